"""Sinks (K1-K18): tables, documents, graph CSVs and series. All write through Spark, to any path it knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Header rows of the graph's files: fixed values.
NODE_HEADERS = {"package": ["name:ID"], "module": ["moduleId:ID", "moduleName"], "class": ["classId:ID"], "function": ["functionId:ID", "functionName", "functionType"]}
EDGE_HEADER = [":START_ID", ":END_ID"]


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    """K1, K3-K5: rows of a table, kept by a column for pruning if one is named."""
    w = df.write.mode("append")
    (w.partitionBy(by) if by else w).parquet(path)


def first_by(df: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """The first row of each key in an order."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def license_rows(df: DataFrame) -> DataFrame:
    """K3: license versions are stored one second later."""
    return df.withColumn("release_time", F.col("release_time") + F.expr("interval 1 second"))


def missing(rows: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """K6: what a resumed job has still to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def without(rows: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """K6: documents after the removal of some."""
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def write_results(df: DataFrame, path: str, form: str = "json") -> None:
    """K7: one JSON object a line, or CSV."""
    (df.write.mode("overwrite").json(path) if form == "json" else df.write.mode("overwrite").csv(path, header=False))


def write_graph(graph: dict[str, DataFrame], path: str) -> None:
    """A folder a table with distinct rows, and one of its header."""
    for name, df in graph.items():
        header = NODE_HEADERS.get(name, EDGE_HEADER)
        df.distinct().write.mode("overwrite").csv(f"{path}/{name}", quoteAll=True)
        df.sparkSession.createDataFrame([tuple(header)], ", ".join(f"c{i} string" for i in range(len(header)))).write.mode("overwrite").csv(f"{path}/{name}-header")


def ratios(df: DataFrame, column: str = "ratio") -> DataFrame:
    """Two decimals."""
    return df.withColumn(column, F.format_string("%.2f", column))


def series_rows(series: DataFrame) -> DataFrame:
    """One JSON list a key, with the folder of its first letter; slashes and spaces are dropped from names."""
    name = F.regexp_replace("key", r"[/ ]", "")
    return series.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("month", "count"))).alias("s")).select(F.substring(name, 1, 1).alias("letter"), name.alias("file"), F.to_json(F.transform("s", lambda x: x["count"])).alias("value"))


def write_series(series: DataFrame, path: str) -> None:
    series_rows(series).write.mode("overwrite").partitionBy("letter").json(path)
