"""Sources (S1-S27): dumps, tables, documents, lists, archives. Network fetches are jobs outside the engine."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SENTINEL = "1970-01-01 00:00:01"


def registry_dump(spark: SparkSession, path: str) -> DataFrame:
    """One row a package of a dump `{"rows": [{"id", "key", "value"}]}`, written one row a line or whole.

    Lines are split by Spark, so a large dump is read in parallel; manifests stay VARIANT. What can't be parsed has
    a null manifest and its text."""
    line = F.regexp_replace(F.trim("value"), r",$", "")
    rows = spark.read.text(path).select(line.alias("raw")).where(F.col("raw").startswith('{"id"') | F.col("raw").startswith('{ "id"'))
    doc = rows.withColumn("doc", F.try_parse_json("raw"))
    return doc.select(F.try_variant_get("doc", "$.id", "string").alias("id"), F.try_variant_get("doc", "$.value", "variant").alias("manifest"), F.when(F.col("doc").isNull(), F.col("raw")).alias("reject"))


def table(spark: SparkSession, path: str) -> DataFrame:
    """S2, S3."""
    return spark.read.parquet(path)


def named(packages: DataFrame, *columns: str) -> DataFrame:
    """Rows with a name."""
    return packages.where("name <> ''").select("name", *columns)


def maintainer_changes_in_order(changes: DataFrame) -> DataFrame:
    """Sorted by package and time; what needs the order of one package alone takes a window instead."""
    return changes.orderBy("package", "release_time")


def lookup(rows: DataFrame, packages: DataFrame, column: str = "name") -> DataFrame:
    """Existence and main file for many names in one join."""
    return rows.join(packages.select(F.col("name").alias(column), "main", F.lit(True).alias("known")), column, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def neighbours(edges: DataFrame, name: str, forwards: bool = True) -> DataFrame:
    """Dependencies (forwards) or dependents of one package."""
    a, b = ("src", "dst") if forwards else ("dst", "src")
    return edges.where(F.col(a) == name).select(F.col(b).alias("name")).distinct()


def changes_of(changes: DataFrame, package: str) -> DataFrame:
    """Changes of a package, times from text, the sentinel where they can't be read."""
    return changes.where(F.col("package") == package).withColumn("release_time", F.coalesce(F.try_to_timestamp(F.col("release_time").cast("string")), F.lit(SENTINEL).cast("timestamp")))


def active_maintainers(counts: DataFrame, year: int, month: int) -> DataFrame:
    """S9."""
    return counts.where((F.year("month") == year) & (F.month("month") == month) & (F.col("count") > 0)).select("name")


def count_grid(counts: DataFrame, months: DataFrame, name: str) -> DataFrame:
    """All months of one name, 0 where it has none."""
    return months.join(counts.where(F.col("name") == name), "month", "left").select("month", F.coalesce("count", F.lit(0)).alias("count"))


def distinct_names(rows: DataFrame) -> DataFrame:
    """S11."""
    return rows.where("name <> ''").select("name").distinct().orderBy("name")


def documents(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Key and value documents, all or by key (pushed to the scan)."""
    rows = spark.read.parquet(path)
    return rows if key is None else rows.where(F.col("key") == key)


def at_time(timeline: Column, when: Column) -> Column:
    """The entry of a timeline array at a time."""
    return F.filter(timeline, lambda x: x["time"] == when)[0]


def reach_of(reach: DataFrame, wanted: DataFrame) -> DataFrame:
    """Reach documents of (package, month) pairs."""
    return wanted.join(reach, ["package", "month"])


def month_cube(spark: SparkSession, path: str, month: str | None = None) -> DataFrame:
    """A cube kept by month; one month reads its folder alone."""
    rows = spark.read.parquet(path)
    return rows if month is None else rows.where(F.col("month") == F.lit(month).cast("date"))


def name_list(spark: SparkSession, path: str, as_json: bool = False) -> DataFrame:
    """Names, one a line (empty ones go) or a JSON array."""
    if as_json:
        return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("name"))
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


def package_list(spark: SparkSession, path: str) -> DataFrame:
    """`name,version` lines; fails on a line of other fields."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.split("value", ",").alias("f"))
    checked = lines.select(F.when(F.size("f") == 2, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not name,version: "), F.array_join("f", ",")))).alias("f"))
    return checked.select(F.trim(F.col("f")[0]).alias("name"), F.trim(F.col("f")[1]).alias("version"))


def literal_packages(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """S18."""
    return spark.createDataFrame(pairs, "name string, version string")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Analysis results, one JSON object a line: package, version, result as JSON text."""
    doc = spark.read.text(path).where("trim(value) <> ''").select(F.try_parse_json("value").alias("d"))
    return doc.select(F.try_variant_get("d", "$.Name", "string").alias("package"), F.try_variant_get("d", "$.Version", "string").alias("version"), F.try_variant_get("d", "$.Result", "string").alias("result"))


def tarball_list(spark: SparkSession, path: str) -> DataFrame:
    """Tarball and shasum of a JSON array."""
    return spark.read.schema("tarball string, shasum string").json(path, multiLine=True)


def vulnerabilities(spark: SparkSession, path: str) -> DataFrame:
    """<path>/<id>/raw.json."""
    schema = "id int, module_name string, publish_date timestamp, patched_versions string, vulnerable_versions string"
    return spark.read.schema(schema).json(f"{path}/*/raw.json", multiLine=True)


def combined_ranges(parts: list[DataFrame]) -> DataFrame:
    """Download ranges of several calls, one row a package and day."""
    from functools import reduce

    return reduce(DataFrame.unionByName, parts).dropDuplicates(["package", "day"])


def blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def unpacked(tarballs: DataFrame, most: int = 250_000) -> DataFrame:
    """Files of tarballs(package, content) up to a size, one archive in memory at a time: package, path, size, content
    (null above the size). An archive that can't be read gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["package", "path", "size", "content", "error"]
        for b in batches:
            for package, content in zip(b["package"], b["content"], strict=True):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(bytes(content)), mode="r:*") as tar:
                        for m in tar:
                            if m.isfile():
                                rows.append((package, m.name, m.size, tar.extractfile(m).read() if m.size <= most else None, None))
                except (tarfile.TarError, OSError, EOFError) as e:
                    rows.append((package, None, None, None, str(e)))
                yield pd.DataFrame(rows, columns=columns).astype({"size": "Int64"})

    return tarballs.select("package", "content").mapInPandas(run, "package string, path string, size long, content binary, error string")
