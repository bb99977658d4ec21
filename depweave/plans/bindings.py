"""The package study's tables, bound to the driver's tables. Each is SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VERSION = "concat(o_orderkey % 4, '.', o_orderkey % 9, '.', o_orderkey % 7, CASE WHEN o_orderkey % 6 = 0 THEN concat('-beta.', o_orderkey % 12) ELSE '' END)"

#: In order: a later one may use earlier ones.
VIEWS = {
    "versions": f"SELECT o_custkey AS package, {VERSION} AS version, min(o_orderdate) AS release_time, min(o_orderpriority) AS license FROM orders GROUP BY 1, 2",
    "members": f"SELECT o_custkey AS package, {VERSION} AS version, l_suppkey AS item, min(l_returnflag) AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3",
    "maintainer_changes": "SELECT l_suppkey AS name, l_partkey % 40 AS package, 'ADDED' AS change, '1.0.0' AS version, min(l_shipdate) AS release_time FROM lineitem GROUP BY 1, 2 UNION ALL SELECT l_suppkey, l_partkey % 40, 'REMOVED', '2.0.0', max(l_shipdate) FROM lineitem GROUP BY 1, 2 HAVING min(l_shipdate) < max(l_shipdate) AND min(l_linenumber) = 1",
    "popularity": "SELECT o_custkey AS package, round(sum(o_totalprice), 2) AS overall, round(sum(CASE WHEN o_orderdate >= DATE '2000-01-01' THEN o_totalprice ELSE 0 END), 2) AS year2000 FROM orders GROUP BY 1",
    # every line item is read; a package depends on packages of smaller number, so closures stay small
    "edges": "SELECT DISTINCT l_partkey AS src, CAST(floor(l_partkey / (2 + l_suppkey % 4)) AS BIGINT) AS dst FROM lineitem WHERE l_partkey >= 2 + l_suppkey % 4",
    "dev_edges": "SELECT DISTINCT l_partkey AS src, CAST(floor(l_partkey / (6 + l_linenumber)) AS BIGINT) AS dst FROM lineitem WHERE l_partkey >= 6 + l_linenumber",
    "owned": "SELECT DISTINCT l_suppkey AS owner, l_partkey AS package FROM lineitem",
    "maintainers": "SELECT DISTINCT o_custkey AS package, l_suppkey AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    "downloads": "SELECT event_type AS package, CAST(ts AS DATE) AS day, count(*) AS downloads FROM events GROUP BY 1, 2",
    "files": "SELECT source AS package, lang AS class, count(*) AS n FROM documents GROUP BY 1, 2",
    "packages": "SELECT p_partkey AS name, p_brand AS version, p_type AS main FROM part",
    "licenses": "SELECT c_custkey AS package, CASE WHEN c_custkey % 3 = 0 THEN 'GPL-3' WHEN c_custkey % 3 = 1 THEN 'MIT' ELSE 'LGPL' END AS type FROM customer",
}


def bind(spark: SparkSession, sf_dir: str) -> None:
    """Registers the tables and the bound views."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for name, text in VIEWS.items():
        spark.sql(text).createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One bound view; its tables alone are read."""
    for t in TABLES:
        if name == t or f" {t} " in f"{VIEWS.get(name, '')} ":
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(VIEWS[name]) if name in VIEWS else spark.table(name)


def common(*more: str) -> str:
    """WITH clause of all bound views (and more) for a plain SQL engine."""
    return "WITH RECURSIVE " + ", ".join([*[f"{k} AS ({v})" for k, v in VIEWS.items()], *more]) + " "
