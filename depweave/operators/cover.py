"""Set cover and trust simulations over reach or cost sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depweave.plans.scratch import cut

from . import bitsets


def _running(counts: DataFrame, order: str, value: str) -> DataFrame:
    """Running sums over ranks. Ranks are summed in blocks first, so no task sorts them all."""
    block = F.floor(F.col(order) / 4096)
    rows = counts.withColumn("_b", block)
    base = rows.groupBy("_b").agg(F.sum(value).alias("_s")).withColumn("_s", F.sum("_s").over(Window.orderBy("_b")) - F.col("_s"))
    inner = F.sum(value).over(Window.partitionBy("_b").orderBy(order))
    return rows.withColumn("_i", inner).join(base, "_b").withColumn("total", F.col("_i") + F.col("_s")).drop("_b", "_i", "_s")


def cover_along(pairs: DataFrame, ranking: DataFrame) -> DataFrame:
    """G1: newly covered and total along a ranking; pairs(name, element), ranking(name, rank). An element counts at
    the least rank that covers it, so nothing is iterated."""
    return _along(pairs.join(ranking, "name").groupBy("element").agg(F.min("rank").alias("rank")).groupBy("rank").agg(F.count("*").alias("new")), ranking)


def cover_along_of(g: bitsets.Graphs, owned: DataFrame, ranking: DataFrame) -> DataFrame:
    """G1 over the reach of what names own, by a pass over a broadcast graph; owned(name, package)."""
    return _along(bitsets.least_counts(g, owned.join(ranking, "name").groupBy("package").agg(F.min("rank").alias("rank"))), ranking)


def _along(first: DataFrame, ranking: DataFrame) -> DataFrame:
    every = ranking.join(first, "rank", "left").select("rank", "name", F.coalesce("new", F.lit(0)).alias("new"))
    return _running(every, "rank", "new").select("rank", "name", "new", "total")


def greedy_cover(pairs: DataFrame, first: str | None = None, limit: int = 20) -> DataFrame:
    """Greedy maximum coverage: rank, name, gain, total. Stops at no gain or at the limit; ties by name.

    A round aggregates the uncovered pairs and drops what the pick covers; one row a round reaches the driver."""
    spark, left, out, total = pairs.sparkSession, cut(pairs.distinct()), [], 0
    while len(out) < limit:
        counts = left.groupBy("name").agg(F.count("*").alias("n"))
        pick = counts.where(F.col("name") == first).first() if first is not None and not out else counts.orderBy(F.desc("n"), "name").first()
        if pick is None:
            break
        total += pick["n"]
        out.append((len(out) + 1, pick["name"], pick["n"], total))
        covered = left.where(F.col("name") == F.lit(pick["name"])).select("element")
        left = cut(left.join(covered, "element", "left_anti"))
    kind = pairs.schema["name"].dataType.simpleString()
    return spark.createDataFrame(out, f"rank int, name {kind}, gain long, total long")


def greedy_cover_of(g: bitsets.Graphs, owned: DataFrame, first: str | None = None, limit: int = 20) -> DataFrame:
    """G2 over the reach of what names own, by bit sets over a broadcast graph; owned(owner, package)."""
    kind = owned.schema["owner"].dataType.simpleString()
    return owned.sparkSession.createDataFrame(bitsets.greedy(g, owned, first, limit), f"rank int, name {kind}, gain long, total long")


def trust_average(pairs: DataFrame, ranking: DataFrame, n: int, limit: int) -> DataFrame:
    """G3 (G5 with owners as elements): average untrusted set size once ranks up to k are trusted, k = 0 to limit + 1.

    pairs(set, element), each set seeded as the caller wants it; n sets."""
    return trust_of_sizes(pairs.groupBy("element").agg(F.count("*").alias("size")), ranking, n, limit)


def trust_of_sizes(sizes: DataFrame, ranking: DataFrame, n: int, limit: int) -> DataFrame:
    """G3, G5 from sizes(element, size): in how many sets each element is."""
    weight = sizes.join(ranking.select(F.col("name").alias("element"), "rank"), "element", "left")
    by = weight.groupBy("rank").agg(F.sum("size").alias("w"))
    total = by.agg(F.sum("w").alias("all"))
    ranks = sizes.sparkSession.range(0, limit + 2).select(F.col("id").alias("k"))
    steps = ranks.join(by.select(F.col("rank").cast("long").alias("k"), "w"), "k", "left").select("k", F.coalesce("w", F.lit(0)).alias("w"))
    return _running(steps, "k", "w").crossJoin(F.broadcast(total)).select("k", ((F.col("all") - F.col("total")) / F.lit(float(n))).alias("average"))


def secured_share(pairs: DataFrame, ranking: DataFrame, n: int, limit: int) -> DataFrame:
    """Share of sets whose elements are all trusted once ranks up to k are; ranks beyond the ranking never are."""
    need = pairs.join(ranking.select(F.col("name").alias("element"), "rank"), "element", "left").groupBy("set").agg(F.max(F.coalesce("rank", F.lit(2147483647))).alias("k"))
    return share_of_needs(need.groupBy("k").agg(F.count("*").alias("w")), n, limit)


def share_of_needs(by: DataFrame, n: int, limit: int) -> DataFrame:
    """G4 from by(k, w): how many sets need ranks up to k."""
    ranks = by.sparkSession.range(0, limit + 2).select(F.col("id").alias("k"))
    steps = ranks.join(by.select(F.col("k").cast("long").alias("k"), "w"), "k", "left").select("k", F.coalesce("w", F.lit(0)).alias("w"))
    return _running(steps, "k", "w").select("k", (F.col("total") / F.lit(float(n))).alias("share"))


def regions(a: DataFrame, b: DataFrame, universe: DataFrame) -> DataFrame:
    """Elements of each region of three sets: flags in_a, in_b, in_universe and a count."""
    mark = lambda df, i: df.select("element", *[F.lit(int(i == j)).alias(f"s{j}") for j in range(3)])
    every = mark(a, 0).unionByName(mark(b, 1)).unionByName(mark(universe, 2)).groupBy("element").agg(*[F.max(f"s{j}").alias(x) for j, x in enumerate(("in_a", "in_b", "in_universe"))])
    return every.groupBy("in_a", "in_b", "in_universe").agg(F.count("*").alias("count"))
