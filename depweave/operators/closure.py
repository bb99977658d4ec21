"""Transitive reach and cost over dependency edges (R1-R17), semi-naive: only new pairs go on.

edges: (keys..., src, dst), src depends on dst. Keys (such as month) part disjoint graphs that are closed
together. Start nodes are not seeded: a node reaches itself when it lies on a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depweave.plans.scratch import cut

from . import bitsets


def closure(edges: DataFrame, sources: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """R1 (R2 on reversed edges): keys, src, dst, layer (fewest steps) and via (least node before dst).

    sources(keys..., src) restricts the starts. Every round joins the frontier, not all pairs, with the edges,
    and writes the new pairs to the shared folder.
    """
    k = list(keys)
    steps = edges.select(*k, "src", "dst").distinct()
    first = steps if sources is None else steps.join(sources.select(*k, "src").distinct(), [*k, "src"], "left_semi")
    frontier = cut(first.select(*k, "src", "dst", F.lit(1).alias("layer"), F.col("src").alias("via")))
    seen, layer = frontier, 1
    hop = steps.select(*k, F.col("src").alias("dst"), F.col("dst").alias("next"))
    while not frontier.isEmpty():
        layer += 1
        reached = frontier.join(hop, [*k, "dst"]).groupBy(*k, "src", F.col("next").alias("to")).agg(F.min("dst").alias("via"))
        new = reached.withColumnRenamed("to", "dst").join(seen.select(*k, "src", "dst"), [*k, "src", "dst"], "left_anti")
        frontier = cut(new.select(*k, "src", "dst", F.lit(layer).alias("layer"), "via"))
        seen = seen.unionByName(frontier)
    return seen


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumnRenamed("src", "_s").withColumnRenamed("dst", "src").withColumnRenamed("_s", "dst")


def reach(edges: DataFrame, sources: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Dependents of src, by layer of breadth-first search."""
    return closure(reversed_edges(edges), sources, keys)


def sizes(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Reached nodes of each source."""
    return pairs.groupBy(*keys, "src").agg(F.countDistinct("dst").alias("count"))


def combined(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Size of the union over all sources."""
    return pairs.groupBy(*keys).agg(F.countDistinct("dst").alias("count"))


def layers(pairs: DataFrame) -> DataFrame:
    """Nodes first reached at each layer from any source."""
    return pairs.groupBy("dst").agg(F.min("layer").alias("layer")).groupBy("layer").agg(F.count("*").alias("count"))


def reach_with_dev(edges: DataFrame, dev_edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Reach over regular edges, and the direct dev dependents of all that is visited."""
    regular = reach(edges, sources).select("src", "dst").distinct()
    visited = regular.unionByName(sources.select("src", F.col("src").alias("dst"))).distinct()
    dev = visited.join(dev_edges.select(F.col("dst"), F.col("src").alias("user")), "dst").select("src", F.col("user").alias("dst"))
    return regular.unionByName(dev).distinct()


def labelled(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sorted labels of a source's reach."""
    label = F.format_string("%02d_%s_%s", "layer", F.col("dst").cast("string"), F.col("via").cast("string"))
    return pairs.groupBy(*keys, "src").agg(F.sort_array(F.collect_list(label)).alias("labels"))


def owner_reach(pairs: DataFrame, owned: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per owner the union of the reach of what it owns; owned(keys..., owner, package)."""
    return owned.join(pairs.withColumnRenamed("src", "package"), [*keys, "package"]).groupBy(*keys, "owner").agg(F.countDistinct("dst").alias("count"))


def owner_detail(pairs: DataFrame, owned: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Reach of each owned package, largest first within its owner."""
    counted = owned.join(sizes(pairs, keys).withColumnRenamed("src", "package"), [*keys, "package"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "owner").orderBy(F.desc("count"), "package")))


def owner_cost(pairs: DataFrame, owned: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Owners of a package and of all it depends on; pairs(src, dst) of costs."""
    nodes = owned.select(*keys, F.col("package").alias("src"), F.col("package").alias("dst")).unionByName(pairs.select(*keys, "src", "dst")).distinct()
    return nodes.join(owned.select(*keys, F.col("package").alias("dst"), "owner"), [*keys, "dst"]).groupBy(*keys, "src").agg(F.countDistinct("owner").alias("count"))


def cost_sizes(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """R4, R8 from edges(keys..., src, dst), without pairs where the graphs are within bitsets.EDGES."""
    g = bitsets.graphs(edges, keys)
    return sizes(closure(edges, keys=keys), keys) if g is None else bitsets.cost_sizes(g)


def reach_with_dev_of(edges: DataFrame, dev_edges: DataFrame, sources: DataFrame) -> DataFrame:
    """R7, its pairs made by blocks of users where the graph is within bitsets.EDGES: none is shuffled."""
    g = bitsets.graphs(edges, nodes=sources.select("src"), also=dev_edges)
    return reach_with_dev(edges, dev_edges, sources) if g is None else bitsets.reach_pairs(g)


def windowed_union_of(edges: DataFrame, width: int = 10) -> DataFrame:
    """R17 from edges(year, src, dst), without pairs where the graphs are within bitsets.EDGES."""
    g = bitsets.graphs(edges, ("year",))
    return windowed_union(reach(edges, keys=("year",)), width) if g is None else bitsets.windows(g, width)


def owner_reach_of(edges: DataFrame, owned: DataFrame) -> DataFrame:
    """R10 from edges(src, dst), without pairs where the graph is within bitsets.EDGES; owned(owner, package)."""
    g = bitsets.graphs(edges)
    return owner_reach(reach(edges), owned) if g is None else bitsets.owner_sizes(g, owned)


def owner_cost_of(edges: DataFrame, owned: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """R12, R13 from edges(keys..., src, dst), without pairs where the graphs are within bitsets.EDGES; owned(owner,
    package) holds in all keys that edges have."""
    g = bitsets.graphs(edges, keys, owned.select("package").where("package is not null"))
    if g is None:
        return owner_cost(closure(edges, keys=keys), owned.join(edges.select(*keys).distinct()) if keys else owned, keys)
    return bitsets.owner_costs(g, owned)


def ranked(counts: DataFrame, name: str, every: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """Names by count, ties by name; names of `every` that lack a count have 0. With top: a top-k, no full sort."""
    rows = counts if every is None else every.select(name).distinct().join(counts, name, "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rows = rows.orderBy(F.desc("count"), name)
    return rows if top is None else rows.limit(top)


def positions(counts: DataFrame, name: str, to: str = "name") -> DataFrame:
    """Rank of every name by count, ties by name, without one task that sorts them all: ranges of the order are
    written, and each gets the rows of the ranges before it as its offset."""
    placed = cut(counts.select(F.col(name).alias(to), "count").repartitionByRange(F.desc("count"), F.asc(to)).withColumn("_p", F.spark_partition_id()))
    before = placed.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(F.desc("count"), to))
    return placed.withColumn("_i", inner).join(before, "_p").select(to, (F.col("_before") + F.col("_i")).alias("rank"))


def windowed_union(pairs: DataFrame, width: int = 10) -> DataFrame:
    """Year, rank: size of the union of `width` consecutive ranks' sets; whole windows only.

    Each member of a set at rank r counts in windows r - width + 1 to r, so rows are expanded by the width and
    counted distinct: no window holds sets.
    """
    size = pairs.groupBy("year", "src").agg(F.countDistinct("dst").alias("count"))
    last = size.groupBy("year").agg(F.count("*").alias("last"))
    placed = cut(size.repartitionByRange("year", F.desc("count"), F.asc("src")).withColumn("_p", F.spark_partition_id()))
    parts = placed.groupBy("year", "_p").agg(F.count("*").alias("_n"))
    before = parts.select("year", "_p", (F.sum("_n").over(Window.partitionBy("year").orderBy("_p")) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("year", "_p").orderBy(F.desc("count"), "src"))
    rank = placed.withColumn("_i", inner).join(before, ["year", "_p"]).select("year", "src", (F.col("_before") + F.col("_i")).alias("rank")).join(F.broadcast(last), "year")
    spread = pairs.join(rank, ["year", "src"]).select("year", "dst", "last", F.explode(F.sequence(F.greatest(F.lit(1), F.col("rank") - width + 1), F.col("rank"))).alias("rank"))
    return spread.where(F.col("rank") + width - 1 <= F.col("last")).groupBy("year", "rank").agg(F.countDistinct("dst").alias("count"))


def store(pairs: DataFrame, path: str) -> None:
    """Reach rows as a table in folders by month."""
    pairs.write.mode("overwrite").partitionBy("month").parquet(path)
