"""Sharding by balanced label propagation, in DataFrame operations alone.

Every document starts in a shard by hash. Documents of one group are linked, each with all others; their votes are
summed by group and shard, so no link is written out. In each round a group looks for the shard that holds most of it,
of those that have room for the rest of it; shards take the groups that ask, whole, in a fixed order, up to a quota;
rounds go on until nothing moves. At last the documents are put in shard order and the order
is cut into equal weights, so sizes are even (law "bytes": of the bytes; law "rows": of the counts) and
few links that propagation saved are cut again. Law "key" hashes doc_id and the shard count by highest
rendezvous: one more shard takes rows only into itself. What is cut is reported by row: copies, and those elsewhere.

Windows run over cells of (shard, hash cell, salt), never over a shard or a group of copies; the number of
cells is a constant, so their running sums are small at any size. A group that no shard has room for stays spread.

Defined cases: a null text weighs 1 and has checksum 0, and is a copy of an empty text; a null doc_id hashes
as any value; rows that repeat are kept, each with its own slot; very long texts weigh what they are; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

SHARDS = 8
#: Rounds at most; they end when nothing moves.
ROUNDS = 10
#: A shard may hold this much above its share while documents move.
SLACK = 0.25
CELLS, SALTS = 64, 16


def _running(df: DataFrame, cell: list[str], order: list[str], weight: str) -> DataFrame:
    """Adds `before`: the weights of all rows before this one, in the order of cells and then of `order`.

    Cells are few (a constant), so their own running sum is one small window, broadcast.
    """
    sums = df.groupBy(*cell).agg(F.sum(weight).alias("_w"))
    whole = Window.orderBy(*cell)
    base = sums.select(*cell, (F.sum("_w").over(whole) - F.col("_w")).alias("_base"))
    inner = Window.partitionBy(*cell).orderBy(*order)
    local = df.withColumn("_in", F.sum(weight).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight))
    return local.join(F.broadcast(base), cell).withColumn("before", F.col("_base") + F.col("_in")).drop("_base", "_in")


def targets(nodes: DataFrame, room: list[int]) -> DataFrame:
    """grp, to, asks (weight that has to move): groups that want into the shard that holds most of them (of equals the
    first), of those with room for the rest, and are not whole yet."""
    shards = range(len(room))
    held = nodes.groupBy("grp").agg(F.sum("size").alias("all"), *[F.sum(F.when(F.col("shard") == s, F.col("size")).otherwise(0)).alias(f"s{s}") for s in shards])
    fit = F.filter(F.array(*[F.struct(F.col(f"s{s}").alias("w"), F.lit(-s).alias("n")) for s in shards]), lambda x: F.col("all") - x["w"] <= F.array(*[F.lit(r) for r in room])[-x["n"]])
    return held.select("grp", "all", F.array_max(fit).alias("b")).select("grp", (-F.col("b.n")).cast("int").alias("to"), (F.col("all") - F.col("b.w")).alias("asks")).where("asks > 0")


def propagate(nodes: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """nodes(id, grp, size, shard) after rounds of moves; nodes without a group stay."""
    now = cut(nodes.select("id", "grp", F.col("size").cast("long").alias("size"), "shard"))
    for _ in range(rounds):
        load = {r["shard"]: r["n"] for r in now.groupBy("shard").agg(F.sum("size").alias("n")).collect()}  # a number a shard
        quota = int(sum(load.values()) / shards * (1 + slack)) + 1
        room = [max(0, quota - load.get(s, 0)) for s in range(shards)]
        asking = cut(targets(now.where("grp is not null"), room).withColumn("cell", F.pmod(F.xxhash64("grp"), F.lit(CELLS * SALTS))))
        inside = _running(asking, ["to", "cell"], ["grp"], "asks")
        first = asking.groupBy("to").agg(F.sum("asks").alias("w"))
        first = first.select("to", (F.sum("w").over(Window.orderBy("to")) - F.col("w")).alias("zero"))
        takes = cut(inside.join(F.broadcast(first), "to").where(F.col("before") - F.col("zero") + F.col("asks") <= F.array(*[F.lit(r) for r in room])[F.col("to")]).select("grp", "to"), asking)
        if takes.isEmpty():
            break
        now = cut(now.join(takes, "grp", "left").select("id", "grp", "size", F.coalesce("to", "shard").alias("shard")), now, takes)
    return now


def rendezvous(key: Column, shards: int) -> Column:
    """The shard of highest hash with the key."""
    tries = [F.struct(F.xxhash64(key, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return (F.greatest(*tries) if shards > 1 else tries[0])["s"]


def shard(docs: DataFrame, law: str = "bytes", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, copies (rows of an equal text) and copies_elsewhere (of
    these in other shards: cut links) of every row of docs(doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("copy"))
    # equal rows share an id: their order does not matter, and they move together
    rows = cut(rows.withColumn("id", F.xxhash64("doc_id", "copy")))
    if law == "key":
        grown = rendezvous(F.col("doc_id"), shards + 1)
        placed = rows.select("*", rendezvous(F.col("doc_id"), shards).alias("shard"), grown.alias("grown_shard")).withColumn("label", F.col("shard"))
    else:
        weight = F.col("size") if law == "bytes" else F.lit(1).cast("long")
        several = rows.groupBy("copy").agg(F.count("*").alias("n")).where("n > 1").select("copy", F.col("copy").alias("grp"))
        start = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(shards)).cast("int").alias("shard")
        nodes = rows.groupBy("id", "copy").agg(F.sum(weight).alias("size")).join(several, "copy", "left").select("id", "grp", "size", start)
        labels = propagate(nodes, shards, rounds)
        every = rows.join(labels.select("id", F.col("shard").alias("label")), "id").withColumn("weight", weight)
        every = every.withColumn("cell", F.pmod(F.xxhash64("copy"), F.lit(CELLS)).cast("int")).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(SALTS)).cast("int"))
        every = cut(_running(every, ["label", "cell", "salt"], ["copy", "id"], "weight"))
        total = every.agg(F.sum("weight")).first()[0] or 1
        # a row belongs where its middle (law "bytes") or its start (law "rows") falls
        middle = F.col("before") * 2 + (F.col("weight") if law == "bytes" else F.lit(0))
        placed = every.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * total))).cast("int")).withColumn("grown_shard", F.lit(None).cast("int")).drop("before", "weight")
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(CELLS * SALTS)).cast("int")).withColumn("one", F.lit(1).cast("long"))
    ordered = _running(placed, ["shard", "cell"], ["id"], "one")
    zero = placed.groupBy("shard").agg(F.count("*").alias("n"))
    zero = zero.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("zero"))
    ordered = ordered.join(F.broadcast(zero), "shard")
    here = placed.groupBy("copy", "shard").agg(F.count("*").alias("here"))
    copies = here.groupBy("copy").agg(F.sum("here").alias("copies")).where("copies > 1")
    apart = here.join(copies, "copy").select("copy", "shard", "copies", (F.col("copies") - F.col("here")).alias("copies_elsewhere"))
    return ordered.join(apart, ["copy", "shard"], "left").select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("before") - F.col("zero")).alias("slot"), "grown_shard", F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("copies_elsewhere", F.lit(0)).alias("copies_elsewhere"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
