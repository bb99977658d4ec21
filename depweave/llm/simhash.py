"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within the radius share a variant that is within half the radius of both. Every
distinct fingerprint goes to the buckets (leading bits of a variant) that its ball reaches; a bucket
makes the variants of its own prefix, sorts them, and links what shares one. All pairs of such a
group are within the radius (each is half of it from the variant), so a star keeps every link that
components need: no group emits all its pairs. Links are verified, joined within the bucket, and
then by star contraction in Spark. A bucket of too many fingerprints is split by further bits, over tasks.

similar() groups documents by the exact likeness of their shingle sets. Its groups begin with those of the
fingerprints; pairs whose fingerprints are further apart than a ball reaches are found by the sets' prefixes.

Defined cases: a null or empty text has fingerprint zero, linked like any other; texts with fewer words
than a shingle are one shingle; equal texts share a fingerprint; rows that repeat are kept; a null doc_id
gets a fingerprint and the component of that fingerprint's others (null without any); an empty table
gives no rows; other columns are ignored, whatever their names; a very long text is hashed in one piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _similar
from ._common import cut, parts_for, pieces, session, text_of, unused

WORDS = 4
RADIUS = 4
SEED = 42
#: Fingerprints whose own prefix is a bucket's, on average; and at most in one step of a bucket.
BUCKET, STEP = 2048, 256
#: Bits by which a full bucket is split at most.
DEEP = 12
#: Edges that are joined to components at once, in the driver (16 bytes each).
FINISH = 1 << 18


def fingerprint(text: str, words: int = WORDS) -> int:
    """64 bits, each 1 if set in over half the XXH64 of the text's word shingles; signed."""
    import xxhash

    parts = text.encode().lower().split()
    if not parts:
        return 0
    line, width = b" ".join(parts), min(words, len(parts))
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(parts) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)
    m = len(h)
    if m % 255:
        h = np.concatenate([h, np.zeros(255 - m % 255, np.uint64)])
    bits = np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 255, 64)
    ones = bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > m).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([fingerprint(t, words) for t in b["text"].to_pylist()], pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks(bits: int, ones: int) -> np.ndarray:
    """All masks of the lowest `bits` bits with up to `ones` set."""
    return np.array([sum(1 << i for i in c) for n in range(ones + 1) for c in combinations(range(bits), n)], np.uint64)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least connected index of each of n."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        old = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == old).all():
            return root


def collide(fps: np.ndarray, radius: int, prefix: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links of the fingerprints that share a variant whose leading `bits` bits are `prefix`."""
    half, low = radius // 2, 64 - bits
    far = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(prefix)) if bits else np.zeros(len(fps), np.uint8)
    keep = (np.uint64(1) << np.uint64(low)) - np.uint64(1) if bits else np.uint64(0xFFFFFFFFFFFFFFFF)
    variants, index = [], []
    for d in range(half + 1):
        at = np.flatnonzero(far == d)
        if len(at):
            m = _masks(low, half - d)
            variants.append(((fps[at] & keep)[:, None] ^ m[None, :]).reshape(-1))
            index.append(np.repeat(at, len(m)))
    if not variants:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    v, i = np.concatenate(variants), np.concatenate(index)
    order = np.argsort(v)
    v, i = v[order], i[order]
    same = v[1:] == v[:-1]
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    size = np.diff(np.concatenate([start, [len(v)]]))
    many = size > 1
    first = np.minimum.reduceat(i, start)
    a, b = np.repeat(first[many], size[many]), i[np.repeat(many, size)]
    pair = np.unique(a[a != b] * len(fps) + b[a != b])
    a, b = pair // len(fps), pair % len(fps)
    near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
    return a[near], b[near]


def links(nodes: DataFrame, radius: int, bits: int, parts: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a < b) between the ids of nodes(fp, id) that hold all connections within the radius.

    Fingerprints are counted by their `bits` leading bits. Where these hold over four times `bucket`, their variants
    go by more bits, as many as bring a share under `bucket` were they spread evenly, up to DEEP.
    """
    half = radius // 2
    top = F.shiftrightunsigned("fp", 64 - bits) if bits else F.lit(0).cast("long")
    masks = _masks(bits, half)
    reach = F.explode(F.array(*[F.struct(top.bitwiseXOR(F.lit(int(m))).alias("bucket"), F.lit(half - int(m).bit_count()).alias("left")) for m in masks]))
    full = nodes.groupBy(top.alias("bucket")).count().where(F.col("count") > 4 * bucket)
    deep = full.select("bucket", F.least(F.lit(DEEP), F.ceil(F.log2(F.col("count") / bucket))).cast("int").alias("more"))
    spread = nodes.select("fp", "id", reach.alias("x")).select("fp", "id", "x.*").join(deep, "bucket", "left").withColumn("more", F.coalesce("more", F.lit(0)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of buckets that are split, for every part that their variants reach."""
        for b in batches:
            more, left = b["more"].to_numpy(), b["left"].to_numpy()
            at, sub = [np.flatnonzero(more == 0)], [np.zeros((more == 0).sum(), np.int64)]
            for m in np.unique(more[more > 0]).tolist():
                for ones in range(half + 1):
                    rows = np.flatnonzero((more == m) & (left == ones))
                    if len(rows):
                        flips = _masks(m, ones)
                        own = (b["fp"].to_numpy()[rows].view(np.uint64) >> np.uint64(64 - bits - m)) & np.uint64((1 << m) - 1)
                        at.append(np.repeat(rows, len(flips)))
                        sub.append((own[:, None] ^ flips[None, :]).reshape(-1).astype(np.int64))
            take = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([*(b[c].take(take) for c in ("fp", "id", "bucket", "more")), pa.array(np.concatenate(sub))], ["fp", "id", "bucket", "more", "sub"])

    def solve(prefix: int, depth: int, fps: np.ndarray, ids: np.ndarray) -> pa.RecordBatch | None:
        order = np.argsort(ids)
        fps, ids = fps[order], ids[order]
        own = int((fps >> np.uint64(64 - depth) == np.uint64(prefix)).sum()) if depth else len(fps)
        more = min(16, max(0, math.ceil(math.log2(max(1, own / STEP)))))
        pairs = []
        for sub in range(1 << more):
            p, n = (prefix << more) | sub, depth + more
            at = np.flatnonzero(np.bitwise_count((fps >> np.uint64(64 - n)) ^ np.uint64(p)) <= half) if n else np.arange(len(fps))
            a, b = collide(fps[at], radius, p, n)
            pairs.append((at[a], at[b]))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        if not len(a):
            return None
        root = roots(len(ids), a, b)
        b = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[root[b]]), pa.array(ids[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def close() -> pa.RecordBatch | None:
            prefix, more, sub = now
            return solve((prefix << more) | sub, bits + more, *(np.concatenate(y) for y in zip(*held, strict=True)))

        for x in batches:
            keys = np.stack([x[c].to_numpy().astype(np.int64) for c in ("bucket", "more", "sub")])
            fp, ids = x["fp"].to_numpy().view(np.uint64), x["id"].to_numpy()
            edge = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(ids)]
            for lo, hi in zip(edge, edge[1:], strict=False):
                if lo == hi:
                    continue
                if held and tuple(keys[:, lo].tolist()) != now:
                    if (out := close()) is not None:
                        yield out
                    held = []
                now = tuple(keys[:, lo].tolist())
                held.append((fp[lo:hi].copy(), ids[lo:hi].copy()))
        if held and (out := close()) is not None:
            yield out

    spread = spread.mapInArrow(dealt, "fp long, id long, bucket long, more int, sub long").repartition(parts, "bucket", "sub")
    return spread.sortWithinPartitions("bucket", "more", "sub").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """id and least connected id (component) of all ids in edges(a, b); alternating star contraction, until `finish`
    edges or fewer are left, which are joined at once."""
    now, mark = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not new[0] or new == mark:
            return now.select(F.col("b").alias("id"), F.col("a").alias("component"))
        if new[0] <= finish:
            t = now.toArrow()
            ids, at = np.unique(np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()]), return_inverse=True)
            root = roots(len(ids), at[: len(t)], at[len(t) :])
            other = np.flatnonzero(root != np.arange(len(ids)))
            found = pa.table({"id": ids[other], "component": ids[root[other]]})
            return cut(session(now).createDataFrame(found, "id long, component long"), now)
        mark = new
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = cut(both.where("b > a").join(low, "a").where("m <> b").select(F.col("m").alias("a"), "b").distinct(), now)
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y")
        now = cut(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), large)


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row of docs(doc_id, text)."""
    spark = session(docs)
    rows = cut(fingerprints(docs, words))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id is not null"))
    n = nodes.count()
    bits = min(24, max(0, math.ceil(math.log2(max(1, n / BUCKET)))))
    parts = max(parts_for(nodes, 1 << 20), min(1 << bits, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2))
    joined = components(links(nodes, radius, bits, parts))
    found = nodes.join(joined, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return rows.join(found, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar(docs: DataFrame, words: int = 5, likeness: int = _similar.LIKENESS, few: int = _similar.FEW, block: int = _similar.BLOCK) -> DataFrame:
    """Every row of docs(doc_id, text, ...) with component_id (the least doc_id) and is_first (whether it is the row
    that stands for its component; of rows that repeat it, all): texts of shingle sets at least `likeness` per cent
    alike are linked (`few` and `block` change only how _similar searches). Rows without a doc_id have neither; a
    doc_id's different texts are apart."""
    out = docs.drop("component_id", "is_first")
    (hashed,) = unused(out, "text_hash")
    out = out.withColumn(hashed, F.xxhash64(text_of("text")))
    base = out.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"), F.col(hashed).alias("sum"))
    hints = near_duplicates(base, words).select("doc_id", F.col("component_id").alias("hint")).distinct()
    found = cut(_similar.groups(base, hints, components, words, likeness, few, block).distinct())
    least = found.groupBy("component").agg(F.min(F.struct("doc_id", "sum")).alias("least"))
    rows = found.join(least, "component").select(F.col("doc_id").alias("k"), F.col("sum").alias("s"), F.col("least.doc_id").alias("component_id"), ((F.col("least.doc_id") == F.col("doc_id")) & (F.col("least.sum") == F.col("sum"))).alias("is_first"))
    return out.join(rows, (F.col("doc_id") == F.col("k")) & (F.col(hashed) == F.col("s")), "left").drop("k", "s", hashed)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
