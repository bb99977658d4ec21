"""Shared pieces of the training-data operators: scratch tables, Arrow views, hashing, ranges."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the polynomial hashes, and the finalizer's constants.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Text bytes that one numpy step works on; temporaries take about fifty times as much.
CHUNK_BYTES = 1 << 20


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, with as many underscores after them as keep them apart from df's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where that setting is absent a temporary folder serves a session of one process (tests); on a cluster, whose
    executors would each write to their own disk, it is an error.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="depweave-")
        context.setCheckpointDir(top)
    return f"{top.rstrip('/')}/depweave-{context.applicationId}/{uuid.uuid4().hex}"


#: Removes a query's shuffle files when the query ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends, a lost executor costs nothing.

    The write's shuffle files go when it ends. `done`: results of cut() that nothing needs from here on; their
    files are deleted. What is left lies in one folder of the application.
    """
    spark, path = session(df), scratch(session(df))
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before) if before is not None else spark.conf.unset(CLEAN)
    drop(*done)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*done: DataFrame) -> None:
    """Deletes the files of results of cut()."""
    for df in done:
        if path := getattr(df, "cut_path", None):
            jvm = session(df).sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(session(df).sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def worker_cache() -> dict:
    """What a Python worker keeps between its tasks. Code travels by value, so a module's globals don't last."""
    return sys.__dict__.setdefault("_depweave_cache", {})


def size_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of df as Catalyst estimates them from the files; counted where it can't tell."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n >= 1 << 60:
        n = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return n


def parts_for(df: DataFrame, each: int, text: str = "text") -> int:
    """Partitions of about `each` estimated bytes, and no fewer than the session's."""
    return max(int(session(df).conf.get("spark.sql.shuffle.partitions")), -(-size_bytes(df, text) // each), 1)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary array (null: empty) and its n + 1 offsets, without a copy."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    big = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64 if big else np.int32, arr.offset + len(arr) + 1)[arr.offset :].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], col: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds about `limit` bytes of col, one row at least."""
    for b in batches:
        _, off = view(b.column(b.schema.get_field_index(col)))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
            yield b.slice(lo, min(hi, b.num_rows) - lo)
            lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i < n, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        m, inv = 1 << max(16, int(n - 1).bit_length()), np.uint64(pow(int(BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(m - 1, x, np.uint64))), dtype=np.uint64) for x in (BASE, inv)]
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] that depend on those bytes alone."""
    pw, inv = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(pw[: len(data)] * (data.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * MIX2)


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive symbols (uint64), by doubling; len(symbols) - k + 1 of them."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have, width, out, done, base = symbols, 1, None, 0, int(BASE)
    while True:
        if k & width:
            out = have if out is None else out[: len(symbols) - done - width + 1] * np.uint64(pow(base, width, 1 << 64)) + have[done:][: len(symbols) - done - width + 1]
            done += width
        if done == k:
            return mix(out[:n])
        have = have[:-width] * np.uint64(pow(base, width, 1 << 64)) + have[width:]
        width *= 2


#: Bytes \x20 and \x09-\x0D separate words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n + 1 offsets into them by row; gap says which bytes part words."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~gap[data]
    step = np.diff(word)
    begins, ends = step[:-1] == 1, step[1:] == -1
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    both = inner[(word[inner + 1] == 1) & (word[inner] == 1)]  # a row's end parts words too
    begins[both], ends[both - 1] = True, True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, off)


#: Slices of a range that are weighed apart, and quantiles that one aggregate is asked for.
SLICES, ASKED = 8, 2048


def ranged(docs: DataFrame, parts: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds int column pid: ranges of ascending key (null: lowest) of about equal bytes of text.

    Approximate quantiles cut the keys into SLICES times as many slices as ranges, of about equal counts (in two
    levels where they are many); the slices' bytes are summed, and neighbouring slices join to ranges; a slice of
    very long texts is cut again. SLICES
    numbers a range reach the driver (Spark's own range partitioner takes a hundred keys a range there).
    """
    low = -(1 << 63)
    value = F.coalesce(F.col(key).cast("long"), F.lit(low))

    def place(at: np.ndarray) -> Column:
        @F.pandas_udf("int")
        def pid(ids: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(at, ids.to_numpy(), side="left").astype(np.int32))

        return pid(value)

    def quantiles(n: int) -> Column:
        return F.percentile_approx(value, [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("q")

    if parts < 2:
        return docs.withColumn("pid", F.lit(0))
    n = min(ASKED, SLICES * parts)
    splits = np.unique(np.array(docs.agg(quantiles(n)).first()[0] or [], np.int64))
    if (more := -(-SLICES * parts // n)) > 1:
        inner = docs.groupBy(place(splits).alias("slice")).agg(quantiles(more)).collect()
        splits = np.unique(np.concatenate([splits, *[np.array(r["q"] or [], np.int64) for r in inner]]))
    size = np.zeros(len(splits) + 1)
    for r in docs.groupBy(place(splits).alias("slice")).agg(F.sum(F.octet_length(text) + 64).alias("n")).collect():
        size[r["slice"]] = r["n"] or 64
    # A slice that alone would fill half a range is cut again, by counts.
    share = size.sum() / parts
    if len(heavy := np.flatnonzero(size > share / 2)):
        k = int(min(256, np.ceil(4 * size.max() / share)))
        inner = docs.where(place(splits).isin(heavy.tolist())).groupBy(place(splits).alias("slice")).agg(quantiles(k)).collect() if k > 1 else []
        extra = {r["slice"]: np.setdiff1d(np.array(r["q"] or [], np.int64), splits) for r in inner}
        size = np.concatenate([np.full(len(extra.get(i, ())) + 1, x / (len(extra.get(i, ())) + 1)) for i, x in enumerate(size.tolist())])
        splits = np.unique(np.concatenate([splits, *extra.values()]))
    ends = np.cumsum(size)
    whole = np.minimum(parts - 1, ((ends - size / 2) * parts / max(1.0, ends[-1])).astype(np.int64))
    return docs.withColumn("pid", place(splits[whole[1:] != whole[:-1]]))
