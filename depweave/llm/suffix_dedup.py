"""Suffix-array dedup by threshold-bounded interval expansion (bytes).

Candidate segments are sorted by suffix as far as the threshold needs, their Burrows-Wheeler
transform is extended backwards breadth first: what is known to share l bytes tells, through the
last-to-first mapping, what shares l + 1; so common-prefix lengths come in increasing order, and the
search stops at the threshold. Suffixes not parted by then share a window.

Defined cases: a null or empty text has no bytes; texts under a window's length keep all; equal
texts: the smallest doc_id keeps its bytes; rows that repeat a doc_id don't remove each other's; a null
doc_id neither removes nor loses bytes; an empty table gives no rows; other columns are kept, but for
those named like a result; a text of over 268 million bytes is an error, others may be of any length. Kept bytes may break a character: `kept` drops the broken ones, kept_sha256 is of the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import pieces, view
from ._passages import Plan, covered, merge

WINDOW = 50
BLOCK_BYTES = 512
ANCHOR_BYTES = 24


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text (symbols under 512) ordered by `depth` symbols at least, by doubling."""
    n = len(text)
    x = np.zeros(n + 8, np.uint64)
    x[:n] = text
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << np.uint64(9)) | x[i : i + n]
    have = 7
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order
        s = key[order]
        rank = np.zeros(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[True], s[1:] != s[:-1]])).astype(np.uint64)
        if rank[order[-1]] == n:
            return order
        later = np.zeros(n, np.uint64)
        later[: max(0, n - have)] = rank[have:]
        key = (rank << np.uint64(32)) | later
        have *= 2


def prefixes_by_value(text: np.ndarray, order: np.ndarray, threshold: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it, where under threshold; else threshold."""
    n = len(text)
    bwt = text[order - 1]  # order 0 takes the last symbol
    back = np.argsort(bwt, kind="stable")  # back[p]: the rank whose suffix, extended by one symbol, has rank p
    symbol = bwt[back]
    out = np.full(n, threshold, np.int16)
    out[0] = 0
    out[1:][symbol[1:] != symbol[:-1]] = 0
    left = np.flatnonzero(out == threshold)
    before, after = back[left - 1], back[left]
    new = out == 0
    for value in range(1, threshold):
        if not len(left):
            break
        sums = np.cumsum(new, dtype=np.int32)
        if not sums[-1]:
            break
        found = sums[after] > sums[before]
        hit = left[found]
        out[hit] = value
        new = np.zeros(n, bool)
        new[hit] = True
        if len(hit) * 20 > len(left):
            rest = ~found
            left, before, after = left[rest], before[rest], after[rest]
        elif len(hit):
            rest = np.flatnonzero(~found)
            left, before, after = left[rest], before[rest], after[rest]
    return out


def expansion_kernel(window: int, segments: list[bytes], owners: list[int], last: list[int]):
    """Covered bytes of segments: windows that also start in a smaller owner's segment."""
    size = np.array([len(s) + 1 for s in segments])
    off = np.concatenate([[0], np.cumsum(size)])
    text = np.zeros(off[-1], np.uint16)
    joined = np.frombuffer(b"\0".join([*segments, b""]), np.uint8)
    text[:] = joined
    text += 1
    text[off[1:] - 1] = 0
    own = np.repeat(np.array(owners, np.int64), size)
    order = suffix_order(text, window)
    prefix = prefixes_by_value(text, order, window)
    start = np.flatnonzero(prefix < window)
    least = np.zeros(len(text), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(own[order], start), np.diff(np.concatenate([start, [len(text)]])))

    # Of each segment's windows the least and the greatest: up to the one nothing is covered, beyond the other all.
    ends = np.stack([off[:-1], off[1:] - window], axis=1).reshape(-1)
    low, high = (f.reduceat(least, ends)[::2].tolist() for f in (np.minimum, np.maximum))
    none, whole = np.zeros((0, 2), np.int64), (size - 1).tolist()

    def cover(k: int, doc: int) -> np.ndarray:
        if doc <= low[k]:
            return none
        if doc > high[k]:
            return np.array([[0, whole[k]]])
        at = np.flatnonzero(least[off[k] : off[k + 1] - window] < doc)
        new = np.concatenate([[True], at[1:] > at[:-1] + window])
        return np.stack([at[new], at[np.concatenate([new[1:], [True]])] + window], axis=1)

    return cover


SCHEMA = ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", "kept string"]


def _apply(names: list[str], spans_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            data, off = view(b["text"])
            gone, runs, sums, texts = [], [], [], []
            for r, packed in enumerate(b[spans_name].to_pylist()):
                body = data[off[r] : off[r + 1]]
                spans = merge(np.frombuffer(packed or b"", "<i4").reshape(-1, 2))
                if len(spans):
                    keep = np.ones(len(body), bool)
                    for a, e in spans.tolist():
                        keep[a:e] = False
                    body = body[keep]
                gone.append(int(off[r + 1] - off[r]) - len(body))
                runs.append(len(spans))
                sums.append(hashlib.sha256(body).hexdigest())
                texts.append(body.tobytes().decode(errors="ignore"))
            more = [pa.array(np.diff(off)), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sums), pa.array(texts)]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), *more], [*names, *[x.split()[0] for x in SCHEMA]])

    return run


def suffix_dedup(docs: DataFrame, window: int = WINDOW, anchor_bytes: int = ANCHOR_BYTES, **options) -> DataFrame:
    """docs(doc_id, text, ...) with n_bytes, n_removed, n_spans, kept_sha256 and the kept text; null texts are empty.

    options: hot, hot_batch (see Plan)."""
    docs = docs.drop(*[x.split()[0] for x in SCHEMA])
    plan = Plan("byte", window, anchor_bytes, BLOCK_BYTES, kernel=expansion_kernel, **options)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], *SCHEMA])
    found, spans_name = covered(docs, plan)
    return found.mapInArrow(_apply(docs.columns, spans_name), schema)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("kept", "text")
