"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph ends at a line's end, after a sentence mark (also wide ones), and where the content says so (a hash
of the last eight bytes), some 48 bytes apart: a text of any kind beyond a few words has several. Equal ones are
told apart by their count so far. A paragraph's 64-bit digest goes into one cell in each third of a sketch; a cell holds a count, the sum of
its digests and the sum of their check values. Two sketches subtract cell by cell; peeling cells that
hold one digest recovers what differs. Where peeling sticks, both texts get a sketch four times larger,
until it ends; so the likeness (shared by all paragraphs) is exact.

Defined cases: a null or empty text has no paragraph; two such texts are alike (1.0); equal texts have
equal fingerprints; a single row is its own next document; rows that repeat are kept and follow each
other, equal doc_ids in descending order of a hash of their texts; a null doc_id comes last in descending order; an
empty table gives no rows; other columns are ignored, whatever their names; a very long text is read in one piece,
in about sixty times its size of memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import MIX1, SPACE, gram_hashes, mix, parts_for, pieces, ranged, span_hashes, text_of

#: Bytes that a content boundary looks at, and how far such boundaries are apart on average.
GRAM, AVERAGE = 8, 48
#: Bytes that end a paragraph: a line's end, and . ! ? ; in UTF-8 also the wide 。！？；
MARK = np.zeros(256, bool)
MARK[list(b"\n\r.!?;")] = True
WIDE = ["。".encode(), "！".encode(), "？".encode(), "；".encode()]
#: Text bytes of a range of documents.
PART_BYTES = 128 << 20
CELLS = 12
GROWTH = 4
CHECK = np.uint64(0xD6E8FEB86659FD93)
SEEDS = tuple(np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def paragraphs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and ends of all paragraphs of texts (bytes and offsets), without white space at their ends."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none
    last = np.zeros(len(data), bool)  # the last byte of a paragraph
    last[off[1:][np.diff(off) > 0] - 1] = True
    last |= MARK[data]
    grams = gram_hashes(data.astype(np.uint64) + np.uint64(1), GRAM)
    at = np.flatnonzero(grams % np.uint64(AVERAGE) == 0)
    inside = np.searchsorted(off, at, side="right") == np.searchsorted(off, at + GRAM - 1, side="right")  # in one text
    last[at[inside] + GRAM - 1] = True
    for mark in WIDE:
        hit = (data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2])
        last[np.flatnonzero(hit) + 2] = True
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends[:-1]])
    ink = np.flatnonzero(~SPACE[data])
    first, after = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
    some = after > first  # others are white space alone
    starts, ends = ink[first[some]], ink[after[some] - 1] + 1
    return np.searchsorted(off, starts, side="right") - 1, starts, ends


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 64-bit digests of the texts' paragraphs, distinct within a text; rows ascend."""
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    row, starts, ends = paragraphs(data, off)
    if not len(row):
        return row, np.zeros(0, np.uint64)
    h = span_hashes(data, starts, ends)
    order = np.lexsort((h, row))
    same = np.concatenate([[False], (h[order[1:]] == h[order[:-1]]) & (row[order[1:]] == row[order[:-1]])])
    at = np.arange(len(h))
    n = at - np.maximum.accumulate(np.where(same, 0, at))  # equal ones before it in its text
    return row[order], mix(h[order] + (n + 1).astype(np.uint64) * MIX1)


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    third = np.uint64(cells // 3)
    return np.stack([(mix(keys ^ s) % third + third * np.uint64(i)).astype(np.int64) for i, s in enumerate(SEEDS)])


def _add(cells: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
    np.add.at(cells[0], at, sign)
    np.add.at(cells[1], at, keys * sign.view(np.uint64))
    np.add.at(cells[2], at, mix(keys ^ CHECK) * sign.view(np.uint64))


def sketch(keys: np.ndarray, row: np.ndarray, rows: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and check sums of all rows' cells; row[i] holds keys[i]."""
    out = np.zeros(rows * cells, np.int64), np.zeros(rows * cells, np.uint64), np.zeros(rows * cells, np.uint64)
    one = np.ones(len(keys), np.int64)
    for at in _places(keys, cells):
        _add(out, at + row * cells, keys, one)
    return out


def peel(count: np.ndarray, total: np.ndarray, check: np.ndarray, rows: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests recovered from each row's subtracted cells, and whether all were."""
    found = np.zeros(rows, np.int64)
    todo = np.flatnonzero(count)
    while True:
        at = todo[np.abs(count[todo]) == 1]
        sign = count[at]
        key = total[at] * sign.view(np.uint64)
        pure = mix(key ^ CHECK) * sign.view(np.uint64) == check[at]
        at, key, sign = at[pure], key[pure], sign[pure]
        if not len(at):
            break
        row = at // cells
        _, first = np.unique(mix(row.astype(np.uint64)) ^ key, return_index=True)  # a digest may be alone in three cells
        row, key, sign = row[first], key[first], -sign[first]
        found += np.bincount(row, minlength=rows)
        places = [p + row * cells for p in _places(key, cells)]
        for p in places:
            _add((count, total, check), p, key, sign)
        todo = np.unique(np.concatenate(places))  # no other cell has changed
    left = (count != 0) | (total != 0) | (check != 0)
    return found, ~left.reshape(rows, cells).any(axis=1)


def differing(n: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many digests (rows, keys) differ between a and b in each of n rows; larger sketches where peeling fails."""
    out, todo, cells = np.zeros(n, np.int64), np.arange(n), CELLS
    while len(todo):
        one, two = (sketch(k, r, len(todo), cells) for r, k in (a, b))
        found, done = peel(*(x - y for x, y in zip(one, two, strict=True)), len(todo), cells)
        out[todo[done]] = found[done]
        number = np.cumsum(~done) - 1
        a, b = ((number[r[~done[r]]], k[~done[r]]) for r, k in (a, b))
        todo, cells = todo[~done], cells * GROWTH
    return out


def likeness(n: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    size = np.bincount(a[0], minlength=n) + np.bincount(b[0], minlength=n)
    d = differing(n, a, b)
    return np.where(size > 0, (size - d) / np.maximum(1, size + d), 1.0)


def fingerprint(n: int, rows: np.ndarray, keys: np.ndarray) -> list[str]:
    """The smallest sketches of n rows, as hexadecimal text: counts, sums, check sums' low half."""
    c, t, k = sketch(keys, rows, n, CELLS)
    parts = [x.reshape(n, -1) for x in (c.astype("<i4").view(np.uint8), t.astype("<u8").view(np.uint8), k.astype("<u8").astype("<u4").view(np.uint8))]
    return [x.tobytes().hex() for x in np.concatenate(parts, axis=1)]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows: list[tuple[int | None, str]], after: str) -> pa.RecordBatch:
    """Results of rows in order; `after` is the text that follows the last."""
    n, texts = len(rows), [t for _, t in rows]
    nexts = [*texts[1:], after]
    edited = [t[: len(t) - len(t) // 3] + x[: len(t) // 3] for t, x in zip(texts, nexts, strict=True)]
    every, changed = digests([*texts, after]), digests(edited)
    own = every[0] < n
    keys = every[0][own], every[1][own]
    ahead = every[0][every[0] > 0] - 1, every[1][every[0] > 0]
    cols = [
        pa.array([i for i, _ in rows], pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array(fingerprint(n, *keys)), pa.array(fingerprint(n, *changed)), pa.array(likeness(n, keys, changed)), pa.array(likeness(n, keys, ahead)),
    ]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in OUT.split(", ")])


def fingerprints(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Fingerprints of every row of docs(doc_id, text) and of its edited text, with likenesses.

    Documents are range partitioned by doc_id, once; the first document of a range is also sent to the
    range before it, so that every document meets the next. The ranges' heads are one row of some 40 bytes a range
    (of PART_BYTES at least): few enough for one window and a broadcast.
    """
    base = docs.select("doc_id", text_of("text").alias("text")).withColumn("sum", F.xxhash64("text"))
    parts = parts_for(base, part_bytes)
    placed = ranged(base, parts).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    heads = placed.groupBy("pid").agg(F.max(F.struct("key", "sum")).alias("h"))
    # In descending order the head of a range follows the range above it; the very first follows the last.
    above = F.lead("pid").over(Window.orderBy("pid"))
    lowest = F.min("pid").over(Window.partitionBy())
    also = F.broadcast(heads.select("pid", "h.key", "h.sum", F.coalesce(above, lowest).alias("to"), above.isNull().cast("int").alias("wrap")))
    own = F.array(F.struct(F.col("pid").alias("at"), F.lit(0).alias("guest")))
    both = placed.join(also, ["pid", "key", "sum"], "left").select("doc_id", "text", "sum", "key", F.explode(F.when(F.col("to").isNull(), own).otherwise(F.concat(own, F.array(F.struct(F.col("to").alias("at"), (F.col("wrap") + 1).alias("guest")))))).alias("x"))
    rows = both.select("x.at", "x.guest", "doc_id", "text", "key", "sum").repartitionById(parts, "at").sortWithinPartitions("at", F.col("guest") > 0, F.desc("key"), F.desc("sum"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        for b in pieces(batches, "text"):
            for guest, i, t in zip(b["guest"].to_pylist(), b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                if not guest:
                    held.append((i, t))
                elif held:  # the guest ends its range; rows that repeat it come after, with none held
                    yield _compare(held, t)
                    held = []
            if len(held) > 1:
                yield _compare(held[:-1], held[-1][1])
                held = held[-1:]
        if held:
            raise RuntimeError("a range without the document that follows it")

    return rows.select("guest", "doc_id", "text").mapInArrow(run, OUT)


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
