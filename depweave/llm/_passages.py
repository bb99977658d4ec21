"""Distributed search for windows of units (words or bytes) that also occur in another document.

1. Every window of `window` units picks one anchor, the k-gram of least hash in it, by its content
   alone: equal windows pick equal anchors. Anchors go to buckets by hash, packed.
2. A bucket keeps the anchors that two documents have; each anchor gets a home: the least document
   that holds it, and the block of that document in which it lies.
3. Windows next to each other whose anchors share a home form a segment. Segments are shuffled by
   home, so all equal windows meet in one place whatever document they stand in, and a stretch of
   text travels about once, not once an anchor.
4. A kernel (Aho-Corasick automata or a Burrows-Wheeler transform) finds, for each home, what is
   covered by windows of smaller documents.
5. The covered intervals go back to their documents.

Hot anchors, which very many documents hold, have no home: each of their windows goes by its anchor, by three more
(the least k-grams by other hashes) and by landmarks at its ends, again by its content alone. Such segments are short, so those of copies are
equal and merge before the shuffle, while those that differ part over tasks. An anchor that is hot within one batch
sends its bucket one mark instead of its documents, and is answered at once, as it is in the task's later batches.

No task gets more than a share of the anchors or the segments of its homes. Broadcasts: none.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, gram_hashes, mix, parts_for, pieces, span_hashes, text_of, unused, view, word_spans

#: Bits of a position in a chunk; the others hold the leading bits of a hash.
POS = np.uint64(28)
POS_MASK = np.uint64((1 << 28) - 1)
#: Make other hashes of an anchor's.
#: Units of a landmark by kind, and one of how many is one.
LANDMARKS = {"byte": (8, 8), "word": (1, 4)}
OTHERS = tuple(np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
#: Bytes of segments that a task holds to merge equal ones.
HELD_BYTES = 8 << 20
#: Bytes of segments that a kernel gets at once, whole homes apart.
KERNEL_BYTES = 1 << 20
#: Text bytes of a partition, and anchors that a bucket sorts at once.
PART_BYTES, SORTED = 128 << 20, 1 << 20
#: Hot anchors that a task remembers from batch to batch.
KNOWN = 1 << 18


@dataclass(frozen=True)
class Plan:
    """unit: "word" or "byte"; window: units that must recur; k: units of an anchor; block: units of the home
    document that share a home (less: smaller groups, more text shuffled twice)."""

    unit: str
    window: int
    k: int
    block: int
    #: documents of an anchor beyond which it is hot, over all and in one batch
    hot: int = 4096
    hot_batch: int = 64
    #: kernel(window, segments, least documents, greatest documents) -> function of (segment, doc)
    #: that gives its covered [start, end) units
    kernel: Callable = None


class Units:
    """The units of a batch of texts: hashes, rows' offsets into them, and their bytes."""

    def __init__(self, unit: str, data: np.ndarray, off: np.ndarray) -> None:
        self.unit, self.data = unit, data
        if unit == "byte":
            self.off, self.hash = off, data.astype(np.uint64) + np.uint64(1)
        else:
            self.starts, self.ends, self.off = word_spans(data, off)
            self.hash = span_hashes(data, self.starts, self.ends)

    def text(self, a: int, b: int) -> bytes:
        if self.unit == "byte":
            return self.data[a:b].tobytes()
        return b" ".join(self.data[self.starts[a] : self.ends[b - 1]].tobytes().split())


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(units: Units, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, position, first and last window and hash of every anchor; positions count in the batch.

    Of equal hashes in a window the rightmost counts.
    """
    none = np.zeros(0, np.int64)
    n, w = len(units.hash), window - k + 1
    if n < window:
        return none, none, none, none, none.astype(np.uint64)
    if n > int(POS_MASK):
        raise ValueError("a text of over 268 million units is too long for this search: split it")
    grams = gram_hashes(units.hash, k)
    low = sliding_least((grams & ~POS_MASK) | (POS_MASK - np.arange(len(grams), dtype=np.uint64)), w)
    row = np.repeat(np.arange(len(units.off) - 1), np.diff(units.off))
    at = np.flatnonzero(np.arange(len(low)) + window <= units.off[1:][row[: len(low)]])  # windows inside a row
    if not len(at):
        return none, none, none, none, none.astype(np.uint64)
    pick = (POS_MASK - (low[at] & POS_MASK)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
    pos = pick[new]
    return row[pos], pos, at[new], at[np.concatenate([new[1:], [len(at)]]) - 1], grams[pos]


ANCHOR = np.dtype([("hash", "<u8"), ("pos", "<u4"), ("lo", "u1"), ("hi", "u1")])
DOC = np.dtype([("id", "<i8"), ("sum", "<i8"), ("n", "<u4")])
#: A document that holds a segment, and where.
MEMBER = np.dtype([("id", "<i8"), ("sum", "<i8"), ("begin", "<i4")])
#: An anchor that recurs, as its document gets it back; home 0: it is hot.
HOMED = np.dtype([("pos", "<u4"), ("lo", "u1"), ("hi", "u1"), ("home", "<u8")])
#: A covered interval of units.
SPAN = np.dtype([("begin", "<i4"), ("end", "<i4")])
#: `lo` of a mark that says that an anchor is hot.
MARK = 255
NAMES = ["bucket", "homed", "docs", "found"]


def _packed(doc: np.ndarray, who: np.ndarray, rec: np.ndarray, key: np.ndarray) -> tuple[list[int], list[bytes], list[bytes]]:
    """Rows by key: the documents (of doc, by index) and their records; all are in the order of key, then of who."""
    if not len(key):
        return [], [], []
    cuts = [*np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist(), len(key)]
    names, bodies = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        first = np.flatnonzero(np.concatenate([[True], who[a + 1 : b] != who[a : b - 1]])) + a
        d = doc[who[first]]  # a copy
        d["n"] = np.diff([*first, b])
        names.append(d.tobytes())
        bodies.append(rec[a:b].tobytes())
    return key[cuts[:-1]].tolist(), names, bodies


def _batch(rows: list[tuple[bool, tuple]]) -> pa.RecordBatch:
    keys, homed, names, bodies = [], [], [], []
    for flag, (k, d, f) in rows:
        keys += k
        homed += [flag] * len(k)
        names += d
        bodies += f
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(homed, pa.bool_()), pa.array(names, pa.binary()), pa.array(bodies, pa.binary())], NAMES)


def _by_part(doc: np.ndarray, who: np.ndarray, found: np.ndarray, parts: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """Rows of found anchors for the partitions that gather them by document."""
    to = (mix(doc["id"][who].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((who, to))
    return _packed(doc, who[order], found[order], to[order])


def _homed(pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, home: np.ndarray | int) -> np.ndarray:
    out = np.zeros(len(pos), HOMED)
    out["pos"], out["lo"], out["hi"], out["home"] = pos, lo, hi, home
    return out


def _anchor_rows(plan: Plan, parts: int, hashed: str):
    """Packed anchors by bucket; those that are hot within a batch as found ones, and a mark each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.uint64)  # hot ones so far
        for b in pieces(batches, "text"):
            units = Units(plan.unit, *view(b["text"]))
            row, pos, lo, hi, h = anchors(units, plan.window, plan.k)
            if not len(row):
                continue
            doc = np.zeros(b.num_rows, DOC)
            doc["id"], doc["sum"] = b["doc_id"].to_numpy(), b[hashed].to_numpy()
            rec = np.zeros(len(row), ANCHOR)
            rec["hash"], rec["pos"], rec["lo"], rec["hi"] = h, pos - units.off[row], pos - lo, pos - hi
            out = []
            hot = _hot(h, row, plan.hot_batch) if b.num_rows >= plan.hot_batch else np.zeros(0, np.int64)
            if len(known):
                hot = np.union1d(hot, np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h))
            if len(hot):
                known = np.union1d(known, h[hot]) if len(known) < KNOWN else known
                x = rec[hot]
                out.append((True, _by_part(doc, row[hot], _homed(x["pos"], x["lo"], x["hi"], 0), parts)))
                _, first = np.unique(h[hot], return_index=True)
                rec["lo"][hot[first]] = MARK
                keep = np.ones(len(row), bool)
                keep[hot] = False
                keep[hot[first]] = True
                rec, row, h = rec[keep], row[keep], h[keep]
            bucket = (h >> np.uint64(8)).astype(np.int64) % parts
            order = np.argsort(bucket.astype(np.uint16) if parts < 1 << 16 else bucket, kind="stable")
            out.append((False, _packed(doc, row[order], rec[order], bucket[order])))
            yield _batch(out)

    return run


def _hot(h: np.ndarray, row: np.ndarray, least: int) -> np.ndarray:
    """Which anchors so many rows of a batch have."""
    order = np.argsort(h, kind="stable")  # rows ascend within a hash
    s, r = h[order], row[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    start = np.flatnonzero(new)
    rows = np.add.reduceat((new | np.concatenate([[True], r[1:] != r[:-1]])).astype(np.int64), start)
    return order[np.repeat(rows >= least, np.diff(np.append(start, len(s))))]


def _recurring(plan: Plan, parts: int):
    """Of a partition's buckets: the anchors that two documents have, with their homes, packed for the
    partitions that gather them by document. What is found already passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        recs: list[np.ndarray] = []
        for b in batches:
            homed = b["homed"].to_numpy(zero_copy_only=False)
            if homed.any():
                yield b.filter(pa.array(homed))
            for d, a in zip(b["docs"].filter(pa.array(~homed)), b["found"].filter(pa.array(~homed)), strict=True):
                docs.append(np.frombuffer(d.as_py(), DOC))
                recs.append(np.frombuffer(a.as_py(), ANCHOR))
        if not recs:
            return
        doc, rec = np.concatenate(docs), np.concatenate(recs)
        del docs, recs
        owner = np.repeat(np.arange(len(doc), dtype=np.int32), doc["n"])
        steps = -(-len(rec) // SORTED)
        for i in range(steps):  # by ranges of hashes, so many at a time
            at = np.flatnonzero((rec["hash"] >> np.uint64(40)) % np.uint64(steps) == i) if steps > 1 else slice(None)
            if len(found := _homes(doc, owner[at], rec[at], plan)[0]):
                yield _batch([(True, _by_part(doc, *found, parts))])

    return run


def _homes(doc: np.ndarray, owner: np.ndarray, rec: np.ndarray, plan: Plan) -> list[tuple[np.ndarray, np.ndarray]]:
    """The documents and found anchors of some buckets' anchors; owner: each one's document."""
    order = np.argsort(rec["hash"])
    h = rec["hash"][order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.concatenate([start, [len(h)]]))
    many = np.repeat(size > 1, size)  # most anchors are alone: leave them early
    order, h = order[many], h[many]
    if not len(h):
        return [()]
    ids = doc["id"][owner[order]]
    sub = np.lexsort((rec["pos"][order], ids, h))
    order, h, ids = order[sub], h[sub], ids[sub]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate([start, [len(h)]]))
    mark = rec["lo"][order] == MARK
    n_docs = np.add.reduceat((new | np.concatenate([[True], ids[1:] != ids[:-1]])).astype(np.int64), start)
    hot = np.logical_or.reduceat(mark, start) | (n_docs > plan.hot)
    more = np.repeat(hot | (n_docs > 1), size) & ~mark
    block = np.repeat(rec["pos"][order[start]] // plan.block, size).astype(np.uint64)
    home = np.maximum(mix(np.repeat(ids[start], size).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + block), np.uint64(1))
    home[np.repeat(hot, size)] = 0
    x = rec[order[more]]
    return [(owner[order[more]], _homed(x["pos"], x["lo"], x["hi"], home[more]))] if more.any() else [()]


def _by_document(kind: np.dtype):
    """All records (anchors found, or covered intervals) of each of a partition's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        recs: list[np.ndarray] = []
        for b in batches:
            for d, a in zip(b["docs"], b["found"], strict=True):
                docs.append(np.frombuffer(d.as_py(), DOC))
                recs.append(np.frombuffer(a.as_py(), kind))
        if not recs:
            return
        doc, rec = np.concatenate(docs), np.concatenate(recs)
        del docs, recs
        order = np.lexsort((doc["sum"], doc["id"]))
        begin = np.concatenate([[0], np.cumsum(doc["n"], dtype=np.int64)])
        at = 0
        while at < len(order):
            ids, sums, found = [], [], []
            while at < len(order) and len(ids) < 4096:
                k = at
                while k < len(order) and doc["id"][order[k]] == doc["id"][order[at]] and doc["sum"][order[k]] == doc["sum"][order[at]]:
                    k += 1
                ids.append(int(doc["id"][order[at]]))
                sums.append(int(doc["sum"][order[at]]))
                found.append(b"".join(rec[begin[i] : begin[i + 1]].tobytes() for i in order[at:k].tolist()))
                at = k
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.int64()), pa.array(found, pa.binary())], ["doc", "sum", "found"])

    return run


def _runs(rec: np.ndarray, window: int) -> Iterator[tuple[int, int, int]]:
    """First and last window and home of the segments of anchors with homes."""
    lo, hi, home = rec["pos"].astype(np.int64) - rec["lo"], rec["pos"].astype(np.int64) - rec["hi"], rec["home"].view(np.int64)
    new = np.concatenate([[True], (home[1:] != home[:-1]) | (lo[1:] != hi[:-1] + 1)])
    last = np.concatenate([new[1:], [True]])
    return zip(lo[new].tolist(), hi[last].tolist(), home[new].tolist(), strict=True)


def window_keys(units: Units, grams: np.ndarray, plan: Plan) -> np.ndarray:
    """A hash of each window's content: of the least k-grams by other hashes, and of its first and last landmark
    (short grams picked by their hash), so that windows of unlike ends or middles part, and neighbours mostly agree."""
    width = plan.window - plan.k + 1
    out = np.zeros(len(grams) - width + 1, np.uint64)
    for x in OTHERS:
        out = mix(out ^ sliding_least(mix(grams ^ x), width))
    size, every = LANDMARKS[plan.unit]
    h = gram_hashes(units.hash, size)
    at = np.flatnonzero(h % np.uint64(every) == 0)
    if len(at):
        begin = np.arange(len(out))
        end = begin + plan.window - size
        first, last = np.searchsorted(at, begin), np.searchsorted(at, end, side="right") - 1
        some = last >= first
        for side in (first, last):
            out = mix(out ^ np.where(some, h[at[np.where(some, side, 0)]], np.uint64(0)))
    return out


def _hot_runs(rec: np.ndarray, base: int, grams: np.ndarray, others: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The same of hot anchors: by the anchor and what window_keys() says; base: the row's first unit."""
    size = rec["lo"].astype(np.int64) - rec["hi"] + 1
    begin = rec["pos"].astype(np.int64) - rec["lo"]
    at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
    key = mix(np.repeat(grams[base + rec["pos"].astype(np.int64)], size) ^ others[base + at])
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)])
    last = np.concatenate([new[1:], [True]])
    return zip(at[new].tolist(), at[last].tolist(), key[new].view(np.int64).tolist(), strict=True)


def distinct(rec: np.ndarray) -> np.ndarray:
    """Different records of HOMED in the order of their positions (as np.unique, which compares records slowly)."""
    rec = rec[np.lexsort((rec["home"], rec["hi"], rec["lo"], rec["pos"]))] if (np.diff(rec["pos"].astype(np.int64)) <= 0).any() else rec
    same = np.ones(len(rec) - 1, bool)
    for name in HOMED.names:
        same &= rec[name][1:] == rec[name][:-1]
    return rec[np.concatenate([[True], ~same])] if same.any() else rec


def _segments(plan: Plan, hashed: str, found: str):
    """Segments of documents: neighbouring windows whose anchors share a home. Equal segments of a task go
    out once, with their members, before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list[bytes]] = {}
        size, pack = 0, struct.Struct("<qqi").pack  # a MEMBER

        def flush() -> pa.RecordBatch:
            members = list(map(b"".join, held.values()))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([t for _, t in held], pa.binary()), pa.array(members, pa.binary())], ["home", "segment", "members"])

        for b in pieces(batches, "text"):
            units = Units(plan.unit, *view(b["text"]))
            some = [r for r, body in enumerate(b[found].to_pylist()) if body and (np.frombuffer(body, HOMED)["home"] == 0).any()]
            if some:  # documents with hot anchors, and what their windows go by
                part = Units(plan.unit, *view(b["text"].take(pa.array(some))))
                grams = gram_hashes(part.hash, plan.k)
                others, base_of = window_keys(part, grams, plan), dict(zip(some, part.off.tolist(), strict=False))
            for r, (i, s, body) in enumerate(zip(b["doc_id"].to_pylist(), b[hashed].to_pylist(), b[found].to_pylist(), strict=True)):
                if not body:
                    continue
                rec = distinct(np.frombuffer(body, HOMED))  # by position; rows that repeat give equal ones
                base, hot = int(units.off[r]), rec["home"] == 0
                runs = _runs(rec[~hot], plan.window) if not hot.all() else ()
                if hot.any():
                    runs = chain(runs, _hot_runs(rec[hot], base_of[r], grams, others))
                for a, z, k in runs:
                    text = units.text(base + a, base + z + plan.window)
                    own = held.setdefault((k, text), [])
                    size += 20 + (0 if own else len(text))
                    own.append(pack(i, s, a))
            if size > HELD_BYTES:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    return run


def alike_runs(cover: Callable, ids: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs [a, z) of ascending ids that have one cover, and it. What is covered only grows with the id, so between two
    ids of equal covers all are equal: a segment that very many documents hold costs a few calls."""
    least = cover(ids[0])
    stack = [(0, len(ids), least, cover(ids[-1]) if ids[-1] != ids[0] else least)]
    while stack:
        a, z, low, high = stack.pop()
        if low is high or np.array_equal(low, high):
            yield a, z, low
        else:  # neither end is the other, so both halves have rows
            m = (a + z) // 2
            stack.append((m, z, cover(ids[m]), high))
            stack.append((a, m, low, cover(ids[m - 1])))


def _covered(plan: Plan, parts: int):
    """Covered units of each segment's members, packed for the partitions that gather them by document. Rows come
    sorted by home."""

    def solve(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch | None:
        texts: dict[bytes, list[bytes]] = {}
        for _, t, m in rows:  # equal segments count once, for their least and greatest documents
            texts.setdefault(t, []).append(m)
        packed = [b"".join(m) for m in texts.values()]
        member = np.frombuffer(b"".join(packed), MEMBER)
        edge = np.cumsum([0, *map(len, packed)]) // MEMBER.itemsize
        order = np.lexsort((member["id"], np.repeat(np.arange(len(packed)), np.diff(edge))))
        member, ids = member[order], member["id"][order]
        cover = plan.kernel(plan.window, list(texts), ids[edge[:-1]].tolist(), ids[edge[1:] - 1].tolist())
        first, count, spans = [], [], []
        for k, (lo, hi) in enumerate(zip(edge.tolist(), edge[1:].tolist(), strict=False)):
            for a, z, x in alike_runs(lambda i, k=k: cover(k, i), ids[lo:hi].tolist()):
                if len(x):
                    first.append(lo + a)
                    count.append(z - a)
                    spans.append(x)
        if not spans:
            return None
        size, x = np.array(list(map(len, spans))), np.concatenate(spans)
        rows_of = size * count  # of a run: its documents' spans
        run_of = np.repeat(np.arange(len(spans)), rows_of)
        nth = np.arange(len(run_of)) - np.repeat(np.cumsum(rows_of) - rows_of, rows_of)
        who = np.array(first)[run_of] + nth // size[run_of]
        found = x[(np.cumsum(size) - size)[run_of] + nth % size[run_of]] + member["begin"][who][:, None]
        doc = np.zeros(len(member), DOC)
        doc["id"], doc["sum"] = ids, member["sum"]
        return _batch([(True, _by_part(doc, who, found.astype("<i4").reshape(-1).view(SPAN), parts))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, home = [], 0, None
        for b in batches:
            for x in zip(b["home"].to_pylist(), b["segment"].to_pylist(), b["members"].to_pylist(), strict=True):
                if x[0] != home and size >= KERNEL_BYTES:
                    if (out := solve(rows)) is not None:
                        yield out
                    rows, size = [], 0
                rows.append(x)
                size += len(x[1])
                home = x[0]
        if rows and (out := solve(rows)) is not None:
            yield out

    return run


def merge(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of [start, end) intervals, sorted; touching ones join."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > top[:-1]])
    return np.stack([spans[new, 0], top[np.concatenate([new[1:], [True]])]], axis=1)


def covered(docs: DataFrame, plan: Plan) -> tuple[DataFrame, str]:
    """Every row of docs(doc_id, text, ...) with one more column: packed [start, end) covered units; its name.

    The two joins with the texts have the same left side, so they share one shuffle of them.
    """
    hashed, found_name, spans_name = unused(docs, "text_hash", "found", "spans")
    base = docs.withColumn("text", text_of("text")).withColumn(hashed, F.xxhash64("text"))
    parts = parts_for(base, PART_BYTES)
    rows = "bucket int, homed boolean, docs binary, found binary"
    found = cut(
        base.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), hashed, "text").mapInArrow(_anchor_rows(plan, parts, hashed), rows)
        .repartition(parts, "bucket").mapInArrow(_recurring(plan, parts), rows)
    )
    by_document = lambda df, kind, name: df.select("bucket", "docs", "found").repartition(parts, "bucket").mapInArrow(_by_document(kind), "doc long, sum long, found binary").withColumnRenamed("found", name)
    same = lambda df: base.join(df.hint("shuffle_hash"), (F.col("doc_id") == F.col("doc")) & (F.col(hashed) == F.col("sum")), "left")
    segments = (
        same(by_document(found, HOMED, found_name)).mapInArrow(_segments(plan, hashed, found_name), "home long, segment binary, members binary")
        .repartition(parts, "home").sortWithinPartitions("home")
    )
    spans = by_document(segments.mapInArrow(_covered(plan, parts), rows), SPAN, spans_name)
    return same(spans).select(*[F.col(f"`{c}`") for c in docs.columns], spans_name), spans_name
