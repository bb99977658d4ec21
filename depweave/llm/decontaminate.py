"""Benchmark decontamination by winnowing.

The least k-gram hash of every sliding window of words is kept, of documents and of items; both join
on it, and hits are extended word by word. A window of 13 words holds 13 - k + 1 k-grams, so every
shared span of 13 words shares a kept hash. Items of fewer words are one window each, found by the
hash of their own length.

The items' fingerprints are broadcast where their counted size is under a bound; beyond it the
fingerprints meet in a shuffle join, and documents get just the items that they share one with.

Defined cases: a null text has no words; an item without words never occurs; rows that repeat an item_id
count as one item; a null item_id or doc_id: the item is ignored, the document is judged as any other;
an empty benchmark hits nothing; an empty table gives no rows; other columns
are kept, but for those named like a result; a very long text is judged in one piece, in about sixty times its
size of memory.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, gram_hashes, pieces, session, span_hashes, text_of, unused, view, word_spans

WINDOW = 13
K = 5
#: Items' text bytes up to which they are broadcast.
BROADCAST_BYTES = 16 << 20
#: Places where the documents of one hash are met beyond that.
SALTS = 16

#: A-Z in lower case; 0-9, a-z and bytes from \x80 are of words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
GAP = np.ones(256, bool)
GAP[48:58] = GAP[97:123] = GAP[128:] = False


class Words:
    """Words of a batch of texts: hashes and offsets by row, and the bytes between them."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.data = LOWER[data]
        self.starts, self.ends, self.off = word_spans(self.data, off, GAP)
        self.hash = span_hashes(self.data, self.starts, self.ends)

    def same(self, a: int, other: "Words", b: int, n: int) -> bool:
        """Exact comparison of n words from a here and from b there."""
        x = self.data[self.starts[a] : self.ends[a + n - 1]].tobytes().translate(TRANSLATE).split()
        return x == other.data[other.starts[b] : other.ends[b + n - 1]].tobytes().translate(TRANSLATE).split()


TRANSLATE = bytes(32 if GAP[i] else i for i in range(256))


def winnow(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are least in a window of one row (the rightmost of equals)."""
    n, w = len(words.hash), window - k + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = gram_hashes(words.hash, k)
    mask = np.uint64((1 << 28) - 1)
    low = (grams & ~mask) | (mask - np.arange(len(grams), dtype=np.uint64))
    low = np.min([low[i : len(low) - w + 1 + i] for i in range(w)], axis=0)
    row = np.repeat(np.arange(len(words.off) - 1), np.diff(words.off))
    inside = np.arange(len(low)) + window <= words.off[1:][row[: len(low)]]
    pos = np.unique((mask - (low[inside] & mask)).astype(np.int64))
    return pos, grams[pos]


class Index:
    """Items' words, and where each fingerprint stands in them."""

    def __init__(self, items: list[tuple[str, str]], window: int, k: int) -> None:
        self.ids = [i for i, _ in items]
        data = "\n".join(t for _, t in items).encode()
        size = np.array([len(t.encode()) for _, t in items], np.int64)
        off = np.concatenate([[0], np.cumsum(size + 1)]) if items else np.zeros(1, np.int64)
        off[-1] = len(data)
        self.words = Words(np.frombuffer(data, np.uint8), off)
        self.n = np.diff(self.words.off)
        row = np.repeat(np.arange(len(items)), self.n)
        self.at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        pos, h = winnow(self.words, window, k)
        for p, x in zip(pos.tolist(), h.tolist(), strict=True):
            self.at[x].append((int(row[p]), p - int(self.words.off[row[p]])))
        self.keys = np.unique(h)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for r in np.flatnonzero((self.n > 0) & (self.n < window)).tolist():
            m, o = int(self.n[r]), int(self.words.off[r])
            self.short[m][int(gram_hashes(self.words.hash[o : o + m], m)[0])].append(r)
        self.short = {m: dict(v) for m, v in self.short.items()}
        self.short_keys = {m: np.sort(np.array(list(v), np.uint64)) for m, v in self.short.items()}


def among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each x is one of the sorted keys."""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def hits(words: Words, index: Index, window: int, k: int) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words lie in an occurrence of a window, and the items that occur, by row."""
    hit = np.zeros(len(words.hash), bool)
    found: dict[int, set[str]] = defaultdict(set)
    row = np.repeat(np.arange(len(words.off) - 1), np.diff(words.off))
    pos, h = winnow(words, window, k)
    seen = among(h, index.keys)
    done: set[tuple[int, int, int]] = set()  # by row too: an item cut over two rows has one diagonal in both
    for p, x in zip(pos[seen].tolist(), h[seen].tolist(), strict=True):
        r = int(row[p])
        for item, q in index.at[x]:
            if (r, item, p - q) in done:
                continue
            done.add((r, item, p - q))
            a = max(p - q, int(words.off[r]))  # extend the hit along its diagonal
            b = min(p - q + int(index.n[item]), int(words.off[r + 1]))
            o = int(index.words.off[item]) + a - (p - q)
            same = words.hash[a:b] == index.words.hash[o : o + b - a]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
            for s, e in edge.reshape(-1, 2).tolist():
                if e - s >= window and words.same(a + s, index.words, o + s, e - s):
                    hit[a + s : a + e] = True
                    found[r].add(index.ids[item])
    for m, table in index.short.items():
        if len(words.hash) < m:
            continue
        grams = gram_hashes(words.hash, m)
        for p in np.flatnonzero(among(grams, index.short_keys[m])).tolist():
            r = int(row[p])
            if p + m <= words.off[r + 1]:
                for item in table[int(grams[p])]:
                    if words.same(p, index.words, int(index.words.off[item]), m):
                        hit[p : p + m] = True
                        found[r].add(index.ids[item])
    return hit, found


SCHEMA = ["n_words long", "n_hit long", "n_items long", "items_sha256 string", "contaminated boolean"]


def _rows(b: pa.RecordBatch, names: list[str], words: Words, hit: np.ndarray, found: dict[int, set[str]]) -> pa.RecordBatch:
    sums = np.concatenate([[0], np.cumsum(hit)])
    n_hit, n = np.diff(sums[words.off]), np.diff(words.off)
    digest = [hashlib.sha256(",".join(sorted(found.get(r, ()))).encode()).hexdigest() for r in range(b.num_rows)]
    n_items = [len(found.get(r, ())) for r in range(b.num_rows)]
    more = [pa.array(n), pa.array(n_hit), pa.array(n_items, pa.int64()), pa.array(digest), pa.array((n_hit > 0) & (20 * n_hit >= n))]
    return pa.RecordBatch.from_arrays([*(b[x] for x in names), *more], [*names, *[x.split()[0] for x in SCHEMA]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs(doc_id, text, ...) with n_words, n_hit, n_items, items_sha256 and contaminated; null texts are empty."""
    spark = session(docs)
    docs = docs.drop(*[x.split()[0] for x in SCHEMA])
    names = docs.columns
    hashed, found = unused(docs, "text_hash", "found_items")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], *SCHEMA])
    base = docs.withColumn("text", text_of("text"))
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("item")).distinct()
    size = items.agg(F.sum(F.octet_length("item") + 16)).first()[0] or 0
    if size <= broadcast_bytes:
        index = spark.sparkContext.broadcast(sorted(map(tuple, items.collect())))

        def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Index(index.value, window, k)
            for b in pieces(batches, "text"):
                words = Words(*view(b["text"]))
                yield _rows(b, names, words, *hits(words, known, window, k))

        return base.mapInArrow(small, schema)

    def keys(name: str, lengths: list[int], whole: bool):
        """Distinct (hash, id) fingerprints; of short items their whole hash, of documents all grams of such lengths."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, b_text):
                words = Words(*view(b[b_text]))
                row = np.repeat(np.arange(b.num_rows), np.diff(words.off))
                pos, h = winnow(words, window, k)
                who, what = [row[pos]], [h]
                n = np.diff(words.off)
                for m in lengths:
                    if len(words.hash) >= m:
                        g = gram_hashes(words.hash, m)
                        at = np.flatnonzero(np.arange(len(g)) + m <= words.off[1:][row[: len(g)]])
                        at = at[n[row[at]] == m] if whole else at
                        who.append(row[at])
                        what.append(g[at] ^ np.uint64(m))
                pair = np.unique(np.stack([np.concatenate(who).astype(np.uint64), np.concatenate(what)], axis=1), axis=0)
                r = pair[:, 0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 1]).view(np.int64)), *(b[c].take(pa.array(r)) for c in name.split())], ["hash", *name.split()])

        b_text = "item" if whole else "text"
        return run

    every = base.withColumn(hashed, F.xxhash64("text"))
    # Only the lengths that short items have: their grams alone are made of documents.
    n_words = F.size(F.filter(F.split(F.lower("item"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != ""))
    lengths = sorted(r[0] for r in items.select(n_words.alias("n")).where((F.col("n") > 0) & (F.col("n") < window)).distinct().collect())
    theirs = cut(items.mapInArrow(keys("item_id", lengths, True), "hash long, item_id string").distinct())
    ours = every.select(F.col("doc_id").cast("long").alias("doc"), F.col(hashed).alias("sum"), "text").mapInArrow(keys("doc sum", lengths, False), "hash long, doc long, sum long").distinct()
    # A hash that very many documents have is met in SALTS places; the benchmark is the small side.
    salts = F.array(*[F.lit(x) for x in range(SALTS)])
    theirs = theirs.select("hash", "item_id", F.explode(salts).alias("salt"))
    ours = ours.withColumn("salt", F.pmod(F.xxhash64("doc", "sum"), F.lit(SALTS)).cast("int"))
    pairs = ours.join(theirs, ["hash", "salt"]).select("doc", "sum", "item_id").distinct()
    theirs = pairs.join(items, "item_id").groupBy("doc", "sum").agg(F.collect_list(F.struct("item_id", "item")).alias(found))
    joined = every.alias("d").join(theirs.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc")) & (F.col(f"d.{hashed}") == F.col("t.sum")), "left").select(*[F.col(f"d.`{n}`") for n in names], found)

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            lists = [b or [] for b in batch[found].to_pylist()]
            own = sorted({(x["item_id"], x["item"]) for b in lists for x in b})
            words = Words(*view(batch["text"]))
            # One index of the batch's items; an item that another row shares can be found here too, and is exact.
            yield _rows(batch, names, words, *(hits(words, Index(own, window, k), window, k) if own else (np.zeros(len(words.hash), bool), {})))

    return joined.mapInArrow(large, schema)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")
