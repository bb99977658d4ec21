"""Substring dedup by repeated-phrase automata (words).

Recurring passages are confirmed (50-word windows that two documents share), cut into phrases that
every window must contain, compiled into Aho-Corasick automata (one for each shard of passages),
and all candidate text streams through them; every occurrence is grown word by word to both sides.

Defined cases: a null or empty text has no words; documents under a window's length keep all words;
equal texts: the smallest doc_id keeps its words; rows that repeat a doc_id don't remove each other's;
a null doc_id neither removes nor loses words; an empty table gives no rows; other columns
are kept, but for those named like a result; a text of over 268 million words is an error, others may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import gram_hashes, mix, pieces
from ._passages import Plan, covered, merge

WINDOW = 50
BLOCK_WORDS = 128
ANCHOR_WORDS = 20
#: No document.
NONE = -(1 << 63)


def automata_kernel(window: int, segments: list[bytes], owners: list[int], last: list[int]):
    """Covered words of segments: windows that also start in a smaller owner's segment."""
    import ahocorasick

    index: dict[bytes, int] = {}
    words = [[index.setdefault(w, len(index)) for w in s.split(b" ")] for s in segments]
    flat = np.array([w for s in words for w in s], np.int64)
    off = np.cumsum([0, *map(len, words)])
    own = np.array(owners, np.int64)
    seg = np.repeat(np.arange(len(words)), np.diff(off))

    # Confirm: windows that two documents have, and the least document of each.
    grams = gram_hashes(mix(flat.astype(np.uint64)), window)
    inside = np.flatnonzero(np.arange(len(grams)) + window <= off[1:][seg[: len(grams)]])
    h, doc = grams[inside], own[seg[inside]]
    order = np.lexsort((doc, h))
    hs, ds = h[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))  # a window of the least document stands for its like
    shared = np.maximum.reduceat(np.array(last, np.int64)[seg[inside[order]]], start) > ds[start]
    keep = np.sort(inside[order[start[shared]]])
    size = np.diff(np.concatenate([start, [len(hs)]]))
    least = np.full(len(flat), NONE, np.int64)  # of each shared window that a greater document has here
    least[inside[order]] = np.repeat(np.where(shared, ds[start], NONE), size)
    least[np.repeat(np.array(last, np.int64), np.diff(off)) <= least] = NONE

    # Passages: runs of such windows; phrases: their aligned blocks of half a window.
    step = window // 2
    runs = np.flatnonzero(np.concatenate([[True], (keep[1:] != keep[:-1] + 1) | (seg[keep[1:]] != seg[keep[:-1]])])) if len(keep) else np.zeros(0, np.int64)
    passages: list[list[int]] = []
    phrases: dict[tuple[int, ...], dict[int, list[tuple[int, int]]]] = {}
    for a, b in zip(runs.tolist(), np.append(runs[1:], len(keep)).tolist(), strict=False):
        s, e = int(keep[a]), int(keep[b - 1]) + window
        k = int(seg[s])
        p = words[k][s - off[k] : e - off[k]]
        for at in range(0, len(p) - step + 1, step):
            phrases.setdefault(tuple(p[at : at + step]), {}).setdefault(owners[k], []).append((len(passages), at))
        passages.append(p)
    hits: list[list[tuple[int, int, int]]] = [[] for _ in words]
    if phrases:
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase, places in phrases.items():
            machine.add_word(phrase, places)
        machine.make_automaton()
        for k, text in enumerate(words):
            want = least[off[k] : off[k + 1]].tolist()
            if max(want) == NONE:
                continue
            for end, places in machine.iter(tuple(text)):
                begin = end - step + 1
                # an owner's passage that holds a wanted window around the phrase
                for owner in {*want[max(0, begin - step) : begin + 1]}:
                    for p, at in places.get(owner, ()):
                        passage, shift = passages[p], begin - at
                        a, b = begin, end + 1
                        while a > 0 and a > shift and text[a - 1] == passage[a - 1 - shift]:
                            a -= 1
                        while b < len(text) and b - shift < len(passage) and text[b] == passage[b - shift]:
                            b += 1
                        if b - a >= window:
                            hits[k].append((a, b, owner))
                            want[a : b - window + 1] = [NONE] * (b - window + 1 - a)

    def cover(k: int, doc: int) -> np.ndarray:
        return merge(np.array([(a, b) for a, b, o in hits[k] if o < doc], np.int64).reshape(-1, 2))

    return cover


SCHEMA = ["n_words long", "n_removed long", "kept_sha256 string", "kept string"]


def _apply(names: list[str], spans_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            n, gone, sums, texts = [], [], [], []
            for text, packed in zip(b["text"].to_pylist(), b[spans_name].to_pylist(), strict=True):
                words = text.encode().split()
                n.append(len(words))
                spans = merge(np.frombuffer(packed or b"", "<i4").reshape(-1, 2))
                kept, at = [], 0
                for a, e in spans.tolist():
                    kept += words[at:a]
                    at = e
                kept += words[at:]
                body = b" ".join(kept)
                gone.append(len(words) - len(kept))
                sums.append(hashlib.sha256(body).hexdigest())
                texts.append(body.decode())
            more = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums), pa.array(texts)]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), *more], [*names, *[x.split()[0] for x in SCHEMA]])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor_words: int = ANCHOR_WORDS, **options) -> DataFrame:
    """docs(doc_id, text, ...) with n_words, n_removed, kept_sha256 and the kept words; null texts are empty.

    options: hot, hot_batch (see Plan)."""
    docs = docs.drop(*[x.split()[0] for x in SCHEMA])
    plan = Plan("word", window, anchor_words, BLOCK_WORDS, kernel=automata_kernel, **options)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], *SCHEMA])
    found, spans_name = covered(docs, plan)
    return found.mapInArrow(_apply(docs.columns, spans_name), schema)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("kept", "text")
