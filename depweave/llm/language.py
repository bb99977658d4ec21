"""Language ID by a bidirectional gated recurrent network over bytes, written and trained in numpy.

Two recurrent passes, one from each side, read windows of bytes; a softmax over both states labels every
position, and a document's probabilities are the mean over its positions. Training is backpropagation
through time on a bounded, documented sample: about `per_lang` documents of each language (fewer, alike for all, where there
are so many languages that this would pass `total`; one at least), chosen by hash, and `chars` characters of each from
a place chosen by hash. Every label that is there is learned. Prediction reads every byte of every text.

Defined cases: a null text, or one without a letter: `und`, score 0; nothing to learn from: `und`, score 0
for all; a null or empty label is not learned from; a null doc_id counts as not held out; rows that repeat
are predicted alike; a text of any length, very long ones too, is read in windows of equal size, so many at a time;
an empty table gives no rows; other columns are kept, but for those named like a result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import pieces, view

HIDDEN = 8
WINDOW = 64
#: Bounds of the training sample.
PER_LANG, TOTAL, CHARS = 600, 60_000, 256
EPOCHS, BATCH, RATE = 6, 256, 0.02
#: Text bytes in one step of prediction.
STEP_BYTES = 1 << 18


@dataclass
class Network:
    """Weights of both directions (0: forwards) and of the labels. Gates lie side by side: update, reset, new."""

    langs: list[str]
    read: list[np.ndarray]
    recur: list[np.ndarray]
    label: np.ndarray
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [*self.read, *self.recur, self.label, self.bias]


def network(langs: list[str], hidden: int = HIDDEN, seed: int = 0) -> Network:
    r = np.random.default_rng(seed)
    draw = lambda *shape: (r.standard_normal(shape) * 0.3).astype(np.float32)
    return Network(langs, [draw(256, 3 * hidden) for _ in range(2)], [draw(hidden, 3 * hidden) for _ in range(2)], draw(2 * hidden, len(langs)), np.zeros(len(langs), np.float32))


def forward(net: Network, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States of both directions at (time, row), and what backward() needs. x, mask: (time, row)."""
    steps, rows = x.shape
    h = net.recur[0].shape[0]
    dtype = net.recur[0].dtype
    states, tape = np.empty((steps, rows, 2 * h), dtype), [[], []]
    for d in range(2):
        half = np.concatenate([np.full(2 * h, 0.5), np.ones(h)]).astype(dtype)  # sigmoid(v) = (1 + tanh(v / 2)) / 2
        read, recur = net.read[d] * half, net.recur[d] * half
        state = np.zeros((rows, h), dtype)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            a, u = read[x[t]], state @ recur
            gates = np.tanh(a[:, : 2 * h] + u[:, : 2 * h])
            gates += 1
            gates *= 0.5
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(a[:, 2 * h :] + r * u[:, 2 * h :])
            old = state
            state = new + z * (old - new)
            state *= mask[t][:, None]
            states[t, :, d * h : (d + 1) * h] = state
            if keep:
                tape[d].append((t, old, z, r, new, u[:, 2 * h :]))
    return states, tape


def probabilities(net: Network, states: np.ndarray) -> np.ndarray:
    p = states @ net.label + net.bias
    p -= p.max(axis=-1, keepdims=True)
    np.exp(p, out=p)
    return p / p.sum(axis=-1, keepdims=True)


def gradients(net: Network, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over positions, and its gradients by backpropagation through time."""
    steps, rows = x.shape
    h = net.recur[0].shape[0]
    states, tape = forward(net, x, mask, keep=True)
    p = probabilities(net, states)
    n = mask.sum()
    at = p[:, np.arange(rows), y]
    loss = -(np.log(at + 1e-12) * mask).sum() / n
    d = p
    d[:, np.arange(rows), y] -= 1
    d *= (mask / n)[:, :, None]
    label, bias = np.tensordot(states, d, ((0, 1), (0, 1))), d.sum(axis=(0, 1))
    back = d @ net.label.T
    reads, recurs = [], []
    for k in range(2):
        recur, flow = np.zeros_like(net.recur[k]), np.zeros((rows, h), net.recur[k].dtype)
        a = np.empty((steps, rows, 3 * h), net.recur[k].dtype)
        for t, old, z, r, new, u in reversed(tape[k]):
            g = (flow + back[t, :, k * h : (k + 1) * h]) * mask[t][:, None]
            dn = g * (1 - z) * (1 - new * new)
            dz = g * (old - new) * z * (1 - z)
            dr = dn * u * r * (1 - r)
            a[t] = np.concatenate([dz, dr, dn], axis=1)
            v = np.concatenate([dz, dr, dn * r], axis=1)
            recur += old.T @ v
            flow = g * z + v @ net.recur[k].T
        read = np.zeros_like(net.read[k])
        flat = x.reshape(-1)
        order = np.argsort(flat, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0]))
        read[flat[order[start]]] = np.add.reduceat(a.reshape(-1, 3 * h)[order], start)
        reads.append(read)
        recurs.append(recur)
    return float(loss), [*reads, *recurs, label, bias]


def windows(data: np.ndarray, off: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and mask at (time, row) of all rows' windows, and the text of each."""
    n = -(-np.diff(off) // size)
    text = np.repeat(np.arange(len(n)), n)
    begin = off[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * size
    at = begin + np.arange(size)[:, None]
    inside = at < off[1:][text]
    return np.where(inside, data[np.minimum(at, max(0, len(data) - 1))] if len(data) else 0, 0), inside.astype(np.float32), text


def train(sample: list[tuple[str, str]], seed: int = 0) -> Network | None:
    """A network learned from (text, lang) pairs; none without pairs."""
    sample = sorted((t, g) for t, g in sample if t and g)
    langs = sorted({g for _, g in sample})
    if not langs:
        return None
    net, r = network(langs, seed=seed), np.random.default_rng(seed)
    raw = [t.encode() for t, _ in sample]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    x, mask, text = windows(data, off)
    y = np.array([langs.index(g) for _, g in sample])[text]
    first, second = ([np.zeros_like(w) for w in net.weights()] for _ in range(2))
    steps, step = EPOCHS * -(-len(y) // BATCH), 0
    for _ in range(EPOCHS):
        order = r.permutation(len(y))
        for i in range(0, len(y), BATCH):
            at = order[i : i + BATCH]
            _, grads = gradients(net, x[:, at], mask[:, at], y[at])
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = RATE * (1 - step / (steps + 1)) * min(1.0, 5.0 / (norm + 1e-9))
            for w, g, m, v in zip(net.weights(), grads, first, second, strict=True):  # Adam
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(w.dtype)
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, per_lang: int = PER_LANG, chars: int = CHARS, total: int = TOTAL) -> Network | None:
    """Trains on the documented sample of docs(doc_id, text, lang) that are not held out.

    The least `per_lang` hashes of each language are found by one aggregate with a bounded state."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull() & (F.col("text") != ""))
    counts = rows.groupBy("lang").count()
    n = counts.count()  # the labels are few; their names don't come to the driver
    if not n:
        return None
    each = max(1, min(per_lang, total // n))
    # With this chance a language gives a little more than `each`; the exact least ones of these are taken then.
    chance = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    place = 1 + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - chars + 1))
    share = counts.select("lang", ((each + 6 * each**0.5 + 20) / F.col("count")).alias("share"))
    picked = rows.join(F.broadcast(share), "lang").where(chance < F.col("share")).select(F.substring(F.col("text"), place.cast("int"), F.lit(chars)).alias("t"), "lang", F.xxhash64("doc_id").alias("h"))
    first = Window.partitionBy("lang").orderBy("h", "t")
    sample = picked.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= each)
    return train([(r.t, r.lang) for r in sample.orderBy("lang", "h", "t").collect()])


LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with lang_pred and score; every column of docs is kept, but for two of these names."""
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], "`lang_pred` string", "`score` double"])
    known = net  # some 50 kB, of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", STEP_BYTES):
            data, off = view(b["text"])
            lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            if known is not None:
                sums = np.zeros((b.num_rows, len(known.langs)))
                x, mask, text = windows(data, off)
                for i in range(0, len(text), 1 << 13):  # so many windows at once, however long a text is
                    part = slice(i, i + (1 << 13))
                    p = probabilities(known, forward(known, x[:, part], mask[:, part])[0])
                    np.add.at(sums, text[part], (p * mask[:, part, None]).sum(axis=0))
                mean = sums / np.maximum(1, np.diff(off))[:, None]
                best = mean.argmax(axis=1)
                for r, t in enumerate(b["text"].to_pylist()):
                    if t and has_letter(t):
                        lang[r], score[r] = known.langs[best[r]], min(1.0, float(mean[r, best[r]]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang), pa.array(score)], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), learn(docs)).drop("text")
