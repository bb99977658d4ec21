"""Token-ID output: patched frame-of-reference blocks, written in document order and read again.

A file is one row of a Parquet table in the shared folder (executors share no other place):
magic, counts, document ids, tokens by document, the start of every block, then the blocks.
A block holds up to BLOCK ids: its minimum, a width that holds PERCENTILE of the offsets, the
packed low bits, and a list of exceptions (position, high bits) for the offsets that are wider.

Defined cases: a null or empty text has the end id alone; an empty table gives no rows; repeated
rows and equal doc_ids are kept, ordered by text; a null doc_id sorts first; other columns are
ignored, whatever their names; a very long text is encoded in one piece and stays in one file.
"""

from __future__ import annotations

import gc
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, parts_for, pieces, ranged, span_hashes, text_of, worker_cache

BLOCK = 256
PERCENTILE = 0.9
MAGIC = b"PFOR"
#: Ids after which a file is closed, at the next document's end.
FILE_IDS = 1 << 18
#: Remembered words of one worker, which keeps them from task to task (about 100 bytes each).
MEMO = 800_000
#: Text bytes of a range of documents.
PART_BYTES = 128 << 20
NULL_ID = -(1 << 63)
#: before: the ids of the range's earlier files.
FILES = "pid int, seq int, n_docs long, before long, n_ids long, body binary"


def pack(ids: np.ndarray) -> bytes:
    """Patched frame-of-reference blocks of ids (below 2 ** 32), with an index of their starts."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return struct.pack("<II", 0, 0)
    x = np.concatenate([ids, np.full(blocks * BLOCK - n, ids[-1], ids.dtype)]).astype(np.int64).reshape(blocks, BLOCK)
    low = x.min(axis=1)
    x = (x - low[:, None]).astype(np.uint32)
    bits = np.where(x > 0, ((x.astype(np.float64).view(np.uint64) >> np.uint64(52)).astype(np.int64) - 1022), 0).astype(np.int8)
    rank = math.ceil(PERCENTILE * BLOCK) - 1
    width = np.partition(bits, rank, axis=1)[:, rank].astype(np.int64)
    body: list[bytes] = [b""] * blocks
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        sub = x[rows]
        packed = np.packbits(np.unpackbits(sub.astype(">u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2)[:, :, 32 - w :].reshape(len(rows), -1), axis=1) if w else np.zeros((len(rows), 0), np.uint8)
        row, pos = np.nonzero(bits[rows] > w)
        high = (sub[row, pos] >> np.uint32(w)).astype("<u4")
        at = np.searchsorted(row, np.arange(len(rows) + 1))
        place = pos.astype(np.uint8)
        for i, r in enumerate(rows.tolist()):
            a, b = at[i], at[i + 1]
            body[r] = struct.pack("<IBH", low[r], w, b - a) + packed[i].tobytes() + place[a:b].tobytes() + high[a:b].tobytes()
    starts = np.cumsum([0, *map(len, body)]).astype("<u4")
    return struct.pack("<II", n, blocks) + starts.tobytes() + b"".join(body)


def unpack(buf: memoryview | bytes) -> np.ndarray:
    """The ids of pack()."""
    n, blocks = struct.unpack_from("<II", buf, 0)
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(buf, np.uint8)
    base = 8 + 4 * (blocks + 1)
    starts = np.frombuffer(buf, "<u4", blocks + 1, 8).astype(np.int64)[:-1] + base
    head = raw[starts[:, None] + np.arange(7)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width, odd = head[:, 4].astype(np.int64), np.ascontiguousarray(head[:, 5:7]).view("<u2")[:, 0].astype(np.int64)
    out = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if 0 < w <= 25:
            # value i begins at bit i * w; four bytes from there hold it
            packed = np.zeros((len(rows), BLOCK * w // 8 + 4), np.uint32)
            packed[:, :-4] = raw[starts[rows][:, None] + 7 + np.arange(BLOCK * w // 8)]
            bit = np.arange(BLOCK) * w
            at = bit >> 3
            word = packed[:, at] << np.uint32(24) | packed[:, at + 1] << np.uint32(16) | packed[:, at + 2] << np.uint32(8) | packed[:, at + 3]
            out[rows] = (word >> (32 - w - (bit & 7)).astype(np.uint32)) & np.uint32((1 << w) - 1)
        elif w:
            packed = raw[starts[rows][:, None] + 7 + np.arange(BLOCK * w // 8)]
            bits = np.zeros((len(rows), BLOCK, 32), np.uint8)
            bits[:, :, 32 - w :] = np.unpackbits(packed, axis=1).reshape(len(rows), BLOCK, w)
            out[rows] = np.packbits(bits, axis=2).view(">u4")[:, :, 0]
        for r in rows[odd[rows] > 0].tolist():
            p, m = int(starts[r]) + 7 + BLOCK * w // 8, int(odd[r])
            out[r, raw[p : p + m]] |= np.frombuffer(buf, "<u4", m, p + m) << np.uint32(w)
    return (out + low[:, None]).reshape(-1)[:n]


def write_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    return MAGIC + struct.pack("<I", len(doc_ids)) + np.array(doc_ids, "<i8").tobytes() + np.array(counts, "<u4").tobytes() + pack(ids)


def read_file(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, tokens by document, all ids."""
    if body[:4] != MAGIC:
        raise ValueError("not a token file")
    (n,) = struct.unpack_from("<I", body, 4)
    return np.frombuffer(body, "<i8", n, 8), np.frombuffer(body, "<u4", n, 8 + 8 * n).astype(np.int64), unpack(memoryview(body)[8 + 12 * n :])


class Words:
    """Byte-level BPE by the tokenizers library, remembering the ids of words.

    The tokenizer's pattern parts a text into words that it encodes on their own. Texts of plain Latin
    characters are parted here, many at once, by the classes of their characters, and the library's model gets
    each new word once; any other text, and one that holds an added token, goes to the library whole.
    """

    plain = re.compile(r"[^\x20-\x7e\t\n\rÀ-ÖØ-öø-ɏ]")
    #: Kinds of characters below U+0250: 0 the end of a text, 1 letters, 2 digits, 3 others, 4 white space.
    kinds = np.array([0 if c == 0 else 4 if chr(c).isspace() else 2 if chr(c) in "0123456789" else 1 if chr(c).isalpha() else 3 for c in range(0x250)], np.uint8)
    #: Letters after an apostrophe that part from what follows.
    tails = ("s", "t", "m", "d", "re", "ve", "ll")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in shown]
        self.letters = {x: x for x in shown} | {x: 256 + i for i, x in enumerate(hidden)}
        self.space = chr(self.letters[32])
        self.second = np.random.default_rng(1).integers(1, 1 << 63, 0x250).astype(np.uint64)
        self.clear()

    def clear(self) -> None:
        self.ids, self.n = np.zeros(1 << 16, np.uint32), 0
        self.known = 0
        self.begin, self.size, self.check = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint64)
        # open addressing: words' first hashes and numbers by slot (0: free)
        self.slots = 1 << 18
        self.key, self.word = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)

    def parts(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of texts that each end with a zero."""
        kind = self.kinds[cp]
        new = np.empty(len(cp), bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new[kind == 0] = True
        # White space before something: its last character joins that where it is a space, and parts from the rest.
        after = np.flatnonzero(new[1:] & (kind[:-1] == 4) & (kind[1:] != 0)) + 1
        new[after - 1] = True
        new[after[cp[after - 1] == 32]] = False
        # An apostrophe at a word's start takes its tail along.
        for p in np.flatnonzero(new & (cp == 39))[:].tolist():
            if kind[p + 1] == 1:
                two = "".join(map(chr, cp[p + 1 : p + 3].tolist()))
                n = next((len(t) for t in self.tails if two.startswith(t)), 0)
                if n:
                    new[p + 1] = False
                    new[p + 1 + n] |= kind[p + 1 + n] == 1
        edge = np.flatnonzero(new)
        inner = kind[edge] != 0
        return edge[inner], np.append(edge[1:], len(cp))[inner]

    def _slot(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the words with such hashes, 0 for those that are not known."""
        out = np.zeros(len(h), np.int32)
        todo, at = np.arange(len(h)), (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            found = self.word[at]
            same = self.key[at] == h[todo]
            out[todo[same]] = found[same]
            go = (found != 0) & ~same
            todo, at = todo[go], (at[go] + 1) & (self.slots - 1)
        return out

    def _enter(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Takes words with distinct hashes that are not known."""
        if 2 * (self.known + len(h)) > self.slots:
            held = np.flatnonzero(self.word)
            h, numbers = np.concatenate([self.key[held], h]), np.concatenate([self.word[held], numbers])
            while 2 * len(h) > self.slots:
                self.slots *= 4
            self.key, self.word = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        todo, at = np.arange(len(h)), (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.word[at] == 0)
            place, first = np.unique(at[free], return_index=True)
            mine = free[first]
            self.key[place], self.word[place] = h[todo[mine]], numbers[todo[mine]]
            rest = np.ones(len(todo), bool)
            rest[mine] = False
            todo, at = todo[rest], (at[rest] + 1) & (self.slots - 1)

    def _learn(self, words: list[str], h: np.ndarray, check: np.ndarray) -> None:
        model, space, letters, flat, sizes = self.tok.model.tokenize, self.space, self.letters, [], []
        for w in words:
            w = space + w[1:] if w[0] == " " and w.isascii() and w[1:].isalpha() else w.encode().decode("latin-1").translate(letters)
            got = model(w)
            sizes.append(len(got))
            flat += [t.id for t in got]
        k, m = self.known, len(sizes)
        while self.n + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + m > len(self.begin):
            self.begin, self.size, self.check = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.check))
        self.ids[self.n : self.n + len(flat)] = flat
        self.begin[k : k + m] = self.n + np.cumsum(sizes) - sizes
        self.size[k : k + m] = sizes
        self.check[k : k + m] = check
        self.n += len(flat)
        self._enter(h, np.arange(k + 1, k + m + 1, dtype=np.int32))
        self.known += m

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        if self.known > MEMO:
            self.clear()
        search, added = self.plain.search, self.added
        whole = {i: np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32) for i, t in enumerate(texts) if search(t) or any(x in t for x in added)}
        joined = "\0".join(["" if i in whole else t for i, t in enumerate(texts)]) + "\0"
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        start, end = self.parts(cp)
        counts = np.diff(np.searchsorted(start, np.flatnonzero(cp == 0)), prepend=0)
        h = span_hashes(cp, start, end)
        check = span_hashes(self.second[cp], start, end)
        k = self._slot(h)
        new = np.flatnonzero(k == 0)
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            at = new[first]
            self._learn([joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)], h[at], check[at])
            k[new] = self._slot(h[new])
        k -= 1
        odd = np.flatnonzero(self.check[k] != check)  # another word of the same hash
        size = self.size[k]
        if len(odd):
            whole |= {i: np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, np.uint32) for i in set(np.searchsorted(np.cumsum(counts), odd, side="right").tolist())}
        ends = np.cumsum(size)
        flat = self.ids[np.arange(len(size) and ends[-1]) + np.repeat(self.begin[k] - ends + size, size)]
        at = np.concatenate([[0], ends])[np.cumsum(counts)]  # where each text's ids end
        n = np.diff(at, prepend=0)
        if whole:
            parts = np.split(flat, at[:-1])
            for i, ids in whole.items():
                parts[i] = ids
                n[i] = len(ids)
            flat = np.concatenate(parts)
        return flat, n


def worker_words(path: str) -> Words:
    """The worker's own Words of a tokenizer, made once."""
    cache = worker_cache()
    if ("words", path) not in cache:
        cache["words", path] = Words(path)
    return cache["words", path]


def write_tokens(docs: DataFrame, tokenizer: str, *, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Files of all documents' ids in ascending doc_id order; pid and seq order the files.

    One range shuffle of the texts; no task holds more than a file's ids and a step of texts at once.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    parts = parts_for(base, part_bytes)
    rows = ranged(base, parts).repartitionById(parts, "pid").sortWithinPartitions("pid", F.col("doc_id").asc_nulls_first(), "text")
    schema = pa.schema([("pid", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("body", pa.binary())])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and the remembered words are many
        words, pid = worker_words(tokenizer), None
        seq = before = total = 0
        names: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            ids = np.concatenate(names)
            body = write_file(ids, np.concatenate(counts), np.concatenate(held))
            return pa.RecordBatch.from_pylist([{"pid": pid, "seq": seq, "n_docs": len(ids), "before": before, "n_ids": total, "body": body}], schema)

        for b in pieces(batches, "text", FILE_IDS):
            pids = b["pid"].to_numpy()
            edge = [0, *(np.flatnonzero(pids[1:] != pids[:-1]) + 1).tolist(), len(pids)]
            for lo, hi in zip(edge, edge[1:], strict=False):
                if names and (pids[lo] != pid or total >= FILE_IDS):
                    yield close()
                    seq, before = (seq + 1, before + total) if pids[lo] == pid else (0, 0)
                    names, counts, held, total = [], [], [], 0
                pid = int(pids[lo])
                part = b.slice(lo, hi - lo)
                flat, n = words.encode_all(part["text"].to_pylist())
                names.append(pc.fill_null(part["doc_id"].cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False))
                counts.append(n + 1)
                held.append(np.insert(flat, np.cumsum(n), end_id))
                total += len(flat) + len(n)
        if names:
            yield close()
        gc.enable()  # the worker may go on to other tasks

    return rows.mapInArrow(files, FILES)


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 by document, from the files alone.

    A file knows the ids before it in its range; the ranges' own sums are one row a range (of PART_BYTES at least),
    so they are few enough for one window and a broadcast: 32 bytes for 128 MB of text.
    """
    by = files.groupBy("pid").agg(F.sum("n_ids").alias("n"))
    base = by.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("base"))
    placed = files.join(F.broadcast(base), "pid").select((F.col("base") + F.col("before")).alias("first"), "body")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, body in zip(b["first"].to_pylist(), b["body"], strict=True):
                names, counts, ids = read_file(body.as_py())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, mask=names == NULL_ID), pa.array(first + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    return read_tokens(cut(write_tokens(docs, tokenizer, **options)))


def op8_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
