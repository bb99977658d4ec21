"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

A sequence of pieces is what the model's merges give exactly when every two neighbours, encoded on their
own, stay those two pieces. So a text is a lattice: a state is the last piece, an edge weighs 0 where two
pieces may stand together and minus infinity where not. A document of more than CHUNK characters is cut into
chunks anywhere. Each chunk gives a transfer matrix: for every piece that may lie over its left cut and every one
that may lie over its right cut, the best weight of a path between. Max-plus products of these matrices, which are
associative, are taken as a balanced tree and pick the pieces at all cuts; then each chunk is backtraced on its own,
between its two pieces. A shorter document is one chunk, which the library encodes.

Between two characters that no piece holds side by side every path has a cut; so within a chunk only the stretches
from its ends to the nearest such places are searched, and the library encodes what lies between. A chunk
without such a place is searched as a whole.

Chunks of a document beyond GIANT characters are spread over tasks, and their matrices meet by GROUP; those of others
stay in one task. Both take the same steps and give the same ids.

Defined cases: a null or empty text has no pieces; a character outside the vocabulary becomes its bytes'
pieces; "▁" in a text decodes to a space, so that text doesn't come back equal; rows that repeat are
kept; a null doc_id is kept; an empty table gives no rows; columns that clash with a result's are replaced, others may
have any name; very long texts (up to Spark's limit of a string) are spread.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import parts_for, pieces, unused

#: Characters beyond which a document's chunks are spread over tasks, and of a chunk.
GIANT, CHUNK = 1 << 16, 1 << 11
#: Matrices that meet at once; its square times CHUNK is the longest text that Spark can hold.
GROUP = 1 << 10
SPACE = "▁"
LOW = float("-inf")


class Model:
    """The library's processor, and one that takes pieces as they are."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            blob = f.read()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=blob)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("the scan needs a model that leaves characters as they are and marks the start")
        spec.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.vocab = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.longest = max(map(len, self.vocab))
        self.inner = {piece[i : i + 2] for piece in self.vocab for i in range(len(piece) - 1)}
        self.fits = lru_cache(1 << 16)(self._fits)

    @cached_property
    def standing(self) -> dict[str, set[str]]:
        """Pieces that encode to themselves, by their first two characters (single ones by that one)."""
        out: dict[str, set[str]] = {}
        names = list(self.vocab)
        for piece, ids in zip(names, self.bare.encode(names, num_threads=1), strict=True):
            if ids == [self.vocab[piece]]:
                out.setdefault(piece[:2], set()).add(piece)
        return out

    @cached_property
    def longest_by(self) -> dict[str, int]:
        return {k: max(map(len, v)) for k, v in self.standing.items()}

    def _fits(self, a: str, b: str) -> bool:
        """Whether two pieces may be neighbours. A character outside the vocabulary merges with none."""
        if a not in self.vocab or b not in self.vocab:
            return True
        return self.bare.encode(a + b) == [self.vocab[a], self.vocab[b]]

    def at(self, text: str, p: int) -> list[str]:
        """Pieces that may begin at p."""
        one, two = text[p], text[p : p + 2]
        found = [one] if one in self.standing.get(one, ()) else []
        if len(two) == 2 and (own := self.standing.get(two)):
            found += [x for n in range(2, min(self.longest_by[two], len(text) - p) + 1) if (x := text[p : p + n]) in own]
        return found or ([text[p]] if text[p] not in self.vocab else [])

    def parts_at(self, text: str, p: int) -> bool:
        """Whether no piece lies over p."""
        return text[p - 1 : p + 1] not in self.inner

    def over(self, text: str, cut: int) -> list[tuple[int, str]]:
        """Pieces (begin, piece) that lie over a cut or end at it, in order."""
        begin = cut - 1
        while begin > max(0, cut - self.longest) and not self.parts_at(text, begin):
            begin -= 1
        return [(p, x) for p in range(max(0, begin), cut) for x in self.at(text, p) if p + len(x) >= cut]

    def ids(self, piece: str) -> list[int]:
        return [self.vocab[piece]] if piece in self.vocab else [self.bytes[x] for x in piece.encode()]


def _paths(model: Model, text: str, entries: list[tuple[int, str | None]], stop: int) -> dict[tuple[int, str], tuple[int, list]]:
    """Pieces that begin before stop, by (begin, piece): which entries reach them (bits), and from where."""
    ends: dict[int, list[tuple[int, str | None, int]]] = {}
    for i, (p, x) in enumerate(entries):
        ends.setdefault(p + len(x or ""), []).append((p, x, 1 << i))
    out: dict[tuple[int, str], tuple[int, list]] = {}
    p = min(ends, default=stop)
    while p < stop:
        before = ends.pop(p, None)
        if before:
            for x in model.at(text, p):
                bits, froms = 0, []
                for q, y, m in before:
                    if y is None or model.fits(y, x):
                        bits |= m
                        froms.append((q, y))
                if bits:
                    out[p, x] = bits, froms
                    ends.setdefault(p + len(x), []).append((p, x, bits))
        p += 1
    return out


def _edges(model: Model, text: str, left: int, right: int, first: bool, last: bool) -> tuple[list, list]:
    """Pieces that may lie over the two cuts of a chunk within its text with context."""
    enter = [(left, None)] if first else model.over(text, left)
    leave = [(p, x) for p, x in model.over(text, right) if not last or p + len(x) == right]
    return enter, leave


def _places(model: Model, text: str, left: int, right: int) -> tuple[int, int] | None:
    """The first and the last place inside a chunk that no piece lies over."""
    a = max(left, 1)
    while a < right and not model.parts_at(text, a):
        a += 1
    if a >= right:
        return None
    b = right - 1
    while not model.parts_at(text, b):
        b -= 1
    return a, b


def _end(piece: tuple[int, str | None]) -> int:
    return piece[0] + len(piece[1] or "")


def _transfer(model: Model, text: str, left: int, right: int, enter: list, leave: list) -> np.ndarray:
    out = np.full((len(enter), len(leave)), LOW, np.float32)
    places = _places(model, text, left, right)
    if places is None:
        paths, known = _paths(model, text, enter, right), {e: i for i, e in enumerate(enter)}
        for j, piece in enumerate(leave):
            bits = paths.get(piece, (0, None))[0]
            out[[i for i in range(len(enter)) if bits >> i & 1], j] = 0
            if piece in known:  # a piece over both cuts
                out[known[piece], j] = 0
        return out
    a, b = places
    bits = 0
    for i, e in enumerate(enter):
        bits |= (_end(e) == a) << i
    for piece, (m, _) in _paths(model, text, [e if _end(e) < a else (a, None) for e in enter], a).items():
        if _end(piece) == a:
            bits |= m
    tail = _paths(model, text, [(b, None)], right)
    rows, cols = [i for i in range(len(enter)) if bits >> i & 1], [j for j, x in enumerate(leave) if x in tail]
    out[np.ix_(rows, cols)] = 0
    return out


def transfer(model: Model, text: str, left: int, right: int, first: bool, last: bool) -> np.ndarray:
    """Weights between the pieces over the left and the right cut: 0 or minus infinity."""
    return _transfer(model, text, left, right, *_edges(model, text, left, right, first, last))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1, initial=LOW)


def tree(matrices: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Levels of a balanced tree of products; the last holds the product of all."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([product(*now[i : i + 2]) if i + 1 < len(now) else now[i] for i in range(0, len(now), 2)])
    return levels


def choose(matrices: list[np.ndarray], enter: int = 0, leave: int | None = None) -> list[tuple[int, int]]:
    """Entry and exit of each chunk on the best path from an entry to an exit of all (None: the best), from the
    tree's root to its leaves."""
    levels = tree(matrices)
    top = levels[-1][0][enter]
    leave = int(top.argmax()) if leave is None and len(top) else leave
    if leave is None or top[leave] == LOW:
        raise ValueError("no path through a document")
    picks = [(enter, leave)]
    for below in reversed(levels[:-1]):
        out = []
        for k, (i, j) in enumerate(picks):
            if 2 * k + 1 < len(below):
                mid = int((below[2 * k][i] + below[2 * k + 1][:, j]).argmax())
                out += [(i, mid), (mid, j)]
            else:
                out.append((i, j))
        picks = out
    return picks


def _walk(model: Model, text: str, begin: tuple[int, str | None], stop: int, now: tuple[int, str] | None = None) -> list[int]:
    """Ids of the pieces after `begin` up to `now`, or up to the piece that ends at stop."""
    paths = _paths(model, text, [begin], stop)
    now = now or next(x for x in paths if _end(x) == stop)
    out: list[list[int]] = []
    while now != begin:
        out.append(model.ids(now[1]))
        froms = paths[now][1]
        now = begin if begin in froms else froms[0]
    return [i for x in reversed(out) for i in x]


def _backtrace(model: Model, text: str, left: int, right: int, begin: tuple, now: tuple) -> list[int]:
    if begin == now:
        return []
    places = _places(model, text, left, right)
    if places is None:
        return _walk(model, text, begin, right, now)
    a, b = places
    head = _walk(model, text, begin, a) if _end(begin) < a else []
    return head + (model.bare.encode(text[a:b]) if a < b else []) + _walk(model, text, (b, None), right, now)


def backtrace(model: Model, text: str, left: int, right: int, first: bool, last: bool, enter: int, leave: int) -> list[int]:
    """Ids of the pieces after a chunk's entry piece up to its exit piece."""
    starts, ends = _edges(model, text, left, right, first, last)
    return _backtrace(model, text, left, right, starts[enter], ends[leave])


def marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def scan(model: Model, text: str, chunk: int = CHUNK) -> list[int]:
    """Ids of one text by the scan, in this process. Pieces over a cut are found once for both its chunks."""
    if not text:
        return []
    text = marked(text)
    n = len(text)
    cuts = [*range(0, n, chunk), n]
    edges = [[(0, None)], *[model.over(text, c) for c in cuts[1:-1]], [x for x in model.over(text, n) if _end(x) == n]]
    spans = list(zip(cuts, cuts[1:], edges, edges[1:], strict=False))
    picks = choose([_transfer(model, text, *x) for x in spans])
    return [i for (a, b, enter, leave), (e, x) in zip(spans, picks, strict=True) for i in _backtrace(model, text, a, b, enter[e], leave[x])]


def encode(docs: DataFrame, model: str, *, ids: bool = False, giant: int = GIANT, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """docs(doc_id, text, ...) with n_pieces, ids_crc32 (little-endian 32 bits), decoded_sha256, round_trip, and ids."""
    new = ["n_pieces long", "ids_crc32 long", "decoded_sha256 string", "round_trip boolean", *["ids array<int>"] * ids]
    docs = docs.drop(*[x.split()[0] for x in new])
    names = docs.columns
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], *new])
    longest = Model(model).longest
    hashed, traced_ids = unused(docs, "text_hash", "found_ids")

    def finish(b: pa.RecordBatch, found: list[list[int]], known: Model) -> pa.RecordBatch:
        decoded = known.whole.decode(found)
        texts = [t or "" for t in b["text"].to_pylist()]
        crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in found]
        more = [pa.array(list(map(len, found)), pa.int64()), pa.array(crc, pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]), pa.array([x == y for x, y in zip(texts, decoded, strict=True)])]
        if ids:
            more.append(pa.array(found, pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays([*(b[n] for n in names), *more], [*names, *[x.split()[0] for x in new]])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(model)
        for b in pieces(batches, "text"):
            texts = [t or "" for t in b["text"].to_pylist()]
            short = iter(known.whole.encode([t for t in texts if len(t) <= chunk], num_threads=1))
            yield finish(b, [next(short) if len(t) <= chunk else scan(known, t, chunk) for t in texts], known)

    large = F.coalesce(F.length("text"), F.lit(0)) > max(giant, chunk)
    small = docs.where(~large).mapInArrow(plain, schema)

    # Chunks with context on both sides; of rows that repeat, one.
    giants = docs.where(large).withColumn(hashed, F.xxhash64("text"))
    text = F.concat(F.lit(SPACE), F.translate("text", " ", SPACE))
    one = giants.select(F.col("doc_id").alias("doc"), F.col(hashed).alias("sum"), "text").dropDuplicates(["doc", "sum"]).select("doc", "sum", text.alias("m"), (F.length("text") + 1).alias("n"))
    each = one.select("doc", "sum", "m", "n", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(chunk))).alias("i", "a"))
    begin = F.greatest(F.lit(0), F.col("a") - longest)
    chunks = each.select("doc", "sum", "i", (F.col("i") == 0).alias("first"), (F.col("a") + chunk >= F.col("n")).alias("last"), F.expr(f"substring(m, greatest(0, a - {longest}) + 1, least(n, a + {chunk}) + {longest} - greatest(0, a - {longest}))").alias("part"), (F.col("a") - begin).alias("left"), (F.least("n", F.col("a") + chunk) - begin).alias("right"))
    chunks = chunks.repartition(parts_for(docs, 64 << 20), "doc", "sum", "i")
    key = [("doc", docs.schema["doc_id"].dataType.simpleString()), ("sum", "long"), ("i", "int")]
    keys = ", ".join(f"{n} {t}" for n, t in key)

    def by_rows(names: list[str], make):
        """mapInArrow of rows that keep their key; make(row, model) gives the other values of one or more rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = lru_cache(1)(lambda: Model(model))  # of this task
            for b in batches:
                for r in b.to_pylist():
                    rows = make(r, known)
                    k = len(rows)
                    base = [pa.array([r["doc"]] * k, b.schema.field("doc").type), pa.array([r["sum"]] * k, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*base, *[pa.array([x[c] for x in rows], t) for c, t in enumerate((pa.int32(), *kinds[len(names)]))]], ["doc", "sum", "i", *names])

        kinds = {1: (pa.binary() if names == ["matrix"] else pa.list_(pa.int32()),), 2: (pa.int32(), pa.int32())}
        return run

    def place(r: dict) -> tuple:
        return r["part"], r["left"], r["right"], r["first"], r["last"]

    def descend(r: dict, known) -> list[tuple[int, int, int]]:
        found = choose([pickle.loads(x["matrix"]) for x in r["all"]], r["enter"], None if r["leave"] < 0 else r["leave"])
        return [(x["i"], *e) for x, e in zip(r["all"], found, strict=True)]

    def met(df: DataFrame) -> DataFrame:
        """Matrices by group, in order: a group's number and its members."""
        return df.groupBy("doc", "sum", F.floor(F.col("i") / group).cast("int").alias("g")).agg(F.array_sort(F.collect_list(F.struct("i", "matrix"))).alias("all")).withColumnRenamed("g", "i")

    same = lambda x, y, *more: F.col(f"{x}.doc").eqNullSafe(F.col(f"{y}.doc")) & (F.col(f"{x}.sum") == F.col(f"{y}.sum"))
    low = met(chunks.mapInArrow(by_rows(["matrix"], lambda r, known: [(r["i"], pickle.dumps(transfer(known(), *place(r))))]), f"{keys}, matrix binary"))
    top = met(low.mapInArrow(by_rows(["matrix"], lambda r, known: [(r["i"], pickle.dumps(tree([pickle.loads(x["matrix"]) for x in r["all"]])[-1][0]))]), f"{keys}, matrix binary"))
    picks = top.select("*", F.lit(0).alias("enter"), F.lit(-1).alias("leave")).mapInArrow(by_rows(["enter", "leave"], descend), f"{keys}, enter int, leave int")
    picks = low.alias("l").join(picks.alias("p"), same("l", "p") & (F.col("l.i") == F.col("p.i"))).select("l.*", "enter", "leave").mapInArrow(by_rows(["enter", "leave"], descend), f"{keys}, enter int, leave int")
    joined = chunks.alias("c").join(picks.alias("k"), same("c", "k") & (F.col("c.i") == F.col("k.i"))).select("c.*", "enter", "leave")
    traced = joined.mapInArrow(by_rows(["ids"], lambda r, known: [(r["i"], backtrace(known(), *place(r), r["enter"], r["leave"]))]), f"{keys}, ids array<int>")
    traced = traced.groupBy("doc", "sum").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"])).alias(traced_ids))
    whole = giants.alias("g").join(traced.alias("t"), F.col("g.doc_id").eqNullSafe(F.col("t.doc")) & (F.col(f"g.{hashed}") == F.col("t.sum")), "left").select(*[F.col(f"g.`{n}`") for n in names], F.col(traced_ids))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(model)
        for b in pieces(batches, "text"):
            yield finish(b, b[traced_ids].to_pylist(), known)

    return small.unionByName(whole.mapInArrow(close, schema))


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")
