"""What SimHash near-dedup adds where links have to be of exact likeness: sets of word shingles, candidates, checks.

Texts of equal sets are one node. Candidates come from SimHash groups (stars), then from prefixes: of every
set as many shingles are kept as two sets of at least LIKENESS can't both miss, in one order of all shingles (rare
first, by a table of counts of a fixed size), so every such pair shares a shingle of both prefixes. Where up to FEW
nodes share one, all their pairs are candidates. Larger groups would have too many; there each node is first compared
with centres: a component of many texts comes together by its links to these. What is left are pairs
across components. All of them are judged by parity maps, in blocks of about BLOCK nodes: the bits in which two maps
differ are no more than the shingles in which the sets differ, so no pair as alike as asked is lost; maps grow with the
sets, so few others pass, however large the sets are. Of the pairs that pass in a block only those that span its
components are compared first; then, once components are joined by what that finds, all others across these.
Candidates are compared over their whole sets, and components are made of the links that pass: they are those of
all links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, drop, gram_hashes, pieces, session, span_hashes, view, word_spans

WORDS = 5
#: Likeness in per cent: shared shingles of all shingles of both sets.
LIKENESS = 80
#: Bits of a cell in the table of counts.
COUNTS = 18
#: Nodes of a shingle up to which all pairs are compared; beyond, shingles by which a node is, and nodes of a centre.
FEW, TAKEN, PART = 8, 4, 256
#: Bits of a small parity map (a power of two), bits a shingle and in all at most of a wide one, nodes of a block on average.
BITS, WIDE, MOST, BLOCK = 512, 4, 1 << 17, 1024
#: Columns of a small parity map.
MAP = [f"m{i}" for i in range(BITS // 64)]
#: Parts of a star.
SALTS = 64

#: A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    data, off = view(texts)
    data = LOWER[data]
    starts, ends, at = word_spans(data, off)
    hashes = span_hashes(data, starts, ends)
    grams = gram_hashes(hashes, words)
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        yield np.unique(grams[a : b - words + 1] if b - a >= words else gram_hashes(hashes[a:b], b - a) if b > a else hashes[:0])


def prefix(n: int, likeness: int = LIKENESS) -> int:
    """How many of n shingles a set as alike as that can't all miss."""
    return n - -(-likeness * n // 100) + 1


def parity(s: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A map of a set: of every bit, whether an odd number of the shingles has it by their leading bits."""
    at = (s >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).view(np.int64)


def wide(s: np.ndarray) -> bytes:
    """The parity map of a set with bits enough for its size."""
    return parity(s, min(MOST, max(BITS, 1 << (WIDE * len(s) - 1).bit_length()))).tobytes()


def folded(maps: np.ndarray) -> np.ndarray:
    """Maps of half the bits: two neighbours of a map are one bit of these."""
    bits = np.unpackbits(maps.view(np.uint8), axis=1)
    return np.packbits(bits[:, ::2] ^ bits[:, 1::2], axis=1).view(np.uint64)


def may_be_alike(maps: np.ndarray, n: np.ndarray, component: np.ndarray, side: np.ndarray, likeness: int, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (of side 0 with side 1; of all where no row is of side 1) of different components that sizes and
    parity maps allow to be as alike as asked."""
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    one = not len(y)
    y = x if one else y
    out = []
    for lo in range(0, len(x), step):
        a = x[lo : lo + step]
        na, nb = n[a][:, None], n[y][None, :]
        ok = (component[a][:, None] != component[y][None, :]) & (100 * np.minimum(na, nb) >= likeness * np.maximum(na, nb))
        if one:
            ok &= a[:, None] < y[None, :]
        i, j = np.nonzero(ok)
        i, j = a[i], y[j]
        apart, most = np.zeros(len(i), np.int64), (100 - likeness) * (n[i] + n[j]) // (100 + likeness)
        for word in range(0, maps.shape[1], 8):
            apart += np.bitwise_count(maps[i, word : word + 8] ^ maps[j, word : word + 8]).sum(axis=1, dtype=np.int64)
            near = apart <= most
            i, j, apart, most = i[near], j[near], apart[near], most[near]
        out.append((i, j))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (x, y)


def may_be_alike_wide(maps: list[bytes], n: np.ndarray, component: np.ndarray, side: np.ndarray, likeness: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for wide maps. Sizes that may be alike have maps of one width, or of neighbouring ones."""
    width, two = np.array(list(map(len, maps))), side.any()
    at = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
    rows = {w: np.frombuffer(b"".join(maps[k] for k in own.tolist()), np.uint64).reshape(len(own), -1) for w, own in at.items()}
    found = []
    for w, own in at.items():
        found.append(_judged(own, rows[w], side[own], n, component, likeness) if not two or len(set(side[own].tolist())) == 2 else None)
        if 2 * w in at:
            both, more = np.concatenate([own, at[2 * w]]), np.concatenate([rows[w], folded(rows[2 * w])])
            larger = np.arange(len(both)) >= len(own)
            for take in ((side[both] == larger), (side[both] != larger)) if two else (None,):
                part = slice(None) if take is None else take
                if len(set(larger[part].tolist())) == 2:
                    found.append(_judged(both[part], more[part], larger[part].astype(int), n, component, likeness))
    found = [x for x in found if x is not None]
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _judged(at: np.ndarray, maps: np.ndarray, side: np.ndarray, n: np.ndarray, component: np.ndarray, likeness: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = may_be_alike(maps, n[at], component[at], side, likeness)
    return at[i], at[j]


def spanning(a: np.ndarray, b: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows, in the order given, join components that none before them joined."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := top.get(x, x)) != x:
            top[x] = x = top.get(y, y)
        return x

    kept = []
    x, y = component[a], component[b]
    _, first = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1, return_index=True)
    for k in np.sort(first).tolist():
        p, q = find(int(x[k])), find(int(y[k]))
        if p != q:
            top[p] = q
            kept.append(k)
    return np.array(kept, np.int64)


class Sets:
    """The shingle sets of docs(doc_id, text, sum), by passes over the texts."""

    def __init__(self, docs: DataFrame, words: int, likeness: int) -> None:
        self.docs, self.words, self.likeness = docs, words, likeness

    def _each(self):
        words = self.words

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
            for b in pieces(batches, "text"):
                sets = list(shingles(b["text"], words))
                yield b, sets, np.array([int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True) for s in sets], np.int64)

        return each

    def rows(self) -> DataFrame:
        """doc_id, sum, node, size of its set (n) and parity map (MAP), of every row."""
        each = self._each()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, sets, node in each(batches):
                maps = np.array([parity(s) for s in sets]).reshape(len(sets), -1).T.copy()
                n = np.array(list(map(len, sets)), np.int64)
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["sum"], *map(pa.array, (node, n, *maps))], ["doc_id", "sum", "node", "n", *MAP])

        return self.docs.mapInArrow(run, f"doc_id long, sum long, node long, n long, {', '.join(f'{m} long' for m in MAP)}")

    def counts(self) -> np.ndarray:
        """Shingles by cell of a table of a fixed size, over all documents."""
        each, cell = self._each(), np.uint64((1 << COUNTS) - 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(1 << COUNTS, np.int64)
            for _, sets, _ in each(batches):
                n += np.bincount((np.concatenate(sets) & cell).astype(np.int64), minlength=len(n))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["cell", "n"])

        table = np.zeros(1 << COUNTS, np.int64)
        found = self.docs.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        table[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
        return table

    def prefixes(self) -> DataFrame:
        """h, node, n: the kept shingles of every node, and the size of its set."""
        each, cell, likeness = self._each(), np.uint64((1 << COUNTS) - 1), self.likeness
        known = session(self.docs).sparkContext.broadcast(self.counts())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, sets, node in each(batches):
                kept = [s[np.lexsort((s, known.value[(s & cell).astype(np.int64)]))][: prefix(len(s), likeness)] if len(s) else s for s in sets]
                at = np.repeat(np.arange(len(sets)), list(map(len, kept)))
                n = np.array(list(map(len, sets)), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kept).view(np.int64)), pa.array(node[at]), pa.array(n[at])], ["h", "node", "n"])

        return self.docs.mapInArrow(run, "h long, node long, n long").distinct()

    def wholes(self, docs: DataFrame) -> DataFrame:
        """node and all shingles, of some of the documents."""
        each = self._each()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, sets, node in each(batches):
                off = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(sets).view(np.int64)))], ["node", "all"])

        return docs.mapInArrow(run, "node long, all array<long>").dropDuplicates(["node"])

    def shown(self, asked: DataFrame, nodes: DataFrame) -> DataFrame:
        """The documents that show the texts of asked(node)."""
        return self.docs.join(asked.distinct().join(nodes, "node").select("r.*").distinct(), ["doc_id", "sum"], "left_semi")

    def wides(self, docs: DataFrame) -> DataFrame:
        """node and its wide map, of some of the documents."""
        each = self._each()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, sets, node in each(batches):
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([wide(s) for s in sets], pa.binary())], ["node", "map"])

        return docs.mapInArrow(run, "node long, map binary").dropDuplicates(["node"])

    def alike(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes(node, n, MAP, r: the row that shows its text) whose sets are as alike as asked."""
        x, y = (nodes.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}{k}") for c in ("n", *MAP)]) for k in "ab")
        apart = sum((F.bit_count(F.col(f"{m}a").bitwiseXOR(F.col(f"{m}b"))) for m in MAP), F.lit(0))
        may = _sized(self.likeness) & (apart * (100 + self.likeness) <= (100 - self.likeness) * (F.col("na") + F.col("nb")))
        left = cut(pairs.join(x, "a").join(y, "b").where(may).select("a", "b"))
        whole = cut(self.wholes(self.shown(left.select(F.col("a").alias("node")).union(left.select("b")), nodes)))
        x, y = (whole.select(F.col("node").alias(k), F.col("all").alias(f"all{k}")) for k in "ab")
        shared = F.size(F.array_intersect("alla", "allb"))
        near = 100 * shared >= self.likeness * (F.size("alla") + F.size("allb") - shared)
        return cut(left.join(x, "a").join(y, "b").where(near).select("a", "b"), whole, left)


def star(members: DataFrame, key: str) -> DataFrame:
    """Pairs that join the nodes of each key: in SALTS parts a star each, and one of the stars' centres."""
    part = members.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    centre = part.groupBy(key, "part").agg(F.min("node").alias("a"))
    least = centre.groupBy(key).agg(F.min("a").alias("low"))
    pairs = part.join(centre, [key, "part"]).select("a", F.col("node").alias("b")).unionByName(centre.join(least, key).select(F.col("low").alias("a"), F.col("a").alias("b")))
    return pairs.where("a <> b").distinct()


def _sized(likeness: int):
    return 100 * F.least("na", "nb") >= likeness * F.greatest("na", "nb")


def _sides(rows: DataFrame, on: list[str], *more: str) -> tuple[DataFrame, DataFrame]:
    """rows(node, n, ...) twice, for pairs."""
    return tuple(rows.select(*on, F.col("node").alias(x), F.col("n").alias(f"n{x}"), *[F.col(c).alias(f"{c}{x}") for c in more]) for x in "ab")


def by_shingle(posts: DataFrame, likeness: int, few: int) -> DataFrame:
    """Candidate pairs (a < b) of posts(h, node, n, held, component), of different components: of shingles that few nodes hold all pairs; for the others
    every node takes the TAKEN of its shingles that come first in an order by hash, the same for all nodes, and is
    compared with one centre of each, among PART nodes at most on average."""
    x, y = _sides(posts.where(F.col("held") <= few), ["h"], "component")
    small = x.join(y, "h").where((F.col("a") < F.col("b")) & (F.col("componenta") != F.col("componentb")) & _sized(likeness)).select("a", "b")
    order = Window.partitionBy("node").orderBy(F.xxhash64("h"), "h")
    taken = posts.where(F.col("held") > few).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= TAKEN)
    taken = taken.withColumn("part", F.pmod(F.xxhash64("node", "h"), F.ceil(F.col("held") / PART))).select("h", "part", "node", "n", "component")
    centre = taken.groupBy("h", "part").agg(F.min_by(F.struct("node", "n", "component"), F.xxhash64("node", "h")).alias("c")).select("h", "part", F.col("c.node").alias("a"), F.col("c.n").alias("na"), F.col("c.component").alias("componenta"))
    large = taken.withColumnsRenamed({"node": "b", "n": "nb", "component": "componentb"}).join(centre, ["h", "part"]).where((F.col("componenta") != F.col("componentb")) & _sized(likeness)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return small.unionByName(large).distinct()


def blocks(placed: DataFrame, likeness: int, block: int) -> DataFrame:
    """h, x, y (numbers of two blocks, or of one), side and node, component, n of the rows of placed(h, size, node,
    component, n): every two nodes of h and different components that sizes don't keep apart are together in some (x, y).

    A shingle of up to `block` nodes is one block. The nodes of others go by bands of set sizes, of which only neighbours
    meet; in a band a component of a block and more has blocks of its own, which do not meet each other, and smaller
    ones are dealt whole."""
    one = placed.where(F.col("size") <= block).select("h", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).alias("side"), "node", "component", "n")
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / likeness) + 1e-6)).cast("int")
    hot = placed.where(F.col("size") > block).withColumn("band", band)
    held = hot.groupBy("h", "band", "component").agg(F.count("*").alias("k"))
    small = held.where(F.col("k") < block).groupBy("h", "band").agg(F.sum("k").alias("rest"))
    large = F.col("k") >= block
    dealt = held.join(small, ["h", "band"], "left").select("h", "band", "component", F.when(large, F.col("component")).alias("owner"), F.ceil(F.when(large, F.col("k")).otherwise(F.col("rest")) / block).alias("of"))
    part = F.pmod(F.xxhash64(F.when(F.col("owner").isNotNull(), F.col("node")).otherwise(F.col("component"))), F.col("of"))
    hot = hot.join(dealt, ["h", "band", "component"]).withColumn("seat", F.xxhash64("band", F.coalesce("owner", F.lit(0)), F.col("owner").isNull(), part))
    seats = hot.groupBy("h", "seat").agg(F.min("band").alias("band"), F.min("owner").alias("owner"))
    x, y = (seats.withColumnsRenamed({"seat": k, "band": f"band{k}", "owner": f"owner{k}"}) for k in "xy")
    meet = x.join(y, "h").where((F.col("x") <= F.col("y")) & (F.abs(F.col("bandx") - F.col("bandy")) <= 1) & F.coalesce(F.col("ownerx") != F.col("ownery"), F.lit(True))).select("h", "x", "y")
    sides = meet.select("h", "x", "y", F.explode(F.when(F.col("x") == F.col("y"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("seat", F.when(F.col("side") == 0, F.col("x")).otherwise(F.col("y")))
    return one.unionByName(hot.join(sides, ["h", "seat"]).select("h", "x", "y", "side", "node", "component", "n"))


def place(posts: DataFrame, ends: DataFrame) -> DataFrame:
    """posts(node, ...) with the components that ends(id, component) gives; other nodes are their own."""
    return posts.join(ends.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))


def mixed(placed: DataFrame) -> DataFrame:
    """h, size, node, component, n of the shingles of placed(h, node, n, component) that several components hold."""
    several = placed.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high").select("h", "size")
    return placed.select("h", "node", "component", "n").join(several, "h")


def across(placed: DataFrame, maps: DataFrame, likeness: int, block: int = BLOCK, span: bool = False) -> DataFrame:
    """Candidate pairs (a < b) of nodes of different components that share a shingle of mixed(): all that maps(node,
    map) allow to be as alike as asked; or (span) of every block only such that join its components as far as all would."""
    dealt = blocks(placed, likeness, block).join(maps, "node")

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        node, n, component, side = (t[c].to_numpy() for c in ("node", "n", "component", "side"))
        i, j = may_be_alike_wide(t["map"].to_pylist(), n, component, side, likeness)
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        if span and len(a):
            order = np.lexsort((b, a))  # the same in every block
            kept = order[spanning(i[order], j[order], component)]
            a, b = a[kept], b[kept]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for t in batches:
            keys = np.stack([t[c].to_numpy() for c in ("h", "x", "y")])
            edge = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
            for lo, hi in zip(edge, edge[1:], strict=False):
                if lo == hi:
                    continue
                if held and tuple(keys[:, lo].tolist()) != now:
                    yield solve(held)
                    held = []
                now = tuple(keys[:, lo].tolist())
                held.append(t.slice(lo, hi - lo))
        if held:
            yield solve(held)

    parts = int(session(placed).conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "h", "x", "y").sortWithinPartitions("h", "x", "y").mapInArrow(run, "a long, b long").distinct()


def groups(docs: DataFrame, hints: DataFrame, components, words: int = WORDS, likeness: int = LIKENESS, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """doc_id, sum and component (a number) of every row of docs(doc_id, text, sum).

    hints(doc_id, hint): documents that may be alike; components(edges(a, b)): least connected ids."""
    sets = Sets(docs, words, likeness)
    rows = cut(sets.rows())
    nodes = cut(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", *MAP)], F.min(F.struct("doc_id", "sum")).alias("r")))
    kept = sets.prefixes()
    held = kept.groupBy("h").agg(F.count("*").alias("held")).where("held > 1")
    posts = cut(kept.join(held, "h"))
    hinted = star(rows.join(hints, "doc_id").select("node", "hint").distinct(), "hint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    asked = cut(hinted.unionByName(by_shingle(posts.withColumn("component", F.col("node")), likeness, few)).distinct())
    near = sets.alike(asked, nodes)
    ends = components(near)
    # The rest, so that no link is lost, where a shingle of many nodes holds several components.
    many, maps = posts.where(F.col("held") > few), None
    for span in (True, False):
        left = cut(mixed(place(many, ends)))
        if maps is None:
            maps = cut(sets.wides(sets.shown(left.select("node"), nodes)))
        more = cut(across(left, maps, likeness, block, span).join(asked, ["a", "b"], "left_anti"), left)
        if more.isEmpty():  # of the first that span, all may have been asked; others are left
            continue
        asked, near = asked.unionByName(more), near.unionByName(sets.alike(more, nodes))
        ends = components(near)
    drop(maps, posts, nodes)
    return rows.join(ends.select(F.col("id").alias("node"), "component"), "node", "left").select("doc_id", "sum", F.coalesce("component", "node").alias("component"))
