"""Each operator on a small table of odd rows, against brute force, and on an empty table."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from depweave.llm import _passages, _similar, decontaminate, fingerprint, language, pieces, quotation, sharding, simhash, substring_dedup, suffix_dedup, token_output
from depweave.llm._common import gram_hashes
from depweave.llm.token_output import pack, unpack

R = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]
PASSAGE = " ".join(R.choice(WORDS) for _ in range(90))
BENCH = " ".join(R.choice(WORDS) for _ in range(30))


def _text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


LONG = _text(300)
TEXTS = [
    None, "", " \t\n", "one", "12 34 !!", _text(60), _text(60), PASSAGE, "Start " + PASSAGE + " end", _text(30) + "\n" + PASSAGE[40:] + "  " + _text(30), LONG, LONG, LONG.replace("w1 ", "x1 "),
    LONG + " tail", "ab " * 200, "ab " * 150 + "c", "Été à la plage. " * 12, "der die das und über " * 20, "中文 测试 文本 " * 15, _text(20) + " " + BENCH + " " + _text(20), "No, " + BENCH.upper(), _text(700), "x" * 400, "y" + "x" * 300, "a>b\n> c",
]
ROWS = [(10 * i + 3, t, None if i % 6 == 5 else ("fr" if t and "plage" in t else "de" if t and "über" in t else "en"), f"s{i % 3}", len(t or ""), -1, "own") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[10], (ROWS[8][0], PASSAGE + " other", "en", "s0", 5, -1, "own"), (None, PASSAGE, "en", None, None, None, None), (-7, LONG, "en", "s1", 3, 0, "own")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept long, found string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def windows_removed(units, window):
    """Brute force: for each (id, units) which are covered by a window that starts in a smaller id."""
    first = {}
    for i, u in units:
        if i is not None:
            for s in range(len(u) - window + 1):
                k = tuple(u[s : s + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, u in units:
        gone = [False] * len(u)
        for s in range(len(u) - window + 1):
            if i is not None and first[tuple(u[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out.append(gone)
    return out


HOT = [{}, {"hot": 2, "hot_batch": 3}, {"hot": 1, "hot_batch": 99}]


@pytest.mark.parametrize("options", HOT)
def test_substring_dedup(docs, empty, options):
    units = [(r[0], (r[1] or "").encode().split()) for r in ROWS]
    want = sorted(((i, len(u), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(u, g) if not y)).hexdigest()) for (i, u), g in zip(units, windows_removed(units, 50))), key=repr)
    out = substring_dedup.substring_dedup(docs.withColumnRenamed("lang", "spans"), **options)
    assert rows(out.select("doc_id", "n_words", "n_removed", "kept_sha256")) == want
    assert sum(x[2] for x in want) > 300 and "source" in out.columns
    assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("options", HOT)
def test_suffix_dedup(docs, empty, options):
    units = [(r[0], (r[1] or "").encode()) for r in ROWS]
    want = []
    for (i, u), g in zip(units, windows_removed(units, 50)):
        kept = bytes(x for x, y in zip(u, g) if not y)
        want.append((i, len(u), sum(g), len([x for x in bytes(g).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    out = suffix_dedup.suffix_dedup(docs, **options)
    assert rows(out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == sorted(want, key=repr)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("dedup, window, unit", [(substring_dedup.substring_dedup, 50, "word"), (suffix_dedup.suffix_dedup, 50, "byte")])
def test_dedup_of_a_hot_group(spark, dedup, window, unit):
    """Near copies of one text, a third of all rows, with thresholds that make their anchors hot or not."""
    r = random.Random(3)
    base, rows_ = [f"v{r.randrange(90)}" for _ in range(300)], []
    for i in range(90):
        t = list(base) if i % 3 == 0 else [r.choice(WORDS) for _ in range(60)]
        for _ in range(r.randrange(4)):
            t[r.randrange(len(t))] = r.choice(WORDS)
        rows_.append((i, " ".join(t)))
    units = [(i, t.encode() if unit == "byte" else t.encode().split()) for i, t in rows_]
    want = sorted((i, sum(g)) for (i, _), g in zip(units, windows_removed(units, window)))
    docs = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    for options in ({}, {"hot": 8}, {"hot": 1000, "hot_batch": 4}):
        assert rows(dedup(docs, **options).select("doc_id", "n_removed")) == sorted(want, key=repr), options


@pytest.mark.parametrize("kernel", [substring_dedup.automata_kernel, suffix_dedup.expansion_kernel])
def test_covers_of_a_segment_with_many_members(kernel):
    """Members of a segment are covered as each alone would be, by few calls; `distinct` is np.unique."""
    r, join = random.Random(2), (b"" if kernel is suffix_dedup.expansion_kernel else b" ").join
    base = [r.choice([b"a", b"b", b"c", b"d"]) for _ in range(60)]
    texts = [join(base), join(base[:40]), join(base[20:])]
    members = [[(r.randrange(900, 2000), k, k % 7) for k in range(2000)], [(950, 5, 3), (1500, 6, 0)], [(1200, 8, 1)]]
    calls = []

    def counted(*args):
        cover = kernel(*args)
        return lambda k, doc: (calls.append(k), cover(k, doc))[1]

    batch = pa.RecordBatch.from_arrays([pa.array([4, 4, 4]), pa.array(texts), pa.array([np.array(m, _passages.MEMBER).tobytes() for m in members])], ["home", "segment", "members"])
    (out,) = _passages._covered(_passages.Plan("byte", 12, 5, 64, kernel=counted), 3)(iter([batch]))
    got = defaultdict(list)
    for d, f in zip(out["docs"].to_pylist(), out["found"].to_pylist()):
        docs_, spans = np.frombuffer(d, _passages.DOC), np.frombuffer(f, _passages.SPAN)
        for x, y in zip(np.repeat(docs_[["id", "sum"]], docs_["n"]).tolist(), spans.tolist(), strict=True):
            got[x].append(y)
    alone = kernel(12, texts, [min(m)[0] for m in members], [max(m)[0] for m in members])
    want = {(i, s): [(a + begin, b + begin) for a, b in alone(k, i).tolist()] for k, m in enumerate(members) for i, s, begin in m if len(alone(k, i))}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 1900 and len(calls) < 60
    rec = np.zeros(40, _passages.HOMED)
    rec["pos"], rec["home"] = [r.randrange(20) for _ in range(40)], [r.randrange(2) for _ in range(40)]
    assert (_passages.distinct(rec) == np.unique(rec)).all() and (_passages.distinct(np.unique(rec)) == np.unique(rec)).all()


@pytest.mark.parametrize("kernel", [substring_dedup.automata_kernel, suffix_dedup.expansion_kernel])
def test_kernels_on_many_near_copies(kernel):
    r = random.Random(1)
    byte = kernel is suffix_dedup.expansion_kernel
    base = [r.choice("abcdefgh") if byte else f"w{r.randrange(50)}" for _ in range(40)]
    texts = defaultdict(list)
    for d in range(60):
        t = list(base)
        for _ in range(r.randrange(3)):
            t[r.randrange(40)] = r.choice("xy")
        texts[("" if byte else " ").join(t).encode()].append(d)
    units = [(i, t if byte else t.split()) for t, ids in texts.items() for i in ids]
    cover = kernel(12, list(texts), [min(v) for v in texts.values()], [max(v) for v in texts.values()])
    at = list(texts)
    for (i, u), gone in zip(units, windows_removed(units, 12)):
        got = [False] * len(u)
        for a, b in cover(at.index(u if byte else b" ".join(u)), i).tolist():
            got[a:b] = [True] * (b - a)
        assert got == gone


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_decontaminate(spark, docs, empty, limit):
    items = [(1, BENCH, "x"), (22, "One", "x"), (3, None, "x"), (4, "!!", "x"), (None, LONG, "x"), (5, "die das und", "x"), (1, BENCH, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string, items string")
    tr = {i: i + 32 for i in range(65, 91)}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(tr))
    table = defaultdict(set)
    for i, t, _ in items:
        w = words(t)
        for s in range(max(1, len(w) - 12) if w and i is not None else 0):
            table[tuple(w[s : s + min(13, len(w))])].add(str(i))
    want = []
    for r in ROWS:
        w = words(r[1])
        hit, found = [0] * len(w), set()
        for k, v in table.items():
            for s in range(len(w) - len(k) + 1):
                if tuple(w[s : s + len(k)]) == k:
                    hit[s : s + len(k)] = [1] * len(k)
                    found |= v
        want.append((r[0], len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    out = decontaminate.decontaminate(docs, bench, broadcast_bytes=limit)
    assert rows(out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == sorted(want, key=repr)
    assert sum(x[5] for x in want) >= 4
    assert decontaminate.decontaminate(empty, bench, broadcast_bytes=limit).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_decontaminate_item_cut_over_two_rows(spark, limit):
    item = [f"q{i}" for i in range(50)]
    chunks = [(1, "a b c " + " ".join(item[:25])), (2, " ".join(item[25:]) + " d e")]
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    out = decontaminate.decontaminate(spark.createDataFrame(chunks, "doc_id long, text string").coalesce(1), bench, broadcast_bytes=limit)
    digest = hashlib.sha256(b"9").hexdigest()
    assert rows(out.drop("text")) == [(1, 28, 25, 1, digest, True), (2, 27, 25, 1, digest, True)]


def test_language(spark, docs, empty):
    net = language.network(["a", "b", "c"], hidden=3)
    for name in ("read", "recur"):
        setattr(net, name, [w.astype(float) for w in getattr(net, name)])
    net.label, net.bias = net.label.astype(float), net.bias.astype(float)
    r = np.random.default_rng(1)
    x, mask, y = r.integers(0, 256, (6, 4)), np.ones((6, 4)), r.integers(0, 3, 4)
    mask[4:, 1] = 0
    _, grads = language.gradients(net, x, mask, y)
    for w, g in zip(net.weights(), grads):
        i = (x[0, 0], 1) if w.shape[0] == 256 else (0,) * w.ndim
        old, pair = w[i], []
        for e in (1e-5, -1e-5):
            w[i] = old + e
            pair.append(language.gradients(net, x, mask, y)[0])
            w[i] = old
        assert abs((pair[0] - pair[1]) / 2e-5 - g[i]) < 1e-6
    learned = language.train([(f"the {w} and of {w}ing", "en") for w in WORDS[:60]] + [(f"les été {w} où à la", "fr") for w in WORDS[:60]])
    out = {(r.doc_id, r.text): r for r in language.predict(docs, learned).collect()}
    for r in ROWS:
        got = out[r[0], r[1]]
        assert 0 <= got.score <= 1 and (got.lang_pred == "und") == (not any(c.isalpha() for c in r[1] or ""))
    assert out[163, TEXTS[16]].lang_pred == "fr"
    assert language.learn(empty) is None and language.predict(empty, None).count() == 0
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = language.predict(d.withColumn("held_out", language.held_out()), language.learn(d)).where("held_out").toPandas()
    assert len(p) > 150 and (p.lang == p.lang_pred).mean() > 0.97


def test_sharding(docs, empty):
    for law in ("bytes", "rows", "key"):
        out = sharding.shard(docs, law).toPandas()
        assert len(out) == len(ROWS)
        for _, g in out.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
        assert sorted(out["size"]) == sorted(len((r[1] or "").encode()) + 1 for r in ROWS)
        assert sorted(out.text_crc32) == sorted(zlib.crc32((r[1] or "").encode()) for r in ROWS)
        if law == "rows":
            n = out.groupby("shard").size().reindex(range(8), fill_value=0)
            assert n.max() - n.min() <= 1
        if law == "key":
            moved = out[out.grown_shard != out["shard"]]
            assert (moved.grown_shard == 8).all()
        else:
            assert out.grown_shard.isna().all()
    assert sharding.shard(empty).count() == 0


def test_sharding_round_against_brute_force(spark):
    r = random.Random(6)
    rows_ = [(i, r.choice([None, *range(12)]), r.randrange(1, 30), r.randrange(4)) for i in range(120)]
    rows_ += [(1000 + i, 99, 40, i % 4) for i in range(30)]  # a group that no shard can hold
    nodes = spark.createDataFrame(rows_, "id long, grp long, size long, shard int")
    load = [sum(x[2] for x in rows_ if x[3] == s) for s in range(4)]
    quota = int(sum(load) / 4 * 1.25) + 1
    room = [max(0, quota - x) for x in load]
    want = {}
    for g in {x[1] for x in rows_ if x[1] is not None}:
        held = [sum(x[2] for x in rows_ if x[1] == g and x[3] == s) for s in range(4)]
        fit = [(held[s], -s) for s in range(4) if sum(held) - held[s] <= room[s]]
        if fit and sum(held) > max(fit)[0]:
            want[g] = (-max(fit)[1], sum(held) - max(fit)[0])
    assert {x.grp: (x.to, x.asks) for x in sharding.targets(nodes.where("grp is not null"), room).collect()} == want and 99 not in want
    cell = {x.grp: x.c for x in nodes.selectExpr("grp", "pmod(xxhash64(grp), 1024) AS c").distinct().collect()}
    moved, used = {}, [0] * 4
    for g in sorted(want, key=lambda g: (cell[g], g)):
        to, asks = want[g]
        used[to] += asks
        if used[to] <= room[to]:
            moved[g] = to
    got = {x.id: x.shard for x in sharding.propagate(nodes, 4, rounds=1).collect()}
    assert got == {i: moved.get(g, s) for i, g, _, s in rows_} and moved


@pytest.mark.parametrize("hot", [0, 800])
def test_sharding_keeps_copies_together(spark, hot):
    """Groups of 16 copies, beside a group of a third of all rows."""
    rows_ = [(i, f"text {i % 100} " + "x" * (i % 100)) for i in range(1600)] + [(5000 + i, "hot " * 12) for i in range(hot)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    out = sharding.shard(docs).toPandas()
    size = out.groupby("shard")["size"].sum()
    assert size.max() < 1.05 * size.mean()
    cold = out[out.doc_id < 5000].assign(t=lambda x: x.doc_id % 100)
    assert (cold.groupby("t")["shard"].nunique() == 1).sum() >= 88
    links = sum(n * (n - 1) // 2 for n in out.groupby("text_crc32").size())
    apart = links - sum(n * (n - 1) // 2 for n in out.groupby(["text_crc32", "shard"]).size())
    before = sharding.shard(docs, rounds=0)  # by hash, cut in its order
    assert out.copies_elsewhere.sum() == 2 * apart and (hot or apart < 0.1 * before.agg({"copies_elsewhere": "sum"}).first()[0] / 2)


def brute_fingerprint(text, n=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, ids, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)].append(ids[i])
    return [min(least[find(i)], default=None) for i in range(len(fps))]


def test_simhash(docs, empty):
    fps = [brute_fingerprint(r[1]) for r in ROWS]
    want = sorted(zip([r[0] for r in ROWS], [f"{x:016x}" for x in fps], brute_components(fps, [r[0] for r in ROWS])), key=repr)
    assert rows(simhash.near_duplicates(docs)) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bits, bucket", [(0, 2048), (5, 2048), (2, 4), (0, 3)])
def test_simhash_links_keep_every_connection(spark, bits, bucket):
    r = random.Random(bits)
    fps = set()
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(r.randrange(1, 12)):
            fps.add(x)
            for b in r.sample(range(64), r.randrange(1, 6)):
                x ^= 1 << b
    fps = sorted(fps)
    ids = list(range(100, 100 + len(fps)))
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for x, i in zip(fps, ids)], "fp long, id long")
    got = dict(map(tuple, simhash.components(simhash.links(nodes, 4, bits, 4, bucket)).collect()))
    assert [got.get(i, i) for i in ids] == brute_components(fps, ids)


def test_token_output(docs, empty):
    out = token_output.tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    fresh = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for r in order:
        ids = [*fresh.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(out) == sorted(want, key=repr)
    assert token_output.tokens(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_token_output_as_the_library_gives_it(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    fresh, texts = Tokenizer.from_file(path), ["end <|endoftext|> start", "plain words", "<|endoftext|>", "a<|endoftext|><|endoftext|>中", "<|endoftext |>", None]
    want, start = [], 0
    for i, t in enumerate(texts):
        ids = [*fresh.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert fresh.encode(texts[0], add_special_tokens=False).ids == [437, 220, 50256, 923]
    assert rows(token_output.tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)) == want


def test_patched_blocks_and_words():
    r = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 3000):
        for top in (1, 2, 300, 50257, 1 << 32):
            x = r.integers(0, top, n).astype(np.uint32)
            assert (unpack(pack(x)) == x).all()
            x = np.where(r.random(n) < 0.05, x, x % 7).astype(np.uint32)
            assert (unpack(pack(x)) == x).all()
    fresh = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words, rr = token_output.Words(public_tokenizers.path("byte_bpe_50k.json")), random.Random(1)
    texts = ["".join(rr.choice("ab CD  \n\t'sréevmld12_.,!ß中") for _ in range(rr.randrange(40))) for _ in range(800)]
    texts += ["don't we'll 'tis\n's", "x " * 3000, "", "<|endoftext|>a"]
    for n in (1, 50):
        for k in range(0, len(texts), n):
            ids, sizes = words.encode_all(texts[k : k + n])
            want = [fresh.encode(t, add_special_tokens=False).ids for t in texts[k : k + n]]
            assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("giant, group", [(500, 4), (1 << 16, 1024)])
def test_sentencepiece(docs, empty, giant, group):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.Model(path)
    docs = docs.withColumnsRenamed({"source": "sum", "lang": "i", "found": "text_hash"})
    out = pieces.encode(docs, path, ids=True, giant=giant, chunk=64, group=group)
    got = rows(out.select("doc_id", "text", "ids", "round_trip"))
    want = sorted(((r[0], r[1], model.whole.encode(r[1] or ""), True) for r in ROWS), key=repr)
    assert got == want and pieces.encode(empty, path).count() == 0 and {"sum", "i", "text_hash"} <= set(out.columns)


def test_sentencepiece_scan():
    model = pieces.Model(public_tokenizers.path("piece_bpe_32k.model"))
    rr = random.Random(3)
    parts = ["a", "th", "he", " ", "  ", "▁", "é", "\n", "中", "😀", "the", "ing", "1", "=="]
    for k in range(600):
        t = "".join(rr.choice(parts) for _ in range(rr.randrange(60)))
        assert pieces.scan(model, t, (17, 5, 2)[k % 3]) == model.whole.encode(t)
    for t in ("x" * 3000, "=" * 999 + " a" * 500, "ab" * 700, LONG * 3):
        assert pieces.scan(model, t, 64) == model.whole.encode(t)
    r = np.random.default_rng(0)
    for n in (1, 2, 7, 16):
        m = [np.where(r.random((3, 3)) < 0.6, r.integers(-5, 1, (3, 3)), -np.inf).astype(np.float32) for _ in range(n)]
        best = m[0]
        for x in m[1:]:
            best = pieces.product(best, x)
        assert (pieces.tree(m)[-1][0] == best).all()
        if best[0].max() > -np.inf:
            found = pieces.choose(m)
            assert sum(x[i, j] for x, (i, j) in zip(m, found)) == best[0].max() and all(a[1] == b[0] for a, b in zip(found, found[1:]))


def brute_paragraphs(text):
    """Byte by byte, by the documented rule."""
    raw, out, begin = (text or "").encode(), [], 0
    for i in range(len(raw)):
        end = i + 1 == len(raw) or raw[i : i + 1] in b"\n\r.!?;" or raw[max(0, i - 2) : i + 1] in [x.encode() for x in "。！？；"]
        if i >= 7 and not end:
            end = int(gram_hashes(np.frombuffer(raw[i - 7 : i + 1], np.uint8).astype(np.uint64) + np.uint64(1), 8)[0]) % fingerprint.AVERAGE == 0
        if end:
            if p := raw[begin : i + 1].strip(b" \t\n\v\f\r"):
                out.append(p)
            begin = i + 1
    return Counter(out)


def test_fingerprints(spark, docs, empty):
    order = sorted(ROWS, key=lambda r: r[0] if r[0] is not None else -(1 << 63), reverse=True)
    out = fingerprint.fingerprints(docs, part_bytes=700).toPandas()
    assert len(out) == len(ROWS)

    def alike(a, b):
        a, b = brute_paragraphs(a), brute_paragraphs(b)
        return (a & b).total() / (a | b).total() if a or b else 1.0

    ids = [r[0] for r in order]
    for k, r in enumerate(order):
        if ids.count(r[0]) > 1 or r[0] is None or ids.count(ids[(k + 1) % len(ids)]) > 1:
            continue
        t, n = r[1] or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        g = out[out.doc_id == r[0]].iloc[0]
        assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert abs(g.near_edited - alike(t, e)) < 1e-9 and abs(g.near_next - alike(t, n)) < 1e-9
    # the repeated doc_id: either order of its two texts, each row judged once
    again = out[out.doc_id == ROWS[8][0]]
    assert sorted(again.n_chars) == sorted(len(r[1]) for r in ROWS if r[0] == ROWS[8][0])
    seen = spark.createDataFrame([(i, t) for i, t in enumerate([LONG, "a", LONG, None, "", "É" * 50])], "doc_id long, text string")
    f = fingerprint.fingerprints(seen).toPandas().sort_values("doc_id")
    assert f.fingerprint.iloc[0] == f.fingerprint.iloc[2] and f.fingerprint.iloc[3] == f.fingerprint.iloc[4] and f.fingerprint.nunique() == 4
    cells = fingerprint.sketch(np.arange(9, dtype=np.uint64), np.zeros(9, np.int64), 1, 12)
    assert fingerprint.fingerprint(1, np.zeros(9, np.int64), np.arange(9, dtype=np.uint64))[0][:96] == cells[0].astype("<i4").tobytes().hex()
    alone = fingerprint.fingerprints(seen.where("doc_id = 0")).first()
    assert alone.near_next == 1.0 and fingerprint.fingerprints(empty).count() == 0


def test_fingerprints_part_any_text(spark):
    """Two thirds of a text are kept by the edit, whatever its marks are."""
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefghij ") for _ in range(400)), "".join(chr(r.randrange(0x4E00, 0x4E80)) for _ in range(200)), " ".join(x.upper() + "!!" for x in LONG.split()[:60]), "other " * 50]
    out = fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    assert (out[out.doc_id < 3].near_edited > 0.35).all() and (out.near_next < 0.1).all()


def test_quotation(spark):
    conv = [
        (1, 0, "a", "Hello there\nSecond  line", 1), (1, 1, "b", "> hello THERE\nYes", 1), (1, 2, "a", ">> Hello there\n> Yes\nNo\n> unknown", 1), (1, 3, "c", None, 1), (1, 4, "c", "> Second line\nTwo", 1),
        (2, 0, "a", "> Hello there\nAlone", 1), (2, 0, "a", "> Hello there\nAlone", 1), (None, 5, "a", "> x", 1), (3, None, "a", "y", 1), (4, 7, "a", "", 1),
    ]
    got = {(r.conv_id, r.turn): r for r in quotation.quote_threads(spark.createDataFrame(conv, "conv_id long, turn long, role string, text string, thread int")).collect()}
    see = lambda c, t: (got[c, t].reply_to, got[c, t].thread, got[c, t].depth, got[c, t].text)
    assert see(1, 0) == (None, 0, 0, "Hello there\nSecond  line")
    assert see(1, 1) == (0, 0, 1, "Yes")
    assert see(1, 2) == (1, 0, 2, "No") and got[1, 2].max_level == 2 and got[1, 2].n_quoted == 3
    assert see(1, 3) == (None, 3, 0, "")
    assert see(1, 4) == (0, 0, 1, "Two")
    assert see(2, 0) == (None, 0, 0, "Alone")
    assert got[None, 5].thread is None and got[4, 7].thread == 7
    assert quotation.quote_threads(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_threads(rows_):
    """Reply and thread of each (conv, turn), message by message."""
    plain = lambda x: re.sub(r"\s+", " ", re.sub(r"^[ \t]*(?:>[ \t]*)+", "", x).lower()).strip(" ")
    deep = lambda x: m[0].count(">") if (m := re.match(r"[ \t]*(?:>[ \t]*)+", x)) else 0
    seen, reply = {}, {}
    for c, t, text in sorted((r for r in rows_ if None not in r[:2]), key=lambda r: r[:2]):
        for x in re.split("\r?\n", text or ""):
            if not deep(x) and plain(x):
                seen.setdefault((c, plain(x)), t)
    for c, t, text in rows_:
        votes = Counter((-deep(x), seen[c, plain(x)]) for x in re.split("\r?\n", text or "") if deep(x) and seen.get((c, plain(x)), t) < t)
        if votes:
            reply[c, t] = max((d, n, s) for (d, s), n in votes.items())[2]
    out = {}
    for c, t, _ in rows_:
        top, depth = t, 0
        while (c, top) in reply:
            top, depth = reply[c, top], depth + 1
        out[c, t] = (reply.get((c, t)), top, depth)
    return out


def test_quotation_against_brute_force(spark):
    r = random.Random(2)
    rows_ = []
    for c in range(12):
        said = []
        for t in range(r.randrange(1, 14)):
            lines = []
            for _ in range(r.randrange(4)):
                if said:
                    lines.append("> " * r.randrange(1, 4) + r.choice(said).upper())
            own = [f"line {r.randrange(30)}  of {c}" for _ in range(r.randrange(3))]
            said += own
            rows_.append((c, t, "\n".join(lines + own)))
    rows_.append((40, 0, "q " * 600_000 + "\n> " + "q " * 5))
    got = {(x.conv_id, x.turn): (x.reply_to, x.thread, x.depth) for x in quotation.quote_threads(spark.createDataFrame([(c, t, "a", x, 1) for c, t, x in rows_], "conv_id long, turn long, role string, text string, depth int")).collect()}
    want = brute_threads(rows_)
    assert got == want and sum(x[0] is not None for x in want.values()) > 25 and max(x[2] for x in want.values()) > 2


def test_pipeline(spark):
    import corpus_pipeline as c

    d = "/root/testdata/sf0.001"
    out = c.run(spark, d).toPandas()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    assert set(names) <= set(out.columns) and out.round_trip.all() and out.doc_id.is_unique and 0 < len(out) < docs.count()
    assert [n for n, _ in c.STAGES] == ["language", "near_dedup", "suffix_dedup", "decontaminate", "sentencepiece"]
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in c.STAGES:
        assert stage(spark, empty, d).count() == 0


def test_similar(spark):
    rr = random.Random(9)
    base, rows_ = [f"v{i}" for i in range(200)], []
    for _ in range(40):
        t = list(base) if rr.random() < 0.5 else [rr.choice(WORDS) for _ in range(rr.randrange(1, 90))]
        for _ in range(rr.randrange(6)):
            t[rr.randrange(len(t))] = rr.choice("xyz")
        rows_.append((len(rows_) + 5, " ".join(t)))
    chain = [f"c{i}" for i in range(60)]  # each like the next, the ends unlike
    rows_ += [(200 + k, " ".join(chain[k * 4 : k * 4 + 44])) for k in range(5)]
    rows_ += [(100, "One two"), (101, "one  TWO"), (102, "one three"), (103, ""), (104, None), (105, rows_[3][1]), (5, "of its own"), (5, "of its own")]

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [grams(t) for _, t in rows_], list(range(len(rows_)))
    for i in range(len(rows_)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    want = [(i, min(k for (k, _), y in zip(rows_, root) if y == x)) for (i, _), x in zip(rows_, root)]
    docs = spark.createDataFrame([(*r, 1) for r in rows_] + [(None, rows_[0][1], 1)], "doc_id long, text string, text_hash int").repartition(3)
    out = simhash.similar(docs, few=1000)
    assert rows(out.where("doc_id is not null").select("doc_id", "component_id")) == sorted(want, key=repr)
    for few, block in ((8, 1024), (1, 6)):  # by centres and maps where many texts are close; in many blocks
        assert rows(simhash.similar(docs, few=few, block=block).where("doc_id is not null").select("doc_id", "component_id")) == sorted(want, key=repr)
    assert out.where("doc_id is null").first().component_id is None and out.columns == ["doc_id", "text", "text_hash", "component_id", "is_first"]
    assert len({x for _, x in want}) < len(rows_) - 6 and rows(out.where("is_first").select("component_id").distinct()) == [(x,) for x in sorted({x for _, x in want}, key=lambda x: repr((x,)))]
    assert simhash.similar(docs.limit(0)).count() == 0


def test_parity_maps_and_blocks(spark):
    """Maps let every pair pass that is as alike as asked; blocks bring every two nodes of different components
    together whose sizes allow it, and few of one component."""
    rr = np.random.default_rng(4)
    base = np.unique(rr.integers(0, 2**63, 120, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rr.permutation(base)[: rr.integers(60, 120)], rr.integers(0, 2**63, rr.integers(0, 12), dtype=np.uint64)])) for _ in range(150)]
    n, component = np.array([len(s) for s in sets]), rr.integers(0, 6, 150)
    maps = np.array([_similar.parity(s) for s in sets]).view(np.uint64)
    shared = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    alike = {(i, j) for i in range(150) for j in range(150) if i < j and component[i] != component[j] and 100 * shared[i, j] >= 80 * (n[i] + n[j] - shared[i, j])}
    for side in (np.zeros(150, int), (np.arange(150) >= 70).astype(int)):
        got = set(zip(*(x.tolist() for x in _similar.may_be_alike(maps, n, component, side, 80)), strict=True))
        assert {p for p in alike if not side.any() or side[p[0]] < side[p[1]]} <= got and len(got) < 6000
    assert len(alike) > 20
    nodes = [(h, i, int(c), int(k)) for h in (1, 2) for i, (c, k) in enumerate(zip(np.where(rr.random(150) < 0.5, 0, component), n, strict=True))][:200]
    size = {h: sum(x[0] == h for x in nodes) for h in (1, 2)}
    placed = spark.createDataFrame([(h, size[h], i, c, k) for h, i, c, k in nodes], "h long, size long, node long, component long, n long")
    for block in (7, 60, 500):
        met, together = set(), defaultdict(list)
        for r in _similar.blocks(placed, 80, block).collect():
            together[r.h, r.x, r.y].append(r)
        for (h, x, y), g in together.items():
            assert len(g) == len({r.node for r in g}) and (x == y) == (not any(r.side for r in g))
            met |= {(h, *sorted((a.node, b.node))) for a in g for b in g if a.component != b.component and (x == y or a.side != b.side)}
        assert met >= {(a[0], a[1], b[1]) for a in nodes for b in nodes if a[0] == b[0] and a[1] < b[1] and a[2] != b[2] and 5 * min(a[3], b[3]) >= 4 * max(a[3], b[3])}


def test_wide_maps():
    """Wide maps of unlike widths let every pair pass that is as alike as asked, and few others; spanning pairs join
    what all would join."""
    rr = np.random.default_rng(5)
    base = rr.integers(0, 2**64, 3000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:k][rr.random(k) < keep], rr.integers(0, 2**64, rr.integers(0, 1 + k // 20), dtype=np.uint64)])) for k in (100, 250, 270, 2000, 2200, 3000) for keep in (1, 0.95, 0.9, 0.7) for _ in range(5)]
    maps, n = [_similar.wide(s) for s in sets], np.array([len(s) for s in sets])
    shared = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    likeness = shared / (n[:, None] + n[None, :] - shared)
    component = rr.integers(0, 40, len(sets))
    for side in (np.zeros(len(sets), int), (np.arange(len(sets)) % 3 == 0).astype(int)):
        i, j = _similar.may_be_alike_wide(maps, n, component, side, 80)
        got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
        apart = (component[:, None] != component[None, :]) & (np.arange(len(sets))[:, None] < np.arange(len(sets))) & (~side.any() | (side[:, None] != side))
        want = set(zip(*(x.tolist() for x in np.nonzero(apart & (likeness >= 0.8))), strict=True))
        assert want <= got and len(got) == len(i) and len(want) > 50
        assert all(apart[p] and likeness[p] > 0.75 for p in got)
    kept = _similar.spanning(i, j, component)
    joined = [simhash.roots(40, component[a], component[b]).tolist() for a, b in ((i, j), (i[kept], j[kept]))]
    assert joined[0] == joined[1] and len(kept) == 40 - len(set(joined[0])) < len(i)


def test_similar_compares_few_long_texts(spark, monkeypatch):
    """Long texts that share very common passages, but are not alike, are compared with centres only."""
    rr = random.Random(12)
    passages = [[f"p{i}w{k}" for k in range(100)] for i in range(30)]
    docs = spark.createDataFrame([(d, " ".join(w for p in rr.sample(passages, 20) for w in p)) for d in range(40)], "doc_id long, text string")
    compared = []
    alike = _similar.Sets.alike
    monkeypatch.setattr(_similar.Sets, "alike", lambda self, pairs, nodes: (compared.append(pairs.count()), alike(self, pairs, nodes))[1])
    assert simhash.similar(docs).where("component_id = doc_id").count() == 40
    assert 0 < sum(compared) <= 40 * _similar.TAKEN  # of 780


def test_components_however_they_end(spark):
    rr = np.random.default_rng(6)
    a, b = rr.integers(0, 300, (2, 220))
    edges = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a long, b long")
    root = simhash.roots(300, a, b).tolist()
    for finish in (0, 100, 1000):
        got = dict(map(tuple, simhash.components(edges, finish).collect()))
        assert [got.get(i, i) for i in range(300)] == root, finish


def test_pipeline_stages_on_odd_rows(spark):
    """Each stage on nulls, repeated rows, columns of clashing names and long texts."""
    import corpus_pipeline as c

    d = "/root/testdata/sf0.001"
    bench = spark.read.parquet(f"{d}/benchmark.parquet").where("length(text) > 100").first().text
    names = spark.read.parquet(f"{d}/documents.parquet").columns
    base = [spark.read.parquet(f"{d}/documents.parquet").where(f"lang = '{x}' and n_chars > 300").first() for x in ("en", "de")]
    rows_ = [(i, r.text, r.lang, "s", 1, 2, "k") for i, r in enumerate(base)] + [(9, base[0].text, "en", "s", 1, 2, "k"), (9, base[0].text, "en", "s", 1, 2, "k"), (None, base[1].text, None, None, None, None, None), (5, None, "en", "s", 0, 0, ""), (6, "", "en", "s", 0, 0, ""), (7, "12 34", "en", "s", 5, 0, "")]
    rows_ += [(11, LONG * 700, "en", "s", 1, 2, "k"), (12, "Words before it. " + bench + " Words after it. " + _text(400), "en", "s", 1, 2, "k")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long, kept long, text_hash string")
    for name, stage in c.STAGES:
        out = stage(spark, docs, d)
        got = out.collect()
        assert set(docs.columns) <= set(out.columns) and (name == "sentencepiece") == (len(out.columns) > len(docs.columns))
        ids = [r.doc_id for r in got]
        assert {0, 1, 11} <= set(ids) and None in ids
        if name == "language":
            assert not {5, 6, 7} & set(ids)
        if name == "near_dedup":
            assert 9 not in ids and ids.count(None) == 1 and ids.count(0) == 1 and 5 in ids and 6 not in ids
        if name == "suffix_dedup":
            assert next(r for r in got if r.doc_id == 0).text == base[0].text and 9 not in ids
        if name == "decontaminate":
            assert 12 not in ids and len(ids) == len(rows_) - 1
        if name == "sentencepiece":
            assert len(ids) == len(rows_)
    again = [(3, _text(80), "en", "s", 1), (3, _text(80), "en", "s", 1)]  # one doc_id, two texts
    assert c.drop_near_duplicates(spark, spark.createDataFrame(again, ", ".join(f"{n} {t}" for n, t in zip(names, ("long", "string", "string", "string", "long")))), d).count() == 2
