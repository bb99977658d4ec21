"""Operators against brute force on small random tables, graphs with cycles, sources, sinks and the stream."""

import io
import json
import random
import tarfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from depweave.functions import semver
from depweave.operators import bitsets, callgraph, changes, closure, cover, stats, timeline
from depweave.sources import readers, writers
from depweave.streaming import feed

VERSIONS = ["0.0.1", "0.1.0", "1.0.0-rc.1", "1.0.0", "1.1.0", "2.0.0", "2.0.1"]


def history(seed):
    r = random.Random(seed)
    versions, members = [], []
    for p in range(12):
        for i, v in enumerate(VERSIONS):
            if r.random() < 0.8:
                versions.append((p, v, datetime(2015, 1, 1) + timedelta(days=r.randrange(900))))
                for d in "abc":
                    if r.random() < 0.5:
                        members.append((p, v, d, r.choice(["", "1", "2"])))
    return versions, members


@pytest.mark.parametrize("seed", [1, 2])
def test_dependency_changes(spark, seed):
    versions, members = history(seed)
    cutoff = datetime(2016, 9, 1)
    want = []
    for p in range(12):
        own = sorted((v for v in versions if v[0] == p), key=lambda v: VERSIONS.index(v[1]))
        state, last = {}, None
        for n, (_, v, t) in enumerate(own):
            if t > cutoff:
                continue
            now = {d: x for q, w, d, x in members if (q, w) == (p, v)}
            for d, x in now.items():
                if state.get(d, "") == "":
                    want.append((p, d, x, "", "INITIAL" if n == 0 else "ADDED", v))
                elif state[d] != x:
                    want.append((p, d, x, state[d], "UPDATED", v))
            want += [(p, d, "", x, "REMOVED", v) for d, x in state.items() if x != "" and d not in now]
            state = now
    got = changes.dependency_changes(spark.createDataFrame(versions, "package int, version string, release_time timestamp"), spark.createDataFrame(members, "package int, version string, item string, value string"), "2016-09-01")
    assert sorted(tuple(x)[:6] for x in got.collect()) == sorted(want)


def test_maintainers_by_time(spark):
    t = datetime(2015, 1, 1)
    versions = [("p", "1.0.0", t), ("p", "0.9.0", t + timedelta(1)), ("p", "1.1.0", t + timedelta(2))]
    people = [("p", "1.0.0", 0, "ann"), ("p", "1.0.0", 1, "bo"), ("p", "0.9.0", 0, "ann"), ("p", "1.1.0", 0, "ann"), ("p", "1.1.0", 1, "cy")]
    got = changes.maintainer_changes_by_time(spark.createDataFrame(versions, "package string, version string, release_time timestamp"), spark.createDataFrame(people, "package string, version string, pos int, item string"))
    assert sorted((r.item, r.change, r.version) for r in got.collect()) == [("ann", "INITIAL", "1.0.0"), ("bo", "ADDED", "1.0.0"), ("bo", "REMOVED", "0.9.0"), ("cy", "ADDED", "1.1.0")]


def test_closure_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("e", "e")], "src string, dst string")
    cost = {}
    for r in closure.closure(edges).collect():
        cost.setdefault(r.src, set()).add((r.dst, r.layer))
    assert {d for d, _ in cost["d"]} == {"a", "b", "c"} and cost["a"] == {("b", 1), ("c", 2), ("a", 3)} and cost["e"] == {("e", 1)}
    assert {(r.src, r.dst) for r in closure.reach(edges, spark.createDataFrame([("d",), ("a",)], "src string")).collect()} == {("a", x) for x in "abcd"}


def test_greedy_cover_and_prefix(spark):
    r = random.Random(3)
    pairs = {(f"n{r.randrange(8)}", r.randrange(40)) for _ in range(120)}
    df = spark.createDataFrame(sorted(pairs), "name string, element int")
    got = [tuple(x) for x in cover.greedy_cover(df, limit=4).orderBy("rank").collect()]
    left, want, total = set(pairs), [], 0
    for k in range(4):
        names = sorted({n for n, _ in left}, key=lambda n: (-len({e for m, e in left if m == n}), n))
        if not names:
            break
        taken = {e for n, e in left if n == names[0]}
        total += len(taken)
        want.append((k + 1, names[0], len(taken), total))
        left = {(n, e) for n, e in left if e not in taken}
    assert got == want
    ranking = spark.createDataFrame([(x[1], x[0]) for x in got], "name string, rank int")
    assert [x.total for x in cover.cover_along(df, ranking).orderBy("rank").collect()] == [x[3] for x in want]


def test_latest_version_rule(spark):
    t = datetime(2015, 1, 1)
    rows = [("p", "1.0.0-rc.1", t), ("p", "0.5.0", t + timedelta(1)), ("p", "2.0.0", t + timedelta(2)), ("p", "1.5.0", t + timedelta(3)), ("p", "3.0.0-a", t + timedelta(4))]
    df = spark.createDataFrame(rows, "package string, version string, release_time timestamp")
    seen = [timeline.latest_version(df, str(t + timedelta(d))).first().version for d in range(6)]
    assert seen == ["unreleased", "1.0.0-rc.1", "1.0.0-rc.1", "2.0.0", "2.0.0", "2.0.0"]
    assert timeline.calendar(spark).count() == 90


def test_call_graph(spark):
    call = lambda **k: {"fromModule": "m", "fromFunction": "f", "receiver": "", "className": "", "modules": [], "toFunction": "t", "args": [], "isLocal": False} | k
    result = [call(modules=["lib"]), call(modules=["./u"], isLocal=True), call(modules=["lib"], className="C"), call(isLocal=True), call(className="D"), call(), call(toFunction=""), call(modules=["lib/sub.js"])]
    raw = spark.createDataFrame([("p", json.dumps(result)), ("q", json.dumps("failed"))], "package string, result string")
    calls = callgraph.parsed(raw, callgraph.CALLS)
    assert callgraph.failed(raw).count() == 1
    packages = spark.createDataFrame([("lib", "./main.js"), ("p", "x.js")], "name string, main string")
    exports = spark.createDataFrame([("lib|main|t", "lib|main|T")], "local string, exported string")
    g = callgraph.sound(callgraph.build(calls, packages, exports))
    assert {r.dst for r in g["call"].collect()} == {"lib|main|T", "p|./u|t", "lib|main|C|t", "p|m|t", "D|t", "t", "lib|sub|t"}
    kinds = {r.id: r.type for r in g["function"].collect()}
    assert kinds["lib|main|T"] == "actualExport" and kinds["p|./u|t"] == "local" and kinds["D|t"] == "class" and kinds["p|m|t"] == "unknown" and kinds["t"] == "export"
    assert [tuple(r) for r in callgraph.api_size(g, packages).where("package = 'lib'").select("exported_functions", "size").collect()] == [(["lib|main|T"], 1)]
    assert callgraph.export_usage(g, packages).first().share == 1.0
    merged = callgraph.merged(g, spark.createDataFrame([("p|m|t", "p|m|new")], "local string, exported string"))
    assert "p|m|new" in {r.dst for r in merged["call"].collect()}


def test_vulnerable_dates(spark):
    t = datetime(2016, 1, 1)
    versions = spark.createDataFrame([("p", v, t + timedelta(i)) for i, v in enumerate(["1.0.0", "1.1.0", "1.2.0"])], "package string, version string, release_time timestamp")
    holes = spark.createDataFrame([(1, "p", ">=1.1.0", "<1.1.0"), (2, "x", ">=1.0.0", "<1.0.0")], "id int, package string, patched_versions string, vulnerable_versions string")
    got = {r.id: (r.vulnerable_date, r.patched_date) for r in stats.vulnerable_dates(holes, versions).collect()}
    assert got[1] == (t, t + timedelta(1)) and got[2] == (datetime(2018, 3, 31), datetime(2018, 4, 2))


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "names").write_text("a\n\nb\n")
    (tmp_path / "names.json").write_text('["x", "y"]')
    (tmp_path / "list").write_text("lodash,1.0.0\n@a/b,2.0.0\n")
    (tmp_path / "bad").write_text("lodash\n")
    (tmp_path / "dump").write_text('{"rows": [\n{"id": "a", "key": "a", "value": {"name": "a"}},\n{"id": "b", "value": {bad\n]}\n')
    (tmp_path / "res").write_text('{"Name": "p", "Version": "1", "Result": [1]}\n{"Name": "q", "Version": "1", "Result": "error"}\n')
    assert [r.name for r in readers.name_list(spark, str(tmp_path / "names")).collect()] == ["a", "b"]
    assert [r.name for r in readers.name_list(spark, str(tmp_path / "names.json"), True).collect()] == ["x", "y"]
    assert readers.package_list(spark, str(tmp_path / "list")).count() == 2
    with pytest.raises(Exception):
        readers.package_list(spark, str(tmp_path / "bad")).collect()
    dump = readers.registry_dump(spark, str(tmp_path / "dump")).collect()
    assert [(r.id, r.reject is None) for r in dump] == [("a", True), (None, False)]
    assert [r.result for r in readers.results(spark, str(tmp_path / "res")).collect()] == ["[1]", "error"]
    blob = io.BytesIO()
    with tarfile.open(fileobj=blob, mode="w:gz") as tar:
        for name, body in (("package/i.js", b"x"), ("package/big", b"y" * 50)):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    tars = spark.createDataFrame([("p", blob.getvalue()), ("q", b"junk")], "package string, content binary")
    got = sorted((r.package, r.path or "", r.content is None, r.error is None) for r in readers.unpacked(tars, 10).collect())
    assert got == [("p", "package/big", True, True), ("p", "package/i.js", False, True), ("q", "", True, False)]
    graph = {"package": spark.createDataFrame([("a",), ("a",)], "id string"), "call": spark.createDataFrame([("f", "g")], "src string, dst string")}
    writers.write_graph(graph, str(tmp_path / "graph"))
    assert spark.read.csv(str(tmp_path / "graph/package")).count() == 1 and spark.read.csv(str(tmp_path / "graph/call-header")).first()[0] == ":START_ID"
    rows = spark.createDataFrame([("k", 2), ("k", 1), ("l", 3)], "key string, n int")
    assert sorted(map(tuple, writers.first_by(rows, "key", "n").collect())) == [("k", 1), ("l", 3)]
    assert writers.missing(rows, rows.where("key = 'k'")).count() == 1


def test_change_feed(spark, tmp_path):
    doc = lambda s, v: json.dumps({"seq": s, "id": "p", "doc": {"dist-tags": {"latest": v}, "versions": {v: {"dist": {"shasum": "h", "tarball": f"t/{v}"}}}}})
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join([doc(1, "1.0.0"), doc(2, "1.1.0"), "broken", doc(3, "1.1.0"), doc(4, "2.0.0")]))
    stream = feed.feed(spark, str(tmp_path / "in"), since=1)
    out = []
    known = spark.createDataFrame([("t/2.0.0",)], "tarball string")
    q = feed.store(feed.once(feed.tarballs(stream)), lambda: known, lambda df, _: out.extend(r.tarball for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert out == ["t/1.1.0"]
    bad = feed.rejects(stream).writeStream.format("memory").queryName("bad").trigger(availableNow=True).start()
    bad.awaitTermination(60)
    assert [r.value for r in spark.table("bad").collect()] == ["broken"]


def test_use_and_saving(spark):
    usage = spark.createDataFrame([("p", "a", 0.05), ("p", "b", 0.0), ("p", "c", 0.5), ("q", "a", 0.0)], "package string, dst string, share double")
    cost = spark.createDataFrame([("a", 4)], "src string, count long")
    assert dict(map(tuple, stats.saving(usage, cost).collect())) == {"p": 5, "q": 0}
    assert dict(map(tuple, stats.positive_mean(usage, "package", "share").collect())) == {"p": 0.275}
    assert stats.doane_histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x").collect() == [(0, 2)]
    assert sum(r.n for r in stats.doane_histogram(spark.createDataFrame([(1.0,), (2.0,)], "x double"), "x").collect()) == 2
    d = spark.createDataFrame([("k", 1, 10.0), ("k", 2, 11.0), ("k", 3, -10.0), ("k", 4, -11.0)], "key string, t int, diff double")
    assert [tuple(r) for r in stats.boosts(d, 10.0).collect()] == [("k", 2, 4)]


def test_ranges_that_are_known(spark):
    v = ["1.2.3", "1.2.0-beta.1", "1.2.0", "2.0.0-rc.1", "2.0.0", "1.4.2-beta.3", "1.4.2-beta.2", "1.5.0-beta.1", "0.1.2", "0.2.0", "nope"]
    rows = spark.createDataFrame([(x,) for x in v], "v string")
    for text in (">=1.2.0 <2.0.0", "^1.4.2-beta.3", "~0.1.2", "1.x || 2.0.0", "1.2.0 - 1.4.2", "*", "!=1.2.0"):
        for node in (False, True):
            got = [r[0] for r in rows.select(semver.in_range(F.col("v"), text, node)).collect()]
            assert got == [None if x == "nope" else semver.satisfies_one(x, text, node) for x in v], (text, node)


def test_unreleased_months(spark):
    rows = spark.createDataFrame([("p", "1.0.0", "2011-01-15")], "package string, version string, release_time string").withColumn("release_time", F.to_timestamp("release_time"))
    got = timeline.timeline(rows, spark.createDataFrame([("p", "1.0.0", "d")], "package string, version string, item string"), "2010-12-01", "2011-02-01").orderBy("month").collect()
    assert [(r.version, list(r["items"])) for r in got] == [("unreleased", []), ("unreleased", []), ("1.0.0", ["d"])]



def pairs_of(edges):
    """All (src, dst) that edges reach, by brute force."""
    found = set(edges)
    while more := {(a, d) for a, b in found for c, d in edges if b == c} - found:
        found |= more
    return found


def test_owners_by_bits(spark):
    """Loops, owners without packages in the graph and a null owner, in two months, with few words a block."""
    r = random.Random(5)
    edges = [(m, a, b) for m in (1, 2) for a, b in {(f"p{r.randrange(30)}", f"p{r.randrange(30)}") for _ in range(25 * m)}]
    owned = sorted({(f"o{r.randrange(90)}", f"p{r.randrange(34)}") for _ in range(200)}) + [(None, "p1"), ("none", "x")]
    e, o = spark.createDataFrame(edges, "month int, src string, dst string"), spark.createDataFrame(owned, "owner string, package string")
    cost, reach = {}, {}
    for m in (1, 2):
        pairs = pairs_of([(a, b) for k, a, b in edges if k == m])
        for name in {p for _, p in owned} | {a for a, _ in pairs}:
            if n := len({x for x, p in owned if x and (p == name or (name, p) in pairs)}):
                cost[m, name] = n
        for x in {x for x, _ in owned}:
            if n := len({a for a, b in pairs if (x, b) in owned}):
                reach[m, x] = n
    assert {(x.month, x.src): x["count"] for x in closure.owner_cost_of(e, o, ("month",)).collect()} == cost
    assert {(1, x.owner): x["count"] for x in closure.owner_reach_of(e.where("month = 1").drop("month"), o).collect()} == {k: v for k, v in reach.items() if k[0] == 1}


def test_walks_by_bits(spark, monkeypatch):
    """Loops, several blocks and halved ones: sizes, windows, needs and pairs with first steps as by brute force."""
    monkeypatch.setattr(bitsets, "SOURCES", 2)
    monkeypatch.setattr(bitsets, "WORDS", 300)
    r = random.Random(6)
    edges = sorted({(a, r.randrange(a)) for a in range(1, 300) for _ in range(2)} | {(7, 90), (120, 121), (3, 3)})
    dev = sorted({(r.randrange(320), r.randrange(300)) for _ in range(60)})
    pairs, names = pairs_of(edges), list(range(5, 310))
    e, d = spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame(dev, "src int, dst int")
    count = lambda i: {x: sum(p[i] == x for p in pairs) for x in {p[i] for p in pairs}}
    assert {x.src: x["count"] for x in closure.cost_sizes(e).collect()} == count(0)
    reach = count(1)
    assert {x.src: x["count"] for x in bitsets.reach_sizes(bitsets.graphs(e)).collect()} == reach
    ranked = sorted(reach, key=lambda x: (-reach[x], x))
    want = {(2000, k + 1): len({a for a, b in pairs if b in ranked[k : k + 10]}) for k in range(len(ranked) - 9)}
    assert {(x.year, x["rank"]): x["count"] for x in closure.windowed_union_of(e.select(F.lit(2000).alias("year"), "src", "dst")).collect()} == want
    rank = {x: k + 1 for k, x in enumerate(ranked[:40])}
    sets = {x: {b for a, b in pairs if a == x} | ({x} & set(names)) for x in {a for a, _ in pairs} | set(names)}
    needs = [max(rank.get(x, 999) for x in one) for one in sets.values()]
    every = spark.createDataFrame([(x,) for x in names], "src int")
    assert {x.k: x.w for x in bitsets.needs(bitsets.graphs(e, nodes=every), list(rank.items()), 999).collect()} == {k: needs.count(k) for k in needs}
    with_dev = pairs | set(dev) | {(u, b) for u, x in dev for a, b in pairs if a == x}
    got = [tuple(x) for x in closure.reach_with_dev_of(e, d, every).collect()]
    assert len(got) == len(set(got)) and set(got) == {(b, a) for a, b in with_dev if b in names}


def test_greedy_by_bits(spark):
    """The same picks as over pairs, with a loop and with a first name."""
    r = random.Random(8)
    edges = sorted({(a, r.randrange(a)) for a in range(1, 300) if r.random() < 0.6} | {(9, 40), (60, 61)})
    owned = sorted({(r.randrange(30), r.randrange(300)) for _ in range(80)})
    e, o = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(owned, "owner long, package long")
    pairs = pairs_of(edges)
    sets = spark.createDataFrame(sorted({(x, a) for x, p in owned for a, b in pairs if b == p}), "name long, element long")
    for first in (None, owned[-1][0]):
        want = [tuple(x) for x in cover.greedy_cover(sets, first, 6).orderBy("rank").collect()]
        assert len(want) > 2 and [tuple(x) for x in cover.greedy_cover_of(bitsets.graphs(e), o, first, 6).orderBy("rank").collect()] == want
