"""Plain SQL of the same results, for an engine that knows none of the operators."""

from __future__ import annotations

from .bindings import VERSION, common
from .corpus import CUTOFF, GRID, STATEMENTS

N = r"^(\d+)\.(\d+)\.(\d+)(?:-beta\.(\d+))?$"
#: Versions with their numbers and order; kept ones up to the cutoff, numbered.
KEPT = [
    f"parsed AS (SELECT *, CAST(regexp_extract(version, '{N}', 1) AS INT) AS ma, CAST(regexp_extract(version, '{N}', 2) AS INT) AS mi, CAST(regexp_extract(version, '{N}', 3) AS INT) AS pa, COALESCE(TRY_CAST(nullif(regexp_extract(version, '{N}', 4), '') AS INT), 1000000) AS pre FROM versions)",
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY ma, mi, pa, pre, version) - 1 AS nth FROM parsed)",
    f"kept AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY nth) AS o FROM numbered WHERE release_time <= TIMESTAMP '{CUTOFF}')",
]
DIFF = "CASE WHEN (p.ma, p.mi, p.pa, p.pre) > (k.ma, k.mi, k.pa, k.pre) THEN 'downgrade' WHEN p.pre <> k.pre AND k.pre < 1000000 THEN 'prerelease' WHEN p.ma <> k.ma OR (p.pre < 1000000 AND k.pre = 1000000 AND k.mi = 0 AND k.pa = 0) THEN 'major' WHEN p.mi <> k.mi OR (p.pre < 1000000 AND k.pre = 1000000 AND k.pa = 0) THEN 'minor' WHEN p.pa <> k.pa OR (p.pre < 1000000 AND k.pre = 1000000) THEN 'patch' ELSE 'equal' END"
MADE = [
    *KEPT,
    f"version_changes AS (SELECT k.package, k.version, COALESCE(p.version, '') AS version_prev, CASE WHEN p.version IS NULL THEN 'publish' ELSE {DIFF} END AS version_diff, COALESCE(epoch_us(k.release_time) - epoch_us(p.release_time), 0) / 3.6e9 AS time_diff, k.release_time, k.o, k.ma, k.mi, k.pa, k.pre FROM kept k LEFT JOIN kept p ON p.package = k.package AND p.o = k.o - 1)",
    "placed AS (SELECT *, CASE WHEN version_diff <> 'publish' THEN version_diff WHEN ma > 0 THEN 'major' WHEN mi > 0 THEN 'minor' WHEN pa > 0 THEN 'patch' END AS e, max(CASE WHEN version_diff = 'major' THEN o END) OVER (PARTITION BY package) AS mo, max(CASE WHEN version_diff = 'minor' THEN o END) OVER (PARTITION BY package) AS no FROM version_changes)",
    "version_counts AS (SELECT package, count(*) FILTER (e = 'major') AS major, count(*) FILTER (e = 'minor') AS minor, count(*) FILTER (e = 'patch') AS patch, COALESCE(count(*) FILTER (e = 'minor' AND o < mo) * 1.0::DOUBLE / nullif(count(*) FILTER (e = 'major'), 0), 0) AS avg_minor_between_major, COALESCE(count(*) FILTER (e = 'patch' AND o < mo) * 1.0::DOUBLE / nullif(count(*) FILTER (e = 'major'), 0), 0) AS avg_patch_between_major, COALESCE(count(*) FILTER (e = 'patch' AND o < no) * 1.0::DOUBLE / nullif(count(*) FILTER (e = 'minor'), 0), 0) AS avg_patch_between_minor FROM placed GROUP BY package)",
    "held AS (SELECT m.package, m.item, m.value, k.o, k.version, k.release_time, k.nth FROM members m JOIN kept k ON m.package = k.package AND m.version = k.version)",
    # by self joins on neighbouring versions, where the operator uses windows
    "entered AS (SELECT h.package, h.item, h.value, COALESCE(p.value, '') AS value_prev, CASE WHEN p.item IS NULL THEN CASE WHEN h.nth = 0 THEN 'INITIAL' ELSE 'ADDED' END WHEN p.value <> h.value THEN 'UPDATED' END AS change, h.version, h.release_time FROM held h LEFT JOIN held p ON p.package = h.package AND p.item = h.item AND p.o = h.o - 1)",
    "removed AS (SELECT p.package, p.item, '' AS value, p.value AS value_prev, 'REMOVED' AS change, k.version, k.release_time FROM held p JOIN kept k ON k.package = p.package AND k.o = p.o + 1 LEFT JOIN held h ON h.package = p.package AND h.item = p.item AND h.o = p.o + 1 WHERE h.item IS NULL)",
    "dependency_changes AS (SELECT * FROM entered WHERE change IS NOT NULL UNION ALL SELECT * FROM removed)",
    "license_changes AS (SELECT k.package, k.version, COALESCE(p.license, '') AS license_from, k.license AS license_to, COALESCE(p.license, '') || '->' || k.license AS change, k.release_time FROM kept k LEFT JOIN kept p ON p.package = k.package AND p.o = k.o - 1 WHERE k.nth > 0 AND COALESCE(p.license, '') <> k.license)",
    f"months AS (SELECT CAST(unnest(generate_series(DATE '{GRID[0]}', DATE '{GRID[1]}', INTERVAL 1 MONTH)) AS DATE) AS month)",
    "maintainer_counts AS (SELECT n.name, m.month, CAST(COALESCE(sum(CASE WHEN c.change = 'REMOVED' THEN -1 WHEN c.change = 'ADDED' THEN 1 END), 0) AS BIGINT) AS count FROM (SELECT DISTINCT name FROM maintainer_changes) n CROSS JOIN months m LEFT JOIN maintainer_changes c ON c.name = n.name AND date_trunc('month', c.release_time) <= m.month GROUP BY 1, 2)",
    "maintained AS (SELECT DISTINCT m.month, c.name, c.package FROM months m JOIN maintainer_changes c ON c.change = 'ADDED' AND date_trunc('month', c.release_time) <= m.month LEFT JOIN maintainer_changes r ON r.name = c.name AND r.package = c.package AND r.change = 'REMOVED' WHERE r.name IS NULL OR date_trunc('month', r.release_time) > m.month)",
    "first_release AS (SELECT package, min(release_time) AS t FROM versions GROUP BY 1)",
    "candidate AS (SELECT p.* FROM parsed p WHERE p.pre = 1000000 OR p.version = (SELECT q.version FROM parsed q WHERE q.package = p.package ORDER BY q.release_time, q.ma, q.mi, q.pa, q.pre LIMIT 1))",
    "snapshots AS (SELECT package, month, COALESCE(version, 'unreleased') AS version FROM (SELECT k.package, m.month, c.version, row_number() OVER (PARTITION BY k.package, m.month ORDER BY c.ma DESC NULLS LAST, c.mi DESC, c.pa DESC, c.pre DESC, c.release_time DESC) AS r FROM (SELECT DISTINCT package FROM versions) k CROSS JOIN months m LEFT JOIN candidate c ON c.package = k.package AND c.release_time < m.month) WHERE r = 1)",
    "closed AS (SELECT src, dst FROM edges UNION SELECT c.src, e.dst FROM closed c JOIN edges e ON e.src = c.dst)",
    "dependents AS (SELECT dst AS src, src AS dst FROM closed)",
    "costs AS (SELECT src, count(*) AS count FROM closed GROUP BY 1)",
    "reaches AS (SELECT src, count(*) AS count FROM dependents GROUP BY 1)",
    "walk AS (SELECT src, dst, 1 AS layer FROM edges UNION SELECT w.src, e.dst, w.layer + 1 FROM walk w JOIN edges e ON e.src = w.dst WHERE w.layer < 40)",
    "owner_reach AS (SELECT o.owner, count(DISTINCT d.dst) AS count FROM owned o JOIN dependents d ON d.src = o.package GROUP BY 1)",
    "ranking AS (SELECT owner AS name, row_number() OVER (ORDER BY count DESC, owner) AS rank FROM owner_reach)",
    "package_ranking AS (SELECT src AS name, row_number() OVER (ORDER BY count DESC, src) AS rank FROM reaches)",
    "seeded AS (SELECT src AS set, dst AS element FROM closed UNION SELECT name, name FROM packages)",
    "active AS (SELECT name AS key, month, count FROM (SELECT *, max(CASE WHEN count > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY month) AS on_ FROM maintainer_counts) WHERE on_ = 1)",
    "diffs AS (SELECT key, month, CAST(count - COALESCE(lag(count) OVER (PARTITION BY key ORDER BY month), 0) AS DOUBLE) AS diff FROM active)",
    "cubes AS (SELECT s.month, s.package, m.item FROM snapshots s JOIN members m ON m.package = s.package AND m.version = s.version)",
    "called AS (SELECT *, concat(package, '|', fm, '|', role) AS src, CASE WHEN m = 2 THEN 1 WHEN m = 1 AND c THEN 2 WHEN m = 1 THEN 3 WHEN l THEN 4 WHEN c THEN 5 ELSE 6 END AS b, CASE WHEN m = 1 AND c THEN concat('lib', k, '|main|C|', f) WHEN m = 1 THEN concat('lib', k, '|main|', f) WHEN m = 2 THEN concat(package, '|./util|', f) WHEN l THEN concat(package, '|', fm, '|', f) WHEN c THEN concat('C|', f) ELSE f END AS dst FROM (SELECT concat('p', conv_id) AS package, conv_id % 7 AS k, role, turn % 3 AS m, turn % 5 = 4 AS c, turn % 4 = 0 AS l, concat('m', turn % 2) AS fm, substr(regexp_extract(text, '([A-Za-z]+)', 1), 1, 2) AS f FROM conversations) WHERE f <> '')",
    "nodes AS (SELECT id, name, type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name, type) AS r FROM (SELECT src AS id, role AS name, 'unknown' AS type FROM called UNION ALL SELECT dst, f, CASE WHEN b = 3 AND f IN ('Th', 'On') THEN 'actualExport' WHEN b IN (1, 3) AND l THEN 'local' WHEN b IN (1, 3) THEN 'export' WHEN b IN (2, 5) THEN 'class' WHEN b = 4 THEN 'unknown' ELSE 'export' END FROM called)) WHERE r = 1)",
    "calls_of AS (SELECT n.id, count(DISTINCT e.src) AS calls FROM nodes n LEFT JOIN called e ON e.dst = n.id GROUP BY 1)",
    "actual AS (SELECT split_part(id, '|', 1) AS package, id FROM nodes WHERE type = 'actualExport')",
    "apis AS (SELECT 'lib' || i AS package, id FROM (SELECT unnest(range(7)) AS i) x LEFT JOIN (SELECT package, id FROM actual UNION ALL SELECT split_part(id, '|', 1), id FROM calls_of WHERE calls > 1 AND regexp_matches(id, '^lib[0-9][|]main') AND split_part(id, '|', 1) NOT IN (SELECT package FROM actual)) y ON y.package = 'lib' || i)",
    "open_vulns AS (SELECT l_partkey AS package, l_partkey AS id, min(l_shipdate) AS vulnerable_date, max(l_shipdate) AS patched_date FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)",
]


def sql(body: str) -> str:
    """body over all bound and made views; those that it doesn't reach are left out."""
    import re

    named = {x.split(" AS ")[0]: x for x in MADE}
    need, todo = set(), re.findall(r"\w+", body)
    while todo:
        w = todo.pop()
        if w in named and w not in need:
            need.add(w)
            todo += re.findall(r"\w+", named[w])
    return common(*[x for k, x in named.items() if k in need]) + body


_TOP = "(SELECT package FROM (SELECT package, row_number() OVER (ORDER BY overall DESC, package) AS r FROM popularity) WHERE r <= {})"
#: The study's statements once more, written in other ways.
APART = {
    "q4_added_removed": "SELECT item, count(*) FILTER (change = 'ADDED') AS added, count(*) FILTER (change = 'REMOVED') AS removed FROM dependency_changes GROUP BY item HAVING bool_or(change = 'ADDED') AND bool_or(change = 'REMOVED') ORDER BY 2 DESC, 3 DESC, 1 LIMIT 25",
    "q7_packages_per_maintainer": "SELECT l_suppkey AS name, count(DISTINCT o_custkey) AS n FROM lineitem, orders WHERE o_orderkey = l_orderkey GROUP BY 1",
    "q11_with_removals": f"SELECT count(DISTINCT package) AS n, count(DISTINCT package) FILTER (package IN {_TOP.format(100)}) AS in_top FROM maintainer_changes WHERE change = 'REMOVED'",
    "q12_average_ever_top": f"SELECT round(count(*)::DOUBLE / count(DISTINCT package), 6) AS average FROM (SELECT DISTINCT package, name FROM maintainer_changes WHERE change <> 'REMOVED' AND package IN {_TOP.format(1000)})",
    "q14_pearson": "SELECT round(corr(overall / 1000000, n), 4) AS r FROM (SELECT DISTINCT package, count(*) OVER (PARTITION BY package) AS n FROM (SELECT DISTINCT o_custkey AS package, l_suppkey FROM orders, lineitem WHERE l_orderkey = o_orderkey)) JOIN popularity USING (package)",
    "q20_version_predicates": "SELECT count(DISTINCT package) FILTER (patch >= 1) AS patched, count(*) AS counted, (SELECT count(*) FROM version_changes WHERE o = 1) AS published, count(*) FILTER (major >= 1 AND minor + patch >= 1) AS grown FROM version_counts",
    "q22_dependents_in_top": f"SELECT DISTINCT o_custkey AS name, {VERSION} AS version FROM orders, lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = 5 AND o_custkey IN {_TOP.format(100)} AND o_custkey IN (SELECT p_partkey FROM part)",
    "q24_removed_while_added": "SELECT DISTINCT item FROM dependency_changes r WHERE change = 'REMOVED' AND NOT contains(version, '-') AND EXISTS (SELECT 1 FROM dependency_changes a WHERE a.package = r.package AND a.version = r.version AND a.change = 'ADDED')",
    "q25_added_then_removed": "SELECT DISTINCT item FROM dependency_changes r WHERE change = 'REMOVED' AND NOT contains(version, '-') AND release_time > (SELECT min(a.release_time) FROM dependency_changes a WHERE a.package = r.package AND a.item = r.item AND a.change = 'ADDED')",
    "q26c_timed_versions": "SELECT package, version, version_diff, release_time FROM version_changes WHERE epoch_us(release_time) <> 1000000",
    "q29b_dependency_names": "SELECT DISTINCT l_suppkey AS item FROM lineitem",
    "q32b_names_like": "SELECT DISTINCT l_suppkey::VARCHAR AS name FROM lineitem WHERE starts_with(l_suppkey::VARCHAR, '1') ORDER BY 1 LIMIT 20",
    "q35c_dependents_of_one": "SELECT o_custkey AS package FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 5) GROUP BY 1",
}
CORPUS = {k: sql(APART.get(k, v)) for k, v in STATEMENTS.items()}
