"""The study's ad-hoc SQL (Q1-Q38) over bound tables. Other texts for the other engine are in oracle.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depweave.operators import changes, timeline

from . import bindings

#: Packages of greatest popularity.
TOP = "(SELECT package FROM popularity ORDER BY overall DESC, package LIMIT {})"

STATEMENTS = {
    "q1_counts": "SELECT (SELECT count(*) FROM members) AS dependencies, (SELECT count(*) FROM packages) AS packages, (SELECT count(*) FROM dependency_changes WHERE change = 'INITIAL') AS initial",
    "q2_distinct_packages": "SELECT (SELECT count(DISTINCT package) FROM dependency_changes WHERE change = 'REMOVED') AS removing, (SELECT count(DISTINCT package) FROM version_changes) AS changing",
    "q3_earliest_change": "SELECT min(release_time) AS first_change FROM dependency_changes",
    "q4_added_removed": "SELECT a.item, a.added, r.removed FROM (SELECT item, count(*) AS added FROM dependency_changes WHERE change = 'ADDED' GROUP BY item) a JOIN (SELECT item, count(*) AS removed FROM dependency_changes WHERE change = 'REMOVED' GROUP BY item) r ON a.item = r.item ORDER BY a.added DESC, r.removed DESC, a.item LIMIT 25",
    "q5_removed": "SELECT item, count(*) AS removed FROM dependency_changes WHERE change = 'REMOVED' GROUP BY item",
    "q6_one_dependency_in_top": f"SELECT d.package, d.change, d.version FROM dependency_changes d JOIN {TOP.format(50)} p ON d.package = p.package WHERE d.item = 3",
    "q7_packages_per_maintainer": "SELECT name, count(package) AS n FROM maintainers GROUP BY name",
    "q8_year_diff": "SELECT a.name, b.n - a.n AS diff FROM (SELECT name, count AS n FROM maintainer_counts WHERE month = DATE '1998-01-01') a JOIN (SELECT name, count AS n FROM maintainer_counts WHERE month = DATE '1999-01-01') b ON a.name = b.name",
    "q9_average_count": "SELECT month, round(avg(CAST(count AS DOUBLE)), 6) AS average FROM maintainer_counts GROUP BY month",
    "q10_average_added": "SELECT round(avg(CAST(n AS DOUBLE)), 6) AS average FROM (SELECT package, count(DISTINCT name) AS n FROM maintainer_changes WHERE change = 'ADDED' GROUP BY package) x",
    "q11_with_removals": f"SELECT count(*) AS n, count(p.package) AS in_top FROM (SELECT package FROM maintainer_changes WHERE change = 'REMOVED' GROUP BY package) x LEFT JOIN {TOP.format(100)} p ON x.package = p.package",
    "q12_average_ever_top": f"SELECT round(avg(CAST(n AS DOUBLE)), 6) AS average FROM (SELECT d.package, count(DISTINCT d.name) AS n FROM maintainer_changes d JOIN {TOP.format(1000)} p ON d.package = p.package WHERE d.change IN ('INITIAL', 'ADDED') GROUP BY d.package) x",
    "q13_top_maintainers": "SELECT name, count FROM maintainer_counts WHERE month = DATE '2000-04-01' ORDER BY count DESC, name LIMIT 20",
    "q14_pearson": "SELECT round((avg(x * y) - avg(x) * avg(y)) / (sqrt(avg(x * x) - avg(x) * avg(x)) * sqrt(avg(y * y) - avg(y) * avg(y))), 4) AS r FROM (SELECT p.overall / 1000000 AS x, CAST(m.n AS DOUBLE) AS y FROM popularity p JOIN (SELECT package, count(DISTINCT name) AS n FROM maintainers GROUP BY package) m ON p.package = m.package) z",
    "q15_release_interval": f"SELECT round(avg(m), 4) AS hours FROM (SELECT v.package, avg(v.time_diff) AS m FROM version_changes v JOIN {TOP.format(100)} p ON v.package = p.package WHERE v.time_diff > 0 GROUP BY v.package) x",
    "q16_class_in_top": f"SELECT count(*) AS n FROM version_changes v JOIN {TOP.format(100)} p ON v.package = p.package WHERE v.version_diff = 'minor'",
    "q17_minor_per_package": f"SELECT round(avg(CAST(n AS DOUBLE)), 6) AS average FROM (SELECT v.package, count(*) AS n FROM version_changes v JOIN {TOP.format(50)} p ON v.package = p.package WHERE v.version_diff = 'minor' GROUP BY v.package) x",
    "q18_patch_between_minor": f"SELECT round(avg(c.avg_patch_between_minor), 6) AS average FROM version_counts c JOIN {TOP.format(100)} p ON c.package = p.package",
    "q19_one_package": "SELECT version, version_prev, version_diff FROM version_changes WHERE package = 7",
    "q20_version_predicates": "SELECT (SELECT count(DISTINCT package) FROM version_counts WHERE patch > 0) AS patched, (SELECT count(DISTINCT package) FROM version_counts ) AS counted, (SELECT count(DISTINCT package) FROM version_changes WHERE version_diff = 'publish') AS published, (SELECT count(DISTINCT package) FROM version_counts WHERE major > 0 AND (minor > 0 OR patch > 0)) AS grown",
    "q21_prerelease_rows": "SELECT package, version, version_diff FROM version_changes WHERE (version_diff = 'publish' AND version LIKE '%-%') OR version_diff = 'prerelease'",
    "q22_dependents_in_top": f"SELECT m.package AS name, m.version FROM members m JOIN packages k ON k.name = m.package JOIN {TOP.format(100)} p ON m.package = p.package WHERE m.item = 5",
    "q23_replacements": "SELECT r.item AS removed, a.item AS added, count(*) AS n FROM dependency_changes r JOIN dependency_changes a ON r.package = a.package AND r.version = a.version JOIN (SELECT package, version FROM dependency_changes GROUP BY package, version HAVING count(*) = 2) two ON two.package = r.package AND two.version = r.version WHERE r.change = 'REMOVED' AND a.change = 'ADDED' AND r.version NOT LIKE '%-%' GROUP BY r.item, a.item",
    "q24_removed_while_added": "SELECT DISTINCT r.item FROM dependency_changes r JOIN dependency_changes a ON r.package = a.package AND r.version = a.version WHERE r.version NOT LIKE '%-%' AND r.change = 'REMOVED' AND a.change = 'ADDED'",
    "q25_added_then_removed": "SELECT DISTINCT a.item FROM dependency_changes a JOIN dependency_changes r ON a.package = r.package AND a.item = r.item AND r.release_time > a.release_time WHERE r.version NOT LIKE '%-%' AND a.change = 'ADDED' AND r.change = 'REMOVED'",
    "q26_counts_over_zero": "SELECT name, month, count FROM maintainer_counts WHERE count > 0",
    "q26b_changes_in_order": "SELECT * FROM dependency_changes ORDER BY package, version",
    "q26c_timed_versions": "SELECT package, version, version_diff, release_time FROM version_changes WHERE release_time <> TIMESTAMP '1970-01-01 00:00:01' ORDER BY release_time",
    "q26d_popularity": "SELECT package, overall, year2000 FROM popularity ORDER BY overall DESC",
    "q27_two_changes": "SELECT package, version FROM dependency_changes GROUP BY package, version HAVING count(*) = 2",
    "q28_license_histogram": "SELECT l.change, count(*) AS n, round(sum(p.overall), 0) AS popularity FROM license_changes l JOIN popularity p ON l.package = p.package GROUP BY l.change",
    "q29_distinct_counts": "SELECT (SELECT count(DISTINCT name) FROM maintainer_changes) AS names, (SELECT count(DISTINCT package) FROM maintainer_changes) AS packages, (SELECT count(DISTINCT item) FROM members) AS dependencies",
    "q29b_dependency_names": "SELECT DISTINCT item FROM members",
    "q29c_names_counted": "SELECT name, count(*) AS n FROM maintainer_changes GROUP BY name ORDER BY name",
    "q30_without_maintainer": "SELECT p.name FROM packages p LEFT JOIN owned o ON p.name = o.package WHERE o.package IS NULL",
    "q31_holders": "SELECT DISTINCT p.name, o.owner FROM packages p JOIN owned o ON p.name = o.package WHERE p.version = 'Brand#11'",
    "q32_added_by_one": "SELECT DISTINCT package FROM maintainer_changes WHERE name = 4 AND change = 'ADDED'",
    "q32b_names_like": "SELECT DISTINCT CAST(name AS STRING) AS name FROM maintainers WHERE CAST(name AS STRING) LIKE '1%' ORDER BY name LIMIT 20",
    "q33_license_violations": "SELECT DISTINCT m.package, m.item, a.type AS own, b.type AS theirs FROM members m JOIN licenses a ON m.package = a.package JOIN licenses b ON m.item = b.package WHERE b.type LIKE 'GPL%' AND a.type <> b.type AND a.type NOT LIKE '%GPL%'",
    "q34_main_of_one": "SELECT main FROM packages WHERE name = 11",
    "q35_counts_grouped": "SELECT count, count(*) AS n FROM maintainer_counts WHERE month = DATE '2000-04-01' GROUP BY count",
    "q35b_distinct_counts": "SELECT count(DISTINCT count) AS n FROM maintainer_counts ",
    "q35c_dependents_of_one": "SELECT DISTINCT package FROM members WHERE item = 5",
    "q36_literal_list": "SELECT round(sum(year2000), 2) AS total FROM popularity WHERE package IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)",
    "q37_top_popularity": "SELECT package, overall FROM popularity ORDER BY overall DESC, package LIMIT 100",
    "q38_versions_of_top": f"SELECT v.package, v.version FROM versions v JOIN {TOP.format(100)} p ON v.package = p.package",
}

#: Views that operators make.
MADE = {
    "dependency_changes": lambda v: changes.dependency_changes(v("versions"), v("members"), CUTOFF),
    "version_changes": lambda v: changes.version_changes(v("versions"), CUTOFF),
    "version_counts": lambda v: changes.version_counts(changes.version_changes(v("versions"), CUTOFF)),
    "license_changes": lambda v: changes.license_changes(v("versions"), CUTOFF),
    "maintainer_counts": lambda v: timeline.maintainer_counts(v("maintainer_changes"), *GRID),
}
CUTOFF = "2001-01-01"
GRID = ("1995-01-01", "2001-12-01")


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One statement, with just the views that it names."""
    text = STATEMENTS[name]
    for view in bindings.VIEWS:
        if f" {view} " in f"{text} " or f" {view})" in text:
            bindings.view(spark, sf_dir, view).createOrReplaceTempView(view)
    for view, make in MADE.items():
        if f" {view} " in f"{text} " or f" {view})" in text:
            make(lambda x: bindings.view(spark, sf_dir, x)).createOrReplaceTempView(view)
    return spark.sql(text)


def explained(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Q35: the plan of a statement."""
    return run(spark, sf_dir, name)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
