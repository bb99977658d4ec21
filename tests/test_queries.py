"""Queries against their SQL in another engine."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from depweave.operators import bitsets, closure
from depweave.plans import bindings

SF = "/root/testdata/sf0.001"
SOME = ["q4_added_removed", "q15_release_interval", "q23_replacements", "q33_license_violations", "f14_semver_diff", "c2_version_changes_closed", "c4_version_counts", "t3_monthly_versions", "t10_maintained_packages", "t17_as_of", "r3_layered_reach", "g4_secured_share", "a2_extreme_diffs", "a10_vulnerable_reach", "p5_call_edges", "v10_boosts"]


def plain(df):
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return ""
        return f"{x:.4f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(pd.Timestamp(x)) if hasattr(x, "year") else str(x)

    return sorted(tuple(cell(x) for x in row) for row in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    con = duckdb.connect()
    for t in bindings.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert plain(entry.queries()[name](spark, SF).toPandas()) == plain(con.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 25
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["v10_boosts", "v11_boost_factors"])
def test_steps_of_just_the_least(spark, tmp_path, name):
    """Steps of exactly 300 are spikes and falls in the SQL."""
    rows = [(i, "view", float(v)) for i, v in enumerate([10, 30, 330, 40, 340, 50, 350, 50, 50])]
    pd.DataFrame(rows, columns=["event_id", "event_type", "value"]).to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    for t in bindings.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path if t == 'events' else SF}/{t}.parquet'")
    got = plain(entry.queries()[name](spark, str(tmp_path)).toPandas())
    assert got and got == plain(con.execute(entry.oracle_sql()[name]).df())


WITHOUT_PAIRS = ["r7_reach_with_dev", "r17_windowed_reach", "g4_secured_share", "g3_trust_average", "r8_monthly_cost", "g5_trusted_owners", "g1_cover_along", "a10_vulnerable_reach", "r13_owner_cost_by_month", "r15_owner_ranking", "r12_owner_cost", "r10_owner_reach"]


@pytest.mark.parametrize("name", WITHOUT_PAIRS)
def test_without_pairs(spark, monkeypatch, name):
    """Where the graph is broadcast no closure is written out as pairs; a graph over the bound is closed by joins."""
    con = duckdb.connect()
    for t in bindings.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = plain(con.execute(entry.oracle_sql()[name]).df())
    with monkeypatch.context() as m:
        m.setattr(closure, "closure", lambda *a, **b: pytest.fail("pairs"))
        assert plain(entry.queries()[name](spark, SF).toPandas()) == want
    monkeypatch.setattr(bitsets, "EDGES", 0)
    assert plain(entry.queries()[name](spark, SF).toPandas()) == want
