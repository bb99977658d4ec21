"""Queries of the training-data operators against their SQL in another engine."""

import duckdb
import pytest

import __spark_entry__ as entry
from depweave.plans import bindings

from ..test_queries import SF, plain


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op2_decontaminate", "op4_suffix_dedup", "op6_quotation_linking"])
def test_query(spark, name):
    con = duckdb.connect()
    for t in bindings.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = plain(entry.queries()[name](spark, SF).toPandas())
    assert got == plain(con.execute(entry.oracle_sql()[name]).df()) and got
