"""Queries that have SQL: the same rows on the smallest tables and on awkward ones."""

import pytest
from oracle import same

from kinlink.llm import queries as Q

from cases import ROWS, folder


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, sf, name):
    same(spark, sf, Q.queries()[name], Q.oracle_sql()[name])


def test_mixing_awkward(spark, tmp_path):
    import duckdb

    d = folder(spark, tmp_path, list(dict.fromkeys(ROWS)))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    want = sorted(map(repr, con.sql(Q.oracle_sql()["op1_mixing"] + " ").fetchall()))
    got = Q.queries()["op1_mixing"](spark, d)
    order = ["doc_id", "size", "source_size", "target", "taken", "copies"]
    assert sorted(repr(tuple(r)) for r in got.select(*order).collect()) == want
