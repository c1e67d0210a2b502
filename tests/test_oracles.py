"""All registered queries against their DuckDB SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from verify import rows_of

SF = "/root/testdata/sf0.001"
ORACLES = oracle_sql()
# the training-data queries have their own tests
QUERIES = {n: q for n, q in queries().items() if not n.startswith("op") and n != "pipeline"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert got
        return
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == rows_of(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    same(spark, duck, name)


def test_keys_of_the_inventory():
    missing = [
        f"{letter}{n}"
        for letter, last in dict(A=7, B=12, C=11, D=19, E=13, F=5, H=27, I=12, J=7, K=17, L=6).items()
        for n in range(1, last + 1)
        if not any(q.startswith(f"{letter}{n}_") for q in QUERIES)
    ]
    assert missing == []
    assert {"G1s", "G2s", "G3s"} <= {q.split("_")[0] for q in QUERIES}
