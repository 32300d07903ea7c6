"""Every query that has SQL gives the rows that DuckDB gives for it."""

import math

import duckdb
import pytest

from tidemark.plans import all_oracles, all_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if type(v).__name__ == "Decimal":
        return int(v) if v == int(v) else float(v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_same_rows(spark, duck, name):
    df = all_queries()[name](spark, DATA)
    cols = sorted(df.columns)
    cur = duck.execute(all_oracles()[name])
    got_cols = [c[0] for c in cur.description]
    assert sorted(got_cols) == cols
    want = sorted(repr([plain(r[got_cols.index(c)]) for c in cols]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == want
