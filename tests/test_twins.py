"""Queries against their SQL twins on the smallest tables."""

import math

import duckdb
import pytest

from trailmark.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = [n for n in ORACLE_SQL if not n.startswith(("r03", "r06", "r07", "r09", "g09_cand", "g10", "g11", "e09", "e10_ab", "v0", "n0", "c0"))]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    return repr(round(float(v), 5) + 0.0) if isinstance(v, int | float) else str(v)


@pytest.mark.parametrize("name", [*QUICK, "r09_unique_names", "c01_refined_archetypes"])
def test_twin(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    r = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert got == want
