"""Every query with SQL gives DuckDB's rows on the small tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tracewell.queries import ORACLE, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return "nan" if math.isnan(v) else float(v)
    return str(v)


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-4, abs_tol=1e-4)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    cursor = duck.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()], key=str)
    assert len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
