"""Every query with a DuckDB counterpart gives the same rows; the others give rows and no NaN by accident."""

import math

import duckdb
import pytest

from gaugeworks.plans import headline

#: The smallest tables on which every group has both labels, as the SQL expects.
SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "N"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5f}".replace("-0.00000", "0.00000")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return plain(float(v)) if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(headline.ORACLES))
def test_equals_duckdb(spark, duck, name):
    df = headline.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(headline.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want) if a != b and not near(a, b)]
    assert not wrong, wrong[:3]


def near(a, b):
    """Equal but for the last digit of a rounded float."""
    try:
        return all(x == y or abs(float(x) - float(y)) < 2e-5 for x, y in zip(a, b))
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(set(headline.QUERIES) - set(headline.ORACLES)))
def test_runs_without_oracle(spark, sf, name):
    rows = headline.QUERIES[name](spark, sf).collect()
    assert rows
    assert not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)
