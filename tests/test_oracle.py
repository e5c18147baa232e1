"""Every measurement query against its SQL oracle in DuckDB."""

import math

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return str(x) if hasattr(x, "isoformat") else float(x) if type(x).__name__ == "Decimal" else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    rows = got.collect()
    assert rows or name == "j13_first_differences"
    sql = registry.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns)
        a, b = rows_of(got.columns, rows), rows_of(names, want.fetchall())
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert x == y or all(p == q or isinstance(p, float) and isinstance(q, (int, float)) and math.isclose(p, q, rel_tol=1e-9, abs_tol=2e-6) for p, q in zip(x, y, strict=True)), (x, y)
