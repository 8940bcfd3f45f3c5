"""Every query with SQL gives what DuckDB gives on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from folioforge import catalog


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        return v if v is None or isinstance(v, (str, bool, int)) else str(v)

    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, data, duck, name):
    df = catalog.queries()[name](spark, data)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert got == _rows(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs_without_sql(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0


def test_entry_has_stable_schema(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["context_pack", "sources"]
