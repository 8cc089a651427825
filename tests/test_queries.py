"""Every registered query of the engine's own operators against its SQL, over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from lodestone.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, list):
        return tuple(map(plain, value))
    return value


def rows_of(table):
    columns = sorted(table.column_names)
    return columns, sorted((tuple(plain(v) for v in row) for row in zip(*(table.column(c).to_pylist() for c in columns), strict=True)), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(catalogue.ORACLE))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    got = rows_of(catalogue.QUERIES[name](spark, str(DATA)).toArrow())
    assert got == rows_of(duck.execute(catalogue.ORACLE[name]).to_arrow_table())


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLE])
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if DATA.exists():
        assert entry.entry(spark).columns
