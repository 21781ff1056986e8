"""Every registered query of the engine's own operators against the same rows from SQL, on the smallest tables."""

import duckdb
import pytest

from headway.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def text(value):
    if value is None or isinstance(value, (bool, str)):
        return repr(value)
    try:
        return f"{float(value):.9g}"
    except (TypeError, ValueError):
        return str(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(text(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.ORACLES:
        result = db.execute(registry.ORACLES[name])
        assert got == table([c[0] for c in result.description], result.fetchall())


def test_entry_works_without_the_corpus_parts(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
