import __spark_entry__ as entry
import pytest

from corpuskiln.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_sql(spark, sf, name):
    """Rows of each query and of its SQL on the smallest tables."""
    import duckdb

    df = registry.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in registry.SQL:
        assert len(rows) > 0
        return
    db = duckdb.connect()
    for table in ("docs", "chunks", "documents", "embeddings", "traces", "query_cache", "eval_set", "adversarial_queries"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    result = db.execute(registry.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v
    want = sorted((tuple(plain(r[columns.index(c)]) for c in df.columns) for r in result.fetchall()), key=str)
    assert sorted((tuple(plain(v) for v in r) for r in rows), key=str) == want


def test_entry(spark):
    assert len(entry.entry(spark).columns) == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
