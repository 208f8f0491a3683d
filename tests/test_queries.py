"""Every registered query: against its SQL where it has one, else that it runs over whole tables with a stable schema."""

import pytest

from geoquarry.plans import queries as own

QUERIES, SQL = own.queries(), own.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    assert df.columns and rows and all(len(r) == len(df.columns) for r in rows)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_stream_gives_the_tracks_of_the_table(spark, data):
    key = lambda r: (r.stream_id, r.frame_id, r.track_id)
    a, b = (sorted(map(key, QUERIES[q](spark, data).collect())) for q in ("track_batch", "stream_track"))
    assert a and a == b


def test_written_tables_can_be_released(spark):
    from geoquarry import storage

    df = storage.materialize(spark.range(5), "x")
    assert df.count() == 5 and storage.release(spark) >= 1 and storage.release(spark) == 0
