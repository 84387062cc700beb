"""Every registered query with a SQL twin against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from causaltape.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(table):
    names = sorted(table.column_names)
    return sorted(repr([float(v) if isinstance(v, float) else v for v in row]) for row in zip(*(table.column(n).to_pylist() for n in names), strict=True))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toArrow(), duck.sql(ORACLES[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert sorted(got.column_names) == sorted(want.column_names)
    assert [x.replace("-0.0", "0.0") for x in plain(got)] == [x.replace("-0.0", "0.0") for x in plain(want)]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_incident_sessions_equal_a_plain_loop(spark):
    from causaltape.plans import fixtures as fx

    times, want = {}, []
    for r in fx.ticks(spark, SF).where("event_type = 'error'").collect():
        times.setdefault(r["instrument"], []).append(r["received_ts_ns"])
    for instrument, seen in times.items():
        seen.sort()
        first = 0
        for k in range(1, len(seen) + 1):
            if k == len(seen) or seen[k] // 1000 - seen[k - 1] // 1000 >= fx.HOUR // 1000:
                want.append((instrument, k - first, seen[first], seen[k - 1]))
                first = k
    got = QUERIES["r8_incident_sessions"](spark, SF).collect()
    assert sorted((r["instrument"], r["firings"], r["start_ns"], r["end_ns"]) for r in got) == sorted(want)


def test_replay_bounds_the_rows_of_a_batch(spark, monkeypatch):
    from pyspark.sql import functions as F

    from causaltape.plans import streams

    monkeypatch.setattr(streams, "BATCH_ROWS", 100, raising=False)
    rows = spark.range(2000).select("id", (F.col("id") + F.when(F.col("id") > 1990, 10**9).otherwise(0)).alias("received_ts_ns"))
    seen = []
    streams.replay(spark, rows).writeStream.foreachBatch(lambda b, _: seen.append([r["id"] for r in b.collect()])).trigger(availableNow=True).start().awaitTermination()
    seen = [sorted(b) for b in seen if b]
    assert max(map(len, seen)) <= 200 and sum(seen, []) == list(range(2000))


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(ORACLES) <= set(__spark_entry__.queries())
