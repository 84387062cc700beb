"""Paths that leave the stream as soon as they are complete."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causaltape.operators import paths
from causaltape.streaming import jobs, pending

S = 1_000_000_000
HORIZONS = {"10s": 10 * S, "60s": 60 * S}
SCHEMA = "instrument long, received_ts_ns long, source_sequence long, mid double, anchor_id long, direction int"


def streamed(spark, batches, folder):
    """The batches as files, one a micro-batch; each but the last is followed by nothing, the last by a row far ahead."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return jobs.drain(pending.pending_paths(source, HORIZONS, late="1000 seconds", patience_ns=100 * S), f"{folder}/out").collect()


def test_paths_leave_once_complete_and_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(4)
    rows, seq = [], 0
    for i in range(240):
        seq += 1
        anchor = seq if rng.random() < 0.3 else None
        # times repeat and prices return to earlier ones; one key falls silent early
        key = 1 if i < 60 and i % 3 == 0 else 2
        rows.append((key, 1000 * S + (i // 2) * 2 * S + rng.choice((0, 0, 250_000_000)) * (i % 2), seq, 100 + rng.choice((0.0, 0.5, 1.0)), anchor, rng.choice((-1, 1))))
    rows.sort(key=lambda r: (r[1], r[2]))
    # batches end between different times
    cuts = [0, *[c for c in (50, 120, 190) if rows[c - 1][1] != rows[c][1]], len(rows)]
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    batches[1] = [*batches[1], (None, 1100 * S, 9000, 1.0, 9000, 1), (2, 1100 * S, 9001, None, 9001, 1)]
    batches.append([(2, 1001 * S, 9002, 100.0, None, 1)])
    batches.append([(None, 10**6 * S, 9999, None, None, None)])
    got = streamed(spark, batches, str(tmp_path))
    ticks = spark.createDataFrame(rows, SCHEMA)
    anchors = ticks.where("anchor_id is not null").select("instrument", "anchor_id", F.col("received_ts_ns").alias("anchor_time"), F.col("source_sequence").alias("anchor_seq"), F.col("mid").alias("anchor_mid"), "direction")
    names = [c.split(":")[0] for c in pending.OUTCOME[7:-1].split(",")]
    want = {(r["anchor_id"], r["horizon"]): tuple(r[n] for n in names) for r in paths.forward_paths(anchors, ticks, ["instrument"], HORIZONS).collect()}
    mine = {(r["anchor_id"], o["horizon"]): tuple(o[n] for n in names) for r in got if r["anchor_id"] is not None for o in r["outcomes"]}
    assert mine.keys() == want.keys() and len(mine) == 2 * sum(r["anchor_id"] is not None for r in got)
    for k, w in want.items():
        assert mine[k] == pytest.approx(w, abs=1e-12), k
    ends = {k: max(r[1] for r in rows if r[0] == k) for k in (1, 2)}
    times = {r[4]: (r[0], r[1]) for r in rows if r[4] is not None}
    for r in got:
        if r["anchor_id"] is not None:
            key, at = times[r["anchor_id"]]
            assert r["drained"] == (at + 60 * S >= ends[key])
            if not r["drained"]:
                assert at + 60 * S < r["emitted_ns"] <= ends[key]
    assert len({r["emitted_ns"] for r in got if not r["drained"]}) > 1
    assert [r["late_sequence"] for r in got if r["late_sequence"] is not None] == [9002]


def test_outcomes_of_whole_columns_equal_those_of_one_anchor():
    rng = random.Random(6)
    for n in (0, 1, 2, 3, 7, 64, 400):
        ticks = np.sort(np.array([(rng.randint(0, 90) * S + rng.choice((0, 1, 10**6, 6 * 10**8)), i, 100 + rng.randint(0, 6) / 4) for i in range(n)], pending.TICK), order=["t", "seq"])
        anchors = [(k, rng.randint(-5, 95) * S, rng.randint(-1, n), 100 + rng.randint(-1, 13) / 8, rng.choice((-1, 1))) for k in range(60)]
        got = pending.outcomes(anchors, ticks, HORIZONS, 70 * S)
        for a, mine in zip(anchors, got, strict=True):
            for (h, w), o in zip(HORIZONS.items(), mine, strict=True):
                want = pending.outcome(a, ticks, h, w, 70 * S)
                assert o.keys() == want.keys() and [o[k] for k in want] == pytest.approx(list(want.values()), abs=1e-12), (n, a, h)


def test_a_batch_that_closes_all_anchors_leaves_no_state(spark, tmp_path):
    rows = [(1, 1000 * S, 1, 100.0, 1, 1)], [(1, 1200 * S, 2, 101.0, None, 1)], [(None, 10**6 * S, 9, None, None, None)]
    got = streamed(spark, rows, str(tmp_path))
    assert [(r["anchor_id"], r["drained"]) for r in got] == [(1, False)]


def test_windows_count_without_pairs_and_tell_late_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice((1, 2)), (1000 + i // 3) * S, i if rng.random() < 0.3 else None, rng.random() < 0.6) for i in range(300)]
    batches = [[], [], []]
    for r in rows:
        batches[min((r[1] // S - 1000 + rng.choice((0, 8))) // 40, 2)].append(r)
    batches = [*batches, [(1, 1001 * S, None, True), (None, 10**6 * S, None, None)]]
    schema = "instrument long, t long, anchor_id long, counts boolean"
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = jobs.drain(pending.pending_windows(source, 5 * S, 7 * S, late_ns=10 * S, patience_ns=100 * S), f"{tmp_path}/out").collect()
    want = {}
    for k, t, a, _ in rows:
        if a is not None:
            seen = [u for j, u, _, c in rows if j == k and c and t - 5 * S <= u <= t + 7 * S]
            want[a] = (k, len(seen), max(seen, default=None))
    assert {r["anchor_id"]: (r["instrument"], r["n"], r["last_time"]) for r in got if r["anchor_id"] is not None} == want
    assert len(got) == len(want) + sum(r["late_time"] is not None for r in got)
