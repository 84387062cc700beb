"""Steps of the stateful streams over whole columns against plain loops, over several micro-batches with late rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from causaltape.streaming import jobs


def batches(rows, columns, order, r):
    """The rows in random micro-batches, each ordered as a processor orders it."""
    while rows:
        n = r.randrange(1, 9)
        yield pd.DataFrame(rows[:n], columns=columns).sort_values(order, kind="stable", ignore_index=True)
        rows = rows[n:]


def run(processor, key, frames):
    held, out = None, []
    for batch in frames:
        held, got = processor.step(key, held, batch)
        out += [tuple(None if pd.isna(v) else v for v in row) for row in got.itertuples(index=False)]
    return out


@pytest.mark.parametrize("seed", range(30))
def test_availability(seed):
    r = random.Random(seed)
    seqs = [i + r.choice([0, 0, 0, -3]) for i in range(60)]
    if seed % 2:
        seqs = list(range(60))
    rows = [(t := i * 3 + r.choice([0, 0, 5, -9]), 1000 + i, s, t // 10 * 10, 10) for i, s in enumerate(seqs)]
    columns = ["event_ts_ns", "received_ts_ns", "source_sequence", "bucket", "width"]
    frames, want, held = list(batches(rows, columns, ["source_sequence"], r)), [], None
    for batch in frames:
        for x in batch.itertuples(index=False):
            if held and (x.event_ts_ns < held[2] or x.source_sequence <= held[1]):
                want.append((5, "1h", None, None, x.received_ts_ns, x.source_sequence, True))
                continue
            if held and x.bucket > held[0]:
                want.append((5, "1h", held[0], held[0] + 10, x.received_ts_ns, x.source_sequence, False))
            held = (x.bucket, x.source_sequence, x.event_ts_ns)
    assert run(jobs.Availability(), (5, "1h"), frames) == want and want


@pytest.mark.parametrize("seed", range(30))
def test_latest_context_never_tells_of_the_future(seed):
    r = random.Random(seed)
    rows = [(max(0, i + r.choice([0, 0, 0, -6])), r.randrange(2), i, float(i)) for i in range(50)]
    frames, want, held, answered = list(batches(rows, ["t", "kind", "seq", "value"], ["t", "kind", "seq"], r)), [], None, -1
    for batch in frames:
        after = answered
        for x in batch.itertuples(index=False):
            if x.kind == 0:
                if x.t < answered:
                    want.append((5, None, x.seq, x.value, None, True))
                if held is None or (x.t, x.seq) >= held[:2]:
                    held = (x.t, x.seq, x.value)
            else:
                after = max(after, x.t)
                late = held is not None and held[0] > x.t
                want.append((5, x.seq, None, None, None, True) if late else (5, x.seq, *((held[1], held[2], x.t - held[0]) if held else (None, None, None)), False))
        answered = after
    got = run(jobs.LatestContext(), (5,), frames)
    assert got == want and all(lag is None or lag >= 0 for *_, lag, _ in got)


@pytest.mark.parametrize("seed", range(30))
def test_lifecycle_keeps_numbers_once_handed_out(seed):
    r = random.Random(seed)
    rows = [(max(0, i + r.choice([0, 0, 0, -6])), i, r.choice(["IDLE", "DEVELOPING", "BURST"]), r.choice(["", "", "1", "2"])) for i in range(60)]
    frames, want = list(batches(rows, ["received_ts_ns", "source_sequence", "state", "eid"], ["received_ts_ns", "source_sequence"], r)), []
    state, eid, episode, seen = "", "", 0, (-1, -1)
    for batch in frames:
        for x in batch.itertuples(index=False):
            if (x.received_ts_ns, x.source_sequence) <= seen:
                want.append((5, x.source_sequence, None, True))
                continue
            if x.state != "IDLE":
                episode += state in ("", "IDLE") or (eid != "" and eid != x.eid)
                want.append((5, x.source_sequence, episode, False))
            state, eid, seen = x.state, x.eid, (x.received_ts_ns, x.source_sequence)
    assert run(jobs.Lifecycle(), (5,), frames) == want


def test_a_stream_of_few_keys_keeps_few_state_partitions(spark, tmp_path):
    """Each state partition costs a task and a commit in every micro-batch."""
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        for i in range(2):
            rows = [(k, 10**15 + i * 10**13 + s * 10**11, 10**15 + s, i * 100 + s) for k in range(3) for s in range(5)]
            spark.createDataFrame(rows, "instrument long, event_ts_ns long, received_ts_ns long, source_sequence long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ticks = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = jobs.drain(jobs.availability_stream(ticks, {"1s": 10**9}), str(tmp_path / "out"))
        assert got.where("not violation").count() == 27 and got.where("violation").count() == 0
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    parts = [d for d in (tmp_path / "out" / "progress" / "state" / "0").iterdir() if d.name.isdigit()]
    assert 0 < len(parts) <= 2 * spark.sparkContext.defaultParallelism


def test_rows_of_a_null_key_are_a_key_of_their_own(spark, tmp_path):
    big = 2**60 + 1
    rows = [(k, 10**15 + s * 10**11, 10**15 + s, s, "BURST", None, ["click", "view"][s % 2]) for k in (None, big, 3) for s in range(5)]
    spark.createDataFrame(rows, "instrument long, event_ts_ns long, received_ts_ns long, source_sequence long, state string, eid long, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    got = jobs.drain(jobs.availability_stream(read(), {"1s": 10**9}), str(tmp_path / "bars"))
    assert {tuple(x) for x in got.select("instrument", "trigger_sequence", "violation").collect()} == {(k, s, False) for k in (None, big, 3) for s in range(1, 5)}
    got = jobs.drain(jobs.lifecycle_stream(read()), str(tmp_path / "episodes"))
    assert {tuple(x) for x in got.collect()} == {(k, s, 1, False) for k in (None, big, 3) for s in range(5)}
    t = read()
    anchors = t.where("kind = 'click'").select("instrument", F.col("received_ts_ns").alias("anchor_time"), F.col("source_sequence").alias("anchor_seq"))
    contexts = t.where("kind = 'view'").select("instrument", F.col("received_ts_ns").alias("available_time"), F.col("source_sequence").alias("context_seq"), F.lit(1.0).alias("context_value"))
    got = jobs.drain(jobs.latest_context_stream(anchors, contexts), str(tmp_path / "contexts"))
    assert {tuple(x) for x in got.select("instrument", "anchor_id", "context_seq").collect()} == {(k, s, s - 1 if k and s else None) for k in (None, big, 3) for s in (0, 2, 4)}
