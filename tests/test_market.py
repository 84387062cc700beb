"""Scenarios of joins, availability, lifecycles and paths on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from causaltape.operators import asof, availability, lifecycle, paths
from causaltape.plans import conditions

S = 1_000_000_000
DAY = 86_400 * S


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_asof_is_inclusive_and_the_last_of_equal_times_wins(spark):
    a = spark.createDataFrame([(1, 10, 5), (2, 9, 5), (3, 0, 5)], "id long, t long, source_sequence long").withColumn("k", F.lit("x"))
    c = spark.createDataFrame([("x", 10, 1, "a"), ("x", 10, 9, "b"), ("x", 5, 2, "c"), ("y", 9, 3, "d"), ("x", None, 4, "e")], "k string, u long, source_sequence long, v string")
    assert rows(asof.asof_latest(a, c, ["k"], "t", "u", fields=["v"]), "id", "ctx_v") == [(1, "b"), (2, "c"), (3, None)]
    assert rows(asof.asof_latest(a, c, ["k"], "t", "u", fields=["v"], by_sequence=True), "id", "ctx_v") == [(1, "a"), (2, "c"), (3, None)]
    assert rows(asof.asof_latest(a, c, ["k"], "t", "u", fields=["v"], strict=True), "id", "ctx_v") == [(1, "a"), (2, "c"), (3, None)]


@pytest.mark.parametrize("bucket", [1, 7, 1000, 10**9])
@pytest.mark.parametrize("partitions", [1, 7])
def test_asof_does_not_depend_on_buckets_or_partitions(spark, bucket, partitions):
    a = spark.range(200).select(F.col("id"), (F.col("id") * 37 % 500).alias("t"), F.col("id").alias("source_sequence"), (F.col("id") % 2).alias("k")).repartition(partitions)
    c = spark.range(60).select((F.col("id") * 53 % 500).alias("u"), F.col("id").alias("source_sequence"), (F.col("id") % 2).alias("k")).repartition(partitions)
    got = {r["id"]: r["ctx_u"] for r in asof.asof_latest(a, c, ["k"], "t", "u", fields=["u"], bucket_ns=bucket).collect()}
    ctx = [(i % 2, i * 53 % 500) for i in range(60)]
    assert got == {i: max((u for k, u in ctx if k == i % 2 and u <= i * 37 % 500), default=None) for i in range(200)}


def test_lookback_includes_both_ends(spark):
    c = spark.createDataFrame([("x", t) for t in (70, 80, 90, 100, 101)], "k string, u long")
    a = spark.createDataFrame([("x", 100), ("x", 101)], "k string, t long")
    got = asof.lookback(a, c, ["k"], "t", "u", 20).groupBy("t").count()
    assert rows(got, "t", "count") == [(100, 3), (101, 3)]


def test_between_counts_without_pairs(spark):
    c = [("x", t * DAY // 2, n) for n, t in enumerate((1, 1, 3, 4, 4, 9))] + [("y", 0, 7), (None, 0, 8), ("x", None, 9)]
    spans = [("x", DAY // 2, 0, DAY * 2), ("x", DAY // 2, 1, DAY * 2 - 1), ("x", -1, 0, DAY * 9), ("x", DAY * 3, 0, DAY * 4), ("x", DAY, 0, DAY), ("z", 0, 0, DAY), ("x", -1, 0, DAY * 9)]
    got = asof.between(spark.createDataFrame(spans, "k string, t long, s long, e long"), spark.createDataFrame(c, "k string, u long, v long"), ["k"], ("t", "s"), "e", ("u", "v"))
    inside = lambda p: [u for k, u, v in c if k == p[0] and u is not None and (u, v) > p[1:3] and u <= p[3]]
    assert rows(got, "k", "t", "s", "e", "n", "last_time") == sorted((*p, len(inside(p)), max(inside(p), default=None)) for p in spans)


def test_first_after_is_strictly_later_and_near(spark):
    c = spark.createDataFrame([("x", 10, 1, "a"), ("x", 12, 3, "b"), ("x", 12, 2, "c"), ("x", 40, 4, "d"), ("y", 11, 5, "e")], "k string, u long, v long, d string")
    a = spark.createDataFrame([("x", 10), ("x", 11), ("x", 12), ("x", 20), ("x", 40), ("y", 0), (None, 0)], "k string, t long")
    got = asof.first_after(a, c, ["k"], "t", "u", "v", ["d"], 20)
    assert {(r["k"], r["t"]): (r["ctx_d"], r["ctx_u"]) for r in got.collect()} == {("x", 10): ("c", 12), ("x", 11): ("c", 12), ("x", 12): (None, None), ("x", 20): ("d", 40), ("x", 40): (None, None), ("y", 0): ("e", 11), (None, 0): (None, None)}


@pytest.mark.parametrize("name", ["j4_forward_horizon", "x7_co_evolution", "x11_antecedent_windows"])
def test_windows_of_anchors_list_no_pairs(spark, name, monkeypatch):
    """Neither the pairs nor a join on buckets as wide as the window, whose rows grow with the square of the tape."""
    from causaltape.plans import registry

    for pairs in ("forward", "lookback"):
        monkeypatch.setattr(asof, pairs, lambda *_: pytest.fail("pairs"))
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_availability_closes_on_a_later_bucket_without_empty_bars(spark):
    t = spark.createDataFrame([(0, 0, 10, 1), (0, 60 * S, 20, 2)], "i long, event_ts_ns long, received_ts_ns long, source_sequence long")
    got = availability.bar_availability(t, {"15s": 15 * S, "30s": 30 * S, "1m": 60 * S}, ["i"])
    assert rows(got, "timeframe", "bar_close_ns", "available_time_ns") == [("15s", 15 * S, 20), ("1m", 60 * S, 20), ("30s", 30 * S, 20)]
    tie = spark.createDataFrame([(0, 15 * S, 10, 3), (0, 0, 10, 1), (0, 16 * S, 10, 4)], t.schema)
    assert rows(availability.bar_availability(tie, {"15s": 15 * S}, ["i"]), "trigger_sequence") == [(3,)]
    assert availability.bar_availability(t.limit(1), {"1m": 60 * S}, ["i"]).count() == 0


def tape(spark, states, day=86_400 * S):
    return spark.createDataFrame([(0, k * day // 3, k, s, e) for k, (s, e) in enumerate(states)], "instrument long, received_ts_ns long, source_sequence long, state string, eid long")


def episodes(spark, states):
    return [r["episode"] for r in lifecycle.episodes(tape(spark, states), ["instrument"]).orderBy("source_sequence").collect()]


def test_lifecycle_segmentation_rules(spark):
    assert episodes(spark, [("IDLE", None), ("DEVELOPING", None), ("BURST", 1), ("DYING", 1), ("IDLE", None), ("BURST", 2)]) == [None, 1, 1, 1, None, 2]
    assert episodes(spark, [("BURST", 1), ("BURST", None), ("BURST", 2), ("BURST", 3)]) == [1, 2, 2, 3]
    assert episodes(spark, [("BURST", 1), (None, 9), ("DYING", 1)]) == [1, 1]
    assert episodes(spark, []) == []


def test_lifecycle_truncation_censoring_and_anchors(spark):
    eps = lifecycle.episodes(tape(spark, [("BURST", 1), ("DYING", 1), ("IDLE", None), ("DEVELOPING", None), ("IDLE", None), ("DEVELOPING", None), ("BURST", 4)]), ["instrument"])
    got = lifecycle.summary(eps, ["instrument"])
    assert rows(got, "episode", "left_truncated", "right_censored", "fizzled") == [(1, True, False, False), (2, False, False, True), (3, False, True, False)]
    assert rows(lifecycle.state_anchors(eps, ["instrument"]), "episode", "anchor_state") == [(1, "DYING"), (3, "BURST")]
    assert rows(lifecycle.state_anchors(eps, ["instrument"], left_policy="emit"), "episode", "anchor_state") == [(1, "BURST"), (1, "DYING"), (3, "BURST")]


def test_milestone_is_the_first_row_of_the_value_standing_at_the_burst(spark):
    states = [("DEVELOPING", None), ("DEVELOPING", None), ("DEVELOPING", None), ("BURST", 1), ("BURST", 1)]
    values = [5, None, 7, 7, 8]
    df = tape(spark, states).join(spark.createDataFrame(list(enumerate(values)), "source_sequence long, weak_ms long"), "source_sequence")
    got = lifecycle.milestones(lifecycle.episodes(df, ["instrument"]), ["instrument"], "weak_ms")
    assert rows(got, "weak_ms", "crossing_ordinal", "arm_ordinal") == [(7, 3, 4)]


def test_paths_keep_anchors_without_ticks(spark):
    ticks = spark.createDataFrame([(0, 10 * S, 1, 100.0), (0, 11 * S, 2, 110.0), (0, 12 * S, 3, 99.0), (0, 500 * S, 4, 100.0)], "instrument long, received_ts_ns long, source_sequence long, mid double")
    a = spark.createDataFrame([(0, 1, 10 * S, 1, 100.0, 1), (0, 2, 100 * S, 3, 100.0, 1), (0, 3, 490 * S, 3, 100.0, -1)], "instrument long, anchor_id long, anchor_time long, anchor_seq long, anchor_mid double, direction int")
    got = {(r["anchor_id"], r["horizon"]): r for r in paths.forward_paths(a, ticks, ["instrument"], {"5s": 5 * S, "60s": 60 * S}).collect()}
    assert len(got) == 6
    one = got[1, "5s"]
    assert (one["ticks"], one["mfe_offset_ms"], one["mae_offset_ms"], one["favorable_first"], one["complete"]) == (2, 1000, 2000, True, True)
    assert got[2, "60s"]["complete"] and got[2, "60s"]["endpoint_return"] is None and got[2, "60s"]["realized_variance"] == 0
    assert not got[3, "60s"]["complete"] and got[3, "60s"]["censor_reason"] == "DEVELOPMENT_BOUNDARY"


def test_asof_of_sides_that_are_dealt_by_key_alike(spark):
    """Both sides come out of exchanges by the key, of unlike sizes: each anchor still has one context."""
    from pyspark.sql import functions as F

    from causaltape.operators import asof

    a = spark.range(20_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("s"), (F.col("id") * 10**10).alias("t")).repartition(7, "k")
    c = spark.range(50).select((F.col("id") % 3).alias("k"), F.col("id").alias("s"), (F.col("id") * 4 * 10**12).alias("u"), F.col("id").alias("v")).groupBy("k", "s", "u", "v").count().repartition("k")
    got = asof.asof_latest(a, c, ["k"], "t", "u", "s", "s", ["v"])
    assert got.count() == 20_000
    best = {r["s"]: r["ctx_v"] for r in got.collect()}
    assert best == {s: max((v for v in range(50) if v % 3 == s % 3 and v * 4 * 10**12 <= s * 10**10), default=None) for s in range(20_000)}


@pytest.mark.parametrize("branch", [2, 8])
def test_paths_equal_a_plain_loop(spark, branch):
    import math
    import random

    draw = random.Random(5)
    tape, at = [], 0
    for i in range(160):
        at += draw.choice([0, 200_000, 1_000_000, 300_000_000, 2 * S, 9 * S])
        tape.append((draw.randrange(2), at, i, draw.choice([1.0, 1.1, 0.9, 1.05])))
    anchors = [(k, i, t + draw.choice([-500_000, 0, 0]), s, m, draw.choice([1, -1])) for i, (k, t, s, m) in enumerate(tape) if i % 4 == 0]
    horizons = {"0s": S // 2, "7s": 7 * S, "90s": 90 * S}
    got = {
        (r["anchor_id"], r["horizon"]): r
        for r in paths.forward_paths(
            spark.createDataFrame(anchors, "k long, anchor_id long, anchor_time long, anchor_seq long, anchor_mid double, direction int"),
            spark.createDataFrame(tape, "k long, received_ts_ns long, source_sequence long, mid double"), ["k"], horizons, branch=branch,
        ).collect()
    }
    assert len(got) == 3 * len(anchors)
    for k, i, t, s, m, d in anchors:
        mine = [x[1:] for x in tape if x[0] == k]
        for h, w in horizons.items():
            r, inside = got[i, h], [x for x in mine if (x[0], x[1]) > (t, s) and x[0] <= t + w]
            assert r["ticks"] == len(inside) and r["complete"] == (mine[-1][0] >= t + w)
            if not inside:
                assert r["mfe"] is None and r["favorable_first"] is None and r["realized_variance"] == 0 and not r["tie"]
                continue
            price, steps, by_second, off = m, [], {}, lambda u: (u - t) // 1_000_000
            for n, (u, _, p) in enumerate(inside):
                steps.append(math.log(p / (m if n == 0 else price)))
                by_second[u // S] = by_second.get(u // S, 0.0) + steps[-1]
                price = p
            signed = [(d * math.log(p / m), off(u)) for u, _, p in inside]
            up, down = ([o for v, o in signed if v * side > 0] for side in (1, -1))
            want = [math.log(price / m), max(max(v for v, _ in signed), 0.0), max(-min(v for v, _ in signed), 0.0), sum(x * x for x in by_second.values())]
            assert [r[c] for c in ("endpoint_return", "mfe", "mae", "realized_variance")] == pytest.approx(want, abs=1e-12)
            assert r["mfe_offset_ms"] == min((-v, o) for v, o in signed)[1] and r["mae_offset_ms"] == min(signed)[1]
            assert r["favorable_first"] == (up[0] < down[0] if up and down else None) and r["tie"] == any(p == m for _, _, p in inside)
            total = sum(map(abs, steps))
            assert r["path_efficiency"] == (pytest.approx(want[0] / total, abs=1e-9) if total > 1e-12 else None)


def test_paths_exchange_each_tick_twice_however_many_share_a_second(spark):
    """Anchors and ticks of one second are not paired, and a tick without a price counts but has no part in prices."""
    ticks = spark.range(4000).select(F.lit(0).alias("k"), (F.col("id") % 2 * 100 + 10**9).alias("received_ts_ns"), F.col("id").alias("source_sequence"), F.when(F.col("id") != 1, 100.0 + F.col("id") % 5).alias("mid"))
    a = ticks.select("k", F.col("source_sequence").alias("anchor_id"), F.col("received_ts_ns").alias("anchor_time"), F.col("source_sequence").alias("anchor_seq"), F.lit(102.0).alias("anchor_mid"), F.lit(1).alias("direction"))
    got = paths.forward_paths(a, ticks, ["k"], {"1s": S})
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().replace("Join LeftOuter", "", 1)
    found = {r["anchor_id"]: r for r in got.collect()}
    assert found[0]["ticks"] == 3999 and found[3999]["ticks"] == 0 and found[3998]["ticks"] == 2000
    assert (found[3998]["tie"], found[3998]["favorable_first"], found[3998]["complete"]) == (True, False, False)
    nobody = a.withColumn("anchor_time", F.lit(None).cast("long")).limit(1)
    row = paths.forward_paths(nobody, ticks, ["k"], {"1s": S}).first()
    assert (row["ticks"], row["complete"], row["endpoint_return"]) == (0, False, None)


def test_wide_paths_have_the_measures_of_forward_paths(spark):
    """Also without ticks after the anchor, without a price, and for keys without ticks."""
    ticks = spark.createDataFrame([(k, i * S, i, 100.0 + (i * 7 + k) % 5 if i % 6 else None) for k in range(2) for i in range(40)], "instrument long, received_ts_ns long, source_sequence long, mid double")
    rows = [(k, 100 * k + i, i * S, i, 100.0 + i % 3 if i % 5 else None, 1 if i % 2 else -1) for k in range(3) for i in range(0, 60, 3)]
    anchors = spark.createDataFrame(rows, "instrument long, anchor_id long, anchor_time long, anchor_seq long, anchor_mid double, direction int")
    horizons, measures = {"5s": 5 * S, "60s": 60 * S}, ["mfe", "ticks", "signed_return", "complete"]
    want = {(r["anchor_id"], r["horizon"]): tuple(r[m] for m in measures) for r in paths.forward_paths(anchors, ticks, ["instrument"], horizons).collect()}
    got = paths.wide_paths(anchors, ticks, ["instrument"], horizons, measures).collect()
    assert len(got) == len(rows) and {(r["anchor_id"], h): tuple(r[f"{m}_{h}"] for m in measures) for r in got for h in horizons} == want


def test_cells_go_by_numbers_until_they_are_counted(spark):
    cells, _ = conditions._cells(spark, "/root/testdata/sf0.001")
    assert {c: cells.schema[c].dataType.simpleString() for c in ("cell", "outcome")} == {"cell": "int", "outcome": "int"}
    names = conditions._told(cells).drop("month", "half", "v").distinct()
    assert names.where("family is null or anchor_state is null or outcome is null or band not between 0 and 4").count() == 0
    assert names.select("outcome").distinct().count() == 9 and names.where("band is not null").count() > 0
