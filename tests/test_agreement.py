"""Classes of agreement, ends of episodes and agreement of scales against plain loops."""

import random

from causaltape.operators import context, lifecycle


def test_each_class_of_agreement(spark):
    live = [("a", "S", 50, True), ("b", "S", 50, True), ("c", "S", 50, True), ("d", "S", 60, False), ("e", "S", 60, False), ("f", "S", 60, False), ("g", "S", 60, False), ("h", "S", None, False), ("j", "S", 50, True)]
    emitted = [("a", "S", 50), ("b", "S", 40), ("c", "S", 55), ("d", "S", 60), ("e", "S", 61), ("h", "S", None), ("i", "S", 70), ("g", "S", 40)]
    tracks = [(k, k in "abcgj", 50) for k in "abcdefghij"]
    got = lifecycle.agreement_classes(spark.createDataFrame(live, "k string, s string, live_ms long, absorbed boolean"), spark.createDataFrame(emitted, "k string, s string, emitted_ms long"), spark.createDataFrame(tracks, "k string, left_truncated boolean, leaf_first_ms long"), ["k", "s"], ["k"])
    want = {"a": "BOUNDARY_AMBIGUOUS", "b": "EXCLUDED_LEFT_TRUNCATED", "c": "VALUE_MISMATCH", "d": "MATCHED", "e": "VALUE_MISMATCH", "f": "SPURIOUS", "g": "EXCLUDED_LEFT_TRUNCATED", "h": "NULL_AGREEMENT", "i": "MISSING", "j": "EXCLUDED_LEFT_TRUNCATED"}
    assert {r["k"]: r["class"] for r in got.collect()} == want


def test_ends_of_episodes_and_lists_of_states(spark):
    tape = [(0, "BURST", 1), (1, "DYING", 1), (2, "BURST", 2), (3, "IDLE", None), (4, "IDLE", None), (5, "DEVELOPING", None), (6, "BURST", 3), (7, "BURST", 3)]
    rows = lifecycle.episodes(spark.createDataFrame([("x", t, t, s, e) for t, s, e in tape], "k string, received_ts_ns long, source_sequence long, state string, eid long"), ["k"])
    ended = {r["episode"]: (r["entry_state"], r["last_state"], r["end_reason"]) for r in lifecycle.terminations(rows, ["k"]).collect()}
    assert ended == {1: ("BURST", "DYING", "NEW_EPISODE"), 2: ("BURST", "BURST", "WENT_IDLE"), 3: ("DEVELOPING", "BURST", "RIGHT_CENSORED")}
    listed = {r["episode"]: (r["states"], r["changes"]) for r in lifecycle.transition_lists(lifecycle.state_runs(rows, ["k"]), ["k"]).collect()}
    assert listed == {1: (["BURST", "DYING"], 1), 2: (["BURST"], 0), 3: (["DEVELOPING", "BURST"], 1)}
    assert lifecycle.terminations(rows.where("false"), ["k"]).count() == 0


def test_scales_equal_a_plain_loop(spark):
    rng = random.Random(2)
    scales, day = ["s", "m", "l"], 86_400_000_000_000
    rows = [(rng.choice(["x", None]), i, rng.choice(scales), rng.randint(0, 60) * day // 10, rng.choice((1, -1))) for i in range(120)]
    df = spark.createDataFrame([*rows, ("x", 900, "s", None, 1), ("x", 901, "q", 5, 1)], "k string, id long, scale string, t long, side int")
    got = {r["id"]: r for r in context.scale_agreement(df, ["k"], "scale", scales, "t", "side", day // 5, day // 2).collect()}
    rows = [r for r in rows if r[0]]
    assert len(got) == len(rows)
    for k, i, scale, t, side in rows:
        at = scales.index(scale)
        of = lambda n, k=k: [(u, d) for kk, _, s, u, d in rows if kk == k and 0 <= n < 3 and s == scales[n]]

        def relation(n, t=t, of=of):
            near = min((abs(u - t) for u, _ in of(n)), default=None)
            if near is None or near > day // 5:
                return "NONE"
            return "COINCIDES" if near == 0 else "FOLLOWS" if any(t - u == near for u, _ in of(n)) else "PRECEDES"

        last = max((u for u, d in of(at) if d != side and u <= t), default=None)
        assert got[i]["since_opposing_ns"] == (None if last is None else t - last)
        assert (got[i]["vs_coarser"], got[i]["vs_finer"]) == (relation(at + 1), relation(at - 1))
        assert got[i]["contradicted"] == any(d != side and t <= u <= t + day // 2 for u, d in of(at + 1))
