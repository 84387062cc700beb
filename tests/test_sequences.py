"""Families at an anchor, conditioning tables and patterns of events against plain loops."""

import random
import statistics as plain

from causaltape.operators import asof, context, sequences

EVENTS = "k string, t long, s long, l string, v double"


def some_events(rng, n):
    rows = [(rng.choice("xy"), rng.randint(0, 300), i, rng.choice("abcz"), float(i)) for i in range(n)]
    return [*rows, rows[0], ("x", None, n, "a", 1.0), ("x", 5, n + 1, None, 1.0)]


def test_families_equal_a_plain_loop(spark):
    rng = random.Random(3)
    rows = some_events(rng, 60)
    anchors = [(rng.choice("xyw"), rng.randint(-5, 320), rng.randint(0, 60), i) for i in range(38)] + [("x", None, 5, 38), (None, 90, 5, 39)]
    rows.append((None, 80, 99, "a", 1.0))
    a, c = spark.createDataFrame(anchors, "k string, at long, aseq long, id long"), spark.createDataFrame(rows, EVENTS)
    for strict in (True, False):
        got = asof.asof_families(a, c, ["k"], "l", ["a", "b", "q"], "at", "t", "aseq", "s", ["v", "t"], strict, bucket_ns=50)
        want = []
        for k, at, aseq, i in anchors:
            for family in "abq":
                near = [(t, s, v) for kk, t, s, f, v in rows if at is not None and kk == k is not None and f == family and t is not None and ((t, s) < (at, aseq) if strict else t <= at)]
                best = max(near, default=(None, None, None))
                want.append((i, family, best[2], best[0], bool(near)))
        assert sorted(map(tuple, got.select("id", "l", "ctx_v", "ctx_t", "known").collect()), key=repr) == sorted(want, key=repr)
        latest = asof.asof_latest(a, c.where("l = 'a'"), ["k"], "at", "t", "aseq", "s", ["v"], strict, bucket_ns=50).select("id", "ctx_v")
        assert sorted(map(tuple, latest.collect()), key=repr) == sorted(((i, v) for i, f, v, *_ in want if f == "a"), key=repr)
        assert asof.asof_families(a, c.where("false"), ["k"], "l", ["a"], "at", "t", "aseq", "s", ["v"], strict).where("not known").count() == 40
        assert asof.asof_families(a.where("false"), c, ["k"], "l", ["a"], "at", "t", "aseq", "s", ["v"], strict).count() == 0


def follows(events, pattern):
    """Time of the earliest end of the pattern in time-ordered events, or None."""
    at = 0
    for t, _, label in events:
        if label == pattern[at]:
            at += 1
            if at == len(pattern):
                return t
    return None


def test_patterns_equal_a_plain_loop(spark):
    import itertools

    rng = random.Random(11)
    rows = some_events(rng, 90)
    anchors = [(rng.choice("xyw"), rng.randint(-5, 320), i, i % 4 if i else None) for i in range(50)]
    a, e = spark.createDataFrame(anchors, "k string, at long, id long, m long"), spark.createDataFrame(rows, EVENTS)
    wide = e.withColumnsRenamed({"v": "sequence"})
    got = sequences.event_patterns(a, wide, ["k"], "id", "at", "m", "t", "s", "l", ["a", "b", "c"], 60, 3, 4)
    want = {}
    for k, at, _, m in anchors:
        near = sorted({(t, s, f) for kk, t, s, f, _ in rows if kk == k and t is not None and f in tuple("abc") and at < t <= at + 60})
        for n in (1, 2, 3):
            for pattern in itertools.product("abc", repeat=n):
                end = follows(near, pattern)
                if end is not None:
                    want.setdefault(">".join(pattern), []).append((m, (end - at) / 1e9))
    want = {p: (len(x), len({m for m, _ in x} - {None}), round(sum(s for _, s in x) / len(x), 15)) for p, x in want.items() if len(x) >= 4}
    seen = {r["sequence"]: (r["anchors"], r["months"], round(r["mean_span_s"], 15)) for r in got.collect()}
    assert seen == want and len(want) > 15
    assert {r["sequence"] for r in got.where("recurrent").collect()} == {p for p, x in want.items() if x[1] >= 3}
    for left, right in ((a.where("false"), wide), (a, wide.where("false"))):
        assert sequences.event_patterns(left, right, ["k"], "id", "at", "m", "t", "s", "l", ["a"], 60).count() == 0


def test_conditioning_equals_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["p", None]), rng.choice("rs"), i % 3, i % 2, rng.choice([None, rng.gauss(0.3, 1)])) for i in range(900)]
    df = spark.createDataFrame(rows, "cell string, outcome string, month int, half int, v double")
    reference = spark.createDataFrame([("r", 0.1, 2.0)], "outcome string, median double, iqr double")
    got = {(r["cell"], r["outcome"]): r for r in context.conditioning(df, ["cell"], "outcome", "v", "month", "half", reference).collect()}
    blocks = {(r["cell"], r["outcome"], r["month"]): (r["n"], r["median"]) for r in context.month_blocks(df, ["cell"], "outcome", "v", "month").collect()}
    sign = lambda x: (x > 0) - (x < 0)
    assert len(got) == 4
    for (cell, outcome), r in got.items():
        mine = [x for x in rows if x[:2] == (cell, outcome) and x[4] is not None]
        median = plain.median(x[4] for x in mine)
        assert r["n"] == len(mine) and abs(r["median"] - median) < 1e-12
        if outcome == "r":
            assert abs(r["effect"] - (median - 0.1)) < 1e-12 and r["material"] == (abs(median - 0.1) >= 0.2)
        else:
            assert r["effect"] is None and r["material"] is None
        months = [plain.median(x[4] for x in mine if x[2] == m) for m in range(3)]
        halves = [plain.median(x[4] for x in mine if x[3] == h) for h in range(2)]
        agree = sign(halves[0]) == sign(halves[1]) != 0
        assert r["halves_agree"] == agree and r["stable"] == (agree and abs(sum(map(sign, months))) == 3)
        for m in range(3):
            n, value = blocks[cell, outcome, m]
            assert n == sum(x[2] == m for x in mine) and abs(value - months[m]) < 1e-12
    assert context.conditioning(df.where("false"), ["cell"], "outcome", "v", "month", "half", reference).count() == 0
