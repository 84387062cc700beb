"""Interval joins and exposures against plain loops."""

import random

from causaltape.operators import evaluation, intervals


def test_pairs_of_any_lengths_equal_a_plain_loop(spark):
    rng = random.Random(8)

    def some(n):
        rows = []
        for i in range(n):
            start = rng.randint(-5000, 5000)
            rows.append((rng.choice("xy"), i, start, start + rng.choice((0, -3, 1, 2, 3, 4, 8, 9, 1 << rng.randint(0, 13), rng.randint(1, 9000)))))
        return [*rows, (None, n, 0, 10**9), ("x", n + 1, None, 5), ("x", n + 2, 5, None), ("y", n + 3, -(1 << 62), 1 << 61), ("y", n + 4, (1 << 60) - 1, 1 << 60)]

    a, b = some(120), some(90)
    schema = "k string, id long, s long, e long"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    meets = lambda p, q: None not in p + q and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and q[2] < p[3]
    got = [(r["id"], r["r_id"]) for r in intervals.overlapping_pairs(left, right, ["k"], "s", "e").collect()]
    assert sorted(got) == sorted((p[1], q[1]) for p in a for q in b if meets(p, q) and p[0] == q[0])
    got = [(r["id"], r["r_id"]) for r in intervals.overlapping_pairs(left.where("k is not null"), right.where("k is not null"), [], "s", "e").collect()]
    assert sorted(got) == sorted((p[1], q[1]) for p in a for q in b if meets(p, q))
    assert intervals.overlapping_pairs(left.where("false"), right, ["k"], "s", "e").count() == 0
    assert intervals.overlapping_pairs(left, right, ["k"], "s", "e").columns == ["k", "id", "s", "e", "r_k", "r_id", "r_s", "r_e"]


def test_exposures_by_their_turn(spark):
    c, s, p = evaluation.CONFIRMATION, *evaluation.HOLDOUTS
    rows = [(1, c, 0, 10, 5), (2, s, 5, 15, 6), (3, s, 5, 15, 4), (4, p, 9, 12, 5), (5, p, 10, 12, 9), (6, c, 500, 600, 1), (7, s, 0, 50, 3), (8, "exploration", 0, 50, 3), (0, s, 0, 3, 5), (9, c, 2, 4, 8)]
    e = spark.createDataFrame([(1, *r) for r in rows], "instrument long, exposure long, role string, start_ns long, end_ns long, exposed_ns long")
    leaves = spark.createDataFrame([(1, f"{n}-{r}", r, 0, 100) for n in "ba" for r in (c, s, p)], "instrument long, leaf string, role string, start_ns long, end_ns long")
    got = {r["exposure"]: (r["leaf"], r["verdict"], r["source"]) for r in evaluation.exposure_history(e, leaves, ["instrument"]).collect()}
    assert got == {
        1: (f"a-{c}", "ACCEPTED", None), 2: (f"a-{s}", "CONTAMINATED", 1), 3: (f"a-{s}", "ACCEPTED", None), 4: (f"a-{p}", "CONTAMINATED", 1), 5: (f"a-{p}", "ACCEPTED", None),
        6: (None, "NO_LEAF", None), 7: (f"a-{s}", "ACCEPTED", None), 8: (None, "NO_LEAF", None), 0: (f"a-{s}", "ACCEPTED", None), 9: (f"a-{c}", "ACCEPTED", None),
    }


def test_pairs_within_a_table_equal_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), rng.randrange(400), t := rng.randint(-50, 50), t + rng.choice((0, -3, 1, 2, 9, rng.randint(1, 90)))) for _ in range(300)]
    rows += [(None, 1, 0, 9), ("x", None, 0, 9), ("x", 3, None, 9), ("x", 4, 0, None)]
    df = spark.createDataFrame(rows, "k string, id long, s long, e long")
    meets = lambda p, q: None not in p + q and p[0] == q[0] and p[1] < q[1] and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and q[2] < p[3]
    want = sorted((p[0], p[1], q[1]) for p in rows for q in rows if meets(p, q))
    for block in (1, 7, 2048):
        assert sorted(tuple(r) for r in intervals.pairs_within(df, ["k"], "id", "s", "e", block).collect()) == want
    assert intervals.pairs_within(df.where("false"), ["k"], "id", "s", "e").count() == 0


def test_pairs_of_unique_names_are_not_compared_one_by_one(spark):
    rows = [("x", i, i % 7, i % 7 + i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, id long, s long, e long")
    meets = sorted((p[0], p[1], q[1]) for p in rows for q in rows if p[1] < q[1] and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and q[2] < p[3])
    for spans, compared in ((df, False), (df.unionByName(df.where("id < 9")), True)):
        pairs = intervals.pairs_within(spans, ["k"], "id", "s", "e", 4)
        assert sorted({tuple(r) for r in pairs.collect()}) == meets
        counted = pairs.groupBy().count()
        assert counted.first()[0] == pairs.count() >= len(meets)
        assert ("least(__name" in counted._jdf.queryExecution().optimizedPlan().toString()) == compared
