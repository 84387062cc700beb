"""Known vectors of statistics, portfolios, gates and catalogues."""

import math
import random

import pytest
from pyspark.sql import functions as F

from causaltape.functions.clock import floor_bucket, rfc3339_ns
from causaltape.functions.scalars import valid_identity
from causaltape.operators import catalog, matching, portfolio, quality, statistics


def test_false_discovery_known_vector_with_missing(spark):
    t = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, None)], "id int, p double")
    got = {r["id"]: r["adjusted"] for r in statistics.false_discovery(t, "p").collect()}
    assert got[0] == pytest.approx(0.04) and got[1] == pytest.approx(0.16 / 3) and got[2] == pytest.approx(0.16 / 3) and got[3] is None
    assert statistics.false_discovery(t.where("p is null"), "p").collect()[0]["rejected"] is None


def test_survival_ties_share_the_set_at_risk(spark):
    o = spark.createDataFrame([(1, True), (1, True), (2, False), (3, True)], "t int, e boolean")
    got = [(r["t"], r["at_risk"], round(r["survival"], 9)) for r in statistics.survival(o, "t", "e").orderBy("t").collect()]
    assert got == [(1, 4, 0.5), (2, 2, 0.5), (3, 1, 0.0)]
    assert all(r["survival"] == 1.0 for r in statistics.survival(o.withColumn("e", F.lit(False)), "t", "e").collect())


def test_drawdown_of_a_total_loss_and_over_years(spark):
    df = spark.createDataFrame([("a", "2020-12-30", 0.5), ("a", "2021-01-02", -0.5), ("a", "2021-01-03", 0.1), ("b", "2020-01-01", 0.1), ("c", "2020-01-01", -1.0), ("c", "2020-01-02", None)], "s string, d string, r double").withColumn("d", F.to_date("d"))
    got = {r["s"]: r["max_drawdown"] for r in portfolio.drawdown(df, ["s"], "d", "r").collect()}
    assert got["a"] == pytest.approx(0.5) and got["b"] == 0 and got["c"] == 1


def test_greedy_matching_equals_a_plain_loop(spark):
    t = spark.createDataFrame([("s", i, [float(i % 5)], 1.0) for i in range(10)], "stratum string, id long, covariates array<double>, outcome double")
    c = spark.createDataFrame([("s", 100 + i, [i * 0.7], 0.0) for i in range(8)], t.schema)
    pairs = matching.candidate_pairs(t, c, 1.0)
    used, want = set(), []
    for i in range(10):
        near = sorted((abs(i % 5 - j * 0.7), 100 + j) for j in range(8) if abs(i % 5 - j * 0.7) <= 1.0 and 100 + j not in used)
        if near:
            used.add(near[0][1])
            want.append((i, near[0][1]))
    assert sorted((r["treated_id"], r["control_id"]) for r in matching.greedy_without_reuse(pairs).collect()) == want
    assert matching.greedy_without_reuse(pairs, max_pairs=2).count() == 2


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_greedy_rounds_equal_a_plain_loop(spark, monkeypatch, few):
    monkeypatch.setattr(matching, "FEW", few)
    rng = random.Random(few)
    rows = [(s, t, 1000 + c, 1.0, 0.0, float(rng.randint(0, 4))) for s in ("x", "y") for t in range(12) for c in rng.sample(range(15), 6)]
    used, done, want = set(), set(), []
    for s, t, c, *_, d in sorted(rows, key=lambda r: (r[0], r[1], r[5], r[2])):
        if (s, t) not in done and (s, c) not in used:
            done.add((s, t))
            used.add((s, c))
            want.append((s, t, c))
    df = spark.createDataFrame(rows, "stratum string, treated_id long, control_id long, treated_outcome double, control_outcome double, distance double")
    assert sorted((r["stratum"], r["treated_id"], r["control_id"]) for r in matching.greedy_without_reuse(df).collect()) == want


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_nearest_control_equals_brute_force(spark, dims):
    rng = random.Random(dims)
    point = lambda: [rng.choice((0.0, 1.0, round(rng.uniform(-9, 9), 2))) for _ in range(dims)]
    schema = "stratum string, id long, covariates array<double>, outcome double, __cell string"
    treated = [(rng.choice("ab"), i, point(), 1.0, "x") for i in range(60)] + [(None, 900, [0.0] * dims, 1.0, "x"), ("a", 901, [None] * dims, 1.0, "x"), ("c", 902, [0.0] * dims, 1.0, "x")]
    controls = [(rng.choice("ab"), 1000 + i, point(), 0.0, "x") for i in range(300)] + [(None, 1900, [0.0] * dims, 0.0, "x"), ("a", 1901, [None] * dims, 0.0, "x")]
    want = []
    for s, i, x, *_ in treated:
        near = [(math.dist(x, y), j) for t, j, y, *_ in controls if s is not None and t == s and None not in x and None not in y and math.dist(x, y) <= 2.5]
        if near:
            want.append((i, min(near)[1], pytest.approx(min(near)[0])))
    got = matching.nearest_control(spark.createDataFrame(treated, schema), spark.createDataFrame(controls, schema), 2.5, dims).collect()
    assert sorted((r["treated_id"], r["control_id"], r["distance"]) for r in got) == want
    assert matching.nearest_control(spark.createDataFrame([], schema), spark.createDataFrame(controls, schema), 2.5, dims).count() == 0


def test_nearest_control_meets_rows_in_proportion(spark, monkeypatch):
    met, plain = [], matching.cell_pairs
    monkeypatch.setattr(matching, "cell_pairs", lambda *a: (met.append(plain(*a).count()), plain(*a))[1])
    found = {}
    for n in (400, 4000):
        met.clear()
        side = lambda k, n=n: spark.range(n).select(F.lit("s").alias("stratum"), F.col("id"), F.array(*[F.pmod(F.xxhash64("id", F.lit(k + j)), F.lit(1 << 20)) / (1 << 20) for j in range(2)]).alias("covariates"), F.lit(0.0).alias("outcome"))
        assert matching.nearest_control(side(0), side(10), 10.0, 2).count() == n
        found[n] = sum(met)
    assert found[4000] <= 12 * found[400] < 400 * 400


def test_null_clock_is_fatal(spark):
    df = spark.createDataFrame([(1, 2), (None, 3)], "a long, b long")
    with pytest.raises(Exception, match="null clock a"):
        quality.development_filter(df, ["a", "b"], 10).count()


def test_clocks(spark):
    texts = {"2024-01-01T00:00:00Z": 1704067200 * 10**9, "2024-01-01T00:00:00.000000001+00:00": 1704067200 * 10**9 + 1, "2024-02-30T00:00:00Z": None, "2024-01-01T00:00:00+24:00": None, "2024-01-01T00:00:00.0000000001Z": None, "2024-01-01": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rfc3339_ns(F.col("t")).alias("ns"))
    assert {r["t"]: r["ns"] for r in df.collect()} == texts
    assert spark.createDataFrame([(-7,), (7,)], "x long").select(floor_bucket(F.col("x"), 5).alias("b")).collect() == [(-10,), (5,)]


def test_identity_rules(spark):
    names = {"a": True, "a-b.c": True, "": False, "a/b": False, "C:x": False, "..": False, " a": False, None: False}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["ok"] for r in df.select("n", valid_identity(F.col("n")).alias("ok")).collect()} == names


def test_lineage_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    got = {(r["node"], r["ancestor"]): r["distance"] for r in catalog.ancestors(e).collect()}
    assert got["a", "a"] == 3 and got["d", "c"] == 3 and len(got) == 12


def test_moments_of_one_value(spark):
    row = spark.createDataFrame([(3.0,)], "x double").agg(*statistics.moments("x")).first()
    assert (row["n"], row["mean"], row["var_samp"], row["var_pop"]) == (1, 3.0, 0.0, 0.0)


def test_pearson_is_null_for_a_constant_side(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (None, 5.0)], "x double, y double")
    assert df.agg(statistics.pearson(F.col("x"), F.col("y")).alias("r")).first()["r"] is None


def test_fingerprint_does_not_depend_on_order(spark):
    df = spark.range(50).select("id", (F.col("id") * 7 % 11).alias("v"))
    assert statistics.table_fingerprint(df).first() == statistics.table_fingerprint(df.orderBy(F.desc("v")).repartition(5)).first()
    assert statistics.table_fingerprint(df).first() != statistics.table_fingerprint(df.withColumn("v", F.col("v") + 1)).first()


def test_stress_with_missing_returns(spark):
    d = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "strategy_id string, capital double")
    s = spark.createDataFrame([("x", {"a": -0.4}), ("y", {"a": 0.1, "b": 0.1})], "scenario_id string, returns map<string,double>")
    got = {r["scenario_id"]: (round(r["portfolio_return"], 9), r["status"]) for r in portfolio.stress(d, s).collect()}
    assert got == {"x": (-0.3, "PARTIAL"), "y": (0.1, "KNOWN")} and math.isclose(sum(r["fraction"] for r in portfolio.shares(d, "capital").collect()), 1)


def test_bootstrap_survives_a_tiny_block_and_one_without_values(spark):
    rows = [("a", 1.0)] * 500 + [("b", 3.0)] * 500 + [("c", 2.0), ("d", None)]
    got = statistics.block_bootstrap(spark.createDataFrame(rows, "block string, v double"), "block", "v", 19, 3).first()
    assert round(got["observed"], 6) == 2.0 and got["draws"] == 19 and 0 < got["p_value"] <= 1


def test_closes_that_do_not_rise_are_refused(spark):
    bars = spark.createDataFrame([("x", 1, 2), ("x", 2, 3), ("y", 1, 5)], "k string, open long, close long")
    assert quality.require_rising(bars, ["k"], "open", "close").count() == 3
    with pytest.raises(ValueError, match="close does not rise"):
        quality.require_rising(bars.unionByName(spark.createDataFrame([("y", 2, 5)], bars.schema)), ["k"], "open", "close")


def test_parts_hand_on_their_count_and_last_key(spark):
    from causaltape.sources import lake

    df = spark.createDataFrame([(0, 1, 1), (0, 5, 2), (1, 4, 3), (2, 6, 4)], "part long, t long, s long")
    got = sorted((r["part"], r["rows"], r["rows_before"], r["follows"]) for r in lake.ordered_parts(df, "part", ["t", "s"]).collect())
    assert got == [(0, 2, 0, True), (1, 1, 2, False), (2, 1, 3, True)]


@pytest.mark.parametrize("block", [4, 5, 1000])
def test_sequences_do_not_depend_on_blocks(spark, block):
    from collections import Counter

    from causaltape.operators import context

    day, labels = 86_400_000_000_000, [("ab", "c", "d")[i * 7 % 3] for i in range(23)]
    rows = [(1, i * day // 5, i, labels[i], i // 10) for i in range(23)] + [(2, 7, 0, "c", 0)]
    got = context.event_sequences(spark.createDataFrame(rows, "k long, t long, s long, label string, month long"), "k", ["t", "s"], "label", "month", "t", block=block)
    grams = [(">".join(labels[i : i + n]), 1, i // 10) for n in range(1, 5) for i in range(24 - n)] + [("c", 2, 0)]
    want = {g: (n, len({k for h, k, _ in grams if h == g}), len({m for h, _, m in grams if h == g})) for g, n in Counter(g for g, _, _ in grams).items()}
    assert {r["sequence"]: (r["n"], r["anchors"], r["months"]) for r in got.collect()} == want


def test_exposure_verdicts(spark):
    from causaltape.operators import context

    def verdict(tick, bar, pairs=30):
        return context.exposure_verdict(spark.createDataFrame([("TICK", 40, tick), ("BAR", pairs, bar)], "domain string, pairs long, effect double"), 30, 1.0).first()["verdict"]

    assert [verdict(2.0, 0.0), verdict(0.5, -1.0), verdict(1.0, 1.0), verdict(0.0, 0.9), verdict(2.0, 2.0, 29)] == ["TICK_DOMAIN_ONLY", "BAR_DOMAIN_ONLY", "BOTH", "NONE", "INCONCLUSIVE"]


def test_greedy_settles_all_at_once_where_no_two_ask_for_one_control(spark, monkeypatch):
    """Every treated row stands near every control, and each is nearest to its own."""
    monkeypatch.setattr(matching, "FEW", 0)
    cuts, cut = [], matching.cut
    monkeypatch.setattr(matching, "cut", lambda df, label: cuts.append(label) or cut(df, label))
    rows = [("x", t, 100 + c, 1.0, 0.0, float(abs(t - c))) for t in range(15) for c in range(15)]
    df = spark.createDataFrame(rows, "stratum string, treated_id long, control_id long, treated_outcome double, control_outcome double, distance double")
    assert sorted((r["treated_id"], r["control_id"]) for r in matching.greedy_without_reuse(df).collect()) == [(t, 100 + t) for t in range(15)]
    assert len(cuts) <= 3


@pytest.mark.parametrize("cell", [3, 40, 1 << 16])
def test_matching_without_reuse_lists_no_pairs(spark, monkeypatch, cell):
    """Equal covariates, more treated rows than controls, and cells of a row or two."""
    monkeypatch.setattr(matching, "CELL", cell)
    monkeypatch.setattr(matching, "candidate_pairs", None)
    rng = random.Random(cell)
    place = lambda: rng.choice((rng.uniform(-3, 3), float(rng.randint(-2, 2)), 0.5, 0.75))
    units = {s: [(i, place()) for i in rng.sample(range(1000), n)] for s, n in (("xt", 60), ("xc", 40), ("yt", 15), ("yc", 70), ("zt", 3), ("wc", 3))}
    want = []
    for s in "xy":
        free = dict(units[f"{s}c"])
        for t, x in sorted(units[f"{s}t"]):
            near = min(((abs(x - y), c) for c, y in free.items() if abs(x - y) <= 1.0), default=None)
            if near:
                del free[near[1]]
                want.append((s, t, near[1], t + 0.5, near[1] + 0.25, pytest.approx(near[0])))
    side = lambda k, o: spark.createDataFrame([(s[0], i, [x], i + o) for s, of in units.items() if s[1] == k for i, x in of] + [(None, 1, [0.0], o), ("x", 2001, [None], o), ("x", 2002, [math.nan], o)], "stratum string, id long, covariates array<double>, outcome double")
    t, c = side("t", 0.5), side("c", 0.25)
    got = matching.nearest_without_reuse(t, c, 1.0)
    assert got.columns == ["stratum", "treated_id", "treated_outcome", "control_id", "control_outcome", "distance"]
    assert sorted((r["stratum"], r["treated_id"], r["control_id"], r["treated_outcome"], r["control_outcome"], r["distance"]) for r in got.collect()) == want
    assert matching.nearest_without_reuse(t.where("false"), c, 1.0).count() == 0


def test_open_controls_are_found_on_both_sides(monkeypatch):
    import numpy as np

    monkeypatch.setattr(matching, "STEP", 4)
    rng = random.Random(1)
    for n in (0, 1, 4, 30):
        ranks = [9] * n
        found = matching.Open(np.array(ranks, int))
        for _ in range(200):
            i, rank = rng.randint(0, n), rng.randint(0, 9)
            assert found.at_or_after(i, rank) == next((k for k in range(i, n) if ranks[k] > rank), None)
            assert found.before(i, rank) == next((k for k in range(i - 1, -1, -1) if ranks[k] > rank), None)
            if n:
                k = rng.randrange(n)
                ranks[k] = rank
                found.hold(k, rank)
