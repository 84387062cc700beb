"""Exact selection and sketches against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from causaltape.operators import quantiles

PROBABILITIES = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q99": 0.99, "q100": 1.0}


def plain(values, p):
    values = sorted(v for v in values if v is not None and not math.isnan(v))
    if not values:
        return None
    at = p * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if low == high else low + (at - math.floor(at)) * (high - low)


@pytest.mark.parametrize("k", [8, 2048])
def test_exact_quantiles_equal_sorted_lists(spark, k):
    r = random.Random(5)
    groups = {
        "hot": [r.lognormvariate(0, 9) for _ in range(3000)], "ties": [float(r.randrange(3)) for _ in range(500)], "one": [7.5, None], "none": [None, float("nan")],
        None: [-1e300, 1e300, 0.0, -0.0, 5e-324, float("inf"), float("nan"), None], "same": [2.0] * 40,
    }
    rows = spark.createDataFrame([(g, v, "x") for g, vs in groups.items() for v in vs], "g string, v double, n string")
    got = {row["g"]: row for row in quantiles.exact(rows, ["g"], "v", PROBABILITIES, k).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g]["n"] == sum(v is not None and not math.isnan(v) for v in values)
        for name, p in PROBABILITIES.items():
            want = plain(values, p)
            assert (got[g][name] is None) == (want is None) and (want is None or math.isclose(got[g][name], want, rel_tol=1e-12)), (g, name)


def test_whole_table_without_groups_and_empty_table(spark):
    rows = spark.range(1001).select((F.col("id") * 37 % 1001).cast("double").alias("v"))
    assert quantiles.exact(rows, [], "v", {"m": 0.5, "q": 0.25}, 8).first().asDict() == {"n": 1001, "m": 500.0, "q": 250.0}
    assert quantiles.exact(rows.where("v < 0").withColumn("g", F.lit(1)), ["g"], "v", {"m": 0.5}).count() == 0


def test_no_round_leaves_more_than_a_hundredth(spark, monkeypatch):
    sizes = []
    real = quantiles.cut
    monkeypatch.setattr(quantiles, "cut", lambda df, label: (lambda t: (sizes.append(t.agg(F.max("size")).first()[0]) if label == "selection" else None, t)[1])(real(df, label)))
    rows = spark.range(400_000).select((F.xxhash64("id") / 1e9).alias("v"))
    quantiles.exact(rows, [], "v", {"m": 0.5})
    assert len(sizes) <= 3 and sizes[0] <= 4000


def test_sketch_stays_within_its_rank_error(spark):
    rows = spark.range(300_000).select((F.col("id") % 3).alias("g"), F.exp(F.xxhash64("id") / 2e18).alias("v"), F.lit(1).alias("n_"))
    for row in quantiles.sketched(rows, ["g"], "v", {"q25": 0.25, "q99": 0.99}).collect():
        assert row["n"] == 100_000
        for name, p in (("q25", 0.25), ("q99", 0.99)):
            rank = rows.where((F.col("g") == row["g"]) & (F.col("v") <= row[name])).count() / 100_000
            assert abs(rank - p) < 0.005
    empty = spark.createDataFrame([("a", None), ("a", float("nan"))], "g string, v double")
    assert quantiles.sketched(empty, ["g"], "v", {"m": 0.5}).first().asDict() == {"g": "a", "n": 0, "m": None}


def test_medians_of_several_groupings_equal_sorted_lists(spark):
    r = random.Random(8)
    values = {"hot": lambda: r.lognormvariate(0, 9) * r.choice([1, -1]), "near": lambda: 1000 + r.random() / 1e6, "ties": lambda: float(r.randrange(-1, 2)), "edges": lambda: r.choice([-1e300, 1e300, 0.0, -0.0, 5e-324, -5e-324, float("inf")]), None: lambda: r.choice([None, 3.5, 4.25])}
    rows = [(g, m, v()) for g, v in values.items() for m in (1, 2, None) for _ in range(r.randrange(40, 90))] + [("none", 1, None), ("one", 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, m int, v double").repartition(7)
    for by, got in zip(([0, 1], [0], [1]), quantiles.medians(df, [["g", "m"], ["g"], ["m"]], "v"), strict=True):
        want = {}
        for row in rows:
            if row[2] is not None:
                want.setdefault(tuple(row[i] for i in by), []).append(row[2])
        seen = {tuple(x[:-2]): (x["n"], x["median"]) for x in got.collect()}
        assert seen == {g: (len(x), plain(x, 0.5) if plain(x, 0.5) in x else 0.5 * sorted(x)[(len(x) - 1) // 2] + 0.5 * sorted(x)[len(x) // 2]) for g, x in want.items()}
    assert [x.count() for x in quantiles.medians(df.where("false"), [["g"], []], "v")][0] == 0


def test_medians_hand_on_few_values_twice(spark):
    """`percentile` exchanged every value of a group; only those of the bins that hold a middle are."""
    rows = spark.range(100_000).select((F.col("id") % 3).alias("g"), F.expr("pow(1.0001, id)").alias("v"))
    (got,) = quantiles.medians(rows, [["g"]], "v")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    files = {f for f in got.inputFiles() if "/middles-" in f}
    assert 0 < spark.read.parquet(*files).count() < 2_000
