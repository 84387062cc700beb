"""Null distributions against enumeration, plain loops and exact moments."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causaltape.operators import resampling, statistics


@pytest.mark.parametrize("values_a_part", [1 << 14, 2])
def test_permutation_null_equals_enumeration(spark, monkeypatch, values_a_part):
    monkeypatch.setattr(resampling, "VALUES", values_a_part)
    rows = [("a", True, 5.0), ("a", True, 4.0), ("a", False, 1.0), ("a", False, 2.0), ("a", False, 2.0), ("b", True, 3.0), ("b", False, 0.0), ("b", False, 7.0), ("c", True, 9.0)]
    blocks = {k: [r for r in rows if r[0] == k] for k in "abc"}
    choices = [list(itertools.combinations(range(len(b)), sum(r[1] for r in b))) for b in blocks.values()]
    total, n_t, n_c, ds = sum(r[2] for r in rows), 4, 5, []
    for pick in itertools.product(*choices):
        st = sum(b[i][2] for b, p in zip(blocks.values(), pick, strict=True) for i in p)
        ds.append(st / n_t - (total - st) / n_c)
    observed = 21 / 4 - (total - 21) / 5
    df = spark.createDataFrame([*rows, (None, True, 1.0), ("a", None, 1.0), ("a", False, None)], "block string, g boolean, v double")
    got = resampling.block_permutation_null(df, "block", "g", "v", 4999, 3).first()
    assert got["observed"] == pytest.approx(observed) and got["null_mean"] == pytest.approx(np.mean(ds)) and got["null_sd"] == pytest.approx(np.std(ds))
    exact = np.mean(np.abs(ds) >= abs(observed) - 1e-9)
    assert abs(got["exceedances"] / 4999 - exact) < 5 * (exact * (1 - exact) / 4999) ** 0.5
    assert abs(got["drawn_mean"] - np.mean(ds)) < 5 * np.std(ds) / 4999**0.5 and got["drawn_sd"] == pytest.approx(np.std(ds), rel=0.05)
    again = resampling.block_permutation_null(df.repartition(3), "block", "g", "v", 4999, 3).first()
    assert again["exceedances"] == got["exceedances"] and again["drawn_mean"] == pytest.approx(got["drawn_mean"])


def test_permutation_null_of_many_distinct_values_has_exact_moments(spark, monkeypatch):
    monkeypatch.setattr(resampling, "VALUES", 64)
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.choice("ab"), rng.random() < 0.3, rng.gauss(0, 1)) for _ in range(700)], "block string, g boolean, v double")
    got = resampling.block_permutation_null(df, "block", "g", "v", 999, 5).first()
    assert abs(got["drawn_mean"] - got["null_mean"]) < 5 * got["null_sd"] / 999**0.5 and got["drawn_sd"] == pytest.approx(got["null_sd"], rel=0.12)


def test_permutation_null_without_a_group(spark):
    df = spark.createDataFrame([("a", True, 1.0)], "block string, g boolean, v double")
    for d in (df, df.where("false")):
        got = resampling.block_permutation_null(d, "block", "g", "v", 9, 3).first()
        assert got["observed"] is None and got["p_value"] == 1.0


@pytest.mark.parametrize("run", [1 << 14, 8])
def test_circular_shift_null_equals_a_plain_loop(spark, monkeypatch, run):
    monkeypatch.setattr(resampling, "POSITIONS", run)
    rng = random.Random(run)
    sizes = {"a": 1, "b": 7, "c": 8, "d": 9, "e": 33, "f": 48}
    rows = {g: [(rng.choice((None, 1.0, 5.5)) if rng.random() < 0.2 else rng.gauss(1000, 3), rng.choice((None, 2.0)) if rng.random() < 0.2 else rng.gauss(-50, 9)) for _ in range(n)] for g, n in sizes.items()}
    df = spark.createDataFrame([(g, i, x, y) for g, of in rows.items() for i, (x, y) in enumerate(of)], "g string, i long, x double, y double").repartition(4)
    corr = lambda pairs: np.corrcoef(*zip(*[p for p in pairs if None not in p], strict=True))[0, 1]
    observed, reps = corr([p for of in rows.values() for p in of]), 199
    reach = 0
    for rep in range(reps):
        pairs = []
        for g, of in rows.items():
            shift = int(hashlib.md5(f"13:{rep}:{g}".encode()).hexdigest()[:8], 16) % len(of)
            pairs += [(x, of[(i + shift) % len(of)][1]) for i, (x, _) in enumerate(of)]
        reach += abs(corr(pairs)) >= abs(observed) * (1 - 1e-9)
    got = resampling.circular_shift_null(df, "g", "i", "x", "y", reps, 13).first()
    assert got["observed"] == pytest.approx(observed) and got["exceedances"] == reach and got["p_value"] == (reach + 1) / (reps + 1)


def exchanged(spark, work):
    """Rows that the stages of `work` write to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    got = work()
    return got, sum(n for i, n in stages().items() if i not in before)


def test_labels_dealt_by_row_exchange_rows_near_the_border_alone(spark):
    rows = spark.range(30_000).select("id", F.when(F.col("id") < 40, "few").when(F.col("id") < 45, "all").otherwise("many").alias("b"), (F.col("id") * 37 % 101).cast("double").alias("v"), ((F.col("id") % 3 == 0) | F.col("id").between(40, 44)).alias("g"))
    got, n = exchanged(spark, lambda: statistics.block_permutation(rows, "b", "g", "v", "id", 9, 11).first())
    assert n < 9 * 30_000 / 3
    reps = rows.crossJoin(spark.range(9).select(F.col("id").alias("rep"))).withColumn("d", statistics.draw(11, F.col("rep"), F.col("id"))).collect()
    by, want, over = {}, [], 0
    for r in reps:
        by.setdefault(r["rep"], {}).setdefault(r["b"], []).append((r["d"], r["id"], r["v"], r["g"]))
    for blocks in by.values():
        one, other = [], []
        for found in blocks.values():
            t = sum(x[3] for x in found)
            found.sort()
            one += [x[2] for x in found[:t]]
            other += [x[2] for x in found[t:]]
        want.append(sum(one) / len(one) - sum(other) / len(other))
    over = sum(abs(d) >= abs(got["observed"]) for d in want)
    assert (got["exceedances"], got["draws"], got["p_value"]) == (over, 9, (over + 1) / 10)


def test_sign_flips_equal_a_plain_loop(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 != 0, F.col("id") * 0.25 - 40).alias("v"))
    got = {(r["g"], r["w"]): r["stat"] for r in resampling.sign_flip_means(rows, "g", "id", "v", 70, 5).collect()}
    assert len(got) == 4 * 70
    draws = {(r["id"], r["c"]): r["d"] for r in rows.crossJoin(spark.range(3).select(F.col("id").alias("c"))).select("id", "c", statistics.draw(5, F.col("c"), F.col("id")).alias("d")).collect()}
    kept = [r for r in rows.collect() if r["v"] is not None]
    for (g, w), stat in got.items():
        signed = [r["v"] * (-1 if draws[r["id"], w // 32] >> w % 32 & 1 else 1) for r in kept if r["g"] == g]
        assert abs(stat - sum(signed) / len(signed)) < 1e-9


def test_packed_rows_become_objects_one_at_a_time():
    import tracemalloc

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([np.arange(16_384.0)] * 100), pa.array(range(100))], ["x", "no"])
    tracemalloc.start()
    assert [float(np.sum(r["x"])) for r in resampling.one_by_one(batch)] == [16_384 * 16_383 / 2] * 100
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()


def test_circular_shifts_exchange_bytes_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(resampling, "POSITIONS", 2048)
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def written():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    mb = []
    for n in (8_000, 64_000):
        before = written()
        noise = [(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 30)) / (1 << 30)).alias("xy"[k]) for k in (0, 1)]
        resampling.circular_shift_null(spark.range(n).select(F.lit("g").alias("g"), "id", *noise), "g", "id", "x", "y", 199, 13).collect()
        mb.append((written() - before) / 2**20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert mb[1] < 12 * mb[0]


def test_circular_shifts_with_nulls_on_either_side(spark, monkeypatch):
    """Groups of which no side, x, y or all of x has nulls; rows of a null group take no part."""
    monkeypatch.setattr(resampling, "POSITIONS", 16)
    rng = random.Random(5)
    pick = lambda share, v: None if rng.random() < share else v
    rows = {g: [(pick(a, rng.gauss(7, 3)), pick(b, rng.gauss(-5, 9))) for _ in range(n)] for g, n, a, b in ((1, 60, 0, 0), (2, 41, 0.3, 0), (3, 37, 0, 0.3), (4, 9, 1, 0))}
    df = spark.createDataFrame([(g, i, x, y) for g, of in rows.items() for i, (x, y) in enumerate(of)] + [(None, i, 99.0 * i, 1.0) for i in range(9)], "g long, i long, x double, y double")
    corr = lambda pairs: np.corrcoef(*zip(*[p for p in pairs if None not in p], strict=True))[0, 1]
    observed, reach = corr([p for of in rows.values() for p in of]), 0
    for rep in range(99):
        pairs = []
        for g, of in rows.items():
            shift = int(hashlib.md5(f"13:{rep}:{g}".encode()).hexdigest()[:8], 16) % len(of)
            pairs += [(x, of[(i + shift) % len(of)][1]) for i, (x, _) in enumerate(of)]
        reach += abs(corr(pairs)) >= abs(observed) * (1 - 1e-9)
    got = resampling.circular_shift_null(df, "g", "i", "x", "y", 99, 13).first()
    assert got["observed"] == pytest.approx(observed) and got["exceedances"] == reach
    assert resampling.circular_shift_null(df.where("false"), "g", "i", "x", "y", 99, 13).first()["exceedances"] == 0
