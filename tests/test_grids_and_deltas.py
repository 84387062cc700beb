"""Ordered union, version deltas, comparison grid, legacy run and the thirteen checks on small scenarios."""

import random

import pytest
from pyspark.sql import functions as F

from causaltape.operators import catalog, merge, population


@pytest.mark.parametrize("ranges", [1, 5])
def test_ordered_union_numbers_all_rows_in_order(spark, ranges):
    r = random.Random(3)
    a = [(r.choice([None, 1, 1, 1, 7]), i, "x") for i in range(300)]
    b = [(r.choice([None, 1, 2]), i) for i in range(200)]
    got = merge.ordered({"a": spark.createDataFrame(a, "t int, seq int, extra string"), "b": spark.createDataFrame(b, "t int, seq int"), "none": spark.createDataFrame([], "t int, seq int")}, ["t", "seq"], ranges=ranges).collect()
    want = sorted([(t is not None, t or 0, s, "a") for t, s, _ in a] + [(t is not None, t or 0, s, "b") for t, s in b])
    assert [(x["t"] is not None, x["t"] or 0, x["seq"], x["kind"]) for x in sorted(got, key=lambda x: x["place"])] == want
    assert sorted(x["place"] for x in got) == list(range(1, 501))
    assert all((x["extra"] == "x") == (x["kind"] == "a") for x in got)


def test_version_delta_names_scope_and_arrays(spark):
    schema = "id int, version string, scales array<string>, instrument string, dataset string, other int"
    before = spark.createDataFrame([(1, "a", ["1h"], "i", "d", 0), (2, "a", ["1h"], "i", None, 0), (3, "a", ["1h"], "i", "d", 0), (4, None, ["1h"], "i", "d", 0)], schema)
    after = spark.createDataFrame([(1, "a", ["1h"], "i", "d", 9), (2, "a", ["1h", "4h"], "i", "", 0), (3, "b", ["1h"], "j", "d", 0), (5, "a", None, None, None, 0)], schema)
    got = {(r["id"], r["surface"]): (r["expected"], r["actual"]) for r in catalog.version_delta(before, after, "id", ["version", "scales"], ("instrument", "dataset")).collect()}
    assert got == {
        (2, "scales"): ("[1h]", "[1h, 4h]"), (2, catalog.SCOPE): ("i:", "i:"), (3, "version"): ("a", "b"), (3, catalog.SCOPE): ("i:d", "j:d"), (4, "scales"): ("[1h]", None), (4, catalog.SCOPE): ("i:d", None),
        (5, "version"): (None, "a"), (5, catalog.SCOPE): (None, ":"),
    }
    verdicts = {r["id"]: (r["verdict"], r["changed"]) for r in catalog.compatibility(before, after, "id", ["version"], ("instrument", "dataset")).collect()}
    assert verdicts[1] == ("COMPATIBLE", []) and verdicts[3] == ("DELTA_REQUIRED", [catalog.SCOPE, "version"]) and set(verdicts) == {1, 2, 3, 4, 5}
    assert catalog.version_delta(before.where("id < 0"), after.where("id < 0"), "id", ["version"], ("instrument", "dataset")).count() == 0


def grid(spark, lineage=(), limit=100, allowed=True, context_scales=("1h", "9h"), role="state"):
    a = spark.createDataFrame([("a", "r", ["1h", "4h"])], "anchor string, role string, scales array<string>")
    c = spark.createDataFrame([("c", role, list(context_scales), allowed), ("a", role, ["1h"], True)], "context string, context_role string, context_scales array<string>, allowed boolean")
    o = spark.createDataFrame([("corr", ["state"], ["up", "down"]), ("lag", ["state", "event"], ["both"])], "operator string, roles array<string>, directions array<string>")
    return population.comparison_grid(a, c, o, spark.createDataFrame(list(lineage), "ancestor string, descendant string"), ["1h", "4h"], limit).collect()


def test_grid_crosses_scales_and_directions(spark):
    rows = grid(spark)
    assert sorted((r["operator"], r["anchor_scale"], r["context_scale"], r["direction"], r["same_scale"], r["reason"]) for r in rows) == [
        ("corr", "1h", "1h", "down", True, None), ("corr", "1h", "1h", "up", True, None), ("corr", "4h", "1h", "down", False, None), ("corr", "4h", "1h", "up", False, None),
        ("lag", "1h", "1h", "both", True, None), ("lag", "4h", "1h", "both", False, None),
    ]
    assert [(r["operator"], r["direction"]) for r in grid(spark, limit=4) if r["reason"] == "BOUNDED_OUT"] == [("lag", "both")] * 2
    assert {r["operator"] for r in grid(spark, role="event")} == {"lag"}


@pytest.mark.parametrize(("change", "reason"), [
    ({"allowed": False, "context_scales": (), "role": "zone"}, "PERMISSION_DENIED"), ({"allowed": None}, "PERMISSION_DENIED"), ({"context_scales": ("9h",), "role": "zone"}, "NO_ALLOWED_CONTEXT_SCALE"), ({"context_scales": ()}, "NO_ALLOWED_CONTEXT_SCALE"),
    ({"lineage": [("a", "c")], "role": "zone"}, "LINEAGE_DEPENDENT"), ({"lineage": [("c", "a")]}, "LINEAGE_DEPENDENT"), ({"lineage": [("x", "a"), ("x", "c")]}, "LINEAGE_DEPENDENT"), ({"role": "zone"}, "INCOMPATIBLE_OPERATOR"),
])
def test_grid_rejects_a_context_once_with_its_first_reason(spark, change, reason):
    rows = grid(spark, **change)
    assert [(r["context"], r["operator"], r["reason"]) for r in rows] == [("c", None, reason)]


def test_legacy_run_splits_domains_and_characterises_candidates(spark):
    rows = [("p", "positive", "1h", "1h", 100, 90, 1.0, 2.0), ("p", "positive", "1h", "1h", 100, 50, 2.0, 5.0), ("p", "positive", "4h", "1h", 100, 95, -3.0, 1.0), ("p", "positive", "4h", "1h", 100, None, 1.0, None), ("p", "positive", "1h", "1h", 9, 9, None, 1.0),
            ("n", "negative", "1h", "4h", 100, 99, 1.0, -2.0), ("n", "negative", "1h", "4h", 100, 98, 2.0, 0.0), ("b", "bidirectional", "1h", "4h", 100, 99, 0.0, 1.0), ("b", "bidirectional", "1h", "4h", 100, 99, 2.0, 3.0), ("k", "positive", "1h", "1h", 5, None, 1.0, None)]
    df = spark.createDataFrame(rows, "detector string, direction string, scale string, context_scale string, anchor_time long, available_time long, value double, context_value double")
    got = {r["detector"]: r for r in population.legacy_run(df, "detector", "direction", "scale", "context_scale").collect()}
    assert {d: r["domain"] for d, r in got.items()} == {"p": "same_domain", "n": "cross_domain", "b": "cross_domain", "k": "cross_domain"}
    assert {d: (r["observations"], r["concordant"], r["discordant"], r["min_lag_ns"], r["max_lag_ns"]) for d, r in got.items()} == {"p": (3, 2, 1, 5, 50), "n": (2, 1, 1, 1, 2), "b": (2, 1, 1, 1, 1), "k": (0, None, None, None, None)}
    assert got["k"]["status"] == "INCONCLUSIVE" and got["k"]["candidate"] is None and got["p"]["candidate"].startswith("candidate-")
    assert population.legacy_run(df.where("anchor_time < 0"), "detector", "direction", "scale", "context_scale").count() == 0


GOOD = {
    "evidence_id": "e", "sample_size": 10, "metric": 0.5, "violations": 0, "denominator": 10, "source_ids": ["a", "b"], "control_identity": "c", "block_count": 2, "family_count": 1, "fit_end_ns": 1, "evaluation_start_ns": 2,
    "perturbation_count": 2, "max_sample_share": 0.4, "alternatives": ["x"],
}
SCHEMA = "kind string, evidence_id string, sample_size long, metric double, violations long, denominator long, source_ids array<string>, control_identity string, block_count long, family_count long, fit_end_ns long, evaluation_start_ns long, perturbation_count long, max_sample_share double, alternatives array<string>"
BREAKS = {
    "lookahead": {"violations": 1}, "population_conditioning": {"denominator": 0}, "denominator_errors": {"violations": 3}, "selection_bias": {"source_ids": ["a"]}, "lineage_duplication": {"source_ids": ["a", "a"]}, "false_confluence": {"source_ids": []},
    "bad_controls": {"control_identity": ""}, "temporal_dependence": {"block_count": 1}, "multiple_testing": {"family_count": 0}, "normalization_leakage": {"fit_end_ns": 3}, "fragility": {"perturbation_count": 1}, "sample_concentration": {"max_sample_share": 0.5},
    "alternative_explanations": {"alternatives": []},
}


def card(spark, changes):
    rows = [tuple({"kind": k, **GOOD, **changes.get(k, {})}.values()) for k in population.CHECKS]
    return {r["kind"]: r["verdict"] for r in population.scorecard(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_each_check_fails_by_its_own_fault_alone(spark):
    assert set(card(spark, {}).values()) == {"PASSED"} and set(BREAKS) == set(population.CHECKS)
    assert set(card(spark, BREAKS).values()) == {"FAILED"}
    shared = {k: {"evidence_id": ""} if i % 3 == 0 else {"sample_size": 0} if i % 3 == 1 else {"metric": float("nan")} for i, k in enumerate(population.CHECKS)}
    assert set(card(spark, shared).values()) == {"FAILED"}
    nulls = {k: dict.fromkeys(BREAKS[k]) for k in population.CHECKS}
    assert set(card(spark, nulls).values()) == {"FAILED"}


def test_each_fault_is_seen_by_no_check_that_does_not_look_at_it(spark):
    for k in ("bad_controls", "temporal_dependence", "multiple_testing", "normalization_leakage", "sample_concentration", "alternative_explanations"):
        everywhere = {c: BREAKS[k] for c in population.CHECKS}
        assert {c for c, v in card(spark, everywhere).items() if v == "FAILED"} == {k}
