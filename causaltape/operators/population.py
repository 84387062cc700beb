"""Population research: denominators, gates, comparison grids, scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causaltape.operators.statistics import concordance, pearson


def discover(joined: DataFrame, by: list[str], anchor_time: str = "anchor_time", available: str = "available_time", value: str = "value", context_value: str = "context_value") -> DataFrame:
    """Metrics and their denominators per group, from anchors left-joined to a requested context. An anchor without
    context, or with a missing value, stays in the population and is counted where it drops out."""
    has, x, y = F.col(available).isNotNull(), F.col(value), F.col(context_value)
    pair = has & x.isNotNull() & y.isNotNull()
    zero = pair & ((x == 0) | (y == 0))
    return joined.groupBy(*by).agg(
        F.count("*").alias("population"), F.count(available).alias("present"), F.count_if(~has).alias("missing_context"), F.count_if(has & x.isNull()).alias("missing_anchor_value"),
        F.count_if(has & x.isNotNull() & y.isNull()).alias("missing_context_value"), F.count_if(zero).alias("zero_excluded"), F.count_if(pair & ~zero).alias("observations"),
        F.avg(F.col(anchor_time) - F.col(available)).alias("mean_lag_ns"), pearson(x, y).alias("pearson"), concordance(x, y).alias("concordance"),
    )


def candidate_gate(metrics: DataFrame, gates: DataFrame, on: list[str], metric: str, support: str = "observations") -> DataFrame:
    """Adds `eligible` and `reason`: a metric passes if its gate asks for no more support and size than it has."""
    joined = metrics.join(gates, on, "left")
    passed = F.coalesce((F.col(support) >= F.col("min_support")) & (F.abs(metric) >= F.col("min_abs_metric")), F.lit(False))
    reason = F.when(F.col("min_support").isNull(), "NO_PREDECLARED_GATE").when(passed, "PREDECLARED_GATE_PASSED").otherwise("PREDECLARED_GATE_NOT_PASSED")
    return joined.withColumn("eligible", passed).withColumn("reason", reason)


def causal_violations(time: Column, available: Column, value: Column, identity: Column) -> Column:
    """The rules that a record breaks, as an array of names."""
    rules = [
        (time.isNull() | (time < 0), "BAD_TIME"), (available.isNull() | (available < 0), "NO_AVAILABILITY"), (available > time, "NOT_YET_KNOWN"),
        (F.isnan(value) | (F.abs(value) == float("inf")), "NOT_FINITE"), (F.coalesce(F.trim(identity), F.lit("")) == "", "NO_IDENTITY"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for bad, name in rules]), lambda r: r.isNotNull())


def comparison_grid(anchors: DataFrame, contexts: DataFrame, operators: DataFrame, lineage: DataFrame, allowed_scales: list[str], limit: int) -> DataFrame:
    """All comparisons (anchor, context, operator, anchor_scale, context_scale, direction, same_scale, reason).

    anchors (anchor, role, scales), contexts (context, context_role, context_scales, allowed), operators (operator,
    roles, directions), lineage (ancestor, descendant; its closure). A context that is rejected as a whole is one row with
    its reason and no operator, the first that holds of: PERMISSION_DENIED, NO_ALLOWED_CONTEXT_SCALE (none of its scales is
    in allowed_scales), LINEAGE_DEPENDENT (one is derived from the other, or both from a third), INCOMPATIBLE_OPERATOR (no
    operator takes its role). Each other context gives a row per operator that takes its role, scale of the anchor,
    allowed scale of the context and direction of the operator; of an anchor's rows those beyond `limit`, in this order,
    are BOUNDED_OUT and the others have no reason. Repeated declarations count once. An anchor without scales gives no
    comparison. Inputs are declarations, so the grid is as large as what was asked for; it is windowed by anchor."""
    related = lineage.select(F.col("ancestor").alias("__a"), F.col("descendant").alias("__d"))
    common = related.select("__a", F.col("__d").alias("x")).join(related.select("__a", F.col("__d").alias("y")), "__a").where("x <> y")
    pairs = related.select(F.col("__a").alias("x"), F.col("__d").alias("y"))
    pairs = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(common.select("x", "y")).distinct().withColumn("__rel", F.lit(True))
    scales = F.array_intersect("context_scales", F.array(*[F.lit(s) for s in allowed_scales]).cast("array<string>"))
    asked = anchors.distinct().join(contexts.distinct(), F.col("anchor") != F.col("context")).withColumn("__scales", scales)
    asked = asked.join(pairs, (F.col("anchor") == F.col("x")) & (F.col("context") == F.col("y")), "left").drop("x", "y")
    judged = asked.withColumn("reason", F.when(~F.coalesce("allowed", F.lit(False)), "PERMISSION_DENIED").when(F.coalesce(F.size("__scales"), F.lit(0)) <= 0, "NO_ALLOWED_CONTEXT_SCALE").when(F.col("__rel"), "LINEAGE_DEPENDENT"))
    takes = judged.where("reason is null").join(operators.distinct(), F.array_contains("roles", F.col("context_role")))
    lost = judged.where("reason is null").join(operators, F.array_contains("roles", F.col("context_role")), "left_anti").withColumn("reason", F.lit("INCOMPATIBLE_OPERATOR"))
    none = F.lit(None).cast("string")
    whole = judged.where("reason is not null").unionByName(lost).select("anchor", "context", none.alias("operator"), none.alias("anchor_scale"), none.alias("context_scale"), none.alias("direction"), F.lit(None).cast("boolean").alias("same_scale"), "reason")
    cells = takes.withColumn("anchor_scale", F.explode(F.array_distinct("scales"))).withColumn("context_scale", F.explode("__scales")).withColumn("direction", F.explode(F.array_distinct("directions")))
    place = F.row_number().over(Window.partitionBy("anchor").orderBy("context", "operator", "anchor_scale", "context_scale", "direction"))
    rows = cells.select("anchor", "context", "operator", "anchor_scale", "context_scale", "direction", (F.col("anchor_scale") == F.col("context_scale")).alias("same_scale"), F.when(place > limit, "BOUNDED_OUT").alias("reason"))
    return rows.unionByName(whole)


def legacy_run(joined: DataFrame, by: str, direction: str, scale: str, context_scale: str, anchor_time: str = "anchor_time", available: str = "available_time", value: str = "value", context_value: str = "context_value", digits: int = 9) -> DataFrame:
    """One row per requested context: its domain, discovery, candidate and characterisation.

    same_domain if the context stood at the native scale of some anchor it was known at, else cross_domain. observations
    and pearson come from anchors with both values; status is UNKNOWN without anchors, INCONCLUSIVE without a correlation,
    else PARTIAL, and only the last is a candidate. Its identity hashes the context, the direction and the counts. The
    characterisation of a candidate, null for others: concordant pairs (the product is above 0, below 0 or not 0 as
    `direction` is positive, negative or bidirectional), discordant ones (all others), least and greatest lag. One aggregate of
    one input; nothing is gathered. Empty tables give an empty result; other columns are ignored."""
    x, y, lag = F.col(value), F.col(context_value), F.col(anchor_time) - F.col(available)
    pair = F.col(available).isNotNull() & x.isNotNull() & y.isNotNull()
    product = F.signum(x) * F.signum(y)
    fits = F.when(F.col(direction) == "positive", product > 0).when(F.col(direction) == "negative", product < 0).otherwise(product != 0)
    got = joined.groupBy(by, direction).agg(
        F.count("*").alias("population"), F.count_if(F.col(available).isNotNull() & (F.col(scale) == F.col(context_scale))).alias("__same"), F.count_if(pair).alias("observations"),
        F.round(pearson(F.when(pair, x), F.when(pair, y)), digits).alias("pearson"), F.count_if(pair & fits).alias("c"), F.min(F.when(pair, lag)).alias("low"), F.max(F.when(pair, lag)).alias("high"),
    )
    chosen = F.col("pearson").isNotNull()
    identity = F.concat(F.lit("candidate-"), F.substring(F.sha2(F.concat_ws("|", by, direction, F.col("population").cast("string"), F.col("observations").cast("string")), 256), 1, 16))
    return got.select(
        by, direction, F.when(F.col("__same") > 0, "same_domain").otherwise("cross_domain").alias("domain"), "population", "observations", "pearson",
        F.when(F.col("population") == 0, "UNKNOWN").when(chosen, "PARTIAL").otherwise("INCONCLUSIVE").alias("status"), F.when(chosen, identity).alias("candidate"), F.when(chosen, F.col("c")).alias("concordant"),
        F.when(chosen, F.col("observations") - F.col("c")).alias("discordant"), F.when(chosen, F.col("low")).alias("min_lag_ns"), F.when(chosen, F.col("high")).alias("max_lag_ns"),
    )


#: The names of the thirteen checks.
CHECKS = (
    "lookahead", "population_conditioning", "denominator_errors", "selection_bias", "lineage_duplication", "false_confluence", "bad_controls",
    "temporal_dependence", "multiple_testing", "normalization_leakage", "fragility", "sample_concentration", "alternative_explanations",
)


def challenge_facts(rows: DataFrame, by: list[str], source: str, block: str, family: str) -> DataFrame:
    """Per subject: sample size, sources in order, the largest source's share of the sample, blocks and families.
    Rows are counted per source first, so a large source is not gathered."""
    per = rows.groupBy(*by, source).agg(F.count("*").alias("c"))
    sources = per.groupBy(*by).agg(F.sum("c").alias("sample_size"), F.array_sort(F.collect_set(source)).alias("source_ids"), (F.max("c") / F.sum("c")).alias("max_sample_share"))
    counts = rows.groupBy(*by).agg(F.count_distinct(block).alias("block_count"), F.count_distinct(family).alias("family_count"))
    renamed = counts.select(*[F.col(c).alias(f"__{c}") for c in by], "block_count", "family_count")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return sources.join(renamed, same).drop(*[f"__{c}" for c in by])


def scorecard(evidence: DataFrame) -> DataFrame:
    """Rows (kind, evidence, verdict, complete) for each of the CHECKS: PASSED if all its evidence passes, FAILED if
    some does not, INCONCLUSIVE without any. complete: every check has evidence exactly once.

    Evidence without an id, a sample or a finite metric fails. Other kinds than the CHECKS are ignored."""
    kind, clean, n = F.col("kind"), F.col("violations") == 0, F.size("source_ids")
    rule = (
        F.when(kind.isin(*CHECKS[:3]), clean & (F.col("denominator") > 0)).when(kind == "selection_bias", n >= 2).when(kind.isin("lineage_duplication", "false_confluence"), (n >= 2) & (F.size(F.array_distinct("source_ids")) == n))
        .when(kind == "bad_controls", F.length("control_identity") > 0).when(kind == "temporal_dependence", F.col("block_count") >= 2).when(kind == "multiple_testing", F.col("family_count") > 0)
        .when(kind == "normalization_leakage", F.col("fit_end_ns") <= F.col("evaluation_start_ns")).when(kind == "fragility", (F.col("perturbation_count") >= 2) & clean)
        .when(kind == "sample_concentration", F.col("max_sample_share").between(0, 1) & (F.col("max_sample_share") < 0.5)).when(kind == "alternative_explanations", F.size("alternatives") > 0)
    )
    sound = (F.length("evidence_id") > 0) & (F.col("sample_size") > 0) & ~F.isnan("metric") & (F.abs("metric") != float("inf"))
    judged = evidence.select("kind", F.coalesce(sound & rule, F.lit(False)).alias("ok"))
    names = evidence.sparkSession.createDataFrame([(c,) for c in CHECKS], "kind string")
    per = names.join(judged, "kind", "left").groupBy("kind").agg(F.count("ok").alias("evidence"), F.min("ok").alias("all_ok"))
    verdict = F.when(F.col("evidence") == 0, "INCONCLUSIVE").when(F.col("all_ok"), "PASSED").otherwise("FAILED")
    whole = per.agg((F.count_if(F.col("evidence") == 1) == len(CHECKS)).alias("complete"))
    return per.select("kind", "evidence", verdict.alias("verdict")).join(F.broadcast(whole))


def run_report(anchors: DataFrame, joined: DataFrame, gates: DataFrame, by: str, states: list[str], identity: str, anchor_time: str = "anchor_time", known_at: str = "known_at", available: str = "available_time", value: str = "value", context_value: str = "context_value", digits: int = 9) -> DataFrame:
    """A population run as one tidy table (section, item, measure, number, verdict).

    validation: anchors checked, those that break a rule, and the count per rule (`causal_violations`; a missing value breaks
    none). phenotype: per group of `states` the anchors, values, mean, least, greatest and sample deviation. discovery:
    the denominators and metrics of each requested context (`discover`) with its status. gate: whether a discovery passes
    its declared gate, with the reason; a passing one is named as a candidate by its identity. scope: distinct identities, first and
    last anchor time. status: REJECTED if any anchor breaks a rule, UNKNOWN without anchors, INCONCLUSIVE if no discovery
    concludes, KNOWN if none was asked for, else PARTIAL.

    anchors holds each anchor once, joined each anchor once per request (left-joined to its context). Sections are
    aggregates of two inputs; only rows of the report are combined. Empty tables give validation, scope and status alone."""
    none = F.lit(None).cast("string")

    def tidy(df: DataFrame, section: str, item: Column, numbers: dict[str, Column], verdict: Column = none) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(n).alias("measure"), F.round(c.cast("double"), digits).alias("number")) for n, c in numbers.items()])
        return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), F.inline(cells), verdict.alias("verdict")).select("section", "item", "measure", "number", "verdict")

    times = [F.col(anchor_time), F.col(known_at), F.coalesce(F.col(value), F.lit(0.0)), F.col(identity).cast("string")]
    checked = anchors.withColumn("__bad", causal_violations(*times))
    rules = ("BAD_TIME", "NO_AVAILABILITY", "NOT_YET_KNOWN", "NOT_FINITE", "NO_IDENTITY")
    valid = checked.agg(
        F.count("*").alias("records"), F.count_if(F.size("__bad") > 0).alias("invalid"), *[F.count_if(F.array_contains("__bad", r)).alias(r) for r in rules],
        F.count_distinct(identity).alias("identities"), F.min(anchor_time).alias("first_ns"), F.max(anchor_time).alias("last_ns"),
    )
    shapes = anchors.groupBy(*states).agg(F.count("*").alias("anchors"), F.count(value).alias("samples"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.stddev_samp(value).alias("deviation"))
    found = discover(joined, [by], anchor_time, available, value, context_value)
    status = F.when(F.col("population") == 0, "UNKNOWN").when((F.col("observations") == 0) | F.col("pearson").isNull(), "INCONCLUSIVE").otherwise("PARTIAL")
    found = found.withColumn("status", status)
    gated = candidate_gate(found.withColumn("pearson", F.round("pearson", digits)), gates, [by], "pearson")
    name = F.when(F.col("eligible"), F.concat(F.lit("candidate-"), F.substring(F.sha2(F.concat_ws("|", by, F.col("population").cast("string"), F.col("observations").cast("string")), 256), 1, 16)))
    tally = found.agg(F.count("*").alias("asked"), F.count_if(F.col("status") == "PARTIAL").alias("concluded"))
    whole = valid.join(tally)  # one row each
    overall = F.when(F.col("invalid") > 0, "REJECTED").when(F.col("records") == 0, "UNKNOWN").when(F.col("asked") == 0, "KNOWN").when(F.col("concluded") == 0, "INCONCLUSIVE").otherwise("PARTIAL")
    metrics = ["population", "present", "missing_context", "missing_anchor_value", "missing_context_value", "zero_excluded", "observations", "pearson", "concordance"]
    parts = [
        tidy(valid, "validation", none, {n: F.col(n) for n in ("records", "invalid", *rules)}),
        tidy(shapes, "phenotype", F.concat_ws("|", *[F.col(c).cast("string") for c in states]), {n: F.col(n) for n in ("anchors", "samples", "mean", "least", "greatest", "deviation")}),
        tidy(found, "discovery", F.col(by), {n: F.col(n) for n in metrics} | {"mean_lag_s": F.round(F.col("mean_lag_ns") / 1e9, 3)}, F.col("status")),
        tidy(gated, "gate", F.col(by), {"eligible": F.col("eligible").cast("int")}, F.col("reason")),
        tidy(gated.where("eligible"), "candidate", F.col(by), {"observations": F.col("observations")}, name),
        tidy(valid, "scope", none, {n: F.col(n) for n in ("identities", "first_ns", "last_ns")}),
        tidy(whole, "status", none, {"requests": F.col("asked"), "concluded": F.col("concluded")}, overall),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
