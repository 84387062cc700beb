"""Reports over return streams: one long table (strategy_id, time, ret, signal, regime, liquidity) and one row of
declarations per strategy (capital, capacity, risk_budget)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causaltape.operators.statistics import pearson
from causaltape.sources.lake import cut

#: States of evidence by severity, the worst last.
SEVERITY = ("KNOWN", "PARTIAL", "INCONCLUSIVE", "UNKNOWN", "NULL", "ABSTAINED", "CONTRADICTORY", "REJECTED", "FAILED")


def severity(state: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), state)


def worst_state(states: DataFrame, by: list[str], state: str) -> DataFrame:
    """The most severe state of each group."""
    return states.groupBy(*by).agg(F.max_by(state, severity(F.col(state))).alias("status"))


def with_missing(base: Column, seen: Column, total: Column) -> Column:
    """A known state turns unknown without any observation and partial with some missing."""
    return F.when((base == "KNOWN") & (seen == 0), "UNKNOWN").when((base == "KNOWN") & (seen < total), "PARTIAL").otherwise(base)


def pairs(streams: DataFrame, time: str = "day") -> DataFrame:
    """Rows of two strategies at one time, a_<column> and b_<column>, the first id below the second. Each time meets
    itself only, so a task holds the strategies of a time and never their whole histories."""
    a, b = (streams.select(F.col(time), *[F.col(c).alias(f"{x}_{c}") for c in streams.columns if c != time]) for x in "ab")
    return a.join(b, time).where("a_strategy_id < b_strategy_id")


def correlations(paired: DataFrame) -> DataFrame:
    both = F.col("a_ret").isNotNull() & F.col("b_ret").isNotNull()
    got = paired.groupBy("a_strategy_id", "b_strategy_id").agg(F.count_if(both).alias("observations"), F.count("*").alias("total"), pearson(F.col("a_ret"), F.col("b_ret")).alias("correlation"))
    status = F.when((F.col("observations") > 0) & F.col("correlation").isNull(), "FAILED").otherwise(with_missing(F.lit("KNOWN"), F.col("observations"), F.col("total")))
    return got.withColumn("status", status)


def conditional_correlations(paired: DataFrame) -> DataFrame:
    """Per pair and regime: correlation over the times both are in it and have a return."""
    same = paired.where((F.col("a_regime") == F.col("b_regime")) & F.col("a_ret").isNotNull() & F.col("b_ret").isNotNull())
    total = paired.groupBy("a_strategy_id", "b_strategy_id").agg(F.count("*").alias("total"))
    got = same.groupBy("a_strategy_id", "b_strategy_id", F.col("a_regime").alias("regime")).agg(F.count("*").alias("observations"), pearson(F.col("a_ret"), F.col("b_ret")).alias("correlation"))
    return got.join(total, ["a_strategy_id", "b_strategy_id"]).withColumn("excluded", F.col("total") - F.col("observations")).drop("total")


def overlaps(paired: DataFrame) -> DataFrame:
    """Jaccard overlap of the times two signals are active; 0 if neither ever is."""
    seen = F.col("a_signal").isNotNull() & F.col("b_signal").isNotNull()
    a, b = F.col("a_signal") != 0, F.col("b_signal") != 0
    got = paired.groupBy("a_strategy_id", "b_strategy_id").agg(F.count_if(seen & a & b).alias("intersection"), F.count_if(seen & (a | b)).alias("union"))
    return got.withColumn("jaccard", F.when(F.col("union") == 0, 0.0).otherwise(F.col("intersection") / F.col("union")))


def shares(declared: DataFrame, column: str) -> DataFrame:
    """Each strategy's part of the total; a strategy without a declaration has part 0 if there is a total."""
    total = declared.agg(F.coalesce(F.sum(column), F.lit(0.0)).alias("total"))
    return declared.join(F.broadcast(total)).select("strategy_id", column, F.when(F.col("total") > 0, F.coalesce(F.col(column), F.lit(0.0)) / F.col("total")).alias("fraction"))


def drawdown(returns: DataFrame, by: list[str], time: str, ret: str) -> DataFrame:
    """The worst fall of wealth from its running peak, which begins at 1, per group.

    Wealth is a running sum of logarithms inside (group, year) with a carry over years; a return of -100 % or worse
    ends at a full loss."""
    year = F.year(time)
    rows = returns.where(F.col(ret).isNotNull()).select(*by, time, F.when(F.col(ret) > -1, F.log1p(ret)).alias("g"), (F.col(ret) <= -1).alias("ruin"), year.alias("__y"))
    upto = Window.partitionBy(*by, "__y").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("__y").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("w", F.sum(F.coalesce("g", F.lit(0.0))).over(upto)).withColumn("top", F.max("w").over(upto))
    years = inside.groupBy(*by, "__y").agg(F.max_by("w", time).alias("end"), F.max("w").alias("high"))
    offset = years.withColumn("offset", F.coalesce(F.sum("end").over(before), F.lit(0.0)))
    peak = offset.withColumn("peak", F.coalesce(F.max(F.col("offset") + F.col("high")).over(before), F.lit(0.0))).select(*by, "__y", "offset", "peak")
    all_ = inside.join(peak, [*by, "__y"])
    level = F.col("offset") + F.col("w")
    fall = F.when(F.col("ruin"), 1.0).otherwise(1 - F.exp(level - F.greatest(F.lit(0.0), F.col("peak"), F.col("offset") + F.col("top"))))
    return all_.groupBy(*by).agg(F.greatest(F.max(fall), F.lit(0.0)).alias("max_drawdown"), F.count("*").alias("observations"))


def portfolio_returns(streams: DataFrame, declared: DataFrame, time: str = "day") -> DataFrame:
    """Returns of the portfolio at times when all strategies report: weighted by capital if all declare it."""
    totals = declared.agg(F.coalesce(F.sum("capital"), F.lit(0.0)).alias("total"), F.count("*").alias("k"), F.count("capital").alias("with_capital"))
    rows = streams.where("ret is not null").join(F.broadcast(declared.select("strategy_id", "capital")), "strategy_id").join(F.broadcast(totals))
    weighted = (F.col("total") > 0) & (F.col("with_capital") == F.col("k"))
    weight = F.when(weighted, F.col("capital") / F.col("total")).otherwise(1 / F.col("k"))
    return rows.groupBy(time).agg(F.sum(F.col("ret") * weight).alias("ret"), F.count("*").alias("n"), F.first("k").alias("k")).where("n = k").select(time, "ret")


def portfolio_drawdown(streams: DataFrame, declared: DataFrame, time: str = "day") -> DataFrame:
    """One row: the portfolio's drawdown, 0 without observations."""
    one = drawdown(portfolio_returns(streams, declared, time).withColumn("__p", F.lit(1)), ["__p"], time, "ret")
    return one.agg(F.coalesce(F.max("max_drawdown"), F.lit(0.0)).alias("max_drawdown"), F.coalesce(F.sum("observations"), F.lit(0)).alias("observations"))


def turnover(streams: DataFrame, time: str = "day") -> DataFrame:
    """Absolute change of the signal between neighbouring times that both have one."""
    w = Window.partitionBy("strategy_id").orderBy(time)
    steps = streams.withColumn("p", F.lag("signal").over(w))
    change = F.abs(F.col("signal") - F.col("p"))
    return steps.groupBy("strategy_id").agg(F.sum(change).alias("turnover"), F.count(change).alias("observations"))


def liquidity(streams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean per strategy; and the mean of those means with the least raw value."""
    per = streams.groupBy("strategy_id").agg(F.avg("liquidity").alias("mean_liquidity"), F.count("liquidity").alias("observations"), F.min("liquidity").alias("least"))
    return per.drop("least"), per.agg(F.avg("mean_liquidity").alias("mean"), F.min("least").alias("minimum"))


def capacity(declared: DataFrame) -> DataFrame:
    """The total, if every strategy declares one, and the smallest."""
    return declared.agg(F.when(F.count("capacity") == F.count("*"), F.sum("capacity")).alias("total_capacity"), F.min("capacity").alias("bottleneck"))


def concentration(declared: DataFrame) -> DataFrame:
    return shares(declared, "capital").agg(F.sum(F.col("fraction") * F.col("fraction")).alias("herfindahl"), F.max("fraction").alias("largest_fraction"))


def constraint_status(value: Column, most: Column, least: Column) -> Column:
    good = F.coalesce(value <= most, F.lit(False)) | F.coalesce(value >= least, F.lit(False))
    return F.when(good, "KNOWN").when(value.isNotNull() & (most.isNotNull() | least.isNotNull()), "ABSTAINED").otherwise("UNKNOWN")


def constraints(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """Metrics (kind, subject, value) against limits (constraint_id, kind, subject, most, least), with the status of
    each and, as `overall`, the most severe of all."""
    named = metrics.select(F.col("kind").alias("__kind"), F.col("subject").alias("__subject"), "value")
    joined = limits.join(named, (F.col("kind") == F.col("__kind")) & F.col("subject").eqNullSafe(F.col("__subject")), "left").drop("__kind", "__subject")
    judged = joined.withColumn("status", constraint_status(F.col("value"), F.col("most"), F.col("least")))
    return judged.join(F.broadcast(judged.agg(F.max_by("status", severity(F.col("status"))).alias("overall"))))


def constraint_metrics(streams: DataFrame, declared: DataFrame, scenarios: DataFrame, time: str = "day") -> DataFrame:
    """What the ten kinds of constraint are held against, as rows (kind, subject, value); the subject of correlation and
    overlap is the pair, of all others null. Streams, declarations and pairs are worked out once, by jobs that run here."""
    streams, declared = cut(streams, "streams"), cut(declared, "declared")
    return held_against(streams, declared, cut(pairs(streams, time), "paired"), scenarios, time)


def held_against(streams: DataFrame, declared: DataFrame, paired: DataFrame, scenarios: DataFrame, time: str) -> DataFrame:
    two, none = F.concat_ws("|", "a_strategy_id", "b_strategy_id"), F.lit(None).cast("string")
    row = lambda df, kind, value, subject=none: df.select(F.lit(kind).alias("kind"), subject.alias("subject"), F.col(value).cast("double").alias("value"))
    sums = declared.agg(F.sum("capital").alias("capital"), F.sum("risk_budget").alias("risk_budget"))
    parts = [
        row(correlations(paired), "correlation", "correlation", two), row(overlaps(paired), "overlap", "jaccard", two), row(sums, "capital_allocation", "capital"), row(sums, "risk_budget", "risk_budget"),
        row(portfolio_drawdown(streams, declared, time), "drawdown", "max_drawdown"), row(capacity(declared), "capacity", "bottleneck"), row(liquidity(streams)[1], "liquidity", "minimum"),
        row(concentration(declared), "concentration", "herfindahl"), row(turnover(streams, time).agg(F.sum("turnover").alias("t")), "turnover", "t"),
        row(stress(declared, scenarios).agg(F.min("portfolio_return").alias("r")), "stress", "r"),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def stress(declared: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Scenarios (scenario_id, returns map) applied to capital shares; a strategy without a return leaves it partial."""
    given = scenarios.select("scenario_id", F.explode("returns").alias("strategy_id", "r"))
    grid = scenarios.select("scenario_id").join(F.broadcast(shares(declared, "capital")))
    full = grid.join(given, ["scenario_id", "strategy_id"], "left")
    hit = F.col("fraction").isNotNull() & F.col("r").isNotNull()
    return full.groupBy("scenario_id").agg(F.coalesce(F.sum(F.col("fraction") * F.col("r")), F.lit(0.0)).alias("portfolio_return"), F.when(F.min(hit.cast("int")) == 1, "KNOWN").otherwise("PARTIAL").alias("status"))


def equal_weight_score(streams: DataFrame, declared: DataFrame) -> DataFrame:
    """Sum of all returns over the number of strategies."""
    return streams.agg(F.sum("ret").alias("total")).join(F.broadcast(declared.agg(F.count("*").alias("k")))).select((F.col("total") / F.col("k")).alias("score"), "k")


def report(streams: DataFrame, declared: DataFrame, scenarios: DataFrame, limits: DataFrame, time: str = "day") -> DataFrame:
    """The whole report as rows (metric, subject, value, status); status is null where a metric has none.

    Pairs: correlation, conditional_correlation (subject a|b|regime), overlap. Strategies: capital_share, risk_share,
    turnover, liquidity, drawdown. The portfolio: drawdown, turnover, liquidity and minimum_liquidity, herfindahl,
    largest_share, capacity_total (null unless all declare one), capacity_bottleneck, equal_weight_score. Then stress by
    scenario, constraint by its id with what it was held against, and constraints, the most severe of their states.
    Streams, declarations, pairs and what constraints are held against are written once, by jobs that run here."""
    streams, declared = cut(streams, "streams"), cut(declared, "declared")
    paired = cut(pairs(streams, time), "paired")
    two = F.concat_ws("|", "a_strategy_id", "b_strategy_id")
    none = F.lit(None).cast("string")
    row = lambda df, metric, subject, value, status=none: df.select(F.lit(metric).alias("metric"), subject.alias("subject"), F.col(value).cast("double").alias("value"), status.alias("status"))
    whole, one, state = F.lit("portfolio"), F.col("strategy_id"), F.col("status")
    capitals, capacities, turnovers = cut(shares(declared, "capital"), "shares"), capacity(declared), turnover(streams, time)
    per, total = liquidity(streams)
    judged = cut(constraints(cut(held_against(streams, declared, paired, scenarios, time), "held"), limits), "judged")
    squares = capitals.agg(F.sum(F.col("fraction") * F.col("fraction")).alias("herfindahl"), F.max("fraction").alias("largest"))
    parts = [
        row(correlations(paired), "correlation", two, "correlation", state), row(conditional_correlations(paired), "conditional_correlation", F.concat_ws("|", two, "regime"), "correlation"), row(overlaps(paired), "overlap", two, "jaccard"),
        row(capitals, "capital_share", one, "fraction"), row(shares(declared, "risk_budget"), "risk_share", one, "fraction"), row(turnovers, "turnover", one, "turnover"), row(per, "liquidity", one, "mean_liquidity"),
        row(drawdown(streams, ["strategy_id"], time, "ret"), "drawdown", one, "max_drawdown"), row(portfolio_drawdown(streams, declared, time), "drawdown", whole, "max_drawdown"),
        row(turnovers.agg(F.sum("turnover").alias("t")), "turnover", whole, "t"), row(total, "liquidity", whole, "mean"), row(total, "minimum_liquidity", whole, "minimum"), row(squares, "herfindahl", whole, "herfindahl"),
        row(squares, "largest_share", whole, "largest"), row(capacities, "capacity_total", whole, "total_capacity"), row(capacities, "capacity_bottleneck", whole, "bottleneck"),
        row(equal_weight_score(streams, declared), "equal_weight_score", whole, "score"), row(stress(declared, scenarios), "stress", F.col("scenario_id"), "portfolio_return", state),
        row(judged, "constraint", F.col("constraint_id"), "value", state), judged.agg(F.max("overall").alias("o")).select(F.lit("constraints").alias("metric"), whole.alias("subject"), F.lit(None).cast("double").alias("value"), F.col("o").alias("status")),
    ]
    return functools.reduce(DataFrame.unionByName, parts)
