"""Queries over time splits and return streams, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causaltape.operators import evaluation, intervals, portfolio
from causaltape.plans import fixtures as fx
from causaltape.plans import market
from causaltape.plans.fixtures import sql, table
from causaltape.sources.lake import cut

QUERIES, SQL = {}, {}


def query(text: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = sql(text, *views) if views else text
        return f

    return add


rounded = market.rounded
PAIRED = """p AS (SELECT a.day, a.strategy_id AS a_strategy_id, b.strategy_id AS b_strategy_id, a.ret AS a_ret, b.ret AS b_ret, a.regime AS a_regime, b.regime AS b_regime, a.signal AS a_signal, b.signal AS b_signal
  FROM streams a JOIN streams b ON a.day = b.day AND a.strategy_id < b.strategy_id)"""


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.pairs(fx.streams(spark, sf_dir))


@query(f"WITH {PAIRED} SELECT a_strategy_id, b_strategy_id, count(*) FILTER (a_ret IS NOT NULL AND b_ret IS NOT NULL) AS observations FROM p GROUP BY ALL", "streams")
def j9_same_index_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.correlations(_paired(spark, sf_dir)).select("a_strategy_id", "b_strategy_id", "observations")


@query(f"""WITH {PAIRED} SELECT a_strategy_id, b_strategy_id, count(*) FILTER (a_ret IS NOT NULL AND b_ret IS NOT NULL) AS observations, round(nullif(corr(a_ret, b_ret), 'nan'::DOUBLE), 8) AS correlation,
  CASE WHEN nullif(corr(a_ret, b_ret), 'nan'::DOUBLE) IS NULL THEN CASE WHEN count(*) FILTER (a_ret IS NOT NULL AND b_ret IS NOT NULL) = 0 THEN 'UNKNOWN' ELSE 'FAILED' END WHEN count(*) FILTER (a_ret IS NOT NULL AND b_ret IS NOT NULL) < count(*) THEN 'PARTIAL' ELSE 'KNOWN' END AS status FROM p GROUP BY ALL""", "streams")
def b5_return_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.correlations(_paired(spark, sf_dir)).drop("total"), "correlation", digits=8)


@query(f"""WITH {PAIRED}, t AS (SELECT a_strategy_id, b_strategy_id, count(*) AS total FROM p GROUP BY ALL) SELECT a_strategy_id, b_strategy_id, a_regime AS regime, count(*) AS observations, round(nullif(corr(a_ret, b_ret), 'nan'::DOUBLE), 8) AS correlation, any_value(total) - count(*) AS excluded
  FROM p JOIN t USING (a_strategy_id, b_strategy_id) WHERE a_regime = b_regime AND a_ret IS NOT NULL AND b_ret IS NOT NULL GROUP BY a_strategy_id, b_strategy_id, a_regime""", "streams")
def b6_conditional_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.conditional_correlations(_paired(spark, sf_dir)), "correlation", digits=8)


OVERLAP = f"""WITH {PAIRED} SELECT a_strategy_id, b_strategy_id, count(*) FILTER (a_signal <> 0 AND b_signal <> 0) AS intersection, count(*) FILTER (a_signal IS NOT NULL AND b_signal IS NOT NULL AND (a_signal <> 0 OR b_signal <> 0)) AS "union" FROM p GROUP BY ALL"""


@query(OVERLAP, "streams")
def u5_active_overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.overlaps(_paired(spark, sf_dir)).drop("jaccard")


@query(f"""SELECT a_strategy_id, b_strategy_id, round(CASE WHEN "union" = 0 THEN 0 ELSE intersection / "union" END, 9) AS jaccard FROM ({OVERLAP.replace("WITH " + PAIRED, "WITH " + PAIRED)})""", "streams")
def b7_signal_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.overlaps(_paired(spark, sf_dir)).select("a_strategy_id", "b_strategy_id", "jaccard"), "jaccard")


def _share_sql(column: str) -> str:
    return f"SELECT strategy_id, round({column}, 4) AS {column}, round({column} / sum({column}) OVER (), 9) AS fraction FROM capital"


@query(_share_sql("capital"), "capital")
def b8_capital_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(portfolio.shares(fx.capital(spark, sf_dir), "capital"), "fraction"), "capital", digits=4)


@query(_share_sql("risk_budget"), "capital")
def b14_risk_budget_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(portfolio.shares(fx.capital(spark, sf_dir), "risk_budget"), "fraction"), "risk_budget", digits=4)


DRAWDOWN = """SELECT {by}round(greatest(max(1 - exp(lw - greatest(0, peak))), 0), 8) AS max_drawdown, count(*) AS observations FROM (SELECT *, max(lw) OVER (PARTITION BY {part} ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak
  FROM (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY {part} ORDER BY day ROWS UNBOUNDED PRECEDING) AS lw FROM {src} WHERE ret IS NOT NULL)) {group}"""
PORTFOLIO = """pr AS (SELECT day, sum(ret * capital / total) AS ret FROM streams JOIN capital USING (strategy_id), (SELECT sum(capital) AS total, count(*) AS k FROM capital) WHERE ret IS NOT NULL GROUP BY day HAVING count(*) = any_value(k))"""


@query(DRAWDOWN.format(by="strategy_id, ", part="strategy_id", src="streams", group="GROUP BY strategy_id"), "streams")
def w17_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.drawdown(fx.streams(spark, sf_dir), ["strategy_id"], "day", "ret"), "max_drawdown", digits=8)


@query(f"WITH {PORTFOLIO} " + DRAWDOWN.format(by="", part="1", src="pr", group=""), "streams", "capital")
def b9_portfolio_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.portfolio_drawdown(fx.streams(spark, sf_dir), fx.capital(spark, sf_dir)), "max_drawdown", digits=8)


@query("SELECT sum(capacity) AS total_capacity, min(capacity) AS bottleneck FROM capital", "capital")
def b10_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.capacity(fx.capital(spark, sf_dir))


TURNOVER = """SELECT strategy_id, sum(abs(signal - p)) AS turnover, count(signal - p) AS observations FROM (SELECT *, lag(signal) OVER (PARTITION BY strategy_id ORDER BY day) AS p FROM streams) GROUP BY strategy_id"""


@query(TURNOVER, "streams")
def w18_signal_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.turnover(fx.streams(spark, sf_dir))


@query(f"SELECT sum(turnover) AS total, CAST(sum(observations) AS BIGINT) AS observations FROM ({TURNOVER})", "streams")
def b11_turnover_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.turnover(fx.streams(spark, sf_dir)).agg(F.sum("turnover").alias("total"), F.sum("observations").alias("observations"))


@query("SELECT round(avg(m), 9) AS mean, min(least) AS minimum FROM (SELECT avg(liquidity) AS m, min(liquidity) AS least FROM streams GROUP BY strategy_id)", "streams")
def b12_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.liquidity(fx.streams(spark, sf_dir))[1], "mean")


@query("SELECT round(sum(f * f), 9) AS herfindahl, round(max(f), 9) AS largest_fraction FROM (SELECT capital / sum(capital) OVER () AS f FROM capital)", "capital")
def b13_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.concentration(fx.capital(spark, sf_dir)), "herfindahl", "largest_fraction")


PAIR = "AUTOMOBILE|BUILDING"
LIMITS = [
    ("c01", "concentration", None, 0.5, None), ("c02", "capacity", None, None, 1e9), ("c03", "capacity", None, None, 1.0), ("c04", "turnover", None, 10.0, None), ("c05", "drawdown", None, 1.0, None),
    ("c06", "stress", None, None, -0.01), ("c07", "correlation", PAIR, 0.9, None), ("c08", "overlap", PAIR, 0.5, None), ("c09", "capital_allocation", None, None, 1.0), ("c10", "liquidity", None, None, 1.0),
    ("c11", "risk_budget", None, 1.0, None), ("c12", "correlation", "none|such", 1.0, None), ("c13", "stress", None, None, None),
]
SCENARIOS = [("crash", {"BUILDING": -0.5, "MACHINERY": -0.2}), ("mild", dict.fromkeys(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), 0.01))]
LIMITS_SQL = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in limit) + ")" for limit in LIMITS)
SCENARIOS_SQL = ", ".join(f"('{name}', '{strategy}', {r}::DOUBLE)" for name, given in SCENARIOS for strategy, r in given.items())


CONSTRAINTS = f"""{PAIRED}, {PORTFOLIO}, s(scenario_id, strategy_id, r) AS (VALUES {SCENARIOS_SQL}), sh AS (SELECT strategy_id, capital / sum(capital) OVER () AS f FROM capital), o AS ({OVERLAP.split("FROM p")[0].split(PAIRED)[1]} FROM p GROUP BY a_strategy_id, b_strategy_id),
  m AS (SELECT 'concentration' AS kind, NULL AS subject, sum(f * f) AS value FROM sh UNION ALL SELECT 'capacity', NULL, min(capacity) FROM capital UNION ALL SELECT 'turnover', NULL, sum(turnover) FROM ({TURNOVER})
    UNION ALL SELECT 'drawdown', NULL, max_drawdown FROM ({DRAWDOWN.format(by="", part="1", src="pr", group="")}) UNION ALL SELECT 'stress', NULL, min(x) FROM (SELECT scenario_id, coalesce(sum(f * r), 0) AS x FROM s JOIN sh USING (strategy_id) GROUP BY scenario_id)
    UNION ALL SELECT 'correlation', a_strategy_id || '|' || b_strategy_id, nullif(corr(a_ret, b_ret), 'nan'::DOUBLE) FROM p GROUP BY a_strategy_id, b_strategy_id
    UNION ALL SELECT 'overlap', a_strategy_id || '|' || b_strategy_id, CASE WHEN "union" = 0 THEN 0 ELSE intersection / "union" END FROM o UNION ALL SELECT 'capital_allocation', NULL, sum(capital) FROM capital
    UNION ALL SELECT 'liquidity', NULL, min(liquidity) FROM streams UNION ALL SELECT 'risk_budget', NULL, sum(risk_budget) FROM capital),
  l(constraint_id, kind, subject, most, least) AS (VALUES {LIMITS_SQL}),
  j AS (SELECT constraint_id, l.kind, l.subject, value, CASE WHEN value <= most OR value >= least THEN 'KNOWN' WHEN value IS NOT NULL AND (most IS NOT NULL OR least IS NOT NULL) THEN 'ABSTAINED' ELSE 'UNKNOWN' END AS status FROM l LEFT JOIN m ON m.kind = l.kind AND m.subject IS NOT DISTINCT FROM l.subject)"""


@query(f"""WITH {CONSTRAINTS}
  SELECT constraint_id, kind, subject, round(value, 7) AS value, status, max_by(status, list_position(['KNOWN', 'PARTIAL', 'INCONCLUSIVE', 'UNKNOWN', 'NULL', 'ABSTAINED'], status)) OVER () AS overall FROM j""", "streams", "capital")
def b15_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenarios = spark.createDataFrame(SCENARIOS, "scenario_id string, returns map<string,double>")
    metrics = portfolio.constraint_metrics(fx.streams(spark, sf_dir), fx.capital(spark, sf_dir), scenarios)
    limits = spark.createDataFrame(LIMITS, "constraint_id string, kind string, subject string, most double, least double")
    return rounded(portfolio.constraints(metrics, limits).select("constraint_id", "kind", "subject", "value", "status", "overall"), "value", digits=7)


@query("""WITH s(scenario_id, strategy_id, r) AS (VALUES ('crash', 'BUILDING', -0.5), ('crash', 'MACHINERY', -0.2), ('mild', 'AUTOMOBILE', 0.01), ('mild', 'BUILDING', 0.01), ('mild', 'FURNITURE', 0.01), ('mild', 'HOUSEHOLD', 0.01), ('mild', 'MACHINERY', 0.01)),
  sh AS (SELECT strategy_id, capital / sum(capital) OVER () AS f FROM capital)
  SELECT scenario_id, round(coalesce(sum(f * r), 0), 9) AS portfolio_return, CASE WHEN count(*) = count(r) THEN 'KNOWN' ELSE 'PARTIAL' END AS status FROM (SELECT DISTINCT scenario_id FROM s) CROSS JOIN sh LEFT JOIN s USING (scenario_id, strategy_id) GROUP BY scenario_id""", "capital")
def b16_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = [("crash", {"BUILDING": -0.5, "MACHINERY": -0.2}), ("mild", dict.fromkeys(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), 0.01))]
    return rounded(portfolio.stress(fx.capital(spark, sf_dir), spark.createDataFrame(given, "scenario_id string, returns map<string,double>")), "portfolio_return")


@query("SELECT round(sum(ret) / (SELECT count(*) FROM capital), 8) AS score, (SELECT count(*) FROM capital) AS k FROM streams", "streams", "capital")
def b17_equal_weight_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.equal_weight_score(fx.streams(spark, sf_dir), fx.capital(spark, sf_dir)), "score", digits=8)


SCENARIO_SQL = "SELECT scenario_id, coalesce(sum(f * r), 0) AS portfolio_return, CASE WHEN count(*) = count(r) THEN 'KNOWN' ELSE 'PARTIAL' END AS status FROM (SELECT DISTINCT scenario_id FROM s) CROSS JOIN sh LEFT JOIN s USING (scenario_id, strategy_id) GROUP BY scenario_id"
BOTH = "count(*) FILTER (a_ret IS NOT NULL AND b_ret IS NOT NULL)"


@query(f"""WITH {CONSTRAINTS}, sd AS ({DRAWDOWN.format(by="strategy_id, ", part="strategy_id", src="streams", group="GROUP BY strategy_id")}), pd AS ({DRAWDOWN.format(by="", part="1", src="pr", group="")}), tv AS ({TURNOVER}), lq AS (SELECT strategy_id, avg(liquidity) AS v, min(liquidity) AS least FROM streams GROUP BY strategy_id),
  co AS (SELECT a_strategy_id || '|' || b_strategy_id AS subject, nullif(corr(a_ret, b_ret), 'nan'::DOUBLE) AS value, {BOTH} AS seen, count(*) AS total FROM p GROUP BY a_strategy_id, b_strategy_id)
  SELECT metric, subject, round(value, 7) AS value, status FROM (
  SELECT 'correlation' AS metric, subject, value, CASE WHEN value IS NULL THEN CASE WHEN seen = 0 THEN 'UNKNOWN' ELSE 'FAILED' END WHEN seen < total THEN 'PARTIAL' ELSE 'KNOWN' END AS status FROM co
  UNION ALL SELECT 'conditional_correlation', concat_ws('|', a_strategy_id, b_strategy_id, a_regime), nullif(corr(a_ret, b_ret), 'nan'::DOUBLE), NULL FROM p WHERE a_regime = b_regime AND a_ret IS NOT NULL AND b_ret IS NOT NULL GROUP BY a_strategy_id, b_strategy_id, a_regime
  UNION ALL SELECT 'overlap', a_strategy_id || '|' || b_strategy_id, coalesce(count(*) FILTER (a_signal <> 0 AND b_signal <> 0) / nullif(count(*) FILTER (a_signal IS NOT NULL AND b_signal IS NOT NULL AND (a_signal <> 0 OR b_signal <> 0)), 0), 0), NULL FROM p GROUP BY a_strategy_id, b_strategy_id
  UNION ALL SELECT 'capital_share', strategy_id, f, NULL FROM sh UNION ALL SELECT 'risk_share', strategy_id, risk_budget / sum(risk_budget) OVER (), NULL FROM capital
  UNION ALL SELECT 'turnover', strategy_id, turnover, NULL FROM tv UNION ALL SELECT 'turnover', 'portfolio', sum(turnover), NULL FROM tv
  UNION ALL SELECT 'liquidity', strategy_id, v, NULL FROM lq UNION ALL SELECT 'liquidity', 'portfolio', avg(v), NULL FROM lq UNION ALL SELECT 'minimum_liquidity', 'portfolio', min(least), NULL FROM lq
  UNION ALL SELECT 'drawdown', strategy_id, max_drawdown, NULL FROM sd UNION ALL SELECT 'drawdown', 'portfolio', max_drawdown, NULL FROM pd
  UNION ALL SELECT 'herfindahl', 'portfolio', sum(f * f), NULL FROM sh UNION ALL SELECT 'largest_share', 'portfolio', max(f), NULL FROM sh
  UNION ALL SELECT 'capacity_total', 'portfolio', CASE WHEN count(capacity) = count(*) THEN sum(capacity) END, NULL FROM capital UNION ALL SELECT 'capacity_bottleneck', 'portfolio', min(capacity), NULL FROM capital
  UNION ALL SELECT 'equal_weight_score', 'portfolio', sum(ret) / (SELECT count(*) FROM capital), NULL FROM streams
  UNION ALL SELECT 'stress', scenario_id, portfolio_return, status FROM ({SCENARIO_SQL}) UNION ALL SELECT 'constraint', constraint_id, value, status FROM j
  UNION ALL SELECT 'constraints', 'portfolio', NULL, max_by(status, list_position(['KNOWN', 'PARTIAL', 'INCONCLUSIVE', 'UNKNOWN', 'NULL', 'ABSTAINED'], status)) FROM j)""", "streams", "capital")
def b18_portfolio_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenarios = spark.createDataFrame(SCENARIOS, "scenario_id string, returns map<string,double>")
    limits = spark.createDataFrame(LIMITS, "constraint_id string, kind string, subject string, most double, least double")
    return rounded(portfolio.report(fx.streams(spark, sf_dir), fx.capital(spark, sf_dir), scenarios, limits), "value", digits=7)


STATES = """st AS (SELECT o_custkey % 7 AS grp, CASE o_orderstatus WHEN 'F' THEN 'KNOWN' WHEN 'O' THEN 'PARTIAL' ELSE 'UNKNOWN' END AS state FROM orders)"""


@query(f"WITH {STATES} SELECT grp, CASE max(CASE state WHEN 'KNOWN' THEN 1 WHEN 'PARTIAL' THEN 2 ELSE 4 END) WHEN 1 THEN 'KNOWN' WHEN 2 THEN 'PARTIAL' ELSE 'UNKNOWN' END AS status FROM st GROUP BY grp")
def g16_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    states = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("grp"), F.when(s == "F", "KNOWN").when(s == "O", "PARTIAL").otherwise("UNKNOWN").alias("state"))
    return portfolio.worst_state(states, ["grp"], "state")


# Time splits


@query("""WITH l AS (SELECT * FROM leaves UNION ALL SELECT 'probe', 1705708800000000000, 1705881600000000000) SELECT a.leaf AS a_name, b.leaf AS b_name FROM l a JOIN l b ON a.leaf < b.leaf AND a.start_ns < b.end_ns AND b.start_ns < a.end_ns
  UNION ALL SELECT 'ticks', leaf FROM ticks JOIN leaves ON event_ts_ns >= start_ns AND event_ts_ns < end_ns GROUP BY leaf""", "leaves", "ticks")
def j11_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of the leaves and a probe, and of the leaves with the spans of the ticks in them."""
    l = fx.leaves(spark).unionByName(spark.createDataFrame([("probe", 1705708800000000000, 1705881600000000000)], "leaf string, start_ns long, end_ns long"))
    touched = evaluation.assign(fx.ticks(spark, sf_dir), fx.leaves(spark), "event_ts_ns").where("leaf is not null").select(F.lit("ticks").alias("a_name"), F.col("leaf").alias("b_name")).distinct()
    return evaluation.overlapping(l).select("a_name", "b_name").unionByName(touched)


SPANNED = """sp AS (SELECT instrument, source_sequence AS leaf, event_ts_ns AS start_ns, event_ts_ns + k * k * 60000000000 AS end_ns FROM ticks WHERE event_type = 'signup')"""


@query(f"WITH {SPANNED} SELECT a.instrument, a.leaf AS a_name, b.leaf AS b_name FROM sp a JOIN sp b ON a.instrument = b.instrument AND a.leaf < b.leaf AND a.start_ns < b.end_ns AND b.start_ns < a.end_ns WHERE a.end_ns > a.start_ns AND b.end_ns > b.start_ns", "ticks")
def j11_overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps among spans of very unlike lengths, from nothing to a week, that stand in the table."""
    t = fx.ticks(spark, sf_dir).where("event_type = 'signup'")
    spans = t.select("instrument", F.col("source_sequence").alias("leaf"), F.col("event_ts_ns").alias("start_ns"), (F.col("event_ts_ns") + F.col("k").cast("long") * F.col("k") * 60_000_000_000).alias("end_ns"))
    return intervals.pairs_within(spans, ["instrument"], "leaf")


LEAFED = """lt AS (SELECT t.*, l.leaf FROM ticks t LEFT JOIN leaves l ON event_ts_ns >= start_ns AND event_ts_ns < end_ns)"""


def _leafed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.assign(fx.ticks(spark, sf_dir), fx.leaves(spark), "event_ts_ns")


@query(f"WITH {LEAFED} SELECT leaf, instrument, count(*) AS n FROM lt GROUP BY ALL", "ticks", "leaves")
def j12_leaf_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leafed(spark, sf_dir).groupBy("leaf", "instrument").agg(F.count("*").alias("n"))


@query("""WITH refs AS (SELECT source_sequence AS row_id, event_ts_ns, unnest([source_sequence - 1, source_sequence + 1]) AS input_id FROM ticks)
  SELECT row_id, input_id, CASE WHEN t.source_sequence IS NULL THEN 'UNKNOWN_INPUT' ELSE 'FUTURE_INPUT' END AS reason FROM refs r LEFT JOIN ticks t ON t.source_sequence = input_id WHERE t.source_sequence IS NULL OR t.received_ts_ns > r.event_ts_ns""", "ticks")
def j13_input_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.ticks(spark, sf_dir)
    rows = t.select(F.col("source_sequence").alias("row_id"), "event_ts_ns", F.array(F.col("source_sequence") - 1, F.col("source_sequence") + 1).alias("input_ids"))
    return evaluation.unavailable_inputs(rows, t.select(F.col("source_sequence").alias("input_id"), F.col("received_ts_ns").alias("available_time_ns")), "row_id", "event_ts_ns")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j14_required_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    confirmed = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return evaluation.missing_ids(table(spark, sf_dir, "orders").select("o_custkey").distinct(), confirmed, "o_custkey")


@query("""WITH e AS (SELECT source_sequence AS exposure, event_ts_ns AS start_ns, event_ts_ns + 86400000000000 AS end_ns FROM ticks WHERE event_type = 'signup' AND source_sequence % 2 = 0), h AS (SELECT exposure, leaf FROM e JOIN leaves l ON e.start_ns < l.end_ns AND l.start_ns < e.end_ns WHERE leaf <> 'development')
  SELECT exposure, leaf, exposure <> min(exposure) OVER (PARTITION BY leaf) AS repeated FROM h""", "ticks", "leaves")
def j15_exposure_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.ticks(spark, sf_dir).where("event_type = 'signup'")
    e = t.select(F.col("source_sequence").alias("exposure"), F.when(F.col("source_sequence") % 2 == 0, "detector_confirmation").otherwise("exploration").alias("purpose"), F.col("event_ts_ns").alias("start_ns"), (F.col("event_ts_ns") + fx.DAY).alias("end_ns"))
    return evaluation.contaminated_exposures(e, fx.leaves(spark).where("leaf <> 'development'"))


@query("""WITH e AS (SELECT instrument, source_sequence AS exposure, CASE event_type WHEN 'signup' THEN 'detector_confirmation' WHEN 'purchase' THEN 'strategy_holdout' WHEN 'error' THEN 'portfolio_holdout' ELSE 'exploration' END AS role, event_ts_ns AS start_ns, event_ts_ns + (k + 1) * 60000000000 AS end_ns, received_ts_ns AS exposed_ns FROM ticks),
  lv AS (SELECT leaf || ':' || role AS leaf, role, start_ns, end_ns FROM leaves, (SELECT unnest(['detector_confirmation', 'strategy_holdout', 'portfolio_holdout']) AS role) WHERE leaf <> 'development'),
  n AS (SELECT e.*, (SELECT min(l.leaf) FROM lv l WHERE l.role = e.role AND e.start_ns < l.end_ns AND l.start_ns < e.end_ns) AS leaf FROM e)
  SELECT n.exposure, n.role, n.leaf, any_value(CASE WHEN n.leaf IS NULL THEN 'NO_LEAF' WHEN p.exposure IS NOT NULL THEN 'CONTAMINATED' ELSE 'ACCEPTED' END) AS verdict, arg_min(p.exposure, (p.exposed_ns, p.exposure)) AS source
  FROM n LEFT JOIN n p ON n.leaf IS NOT NULL AND n.role IN ('strategy_holdout', 'portfolio_holdout') AND p.role = 'detector_confirmation' AND p.leaf IS NOT NULL AND p.instrument = n.instrument AND p.start_ns < n.end_ns AND n.start_ns < p.end_ns AND (p.exposed_ns, p.exposure) < (n.exposed_ns, n.exposure) GROUP BY ALL""", "ticks", "leaves")
def j15_exposure_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick as an exposure of its role: which leaf it opens, and whether an earlier confirmation has spoilt it."""
    t = fx.ticks(spark, sf_dir)
    roles = {"signup": evaluation.CONFIRMATION, "purchase": evaluation.HOLDOUTS[0], "error": evaluation.HOLDOUTS[1]}
    role = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in roles.items()], F.lit("exploration"))
    e = t.select("instrument", F.col("source_sequence").alias("exposure"), role.alias("role"), F.col("event_ts_ns").alias("start_ns"), (F.col("event_ts_ns") + (F.col("k").cast("long") + 1) * 60_000_000_000).alias("end_ns"), F.col("received_ts_ns").alias("exposed_ns"))
    declared = fx.leaves(spark).where("leaf <> 'development'").withColumn("role", F.explode(F.array(*[F.lit(r) for r in roles.values()])))
    declared = t.select("instrument").distinct().join(F.broadcast(declared)).withColumn("leaf", F.concat_ws(":", "leaf", "role"))
    return evaluation.exposure_history(cut(e, "exposures"), cut(declared, "leaves"), ["instrument"]).select("exposure", "role", "leaf", "verdict", "source")


SCORED = """SELECT {0} count(*) AS observations, count(*) FILTER (acts) AS acted, count(*) FILTER (NOT acts) AS abstentions, count(*) FILTER (breach) AS risk_breaches, round(coalesce(sum(side * o) FILTER (acts), 0), 6) AS gross_score, round(count(*) FILTER (acts) * 0.01::DOUBLE, 6) AS costs,
  round(coalesce(sum(side * o) FILTER (acts), 0) - count(*) FILTER (acts) * 0.01, 6) AS net_score FROM (SELECT *, s IS NOT NULL AND o IS NOT NULL AND NOT breach AND side IS NOT NULL AS acts FROM (SELECT *, s IS NOT NULL AND o IS NOT NULL AND abs(o) > 0.9 AS breach, CASE WHEN s >= {1} THEN 1.0 WHEN s <= -{1} THEN -1.0 END AS side FROM {2})) GROUP BY {3}"""
SIGNALS = f"""{LEAFED}, sg AS (SELECT leaf, instrument, CASE WHEN k % 7 <> 0 THEN value - 50 END AS s, round(k / 50.0 - 1, 9) AS o FROM lt)"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leafed(spark, sf_dir).select("leaf", "instrument", F.when(F.col("k") % 7 != 0, F.col("value") - 50).alias("s"), F.round(F.col("k") / 50.0 - 1, 9).alias("o"))


def _scores(df: DataFrame, by: list[str], s: str, threshold: float) -> DataFrame:
    return rounded(evaluation.threshold_score(df, by, s, "o", threshold, 0.9, 0.01), "gross_score", "costs", "net_score", digits=6)


@query(f"WITH {SIGNALS} " + SCORED.format("instrument,", "10", "sg", "instrument"), "ticks", "leaves")
def b1_threshold_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_signals(spark, sf_dir), ["instrument"], "s", 10)


@query(f"WITH {SIGNALS} " + SCORED.format("instrument, leaf,", "10", "sg", "instrument, leaf"), "ticks", "leaves")
def b3_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_signals(spark, sf_dir), ["instrument", "leaf"], "s", 10)


@query(f"""WITH {SIGNALS}, f AS (SELECT instrument, avg(s) AS m, greatest(stddev_pop(s), 1e-12) AS d FROM sg WHERE leaf = 'development' GROUP BY ALL), z AS (SELECT leaf, instrument, (sg.s - m) / d AS s, o FROM sg JOIN f USING (instrument) WHERE leaf = 'holdout') """ + SCORED.format("instrument,", "0.5", "z", "instrument"), "ticks", "leaves")
def b4_fitted_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = evaluation.fit_and_apply(_signals(spark, sf_dir), ["instrument"], "s").where("leaf = 'holdout'")
    return _scores(fitted, ["instrument"], "z", 0.5)


@query(f"""WITH {LEAFED} SELECT instrument, count(*) FILTER (received_ts_ns < event_ts_ns OR event_ts_ns < 0 OR leaf IS NULL) AS violations, CASE WHEN count(*) FILTER (received_ts_ns < event_ts_ns OR event_ts_ns < 0 OR leaf IS NULL) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM lt GROUP BY ALL""", "ticks", "leaves")
def p10_causal_partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("received_ts_ns") < F.col("event_ts_ns")) | (F.col("event_ts_ns") < 0) | F.col("leaf").isNull()
    got = _leafed(spark, sf_dir).groupBy("instrument").agg(F.count_if(bad).alias("violations"))
    return got.withColumn("status", F.when(F.col("violations") == 0, "PASSED").otherwise("FAILED"))
