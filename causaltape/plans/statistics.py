"""Queries over summaries, nulls, matching and survival, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causaltape.functions.clock import floor_div
from causaltape.operators import matching, paths, quantiles, resampling, statistics
from causaltape.operators.asof import carry_sum
from causaltape.plans import fixtures as fx
from causaltape.plans import market
from causaltape.plans.fixtures import sql, table

QUERIES, SQL = {}, {}


def query(text: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = sql(text, *views) if views else text
        return f

    return add


rounded = market.rounded
PRICES = {"q25": 0.25, "q50": 0.5, "q99": 0.99}


@query("""SELECT l_returnflag, count(l_discount) AS n, round(avg(l_discount), 9) AS mean, round(coalesce(var_samp(l_discount), 0), 9) AS var_samp, round(var_pop(l_discount), 9) AS var_pop FROM lineitem GROUP BY ALL""")
def g1_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*statistics.moments("l_discount")), "mean", "var_samp", "var_pop")


@query("""SELECT l_linestatus, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.99), 6) AS q99 FROM lineitem GROUP BY ALL""")
def g2_exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_extendedprice")
    return rounded(quantiles.exact(prices, ["l_linestatus"], "l_extendedprice", PRICES).drop("n"), *PRICES, digits=6)


@query()
def g2_sketched_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same quantiles from one pass, off by a rank of about 0.2 % of the rows; tested against true ranks."""
    return quantiles.sketched(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_extendedprice", PRICES)


RECORDS = """records AS (SELECT instrument, event_type AS state, CASE WHEN k % 7 = 0 THEN NULL ELSE value END AS value FROM ticks)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.ticks(spark, sf_dir).select("instrument", F.col("event_type").alias("state"), F.when(F.col("k") % 7 != 0, F.col("value")).alias("value"))


@query(f"""WITH {RECORDS} SELECT instrument, state, count(*) AS anchors, count(value) AS samples, round(avg(value), 9) AS mean, round(min(value), 9) AS min, round(quantile_cont(value, 0.1), 9) AS p10,
  round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.9), 9) AS p90, round(max(value), 9) AS max FROM records GROUP BY ALL""", "ticks")
def g3_phenotype_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.phenotype_summary(_records(spark, sf_dir), ["instrument", "state"], "value"), "mean", "min", "p10", "median", "p90", "max")


@query(f"WITH {RECORDS} SELECT state, count(*) AS n, round(avg(value), 9) AS mean, min(value) AS min, max(value) AS max FROM records WHERE value IS NOT NULL GROUP BY ALL", "ticks")
def g4_legacy_phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).where("value is not null").groupBy("state").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))


def discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the latest context of each other detector known by then; values may be missing."""
    from causaltape.operators import asof

    a = fx.anchors(spark, sf_dir).withColumn("value", F.when(F.col("k") % 7 != 0, F.col("value") - 50))
    detectors = spark.createDataFrame([("purchase",), ("signup",), ("view",)], "detector string")
    c = fx.contexts(spark, sf_dir).withColumn("context_value", F.when(F.col("context_seq") % 5 != 0, F.col("context_value") - 50))
    got = asof.asof_latest(a.join(F.broadcast(detectors)), c, ["instrument", "detector"], "anchor_time", "available_time", "anchor_seq", "context_seq", ["available_time", "context_value"])
    return got.select("instrument", "detector", "anchor_id", "anchor_time", "value", F.col("ctx_available_time").alias("available_time"), F.col("ctx_context_value").alias("context_value"))


DISCOVERY = """disc AS (SELECT a.instrument, d.detector, a.anchor_id, a.anchor_time, CASE WHEN a.k % 7 <> 0 THEN a.value - 50 END AS value, c.available_time,
    CASE WHEN c.context_seq % 5 <> 0 THEN c.context_value - 50 END AS context_value FROM anchors a CROSS JOIN (VALUES ('purchase'), ('signup'), ('view')) d(detector)
    LEFT JOIN LATERAL (SELECT * FROM contexts c WHERE c.instrument = a.instrument AND c.detector = d.detector AND c.available_time <= a.anchor_time ORDER BY c.available_time DESC, c.context_seq DESC LIMIT 1) c ON true)"""
OK_PAIR = "value IS NOT NULL AND context_value IS NOT NULL"


@query(f"WITH {DISCOVERY} SELECT detector, count(*) AS population, count(available_time) AS present, count(*) - count(available_time) AS missing_context FROM disc GROUP BY ALL", "anchors", "contexts")
def j7_requested_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery(spark, sf_dir).groupBy("detector").agg(F.count("*").alias("population"), F.count("available_time").alias("present"), (F.count("*") - F.count("available_time")).alias("missing_context"))


@query(f"""WITH {DISCOVERY} SELECT instrument, detector, count(*) FILTER ({OK_PAIR}) AS observations, round(nullif(corr(value, context_value) FILTER ({OK_PAIR}), 'nan'::DOUBLE), 9) AS pearson FROM disc GROUP BY ALL""", "anchors", "contexts")
def g5_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("value"), F.col("context_value")
    return discovery(spark, sf_dir).groupBy("instrument", "detector").agg(F.count_if(x.isNotNull() & y.isNotNull()).alias("observations"), F.round(statistics.pearson(x, y), 9).alias("pearson"))


@query(f"""WITH {DISCOVERY} SELECT detector, round(avg(CASE WHEN sign(value) = sign(context_value) THEN 1.0 ELSE 0 END) FILTER ({OK_PAIR} AND value <> 0 AND context_value <> 0), 9) AS concordance FROM disc GROUP BY ALL""", "anchors", "contexts")
def g6_directional_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery(spark, sf_dir).groupBy("detector").agg(F.round(statistics.concordance(F.col("value"), F.col("context_value")), 9).alias("concordance"))


@query(f"WITH {DISCOVERY} SELECT detector, round(avg(anchor_time - available_time) / 1000) AS mean_lag_us FROM disc GROUP BY ALL", "anchors", "contexts")
def g7_mean_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery(spark, sf_dir).groupBy("detector").agg(F.round(F.avg(F.col("anchor_time") - F.col("available_time")) / 1000).alias("mean_lag_us"))


DENOMINATORS = f"""SELECT instrument, detector, count(*) AS population, count(available_time) AS present, count(*) - count(available_time) AS missing_context,
  count(*) FILTER (available_time IS NOT NULL AND value IS NULL) AS missing_anchor_value, count(*) FILTER (available_time IS NOT NULL AND value IS NOT NULL AND context_value IS NULL) AS missing_context_value,
  count(*) FILTER ({OK_PAIR} AND (value = 0 OR context_value = 0)) AS zero_excluded, count(*) FILTER ({OK_PAIR} AND value <> 0 AND context_value <> 0) AS observations,
  round(avg(anchor_time - available_time) / 1000) AS mean_lag_us, round(nullif(corr(value, context_value) FILTER ({OK_PAIR}), 'nan'::DOUBLE), 9) AS pearson,
  round(avg(CASE WHEN sign(value) = sign(context_value) THEN 1.0 ELSE 0 END) FILTER ({OK_PAIR} AND value <> 0 AND context_value <> 0), 9) AS concordance FROM disc GROUP BY ALL"""


@query(f"WITH {DISCOVERY} {DENOMINATORS}", "anchors", "contexts")
def g8_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    from causaltape.operators import population

    found = rounded(population.discover(discovery(spark, sf_dir), ["instrument", "detector"]), "pearson", "concordance")
    return found.withColumn("mean_lag_us", F.round(F.col("mean_lag_ns") / 1000)).drop("mean_lag_ns")


@query(f"""WITH {DISCOVERY} SELECT detector, count(*) FILTER (sign(value) = sign(context_value)) AS concordant, count(*) FILTER (sign(value) <> sign(context_value)) AS discordant,
  min(anchor_time - available_time) AS min_lag_ns, max(anchor_time - available_time) AS max_lag_ns FROM disc GROUP BY ALL""", "anchors", "contexts")
def g9_characterisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.signum("value") == F.signum("context_value")
    lag = F.col("anchor_time") - F.col("available_time")
    return discovery(spark, sf_dir).groupBy("detector").agg(F.count_if(same).alias("concordant"), F.count_if(~same).alias("discordant"), F.min(lag).alias("min_lag_ns"), F.max(lag).alias("max_lag_ns"))


@query("SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY lang, source")
def g10_support_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(counted.agg(F.sum("n").alias("total")))).select("lang", "source", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


@query(fx.fingerprint_sql("anchors", "anchor_id", "anchor_time", "direction"), "anchors")
def g13_output_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.table_fingerprint(fx.anchors(spark, sf_dir).select("anchor_id", "anchor_time", "direction"))


EFFECT = """SELECT p_brand, n_a, n_b, round(ma - mb, 9) AS difference, round(CASE WHEN pooled > 0 THEN (ma - mb) / pooled END, 9) AS cohen_d, round(CASE WHEN pooled > 0 THEN (ma - mb) / pooled * (1 - 3.0 / (4 * (n_a + n_b - 2) - 1)) END, 9) AS hedges_g
  FROM (SELECT *, CASE WHEN n_a + n_b > 2 THEN sqrt(((n_a - 1) * coalesce(va, 0) + (n_b - 1) * coalesce(vb, 0)) / (n_a + n_b - 2)) END AS pooled FROM
  (SELECT p_brand, count(*) FILTER (l_returnflag = 'R') AS n_a, count(*) FILTER (l_returnflag <> 'R') AS n_b, avg(l_quantity) FILTER (l_returnflag = 'R') AS ma, avg(l_quantity) FILTER (l_returnflag <> 'R') AS mb,
  var_samp(l_quantity) FILTER (l_returnflag = 'R') AS va, var_samp(l_quantity) FILTER (l_returnflag <> 'R') AS vb FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand))"""


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_quantity"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return statistics.effect_size(l.join(p, F.col("l_partkey") == F.col("p_partkey")), F.col("l_returnflag") == "R", "l_quantity", ["p_brand"])


@query(EFFECT)
def g14_effect_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_effects(spark, sf_dir), "difference", "cohen_d", "hedges_g")


@query("SELECT count(DISTINCT instrument) AS instruments, count(DISTINCT event_type) AS detectors, min(received_ts_ns) AS first_ns, max(received_ts_ns) AS last_ns FROM ticks", "ticks")
def g15_scope_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.ticks(spark, sf_dir).agg(F.count_distinct("instrument").alias("instruments"), F.count_distinct("event_type").alias("detectors"), F.min("received_ts_ns").alias("first_ns"), F.max("received_ts_ns").alias("last_ns"))


BASE_PATHS = f"""{market.PATHS}, base AS (SELECT horizon, round(signed_return, 9) AS v FROM paths WHERE signed_return IS NOT NULL AND complete),
  ranked AS (SELECT horizon, v, row_number() OVER (PARTITION BY horizon ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY horizon) AS n FROM base),
  reference AS (SELECT horizon, max(n) AS n, max(v) FILTER (i = 25 * (n - 1) // 100) AS q25, max(v) FILTER (i = 50 * (n - 1) // 100) AS median, max(v) FILTER (i = 75 * (n - 1) // 100) AS q75 FROM ranked GROUP BY horizon)"""


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market._paths(spark, sf_dir).where("complete and signed_return is not null").select("horizon", "anchor_id", F.round("signed_return", 9).alias("v"))


@query(f"""WITH {BASE_PATHS} SELECT horizon, n, q25, median, q75, round(q75 - q25, 9) AS iqr, CASE WHEN n < 150 THEN 'INSUFFICIENT_SUPPORT' WHEN n < 300 THEN 'LOW_SUPPORT_FALLBACK' ELSE 'SUPPORTED' END AS support FROM reference""", "ticks", "anchors", "horizons")
def g17_baseline_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = statistics.nearest_rank(_base(spark, sf_dir), ["horizon"], "v", {"q25": 25, "median": 50, "q75": 75})
    return ref.withColumn("iqr", F.round(F.col("q75") - F.col("q25"), 9)).withColumn("support", statistics.support_label(F.col("n")))


@query("""SELECT band, count(*) AS support, min(k) AS low, max(k) AS high, CAST(sum(anchor_id) AS BIGINT) AS id_sum FROM
  (SELECT *, least((rank() OVER (ORDER BY k) - 1) * 100 // count(*) OVER () // 20, 4)::INTEGER AS band FROM anchors) GROUP BY band""", "anchors")
def g18_quintile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.bands(fx.anchors(spark, sf_dir), "k").groupBy("band").agg(F.count("*").alias("support"), F.min("k").alias("low"), F.max("k").alias("high"), F.sum("anchor_id").alias("id_sum"))


@query("""SELECT instrument, count(*) AS rows, count(*) FILTER (source_sequence % 10 = 0) AS absent, count(*) FILTER (source_sequence % 10 = 1) AS malformed, count(*) FILTER (source_sequence % 10 > 1) AS parsed FROM snapshots GROUP BY ALL""", "snapshots")
def g19_payload_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    from causaltape.sources.lake import payload_counts

    whole = F.to_json(F.struct(F.struct("state", F.col("eid").alias("event_id")).alias("drift_burst_state")))
    rows = fx.snapshots(spark, sf_dir).withColumn("payload", F.when(F.col("source_sequence") % 10 == 1, "{broken").when(F.col("source_sequence") % 10 != 0, whole))
    return payload_counts(rows, "payload", ["instrument"])


SURVIVAL = """obs AS (SELECT abs(date_diff('day', o_orderdate, first_ship)) AS t, o_orderstatus = 'F' AS event FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey),
  per AS (SELECT t AS days, count(*) FILTER (event) AS events, count(*) FILTER (NOT event) AS censored FROM obs GROUP BY t),
  risk AS (SELECT *, CAST(sum(events + censored) OVER (ORDER BY days ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS at_risk FROM per), h AS (SELECT *, events / at_risk AS hazard FROM risk)"""


@query(f"""WITH {SURVIVAL} SELECT CAST(days AS INTEGER) AS days, events, censored, at_risk, round(hazard, 9) AS hazard, round(CASE WHEN max(CASE WHEN hazard >= 1 THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE coalesce(exp(sum(CASE WHEN hazard < 1 THEN ln(1 - hazard) END) OVER w), 1) END, 9) AS survival,
  round(sum(hazard) OVER w, 9) AS cumulative_hazard FROM h WINDOW w AS (ORDER BY days ROWS UNBOUNDED PRECEDING)""")
def w19_survival_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("ship"))
    obs = table(spark, sf_dir, "orders").join(first, "o_orderkey").select(F.abs(F.datediff("ship", "o_orderdate")).alias("days"), (F.col("o_orderstatus") == "F").alias("event"))
    return rounded(statistics.survival(obs, "days", "event"), "hazard", "survival", "cumulative_hazard")


MATCHING = """unit AS (SELECT d.doc_id AS id, lang AS stratum, toxic = 1 AS treated, CAST(quality AS DOUBLE) AS outcome, ln(n_chars) AS x FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
  pairs AS (SELECT t.stratum, t.id AS treated_id, c.id AS control_id, t.outcome AS treated_outcome, c.outcome AS control_outcome, abs(t.x - c.x) AS distance FROM unit t JOIN unit c ON t.stratum = c.stratum AND t.treated AND NOT c.treated AND abs(t.x - c.x) <= 0.25)"""


def _units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    units = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("stratum"), F.col("toxic"), F.col("quality").cast("double").alias("outcome"), F.array(F.ln("n_chars")).alias("covariates"))
    return units.where("toxic = 1"), units.where("toxic = 0")


@query(f"""WITH {MATCHING} SELECT stratum, treated_id, control_id, round(distance, 9) AS distance, treated_outcome, control_outcome FROM (SELECT *, row_number() OVER (PARTITION BY treated_id ORDER BY distance, control_id) AS r FROM pairs) WHERE r = 1""")
def j8_nearest_control_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matching.nearest_control(*_units(spark, sf_dir), 0.25, 1).select("stratum", "treated_id", "control_id", "distance", "treated_outcome", "control_outcome"), "distance")


@query()
def j8_nearest_control_no_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matching.nearest_without_reuse(*_units(spark, sf_dir), 0.25), "distance")


@query(f"""WITH {MATCHING} SELECT stratum, treated_id, control_id, round(distance, 9) AS distance FROM pairs QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY distance, treated_id, control_id) = 1""")
def t4_nearest_one_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = matching.nearest_control(*_units(spark, sf_dir), 0.25, 1).groupBy("stratum").agg(F.min(F.struct("distance", "treated_id", "control_id")).alias("b"))
    return best.select("stratum", F.col("b.treated_id").alias("treated_id"), F.col("b.control_id").alias("control_id"), F.round("b.distance", 9).alias("distance"))


DRAW = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
BLOCKS = """vals AS (SELECT date_trunc('month', l_shipdate)::DATE::VARCHAR AS block, l_discount - 0.05 AS v FROM lineitem), sums AS (SELECT block, count(v) AS n, sum(v) AS s FROM vals GROUP BY block),
  tot AS (SELECT sum(n) AS total_n, sum(s) / sum(n) AS observed, count(*) AS blocks, min(n) AS least FROM sums), numbered AS (SELECT *, row_number() OVER (ORDER BY block) - 1 AS no FROM sums)"""


@query(f"""WITH {BLOCKS}, draws AS (SELECT rep, k, {DRAW.format("'7:' || rep || ':' || k")} % blocks AS no, total_n, observed FROM range(4999) r(rep), tot, LATERAL (SELECT unnest(range(CAST(ceil(total_n / least) AS BIGINT))) AS k)),
  run AS (SELECT d.*, n, s, coalesce(sum(n) OVER (PARTITION BY rep ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM draws d JOIN numbered USING (no)),
  m AS (SELECT rep, sum(s - n * observed) / sum(n) AS m, any_value(observed) AS observed FROM run WHERE before < total_n GROUP BY rep)
  SELECT round(any_value(observed), 9) AS observed, count(*) FILTER (abs(m) >= abs(observed)) AS exceedances, 4999 AS draws, round((count(*) FILTER (abs(m) >= abs(observed)) + 1) / 5000, 9) AS p_value FROM m""")
def n1_block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    vals = table(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month").cast("string").alias("block"), (F.col("l_discount") - 0.05).alias("v"))
    return rounded(statistics.block_bootstrap(vals, "block", "v", 4999, 7), "observed", "p_value")


PERMUTED = """vals AS (SELECT l_orderkey * 10 + l_linenumber AS id, date_trunc('month', l_shipdate)::DATE::VARCHAR AS block, l_discount AS v, l_returnflag = 'R' AS g FROM lineitem)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.trunc("l_shipdate", "month").cast("string").alias("block"), F.col("l_discount").alias("v"), (F.col("l_returnflag") == "R").alias("g"))


@query(f"""WITH {PERMUTED}, b AS (SELECT block, count(*) AS n, count(*) FILTER (g) AS t, sum(v) AS s, sum(v * v) AS ss, sum(v) FILTER (g) AS st FROM vals GROUP BY block),
  k AS (SELECT sum(t) AS nt, sum(n) - sum(t) AS nc, sum(s) AS s, sum(st) AS st, sum(t * s / n) AS m, sum(CASE WHEN n > 1 THEN t * (n - t) / (n - 1) * (ss / n - (s / n) ** 2) ELSE 0 END) AS var FROM b)
  SELECT round(st / nt - (s - st) / nc, 9) AS observed, round(m / nt - (s - m) / nc, 9) AS null_mean, round(sqrt(var) * (1 / nt + 1 / nc), 9) AS null_sd, 4999 AS draws, true AS drawn_like_exact FROM k""")
def n2_block_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The null of 4,999 shuffles: its exact mean and deviation, and whether those of the draws are within five standard
    errors of them."""
    got = resampling.block_permutation_null(_labelled(spark, sf_dir), "block", "g", "v", 4999, 11)
    near = (F.abs(F.col("drawn_mean") - F.col("null_mean")) <= 5 * F.col("null_sd") / 4999**0.5) & (F.abs(F.col("drawn_sd") / F.col("null_sd") - 1) <= 5 / (2 * 4999) ** 0.5)
    return rounded(got.select("observed", "null_mean", "null_sd", "draws", near.alias("drawn_like_exact")), "observed", "null_mean", "null_sd")


@query()
def n2_permutation_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resampling.block_permutation_null(_labelled(spark, sf_dir), "block", "g", "v", 4999, 11).select("observed", "exceedances", "draws", "p_value"), "observed", "p_value")


@query(f"""WITH {PERMUTED}, o AS (SELECT avg(v) FILTER (g) - avg(v) FILTER (NOT g) AS observed FROM vals), sized AS (SELECT *, count(*) FILTER (g) OVER (PARTITION BY block) AS treated FROM vals),
  shuffled AS (SELECT rep, v, row_number() OVER (PARTITION BY rep, block ORDER BY {DRAW.format("'11:' || rep || ':' || id")}, id) <= treated AS g FROM sized, range(19) r(rep)),
  d AS (SELECT rep, avg(v) FILTER (g) - avg(v) FILTER (NOT g) AS d FROM shuffled GROUP BY rep)
  SELECT round(any_value(observed), 9) AS observed, count(*) FILTER (abs(d) >= abs(observed)) AS exceedances, 19 AS draws, round((count(*) FILTER (abs(d) >= abs(observed)) + 1) / 20, 9) AS p_value FROM d, o""")
def n2_block_permutation_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels dealt row by row, which SQL can follow: rows times replicates, so for few of them."""
    return rounded(statistics.block_permutation(_labelled(spark, sf_dir), "block", "g", "v", "id", 19, 11), "observed", "p_value")


SHIFT = """xy AS (SELECT instrument, row_number() OVER (PARTITION BY instrument ORDER BY source_sequence) - 1 AS pos, mid AS x, k::DOUBLE AS y FROM ticks), sz AS (SELECT instrument, count(*) AS size FROM xy GROUP BY ALL)"""


@query(f"""WITH {SHIFT}, o AS (SELECT corr(x, y) AS observed FROM xy), moved AS (SELECT rep, instrument, (pos + {DRAW.format("'13:' || rep || ':' || instrument")} % size) % size AS pos, x FROM xy JOIN sz USING (instrument), range(4999) r(rep)),
  st AS (SELECT rep, corr(m.x, v.y) AS r FROM moved m JOIN xy v ON v.instrument = m.instrument AND v.pos = m.pos GROUP BY rep)
  SELECT round(any_value(observed), 9) AS observed, count(*) FILTER (abs(r) >= abs(observed) * (1 - 1e-9)) AS exceedances, 4999 AS draws, round((count(*) FILTER (abs(r) >= abs(observed) * (1 - 1e-9)) + 1) / 5000, 9) AS p_value FROM st, o""", "ticks")
def n3_circular_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.ticks(spark, sf_dir).select("instrument", "source_sequence", F.col("mid").alias("x"), F.col("k").cast("double").alias("y"))
    numbered = carry_sum(t.withColumn("span", floor_div(F.col("source_sequence"), 100_000)), ["instrument"], [F.col("source_sequence")], F.lit(1), "span", "no")
    xy = numbered.select("instrument", (F.col("no") - 1).alias("pos"), "x", "y")
    return rounded(resampling.circular_shift_null(xy, "instrument", "pos", "x", "y", 4999, 13), "observed", "p_value")


FAMILY = f"""family AS (SELECT p_brand, CASE WHEN n_a + n_b >= 30 THEN round(exp(-abs(cohen_d) * 20), 12) END AS p FROM ({EFFECT}))"""


def _family(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rounded(_effects(spark, sf_dir), "cohen_d")
    return e.select("p_brand", F.when(F.col("n_a") + F.col("n_b") >= 30, F.round(F.exp(-F.abs("cohen_d") * 20), 12)).alias("p"))


def _fdr_sql(c: str) -> str:
    return f"""WITH {FAMILY}, r AS (SELECT *, count(*) OVER () AS m, {c} AS c, CASE WHEN p IS NOT NULL THEN rank() OVER (ORDER BY p NULLS LAST) + count(p) OVER (PARTITION BY p) - 1 END AS rank FROM family),
  a AS (SELECT p_brand, p, CASE WHEN p IS NOT NULL THEN least(min(p * m * c / rank) OVER (ORDER BY p DESC NULLS FIRST RANGE UNBOUNDED PRECEDING), 1) END AS adjusted FROM r)
  SELECT p_brand, p, round(adjusted, 9) AS adjusted, adjusted <= 0.05 AS rejected FROM a"""


@query(_fdr_sql("1"))
def n4_fdr_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.false_discovery(_family(spark, sf_dir), "p"), "adjusted")


@query(_fdr_sql("(SELECT sum(1.0 / i) FROM range(1, (SELECT count(*) FROM family) + 1) q(i))"))
def n4_fdr_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.false_discovery(_family(spark, sf_dir), "p", dependent=True), "adjusted")


@query(f"""WITH {FAMILY}, r AS (SELECT *, (count(p) OVER () - rank() OVER (ORDER BY p NULLS LAST) + 1) * p AS raw FROM family), h AS (SELECT p_brand, p, CASE WHEN p IS NOT NULL THEN least(max(raw) OVER (ORDER BY p NULLS LAST RANGE UNBOUNDED PRECEDING), 1) END AS holm FROM r)
  SELECT p_brand, p, round(holm, 9) AS holm, holm <= 0.05 AS holm_rejected FROM h""")
def n8_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.holm(_family(spark, sf_dir), "p"), "holm")


#: Null worlds; one draw of a row flips its sign in 32 of them.
NULLS = 4999
WORLDS = f"""obs AS (SELECT instrument, round(avg(value) - 50, 9) AS stat FROM ticks GROUP BY ALL), drawn AS (SELECT instrument, value, c, {DRAW.format("'5:' || c || ':' || source_sequence")} AS d FROM ticks, range({-(-NULLS // 32)}) q(c)),
  worlds AS (SELECT c * 32 + j AS w, instrument, round(avg(CASE WHEN (d >> j::INTEGER) & 1 = 0 THEN value - 50 ELSE 50 - value END), 9) AS stat FROM drawn, range(32) b(j) WHERE c * 32 + j < {NULLS} GROUP BY ALL)"""


def _worlds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = fx.ticks(spark, sf_dir).select("instrument", "source_sequence", "value")
    obs = t.groupBy("instrument").agg(F.round(F.avg("value") - 50, 9).alias("stat"))
    worlds = resampling.sign_flip_means(t.withColumn("v", F.col("value") - 50), "instrument", "source_sequence", "v", NULLS, 5)
    return obs, worlds.withColumn("stat", F.round("stat", 9))


@query(f"""WITH {WORLDS}, tops AS (SELECT w, max(abs(stat)) AS top FROM worlds GROUP BY w) SELECT instrument, stat, count(*) FILTER (top >= abs(stat)) AS exceedances, count(*) AS worlds, round((count(*) FILTER (top >= abs(stat)) + 1) / (count(*) + 1), 9) AS p_value FROM obs, tops GROUP BY instrument, stat""", "ticks")
def n6_max_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.max_statistic(*_worlds(spark, sf_dir), "w", "instrument", "stat"), "p_value")


@query(f"""WITH {WORLDS}, tops AS (SELECT w, max(abs(stat)) AS top FROM worlds GROUP BY w) SELECT instrument, CAST(w AS INTEGER) AS w, stat, CAST(sum(CASE WHEN top >= abs(stat) THEN 1 ELSE 0 END) OVER q AS BIGINT) AS exceedances, count(*) OVER q AS worlds,
  round((sum(CASE WHEN top >= abs(stat) THEN 1 ELSE 0 END) OVER q + 1) / (count(*) OVER q + 1), 9) AS p_value FROM obs, tops WINDOW q AS (PARTITION BY instrument ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "ticks")
def r7_max_statistic_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same accumulator world by world."""
    return rounded(statistics.max_statistic_running(*_worlds(spark, sf_dir), "w", "instrument", "stat"), "p_value")


@query("SELECT event_type, count(*) FILTER (value >= 99) AS exceedances, count(*) AS draws, round((count(*) FILTER (value >= 99) + 1) / (count(*) + 1), 9) AS p_value FROM ticks GROUP BY event_type", "ticks")
def n5_finite_sample_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = fx.ticks(spark, sf_dir).groupBy("event_type").agg(F.count_if(F.col("value") >= 99).alias("exceedances"), F.count("*").alias("draws"))
    return rounded(counted.withColumn("p_value", statistics.p_value(F.col("exceedances"), F.col("draws"))), "p_value")


@query("SELECT instrument, source_sequence, " + DRAW.format("'3:' || source_sequence") + " AS draw, round((" + DRAW.format("'3:' || source_sequence") + " % 100 + 1) / 101.0, 9) AS p FROM ticks", "ticks")
def n7_seeded_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = statistics.draw(3, F.col("source_sequence"))
    return fx.ticks(spark, sf_dir).select("instrument", "source_sequence", d.alias("draw"), F.round(statistics.p_value(d % 100, 100), 9).alias("p"))


@query(f"""WITH {BASE_PATHS} SELECT b.horizon, round(quantile_cont(b.v, 0.5), 9) AS median_effect, any_value(r.median) AS baseline_median, round(any_value(q75 - q25), 9) AS iqr, abs(quantile_cont(b.v, 0.5) - any_value(r.median)) >= 0.1 * any_value(q75 - q25) AS material
  FROM base b JOIN reference r USING (horizon) GROUP BY b.horizon""", "ticks", "anchors", "horizons")
def x3_materiality(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _base(spark, sf_dir)
    ref = statistics.nearest_rank(base, ["horizon"], "v", {"q25": 25, "median": 50, "q75": 75})
    effect = base.groupBy("horizon").agg(F.percentile("v", 0.5).alias("e")).join(ref, "horizon")
    iqr = F.col("q75") - F.col("q25")
    return effect.select("horizon", F.round("e", 9).alias("median_effect"), F.col("median").alias("baseline_median"), F.round(iqr, 9).alias("iqr"), (F.abs(F.col("e") - F.col("median")) >= 0.1 * iqr).alias("material"))


@query(f"WITH {BASE_PATHS} SELECT horizon, round(sum(v / (q75 - q25)), 6) AS total, count(*) AS n FROM base JOIN reference USING (horizon) GROUP BY horizon".replace("count(*) AS n FROM base", "count(*) AS cnt FROM base"), "ticks", "anchors", "horizons")
def x4_normalised_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _base(spark, sf_dir)
    ref = statistics.nearest_rank(base, ["horizon"], "v", {"q25": 25, "q75": 75})
    return base.join(ref, "horizon").groupBy("horizon").agg(F.round(F.sum(F.col("v") / (F.col("q75") - F.col("q25"))), 6).alias("total"), F.count("*").alias("cnt"))
