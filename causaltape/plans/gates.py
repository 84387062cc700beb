"""Queries over scans, gates, scalar functions, sorts and sets, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causaltape.functions import clock, scalars
from causaltape.operators import merge, population, quality, statistics
from causaltape.operators.asof import carry_sum
from causaltape.plans import fixtures as fx
from causaltape.plans import market
from causaltape.plans.fixtures import sql, table
from causaltape.sources import lake
from causaltape.sources.lake import cut, shared

QUERIES, SQL = {}, {}


def query(text: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = sql(text, *views) if views else text
        return f

    return add


rounded = market.rounded
B = fx.DEVELOPMENT_END


# Scans and sinks


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49")
def s1_projected_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.scan(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"]).where("l_quantity > 49")


@query("SELECT count(*) AS rows, CAST(ceil(count(*) / 65536) AS BIGINT) AS batches, true AS has_bytes, CAST(1 AS BIGINT) AS parts, true AS timed FROM lineitem")
def s2_scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL knows no file size and no time, so the query returns whether they were taken."""
    seen = lake.scan_report(table(spark, sf_dir, "lineitem"))
    return seen.select("rows", "batches", (F.col("bytes") > 0).alias("has_bytes"), "parts", (F.col("elapsed_s") > 0).alias("timed"))


@query("""WITH p AS (SELECT event_ts_ns // 86400000000000 AS day, count(*) AS rows, min(received_ts_ns * 1000000000::HUGEINT + source_sequence) AS a, max(received_ts_ns * 1000000000::HUGEINT + source_sequence) AS z FROM ticks GROUP BY ALL)
  SELECT day, rows, CAST(coalesce(sum(rows) OVER w, 0) AS BIGINT) AS rows_before, coalesce(a > max(z) OVER w, true) AS follows FROM p WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "ticks")
def s3_multi_part_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a day each: the running count and the last key are carried over their borders, where late rows show."""
    t = fx.ticks(spark, sf_dir).withColumn("day", clock.floor_div(F.col("event_ts_ns"), fx.DAY))
    return lake.ordered_parts(t, "day", ["received_ts_ns", "source_sequence"])


@query("SELECT event_id, 'events.parquet' AS part, row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM events")
def s4_row_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.with_source(table(spark, sf_dir, "events")).select("event_id", "part", "row_index")


@query("SELECT 'orders.parquet' AS part, count(*) AS rows, true AS has_bytes, min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey, min(o_orderdate) AS min_o_orderdate, max(o_orderdate) AS max_o_orderdate FROM orders")
def s5_part_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory = lake.part_inventory(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderdate"])
    return inventory.withColumn("has_bytes", F.col("bytes") > 0).drop("bytes")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01' ")
def s6_cutoff_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter reaches the Parquet scan, which skips row groups past the cutoff."""
    return table(spark, sf_dir, "orders").where("o_orderdate < timestamp_ntz'1995-03-01 00:00:00'").select("o_orderkey", "o_totalprice")


@query(f"WITH {market.AVAILABLE} SELECT timeframe, count(*) AS records, max(available_time_ns) AS last_ns FROM avail WHERE available_time_ns < {B} GROUP BY ALL", "ticks", "frames")
def s7_json_availability_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability records written as JSON lines and read back below the cutoff."""
    records = market._availability(spark, sf_dir)
    path = shared(spark, "availability")
    lake.write_new(records, path, "json")
    back = lake.read_records(spark, path, "instrument long, timeframe string, bar_close_ns long, available_time_ns long", "available_time_ns", B)
    return back.groupBy("timeframe").agg(F.count("*").alias("records"), F.max("available_time_ns").alias("last_ns"))


@query(f"""WITH {market.AVAILABLE} {fx.fingerprint_sql("avail", "available_time_ns", "bar_close_ns", "bar_open_ns", "instrument", "timeframe", "trigger_sequence")}""", "ticks", "frames")
def s8_json_sink_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once, never over an existing path, and read back with the same fingerprint."""
    records = market._availability(spark, sf_dir)
    path = shared(spark, "availability")
    lake.write_new(records, path, "json")
    both = statistics.table_fingerprint(records).unionByName(statistics.table_fingerprint(spark.read.schema(records.schema).json(path)))
    return both.groupBy("rows", "xor", "sum").agg(F.count("*").alias("n")).where("n = 2").drop("n")


@query(f"SELECT count(*) AS rows, max(received_ts_ns) AS last_ns FROM ticks WHERE event_ts_ns < {B} AND received_ts_ns < {B}", "ticks")
def s9_filtered_parquet_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = fx.ticks(spark, sf_dir)
    path = shared(spark, "view")
    lake.write_new(quality.development_filter(ticks, ["event_ts_ns", "received_ts_ns"], B), path)
    back = spark.read.parquet(path)
    if [(f.name, f.dataType) for f in back.schema] != [(f.name, f.dataType) for f in ticks.schema]:
        raise ValueError("the written view changed its schema")
    return back.agg(F.count("*").alias("rows"), F.max("received_ts_ns").alias("last_ns"))


@query(f"WITH {market.PATHS} SELECT horizon, count(*) AS paths, count(*) FILTER (complete) AS complete FROM paths GROUP BY ALL", "ticks", "anchors", "horizons")
def s10_path_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared(spark, "paths")
    lake.write_new(market._paths(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("horizon").agg(F.count("*").alias("paths"), F.count_if("complete").alias("complete"))


@query("SELECT instrument, scale, bar_close_ts AS anchor_ms, close AS anchor_close FROM bars", "bars")
def s11_completed_bar_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every completed bar as an anchor at its close; bars whose closes do not rise are refused."""
    bars = quality.require_rising(cut(fx.bars(spark, sf_dir), "bars"), ["instrument", "scale"], "bar_open_ts", "bar_close_ts")
    return bars.select("instrument", "scale", F.col("bar_close_ts").alias("anchor_ms"), F.col("close").alias("anchor_close"))


@query("""SELECT part, declared, found, CASE WHEN found IS NULL THEN 'MISSING' WHEN declared IS NULL THEN 'UNDECLARED' WHEN declared = found THEN 'OK' ELSE 'ROW_COUNT_DIFFERS' END AS status FROM
  (SELECT event_type AS part, count(*) AS declared FROM events WHERE event_type <> 'view' GROUP BY 1 UNION ALL SELECT 'nowhere', 1) d FULL JOIN (SELECT event_type AS part, count(*) FILTER (event_type <> 'click' OR event_id % 2 = 0) AS found FROM events GROUP BY 1) f USING (part)""")
def s12_manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "part")
    manifest = e.where("part <> 'view'").groupBy("part").agg(F.count("*").alias("rows")).unionByName(spark.createDataFrame([("nowhere", 1)], "part string, rows long"))
    actual = e.groupBy("part").agg(F.count_if((F.col("part") != "click") | (F.col("event_id") % 2 == 0)).alias("rows"))
    return lake.manifest_check(manifest, actual)


CLASSES = f"""SELECT instrument, count(*) AS rows, count(*) FILTER (event_ts_ns < {B} AND received_ts_ns < {B}) AS eligible, min(received_ts_ns) AS min_received_ts_ns, max(received_ts_ns) AS max_received_ts_ns,
  CASE WHEN count(*) FILTER (event_ts_ns < {B} AND received_ts_ns < {B}) = count(*) THEN 'FULL_DEVELOPMENT' WHEN count(*) FILTER (event_ts_ns < {B} AND received_ts_ns < {B}) = 0 THEN 'FULL_CONFIRMATION' ELSE 'MIXED' END AS class FROM {{0}} GROUP BY instrument"""
PARTED = f"parted AS (SELECT * REPLACE (instrument * 10 + CASE WHEN received_ts_ns < {B} - 86400000000000 THEN 0 WHEN received_ts_ns < {B} + 86400000000000 THEN 1 ELSE 2 END AS instrument) FROM ticks)"


def _parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("received_ts_ns")
    return fx.ticks(spark, sf_dir).withColumn("instrument", F.col("instrument") * 10 + F.when(r < B - fx.DAY, 0).when(r < B + fx.DAY, 1).otherwise(2))


@query(f"WITH {PARTED}, kept AS (SELECT * FROM parted WHERE event_ts_ns < {B} AND received_ts_ns < {B}) SELECT instrument, rows, class FROM ({CLASSES.format('kept')})", "ticks")
def s13_development_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts classified, filtered, written and verified: the manifest of what was written."""
    view = quality.development_filter(_parted(spark, sf_dir), ["event_ts_ns", "received_ts_ns"], B)
    path = shared(spark, "view")
    lake.write_new(view, path)
    return quality.classify(spark.read.parquet(path), ["instrument"], ["event_ts_ns", "received_ts_ns"], B).select("instrument", "rows", "class")


# Filters and gates


@query(f"SELECT instrument, source_sequence FROM ticks WHERE event_ts_ns < {B} AND received_ts_ns < {B}", "ticks")
def q1_development_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.development_filter(fx.ticks(spark, sf_dir), ["event_ts_ns", "received_ts_ns"], B).select("instrument", "source_sequence")


@query(f"WITH {PARTED} {CLASSES.format('parted')}", "ticks")
def q2_part_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_parted(spark, sf_dir), ["instrument"], ["event_ts_ns", "received_ts_ns"], B).drop("min_event_ts_ns", "max_event_ts_ns")


@query("""SELECT count(*) FILTER (r < pr OR (r = pr AND s < ps)) AS regressions, count(*) FILTER (r = pr AND s = ps) AS repeats FROM (SELECT received_ts_ns AS r, source_sequence AS s, lag(received_ts_ns) OVER (ORDER BY source_sequence) AS pr, lag(source_sequence) OVER (ORDER BY source_sequence) AS ps FROM ticks)""", "ticks")
def q3_ordering_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = fx.ticks(spark, sf_dir).withColumn("part", clock.floor_div(F.col("source_sequence"), 1000))
    return quality.ordering_regressions(parts, ["part"], "source_sequence", ["received_ts_ns", "source_sequence"])


@query("SELECT count(*) AS rows, count(*) FILTER (received_ts_ns < event_ts_ns) AS causal_violations, count(*) FILTER (event_ts_ns % 1000000 <> 0) AS sub_millisecond, count(*) FILTER (eid IS NULL) AS null_eid, count(*) FILTER (weak_ms IS NULL) AS null_weak_ms FROM snapshots", "snapshots")
def q4_clock_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clock_counters(fx.snapshots(spark, sf_dir), "event_ts_ns", "received_ts_ns", ["eid", "weak_ms"])


@query(f"""WITH {PARTED}, f AS ({CLASSES.format('parted')}) SELECT instrument, list_filter([CASE WHEN instrument // 10 = 3 THEN 'ROWS_DIFFER' END, CASE WHEN class <> 'FULL_DEVELOPMENT' THEN 'BEYOND_BOUNDARY' END], x -> x IS NOT NULL) AS faults FROM f""".replace("list_filter(", "array_to_string(list_filter(").replace("x -> x IS NOT NULL)", "lambda x: x IS NOT NULL), ',')"), "ticks")
def q5_verify_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view, clocks = _parted(spark, sf_dir), ["event_ts_ns", "received_ts_ns"]
    declared = quality.classify(view, ["instrument"], clocks, B).select("instrument", (F.col("rows") + F.floor(F.col("instrument") / 10).eqNullSafe(3).cast("long")).alias("rows"), *[f"max_{c}" for c in clocks])
    return quality.verify_view(view, declared, ["instrument"], clocks, B).select("instrument", F.array_join("faults", ",").alias("faults"))


@query("""SELECT violations, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN event_ts_ns < 0 THEN 'BAD_TIME' END, CASE WHEN source_sequence % 20 = 0 THEN 'NO_AVAILABILITY' WHEN received_ts_ns > event_ts_ns + 500000000 THEN 'NOT_YET_KNOWN' END, CASE WHEN event_type = 'view' THEN 'NO_IDENTITY' END) AS violations FROM ticks) GROUP BY ALL""", "ticks")
def q6_causal_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.ticks(spark, sf_dir)
    known = F.when(F.col("source_sequence") % 20 != 0, F.col("received_ts_ns") - 500_000_000)
    rules = population.causal_violations(F.col("event_ts_ns"), known, F.col("value"), F.when(F.col("event_type") != "view", F.col("event_type")))
    return t.select(F.array_join(rules, ",").alias("violations")).groupBy("violations").agg(F.count("*").alias("n"))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q7_unique_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.key_faults(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("""WITH m AS (SELECT event_type AS detector, count(*) AS observations, round(corr(value, k), 9) AS metric FROM ticks GROUP BY ALL) SELECT detector, observations, metric, coalesce(observations >= s AND abs(metric) >= a, false) AS eligible,
  CASE WHEN s IS NULL THEN 'NO_PREDECLARED_GATE' WHEN observations >= s AND abs(metric) >= a THEN 'PREDECLARED_GATE_PASSED' ELSE 'PREDECLARED_GATE_NOT_PASSED' END AS reason FROM m LEFT JOIN (VALUES ('click', 10, 0.0), ('view', 10, 0.9), ('signup', 1000000, 0.0)) g(detector, s, a) USING (detector)""", "ticks")
def q8_candidate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = fx.ticks(spark, sf_dir).groupBy(F.col("event_type").alias("detector")).agg(F.count("*").alias("observations"), F.round(statistics.pearson(F.col("value"), F.col("k")), 9).alias("metric"))
    gates = spark.createDataFrame([("click", 10, 0.0), ("view", 10, 0.9), ("signup", 1000000, 0.0)], "detector string, min_support long, min_abs_metric double")
    return population.candidate_gate(metrics, gates, ["detector"], "metric").drop("min_support", "min_abs_metric")


@query("SELECT strategy_id, count(*) AS points, count(*) - count(DISTINCT day) AS repeats, true AS same_grid FROM streams GROUP BY ALL", "streams")
def q9_time_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.grid_check(fx.streams(spark, sf_dir), "strategy_id", "day")
    first = got.agg(F.min("grid").alias("g"), F.max("grid").alias("h"))
    return got.join(F.broadcast(first)).select("strategy_id", "points", "repeats", (F.col("g") == F.col("h")).alias("same_grid"))


@query("SELECT instrument, detector, count(*) AS n FROM contexts WHERE (instrument, detector) IN (VALUES (0, 'view'), (1, 'view'), (1, 'signup')) GROUP BY ALL", "contexts")
def q10_allowed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    allow = spark.createDataFrame([(0, "view"), (1, "view"), (1, "signup")], "instrument long, detector string")
    return quality.allowed(fx.contexts(spark, sf_dir), allow, ["instrument", "detector"]).groupBy("instrument", "detector").agg(F.count("*").alias("n"))


@query("SELECT concat_ws(',', CASE WHEN quality IS NULL THEN 'x' END, CASE WHEN NOT coalesce(p BETWEEN 0 AND 1, false) THEN 'p' END) AS faults, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 <> 0 THEN quality END AS quality, quality + toxic * 0.5 AS p FROM labels) GROUP BY ALL")
def q11_numeric_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 5 != 0, F.col("quality").cast("double")).alias("x"), (F.col("quality") + F.col("toxic") * 0.5).alias("p"))
    return rows.select(F.array_join(quality.numeric_faults(["x"], ["p"]), ",").alias("faults")).groupBy("faults").agg(F.count("*").alias("n"))


# Scalar functions


@query("SELECT source_sequence, state, eid FROM snapshots", "snapshots")
def f1_payload_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.to_json(F.struct(F.struct("state", F.col("eid").alias("event_id")).alias("drift_burst_state")))
    parsed = scalars.parse_payload(text).getField("drift_burst_state")
    return fx.snapshots(spark, sf_dir).select("source_sequence", parsed.state.alias("state"), parsed.event_id.alias("eid"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def f2_json_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT CASE WHEN s IN ('IDLE', 'DEVELOPING', 'BURST', 'DECAY_RISK', 'DYING') THEN s ELSE 'OTHER' END AS label, count(*) AS n FROM (SELECT CASE WHEN source_sequence % 11 = 0 THEN 'NEW' ELSE state END AS s FROM snapshots) GROUP BY ALL", "snapshots")
def f3_state_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("source_sequence") % 11 == 0, " new").otherwise(F.lower("state"))
    return fx.snapshots(spark, sf_dir).select(scalars.state_label(raw).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT source_sequence, round(ln(ask / bid), 9) AS spread, CAST(sign(value - 50) AS DOUBLE) AS side, round(sqrt(abs(value - 50)), 9) AS root, round(pow(value, 2), 6) AS square FROM ticks", "ticks")
def f4_price_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return fx.ticks(spark, sf_dir).select("source_sequence", F.round(scalars.log_return(F.col("ask"), F.col("bid")), 9).alias("spread"), F.signum(v - 50).alias("side"), F.round(F.sqrt(F.abs(v - 50)), 9).alias("root"), F.round(F.pow(v, F.lit(2)), 6).alias("square"))


@query("SELECT source_sequence, CAST(floor((k - 50) / 7.0) AS BIGINT) * 7 AS bucket FROM ticks", "ticks")
def f5_floor_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.ticks(spark, sf_dir).select("source_sequence", clock.floor_bucket((F.col("k") - 50).cast("long"), 7).alias("bucket"))


@query("SELECT source_sequence, event_ts_ns // 1000000 AS ms, CASE WHEN source_sequence % 2 = 0 THEN (event_ts_ns // 1000000) * 1000000 END AS ns FROM ticks", "ticks")
def f6_clock_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = clock.ns_to_ms(F.col("event_ts_ns"))
    huge = F.when(F.col("source_sequence") % 2 == 0, ms).otherwise(F.lit(9_223_372_036_854_775_000))
    return fx.ticks(spark, sf_dir).select("source_sequence", ms.alias("ms"), clock.ms_to_ns(huge).alias("ns"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE epoch_us(ts) * 1000 + CASE event_id % 4 WHEN 1 THEN -7200000000000 WHEN 2 THEN 123 ELSE 0 END END AS ns FROM events")
def f7_rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, k = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.col("event_id") % 4
    text = F.when(k == 0, F.concat(base, F.lit("Z"))).when(k == 1, F.concat(base, F.lit("+02:00"))).when(k == 2, F.concat(base, F.lit("123Z"))).otherwise(F.concat(base, F.lit("+24:00")))
    return table(spark, sf_dir, "events").select("event_id", clock.rfc3339_ns(text).alias("ns"))


@query("""SELECT r_regionkey, sha256('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}') AS hash FROM region""")
def f8_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_regionkey", scalars.content_hash("r_regionkey", "r_name").alias("hash"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def f9_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(nxt, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(scalars.euclidean(F.col("v"), F.col("w")), 6).alias("distance"))


@query("SELECT count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid FROM (SELECT p_partkey % 3 = 0 AS ok FROM part)")
def f10_identity_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("part-"), "p_partkey")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a/"), "p_partkey")).otherwise(F.concat(F.lit("C:"), "p_partkey"))
    ok = scalars.valid_identity(name)
    return table(spark, sf_dir, "part").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@query("SELECT n_nationkey, n_regionkey || ':' || n_name || '#' || substr(sha256(n_regionkey || ':' || n_name), 1, 12) AS id FROM nation")
def f11_identity_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", scalars.identity(F.col("n_regionkey").cast("string"), "n_name").alias("id"))


@query("SELECT source_sequence, round((value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-12), 8) AS z FROM ticks WINDOW w AS (PARTITION BY instrument)", "ticks")
def f12_z_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.ticks(spark, sf_dir)
    fitted = t.groupBy("instrument").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d"))
    return t.join(fitted, "instrument").select("source_sequence", F.round(scalars.z_score(F.col("value"), F.col("m"), F.col("d")), 8).alias("z"))


@query("SELECT source_sequence, CASE WHEN k > 50 THEN value END AS v, CASE WHEN eid IS NOT NULL AND weak_ms IS NOT NULL THEN eid < weak_ms END AS both FROM snapshots", "snapshots")
def f13_conditional_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.snapshots(spark, sf_dir).select("source_sequence", F.when(F.col("k") > 50, F.col("value")).alias("v"), (F.col("eid") < F.col("weak_ms")).alias("both"))


@query("SELECT source_sequence, CASE source_sequence % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN -1 ELSE 1 END AS direction FROM ticks", "ticks")
def w15_direction_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("source_sequence") % 4
    payload = F.when(k == 0, F.lit('{"operational":{"direction":"up"}}')).when(k == 1, F.lit('{"operational":{"direction":"DOWN"},"direction":"up"}')).when(k == 2, F.lit('{"direction":-1}')).otherwise(F.lit("{}"))
    return fx.ticks(spark, sf_dir).select("source_sequence", scalars.direction_from(payload, "$.operational.direction", "$.direction").alias("direction"))


@query("SELECT anchor_id, k AS score, round(value, 4) AS efficiency FROM anchors", "anchors")
def w16_attribute_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.anchors(spark, sf_dir).withColumn("record", F.struct(F.struct(F.col("k").alias("score"), F.col("value").alias("efficiency")).alias("operational")))
    return a.select("anchor_id", F.col("record.operational.score").alias("score"), F.round("record.operational.efficiency", 4).alias("efficiency"))


# Sorts, limits, sets


@query("SELECT anchor_id, row_number() OVER (ORDER BY anchor_time, anchor_seq, anchor_id) AS place FROM anchors", "anchors")
def t1_deterministic_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every anchor. Places count on from the day buckets before, so no task sorts all anchors."""
    a = fx.anchors(spark, sf_dir).select("anchor_id", "anchor_time", "anchor_seq").withColumn("day", clock.floor_div(F.coalesce("anchor_time", F.lit(2**62)), fx.DAY))
    placed = carry_sum(a, [], [F.asc_nulls_last("anchor_time"), F.asc_nulls_last("anchor_seq"), F.col("anchor_id")], F.lit(1), "day", "place")
    return placed.select("anchor_id", F.col("place").cast("long").alias("place"))


@query("SELECT p_brand, p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) > 3 THEN 'BOUNDED_OUT' END AS reason FROM part")
def t2_bounded_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(place > 3, "BOUNDED_OUT").alias("reason"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def t3_first_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy("o_orderdate", "o_orderkey").limit(25).select("o_orderkey", "o_custkey")


@query("SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)) AS only_left, (SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)) AS only_right")
def u1_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (table(spark, sf_dir, t).select(F.col(c).alias("n")).distinct() for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    return a.exceptAll(b).agg(F.count("*").alias("only_left")).join(b.exceptAll(a).agg(F.count("*").alias("only_right")))


@query("SELECT detector, array_to_string(list_sort(list_intersect(list(DISTINCT CASE WHEN k % 2 = 0 THEN '1h' ELSE '4h' END), ['1h', '1d'])), ',') AS scales FROM (SELECT event_type AS detector, k FROM ticks) GROUP BY detector", "ticks")
def u2_scale_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fx.ticks(spark, sf_dir).groupBy(F.col("event_type").alias("detector")).agg(F.collect_set(F.when(F.col("k") % 2 == 0, "1h").otherwise("4h")).alias("s"))
    return got.select("detector", F.array_join(F.array_sort(F.array_intersect("s", F.array(F.lit("1h"), F.lit("1d")))), ",").alias("scales"))


@query("SELECT kind, t, seq, row_number() OVER (ORDER BY t, seq, kind) AS place FROM (SELECT 'anchor' AS kind, anchor_time AS t, anchor_seq AS seq FROM anchors UNION ALL SELECT 'context', available_time, context_seq FROM contexts)", "anchors", "contexts")
def u3_ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.anchors(spark, sf_dir).select(F.col("anchor_time").alias("t"), F.col("anchor_seq").alias("seq"))
    return merge.ordered({"anchor": a, "context": fx.contexts(spark, sf_dir).select(F.col("available_time").alias("t"), F.col("context_seq").alias("seq"))}, ["t", "seq"])
