"""Derived views that bind the operators to the given tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causaltape.functions.clock import floor_div, micros

HOUR, DAY = 3_600_000_000_000, 86_400_000_000_000
HORIZONS = {"1h": HOUR, "6h": 6 * HOUR, "24h": DAY}
BAR_FRAMES = {"1h": HOUR, "4h": 4 * HOUR, "1d": DAY}
#: Borders of the leaves: 2024-01-21 and 2024-01-26.
DEVELOPMENT_END, HOLDOUT_END = 1_705_795_200_000_000_000, 1_706_227_200_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    event = micros(F.col("ts")) * 1000
    return e.select(
        (F.col("user_id") % 5).alias("instrument"), F.col("event_id").alias("source_sequence"), event.alias("event_ts_ns"),
        (event + (F.col("event_id") * 7919) % 997 * 1_000_000).alias("received_ts_ns"), (1000 + F.col("value")).alias("bid"), (1000 + F.col("value") + 0.2).alias("ask"),
        ((1000 + F.col("value") + (1000 + F.col("value") + 0.2)) / 2).alias("mid"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, event = F.col("event_type"), F.col("source_sequence")
    states = {"view": "IDLE", "click": "DEVELOPING", "purchase": "BURST", "signup": "DECAY_RISK", "error": "DYING"}
    state = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in states.items()])
    return ticks(spark, sf_dir).withColumn("state", state).withColumn("eid", F.when(F.col("state").isin("BURST", "DECAY_RISK", "DYING"), floor_div(event, 7))).withColumn(
        "weak_ms", F.when(F.col("state") != "IDLE", floor_div(F.col("event_ts_ns"), 1_000_000) - event % 3)
    )


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).where("event_type = 'click'")
    return t.select("instrument", F.col("source_sequence").alias("anchor_id"), F.col("received_ts_ns").alias("anchor_time"), F.col("source_sequence").alias("anchor_seq"), "event_ts_ns", F.col("mid").alias("anchor_mid"), "value", "k", F.when(F.col("k") % 2 == 0, 1).otherwise(-1).alias("direction"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).where("event_type <> 'click'")
    return t.select("instrument", F.col("event_type").alias("detector"), F.col("received_ts_ns").alias("available_time"), F.col("source_sequence").alias("context_seq"), F.col("value").alias("context_value"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = F.array(*[F.struct(F.lit(n).alias("scale"), F.lit(w).cast("long").alias("width")) for n, w in BAR_FRAMES.items()])
    t = ticks(spark, sf_dir).select("*", F.inline(frames))
    opened = F.col("event_ts_ns") - F.pmod("event_ts_ns", "width")
    return t.withColumn("open_ns", opened).groupBy("instrument", "scale", "width", "open_ns").agg(
        F.min_by("mid", "source_sequence").alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", "source_sequence").alias("close"), F.count("*").alias("ticks")
    ).select("instrument", "scale", floor_div(F.col("open_ns"), 1_000_000).alias("bar_open_ts"), floor_div(F.col("open_ns") + F.col("width"), 1_000_000).alias("bar_close_ts"), "open", "high", "low", "close", "ticks")


def leaves(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("development", 0, DEVELOPMENT_END), ("holdout", DEVELOPMENT_END, HOLDOUT_END), ("future", HOLDOUT_END, 2 * HOLDOUT_END)], "leaf string, start_ns long, end_ns long")


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A return per market segment and day on the grid of all days; days without orders are null."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    seen = o.groupBy(F.col("c_mktsegment").alias("strategy_id"), F.col("o_orderdate").cast("date").alias("day")).agg((F.avg("o_totalprice") / 250000 - 1).alias("raw"), F.count("*").alias("n"))
    grid = seen.select("day").distinct().join(F.broadcast(seen.select("strategy_id").distinct()))
    full = grid.join(seen, ["strategy_id", "day"], "left").withColumn("ret", F.col("raw") * 0.01)
    return full.select("strategy_id", "day", "ret", F.when(F.col("n") % 2 == 0, "A").when(F.col("n").isNotNull(), "B").alias("regime"), F.col("n").cast("double").alias("liquidity"), F.signum(F.col("ret")).alias("signal"))


def capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("strategy_id")).agg(F.sum("c_acctbal").alias("capital"), F.count("*").cast("double").alias("capacity"), F.max("c_acctbal").alias("risk_budget"))


SQL = {
    "ticks": """SELECT user_id % 5 AS instrument, event_id AS source_sequence, epoch_us(ts) * 1000 AS event_ts_ns,
      epoch_us(ts) * 1000 + (event_id * 7919) % 997 * 1000000 AS received_ts_ns, 1000 + value AS bid, 1000 + value + 0.2::DOUBLE AS ask,
      (1000 + value + (1000 + value + 0.2::DOUBLE)) / 2 AS mid, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    "snapshots": """SELECT *, CASE WHEN state IN ('BURST', 'DECAY_RISK', 'DYING') THEN source_sequence // 7 END AS eid,
      CASE WHEN state <> 'IDLE' THEN event_ts_ns // 1000000 - source_sequence % 3 END AS weak_ms
      FROM (SELECT *, CASE event_type WHEN 'view' THEN 'IDLE' WHEN 'click' THEN 'DEVELOPING' WHEN 'purchase' THEN 'BURST' WHEN 'signup' THEN 'DECAY_RISK' WHEN 'error' THEN 'DYING' END AS state FROM ticks)""",
    "anchors": """SELECT instrument, source_sequence AS anchor_id, received_ts_ns AS anchor_time, source_sequence AS anchor_seq, event_ts_ns, mid AS anchor_mid,
      value, k, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS direction FROM ticks WHERE event_type = 'click'""",
    "contexts": """SELECT instrument, event_type AS detector, received_ts_ns AS available_time, source_sequence AS context_seq, value AS context_value FROM ticks WHERE event_type <> 'click'""",
    "frames": """SELECT * FROM (VALUES ('1h', 3600000000000), ('4h', 14400000000000), ('1d', 86400000000000)) f(scale, width)""",
    "bars": """SELECT instrument, scale, open_ns // 1000000 AS bar_open_ts, (open_ns + width) // 1000000 AS bar_close_ts, arg_min(mid, source_sequence) AS open, max(mid) AS high,
      min(mid) AS low, arg_max(mid, source_sequence) AS close, count(*) AS ticks
      FROM (SELECT *, event_ts_ns - event_ts_ns % width AS open_ns FROM ticks, frames) GROUP BY instrument, scale, width, open_ns""",
    "horizons": """SELECT * FROM (VALUES ('1h', 3600000000000), ('6h', 21600000000000), ('24h', 86400000000000)) h(horizon, h_ns)""",
    "leaves": f"""SELECT * FROM (VALUES ('development', 0, {DEVELOPMENT_END}), ('holdout', {DEVELOPMENT_END}, {HOLDOUT_END}), ('future', {HOLDOUT_END}, {2 * HOLDOUT_END})) l(leaf, start_ns, end_ns)""",
    "seen": """SELECT c_mktsegment AS strategy_id, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) / 250000 - 1 AS raw, count(*) AS n
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "streams": """SELECT strategy_id, day, raw * 0.01::DOUBLE AS ret, CASE WHEN n % 2 = 0 THEN 'A' WHEN n IS NOT NULL THEN 'B' END AS regime, CAST(n AS DOUBLE) AS liquidity, CAST(sign(raw * 0.01::DOUBLE) AS DOUBLE) AS signal
      FROM (SELECT DISTINCT day FROM seen) CROSS JOIN (SELECT DISTINCT strategy_id FROM seen) LEFT JOIN seen USING (strategy_id, day)""",
    "capital": """SELECT c_mktsegment AS strategy_id, sum(c_acctbal) AS capital, CAST(count(*) AS DOUBLE) AS capacity, max(c_acctbal) AS risk_budget FROM customer GROUP BY ALL""",
}
NEEDS = {"snapshots": ["ticks"], "anchors": ["ticks"], "contexts": ["ticks"], "bars": ["ticks", "frames"], "streams": ["seen"]}


def sql(body: str, *views: str) -> str:
    """`body` after a WITH clause of the named views and what they need."""
    order: list[str] = []

    def add(view: str) -> None:
        for need in NEEDS.get(view, []):
            add(need)
        if view not in order:
            order.append(view)

    for view in views:
        add(view)
    known = ", ".join(f"{v} AS ({SQL[v]})" for v in order)
    body = body.strip()
    return f"WITH {known}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {known} {body}"


def fingerprint_sql(source: str, *columns: str) -> str:
    """The table fingerprint of `source` in SQL; columns in order of name."""
    row = "to_json({" + ", ".join(f"'{c}': {c}" for c in columns) + "})"
    h = f"('0x' || substr(sha256({row}), 1, 15))::BIGINT"
    return f"SELECT count(*) AS rows, bit_xor({h}) AS xor, CAST(sum({h}) AS VARCHAR) AS sum FROM {source}"
