"""Queries over ticks, bars, contexts, lifecycles and paths, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causaltape.operators import asof, availability, lifecycle, paths, payloads, quantiles
from causaltape.plans import fixtures as fx
from causaltape.plans.fixtures import sql
from causaltape.sources.lake import cut

QUERIES, SQL = {}, {}
LAST_NS = 4 * fx.HOLDOUT_END


def query(text: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = sql(text, *views) if views else text
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


ASOF = """SELECT a.anchor_id, a.instrument, c.context_seq AS ctx_seq, c.context_value AS ctx_value, a.anchor_time - c.available_time AS lag_ns
  FROM anchors a LEFT JOIN LATERAL (SELECT * FROM contexts c WHERE c.instrument = a.instrument AND c.detector = 'purchase' AND {0}
  ORDER BY c.available_time DESC, c.context_seq DESC LIMIT 1) c ON true"""


def _asof(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    ctx = fx.contexts(spark, sf_dir).where("detector = 'purchase'")
    got = asof.asof_latest(fx.anchors(spark, sf_dir), ctx, ["instrument"], "anchor_time", "available_time", "anchor_seq", "context_seq", ["context_seq", "context_value", "available_time"], strict=strict)
    return got.select("anchor_id", "instrument", F.col("ctx_context_seq").alias("ctx_seq"), F.col("ctx_context_value").alias("ctx_value"), (F.col("anchor_time") - F.col("ctx_available_time")).alias("lag_ns"))


@query(ASOF.format("c.available_time <= a.anchor_time"), "anchors", "contexts")
def j1_asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, strict=False)


@query(ASOF.format("(c.available_time < a.anchor_time OR (c.available_time = a.anchor_time AND c.context_seq < a.anchor_seq))"), "anchors", "contexts")
def j2_asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, strict=True)


@query("""SELECT a.anchor_id, count(c.context_seq) AS n, min(c.context_seq) AS first_seq, round(sum(c.context_value), 6) AS total FROM anchors a
  LEFT JOIN contexts c ON c.instrument = a.instrument AND c.available_time BETWEEN a.anchor_time - 21600000000000 AND a.anchor_time GROUP BY a.anchor_id""", "anchors", "contexts")
def j3_lookback_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.anchors(spark, sf_dir)
    got = asof.lookback(a, fx.contexts(spark, sf_dir), ["instrument"], "anchor_time", "available_time", 6 * fx.HOUR)
    counted = got.groupBy("anchor_id").agg(F.count("*").alias("n"), F.min("context_seq").alias("first_seq"), F.round(F.sum("context_value"), 6).alias("total"))
    return a.select("anchor_id").join(counted, "anchor_id", "left").fillna(0, ["n"])


AVAILABLE = """first AS (SELECT instrument, scale AS timeframe, width, event_ts_ns - event_ts_ns % width AS bar_open_ns, min(source_sequence) AS s, arg_min(received_ts_ns, source_sequence) AS r
    FROM ticks, frames GROUP BY ALL),
  avail AS (SELECT * FROM (SELECT instrument, timeframe, bar_open_ns, bar_open_ns + width AS bar_close_ns,
    lead(r) OVER w AS available_time_ns, lead(s) OVER w AS trigger_sequence FROM first WINDOW w AS (PARTITION BY instrument, timeframe ORDER BY bar_open_ns)) WHERE available_time_ns IS NOT NULL)"""


def _availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return availability.bar_availability(fx.ticks(spark, sf_dir), fx.BAR_FRAMES, ["instrument"])


@query(f"WITH {AVAILABLE} SELECT * FROM avail", "ticks", "frames")
def w1_bar_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _availability(spark, sf_dir)


@query(f"""WITH {AVAILABLE} SELECT b.instrument, b.scale, b.bar_close_ts, b.ticks, a.available_time_ns, a.trigger_sequence FROM bars b
  LEFT JOIN avail a ON a.instrument = b.instrument AND a.timeframe = b.scale AND a.bar_close_ns // 1000000 = b.bar_close_ts""", "ticks", "frames", "bars")
def j6_bars_left_join_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = availability.with_availability(fx.bars(spark, sf_dir), _availability(spark, sf_dir), ["instrument"])
    return got.select("instrument", "scale", "bar_close_ts", "ticks", "available_time_ns", "trigger_sequence")


EPISODES = """lagged AS (SELECT *, lag(state) OVER w AS prev_state, lag(eid) OVER w AS prev_eid, row_number() OVER w AS ordinal FROM snapshots WHERE state IS NOT NULL
    WINDOW w AS (PARTITION BY instrument ORDER BY received_ts_ns, source_sequence)),
  flagged AS (SELECT *, state <> 'IDLE' AND (prev_state IS NULL OR prev_state = 'IDLE' OR (prev_eid IS NOT NULL AND prev_eid IS DISTINCT FROM eid)) AS starts FROM lagged),
  numbered AS (SELECT *, sum(CAST(starts AS BIGINT)) OVER (PARTITION BY instrument ORDER BY ordinal) AS e FROM flagged),
  rows_ AS (SELECT *, CASE WHEN state <> 'IDLE' THEN CAST(e AS BIGINT) END AS episode FROM numbered),
  runs0 AS (SELECT *, CAST(sum(CASE WHEN p IS NULL OR p <> state THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, episode ORDER BY ordinal) AS BIGINT) AS run
    FROM (SELECT *, lag(state) OVER (PARTITION BY instrument, episode ORDER BY ordinal) AS p FROM rows_ WHERE episode IS NOT NULL)),
  runs AS (SELECT *, row_number() OVER (PARTITION BY instrument, episode, state ORDER BY run) > 1 AS re_entry
    FROM (SELECT instrument, episode, run, state, min(received_ts_ns) AS entry_ns, max(received_ts_ns) AS exit_ns, count(*) AS rows FROM runs0 GROUP BY ALL))"""
KEY = ["instrument"]


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.episodes(fx.snapshots(spark, sf_dir), KEY)


@query(f"""WITH {EPISODES} SELECT instrument, episode, count(*) AS rows, min(source_sequence) AS first_seq, max(source_sequence) AS last_seq FROM rows_ WHERE episode IS NOT NULL GROUP BY ALL""", "snapshots")
def w3_episode_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _episodes(spark, sf_dir).where("episode is not null").groupBy("instrument", "episode").agg(F.count("*").alias("rows"), F.min("source_sequence").alias("first_seq"), F.max("source_sequence").alias("last_seq"))


@query(f"WITH {EPISODES} SELECT instrument, episode, run, state, entry_ns, exit_ns, rows, re_entry FROM runs", "snapshots")
def w4_state_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.state_runs(_episodes(spark, sf_dir), KEY)


FIRST_ENTRY = f"""WITH {EPISODES} SELECT instrument, episode, state AS anchor_state, arg_min(received_ts_ns, ordinal) AS anchor_time, arg_min(source_sequence, ordinal) AS anchor_sequence,
  arg_min(eid, ordinal) AS event_id FROM rows_ WHERE episode IS NOT NULL AND state IN ('BURST', 'DECAY_RISK', 'DYING') GROUP BY ALL"""


@query(FIRST_ENTRY + " HAVING min(ordinal) > 1", "snapshots")
def w5_first_entry_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.state_anchors(_episodes(spark, sf_dir), KEY)


@query(FIRST_ENTRY, "snapshots")
def w5_first_entry_anchors_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.state_anchors(_episodes(spark, sf_dir), KEY, left_policy="emit")


#: Payload texts of the tape: a tenth absent, a tenth malformed.
NARROW = "struct<drift_burst_state:struct<state:string,event_id:bigint>>"
FIELDS = {"score": ("$.operational.score", "long"), "efficiency": ("$.operational.efficiency", "double"), "first_weak": ("$.drift_burst_state.emitted_events[0].weak_ts", "long"), "lost": ("$.operational.none", "string")}


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.struct("state", F.col("eid").alias("event_id"), F.array(F.struct(F.col("weak_ms").alias("weak_ts"))).alias("emitted_events")).alias("drift_burst_state")
    whole = F.to_json(F.struct(state, F.struct(F.col("k").alias("score"), F.col("value").alias("efficiency")).alias("operational")))
    n = F.col("source_sequence") % 10
    return fx.snapshots(spark, sf_dir).select("instrument", "received_ts_ns", "source_sequence", F.when(n == 1, "{broken").when(n != 0, whole).alias("payload"))


@query("WITH tape AS (SELECT * REPLACE (CASE WHEN source_sequence % 10 > 1 THEN state END AS state, CASE WHEN source_sequence % 10 > 1 THEN eid END AS eid) FROM snapshots), " + FIRST_ENTRY.replace("FROM snapshots", "FROM tape")[5:].replace("SELECT instrument, episode, state AS anchor_state", ", first AS (SELECT instrument, episode, state AS anchor_state", 1)
       + """ HAVING min(ordinal) > 1)
  SELECT f.instrument, episode, anchor_state, anchor_time, anchor_sequence, event_id, k AS score, round(value, 9) AS efficiency, weak_ms AS first_weak, NULL::VARCHAR AS lost, 'PARSED' AS payload_state FROM first f JOIN snapshots s ON s.source_sequence = anchor_sequence""", "snapshots")
def w16_anchor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of a tape of texts: the narrow state of every row, the whole record of the anchors' rows only."""
    tape = texts(spark, sf_dir)
    states = payloads.narrow(tape, "payload", NARROW).select("instrument", "received_ts_ns", "source_sequence", F.col("drift_burst_state.state").alias("state"), F.col("drift_burst_state.event_id").alias("eid"))
    found = lifecycle.state_anchors(lifecycle.episodes(states, KEY), KEY).withColumn("source_sequence", F.col("anchor_sequence"))
    return rounded(payloads.records(found, tape, ["instrument", "source_sequence"], "payload", FIELDS).drop("source_sequence"), "efficiency")


@query(f"""WITH {EPISODES}, marked AS (SELECT *, CAST(sum(CASE WHEN rn = 1 OR p IS DISTINCT FROM weak_ms THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, episode ORDER BY ordinal) AS BIGINT) AS mrun
    FROM (SELECT *, lag(weak_ms) OVER w AS p, row_number() OVER w AS rn FROM rows_ WHERE episode IS NOT NULL WINDOW w AS (PARTITION BY instrument, episode ORDER BY ordinal))),
  armed AS (SELECT instrument, episode, min(ordinal) AS arm_ordinal, arg_min(mrun, ordinal) AS mrun FROM marked WHERE state = 'BURST' GROUP BY ALL)
  SELECT a.instrument, a.episode, any_value(m.weak_ms) AS weak_ms, a.arm_ordinal, min(m.ordinal) AS crossing_ordinal, arg_min(m.received_ts_ns, m.ordinal) AS crossing_ns
  FROM armed a JOIN marked m ON m.instrument = a.instrument AND m.episode = a.episode AND m.mrun = a.mrun WHERE m.weak_ms IS NOT NULL GROUP BY a.instrument, a.episode, a.arm_ordinal""", "snapshots")
def w6_milestone_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.milestones(_episodes(spark, sf_dir), KEY, "weak_ms")


SUMMARY = f"""WITH {EPISODES}, ends AS (SELECT instrument, max(ordinal) AS tape_end FROM rows_ GROUP BY ALL),
  ep AS (SELECT instrument, episode, max(eid) AS event_id, count(*) AS rows, min(received_ts_ns) AS entry_ns, max(received_ts_ns) AS exit_ns, min(ordinal) = 1 AS left_truncated,
    max(ordinal) = any_value(tape_end) AS right_censored, max(eid) IS NULL AS forming FROM rows_ JOIN ends USING (instrument) WHERE episode IS NOT NULL GROUP BY ALL)"""


@query(SUMMARY + " SELECT instrument, episode, rows, entry_ns, left_truncated FROM ep", "snapshots")
def w7_left_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.summary(_episodes(spark, sf_dir), KEY).select("instrument", "episode", "rows", "entry_ns", "left_truncated")


@query(SUMMARY + " SELECT instrument, episode, event_id, exit_ns, right_censored, forming, forming AND NOT right_censored AS fizzled FROM ep", "snapshots")
def w8_right_censoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.summary(_episodes(spark, sf_dir), KEY).select("instrument", "episode", "event_id", "exit_ns", "right_censored", "forming", "fizzled")


@query("""WITH seen AS (SELECT instrument, eid, source_sequence, sha256(concat_ws(':', eid, event_ts_ns // 1800000000000)) AS h FROM snapshots WHERE state = 'DYING'),
  p AS (SELECT *, lag(h) OVER (PARTITION BY instrument, eid ORDER BY source_sequence) AS q FROM seen)
  SELECT instrument, eid, min(source_sequence) AS first_seen, count(*) AS sightings, count(*) FILTER (q = h) AS duplicates, count(*) FILTER (q <> h) AS mutations, min(source_sequence) = 1 AS baseline FROM p GROUP BY ALL""", "snapshots")
def w9_emitted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from causaltape.functions.clock import floor_div

    seen = fx.snapshots(spark, sf_dir).where("state = 'DYING'")
    content = F.concat_ws(":", F.col("eid").cast("string"), floor_div(F.col("event_ts_ns"), 1_800_000_000_000).cast("string"))
    return lifecycle.emitted_records(seen, ["instrument"], "eid", content, "source_sequence")


LIVE_EMITTED = f"""WITH {EPISODES}, live AS (SELECT eid, state, min(event_ts_ns) // 1000000 AS live_ms FROM rows_ WHERE episode IS NOT NULL AND eid IS NOT NULL GROUP BY ALL),
  emitted AS (SELECT eid, state, min(event_ts_ns) // 1000000 + max(CASE WHEN eid % 11 = 0 THEN 1 ELSE 0 END) AS emitted_ms FROM snapshots WHERE eid IS NOT NULL AND eid % 13 <> 0 GROUP BY eid, state),
  both_ AS (SELECT coalesce(l.eid, e.eid) AS eid, coalesce(l.state, e.state) AS state, live_ms, emitted_ms FROM (SELECT * FROM live WHERE eid % 17 <> 0) l FULL JOIN emitted e ON l.eid = e.eid AND l.state = e.state),
  judged AS (SELECT *, CASE WHEN live_ms IS NULL AND emitted_ms IS NULL THEN 'NULL_AGREEMENT' WHEN live_ms IS NULL THEN 'MISSING' WHEN emitted_ms IS NULL THEN 'SPURIOUS' WHEN live_ms = emitted_ms THEN 'MATCHED' ELSE 'VALUE_MISMATCH' END AS class,
    live_ms - emitted_ms AS lag_ms FROM both_)"""


def _agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from causaltape.functions.clock import floor_div

    ms = floor_div(F.min("event_ts_ns"), 1_000_000)
    live = _episodes(spark, sf_dir).where("episode is not null and eid is not null and eid % 17 <> 0").groupBy("eid", "state").agg(ms.alias("live_ms"))
    emitted = fx.snapshots(spark, sf_dir).where("eid is not null and eid % 13 <> 0").groupBy("eid", "state").agg(ms.alias("emitted_ms"))
    return lifecycle.agreement(live, emitted.withColumn("emitted_ms", F.col("emitted_ms") + (F.col("eid") % 11 == 0).cast("long")), ["eid", "state"])


@query(LIVE_EMITTED + " SELECT eid, state, live_ms, emitted_ms, class, lag_ms FROM judged", "snapshots")
def j10_ground_truth_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _agreement(spark, sf_dir)


@query(LIVE_EMITTED + " SELECT state, class, count(*) AS n, CAST(max(abs(lag_ms)) AS BIGINT) AS max_lag_ms FROM judged GROUP BY ALL", "snapshots")
def w10_ground_truth_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _agreement(spark, sf_dir).groupBy("state", "class").agg(F.count("*").alias("n"), F.max(F.abs("lag_ms")).alias("max_lag_ms"))


PATHS = """stepped AS (SELECT *, lag(mid) OVER (PARTITION BY instrument ORDER BY received_ts_ns, source_sequence) AS prev_mid FROM ticks),
  pairs AS (SELECT a.anchor_id, a.direction, h.horizon, t.received_ts_ns, t.source_sequence AS seq, ln(t.mid / a.anchor_mid) AS ret, a.direction * ln(t.mid / a.anchor_mid) AS signed,
    (t.received_ts_ns - a.anchor_time) // 1000000 AS off, t.received_ts_ns // 1000000000 AS sec,
    ln(t.mid / CASE WHEN row_number() OVER (PARTITION BY a.anchor_id, h.horizon ORDER BY t.received_ts_ns, t.source_sequence) = 1 THEN a.anchor_mid ELSE t.prev_mid END) AS step
    FROM anchors a CROSS JOIN horizons h JOIN stepped t ON t.instrument = a.instrument AND (t.received_ts_ns > a.anchor_time OR (t.received_ts_ns = a.anchor_time AND t.source_sequence > a.anchor_seq))
      AND t.received_ts_ns <= a.anchor_time + h.h_ns),
  rv AS (SELECT anchor_id, horizon, sum(x * x) AS realized_variance FROM (SELECT anchor_id, horizon, sec, sum(step) AS x FROM pairs GROUP BY ALL) GROUP BY ALL),
  agg AS (SELECT anchor_id, horizon, count(*) AS ticks, arg_max(ret, (received_ts_ns, seq)) AS endpoint_return, max(signed) AS hi, min(signed) AS lo, min((-signed, off))[2] AS hi_at, min((signed, off))[2] AS lo_at,
    max(received_ts_ns) AS last_ns, min(off) FILTER (signed > 0) AS up, min(off) FILTER (signed < 0) AS down, bool_or(signed = 0) AS tie, sum(abs(step)) AS abs_sum FROM pairs GROUP BY ALL),
  ends AS (SELECT instrument, max(received_ts_ns) AS tape_end FROM ticks GROUP BY ALL),
  paths AS (SELECT a.instrument, a.anchor_id, h.horizon, coalesce(ticks, 0) AS ticks, endpoint_return, a.direction * endpoint_return AS signed_return, CASE WHEN hi IS NOT NULL THEN greatest(hi, 0) END AS mfe,
    CASE WHEN lo IS NOT NULL THEN greatest(-lo, 0) END AS mae, hi_at AS mfe_offset_ms, lo_at AS mae_offset_ms, up < down AS favorable_first, down < up AS adverse_first, CASE WHEN ticks IS NULL THEN 0 WHEN tape_end >= a.anchor_time + h.h_ns THEN h.h_ns ELSE last_ns - a.anchor_time END AS covered_ns, coalesce(tie, false) AS tie,
    coalesce(realized_variance, 0) AS realized_variance, CASE WHEN abs_sum > 0 THEN endpoint_return / abs_sum END AS path_efficiency, tape_end >= a.anchor_time + h.h_ns AS complete
    FROM anchors a CROSS JOIN horizons h JOIN ends USING (instrument) LEFT JOIN agg USING (anchor_id, horizon) LEFT JOIN rv USING (anchor_id, horizon))"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.forward_paths(fx.anchors(spark, sf_dir), fx.ticks(spark, sf_dir), ["instrument"], fx.HORIZONS)


@query("""SELECT a.anchor_id, h.horizon, count(t.source_sequence) AS ticks, max(t.received_ts_ns) AS last_ns FROM anchors a CROSS JOIN horizons h
  LEFT JOIN ticks t ON t.instrument = a.instrument AND (t.received_ts_ns > a.anchor_time OR (t.received_ts_ns = a.anchor_time AND t.source_sequence > a.anchor_seq)) AND t.received_ts_ns <= a.anchor_time + h.h_ns
  GROUP BY a.anchor_id, h.horizon""", "ticks", "anchors", "horizons")
def j4_forward_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.anchors(spark, sf_dir)
    every = F.array(*[F.struct(F.lit(n).alias("horizon"), F.lit(w).cast("long").alias("h_ns")) for n, w in fx.HORIZONS.items()])
    spans = a.select("instrument", "anchor_id", "anchor_time", "anchor_seq", F.inline(every)).withColumn("end", F.col("anchor_time") + F.col("h_ns"))
    got = asof.between(spans, fx.ticks(spark, sf_dir), ["instrument"], ("anchor_time", "anchor_seq"), "end", ("received_ts_ns", "source_sequence"))
    return got.select("anchor_id", "horizon", F.col("n").alias("ticks"), F.col("last_time").alias("last_ns"))


@query(f"""WITH {PATHS} SELECT instrument, anchor_id, horizon, ticks, round(endpoint_return, 9) AS endpoint_return, round(signed_return, 9) AS signed_return, round(mfe, 9) AS mfe, round(mae, 9) AS mae,
  mfe_offset_ms, mae_offset_ms, favorable_first, adverse_first, round(mfe, 9) AS continuation_distance, round(mae, 9) AS reversal_distance, covered_ns, tie, round(path_efficiency, 9) AS path_efficiency, complete, CASE WHEN NOT complete THEN 'DEVELOPMENT_BOUNDARY' END AS censor_reason FROM paths""", "ticks", "anchors", "horizons")
def w11_forward_path_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_paths(spark, sf_dir).drop("realized_variance"), "endpoint_return", "signed_return", "mfe", "mae", "continuation_distance", "reversal_distance", "path_efficiency")


@query(f"WITH {PATHS} SELECT anchor_id, horizon, round(realized_variance, 9) AS realized_variance FROM paths", "ticks", "anchors", "horizons")
def w12_realized_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_paths(spark, sf_dir).select("anchor_id", "horizon", "realized_variance"), "realized_variance")


@query("""SELECT instrument, source_sequence, row_index FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY received_ts_ns, source_sequence) AS row_index FROM snapshots) WHERE row_index % 50 = 0""", "snapshots")
def w14_pseudo_anchor_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.baseline_anchors(fx.snapshots(spark, sf_dir), KEY, every=50).select("instrument", "source_sequence", "row_index")


BARS = f"""{AVAILABLE}, known AS (SELECT b.instrument, b.scale, b.bar_open_ts * 1000000 AS open_ns, b.high, b.low, b.close, a.available_time_ns AS av, a.trigger_sequence AS sq,
    row_number() OVER w AS bar_no, lag(b.close) OVER w AS prev_close FROM bars b LEFT JOIN avail a ON a.instrument = b.instrument AND a.timeframe = b.scale AND a.bar_close_ns // 1000000 = b.bar_close_ts
    WINDOW w AS (PARTITION BY b.instrument, b.scale ORDER BY b.bar_open_ts)),
  first_bar AS (SELECT a.anchor_id, s.scale, (SELECT min(k.bar_no) FROM known k WHERE k.instrument = a.instrument AND k.scale = s.scale AND k.open_ns > a.event_ts_ns AND k.av IS NOT NULL
    AND (k.av > a.anchor_time OR (k.av = a.anchor_time AND k.sq > a.anchor_seq))) AS n FROM anchors a, (SELECT scale FROM frames) s)"""


def _bars_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = availability.with_availability(fx.bars(spark, sf_dir), _availability(spark, sf_dir), ["instrument"])
    return got.withColumn("open_ns", F.col("bar_open_ts") * 1_000_000).withColumn("close_ns", F.col("bar_close_ts") * 1_000_000)


@query(f"""WITH {BARS} SELECT a.anchor_id, f.scale, c.bars, CASE WHEN ok THEN round(ln(last_close / a.anchor_mid), 9) END AS bar_return, CASE WHEN ok THEN round(greatest(hi, 0), 9) END AS mfe, CASE WHEN ok THEN round(greatest(-lo, 0), 9) END AS mae,
    CASE WHEN ok THEN round(rv, 9) END AS realized_volatility, ok AS complete, CASE WHEN found < c.bars THEN 'NO_FULLY_POST_ANCHOR_BAR' WHEN NOT ok THEN 'UNRESOLVED_AVAILABILITY' END AS censor_reason
  FROM anchors a JOIN first_bar f USING (anchor_id) CROSS JOIN (VALUES (1), (2), (3), (5)) c(bars)
  JOIN LATERAL (SELECT count(k.close) AS found, count(k.close) = c.bars AND count(k.av) = c.bars AS ok, arg_max(k.close, k.bar_no) AS last_close, max(a.direction * ln(k.high / a.anchor_mid)) AS hi, min(a.direction * ln(k.low / a.anchor_mid)) AS lo,
    sum(ln(k.close / CASE WHEN k.bar_no = f.n THEN a.anchor_mid ELSE k.prev_close END) ** 2) AS rv FROM known k WHERE k.instrument = a.instrument AND k.scale = f.scale AND k.bar_no BETWEEN f.n AND f.n + c.bars - 1) x ON true""", "ticks", "frames", "bars", "anchors")
def w13_bar_bridge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paths.bar_outcomes(fx.anchors(spark, sf_dir), _bars_known(spark, sf_dir), ["instrument"], [1, 2, 3, 5], LAST_NS)
    return rounded(out.drop("instrument", "signed_return", "first_bar"), "bar_return", "mfe", "mae", "realized_volatility")


@query(f"""WITH {BARS} SELECT a.anchor_id, f.scale, f.n AS bar_no, k.open_ns, f.n IS NOT NULL AS has_bar FROM anchors a JOIN first_bar f USING (anchor_id) LEFT JOIN known k ON k.instrument = a.instrument AND k.scale = f.scale AND k.bar_no = f.n""", "ticks", "frames", "bars", "anchors")
def j5_first_post_anchor_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bar comes first after each anchor, by its number and opening time."""
    bars = cut(_bars_known(spark, sf_dir), "bars")
    out = paths.bar_outcomes(fx.anchors(spark, sf_dir), bars, ["instrument"], [1], LAST_NS)
    numbered = bars.select("instrument", "scale", "open_ns", F.row_number().over(Window.partitionBy("instrument", "scale").orderBy("open_ns")).cast("long").alias("first_bar"))
    return out.join(numbered, ["instrument", "scale", "first_bar"], "left").select("anchor_id", "scale", F.col("first_bar").alias("bar_no"), "open_ns", F.col("complete").alias("has_bar"))


@query("""WITH lagged AS (SELECT state, lag(state) OVER (PARTITION BY instrument ORDER BY received_ts_ns, source_sequence) AS prev FROM snapshots)
  SELECT prev AS from_state, state AS to_state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY prev), 9) AS share FROM lagged WHERE prev IS NOT NULL GROUP BY prev, state""", "snapshots")
def g11_transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lifecycle.transitions(_episodes(spark, sf_dir), KEY), "share")


@query(f"""WITH {EPISODES}, a AS ({FIRST_ENTRY.split(f"WITH {EPISODES} ")[1]} HAVING min(ordinal) > 1) SELECT anchor_state, count(*) AS n FROM a GROUP BY ALL""", "snapshots")
def g12_anchor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.state_anchors(_episodes(spark, sf_dir), KEY).groupBy("anchor_state").agg(F.count("*").alias("n"))


@query(f"""WITH {EPISODES} SELECT state, count(*) AS runs, round(quantile_cont((exit_ns - entry_ns) / 1e9, 0.5), 6) AS median_s, round(quantile_cont((exit_ns - entry_ns) / 1e9, 0.9), 6) AS p90_s FROM runs GROUP BY ALL""", "snapshots")
def x5_dwell_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = lifecycle.state_runs(_episodes(spark, sf_dir), KEY).select("state", ((F.col("exit_ns") - F.col("entry_ns")) / 1e9).alias("s"))
    return rounded(quantiles.exact(cut(runs, "dwell"), ["state"], "s", {"median_s": 0.5, "p90_s": 0.9}).withColumnRenamed("n", "runs"), "median_s", "p90_s", digits=6)
