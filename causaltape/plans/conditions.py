"""Queries on families at an anchor, conditioning tables, event order, agreement and ends, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causaltape.functions.clock import floor_div
from causaltape.operators import asof, context, lifecycle, paths, population, sequences, statistics
from causaltape.plans import fixtures as fx
from causaltape.plans import market
from causaltape.plans import statistics as st
from causaltape.plans.fixtures import sql
from causaltape.sources import footers, ledger
from causaltape.sources.lake import cut, shared

QUERIES, SQL = {}, {}
#: Middle of the tape, 2024-01-16; the tape spans one month, so spans of ten days stand for months.
MIDDLE, MONTH = 1_705_363_200_000_000_000, 10 * fx.DAY
TICK_FAMILIES = ["view", "purchase", "signup", "error"]
BAR_FAMILIES = ["UP_BAR", "DOWN_BAR", "BUSY_BAR"]
rounded = market.rounded


def query(text: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = sql(text, *views) if views else text
        return f

    return add


# Families at an anchor


FAMILY_EVENTS = f"""{market.BARS}, fam AS (SELECT instrument, detector AS family, 'tick' AS scale, available_time AS av, context_seq AS sq, context_value AS v FROM contexts
  UNION ALL SELECT instrument, 'UP_BAR', b.scale, k.av, k.sq, b.close - b.open FROM bars b JOIN known k USING (instrument, scale) WHERE k.open_ns = b.bar_open_ts * 1000000 AND b.close > b.open
  UNION ALL SELECT instrument, 'DOWN_BAR', b.scale, k.av, k.sq, b.close - b.open FROM bars b JOIN known k USING (instrument, scale) WHERE k.open_ns = b.bar_open_ts * 1000000 AND b.close < b.open
  UNION ALL SELECT instrument, 'BUSY_BAR', b.scale, k.av, k.sq, b.ticks FROM bars b JOIN known k USING (instrument, scale) WHERE k.open_ns = b.bar_open_ts * 1000000 AND b.ticks >= 2),
  kinds AS (SELECT unnest({TICK_FAMILIES}) AS family, 'tick' AS scale UNION ALL SELECT f, scale FROM (SELECT unnest({BAR_FAMILIES}) AS f), frames)"""


def _family_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Detector firings of the ticks and three families of bars at each scale, by the time they are known."""
    ticks = fx.contexts(spark, sf_dir).select("instrument", F.concat_ws("|", "detector", F.lit("tick")).alias("kind"), F.col("available_time").alias("av"), F.col("context_seq").alias("sq"), F.col("context_value").alias("v"))
    opened = fx.bars(spark, sf_dir).select("instrument", "scale", (F.col("bar_open_ts") * 1000000).alias("open_ns"), (F.col("close") - F.col("open")).alias("move"), "ticks")
    known = market._bars_known(spark, sf_dir).select("instrument", "scale", "open_ns", F.col("available_time_ns").alias("av"), F.col("trigger_sequence").alias("sq"))
    bars = opened.join(known, ["instrument", "scale", "open_ns"])
    every = F.array(F.struct(F.lit("UP_BAR").alias("f"), F.when(F.col("move") > 0, F.col("move")).alias("v")), F.struct(F.lit("DOWN_BAR").alias("f"), F.when(F.col("move") < 0, F.col("move")).alias("v")), F.struct(F.lit("BUSY_BAR").alias("f"), F.when(F.col("ticks") >= 2, F.col("ticks").cast("double")).alias("v")))
    long = bars.select("instrument", "scale", "av", "sq", F.inline(every)).where("v is not null")
    kinds = [f"{f}|tick" for f in TICK_FAMILIES] + [f"{f}|{s}" for f in BAR_FAMILIES for s in fx.BAR_FRAMES]
    return ticks.unionByName(long.select("instrument", F.concat_ws("|", "f", "scale").alias("kind"), "av", "sq", "v")), kinds


@query(f"""WITH {FAMILY_EVENTS} SELECT a.anchor_id, d.family, d.scale, round(arg_max(f.v, (f.av, f.sq)), 9) AS value, a.anchor_time - max(f.av) AS age_ns, CASE WHEN count(f.av) > 0 THEN 'KNOWN' ELSE 'NULL_PAYLOAD' END AS status
  FROM anchors a CROSS JOIN kinds d LEFT JOIN fam f ON f.instrument = a.instrument AND f.family = d.family AND f.scale = d.scale AND (f.av < a.anchor_time OR (f.av = a.anchor_time AND f.sq < a.anchor_seq)) GROUP BY a.anchor_id, a.anchor_time, d.family, d.scale""", "ticks", "frames", "bars", "anchors", "contexts")
def x8_family_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per anchor, family and scale what was last known strictly before it; absent families are rows too."""
    events, kinds = _family_events(spark, sf_dir)
    got = asof.asof_families(fx.anchors(spark, sf_dir), events, ["instrument"], "kind", kinds, "anchor_time", "av", "anchor_seq", "sq", ["v", "av"])
    name = lambda i: F.element_at(F.split("kind", "[|]"), i)
    return got.select("anchor_id", name(1).alias("family"), name(2).alias("scale"), F.round("ctx_v", 9).alias("value"), (F.col("anchor_time") - F.col("ctx_av")).alias("age_ns"), F.when(F.col("known"), "KNOWN").otherwise("NULL_PAYLOAD").alias("status"))


# Conditioning tables


OUTCOMES = f"""{market.EPISODES}, first AS ({market.FIRST_ENTRY.split(f"WITH {market.EPISODES} ")[1]} HAVING min(ordinal) > 1),
  marks AS (SELECT anchor_sequence AS q, anchor_state FROM first UNION ALL SELECT source_sequence, 'BASELINE' FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY received_ts_ns, source_sequence) AS i FROM snapshots) WHERE i % 50 = 0),
  anchors AS (SELECT t.instrument, t.source_sequence * 2 + (m.anchor_state = 'BASELINE')::INT AS anchor_id, m.anchor_state, t.received_ts_ns AS anchor_time, t.source_sequence AS anchor_seq, t.mid AS anchor_mid, CASE WHEN t.k % 2 = 0 THEN 1 ELSE -1 END AS direction FROM marks m JOIN ticks t ON t.source_sequence = m.q),
  {market.PATHS}, outs AS (SELECT anchor_id, 'return_' || horizon AS outcome, round(signed_return, 9) AS v FROM paths WHERE complete AND signed_return IS NOT NULL UNION ALL SELECT anchor_id, 'mfe_' || horizon, round(mfe, 9) FROM paths WHERE complete AND mfe IS NOT NULL UNION ALL SELECT anchor_id, 'mae_' || horizon, round(mae, 9) FROM paths WHERE complete AND mae IS NOT NULL),
  base AS (SELECT outcome, v, row_number() OVER (PARTITION BY outcome ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY outcome) AS n FROM outs JOIN anchors USING (anchor_id) WHERE anchor_state = 'BASELINE'),
  reference AS (SELECT outcome, max(v) FILTER (i = 50 * (n - 1) // 100) AS rm, max(v) FILTER (i = 75 * (n - 1) // 100) - max(v) FILTER (i = 25 * (n - 1) // 100) AS iqr FROM base GROUP BY outcome),
  ctx AS (SELECT a.anchor_id, a.anchor_state, a.anchor_time, d.family, arg_max(c.context_value, (c.available_time, c.context_seq)) AS v FROM anchors a CROSS JOIN (SELECT unnest({TICK_FAMILIES}) AS family) d LEFT JOIN contexts c ON c.instrument = a.instrument AND c.detector = d.family AND (c.available_time < a.anchor_time OR (c.available_time = a.anchor_time AND c.context_seq < a.anchor_seq)) WHERE a.anchor_state <> 'BASELINE' GROUP BY ALL),
  banded AS (SELECT anchor_id, family, least((rank() OVER (PARTITION BY family ORDER BY v) - 1) * 100 // count(*) OVER (PARTITION BY family) // 20, 4)::INTEGER AS band FROM ctx WHERE v IS NOT NULL),
  cells AS (SELECT c.family, c.anchor_state, b.band, o.outcome, o.v, c.anchor_time // {MONTH} AS month, (c.anchor_time >= {MIDDLE})::INT AS half FROM ctx c LEFT JOIN banded b USING (anchor_id, family) JOIN outs o USING (anchor_id))"""


#: Bands are 0 to 4; an absent value has the number behind them. Cells and outcomes go by their numbers until they are counted.
ABSENT = 5
MEASURED = [(f"{name}_{h}", column, h) for h in fx.HORIZONS for name, column in (("return", "signed_return"), ("mfe", "mfe"), ("mae", "mae"))]


def _place(column: str, names: list[str]) -> Column:
    """The place of a name in a list, from 0."""
    return (F.array_position(F.array(*map(F.lit, names)), F.col(column)) - 1).cast("int")


def _told(df: DataFrame) -> DataFrame:
    """Family, state, band and outcome in place of the numbers of `_cells`."""
    cell, at = F.col("cell"), lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    band, family, state = cell % (ABSENT + 1), F.floor(cell / (ABSENT + 1)) % len(TICK_FAMILIES), F.floor(cell / ((ABSENT + 1) * len(TICK_FAMILIES)))
    names = [at(TICK_FAMILIES, family).alias("family"), at(lifecycle.ACTIVE, state).alias("anchor_state"), F.when(band < ABSENT, band.cast("int")).alias("band"), at([m[0] for m in MEASURED], F.col("outcome")).alias("outcome")]
    return df.select(*names, *[c for c in df.columns if c not in ("cell", "outcome")])


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Outcomes of state anchors under the band of each family's last value (null: absent), and the reference of each
    outcome over every 50th row of the tape. Both kinds of anchors go through one run of paths. Cells and outcomes are numbers
    (`_told` has their names), as each anchor is in as many rows as there are families and outcomes."""
    rows = market._episodes(spark, sf_dir)
    first = lifecycle.state_anchors(rows, ["instrument"]).select(F.col("anchor_sequence").alias("q"), "anchor_state")
    base = paths.baseline_anchors(fx.snapshots(spark, sf_dir), ["instrument"], every=50).select(F.col("source_sequence").alias("q"), F.lit("BASELINE").alias("anchor_state"))
    ticks = fx.ticks(spark, sf_dir)
    t = ticks.select("instrument", F.col("source_sequence").alias("q"), F.col("received_ts_ns").alias("anchor_time"), F.col("source_sequence").alias("anchor_seq"), F.col("mid").alias("anchor_mid"), F.when(F.col("k") % 2 == 0, 1).otherwise(-1).alias("direction"))
    marks = first.unionByName(base).join(t, "q").withColumn("anchor_id", F.col("q") * 2 + (F.col("anchor_state") == "BASELINE").cast("long"))
    marks = cut(marks, "marks")
    done = paths.wide_paths(marks, ticks, ["instrument"], fx.HORIZONS, ["signed_return", "mfe", "mae", "complete"])
    # a row per anchor until both reads of the cells
    outs = cut(done.select("anchor_id", F.array(*[F.when(F.col(f"complete_{h}"), F.round(f"{column}_{h}", 9)) for _, column, h in MEASURED]).alias("outs")), "outcomes")
    base = outs.join(marks.where("anchor_state = 'BASELINE'").select("anchor_id"), "anchor_id").select(F.posexplode("outs").alias("outcome", "v")).where("v is not null")
    ref = statistics.nearest_rank(base, ["outcome"], "v", {"q25": 25, "median": 50, "q75": 75}).withColumn("iqr", F.col("q75") - F.col("q25"))
    real = marks.where("anchor_state <> 'BASELINE'").select("instrument", "anchor_id", "anchor_state", "anchor_time", "anchor_seq")
    ctx = asof.asof_families(real, fx.contexts(spark, sf_dir), ["instrument"], "detector", TICK_FAMILIES, "anchor_time", "available_time", "anchor_seq", "context_seq", ["context_value"])
    ctx = cut(ctx.select("anchor_id", F.col("detector").alias("family"), "ctx_context_value"), "families")
    banded = statistics.bands(ctx.where("ctx_context_value is not null"), "ctx_context_value", by=["family"]).select("anchor_id", "family", "band")
    banded = banded.unionByName(ctx.where("ctx_context_value is null").select("anchor_id", "family", F.lit(None).cast("int").alias("band")))
    place = _place("family", TICK_FAMILIES) * (ABSENT + 1) + F.coalesce("band", F.lit(ABSENT))
    families = banded.groupBy("anchor_id").agg(F.collect_list(place).alias("families"))
    month, half = floor_div(F.col("anchor_time"), MONTH), (F.col("anchor_time") >= MIDDLE).cast("int")
    state = _place("anchor_state", lifecycle.ACTIVE) * ((ABSENT + 1) * len(TICK_FAMILIES))
    full = families.join(real.select("anchor_id", state.alias("state"), month.alias("month"), half.alias("half")), "anchor_id").join(outs, "anchor_id")
    full = cut(full.select("month", "half", F.transform("families", lambda f: f + F.col("state")).alias("cells"), "outs"), "cells")
    full = full.select("month", "half", "cells", F.posexplode("outs").alias("outcome", "v")).where("v is not null")
    return full.select("month", "half", "outcome", "v", F.explode("cells").alias("cell")), ref


@query(f"""WITH {OUTCOMES}, per AS (SELECT family, anchor_state, band, outcome, month, count(*) AS n, median(v) AS m FROM cells GROUP BY ALL), sides AS (SELECT family, anchor_state, band, outcome, abs(sum(sign(m))) = 2 AS agree FROM (SELECT family, anchor_state, band, outcome, half, median(v) AS m FROM cells GROUP BY ALL) GROUP BY ALL),
  whole AS (SELECT family, anchor_state, band, outcome, median(v) AS median FROM cells GROUP BY ALL),
  got AS (SELECT family, anchor_state, band, outcome, CAST(sum(n) AS BIGINT) AS n, count(*) AS months, round(max(n) / sum(n), 9) AS largest_share, greatest(count(*) FILTER (m > 0), count(*) FILTER (m < 0)) = count(*) AS consistent,
    CASE WHEN sum(n) >= 300 THEN 'SUPPORTED' WHEN sum(n) >= 150 AND count(*) FILTER (n >= 50) >= 3 THEN 'LOW_SUPPORT_FALLBACK' ELSE 'INSUFFICIENT_SUPPORT' END AS support, max(n) / sum(n) > 0.5 AS dominated FROM per GROUP BY family, anchor_state, band, outcome)
  SELECT g.*, s.agree AS halves_agree, consistent AND months >= 3 AND s.agree AS stable, round(w.median, 10) AS median, round(w.median - r.rm, 10) AS effect, abs(w.median - r.rm) >= 0.1::DOUBLE * r.iqr AS material FROM got g
  JOIN sides s ON g.family = s.family AND g.anchor_state = s.anchor_state AND g.band IS NOT DISTINCT FROM s.band AND g.outcome = s.outcome JOIN whole w ON g.family = w.family AND g.anchor_state = w.anchor_state AND g.band IS NOT DISTINCT FROM w.band AND g.outcome = w.outcome LEFT JOIN reference r ON r.outcome = g.outcome""", "snapshots", "horizons", "contexts")
def x6_family_conditioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, ref = _cells(spark, sf_dir)
    got = _told(context.conditioning(cells, ["cell"], "outcome", "v", "month", "half", ref))
    # a median of values of nine digits has ten
    return rounded(rounded(got.drop("full_months"), "largest_share"), "median", "effect", digits=10)


@query(f"""WITH {OUTCOMES} SELECT family, anchor_state, band, outcome, month, count(*) AS n, round(median(v), 10) AS median FROM cells GROUP BY ALL""", "snapshots", "horizons", "contexts")
def x6_month_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = _cells(spark, sf_dir)
    return rounded(_told(context.month_blocks(cells, ["cell"], "outcome", "v", "month")), "median", digits=10)


@query(f"""WITH c AS (SELECT instrument, event_type AS cell, received_ts_ns // {MONTH} AS month, (received_ts_ns >= {MIDDLE})::INT AS half, value - 50 AS v FROM ticks), per AS (SELECT instrument, cell, month, median(v) AS m FROM c GROUP BY ALL),
  sides AS (SELECT instrument, cell, abs(sum(sign(m))) = 2 AS agree FROM (SELECT instrument, cell, half, median(v) AS m FROM c GROUP BY ALL) GROUP BY ALL), months AS (SELECT instrument, cell, count(*) AS months, greatest(count(*) FILTER (m > 0), count(*) FILTER (m < 0)) = count(*) AS consistent FROM per GROUP BY ALL)
  SELECT instrument, cell, months, consistent, agree AS halves_agree, consistent AND months >= 3 AND agree AS stable FROM months JOIN sides USING (instrument, cell)""", "ticks")
def x2_halves_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction stability: one sign in all of three or more months, and in both halves of the leaf."""
    t = F.col("received_ts_ns")
    c = fx.ticks(spark, sf_dir).select("instrument", F.col("event_type").alias("cell"), floor_div(t, MONTH).alias("month"), (t >= MIDDLE).cast("int").alias("half"), (F.col("value") - 50).alias("v"))
    return context.support_by_month(c, ["instrument", "cell"], "month", "v", "half").select("instrument", "cell", "months", "consistent", "halves_agree", "stable")


# Order of events after anchors


@query(f"""WITH ev AS (SELECT a.anchor_id, a.anchor_time, a.anchor_time // {MONTH} AS month, c.detector AS l, c.available_time AS t, row_number() OVER (PARTITION BY a.anchor_id ORDER BY c.available_time, c.context_seq) AS pos FROM anchors a JOIN contexts c ON c.instrument = a.instrument AND c.available_time > a.anchor_time AND c.available_time <= a.anchor_time + {6 * fx.HOUR}),
  p1 AS (SELECT anchor_id, l AS sequence, min(pos) AS pos FROM ev GROUP BY ALL), p2 AS (SELECT anchor_id, sequence || '>' || l AS sequence, min(ev.pos) AS pos FROM p1 JOIN ev USING (anchor_id) WHERE ev.pos > p1.pos GROUP BY ALL),
  p3 AS (SELECT anchor_id, sequence || '>' || l AS sequence, min(ev.pos) AS pos FROM p2 JOIN ev USING (anchor_id) WHERE ev.pos > p2.pos GROUP BY ALL), p4 AS (SELECT anchor_id, sequence || '>' || l AS sequence, min(ev.pos) AS pos FROM p3 JOIN ev USING (anchor_id) WHERE ev.pos > p3.pos GROUP BY ALL),
  p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4)
  SELECT sequence, count(*) AS anchors, count(DISTINCT month) AS months, round(avg((t - anchor_time) / 1e9), 6) AS mean_span_s, count(DISTINCT month) >= 3 AS recurrent FROM p JOIN ev USING (anchor_id, pos) GROUP BY sequence HAVING count(*) >= 5""", "anchors", "contexts")
def x9_event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of detectors in the six hours after an anchor, found at five anchors or more."""
    a = fx.anchors(spark, sf_dir).select("instrument", "anchor_id", "anchor_time", floor_div(F.col("anchor_time"), MONTH).alias("month"))
    got = sequences.event_patterns(a, fx.contexts(spark, sf_dir), ["instrument"], "anchor_id", "anchor_time", "month", "available_time", "context_seq", "detector", TICK_FAMILIES, 6 * fx.HOUR, 4, 5)
    return rounded(got, "mean_span_s", digits=6)


# Agreement, ends and scales


@query(f"""WITH {market.EPISODES}, ends AS (SELECT instrument, min(event_ts_ns) FILTER (ordinal = 1) // 1000000 AS leaf_first_ms FROM rows_ GROUP BY ALL),
  track AS (SELECT instrument, eid, bool_or(lt) AS left_truncated FROM (SELECT instrument, eid, min(ordinal) OVER (PARTITION BY instrument, episode) = 1 AS lt FROM rows_ WHERE episode IS NOT NULL) WHERE eid IS NOT NULL GROUP BY ALL),
  live AS (SELECT instrument, eid, state, arg_min(event_ts_ns, ordinal) // 1000000 AS live_ms, min(ordinal) = 1 AS absorbed FROM rows_ WHERE episode IS NOT NULL AND eid IS NOT NULL AND eid % 17 <> 16 GROUP BY ALL),
  emitted AS (SELECT instrument, eid, state, arg_min(event_ts_ns, (received_ts_ns, source_sequence)) // 1000000 + CASE WHEN eid % 11 = 10 THEN 1 ELSE 0 END - CASE WHEN instrument % 2 = 0 AND eid < 4 THEN 86400000 ELSE 0 END AS emitted_ms FROM snapshots WHERE eid IS NOT NULL AND eid % 13 <> 12 GROUP BY instrument, eid, state),
  judged AS (SELECT instrument, eid, state, live_ms, emitted_ms, CASE WHEN absorbed AND emitted_ms = leaf_first_ms THEN 'BOUNDARY_AMBIGUOUS' WHEN absorbed AND (emitted_ms IS NULL OR emitted_ms < leaf_first_ms) THEN 'EXCLUDED_LEFT_TRUNCATED' WHEN absorbed THEN 'VALUE_MISMATCH'
    WHEN left_truncated AND emitted_ms < leaf_first_ms THEN 'EXCLUDED_LEFT_TRUNCATED' WHEN live_ms IS NULL THEN 'MISSING' WHEN emitted_ms IS NULL THEN 'SPURIOUS' WHEN live_ms = emitted_ms THEN 'MATCHED' ELSE 'VALUE_MISMATCH' END AS class
    FROM live FULL JOIN emitted USING (instrument, eid, state) LEFT JOIN track USING (instrument, eid) LEFT JOIN ends USING (instrument))
  SELECT state, class, count(*) AS n, count(*) FILTER (live_ms <> emitted_ms) AS tick_lags, CAST(max(abs(live_ms - emitted_ms)) AS BIGINT) AS max_lag_ms FROM judged GROUP BY ALL""", "snapshots")
def w10_agreement_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors seen live against records emitted with planted gaps and shifts, with the classes of the leaf's border."""
    rows = cut(market._episodes(spark, sf_dir), "episodes")
    inside, ms = rows.where("episode is not null"), lambda c: floor_div(c, 1_000_000)
    live = inside.where("eid is not null and eid % 17 <> 16").groupBy("instrument", "eid", "state").agg(ms(F.min_by("event_ts_ns", "ordinal")).alias("live_ms"), (F.min("ordinal") == 1).alias("absorbed"))
    cut_off = inside.groupBy("instrument", "episode").agg((F.min("ordinal") == 1).alias("left_truncated"))
    first = rows.where("ordinal = 1").select("instrument", ms(F.col("event_ts_ns")).alias("leaf_first_ms"))
    ids = inside.where("eid is not null").select("instrument", "episode", "eid").distinct()
    tracks = ids.join(cut_off, ["instrument", "episode"]).groupBy("instrument", "eid").agg(F.max("left_truncated").alias("left_truncated")).join(first, "instrument")
    shift = F.when(F.col("eid") % 11 == 10, 1).otherwise(0) - F.when((F.col("instrument") % 2 == 0) & (F.col("eid") < 4), 86_400_000).otherwise(0)
    emitted = fx.snapshots(spark, sf_dir).where("eid is not null and eid % 13 <> 12").groupBy("instrument", "eid", "state").agg(ms(F.min_by("event_ts_ns", F.struct("received_ts_ns", "source_sequence"))).alias("t"))
    judged = lifecycle.agreement_classes(live, emitted.select("instrument", "eid", "state", (F.col("t") + shift).alias("emitted_ms")), tracks, ["instrument", "eid", "state"], ["instrument", "eid"])
    return judged.groupBy("state", "class").agg(F.count("*").alias("n"), F.count_if(F.col("lag_ms") != 0).alias("tick_lags"), F.max(F.abs("lag_ms")).alias("max_lag_ms"))


@query(f"""WITH {market.EPISODES}, ep AS (SELECT instrument, episode, arg_min(state, ordinal) AS entry_state, arg_min(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END, ordinal) AS direction, arg_max(state, ordinal) AS last_state, max(ordinal) AS z FROM rows_ WHERE episode IS NOT NULL GROUP BY ALL)
  SELECT entry_state, direction, last_state, CASE WHEN n.state IS NULL THEN 'RIGHT_CENSORED' WHEN n.state = 'IDLE' THEN 'WENT_IDLE' ELSE 'NEW_EPISODE' END AS end_reason, count(*) AS episodes FROM ep LEFT JOIN rows_ n ON n.instrument = ep.instrument AND n.ordinal = ep.z + 1 GROUP BY ALL""", "snapshots")
def x5_termination_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market._episodes(spark, sf_dir).withColumn("direction", F.when(F.col("k") % 2 == 0, 1).otherwise(-1))
    ended = lifecycle.terminations(rows, ["instrument"], ["direction"])
    return ended.groupBy("entry_state", "direction", "last_state", "end_reason").agg(F.count("*").alias("episodes"))


@query(f"""WITH {market.EPISODES} SELECT instrument, episode, string_agg(state, '>' ORDER BY run) AS states, count(*) - 1 AS changes FROM runs GROUP BY ALL""", "snapshots")
def w4_transition_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lifecycle.transition_lists(lifecycle.state_runs(market._episodes(spark, sf_dir), ["instrument"]), ["instrument"])
    return listed.select("instrument", "episode", F.array_join("states", ">").alias("states"), F.col("changes").cast("long").alias("changes"))


@query(f"""WITH e AS (SELECT instrument, scale, width, bar_close_ts * 1000000 AS t, CASE WHEN close > open THEN 1 ELSE -1 END AS side FROM bars JOIN frames USING (scale) WHERE close <> open),
  j AS (SELECT a.instrument, a.scale, a.t, a.side, max(o.t) FILTER (o.width = a.width AND o.side <> a.side AND o.t <= a.t) AS opposing, max(o.t) FILTER (o.scale = c.coarser AND o.t <= a.t) AS cb, min(o.t) FILTER (o.scale = c.coarser AND o.t >= a.t) AS ca,
    max(o.t) FILTER (o.scale = c.finer AND o.t <= a.t) AS fb, min(o.t) FILTER (o.scale = c.finer AND o.t >= a.t) AS fa, min(o.t) FILTER (o.scale = c.coarser AND o.side <> a.side AND o.t >= a.t) AS against
    FROM e a JOIN (VALUES ('1h', '4h', NULL), ('4h', '1d', '1h'), ('1d', NULL, '4h')) c(scale, coarser, finer) ON a.scale = c.scale JOIN e o ON o.instrument = a.instrument GROUP BY ALL),
  g AS (SELECT *, a.t - cb AS b1, ca - a.t AS a1, a.t - fb AS b2, fa - a.t AS a2 FROM j a)
  SELECT instrument, scale, t, side, t - opposing AS since_opposing_ns, CASE WHEN least(b1, a1) IS NULL OR least(b1, a1) > {4 * fx.HOUR} THEN 'NONE' WHEN least(b1, a1) = 0 THEN 'COINCIDES' WHEN b1 = least(b1, a1) THEN 'FOLLOWS' ELSE 'PRECEDES' END AS vs_coarser,
    CASE WHEN least(b2, a2) IS NULL OR least(b2, a2) > {4 * fx.HOUR} THEN 'NONE' WHEN least(b2, a2) = 0 THEN 'COINCIDES' WHEN b2 = least(b2, a2) THEN 'FOLLOWS' ELSE 'PRECEDES' END AS vs_finer, coalesce(against - t <= {fx.DAY}, false) AS contradicted FROM g""", "ticks", "frames", "bars")
def x17_scale_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that moved, as breaks of three scales, against those of the next coarser and the next finer one."""
    e = fx.bars(spark, sf_dir).where("close <> open").select("instrument", "scale", (F.col("bar_close_ts") * 1000000).alias("t"), F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("side"))
    return context.scale_agreement(cut(e, "breaks"), ["instrument"], "scale", list(fx.BAR_FRAMES), "t", "side", 4 * fx.HOUR, fx.DAY)


# Parts and records


@query("SELECT 'orders.parquet' AS part, count(*) AS rows, true AS has_groups, min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey, true AS known_o_orderkey, min(o_custkey) AS min_o_custkey, max(o_custkey) AS max_o_custkey, true AS known_o_custkey FROM orders")
def s5_footer_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the footer alone, equal to the scan. SQL can't tell the number of row groups, so the query says whether there are any."""
    got = footers.footer_inventory(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey"])
    return got.withColumn("has_groups", F.col("row_groups") > 0).drop("path", "bytes", "row_groups")


@query("""SELECT c_custkey % 4 + 1 AS version, count(*) FILTER (c_acctbal >= 0) AS appended, count(*) FILTER (c_acctbal < 0) AS below_zero, CAST(0 AS BIGINT) AS repeated FROM customer GROUP BY ALL
  UNION ALL SELECT 5, 0, count(*) FILTER (c_acctbal < 0), count(*) FILTER (c_acctbal >= 0) FROM customer WHERE c_custkey % 4 = 1""")
def k4_ledger_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers appended in four batches, one of them tried twice, and a fifth that repeats the second: what each version took in
    and what it refused."""
    c = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    path, refused = shared(spark, "ledger"), None
    for name, part in (("b0", 0), ("b1", 1), ("b1", 1), ("b2", 2), ("b3", 3), ("again", 1)):
        lost = ledger.append(spark, path, c.where(F.col("c_custkey") % 4 == part), "c_custkey", {"BELOW_ZERO": F.col("c_acctbal") >= 0}, name)
        lost = lost.select(F.lit(name).alias("batch"), "rejects")
        refused = lost if refused is None else refused.unionByName(lost)
    # the second try of a batch refuses the same rows again
    twice = F.when(F.col("batch") == "b1", 2).otherwise(1)
    low = F.array_contains("rejects", "BELOW_ZERO")
    per = refused.groupBy("batch").agg((F.count_if(low) / F.first(twice)).cast("long").alias("below_zero"), F.count_if(~low).alias("repeated"))
    versions = spark.createDataFrame([(v["version"], v["batch"], v["rows"]) for v in ledger.history(spark, path)], "version long, batch string, appended long")
    return versions.join(per, "batch", "left").fillna(0).select("version", "appended", "below_zero", "repeated")


def _longs(section: str, item: str, verdict: str, measures: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {item} AS item, '{m}' AS measure, round(CAST({c} AS DOUBLE), 9) AS number, {verdict} AS verdict FROM {source}" for m, c in measures.items())


METRICS = {m: m for m in ("population", "present", "missing_context", "missing_anchor_value", "missing_context_value", "zero_excluded", "observations", "pearson", "concordance", "mean_lag_s")}
RUN = f"""WITH {st.DISCOVERY}, a AS (SELECT instrument, k % 3 AS band, anchor_time, event_ts_ns, CASE WHEN k % 7 <> 0 THEN value - 50 END AS value FROM anchors),
  v AS (SELECT count(*) AS records, 0 AS zero, count(DISTINCT instrument) AS identities, min(anchor_time) AS first_ns, max(anchor_time) AS last_ns FROM a),
  shapes AS (SELECT concat_ws('|', instrument, band) AS item, count(*) AS anchors, count(value) AS samples, avg(value) AS mean, min(value) AS least, max(value) AS greatest, stddev_samp(value) AS deviation FROM a GROUP BY ALL),
  f AS (SELECT detector, count(*) AS population, count(available_time) AS present, count(*) - count(available_time) AS missing_context, count(*) FILTER (available_time IS NOT NULL AND value IS NULL) AS missing_anchor_value,
    count(*) FILTER (available_time IS NOT NULL AND value IS NOT NULL AND context_value IS NULL) AS missing_context_value, count(*) FILTER ({st.OK_PAIR} AND (value = 0 OR context_value = 0)) AS zero_excluded, count(*) FILTER ({st.OK_PAIR} AND value <> 0 AND context_value <> 0) AS observations,
    nullif(corr(value, context_value) FILTER ({st.OK_PAIR}), 'nan'::DOUBLE) AS pearson, avg(CASE WHEN sign(value) = sign(context_value) THEN 1.0 ELSE 0 END) FILTER ({st.OK_PAIR} AND value <> 0 AND context_value <> 0) AS concordance, round(avg(anchor_time - available_time) / 1e9, 3) AS mean_lag_s FROM disc GROUP BY ALL),
  s AS (SELECT *, CASE WHEN observations = 0 OR pearson IS NULL THEN 'INCONCLUSIVE' ELSE 'PARTIAL' END AS status FROM f),
  g AS (SELECT s.*, coalesce(observations >= q.n AND abs(round(pearson, 9)) >= q.m, false) AS eligible, CASE WHEN q.n IS NULL THEN 'NO_PREDECLARED_GATE' WHEN observations >= q.n AND abs(round(pearson, 9)) >= q.m THEN 'PREDECLARED_GATE_PASSED' ELSE 'PREDECLARED_GATE_NOT_PASSED' END AS reason
    FROM s LEFT JOIN (VALUES ('purchase', 10, 0.0), ('view', 10, 0.99)) q(detector, n, m) USING (detector)),
  w AS (SELECT count(*) AS asked, count(*) FILTER (status = 'PARTIAL') AS concluded FROM s)
  {_longs("validation", "NULL", "NULL", {"records": "records"} | {m: "zero" for m in ("invalid", "BAD_TIME", "NO_AVAILABILITY", "NOT_YET_KNOWN", "NOT_FINITE", "NO_IDENTITY")}, "v")}
  UNION ALL {_longs("phenotype", "item", "NULL", {m: m for m in ("anchors", "samples", "mean", "least", "greatest", "deviation")}, "shapes")}
  UNION ALL {_longs("discovery", "detector", "status", METRICS, "s")} UNION ALL {_longs("gate", "detector", "reason", {"eligible": "eligible::INT"}, "g")}
  UNION ALL {_longs("candidate", "detector", "'candidate-' || substr(sha256(concat_ws('|', detector, population, observations)), 1, 16)", {"observations": "observations"}, "g WHERE eligible")}
  UNION ALL {_longs("scope", "NULL", "NULL", {m: m for m in ("identities", "first_ns", "last_ns")}, "v")}
  UNION ALL {_longs("status", "NULL", "CASE WHEN concluded = 0 THEN 'INCONCLUSIVE' ELSE 'PARTIAL' END", {"requests": "asked", "concluded": "concluded"}, "w")}"""


@query(RUN, "anchors", "contexts")
def p1_population_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run as one report: validation, phenotypes, discoveries, gates, candidates, scope, status."""
    a = fx.anchors(spark, sf_dir).select("instrument", (F.col("k") % 3).alias("band"), "anchor_time", F.col("anchor_time").alias("known_at"), F.when(F.col("k") % 7 != 0, F.col("value") - 50).alias("value"))
    gates = spark.createDataFrame([("purchase", 10, 0.0), ("view", 10, 0.99)], "detector string, min_support long, min_abs_metric double")
    return population.run_report(cut(a, "anchors"), cut(st.discovery(spark, sf_dir), "discovery"), gates, "detector", ["instrument", "band"], "instrument")
