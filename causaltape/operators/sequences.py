"""Order of events after anchors: patterns of labels with gaps, grown from tape-wide successors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causaltape.functions.clock import floor_div
from causaltape.operators.asof import DAY_NS, carry_many
from causaltape.sources.lake import cut


def successors(rows: DataFrame, by: list[str], labels: list[str], time: str = "__t", bucket_ns: int = DAY_NS) -> DataFrame:
    """`rows` (by, __t, __kind, __s, __l) with `nexts`: of each label with a later event, its number and the (t, s) of
    the first one. __kind is 0 for events, whose __l is the place of their label among `labels`, and 1 for anchors, which
    come after events of their own time. Carried backwards over time buckets, all labels at once."""
    order = [-F.col(time), -F.col("__kind"), -F.col("__s"), -F.col("__l")]
    at = F.struct(F.col(time).alias("t"), F.col("__s").alias("s"))
    turned = rows.withColumn("__b", -floor_div(F.col(time), bucket_ns)).repartition(*by, "__b")
    values = {f"__n{i}": F.when((F.col("__kind") == 0) & (F.col("__l") == i), at) for i in range(len(labels))}
    got = carry_many(turned, by, order, values, "__b", include_current=False)
    every = F.array(*[F.when(F.col(f"__n{i}").isNotNull(), F.struct(F.lit(i).alias("l"), F.col(f"__n{i}.t").alias("t"), F.col(f"__n{i}.s").alias("s"))) for i in range(len(labels))])
    return got.withColumn("nexts", F.filter(every, lambda n: n.isNotNull())).drop("__b", *values)


def event_patterns(anchors: DataFrame, events: DataFrame, by: list[str], anchor_id: str, anchor_time: str, month: str, event_time: str, event_seq: str, label: str, labels: list[str], horizon_ns: int, longest: int = 4, least: int = 1) -> DataFrame:
    """Patterns of up to `longest` labels that follow anchors in this order, other events between them allowed: at how
    many anchors, in how many months (of the anchor), `recurrent` if in three or more, and the mean seconds from the anchor to
    the pattern's end at its earliest. Events count if later than the anchor and within the horizon.

    Pattern growth: a pattern's anchors are kept with the earliest event that completes it, and meet the next event
    of each label, which is worked out once for the tape. So anchors are never joined with the events of their horizon: rows
    are anchors times frequent patterns. Patterns at fewer than `least` anchors are not grown, as no longer one can be more
    frequent. Each round is written to the shared folder; making this DataFrame runs jobs. `labels` is a declared list;
    other labels and null times, labels or keys are left out. Events equal in key, time, sequence and label count once.
    Anchors need distinct ids. Empty tables give no patterns."""
    place = F.coalesce(*[F.when(F.col(label) == name, F.lit(i)) for i, name in enumerate(labels)])
    tape = events.dropna(subset=[event_time, *by]).select(*by, F.col(event_time).alias("__t"), F.lit(0).alias("__kind"), F.col(event_seq).alias("__s"), place.alias("__l")).where("__l is not null").dropDuplicates()
    marks = anchors.dropna(subset=[anchor_time, *by]).select(*by, F.col(anchor_time).alias("__t"), F.lit(1).alias("__kind"), F.lit(0).cast("long").alias("__s"), F.lit(0).alias("__l"), F.struct(F.col(anchor_id).alias("id"), F.col(month).alias("month")).alias("__anchor"))
    known = cut(successors(tape.unionByName(marks, allowMissingColumns=True), by, labels), "successors")
    links = known.where("__kind = 0").select(*by, "__t", "__s", "__l", "nexts")
    front = known.where("__kind = 1").select(*by, "__anchor", F.col("__t").alias("__start"), F.lit("").alias("sequence"), F.explode("nexts").alias("__n"))
    names = F.array(*[F.lit(n) for n in labels])
    found = None
    for length in range(1, longest + 1):
        grown = front.where(F.col("__n.t") - F.col("__start") <= horizon_ns)
        name = F.element_at(names, F.col("__n.l") + 1)
        named = F.when(F.col("sequence") == "", name).otherwise(F.concat_ws(">", "sequence", name))
        grown = cut(grown.select(*by, "__anchor", "__start", named.alias("sequence"), F.col("__n.t").alias("__t"), F.col("__n.s").alias("__s"), F.col("__n.l").alias("__l")), "patterns")
        per = grown.groupBy("sequence", F.col("__anchor.month").alias("__month")).agg(F.count("*").alias("n"), F.sum((F.col("__t") - F.col("__start")) / 1e9).alias("__span"))
        counted = per.groupBy("sequence").agg(F.sum("n").alias("anchors"), F.count("__month").alias("months"), (F.sum("__span") / F.sum("n")).alias("mean_span_s")).where(F.col("anchors") >= least)
        counted = cut(counted, "frequent")
        found = counted if found is None else found.unionByName(counted)
        if length < longest:
            frequent = grown.join(counted.select("sequence"), "sequence", "left_semi")
            front = frequent.join(links, [*by, "__t", "__s", "__l"]).select(*by, "__anchor", "__start", "sequence", F.explode("nexts").alias("__n"))
    return found.withColumn("recurrent", F.col("months") >= 3)
