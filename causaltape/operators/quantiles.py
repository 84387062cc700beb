"""Order statistics of groups of any size: exact selection by rounds of counting, and one-pass sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causaltape.sources.lake import cut

#: Size parameter of the sketches: their rank error is about 0.1 % of the rows, and few rows are held exactly.
K = 2048
#: Marks that a sketch is read at, and the neighbours of a rank's mark that a round keeps between its pivots: one mark is
#: more than the error of the sketch.
MARKS = 512
#: So many groups' bins go to all tasks at once; rows that meet more of them are exchanged.
FEW = 50_000


def same(left: list[str], right: list[str]) -> Column:
    """Equality of group columns, in which null equals null."""
    test = F.lit(True)
    for a, b in zip(left, right, strict=True):
        test = test & F.col(a).eqNullSafe(F.col(b))
    return test


def sketched(rows: DataFrame, by: list[str], value: str, probabilities: dict[str, float], k: int = K) -> DataFrame:
    """Per group its number of values and the approximate quantiles, in one pass with a partial step before the exchange.

    A task holds sketches of about `k` values a group, whatever the rows. The rank of an answer is off by about 2.3 / k^0.9
    of the rows. Nulls and NaN count for nothing; a group without any value has n 0 and null quantiles. Empty tables give
    an empty result; other columns are ignored."""
    x = F.col(value).cast("double")
    kept = F.when(~F.isnan(x), x)
    got = rows.groupBy(*by).agg(F.count(kept).alias("n"), F.kll_sketch_agg_double(kept, F.lit(k)).alias("__s"))
    return got.select(*by, "n", *[F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("__s", F.lit(float(p)))).alias(name) for name, p in probabilities.items()])


def selected(rows: DataFrame, by: list[str], value: str, targets: DataFrame, k: int = K) -> DataFrame:
    """`targets` (by, rank, size) with `value`, the rank-th smallest value of the group, counted from 0; exact.

    Each round counts, per target, the values of its open segment below, at, between, at and above two pivots, and sketches
    the three open pieces. The piece that holds the rank is the next segment, unless a pivot is the answer. Pivots come
    from the sketch of the segment around the rank, so a round leaves 3 of MARKS parts of the rows, and 1e13 values
    take about five; a wrong pivot costs another round and never the result. A round hands on a few counts and sketches a
    target, is an aggregate with a partial step, and is written to the shared folder: no task holds a group's values.
    Building the result runs these jobs. Nulls and NaN must have been left out of `rows`, `size` is the number of rows of the group
    and 0 <= rank < size."""
    x = F.col("__x")
    names = [f"__g{i}" for i in range(len(by))]
    data = rows.select(*by, F.col(value).cast("double").alias("__x"))
    sketch = lambda inside: F.kll_sketch_agg_double(F.when(inside, x), F.lit(k))
    whole = data.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)]).agg(sketch(F.lit(True)).alias("sketch"))
    asked = targets.select(*by, "rank", "size").distinct()
    none = F.lit(None).cast("double")
    state = asked.join(whole, same(by, names)).select(*by, "rank", F.lit(0).cast("long").alias("base"), "size", none.alias("low"), none.alias("high"), "sketch")
    done = None
    while True:
        inside = F.col("rank") - F.col("base")
        mark = F.floor((inside + 0.5) / F.col("size") * MARKS).cast("int")
        at = lambda shift: F.get("marks", F.least(F.lit(MARKS), F.greatest(F.lit(0), mark + shift)))
        few = F.col("size") <= MARKS // 2
        marked = state.withColumn("marks", F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / MARKS) for i in range(MARKS + 1)])))
        pivots = marked.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], "rank", "base", "low", "high", F.when(few, at(0)).otherwise(at(-1)).alias("a"), F.when(few, at(0)).otherwise(at(2)).alias("b"))
        pivots = cut(pivots, "pivots")
        open_ = (F.col("low").isNull() | (x > F.col("low"))) & (F.col("high").isNull() | (x < F.col("high")))
        pieces = {"under": x < F.col("a"), "middle": (x > F.col("a")) & (x < F.col("b")), "over": x > F.col("b")}
        counts = data.join(pivots, same(by, names) & open_).groupBy(*by, "rank", "base", "low", "high", "a", "b").agg(
            *[F.count_if(p).alias(n) for n, p in pieces.items()], F.count_if(x == F.col("a")).alias("at_a"), F.count_if(x == F.col("b")).alias("at_b"), *[sketch(p).alias(f"s_{n}") for n, p in pieces.items()]
        )
        first = F.col("base") + F.col("under")
        second = first + F.col("at_a")
        third = second + F.col("middle")
        fourth = third + F.when(F.col("a") < F.col("b"), F.col("at_b")).otherwise(0)
        rank = F.col("rank")
        part = lambda base, size, low, high, s, answer=none: F.struct(base.alias("base"), size.alias("size"), low.alias("low"), high.alias("high"), s.alias("sketch"), answer.alias("answer"))
        c = F.col
        found = lambda v: part(c("base"), F.lit(1).cast("long"), c("low"), c("high"), F.lit(None).cast("binary"), c(v))
        place = (
            F.when(rank < first, part(c("base"), c("under"), c("low"), c("a"), c("s_under"))).when(rank < second, found("a"))
            .when(rank < third, part(second, c("middle"), c("a"), c("b"), c("s_middle"))).when(rank < fourth, found("b"))
            .otherwise(part(fourth, c("over"), c("b"), c("high"), c("s_over")))
        )
        step = cut(counts.select(*by, "rank", place.alias("p")).select(*by, "rank", "p.*"), "selection")
        settled = step.where("answer is not null").select(*by, "rank", F.col("answer").alias("value"))
        done = settled if done is None else done.unionByName(settled)
        state = step.where("answer is null").drop("answer")
        if state.isEmpty():
            return done


def exact(rows: DataFrame, by: list[str], value: str, probabilities: dict[str, float], k: int = K) -> DataFrame:
    """Per group its number of values and its exact quantiles, interpolated linearly between the two values next to
    place p * (n - 1), as `percentile` does, by `selected` and so with no group's values in one task.

    Nulls and NaN count for nothing; a group without any value has n 0 and null quantiles. Group columns may be null. Ties
    and repeated rows are values like others. An empty table gives an empty result; other columns are ignored. `rows`
    is read once a round, so an expensive one should be written first."""
    x = F.col(value).cast("double")
    data = rows.select(*by, F.when(~F.isnan(x), x).alias("__v"))
    sizes = cut(data.groupBy(*by).agg(F.count("__v").alias("n")), "sizes")
    place = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for name, p in probabilities.items()])
    wanted = sizes.where("n > 0").select(*by, F.col("n").alias("size"), F.inline(place)).withColumn("lower", F.floor("at").cast("long")).withColumn("upper", F.ceil("at").cast("long"))
    ends = wanted.select(*by, "size", F.explode(F.array("lower", "upper")).alias("rank"))
    values = selected(data.where("__v is not null"), by, "__v", ends, k)
    names = [f"__h{i}" for i in range(len(by))]
    look = lambda v: values.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col("rank").alias("__r"), F.col("value").alias(v))
    both = wanted.join(look("v0"), same(by, names) & (F.col("lower") == F.col("__r"))).drop(*names, "__r").join(look("v1"), same(by, names) & (F.col("upper") == F.col("__r"))).drop(*names, "__r")
    one = F.when(F.col("v0") == F.col("v1"), F.col("v0")).otherwise(F.col("v0") + (F.col("at") - F.col("lower")) * (F.col("v1") - F.col("v0")))
    wide = both.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)]).agg(*[F.max(F.when(F.col("name") == name, one)).alias(name) for name in probabilities])
    return sizes.join(wide, same(by, names), "left").drop(*names)


def _bin(x: Column) -> Column:
    """A number that never falls as x rises: 16 to every power of two, NaN last."""
    size = F.least(F.floor(F.least(F.log2(F.abs(x)), F.lit(1100.0)) * 16), F.lit(17_600)) + 20_000
    return F.when(F.isnan(x), 50_000).when(x > 0, size).when(x < 0, -size).otherwise(0).cast("int")


def medians(rows: DataFrame, groupings: list[list[str]], value: str) -> list[DataFrame]:
    """For each list of columns a table of its groups with `n` values and their exact `median`, the mean of the two middle
    ones if they are even in number, as `percentile` has it.

    Two reads of `rows` serve all groupings, so an expensive table should be written first. The first counts values by bins
    of a sixteenth of a power of two, under all columns at once; sums of these counts say which bins hold the middle of
    each group. The second takes the values of those bins alone, counted per distinct value. No task holds a group's values, unless they
    all crowd in one bin, and then it is their distinct ones. Nulls count for nothing and groups without a value are left out; NaN
    comes last. Group columns may be null. Writes two tables."""
    names = list(dict.fromkeys(c for by in groupings for c in by))
    data = rows.select(*names, F.col(value).cast("double").alias("__x")).where("__x is not null").withColumn("__bin", _bin(F.col("__x")))
    counts = cut(data.groupBy(*names, "__bin").agg(F.count("*").alias("__n")), "bins")
    wanted, near = [], data
    for i, by in enumerate(groupings):
        per = counts.groupBy(*by, "__bin").agg(F.sum("__n").alias("__n"))
        along = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
        upto = per.withColumn("__upto", F.sum("__n").over(along)).withColumn("n", F.sum("__n").over(Window.partitionBy(*by)))
        middle = upto.select(*by, "__bin", "n", "__n", (F.col("__upto") - F.col("__n")).alias("__base"), F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("__rank"))
        middle = middle.where((F.col("__rank") >= F.col("__base")) & (F.col("__rank") < F.col("__base") + F.col("__n")))
        middle = cut(middle.select(*by, "__bin", "n", (F.col("__rank") - F.col("__base")).alias("__at")), "middle")
        wanted.append(middle)
        # most rows are told off by one number; the few that are left, by all columns
        hashed = middle.select(F.xxhash64(*by, "__bin").alias("__hash"), F.lit(True).alias(f"__near{i}")).distinct()
        near = near.join(F.broadcast(hashed) if middle.count() <= FEW else hashed, F.xxhash64(*by, "__bin") == F.col("__hash"), "left").drop("__hash")
    flags = [f"__in{i}" for i in range(len(groupings))]
    kept = near.where(F.coalesce(*[f"__near{i}" for i in range(len(groupings))], F.lit(False)))
    for by, flag, middle in zip(groupings, flags, wanted, strict=True):
        held = [f"__h{j}" for j in range(len(by))]
        asked = middle.select(*[F.col(c).alias(h) for c, h in zip(by, held, strict=True)], F.col("__bin").alias("__hbin"), F.lit(True).alias(flag)).distinct()
        kept = kept.join(F.broadcast(asked) if middle.count() <= FEW else asked, same(by, held) & (F.col("__bin") == F.col("__hbin")), "left").drop(*held, "__hbin")
    kept = cut(kept.where(F.coalesce(*flags, F.lit(False))).groupBy(*names, "__bin", "__x", *flags).agg(F.count("*").alias("__n")), "middles")
    out = []
    for by, flag, middle in zip(groupings, flags, wanted, strict=True):
        per = kept.where(flag).groupBy(*by, "__bin", "__x").agg(F.sum("__n").alias("__n"))
        upto = per.withColumn("__upto", F.sum("__n").over(Window.partitionBy(*by, "__bin").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)))
        held = [f"__h{j}" for j in range(len(by))]
        asked = middle.select(*[F.col(c).alias(h) for c, h in zip(by, held, strict=True)], F.col("__bin").alias("__hbin"), "n", "__at")
        at = (F.col("__at") >= F.col("__upto") - F.col("__n")) & (F.col("__at") < F.col("__upto"))
        found = upto.join(asked, same(by, held) & (F.col("__bin") == F.col("__hbin"))).where(at)
        low, high = F.min("__x"), F.max("__x")
        out.append(found.groupBy(*by).agg(F.max("n").alias("n"), F.when(low == high, low).otherwise(0.5 * low + 0.5 * high).alias("median")))
    return out
