"""Summaries, resampling nulls, multiplicity control and survival curves as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causaltape.sources.lake import cut


def moments(x: str | Column) -> list[Column]:
    """Count, mean, sample and population variance; a single value has no sample variance, reported as 0."""
    c = F.col(x) if isinstance(x, str) else x
    return [F.count(c).alias("n"), F.avg(c).alias("mean"), F.coalesce(F.var_samp(c), F.lit(0.0)).alias("var_samp"), F.var_pop(c).alias("var_pop")]


def pearson(x: Column, y: Column) -> Column:
    """Correlation of the pairs in which both are present; null below two pairs or for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when((F.count(a) >= 2) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def concordance(x: Column, y: Column) -> Column:
    """Share of pairs of equal sign among those without a null or zero."""
    good = x.isNotNull() & y.isNotNull() & (x != 0) & (y != 0)
    return F.avg(F.when(good, (F.signum(x) == F.signum(y)).cast("double")))


def phenotype_summary(records: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group: rows, values, mean and interpolated quantiles. Groups without a value stay."""
    return records.groupBy(*by).agg(
        F.count("*").alias("anchors"), F.count(value).alias("samples"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.percentile(value, 0.1).alias("p10"),
        F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.9).alias("p90"), F.max(value).alias("max"),
    )


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: dict[str, int]) -> DataFrame:
    """Per group: count and lower-nearest-rank quantiles, the value at index p*(n-1) div 100 of the sorted values.

    Values are first reduced to counts per distinct value, so that a group's ranks come from a running sum over
    those and not from its rows."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    at = lambda p: F.floor(F.lit(p) * (F.col("n") - 1) / 100)
    pick = lambda p: F.min(F.when(F.col("upto") > at(p), F.col(value)))
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *[pick(p).alias(name) for name, p in percents.items()])


def support_label(n: Column) -> Column:
    return F.when(n < 150, "INSUFFICIENT_SUPPORT").when(n < 300, "LOW_SUPPORT_FALLBACK").otherwise("SUPPORTED")


def bands(df: DataFrame, value: str, out: str = "band", by: list[str] | None = None) -> DataFrame:
    """Adds the fifth (0 to 4) of each row's rank among all values, ties sharing the lowest rank. Ranks come from
    counts per distinct value, not from one sort of all rows."""
    by = by or []
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    below = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("__below", F.coalesce(F.sum("__c").over(below), F.lit(0))).withColumn("__n", F.sum("__c").over(Window.partitionBy(*by)))
    band = F.least(F.floor(F.floor(F.col("__below") * 100 / F.col("__n")) / 20), F.lit(4)).cast("int")
    return df.join(ranked.select(*by, value, band.alias(out)), [*by, value])


def effect_size(df: DataFrame, group: Column, value: str, by: list[str] | None = None) -> DataFrame:
    """Difference of means of two groups, standardised by the pooled deviation, and Hedges' correction."""
    one, two = F.when(group, F.col(value)), F.when(~group, F.col(value))
    a = df.groupBy(*(by or [])).agg(F.count(one).alias("n_a"), F.count(two).alias("n_b"), F.avg(one).alias("mean_a"), F.avg(two).alias("mean_b"), F.var_samp(one).alias("va"), F.var_samp(two).alias("vb"))
    df_ = F.col("n_a") + F.col("n_b") - 2
    pooled = F.sqrt(((F.col("n_a") - 1) * F.coalesce("va", F.lit(0.0)) + (F.col("n_b") - 1) * F.coalesce("vb", F.lit(0.0))) / df_)
    diff = F.col("mean_a") - F.col("mean_b")
    d = F.when((df_ > 0) & (pooled > 0), diff / pooled)
    return a.select(*(by or []), "n_a", "n_b", diff.alias("difference"), d.alias("cohen_d"), (d * (1 - 3 / (4 * df_ - 1))).alias("hedges_g"))


def draw(*parts: Column | int | str) -> Column:
    """A repeatable 32-bit draw from a seed and keys; the same in any partitioning and in other engines."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def p_value(exceed: Column, draws: int | Column) -> Column:
    return (exceed + 1) / F.lit(draws + 1)


def block_bootstrap(values: DataFrame, block: str, value: str, replicates: int, seed: int) -> DataFrame:
    """One row: the mean, how many block-bootstrap means reach it in size, and the two-sided p-value.

    Values are centred at their mean and whole blocks are drawn with replacement until a replicate has at least as
    many values as the sample. Blocks are reduced to (count, sum) first, those without a value are left out; draws are
    rows of a small table, and every replicate's running count is a window of its own. Draws a replicate are twice the
    number of blocks, doubled for as long as a replicate falls short, so one tiny block does not multiply them."""
    sums = values.groupBy(block).agg(F.count(value).alias("n"), F.sum(value).alias("s")).where("n > 0")
    total = sums.agg(F.sum("n").alias("total_n"), (F.sum("s") / F.sum("n")).alias("observed"), F.count("*").alias("blocks"), F.min("n").alias("least"))
    numbered = sums.withColumn("no", F.row_number().over(Window.orderBy(block)) - 1)
    reps = values.sparkSession.range(replicates).select(F.col("id").alias("rep")).join(F.broadcast(total))
    enough = F.ceil(F.col("total_n") / F.col("least"))

    def drawn(rounds: int) -> DataFrame:
        every = F.sequence(F.lit(0).cast("long"), F.least(enough, rounds * F.col("blocks")) - 1)
        return reps.withColumn("k", F.explode(every)).withColumn("no", draw(seed, F.col("rep"), F.col("k")) % F.col("blocks")).join(numbered, "no")

    rounds = 2
    while not drawn(rounds).groupBy("rep", "total_n").agg(F.sum("n").alias("n")).where("n < total_n").isEmpty():
        rounds *= 2
    draws = drawn(rounds)
    w = Window.partitionBy("rep").orderBy("k")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    means = draws.withColumn("before", before).where("before < total_n").groupBy("rep").agg((F.sum(F.col("s") - F.col("n") * F.col("observed")) / F.sum("n")).alias("m"), F.first("observed").alias("observed"))
    out = means.agg(F.first("observed").alias("observed"), F.count_if(F.abs("m") >= F.abs("observed")).alias("exceedances"))
    return out.select("observed", "exceedances", F.lit(replicates).alias("draws"), p_value(F.col("exceedances"), replicates).alias("p_value"))


def block_permutation(values: DataFrame, block: str, group: str, value: str, row_id: str, replicates: int, seed: int) -> DataFrame:
    """One row: the difference of group means, and how often it is reached when labels are shuffled inside blocks.

    A replicate gives the group label to as many rows of each block as have it, in order of a hash of (seed,
    replicate, row). As the hashes are spread evenly, where the label ends in a block is known but for a few deviations:
    rows off it are added up where they stand, and only those close to that border are exchanged and ranked. That the
    border lies among them is checked, and they are taken from further off if it does not. Writes small tables and runs jobs."""
    observed = values.agg((F.avg(F.when(F.col(group), F.col(value))) - F.avg(F.when(~F.col(group), F.col(value)))).alias("observed"))
    sized = values.groupBy(block).agg(F.count("*").alias("__n"), F.count_if(F.col(group)).alias("__treated"))
    reps = values.select(block, value, row_id).join(sized, block).withColumn("__rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = reps.withColumn("__draw", draw(seed, F.col("__rep"), F.col(row_id)))
    share, n = F.col("__treated") / F.col("__n"), F.col("__n")
    for deviations in (8, 80, None):
        # the last one ranks all rows
        reach = F.lit(2.0) if deviations is None else deviations * (F.sqrt(share * (1 - share) / n) + 8 / n)
        side = F.when(F.col("__draw") < (share - reach) * 2**32, -1).when(F.col("__draw") > (share + reach) * 2**32, 1).otherwise(0)
        sided = drawn.withColumn("__side", side)
        own = [F.when(F.col("__side") == 0, F.col(c)).alias(name) for c, name in (("__draw", "__at"), (row_id, "__id"), (value, "__v"))]
        v = F.col(value)
        dealt = cut(sided.groupBy("__rep", block, "__treated", "__side", *own).agg(F.count("*").alias("__rows"), F.count(v).alias("__n"), F.sum(v).alias("__s")), "dealt")
        below, near = (F.coalesce(F.sum(F.when(F.col("__side") == k, F.col("__rows"))), F.lit(0)) for k in (-1, 0))
        counted = dealt.groupBy("__rep", block, "__treated").agg(below.alias("__below"), near.alias("__near"))
        if counted.where("__below > __treated or __below + __near < __treated").isEmpty():
            break
    upto = F.sum("__rows").over(Window.partitionBy("__rep", block).orderBy("__at", "__id", "__v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = dealt.where("__side = 0").withColumn("__upto", upto).join(counted.select("__rep", block, "__below"), ["__rep", block])
    # rows that share draw, id and value stand in one
    taken = F.least(F.greatest(F.col("__treated") - F.col("__below") - F.col("__upto") + F.col("__rows"), F.lit(0)), F.col("__rows")) / F.col("__rows")
    border = ranked.select("__rep", taken.alias("__share"), "__n", "__s")
    parts = border.unionByName(dealt.where("__side <> 0").select("__rep", F.when(F.col("__side") < 0, 1.0).otherwise(0.0).alias("__share"), "__n", "__s"))
    one, other = F.col("__share"), 1 - F.col("__share")
    whole = parts.groupBy("__rep").agg(*[F.sum(F.col(c) * w).alias(name) for c, w, name in (("__s", one, "st"), ("__n", one, "nt"), ("__s", other, "sc"), ("__n", other, "nc"))])
    mean = lambda s, c: F.when(F.col(c) > 0, F.col(s) / F.col(c))
    stats = whole.select((mean("st", "nt") - mean("sc", "nc")).alias("d"))
    out = stats.join(F.broadcast(observed)).agg(F.first("observed").alias("observed"), F.count_if(F.abs("d") >= F.abs("observed")).alias("exceedances"))
    return out.select("observed", "exceedances", F.lit(replicates).alias("draws"), p_value(F.col("exceedances"), replicates).alias("p_value"))


def false_discovery(tests: DataFrame, p: str, q: float = 0.05, dependent: bool = False) -> DataFrame:
    """Adds adjusted p-values and rejections under Benjamini-Hochberg, or Benjamini-Yekutieli if `dependent`.

    Missing p-values stay in the table and in the family's size, with null results. Runs over the family's rows in
    one ordered window: a family is a list of tests, not of observations."""
    m = tests.agg(F.count("*").alias("m"))
    c = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("m")), F.lit(0.0), lambda s, k: s + 1 / k) if dependent else F.lit(1.0)
    sized = tests.join(F.broadcast(m.withColumn("c", c)))
    rank = F.when(F.col(p).isNotNull(), F.rank().over(Window.orderBy(F.col(p).asc_nulls_last())) + F.count(p).over(Window.partitionBy(p)) - 1)
    raw = F.col(p) * F.col("m") * F.col("c") / F.col("rank")
    least = F.min("raw").over(Window.orderBy(F.col(p).desc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0))
    out = sized.withColumn("rank", rank).withColumn("raw", raw).withColumn("adjusted", F.when(F.col(p).isNotNull(), F.least(least, F.lit(1.0))))
    return out.withColumn("rejected", F.col("adjusted") <= q).drop("m", "c", "rank", "raw")


def holm(tests: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Adds Holm's adjusted p-values and rejections; missing p-values stay, with null results."""
    m = tests.agg(F.count(p).alias("m"))
    order = Window.orderBy(F.col(p).asc_nulls_last())
    scaled = tests.join(F.broadcast(m)).withColumn("rank", F.rank().over(order)).withColumn("raw", F.when(F.col(p).isNotNull(), (F.col("m") - F.col("rank") + 1) * F.col(p)))
    out = scaled.withColumn("holm", F.when(F.col(p).isNotNull(), F.least(F.max("raw").over(order.rangeBetween(Window.unboundedPreceding, 0)), F.lit(1.0))))
    return out.withColumn("holm_rejected", F.col("holm") <= alpha).drop("m", "rank", "raw")


def max_statistic(observed: DataFrame, worlds: DataFrame, world: str, name: str, stat: str) -> DataFrame:
    """Joint p-value of each observed statistic: in how many worlds the largest statistic in size reaches it.

    Worlds are reduced to the number that share a top, and tops and statistics are counted up in one falling order, so
    no statistic meets a world; that order runs over one family and its worlds, not over observations. A null statistic
    is reached by no world."""
    tops = worlds.groupBy(world).agg(F.max(F.abs(stat)).alias("__v"))
    total = tops.agg(F.count("*").alias("worlds"))
    counts = tops.where("__v is not null").groupBy("__v").agg(F.count("*").alias("__n"))
    both = counts.unionByName(observed.select(name, stat, F.abs(stat).alias("__v"), F.lit(0).cast("long").alias("__n")), allowMissingColumns=True)
    # at a tie the worlds come first, as equal counts as reached
    falling = Window.orderBy(F.col("__v").desc_nulls_last(), F.col("__n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__reached", F.sum("__n").over(falling)).where("__n = 0").crossJoin(F.broadcast(total))
    counted = met.select(name, stat, F.when(F.col(stat).isNull(), 0).otherwise(F.col("__reached")).cast("long").alias("exceedances"), "worlds")
    return counted.withColumn("p_value", (F.col("exceedances") + 1) / (F.col("worlds") + 1))


def max_statistic_running(observed: DataFrame, worlds: DataFrame, world: str, name: str, stat: str) -> DataFrame:
    """The accumulator of `max_statistic` after each world, in order of `world`: exceedances and p-value so far."""
    tops = worlds.groupBy(world).agg(F.max(F.abs(stat)).alias("__top"))
    w = Window.partitionBy(name).orderBy(world).rowsBetween(Window.unboundedPreceding, 0)
    met = observed.join(tops).withColumn("exceedances", F.sum((F.col("__top") >= F.abs(stat)).cast("long")).over(w)).withColumn("worlds", F.count("*").over(w))
    return met.select(name, world, stat, "exceedances", "worlds", ((F.col("exceedances") + 1) / (F.col("worlds") + 1)).alias("p_value"))


def survival(observations: DataFrame, time: str, event: str, by: list[str] | None = None) -> DataFrame:
    """Kaplan-Meier and Nelson-Aalen per distinct time: ties share the set at risk. Windows run over the distinct
    times of each group; the product is a sum of logarithms, with an explicit zero once a hazard is 1."""
    by = by or []
    per = observations.groupBy(*by, time).agg(F.count_if(F.col(event)).alias("events"), F.count_if(~F.col(event)).alias("censored"))
    w = Window.partitionBy(*by).orderBy(time)
    later = F.sum(F.col("events") + F.col("censored")).over(w.rowsBetween(0, Window.unboundedFollowing))
    hazard = F.col("events") / F.col("at_risk")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = per.withColumn("at_risk", later).withColumn("hazard", hazard)
    product = F.exp(F.sum(F.when(F.col("hazard") < 1, F.ln(1 - F.col("hazard")))).over(upto))
    dead = F.max((F.col("hazard") >= 1).cast("int")).over(upto) == 1
    return out.withColumn("survival", F.when(dead, 0.0).otherwise(F.coalesce(product, F.lit(1.0)))).withColumn("cumulative_hazard", F.sum("hazard").over(upto))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """An order-insensitive fingerprint: row count, exclusive or and sum of 60 bits of each row's SHA-256, taken over the
    row as JSON with its columns in order of name and nulls kept. Repeated rows cancel in the first but not in the sum."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    h = F.conv(F.substring(row, 1, 15), 16, 10).cast("long")
    return df.select(h.alias("h")).agg(F.count("*").alias("rows"), F.bit_xor("h").alias("xor"), F.sum(F.col("h").cast("decimal(20,0)")).cast("string").alias("sum"))
