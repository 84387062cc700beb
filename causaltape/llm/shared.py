"""Shared folder, table reading and byte-level word helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causaltape.operators.asof import carry_sum

#: Odd multiplier of the rolling window hash and the two multipliers of its finalizer.
ROLL, MIX1, MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def bounded(df: DataFrame) -> DataFrame:
    """`df`, once the session hands Python workers batches of 8 MB and not of up to 64, so that long texts in a batch
    of many rows don't add up. The setting stays for the session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (tests)
    takes a new one and a cluster is refused, as each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local[*]").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Where the tables that `cut` wrote lie, while they are in use.
WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it back: lineage ends here, and a lost executor costs
    nothing but its running tasks. Reading back also forgets the partitioning, so that a later join on a hot key
    exchanges both sides and adaptive execution can split it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    WRITTEN[back] = path
    return back


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table that `cut` wrote, once nothing reads it any more. A session without access to
    Hadoop's file system leaves them for whoever clears the shared folder."""
    spark, path = df.sparkSession, WRITTEN.pop(df, None)
    if path and hasattr(spark, "_jvm"):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Rows of one range of `positions`, and ranges whose counts are summed in one task.
RANGE, RANGES = 1 << 15, 1024


def positions(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """`df`, a table that `cut` wrote, with `position`, the place of each row in its group from 0 in the given order, and
    `size`, the group's number of rows. The group column must hold no null and the order must be total.

    Rows are dealt to sorted ranges of about RANGE rows, so that a group of any size spreads over tasks; beyond that only
    one count per range and group is summed, in two levels. Runs a job and writes two tables in the shared folder."""
    parts = max(1, -(-df.count() // RANGE))
    ranged = df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    placed = cut(ranged.withColumn("__place", F.monotonically_increasing_id()), "placed").withColumn("__part", F.shiftright("__place", 33))
    runs = cut(placed.groupBy(group, "__part").agg(F.min("__place").alias("__first"), F.count("*").alias("__n")), "runs")
    ends = carry_sum(runs.withColumn("__bucket", F.floor(F.col("__part") / RANGES)), [group], [F.col("__part")], F.col("__n"), "__bucket", "__end")
    sizes = runs.groupBy(group).agg(F.sum("__n").alias("size"))
    starts = ends.join(sizes, group).select(group, "__part", (F.col("__end") - F.col("__n") - F.col("__first")).alias("__shift"), "size")
    return placed.join(starts, [group, "__part"]).withColumn("position", F.col("__place") + F.col("__shift")).drop("__place", "__part", "__shift")


def threshold(rows: int, most: int) -> int | None:
    """The signed 64-bit number that about `most` of `rows` 64-bit hashes lie below; None if all may stay."""
    return None if rows <= most else (most << 64) // rows - (1 << 63)


def drawn(rows: int, most: int, seed: int, *key: str | Column) -> Column:
    """Whether a row is in a sample of about `most` of so many rows: by a full-width hash of its key, so that the sample
    doesn't depend on partitioning and is never empty for want of digits. Rows of equal keys stay or go together."""
    below = threshold(rows, most)
    return F.lit(True) if below is None else F.xxhash64(F.lit(seed), *key) < F.lit(below)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive word hashes."""
    n = max(0, len(hashes) - k + 1)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = acc * ROLL + hashes[j : j + n]
    acc ^= acc >> np.uint64(30)
    acc *= MIX1
    acc ^= acc >> np.uint64(27)
    acc *= MIX2
    return acc ^ (acc >> np.uint64(31))
