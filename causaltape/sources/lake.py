"""Reading, checking and writing partitioned tables of ticks and bars."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from causaltape.functions.scalars import parse_payload


def shared(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir. Where that is unset, a local
    session (tests) takes a temporary one and a cluster is refused, as each executor would write to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local[*]").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-tables-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: its plan ends here, it is worked out once however
    often it is used, and a lost executor costs its running tasks alone."""
    path = shared(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan(spark: SparkSession, path: str, columns: list[str], schema: StructType | None = None) -> DataFrame:
    """Only the named columns; an unknown name is an error. Order of parts never matters: clocks give the order."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path).select(*columns)


def counted(df: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """`df` and an observation that holds its row count once an action has run over it."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows")), seen


def scan_counters(df: DataFrame, batch_rows: int = 65_536) -> DataFrame:
    """Per part of a plain scan: rows, batches of at most `batch_rows` rows, and bytes of the file."""
    parted = df.select(F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_size").alias("bytes"))
    counted = parted.groupBy("part").agg(F.count("*").alias("rows"), F.max("bytes").alias("bytes"))
    return counted.withColumn("batches", F.ceil(F.col("rows") / batch_rows).cast("long"))


def scan_report(df: DataFrame, batch_rows: int = 65_536) -> DataFrame:
    """One row: rows, batches, bytes and parts of a plain scan, and the seconds that reading it took."""
    began = time.monotonic()
    totals = scan_counters(df, batch_rows).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "batches", "bytes")], F.count("*").alias("parts"))
    return df.sparkSession.createDataFrame([(*totals.first(), time.monotonic() - began)], "rows long, batches long, bytes long, parts long, elapsed_s double")


def ordered_parts(df: DataFrame, part: str, order: list[str]) -> DataFrame:
    """Per part, in order of `part`: its rows, the rows of all parts before, and whether its first key comes after the
    last of all those before. What a part hands on is one row, so the windows run over parts and not over rows."""
    key = F.struct(*order)
    per = df.groupBy(part).agg(F.count("*").alias("rows"), F.min(key).alias("__first"), F.max(key).alias("__last"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    follows = F.coalesce(F.col("__first") > F.max("__last").over(before), F.lit(True))
    return per.select(part, "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), follows.alias("follows"))


def with_source(df: DataFrame) -> DataFrame:
    """Adds the part and the row inside it that each row comes from. `df` must be a plain scan."""
    return df.select("*", F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("row_index"))


def part_inventory(df: DataFrame, clocks: list[str]) -> DataFrame:
    """Per part: rows, bytes, and the least and greatest value of each clock."""
    every = [f(c).alias(f"{n}_{c}") for c in clocks for f, n in ((F.min, "min"), (F.max, "max"))]
    parted = df.select(*clocks, F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_size").alias("bytes"))
    return parted.groupBy("part").agg(F.count("*").alias("rows"), F.max("bytes").alias("bytes"), *every)


def manifest_check(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Declared against found parts (part, rows): each part with its status, missing and undeclared ones included."""
    both = manifest.select("part", F.col("rows").alias("declared")).join(actual.select("part", F.col("rows").alias("found")), "part", "full")
    status = F.when(F.col("found").isNull(), "MISSING").when(F.col("declared").isNull(), "UNDECLARED").when(F.col("declared") == F.col("found"), "OK").otherwise("ROW_COUNT_DIFFERS")
    return both.withColumn("status", status)


def schema_drift(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]]:
    """(path, difference) of each part whose schema is not that of the first, by names, types and nullability."""
    first, out = None, []
    for path in paths:
        schema = spark.read.parquet(path).schema
        if first is None:
            first = schema
        elif schema != first:
            out.append((path, f"{schema.simpleString()} is not {first.simpleString()}"))
    return out


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes to a path that must not exist yet."""
    df.write.mode("errorifexists").option("compression", "snappy" if kind == "parquet" else "none").format(kind).save(path)


def read_records(spark: SparkSession, path: str, schema: str, clock: str, cutoff: int) -> DataFrame:
    """JSON-lines records known before the cutoff."""
    return spark.read.schema(schema).json(path).where(F.col(clock) < cutoff)


def payload_counts(df: DataFrame, payload: str, by: list[str]) -> DataFrame:
    """Per group: rows, absent, malformed and parsed payloads."""
    state = parse_payload(F.col(payload)).getField("drift_burst_state")
    text = F.col(payload)
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(text.isNull()).alias("absent"), F.count_if(text.isNotNull() & state.isNull()).alias("malformed"), F.count_if(state.isNotNull()).alias("parsed"))
