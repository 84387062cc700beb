"""Append-only records in the shared folder: appends that may be tried again, and every version readable."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causaltape.operators.catalog import append_checked
from causaltape.sources.lake import cut


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")


def history(spark: SparkSession, path: str) -> list[dict]:
    """The versions of a ledger in order: version, batch, part (its folder), rows. Empty if there is no ledger."""
    fs, at = _files(spark, path)
    if not fs.exists(at("versions")):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(at("versions")))
    lines = spark.read.option("wholetext", True).text([f"{path}/versions/{n}" for n in names]).collect() if names else []
    return sorted((json.loads(line[0]) for line in lines), key=lambda v: v["version"])


def read(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The records of a version (the last by default), without what failed appends left behind."""
    parts = [v["part"] for v in history(spark, path) if (version is None or v["version"] <= version) and v["rows"]]
    reader = spark.read.schema(schema)
    return reader.parquet(*[f"{path}/{p}" for p in parts]) if parts else spark.createDataFrame([], schema)


def _publish(spark: SparkSession, path: str, entry: dict) -> None:
    """The version file appears under its name with its content: written aside, then renamed to a name that must be free."""
    fs, at = _files(spark, path)
    name, aside = at(f"versions/{entry['version']:012d}.json"), at(f"versions-pending/{entry['version']:012d}-{entry['batch']}.json")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(entry), "utf8"))
    out.close()
    fs.mkdirs(at("versions"))
    if fs.exists(name) or not fs.rename(aside, name):
        raise FileExistsError(f"version {entry['version']} of {path} was made by another writer")


def append(spark: SparkSession, path: str, new: DataFrame, record_id: str, rules: dict[str, Column], batch: str) -> DataFrame:
    """Appends the records of `new` that break no rule and repeat no id, and returns those rejected with `rejects`.

    Rows are written to a folder of the batch first and a version file last, made only if it isn't there: a reader
    never sees half an append. A batch that is already a version is not written again, and returns no rejects for what
    it holds itself, so a job killed anywhere can be run again. Of two writers that reach for the same version one fails with
    FileExistsError and changes nothing; it may try again. `new` is worked out once. Null ids are rejected as NULL_ID.
    Between writers at the very same moment this holds where the file system refuses to rename onto a file, as HDFS does. Batches
    are named by letters, digits, - and _. Runs jobs."""
    schema = new.schema.simpleString()[7:-1]
    past = history(spark, path)
    done = next((v for v in past if v["batch"] == batch), None)
    before = read(spark, path, new.schema, done["version"] - 1 if done else None)
    checked = append_checked(before, new.where(F.col(record_id).isNotNull()), record_id, rules)
    lost = new.where(F.col(record_id).isNull()).withColumn("rejects", F.array(F.lit("NULL_ID")))
    judged = cut(checked.unionByName(lost), "judged")
    if done is None:
        version = past[-1]["version"] + 1 if past else 1
        part = f"records/{version:012d}-{batch}"
        good = judged.where(F.size("rejects") == 0).select(*new.columns)
        good.write.mode("overwrite").parquet(f"{path}/{part}")
        rows = spark.read.schema(new.schema).parquet(f"{path}/{part}").count()
        _publish(spark, path, {"version": version, "batch": batch, "part": part, "rows": rows, "schema": schema})
    return judged.where(F.size("rejects") > 0)
