"""Part inventories from Parquet footers, read in tasks and without scanning rows."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _footers(clocks: list[str]):
    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                system, inner = fs.FileSystem.from_uri(path)
                with system.open_input_file(unquote(inner) if path.startswith("file:") else inner) as source:
                    size, meta = source.size(), pq.read_metadata(source)
                for group in range(meta.num_row_groups):
                    row = {"path": path, "bytes": size, "row_group": group, "rows": meta.row_group(group).num_rows}
                    columns = {meta.row_group(group).column(i).path_in_schema: meta.row_group(group).column(i) for i in range(meta.num_columns)}
                    for clock in clocks:
                        seen = columns[clock].statistics if clock in columns else None
                        has = seen is not None and seen.has_min_max
                        nulls = seen.null_count if seen is not None and seen.has_null_count else None
                        least, most = (seen.min_raw, seen.max_raw) if has else (None, None)
                        row |= {f"min_{clock}": least, f"max_{clock}": most, f"nulls_{clock}": nulls, f"known_{clock}": has or nulls == row["rows"]}
                    out.append(row)
                if meta.num_row_groups == 0:
                    out.append({"path": path, "bytes": size, "row_group": None, "rows": 0} | {f"{k}_{c}": v for c in clocks for k, v in (("min", None), ("max", None), ("nulls", 0), ("known", True))})
            types = {"path": pa.string(), "bytes": pa.int64(), "row_group": pa.int64(), "rows": pa.int64()} | {f"{k}_{c}": t for c in clocks for k, t in (("min", pa.int64()), ("max", pa.int64()), ("nulls", pa.int64()), ("known", pa.bool_()))}
            yield pa.RecordBatch.from_pylist(out, pa.schema(list(types.items())))

    return read


def row_groups(spark: SparkSession, path: str, clocks: list[str]) -> DataFrame:
    """A row per row group of the Parquet files under `path`: path, bytes of the file, row_group, rows, and for each clock
    min_, max_, nulls_ and known_ (whether the footer tells them). A file without row groups has one row with a null
    row_group. Clocks are columns stored as whole numbers (timestamps in their file's unit); one that a file lacks is not known.

    Spark lists the files; tasks open footers only, a few files a task, so no row is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    fields = ", ".join(f"`min_{c}` long, `max_{c}` long, `nulls_{c}` long, `known_{c}` boolean" for c in clocks)
    return found.select("path").mapInArrow(_footers(clocks), "path string, bytes long, row_group long, rows long" + (f", {fields}" if fields else ""))


def footer_inventory(spark: SparkSession, path: str, clocks: list[str]) -> DataFrame:
    """Per part: rows, row_groups, bytes, and each clock's least and greatest value; known_<clock> is false, and both are
    null, where a row group's footer does not tell them, so that a scan has to."""
    groups = row_groups(spark, path, clocks)
    each = []
    for c in clocks:
        known = F.bool_and(f"known_{c}")
        each += [F.when(known, F.min(f"min_{c}")).alias(f"min_{c}"), F.when(known, F.max(f"max_{c}")).alias(f"max_{c}"), known.alias(f"known_{c}")]
    part = F.element_at(F.split("path", "/"), -1).alias("part")
    return groups.groupBy("path", part).agg(F.sum("rows").alias("rows"), F.count("row_group").alias("row_groups"), F.max("bytes").alias("bytes"), *each)
