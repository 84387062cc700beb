"""Payload texts in two phases: a narrow struct of every row, the whole record of chosen rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field(record: Column, path: str, kind: str) -> Column:
    """One typed field of a VARIANT; null if it is missing or can't be read as `kind`."""
    return F.try_variant_get(record, path, kind)


def narrow(tape: DataFrame, payload: str, schema: str) -> DataFrame:
    """`tape` without its payload and with the fields of `schema` (a struct type), which alone are read from each text.

    Absent and malformed texts give null fields. A field that the tape has already takes the place of the old one. Other
    columns stay; an empty table gives an empty result."""
    parsed = F.from_json(payload, schema, {"mode": "PERMISSIVE"})
    return tape.withColumn("__p", parsed).select(*[c for c in tape.columns if c != payload], "__p").select("*", "__p.*").drop("__p")


def records(chosen: DataFrame, tape: DataFrame, keys: list[str], payload: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """`chosen` with fields {name: (path, type)} of the whole record of its row in `tape`, and `payload_state`.

    Texts are parsed to VARIANT after the join, so only those of chosen rows are; all fields come from one parse. The join
    is left to Spark: a small `chosen` is broadcast if its size allows, else both sides are exchanged by key, the tape with its
    keys and payload alone. payload_state is NO_ROW where the tape lacks the row, else ABSENT, MALFORMED or PARSED;
    fields are null in all but the last, and where the record lacks them. `keys` tell the tape's rows apart: a row that
    repeats there gives as many rows. Rows with a null key find nothing. Empty tables give an empty or unmatched result; a column of
    `chosen` called as a wanted field is replaced."""
    raw = tape.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(payload).alias("__payload"))
    test = F.lit(True)
    for i, k in enumerate(keys):
        test = test & (F.col(k) == F.col(f"__k{i}"))
    kept = chosen.drop("payload_state", *wanted)
    got = kept.join(raw, test, "left").withColumn("__record", F.try_parse_json("__payload"))
    state = F.when(F.col("__k0").isNull(), "NO_ROW").when(F.col("__payload").isNull(), "ABSENT").when(F.col("__record").isNull(), "MALFORMED").otherwise("PARSED")
    return got.select(*kept.columns, *[field(F.col("__record"), path, kind).alias(name) for name, (path, kind) in wanted.items()], state.alias("payload_state"))
