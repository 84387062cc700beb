"""Scalar functions over prices, payloads and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The lifecycle states of a detector; any other label counts as OTHER.
STATES = ("IDLE", "DEVELOPING", "BURST", "DECAY_RISK", "DYING")

#: The payload of a detector's state at a tick.
PAYLOAD = """struct<drift_burst_state:struct<state:string,event_id:bigint,
  milestones:struct<weak:struct<ts_ms:bigint>,online:struct<ts_ms:bigint>>,
  emitted_events:array<struct<event_id:bigint,origin_ts:bigint,weak_ts:bigint,online_ts:bigint,strong_ts:bigint,decay_risk_ts:bigint,first_dying_ts:bigint,end_ts:bigint>>>>"""


def parse_payload(payload: Column) -> Column:
    """The typed payload; fields that are missing are null, and a malformed text gives null."""
    return F.from_json(payload, PAYLOAD.replace("\n", " "), {"mode": "PERMISSIVE"})


def state_label(label: Column) -> Column:
    upper = F.upper(F.trim(label))
    return F.when(upper.isin(*STATES), upper).when(label.isNotNull(), F.lit("OTHER"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def log_return(now: Column, before: Column) -> Column:
    return F.when((now > 0) & (before > 0), F.ln(now / before))


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two arrays of like length; null if their lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def content_hash(*columns: str | Column) -> Column:
    """SHA-256 of the columns as a JSON object, in the order given."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def valid_identity(name: Column) -> Column:
    """Not empty, no slash or backslash, no drive letter, no surrounding white space, not . or .."""
    return F.coalesce(name.rlike(r"^[^/\\\s]([^/\\]*[^/\\\s])?$") & ~name.rlike(r"^[A-Za-z]:") & ~name.isin(".", ".."), F.lit(False))


def identity(*parts: str | Column) -> Column:
    """Parts joined with colons, and a short prefix of their hash."""
    joined = F.concat_ws(":", *parts)
    return F.concat(joined, F.lit("#"), F.substring(F.sha2(joined, 256), 1, 12))


def z_score(x: Column, mean: Column, deviation: Column, floor: float = 1e-12) -> Column:
    return (x - mean) / F.greatest(deviation, F.lit(floor))


def direction_from(payload: Column, *paths: str) -> Column:
    """The sign of the first of several payload paths that holds a direction; +1 if none does."""
    texts = [F.upper(F.get_json_object(payload, p)) for p in paths]
    signs = [F.when(t.isin("UP", "LONG", "BUY", "BULL", "1"), F.lit(1)).when(t.isin("DOWN", "SHORT", "SELL", "BEAR", "-1"), F.lit(-1)) for t in texts]
    return F.coalesce(*signs, F.lit(1))
