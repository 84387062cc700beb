"""Forward paths in a stream: anchors wait in state until all their horizons are complete, and then leave it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from causaltape.functions.clock import NS_PER_MS, NS_PER_S
from causaltape.operators.paths import tick_paths
from causaltape.streaming.jobs import ROCKS, micros_of

OUTCOME = "struct<horizon:string,ticks:bigint,endpoint_return:double,signed_return:double,mfe:double,mae:double,mfe_offset_ms:bigint,mae_offset_ms:bigint,favorable_first:boolean,adverse_first:boolean,covered_ns:bigint,tie:boolean,realized_variance:double,path_efficiency:double,complete:boolean>"
TICK = np.dtype([("t", "<i8"), ("seq", "<i8"), ("mid", "<f8")])
HELD = np.dtype([("anchor_id", "<i8"), ("anchor_time", "<i8"), ("anchor_seq", "<i8"), ("anchor_mid", "<f8"), ("direction", "<i4")])
ANCHOR = ["anchor_id", "anchor_time", "anchor_seq", "anchor_mid", "direction"]


def outcome(anchor: tuple, ticks: np.ndarray, horizon: str, width: int, tape_end: int) -> dict:
    """What `forward_paths` has for one anchor and horizon, from the ticks of its key in order of time and sequence."""
    _, time, seq, mid, direction = anchor
    # the first tick after the anchor, and the first one past the horizon
    low = np.searchsorted(ticks["t"], time, "left")
    low += np.searchsorted(ticks["seq"][low : np.searchsorted(ticks["t"], time, "right")], seq, "right")
    high = np.searchsorted(ticks["t"], time + width, "right")
    t, price = ticks["t"][low:high], ticks["mid"][low:high]
    out = dict.fromkeys(("endpoint_return", "signed_return", "mfe", "mae", "mfe_offset_ms", "mae_offset_ms", "favorable_first", "adverse_first", "path_efficiency"))
    out |= {"horizon": horizon, "ticks": len(t), "covered_ns": 0, "tie": False, "realized_variance": 0.0, "complete": bool(tape_end >= time + width)}
    if not len(t):
        return out
    ret, off = np.log(price / mid), (t - time) // NS_PER_MS
    steps = np.log(price / np.concatenate(([mid], price[:-1])))
    signed = direction * ret
    best, worst = int(np.argmax(signed)), int(np.argmin(signed))
    up, down = (off[s][:1] for s in (signed > 0, signed < 0))
    seconds = t // NS_PER_S
    moved = np.add.reduceat(steps, np.flatnonzero(np.concatenate(([True], seconds[1:] != seconds[:-1]))))
    total = float(np.abs(steps).sum())
    return out | {
        "endpoint_return": float(ret[-1]), "signed_return": float(signed[-1]), "mfe": max(float(signed[best]), 0.0), "mae": max(float(-signed[worst]), 0.0),
        "mfe_offset_ms": int(off[best]), "mae_offset_ms": int(off[worst]), "favorable_first": bool(up[0] < down[0]) if len(up) and len(down) else None,
        "adverse_first": bool(down[0] < up[0]) if len(up) and len(down) else None, "covered_ns": width if out["complete"] else int(t[-1]) - time,
        "tie": bool((ret == 0).any()), "realized_variance": float((moved**2).sum()), "path_efficiency": float(ret[-1]) / total if total > 0 else None,
    }


def outcomes(anchors: list[tuple], ticks: np.ndarray, horizons: dict[str, int], tape_end: int) -> list[list[dict]]:
    """`outcome` of all anchors and horizons of a key, as whole columns (see `tick_paths`)."""
    time, number = (np.array([a[i] for a in anchors], np.int64) for i in (1, 2))
    own, direction = (np.array([a[i] for a in anchors], float) for i in (3, 4))
    with np.errstate(all="ignore"):
        found = tick_paths(time, number, own, direction, *(np.ascontiguousarray(ticks[c]) for c in ("t", "seq", "mid")), horizons, tape_end)
    rows = []
    for name, columns in found.items():
        shown = [[v if k else None for v, k in zip(values.tolist(), known.tolist(), strict=True)] for values, known in columns.values()]
        rows.append([{"horizon": name, **dict(zip(columns, row, strict=True))} for row in zip(*shown, strict=True)])
    return [list(each) for each in zip(*rows, strict=True)]


class PendingPaths(StatefulProcessor):
    """State of a key: its open anchors, the ticks since the oldest of them in blocks of time, the greatest tick time and
    the last time that an emitted path reaches to. A block is dropped once no open anchor can look into it."""

    schema = f"instrument long, anchor_id long, late_sequence long, emitted_ns long, drained boolean, outcomes array<{OUTCOME}>"

    def __init__(self, horizons: dict[str, int], patience_ns: int):
        self.horizons, self.patience = horizons, patience_ns
        self.longest = max(horizons.values())
        self.width = max(1, self.longest // 24)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "anchors binary")
        self.blocks = handle.getMapState("blocks", "block long", "ticks binary")
        self.clock = handle.getValueState("clock", "tape_end long, reached long, timer_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch[batch["mid"].notna()]
        if not len(batch):
            return
        tape_end, reached, timer = self.clock.get() if self.clock.exists() else (None, None, None)
        new = np.zeros(len(batch), TICK)
        new["t"], new["seq"], new["mid"] = (batch[c].to_numpy() for c in ("received_ts_ns", "source_sequence", "mid"))
        late = new[new["t"] <= reached] if reached is not None else new[:0]
        waiting = np.frombuffer(bytes(self.open.get()[0]), HELD).tolist() if self.open.exists() else []
        fresh = batch[batch["anchor_id"].notna()]
        added = list(zip(fresh["anchor_id"].astype("int64").tolist(), fresh["received_ts_ns"].tolist(), fresh["source_sequence"].tolist(), fresh["mid"].tolist(), fresh["direction"].astype("int64").tolist(), strict=True))
        tape_end = max(int(new["t"].max()), tape_end if tape_end is not None else int(new["t"].max()))
        waiting += added
        done = [a for a in waiting if a[1] + self.longest < tape_end]
        left = [a for a in waiting if a[1] + self.longest >= tape_end]
        paths = self.paths(done, new, tape_end)
        reached = max([a[1] + self.longest for a in done], default=reached)
        self.keep(left, new)
        if not left:
            self.open.clear()
        elif done or added:
            self.open.update((np.array(left, HELD).tobytes(),))
        end = max((a[1] for a in left), default=None)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = None if end is None else (end + self.longest + self.patience) // NS_PER_MS
        if timer is not None:
            self.handle.registerTimer(timer)
        self.clock.update((tape_end, reached, timer))
        yield self.frame(key, [(a, None, o) for a, o in paths] + [(None, int(s), None) for s in late["seq"]], tape_end, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tape_end, reached, _ = self.clock.get()
        waiting = np.frombuffer(bytes(self.open.get()[0]), HELD).tolist() if self.open.exists() else []
        paths = self.paths(waiting, np.zeros(0, TICK), tape_end)
        self.open.clear()
        self.blocks.clear()
        self.clock.update((tape_end, max([a[1] + self.longest for a in waiting], default=reached), None))
        yield self.frame(key, [(a, None, o) for a, o in paths], tape_end, True)

    def paths(self, anchors: list[tuple], new: np.ndarray, tape_end: int) -> list[tuple]:
        if not anchors:
            return []
        low, high = min(a[1] for a in anchors) // self.width, (max(a[1] for a in anchors) + self.longest) // self.width
        held = [np.frombuffer(self.blocks.getValue((b,))[0], TICK) for b in range(low, high + 1) if self.blocks.containsKey((b,))]
        ticks = np.sort(np.concatenate([*held, new]), order=["t", "seq"], kind="stable")
        return [(a[0], o) for a, o in zip(anchors, outcomes(anchors, ticks, self.horizons, tape_end), strict=True)]

    def keep(self, left: list[tuple], new: np.ndarray) -> None:
        """Adds the batch's ticks to their blocks and drops blocks that end before the oldest open anchor."""
        oldest = min((a[1] for a in left), default=None)
        if self.blocks.exists():
            for (block,) in list(self.blocks.keys()):
                if oldest is None or (block + 1) * self.width <= oldest:
                    self.blocks.removeKey((block,))
        if oldest is None:
            return
        number = new["t"] // self.width
        for block in np.unique(number[new["t"] >= oldest]).tolist():
            before = self.blocks.getValue((block,))[0] if self.blocks.containsKey((block,)) else b""
            self.blocks.updateValue((block,), (bytes(before) + new[number == block].tobytes(),))

    def frame(self, key: tuple, rows: list[tuple], now: int, drained: bool) -> pd.DataFrame:
        out = [(key[0], a, late, now, drained, o) for a, late, o in rows]
        frame = pd.DataFrame(out, columns=["instrument", "anchor_id", "late_sequence", "emitted_ns", "drained", "outcomes"])
        return frame.astype({"instrument": "Int64", "anchor_id": "Int64", "late_sequence": "Int64", "emitted_ns": "Int64", "drained": "bool"})

    def close(self) -> None:
        pass


def pending_paths(ticks: DataFrame, horizons: dict[str, int], late: str = "10 minutes", patience_ns: int = 365 * 86_400 * NS_PER_S) -> DataFrame:
    """One row per anchor, (instrument, anchor_id, emitted_ns, drained, outcomes), from a stream of ticks (instrument,
    received_ts_ns, source_sequence, mid, anchor_id, direction), where a tick with an anchor_id is an anchor itself.

    outcomes has an entry per horizon with what `forward_paths` has. An anchor leaves once a tick of its key lies past its
    longest horizon, whatever else the stream still brings; emitted_ns is that tick's time. An anchor whose key stays
    silent leaves when the watermark is `patience_ns` past its end, with drained set and the horizons not reached marked
    incomplete. Rows may come in any order inside the watermark's delay; a tick that comes after a path it belongs to has
    left is a row of its own, with its number in late_sequence. Ticks without a price and rows of a null key are left out."""
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    processor = PendingPaths(horizons, patience_ns)
    seen = ticks.select("instrument", "received_ts_ns", "source_sequence", F.when(F.col("instrument").isNotNull(), F.col("mid")).alias("mid"), "anchor_id", "direction", micros_of("received_ts_ns").alias("ts")).withWatermark("ts", late)
    return seen.groupBy("instrument").transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.schema, outputMode="Append", timeMode="EventTime")


class PendingWindows(StatefulProcessor):
    """State of a key: open anchors and the times of the rows that an open or a later anchor may count, both as arrays,
    the greatest time and the last time that a window which has left reaches to."""

    schema = "instrument long, anchor_id long, late_time long, n long, last_time long"

    def __init__(self, before_ns: int, after_ns: int, late_ns: int, patience_ns: int):
        self.before, self.after, self.late, self.patience = before_ns, after_ns, late_ns, patience_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "open binary, times binary, greatest long, reached long, timer_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch[batch["t"].notna()]
        if not len(batch):
            return
        time = batch["t"].to_numpy().astype(np.int64)
        asked, counted = batch["anchor_id"].notna().to_numpy(), batch["counts"].to_numpy().astype(bool)
        new = np.stack((batch["anchor_id"].to_numpy()[asked].astype(np.int64), time[asked]), axis=1)
        open_, times, greatest, reached, timer = self.state()
        late = time[counted & (time <= reached)] if reached is not None else time[:0]
        open_, times = np.concatenate((open_, new)), np.sort(np.concatenate((times, time[counted])))
        greatest = max(int(time.max()), greatest if greatest is not None else int(time.max()))
        done = open_[:, 1] + self.after + self.late < greatest
        frame = self.frame(key, open_[done], times, late)
        if done.any():
            end = int(open_[done, 1].max()) + self.after
            reached = end if reached is None else max(reached, end)
        open_ = open_[~done]
        # rows of an anchor that is still to come, which may be late itself, stay too
        oldest = min(int(open_[:, 1].min()) if len(open_) else greatest, greatest - self.late) - self.before
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = (int(open_[:, 1].max()) + self.after + self.late + self.patience) // NS_PER_MS if len(open_) else None
        if timer is not None:
            self.handle.registerTimer(timer)
        self.held.update((open_.tobytes(), times[np.searchsorted(times, oldest) :].tobytes(), greatest, reached, timer))
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        open_, times, greatest, reached, _ = self.state()
        end = max(int(open_[:, 1].max()) + self.after, reached if reached is not None else np.iinfo(np.int64).min) if len(open_) else reached
        self.held.update((b"", times.tobytes(), greatest, end, None))
        yield self.frame(key, open_, times, times[:0])

    def state(self) -> tuple:
        open_, times, *rest = self.held.get() if self.held.exists() else (b"", b"", None, None, None)
        return np.frombuffer(bytes(open_), np.int64).reshape(-1, 2), np.frombuffer(bytes(times), np.int64), *rest

    def frame(self, key: tuple, anchors: np.ndarray, times: np.ndarray, late: np.ndarray) -> pd.DataFrame:
        low, high = np.searchsorted(times, anchors[:, 1] - self.before, "left"), np.searchsorted(times, anchors[:, 1] + self.after, "right")
        last = times[np.maximum(high, 1) - 1] if len(times) else high
        kept = lambda values, fill: pd.array([*values.tolist(), *fill], "Int64")
        none, m = [None] * len(late), len(anchors)
        last = [v if k else None for v, k in zip(last.tolist(), (high > low).tolist(), strict=True)]
        return pd.DataFrame({
            "instrument": pd.array([key[0]] * (m + len(late)), "Int64"), "anchor_id": kept(anchors[:, 0], none), "late_time": pd.array([None] * m + late.tolist(), "Int64"), "n": kept(high - low, none), "last_time": pd.array([*last, *none], "Int64"),
        })

    def close(self) -> None:
        pass


def pending_windows(rows: DataFrame, before_ns: int, after_ns: int, late_ns: int = 600 * NS_PER_S, patience_ns: int = 365 * 86_400 * NS_PER_S) -> DataFrame:
    """One row per anchor, (instrument, anchor_id, n, last_time), from a stream of rows (instrument, t, anchor_id, counts):
    how many rows with `counts` of its key lie from before_ns before to after_ns after it, both ends included, and the
    time of the last. An anchor that counts itself is among them.

    No pairs are made. An anchor leaves once a row of its key lies `late_ns` past its window, or, if its key stays silent,
    once the watermark is `patience_ns` further. Rows may come in any order inside `late_ns`; a counted one that comes after
    a window it may belong to has left is a row of its own, with its time in late_time. Rows of a null key are left out."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    processor = PendingWindows(before_ns, after_ns, late_ns, patience_ns)
    timed = rows.select("instrument", F.when(F.col("instrument").isNotNull(), F.col("t")).alias("t"), "anchor_id", F.coalesce("counts", F.lit(False)).alias("counts"), micros_of("t").alias("ts"))
    timed = timed.withWatermark("ts", f"{late_ns // NS_PER_S} seconds")
    return timed.groupBy("instrument").transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.schema, outputMode="Append", timeMode="EventTime")
