"""Null distributions of thousands of replicates whose exchanges don't grow with rows times replicates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causaltape.operators.statistics import draw, p_value, pearson
from causaltape.sources.lake import cut

#: Distinct values that one row of packed counts holds about, and numbers of a series that one part holds about.
VALUES, POSITIONS = 1 << 14, 1 << 18
#: The most rows of a block that numpy's hypergeometric draws allow.
LARGEST = 1_000_000_000


def one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, of which only one at a time stands in Python objects; arrays of numbers are numpy's."""
    for i in range(batch.num_rows):
        row = {}
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            kind = column.type
            if pa.types.is_list(kind) and pa.types.is_primitive(kind.value_type) and column[i].is_valid:
                # a null of a list of doubles becomes not a number
                row[name] = column[i].values.to_numpy(zero_copy_only=False)
            else:
                row[name] = column[i].as_py()
        yield row


def totals(df: DataFrame, columns: list[str], replicates: int, work) -> DataFrame:
    """Rows (rep, columns..): for each replicate the sum of what `work` gives for each row of `df`, an array (columns,
    replicates). A task adds its rows up first, so the exchange has one row a task and replicate."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for row in one_by_one(batch):
                got = work(row)
                held = got if held is None else held + got
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), *[pa.array(c) for c in held]], ["rep", *columns])

    return df.mapInArrow(of, ", ".join(["rep long", *[f"{c} double" for c in columns]])).groupBy("rep").agg(*[F.sum(c).alias(c) for c in columns])


def shares(counts: np.ndarray, taken: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """For each kind in turn how many of it are among `taken` rows drawn without replacement, a number a replicate."""
    rest, left = int(counts.sum()), taken.copy()
    for n in counts.tolist():
        got = rng.hypergeometric(n, rest - n, left) if rest > n else left.copy()
        yield got
        rest -= n
        left -= got


def block_permutation_null(values: DataFrame, block: str, group: str, value: str, replicates: int = 4999, seed: int = 0) -> DataFrame:
    """One row (observed, null_mean, null_sd, drawn_mean, drawn_sd, exceedances, draws, p_value): the difference of group
    means, treated less untreated, and how often labels shuffled inside blocks reach it in size.

    Shuffling labels makes the number of treated rows of each value in a block multivariate hypergeometric, so a block is
    reduced to counts of distinct values and drawn from those; rows never meet replicates. Blocks of many distinct values
    are cut into parts, among which their treated rows are drawn first. Draws depend on the seed, the block and the part
    alone. null_mean and null_sd are the exact ones over all shuffles. Rows with a null block, label or value take no part;
    one row of nulls and p-value 1 if a group is empty. A block may have up to 1e9 rows."""
    used = values.select(F.col(block).cast("string").alias("b"), F.col(group).alias("g"), F.col(value).cast("double").alias("v")).dropna()
    counted = cut(used.groupBy("b", "v").agg(F.count("*").alias("n"), F.count_if("g").alias("t")), "counts")
    n, v = F.col("n"), F.col("v")
    blocks = counted.groupBy("b").agg(F.sum("n").alias("rows"), F.sum("t").alias("treated"), F.sum(n * v).alias("s"), F.sum(n * v * v).alias("ss"), F.sum(F.col("t") * v).alias("st"), F.ceil(F.count("*") / VALUES).alias("parts"))
    blocks = cut(blocks, "blocks")
    rows, t, s = F.col("rows"), F.col("treated"), F.col("s")
    spread = F.when(rows > 1, t * (rows - t) / (rows - 1) * (F.col("ss") / rows - (s / rows) * (s / rows))).otherwise(0.0)
    known = blocks.agg(F.sum("treated").alias("n_t"), (F.sum("rows") - F.sum("treated")).alias("n_c"), F.sum("s").alias("s"), F.sum("st").alias("st"), F.sum(t * s / rows).alias("mean"), F.sum(spread).alias("variance"), F.max("rows").alias("largest")).first()
    if (known["largest"] or 0) > LARGEST:
        raise ValueError("a block has over 1e9 rows")
    if not known["n_t"] or not known["n_c"]:
        none = [F.lit(None).cast("double").alias(c) for c in ("observed", "null_mean", "null_sd", "drawn_mean", "drawn_sd")]
        return values.sparkSession.range(1).select(*none, F.lit(0).cast("long").alias("exceedances"), F.lit(replicates).alias("draws"), F.lit(1.0).alias("p_value"))
    scale, base = 1 / known["n_t"] + 1 / known["n_c"], known["s"] / known["n_c"]
    observed, mean, sd = known["st"] * scale - base, known["mean"] * scale - base, max(known["variance"], 0.0) ** 0.5 * scale

    parted = counted.join(blocks.select("b", "parts"), "b").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")))
    packed = cut(parted.groupBy("b", "part").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("v", "n"))).alias("kinds")), "packed")
    sizes = packed.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("part", "size"))).alias("sizes")).join(blocks.select("b", "treated"), "b")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many treated rows each part of a block has in each replicate."""
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array([p["size"] for p in row["sizes"]])
                rng = np.random.default_rng([seed, 1, *row["b"].encode()])
                for p, got in zip(row["sizes"], shares(counts, np.full(replicates, row["treated"]), rng), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([row["b"]]), pa.array([p["part"]], pa.int64()), pa.array([got.astype("<i8").tobytes()])], ["b", "part", "taken"])

    def treated_sum(row: dict) -> np.ndarray:
        rng = np.random.default_rng([seed, 2, row["part"], *row["b"].encode()])
        counts = np.array([k["n"] for k in row["kinds"]])
        out = np.zeros(replicates)
        for k, got in zip(row["kinds"], shares(counts, np.frombuffer(row["taken"], "<i8").copy(), rng), strict=True):
            out += k["v"] * got
        return out[None]

    ready = packed.join(sizes.mapInArrow(dealt, "b string, part long, taken binary"), ["b", "part"])
    sums = totals(ready, ["st"], replicates, treated_sum).select((F.col("st") * scale - base).alias("d"))
    # sums of one shuffle in another order differ in their last digits
    reach = F.abs("d") >= abs(observed) * (1 - 1e-12)
    out = sums.agg(F.avg("d").alias("drawn_mean"), F.stddev_pop("d").alias("drawn_sd"), F.count_if(reach).alias("exceedances"))
    return out.select(F.lit(observed).alias("observed"), F.lit(mean).alias("null_mean"), F.lit(sd).alias("null_sd"), "drawn_mean", "drawn_sd", "exceedances", F.lit(replicates).alias("draws"), p_value(F.col("exceedances"), replicates).alias("p_value"))


#: Sums over pairs, each with the powers of x and y in it.
SUMS = {"n": (0, 0), "sx": (1, 0), "sy": (0, 1), "sxx": (2, 0), "syy": (0, 2), "sxy": (1, 1)}
#: Rows that a task packs at once.
ROWS = 1 << 20


def smooth(n: int) -> int:
    """The least number from `n` on whose bits are all zero but the first four; its Fourier transforms are quick."""
    low = max(0, n.bit_length() - 4)
    return -(-n >> low) << low


def grid(size: int, block: int) -> tuple[int, int, int, int]:
    """Rows and columns of a table for twice `size` numbers, row by row; and how many of its columns, and how many rows, make
    a part of about `block` numbers."""
    columns = 1 if 2 * size <= block else smooth(math.isqrt(2 * size) + 1)
    rows = smooth(-(-2 * size // columns))
    return rows, columns, max(1, block // rows), max(1, block // columns)


def turning(gaps: int) -> list[tuple[int, int]]:
    """Those of SUMS that turning y can change, where bits of `gaps` say whether x (1) and y (2) have nulls."""
    return [(i, j) for i, j in SUMS.values() if (i or gaps & 1) and (j or gaps & 2)]


def series(gaps: int) -> list[tuple[int, int]]:
    """Side (0: x, 1: y) and power of the series that `turning` needs."""
    return sorted({(0, i) for i, _ in turning(gaps)} | {(1, j) for _, j in turning(gaps)})


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each part of a group, which stand one after the other."""
    rows = (row for batch in batches for row in one_by_one(batch))
    for _, of in groupby(rows, key=lambda row: (row["gid"], row["part"])):
        yield list(of)


def circular_shift_null(values: DataFrame, group: str, position: str, x: str, y: str, replicates: int = 4999, seed: int = 0) -> DataFrame:
    """One row (observed, exceedances, draws, p_value): the correlation of x and y, and how often it is reached in size
    when y turns by a random step inside groups.

    `position` counts from 0 in each group. The row at a position meets y of (position + shift) mod size, where the shift
    of a group and replicate is the stateless draw of (seed, replicate, group) mod size. All sums of all shifts come from one
    Fourier cross-correlation of each group, over twice its size so that nothing wraps. A group is a table, row by row: tasks transform some of its
    columns, are dealt anew to transform and multiply some of its rows, and once more to transform the columns back. So a number is
    exchanged three times however many shifts there are and however long a group is, and a task holds parts of about POSITIONS numbers of a
    series. Sums that no shift changes, as one side has no nulls, are plain totals. Null x or y leave their pairs out. Writes two small
    tables and one of the rows."""
    spark, block = values.sparkSession, POSITIONS
    values = cut(values.select(F.col(group).alias("g"), F.col(position).alias("p"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "positions")
    known = values.agg(F.avg("x").alias("mx"), F.avg("y").alias("my")).first()
    # shifts of origin leave a correlation as it is and keep its sums small
    centred = values.where("g is not null").select("g", F.col("p").cast("long").alias("p"), *[F.nanvl(F.col(c) - F.lit(known[f"m{c}"] or 0.0), F.lit(None).cast("double")).alias(c) for c in "xy"])
    totals_of = [f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("n", F.count), ("s", F.sum), ("ss", lambda c: F.sum(F.col(c) * F.col(c))))]
    groups = centred.groupBy("g").agg(F.count("*").alias("size"), *totals_of)
    turned = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: draw(seed, r, F.col("g")) % F.col("size"))
    gap = lambda c: F.col(f"n{c}") < F.col("size")
    gaps = (F.when(gap("x"), 1).otherwise(0) + F.when(gap("y"), 2).otherwise(0)).cast("long")
    groups = cut(groups.select("*", F.monotonically_increasing_id().alias("gid"), gaps.alias("gaps"), turned.alias("shifts")), "shifts")

    def fixed(i: int, j: int) -> Column:
        """What a group adds to a sum in every replicate: all of one side where the other has no nulls."""
        total = lambda c, power: F.col(("n", "s", "ss")[power] + c)
        whole = ([F.when(~gap("y"), total("x", i))] if not j else []) + ([F.when(~gap("x"), total("y", j))] if not i else [])
        return F.coalesce(*whole, F.lit(0)).cast("double")

    added = groups.agg(*[F.coalesce(F.sum(fixed(i, j)), F.lit(0.0)).alias(name) for name, (i, j) in SUMS.items()]).first()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a part of columns as one row a task, or a few."""
        names = ["gid", "size", "gaps", "p", "x", "y"]
        held: list = []

        def out() -> pa.RecordBatch:
            of = {c: np.concatenate([h[k] for h in held]) for k, c in enumerate(names)}
            held.clear()
            _, first, number = np.unique(of["gid"], return_index=True, return_inverse=True)
            _, columns, width, _ = np.array([grid(n, block) for n in of["size"][first].tolist()]).T
            part = of["p"] % columns[number] // width[number]
            order = np.lexsort((part, of["gid"]))
            ends = np.flatnonzero((np.diff(of["gid"][order]) != 0) | (np.diff(part[order]) != 0)) + 1
            runs = np.split(order, ends)
            heads = np.array([r[0] for r in runs])
            arrays = [of["gid"][heads], part[heads], of["size"][heads], of["gaps"][heads], *[[of[c][r].tobytes() for r in runs] for c in "pxy"]]
            return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["gid", "part", "size", "gaps", *"pxy"])

        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
                rows += batch.num_rows
            if rows >= ROWS:
                yield out()
                rows = 0
        if held:
            yield out()

    def told(row: dict, to: list[int], whence: int, data: list[np.ndarray]) -> pa.RecordBatch:
        some = {"gid": [row["gid"]] * len(to), "part": to, "size": [row["size"]] * len(to), "gaps": [row["gaps"]] * len(to), "whence": [whence] * len(to), "data": [d.tobytes() for d in data]}
        return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "data" else pa.int64()) for c, v in some.items()], list(some))

    def turn(rows: np.ndarray, columns: np.ndarray, size: int, sign: int) -> np.ndarray:
        """What a number of the table turns by between the transforms of columns and of rows; whole numbers keep it exact."""
        return np.exp(sign * 2j * np.pi * (rows[:, None] * columns[None, :] % size / size))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns of the series transformed, dealt to parts of rows. Those past the half mirror the others."""
        for of in by_part(batches):
            row = of[0]
            n1, n2, width, height = grid(row["size"], block)
            at = np.arange(row["part"] * width, min((row["part"] + 1) * width, n2))
            sides = np.full((2, n1, len(at)), np.nan)
            for some in of:
                p, *xy = (np.frombuffer(some[c], t) for c, t in (("p", "<i8"), ("x", "<f8"), ("y", "<f8")))
                sides[:, p // n2, p % n2 - at[0]] = xy
            here = ~np.isnan(sides)
            sides = np.where(here, sides, 0.0)
            spectra = np.fft.rfft(np.array([sides[s] ** i if i else here[s].astype(float) for s, i in series(row["gaps"])]), axis=1)
            spectra *= turn(np.arange(spectra.shape[1]), at, n1 * n2, -1)
            starts = range(0, spectra.shape[1], height)
            # a few at once
            for some in (starts[k : k + 16] for k in range(0, len(starts), 16)):
                yield told(row, [k // height for k in some], row["part"], [spectra[:, k : k + height] for k in some])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows transformed, multiplied and transformed back, dealt to parts of columns."""
        for of in by_part(batches):
            row, wanted = of[0], series(of[0]["gaps"])
            n1, n2, width, height = grid(row["size"], block)
            at = np.arange(row["part"] * height, min((row["part"] + 1) * height, n1 // 2 + 1))
            full = np.empty((len(wanted), len(at), n2), complex)
            for some in of:
                got = np.frombuffer(some["data"], complex).reshape(*full.shape[:2], -1)
                full[:, :, some["whence"] * width :][:, :, : got.shape[2]] = got
            full = dict(zip(wanted, np.fft.fft(full, axis=2), strict=True))
            back = np.fft.ifft(np.array([np.conj(full[0, i]) * full[1, j] for i, j in turning(row["gaps"])]), axis=2)
            back *= turn(at, np.arange(n2), n1 * n2, 1)
            starts = range(0, n2, width)
            for some in (starts[k : k + 16] for k in range(0, len(starts), 16)):
                yield told(row, [k // width for k in some], row["part"], [back[:, :, k : k + width] for k in some])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shifts of a group for each of its parts of columns."""
        for batch in batches:
            for row in one_by_one(batch):
                _, n2, width, _ = grid(row["size"], block)
                parts = list(range(-(-n2 // width)))
                shifts = np.asarray(row["shifts"], "<i8")
                for some in (parts[k : k + 16] for k in range(0, len(parts), 16)):
                    yield told(row, some, -1, [shifts] * len(some))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of each replicate over all parts of a task."""
        held = None
        for of in by_part(batches):
            row, wanted = of[0], turning(of[0]["gaps"])
            n1, n2, width, height = grid(row["size"], block)
            first = row["part"] * width
            full = np.empty((len(wanted), n1 // 2 + 1, min(width, n2 - first)), complex)
            for some in of:
                if some["whence"] < 0:
                    shifts = np.frombuffer(some["data"], "<i8")
                    continue
                got = np.frombuffer(some["data"], complex).reshape(len(wanted), -1, full.shape[2])
                full[:, some["whence"] * height :][:, : got.shape[1]] = got
            sums = np.fft.irfft(full, n1, axis=1)
            held = np.zeros((len(SUMS), replicates)) if held is None else held
            names = list(SUMS.values())
            # a row meets y further on, or y from the start once it is past the end
            for lag in (shifts, n1 * n2 + shifts - row["size"]):
                column = lag % n2 - first
                some = np.flatnonzero((column >= 0) & (column < full.shape[2]))
                for k, name in enumerate(wanted):
                    held[names.index(name), some] += sums[k, lag[some] // n2, column[some]]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), *[pa.array(c) for c in held]], ["rep", *SUMS])

    def of_sums() -> Column:
        n, sx, sy, sxx, syy, sxy = (F.col(c) for c in SUMS)
        below = (n * sxx - sx * sx) * (n * syy - sy * sy)
        return F.when(below > 0, (n * sxy - sx * sy) / F.sqrt(below))

    # a row is part of a table; a task gets few of them at once
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    ids, piece = "gid long, part long, size long, gaps long", "whence long, data binary"
    dealt = lambda df: df.repartition("gid", "part").sortWithinPartitions("gid", "part")
    rows = centred.join(groups.select("g", "gid", "size", "gaps"), "g").select("gid", "size", "gaps", "p", "x", "y")
    parts = rows.mapInArrow(packed, f"{ids}, p binary, x binary, y binary")
    there = dealt(parts).mapInArrow(forward, f"{ids}, {piece}")
    back = dealt(there).mapInArrow(across, f"{ids}, {piece}")
    back = back.unionByName(groups.select("gid", "size", "gaps", "shifts").mapInArrow(asked, f"{ids}, {piece}"))
    each = dealt(back).mapInArrow(summed, ", ".join(["rep long", *[f"{c} double" for c in SUMS]]))
    nulls = each.groupBy("rep").agg(*[(F.sum(c) + F.lit(added[c])).alias(c) for c in SUMS])
    r = nulls.select(of_sums().alias("r"))
    observed = values.where("g is not null").agg(pearson(F.col("x"), F.col("y")).alias("observed"))
    out = r.crossJoin(F.broadcast(observed)).agg(F.first("observed").alias("observed"), F.count_if(F.abs("r") >= F.abs("observed") * (1 - 1e-9)).alias("exceedances"))
    return out.select("observed", "exceedances", F.lit(replicates).alias("draws"), p_value(F.col("exceedances"), replicates).alias("p_value"))


#: Groups whose sums a task holds at once.
GROUPS = 256


def sign_flip_means(values: DataFrame, group: str, row_id: str, value: str, worlds: int, seed: int = 0) -> DataFrame:
    """Rows (group, w, stat): the mean of the values of each group in each world, where a row changes its sign if bit w % 32
    of the draw of (seed, w div 32, row) is set.

    Rows never meet worlds as rows: a task draws the bits of a few rows at once (as `draw` does), multiplies the values of a
    group with them and hands on one row of sums a group. Null values have no part; a group without values has null."""
    starts = [f"{seed}:{c}".encode() for c in range(-(-worlds // 32))]
    # hashing is the work, so few or uneven parts of the input are dealt anew
    dealt = values.select(group, value, row_id).repartition(4 * values.sparkSession.sparkContext.defaultParallelism)
    ready = dealt.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"), F.coalesce(F.concat(F.lit(":"), F.col(row_id).cast("string")), F.lit("")).cast("binary").alias("key"))
    kind = ready.schema["g"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            arrays = [pa.array(list(held), key), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([s for _, s in held.values()], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(arrays, ["g", "n", "sums"])

        for batch in batches:
            key = batch.schema.field("g").type
            groups = batch.column("g").dictionary_encode()
            number = groups.indices.fill_null(len(groups.dictionary)).to_numpy()
            names = [*groups.dictionary.to_pylist(), None]
            v = batch.column("v").fill_null(0.0).to_numpy()
            known = batch.column("v").is_valid().to_numpy(zero_copy_only=False)
            texts = batch.column("key").to_pylist()
            for i in np.unique(number).tolist():
                at = np.flatnonzero(number == i)
                n, sums = held.pop(names[i], (0, np.zeros(worlds)))
                for some in np.split(at, range(1024, len(at), 1024)):
                    heads = b"".join([md5(start + texts[k]).digest()[:4] for k in some.tolist() for start in starts])
                    words = np.frombuffer(heads, ">u4").reshape(len(some), -1)
                    bits = np.unpackbits(words.astype("<u4").view(np.uint8), axis=1, bitorder="little")[:, :worlds]
                    sums = sums + v[some].sum() - 2 * (v[some] @ bits.astype(float))
                held[names[i]] = (n + int(known[at].sum()), sums)
                if len(held) == GROUPS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    parts = ready.mapInArrow(of, f"g {kind}, n long, sums array<double>")
    each = parts.select("g", "n", F.posexplode("sums").alias("w", "s")).groupBy("g", "w").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return each.select(F.col("g").alias(group), "w", F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("stat"))
