"""Document fingerprints by weighted SimHash, and their search with permuted block tables. DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causaltape.llm.shared import cut, drop_table, positions

#: Bits of a fingerprint: two 64-bit words, one for each hash seed.
SEEDS = (11, 23)
BITS = 64 * len(SEEDS)
#: Four 16-bit counters of a long and two 32-bit ones; the heaviest weight of a term; terms that 16-bit counters hold.
FOURS, TWOS = 0x0001000100010001, 0x0000FFFF0000FFFF
HEAVIEST, PART = 15, 2048


def words(text: Column) -> Column:
    """Runs of anything but white space, lower-cased."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def votes(docs: DataFrame, key: str, text: Column, carried: list[str]) -> DataFrame:
    """Rows (key, carried.., fp0, fp1): the SimHash of each text.

    A term is a word and the word after it (nothing after the last). Each occurrence votes on every bit, with as many
    votes as the term has letters, HEAVIEST at most, for or against as its hash has the bit set or not. The votes of four
    bits are summed in one long, PART terms together, by partial aggregates where the text is read; only texts of more
    terms have their parts summed once more. Texts without terms have fingerprint zero. `key` must tell rows apart. Writes
    a table in the shared folder."""
    split = docs.select(key, *carried, words(text).alias("words"))
    paired = split.select(key, *carried, F.size("words").alias("n"), F.posexplode_outer(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, 1 << 30).alias("b"))).alias("nth", "term"))
    weight = F.least(F.coalesce(F.length("term.a"), F.lit(0)) + F.coalesce(F.length("term.b"), F.lit(0)), F.lit(HEAVIEST)).cast("long")
    first = F.xxhash64(F.lit(SEEDS[0]), "term.a", "term.b")
    hashed = paired.select(key, *carried, F.coalesce(F.col("n") > PART, F.lit(False)).alias("long"), F.coalesce(F.floor(F.col("nth") / PART), F.lit(0)).alias("part"), weight.alias("w"), first.alias("h0"))
    hashed = hashed.select("*", F.xxhash64(F.lit(SEEDS[1]), "h0").alias("h1"))
    sums = [F.sum(F.shiftrightunsigned(f"h{i}", j).bitwiseAND(F.lit(FOURS)) * F.col("w")).alias(f"s{i}_{j}") for i in range(len(SEEDS)) for j in range(16)]
    counted = hashed.groupBy(key, *carried, "long", "part").agg(F.sum("w").alias("w"), *sums)
    # votes for bits j and j + 32, and j + 16 and j + 48
    wide = {f"t{i}_{j + up}": F.shiftrightunsigned(f"s{i}_{j}", up).bitwiseAND(F.lit(TWOS)) for i in range(len(SEEDS)) for j in range(16) for up in (0, 16)}
    unpacked = counted.select(key, *carried, "long", "w", *[c.alias(n) for n, c in wide.items()])
    fp = [F.when(~F.col("long"), majority(i)).alias(f"fp{i}") for i in range(len(SEEDS))]
    kept = cut(unpacked.select(key, *carried, "long", *fp, *[F.when(F.col("long"), F.col(n)).alias(n) for n in ("w", *wide)]), "votes")
    summed = kept.where("long").groupBy(key, *carried).agg(*[F.sum(n).alias(n) for n in ("w", *wide)])
    short = kept.where("not long").select(key, *carried, *[f"fp{i}" for i in range(len(SEEDS))])
    return short.unionByName(summed.select(key, *carried, *[majority(i).alias(f"fp{i}") for i in range(len(SEEDS))]))


def majority(i: int) -> Column:
    """Word i of the fingerprint: the bits that got more than half of all votes."""
    word = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"t{i}_{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"t{i}_{j}", 32)
        for count, bit in ((low, j), (high, j + 32)):
            word = word.bitwiseOR(F.when(2 * count > F.col("w"), F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    return word


def distance(a: list[Column], b: list[Column]) -> Column:
    """Differing bits of two fingerprints."""
    differ = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)]
    return sum(differ[1:], differ[0])


def likeness(a: list[Column], b: list[Column]) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - distance(a, b) / F.lit(float(BITS))


def hex_of(words: list[Column]) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(w)), 16, "0") for w in words])


def block_masks(radius: int, blocks: int) -> list[tuple[int, ...]]:
    """Masks, as signed words, of all sets of blocks - radius blocks of neighbouring bits: fingerprints that differ in at
    most `radius` bits agree in all bits of one of them, as no more than `radius` blocks hold a differing bit."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("the radius must be at least 0 and below the number of blocks")
    of = [b * blocks // BITS for b in range(BITS)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        bits = [b for b in range(BITS) if of[b] in chosen]
        words = [sum(1 << b % 64 for b in bits if b // 64 == i) for i in range(len(SEEDS))]
        masks.append(tuple(w - (1 << 64) if w >> 63 else w for w in words))
    return masks


def within_radius(queries: DataFrame, points: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """Rows (q0, q1, fp0, fp1, distance): every distinct fingerprint of `points` within `radius` bits of one of `queries`.

    Each table permutes its chosen blocks to the front and drops the others; queries and points that agree there are
    candidates, checked by their distance, and a pair is returned by the first table that it shares. Both sides are
    reduced to distinct fingerprints first, so a group of copies is one row. Nulls match nothing."""
    masks = block_masks(radius, blocks)
    names = [f"fp{i}" for i in range(len(SEEDS))]
    tables = F.array(*[F.struct(F.lit(t).alias("t"), *[F.col(n).bitwiseAND(F.lit(w)).alias(f"m{i}") for i, (n, w) in enumerate(zip(names, m, strict=True))]) for t, m in enumerate(masks)])
    dealt = lambda df: df.select(*names).dropna().distinct().select(*names, F.inline(tables))
    keys = ["t", *[f"m{i}" for i in range(len(SEEDS))]]
    asked = dealt(queries).withColumnsRenamed({n: f"q{i}" for i, n in enumerate(names)})
    q, p = [F.col(f"q{i}") for i in range(len(SEEDS))], [F.col(n) for n in names]
    agree = [sum((F.when(x.bitwiseXOR(y).bitwiseAND(F.lit(w)) == 0, 0).otherwise(1) for x, y, w in zip(q, p, m, strict=True)), F.lit(0)) == 0 for m in masks]
    first = F.coalesce(*[F.when(a, F.lit(t)) for t, a in enumerate(agree)])
    found = asked.join(dealt(points), keys).where((distance(q, p) <= radius) & (F.col("t") == first))
    return found.select(*[f"q{i}" for i in range(len(SEEDS))], *names, distance(q, p).alias("distance"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_chars, fp0, fp1, edited_sha256, edited0, edited1, near_edited, near_next), one per input row.

    Documents stand in descending order of their id, rows of one id by a digest, those with a null id last; the next of
    the last is the first, and a single document is next to itself. The edited text is the document's with its last
    floor(n_chars / 2) code points replaced by as many first ones of the next document (all, if it has fewer). near_edited
    and near_next are the likeness of the document's fingerprint to those of the edited text and of the next document.

    Rows with equal id and text are one document and return equal rows. Null text counts as empty; texts without words
    have fingerprint zero; an empty table gives an empty result; other columns are ignored. The order is found on ids and
    digests alone; whole texts are exchanged once to learn who needs their beginning, and halves once to meet. Writes
    tables in the shared folder and runs jobs when it is built."""
    fp = [f"fp{i}" for i in range(len(SEEDS))]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), text).cast("binary"), 256))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("key"), text.alias("text"))
    rows = own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", F.length("text").cast("long").alias("n_chars"), "text")
    prints = cut(votes(rows, "row", F.col("text"), ["doc_id", "key", "n_chars"]), "prints")
    distinct = cut(prints.groupBy("key").agg(*[F.any_value(c).alias(c) for c in ("doc_id", "n_chars", *fp)]).withColumn("all", F.lit(0)), "documents")
    ranked = cut(positions(distinct, "all", [F.col("doc_id").desc_nulls_last(), F.col("key")]), "ranked")
    before = ranked.select(F.pmod(F.col("position") + 1, F.col("size")).alias("position"), F.col("n_chars").alias("n_before"))
    after = ranked.select(F.pmod(F.col("position") - 1, F.col("size")).alias("position"), *[F.col(c).alias(f"next_{c}") for c in fp])
    links = cut(ranked.join(before, "position").join(after, "position"), "links")
    known = own.select("key", "text").join(links.select("key", "position", "size", "n_chars", "n_before"), "key")
    half = lambda n: F.floor(F.col(n) / 2).cast("int")
    head = F.struct(F.col("position").alias("at"), F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half("n_chars")).alias("head"), F.lit(None).cast("string").alias("tail"))
    tail = F.struct(F.pmod(F.col("position") - 1, F.col("size")).alias("at"), F.lit(None).cast("string").alias("head"), F.substr("text", F.lit(1), half("n_before")).alias("tail"))
    pieces = known.select(F.inline(F.array(head, tail))).groupBy("at").agg(F.max("head").alias("head"), F.max("tail").alias("tail"))
    edited = pieces.select("at", F.concat("head", "tail").alias("text")).select("at", F.sha2(F.col("text").cast("binary"), 256).alias("edited_sha256"), "text")
    voted = votes(edited, "at", F.col("text"), ["edited_sha256"]).select(F.col("at").alias("position"), "edited_sha256", *[F.col(c).alias(f"edited{i}") for i, c in enumerate(fp)])
    a = [F.col(c) for c in fp]
    near = links.join(voted, "position").select("key", "edited_sha256", "edited0", "edited1", likeness(a, [F.col("edited0"), F.col("edited1")]).alias("near_edited"), likeness(a, [F.col(f"next_{c}") for c in fp]).alias("near_next"))
    near = cut(near, "near")
    for done in (distinct, ranked, links):
        drop_table(done)
    return prints.join(near, "key").select("doc_id", "n_chars", *fp, "edited_sha256", "edited0", "edited1", "near_edited", "near_next")
