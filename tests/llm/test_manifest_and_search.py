"""Fingerprints, Merkle manifest and hard negatives against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from causaltape.llm import fingerprints, hard_negatives, merkle, queries, shared

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, position long, text_ string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_print(text):
    """SimHash over pairs of neighbouring words, as the docstring of `votes` states it."""
    words = [w for w in (text or "").lower().split() if w]
    votes = np.zeros(128, np.int64)
    for a, b in zip(words, [*words[1:], None][: len(words)], strict=True):
        w = min(len(a) + len(b or ""), 15)
        h0 = spark_hash(11, a, b)
        h1 = spark_hash(23, h0)
        bits = np.array([h0 >> i & 1 for i in range(64)] + [h1 >> i & 1 for i in range(64)])
        votes += w * (2 * bits - 1)
    return [signed(sum(1 << i for i in range(64) if votes[64 * k + i] > 0)) for k in range(2)]


def spark_hash(*values):
    """xxhash64 of Spark: each column is hashed with the hash so far as seed, 42 at first; nulls leave it as it is."""
    h = 42
    for v in values:
        if isinstance(v, str):
            h = xxhash.xxh64_intdigest(v.encode(), h)
        elif v is not None:
            h = xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little") if v > 1 << 31 or v < 0 else v.to_bytes(4, "little"), h)
    return h


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(5, "a b c d e f g h", "en", "s", 15), (4, None, None, None, None), (3, "", "en", "s", 0), (2, "ünï çödé \n wörds 𝄞 here", "fr", None, 22), (2, "other text of one id", "fr", "t", 20), (1, "one", "en", "s", 3), (1, "one", "en", "s", 3), (None, "no id\nat all", "en", "t", 9), (0, " ".join(f"w{i % 97}" for i in range(5000)), "en", "s", 20000)]
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], DOCS)


def test_fingerprints_equal_a_plain_simhash(spark, odd):
    rows = odd.where("doc_id is not null").select(F.monotonically_increasing_id().alias("id"), "text")
    got = fingerprints.votes(rows, "id", F.col("text"), ["text"]).collect()
    assert len(got) == 8
    for r in got:
        assert [r["fp0"], r["fp1"]] == plain_print(r["text"]), r["text"]


def test_edited_texts_and_likeness(spark, odd):
    got = fingerprints.edited_likeness(odd).collect()
    assert len(got) == 9
    seen = {(r["doc_id"], r["text"] or "") for r in odd.collect()}
    digest = lambda d: hashlib.sha256(f"{'-' if d[0] is None else d[0]}:{d[1]}".encode()).digest()
    order = sorted(seen, key=lambda d: (d[0] is None, -(d[0] or 0), digest(d)))
    want = {}
    for d, n in zip(order, [*order[1:], order[0]], strict=True):
        half = len(d[1]) // 2
        edited = d[1][: len(d[1]) - half] + n[1][:half]
        near = lambda a, b: 1 - sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(plain_print(a), plain_print(b), strict=True)) / 128
        want.setdefault(d[0], []).append((len(d[1]), hashlib.sha256(edited.encode()).hexdigest(), near(d[1], edited), near(d[1], n[1])))
    for r in got:
        assert (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) in want[r["doc_id"]]
    assert fingerprints.edited_likeness(odd.where("false")).count() == 0
    alone = fingerprints.edited_likeness(odd.where("doc_id = 5")).first()
    assert alone["near_next"] == 1 and alone["edited_sha256"] == hashlib.sha256(b"a b c d a b c d"[:8] + b"a b c d"[:7]).hexdigest()


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(3)
    base = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(30)]
    points = set(base)
    for a, b in base:
        for _ in range(8):
            flips = rng.sample(range(128), rng.randint(1, 6))
            m = sum(1 << f for f in flips)
            points.add((a ^ (m & (1 << 64) - 1), b ^ (m >> 64)))
    points = sorted(points)
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in points] * 2 + [(None, 1)], "fp0 long, fp1 long")
    asked = spark.createDataFrame([(signed(a), signed(b)) for a, b in base], "fp0 long, fp1 long")
    for radius, blocks in ((3, 5), (0, 2), (4, 6)):
        got = sorted(tuple(r) for r in fingerprints.within_radius(asked, df, radius, blocks).collect())
        far = lambda p, q: (p[0] ^ q[0]).bit_count() + (p[1] ^ q[1]).bit_count()
        want = sorted((signed(q[0]), signed(q[1]), signed(p[0]), signed(p[1]), far(p, q)) for q in base for p in points if far(p, q) <= radius)
        assert got == want
    with pytest.raises(ValueError):
        fingerprints.block_masks(5, 5)


def plain_tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([hashlib.sha256("".join(levels[-1][i : i + arity]).encode()).hexdigest() for i in range(0, len(levels[-1]), arity)])
    return levels


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_multiproofs_of_any_leaves_are_minimal_and_lead_to_the_root(arity):
    rng = random.Random(arity)
    for size in (1, 2, 3, 4, 9, 10, 28, 100):
        levels = plain_tree([hashlib.sha256(str(i).encode()).hexdigest() for i in range(size)], arity)
        for _ in range(5):
            known = sorted(rng.sample(range(size), rng.randint(1, size)))
            need = merkle.missing(np.array(known), size, arity)
            # a node is needed if it is off every known path and its parent is on one
            paths = {(n, i // arity**n) for i in known for n in range(len(levels))}
            want = {(n, i) for n, row in enumerate(levels[:-1]) for i in range(len(row)) if (n, i) not in paths and (n + 1, i // arity) in paths}
            assert set(need) == want and len(need) == len(want)
            got = merkle.proofs({i: levels[0][i] for i in known}, size, {(n, i): levels[n][i] for n, i in need}, arity)
            for i in known:
                h = levels[0][i]
                for left, right in got[i]:
                    h = hashlib.sha256((left + h + right).encode()).hexdigest()
                assert h == levels[-1][0] and len(got[i]) == len(levels) - 1


def plain_leaf(row):
    out = ""
    for v in row:
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return hashlib.sha256(out.encode()).hexdigest()


@pytest.mark.parametrize(("arity", "leaves"), [(3, 2187), (3, 9), (2, 4)])
def test_manifest_equals_plain_trees(spark, odd, monkeypatch, arity, leaves):
    monkeypatch.setattr(merkle, "LEAVES", leaves)
    monkeypatch.setattr(shared, "RANGE", 16)
    more = spark.range(60).select((F.col("id") + 10).alias("doc_id"), F.lit("x\ny").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(3).cast("long").alias("n_chars"), F.lit("x").alias("key"), F.lit(7).cast("long").alias("position"), F.lit("y").alias("text_"))
    docs = odd.unionByName(more)
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.manifest(docs, fields, changed=changed, arity=arity).withColumn("folded", merkle.fold(F.col("seen"), F.col("proof"))).collect()
    groups = {}
    for r in docs.collect():
        groups.setdefault(r["source"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0), plain_leaf([r[f] for f in fields]), r))
    trees = {g: plain_tree([leaf for _, leaf, _ in sorted(rows, key=lambda x: x[:2])], arity) for g, rows in groups.items()}
    names = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    root = plain_tree([trees[g][-1][0] for g in names], arity)[-1][0]
    want = sorted((str(r["doc_id"]), leaf, trees[g][-1][0]) for g, rows in groups.items() for _, leaf, r in rows)
    assert sorted((str(r["id"]), r["leaf"], r["subroot"]) for r in got) == want and {r["root"] for r in got} == {root}
    for r in got:
        h = r["leaf"]
        for s in r["proof"]:
            h = hashlib.sha256((s["left"] + h + s["right"]).encode()).hexdigest()
        assert h == root and (r["folded"] == root) == (r["seen"] == r["leaf"])
    assert merkle.manifest(docs.where("false"), fields, arity=arity).count() == 0


def test_residue_products_are_exact():
    rng = np.random.default_rng(5)
    for dims, size in ((1, 1 << 26), (64, 300), (3000, 1 << 10), (0, 1)):
        a, b = rng.integers(-size, size, (7, dims)), rng.integers(-size, size, (9, dims))
        bound = int(max([0, *(a**2).sum(axis=1), *(b**2).sum(axis=1)])) + 1
        assert (hard_negatives.scores(a, b, bound) == a @ b.T).all()
    assert hard_negatives.primes(250) == [251] and np.prod([float(p) for p in hard_negatives.primes(2 * hard_negatives.MOST)]) < 2.0**63


def plain_negatives(rows, positives=5, negatives=3, low=50, high=95):
    used = [(i, label, [int(np.floor(256 * np.float64(x))) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, label, v) in enumerate(used):
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, lab) for m, (j, lab, w) in enumerate(used) if m != n)
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [(j, -s) for s, j, lab in scored if lab != label and low * -ps <= 100 * -s <= high * -ps][:negatives]
            out += [(i, p, r + 1, j, -ps, s) for r, (j, s) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize(("rows_a_block", "tile"), [(4096, 32), (7, 2), (3, 1)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, rows_a_block, tile):
    monkeypatch.setattr(hard_negatives, "ROWS", rows_a_block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(3)), (np.round(rng.normal(size=5), 1) + 0.5).tolist()) for i in range(0, 160)]
    rows += [(50, 1, rows[50][2]), (50, rows[50][1], rows[50][2]), (7, 1, rows[8][2]), (200, 2, [1.0, 1.0]), (250, 2, [0.0] * 5), (300, 0, [-9.0] * 5), (350, 1, [])]
    rows += [(None, 1, [1.0] * 5), (400, None, [1.0] * 5), (450, 1, None), (500, 1, [1.0, None]), (550, 1, [float("nan")]), (600, 1, [float("inf")])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, nth string, tile int").repartition(5)
    mined = lambda d: sorted(tuple(r) for r in hard_negatives.mine(d, F.col("vec_id") % 50 == 0).collect())
    assert mined(df) == plain_negatives(rows)
    assert mined(df.where("false")) == [] and mined(df.where("vec_id % 50 > 0")) == []
    with pytest.raises(ValueError):
        hard_negatives.mine(df.limit(1).withColumn("embedding", F.array(F.lit(1e30))), F.lit(True))


def test_queries_carry_the_contract_columns(spark):
    from tests.llm.test_operators import SF

    want = {
        "op11_document_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op12_merkle_manifest": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        "op13_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    }
    for name, columns in want.items():
        got = queries.queries()[name](spark, SF)
        assert sorted(got.columns) == sorted(columns)
        if name.startswith("op11"):
            rows = got.collect()
            assert len({r["doc_id"] for r in rows}) == len(rows) and all(len(r["fingerprint"]) == 32 for r in rows)
            texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
            same = {}
            for r in rows:
                assert same.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
            edited, other = (np.array([r[c] for r in rows]) for c in ("near_edited", "near_next"))
            assert (edited[:, None] > other[None]).mean() > 0.95
