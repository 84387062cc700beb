"""Each corpus operator against a brute-force version on a small fixture, and on edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from causaltape.llm import bpe, chat, decontamination, embeddings, language_id, pii, similar_documents, simhash, substring_dedup, token_counts, toxicity
from causaltape.llm.components import connected_components
from causaltape.llm.shared import drawn, threshold

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EDGE = [None, "", " \t\n", "a", "a b", "ÄÖ ü", "x " * 3000, "x" * 5000, "a b c d e", "a b c d e", "A B C D E", "<|endoftext|> x\n\n  y", "漢字😀 é"]


@pytest.fixture(scope="module")
def texts():
    got = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return list(zip(got["doc_id"], got["text"], strict=True))


@pytest.fixture(scope="module")
def edge(spark):
    """Null and repeated ids, ties, edge texts, and extra columns with names the operators use inside."""
    rows = [(i, t, i, "q") for i, t in enumerate(EDGE)] + [(None, "a b c d e", 1, "n"), (3, "a", 1, "r"), (3, "a", 1, "r")]
    return spark.createDataFrame(rows, "doc_id long, text string, id long, component string").repartition(3)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.where("false")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_match_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    good = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components({n for e in good for n in e}, good)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_covering_masks_cover_every_pair():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    assert all(any(not (m >> i & 1 or m >> j & 1) for m in masks) for i in range(64) for j in range(64))


def test_simhash_matches_brute_force(spark, texts, edge, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    found = components(prints, links)
    assert got == {d: (format(p, "016x"), found[d]) for d, p in prints.items()}
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count() and all((r["component_id"] is None) == (r["doc_id"] is None) for r in rows)
    assert {r["component_id"] for r in rows if r["doc_id"] in (0, 1, 2)} == {0}
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_dense_groups_without_pairs(spark):
    points = [(i, random.Random(3).getrandbits(60) ^ (1 << (i % 20)) ^ (1 << (i // 20))) for i in range(200)]
    points = list({p: i for i, p in reversed(points)}.items())
    df = spark.createDataFrame([(p,) for p, _ in points], "fp long")
    got = {r["node"]: r["component"] for r in connected_components(simhash.near_links(df)).collect()}
    links = [(p, q) for p, _ in points for q, _ in points if p < q and (p ^ q).bit_count() <= 2]
    assert got == {n: c for n, c in components([p for p, _ in points], links).items() if any(n in e for e in links)}


def test_simhash_keeps_rows_of_one_id_apart(spark, monkeypatch):
    near = lambda fp, *bits: fp ^ sum(1 << b for b in bits)
    one, two = 0x1234_5678_9ABC_DEF0, 0x0FED_CBA9_8765_4321
    prints = {"a": near(one, 3), "b": one, "c": two, "d": two, "e": near(two, 9, 60)}
    rows = [(1, "a"), (3, "b"), (3, "c"), (7, "d"), (8, "e")]
    fake = spark.createDataFrame([(i, prints[t]) for i, t in rows], "id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: fake)
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(fake).collect())
    assert got == sorted((i, format(prints[t], "016x"), c) for (i, t), c in zip(rows, (1, 1, 3, 3, 3), strict=True))


def plain_removal(rows, size=13):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, (d, t) in enumerate(rows)}
    first = {}
    for k, w in words.items():
        if rows[k][0] is not None:
            for i in range(len(w) - size + 1):
                key = tuple(w[i : i + size])
                first[key] = min(first.get(key, rows[k][0]), rows[k][0])
    out = []
    for k, w in words.items():
        gone = [False] * len(w)
        if rows[k][0] is not None:
            for i in range(len(w) - size + 1):
                if first[tuple(w[i : i + size])] < rows[k][0]:
                    gone[i : i + size] = [True] * size
        out.append((rows[k][0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return collections.Counter(out)


def test_substring_dedup_matches_brute_force(spark, texts, edge, empty):
    rows = texts + [(None, texts[0][1]), (texts[0][0], texts[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(tuple(r) for r in substring_dedup.repeated_passages(docs).collect()) == plain_removal(rows)
    pairs = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert collections.Counter(tuple(r) for r in substring_dedup.repeated_passages(edge).collect()) == plain_removal(pairs)
    assert substring_dedup.repeated_passages(empty).count() == 0


@pytest.mark.parametrize(("fan", "most"), [(4, 2), (8, 8), (2, 4)])
def test_substring_dedup_merges_over_many_levels(spark, texts, fan, most):
    """Blocks of chunks over several levels, hot rows of null and equal ids, in many small chunks."""
    rnd = random.Random(fan)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(d, " ".join([*(f"w{rnd.randrange(40)}" for _ in range(rnd.randint(0, 60))), *([passage] * (d % 3 == 0))])) for d in range(150)]
    rows += [(None, passage)] * 80 + [(7, passage)] * 40 + [(1, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring_dedup.repeated_passages(docs, chunk_bytes=500, fan=fan, most=most)
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_removal(rows)


def test_bpe_equals_the_library_and_goes_back(spark, texts, edge, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    for docs in (spark.createDataFrame(texts[:80], "doc_id long, text string"), edge):
        want = {(r["doc_id"], r["text"] or "") for r in docs.collect()}
        got = bpe.decode(bpe.encode(docs, BPE, keep=("text",)), BPE).collect()
        again = bpe.encode(docs, BPE, keep=("text",), decoded=True).collect()
        assert sorted(map(repr, again)) == sorted(map(repr, got))
        assert {(r["doc_id"], r["text"] or "") for r in got} == want and len(got) == docs.count()
        for r in got:
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids and r["n_tokens"] == len(ids)
            assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(empty, BPE).count() == 0
    assert bpe.id_list(bpe.encode(edge, BPE)).where("size(token_ids) = 0").count() == 2


def test_segment_tree_merges_alike_in_both_forms():
    known, rnd = bpe.vocabulary(BPE), random.Random(5)
    pieces = ["".join(rnd.choice("theandion rés漢") for _ in range(rnd.randint(1, 14))).encode() for _ in range(400)]
    packed = known.merge_many(pieces, 64)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [known.merge([known.of_byte[b] for b in p]) for p in pieces]


def test_embeddings_find_all_links_above_the_threshold(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 64))
    rows = [(i, (base[i % 60] + rng.standard_normal(64) * 0.24).tolist(), i % 3) for i in range(600)]
    rows += [(600 + i, rows[0][1], 0) for i in range(50)]
    rows += [(700, None, 0), (701, [0.0] * 64, 0), (702, [float("nan")] * 64, 0), (703, rows[0][1], None), (None, rows[0][1], 0), (704, [1.0, 2.0], 0), (705, [2.0, 4.0], 0), (706, [], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    valid = [(i, np.array(v), l) for i, v, l in rows[:650]]
    x = np.array([v / np.linalg.norm(v) for _, v, _ in valid])
    near = (x @ x.T >= 0.93) & (np.array([l for *_, l in valid])[:, None] == np.array([l for *_, l in valid]))
    np.fill_diagonal(near, False)
    found = components([i for i, *_ in valid], [(valid[a][0], valid[b][0]) for a, b in zip(*np.nonzero(near), strict=True)])
    want = {i: int(near[k].sum()) for k, (i, *_) in enumerate(valid)}
    links = sum(want.values())
    assert links > 3000 and sum(abs(got[i][0] - n) for i, n in want.items()) <= 0.001 * links
    assert sum(got[i][1] != found[i] for i in want) <= 1
    assert got[700] == (0, 700, True) and got[701] == (0, 701, True) and got[703] == (0, 703, True) and got[None] == (0, None, None)
    assert got[704] == (1, 704, True) and got[705] == (1, 704, False)


def plain_links(rows, threshold=0.93):
    """{row number: (n_links, component_id)} of (id, vector, label) rows, all good."""
    x = np.array([np.array(v) / np.linalg.norm(v) for _, v, _ in rows])
    label = np.array([l for *_, l in rows])
    near = (x @ x.T >= threshold) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    group = np.arange(len(rows))
    while (new := np.array([min(group[k], *group[near[k]], group[k]) for k in range(len(rows))])).tolist() != group.tolist():
        group = new
    ids = np.array([i for i, *_ in rows])
    return [(int(i), int(near[k].sum()), int(ids[group == group[k]].min())) for k, i in enumerate(ids)]


def test_embeddings_repeated_ids_and_extra_columns(spark):
    turn = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]
    rows = [(1, turn(0), 0), (3, turn(5), 0), (3, turn(90), 0), (7, turn(95), 0), (7, turn(200), 0)]
    frame = spark.createDataFrame([(*r, 9, "n", 0.5) for r in rows], "vec_id long, embedding array<float>, label int, pid long, ball string, copies double")
    got = [tuple(r)[:3] for r in embeddings.near_duplicates(frame).collect()]
    assert sorted(got) == sorted(plain_links(rows)) == [(1, 1, 1), (3, 1, 1), (3, 1, 3), (7, 0, 7), (7, 1, 3)]
    assert embeddings.near_duplicates(frame.where("false")).count() == 0


@pytest.mark.parametrize("dims", [2, 3, 8, 64])
def test_balls_of_many_widths_count_every_link(spark, dims):
    """Groups tighter than a ball, wider than one, and chains, in few and many dimensions."""
    rng = np.random.default_rng(dims)
    rows = []
    for g, spread in enumerate((0.02, 0.1, 0.2, 0.3, 0.45) * 3):
        centre = rng.standard_normal(dims)
        centre /= np.linalg.norm(centre)
        rows += [(len(rows) + i, (centre + rng.standard_normal(dims) * spread / np.sqrt(dims)).tolist(), g % 2) for i in range(30)]
    got = sorted(tuple(r)[:3] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    want = sorted(plain_links(rows))
    assert sum(abs(a[1] - b[1]) for a, b in zip(got, want, strict=True)) <= 0.001 * sum(b[1] for b in want)
    assert sum(a[2] != b[2] for a, b in zip(got, want, strict=True)) <= 1


@pytest.mark.parametrize(("words", "pairs"), [(32, 4000), (512, 4000), (4096, 1500)])
def test_filters_miss_few_pairs_at_the_threshold_at_any_size(words, pairs):
    rng, hit = np.random.default_rng(1), np.zeros(pairs, bool)
    x, y = rng.standard_normal((2, pairs, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for code in range(embeddings.CODES):
        for at in range(0, pairs, 500):
            one, two = (set(zip(*(k.tolist() for k in embeddings.passed_filters(z[at : at + 500], words, code)), strict=True)) for z in (x, y))
            hit[[at + r for r, _ in one & two]] = True
    assert 1 - hit.mean() <= 0.002


def test_language_id_held_out_accuracy(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.held_out(docs.doc_id)
    model = language_id.train(docs.where(~out), PIECES, most=400)
    got = docs.where(out).join(language_id.predict(docs, model), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = language_id.predict(edge, model).collect()
    assert len(odd) == edge.count() and {r["lang_pred"] for r in odd if r["doc_id"] in (0, 1, 2)} == {"und"}
    assert language_id.predict(empty, model).count() == 0
    nothing = language_id.train(docs.where("false"), PIECES)
    assert {r["lang_pred"] for r in language_id.predict(edge, nothing).collect()} == {"und"}


def test_forward_algorithm_sums_all_segmentations():
    known, lattice = language_id.pieces(PIECES), language_id.lattice(PIECES)
    logp = np.random.default_rng(1).uniform(-9, -2, (len(known) + 1, 2))

    def total(word):
        if not word:
            return np.zeros(2) + 1
        out = np.exp(logp[-1]) * total(word[1:])
        for k in range(1, len(word) + 1):
            if word[:k] in known:
                out = out + np.exp(logp[known[word[:k]]]) * total(word[k:])
        return out

    for word in ("▁the", "▁éöx", "▁tion", "▁漢a"):
        assert np.allclose(lattice.score([word], logp)[0], np.log(total(word)))


def test_chat_is_reversible_and_marks_the_loss(spark):
    trap = "<|im_end|>\\<|im_start|><\\|x|>\n|<|im_sep|>"
    rows = [(1, 0, "user", trap), (1, 1, "assistant", trap), (1, 1, "assistant", None), (2, 0, None, ""), (None, 5, "assistant", "ü😀"), (1, None, "system", "s"), (3, 0, trap, "t")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns.withColumn("parts", chat.text_parts(turns.text)))).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("system", "s"), ("user", trap), ("assistant", ""), ("assistant", trap)]
    assert got[1]["loss_text"] == trap and got[None]["loss_text"] == "ü😀" and got[2]["loss_text"] == ""
    assert got[3]["turns"][0]["role"] == trap
    assert chat.format_conversations(turns.withColumn("parts", chat.text_parts(turns.text)).where("false")).count() == 0


def test_chat_flattens_typed_parts(spark):
    parts = [{"kind": "text", "text": "see <|image|> ", "ref": None, "units": None}, {"kind": "image", "text": None, "ref": "i1", "units": 4}, {"kind": "audio", "text": None, "ref": "a1", "units": None}, {"kind": "other", "text": "gone", "ref": None, "units": 1}]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.format_conversations(turns).first()
    assert row["formatted"] == "<|im_start|>user<|im_sep|>see <\\|image|> <|image|><|audio|><|im_end|>\n<|im_start|>assistant<|im_sep|><|im_end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("image", "i1", 1024), ("audio", "a1", 25)] and row["attachment_tokens"] == 1049


def plain_contaminated(docs, items):
    out = {}
    for d, text in docs:
        words = decontamination.words_of(text)
        for item, passage in items:
            wanted = decontamination.words_of(passage)
            if not wanted or item is None:
                continue
            q, n = min(5, len(wanted)), len(wanted)
            if len(words) < q:
                continue
            for s in range(max(1, len(words) - n + 1)):
                x = decontamination.similarity(decontamination.shingles(words[s : s + n], q), decontamination.shingles(wanted, q))
                if x >= 0.8 and x > out.get((d, item), (0,))[0]:
                    out[d, item] = (x, s)
    return out


def test_decontamination_matches_brute_force(spark, edge, empty):
    rnd = random.Random(4)
    vocab = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.choice((3, 15, 40, 60))))) for k in range(25)] + [(98, ""), (99, None), (None, "w1 w2 w3 w4 w5")]
    docs = []
    for d in range(120):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(0, 150))]
        if d % 2:
            leak = (items[d % 25][1] or "").split()
            for _ in range(d % 3):
                leak[rnd.randrange(len(leak))] = "changed"
            at = rnd.randint(0, len(words))
            words[at:at] = [w.upper() + "," for w in leak]
        docs.append((d, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    want = plain_contaminated(docs, items)
    assert got == want and any(x < 1 for x, _ in want.values())
    clean = decontamination.keep_clean(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontamination.contaminated(edge, bench).count() == 0 and decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.keep_clean(edge, bench.where("false")).count() == edge.count()


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (True, k == 1 and all(int(p) <= 255 for p in m.group().split(".")), k == 2 and 13 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15)[k]
            if good:
                out.append((k, *m.span()))
    return out


def test_pii_base_spans_match_the_patterns():
    rnd = random.Random(8)
    for alphabet, n in (("a@.-+1 9(b)@.%é", 4000), ("19 .-", 3000)):
        for _ in range(n):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
            assert pii.base_spans(text) == plain_spans(text), text
    for text in ("4532015112830366", "a@b.c+d@e.f", "1.2.3.4.5.6.7.8", "a" * 200_000, "1" * 200_000, "+1 (487) 555-7209"):
        assert len(text) > 100_000 or pii.base_spans(text) == plain_spans(text)
        pii.base_spans(text)


def test_pii_field_finds_secrets_and_persons(spark, edge, empty):
    field = pii.train()
    finder = pii.Finder(field)
    text = 'und die token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" steht.\nask Dr. Maria Stone now'
    found = [(pii.KINDS[k], text[s:e]) for k, s, e in finder.find([text])[0]]
    assert ("secret", "9b0b3c6a43eb78aa99cbd7049c572391524f37a8") in found and any(k == "person" and "Maria" in t for k, t in found)
    assert finder.find(["The house. By the way, it is 9 now."]) == [[]]
    rows = pii.personal_data(edge, field).collect()
    assert len(rows) == edge.count() and all(not r["spans"] for r in rows)
    assert pii.personal_data(empty, field).count() == 0
    masked = pii.mask(spark.createDataFrame([(1, "mail a@b.cd or 10.1.2.3", 5), (2, None, 6)], "doc_id long, text string, kind int"), field).collect()
    assert [tuple(r) for r in masked] == [(1, "mail <email> or <ip>", 5), (2, None, 6)]


def test_masks_cover_the_union_of_overlapping_spans():
    email, phone = pii.KINDS.index("email"), pii.KINDS.index("phone")
    text = "call +14875557209bob.smith@example.com now"
    assert pii.masked(text, [(email, 6, 38), (phone, 5, 17)]) == "call <phone> now"
    assert pii.masked(text, [(phone, 5, 17), (email, 5, 38)]) == "call <email> now"
    assert pii.masked(text, [(phone, 5, 17), (email, 17, 38)]) == "call <phone><email> now"


def test_viterbi_equals_search_over_all_paths():
    field, rnd = pii.train(), random.Random(2)
    words = ["token", "=", '"', "a1b2c3d4e5f6a7b8", "the", ".", "Dr", "Ada", "name", ":"]
    sentences = [[rnd.choice(words) for _ in range(rnd.randint(1, 5))] for _ in range(40)]
    classes = [np.array([field.class_of(w) for w in s]) for s in sentences]
    import itertools

    for c, tags in zip(classes, field.decode(classes), strict=True):
        def score(path, c=c):
            total = sum(field.scores[c[t + off], o, path[t]] for t in range(len(c)) for o, off in enumerate(pii.OFFSETS) if 0 <= t + off < len(c))
            return total + sum(field.move[a, b] for a, b in itertools.pairwise(path))

        assert np.isclose(score(tags.tolist()), max(map(score, itertools.product(range(3), repeat=len(c)))))


def test_token_counts_equal_the_library_at_every_prefix(spark, texts, edge, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    known, rnd = token_counts.counter(PIECES), random.Random(6)
    samples = [t[:50] for _, t in texts[:60]] + ["".join(rnd.choice("ab  \n\t'sé漢😀▁.") for _ in range(30)) for _ in range(100)]
    for text, parts in zip(samples, known.counts(samples), strict=True):
        counts, base = [], 0
        for p in parts:
            counts += [base + c for c in p[1:]]
            base += p[-1]
        want = [len(library.encode(text[:i])) for i in range(1, len(text) + 1)]
        assert counts[1:] == want
        for budget in (1, 4, 9):
            assert token_counts.fitting_prefix(parts, budget) == max([i + 1 for i, c in enumerate(want) if c <= budget], default=0)
    for docs in (spark.createDataFrame(texts, "doc_id long, text string"), edge):
        got = token_counts.token_counts(docs, PIECES, budget=300).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
        assert all(r["n_tokens"] == len(library.encode(r["text"] or "")) and r["over_limit"] == (r["n_tokens"] > 300) and r["n_bytes"] == len((r["text"] or "").encode()) for r in got)
    assert token_counts.token_counts(empty, PIECES).count() == 0


def test_toxicity_held_out(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.held_out(docs.doc_id)
    model = toxicity.train(docs, labels.where(~toxicity.held_out(labels.doc_id)))
    got = docs.where(out).join(labels, "doc_id").join(toxicity.score(docs, model), "doc_id").select("lang", "toxic", "predicted").collect()
    toxic = [r for r in got if r["toxic"]]
    wrong = [r for r in got if not r["toxic"] and r["predicted"]]
    # all held-out rows: 9 of 14 toxic ones are found and one of 80 others; the five missed are not English and hold no
    # word that the toxic texts of their language share
    assert sum(r["toxic"] == r["predicted"] for r in got) / len(got) > 0.93 and len(wrong) <= 0.02 * len(got)
    assert len(toxic) == 14 and all(r["predicted"] for r in toxic if r["lang"] == "en") and sum(r["predicted"] for r in toxic) >= 9
    rows = toxicity.score(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert toxicity.score(empty, model).count() == 0 and toxicity.keep_harmless(edge, model).count() == edge.where("true").count()
    prior = toxicity.train(docs, labels.where("false"))
    assert toxicity.score(edge, prior).count() == edge.count()


@pytest.mark.parametrize(("rows", "most"), [(10, 8000), (8001, 8000), (10**6, 8000), (5 * 10**10, 8000), (10**15, 12_000)])
def test_samples_keep_their_size_at_any_number_of_rows(rows, most):
    below = threshold(rows, most)
    expected = rows if below is None else rows * (below + 2**63) / 2**64
    assert abs(expected - min(rows, most)) <= 1


def test_samples_are_drawn_by_a_hash(spark):
    ids = spark.range(20_000)
    assert 1800 < ids.where(drawn(20_000, 2000, 5, "id")).count() < 2200 and ids.where(drawn(5, 2000, 5, "id")).count() == 20_000


def plain_matches(text, insults):
    """Sums by (kind, directed, negated, reported), by looking back from each word over its sentence and paragraph."""
    out = collections.Counter()
    for paragraph in re.split(r"[\n|]", text.lower()):
        marks = 0
        for sentence in re.split(r"[.!?;]", paragraph):
            words, pending = re.findall(r"[^\W\d_']+(?:'[^\W\d_']*)*|[\"“”«»]", sentence), None
            for i, w in enumerate(words):
                before = words[:i]
                marks += w in '"“”«»'
                about = (any(b in toxicity.TARGET for b in before), any(b in toxicity.NEGATION for b in before[-3:]), marks % 2 == 1 or any(b in toxicity.REPORT for b in before))
                kind = "insult" if w in insults else w in toxicity.THREAT and "verb" or w in toxicity.TARGET and "target"
                if kind == "insult":
                    out["insult", *about] += insults[w]
                elif kind:
                    if pending and pending[0] != kind and i - pending[1] <= 4:
                        out["threat", True, *about[1:]] += 1
                        pending = None
                    else:
                        pending = (kind, i)
    return {k: np.log1p(v) for k, v in out.items()}


def test_grammar_equals_a_plain_clause_scanner():
    insults, rnd = {"idiot": 2.0, "fool": 0.5}, random.Random(3)
    grammar = toxicity.Grammar(insults)
    vocab = ["idiot", "fool", "you", "them", "hurt", "kill", "not", "never", "said", "wrote", '"', "the", "green", "house", ".", "!", "\n", ";"]
    for _ in range(3000):
        text = " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 25)))
        got = {n: v for n, v in zip(toxicity.MATCHES, grammar.features(text), strict=False) if v}
        marked = any(w in text.split() for w in ("idiot", "fool", "hurt", "kill"))
        assert got.keys() == plain_matches(text, insults).keys() and np.allclose([*got.values()], [plain_matches(text, insults)[k] for k in got]), (text, marked)


def test_language_model_equals_plain_expectation_maximisation(spark):
    texts = [(1, "der tag", "de"), (2, "tag der", "de"), (3, "the day", "en"), (4, "day", "en"), (5, "Tag!", "de"), (None, None, "en"), (6, "x", None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = language_id.train(frame, PIECES, rounds=2)
    known, langs = language_id.pieces(PIECES), ["de", "en"]

    def cuts(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in known:
                yield from ([known[word[:k]], *rest] for rest in cuts(word[k:]))
        if word:
            yield from ([-1, *rest] for rest in cuts(word[1:]))

    words = {l: ["▁" + w for _, t, m in texts if m == l for w in re.findall("[a-z]+", (t or "").lower())] for l in langs}
    logp = np.full((len(known) + 1, 2), -np.log(len(known)))
    logp[-1] = language_id.UNKNOWN
    for _ in range(2):
        table = np.full(logp.shape, language_id.SMOOTHING)
        for c, l in enumerate(langs):
            for w in words[l]:
                ways = list(cuts(w))
                p = np.exp([sum(logp[x, c] for x in way) for way in ways])
                for way, q in zip(ways, p / p.sum(), strict=True):
                    for x in way:
                        table[x, c] += q
        logp = np.log(table / table[:-1].sum(axis=0))
        logp[-1] = language_id.UNKNOWN
    assert model.languages == langs and np.allclose(model.logp, logp) and np.allclose(np.exp(model.prior), [3 / 5, 2 / 5])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(spark.createDataFrame([(1, "Day the day"), (2, "tag")], "doc_id long, text string"), model).collect()}
    for d, t in ((1, "Day the day"), (2, "tag")):
        total = model.prior + sum(np.log(sum(np.exp(logp[way].sum(axis=0)) for way in map(np.array, cuts("▁" + w)))) for w in t.lower().split())
        p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert got[d][0] == langs[int(p.argmax())] and np.isclose(got[d][1], p.max())


def test_benchmark_items_that_repeat_count_once(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS", 3)
    bench = spark.createDataFrame([(1, "one two three four five six")] * 50 + [(2, "seven eight nine ten eleven")], "item_id long, text string")
    assert sorted(len(b) for b in decontamination.item_blocks(bench, "item_id", "text")) == [2]


@pytest.mark.parametrize("block", [1, 2, 2000])
def test_an_item_id_of_several_texts_gives_one_row_in_any_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "ITEMS", block)
    texts = ["one two three four five six seven", "one two three four five six eight", "one two three four five nine seven"]
    for shift in range(3):
        items = spark.createDataFrame([(7 + shift, t) for t in texts] + [(70 + shift, "other words that stand in no document at all"), (80 + shift, texts[0])], "item_id long, text string")
        got = decontamination.contaminated(spark.createDataFrame([(1, texts[0] + " tail")], "doc_id long, text string"), items).collect()
        assert sorted((r["item_id"], r["similarity"]) for r in got) == [(7 + shift, 1.0), (80 + shift, 1.0)]


def test_grammar_weighs_matches_by_their_clause():
    grammar = toxicity.Grammar({"idiot": 2.0})
    of = lambda text: {n: v for n, v in zip(toxicity.MATCHES, grammar.features(text), strict=False) if v}
    assert of("what an idiot") == {("insult", False, False, False): np.log1p(2)}
    assert of("you are an idiot") == {("insult", True, False, False): np.log1p(2)}
    assert of("he is not an idiot. idiot") == {("insult", True, True, False): np.log1p(2), ("insult", False, False, False): np.log1p(2)}
    assert of('she said "you idiot"') == {("insult", True, False, True): np.log1p(2)}
    assert of('she said "you fool. you idiot" and left. idiot') == {("insult", True, False, True): np.log1p(2), ("insult", False, False, False): np.log1p(2)}
    assert of("i will hurt you") == {("threat", True, False, False): np.log1p(1)} and of("we hurt. you") == {}


def plain_groups(rows, least=0.8):
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        sets[d] = frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)])
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    return components(sets, links)


def near_copies(n, seed, words=120):
    rnd = random.Random(seed)
    base, out = [f"v{rnd.randrange(5000)}" for _ in range(words)], []
    for _ in range(n):
        copy = [*base]
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_similar_documents_match_brute_force(spark, edge, empty, texts):
    rows = [(k, t) for k, t in enumerate([t for s in range(12) for t in near_copies(15, s)] + near_copies(60, 99))] + [(1000 + d, t) for d, t in texts]
    want = plain_groups(rows)
    got = {r["doc_id"]: r["component_id"] for r in similar_documents.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[d] != c for d, c in want.items()) <= 0.01 * len(want)
    kept = [r["doc_id"] for r in similar_documents.keep_one(edge).collect()]
    assert sorted(k for k in kept if k is not None) == [0, 3, 3, 3, 4, 5, 6, 7, 8, 11, 12] and kept.count(None) == 1
    assert similar_documents.keep_one(empty).count() == 0


def test_clusters_of_many_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(similar_documents, "BLOCK_SHINGLES", 1500)
    monkeypatch.setattr(similar_documents, "PIECE", 20)
    rows = list(enumerate(near_copies(90, 5)))
    got = {r["doc_id"]: r["component_id"] for r in similar_documents.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_groups(rows)


def test_members_outside_the_largest_component_meet_every_block(spark, monkeypatch):
    monkeypatch.setattr(similar_documents, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(similar_documents, "PIECE", 6)
    base = [f"c{i}" for i in range(60)]  # a chain: neighbours are similar, far ends are not, so stars link too much
    rows = [(i, " ".join(base[:44] + [f"t{j}" for j in range(i, i + 16)])) for i in range(40)]
    rows += [(100 + i, " ".join([*base[:40], *(f"z{i % 3}x{j}" for j in range(20))])) for i in range(12)]
    got = {r["doc_id"]: r["component_id"] for r in similar_documents.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_groups(rows)


def test_pairs_at_the_threshold_are_all_found(spark):
    rows = []
    for i in range(1000):  # 40 shared shingles of 50
        shared = " ".join(f"s{i}x{j}" for j in range(44))
        rows += [(2 * i + side, f"{shared} " + " ".join(f"e{i}x{side}x{j}" for j in range(5))) for side in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert similar_documents.keep_one(docs).count() == 1000


@pytest.mark.parametrize("rows_a_batch", [7, 1000])
def test_buckets_over_the_cap_keep_the_pairs_of_every_group(monkeypatch, rows_a_batch):
    monkeypatch.setattr(similar_documents, "PIECE", 20)
    sketch = {0: (0, 0), 1: (-1, -1)}
    rows = [(k, 1000 * k + r, *sketch[r % 2]) for k in (1, 2) for r in range(150)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[s : s + rows_a_batch], strict=True)], ["key", "rep", "f1", "f2"]) for s in range(0, len(rows), rows_a_batch)]
    root = {r[1]: r[1] for r in rows}
    for batch in similar_documents.propose(iter(batches), 31):
        for a, b in zip(*batch.to_pydict().values(), strict=True):
            old, new = root[a], root[b]
            root = {k: new if v == old else v for k, v in root.items()}
    assert all(root[1000 * k + r] == root[1000 * k + r % 2] for k in (1, 2) for r in range(150))
    assert root[1000] != root[2000]


def test_queries_derive_the_contract_columns(spark):
    from causaltape.llm import queries

    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11))
    from tokenizers import Tokenizer

    library, docs = Tokenizer.from_file(BPE), spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in found["op3_bpe_round_trip"](spark, SF).collect()}
    for d, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[d] == (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids, skip_special_tokens=False).encode()))
    columns = {1: "doc_id fingerprint component_id", 5: "doc_id held_out lang_pred score", 9: "doc_id n_bytes n_tokens over_limit", 10: "doc_id held_out score predicted"}
    for number, names in columns.items():
        rows = found[next(n for n in found if n.startswith(f"op{number}_"))](spark, SF).collect()
        assert set(names.split()) <= set(rows[0].asDict()) and sorted(r["doc_id"] for r in rows) == sorted(d for d, _ in docs)
        if number in (5, 10):
            assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
        if number == 9:
            sizes = {d: len((t or "").encode()) for d, t in docs}
            assert all(r["n_bytes"] == sizes[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 4096) for r in rows)
    row = found["op8_personal_data"](spark, SF).where("n_email = 0 and n_ip = 0 and n_card = 0 and n_phone = 0").first()
    assert row["base_sha256"] == hashlib.sha256(b"").hexdigest()
