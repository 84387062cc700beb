"""The pipeline's stages against brute-force versions of their decisions."""

import corpus_pipeline
import pyarrow.parquet as pq
import pytest

from causaltape.llm import decontamination, queries, similar_documents, simhash, toxicity
from causaltape.llm.shared import cut
from tests.llm.test_operators import SF, plain_contaminated, plain_groups


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF), name)
        assert docs.columns == names
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    start, harmless, distinct, clean, masked = seen
    model = queries.toxicity_model(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scored = toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()
    assert set(harmless) == {r["doc_id"] for r in scored if r["predicted"] == 0} < set(start)
    groups = plain_groups(harmless.items())
    assert set(distinct) == {d for d, c in groups.items() if d == c}
    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    assert set(clean) == set(distinct) - {d for d, _ in plain_contaminated(distinct.items(), list(zip(bench["item_id"], bench["text"], strict=True)))}
    assert set(masked) == set(clean) and not any("@" in t for t in masked.values())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in last} == set(masked) and all(r["exact"] for r in last)


def test_stages_take_empty_documents_and_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f", None, "s", 3)], docs.schema)
    for frame, left in ((docs.where("false"), 0), (odd, 2)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SF)
        assert frame.count() == left


def test_near_copies_are_linked_by_fingerprints_too(spark):
    """5 is linked to 4 by fingerprints only, and 4 to 2 by shingles only, so 2 stands for all three."""
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "a b"), (2, " ".join(words)), (3, "A  b"), (4, " ".join([*words, "more"])), (5, "c d"), (6, "")], "doc_id long, text string")
    near = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 4), (5, 4), (6, 6)], "doc_id long, component_id long")
    assert sorted(r["doc_id"] for r in similar_documents.keep_one(docs, also=near).collect()) == [1, 2, 6]
    asked = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(simhash, "near_duplicates", lambda d, **how: asked.append(how) or near)
        assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [1, 2, 6]
    assert asked == [{"shingle": 3, "radius": 2}]


def test_keep_one_takes_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 9, "x"), (2, "a b c d e f", 8, "y"), (3, "other words here", 7, "z"), (None, "a b c d e f", 6, "n")]
    kept = similar_documents.keep_one(spark.createDataFrame(rows, "doc_id long, text string, gone long, rep string"))
    assert kept.columns == ["doc_id", "text", "gone", "rep"] and sorted(r["gone"] for r in kept.collect()) == [6, 7, 9]


def test_items_without_words_match_nothing():
    assert decontamination.Benchmark([(1, "..."), (2, "")], 5, 0.8).matches("a b c d e") == []
