"""Appends that fail and are tried again, versions, and footers against scans."""

import pytest
from pyspark.sql import functions as F

from causaltape.sources import footers, lake, ledger

SCHEMA = "id string, created long, v long"


def test_appends_can_be_tried_again(spark, monkeypatch):
    path = lake.shared(spark, "ledger")
    some = lambda rows: spark.createDataFrame(rows, SCHEMA)
    rules = {"NEGATIVE": F.col("v") >= 0}
    ids = lambda version=None: sorted(r["id"] for r in ledger.read(spark, path, SCHEMA, version).collect())
    assert ids() == [] and ledger.history(spark, path) == []
    first = some([("a", 1, 1), ("b", 1, -1), ("c", 1, 2), ("c", 1, 3), (None, 1, 4)])
    lost = {(r["id"], tuple(r["rejects"])) for r in ledger.append(spark, path, first, "id", rules, "one").collect()}
    assert lost == {("b", ("NEGATIVE",)), ("c", ("DUPLICATE_ID",)), (None, ("NULL_ID",))} and ids() == ["a"]
    # a killed append leaves rows without a version, and readers don't see them
    second = some([("a", 2, 5), ("d", 2, 6)])
    with monkeypatch.context() as m:
        m.setattr(ledger, "_publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ledger.append(spark, path, second, "id", rules, "two")
    assert ids() == ["a"] and len(ledger.history(spark, path)) == 1
    for _ in range(2):
        lost = ledger.append(spark, path, second, "id", rules, "two").collect()
        assert [(r["id"], r["rejects"]) for r in lost] == [("a", ["DUPLICATE_ID"])]
        assert ids() == ["a", "d"] and ids(1) == ["a"] and len(ledger.history(spark, path)) == 2
    assert ledger.append(spark, path, some([]), "id", rules, "none").count() == 0 and ids() == ["a", "d"]
    # another writer took the version in between
    past = ledger.history(spark, path)
    with monkeypatch.context() as m:
        m.setattr(ledger, "history", lambda *_: past[:2])
        with pytest.raises(FileExistsError):
            ledger.append(spark, path, some([("e", 3, 1)]), "id", rules, "late")
    assert ids() == ["a", "d"]


def test_footers_equal_a_scan(spark):
    path = lake.shared(spark, "parts")
    rows = spark.range(5000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") * 3 - 100).alias("t"), F.lit(None).cast("long").alias("none"), F.col("id").cast("string").alias("s"))
    rows.repartition(3).write.option("parquet.block.size", 4096).option("parquet.page.size", 1024).parquet(path)
    got = {r["part"]: r for r in footers.footer_inventory(spark, path, ["id", "t", "none", "lacking"]).collect()}
    want = {r["part"]: r for r in lake.part_inventory(spark.read.parquet(path), ["id", "t"]).collect()}
    assert set(got) == set(want) and len(got) == 3
    for part, r in want.items():
        assert {c: got[part][c] for c in r.asDict()} == r.asDict()
        assert got[part]["row_groups"] >= 1 and got[part]["known_none"] and got[part]["min_none"] is None
        assert not got[part]["known_lacking"] and got[part]["max_lacking"] is None
    groups = footers.row_groups(spark, path, ["id"])
    assert groups.agg(F.sum("rows")).first()[0] == 5000 and groups.count() == sum(r["row_groups"] for r in got.values())
    spark.range(0).write.parquet(path + "-none")
    assert [(r["rows"], r["row_groups"]) for r in footers.footer_inventory(spark, path + "-none", ["id"]).collect()] == [(0, 0)]
