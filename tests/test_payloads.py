"""Narrow structs of every row, whole records of chosen rows."""

from causaltape.operators import payloads

TAPE = [(1, 1, '{"a":{"s":"x","n":3},"b":[{"t":7}]}'), (1, 2, None), (1, 3, "{broken"), (1, 4, '{"a":{"s":5,"n":"no"}}'), (1, 5, ""), (2, 1, '{"b":[]}'), (None, 1, "{}"), (2, 9, '{"a":{"n":1}}'), (2, 9, '{"a":{"n":2}}')]


def tape(spark):
    return spark.createDataFrame(TAPE, "k int, seq int, payload string").selectExpr("*", "'old' as n", "'kept' as other")


def test_records_of_chosen_rows(spark):
    chosen = spark.createDataFrame([(1, 1, "c"), (1, 2, "c"), (1, 3, "c"), (1, 4, "c"), (1, 5, "c"), (2, 1, "c"), (2, 9, "c"), (7, 7, "c"), (None, 1, "c")], "k int, seq int, n string")
    got = payloads.records(chosen, tape(spark), ["k", "seq"], "payload", {"s": ("$.a.s", "string"), "n": ("$.a.n", "int"), "t": ("$.b[0].t", "long")})
    assert got.columns == ["k", "seq", "s", "n", "t", "payload_state"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([
        (1, 1, "x", 3, 7, "PARSED"), (1, 2, None, None, None, "ABSENT"), (1, 3, None, None, None, "MALFORMED"), (1, 4, "5", None, None, "PARSED"), (1, 5, None, None, None, "MALFORMED"), (2, 1, None, None, None, "PARSED"),
        (2, 9, None, 1, None, "PARSED"), (2, 9, None, 2, None, "PARSED"), (7, 7, None, None, None, "NO_ROW"), (None, 1, None, None, None, "NO_ROW"),
    ], key=repr)
    assert payloads.records(chosen.where("k > 99"), tape(spark), ["k", "seq"], "payload", {"n": ("$.a.n", "int")}).count() == 0
    assert {r["payload_state"] for r in payloads.records(chosen, tape(spark).where("k > 99"), ["k", "seq"], "payload", {"n": ("$.a.n", "int")}).collect()} == {"NO_ROW"}


def test_narrow_keeps_rows_and_other_columns(spark):
    got = payloads.narrow(tape(spark), "payload", "struct<a:struct<n:int>>")
    assert got.columns == ["k", "seq", "n", "other", "a"] and got.count() == len(TAPE)
    assert {(r["seq"], r["a"]["n"] if r["a"] else None) for r in got.where("k = 1").collect()} == {(1, 3), (2, None), (3, None), (4, None), (5, None)}


def test_whole_records_are_parsed_behind_the_join(spark, tmp_path):
    tape(spark).write.parquet(f"{tmp_path}/tape")
    raw = spark.read.parquet(f"{tmp_path}/tape")
    chosen = spark.createDataFrame([(1, 1)], "k int, seq int")
    plan = payloads.records(chosen, raw, ["k", "seq"], "payload", {"n": ("$.a.n", "int"), "s": ("$.a.s", "string")})._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert "parsejson" in plan[:join].lower() and "parsejson" not in plan[join:].lower() and "variant_get" not in plan[join:].lower()
    scan = payloads.narrow(raw, "payload", "struct<a:struct<n:int,s:string>>").select("a.n")._jdf.queryExecution().executedPlan().toString()
    assert "payload" in scan and "other" not in scan
