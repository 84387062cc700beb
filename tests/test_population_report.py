"""The population run: each status, and its sections."""

from causaltape.operators import population

ANCHOR = "who string, state string, anchor_time long, known_at long, value double"
JOINED = "d string, anchor_time long, available_time long, value double, context_value double"
GATES = "d string, min_support long, min_abs_metric double"


def test_each_status(spark):
    good = [("x", "S", 10 + i, 10, float(i)) for i in range(4)] + [("y", "T", 20, 20, None)]
    pairs = [("p", 10 + i, 5, i + 1.0, 2.0 * i + 1) for i in range(4)] + [("p", 20, None, None, None), ("q", 20, None, 1.0, None)]

    def run(anchors, joined, gates=(("p", 4, 0.9),)):
        rows = population.run_report(spark.createDataFrame(anchors, ANCHOR), spark.createDataFrame(joined, JOINED), spark.createDataFrame(list(gates), GATES), "d", ["state"], "who").collect()
        return {(r["section"], r["item"], r["measure"]): (r["number"], r["verdict"]) for r in rows}

    got = run(good, pairs)
    assert got["status", None, "requests"] == (2, "PARTIAL") and got["status", None, "concluded"][0] == 1
    assert got["validation", None, "records"][0] == 5 and got["validation", None, "invalid"][0] == 0
    assert [got["phenotype", "S", m][0] for m in ("anchors", "samples", "mean", "least", "greatest")] == [4, 4, 1.5, 0, 3]
    assert got["phenotype", "T", "samples"][0] == 0 and got["phenotype", "T", "mean"][0] is None
    assert got["discovery", "p", "pearson"] == (1.0, "PARTIAL") and got["discovery", "q", "observations"] == (0, "INCONCLUSIVE")
    assert got["gate", "p", "eligible"] == (1, "PREDECLARED_GATE_PASSED") and got["gate", "q", "eligible"] == (0, "NO_PREDECLARED_GATE")
    assert got["candidate", "p", "observations"][1].startswith("candidate-") and ("candidate", "q", "observations") not in got
    assert [got["scope", None, m][0] for m in ("identities", "first_ns", "last_ns")] == [2, 10, 20]
    assert run([*good, ("z", "S", 5, 9, 1.0)], pairs)["status", None, "requests"][1] == "REJECTED"
    assert run([*good, (None, "S", 9, 9, 1.0)], pairs)["validation", None, "NO_IDENTITY"][0] == 1
    assert run(good, pairs[5:])["status", None, "requests"][1] == "INCONCLUSIVE"
    assert run(good, [])["status", None, "requests"][1] == "KNOWN"
    empty = run([], [], ())
    assert empty["status", None, "requests"] == (0, "UNKNOWN") and not any(k[0] in ("phenotype", "discovery", "gate") for k in empty)
