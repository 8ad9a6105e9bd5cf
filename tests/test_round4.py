"""What the fourth round mended: gates that have nothing to do, words worked out once."""

from pyspark.sql import functions as F

from attestra.operators import authoring, bindings, evidence
from attestra.plans import evaluate


def test_gates_without_obligations_are_not_run(spark, monkeypatch):
    """Only the gate of tables is run where all obligations are cells; regions without any obligation give no rows."""
    names, write = [], evaluate.written
    monkeypatch.setattr(evaluate, "written", lambda df, name: names.append(name) or write(df, name))
    candidates = spark.createDataFrame([(i, "| a | b |\n| --- | --- |\n| k | 1 |\n| n | 2 |") for i in (1, 2)], "case_id long, text string")
    regions = candidates.select("case_id", F.lit(1).alias("region_id"), F.array(F.lit(1)).alias("pages"), F.lit(True).alias("unique_evidence"), F.lit(1).alias("budget"))
    schema = "case_id long, region_id int, leaf_id string, claim string, kind string, strict boolean, expectation string, state string, harm int"
    leaves = spark.createDataFrame([(i, 1, n, "table_binding", "table_binding", False, "x", None, 1) for i in (1, 2) for n in "kn"], schema)
    terms = spark.createDataFrame([(i, n, role, 0, 0, alt) for i in (1, 2) for n, v in (("k", "1"), ("n", "3")) for role, alt in (("row", n), ("column", "b"), ("value", v))], "case_id long, leaf_id string, role string, binding_no int, group_no int, alternative string")
    judged = leaves.select("case_id", "leaf_id", F.lit(0).alias("at"), F.lit("correct").alias("status"), F.array(F.lit(3)).alias("refs"))
    run = lambda le: sorted(tuple(r) for r in evaluate.leaf_statuses(candidates, regions, le, terms, judged, ["case_id"]).select("case_id", "leaf_id", "status", "credited").collect())
    assert run(leaves) == [(i, n, "correct", n == "k") for i in (1, 2) for n in "kn"]
    assert names.count("evaluate-gate") == 1
    assert run(leaves.where("false")) == [] and names.count("evaluate-gate") == 1


def test_words_are_worked_out_once(spark):
    """Words of both texts are an array each, made before they are gone through; a phrase is looked for only where its letters are."""
    df = spark.createDataFrame([("a b c", "a c"), ("a b c", "c a"), ("a b", ""), ("Total amount", "total amount"), (None, "x")], "v string, a string")
    said = F.coalesce(bindings.is_subsequence(bindings.words_of(F.col("a")), bindings.words_of(F.col("v"))), F.lit(False))
    assert [r[0] for r in df.select(said).collect()] == [True, False, False, False, False]
    plan = df.select(said.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2
    assert "contains" in df.select(evidence.holds(F.col("v"), F.array("a")).alias("x"))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_literals_are_read_once(spark, monkeypatch):
    """Statements' literals and groups are worked out once, however many tables rest on them."""
    calls, own = [], authoring.signals
    monkeypatch.setattr(authoring, "signals", lambda leaves, keys: calls.append(1) or own(leaves, keys))
    leaves = spark.createDataFrame([(i, 1, "S", f"Lot AB-{i} weighs {i}.5 kg") for i in range(1, 4)], "c int, leaf_id int, section string, expectation string")
    gold = spark.createDataFrame([(1, "S", "AB-1 weighs 1.5 kg"), (2, "S", "AB-2 weighs kg"), (3, "T", "x")], "c int, section string, body string")
    kept, failed = authoring.refined_groups(leaves, gold, ["c"])
    assert {x.alternatives[0] for x in kept.where("c = 1").collect()} == {"AB-1", "1.5", "kg", "weighs"}
    assert {(x.c, x.reason) for x in failed.collect()} >= {(2, "the gold section lacks the scalar 2.5"), (3, "the gold section has none of the terms")}
    assert len(calls) == 1 and "regexp" not in kept._jdf.queryExecution().optimizedPlan().toString()
