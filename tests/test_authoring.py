"""Literals, obligations as they are written, aliases by keys, shortest covers and audits, each against a plain version or worked cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from attestra.functions import literals, text
from attestra.operators import alias_join, authoring, edges, gold_audit, lexical, order
from attestra.plans import evaluate
from attestra.sources import facts


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_literals_do_not_overlap(spark):
    said = "Lot AB-12/7 on 2024-03-05 (5 March 2024) at 09:30 UTC held 1,250.50 mg / L, >= 5 and 12 -> 14 at 20 V within 3 hours, NOT final."
    got = {(s.kind, s.value) for s in one(spark, said, literals.signal_spans)}
    assert got == {
        ("date", "2024-03-05"), ("date", "5 March 2024"), ("time", "09:30 UTC"), ("identifier", "AB-12/7"), ("identifier", "NOT"), ("scalar", "1,250.50"), ("scalar", ">= 5"), ("scalar", "12"),
        ("scalar", "14"), ("scalar", "20"), ("scalar", "3"), ("unit", "mg/L"), ("unit", "hours"), ("unit", "V"), ("direction", "->"), ("qualifier", "held"), ("qualifier", "within"), ("qualifier", "NOT"), ("qualifier", "final"),
    }
    for s in one(spark, said, literals.signal_spans):
        assert s.kind == "unit" or said[s.start : s.end].strip(" .,;:") == s.value
    assert one(spark, "a few days later", literals.signal_spans) == [] and one(spark, None, literals.signal_spans) == []


@pytest.mark.parametrize("kind,value,forms", [
    ("scalar", ">= 1,250.50", [">= 1,250.50", ">=1250.50", ">=1250.5", ">= 1250.50", ">= 1250.5", "≥1250.50", "≥ 1250.50"]),
    ("scalar", "1.50e3", ["1.50e3", "1500"]), ("scalar", "-007", ["-007", "-7", "- 007", "- 7"]), ("scalar", "2.5E-3", ["2.5E-3", "0.0025"]), ("scalar", "12,34", ["12,34"]),
    ("date", "Mar 5, 2024", ["Mar 5, 2024", "2024-03-05", "5 Mar 2024", "05 Mar 2024", "5 March 2024", "Mar 5 2024", "March 5 2024", "5 Mar", "05 Mar", "5 March", "Mar 5", "March 5"]),
    ("time", "09:30 UTC", ["09:30 UTC", "9:30 UTC"]), ("unit", "ug/L", ["ug/L", "µg/L", "μg/L"]), ("identifier", "A-1/b-2", ["A-1/b-2", "A-1 / b-2", "A 1/b-2", "A-1/b 2", "A 1/b 2"]),
    ("identifier", "a-b-c-d-e-f1", ["a-b-c-d-e-f1"]), ("qualifier", "Hold", ["Hold", "held", "on hold", "not released", "blocked"]), ("direction", "→", ["→", "->", ">"]),
])
def test_forms_of_literals(spark, kind, value, forms):
    assert one(spark, value, lambda c: literals.signal_forms(F.lit(kind), c)) == forms


def test_form_marks(spark):
    marks = {"[ x ] A": "checked a", "[] A": "unchecked a", "[ / ] A": "disabled a", "[crossed box: Phone]": "crossed out phone", "~~gone~~": "crossed out gone", "not  checked": "unchecked", "knot checked": "knot checked", "[✓]": "checked"}
    for raw, plain in marks.items():
        assert one(spark, raw, text.form_text) == plain


def test_negation(spark):
    free = ("not only cheap, never dear ", "it is not only never ", "not here, but ", "nothing ", "not " + "word " * 17)
    denied = ("it is not ", "never a-b c ", "cannot ", "it isn't ", "not only. It is not ", "not only cheap but never ", "not " + "word " * 16, "not " + "a-b-c " * 16)
    assert [one(spark, x, text.is_negated) for x in free] == [False] * len(free)
    assert [one(spark, x, text.is_negated) for x in denied] == [True] * len(denied)


def test_html_grows_with_its_length(spark):
    """Twice the entities take about twice the time; each is decoded once."""
    assert one(spark, "a&amp;lt;b &#x41;&#66; &bogus; & &; &#xD800;c<br/>d", text.html_text) == "a&lt;b AB & &; c d"
    times = {}
    for n in (2_000, 8_000):
        df = spark.createDataFrame([("x &amp; y" * n,)] * 8, "x string").repartition(1).cache()
        df.count()
        start = time.time()
        assert df.select(F.sum(F.length(text.html_text(F.col("x"))))).first()[0] == 8 * (5 * n)
        times[n] = time.time() - start
    assert times[8_000] < 10 * max(times[2_000], 0.2)


def test_aliases_lose_none(spark):
    r = random.Random(5)
    parts = ["total", "market", "segment", "alpha", "beta", "gamma delta", "supplier", "north", "sensor", "12", "7", "3.5", "0042", "ß", "Москва", "a", "net", "value", "of"]
    names = {"", "x"}
    for _ in range(120):
        name = " ".join(r.choice(parts) for _ in range(r.randint(1, 6)))
        names.add(name)
        chars = list(name)
        for _ in range(r.randint(1, 3)):
            i = r.randrange(len(chars))
            chars[i : i + r.randint(0, 1)] = r.choice(["", "a", "1", " ", "xy"])
        names.add("".join(chars).strip())
    df = spark.createDataFrame([(1, n) for n in names], "k int, name string")
    every = df.select(F.col("name").alias("a")).crossJoin(df.select(F.col("name").alias("b"))).where(alias_join.is_alias(F.col("a"), F.col("b")))
    got = [(x.left, x.right) for x in alias_join.alias_pairs(df, df, ["k"]).collect()]
    assert set(got) == {(x.a, x.b) for x in every.collect()} and len(got) == len(set(got))


def test_edges_of_a_large_document(spark):
    """Five thousand records and obligations in one document meet by their words, not all by all."""
    n = 5_000
    doc = "\n".join(f"Node{i}a -> Node{i}b" if i % 2 else f"Node{i}b -> Node{i}a" for i in range(n))
    docs = spark.createDataFrame([(1, doc)], "d int, text string")
    rows = [(1, i, role, 0, f"Node{i}{end}") for i in range(n) for role, end in (("source", "a"), ("destination", "b"))]
    terms = spark.createDataFrame(rows, "d int, leaf_id int, role string, group_no int, alternative string")
    got = edges.edge(docs, terms, ["d"]).groupBy("status").count().collect()
    assert {x.status: x["count"] for x in got} == {"correct": n // 2, "incorrect": n // 2}


def test_wide_tables_keep_their_order(spark):
    head = "| " + " | ".join(f"h{i}" for i in range(1_200)) + " |"
    row = "| " + " | ".join(f"v{i}" for i in range(1_200)) + " |"
    docs = spark.createDataFrame([(1, f"{head}\n|{'---|' * 1_200}\n{row}\n{row}")], "d int, text string")
    flat = order.record_sequences(docs, ["d"]).where("seq like 'cells%'").first()
    assert list(flat["values"]) == [f"v{i}" for i in range(1_200)] * 2


def test_values_are_assigned_without_recursion(spark):
    """A chain of two thousand groups in which the last one moves all others."""
    n = 2_000
    chances = [[i, i + 1] if i else [0, 1] for i in range(n)] + [[0]]
    for c, want in ((chances, True), ([[0], [0]], False), ([[1, 0], [0], [1, 2]], True)):
        df = spark.createDataFrame([(c,)], "c array<array<int>>")
        assert df.select(order._can_assign("c")).first()[0] is want


def covers(said, groups):
    events = sorted((i, i + len(a), g) for g, alts in enumerate(groups) for a in alts for i in range(len(said)) if said.startswith(a, i) and not (said[i - 1 : i].isalnum() or said[i + len(a) : i + len(a) + 1].isalnum()))
    best = None
    for i, (start, _, _) in enumerate(events):
        for j in range(i, len(events)):
            if len({g for _, _, g in events[i : j + 1]}) == len(groups):
                end = max(e for _, e, _ in events[i : j + 1])
                if best is None or end - start < best[1] - best[0]:
                    best = (start, end)
                break
    return best


def test_shortest_covers(spark):
    r = random.Random(8)
    groups = [["ant", "ant hill"], ["bee"], ["cat", "hill cat"]]
    said = [" ".join(r.choices(["ant", "bee", "cat", "hill", "dog"], k=r.randint(1, 14))) for _ in range(60)]
    docs = spark.createDataFrame([(i, [1], s, str(i)) for i, s in enumerate(said)], "d int, refs array<int>, text string, unit string")
    terms = docs.select("d", F.lit(1).alias("leaf_id"), F.inline(F.array(*(F.struct(F.lit(g).alias("group_no"), F.lit(a).alias("alternative")) for g, alts in enumerate(groups) for a in alts))))
    leaves = docs.select("d", F.lit(1).alias("leaf_id"), F.lit("x").alias("expectation"))
    got = {x.d: (x.start, x.end) for x in lexical.compact_cover(docs, terms, leaves, ["d"]).collect()}
    assert got == {i: c for i, s in enumerate(said) if (c := covers(s, groups))}


def test_policies_must_guarantee_literals(spark):
    leaves = spark.createDataFrame([(1, 1, "lexical", "Values 96 and 98 on 2024-01-05"), (1, 2, "directed_edge", "1 -> 2 is open"), (1, 3, "form_state", "Box is checked")], "c int, leaf_id int, kind string, expectation string")
    rows = [(1, 1, "allOf", 0, "96"), (1, 1, "allOf", 0, "98"), (1, 1, "allOf", 1, "2024-01-05"), (1, 1, "allOf", 1, "January 05"), (1, 2, "source", 0, "1"), (1, 2, "destination", 0, "2"), (1, 2, "relation", 0, "outstanding"), (1, 3, "label", 0, "Box"), (1, 3, "state", 0, "checked")]
    terms = spark.createDataFrame(rows, "c int, leaf_id int, role string, group_no int, alternative string")
    got = {(x.leaf_id, x.value, x.reason.split(":")[0]) for x in authoring.policy_violations(leaves, terms, ["c"]).collect()}
    assert got == {(1, "96", "optional"), (1, "98", "optional")}


def test_terms_for_statements_that_name_none(spark):
    leaves = spark.createDataFrame([(1, 1, "The northern pumphouse feeds basin-seven and the pump"), (1, 2, "It is so."), (1, 3, None)], "c int, leaf_id int, expectation string")
    got = {}
    for x in authoring.evidence_groups(leaves, ["c"]).collect():
        got.setdefault(x.leaf_id, {})[x.group_no] = x.alternatives
    assert [got[1][i][0] for i in sorted(got[1])] == ["basin-seven", "pumphouse", "northern"] and got[2] == {0: ["It is so"]}


def test_gold_phrases_have_letters_edges(spark):
    held = lambda body, member: not [x for x in gold_audit.closed_world_violations(
        spark.createDataFrame([(1, "r", "S", "mention", [member])], "c int, region_id string, section string, scope string, members array<string>"), spark.createDataFrame([], "c int, region_id string, leaf_id string, claim_id string"),
        spark.createDataFrame([(1, "S", body)], "c int, section string, body string"), ["c"]).collect()]
    assert held("the É-7 unit", "é-7") and not held("caféÉ unit", "é") and held("a*b c", "a b") and not held("x", "")


def test_facts_keep_their_bindings(spark):
    policy = '{"type": "ordered_tokens", "tokens": [["a"], ["b", "c"]], "requiredBindings": [[["a"], ["x"]], [["b"]]]}'
    row = f'{{"id": "P1", "regions": [{{"id": "r", "budget": 1, "leaves": [{{"id": "l", "evidencePolicy": {policy}}}]}}]}}'
    df = spark.createDataFrame([(row,)], "j string").select(F.from_json("j", facts.FACTS).alias("f")).select("f.*")
    got = sorted((x.role, x.binding_no, x.group_no, x.alternative) for x in facts.leaf_terms(facts.leaves(facts.regions(df))).collect())
    assert got == [("requiredBindings", 0, 0, "a"), ("requiredBindings", 0, 1, "x"), ("requiredBindings", 1, 0, "b"), ("tokens", 0, 0, "a"), ("tokens", 0, 1, "b"), ("tokens", 0, 1, "c")]


def test_locators_of_one_case(spark):
    """Two thousand rows of one column overlap only where rows may mean one another; doubles all do."""
    n = 2_000
    rows = [(1, i, "row", 0, f"Supplier {i:09d}") for i in range(n)] + [(1, n + i, "row", 0, f"Supplier {i:09d} total") for i in range(3)] + [(1, n + 10, "row", 0, "Twin"), (1, n + 11, "row", 0, "Twin")]
    rows += [(c, i, "column", 0, "Nation") for c, i, *_ in rows]
    terms = spark.createDataFrame(rows, "case_id int, leaf_id int, role string, group_no int, alternative string")
    leaves = terms.select("case_id", "leaf_id").distinct().withColumn("kind", F.lit("table_binding"))
    got = sorted(x.leaf_id for x in evaluate.locator_overlaps(leaves, terms).collect())
    assert got == [0, 1, 2, n, n + 1, n + 2, n + 10, n + 11]
