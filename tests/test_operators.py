"""Small known answers for parsers, gates, pages and scores."""

import pytest
from pyspark.sql import functions as F

from attestra.functions import signals, text
from attestra.operators import bindings, closed_world, edges, evidence, gates, lines, members, scoring, tables
from attestra.sources import facts


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("raw", "plain"),
    [("Speed–Test  12kg", "speed-test 12 kg"), ("A→B | *c*", "a->b . c"), ("NODE-A \\rightarrow NODE-B", "node-a -> node-b"), ("40°C", "40 c"), ("", "")],
)
def test_normal_form(spark, raw, plain):
    assert one(spark, raw, text.normalize_evidence) == plain


def test_normal_forms_differ(spark):
    assert one(spark, "ﬁve²x|", text.normalize_audit) == "five 2 x"
    assert one(spark, "Straße–9", text.normalize_authoring) == "strasse-9"


def test_phrase_needs_its_edges(spark):
    assert one(spark, "state is go.", lambda c: text.has_phrase(c, "go"))
    assert not one(spark, "state is gone", lambda c: text.has_phrase(c, "go"))
    assert one(spark, "is not yet ", text.is_negated) and not one(spark, "not this; but it is ", text.is_negated)


def test_rounding_and_rank(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(text.round_half_up(F.col("x"))).collect()] == [-2.0, 3.0]
    refs = spark.createDataFrame([([9, 10],), ([10, 11],)], "r array<int>")
    assert refs.select(F.min_by("r", text.evidence_rank(F.col("r")))).first()[0] == [10, 11]  # "10,11" is before "9,10"


def test_tables_round_trip_and_skip_ahead(spark):
    doc = "| a | b |\n|---|---|\n| 1 | x\\|y |\n| 2 |  |\n| c | d | e |\n<table><tr><th>k</th><th>v</th></tr>\n<tr><td>1</td><td>&amp;<b>z</b></td></tr></table>"
    rows = tables.table_cells(spark.createDataFrame([(1, doc), (2, None), (3, "")], "d int, text string"), ["d"]).collect()
    assert {(r.kind, r.header, r.ref, r.cell) for r in rows} == {("md", "a", 3, "1"), ("md", "b", 3, "x|y"), ("md", "a", 4, "2"), ("md", "b", 4, ""), ("html", "k", 7, "1"), ("html", "v", 7, "& z")}


def test_binding_conflict_beats_match(spark):
    docs = spark.createDataFrame([(1, "| M | Sample A |\n|---|---|\n| Viscosity | 87 |\n| Viscosity | 91 |\n| Density | 1.0 |\n| Colour | dark |")], "d int, text string")
    leaves = spark.createDataFrame([(1, 1, "Viscosity", "Sample A", "87"), (1, 2, "Density", "Sample A", "1.0"), (1, 3, "Colour", "Sample A", "dark blue"), (1, 4, "Mass", "Sample A", "3")], "d int, leaf_id int, row_key string, column string, value string")
    got = {r.leaf_id: r.status for r in gates.table_binding(tables.table_cells(docs, ["d"]), leaves, ["d"]).collect()}
    assert got == {1: "incorrect", 2: "correct", 3: "missing", 4: "missing"}


def test_edges_chain_and_reverse(spark):
    rows = spark.createDataFrame([(1, 1, "NODE-A \\rightarrow NODE-B → NODE-C"), (1, 2, "X <- Y")], "d int, ref int, raw string")
    assert {(r.source, r.destination) for r in gates.edges(rows, ["d"]).collect()} == {("node-a", "node-b"), ("node-b", "node-c"), ("y", "x")}


def test_forms(spark):
    rows = spark.createDataFrame([(1, 1, "[x] Valve open; [ ] Pump on"), (1, 2, "Motor ran ~~twice~~")], "d int, ref int, raw string")
    leaves = spark.createDataFrame([(1, 1, "Valve open", "checked"), (1, 2, "Pump on", "checked"), (1, 3, "Fan", "checked")], "d int, leaf_id int, label string, state string")
    assert {r.leaf_id: r.status for r in gates.form_state(rows, leaves, ["d"]).collect()} == {1: "correct", 2: "incorrect", 3: "missing"}


def pages(spark, doc, n):
    rows = lines.candidate_lines(spark.createDataFrame([(1, n, doc)], "d int, n_pages int, text string"), ["d", "n_pages"])
    return [r.page for r in lines.page_map(rows, ["d", "n_pages"]).orderBy("ref").collect()]


def test_pages_from_marks(spark):
    # A block ends after its rule, so the rule is still the page's.
    assert pages(spark, "PAGE 1\na\nPAGE 3\nb\n---\nc", 4) == [1, None, 3, 3, 3, None]
    assert pages(spark, "Page: 1\na\nPAGE 1\nb\n## PAGE 2\nc", 2) == [1, 1, 1, 1, 2, 2]
    assert pages(spark, "PAGE 2\na\nPAGE 1\nb", 2) == [None] * 4
    assert pages(spark, "a\nb", 3) == [None, None]


def test_pages_from_footers(spark):
    block = "\n".join("abcdefg")
    assert pages(spark, f"{block}\n1/3\n---\n{block}\n2/3\n---\n{block}\n3 / 3", 9) == [1] * 8 + [2] * 9 + [3] * 9
    # A gap leaves its lines without a page.
    assert pages(spark, f"{block}\n1/4\n---\n{block}\n3/4\n---\n{block}\n4/4", 9) == [1] * 8 + [None] * 9 + [4] * 9


def test_pages_from_blocks(spark):
    assert pages(spark, "a\n---\nb\n***\nc", 3) == [1, 1, 2, 2, 3]
    assert pages(spark, "a\n---\nb PAGE\nPAGE 2\n***\nc", 3) == [1, 1, 2, 2, 2, 3]
    assert pages(spark, "a\n---\nPAGE 3\n***\nc", 3) == [None] * 5


def test_empty_lines_stay(spark):
    rows = lines.candidate_lines(spark.createDataFrame([(1, "a\r\n\n")], "d int, text string"), ["d"]).orderBy("ref").collect()
    assert [(r.ref, r.raw) for r in rows] == [(1, "a"), (2, ""), (3, "")]


def test_members(spark):
    known = spark.createDataFrame([(1, "Red lantern"), (1, "Blue lantern 12")], "s int, member string")
    seen = spark.createDataFrame([(1, "red Lantern"), (1, "Red lanterm"), (1, "Blue lantern 13"), (2, "Red lantern")], "s int, member string")
    assert {(r.s, r.member) for r in members.invented(seen, known, ["s"]).collect()} == {(1, "Blue lantern 13"), (2, "Red lantern")}


def test_scores_are_signed_until_the_case(spark):
    leaves = spark.createDataFrame([(1, "incorrect", 2), (1, "missing", 1), (2, "correct", 1)], "r int, status string, harm int")
    claims = spark.createDataFrame([(2, 1)], "r int, n_claims int")
    rows = scoring.region_scores(leaves, claims, ["r"]).withColumns({"budget": F.lit(2), "c": F.lit(0)})
    assert {r.r: round(r.ratio, 4) for r in rows.collect()} == {1: -0.3333, 2: 0.0}
    assert scoring.case_scores(rows, ["c"]).first().score == 0.0


def test_cost_clamps(spark):
    usage = {"input": F.lit(100), "cached": F.lit(150), "written": F.lit(50), "output": F.lit(None).cast("int")}
    price = {"input": F.lit(2.0), "cached": F.lit(1.0), "written": F.lit(None).cast("double"), "output": F.lit(8.0)}
    assert spark.range(1).select(scoring.cost(usage, price)).first()[0] == pytest.approx(100e-6)


def test_merge_is_stable(spark):
    leaves = spark.createDataFrame([(1, "directed_edge"), (2, "table_binding"), (3, "lexical")], "i int, kind string")
    judged = spark.createDataFrame([(1, 0, "correct", 1), (2, 1, "incorrect", 1), (2, 0, "correct", 1), (3, 0, "correct", 0)], "i int, at int, status string, n_refs int")
    evidence = spark.createDataFrame([(1, True, True, False, False), (2, True, False, False, False)], "i int, satisfied boolean, contradiction boolean, partial boolean, near boolean")
    once = scoring.merged_status(leaves, judged, evidence, ["i"])
    assert {r.i: r.status for r in once.collect()} == {1: "incorrect", 2: "correct", 3: "missing"}
    again = scoring.merged_status(leaves, once.select("i", F.lit(0).alias("at"), "status", F.lit(1).alias("n_refs")), evidence, ["i"])
    assert sorted(once.collect()) == sorted(again.collect())


def test_numeric_aliases(spark):
    assert one(spark, "25070.50", signals.numeric_alternatives) == ["25070.50", "25070.5", "25,070.5"]


def test_facts_and_violations(spark, tmp_path):
    (tmp_path / "facts.json").write_text('{"schemaVersion": 3, "id": "C", "regions": [{"id": "r", "budget": 5, "primaryAxis": "a", "secondaryAxes": ["a"], "leaves": [{"id": "l", "canonicalClaimId": "k", "harm": 1, "evidencePolicy": {"type": "lexical", "allOf": [["x", "y"], ["z"]]}}]}]}')
    df = facts.read_facts(spark, str(tmp_path / "facts.json"))
    assert {r.rule for r in facts.violations(df).collect()} == {"budget", "secondary axes"}
    terms = facts.leaf_terms(facts.leaves(facts.regions(df))).collect()
    assert {(r.role, r.group_no, r.alternative) for r in terms} == {("allOf", 0, "x"), ("allOf", 0, "y"), ("allOf", 1, "z")}


def test_stream_scores_only_new_keys(spark, tmp_path):
    from attestra.streaming.incremental import keyed_candidates, score_new

    (tmp_path / "in").mkdir()
    row = '{"model_id": "m", "case_id": "c", "draw": %d, "prediction": "p"}\n'
    for k, text_ in enumerate((row % 1, row % 1 + row % 2)):
        (tmp_path / "in" / f"{k}.json").write_text(text_)
        q = score_new(keyed_candidates(spark, str(tmp_path / "in")), lambda df: df.withColumn("score", F.lit(1.0)), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    assert sorted(r.draw for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


TERM = "d int, leaf_id int, group_no int, alternative string"


def test_lexical_polarity(spark):
    docs = spark.createDataFrame([(1, "Release state is GO. It does not close unrelated item Z-9."), (2, "Release state is not GO.")], "d int, text string")
    terms = spark.createDataFrame([(d, 1, g, a) for d in (1, 2) for g, a in enumerate(("Release state", "GO"))], TERM)
    leaves = spark.createDataFrame([(1, 1, "Release state is GO"), (2, 1, "Release state is GO")], "d int, leaf_id int, expectation string")
    u = evidence.units(docs, ["d"])
    assert {r.d for r in evidence.lexical(u, terms, leaves, ["d"]).collect()} == {1}
    denied = leaves.withColumn("expectation", F.lit("Release state is not GO"))
    assert {r.d for r in evidence.lexical(u, terms, denied, ["d"]).collect()} == {1, 2}


def test_bindings_need_one_unit(spark):
    docs = spark.createDataFrame([(1, "Pump A runs; pump B stops.\n| Unit | State |\n|---|---|\n| Pump C | idle |")], "d int, text string")
    rows = [(1, 1, 0, 0, "pump a"), (1, 1, 0, 1, "runs"), (1, 2, 0, 0, "pump c"), (1, 2, 0, 1, "state"), (1, 2, 0, 2, "idle"), (1, 3, 0, 0, "pump c"), (1, 3, 0, 1, "stops")]
    wanted = spark.createDataFrame(rows, "d int, leaf_id int, binding_no int, group_no int, alternative string")
    got = {r.leaf_id: r.refs for r in evidence.required_bindings(evidence.units(docs, ["d"]), wanted, ["d"]).collect()}
    assert got == {1: [1], 2: [2, 4]}


def test_citations_are_recovered(spark):
    rows = lines.candidate_lines(spark.createDataFrame([(1, "alpha 7\n\nbeta\ngamma\nalpha 7 beta")], "d int, text string"), ["d"])
    terms = spark.createDataFrame([(1, 1, 0, "alpha"), (1, 1, 1, "7"), (1, 1, 2, "beta"), (1, 2, 0, "beta"), (1, 2, 1, "gamma")], TERM)
    got = {r.leaf_id: (r.matched, r.refs) for r in evidence.recovered_citations(rows, terms, ["d"]).collect()}
    assert got == {1: (3, [5])}  # two groups without digits are too few


def test_ordered_tokens(spark):
    docs = spark.createDataFrame([(1, "Third step, second step, first step."), (2, "First, then second and third")], "d int, text string")
    terms = spark.createDataFrame([(d, 1, g, a) for d in (1, 2) for g, a in enumerate(("First", "second", "third"))], TERM)
    assert {r.d: r.in_order for r in evidence.ordered_tokens(docs, terms, ["d"]).collect()} == {1: False, 2: True}


def test_visual_citations(spark):
    rows = lines.candidate_lines(spark.createDataFrame([(1, "## Room 12\ndoor on the left wall\nsomething else")], "d int, text string"), ["d"])
    cited = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 3)], "d int, leaf_id int, ref int")
    terms = spark.createDataFrame([(1, 1, 0, "west"), (1, 1, 1, "Room 12"), (1, 2, 0, "Room 12"), (1, 3, 0, "Room 12")], TERM)
    leaves = spark.createDataFrame([(1, 1, "Door of room 12 is west"), (1, 2, "Door of room 12 is west"), (1, 3, "Room 12"), (1, 4, "x")], "d int, leaf_id int, expectation string")
    got = {r.leaf_id: r.anchored for r in evidence.visual_citations(rows, cited, terms, leaves, ["d"]).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def obligations(spark, rows):
    """(leaf_id, row, column, value) as terms of document 1; a tuple as row: its parts."""
    terms = []
    for leaf, row, column, value in rows:
        parts = row if isinstance(row, tuple) else ()
        terms += [(1, leaf, "row", 0, row)] if not parts else [(1, leaf, "rowParts", g, p) for g, p in enumerate(parts)]
        terms += [(1, leaf, "column", 0, column), (1, leaf, "value", 0, value)]
    return spark.createDataFrame(terms, "d int, leaf_id int, role string, group_no int, alternative string")


def bound(spark, doc, rows):
    docs = spark.createDataFrame([(1, doc)], "d int, text string")
    return {r.leaf_id: (r.status, r.partial, r.refs) for r in bindings.binding(docs, obligations(spark, rows), ["d"]).collect()}


def test_binding_in_plain_columns_and_lists(spark):
    assert bound(spark, "Metric | Sample A | Sample B\n- Viscosity | 87 | 91", [(1, "Viscosity", "Sample A", "87"), (2, "Viscosity", "Sample B", "87")]) == {1: ("correct", False, [1, 2]), 2: ("incorrect", False, [1, 2])}
    doc = "Control | Value | Interpretation\n- Base committed cost: $25,070 (implementation and validation)"
    assert bound(spark, doc, [(1, "Base committed cost", "Value", "$25,070"), (2, "Base committed cost", "Owner", "x")]) == {1: ("correct", False, [2]), 2: ("missing", False, None)}


def test_binding_in_prose_yields_to_tables(spark):
    doc = "For pump A the state is idle; pump B flow was 7.\n| Unit | Line | Flow |\n|---|---|---|\n| Pump B | 2 | 7 |\n| Pump C | 3 | dark |"
    want = [(1, "pump A", "state", "idle"), (2, "pump A", "state", "running"), (3, "Pump B", "Flow", "7"), (4, ("Pump C", "3"), "Flow", "dark blue"), (5, "Pump B", "Line", "9")]
    got = bound(spark, doc, want)
    assert {k: v[:2] for k, v in got.items()} == {1: ("correct", False), 2: ("incorrect", False), 3: ("correct", False), 4: ("missing", True), 5: ("incorrect", False)}


def test_near_binding(spark):
    doc = "| Unit | Admin state |\n|---|---|\n| Pump A | on |\n## Pump B\n- State: off"
    terms = obligations(spark, [(1, "Pump A", "Administrative state code", "x"), (2, "Pump B", "State", "x"), (3, "Pump C", "State", "x")])
    got = bindings.near_binding(spark.createDataFrame([(1, doc)], "d int, text string"), terms, ["d"])
    assert {r.leaf_id: r.refs for r in got.collect()} == {1: [1, 3], 2: [4, 5]}


def edge_status(spark, doc, rows, **more):
    roles = ("source", "destination", "relation", "identifier")
    terms = [(1, n, role, 0, value) for n, row in enumerate(rows, 1) for role, value in zip(roles, row) if value]
    terms = spark.createDataFrame(terms, "d int, leaf_id int, role string, group_no int, alternative string")
    return [r.status for r in edges.edge(spark.createDataFrame([(1, doc)], "d int, text string"), terms, ["d"], **more).orderBy("leaf_id").collect()]


def test_edges_in_sentences(spark):
    assert edge_status(spark, "### Directed links\nNODE-A \\rightarrow NODE-B \\rightarrow NODE-C", [("NODE-A", "NODE-B"), ("NODE-C", "NODE-B"), ("NODE-A", "NODE-D")]) == ["correct", "incorrect", "missing"]
    doc = "NODE-A receives data from NODE-B. The tank does not feed the pump."
    assert edge_status(spark, doc, [("NODE-A", "NODE-B", "data"), ("NODE-B", "NODE-A", "data"), ("NODE-B", "NODE-A", "steam"), ("tank", "pump")]) == ["incorrect", "correct", "missing", "incorrect"]


def test_edges_in_fields_and_tables(spark):
    doc = "Source: Mill\nDestination: Silo\nSource: Silo\nDestination: Port\n| From | To | Label | Edge |\n|---|---|---|---|\n| Port | Ship | loads | E 7 |"
    assert edge_status(spark, doc, [("Mill", "Silo"), ("Port", "Silo"), ("Port", "Ship", "loads", "E 7"), ("Port", "Ship", "loads", "E 8")]) == ["correct", "incorrect", "correct", "missing"]


def test_edges_joined_by_identifier(spark):
    doc = "E 4: carries steam\nBoiler -> Turbine, E 4"
    assert edge_status(spark, doc, [("Boiler", "Turbine", "carries steam", "E 4"), ("Boiler", "Turbine", "carries oil", "E 4")]) == ["correct", "missing"]
    doc = "E 5: feeds\nThe Boiler outlet E 5 enters the northern culvert channel.\nThe northern culvert runs to the Basin."
    assert edge_status(spark, doc, [("Boiler", "Basin", "feeds", "E 5")]) == ["missing"]
    assert edge_status(spark, doc, [("Boiler", "Basin", "feeds", "E 5")], semantic=True) == ["correct"]


def test_invented_rows_need_their_scope(spark):
    table = "\n\n| Seq | Color | State |\n|---|---|---|\n| 1 | Red | ready |\n| 2 | Blue | held |\n| 3 | Green | pending |\n| 4 | Teal |  |"
    docs = spark.createDataFrame([(1, "## Color register" + table), (2, "## Other register" + table)], "d int, text string")
    regions = spark.createDataFrame([(d, "r", ["Color register"], ["Red", "Blue"], ["State"]) for d in (1, 2)], "d int, region_id string, labels array<string>, members array<string>, columns array<string>")
    found = closed_world.invented_rows(docs, regions, ["d"])
    assert {(r.d, r.key, r.claim, r.ref) for r in found.collect()} == {(1, "Green", "3 | Green | pending", 7), (1, "Teal", "4 | Teal | ", 8)}


def test_claims_are_counted_once(spark):
    kind = "d int, region_id string, key string"
    reported, found = spark.createDataFrame([(1, "r", "Green")], kind), spark.createDataFrame([(1, "r", "green"), (1, "r", "Pink"), (1, "r", "Grey")], kind)
    members = spark.createDataFrame([(1, "s", "pink"), (1, "r", "grey")], "d int, region_id string, member string")
    assert {(r.region_id, r.key) for r in closed_world.applied_claims(reported, found, members, ["d"]).collect()} == {("r", "Green"), ("r", "Grey")}


def test_aliases(spark):
    rows = spark.createDataFrame([("room 12", "room 13", False), ("room", "room 13", True), ("north pump house", "north house", True), ("a 1 2 x", "b 1 2 x", True), ("red", "blue", False)], "a string, b string, want boolean")
    assert [r[0] == r[1] for r in rows.select(closed_world.is_alias(F.col("a"), F.col("b")), "want").collect()] == [True] * 5


def test_audit_batches(spark):
    rows = [(1, f"r{i}", i, m) for i, m in enumerate((200, 50, 10, 300, 1))] + [(2, f"r{i}", i, 1) for i in range(25)]
    got = scoring.audit_batches(spark.createDataFrame(rows, "c int, region_id string, pos int, members int"), ["c"]).collect()
    assert [r.batch for r in sorted(got, key=lambda r: r.region_id) if r.c == 1] == [0, 0, 1, 2, 3]
    assert sum(r.batch == 1 for r in got if r.c == 2) == 1


def test_precredits(spark):
    leaves = spark.createDataFrame([(1, 1, "form_state", "state", True), (1, 2, "form_state", "state", False), (1, 3, "lexical", "value", True), (1, 4, "ordered_tokens", "structure", True), (1, 5, "form_state", "state", True)], "c int, leaf_id int, kind string, claim string, unique_evidence boolean")
    found = spark.createDataFrame([(1, i, "correct", [1], i != 4) for i in range(1, 6)], "c int, leaf_id int, status string, refs array<int>, on_page boolean")
    alike = spark.createDataFrame([(1, 5, 9)], "c int, a int, b int")
    assert [r.leaf_id for r in scoring.precredits(leaves, found, alike, ["c"]).collect()] == [1]
