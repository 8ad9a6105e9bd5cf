"""Gates with cases worked out by hand: HTML, forms, lexical windows, order, and the plan from texts to scores."""

import pytest
from pyspark.sql import functions as F

from attestra.functions import text as tx
from attestra.operators import evidence, gates, lexical, lines, order, tables
from attestra.plans import evaluate


def terms(spark, rows):
    """(d, leaf_id, groups of alternatives)."""
    flat = [(d, leaf, g, a) for d, leaf, groups in rows for g, alternatives in enumerate(groups) for a in alternatives]
    return spark.createDataFrame(flat, "d int, leaf_id int, group_no int, alternative string")


def test_html_text(spark):
    want = {
        "<td>A</td><td>B</td>": "A B",
        "it&#8217;s": "it’s",
        "&amp;lt;": "&lt;",
        "&AMP; &foo; &apos;": "& '",
        "&#x1F600;": "\U0001f600",
        "&#xD800;|&#99999999999;": "|",
        "a<br / >b &nbsp; c": "a b c",
        "no entity & here": "no entity & here",
    }
    got = spark.createDataFrame([(k,) for k in want], "t string").select("t", tx.html_text(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == want


def test_compatibility_forms(spark):
    got = spark.createDataFrame([("Ｒ１２ ﬁne ²　x",), ("plain",), (None,)], "t string").select(tx.normalize_ascii(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == ["r 12 fine 2 x", "plain", None]


def test_html_cells_have_their_own_lines(spark):
    docs = spark.createDataFrame([(1, "<table><tr><th>Q</th><th>A</th></tr>\n<tr><td>one</td>\n\n<td>t&#119;o</td></tr></table>")], "d int, text string")
    got = tables.table_cells(docs, ["d"]).orderBy("col").collect()
    assert [(r.cell, r.ref, r.row_no, r.header_ref) for r in got] == [("one", 2, 0, 1), ("two", 4, 0, 1)]


FORMS = [
    (1, "[x] Alpha [ ] Beta"),
    (2, "Alpha: checked; Beta: unchecked; Gamma: checked"),
    (3, "Alphabet: checked"),
    (4, "| Alpha | ☑ | Beta | ☐ |"),
    (5, "[ ] Phone [x] Post [ ] Fax"),
    (6, "<table><tr><th>Q</th><th>A</th></tr>\n<tr><td>Alpha</td>\n<td>[x]</td></tr></table>"),
    (7, "~~Alpha~~"),
]
WANTED = [(1, 1, "Alpha", "checked"), (1, 2, "Beta", "checked"), (2, 1, "Gamma", "checked"), (2, 2, "Beta", "unchecked"), (3, 1, "Alpha", "checked"), (4, 1, "Alpha", "checked"), (4, 2, "Beta", "unchecked"), (5, 1, "Fax", "unchecked"), (5, 2, "Post", "checked"), (6, 1, "Alpha", "checked"), (7, 1, "Alpha", "crossed")]


def test_form_segments(spark):
    docs = spark.createDataFrame(FORMS, "d int, text string")
    leaves = spark.createDataFrame(WANTED, "d int, leaf_id int, label string, state string")
    got = {(r.d, r.leaf_id): r for r in gates.form_state(lines.candidate_lines(docs, ["d"]), leaves, ["d"], docs=docs).collect()}
    assert {k for k, r in got.items() if r.status == "incorrect"} == {(1, 2)} and got[3, 1].status == "missing"
    assert sum(r.status == "correct" for r in got.values()) == len(WANTED) - 2 and got[6, 1].refs == [2, 3]


def test_lexical_windows(spark):
    docs = spark.createDataFrame([(1, "Alpha is here.\nNothing. Beta follows\n\ngamma too"), (2, "Alpha is not here. Beta is."), (3, "alpha\n| a | b |\nbeta"), (4, "Alpha. Other\nmiddle\nBeta. Gamma. Delta")], "d int, text string")
    want = terms(spark, [(1, 1, [["alpha"], ["beta"]]), (1, 2, [["alpha"], ["gamma"]]), (1, 3, [["alpha"], ["delta"]]), (1, 4, [["alpha"], ["beta"], ["gamma"]]), (2, 1, [["alpha here", "alpha"], ["beta"]]), (2, 2, [["here"], ["beta"]]), (3, 1, [["alpha"], ["beta"]]), (4, 1, [["alpha"], ["beta"], ["delta"]])])
    leaves = want.select("d", "leaf_id").distinct().withColumn("expectation", F.lit("x"))
    got = {(r.d, r.leaf_id): r.refs for r in lexical.lexical_resolution(docs, want, leaves, ["d"]).collect()}
    assert got == {(1, 1): [1, 2], (1, 2): [1, 4], (1, 3): None, (1, 4): [1, 2, 4], (2, 1): [1], (2, 2): None, (3, 1): None, (4, 1): [1, 2, 3]}
    strict = {(r.d, r.leaf_id): r.refs for r in lexical.strict_lexical(docs, want, leaves, ["d"]).collect()}
    assert strict[1, 4] == [1, 2, 4] and strict[3, 1] == [1, 3] and strict[1, 3] is None


@pytest.mark.parametrize("records", [True, False])
def test_order(spark, records):
    texts = ["# A\n## First\nx\n## Second\n## Third\n", "1. Second\n2. First\n3. Third", "First then third then second", "| Name | Qty |\n| --- | --- |\n| First | 1 |\n| Second | 2 |\n| Third | 3 |", "Third step, second step, first step.", "Name  |  Qty", "fields: qty, name"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d int, text string")
    names, fields = [["first"], ["second"], ["third"]], [["name"], ["quantity"]]
    got = order.ordered_gate(docs, terms(spark, [(d, 1, names if records else fields) for d in range(len(texts))]), ["d"], records)
    state = {r.d: "yes" if r.satisfied else "turned" if r.contradiction else None for r in got.collect()}
    assert state == ({0: "yes", 1: "turned", 2: "turned", 3: "yes", 4: None, 5: None, 6: None} if records else {0: None, 1: None, 2: None, 3: "yes", 4: None, 5: "yes", 6: "turned"})


def test_ordered_tokens_give_lines(spark):
    docs = spark.createDataFrame([(1, "alpha\n\nthen beta\ngamma")], "d int, text string")
    got = evidence.ordered_tokens(docs, terms(spark, [(1, 1, [["alpha"], ["beta"], ["gamma"]]), (1, 2, [["beta"], ["alpha"]])]), ["d"]).orderBy("leaf_id").collect()
    assert [(r.in_order, r.refs) for r in got] == [(True, [1, 3, 4]), (False, None)]


def test_local_bindings_of_visual_evidence(spark):
    docs = spark.createDataFrame([(1, "## Plan\nDoor D3-4 sits in the west wall; pump P1 is elsewhere.")], "d int, text string")
    cited = spark.createDataFrame([(1, i, 2) for i in (1, 2)], "d int, leaf_id int, ref int")
    want = terms(spark, [(1, i, [["D4"], ["west"]]) for i in (1, 2)])
    leaves = spark.createDataFrame([(1, i, "The door is west") for i in (1, 2)], "d int, leaf_id int, expectation string")
    bound = spark.createDataFrame([(1, 1, 0, 0, "door"), (1, 1, 0, 1, "west"), (1, 2, 0, 0, "door"), (1, 2, 0, 1, "pump P1 elsewhere")], "d int, leaf_id int, binding_no int, group_no int, alternative string")
    got = evidence.visual_citations(lines.candidate_lines(docs, ["d"]), cited, want, leaves, ["d"], bindings=bound.where("leaf_id = 1 or group_no = 0"))
    assert {r.leaf_id: r.anchored for r in got.collect()} == {1: True, 2: True}
    far = spark.createDataFrame([(1, 2, 0, 0, "window"), (1, 2, 0, 1, "west")], bound.schema)
    assert {r.leaf_id: r.anchored for r in evidence.visual_citations(lines.candidate_lines(docs, ["d"]), cited, want, leaves, ["d"], bindings=far).collect()} == {1: True, 2: False}


def test_guards(spark):
    """The guard table, one row for each rule."""
    schema = "id int, kind string, claim string, strict boolean, status string, refs array<int>, satisfied boolean, contradiction boolean, partial boolean, near boolean, bound boolean, bound_refs array<int>, anchored boolean, found_refs array<int>"
    row = lambda i, kind, claim, status, strict=False, refs=(1,), sat=False, con=False, part=False, near=False, bound=None, anchored=None, found=(): (i, kind, claim, strict, status, list(refs), sat, con, part, near, bound, [7] if bound else None, anchored, list(found))
    cases = [
        (row(1, "ordered_tokens", "value", "correct", bound=False), "missing"),
        (row(2, "ordered_tokens", "value", "correct", bound=True), "correct"),
        (row(3, "ordered_tokens", "structure", "incorrect"), "missing"),
        (row(4, "ordered_tokens", "structure", "correct", con=True, found=(2,)), "incorrect"),
        (row(5, "ordered_tokens", "ordered_record", "correct"), "missing"),
        (row(6, "qualitative", "visual_description", "correct", anchored=False), "missing"),
        (row(7, "qualitative", "visual_description", "incorrect", anchored=True), "incorrect"),
        (row(8, "lexical", "value", "incorrect", sat=True, found=(1,)), "correct"),
        (row(9, "lexical", "value", "incorrect", sat=True, found=(5,)), "incorrect"),
        (row(10, "lexical", "value", "correct", strict=True), "missing"),
        (row(11, "table_binding", "table_binding", "incorrect"), "missing"),
        (row(12, "table_binding", "table_binding", "correct", part=True, near=True), "missing"),
        (row(13, "table_binding", "table_binding", "correct", near=True), "correct"),
        (row(14, "directed_edge", "directed_edge", "missing", con=True, found=(3,)), "incorrect"),
        (row(15, "directed_edge", "directed_edge", "correct"), "missing"),
        (row(16, "form_state", "form_state", "incorrect"), "incorrect"),
        (row(17, "form_state", "form_state", "correct", refs=()), "missing"),
        (row(18, "form_state", "form_state", None), "missing"),
    ]
    got = {r.id: r for r in evaluate.guarded(spark.createDataFrame([c for c, _ in cases], schema)).collect()}
    assert {i: r.status for i, r in got.items()} == {c[0]: want for c, want in cases}
    assert got[2].refs == [1, 7] and got[4].refs == [2] and got[14].refs == [3] and got[15].refs == []
