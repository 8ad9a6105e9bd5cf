"""Tables' obligations, covers of pages, cached draws, and streams that go on past rows that can't be scored."""

import json
import random

from pyspark.sql import functions as F

from attestra.functions import signals
from attestra.operators import builders, constraints, scoring
from attestra.sources import draws, facts, facts_rules
from attestra.streaming import incremental

ROWS = [("Alpha One", "1,200", "x"), ("Beta", "7", "y")]
HEADS = ("Site", "Load", "Note")


def cells(spark, rows=ROWS):
    return spark.createDataFrame([("c", "r", i, j, HEADS[j], v) for i, row in enumerate(rows) for j, v in enumerate(row)], "c string, region_id string, row_no int, col int, header string, cell string")


def table(spark, schema, *rows):
    return spark.createDataFrame([("c", "r", *x) for x in rows], "c string, region_id string, " + schema)


def test_obligations_of_a_table(spark):
    leaves, terms, refused = builders.table_obligations(
        cells(spark), ["c"], row_aliases=table(spark, "row_key string, alias string", ("Beta", "B")), column_aliases=table(spark, "header string, alias string", ("Load", "Weight")),
        value_aliases=table(spark, "row_key string, header string, alias string", ("Beta", "Load", "seven")), row_parts=table(spark, "row_key string, part_no int, alias string", ("Alpha One", 0, "Alpha"), ("Alpha One", 1, "One"), ("Alpha One", 1, "1")),
        skipped=table(spark, "header string", ("Note",)), consequential=table(spark, "row_key string, header string", ("Beta", "Load")),
    )
    got = {x.leaf_id: x for x in leaves.collect()}
    assert sorted(got) == ["r.alpha-one.load", "r.beta.load", "r.row-order", "r.schema"]
    assert {k: x.harm for k, x in got.items()} == {"r.alpha-one.load": 1, "r.beta.load": 2, "r.row-order": 1, "r.schema": 1}
    assert (got["r.schema"].claim, got["r.row-order"].claim, got["r.beta.load"].claim) == ("structure", "ordered_record", "table_binding")
    assert got["r.row-order"].expectation.endswith("Alpha One -> Beta.") and got["r.schema"].expectation.endswith("Site, Load, Note.")
    said = {}
    for x in terms.collect():
        said.setdefault((x.leaf_id, x.role, x.group_no), set()).add(x.alternative)
    assert said["r.schema", "tokens", 1] == {"Load", "Weight"} and said["r.row-order", "tokens", 1] == {"Beta", "B"} and said["r.row-order", "tokens", 0] == {"Alpha One"}
    assert said["r.alpha-one.load", "value", 0] >= {"1,200", "1200"} and said["r.beta.load", "value", 0] == {"7", "seven"} and said["r.beta.load", "column", 0] == {"Load", "Weight"}
    assert said["r.alpha-one.load", "rowParts", 1] == {"One", "1"} and ("r.beta.load", "rowParts", 0) not in said and refused.count() == 0


def test_refused_tables(spark):
    parts = table(spark, "row_key string, part_no int, alias string", ("A", 0, "x  Y"), ("B", 0, "X y"), ("C", 0, "z"), ("Gone", 0, "q"))
    _, _, refused = builders.table_obligations(cells(spark, [("A", "1", ""), ("B", "2", ""), ("C", "3", ""), ("c!", "4", "")]), ["c"], row_parts=parts)
    assert sorted((x.rule, x.subject) for x in refused.collect()) == [("id repeats", "r.c.load"), ("id repeats", "r.c.note"), ("parts of no row", "Gone"), ("rows share their parts", "A, B")]
    leaves, terms, refused = builders.table_obligations(cells(spark).where("false"), ["c"])
    assert leaves.count() == terms.count() == refused.count() == 0


def test_page_cover_against_pages_one_by_one(spark):
    rng = random.Random(5)
    n = {c: rng.randrange(0, 9) for c in range(60)}
    ranges = [(c, rng.choice("abc"), a, a + rng.randrange(-1, 5)) for c in range(60) for a in (rng.randrange(-2, 11) for _ in range(rng.randrange(0, 5)))] + [(99, "a", 1, 2)]
    got = constraints.page_cover(spark.createDataFrame(ranges, "c int, modality string, first int, last int"), spark.createDataFrame(list(n.items()), "c int, n_pages int"), ["c"]).collect()
    seen = [(x.c, p, x.problem) for x in got for p in range(x.first, x.last + 1)]
    want = set()
    for c in (*n, 99):
        for p in range(-5, 20):
            times = sum(a <= p <= b for k, _, a, b in ranges if k == c)
            if not 1 <= p <= n.get(c, 0):
                want |= {(c, p, "outside")} if times else set()
            elif times != 1:
                want.add((c, p, "given twice" if times else "missing"))
    assert set(seen) == want and len([x for x in seen if x[2] != "outside"]) == len([x for x in want if x[2] != "outside"])


def test_batches_go_on_in_a_region(spark):
    leaves = spark.createDataFrame([("c", 0, i, "r", f"a{i}") for i in range(70)] + [("c", 1, i, "s", f"b{i}") for i in range(3)], "c string, region_no int, leaf_no int, region_id string, leaf_id string")
    settled = spark.createDataFrame([("c", f"a{i}") for i in range(40)], "c string, leaf_id string")
    got = sorted(scoring.semantic_batches(leaves, ["c"], settled).collect(), key=lambda x: (x.batch, x.request))
    assert [(x.batch, x.request, len(x.leaf_ids), [tuple(r) for r in x.regions]) for x in got] == [(0, 0, 24, [("r", 0, 64)]), (1, 0, 9, [("r", 64, 6), ("s", 0, 3)])]
    assert got[1].leaf_ids == [f"a{i}" for i in range(64, 70)] + ["b0", "b1", "b2"]
    assert [x.request for x in sorted(scoring.semantic_batches(leaves, ["c"]).where("batch = 0").collect(), key=lambda x: x.request)] == [0, 1]


def test_keys_tell_every_part(spark):
    df = spark.createDataFrame([("p", "f")], "p string, f string")
    key = lambda mode, tokens: df.select(signals.inference_key(F.lit(2), F.lit(mode), F.col("f"), F.col("p"), signals.configured_model(F.lit("m"), F.lit("n"), F.lit("x"), F.lit(None).cast("string"), F.lit(None).cast("string"), tokens))).first()[0]
    assert len({key("a", F.lit(5)), key("b", F.lit(5)), key("a", F.lit(6))}) == 3 and key("a", F.lit(None).cast("int")) == key("a", F.lit(60_000))


def test_draws_of_a_folder(spark, tmp_path):
    root = tmp_path / "cache"
    for place, files in {"m/c": {"prediction.md": "one", "inference.json": '{"cacheKey": "i"}', "notes.md": "x"}, "m/c/draws/002": {"prediction.md": "two", "score.json": "{broken"}, "n/draws": {"prediction.md": "x", "score.json": ""}, "n/d/draws/1000": {"score.json": '{"score": 1.5}'}}.items():
        (root / place).mkdir(parents=True)
        for name, text in files.items():
            (root / place / name).write_text(text)
    (root / "stray.md").write_text("x")
    got = {(x.model_id, x.case_id, x.draw): (x.prediction, x.inference and x.inference.cacheKey, x.score and x.score.score) for x in draws.read_draws(spark, str(root)).collect()}
    assert got == {("m", "c", 1): ("one", "i", None), ("m", "c", 2): ("two", None, None), ("n", "draws", 1): ("x", None, None), ("n", "d", 1000): (None, None, 1.5)}
    assert draws.cached_models(spark, str(root), ["n", "m", "z"]) == ["m", "n"] and draws.cached_models(spark, str(tmp_path / "none"), ["m"]) == []
    places = spark.createDataFrame([(1,), (2,), (1000,)], "d int").select(draws.draw_folder(F.lit("m"), F.lit("c"), F.col("d"))).collect()
    assert [x[0] for x in places] == ["m/c", "m/c/draws/002", "m/c/draws/1000"]


def test_draws_as_a_table(spark, tmp_path):
    root = str(tmp_path / "draws")
    schema = "model_id string, case_id string, draw int, key string, at int, prediction string"
    draws.write_draws(spark.createDataFrame([("m", "c", 1, "k1", 1, "old"), ("m", "d", 1, "k2", 1, "d"), ("n", "c", 2, "k3", 1, "n")], schema), root)
    draws.write_draws(spark.createDataFrame([("m", "c", 1, "k4", 2, "new")], schema), root)
    got = {(x.model_id, x.case_id, x.draw): (x.key, x.prediction) for x in draws.latest_draws(spark, root).collect()}
    assert got == {("m", "c", 1): ("k4", "new"), ("m", "d", 1): ("k2", "d"), ("n", "c", 2): ("k3", "n")}
    one = draws.latest_draws(spark, root, ["n"])
    assert [x.prediction for x in one.collect()] == ["n"] and draws.cached_models(spark, root, ["m", "n", "o"]) == ["m", "n"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "model_id" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_stream_goes_on_past_faults(spark, tmp_path):
    """Bad rows are listed, good ones are scored, over a restart too; a case that comes again well is no longer failed."""
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    row = lambda case, text, draw=1: json.dumps({"model_id": "m", "case_id": case, "draw": draw, "prediction": text})
    run = lambda: incremental.score_new(incremental.keyed_candidates(spark, str(src), "_bad"), lambda df: df.select("model_id", "case_id", "draw", F.length("prediction").alias("score")), out, cp, incremental.candidate_fault("_bad")).awaitTermination()
    (src / "1.json").write_text("\n".join((row("a", "good"), row("b", " "), row("c", "text", 0), "{broken", "{broken too", row("", "x"), row("a", "good"))))
    run()
    (src / "2.json").write_text("\n".join((row("b", "now"), row("c", "text", 0), row("a", "good"))))
    run()
    scored, failed = spark.read.parquet(out), spark.read.parquet(incremental.failed_at(out))
    assert sorted((x.case_id, x.score) for x in scored.collect()) == [("a", 4), ("b", 3)]
    assert sorted(x.fault for x in failed.collect()) == ["does not parse"] * 2 + ["no case", "no draw", "no draw", "no text"]
    left = {x.case_id: (x.faults, x.tries) for x in incremental.still_failed(failed, scored, ["model_id", "case_id"]).collect()}
    assert left == {None: (["does not parse"], 2), "": (["no case"], 1), "c": (["no draw"], 2)}


GOOD = {"schemaVersion": 3, "id": "c", "title": "T", "family": "F", "tags": ["x"], "regions": [{
    "id": "r", "label": "R", "sourceAnchors": [{"page": 1, "layer": "mixed", "sectionPath": ["S"]}], "goldSection": "S", "kind": "table", "modality": "mixed", "uniqueEvidence": True, "primaryAxis": "form_state",
    "secondaryAxes": [], "textOnlyRecoverable": False, "budget": 1, "leaves": [{"id": "l", "canonicalClaimId": "k", "claimType": "scalar", "expectation": "The word is plain", "harm": 1, "evidencePolicy": {"type": "lexical", "allOf": [["plain"]]}}],
}]}


FAULTS = [
    ("", {}, []), ("", {"title": None}, ["title differs"]), ("", {"regions": []}, ["no regions", "page is not anchored"]), ("", {"id": "d"}, ["case without facts", "page is not anchored"]),
    ("region", {"sourceAnchors": []}, ["no anchors", "page is not anchored"]), ("region", {"secondaryAxes": None}, ["unknown secondary axes"]), ("region", {"closedWorld": {"scope": "table_rows", "keys": ["a", " "]}}, ["closed world"]),
    ("region", {"textOnlyRecoverable": True, "modality": "native_layer_recovery"}, ["text-only recoverable of its layer"]), ("region", {"leaves": []}, ["no obligations"]), ("anchor", {"page": None}, ["page is not anchored", "page is out of range"]),
    ("anchor", {"bbox": [0, 0, 1, 2]}, ["box"]), ("anchor", {"sectionPath": []}, ["section path"]), ("anchor", {"layer": "paper", "documentPage": 0}, ["document page", "source layer"]), ("leaf", {"claimType": "visual_description"}, ["policy of another claim"]),
    ("leaf", {"evidencePolicy": {"type": "form_state", "label": ["a"], "state": "torn"}}, ["state"]), ("leaf", {"evidencePolicy": {"type": "other"}}, ["policy type"]), ("leaf", {"expectation": "The lot weighs 12"}, ["policy does not keep a scalar"]),
]


def test_rules_for_facts(spark):
    """Each change of good facts breaks the rules that are named with it, and no other; each is a case of its own."""
    made = []
    for i, (where, change, _) in enumerate(FAULTS):
        one = json.loads(json.dumps(GOOD)) | {"id": f"c{i}"}
        region = one["regions"][0]
        {"": one, "region": region, "anchor": region["sourceAnchors"][0], "leaf": region["leaves"][0]}[where].update(change)
        made.append((json.dumps(one),))
    df = spark.createDataFrame(made, "j string").select(F.from_json("j", facts.FACTS).alias("f")).select("f.*")
    cases = spark.createDataFrame([(f"c{i}", "T", "F", ["x"], 1) for i in range(len(FAULTS))], "case_id string, title string, family string, tags array<string>, pages int")
    got = {}
    for x in facts_rules.all_violations(df, cases, cases.select("case_id", F.lit("S").alias("section"))).collect():
        got.setdefault(x.case_id, []).append(x.rule)
    assert {k: sorted(v) for k, v in got.items() if k != "d"} == {f"c{i}": rules for i, (_, _, rules) in enumerate(FAULTS) if rules}
    assert sorted(got["d"]) == ["facts of no case", "gold section has no heading", "page is out of range"]
