"""Plans that keep their shape at size: no broadcasts of computed tables, and no text copied once for each of its words."""

import re

import pytest
from pyspark.sql import functions as F

from attestra.operators import evidence, gates, lines, members, reports, scoring, tables
from attestra.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def _plan(df, which="executedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


@pytest.mark.parametrize("name", ["lexical_polarity", "lexical_cover", "near_binding", "audited_claims", "required_bindings"])
def test_no_computed_table_is_broadcast(spark, name):
    assert "Broadcast" not in _plan(QUERIES[name](spark, DATA))


def test_terms_meet_whole_texts(spark):
    units = spark.createDataFrame([(1, 1, "red fox and the red hen"), (1, 2, "a hen"), (2, 1, "fox")], "doc int, unit int, text string")
    terms = spark.createDataFrame([(1, 1, 0, "red hen"), (1, 1, 1, "fox"), (1, 2, 0, "-"), (2, 3, 0, "hen")], "doc int, leaf_id int, group_no int, alternative string")
    hits = evidence.term_hits(units, terms, ["doc"])
    plan = _plan(hits, "optimizedPlan")
    assert plan.index("Generate") < plan.index("Join")
    assert {tuple(r) for r in hits.select("doc", "unit", "leaf_id", "group_no", "at").collect()} == {(1, 1, 1, 0, 17), (1, 1, 1, 1, 5)}


def test_words_of_many_obligations_make_no_rows(spark):
    units = spark.createDataFrame([(1, "u", [1], "row 7 under size")], "doc int, unit string, refs array<int>, text string")
    terms = spark.createDataFrame([(1, i, 0, g, a) for i in range(50) for g, a in enumerate((f"row {i}", "size"))] + [(1, 99, 0, 0, "size"), (1, 99, 0, 1, "")], "doc int, leaf_id int, binding_no int, group_no int, alternative string")
    assert [tuple(r) for r in evidence.required_bindings(units, terms, ["doc"]).collect()] == [(1, 7, [1])]


def test_cells_leave_in_small_batches(spark):
    text = "| a | b |\n| --- | --- |\n| 1 | 2 |"
    docs = spark.range(200).coalesce(1).select(F.col("id").alias("doc"), F.lit(text).alias("text"))
    cells = tables.table_cells(docs, ["doc"])
    assert "ArrowEvalPython" not in _plan(cells)
    assert cells.groupBy("header", "cell").count().collect() and cells.count() == 400
    sizes = cells.mapInArrow(lambda bs: bs, cells.schema)
    assert sizes.select("doc").distinct().count() == 200


def test_rows_are_met_before_columns(spark):
    docs = spark.createDataFrame([(1, "| a | b |\n| --- | --- |\n" + "\n".join(f"| k{i} | {i} |" for i in range(30)))], "doc int, text string")
    leaves = spark.createDataFrame([(1, i, f"k{i}", "b", str(i)) for i in range(30)], "doc int, leaf_id int, row_key string, column string, value string")
    rows = gates.table_binding(tables.table_cells(docs, ["doc"]), leaves, ["doc"])
    plan = _plan(rows, "optimizedPlan")
    assert "_row" in [line for line in plan.split("\n") if "Join Inner" in line][-1]
    assert {r.status for r in rows.collect()} == {"correct"}


def test_spend_beyond_a_long(spark):
    cases = spark.range(10).select(F.lit(5e9).alias("inference"), F.lit(None).cast("double").alias("evaluator"))
    failed = spark.createDataFrame([("case", 1.0, 1.0), ("setup", 1.0, 1.0)], "kind string, inference double, evaluator double")
    assert [int(x) for x in reports.spend(cases, failed).first()] == [50 * 10**18 + 10**9, 10**9, 50 * 10**18 + 2 * 10**9]


def test_fingerprints_join_groups_of_near_copies(spark):
    """Texts with few shingles in common go by their SimHash fingerprints too, as the stage is named."""
    import corpus_pipeline

    near = spark.createDataFrame([(1, 11, 5), (2, 12, 6), (3, 13, 7), (4, 14, 7), (5, 11, 5)], "doc_id long, text_key long, root long")
    alike = spark.createDataFrame([(1, 11, 90), (2, 12, 90), (3, 13, 91), (4, 14, 92), (5, 11, 90)], "doc_id long, text_key long, root long")
    assert {tuple(r) for r in corpus_pipeline.united(near, alike).collect()} == {(1, 11, 5), (2, 12, 5), (5, 11, 5), (3, 13, 7), (4, 14, 7)}


def test_pipeline_workers_keep_few_pieces(spark, monkeypatch):
    """Workers go from stage to stage with what they keep, so the pipeline keeps fewer pieces; ids do not depend on it."""
    import corpus_pipeline
    from attestra.llm import packing, tokens

    kept = {}
    monkeypatch.setattr(packing, "pack", lambda docs, vocabulary, **more: kept.update(more))
    corpus_pipeline.pack(spark, None, DATA)
    assert 200 * kept["cached_pieces"] <= 64_000_000
    path, texts = corpus_pipeline.vocabulary("word_bpe_49k.json"), [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(20)]
    few = tokens.encoder(path, "word", 100)
    assert [few.encode_batch([t])[0] for t in texts] == tokens.encoder(path, "word").encode_batch(texts)
    assert len(few.cache) < 200 and few is not tokens.encoder(path, "word")


def test_suppliers_are_dealt_once(spark, monkeypatch):
    """Batches come of one shuffle, with a task for each so many lines, not of joins of lines with themselves."""
    from attestra import queries

    monkeypatch.setattr(queries, "BATCHED_ROWS", 500)
    rows = QUERIES["semantic_batches"](spark, DATA)
    assert "Join" not in _plan(rows) and _plan(rows).count("Exchange") == 1
    assert rows.rdd.getNumPartitions() == 1 + spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500


def test_batches_of_a_column_and_of_odd_regions(spark):
    """A column marks what is settled as a table does; two regions of one number are told apart, and a leaf without a number comes first."""
    rows = [("c", i // 9, None if i == 20 else i % 9, "rs"[i % 2], f"a{i}", i % 3 == 0) for i in range(40)] + [("d", 0, 0, "r", "b", True)]
    leaves = spark.createDataFrame(rows, "c string, region_no int, leaf_no int, region_id string, leaf_id string, done boolean")
    tell = lambda df: sorted((x.c, x.batch, x.request, x.leaf_ids, [tuple(r) for r in x.regions]) for x in df.collect())
    by_column = tell(scoring.semantic_batches(leaves, ["c"], "done", 16, 8))
    assert by_column == tell(scoring.semantic_batches(leaves, ["c"], leaves.where("done"), 16, 8))
    want = []
    for b in range(3):
        batch = sorted(rows[:40], key=lambda r: (r[1], -1 if r[2] is None else r[2]))[16 * b : 16 * b + 16]
        pieces = [(i, min(r[2] for r in batch if (r[1], r[3]) == (n, i) and r[2] is not None), sum((r[1], r[3]) == (n, i) for r in batch)) for n, i in sorted({(r[1], r[3]) for r in batch})]
        asked = [r[4] for r in batch if not r[5]]
        want += [("c", b, k, asked[8 * k : 8 * k + 8], pieces) for k in range(-(-len(asked) // 8))]
    assert by_column == want


def test_pairs_of_a_locator_are_spread(spark):
    """Rows of one locator make pairs in several tasks, each pair once."""
    rows = spark.createDataFrame([(i, "x" if i < 60 else "y" if i < 62 else None) for i in range(64)] + [(99, "z")], "id long, p string")
    pairs = members.collisions(rows, "id", ["p"], block=8)
    assert sorted(map(tuple, pairs.collect())) == [(a, b) for a in range(60) for b in range(a + 1, 60)] + [(60, 61)]
    assert pairs.rdd.getNumPartitions() == 4
    assert pairs.where("a < 60").groupBy(F.spark_partition_id()).count().count() > 1


@pytest.mark.parametrize("name", ["page_map", "page_scope"])
def test_lines_are_not_gone_through_again_for_each_line(spark, name):
    plan = _plan(QUERIES[name](spark, DATA))
    assert "unboundedfollowing" in plan and not re.search(r"(?:currentrow\$\(\)|RowFrame, 1), unboundedfollowing", plan)


def test_counters_of_blocks_and_runs(spark):
    """A page's last line in a block of seven and more lines, before a rule: pages end with their counters, blocks are told apart."""
    text = "\n".join([*"abcdefg", "1/2", "---", *"hijklmn", "2/2", "---", "x"])
    docs = spark.createDataFrame([(1, 2, text), (2, 2, "a/b\nPAGE 1\nx\nPAGE 2\ny")], "d int, n_pages int, text string")
    got = {(r.d, r.ref): r.page for r in lines.page_map(lines.candidate_lines(docs, ["d", "n_pages"]), ["d", "n_pages"]).collect()}
    assert [got[1, i] for i in range(1, 20)] == [1] * 8 + [2] * 9 + [None] * 2
    assert [got[2, i] for i in range(1, 6)] == [None, 1, 1, 2, 2]
