"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir), and its result is written and read as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import decontam, line_dedup, near_copies, packing, quality, simhash
from attestra.llm.components import connected_components
from attestra.llm.queries import vocabulary
from attestra.llm.skew import one_of_each, unused
from attestra.session import table, written

#: Pieces of words that a worker keeps, about 50 MB: workers go from stage to stage and keep them, beside all that the other stages hold.
CACHED_PIECES = 250_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows with a null text go; of repeated rows all stay or all go."""
    (mark,) = unused(docs, "_kept")
    return quality.marked(docs, mark=mark).where(mark).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that five or more hold, but for the largest doc_id; n_chars follows the text."""
    lines, dropped = unused(docs, "_n_lines", "_n_dropped")
    out = line_dedup.applied(docs, line_dedup.keep_bitmaps(docs), lines, dropped)
    return out.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.

    Texts are linked by SimHash fingerprints at most two bits apart, found by segments and the pivot table, and by five-word
    shingles of similarity 0.8; groups are what either kind of link joins.
    """
    return one_of_each(docs, united(near_copies.groups(docs), simhash.near_duplicates(docs)))


def united(near: DataFrame, alike: DataFrame) -> DataFrame:
    """(doc_id, text_key, root) of ``near(doc_id, text_key, root)``, its groups joined where one group of ``alike`` has texts of several."""
    near = written(near.select("doc_id", "text_key", "root"), "pipeline-near")
    own = near.select("text_key", "root").distinct()
    met = own.join(alike.select("text_key", F.col("root").alias("other")).distinct().hint("merge"), "text_key").select("root", "other").distinct()
    least = met.groupBy("other").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    links = met.join(least.hint("merge"), "other").where("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b"))
    roots = connected_components(links).select(F.col("node").alias("root"), F.col("root").alias("joined"))
    # Groups that are joined are few rows beside the documents, but they grow with these, so they are never broadcast.
    return near.join(roots.hint("merge"), "root", "left").select("doc_id", "text_key", F.coalesce("joined", "root").alias("root"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.cleaned(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left, ids included."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), cached_pieces=CACHED_PIECES)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("packing", pack),
]

#: Tokenizing, hashing with XXH64 and zstandard are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
