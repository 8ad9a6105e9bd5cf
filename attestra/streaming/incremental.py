"""Incremental work on candidates: files that arrive are keyed by content, and only new keys are handed on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.signals import cache_key
from ..sources.facts import CANDIDATES


def keyed_candidates(spark: SparkSession, folder: str, corrupt: str | None = None) -> DataFrame:
    """A stream of candidates from JSON files, with their content key; ``corrupt`` names a column for lines that do not parse."""
    schema = CANDIDATES + (f", {corrupt} STRING" if corrupt else "")
    rows = spark.readStream.schema(schema).json(folder, columnNameOfCorruptRecord=corrupt)
    return rows.withColumn("key", cache_key(F.col("model_id"), F.col("case_id"), F.col("draw"), F.col("prediction")))


def first_fault(rules: dict[str, Column]) -> Column:
    """The first rule that a row breaks, or null; a rule that can't be told is not broken."""
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in rules.items()), F.lit(None).cast("string"))


def candidate_fault(corrupt: str | None = None) -> Column:
    """What keeps a candidate from being scored."""
    lines = {"does not parse": F.col(corrupt).isNotNull()} if corrupt else {}
    rules = {"no model": F.trim(F.coalesce("model_id", F.lit(""))) == "", "no case": F.trim(F.coalesce("case_id", F.lit(""))) == "", "no draw": F.coalesce("draw", F.lit(0)) < 1, "no text": F.trim(F.coalesce("prediction", F.lit(""))) == ""}
    return first_fault(lines | rules)


def score_new(rows: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, fault: Column | None = None) -> StreamingQuery:
    """Scores what has a new key, batch by batch, and appends it to ``out``; a batch that is run again is not scored twice.

    Rows with a ``fault`` do not keep a batch from its end: all others are scored, and they are listed in ``out``-failed, each one with
    its ``fault``. Their keys are not kept, so the same row is tried again if it comes again.

    Keys alone are kept in ``out``-keys, in 256 parts by how they begin, and a batch reads the parts that its own keys are in, so
    its cost does not grow with what has been scored but for those keys. Results come first: a batch that ends in between is
    scored again and takes the place of its own results.
    """
    known_at = out.rstrip("/") + "-keys"

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        save = lambda x: x.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        if fault is not None:
            df = df.withColumn("fault", fault)
            save(df.where("fault is not null").withColumn("batch", F.lit(number))).partitionBy("batch").parquet(failed_at(out))
            df = df.where("fault is null").drop("fault")
        fresh = df.dropDuplicates(["key"]).withColumn("_part", F.substring("key", 1, 2))
        root = spark._jvm.org.apache.hadoop.fs.Path(known_at)
        if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            parts = [r[0] for r in fresh.select("_part").distinct().collect()]  # 256 at most
            known = spark.read.parquet(known_at).where(F.col("_part").isin(parts) & (F.col("batch") != number)).select("key")
            fresh = fresh.join(known, "key", "left_anti")
        save(score(fresh.drop("_part")).withColumn("batch", F.lit(number))).partitionBy("batch").parquet(out)
        save(fresh.select("key", "_part", F.lit(number).alias("batch"))).partitionBy("_part", "batch").parquet(known_at)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failed_at(out: str) -> str:
    return out.rstrip("/") + "-failed"


def still_failed(failed: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, faults, tries) of what failed and no later try has scored; rows without one of their keys can't be scored and stay."""
    tries = failed.groupBy(*keys).agg(F.array_sort(F.collect_set("fault")).alias("faults"), F.count("*").alias("tries"))
    return tries.join(scored.select(*keys).distinct(), keys, "left_anti")


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts and sums of ``events(ts, event_type, value)`` by window; works on tables and on streams (an extension)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
