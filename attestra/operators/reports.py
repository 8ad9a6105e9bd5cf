"""Report tables: draws, cases and models over exact sums; usage, spend and windows; orders and exclusions.

Scores are summed as whole billionths and divided once, with halves going up, so that means do not hang on the order of summing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NANO = 10**9


def nano(c: Column) -> Column:
    """A number as whole billionths."""
    return F.round(c * NANO).cast("long")


def nano_mean(total: Column, n: Column) -> Column:
    """``total / n`` in whole units, halves up."""
    twice = 2 * total + n
    return F.call_function("div", twice - F.pmod(twice, 2 * n), 2 * n)


def exact_draws(scores: DataFrame, cases: int, keys: list[str]) -> DataFrame:
    """(keys, draw, score_nano, cost_nano): draws with a finite score for each of ``cases`` cases, the mean of the cases' means, and costs added up.

    ``scores(keys, draw, case_id, score, cost)``; several rows of one case count as its mean.
    """
    good = scores.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")))
    one = good.groupBy(*keys, "draw", "case_id").agg(nano_mean(F.sum(nano(F.col("score"))), F.count("*")).alias("s"), F.sum(nano(F.col("cost"))).alias("c"))
    rows = one.groupBy(*keys, "draw").agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c")).where(F.col("n") == cases)
    return rows.select(*keys, "draw", nano_mean(F.col("s"), F.col("n")).alias("score_nano"), F.col("c").alias("cost_nano"))


def usable_draws(draws: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    """Draws 1 to ``most`` before the first that is missing."""
    numbered = draws.where(F.col("draw").between(1, most)).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("draw")))
    return numbered.where("draw = _rank").drop("_rank")


def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, draws, mean_nano, least_nano, most_nano, sd): of ``rows(keys, score_nano)``; sd is the sample's, null for one row. For models, or for cases across draws."""
    return rows.groupBy(*keys).agg(F.count("*").alias("draws"), nano_mean(F.sum("score_nano"), F.count("*")).alias("mean_nano"), F.min("score_nano").alias("least_nano"), F.max("score_nano").alias("most_nano"), (F.stddev_samp("score_nano") / NANO).alias("sd"))


def combined_usage(usages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, input, output, total, cached, written): token counts added up, missing ones as 0; keys without usage have no row."""
    return usages.groupBy(*keys).agg(*(F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("input", "output", "total", "cached", "written")))


def with_written(usages: DataFrame) -> DataFrame:
    """``usages`` in which tokens written to a cache are what was not read from it, where a price for them is set and none are given."""
    whole = F.greatest(F.lit(0), F.coalesce("input", F.lit(0)))
    derived = whole - F.least(whole, F.greatest(F.lit(0), F.coalesce("cached", F.lit(0))))
    return usages.withColumn("written", F.when(F.coalesce("write_price", F.lit(0)) != 0, F.coalesce("written", derived)).otherwise(F.col("written")))


def spend(cases: DataFrame, failures: DataFrame) -> DataFrame:
    """(inference, evaluator, total) in whole billionths: what this run paid, failed cases included; ``failures(kind, inference, evaluator)`` that are no case cost nothing.

    Sums are decimal(38,0), as a large run's billionths go beyond a long.
    """
    part = lambda df: df.select(nano(F.coalesce("inference", F.lit(0.0))).alias("inference"), nano(F.coalesce("evaluator", F.lit(0.0))).alias("evaluator"))
    rows = part(cases).unionByName(part(failures.where("kind = 'case'"))).agg(*(F.coalesce(F.sum(F.col(c).cast("decimal(28,0)")), F.lit(0)).cast("decimal(38,0)").alias(c) for c in ("inference", "evaluator")))
    return rows.withColumn("total", (F.col("inference") + F.col("evaluator")).cast("decimal(38,0)"))


def measured(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, started, finished): the first start and the last end, missing ones aside."""
    return rows.groupBy(*keys).agg(F.min("started_at").alias("started"), F.max("finished_at").alias("finished"))


def draw_label(models: DataFrame) -> DataFrame:
    """(label): "n draws", or "m to n draws" where models differ."""
    n = models.agg(F.min("draws").alias("a"), F.max("draws").alias("b"))
    return n.select(F.when(F.col("a") == F.col("b"), F.concat(F.col("a").cast("string"), F.when(F.col("a") == 1, " draw").otherwise(" draws"))).otherwise(F.concat_ws(" ", F.col("a").cast("string"), F.lit("to"), F.col("b").cast("string"), F.lit("draws"))).alias("label"))


def excluded(registered: DataFrame, draws: DataFrame, identities: DataFrame) -> DataFrame:
    """(model_id, reason): registered models that no report lists.

    Those without a complete draw, and those whose ``identities(model_id, model, evaluator)`` are not one of each, nulls aside.
    """
    names = lambda c: F.coalesce(F.array_join(F.array_sort(F.collect_set(c)), ", "), F.lit(""))
    seen = identities.groupBy("model_id").agg(F.count_distinct("model").alias("n"), F.count_distinct("evaluator").alias("m"), names("model").alias("ns"), names("evaluator").alias("ms"))
    shown = lambda c: F.when(F.col(c) == "", "missing").otherwise(F.col(c))
    rows = registered.select("model_id").distinct().join(draws.select("model_id").distinct().withColumn("_has", F.lit(True)), "model_id", "left").join(seen, "model_id", "left")
    drift = F.concat(F.lit("drift: model="), shown("ns"), F.lit("; evaluator="), shown("ms"))
    reason = F.when(F.col("_has").isNull(), "no complete draw").when(~((F.col("n") == 1) & (F.col("m") == 1)), drift)
    return rows.select("model_id", reason.alias("reason")).where("reason is not null")


def ranked(rows: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """``rows`` with place: best score first, then by ``by``; models overall, or the bars of each case (``within``)."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("score_nano"), *by)))


def unsupported_counts(claims: DataFrame, harms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, count, reported, penalty): claims of each candidate, those that a judge reported, and the harm they cost; ``claims(keys, region_id, source)``."""
    rows = claims.join(harms, "region_id")
    return rows.groupBy(*keys).agg(F.count("*").alias("count"), F.count_if(F.col("source") == "reported").alias("reported"), F.sum("harm").cast("double").alias("penalty"))
