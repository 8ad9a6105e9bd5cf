"""Integrity checks as queries for rows that break them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, copies) of keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def unequal_sets(left: DataFrame, right: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Keys whose distinct members differ between two tables, with how many each side has alone."""
    a = left.select(*keys, column).distinct().withColumn("l", F.lit(1))
    b = right.select(*keys, column).distinct().withColumn("r", F.lit(1))
    both = a.join(b.hint("merge"), [*keys, column], "full").groupBy(*keys).agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))
    return both.where("only_left > 0 or only_right > 0")


def missing_numbers(rows: DataFrame, keys: list[str], number: str, upto: str) -> DataFrame:
    """(keys, number): numbers from 1 to ``upto`` that a key has no row for."""
    want = rows.groupBy(*keys).agg(F.max(upto).alias("_n")).select(*keys, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias(number))
    return want.join(rows.select(*keys, F.col(number).cast("int").alias(number)).distinct().hint("merge"), [*keys, number], "left_anti")


def decreasing(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is below that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_before", before).where(F.col(value) < F.col("_before")).drop("_before")


def not_functional(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, values): keys that go with more than one value."""
    return rows.groupBy(*key).agg(F.count_distinct(value).alias("values")).where("values > 1")


def page_cover(ranges: DataFrame, cases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, last, problem): where ``ranges(keys, modality, first, last)`` do not give each page of ``cases(keys, n_pages)`` to one modality.

    Problems are ``missing``, ``given twice`` and ``outside``, the last for pages before 1 or after the case's last one, and for a case that
    is not there. A sweep over the ends of ranges: pages are not counted out one by one. A range without a page is left out.
    """
    real = ranges.where(F.col("first") <= F.col("last")).join(cases.select(*keys, "n_pages").hint("merge"), keys, "left").withColumn("_n", F.coalesce("n_pages", F.lit(0)))
    early, late = F.col("first") < 1, F.col("last") > F.col("_n")
    part = lambda when, a, b: F.when(when, F.struct(a.cast("long").alias("first"), b.cast("long").alias("last")))
    before, after = part(early, F.col("first"), F.least("last", F.lit(0))), part(late, F.greatest("first", F.greatest(F.lit(1), F.col("_n") + 1)), F.col("last"))
    outside = real.select(*keys, F.inline(F.array_compact(F.array(before, after)))).where("first <= last").distinct().withColumn("problem", F.lit("outside"))
    clipped = real.select(*keys, F.greatest("first", F.lit(1)).cast("long").alias("a"), F.least("last", "_n").cast("long").alias("b")).where("a <= b")
    end = lambda at, d: F.struct(at.cast("long").alias("at"), F.lit(d).alias("d"))
    ends = clipped.select(*keys, F.inline(F.array(end(F.col("a"), 1), end(F.col("b") + 1, -1)))).unionByName(cases.where("n_pages > 0").select(*keys, F.inline(F.array(end(F.lit(1), 0), end(F.col("n_pages") + 1, 0)))))
    steps = ends.groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("at")
    swept = steps.select(*keys, F.col("at").alias("first"), (F.lead("at").over(w) - 1).alias("last"), F.sum("d").over(w).alias("depth")).where("last is not null and depth <> 1")
    # Neighbouring stretches with one problem are one.
    swept = swept.withColumn("problem", F.when(F.col("depth") == 0, "missing").otherwise("given twice"))
    begins = F.coalesce((F.lag("last").over(Window.partitionBy(*keys, "problem").orderBy("first")) + 1 != F.col("first")).cast("int"), F.lit(1))
    swept = swept.withColumn("_b", begins).withColumn("_run", F.sum("_b").over(Window.partitionBy(*keys, "problem").orderBy("first")))
    joined = swept.groupBy(*keys, "problem", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return joined.select(*keys, "first", "last", "problem").unionByName(outside)


def bad_telemetry(rows: DataFrame, text: str, tokens: str, bytes_per_token: int = 16, least_bytes: int = 4096) -> DataFrame:
    """Rows whose token count can't be right: none, or a long text with too many bytes for each token."""
    size = F.octet_length(text)
    return rows.where(F.col(tokens).isNull() | (F.col(tokens) <= 0) | ((size >= least_bytes) & (size > bytes_per_token * F.col(tokens))))
