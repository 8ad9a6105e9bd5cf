"""Closed sets: known members, invented ones, and obligations that are too alike to tell apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_ascii, same_member


def member_pairs(left: DataFrame, right: DataFrame, column: str, on: list[str]) -> DataFrame:
    """(on, left, right): distinct members of two sets that are alike, joined within ``on``.

    Alike at 0.86 or more means that the shorter has at least 0.86 of the longer's length and that digits agree, so
    lengths are joined in bands and digit runs by equality, before distances are taken. Sets are made distinct first.
    """
    prep = lambda df, name: df.select(*on, F.col(column).alias(name)).distinct().withColumns({"_digits": F.regexp_replace(name, "[^0-9]+", ","), "_len": F.length(name)})
    # Lengths in bands of powers of 1/0.86: likes are in one band or the next.
    band = F.floor(F.log(F.greatest(F.col("_len"), F.lit(1)).cast("double")) / F.log(F.lit(1 / 0.86)))
    a = prep(left, "left").withColumn("_band", band)
    b = prep(right, "right").withColumn("_band", F.explode(F.array(band - 1, band, band + 1)))
    return a.join(b.drop("_len").hint("merge"), [*on, "_digits", "_band"]).where(same_member(F.col("left"), F.col("right"))).select(*on, "left", "right").distinct()


def invented(rows: DataFrame, known: DataFrame, scope: list[str], column: str = "member") -> DataFrame:
    """Members in ``rows(scope, column)`` that no known member equals in normal form, nor is alike to."""
    norm = lambda df: df.withColumn("_m", normalize_ascii(F.col(column)))
    novel = norm(rows).join(norm(known).select(*scope, "_m").distinct().hint("merge"), [*scope, "_m"], "left_anti")
    alike = member_pairs(novel.select(*scope, "_m"), norm(known).select(*scope, "_m"), "_m", scope).select(*scope, F.col("left").alias("_m")).distinct()
    return novel.join(alike.hint("merge"), [*scope, "_m"], "left_anti").drop("_m")


def key_column(cells: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, table_no, col): the one column of a table that holds most of the known members, two at least (all if fewer)."""
    n = known.groupBy(*keys).agg(F.least(F.lit(2), F.count_distinct("member")).alias("need"))
    hits = cells.withColumn("_m", normalize_ascii(F.col("cell"))).join(known.select(*keys, normalize_ascii(F.col("member")).alias("_m")).distinct().hint("merge"), [*keys, "_m"])
    found = hits.groupBy(*keys, "table_no", "col").agg(F.count_distinct("_m").alias("found")).join(n.hint("merge"), keys).where("found >= need")
    w = Window.partitionBy(*keys, "table_no")
    best = found.withColumn("top", F.max("found").over(w)).where("found = top").withColumn("tied", F.count("*").over(w)).where("tied = 1")
    return best.select(*keys, "table_no", "col")


def collisions(rows: DataFrame, id_col: str, by: list[str], block: int = 1000) -> DataFrame:
    """(a, b): pairs of obligations with one locator, ``a < b``; the locator's columns are the join's keys.

    Pairs grow with the square of a locator's rows, so these are cut into blocks of about ``block`` by a hash of the id: the one side is
    dealt by block and the other is sent to each of the locator's blocks. Tasks are as many as shuffle partitions, as the few bytes of
    the rows do not tell how many pairs they make.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = rows.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    met = rows.select(F.col(id_col).alias("_id"), *by).join(shared.hint("merge"), by)
    a = met.select(*by, F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int").alias("_block"), F.col("_id").alias("a"))
    b = met.select(*by, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), F.col("_id").alias("b"))
    on = [*by, "_block"]
    return a.repartition(tasks, *on).join(b.repartition(tasks, *on).hint("merge"), on).where("a < b").select("a", "b")


def only_in_one(pairs: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys that go with one value alone, and that value: mappings that are not ambiguous."""
    return pairs.groupBy(*key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")
