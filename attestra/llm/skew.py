"""Joins whose keys may be held by a large share of all rows, and choosing one row of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import text_key

#: A key is hot if it is in more than one of so many rows; so there are at most as many hot keys, at any size of the input.
HOT_SHARE = 10_000


def join_hot(rows: DataFrame, classes: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined with ``classes`` by ``key``, where ``n`` is the number of rows that a class has.

    Classes of more than 1 / HOT_SHARE of all rows are at most HOT_SHARE; they are broadcast, so their rows stay where they are.
    The rest is joined by a shuffle in which no key has more than that share. No row is lost or doubled.
    """
    total = rows.count()
    hot, cold = (classes.where(F.col(n) * HOT_SHARE > total), classes.where(F.col(n) * HOT_SHARE <= total))
    hot = F.broadcast(hot)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names made of ``names`` that ``df`` has not, whatever their case."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of ``groups(doc_id, text_key, root)``: the smallest doc_id (null ids last), then the smallest text key.

    Rows are met by id and text key; both the semi join and the dropping of repeated rows take these as keys, so texts are
    shuffled once.
    """
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    keep = groups.groupBy("root").agg(F.min(at).alias("k")).select("k.doc_id", "k.text_key")
    a, b = unused(docs, "_id", "_key")
    place = lambda i, k: {a: F.coalesce(i, F.lit(0)), b: F.when(i.isNull(), F.xxhash64(k)).otherwise(k)}
    # One row of each group grows with the corpus, so it is never broadcast.
    keep = keep.select(*(c.alias(n) for n, c in place(F.col("doc_id"), F.col("text_key")).items())).hint("merge")
    kept = docs.withColumns(place(F.col("doc_id").cast("long"), text_key())).join(keep, [a, b], "left_semi")
    return kept.dropDuplicates([a, b]).select(*docs.columns)
