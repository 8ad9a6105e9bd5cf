"""Names that may mean one member, joined by keys that every such pair shares, so that no name meets all others.

``is_alias`` decides; the keys only choose whom it is asked about, and lose no pair:

* equal names share their text;
* names alike by edit distance share one of their first q-grams in an order by hash (prefix filter: d edits change at most q * d
  grams, so of two such names the first q * d + 1 grams of each have one in common), and their runs of digits;
* where one name begins the other, all words of one are the first words of the other;
* names with the same two or more numbers that share another word share both;
* where the other words of one stand in the other in order, the longest of them is a word there, and numbers agree if both have any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, same_member
from .bindings import is_subsequence, words_of

GRAM, LEAST = 3, 0.86


def is_alias(a: Column, b: Column) -> Column:
    """Whether two names in normal form may mean one member.

    They are alike, or one begins the other, or (numbers being equal where both have any) they share two numbers and a word, or
    the two or more words of one stand in the other in order.
    """
    x, y = words_of(a), words_of(b)
    numbers = lambda ws: F.filter(ws, lambda w: w.rlike(r"^\p{N}+$"))
    others = lambda ws: F.filter(ws, lambda w: ~w.rlike(r"^\p{N}+$"))
    begins = lambda p, q: (F.size(p) > 0) & (F.slice(q, F.lit(1), F.greatest(F.lit(1), F.size(p))) == p)
    n, m, v, w = numbers(x), numbers(y), others(x), others(y)
    agree = (F.size(n) == 0) | (F.size(m) == 0) | (n == m)
    shared = (F.size(n) >= 2) & (n == m) & F.arrays_overlap(v, w)
    inside = ((F.size(v) >= 2) & is_subsequence(v, w)) | ((F.size(w) >= 2) & is_subsequence(w, v))
    return same_member(a, b) | begins(x, y) | begins(y, x) | (agree & (shared | inside))


def _hashes(tag: str, *parts: Column) -> Column:
    return F.xxhash64(F.lit(tag), *parts)


def _gram_keys(name: Column) -> Column:
    """The first q-grams in an order by hash, as many as the edits that a name of this length may have ask for; none where only equality is close enough."""
    n = F.length(name)
    edits = F.floor(F.floor(n / LEAST + 1e-9) * (1 - LEAST) + 1e-9).cast("int")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - GRAM + 1)), lambda i: F.substr(name, i, F.lit(GRAM)))
    # Equal grams are told apart by their number, as the bound counts every one of them.
    told = let(grams, lambda g: F.transform(g, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(g, F.lit(1), i + 1), lambda y: y == x)))))
    digits = F.regexp_replace(name, "[^0-9]+", ",")
    first = F.slice(F.array_sort(told), F.lit(1), GRAM * edits + 1)
    return F.when(edits > 0, F.transform(first, lambda h: _hashes("gram", digits, h))).otherwise(F.array().cast("array<bigint>"))


def _keys(name: Column, left: bool) -> Column:
    """All keys of a name. A key that is not the same on both sides bears the side that is the shorter name's."""
    mine, theirs = ("left", "right") if left else ("right", "left")

    def of(words: Column, numbers: Column, others: Column) -> Column:
        number = F.array_join(numbers, " ")
        whole = F.when(F.size(words) > 0, F.array(_hashes(f"begins {mine}", F.array_join(words, " "))))
        parts = F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: _hashes(f"begins {theirs}", F.array_join(F.slice(words, F.lit(1), k), " "))))
        shared = F.when(F.size(numbers) >= 2, F.transform(F.array_distinct(others), lambda w: _hashes("shared", number, w)))
        longest = F.array_max(F.transform(others, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
        inside = F.when(F.size(others) >= 2, F.when(number == "", F.array(_hashes(f"inside {mine}", longest, F.lit("*")))).otherwise(F.array(_hashes(f"inside {mine}", longest, number), _hashes(f"inside {mine}", longest, F.lit("")))))
        around = F.when(F.size(others) >= 2, F.flatten(F.transform(F.array_distinct(others), lambda w: F.array(_hashes(f"inside {theirs}", w, number), _hashes(f"inside {theirs}", w, F.lit("*"))))))
        none = F.array().cast("array<bigint>")
        return F.concat(F.array(_hashes("equal", name)), _gram_keys(name), *(F.coalesce(x, none) for x in (whole, parts, shared, inside, around)))

    is_number = lambda w: w.rlike(r"^\p{N}+$")
    cut = let(words_of(name), lambda ws: F.struct(ws.alias("words"), F.filter(ws, is_number).alias("numbers"), F.filter(ws, lambda w: ~is_number(w)).alias("others")))
    return F.array_distinct(let(cut, lambda c: of(c["words"], c["numbers"], c["others"])))


def alias_pairs(left: DataFrame, right: DataFrame, on: list[str], name: str = "name") -> DataFrame:
    """(on, left, right): distinct names in normal form of ``left(on, name)`` and ``right(on, name)`` that may mean one member."""
    side = lambda df, as_: df.select(*on, F.col(name).alias(as_)).where(F.col(as_).isNotNull()).distinct().withColumn("_key", F.explode_outer(_keys(F.col(as_), as_ == "left")))
    met = side(left, "left").join(side(right, "right").hint("merge"), [*on, "_key"]).select(*on, "left", "right").distinct()
    return met.where(is_alias(F.col("left"), F.col("right")))


def squeezed(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit(""))


def known_in(names: DataFrame, members: DataFrame, on: list[str], name: str, member: str, where: str) -> DataFrame:
    """(on, name, where): for distinct ``names(on, name)`` every ``where`` of ``members(on, member, where)`` that holds an alias, or the name but for its blanks."""
    own = names.select(*on, F.col(name).alias("name")).distinct()
    held = members.select(*on, F.col(member).alias("member"), where).distinct()
    alike = alias_pairs(own, held.withColumnRenamed("member", "name"), on).select(*on, F.col("left").alias("name"), F.col("right").alias("member"))
    same = own.withColumn("_s", squeezed(F.col("name"))).join(held.select(*on, "member").distinct().withColumn("_s", squeezed(F.col("member"))).hint("merge"), [*on, "_s"]).select(*on, "name", "member")
    return alike.unionByName(same).distinct().join(held.hint("merge"), [*on, "member"]).select(*on, F.col("name").alias(name), where).distinct()
