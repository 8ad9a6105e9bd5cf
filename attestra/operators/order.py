"""Order inside local structures: table columns, rows, headings, lists and lines that tell a sequence.

A sequence is (keys, seq, refs, values): texts in the order in which a document gives them. An obligation's groups, ``terms(keys,
leaf_id, group_no, alternative)``, are in order if each has a value of its own, one after the other; if they only have values of
their own, they are given in another order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import evidence_rank, is_delimiter, let, normalize_ascii, plain_cells
from .bindings import header_matches, header_words, is_subsequence, words_of
from .evidence import holds, phrase_pattern
from .lines import by, candidate_lines
from .tables import table_cells

#: Words that tell a sequence in a line, and that announce a list of fields.
SEQUENCE_CUE = r"->|<-|(?<![a-z0-9_])(?:then|followed by|sequence|order|ordered|row order|reading order|progression)(?![a-z0-9_])"
SCHEMA_CUE = r"(?i)\b(?:columns?|fields?|headers?|schema)\b"
#: An item of a list, a key with its value, and a field with its value.
LIST_ITEM = r"^\s*(?:[-+*]|\d+[.)])\s+(.+)$"
KEY_VALUE = r"^\s*([^:]{1,160})\s*:\s*\S.*$"
FIELD_VALUE = r"^(.{1,80}?)\s*[:=]\s*\S"


def _sequences(items: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    """(keys, seq, refs, values) of ``items(keys, ..., ref, pos, value)``, in the order of lines and places."""
    rows = items.withColumn("seq", seq).groupBy(*keys, "seq").agg(F.array_sort(F.collect_list(F.struct("ref", "pos", "value"))).alias("x"))
    return rows.select(*keys, "seq", F.array_sort(F.array_distinct(F.transform("x", lambda r: r["ref"]))).alias("refs"), F.transform("x", lambda r: r["value"]).alias("values"))


def _named(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *(p.cast("string") for p in parts))


def _runs(lines: DataFrame, value: Column, keys: list[str], kind: str) -> DataFrame:
    """Runs of lines that each give a value."""
    bold = F.regexp_replace(F.regexp_replace("value", r"^(?:\*\*|__)", ""), r"(?:\*\*|__)$", "")
    rows = lines.withColumn("value", value).where("value <> ''").withColumn("value", bold)
    rows = rows.withColumn("_run", F.col("ref") - F.row_number().over(by(keys)))
    return _sequences(rows.withColumn("pos", F.lit(0)), keys, _named(kind, F.col("_run")))


def record_sequences(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Columns, cells and rows of tables; runs of headings of one level; lists and ``key: value`` runs."""
    lines = candidate_lines(docs, keys, text)
    cells = table_cells(docs.select(*keys, text), keys, text).withColumnRenamed("cell", "value")
    heads = cells.select(*keys, "table_no", "header_ref").distinct()
    rows = cells.withColumn("pos", F.col("col"))
    columns = _sequences(rows, keys, _named("column", F.col("table_no"), F.col("col")))
    flat = _sequences(rows.withColumn("pos", F.struct("row_no", "col")), keys, _named("cells", F.col("table_no")))
    joined = rows.groupBy(*keys, "table_no", "row_no").agg(F.min("ref").alias("ref"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda c: c["value"]), " ").alias("value"))
    whole = _sequences(joined.withColumn("pos", F.col("row_no")), keys, _named("rows", F.col("table_no")))
    tables = columns.unionByName(flat).unionByName(whole).withColumn("_no", F.split("seq", ":")[1].cast("int"))
    tables = tables.join(heads.withColumnRenamed("table_no", "_no").hint("merge"), [*keys, "_no"]).select(*keys, "seq", F.array_sort(F.array_distinct(F.concat(F.array("header_ref"), "refs"))).alias("refs"), "values")
    mark = r"^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$"
    titled = lines.withColumn("level", F.length(F.regexp_extract("raw", mark, 1))).where("level > 0")
    title = F.trim(F.regexp_replace(F.regexp_extract("raw", mark, 2), r"^\d+[.)]\s+", ""))
    # A heading's run is told by the nearest shallower heading before it.
    up = Window.partitionBy(*keys).orderBy("ref").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.max(F.when(F.col("level") < n, F.col("ref"))).over(up) for n in range(2, 7)]
    titled = titled.withColumn("_above", F.coalesce(F.get(F.array(F.lit(None).cast("int"), *above), F.col("level") - 1), F.lit(0)))
    headings = _sequences(titled.withColumns({"value": title, "pos": F.lit(0)}), keys, _named("heading", F.col("level"), F.col("_above")))
    item = F.regexp_extract("raw", LIST_ITEM, 1)
    listed = _runs(lines, F.when(item != "", item).when(~F.col("raw").contains("|"), F.regexp_extract("raw", KEY_VALUE, 1)), keys, "list")
    return tables.unionByName(headings).unionByName(listed)


def field_sequences(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Fields of lines in columns or under a word like "schema", headings of tables, and ``field: value`` runs."""
    lines = candidate_lines(docs, keys, text)
    told = F.when(F.col("raw").rlike(SCHEMA_CUE), F.split("raw", r"\s*(?:,|;|->|→)\s*"))
    fields = lines.withColumn("f", F.coalesce(plain_cells(F.col("raw")), told)).where(F.col("f").isNotNull() & ~is_delimiter(F.col("f")))
    fields = fields.select(*keys, _named("line", F.col("ref")).alias("seq"), F.array("ref").alias("refs"), F.col("f").alias("values"))
    heads = table_cells(docs.select(*keys, text), keys, text).select(*keys, "table_no", F.col("header_ref").alias("ref"), F.col("col").alias("pos"), F.col("header").alias("value")).distinct()
    heads = _sequences(heads, keys, _named("head", F.col("table_no")))
    body = F.regexp_replace(F.trim("raw"), r"^[-+*]\s+", "")
    return fields.unionByName(heads).unionByName(_runs(lines, F.when(~F.col("raw").contains("|"), F.regexp_extract(body, FIELD_VALUE, 1)), keys, "field"))


@F.pandas_udf(T.BooleanType())
def _assignable(chances: pd.Series) -> pd.Series:
    """Whether each group can have a value of its own; ``chances``: for each group the numbers of the values that fit it."""

    def one(groups) -> bool:
        taken, held = {}, {}  # value -> group, group -> value
        for g in range(len(groups)):
            came, free, waiting = {}, None, [g]  # value -> the group that looked at it
            while waiting and free is None:
                h = waiting.pop()
                for v in map(int, groups[h]):
                    if v not in came:
                        came[v] = h
                        if v not in taken:
                            free = v
                            break
                        waiting.append(taken[v])
            if free is None:
                return False
            while free is not None:  # every group on the way moves on by one value
                h = came[free]
                taken[free], held[h], free = h, free, held.get(h)
        return True

    return chances.map(one)


#: Not to be moved into a join's condition, where Spark can't call Python.
_can_assign = _assignable.asNondeterministic()


def _cued(docs: DataFrame, groups: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, leaf_id, refs, in_order) of lines that tell a sequence and hold all groups: whether their first places rise."""
    lines = candidate_lines(docs, keys, text).select(*keys, "ref", normalize_ascii(F.col("raw")).alias("t")).where(F.col("t").rlike(SEQUENCE_CUE))
    met = lines.withColumn("_w", F.explode(F.array_distinct(words_of(F.col("t"))))).join(groups.hint("merge"), [*keys, "_w"]).drop("_w").distinct()
    first = lambda alts: F.array_min(F.filter(F.transform(alts, lambda a: F.regexp_instr("t", phrase_pattern(a))), lambda p: p > 0))
    met = met.withColumn("_at", F.transform("groups", first)).where(F.forall("_at", lambda p: p.isNotNull()))
    rising = F.forall(F.sequence(F.lit(0), F.size("_at") - 1), lambda i: (i == 0) | (F.get("_at", i) > F.get("_at", i - 1)))
    return met.select(*keys, "leaf_id", F.array("ref").alias("refs"), rising.alias("in_order"))


def ordered_gate(docs: DataFrame, terms: DataFrame, keys: list[str], records: bool, text: str = "text") -> DataFrame:
    """(keys, leaf_id, satisfied, contradiction, refs) of every obligation; a sequence in order beats one in another order.

    ``records``: values of records, where a phrase or all words of an alternative in order will do, and lines with a cue
    count too; else fields, which may be short forms of headings. Sequences and obligations meet by any word of the first group.
    """
    norm = terms.withColumn("alternative", normalize_ascii(F.col("alternative")))
    wide = norm.groupBy(*keys, "leaf_id", "group_no").agg(F.collect_set(F.when(F.col("alternative") != "", F.col("alternative"))).alias("alts"))
    wide = wide.groupBy(*keys, "leaf_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("group_no", "alts"))), lambda g: g["alts"]).alias("groups"))
    keyed = wide.withColumn("_w", F.explode(F.array_distinct(F.flatten(F.transform(F.col("groups")[0], header_words)))))
    seqs = (record_sequences if records else field_sequences)(docs, keys, text)
    seqs = seqs.withColumn("values", F.transform("values", normalize_ascii)).where("size(values) > 0")
    met = seqs.withColumn("_w", F.explode(F.array_distinct(F.flatten(F.transform("values", header_words))))).join(keyed.hint("merge"), [*keys, "_w"]).drop("_w").distinct()
    inside = lambda v, a: let(words_of(a), lambda ws: (F.size(ws) >= 2) & is_subsequence(ws, words_of(v)))
    fits = lambda v, alts: holds(v, alts) | F.exists(alts, lambda a: inside(v, a) if records else header_matches(v, a))
    chances = F.transform("groups", lambda alts: F.array_compact(F.transform("values", lambda v, i: F.when((v != "") & fits(v, alts), i))))
    met = met.withColumn("_c", chances).where(F.forall("_c", lambda c: F.size(c) > 0))
    last = F.aggregate("_c", F.lit(-1), lambda at, c: F.array_min(F.filter(c, lambda i: i > at)))
    met = met.withColumn("in_order", last.isNotNull()).withColumn("_all", _can_assign("_c")).where("in_order or _all").select(*keys, "leaf_id", "refs", "in_order")
    if records:
        met = met.unionByName(_cued(docs, keyed, keys, text))
    best = lambda ok: F.min_by("refs", F.when(F.col("in_order") == ok, evidence_rank(F.col("refs"))))
    got = met.groupBy(*keys, "leaf_id").agg(best(True).alias("_y"), best(False).alias("_n"))
    rows = wide.select(*keys, "leaf_id").join(got.hint("merge"), [*keys, "leaf_id"], "left")
    return rows.select(*keys, "leaf_id", F.col("_y").isNotNull().alias("satisfied"), (F.col("_y").isNull() & F.col("_n").isNotNull()).alias("contradiction"), F.coalesce("_y", "_n").alias("refs"))
