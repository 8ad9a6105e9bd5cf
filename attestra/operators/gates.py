"""Evidence gates: each takes parsed structures and obligations and gives a status for every obligation.

A status is ``correct``, ``incorrect`` or ``missing``. Obligations and structures share the columns ``keys``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FORM_STATES, evidence_rank, form_text, let, normalize_ascii, pipe_cells
from .evidence import CLAUSE, blocking_word, holds, places, shared_words
from .tables import table_cells


def _best(hits: DataFrame, leaf: list[str]) -> DataFrame:
    """Per obligation the flags of its hits and the lines of its best one of each class."""
    cls = lambda k: F.min_by("refs", F.when(F.col("class") == k, evidence_rank(F.col("refs"))))
    return hits.groupBy(*leaf).agg(*(F.bool_or(F.col("class") == k).alias(f"is_{k}") for k in ("positive", "conflict", "partial")), *(cls(k).alias(f"{k}_refs") for k in ("positive", "conflict")))


def table_binding(cells: DataFrame, leaves: DataFrame, keys: list[str], leaf: str = "leaf_id") -> DataFrame:
    """Row, column and value of ``leaves(keys, leaf, row_key, column, value)`` against table cells.

    Columns and row keys are joined by equality of normal forms, the key's cell standing in another column. A value that
    differs is a conflict, which beats a match elsewhere; one that only begins the expected value is partial, hence missing.
    """
    n = lambda c: normalize_ascii(F.col(c))
    c = cells.select(*keys, "table_no", "row_no", "ref", "col", "header_ref", n("header").alias("_h"), n("cell").alias("_v"))
    want = leaves.select(*keys, leaf, n("row_key").alias("_row"), n("column").alias("_h"), n("value").alias("_want"))
    row = c.select(*keys, "table_no", "row_no", F.col("col").alias("_kc"), F.col("_v").alias("_row"))
    # The row is met first, so that no obligation meets all cells of its column.
    named = want.join(row.hint("merge"), [*keys, "_row"])
    hits = named.join(c.hint("merge"), [*keys, "table_no", "row_no", "_h"]).where("_kc <> col")
    short = (F.length("_v") > 0) & F.startswith(F.col("_want"), F.concat("_v", F.lit(" ")))
    kind = F.when(F.col("_v") == F.col("_want"), "positive").when(short, "partial").when(F.length("_v") > 0, "conflict")
    hits = hits.select(*keys, leaf, kind.alias("class"), F.array("header_ref", "ref").alias("refs"))
    found = _best(hits, [*keys, leaf])
    status = F.when(F.col("is_conflict"), "incorrect").when(F.col("is_positive"), "correct").otherwise("missing")
    return leaves.join(found.hint("merge"), [*keys, leaf], "left").select(*keys, leaf, status.alias("status"), F.when(F.col("is_conflict"), F.col("conflict_refs")).otherwise(F.col("positive_refs")).alias("refs"))


#: A form's box or sign before a field.
FORM_MARK = r"(?i)(\[\s*crossed box\s*:[^\]]+\]|\[(?:\s*[xX✓/]\s*|\s+)\]|☑|✅|☐|⬜)"


def form_segments(lines: DataFrame, keys: list[str], docs: DataFrame | None = None) -> DataFrame:
    """(keys, refs, text, before, after): pieces of a form in normal form, in which a label and its state stand together.

    A line with several boxes is cut before each of them, another into clauses; cells of piped lines stand alone, with their
    neighbours as ``before`` and ``after``; a row of an HTML table of ``docs(keys, text)``, if given, is one piece.
    """
    lines = lines.withColumn("cells", pipe_cells(F.col("raw")))
    boxed = F.split(F.regexp_replace("raw", FORM_MARK, "\x01$1"), "\x01")
    parts = F.when(F.size(boxed) > 2, boxed).otherwise(F.split("raw", CLAUSE))
    none = F.lit(None).cast("string")
    plain = lines.where("cells is null").select(*keys, F.array("ref").alias("refs"), F.explode(parts).alias("text"), none.alias("before"), none.alias("after"))
    cell = F.transform("cells", lambda c, i: F.struct(c.alias("text"), F.when(i > 0, F.get("cells", i - 1)).alias("before"), F.get("cells", i + 1).alias("after")))
    piped = lines.where("cells is not null").select(*keys, F.array("ref").alias("refs"), F.inline(cell))
    made = plain.where(F.trim("text") != "").unionByName(piped)
    if docs is not None:
        html = table_cells(docs.where(F.lower("text").contains("<table")).select(*keys, "text"), keys).where("kind = 'html'")
        html = html.groupBy(*keys, "table_no", "row_no").agg(F.array_sort(F.collect_set("ref")).alias("refs"), F.array_sort(F.collect_list(F.struct("col", "cell"))).alias("c"))
        made = made.unionByName(html.select(*keys, "refs", F.array_join(F.transform("c", lambda x: x["cell"]), " | ").alias("text"), none.alias("before"), none.alias("after")))
    return made.select(*keys, "refs", *(form_text(F.col(c)).alias(c) for c in ("text", "before", "after")))


#: A state's word, the longest first, with no ASCII letter or digit running on.
STATE_WORD = r"(?<![a-z0-9])(?:" + "|".join(sorted((w for ws in FORM_STATES.values() for w in ws), key=len, reverse=True)) + r")(?![a-z0-9])"
STATE_OF = {w: s for s, ws in FORM_STATES.items() for w in ws}


def _states(text: Column) -> Column:
    """The states that a text names, in turn."""
    names = F.create_map(*(F.lit(x) for pair in STATE_OF.items() for x in pair))
    return F.transform(F.regexp_extract_all(text, F.lit(STATE_WORD), F.lit(0)), lambda w: F.element_at(names, w))


def _state_places(text: Column) -> Column:
    """(state, start, end) of every word for a state: a text is searched once, and places are sums of what lies before."""
    names = F.create_map(*(F.lit(x) for pair in STATE_OF.items() for x in pair))
    sizes = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, p: s + F.length(p))
    word = lambda x, w, i: let(sizes(x["parts"], i + 1) + sizes(x["words"], i), lambda at: F.struct(F.element_at(names, w).alias("state"), at.alias("start"), (at + F.length(w)).alias("end")))
    cut = F.struct(F.split(text, STATE_WORD).alias("parts"), F.regexp_extract_all(text, F.lit(STATE_WORD), F.lit(0)).alias("words"))
    return let(cut, lambda x: F.transform(x["words"], lambda w, i: word(x, w, i)))


def form_state(lines: DataFrame, leaves: DataFrame, keys: list[str], leaf: str = "leaf_id", docs: DataFrame | None = None) -> DataFrame:
    """(keys, leaf, status, refs): states of form labels, ``leaves(keys, leaf, label, state)``, ``label`` a text or an array of them.

    In a piece of a form each place of a label takes the state that stands nearest to it and does not overlap it; ties all count.
    A cell with a label but no state takes that of the cell after it, else of the one before. A state other than the wanted
    one beats a match. Pieces and labels meet by the label's longest word, and states are looked for only where they have met.
    """
    labels = F.col("label") if "array" in dict(leaves.dtypes)["label"] else F.array("label")
    want = leaves.select(*keys, leaf, "state", F.filter(F.transform(labels, normalize_ascii), lambda x: x != "").alias("_labels"))
    want = want.select(*keys, F.struct(leaf, "state", "_labels", F.array_distinct(F.transform("_labels", blocking_word)).alias("_ws")).alias("_x")).groupBy(*keys).agg(F.collect_list("_x").alias("_all"))
    # A document's labels are one row, so that a piece is shuffled once, not once for each of its words.
    rows = form_segments(lines, keys, docs)
    some = let(shared_words(F.flatten(F.transform("_all", lambda x: x["_ws"]))), lambda have: F.filter("_all", lambda x: F.arrays_overlap(have, x["_ws"])))
    # explode_outer, as explode would push a test of its array below and have the words cut twice.
    hits = rows.join(want.hint("merge"), keys).select(*rows.columns, F.explode_outer(some).alias("_x")).where("_x is not null")
    hits = hits.select(*rows.columns, *(F.col(f"_x.{c}").alias(c) for c in (leaf, "state", "_labels"))).where(holds(F.col("text"), F.col("_labels")))
    hits = hits.withColumns({"_here": places(F.col("text"), F.col("_labels")), "_at": _state_places(F.col("text"))})
    gap = lambda x, s: F.greatest(F.lit(0), s["start"] - x["end"], x["start"] - s["end"])

    def nearest(x: Column) -> Column:
        free = F.filter("_at", lambda s: (s["end"] <= x["start"]) | (s["start"] >= x["end"]))
        return let(free, lambda f: let(F.array_min(F.transform(f, lambda y: gap(x, y))), lambda n: F.filter(f, lambda s: gap(x, s) == n)))

    hits = hits.withColumn("_near", F.transform(F.flatten(F.transform("_here", nearest)), lambda s: s["state"]))
    beside = let(_states(F.col("after")), lambda a: F.when(F.size(a) > 0, a).otherwise(F.coalesce(_states(F.col("before")), F.array().cast("array<string>"))))
    hits = hits.withColumn("_found", F.when(F.size("_near") > 0, F.col("_near")).otherwise(beside))
    kinds = F.array_compact(F.array(F.when(F.array_contains("_found", F.col("state")), "positive"), F.when(F.exists("_found", lambda s: s != F.col("state")), "conflict")))
    found = _best(hits.select(*keys, leaf, F.explode_outer(kinds).alias("class"), "refs").where("class is not null"), [*keys, leaf])
    status = F.when(F.col("is_conflict"), "incorrect").when(F.col("is_positive"), "correct").otherwise("missing")
    refs = F.when(F.col("is_conflict"), F.col("conflict_refs")).otherwise(F.col("positive_refs"))
    return leaves.select(*keys, leaf).join(found.hint("merge"), [*keys, leaf], "left").select(*keys, leaf, status.alias("status"), refs.alias("refs"))


def edges(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ref, source, destination): one for each arrow of a line; an arrow to the left turns its ends round."""
    parts = F.split(normalize_ascii(F.col("raw")), r"[ ]*(?=<-|->)|(?<=<-|->)[ ]*")
    rows = lines.select(*keys, "ref", F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "").alias("p"))
    rows = rows.select(*keys, "ref", "p", F.explode(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1)))).alias("i"))
    mid = F.get("p", F.col("i"))
    rows = rows.select(*keys, "ref", mid.alias("arrow"), F.get("p", F.col("i") - 1).alias("a"), F.get("p", F.col("i") + 1).alias("b")).where("arrow in ('->', '<-') and b is not null")
    return rows.select(*keys, "ref", F.when(F.col("arrow") == "->", F.col("a")).otherwise(F.col("b")).alias("source"), F.when(F.col("arrow") == "->", F.col("b")).otherwise(F.col("a")).alias("destination"))


def directed_edge(lines: DataFrame, leaves: DataFrame, keys: list[str], leaf: str = "leaf_id") -> DataFrame:
    """Edges of ``leaves(keys, leaf, source, destination)``: a reversed one beats one in order."""
    want = leaves.select(*keys, leaf, normalize_ascii(F.col("source")).alias("_s"), normalize_ascii(F.col("destination")).alias("_d"))
    e = edges(lines, keys)
    forward = want.join(e.select(*keys, F.col("source").alias("_s"), F.col("destination").alias("_d"), "ref").hint("merge"), [*keys, "_s", "_d"]).select(*keys, leaf, F.lit("positive").alias("class"), F.array("ref").alias("refs"))
    back = want.join(e.select(*keys, F.col("destination").alias("_s"), F.col("source").alias("_d"), "ref").hint("merge"), [*keys, "_s", "_d"]).select(*keys, leaf, F.lit("conflict").alias("class"), F.array("ref").alias("refs"))
    found = _best(forward.union(back), [*keys, leaf])
    status = F.when(F.col("is_conflict"), "incorrect").when(F.col("is_positive"), "correct").otherwise("missing")
    return leaves.join(found.hint("merge"), [*keys, leaf], "left").select(*keys, leaf, status.alias("status"))


def ordered_record(values: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Whether ``values(keys, pos, value)`` hold the sequence ``wanted(keys, pos, value)``.

    In order: correct; all there but in another order: incorrect; else missing. The earliest hit in turn is enough for order.
    """
    seq = lambda df, name: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda r: r["value"]).alias(name))
    rows = seq(wanted, "want").join(seq(values, "have").hint("merge"), keys, "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    fold = F.aggregate("have", F.lit(0), lambda i, v: F.when(F.get("want", i) == v, i + 1).otherwise(i))
    tally = lambda a, v: F.size(F.filter(a, lambda x: x == v))
    all_there = F.forall("want", lambda v: tally(F.col("have"), v) >= tally(F.col("want"), v))
    status = F.when(fold == F.size("want"), "correct").when(all_there, "incorrect").otherwise("missing")
    return rows.select(*keys, status.alias("status"))


def lexical_window(hits: DataFrame, groups: int, keys: list[str], within: int = 3) -> DataFrame:
    """(keys, span, first, last): the tightest run of lines that holds a hit of each of ``groups`` groups.

    ``hits(keys, ref, group_no)``: at each hit, the last line so far of every group; the run starts at the least of them.
    """
    up = Window.partitionBy(*keys).orderBy("ref").rangeBetween(Window.unboundedPreceding, 0)
    lasts = [F.max(F.when(F.col("group_no") == g, F.col("ref"))).over(up) for g in range(groups)]
    rows = hits.select(*keys, "ref", F.array(*lasts).alias("lasts")).where(F.forall("lasts", lambda x: x.isNotNull()))
    rows = rows.select(*keys, (F.col("ref") - F.array_min("lasts")).alias("span"), F.array_min("lasts").alias("first"), F.col("ref").alias("last")).where(F.col("span") <= within)
    best = F.min(F.struct("span", "first", "last")).alias("b")
    return rows.groupBy(*keys).agg(best).select(*keys, "b.span", "b.first", "b.last")
