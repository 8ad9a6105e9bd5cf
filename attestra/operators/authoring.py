"""Obligations as they are written: literals that a statement asserts, terms that must prove it, and keys of closed tables.

``leaves(keys, leaf_id, kind, expectation)`` are statements with the kind of their policy; ``terms(keys, leaf_id, role, group_no,
alternative)`` the policy's terms: of each group one alternative must be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import MONTHS, date_parts, signal_forms, signal_spans, term_forms
from ..functions.text import has_whole_phrase, let, normalize_authoring
from ..session import dealt, written

#: The roles whose groups a policy demands, by kind.
DEMANDED = {
    "lexical": ("allOf",), "ordered_tokens": ("tokens",), "qualitative": ("requiredTerms",), "table_binding": ("row", "column", "value"),
    "form_state": ("label", "state"), "directed_edge": ("source", "destination", "relation"),
}
#: Words that tell nothing of a statement.
COMMON_WORDS = (
    "about", "after", "again", "also", "and", "are", "because", "before", "belongs", "between", "candidate", "contains", "document", "during", "each", "field", "final", "from",
    "has", "have", "into", "marked", "must", "only", "page", "preserve", "preserved", "record", "region", "remains", "shown", "source", "state", "table", "that", "the", "their",
    "there", "this", "through", "value", "visible", "with", "written",
)
WORD_CHARS = r"\w"


def signals(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, leaf_id, signal_no, kind, value, forms): the literals of each expectation, one of each kind and normal form, in turn."""
    rows = leaves.select(*keys, "leaf_id", F.posexplode(signal_spans(F.col("expectation"))).alias("signal_no", "s")).select(*keys, "leaf_id", "signal_no", F.col("s.kind").alias("signal"), F.col("s.value").alias("value"))
    first = rows.withColumn("_n", normalize_authoring(F.col("value"))).groupBy(*keys, "leaf_id", "signal", "_n").agg(F.min(F.struct("signal_no", "value")).alias("x"))
    return first.select(*keys, "leaf_id", "x.signal_no", "signal", "x.value", signal_forms(F.col("signal"), F.col("x.value")).alias("forms"))


def demanded(leaves: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Terms of the groups that each obligation's policy demands; a form's state is a group of its own."""
    fits = F.lit(False)
    for kind, roles in DEMANDED.items():
        fits = fits | ((F.col("kind") == kind) & F.col("role").isin(*roles))
    return terms.join(leaves.select(*keys, "leaf_id", "kind").hint("merge"), [*keys, "leaf_id"]).where(fits & (F.trim("alternative") != ""))


def _yearless(alternative: Column, value: Column) -> Column:
    """Whether an alternative gives a date's day and month, and no year."""

    def told(d: Column) -> Column:
        name = lambda i: F.element_at(F.array(*(F.lit(m[i]) for m in MONTHS)), d["month"])
        month, day = F.concat(F.lit("(?:"), name(0), F.lit("|"), name(1), F.lit(")")), F.concat(F.lit("0?"), d["day"].cast("string"))
        pattern = F.concat(F.lit(r"(?iU)(?<![A-Za-z0-9])(?:"), day, F.lit(r"\s+"), month, F.lit(r"(?!\s+\d{4})|"), month, F.lit(r"\s+"), day, F.lit(r"(?!,?\s+\d{4}))"))
        return d.isNotNull() & F.rlike(alternative, pattern)

    return F.coalesce(~alternative.rlike(r"(?U)\b\d{4}\b") & let(date_parts(value), told), F.lit(False))


def policy_violations(leaves: DataFrame, terms: DataFrame, keys: list[str], literals: DataFrame | None = None) -> DataFrame:
    """(keys, leaf_id, signal, value, reason): literals of an expectation that its policy does not guarantee; ``literals``: its ``signals``, if they are there.

    A group guarantees a literal if every alternative has one of its forms; for a date, alternatives without the year will do beside one
    that has it. Order and direction of edges and ordered tokens are kept by their gates. What is in some alternative only is optional.
    """
    by = [*keys, "leaf_id"]
    found = (signals(leaves, keys) if literals is None else literals).join(leaves.select(*by, "kind").hint("merge"), by).where("not (kind in ('directed_edge', 'ordered_tokens') and signal = 'direction')").drop("kind")
    forms = found.select(*by, "signal_no", F.explode("forms").alias("form")).withColumn("form", normalize_authoring(F.col("form")))
    asked = demanded(leaves, terms, keys).select(*by, "role", "group_no", "alternative").distinct().withColumn("_a", normalize_authoring(F.col("alternative")))
    # An obligation's literals and terms are few, so they meet by obligation; nothing crosses from one to another.
    met = found.select(*by, "signal_no", "signal", "value").join(asked.hint("merge"), by).withColumn("year_apart", (F.col("signal") == "date") & _yearless(F.col("alternative"), F.col("value")))
    sure = met.join(forms.hint("merge"), [*by, "signal_no"]).groupBy(*by, "signal_no", "role", "group_no", "alternative").agg(F.bool_or(has_whole_phrase(F.col("_a"), F.col("form"), WORD_CHARS)).alias("sure"), F.bool_or("year_apart").alias("apart"), F.first("signal").alias("signal"))
    groups = sure.groupBy(*by, "signal_no", "role", "group_no").agg(F.bool_and("sure").alias("all"), F.bool_or("sure").alias("any"), F.bool_and(F.col("sure") | F.col("apart")).alias("eased"))
    state = groups.groupBy(*by, "signal_no").agg(F.bool_or(F.col("all") | (F.col("any") & F.col("eased"))).alias("kept"), F.bool_or("any").alias("named"))
    rows = found.join(state.hint("merge"), [*by, "signal_no"], "left").where(~F.coalesce("kept", F.lit(False)))
    reason = F.when(F.coalesce("named", F.lit(False)), "optional: one alternative of a group has it, another has not").otherwise("absent from every group")
    return rows.select(*by, "signal", "value", reason.alias("reason"))


def evidence_groups(leaves: DataFrame, keys: list[str], words: int = 3, literals: DataFrame | None = None) -> DataFrame:
    """(keys, leaf_id, group_no, alternatives): terms for statements that name none; ``literals``: their ``signals``, if they are there.

    The forms of each literal are a group; then come the longest words of four letters or more that no group has yet, at most ``words``;
    a statement with neither is a term by itself.
    """
    by = [*keys, "leaf_id"]
    flat = lambda forms: F.array_distinct(F.flatten(F.transform(forms, term_forms)))
    literal = (signals(leaves, keys) if literals is None else literals).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("signal_no", flat(F.col("forms")).alias("g")))), lambda x: x["g"]).alias("_groups"))
    rows = leaves.select(*by, "expectation").join(literal.hint("merge"), by, "left").withColumn("_groups", F.array_distinct(F.coalesce("_groups", F.array().cast("array<array<string>>"))))
    told = F.transform(F.regexp_extract_all(F.replace(F.coalesce("expectation", F.lit("")), F.lit("→"), F.lit(" -> ")), F.lit("[A-Za-z][A-Za-z-]{3,}"), F.lit(0)), F.lower)
    told = F.filter(F.array_distinct(told), lambda w: ~w.isin(*COMMON_WORDS))
    ranked = F.array_sort(F.transform(told, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    start = F.struct(F.col("_groups").alias("g"), F.lit(0).alias("n"))
    new = lambda s, w: (s["n"] < words) & ~F.exists(s["g"], lambda g: F.exists(g, lambda a: F.contains(F.lower(a), w)))
    step = lambda s, x: F.when(new(s, x["w"]), F.struct(F.concat(s["g"], F.array(F.array(x["w"]))).alias("g"), (s["n"] + 1).alias("n"))).otherwise(s)
    rows = rows.withColumn("_g", F.aggregate(ranked, start, step)["g"])
    whole = F.regexp_replace(F.trim(F.regexp_replace("expectation", r"(?U)\s+", " ")), r"^[ .]+|[ .]+$", "")
    return rows.select(*by, F.posexplode(F.when(F.size("_g") > 0, F.col("_g")).otherwise(F.array(F.array(whole)))).alias("group_no", "alternatives"))


def refined_groups(leaves: DataFrame, sections: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Inferred groups (keys, leaf_id, group_no, alternatives) of which the gold section has an alternative, and (keys, leaf_id, reason) of statements that fail.

    ``leaves`` name their ``section``, ``sections(keys, section, body)`` hold its text. A word that the section lacks is let go, a literal is not.
    Literals, groups and what is kept or fails are read several times, so each is written once.
    """
    by = [*keys, "leaf_id"]
    literals = written(signals(dealt(leaves, by), keys), "refined-literals")
    gold = sections.select(*keys, "section", normalize_authoring(F.col("body")).alias("_gold"))
    groups = written(evidence_groups(leaves, keys, literals=literals), "refined-groups")
    each = groups.select(*by, "group_no", F.explode("alternatives").alias("alternative")).withColumn("_a", normalize_authoring(F.col("alternative")))
    asked = each.groupBy(*by).agg(F.collect_list(F.struct("group_no", "_a")).alias("_asked"))
    # A section's text goes once to each of its statements, not to each alternative.
    held = asked.join(leaves.select(*by, "section").hint("merge"), by).join(gold.hint("merge"), [*keys, "section"], "left")
    held = held.select(*by, F.explode(F.array_distinct(F.transform(F.filter("_asked", lambda x: has_whole_phrase(F.col("_gold"), x["_a"], WORD_CHARS)), lambda x: x["group_no"]))).alias("group_no"))
    kept = written(groups.join(held.hint("merge"), [*by, "group_no"]), "refined-kept")
    terms = kept.select(*by, F.lit("allOf").alias("role"), "group_no", F.explode("alternatives").alias("alternative"))
    lost = policy_violations(leaves.withColumn("kind", F.lit("lexical")), terms, keys, literals).select(*by, F.concat_ws(" ", F.lit("the gold section lacks the"), "signal", "value").alias("reason"))
    none = leaves.select(*by).join(kept.select(*by).distinct().hint("merge"), by, "left_anti").withColumn("reason", F.lit("the gold section has none of the terms"))
    failed = written(lost.unionByName(none), "refined-failed")
    return kept.join(failed.select(*by).distinct().hint("merge"), by, "left_anti"), failed


def expanded_keys(regions: DataFrame, columns: DataFrame, cells: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, region_id, members) with each closed table's whole column of keys, and (keys, region_id, matches) of regions that several columns fit.

    ``regions(keys, region_id, section, members)``, ``columns(keys, region_id, leaf_id, alternative)``: headings that a region's bindings name;
    ``cells(keys, section, table_no, col, row_no, header, cell)``: the gold tables. A column fits if it holds two of the members that are
    given and its table has headings of two bindings. Where none fits, or fewer than two members or bindings are given, members stay.
    """
    n, own = normalize_authoring, [*keys, "region_id"]
    given = regions.select(*own, "section", F.explode("members").alias("member")).select(*own, "section", n(F.col("member")).alias("_m")).distinct()
    enough = given.groupBy(*own).agg(F.count("*").alias("_given")).where("_given >= 2").join(columns.groupBy(*own).agg(F.count_distinct("leaf_id").alias("_bindings")).where("_bindings >= 2").hint("merge"), own).select(*own)
    grid = [*keys, "section", "table_no"]
    said = cells.where(F.trim("cell") != "").withColumns({"_m": n(F.col("cell")), "_h": n(F.col("header"))})
    heads = said.select(*grid, "_h").distinct()
    named = columns.withColumn("_h", n(F.col("alternative"))).join(regions.select(*own, "section").hint("merge"), own).join(heads.hint("merge"), [*keys, "section", "_h"])
    named = named.groupBy(*own, "section", "table_no").agg(F.count_distinct("leaf_id").alias("_named")).where("_named >= 2")
    held = given.join(enough.hint("merge"), own).join(said.select(*grid, "col", "_m").distinct().hint("merge"), [*keys, "section", "_m"]).groupBy(*own, "section", "table_no", "col").agg(F.count("*").alias("_held")).where("_held >= 2")
    fits = held.join(named.hint("merge"), [*own, "section", "table_no"]).withColumn("matches", F.count("*").over(Window.partitionBy(*own)))
    column = F.transform(F.array_sort(F.collect_list(F.struct("row_no", F.trim("cell").alias("v")))), lambda x: x["v"])
    whole = fits.where("matches = 1").join(said.hint("merge"), [*grid, "col"]).groupBy(*own).agg(F.array_distinct(column).alias("_all"))
    rows = regions.join(whole.hint("merge"), own, "left").select(*own, F.coalesce("_all", "members").alias("members"))
    refused = fits.where("matches > 1").select(*own, "matches").distinct()
    return rows.join(refused.hint("merge"), own, "left_anti"), refused
