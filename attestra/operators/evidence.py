"""Terms found in units of text, and the gates that rest on them.

A unit is a line, a clause or a table row, ``units(keys, unit, refs, text)`` with ``text`` in normal form; terms are
``terms(keys, leaf_id, group_no, alternative)``: an obligation needs one alternative of each of its groups. Units and terms
meet by equality of one word, the longest of the alternative, and only then is the phrase looked for in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import EDGE, END, NEGATORS, evidence_rank, is_negated, let, normalize_ascii
from .lines import candidate_lines
from .tables import table_cells

CLAUSE = r";|(?<=[.!?])\s+"


def ascii_words(text: str | Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))


def phrase_pattern(phrase: Column) -> Column:
    """A pattern for a phrase, with no ASCII letter or digit running on where the phrase ends in one."""
    left = F.when(phrase.rlike("^[a-z0-9]"), "(?<![a-z0-9])").otherwise("")
    right = F.when(phrase.rlike("[a-z0-9]$"), "(?![a-z0-9])").otherwise("")
    return F.concat(left, F.lit("\\Q"), F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"), right)


def holds(text: Column, alternatives: Column) -> Column:
    """Whether a text has one of an array of phrases; null texts and arrays hold nothing."""
    return F.coalesce(F.exists(alternatives, lambda a: F.contains(text, a) & (F.regexp_instr(text, phrase_pattern(a)) > 0)), F.lit(False))


def whole_phrases(docs: DataFrame, phrases: DataFrame, doc: str, phrase: str, block: int = 8) -> DataFrame:
    """(doc, phrase): ``phrases(phrase, phrase text)`` all of whose ASCII words a text of ``docs(doc, text)`` holds in turn.

    Candidates meet by the hash of a phrase's first words, at most ``block`` of them (so of fewer for a shorter phrase), and then the
    whole phrase is looked for. Words are hashed once for each text; a phrase without words is held by none.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    hashes = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    want = phrases.select(phrase, words(F.col("phrase")).alias("_p")).where("size(_p) > 0").withColumn("_n", F.least(F.lit(block), F.size("_p")))
    want = want.withColumns({"_h": F.xxhash64("_n", F.slice(hashes(F.col("_p")), F.lit(1), F.col("_n"))), "_p": F.concat(F.lit(" "), F.array_join("_p", " "), F.lit(" "))})
    sizes = F.broadcast(want.select("_n").distinct())  # at most ``block`` rows
    said = docs.select(doc, words(F.col("text")).alias("_w")).withColumn("_hs", hashes(F.col("_w"))).join(sizes, F.size("_w") >= F.col("_n"))
    said = said.select(doc, "_n", "_hs", F.explode(F.sequence(F.lit(1), F.size("_hs") - F.col("_n") + 1)).alias("_at"))
    met = said.select(doc, F.xxhash64("_n", F.slice("_hs", F.col("_at"), F.col("_n"))).alias("_h")).join(want.select("_h", phrase, "_p").hint("merge"), "_h").select(doc, phrase, "_p").distinct()
    texts = docs.select(doc, F.concat(F.lit(" "), F.array_join(words(F.col("text")), " "), F.lit(" ")).alias("_t"))
    return met.join(texts.hint("merge"), doc).where(F.contains("_t", "_p")).select(doc, phrase).distinct()


def places(text: Column, alternatives: Column) -> Column:
    """(start, end) of all occurrences of the alternatives."""

    def of(a: Column) -> Column:
        found = F.regexp_extract_all(text, phrase_pattern(a), F.lit(0))
        return let(F.struct(F.split(text, phrase_pattern(a)).alias("parts"), F.size(found).alias("n")), lambda x: F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), x["n"])),
            lambda i: F.when(x["n"] > 0, let(F.aggregate(F.slice(x["parts"], F.lit(1), i), F.lit(0), lambda s, p: s + F.length(p)) + (i - 1) * F.length(a), lambda at: F.struct(at.alias("start"), (at + F.length(a)).alias("end")))),
        ))

    return F.array_compact(F.flatten(F.transform(alternatives, of)))


def units(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lines, their clauses, and rows of tables with their headings."""
    rows = candidate_lines(docs, keys, text).where(F.trim("raw") != "")
    parts = F.filter(F.split("raw", CLAUSE), lambda p: F.trim(p) != "")
    rows = rows.select(*keys, "ref", F.explode(F.array_distinct(F.concat(F.array("raw"), parts))).alias("part"))
    prose = rows.select(*keys, F.array("ref").alias("refs"), normalize_ascii(F.col("part")).alias("text"))
    return with_unit(prose.unionByName(_table_rows(docs, keys, text)), keys)


def _table_rows(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    cells = table_cells(docs.select(*keys, text), keys, text)
    joined = lambda c: F.array_join(F.transform(F.col("cells"), lambda x: x[c]), " . ")
    table = cells.groupBy(*keys, "table_no", "header_ref", "row_no").agg(F.collect_set("ref").alias("refs"), F.array_sort(F.collect_list(F.struct("col", "header", "cell"))).alias("cells"))
    return table.select(*keys, F.array_sort(F.array_distinct(F.concat(F.array("header_ref"), "refs"))).alias("refs"), normalize_ascii(F.concat_ws("\n", joined("header"), joined("cell"))).alias("text"))


def with_unit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows(keys, refs, text)``, each once, with ``unit``: a digest of lines and text."""
    return rows.withColumn("unit", F.sha1(F.concat_ws(",", F.transform("refs", lambda r: r.cast("string")), "text"))).dropDuplicates([*keys, "unit"])


def table_units(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Rows of tables with their headings, as units."""
    return with_unit(_table_rows(docs, keys, text), keys)


def blocking_word(phrase: Column) -> Column:
    """A phrase's longest run of ASCII letters and digits; an empty text if it has none."""
    words = F.transform(ascii_words(phrase), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    return F.coalesce(F.array_max(words)["w"], F.lit(""))


def sharing_word(rows: DataFrame, words: Column, wanted: DataFrame, wanted_words: Column, keys: list[str]) -> DataFrame:
    """``rows`` joined by ``keys`` with those of ``wanted`` that have a word in common with them, each pair once; an empty word is in all rows."""
    some = F.array_distinct(F.concat(words, F.array(F.lit(""))))
    left = rows.withColumn("_have", some).withColumn("_w", F.explode_outer("_have"))
    right = wanted.withColumn("_need", F.array_distinct(wanted_words)).withColumn("_w", F.explode_outer("_need"))
    return left.join(right.hint("merge"), [*keys, "_w"]).where(F.get(F.array_intersect("_need", "_have"), F.lit(0)) == F.col("_w")).drop("_w", "_have", "_need")


def normal_terms(terms: DataFrame) -> DataFrame:
    """Terms with their alternatives in normal form, each once. The normal form of a normal form may be another, so it is taken once."""
    return terms.withColumn("alternative", normalize_ascii(F.col("alternative"))).where("alternative <> ''").distinct()


def term_hits(unit_rows: DataFrame, normal: DataFrame, keys: list[str]) -> DataFrame:
    """``unit_rows`` with every one of the ``normal_terms`` that they hold, and ``at``: its first place, from 1.

    The terms of one document are one row, so that a unit's text is shuffled once, not once for each of its words.
    """
    own = [c for c in normal.columns if c not in keys]
    want = normal.select(*keys, F.struct(blocking_word(F.col("alternative")).alias("_w"), *own).alias("_x")).groupBy(*keys).agg(F.collect_list("_x").alias("_terms"))
    some = let(shared_words(F.transform("_terms", lambda x: x["_w"])), lambda have: F.filter("_terms", lambda x: F.array_contains(have, x["_w"])))
    # explode_outer, as explode would push a test of its array below and have the words cut twice.
    met = unit_rows.join(want.hint("merge"), keys).select(*unit_rows.columns, F.explode_outer(some).alias("_x")).where("_x is not null")
    met = met.select(*unit_rows.columns, *(F.col(f"_x.{c}").alias(c) for c in own))
    return met.where(F.contains("text", "alternative")).withColumn("at", F.regexp_instr("text", phrase_pattern(F.col("alternative")))).where("at > 0")


def shared_words(words: Column) -> Column:
    """Those of an array of words that ``text`` has; an empty word is in all texts."""
    return F.array_intersect(words, F.concat(ascii_words("text"), F.array(F.lit(""))))


def full_units(unit_rows: DataFrame, terms: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(keys, by, unit, refs): units that hold all groups of ``terms(keys, by, group_no, alternative)``.

    A unit is held against a document's obligations where it stands, so words that many of them share make no rows.
    """
    word = F.struct(blocking_word(F.col("alternative")).alias("w"), F.col("alternative").alias("a"))
    groups = normal_terms(terms).groupBy(*keys, *by, "group_no").agg(F.collect_set(word).alias("alts")).groupBy(*keys, *by).agg(F.collect_list("alts").alias("groups"))
    total = terms.groupBy(*keys, *by).agg(F.count_distinct("group_no").alias("_groups"))
    groups = groups.join(total.hint("merge"), [*keys, *by]).where("size(groups) = _groups")
    want = groups.groupBy(*keys).agg(F.collect_list(F.struct(*by, "groups")).alias("_all"))
    every = F.flatten(F.transform("_all", lambda x: F.flatten(F.transform(x["groups"], lambda g: F.transform(g, lambda a: a["w"])))))
    told = lambda x, f: F.forall(x["groups"], lambda g: F.exists(g, f))
    some = let(shared_words(every), lambda have: F.filter("_all", lambda x: told(x, lambda a: F.array_contains(have, a["w"]))))
    met = unit_rows.join(want.hint("merge"), keys).select(*keys, "unit", "refs", "text", F.explode_outer(some).alias("_x")).where("_x is not null")
    met = met.where(told(F.col("_x"), lambda a: F.regexp_instr("text", phrase_pattern(a["a"])) > 0))
    return met.select(*keys, *(F.col(f"_x.{c}").alias(c) for c in by), "unit", "refs")


def polarity(text: Column, phrase: Column) -> Column:
    """(found, positive, negated) of a phrase's occurrences in a text."""
    parts = F.split(text, phrase_pattern(phrase))
    inner = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    states = F.transform(inner, lambda i: F.coalesce(is_negated(F.call_function("array_join", F.slice(parts, F.lit(1), i), phrase)), F.lit(False)))
    return F.struct((F.size(states) > 0).alias("found"), F.exists(states, lambda x: ~x).alias("positive"), F.exists(states, lambda x: x).alias("negated"))


def _group_counts(terms: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return terms.groupBy(*keys, "leaf_id", *more).agg(F.count_distinct("group_no").alias("_groups"))


def free_groups(terms: DataFrame, leaves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, leaf_id, group_no, _free): whether a group may stand negated.

    It may if an alternative has a negator itself, or if ``leaves(keys, leaf_id, expectation)`` names it negated and never otherwise.
    """
    said = normal_terms(terms).join(leaves.select(*keys, "leaf_id", F.coalesce(normalize_ascii(F.col("expectation")), F.lit("")).alias("_e")).hint("merge"), [*keys, "leaf_id"])
    said = said.withColumn("_p", polarity(F.col("_e"), F.col("alternative"))).withColumn("_own", F.col("alternative").rlike(rf"{EDGE}(?:{NEGATORS}){END}"))
    free = F.bool_or("_own") | (F.bool_or("_p.negated") & ~F.bool_or("_p.positive"))
    return said.groupBy(*keys, "leaf_id", "group_no").agg(free.alias("_free"))


def lexical(unit_rows: DataFrame, terms: DataFrame, leaves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, leaf_id, unit, refs): units that hold all groups of an obligation, each with the polarity that it needs.

    Which groups may stand negated: see ``free_groups``. This gate never contradicts.
    """
    groups, normal = free_groups(terms, leaves, keys), normal_terms(terms)
    hits = term_hits(unit_rows, normal, keys).withColumn("_p", polarity(F.col("text"), F.col("alternative")))
    held = hits.join(groups.hint("merge"), [*keys, "leaf_id", "group_no"]).where("_free or _p.positive")
    held = held.groupBy(*keys, "leaf_id", "unit").agg(F.count_distinct("group_no").alias("_n"), F.first("refs").alias("refs"))
    return held.join(_group_counts(terms, keys).hint("merge"), [*keys, "leaf_id"]).where("_n = _groups").select(*keys, "leaf_id", "unit", "refs")


def required_bindings(unit_rows: DataFrame, bindings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, leaf_id, refs): obligations each of whose bindings has all its groups in one unit; ``bindings`` are terms with ``binding_no``."""
    by = [*keys, "leaf_id", "binding_no"]
    full = full_units(unit_rows, bindings.select(*by, "group_no", "alternative"), keys, ["leaf_id", "binding_no"])
    best = full.groupBy(*by).agg(F.min_by("refs", evidence_rank(F.col("refs"))).alias("refs"))
    total = bindings.groupBy(*keys, "leaf_id").agg(F.count_distinct("binding_no").alias("_bindings"))
    met = best.groupBy(*keys, "leaf_id").agg(F.count("*").alias("_met"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"))
    return met.join(total.hint("merge"), [*keys, "leaf_id"]).where("_met = _bindings").select(*keys, "leaf_id", "refs")


def recovered_citations(lines: DataFrame, terms: DataFrame, keys: list[str], reach: int = 2) -> DataFrame:
    """(keys, leaf_id, matched, refs): lines to cite for an obligation, at most ``reach`` apart.

    They hold half its groups, two at least, and all groups with a digit; without such groups two thirds, three at least.
    Most groups first, then the tightest, the fewest and the first lines. Best runs begin and end with a hit, so only
    lines with hits open them, and what lies between is a frame of the lines after.
    """
    some = lines.where(F.trim("raw") != "").select(*keys, "ref", F.array("ref").alias("refs"), F.col("ref").alias("unit"), normalize_ascii(F.col("raw")).alias("text"))
    digits = terms.groupBy(*keys, "leaf_id", "group_no").agg(F.bool_or(F.col("alternative").rlike("[0-9]")).alias("_digit"))
    need = digits.groupBy(*keys, "leaf_id").agg(F.count("*").alias("_groups"), F.array_compact(F.collect_list(F.when(F.col("_digit"), F.col("group_no")))).alias("_digits"))
    hits = term_hits(some, normal_terms(terms), keys).groupBy(*keys, "leaf_id", "ref").agg(F.collect_set("group_no").alias("g"))
    frame = Window.partitionBy(*keys).orderBy("ref").rangeBetween(0, reach)
    filled = some.select(*keys, "ref", F.array_sort(F.collect_list("ref").over(frame)).alias("_near"))
    ahead = Window.partitionBy(*keys, "leaf_id").orderBy("ref").rangeBetween(0, reach)
    runs = hits.withColumn("_hits", F.array_sort(F.collect_list(F.struct("ref", "g")).over(ahead)))
    least = F.when(F.size("_digits") > 0, F.greatest(F.lit(2), F.ceil(F.col("_groups") / 2))).otherwise(F.greatest(F.lit(3), F.ceil(F.col("_groups") * 2 / 3)))
    enough = lambda g: (F.size(g) >= least) & (F.size(F.array_except("_digits", g)) == 0)
    said = lambda hits: F.array_distinct(F.flatten(F.transform(hits, lambda h: h["g"])))
    # Runs that say too little go where they were made, before anything else meets them.
    runs = runs.join(need.hint("merge"), [*keys, "leaf_id"]).where(enough(said(F.col("_hits"))))
    runs = runs.withColumn("_end", F.explode(F.transform("_hits", lambda h: h["ref"])))
    runs = runs.withColumn("g", said(F.filter("_hits", lambda h: h["ref"] <= F.col("_end")))).where(enough(F.col("g")))
    runs = runs.select(*keys, "leaf_id", "ref", "_end", "g").join(filled.hint("merge"), [*keys, "ref"]).withColumn("refs", F.filter("_near", lambda r: r <= F.col("_end")))
    n = F.size("g")
    best = F.min(F.struct((-n).alias("n"), (F.col("_end") - F.col("ref")).alias("span"), F.size("refs").alias("count"), "ref", "refs")).alias("b")
    return runs.groupBy(*keys, "leaf_id").agg(best).select(*keys, "leaf_id", (-F.col("b.n")).alias("matched"), "b.refs")


def ordered_tokens(docs: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, leaf_id, in_order, refs): whether a text holds an obligation's groups one after the other, each at its earliest place in turn, and on which lines."""
    groups = terms.withColumn("alternative", normalize_ascii(F.col("alternative"))).groupBy(*keys, "leaf_id", "group_no").agg(F.collect_set(F.when(F.col("alternative") != "", F.col("alternative"))).alias("alts"))
    groups = groups.groupBy(*keys, "leaf_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("group_no", "alts"))), lambda g: g["alts"]).alias("groups"))
    said = candidate_lines(docs, keys).select(*keys, F.struct("ref", normalize_ascii(F.col("raw")).alias("t")).alias("x")).where("x.t <> ''")
    said = said.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x"))
    said = said.select(*keys, F.transform("x", lambda x: x["ref"]).alias("_refs"), F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("text"))
    rows = groups.join(said.hint("merge"), keys, "left").withColumn("text", F.coalesce("text", F.lit("")))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("hits"))

    def step(state: Column, alts: Column) -> Column:
        rest = F.substr(F.col("text"), state["at"])
        ends = F.transform(alts, lambda a: F.struct(F.regexp_instr(rest, phrase_pattern(a)).alias("at"), (-F.length(a)).alias("n")))
        first = F.array_min(F.filter(ends, lambda e: e["at"] > 0))
        hit = state["at"] + first["at"] - 1
        return F.when((state["at"] > 0) & first.isNotNull(), F.struct((hit - first["n"]).alias("at"), F.concat(state["hits"], F.array(hit)).alias("hits"))).otherwise(F.struct(F.lit(0).alias("at"), state["hits"].alias("hits")))

    rows = rows.withColumn("_f", F.aggregate("groups", start, step)).withColumn("in_order", F.col("_f.at") > 0)
    before = lambda p: F.substr(F.col("text"), F.lit(1), p - 1)
    line = lambda p: F.get("_refs", F.length(before(p)) - F.length(F.replace(before(p), F.lit("\n"), F.lit(""))))
    return rows.select(*keys, "leaf_id", "in_order", F.when(F.col("in_order"), F.array_sort(F.array_distinct(F.transform("_f.hits", line)))).alias("refs"))


#: Words that place something, each with those that say the same.
SPATIAL = {
    "west": ("west", "left"),
    "east": ("east", "right"),
    "north": ("north", "upper", "top", "above"),
    "south": ("south", "lower", "bottom", "below"),
    "shared": ("shared", "between", "adjoin", "adjoins", "adjacent"),
    "middle": ("middle", "center", "centre"),
    "adjacent": ("adjacent", "beside", "nearby", "next"),
}
#: Cues of place, route and line that a visual statement has to give, each with the endings that it may have.
CUES = (
    "west", "east", "north", "south", "left", "right", "upper", "lower", "top", "bottom", "above", "below", "between", "adjacent", "beside", "nearby", "inside", "outside",
    "middle", "center", "centre", "shared", "adjoin(?:s|ing)?", "callout", "point(?:s|ing|ed)?", "key(?:s|ing|ed)?", "target(?:s|ing|ed)?", "connect(?:s|ing|ed)?",
    "route(?:s|ing|ed)?", "run(?:s|ning)?", "shift(?:s|ing|ed)?", "swing(?:s|ing)?", "enter(?:s|ing|ed)?", "occup(?:y|ies|ied)", "mount(?:s|ing|ed)?", "locat(?:e|es|ed|ion)",
    "dimension(?:s|ed)?", "overall", "footprint", "wall", "jamb", "side", "arrow", "path", "row", "column", "grid", "position", "dashed", "solid", "current", "archived", "superseded", "void",
)
#: A line that heads measures of a whole plan.
MEASURES = r"(?i)\b(?:overall|plan)\s+(?:dimensions?|footprint)\s*:?\s*$"


def has_cue(text: Column) -> Column:
    """Whether a text has a cue, in a form that it may have."""
    return text.rlike(r"\b(?:" + "|".join(CUES) + r")\b")


def _ranges(text: Column) -> Column:
    """``Name3-4`` as ``Name3 Name4``."""
    return F.regexp_replace(text, r"\b([A-Za-z]+)(\d+)-(\d+)\b", "$1$2 $1$3")


def _all_words(text_words: Column, phrase: Column) -> Column:
    own = F.regexp_extract_all(phrase, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return (F.size(own) > 0) & (F.size(F.array_except(own, text_words)) == 0)


def visual_citations(lines: DataFrame, cited: DataFrame, terms: DataFrame, leaves: DataFrame, keys: list[str], above: int = 7, bindings: DataFrame | None = None) -> DataFrame:
    """(keys, leaf_id, anchored): whether cited lines anchor a visual obligation; ``cited(keys, leaf_id, ref)``.

    Read with the nearest heading at most ``above`` lines before each, they must hold one group, one of the groups with a digit if
    there are any, and a cue of place or route if ``leaves(keys, leaf_id, expectation)`` has one, unless a cited line is a
    table row, a line at most two above heads measures of the whole, or the obligation has local bindings. An alternative is held as a
    phrase, by a word of place that says the same, or by all its words. Each of the local ``bindings``, terms with ``binding_no``,
    must have all its groups in one cited line or clause.
    """
    up = Window.partitionBy(*keys).orderBy("ref").rowsBetween(-above, -1)
    near = Window.partitionBy(*keys).orderBy("ref").rowsBetween(-2, -1)
    head = F.last(F.when(F.col("raw").rlike(r"^\s*#{1,6}\s+\S"), F.col("raw")), ignorenulls=True).over(up)
    measured = F.coalesce(F.max(F.col("raw").rlike(MEASURES)).over(near), F.lit(False))
    rows = lines.withColumns({"_head": head, "_measured": measured}).join(cited.distinct().hint("merge"), [*keys, "ref"]).withColumn("_row", F.col("raw").rlike(r"(?i)^\s*\||</?(?:table|tr|td|th)\b"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref", "raw"))), lambda r: r["raw"]), "\n")
    read = rows.groupBy(*keys, "leaf_id").agg(text.alias("_cited"), F.concat_ws("\n", F.collect_set("_head"), text).alias("_all"), F.bool_or(F.col("_row") | F.col("_measured")).alias("_table"))
    read = read.withColumns({"_cited": normalize_ascii(F.col("_cited")), "_all": normalize_ascii(_ranges(F.col("_all")))})
    want = normal_terms(terms.withColumn("alternative", _ranges(F.col("alternative"))))
    same = F.create_map(*(x for k, v in SPATIAL.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    words = F.regexp_extract_all("_all", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    met = (F.regexp_instr("_all", phrase_pattern(F.col("alternative"))) > 0) | F.coalesce(F.arrays_overlap(words, F.get(F.array(same[F.col("alternative")]), F.lit(0))), F.lit(False)) | _all_words(words, F.col("alternative"))
    groups = read.join(want.hint("merge"), [*keys, "leaf_id"]).withColumn("_met", met).groupBy(*keys, "leaf_id", "group_no").agg(F.bool_or("_met").alias("met"), F.bool_or(F.col("alternative").rlike("[0-9]")).alias("digit"), F.first("_cited").alias("_cited"), F.first("_table").alias("_table"))
    found = groups.groupBy(*keys, "leaf_id").agg(F.bool_or("met").alias("any"), F.bool_or("digit").alias("ids"), F.bool_or(F.col("met") & F.col("digit")).alias("id_met"), F.first("_cited").alias("_cited"), F.first("_table").alias("_table"))
    found = leaves.select(*keys, "leaf_id", normalize_ascii(F.col("expectation")).alias("_e")).join(found.hint("merge"), [*keys, "leaf_id"], "left").withColumns({"_bound": F.lit(True), "_local": F.lit(False)})
    if bindings is not None:
        unit = F.explode(F.array_distinct(F.concat(F.array("raw"), F.split("raw", CLAUSE))))
        said = rows.select(*keys, "leaf_id", "ref", unit.alias("u")).select(*keys, "leaf_id", "ref", normalize_ascii(F.col("u")).alias("u")).where("u <> ''")
        inside = (F.regexp_instr("u", phrase_pattern(F.col("alternative"))) > 0) | _all_words(F.regexp_extract_all("u", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.col("alternative"))
        full = said.join(normal_terms(bindings).hint("merge"), [*keys, "leaf_id"]).where(inside).groupBy(*keys, "leaf_id", "binding_no", "ref", "u").agg(F.count_distinct("group_no").alias("_n"))
        full = full.join(_group_counts(bindings, keys, "binding_no").hint("merge"), [*keys, "leaf_id", "binding_no"]).where("_n = _groups").groupBy(*keys, "leaf_id").agg(F.count_distinct("binding_no").alias("_met"))
        total = bindings.groupBy(*keys, "leaf_id").agg(F.count_distinct("binding_no").alias("_bindings"))
        found = found.join(total.hint("merge"), [*keys, "leaf_id"], "left").join(full.hint("merge"), [*keys, "leaf_id"], "left")
        found = found.withColumns({"_local": F.col("_bindings").isNotNull(), "_bound": F.col("_bindings").isNull() | (F.coalesce("_met", F.lit(0)) == F.col("_bindings"))})
    cue = ~F.coalesce(has_cue(F.col("_e")), F.lit(False)) | has_cue(F.col("_cited")) | F.col("_table") | F.col("_local")
    return found.select(*keys, "leaf_id", F.coalesce(F.col("any") & (~F.col("ids") | F.col("id_met")) & cue & F.col("_bound"), F.lit(False)).alias("anchored"))
