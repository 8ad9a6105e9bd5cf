"""Lexical evidence over lines that stand near each other, and over whole documents.

Terms are ``terms(keys, leaf_id, group_no, alternative)``, obligations ``leaves(keys, leaf_id, expectation)``. A sentence ends what a
negator reaches, and a line break counts as its end, so what several sentences say together is the union of what each says: hits are
found once for each sentence, and only the numbers of groups are put together in windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import evidence_rank, is_negated, let, normalize_ascii
from .evidence import free_groups, normal_terms, places, polarity, table_units, term_hits
from .lines import candidate_lines

FRAGMENT = r"(?<=[.!?])\s+"


def fragments(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unit, ref, island, refs, text): sentences of lines that begin with no pipe, in normal form; such lines part islands."""
    w = Window.partitionBy(*keys).orderBy("ref").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.where(F.trim("raw") != "").withColumn("_pipe", F.col("raw").rlike(r"^\s*\|"))
    rows = rows.withColumn("island", F.sum(F.col("_pipe").cast("int")).over(w)).where("not _pipe")
    rows = rows.select(*keys, "ref", "island", F.posexplode(F.split("raw", FRAGMENT)).alias("at", "raw")).where(F.trim("raw") != "")
    return rows.select(*keys, F.struct("ref", "at").alias("unit"), "ref", "island", F.array("ref").alias("refs"), normalize_ascii(F.col("raw")).alias("text"))


def _held(units: DataFrame, terms: DataFrame, free: DataFrame, keys: list[str]) -> DataFrame:
    """Hits of groups in units, each with the polarity that it needs."""
    hits = term_hits(units, normal_terms(terms), keys).withColumn("_p", polarity(F.col("text"), F.col("alternative")))
    return hits.join(free.hint("merge"), [*keys, "leaf_id", "group_no"]).where("_free or _p.positive")


def _union(sets: Column) -> Column:
    return F.array_distinct(F.flatten(sets))


def lexical_resolution(docs: DataFrame, terms: DataFrame, leaves: DataFrame, keys: list[str], reach: int = 3, text: str = "text") -> DataFrame:
    """(keys, leaf_id, satisfied, refs) of every obligation: the tightest evidence that gives all its groups.

    Evidence is a row of a table with its headings, a line, two sentences of lines at most ``reach`` apart, or all lines of such
    a window; no window holds a line that begins with a pipe. Least span first, then fewest lines, then the lines as text. This
    gate never contradicts. Windows are frames over an obligation's hits alone: they begin and end with one.
    """
    free = free_groups(terms, leaves, keys)
    lines = candidate_lines(docs, keys, text)
    total = terms.groupBy(*keys, "leaf_id").agg(F.count_distinct("group_no").alias("_groups"))
    rows = _held(table_units(docs, keys, text), terms, free, keys).groupBy(*keys, "leaf_id", "unit").agg(F.count_distinct("group_no").alias("_n"), F.first("refs").alias("refs"))
    rows = rows.join(total.hint("merge"), [*keys, "leaf_id"]).where("_n = _groups").select(*keys, "leaf_id", "refs")
    hits = _held(fragments(lines, keys), terms, free, keys).groupBy(*keys, "leaf_id", "island", "ref", "unit").agg(F.collect_set("group_no").alias("g"))
    ahead = Window.partitionBy(*keys, "leaf_id", "island").orderBy("ref").rangeBetween(0, reach)
    runs = hits.withColumn("_hits", F.collect_list(F.struct("ref", "g")).over(ahead)).join(total.hint("merge"), [*keys, "leaf_id"])
    full = lambda s: F.size(s) == F.col("_groups")
    pair = F.array_min(F.transform(F.filter("_hits", lambda h: (h["ref"] > F.col("ref")) & full(F.array_union(F.col("g"), h["g"]))), lambda h: h["ref"]))
    ends = F.array_distinct(F.transform("_hits", lambda h: h["ref"]))
    upto = lambda r: _union(F.transform(F.filter("_hits", lambda h: h["ref"] <= r), lambda h: h["g"]))
    runs = runs.withColumns({"_pair": pair, "_end": F.array_min(F.filter(ends, lambda r: full(upto(r))))}).where("_end is not null")
    pairs = runs.where("_pair is not null").select(*keys, "leaf_id", F.array("ref", "_pair").alias("refs"))
    filled = lines.where(F.trim("raw") != "").select(*keys, "ref", F.collect_list("ref").over(Window.partitionBy(*keys).orderBy("ref").rangeBetween(0, reach)).alias("_near"))
    whole = runs.select(*keys, "leaf_id", "ref", "_end").distinct().join(filled.hint("merge"), [*keys, "ref"])
    whole = whole.select(*keys, "leaf_id", F.array_sort(F.filter("_near", lambda r: r <= F.col("_end"))).alias("refs"))
    best = rows.unionByName(pairs).unionByName(whole).groupBy(*keys, "leaf_id").agg(F.min_by("refs", evidence_rank(F.col("refs"))).alias("refs"))
    return total.select(*keys, "leaf_id").join(best.hint("merge"), [*keys, "leaf_id"], "left").select(*keys, "leaf_id", F.col("refs").isNotNull().alias("satisfied"), F.array_sort("refs").alias("refs"))


def covering_lines(hits: DataFrame, total: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, refs): of ``hits(keys, ref, g)``, g the groups of a line, the tightest run of lines that has all groups of ``total(keys, groups)``, thinned out.

    The run is found in one fold over the lines with hits, which keeps the last line of each group; of equal runs the first counts. In
    it lines are taken that have most of what is still lacking, the first of equals.
    """
    rows = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ref", "g"))).alias("e")).join(total.hint("merge"), keys)
    start = F.struct(F.transform("groups", lambda g: F.lit(None).cast("int")).alias("lasts"), F.lit(None).cast("struct<span:int,first:int,last:int>").alias("best"))

    def step(s: Column, x: Column) -> Column:
        lasts = F.zip_with(F.col("groups"), s["lasts"], lambda g, last: F.when(F.array_contains(x["g"], g), x["ref"]).otherwise(last))
        first = F.array_min(lasts)
        run = F.when(F.forall(lasts, lambda y: y.isNotNull()), F.struct((x["ref"] - first).alias("span"), first.alias("first"), x["ref"].alias("last")))
        return F.struct(lasts.alias("lasts"), F.when(run.isNotNull() & (s["best"].isNull() | (run["span"] < s["best"]["span"])), run).otherwise(s["best"]).alias("best"))

    rows = rows.withColumn("b", F.aggregate("e", start, step, lambda s: s["best"])).where("b is not null")
    rows = rows.withColumn("e", F.filter("e", lambda x: x["ref"].between(F.col("b.first"), F.col("b.last"))))
    pick = F.struct(F.col("groups").alias("left"), F.array().cast("array<int>").alias("refs"))

    def take(s: Column, _: Column) -> Column:
        best = F.array_max(F.transform("e", lambda x: F.struct(F.size(F.array_intersect(x["g"], s["left"])).alias("n"), (-x["ref"]).alias("at"), x["g"].alias("g"))))
        return F.when(F.size(s["left"]) > 0, F.struct(F.array_except(s["left"], best["g"]).alias("left"), F.concat(s["refs"], F.array(-best["at"])).alias("refs"))).otherwise(s)

    return rows.select(*keys, F.array_sort(F.aggregate("groups", pick, take, lambda s: s["refs"])).alias("refs"))


def strict_lexical(docs: DataFrame, terms: DataFrame, leaves: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, leaf_id, satisfied, refs) of every obligation: whether a document's lines give all its groups, wherever they stand, and the fewest near each other."""
    free = free_groups(terms, leaves, keys)
    lines = candidate_lines(docs, keys, text).where(F.trim("raw") != "")
    units = lines.select(*keys, F.col("ref").alias("unit"), "ref", F.array("ref").alias("refs"), normalize_ascii(F.col("raw")).alias("text"))
    hits = _held(units, terms, free, keys).groupBy(*keys, "leaf_id", "ref").agg(F.collect_set("group_no").alias("g"))
    total = terms.groupBy(*keys, "leaf_id").agg(F.collect_set("group_no").alias("groups"))
    found = covering_lines(hits, total, [*keys, "leaf_id"])
    return total.select(*keys, "leaf_id").join(found.hint("merge"), [*keys, "leaf_id"], "left").select(*keys, "leaf_id", F.col("refs").isNotNull().alias("satisfied"), "refs")


def compact_cover(unit_rows: DataFrame, terms: DataFrame, leaves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, leaf_id, unit, start, end): the shortest part of a text that holds all groups of an obligation, the first of equals.

    Only places of the polarity that a group needs count (see ``evidence.free_groups``). Places are swept in order: the shortest cover that
    ends with a place begins at the earliest of the groups' last places up to there, and reaches as far as any place in between.
    """
    by = [*keys, "leaf_id"]
    groups = free_groups(terms, leaves, keys)
    hits = term_hits(unit_rows, normal_terms(terms), keys).join(groups.hint("merge"), [*by, "group_no"])
    places_ = F.filter(places(F.col("text"), F.array("alternative")), lambda p: F.col("_free") | ~F.coalesce(is_negated(F.substr(F.col("text"), F.lit(1), p["start"])), F.lit(False)))
    event = hits.select(*by, "unit", F.explode(F.transform(places_, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.col("group_no").cast("int").alias("g")))).alias("e"))
    total = terms.groupBy(*by).agg(F.count_distinct("group_no").cast("int").alias("_groups"))
    rows = event.groupBy(*by, "unit").agg(F.array_sort(F.collect_set("e")).alias("e")).join(total.hint("merge"), by)
    # After each place: the number of the last place of every group met so far.
    none = F.struct(F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("last"), F.array().cast("array<struct<first:int,last:int>>").alias("covers"))

    def step(s: Column, i: Column) -> Column:
        g = F.get(F.col("e"), i)["g"]
        last = F.map_concat(F.map_filter(s["last"], lambda k, v: k != g), F.map_from_arrays(F.array(g), F.array(i)))
        cover = F.when(F.size(last) == F.col("_groups"), F.array(F.struct(F.array_min(F.map_values(last)).alias("first"), i.alias("last")))).otherwise(F.array().cast("array<struct<first:int,last:int>>"))
        return F.struct(last.alias("last"), F.concat(s["covers"], cover).alias("covers"))

    rows = rows.withColumn("_c", F.aggregate(F.sequence(F.lit(0), F.size("e") - 1), none, step)["covers"])
    reach = lambda c: F.array_max(F.transform(F.slice("e", c["first"] + 1, c["last"] - c["first"] + 1), lambda x: x["end"]))
    span = lambda c: let(F.struct(F.get(F.col("e"), c["first"])["start"].alias("start"), reach(c).alias("end")), lambda x: F.struct((x["end"] - x["start"]).alias("n"), x["start"].alias("start"), x["end"].alias("end")))
    rows = rows.withColumn("_b", F.array_min(F.transform("_c", span))).where("_b is not null")
    return rows.select(*by, "unit", "_b.start", "_b.end")
