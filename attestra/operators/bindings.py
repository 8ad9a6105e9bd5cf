"""Row, column and value bindings over tables, plain columns, prose and key-value lists.

Obligations are ``terms(keys, leaf_id, role, group_no, alternative)`` with the roles row, rowParts, column and value, as the reader of
facts gives them. A row is named by one alternative of ``row``, or by all groups of ``rowParts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import evidence_rank, let, normalize_ascii, plain_cells
from .evidence import CLAUSE, normal_terms, phrase_pattern, term_hits
from .lines import candidate_lines
from .tables import table_cells

#: Short forms in headings.
HEADER_WORDS = {"admin": "administrative", "qty": "quantity", "desc": "description", "ts": "timestamp"}
#: Words that turn a value round.
VALUE_NEGATORS = ("no", "not", "never", "without", "neither", "nor")
CONNECTOR = r"^\s*(?:is|was|=|:)\s*"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether the words of ``short``, at least one, stand in ``long`` in that order."""
    met = lambda x: F.aggregate(x["long"], F.lit(0), lambda i, w: F.when(F.get(x["short"], i) == w, i + 1).otherwise(i))
    # Both are worked out once, not once for each word.
    return let(F.struct(short.alias("short"), long.alias("long")), lambda x: (F.size(x["short"]) > 0) & (met(x) == F.size(x["short"])))


def is_incomplete(value: Column, whole: Column) -> Column:
    """Whether a value is a part of another: some of its words in order, or one of its words broken up; negated alike."""
    a, b = words_of(value), words_of(whole)
    denied = lambda ws: F.arrays_overlap(ws, F.array(*map(F.lit, VALUE_NEGATORS)))
    return (F.size(a) > 0) & (F.size(b) > F.size(a)) & (denied(a) == denied(b)) & (F.array_contains(b, F.array_join(a, "")) | is_subsequence(a, b))


def header_words(text: Column) -> Column:
    def full(w: Column) -> Column:
        out = w
        for short, long in HEADER_WORDS.items():
            out = F.when(w == short, long).otherwise(out)
        return out

    return F.transform(words_of(text), full)


def header_matches(header: Column, wanted: Column) -> Column:
    """Equal, or held as a phrase, or the words of the shorter in the longer: two at least, or one of seven letters."""

    def alike(x: Column) -> Column:
        swap = F.size(x["a"]) > F.size(x["b"])
        short, long = F.when(swap, x["b"]).otherwise(x["a"]), F.when(swap, x["a"]).otherwise(x["b"])
        telling = (F.size(short) >= 2) | (F.length(F.coalesce(F.get(short, F.lit(0)), F.lit(""))) >= 7)
        return telling & is_subsequence(short, long)

    held = F.contains(header, wanted) & (F.regexp_instr(header, phrase_pattern(wanted)) > 0)
    return (header == wanted) | held | let(F.struct(header_words(header).alias("a"), header_words(wanted).alias("b")), alike)


def marked_grids(docs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Headings (keys, grid, header_ref, col, header) and cells (keys, grid, row, ref, col, cell) of Markdown and HTML tables, in normal form."""
    c = table_cells(docs, keys).withColumn("grid", F.concat("kind", F.col("table_no").cast("string"), F.lit(":"), F.col("header_ref").cast("string")))
    heads = c.select(*keys, "grid", "header_ref", "col", normalize_ascii(F.col("header")).alias("header")).distinct()
    return heads, c.select(*keys, "grid", F.col("row_no").alias("row"), "ref", "col", normalize_ascii(F.col("cell")).alias("cell"))


def plain_grids(docs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The same of plain columns: runs of lines with one number of cells, each of which may head those below it."""
    rows = candidate_lines(docs, keys).withColumn("cells", plain_cells(F.col("raw"))).where("cells is null or not forall(cells, c -> c rlike '^:?-{3,}:?$')")
    w = Window.partitionBy(*keys).orderBy("ref")
    new = F.col("cells").isNull() | ~F.size("cells").eqNullSafe(F.size(F.lag("cells").over(w))) | F.lag("cells").over(w).isNull()
    rows = rows.withColumn("grid", F.concat(F.lit("plain"), F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("string"))).where("cells is not null")
    cells = rows.select(*keys, "grid", F.col("ref").alias("row"), "ref", F.posexplode("cells").alias("col", "cell")).withColumn("cell", normalize_ascii(F.col("cell")))
    return cells.select(*keys, "grid", F.col("ref").alias("header_ref"), "col", F.col("cell").alias("header")), cells


def _role(terms: DataFrame, keys: list[str], role: str) -> DataFrame:
    return terms.where(F.col("role") == role).transform(normal_terms).select(*keys, "leaf_id", "group_no", "alternative")


def _all_parts(hits: DataFrame, terms: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Rows of ``hits`` by ``by`` that have every group of ``rowParts``."""
    total = terms.where("role = 'rowParts'").groupBy(*keys, "leaf_id").agg(F.count_distinct("group_no").alias("_groups"))
    return hits.groupBy(*by).agg(F.count_distinct("group_no").alias("_n")).join(total.hint("merge"), [*keys, "leaf_id"]).where("_n = _groups").select(*by)


def grid_values(heads: DataFrame, cells: DataFrame, terms: DataFrame, keys: list[str], fuzzy: bool = False) -> DataFrame:
    """(keys, leaf_id, refs, value): cells under a wanted heading in a wanted row, whose key stands in another column."""
    column = _role(terms, keys, "column")
    if fuzzy:
        split = lambda df, c: df.withColumn("_w", F.explode(F.array_distinct(header_words(F.col(c)))))
        met = split(heads, "header").join(split(column, "alternative").hint("merge"), [*keys, "_w"]).drop("_w").where(header_matches(F.col("header"), F.col("alternative")))
    else:
        met = heads.join(column.withColumnRenamed("alternative", "header").hint("merge"), [*keys, "header"])
    met = met.select(*keys, "leaf_id", "grid", "header_ref", "col").distinct()
    # A named row is met before the column's cells, so that no obligation meets all rows of a table.
    at = [*keys, "leaf_id", "grid", "row", "col", "header_ref", "ref", "value"]

    def under(rows: DataFrame) -> DataFrame:
        placed = rows.join(met.hint("merge"), [*keys, "leaf_id", "grid"]).where("_kc <> col").join(cells.hint("merge"), [*keys, "grid", "row", "col"])
        return placed.where("ref > header_ref or grid not like 'plain%'").withColumnRenamed("cell", "value")

    named = cells.withColumnRenamed("cell", "alternative").join(_role(terms, keys, "row").hint("merge"), [*keys, "alternative"]).select(*keys, "leaf_id", "grid", "row", F.col("col").alias("_kc"))
    whole = under(named).select(*at)
    units = cells.select(*keys, F.struct("grid", "row", "col").alias("unit"), F.col("cell").alias("text"))
    part = term_hits(units, _role(terms, keys, "rowParts"), keys).select(*keys, "leaf_id", "group_no", "unit.grid", "unit.row", F.col("unit.col").alias("_kc"))
    parts = _all_parts(under(part), terms, keys, at)
    return whole.unionByName(parts).distinct().select(*keys, "leaf_id", F.array("header_ref", "ref").alias("refs"), "value")


def _rows_named(units: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Units of text that name an obligation's row."""
    by = [*units.columns, "leaf_id"]
    whole = term_hits(units, _role(terms, keys, "row"), keys).select(*by)
    parts = _all_parts(term_hits(units, _role(terms, keys, "rowParts"), keys), terms, keys, by)
    return whole.unionByName(parts).distinct()


def _clauses(docs: DataFrame, keys: list[str], whole: bool) -> DataFrame:
    parts = F.split("raw", CLAUSE)
    rows = candidate_lines(docs, keys).select(*keys, "ref", F.explode(F.array_distinct(F.concat(F.array("raw"), parts) if whole else parts)).alias("raw"))
    return rows.select(*keys, "ref", normalize_ascii(F.col("raw")).alias("text")).where("text <> ''")


def _said(units: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, leaf_id, ref, rest): what stands after a wanted column in clauses that name the row."""
    hits = term_hits(_rows_named(units, terms, keys), _role(terms, keys, "column"), [*keys, "leaf_id"])
    rest = F.substr(F.col("text"), F.col("at") + F.length("alternative"))
    return hits.select(*keys, "leaf_id", "ref", rest.alias("rest")).where(F.col("rest").rlike(CONNECTOR + r"\S"))


def _values(terms: DataFrame, keys: list[str]) -> DataFrame:
    return _role(terms, keys, "value").groupBy(*keys, "leaf_id").agg(F.collect_set("alternative").alias("values"))


def _keyed(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ref, text, listed): ``key: value`` lines, the key in normal form."""
    line = r"^\s*(?:[-+*]\s+)?([^:|]{1,160})\s*:\s*(\S.*)$"
    rows = candidate_lines(docs, keys).where(F.col("raw").rlike(line))
    return rows.select(*keys, "ref", normalize_ascii(F.regexp_extract("raw", line, 1)).alias("text"), normalize_ascii(F.regexp_extract("raw", line, 2)).alias("listed"))


def binding(docs: DataFrame, terms: DataFrame, keys: list[str], above: int = 6) -> DataFrame:
    """(keys, leaf_id, status, partial, refs) of every obligation.

    A conflict in a table beats a match anywhere. A conflict in prose counts only where nothing matches. A value that is but a
    part of the expected one is partial, hence missing. A ``key: value`` line under lines that name the column can only match.
    """
    wanted = terms.select(*keys, "leaf_id").distinct().join(_values(terms, keys).hint("merge"), [*keys, "leaf_id"], "left")
    found = grid_values(*marked_grids(docs, keys), terms, keys).unionByName(grid_values(*plain_grids(docs, keys), terms, keys)).join(wanted.hint("merge"), [*keys, "leaf_id"])
    same, part = F.array_contains("values", F.col("value")), F.exists("values", lambda v: is_incomplete(F.col("value"), v))
    kind = F.when(same, "positive").when(part, "partial").when(F.col("value") != "", "conflict")
    found = found.select(*keys, "leaf_id", kind.alias("class"), "refs").where("class is not null")
    said = _said(_clauses(docs, keys, False), terms, keys).join(wanted.hint("merge"), [*keys, "leaf_id"])
    exact = F.exists("values", lambda v: F.regexp_instr("rest", F.concat(F.lit(CONNECTOR), phrase_pattern(v))) > 0)
    any_ = F.exists("values", lambda v: F.regexp_instr("rest", phrase_pattern(v)) > 0)
    said = said.select(*keys, "leaf_id", F.when(exact, "positive").when(~any_, "prose").alias("class"), F.array("ref").alias("refs")).where("class is not null")
    listed = _rows_named(_keyed(docs, keys), terms, keys)
    plain = candidate_lines(docs, keys).select(*keys, F.col("ref").alias("_at"), normalize_ascii(F.col("raw")).alias("text"))
    headed = term_hits(plain, _role(terms, keys, "column"), keys).select(*keys, "leaf_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(above)), lambda i: F.col("_at") + i)).alias("ref")).distinct()
    listed = listed.join(headed.hint("merge"), [*keys, "leaf_id", "ref"]).join(wanted.hint("merge"), [*keys, "leaf_id"]).where(F.exists("values", lambda v: F.regexp_instr("listed", phrase_pattern(v)) > 0))
    everything = found.unionByName(said).unionByName(listed.select(*keys, "leaf_id", F.lit("positive").alias("class"), F.array("ref").alias("refs")))
    best = lambda *cs: F.min_by("refs", F.when(F.col("class").isin(*cs), evidence_rank(F.col("refs"))))
    got = everything.groupBy(*keys, "leaf_id").agg(best("positive").alias("_p"), best("conflict").alias("_c"), best("conflict", "prose").alias("_any"), best("partial").alias("_part"))
    conflict = F.when(F.col("_p").isNotNull(), F.col("_c")).otherwise(F.col("_any"))
    rows = wanted.select(*keys, "leaf_id").join(got.hint("merge"), [*keys, "leaf_id"], "left").withColumn("_x", conflict)
    status = F.when(F.col("_x").isNotNull(), "incorrect").when(F.col("_p").isNotNull(), "correct").otherwise("missing")
    return rows.select(*keys, "leaf_id", status.alias("status"), ((status == "missing") & F.col("_part").isNotNull()).alias("partial"), F.coalesce("_x", "_p", "_part").alias("refs"))


def near_binding(docs: DataFrame, terms: DataFrame, keys: list[str], above: int = 6) -> DataFrame:
    """(keys, leaf_id, refs): obligations whose row stands with its column somewhere, whatever the value.

    Tables with a heading that is alike, clauses that say something of the column, and ``column: ...`` lines at most ``above``
    lines under a heading that names the row.
    """
    table = grid_values(*marked_grids(docs, keys), terms, keys, fuzzy=True).where("value <> ''").select(*keys, "leaf_id", "refs")
    prose = _said(_clauses(docs, keys, True), terms, keys).select(*keys, "leaf_id", F.array("ref").alias("refs"))
    heads = candidate_lines(docs, keys).withColumn("_h", F.regexp_extract("raw", r"^\s*#{1,6}\s+(.+)$", 1)).where("_h <> ''")
    heads = heads.withColumn("_until", F.coalesce(F.lead("ref").over(Window.partitionBy(*keys).orderBy("ref")), F.lit(1 << 30)))
    named = _rows_named(heads.select(*keys, F.col("ref").alias("_head"), "_until", normalize_ascii(F.col("_h")).alias("text")), terms, keys)
    named = named.select(*keys, "leaf_id", "_head", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.lit(above)), lambda i: F.col("_head") + i), lambda r: r < F.col("_until"))).alias("ref"))
    keyed = term_hits(_keyed(docs, keys), _role(terms, keys, "column"), keys).select(*keys, "leaf_id", "ref").distinct()
    under = named.join(keyed.hint("merge"), [*keys, "leaf_id", "ref"]).select(*keys, "leaf_id", F.array("_head", "ref").alias("refs"))
    every = table.unionByName(prose).unionByName(under)
    return every.groupBy(*keys, "leaf_id").agg(F.min_by("refs", evidence_rank(F.col("refs"))).alias("refs"))
