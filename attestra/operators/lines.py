"""Lines, pages and headings of candidate documents, keyed by any columns that tell documents apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidate_lines(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """A row for each line, ``ref`` from 1; an empty last line counts."""
    lines = F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return docs.select(*keys, F.posexplode(lines).alias("at", "raw")).select(*keys, (F.col("at") + 1).alias("ref"), "raw")


def by(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("ref")


def carried_heading(lines: DataFrame, keys: list[str], within: int | None = None) -> DataFrame:
    """``lines`` with the nearest heading at or above each, and its line; ``within``: at most so many lines above."""
    up = by(keys).rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("raw", r"^#{1,6}[ ]+(.*)$", 1)
    at = F.last(F.when(F.col("raw").rlike("^#{1,6}[ ]"), F.struct(F.trim(head).alias("heading"), F.col("ref").alias("heading_ref"))), ignorenulls=True).over(up)
    if within is not None:
        at = F.when(F.col("ref") - at["heading_ref"] <= within, at)
    return lines.withColumns({"heading": at["heading"], "heading_ref": at["heading_ref"]})


def sections(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, section, body, copies): text under each ``## `` heading; ``copies`` over 1 is a repeated heading."""
    up = by(keys).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("number", F.sum(F.col("raw").startswith("## ").cast("int")).over(up)).where("number > 0")
    made = marked.groupBy(*keys, "number").agg(F.array_sort(F.collect_list(F.struct("ref", "raw"))).alias("rows"))
    made = made.select(*keys, F.trim(F.substr(F.col("rows")[0]["raw"], F.lit(4))).alias("section"), F.array_join(F.transform(F.slice("rows", F.lit(2), F.size("rows")), lambda r: r["raw"]), "\n").alias("body"))
    return made.withColumn("copies", F.count("*").over(Window.partitionBy(*keys, "section")))


def page_map(lines: DataFrame, keys: list[str], pages: str = "n_pages") -> DataFrame:
    """``lines`` with the page of each line or null, from ``PAGE n`` marks and trusted ``n/m`` counters.

    The trusted total is the counters' own where one total has two pages or more, else ``pages``. Marks of one page in a
    row count once; a mark with a lower page than the one before makes the whole map null. Then, in this order:

    * footers: all marks are counters that end a block of over six lines and stand before a rule (``---`` or ``***``);
      a page is what ends with its counter, if the counter before is that of the page before;
    * blocks: the rules cut the text into as many blocks as there are pages; all null if a mark is in another's block;
    * marks: a page runs from its mark to that of the next page; where pages are missing between, or nothing follows
      one that isn't the last, up to the first rule, or else it is the mark's line alone.
    """
    w, everything = by(keys), Window.partitionBy(*keys)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    counter = F.regexp_extract(F.trim(F.regexp_replace("raw", r"[*_`]", "")), r"(?:^|[^0-9+])([0-9]{1,3}\s*/\s*[0-9]{1,3})\s*>?\s*$", 1)
    # Few lines have a slash, and only these are searched for counters. A cast that fails is dear, so nothing empty is cast.
    rows = lines.withColumn("_c", F.when(F.contains(F.col("raw"), F.lit("/")), F.split(F.nullif(counter, F.lit("")), "/")))
    n, m = F.trim(F.get("_c", F.lit(0))).try_cast("int"), F.trim(F.get("_c", F.lit(1))).try_cast("int")
    good = (n >= 1) & (n <= m) & (m >= 2)
    named = F.nullif(F.regexp_extract("raw", r"(?i)^\s*(?:<!--\s*)?(?:#{1,6}\s*)?page\s*:?\s*([0-9]{1,9})\b", 1), F.lit("")).try_cast("int")
    rows = rows.withColumns({"_n": F.when(good, n), "_m": F.when(good, m), "_named": named, "_rule": F.col("raw").rlike(r"^\s*(?:-{3,}|\*{3,})\s*$").cast("int"), "_filled": (F.trim("raw") != "").cast("int")}).drop("_c")
    totals = rows.where("_n is not null").groupBy(*keys, "_m").agg(F.count_distinct("_n").alias("_d"), F.count("*").alias("_c"), F.min("ref").alias("_f")).where("_d >= 2")
    trusted = totals.groupBy(*keys).agg(F.max_by("_m", F.struct("_d", "_c", -F.col("_f"))).alias("_total"))
    rows = rows.join(trusted.hint("merge"), keys, "left").withColumn("_total", F.coalesce("_total", F.col(pages)))
    rows = rows.withColumn("_count", F.when(F.col("_m") == F.col("_total"), F.col("_n"))).withColumn("_mark", F.coalesce("_named", "_count"))
    rows = rows.withColumn("_mark", F.when((F.col("_mark") >= 1) & F.coalesce(F.col("_mark") <= F.col("_total"), F.lit(True)), F.col("_mark")))
    last = F.last("_mark", ignorenulls=True).over(before)
    rows = rows.withColumns({"_down": F.coalesce(F.col("_mark") < last, F.lit(False)), "_anchor": F.when(last.isNull() | (F.col("_mark") != last), F.col("_mark")), "_block": 1 + F.coalesce(F.sum("_rule").over(before), F.lit(0)), "_above": F.coalesce(F.sum("_filled").over(before), F.lit(0)), "_after": F.coalesce(F.lag("_rule").over(w), F.lit(1)) == 1})
    # Lines of the block so far: those of the text so far without those above the block. A run is a mark's lines up to the next one.
    full = F.col("_above") - F.last(F.when(F.col("_after"), F.col("_above")), ignorenulls=True).over(upto)
    foot = (F.col("_count") == F.col("_anchor")) & (full > 6) & ((F.col("_anchor") == F.col("_total")) | (F.max("_rule").over(w.rowsBetween(1, 2)) == 1))
    rows = rows.withColumns({
        "_foot": F.when(F.col("_anchor").isNotNull(), F.coalesce(foot, F.lit(False))),
        "_odd": F.col("_anchor") != F.col("_block"),
        "_page": F.last("_anchor", ignorenulls=True).over(upto),
        "_prior": F.last("_anchor", ignorenulls=True).over(before),
        "_run": F.count("_anchor").over(upto),
    })
    whole = lambda f: f.over(everything)
    rows = rows.withColumns({
        "_bad": whole(F.bool_or("_down")),
        "_footers": (whole(F.count("_anchor")) >= 2) & whole(F.bool_and("_foot")),
        "_blocks": whole(F.max("_block")) == F.col("_total"),
        "_mixed": F.coalesce(whole(F.bool_or("_odd")), F.lit(False)),
    })
    # A frame up to the end would be gone through again for each line, so the next mark is looked up by its run. Runs are pages, if none goes down.
    rows = rows.withColumn("_next", F.first("_anchor", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_run").rangeBetween(1, 1)))
    rows = rows.withColumn("_ends", F.coalesce("_anchor", "_next"))
    span = Window.partitionBy(*keys, "_run")
    cut = (F.max("_block").over(span) > F.min("_block").over(span)) & (F.col("_block") == F.min("_block").over(span))
    to_next = (F.col("_next") == F.col("_page") + 1) | (F.col("_next").isNull() & (F.col("_total").isNull() | (F.col("_page") == F.col("_total"))))
    marks = F.when(F.coalesce(to_next, F.lit(False)) | cut | F.col("_anchor").isNotNull(), F.col("_page"))
    footers = F.when((F.col("_ends") == 1) | (F.col("_prior") == F.col("_ends") - 1), F.col("_ends"))
    page = F.when(F.col("_bad"), None).when(F.coalesce("_footers", F.lit(False)), footers).when(F.coalesce("_blocks", F.lit(False)), F.when(~F.col("_mixed"), F.col("_block"))).otherwise(marks)
    return rows.withColumn("page", page.cast("int")).select(*lines.columns, "page")


def page_scoped(lines: DataFrame, allowed: str, keys: list[str] | None = None) -> DataFrame:
    """Lines off the pages of the array column ``allowed`` made blank; numbers stay, and no map means no scope.

    With ``keys``, a document that has a page anywhere loses its lines of no page too; without, they stay.
    """
    on = F.array_contains(F.col(allowed), F.col("page"))
    if keys is None:
        return lines.withColumn("raw", F.when(F.col("page").isNull() | on, F.col("raw")).otherwise(""))
    mapped = F.max("page").over(Window.partitionBy(*keys)).isNotNull()
    return lines.withColumn("raw", F.when(~mapped | F.coalesce(on, F.lit(False)), F.col("raw")).otherwise(""))


def numbered(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, numbered): the lines as one text, each with its number."""
    rows = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ref", F.format_string("L%04d | %s", "ref", "raw").alias("line")))).alias("rows"))
    return rows.select(*keys, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("numbered"))


def bridges(lines: DataFrame, keys: list[str], within: int = 3, shared: int = 2, letters: int = 5) -> DataFrame:
    """(keys, ref, other, n): lines at most ``within`` apart that share ``shared`` words of ``letters`` or more."""
    words = lines.select(*keys, "ref", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.lower("raw"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.regexp_replace(w, "s$", "")))).alias("word")).where(F.length("word") >= letters)
    # A band of ``within + 1`` lines makes the range an equality: each line is offered to its own band and the next.
    size = within + 1
    banded = words.withColumn("band", F.floor(F.col("ref") / size))
    offered = words.select(*keys, F.col("ref").alias("other"), "word", F.explode(F.array(F.floor(F.col("ref") / size), F.floor(F.col("ref") / size) - 1)).alias("band"))
    pairs = banded.join(offered.hint("merge"), [*keys, "word", "band"]).where((F.col("other") > F.col("ref")) & (F.col("other") - F.col("ref") <= within))
    return pairs.groupBy(*keys, "ref", "other").agg(F.count("*").alias("n")).where(F.col("n") >= shared)
