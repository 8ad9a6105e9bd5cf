"""Closed worlds held against their gold sections: members that give ids away, that the section lacks, or that are no column of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_whole_phrase, normalize_audit
from .tables import table_cells


def column_member_sets(sections: DataFrame, keys: list[str], text: str = "body") -> DataFrame:
    """(keys, section, table_no, col, members): the distinct members of each column of each Markdown table, sorted, in the audit's normal form."""
    cells = table_cells(sections.select(*keys, "section", text), [*keys, "section"], text).where("kind = 'md'")
    said = cells.withColumn("_v", normalize_audit(F.col("cell"))).where("_v <> ''")
    return said.groupBy(*keys, "section", "table_no", "header_ref", "col").agg(F.array_sort(F.collect_set("_v")).alias("members"))


def closed_world_violations(regions: DataFrame, leaves: DataFrame, sections: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, region_id, rule, subject): what is wrong with the closed worlds of ``regions(keys, region_id, section, scope, members)``.

    ``leaves(keys, region_id, leaf_id, claim_id)``, ``sections(keys, section, body)``. Rules: the section is absent; a member is the id of an
    obligation or claim of its region; the section does not hold a member as a whole phrase; the members of a region of scope
    ``table_rows`` are not the member set of exactly one column (``subject``: of how many). A region without members is not looked at.
    """
    n, own = normalize_audit, [*keys, "region_id"]
    closed = regions.where("members is not null")
    told = lambda df, rule, subject: df.select(*own, F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))
    present = sections.select(*keys, "section").distinct()
    absent = told(regions.join(present.hint("merge"), [*keys, "section"], "left_anti"), "no gold section", F.col("section"))
    found = closed.join(present.hint("merge"), [*keys, "section"], "left_semi")
    each = found.select(*own, "section", F.explode("members").alias("member")).withColumn("_m", n(F.col("member")))
    ids = leaves.select(*own, F.explode(F.array("leaf_id", "claim_id")).alias("_id")).select(*own, n(F.col("_id")).alias("_m")).distinct()
    leaked = told(each.join(ids.hint("merge"), [*own, "_m"], "left_semi"), "member is an id", F.col("member"))
    # A section's text meets its region's members in one row, not in one for each member.
    asked = each.groupBy(*own, "section").agg(F.collect_list(F.struct("member", "_m")).alias("_asked"))
    held = asked.join(sections.select(*keys, "section", n(F.col("body")).alias("_gold")).hint("merge"), [*keys, "section"])
    missing = F.filter("_asked", lambda x: ~has_whole_phrase(F.col("_gold"), x["_m"]))
    ungrounded = told(held.select(*own, F.explode(missing).alias("x")), "member is absent from gold", F.col("x.member"))
    tables = found.where("scope = 'table_rows'")
    declared = each.join(tables.select(*own).hint("merge"), own).groupBy(*own, "section").agg(F.array_sort(F.collect_set("_m")).alias("members"))
    sets = column_member_sets(sections, keys).groupBy(*keys, "section", "members").agg(F.count("*").alias("_n"))
    matched = tables.select(*own).join(declared.hint("merge"), own, "left").join(sets.hint("merge"), [*keys, "section", "members"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    unmatched = told(matched.where("_n <> 1"), "members are not one column", F.col("_n"))
    return absent.unionByName(leaked).unionByName(ungrounded).unionByName(unmatched)
