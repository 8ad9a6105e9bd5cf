"""Rows that a document adds to a table whose members are all known.

A region is ``regions(keys, region_id, labels, members, columns)``, all three arrays: what its tables stand under, the keys
that they may have, and headings of which one at least must be there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_ascii
from .alias_join import alias_pairs, is_alias  # noqa: F401
from .evidence import holds
from .lines import by, candidate_lines
from .tables import table_cells


def scopes(docs: DataFrame, keys: list[str], before: int = 12, without: int = 4) -> DataFrame:
    """(keys, ref, scope): for every line what stands before it: from the nearest heading in ``before`` lines, else ``without`` lines."""
    rows = candidate_lines(docs, keys).withColumn("_b", F.collect_list("raw").over(by(keys).rowsBetween(-before, -1)))
    head = F.array_max(F.transform("_b", lambda x, i: F.when(x.rlike(r"^\s*#{1,6}\s+\S"), i + 1)))
    start = F.coalesce(head, F.greatest(F.lit(1), F.size("_b") - without + 1))
    return rows.select(*keys, "ref", F.array_join(F.slice("_b", start, F.greatest(F.lit(1), F.size("_b"))), "\n").alias("scope"))


def invented_rows(docs: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, region_id, key, claim, ref): rows of closed tables whose key no member may mean, the first of each key.

    A table is a region's if its scope names the region and it has one of its columns, and one column alone holds most of the
    members, two at least (all if fewer). Rows with nothing but a key don't count, nor do tables that two regions claim.
    """
    grid, n = [*keys, "table_no", "header_ref"], normalize_ascii
    cells = table_cells(docs, keys).withColumn("_says", F.col("cell").rlike(r"[\p{L}\p{N}]"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "cell")).over(Window.partitionBy(*grid, "row_no"))), lambda x: x["cell"]), " | ")
    rest = F.sum(F.col("_says").cast("int")).over(Window.partitionBy(*grid, "row_no")) - F.col("_says").cast("int")
    cells = cells.withColumns({"claim": whole, "_rest": rest}).where("_rest > 0").withColumn("_n", n(F.col("cell")))
    heads = cells.groupBy(*grid).agg(F.collect_set(n(F.col("header"))).alias("_heads"))
    heads = heads.join(scopes(docs, keys).withColumnRenamed("ref", "header_ref").hint("merge"), [*keys, "header_ref"]).withColumn("scope", n(F.col("scope")))
    norm = lambda c: F.filter(F.transform(c, n), lambda x: x != "")
    r = regions.select(*keys, "region_id", *(norm(c).alias(f"_{c}") for c in ("labels", "members", "columns")))
    owned = heads.join(r.hint("merge"), keys).where(holds(F.col("scope"), F.col("_labels")) & F.arrays_overlap("_heads", "_columns")).select(*grid, "region_id", "_members")
    own = [*grid, "region_id"]
    met = cells.join(owned.hint("merge"), grid)
    # Each name of a region's tables meets the members that it may mean, and no others.
    named = met.select(*keys, "region_id", F.col("_n").alias("name")).distinct()
    member = r.select(*keys, "region_id", F.explode("_members").alias("name"))
    alike = alias_pairs(named, member, [*keys, "region_id"]).groupBy(*keys, "region_id", F.col("left").alias("_n")).agg(F.collect_set("right").alias("_alias"))
    met = met.join(alike.hint("merge"), [*keys, "region_id", "_n"], "left").withColumn("_alias", F.coalesce("_alias", F.array().cast("array<string>")))
    found = met.where("size(_alias) = 1").groupBy(*own, "col").agg(F.count_distinct(F.col("_alias")[0]).alias("_found"), F.first("_members").alias("_m"))
    found = found.where(F.col("_found") >= F.least(F.lit(2), F.size("_m")))
    w = Window.partitionBy(*own)
    column = found.withColumn("_top", F.max("_found").over(w)).where("_found = _top").withColumn("_tied", F.count("*").over(w)).where("_tied = 1").select(*own, "col")
    squeezed = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    known = F.array_contains(F.transform("_members", squeezed), squeezed(F.col("_n")))
    novel = met.where("_n <> '' and size(_alias) = 0").where(~known).join(column.hint("merge"), [*own, "col"])
    single = novel.groupBy(*grid).agg(F.count_distinct("region_id").alias("_regions")).where("_regions = 1").select(*grid)
    novel = novel.join(single.hint("merge"), grid).withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "region_id", "_n").orderBy("ref", "table_no")))
    return novel.where("_rn = 1").select(*keys, "region_id", F.col("cell").alias("key"), "claim", "ref")


def applied_claims(reported: DataFrame, discovered: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, region_id, key): reported claims and those discovered that are neither reported nor may mean a member of another region.

    ``members(keys, region_id, member)``; keys are compared in normal form, with members as ``is_alias`` does.
    """
    n = lambda df, c: df.withColumn("_n", normalize_ascii(F.col(c)))
    own = n(discovered.select(*keys, "region_id", "key"), "key")
    fresh = own.join(n(reported, "key").select(*keys, "region_id", "_n").distinct().hint("merge"), [*keys, "region_id", "_n"], "left_anti")
    held = members.select(*keys, F.col("region_id").alias("_other"), normalize_ascii(F.col("member")).alias("name"))
    alike = alias_pairs(fresh.select(*keys, F.col("_n").alias("name")), held, keys)
    elsewhere = fresh.join(alike.withColumnRenamed("left", "_n").hint("merge"), [*keys, "_n"]).join(held.withColumnRenamed("name", "right").hint("merge"), [*keys, "right"]).where("_other <> region_id")
    elsewhere = elsewhere.select(*keys, "region_id", "_n").distinct()
    return reported.select(*keys, "region_id", "key").unionByName(fresh.join(elsewhere.hint("merge"), [*keys, "region_id", "_n"], "left_anti").select(*keys, "region_id", "key"))
