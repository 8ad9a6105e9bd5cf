"""Obligations made from tables: the schema, the order of rows, and a cell each, with the forms that evidence may take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import term_forms
from ..sources.artifacts import slug

LEAF = ("leaf_id", "claim", "kind", "strict", "expectation", "state", "harm")


def _leaf(rows: DataFrame, own: list[str], name: Column, claim: str, kind: str, expectation: Column, harm: Column | None = None) -> DataFrame:
    values = (F.concat(F.col("region_id").cast("string"), F.lit("."), name), F.lit(claim), F.lit(kind), F.lit(False), expectation, F.lit(None).cast("string"), F.lit(1) if harm is None else harm)
    return rows.select(*own, *(v.alias(n) for n, v in zip(LEAF, values)))


def _listed(rows: DataFrame, own: list[str], order: str, value: str) -> DataFrame:
    """(own, values): one region's headings or keys, in their order."""
    return rows.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("v")))).alias("x")).select(*own, F.transform("x", lambda x: x["v"]).alias("values"))


def table_obligations(
    cells: DataFrame, keys: list[str], key_col: int = 0, row_aliases: DataFrame | None = None, column_aliases: DataFrame | None = None,
    value_aliases: DataFrame | None = None, row_parts: DataFrame | None = None, skipped: DataFrame | None = None, consequential: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaves and terms, as ``plans.evaluate`` takes them, of ``cells(keys, region_id, row_no, col, header, cell)``, one table for each region; and what is refused.

    * ``<region>.schema``: the headings in order; ``<region>.row-order``: the keys in order; each heading and key with its aliases as they are;
    * ``<region>.<key>.<heading>``: a binding for each cell but the key's and those of ``skipped(keys, region_id, header)``, every part in its
      term forms; it weighs 2 if ``consequential(keys, region_id, row_key, header)`` has it, else 1.

    ``row_aliases(keys, region_id, row_key, alias)``, ``column_aliases(keys, region_id, header, alias)`` and ``value_aliases(keys, region_id,
    row_key, header, alias)`` add alternatives. ``row_parts(keys, region_id, row_key, part_no, alias)`` tell a row by several cells.
    Refused, as (keys, region_id, rule, subject): parts of a row that is not there; rows that share all their parts; an id that two cells give.
    """
    own = [*keys, "region_id"]
    at_key = cells.where(F.col("col") == key_col).select(*own, "row_no", F.col("cell").alias("row_key"))
    heads = cells.select(*own, "col", "header").distinct()
    schema, order = _listed(heads, own, "col", "header"), _listed(at_key, own, "row_no", "row_key")
    told = lambda rows, first, mark: F.concat(F.lit(first), F.array_join("values", mark), F.lit("."))
    schemas = _leaf(schema, own, F.lit("schema"), "structure", "ordered_tokens", told(schema, "The region keeps these fields in order: ", ", "))
    orders = _leaf(order, own, F.lit("row-order"), "ordered_record", "ordered_tokens", told(order, "The rows come in this order: ", " -> "))
    bound = cells.where(F.col("col") != key_col).join(at_key.hint("merge"), [*own, "row_no"])
    if skipped is not None:
        bound = bound.join(skipped.select(*own, "header").distinct().hint("merge"), [*own, "header"], "left_anti")
    harm = F.lit(1)
    if consequential is not None:
        bound = bound.join(consequential.select(*own, "row_key", "header", F.lit(2).alias("_harm")).distinct().hint("merge"), [*own, "row_key", "header"], "left")
        harm = F.coalesce("_harm", F.lit(1))
    name = F.concat(slug(F.col("row_key")), F.lit("."), slug(F.col("header")))
    bound = bound.withColumn("leaf_id", F.concat(F.col("region_id").cast("string"), F.lit("."), name))
    said = F.concat(F.lit("For "), "row_key", F.lit(", "), "header", F.lit(" is "), "cell", F.lit("."))
    bindings = _leaf(bound, own, name, "table_binding", "table_binding", said, harm)
    leaves = reduce(DataFrame.unionByName, (schemas, orders, bindings))
    tokens = [_tokens(schema, own, "schema", "header", column_aliases), _tokens(order, own, "row-order", "row_key", row_aliases)]
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(0).alias("group_no"), F.col(c).alias("raw")) for r, c in (("row", "row_key"), ("column", "header"), ("value", "cell"))))
    raw = [bound.select(*own, "leaf_id", F.inline(roles))]
    more = lambda rows, by, role, no=F.lit(0): bound.select(*own, "row_key", "header", "leaf_id").join(rows.hint("merge"), [*own, *by]).select(*own, "leaf_id", F.lit(role).alias("role"), no.alias("group_no"), F.col("alias").alias("raw"))
    if column_aliases is not None:
        raw.append(more(column_aliases, ["header"], "column"))
    if value_aliases is not None:
        raw.append(more(value_aliases, ["row_key", "header"], "value"))
    if row_parts is not None:
        raw.append(more(row_parts, ["row_key"], "rowParts", F.col("part_no").cast("int")))
    forms = reduce(DataFrame.unionByName, raw).select(*own, "leaf_id", "role", "group_no", F.explode(term_forms(F.col("raw"))).alias("alternative"))
    terms = reduce(DataFrame.unionByName, (*tokens, forms)).select(*keys, "leaf_id", "role", F.lit(0).alias("binding_no"), "group_no", "alternative").distinct()
    ids = leaves.groupBy(*own, "leaf_id").agg(F.count("*").alias("n")).where("n > 1")
    refused = ids.select(*own, F.lit("id repeats").alias("rule"), F.col("leaf_id").alias("subject"))
    if row_parts is not None:
        refused = refused.unionByName(_refused_parts(row_parts, at_key, own))
    return leaves, terms, refused


def _tokens(listed: DataFrame, own: list[str], name: str, by: str, aliases: DataFrame | None) -> DataFrame:
    """The groups of an ordered obligation: each value with its aliases."""
    rows = listed.select(*own, F.posexplode("values").alias("group_no", by))
    if aliases is not None:
        rows = rows.join(aliases.groupBy(*own, by).agg(F.collect_set("alias").alias("_a")).hint("merge"), [*own, by], "left")
    alts = F.array(by) if aliases is None else F.concat(F.array(by), F.coalesce("_a", F.array().cast("array<string>")))
    leaf_id = F.concat(F.col("region_id").cast("string"), F.lit(f".{name}"))
    return rows.select(*own, leaf_id.alias("leaf_id"), F.lit("tokens").alias("role"), "group_no", F.explode(alts).alias("alternative"))


def _refused_parts(parts: DataFrame, at_key: DataFrame, own: list[str]) -> DataFrame:
    plain = F.trim(F.regexp_replace(F.lower("alias"), r"(?U)\s+", " "))
    unknown = parts.select(*own, "row_key").distinct().join(at_key.hint("merge"), [*own, "row_key"], "left_anti")
    groups = parts.groupBy(*own, "row_key", "part_no").agg(F.array_sort(F.collect_set(plain)).alias("alts"))
    whole = groups.groupBy(*own, "row_key").agg(F.array_sort(F.collect_list(F.struct("part_no", "alts"))).alias("x")).withColumn("x", F.transform("x", lambda x: x["alts"]))
    shared = whole.groupBy(*own, "x").agg(F.array_sort(F.collect_set("row_key")).alias("owners")).where("size(owners) > 1")
    told = lambda df, rule, subject: df.select(*own, F.lit(rule).alias("rule"), subject.alias("subject"))
    return told(unknown, "parts of no row", F.col("row_key")).unionByName(told(shared, "rows share their parts", F.array_join("owners", ", ")))
