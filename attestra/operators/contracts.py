"""What judges return, held against what was asked: ids, notes, lines, and claims that are grounded in a candidate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_ascii
from .alias_join import known_in
from .evidence import phrase_pattern


def id_violations(returned: DataFrame, expected: DataFrame, keys: list[str], column: str = "leaf_id") -> DataFrame:
    """(keys, rule, id): ids returned twice, ids that were not asked for, and ids that are missing."""
    by = [*keys, column]
    n = returned.groupBy(*by).agg(F.count("*").alias("n"))
    told = lambda df, rule: df.select(*keys, F.lit(rule).alias("rule"), F.col(column).cast("string").alias("id"))
    asked = expected.select(*by).distinct()
    return told(n.where("n > 1"), "duplicate").unionByName(told(n.join(asked.hint("merge"), by, "left_anti"), "unknown")).unionByName(told(asked.join(n.hint("merge"), by, "left_anti"), "missing"))


def settled(returned: DataFrame, recovered: DataFrame, keys: list[str]) -> DataFrame:
    """``returned(keys, leaf_id, status, refs, note)`` with lines recovered for a correct row that has none, and missing where no lines are left.

    ``refs`` are those left after blank lines and other pages; ``recovered(keys, leaf_id, refs)``: see ``evidence.recovered_citations``.
    """
    rows = returned.join(recovered.select(*keys, "leaf_id", F.col("refs").alias("_more")).hint("merge"), [*keys, "leaf_id"], "left")
    none = F.array().cast("array<int>")
    refs = F.when((F.col("status") == "correct") & (F.size("refs") == 0), F.coalesce(F.col("_more").cast("array<int>"), none)).otherwise(F.col("refs"))
    rows = rows.withColumn("refs", F.array_sort(F.array_distinct(refs)))
    gone = (F.col("status") != "missing") & (F.size("refs") == 0)
    return rows.withColumns({"note": F.when(gone, "no evidence on the obligation's pages").otherwise(F.col("note")), "status": F.when(gone, "missing").otherwise(F.col("status"))}).drop("_more")


def row_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, leaf_id, rule): rows whose note or lines don't go with their status."""
    status = F.col("status")
    rules = {
        "correct with a note": (status == "correct") & F.col("note").isNotNull(),
        "no note": (status != "correct") & F.col("note").isNull(),
        "missing with lines": (status == "missing") & (F.size("refs") > 0),
        "no lines": (status != "missing") & (F.size("refs") == 0),
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())))
    return rows.select(*keys, "leaf_id", F.explode(found).alias("rule"))


def audited_claims(claims: DataFrame, lines: DataFrame, members: DataFrame, keys: list[str], most: int = 64) -> DataFrame:
    """(keys, region_id, key, verdict, refs): each proposed claim, accepted or why not.

    ``claims(keys, at, region_id, key, claim, refs)``, ``lines(keys, ref, raw)``, ``members(case_id, region_id, member)``. A key must not mean a
    member of another region nor one of its own, must stand in the claim's text and in 1 to ``most`` cited lines, and counts once.
    """
    n = normalize_ascii
    rows = claims.withColumns({"_k": n(F.col("key")), "_c": n(F.col("claim"))})
    known = members.select("case_id", "region_id", n(F.col("member")).alias("_m"))
    near = known_in(rows.select("case_id", "_k"), known, ["case_id"], "_k", "_m", "region_id").groupBy("case_id", "_k").agg(F.collect_set("region_id").alias("_in"))
    rows = rows.join(near.hint("merge"), ["case_id", "_k"], "left").withColumn("_in", F.coalesce("_in", F.array().cast(near.schema["_in"].dataType)))
    cited = rows.select(*keys, "at", "_k", F.explode("refs").alias("ref")).join(lines.select(*keys, "ref", n(F.col("raw")).alias("_t")).hint("merge"), [*keys, "ref"])
    cited = cited.where(F.regexp_instr("_t", phrase_pattern(F.col("_k"))) > 0).groupBy(*keys, "at").agg(F.array_sort(F.collect_set(F.col("ref").cast("int"))).alias("_r"))
    rows = rows.join(cited.hint("merge"), [*keys, "at"], "left").withColumn("_r", F.coalesce("_r", F.array().cast("array<int>")))
    elsewhere = F.size(F.array_remove("_in", F.col("region_id"))) > 0
    grounded = (F.col("_k") != "") & ~F.array_contains("_in", F.col("region_id")) & (F.regexp_instr("_c", phrase_pattern(F.col("_k"))) > 0) & F.size("_r").between(1, most)
    rows = rows.withColumn("verdict", F.when(elsewhere, "declared in another region").when(~grounded, "not grounded").otherwise("accepted"))
    first = rows.where("verdict = 'accepted'").groupBy(*keys, "region_id", "_k").agg(F.min("at").alias("_first"))
    rows = rows.join(first.hint("merge"), [*keys, "region_id", "_k"], "left").withColumn("verdict", F.when((F.col("verdict") == "accepted") & (F.col("at") > F.col("_first")), "duplicate").otherwise(F.col("verdict")))
    return rows.select(*keys, "at", "region_id", "key", "verdict", F.when(F.col("verdict") == "accepted", F.col("_r")).alias("refs"))


def reused(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, inference, score): what cached results can be used again, each artifact by its own content key; a stale score leaves the inference usable.

    ``wanted(keys, inference_key, score_key)``, ``cached(keys, inference_key, score_key, telemetry_ok)``.
    """
    have = cached.select(*keys, F.col("inference_key").alias("_i"), F.col("score_key").alias("_s"), "telemetry_ok")
    rows = wanted.join(have.hint("merge"), keys, "left")
    inference = F.coalesce((F.col("_i") == F.col("inference_key")) & F.col("telemetry_ok"), F.lit(False))
    return rows.select(*keys, inference.alias("inference"), (inference & F.coalesce(F.col("_s") == F.col("score_key"), F.lit(False))).alias("score"))


def resumed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ok, attempts, errors, input): the last try of each part, with attempts, errors and tokens of all its tries.

    ``parts(keys, at, ok, attempts, errors, input)``: a part that is done is not tried again, so its last row is the good one.
    """
    return parts.groupBy(*keys).agg(F.max_by("ok", "at").alias("ok"), F.sum("attempts").alias("attempts"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "errors"))), lambda x: x["errors"])).alias("errors"), F.sum("input").alias("input"))


def union_of(*frames: DataFrame) -> DataFrame:
    """The distinct rows of several tables of the same columns."""
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()
