"""Scores from obligation to region, case, draw and model; costs; and summaries. Built-in aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp01

#: Credit of each status, and of an unsupported claim, per unit of harm.
CREDIT = {"correct": 1.0, "missing": 0.0, "incorrect": -0.5}
UNSUPPORTED = -1.0


def credit(status: Column) -> Column:
    c = F.lit(0.0)
    for s, v in CREDIT.items():
        c = F.when(status == s, v).otherwise(c)
    return c


def region_scores(leaves: DataFrame, claims: DataFrame | None, keys: list[str]) -> DataFrame:
    """(keys, possible, earned, penalty, ratio) from ``leaves(keys, status, harm)`` and claims counted as ``claims(keys, n_claims)``.

    A claim's harm is 2 where a region has a leaf of harm 2, else 1. The ratio is signed and not clamped; it is 0 where nothing can be earned.
    """
    rows = leaves.groupBy(*keys).agg(F.sum("harm").alias("possible"), F.sum(credit(F.col("status")) * F.col("harm")).alias("earned"), F.max("harm").alias("_harm"))
    rows = rows.join(claims.hint("merge"), keys, "left") if claims is not None else rows.withColumn("n_claims", F.lit(0))
    rows = rows.withColumn("penalty", -UNSUPPORTED * F.coalesce("n_claims", F.lit(0)) * F.col("_harm"))
    return rows.select(*keys, F.col("possible").cast("long").alias("possible"), "earned", "penalty", F.coalesce(F.try_divide(F.col("earned") - F.col("penalty"), F.col("possible")), F.lit(0.0)).alias("ratio"))


def case_scores(regions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, regions, total_budget, raw_score, score): budget-weighted means; only the score is clamped to 0..100."""
    ratio = F.try_divide(F.sum(F.col("ratio") * F.col("budget")), F.sum("budget"))
    return regions.groupBy(*keys).agg(F.count("*").alias("regions"), F.sum("budget").cast("long").alias("total_budget"), (100 * ratio).alias("raw_score"), (100 * clamp01(ratio)).alias("score"))


def rollups(regions: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, key, region_count, total_budget, score): one pass of grouping sets, a set for each axis column."""
    sets = regions.groupingSets([[F.col(a)] for a in axes], *axes)
    ratio = F.try_divide(F.sum(F.col("ratio") * F.col("budget")), F.sum("budget"))
    rows = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("region_count"), F.sum("budget").cast("long").alias("total_budget"), (100 * clamp01(ratio)).alias("score"))
    n = len(axes)
    axis = F.coalesce(*(F.when(F.col("g") == (1 << n) - 1 - (1 << (n - 1 - i)), F.lit(a)) for i, a in enumerate(axes)))
    key = F.coalesce(*(F.when(F.col("g") == (1 << n) - 1 - (1 << (n - 1 - i)), F.col(a).cast("string")) for i, a in enumerate(axes)))
    return rows.select(axis.alias("axis"), key.alias("key"), "region_count", "total_budget", "score")


def status_harm(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, correct, missing, incorrect): harm by status."""
    return leaves.groupBy(*keys).agg(*(F.sum(F.when(F.col("status") == s, F.col("harm")).otherwise(0)).cast("long").alias(s) for s in CREDIT))


def gapless_draws(draws: DataFrame, keys: list[str]) -> DataFrame:
    """Draws before the first one that is missing: those whose number is their rank."""
    numbered = draws.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("draw")))
    return numbered.where("draw = _rank").drop("_rank")


def complete_draws(scores: DataFrame, cases: int, keys: list[str]) -> DataFrame:
    """(keys, draw, score, cost): draws that have all cases, each with the plain mean of its case scores."""
    return scores.groupBy(*keys, "draw").agg(F.count_distinct("case_id").alias("_n"), F.avg("score").alias("score"), F.sum("cost").alias("cost")).where(F.col("_n") == cases).drop("_n")


def summary(draws: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, draws, mean, least, most, sd, mean_cost, total_cost); sd is the sample's, null for one draw."""
    return draws.groupBy(*keys).agg(F.count("*").alias("draws"), F.avg("score").alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"), F.stddev_samp("score").alias("sd"), F.avg("cost").alias("mean_cost"), F.sum("cost").alias("total_cost"))


def cost(usage: dict[str, Column], price: dict[str, Column]) -> Column:
    """Dollars: cached tokens are at most the input, written ones at most the rest; a missing write price is the input's."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    cached = F.least(zero(usage["cached"]), zero(usage["input"]))
    wrote = F.least(zero(usage["written"]), zero(usage["input"]) - cached)
    plain = zero(usage["input"]) - cached - wrote
    return (plain * price["input"] + cached * price["cached"] + wrote * F.coalesce(price["written"], price["input"]) + zero(usage["output"]) * price["output"]) / 1e6


def uncached_cost(usage: dict[str, Column], price: dict[str, Column]) -> Column:
    return (F.coalesce(usage["input"], F.lit(0)) * price["input"] + F.coalesce(usage["output"], F.lit(0)) * price["output"]) / 1e6


def one_identity(rows: DataFrame, keys: list[str], identities: list[str]) -> DataFrame:
    """Keys whose rows all name one value in each identity column, nulls aside."""
    n = rows.groupBy(*keys).agg(*(F.count_distinct(i).alias(f"_{i}") for i in identities))
    return n.where(" and ".join(f"_{i} = 1" for i in identities)).select(*keys)


def paced(events: DataFrame, keys: list[str], arrival: str, gap: int) -> DataFrame:
    """``events`` with ``start``: in turn, no two starts of a key less than ``gap`` apart, none before its arrival.

    start_i = gap * i + the largest (arrival_j - gap * j) so far, so a running maximum does it.
    """
    w = Window.partitionBy(*keys).orderBy(arrival, "event_id")
    i = (F.row_number().over(w) - 1).cast("long")
    rows = events.withColumn("_i", i)
    lead = F.max(F.col(arrival) - F.col("_i") * gap).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start", F.col("_i") * gap + lead).drop("_i")


def packed(rows: DataFrame, keys: list[str], order: list[str], stable: int = 64, request: int = 32) -> DataFrame:
    """``rows`` with stable_batch (of ``stable`` rows) and request (of ``request`` rows that are not settled) in each."""
    at = (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")
    rows = rows.withColumn("stable_batch", F.floor(at / stable)).where("not settled")
    n = (F.row_number().over(Window.partitionBy(*keys, "stable_batch").orderBy(*order)) - 1).cast("long")
    return rows.withColumn("request", F.floor(n / request))


def semantic_batches(leaves: DataFrame, keys: list[str], settled: DataFrame | str | None = None, stable: int = 64, request: int = 32) -> DataFrame:
    """(keys, batch, request, regions, leaf_ids): what a judge is asked, of ``leaves(keys, region_no, leaf_no, region_id, leaf_id)``; ids are unique.

    Obligations fill batches of ``stable`` in the order of regions, so a region may go on in the next batch; ``regions`` has for each
    piece of a region in the batch its id, its first obligation's place in the region and how many there are, whatever is settled, so that
    batches are alike from try to try. ``settled(keys, leaf_id)``, or leaves whose column of that name is true, are not asked again; the
    others make requests of ``request``, and a batch without any makes none.

    Keys are sorted once; a batch is then one row of at most ``stable`` obligations, from which pieces and requests are cut.
    """
    if isinstance(settled, str):
        rows = leaves.withColumn("_settled", F.coalesce(F.col(settled), F.lit(False)))
    elif settled is None:
        rows = leaves.withColumn("_settled", F.lit(False))
    else:
        done = settled.select(*keys, "leaf_id").distinct().withColumn("_done", F.lit(True)).hint("merge")
        rows = leaves.join(done, [*keys, "leaf_id"], "left").withColumn("_settled", F.col("_done").isNotNull())
    at = (F.row_number().over(Window.partitionBy(*keys).orderBy("region_no", "leaf_no")) - 1).cast("long")
    rows = rows.select(*keys, F.floor(at / stable).cast("long").alias("batch"), at.alias("_at"), "region_no", "region_id", "leaf_no", "leaf_id", "_settled")
    piece = F.struct("region_no", "region_id", F.col("leaf_no").isNull().alias("none"), F.col("leaf_no").cast("long").alias("leaf_no"))
    made = rows.groupBy(*keys, "batch").agg(F.sort_array(F.collect_list(piece)).alias("x"), F.sort_array(F.collect_list(F.when(~F.col("_settled"), F.struct("_at", "leaf_id")))).alias("open")).where(F.size("open") > 0)
    # Sorted by region, each region is one run: its first row has its least leaf_no, and the next run's place tells how many there are.
    begins = lambda e, i: (i == 0) | ~(e["region_no"].eqNullSafe(F.get("x", i - 1)["region_no"]) & e["region_id"].eqNullSafe(F.get("x", i - 1)["region_id"]))
    starts = F.filter(F.transform("x", lambda e, i: F.when(begins(e, i), F.struct(e["region_id"].alias("region_id"), e["leaf_no"].alias("first"), i.alias("at")))), lambda e: e.isNotNull())
    made = made.withColumn("runs", starts)
    until = lambda i: F.coalesce(F.get("runs", i + 1)["at"], F.size("x"))
    regions = F.transform("runs", lambda e, i: F.struct(e["region_id"].alias("region_id"), e["first"].alias("first"), (until(i) - e["at"]).cast("long").alias("n")))
    made = made.select(*keys, "batch", regions.alias("regions"), F.transform("open", lambda x: x["leaf_id"]).alias("open"))
    asked = made.select(*keys, "batch", "regions", "open", F.explode(F.sequence(F.lit(0), F.floor((F.size("open") - 1) / request).cast("int"))).alias("request"))
    return asked.select(*keys, "batch", F.col("request").cast("long").alias("request"), F.slice("open", F.col("request") * request + 1, F.lit(request)).alias("leaf_ids"), "regions")


def audit_batches(regions: DataFrame, keys: list[str], most_regions: int = 24, most_members: int = 256) -> DataFrame:
    """(keys, region_id, batch): regions of ``regions(keys, region_id, pos, members)`` in their order, a new batch where one more would be too many.

    A fold over the regions of one key, as each batch begins where the one before is full; a region that is too large alone has its own.
    """
    rows = regions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "region_id", F.col("members").cast("long").alias("members")))).alias("rs"))
    state = F.struct(F.array().cast("array<long>").alias("batches"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("b"))

    def step(s: Column, r: Column) -> Column:
        full = (s["n"] > 0) & ((s["n"] >= most_regions) | (s["m"] + r["members"] > most_members))
        at = s["b"] + full.cast("long")
        return F.struct(F.concat(s["batches"], F.array(at)).alias("batches"), F.when(full, F.lit(1).cast("long")).otherwise(s["n"] + 1).alias("n"), F.when(full, r["members"]).otherwise(s["m"] + r["members"]).alias("m"), at.alias("b"))

    rows = rows.withColumn("bs", F.aggregate("rs", state, step, lambda s: s["batches"]))
    return rows.select(*keys, F.inline(F.arrays_zip(F.transform("rs", lambda r: r["region_id"]).alias("region_id"), F.col("bs").alias("batch"))))


#: Kinds of obligations that gates may credit without a judge.
CREDITED_KINDS = ("table_binding", "form_state", "directed_edge")


def precredits(leaves: DataFrame, gates: DataFrame, collisions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, leaf_id, refs): obligations that are correct before any judgement.

    ``leaves(keys, leaf_id, kind, claim, unique_evidence)`` of an eligible kind (or ordered tokens of a structure), whose evidence is unique,
    whose locator is not in ``collisions(keys, a, b)``, and which ``gates(keys, leaf_id, status, refs, on_page)`` find correct on expected pages.
    """
    kind = F.col("kind").isin(*CREDITED_KINDS) | ((F.col("kind") == "ordered_tokens") & (F.col("claim") == "structure"))
    alike = collisions.select(*keys, F.explode(F.array("a", "b")).alias("leaf_id")).distinct()
    sure = leaves.where(kind & F.col("unique_evidence")).join(alike.hint("merge"), [*keys, "leaf_id"], "left_anti")
    return sure.join(gates.where("status = 'correct' and on_page and size(refs) > 0").hint("merge"), [*keys, "leaf_id"]).select(*keys, "leaf_id", "refs")


def merged_status(leaves: DataFrame, judged: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """External judgements under the gates' guard: ``leaves(keys, kind)``, ``judged(keys, at, status, n_refs)``, ``evidence(keys, satisfied, contradiction, partial, near)``.

    The first judgement of a leaf counts, none is missing. An edge that is contradicted is incorrect whatever was judged.
    A table value judged correct needs exact or near evidence and no partial value; one judged incorrect needs a
    contradiction. Ordered records follow the gate. A status other than missing without lines is missing. Merging the
    result once more changes nothing.
    """
    first = judged.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).where("_rn = 1").select(*keys, F.col("status").alias("_s"), "n_refs")
    rows = leaves.join(first.hint("merge"), keys, "left").join(evidence.hint("merge"), keys, "left")
    s, kind = F.coalesce("_s", F.lit("missing")), F.col("kind")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    guarded = (
        F.when((kind == "directed_edge") & yes("contradiction"), "incorrect")
        .when((kind == "directed_edge") & (s == "correct") & ~yes("satisfied") & ~yes("near"), "missing")
        .when((kind == "table_binding") & (s == "correct") & (yes("partial") | (~yes("satisfied") & ~yes("near"))), "missing")
        .when((kind == "table_binding") & (s == "incorrect") & ~yes("contradiction"), "missing")
        .when((kind == "ordered_record") & (s == "correct") & yes("contradiction"), "incorrect")
        .when((kind == "ordered_record") & (s == "correct") & ~yes("satisfied"), "missing")
        .when((kind == "ordered_record") & (s == "incorrect") & ~yes("contradiction"), "missing")
        .otherwise(s)
    )
    status = F.when((guarded != "missing") & (F.coalesce("n_refs", F.lit(0)) == 0) & ~((kind == "directed_edge") & yes("contradiction")), "missing").otherwise(guarded)
    return rows.select(*keys, "kind", status.alias("status"))
