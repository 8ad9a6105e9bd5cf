"""Readers and writers of benchmark files: manifest, facts, candidates, judgements; and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CASE = "STRUCT<id STRING, title STRING, family STRING, tags ARRAY<STRING>, pages INT, pdf STRING, gold STRING, spec STRING, facts STRING>"
MANIFEST = f"schemaVersion INT, name STRING, suite STRING, version STRING, caseCount INT, pageCount INT, cases ARRAY<{_CASE}>"
_TERMS, _BINDINGS = "ARRAY<ARRAY<STRING>>", "ARRAY<ARRAY<ARRAY<STRING>>>"
_POLICY = (
    f"STRUCT<type STRING, allOf {_TERMS}, strict BOOLEAN, row ARRAY<STRING>, rowParts {_TERMS}, column ARRAY<STRING>, value ARRAY<STRING>, label ARRAY<STRING>, state STRING, "
    f"source ARRAY<STRING>, destination ARRAY<STRING>, relation ARRAY<STRING>, identifier ARRAY<STRING>, tokens {_TERMS}, requiredBindings {_BINDINGS}, requiredTerms {_TERMS}, localBindings {_BINDINGS}>"
)
_LEAF = f"STRUCT<id STRING, canonicalClaimId STRING, claimType STRING, expectation STRING, harm INT, evidencePolicy {_POLICY}>"
_ANCHOR = "STRUCT<page INT, documentPage INT, layer STRING, sectionPath ARRAY<STRING>, bbox ARRAY<DOUBLE>>"
_REGION = (
    f"STRUCT<id STRING, label STRING, sourceAnchors ARRAY<{_ANCHOR}>, goldSection STRING, kind STRING, modality STRING, uniqueEvidence BOOLEAN, primaryAxis STRING, secondaryAxes ARRAY<STRING>, "
    f"textOnlyRecoverable BOOLEAN, budget INT, closedWorld STRUCT<scope STRING, keys ARRAY<STRING>>, leaves ARRAY<{_LEAF}>>"
)
FACTS = f"schemaVersion INT, id STRING, title STRING, family STRING, tags ARRAY<STRING>, regions ARRAY<{_REGION}>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each case; a file that doesn't parse is an error."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True, mode="FAILFAST").select(F.inline("cases"))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACTS).json(path, multiLine=True, mode="FAILFAST")


def regions(facts: DataFrame) -> DataFrame:
    """(case_id, region_no, region fields) in the order of the files."""
    return facts.select(F.col("id").alias("case_id"), F.posexplode("regions").alias("region_no", "r")).select("case_id", "region_no", "r.*")


def leaves(region_rows: DataFrame) -> DataFrame:
    return region_rows.select("case_id", F.col("id").alias("region_id"), "region_no", "budget", F.posexplode("leaves").alias("leaf_no", "l")).select("case_id", "region_id", "region_no", "budget", "leaf_no", "l.*")


def leaf_terms(leaf_rows: DataFrame) -> DataFrame:
    """(case_id, leaf_id, role, binding_no, group_no, alternative): the alternatives of every policy, each once; ``binding_no`` is 0 but for bindings."""
    p = "evidencePolicy"
    one = lambda groups: F.array(F.coalesce(groups, F.array().cast("array<array<string>>")))
    flat = [(r, one(F.array(F.col(f"{p}.{r}")))) for r in ("row", "column", "value", "label", "source", "destination", "relation", "identifier")]
    grouped = [(r, one(F.col(f"{p}.{r}"))) for r in ("allOf", "rowParts", "tokens", "requiredTerms")]
    bound = [(r, F.coalesce(F.col(f"{p}.{r}"), F.array().cast("array<array<array<string>>>"))) for r in ("requiredBindings", "localBindings")]
    rows = leaf_rows.select("case_id", F.col("id").alias("leaf_id"), F.explode(F.array(*(F.struct(F.lit(r).alias("role"), g.alias("bindings")) for r, g in (*flat, *grouped, *bound)))).alias("t"))
    rows = rows.select("case_id", "leaf_id", "t.role", F.posexplode("t.bindings").alias("binding_no", "groups"))
    rows = rows.select("case_id", "leaf_id", "role", "binding_no", F.posexplode("groups").alias("group_no", "g"))
    return rows.select("case_id", "leaf_id", "role", "binding_no", "group_no", F.explode("g").alias("alternative")).distinct()


def violations(facts: DataFrame) -> DataFrame:
    """(case_id, rule, subject): what breaks the rules for facts."""
    r = regions(facts)
    le = leaves(r)
    twice = lambda df, by, rule: df.groupBy("case_id", by).agg(F.count("*").alias("n")).where("n > 1").select("case_id", F.lit(rule).alias("rule"), F.col(by).alias("subject"))
    bad = lambda df, cond, rule, subject: df.where(cond).select("case_id", F.lit(rule).alias("rule"), F.col(subject).alias("subject"))
    out = [
        facts.where("schemaVersion is null or schemaVersion <> 3").select(F.col("id").alias("case_id"), F.lit("schema version").alias("rule"), F.col("schemaVersion").cast("string").alias("subject")),
        twice(r, "id", "region id repeats"),
        twice(le, "id", "leaf id repeats"),
        twice(le, "canonicalClaimId", "claim is charged twice"),
        bad(r, "budget is null or budget not between 1 and 4", "budget", "id"),
        bad(le, "harm is null or harm not in (1, 2)", "harm", "id"),
        bad(r, F.array_contains("secondaryAxes", F.col("primaryAxis")) | (F.size(F.array_distinct("secondaryAxes")) < F.size("secondaryAxes")), "secondary axes", "id"),
        bad(r, F.size(F.array_distinct(F.transform("closedWorld.keys", lambda k: F.lower(k)))) < F.size("closedWorld.keys"), "closed world keys repeat", "id"),
        bad(r, "textOnlyRecoverable and (modality = 'raster' or primaryAxis = 'native_layer_recovery')", "text-only recoverable", "id"),
    ]
    pages = r.select("case_id", F.inline("sourceAnchors")).where("page is not null").withColumn("_to", F.coalesce("documentPage", "page"))
    both = pages.groupBy("case_id", "page").agg(F.count_distinct("_to").alias("n")).where("n > 1").select("case_id", F.lit("page has two document pages").alias("rule"), F.col("page").cast("string").alias("subject"))
    result = both
    for x in out:
        result = result.unionByName(x)
    return result


def write_report(summary: DataFrame, path: str) -> None:
    """One JSON file; a summary has a row for each model."""
    summary.coalesce(1).write.mode("overwrite").json(path)


CANDIDATES = "model_id STRING, case_id STRING, draw INT, prediction STRING"
