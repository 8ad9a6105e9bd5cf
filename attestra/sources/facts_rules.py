"""All rules for facts: fields and their values, obligations and their policies, and how facts go with manifest and gold text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_ascii
from ..operators.authoring import policy_violations
from . import facts as files

#: What fields may hold.
LAYERS = ("native_text", "raster", "vector_geometry", "mixed", "native_layer_recovery")
KINDS = ("text", "table", "chart", "diagram", "form", "image", "structure", "mixed")
AXES = (
    "precise_recall", "table_reconstruction", "long_context_coherence", "reading_order", "form_state", "source_precedence", "chart_diagram_spatial", "image_description", "mixed_modality_fusion",
    "native_layer_recovery", "cross_page_join", "structure_reconstruction", "low_quality_scan", "summarization_coverage",
)
CLAIMS = ("scalar", "table_binding", "ordered_record", "directed_edge", "form_state", "source_precedence", "cross_page_join", "visual_description", "structure")
SCOPES = ("region_claims", "table_rows", "form_options", "record_set", "edge_set", "structure_children")
STATES = ("checked", "unchecked", "disabled", "crossed")
#: The policy that a claim needs, and the roles that a policy can't do without.
POLICY_OF = {"table_binding": "table_binding", "ordered_record": "ordered_tokens", "directed_edge": "directed_edge", "form_state": "form_state", "source_precedence": "ordered_tokens", "visual_description": "qualitative"}
ROLES_OF = {"lexical": ("allOf",), "table_binding": ("row", "column", "value"), "form_state": ("label",), "directed_edge": ("source", "destination"), "ordered_tokens": ("tokens",), "qualitative": ("requiredTerms",)}


def _no(c: Column) -> Column:
    """Whether a condition fails to hold; one that can't be told fails."""
    return ~F.coalesce(c, F.lit(False))


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))


def _broken(rows: DataFrame, subject: Column, rules: dict[str, Column]) -> DataFrame:
    """(case_id, rule, subject): each rule that a row breaks, in one pass over the rows."""
    names = F.array_compact(F.array(*(F.when(c, F.lit(rule)) for rule, c in rules.items())))
    return rows.select("case_id", F.explode(names).alias("rule"), F.coalesce(subject.cast("string"), F.lit("")).alias("subject"))


def anchor_rules(regions: DataFrame, cases: DataFrame) -> DataFrame:
    """What is wrong with anchors, and with the pages that they map to; ``cases(case_id, pages)``."""
    a = regions.select("case_id", F.col("id").alias("region_id"), F.inline("sourceAnchors")).join(cases.select("case_id", "pages").hint("merge"), "case_id", "left")
    box, path = F.col("bbox"), F.col("sectionPath")
    at = lambda i: F.get(box, F.lit(i))
    normal = (F.size(box) == 4) & F.forall(box, lambda v: v.between(0, 1)) & (at(0) < at(2)) & (at(1) < at(3))
    out = _broken(a, F.col("region_id"), {
        "page is out of range": _no(F.col("page").between(1, F.col("pages"))),
        "document page": F.col("documentPage") < 1,
        "source layer": _no(F.col("layer").isin(*LAYERS)),
        "section path": _no((F.size(path) > 0) & F.forall(path, lambda s: F.trim(s) != "")),
        "box": box.isNotNull() & _no(normal),
    }).distinct()
    mapped = a.where("page is not null").groupBy("case_id", "page").agg(F.max(F.coalesce("documentPage", "page")).alias("_to"))
    before = F.lag("_to").over(Window.partitionBy("case_id").orderBy("page"))
    falls = mapped.withColumn("_before", before).where("_to < _before").select("case_id", F.lit("document pages decrease").alias("rule"), F.col("page").cast("string").alias("subject"))
    return out.unionByName(falls)


def region_rules(regions: DataFrame) -> DataFrame:
    secondary, keys = F.col("secondaryAxes"), F.col("closedWorld.keys")
    return _broken(regions, F.col("id"), {
        "region has no id": _blank("id"),
        "label": _blank("label"),
        "no anchors": _no(F.size("sourceAnchors") > 0),
        "gold section": _blank("goldSection"),
        "kind": _no(F.col("kind").isin(*KINDS)),
        "modality": _no(F.col("modality").isin(*LAYERS)),
        "unique evidence": F.col("uniqueEvidence").isNull(),
        "primary axis": _no(F.col("primaryAxis").isin(*AXES)),
        "unknown secondary axes": secondary.isNull() | F.exists(secondary, lambda x: _no(x.isin(*AXES))),
        "text-only recoverable is not told": F.col("textOnlyRecoverable").isNull(),
        "text-only recoverable of its layer": F.coalesce(F.col("textOnlyRecoverable") & (F.col("modality") == "native_layer_recovery"), F.lit(False)),
        "closed world": F.col("closedWorld").isNotNull() & _no(F.col("closedWorld.scope").isin(*SCOPES) & (F.size(keys) > 0) & F.forall(keys, lambda k: F.trim(k) != "")),
        "no obligations": _no(F.size("leaves") > 0),
    })


def leaf_rules(leaves: DataFrame) -> DataFrame:
    kind, claim = F.col("evidencePolicy.type"), F.col("claimType")
    needs = lambda table, of: F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*map(F.lit, table.values())))[of]
    empty = lambda role: _no(F.size(f"evidencePolicy.{role}") > 0)
    lacks = reduce(lambda out, k: out | ((kind == k) & reduce(lambda a, b: a | b, map(empty, ROLES_OF[k]))), ROLES_OF, F.lit(False))
    # The groups of a strict policy, normal and each alternative once: one that two groups share is counted twice.
    groups = F.transform("evidencePolicy.allOf", lambda g: F.array_distinct(F.transform(g, normalize_ascii)))
    shares = F.size(F.flatten(groups)) > F.size(F.array_distinct(F.flatten(groups)))
    return _broken(leaves, F.col("id"), {
        "leaf has no id": _blank("id"),
        "claim id": _blank("canonicalClaimId"),
        "expectation": _no(F.length(F.trim("expectation")) >= 4),
        "claim type": _no(claim.isin(*CLAIMS)),
        "policy type": _no(kind.isin(*ROLES_OF)),
        "policy of another claim": F.coalesce(needs(POLICY_OF, claim) != kind, F.lit(False)),
        "policy lacks its terms": F.coalesce(lacks, F.lit(False)),
        "state": F.coalesce((kind == "form_state") & _no(F.col("evidencePolicy.state").isin(*STATES)), F.lit(False)),
        "strict groups share an alternative": F.coalesce((kind == "lexical") & F.col("evidencePolicy.strict") & shares, F.lit(False)),
    })


def case_rules(facts: DataFrame, regions: DataFrame, cases: DataFrame, sections: DataFrame) -> DataFrame:
    """How facts go with ``cases(case_id, title, family, tags, pages)`` and ``sections(case_id, section)``; a page that no region is anchored to is told too."""
    f = facts.select(F.col("id").alias("case_id"), F.col("title").alias("_t"), F.col("family").alias("_f"), F.col("tags").alias("_g"), F.col("regions").alias("_r"), F.lit(True).alias("_facts"))
    both = f.join(cases.withColumn("_case", F.lit(True)).hint("merge"), "case_id", "full")
    known = F.col("_facts") & F.col("_case")
    out = _broken(both, F.lit(""), {
        "facts of no case": F.col("_case").isNull(),
        "case without facts": F.col("_facts").isNull(),
        "title differs": known & ~F.col("_t").eqNullSafe(F.col("title")),
        "family differs": known & ~F.col("_f").eqNullSafe(F.col("family")),
        "tags differ": known & ~F.col("_g").eqNullSafe(F.col("tags")),
        "no regions": F.col("_facts") & _no(F.size("_r") > 0),
    })
    named = regions.where(F.trim("goldSection") != "").select("case_id", F.col("goldSection").alias("section"), F.col("id").alias("subject"))
    lost = named.join(sections.select("case_id", "section").distinct().hint("merge"), ["case_id", "section"], "left_anti").select("case_id", F.lit("gold section has no heading").alias("rule"), F.coalesce("subject", F.lit("")).alias("subject"))
    pages = cases.where("pages > 0").select("case_id", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))
    anchored = regions.select("case_id", F.explode("sourceAnchors.page").alias("page")).distinct()
    unseen = pages.join(anchored.hint("merge"), ["case_id", "page"], "left_anti").select("case_id", F.lit("page is not anchored").alias("rule"), F.col("page").cast("string").alias("subject"))
    return out.unionByName(lost).unionByName(unseen)


def unkept_signals(leaves: DataFrame) -> DataFrame:
    """Literals of expectations that policies do not guarantee."""
    le = leaves.select("case_id", F.col("id").alias("leaf_id"), F.col("evidencePolicy.type").alias("kind"), "expectation")
    state = leaves.where("evidencePolicy.type = 'form_state'").select("case_id", F.col("id").alias("leaf_id"), F.lit("state").alias("role"), F.lit(0).alias("group_no"), F.col("evidencePolicy.state").alias("alternative"))
    terms = files.leaf_terms(leaves).select("case_id", "leaf_id", "role", "group_no", "alternative").unionByName(state)
    return policy_violations(le, terms, ["case_id"]).select("case_id", F.concat(F.lit("policy does not keep a "), "signal").alias("rule"), F.col("leaf_id").alias("subject"))


def all_violations(facts: DataFrame, cases: DataFrame, sections: DataFrame) -> DataFrame:
    """(case_id, rule, subject): everything that is wrong with facts; those of closed worlds against columns of gold are ``operators.gold_audit``'s."""
    r = files.regions(facts)
    le = files.leaves(r)
    parts = (files.violations(facts), region_rules(r), leaf_rules(le), anchor_rules(r, cases), case_rules(facts, r, cases, sections), unkept_signals(le))
    return reduce(DataFrame.unionByName, parts)
