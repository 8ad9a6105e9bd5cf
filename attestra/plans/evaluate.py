"""Candidates scored on typed obligations of every kind: pages, gates, guarded judgements, precredits, claims and scores in one plan.

Tables, by the columns ``keys`` of a candidate, which hold ``case_id``:

* ``candidates(keys, text)``; ``regions(case_id, region_id, pages, unique_evidence, budget)``;
* ``leaves(case_id, region_id, leaf_id, claim, kind, strict, expectation, state, harm)``: claim is the type of the claim, kind that of its policy;
* ``terms(case_id, leaf_id, role, binding_no, group_no, alternative)`` with the roles row, rowParts, column, value, label, source, destination,
  relation, identifier, allOf, tokens, requiredTerms, requiredBindings and localBindings;
* ``judged(keys, leaf_id, at, status, refs)`` and ``claims(keys, region_id, key)``: what external judges said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import alias_join, bindings, closed_world, edges, evidence, gates, lexical, lines, order, scoring
from ..session import dealt, written
from ..sources import facts as fact_files

GRID_ROLES, EDGE_ROLES = ("row", "rowParts", "column", "value"), ("source", "destination", "relation", "identifier")


def paged_lines(candidates: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ref, raw, page): lines with their pages; a case has as many pages as its regions name."""
    n = regions.groupBy("case_id").agg(F.max(F.array_max("pages")).alias("n_pages"))
    rows = lines.candidate_lines(candidates.join(n.hint("merge"), "case_id", "left").select(*keys, "n_pages", "text"), [*keys, "n_pages"])
    return lines.page_map(rows, [*keys, "n_pages"]).drop("n_pages")


def scoped(paged: DataFrame, regions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Texts (keys, scope, text), and (keys, region_id, scope, pages): each region reads its pages alone, or all where no page is known.

    Regions of the same pages share a text, so a candidate is laid out once for each set of pages, not for each region.
    """
    mapped = paged.groupBy(*keys).agg(F.bool_or(F.col("page").isNotNull()).alias("_mapped"))
    own = mapped.join(regions.select("case_id", "region_id", F.array_sort(F.array_distinct("pages")).alias("pages")).hint("merge"), "case_id")
    own = own.withColumn("scope", F.when(F.col("_mapped"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ",")).otherwise("all"))
    scopes = own.select(*keys, "scope", "_mapped", "pages").dropDuplicates([*keys, "scope"])
    seen = ~F.col("_mapped") | F.array_contains("pages", F.col("page"))
    shown = paged.join(scopes.hint("merge"), keys).select(*keys, "scope", F.struct("ref", F.when(F.coalesce(seen, F.lit(False)), F.col("raw")).otherwise("").alias("raw")).alias("x"))
    texts = shown.groupBy(*keys, "scope").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return texts.select(*keys, "scope", F.array_join(F.transform("x", lambda x: x["raw"]), "\n").alias("text")), own.select(*keys, "region_id", "scope", "pages")


def present(rows: DataFrame, **tests: str) -> dict[str, bool]:
    """Whether any of ``rows`` meets each test: what has no rows needs no gate."""
    return rows.agg(*(F.coalesce(F.bool_or(F.expr(t)), F.lit(False)).alias(n) for n, t in tests.items())).first().asDict()


def _flags(rows: DataFrame, keys: list[str], satisfied: Column, contradiction: Column, partial: Column | None = None) -> DataFrame:
    return rows.select(*keys, "leaf_id", satisfied.alias("satisfied"), contradiction.alias("contradiction"), (F.lit(False) if partial is None else partial).alias("partial"), F.col("refs").cast("array<int>").alias("refs"))


def resolved(texts: DataFrame, leaves: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, leaf_id, satisfied, contradiction, partial, refs): each obligation by the gate of its kind, all in one table.

    ``texts(keys, text)``, ``leaves`` and ``terms`` with ``keys``; obligations of quality alone have no gate.
    """
    kinds = {
        "table": "kind = 'table_binding'", "edge": "kind = 'directed_edge'", "form": "kind = 'form_state'", "near": "kind = 'lexical' and not strict", "strict": "kind = 'lexical' and strict",
        "fields": "kind = 'ordered_tokens' and claim = 'structure'", "records": "kind = 'ordered_tokens' and claim = 'ordered_record'",
        "tokens": "kind = 'ordered_tokens' and claim not in ('structure', 'ordered_record')",
    }
    of = lambda name: leaves.where(kinds[name]).select(*keys, "leaf_id")
    said = lambda name, *roles: terms.where(F.col("role").isin(*roles)).join(of(name).hint("merge"), [*keys, "leaf_id"], "left_semi")
    plain = lambda name, *roles: said(name, *roles).select(*keys, "leaf_id", "role", "group_no", "alternative")
    right, wrong, no = F.col("status") == "correct", F.col("status") == "incorrect", F.lit(False)
    lexicals = leaves.where("kind = 'lexical'")

    def form() -> DataFrame:
        labels = terms.where("role = 'label'").groupBy(*keys, "leaf_id").agg(F.collect_set("alternative").alias("label"))
        return gates.form_state(lines.candidate_lines(texts, keys), leaves.where(kinds["form"]).select(*keys, "leaf_id", "state").join(labels.hint("merge"), [*keys, "leaf_id"]), keys, docs=texts)

    told = lambda x: _flags(x, keys, F.col("satisfied"), F.col("contradiction"))
    found = {
        "table": lambda: _flags(bindings.binding(texts, plain("table", *GRID_ROLES), keys), keys, right, wrong, F.col("partial")),
        "edge": lambda: _flags(edges.edge(texts, plain("edge", *EDGE_ROLES), keys), keys, right, wrong),
        "form": lambda: _flags(form(), keys, right, wrong),
        "near": lambda: _flags(lexical.lexical_resolution(texts, said("near", "allOf"), lexicals, keys), keys, F.col("satisfied"), no),
        "strict": lambda: _flags(lexical.strict_lexical(texts, said("strict", "allOf"), lexicals, keys), keys, F.col("satisfied"), no),
        "fields": lambda: told(order.ordered_gate(texts, said("fields", "tokens"), keys, records=False)),
        "records": lambda: told(order.ordered_gate(texts, said("records", "tokens"), keys, records=True)),
        "tokens": lambda: _flags(evidence.ordered_tokens(texts, said("tokens", "tokens"), keys), keys, F.col("in_order"), no),
    }
    out, here = None, present(leaves, **kinds)
    # Each gate is a plan of its own; written one by one, Spark plans and runs them apart. One without obligations gives no rows and is not run.
    for name, gate in found.items():
        if here[name]:
            x = written(gate(), "evaluate-gate")
            out = x if out is None else out.unionByName(x)
    return _flags(leaves.where(no).withColumn("refs", F.array().cast("array<int>")), keys, no, no) if out is None else out


#: The roles by which obligations of a kind are found; a form has one.
LOCATORS = {"table_binding": ("row", "column"), "form_state": ("label", None), "directed_edge": ("source", "destination")}


def locator_overlaps(leaves: DataFrame, terms: DataFrame) -> DataFrame:
    """(case_id, leaf_id): obligations of a case that a gate could take for another one of their kind.

    Alternatives overlap if they may mean one member. Tables overlap in row (each part in one of the other's) and column, forms in
    label, edges in both ends. Answer keys alone are compared, once for all candidates. Obligations with the same locators overlap
    and stand for each other; others meet only where an alternative of either locator has an alias there.
    """
    kinds = F.col("kind").isin(*LOCATORS)
    norm = terms.withColumn("role", F.when(F.col("role") == "rowParts", "row").otherwise(F.col("role")))
    norm = norm.withColumn("group_no", F.when(F.col("role") == "row", F.col("group_no")).otherwise(0))
    sided = leaves.where(kinds).select("case_id", "leaf_id", "kind").join(evidence.normal_terms(norm).hint("merge"), ["case_id", "leaf_id"])
    side = F.lit(None).cast("int")
    for kind, (first, second) in LOCATORS.items():
        here = F.col("kind") == kind
        side = F.when(here & (F.col("role") == first), 0).when(here & (F.col("role") == (second or "")), 1).otherwise(side)
    sided = sided.withColumn("side", side).where("side is not null")
    groups = sided.groupBy("case_id", "kind", "leaf_id", "side", "group_no").agg(F.array_sort(F.collect_set("alternative")).alias("alts"))
    both = lambda s: F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("alts"))))
    locators = groups.groupBy("case_id", "kind", "leaf_id").agg(both(0).alias("x"), both(1).alias("y"))
    # One obligation stands for all with the same locators.
    classes = written(locators.groupBy("case_id", "kind", "x", "y").agg(F.count("*").alias("n"), F.min("leaf_id").alias("one")), "evaluate-locators")
    by = ["case_id", "kind"]
    names = lambda c, as_: F.explode(F.when(F.size(c) > 0, F.array_distinct(F.flatten(c))).otherwise(F.array(F.lit("")))).alias(as_)
    placed = classes.select(*by, "one", names("x", "px"), "y").select(*by, "one", "px", names("y", "py"))
    alike = lambda c: alias_join.alias_pairs(placed.withColumnRenamed(c, "name"), placed.withColumnRenamed(c, "name"), by)
    other = placed.select(*by, F.col("one").alias("other"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    # Names of both sides go from one to the other before obligations meet, so a column that all rows share makes no pairs by itself.
    spread = placed.join(alike("px").withColumnRenamed("left", "px").withColumnRenamed("right", "qx").hint("merge"), [*by, "px"]).join(alike("py").withColumnRenamed("left", "py").withColumnRenamed("right", "qy").hint("merge"), [*by, "py"])
    met = spread.join(other.hint("merge"), [*by, "qx", "qy"]).where("one < other").select(*by, "one", "other").distinct()
    full = lambda a: classes.select(*by, F.col("one").alias(a), F.col("x").alias(f"{a}_x"), F.col("y").alias(f"{a}_y"))
    met = met.join(full("one").hint("merge"), [*by, "one"]).join(full("other").hint("merge"), [*by, "other"])
    meet = lambda x, y: F.exists(x, lambda p: F.exists(y, lambda q: alias_join.is_alias(p, q)))
    each = lambda x, y: F.forall(x, lambda g: F.exists(y, lambda h: meet(g, h)))
    same = lambda c: each(F.col(f"one_{c}"), F.col(f"other_{c}")) & each(F.col(f"other_{c}"), F.col(f"one_{c}"))
    pairs = met.where(same("x") & same("y")).select("case_id", "kind", F.explode(F.array("one", "other")).alias("one"))
    marked = pairs.unionByName(classes.where("n > 1").select("case_id", "kind", "one")).distinct()
    found = marked.join(classes.select("case_id", "kind", "one", "x", "y").hint("merge"), [*by, "one"])
    return locators.join(found.hint("merge"), ["case_id", "kind", "x", "y"], "left_semi").select("case_id", "leaf_id").distinct()


def cited_lines(judged: DataFrame, paged: DataFrame, own: DataFrame, leaves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, leaf_id, status, refs): the first judgement of each obligation, with the cited lines that exist, say something and are on its pages."""
    first = judged.join(leaves.select(*keys, "leaf_id", "region_id").hint("merge"), [*keys, "leaf_id"]).groupBy(*keys, "leaf_id", "region_id").agg(F.min_by(F.struct("status", "refs"), "at").alias("j"))
    good = first.select(*keys, "leaf_id", "region_id", F.explode(F.array_distinct("j.refs")).alias("ref")).join(own.select(*keys, "region_id", "scope", "pages").hint("merge"), [*keys, "region_id"])
    good = good.join(paged.where(F.trim("raw") != "").hint("merge"), [*keys, "ref"]).where((F.col("scope") == "all") | F.array_contains("pages", F.col("page")))
    good = good.groupBy(*keys, "leaf_id").agg(F.array_sort(F.collect_set(F.col("ref").cast("int"))).alias("refs"))
    return first.select(*keys, "leaf_id", F.col("j.status").alias("status")).join(good.hint("merge"), [*keys, "leaf_id"], "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<int>")))


def guarded(rows: DataFrame) -> DataFrame:
    """``rows`` with the judged status and refs under what the gates found; a status other than missing without lines is missing.

    Wants kind, claim, strict, status, refs, satisfied, contradiction, partial, near, bound (null: no bindings), bound_refs, anchored, found_refs.
    """
    kind, claim, none = F.col("kind"), F.col("claim"), F.array().cast("array<int>")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    s, refs, found = F.coalesce("status", F.lit("missing")), F.coalesce("refs", none), F.coalesce("found_refs", none)
    rows = rows.withColumns({"_s": s, "_r": refs})
    unbound = (F.col("_s") == "correct") & (kind == "ordered_tokens") & F.col("bound").isNotNull()
    rows = rows.withColumns({"_s": F.when(unbound & ~F.col("bound"), "missing").otherwise(F.col("_s")), "_r": F.when(unbound & F.col("bound"), F.array_union("_r", F.coalesce("bound_refs", none))).otherwise(F.col("_r"))})
    right, wrong = F.col("_s") == "correct", F.col("_s") == "incorrect"
    ordered = (kind == "ordered_tokens") & claim.isin("structure", "ordered_record")
    seen = (kind == "qualitative") & (claim == "visual_description") & (F.col("_s") != "missing")
    table, edge, words = (kind == "table_binding") & (claim == "table_binding"), (kind == "directed_edge") & (claim == "directed_edge"), kind == "lexical"
    restored = words & wrong & ~yes("strict") & yes("satisfied") & F.arrays_overlap(found, F.col("_r"))
    status = (
        F.when(ordered & wrong & ~yes("contradiction"), "missing")
        .when(ordered & right & ~yes("satisfied"), F.when(yes("contradiction"), "incorrect").otherwise("missing"))
        .when(seen & ~yes("anchored"), "missing")
        .when(restored, "correct")
        .when(words & right & yes("strict") & ~yes("satisfied"), "missing")
        .when(table & wrong & ~yes("contradiction"), "missing")
        .when(table & right & (yes("partial") | (~yes("satisfied") & ~yes("near"))), "missing")
        .when(edge & yes("contradiction"), "incorrect")
        .when(edge & right & ~yes("satisfied") & ~yes("near"), "missing")
        .otherwise(F.col("_s"))
    )
    taken = (ordered & right & (yes("satisfied") | yes("contradiction"))) | restored | (words & right & yes("strict")) | (edge & yes("contradiction"))
    rows = rows.withColumns({"_t": status, "_r": F.when(taken, found).otherwise(F.col("_r"))})
    return rows.withColumn("status", F.when(F.size("_r") == 0, "missing").otherwise(F.col("_t"))).withColumn("refs", F.when(F.col("status") == "missing", none).otherwise(F.array_sort("_r"))).drop("_s", "_t", "_r")


def leaf_statuses(candidates: DataFrame, regions: DataFrame, leaves: DataFrame, terms: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, region_id, leaf_id, harm, status, refs, credited): a precredit, else the guarded judgement, else missing."""
    paged = written(paged_lines(candidates, regions, keys), "evaluate-lines")
    texts, own = scoped(paged, regions, keys)
    k = [*keys, "scope"]
    texts = written(dealt(texts, k), "evaluate-texts")
    owed = written(own.join(leaves.hint("merge"), ["case_id", "region_id"]), "evaluate-leaves")
    said = written(owed.select(*k, "leaf_id").join(terms.hint("merge"), ["case_id", "leaf_id"]), "evaluate-terms")
    gate = resolved(texts, owed, said, k).withColumnRenamed("refs", "found_refs")
    roles = lambda *r: said.where(F.col("role").isin(*r)).select(*k, "leaf_id", "role", "group_no", "alternative")
    listed = lambda *r: "role in (" + ", ".join(f"'{x}'" for x in r) + ")"
    here = present(said, grid=listed(*GRID_ROLES), edge=listed(*EDGE_ROLES), bound="role = 'requiredBindings'") | present(owed, visual="claim = 'visual_description' and kind = 'qualitative'")
    near = said.where(F.lit(False)).select(*k, "leaf_id")
    if here["grid"]:
        near = near.unionByName(bindings.near_binding(texts, roles(*GRID_ROLES), k).select(*k, "leaf_id"))
    if here["edge"]:
        near = near.unionByName(edges.edge(texts, roles(*EDGE_ROLES), k, semantic=True).where("status = 'correct'").select(*k, "leaf_id"))
    near = written(near.distinct(), "evaluate-near")
    need = said.where("role = 'requiredBindings'")
    bound = need.select(*k, "leaf_id").distinct().withColumn("bound_refs", F.lit(None).cast("array<int>"))
    if here["bound"]:
        bound = need.select(*k, "leaf_id").distinct().join(evidence.required_bindings(evidence.units(texts, k), need, k).withColumnRenamed("refs", "bound_refs").hint("merge"), [*k, "leaf_id"], "left")
    bound = written(bound.select(*k, "leaf_id", F.col("bound_refs").isNotNull().alias("bound"), F.col("bound_refs").cast("array<int>").alias("bound_refs")), "evaluate-bound")
    cited = written(cited_lines(judged, paged, own, owed, keys), "evaluate-cited")
    seen = owed.where("claim = 'visual_description' and kind = 'qualitative'").select(*k, "leaf_id", "expectation")
    anchored = seen.select(*k, "leaf_id", F.lit(False).alias("anchored"))
    if here["visual"]:
        looked = seen.join(cited.hint("merge"), [*keys, "leaf_id"]).select(*k, "leaf_id", F.explode("refs").alias("ref"))
        anchored = evidence.visual_citations(lines.candidate_lines(texts, k), looked, said.where("role = 'requiredTerms'"), seen, k, bindings=said.where("role = 'localBindings'"))
    anchored = written(anchored, "evaluate-anchored")
    rows = owed.join(cited.hint("merge"), [*keys, "leaf_id"], "left").join(gate.hint("merge"), [*k, "leaf_id"], "left").join(near.withColumn("near", F.lit(True)).hint("merge"), [*k, "leaf_id"], "left")
    rows = guarded(rows.join(bound.hint("merge"), [*k, "leaf_id"], "left").join(anchored.hint("merge"), [*k, "leaf_id"], "left"))
    eligible = F.col("kind").isin(*scoring.CREDITED_KINDS) | ((F.col("kind") == "ordered_tokens") & (F.col("claim") == "structure"))
    unique = regions.select("case_id", "region_id", "unique_evidence")
    alike = locator_overlaps(leaves, terms).withColumn("_alike", F.lit(True))
    rows = rows.join(unique.hint("merge"), ["case_id", "region_id"]).join(alike.hint("merge"), ["case_id", "leaf_id"], "left")
    sure = eligible & F.col("unique_evidence") & F.col("_alike").isNull() & F.coalesce(F.col("satisfied") & ~F.col("contradiction") & (F.size("found_refs") > 0), F.lit(False))
    return rows.select(*keys, "region_id", "leaf_id", "harm", F.when(sure, "correct").otherwise(F.col("status")).alias("status"), F.when(sure, F.col("found_refs")).otherwise(F.col("refs")).alias("refs"), sure.alias("credited"))


def evaluate(candidates: DataFrame, regions: DataFrame, leaves: DataFrame, terms: DataFrame, judged: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, regions, total_budget, raw_score, score) of every candidate."""
    statuses = leaf_statuses(candidates, regions, leaves, terms, judged, keys)
    counted = claims.groupBy(*keys, "region_id").agg(F.count("*").alias("n_claims"))
    scored = scoring.region_scores(statuses, counted, [*keys, "region_id"]).join(regions.select("case_id", "region_id", "budget").hint("merge"), ["case_id", "region_id"])
    return scoring.case_scores(scored, keys)


def tables_of(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Regions, obligations and terms of ``sources.facts.read_facts`` as ``evaluate`` takes them; the closed regions that tables are held
    against, (case_id, region_id, labels, members, columns); and (case_id, region_id, member) of all regions."""
    r = fact_files.regions(facts).withColumnRenamed("id", "region_id")
    le = fact_files.leaves(fact_files.regions(facts))
    page = lambda a: F.coalesce(a["documentPage"], a["page"])
    regions = r.select("case_id", "region_id", F.transform("sourceAnchors", page).alias("pages"), F.coalesce("uniqueEvidence", F.lit(False)).alias("unique_evidence"), "budget")
    policy = lambda c: F.col(f"evidencePolicy.{c}")
    leaves = le.select("case_id", "region_id", F.col("id").alias("leaf_id"), F.col("claimType").alias("claim"), policy("type").alias("kind"), F.coalesce(policy("strict"), F.lit(False)).alias("strict"), "expectation", policy("state").alias("state"), "harm")
    terms = fact_files.leaf_terms(le)
    own = terms.join(leaves.select("case_id", "region_id", "leaf_id", "kind").hint("merge"), ["case_id", "leaf_id"])
    named = own.where("(kind = 'form_state' and role = 'label') or (kind = 'table_binding' and role = 'row')").select("case_id", "region_id", F.col("alternative").alias("member"))
    declared = r.select("case_id", "region_id", F.explode("closedWorld.keys").alias("member"))
    members = declared.unionByName(named).distinct()
    columns = own.where("kind = 'table_binding' and role = 'column'").groupBy("case_id", "region_id").agg(F.collect_set("alternative").alias("columns"))
    every = members.groupBy("case_id", "region_id").agg(F.collect_set("member").alias("members"))
    ends = F.transform(F.filter("sourceAnchors", lambda a: F.size(a["sectionPath"]) > 0), lambda a: F.element_at(a["sectionPath"], -1))
    labels = F.array_distinct(F.array_compact(F.concat(F.array("label", "goldSection"), F.coalesce(ends, F.array().cast("array<string>")))))
    closed = r.where("closedWorld.scope = 'table_rows'").select("case_id", "region_id", labels.alias("labels"))
    closed = closed.join(every.hint("merge"), ["case_id", "region_id"]).join(columns.hint("merge"), ["case_id", "region_id"])
    return regions, leaves, terms, closed, members


def evaluate_facts(facts: DataFrame, candidates: DataFrame, judged: DataFrame, reported: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, regions, total_budget, raw_score, score) from facts as they are read, with ``reported(keys, region_id, key)`` claims and those that tables show."""
    regions, leaves, terms, closed, members = tables_of(facts)
    cases = candidates.select(*keys).distinct()
    discovered = written(closed_world.invented_rows(candidates, cases.join(closed.hint("merge"), "case_id"), keys).select(*keys, "region_id", "key"), "evaluate-discovered")
    claims = closed_world.applied_claims(reported.select(*keys, "region_id", "key"), discovered, cases.join(members.hint("merge"), "case_id"), keys)
    return evaluate(candidates, regions, leaves, terms, judged, claims, keys)
