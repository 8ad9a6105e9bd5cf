"""Literal signals of a text: dates, times, identifiers, amounts and comparisons that evidence has to keep."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns without lookaround, the same in Java and RE2.
PATTERNS = {
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "time": r"[0-9]{1,2}:[0-9]{2}",
    "identifier": r"[A-Z]{2,}-[0-9]+",
    "scalar": r"[0-9]+(?:[.,][0-9]+)*",
    "comparison": r"(?:<=|>=|<|>|=) ?[0-9]+",
    "direction": r"(?:->|<-)",
}


def signals(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))


def date_alternatives(day: Column) -> Column:
    """Forms that a date is written in."""
    forms = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "dd.MM.yyyy", "d MMMM", "MMMM d")
    return F.transform(F.array(*(F.date_format(day, f) for f in forms)), lambda x: F.lower(x))


def numeric_alternatives(number: Column) -> Column:
    """A decimal with and without thousands marks and trailing zeros."""
    plain = F.regexp_replace(number, ",", "")
    short = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    whole, rest = F.regexp_extract(short, r"^[^.]*", 0), F.regexp_extract(short, r"\..*$", 0)
    grouped = F.concat(F.regexp_replace(F.format_number(whole.cast("decimal(38,0)"), 0), r"\.0*$", ""), rest)
    return F.array_distinct(F.array(number, plain, short, grouped))


def cache_key(*parts: Column) -> Column:
    """A content key: SHA-256 of the parts as JSON."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))), 256)


def _json(**fields: Column) -> Column:
    """A JSON object of these fields in their order, nulls and all."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})


def configured_model(model_id: Column, name: Column, provider: Column, reasoning: Column, location: Column, most_tokens: Column, default: int = 60_000) -> Column:
    """A model as keys know it: what is not set is null, but for the most tokens that it may give."""
    fields = {"id": model_id, "modelName": name, "provider": provider, "reasoning": reasoning, "location": location, "maxOutputTokens": F.coalesce(most_tokens, F.lit(default))}
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def inference_key(protocol: Column, mode: Column, pdf_sha256: Column, prompt: Column, model: Column) -> Column:
    """The content key of an inference: protocol, way of reading, document, prompt and model; ``model`` by ``configured_model``."""
    return F.sha2(_json(protocolVersion=protocol, ingestionMode=mode, pdf=pdf_sha256, prompt=F.sha2(prompt, 256), model=model), 256)


def score_key(prediction: Column, facts_sha256: Column, case_id: Column, title: Column, evaluator: Column) -> Column:
    """The content key of a score: text, facts, case and the evaluator's own hash."""
    return F.sha2(_json(prediction=F.sha2(prediction, 256), facts=facts_sha256, case=F.struct(case_id.alias("id"), title.alias("title")), evaluator=evaluator), 256)


def checkpoint_key(evaluator: Column, case: Column, facts_sha256: Column, prediction: Column, kind: Column, part: Column) -> Column:
    """The content key of one part of an evaluation: ``case`` is a struct (id, title, pages), ``part`` the batch or the regions that it asks about."""
    return F.sha2(_json(evaluator=evaluator, testCase=case, facts=facts_sha256, prediction=F.sha2(prediction, 256), kind=kind, part=part), 256)


def prompt_key(key: Column, prefix: str) -> Column:
    """A short key for a provider's prompt cache."""
    return F.concat(F.lit(prefix + "-"), F.substring(key, 1, 48))
