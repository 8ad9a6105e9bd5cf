"""Literals of a statement that evidence must keep: what they are, where they stand, and the forms that each may be written in.

All expressions are built in; a text is searched once for each kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Months, short and long.
MONTHS = (
    ("Jan", "January"), ("Feb", "February"), ("Mar", "March"), ("Apr", "April"), ("May", "May"), ("Jun", "June"),
    ("Jul", "July"), ("Aug", "August"), ("Sep", "September"), ("Oct", "October"), ("Nov", "November"), ("Dec", "December"),
)
MONTH = "(?:" + "|".join(sorted({m for pair in MONTHS for m in pair}, key=lambda m: (-len(m), m))) + ")"
_FREE, _END = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
#: Patterns of literals, by kind.
ISO_DATE = rf"(?U){_FREE}\d{{4}}-\d{{2}}-\d{{2}}{_END}"
TEXT_DATE = rf"(?iU){_FREE}(?:\d{{1,2}}\s+{MONTH}\s+\d{{4}}|{MONTH}\s+\d{{1,2}},?\s+\d{{4}}){_END}"
TIME = rf"(?iU){_FREE}\d{{1,2}}:\d{{2}}(?::\d{{2}})?(?:\s*(?:UTC|GMT|MST|MDT|PST|PDT|PT))?{_END}"
IDENTIFIER = (
    rf"(?U){_FREE}(?:(?=[A-Za-z0-9][A-Za-z0-9._/-]*[A-Za-z])(?=[A-Za-z0-9][A-Za-z0-9._/-]*\d)[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*"
    rf"|[A-Z]{{2,}}[A-Z0-9]*(?:[-_/][A-Z0-9]+)*){_END}"
)
SCALAR = r"(?U)(?<![A-Za-z0-9.])(?:(?<!-)[<>≤≥]=?\s*|[+-]\s*)?\d+(?:,\d{3})*(?:\.\d+)?(?:[eE][+-]?\d+)?"
DIRECTION = r"(?U)(?<=\d)\s*(?:->|→|>)\s*(?=\d)|(?<=\d)\s*(?:<-|←|<)\s*(?=\d)"
UNIT = (
    r"(?iU)(?<![A-Za-z])(?:ng\s*/\s*L|mg\s*/\s*dL|mg\s*/\s*L|[uµμ]g\s*/\s*L|[uµμ]L|mL|psi|nm|[uµμ]m|mm|cm|kV|mA|kW|MHz|kHz|Hz|rpm|kg|"
    r"hours?|hrs?|minutes?|mins?|days?|seconds|secs?|ms|°\s*C|%)(?![A-Za-z])"
)
TIME_UNIT = "(?i)^(?:hours?|hrs?|minutes?|mins?|days?|seconds?|secs?)$"
LETTER_UNIT = r"(?U)(?<=\d)\s*(?:V|A|W|C|g|s)(?![A-Za-z0-9])"
#: Words that settle a state, a bound or a denial.
QUALIFIERS = (
    r"crossed\s+out", r"not\s+applicable", "quantifier", "qualifier", "final", "draft", "current", "superseded", "accepted", "rejected", "approved", "unapproved", "open", "closed",
    "pending", "released", "hold", "held", "quarantine", "quarantined", "required", "optional", "never", "none", "only", "not", "no", "yes", "true", "false", "pass", "passed",
    "fail", "failed", "checked", "unchecked", "disabled", "upper", "lower", "minimum", "maximum", "before", "after", "above", "below", "within", "outside", "inclusive",
    "exclusive", "native", "raster", "signed", "unsigned", "corrected", "uncorrected", "controlling", "advisory", "active", "inactive",
)
QUALIFIER = r"(?iU)\b(?:" + "|".join(QUALIFIERS) + r")\b"
#: Other words for a qualifier.
SYNONYMS = {
    "maximum": ("max",), "minimum": ("min",), "within": ("+/-", "±"), "not": ("no", "without", "absent"), "no": ("not", "none", "without", "absent"), "final": ("finalized",),
    "accepted": ("accept",), "rejected": ("reject",), "current": ("controlling",), "controlling": ("current", "controls"), "crossed out": ("crossed",), "not applicable": ("N/A", "NA"),
    "open": ("unresolved", "outstanding"), "closed": ("resolved", "completed"), "pending": ("awaiting", "not final"), "hold": ("held", "on hold", "not released", "blocked"),
    "held": ("hold", "on hold", "not released", "blocked"), "above": ("over", "more than", "greater than", "exceeds", ">"), "below": ("under", "less than", "fewer than", "<"),
    "before": ("prior to", "earlier than"), "after": ("following", "later than"), "only": ("solely", "exclusively"),
}
#: Exponents beyond this are left as they are written.
MOST_EXPONENT = 400
_NONE = "array<string>"


def _strings(*items) -> Column:
    return F.array(*(F.lit(x) if isinstance(x, str) else x for x in items))


def _none() -> Column:
    return F.array().cast(_NONE)


def found(text: Column, pattern: str) -> Column:
    """(start, end, value) of every match, in turn; ends are exclusive, starts count from 0."""

    def placed(x: Column) -> Column:
        size = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, p: s + F.length(p))
        at = lambda w, i: let(size(x["parts"], i + 1) + size(x["words"], i), lambda s: F.struct(s.alias("start"), (s + F.length(w)).alias("end"), w.alias("value")))
        return F.transform(x["words"], at)

    return let(F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("words")), placed)


def _apart(spans: Column, taken: Column) -> Column:
    """Those of ``spans`` that overlap none of ``taken``."""
    return F.filter(spans, lambda s: ~F.exists(taken, lambda t: (s["start"] < t["end"]) & (t["start"] < s["end"])))


def _compact(value: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")), r"^[ .,;:]+|[ .,;:]+$", "")


def signal_spans(text: Column) -> Column:
    """(kind, start, end, value) of a text's literals, by kind and place.

    Dates come first, then times, identifiers and numbers: none of them overlaps one before it. Units, directions and qualifiers stand by
    themselves; a unit of time counts only with a digit at most 12 characters away.
    """

    def swept(t: Column) -> Column:
        iso = found(t, ISO_DATE)
        return let(iso, lambda a: let(F.concat(a, _apart(found(t, TEXT_DATE), a)), lambda dates: let(F.concat(dates, _apart(found(t, TIME), dates)), lambda timed: let(_apart(found(t, IDENTIFIER), timed), lambda ids: F.concat(
            named("date", dates), named("time", F.array_except(timed, dates)), named("identifier", ids), named("scalar", _apart(found(t, SCALAR), F.concat(timed, ids))),
            named("unit", F.concat(units(t), found(t, LETTER_UNIT))), named("direction", found(t, DIRECTION)), named("qualifier", found(t, QUALIFIER)),
        )))))

    def named(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _compact(s["value"]).alias("value")))

    def units(t: Column) -> Column:
        tidy = lambda v: F.regexp_replace(F.regexp_replace(v, r"(?U)°\s+", "°"), r"(?U)\s*/\s*", "/")
        near = lambda s: F.substr(t, F.greatest(F.lit(1), s["start"] - 11), s["end"] + 12 - F.greatest(F.lit(0), s["start"] - 12)).rlike(r"(?U)\d")
        kept = F.filter(found(t, UNIT), lambda s: ~s["value"].rlike(TIME_UNIT) | near(s))
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), tidy(s["value"]).alias("value")))

    return F.filter(let(F.coalesce(text, F.lit("")), swept), lambda s: s["value"] != "")


def _plain_number(number: Column) -> Column:
    """A number without exponent, leading zeros, or zeros at the end of its fraction."""
    whole, part = F.regexp_extract(number, r"^(\d+)", 1), F.regexp_extract(number, r"^\d+\.(\d+)", 1)
    power = F.coalesce(F.regexp_extract(number, r"[eE]([+-]?\d+)$", 1).try_cast("int"), F.when(number.rlike("[eE]"), F.lit(None)).otherwise(0))

    def shifted(digits: Column, point: Column) -> Column:
        left = F.when(point <= 0, "0").otherwise(F.rpad(F.substr(digits, F.lit(1), point), F.greatest(point, F.lit(0)), "0"))
        right = F.when(point < 0, F.concat(F.repeat(F.lit("0"), -point), digits)).when(point == 0, digits).otherwise(F.substr(digits, point + 1, F.length(digits)))
        tidy = F.regexp_replace(F.regexp_replace(left, r"^0+(?=\d)", ""), r"^$", "0")
        return F.concat(tidy, F.regexp_replace(F.concat(F.lit("."), F.regexp_replace(right, "0+$", "")), r"^\.$", ""))

    plain = let(F.struct(F.concat(whole, part).alias("d"), (F.length(whole) + power).alias("p")), lambda x: shifted(x["d"], x["p"]))
    return F.when(F.abs(power) <= MOST_EXPONENT, plain)


def numeric_forms(value: Column) -> Column:
    """Forms of a number: without thousands marks, plain, with its comparison or sign apart or as one sign; none for other texts."""
    tight = F.regexp_replace(value, r"(?U)\s+", "")
    grouped = ~tight.contains(",") | tight.rlike(r"^[<>≤≥]?[=]?[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?(?:[eE][+-]?\d+)?$")
    compact = F.replace(tight, F.lit(","), F.lit(""))
    pattern = r"^([<>≤≥]=?|[+-])?(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)$"

    def forms(c: Column) -> Column:
        prefix, raw = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
        sign = F.when(prefix == ">=", "≥").when(prefix == "<=", "≤")
        apart = let(_plain_number(raw), lambda n: F.when(n.isNull(), F.array(c)).otherwise(F.concat(
            F.array(c, F.concat(prefix, n)),
            F.when(prefix != "", F.array(F.concat(prefix, F.lit(" "), raw), F.concat(prefix, F.lit(" "), n))).otherwise(_none()),
            F.when(sign.isNotNull(), F.array(F.concat(sign, raw), F.concat(sign, F.lit(" "), raw))).otherwise(_none()),
        )))
        return F.when(c.rlike(pattern), F.array_distinct(apart)).otherwise(_none())

    return F.when(grouped, let(compact, forms)).otherwise(_none())


def date_parts(value: Column) -> Column:
    """(year, month, day) of a date as it is written, or null."""
    v = F.trim(F.regexp_replace(F.replace(value, F.lit(","), F.lit(" ")), r"(?U)\s+", " "))
    number = lambda name: F.expr("map(" + ", ".join(f"'{short.lower()}', {i + 1}" for i, (short, _) in enumerate(MONTHS)) + ")")[F.lower(F.substr(name, F.lit(1), F.lit(3)))]
    get = lambda p, i: F.regexp_extract(v, p, i)
    iso, first, last = r"^(\d{4})-(\d{2})-(\d{2})$", rf"(?i)^(\d{{1,2}}) ({MONTH}) (\d{{4}})$", rf"(?i)^({MONTH}) (\d{{1,2}}) (\d{{4}})$"
    parts = lambda y, m, d: F.struct(y.try_cast("int").alias("year"), m.alias("month"), d.try_cast("int").alias("day"))
    found_ = F.when(v.rlike(iso), parts(get(iso, 1), get(iso, 2).try_cast("int"), get(iso, 3))).when(v.rlike(first), parts(get(first, 3), number(get(first, 2)), get(first, 1)))
    found_ = found_.when(v.rlike(last), parts(get(last, 3), number(get(last, 1)), get(last, 2)))
    return let(found_, lambda x: F.when(x["month"].between(1, 12), x))


def date_forms(value: Column) -> Column:
    """The forms of a date, those without its year last; none for other texts."""

    def forms(p: Column) -> Column:
        name = lambda i: F.element_at(_strings(*(m[i] for m in MONTHS)), p["month"])
        two, one = F.lpad(p["day"].cast("string"), 2, "0"), p["day"].cast("string")
        year, month = F.lpad(p["year"].cast("string"), 4, "0"), F.lpad(p["month"].cast("string"), 2, "0")
        plain = p["year"].cast("string")
        join = lambda *xs: F.concat_ws(" ", *xs)
        full = [F.concat_ws("-", year, month, two), join(one, name(0), plain), join(two, name(0), plain), join(one, name(1), plain), join(name(0), one, plain), join(name(1), one, plain)]
        short = [join(one, name(0)), join(two, name(0)), join(one, name(1)), join(name(0), one), join(name(1), one)]
        return F.when(p.isNotNull(), F.array_distinct(F.array(*full, *short))).otherwise(_none())

    return let(date_parts(value), forms)


def _masked(value: Column, most: int = 4) -> Column:
    """An identifier with each set of its hyphens as blanks; of more than ``most`` hyphens, none."""
    parts = F.split(value, "-", -1)

    def mask(ps: Column) -> Column:
        n = F.size(ps) - 1
        one = lambda m: F.aggregate(F.sequence(F.lit(1), n), F.get(ps, F.lit(0)), lambda s, i: F.concat(s, F.when(F.getbit(m, i - 1) == 1, " ").otherwise("-"), F.get(ps, i)))
        return F.when(n.between(1, most), F.transform(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), n) - 1), one)).otherwise(_none())

    return let(parts, mask)


def _tidy(forms: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(forms, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""))


def signal_forms(kind: Column, value: Column) -> Column:
    """The forms that a literal may be written in, itself first."""
    marks = F.filter(_strings("u", "µ", "μ"), lambda m: F.exists(_strings("u", "µ", "μ"), lambda x: F.contains(value, x)))
    unit = F.transform(marks, lambda m: F.replace(F.replace(F.replace(value, F.lit("µ"), m), F.lit("μ"), m), F.lit("u"), m))
    direction = F.when(value.contains(">") | value.contains("→"), _strings("->", "→", ">")).otherwise(_strings("<-", "←", "<"))
    slash = F.when(value.contains("/"), F.array(F.regexp_replace(value, r"(?U)\s*/\s*", " / "))).otherwise(_none())
    known = F.map_from_entries(F.array(*(F.struct(F.lit(k).alias("k"), _strings(*v).alias("v")) for k, v in SYNONYMS.items())))
    words = F.coalesce(F.get(F.array(known[F.lower(value)]), F.lit(0)), _none())
    zero = r"^0(\d:\d{2}(?::\d{2})?)(.*)$"
    time = F.when(value.rlike(zero), F.array(F.regexp_replace(value, "^0", ""))).otherwise(_none())
    more = {"date": date_forms(value), "scalar": numeric_forms(value), "time": time, "unit": unit, "direction": direction, "identifier": F.concat(slash, _masked(value)), "qualifier": words}
    return _tidy(F.concat(F.array(value), reduce(lambda out, k: F.when(kind == k, more[k]).otherwise(out), more, _none())))


def term_forms(value: Column) -> Column:
    """The forms of a term that evidence may give instead: thousands marks, numbers, arrows and dashes in plain form."""
    return _tidy(F.concat(
        F.array(value, F.regexp_replace(value, r"(?U)(?<=\d),(?=\d{3}(?:\D|$))", "")), numeric_forms(value),
        F.array(F.replace(value, F.lit("→"), F.lit("->")), F.replace(value, F.lit("←"), F.lit("<-")), F.translate(value, "–—", "--")),
    ))
