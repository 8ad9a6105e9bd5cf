"""Column expressions for evidence text: normalisers, phrase tests, HTML and form text, rounding and ranks."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Signs that count as a hyphen, arrows and comparisons, each with its plain form.
DASHES = "‐‑‒–—―−"
SIGNS = (("→", "->"), ("←", "<-"), ("≤", "<="), ("≥", ">="), ("×", "x"), ("\\rightarrow", "->"), ("\\to", "->"), ("\\leftarrow", "<-"))
#: Words that deny what follows.
NEGATION_WORDS = (
    "not", "never", "without", "cannot", "can't", "no longer", "does not", "doesn't", "do not", "don't", "did not", "didn't", "is not", "isn't",
    "was not", "wasn't", "are not", "aren't", "were not", "weren't", "lack", "lacks", "lacked", "missing", "absent",
)
#: Longest first, so that the whole of a negator is taken.
NEGATORS = "|".join(sorted(NEGATION_WORDS, key=len, reverse=True))
#: Words for each state of a form field.
FORM_STATES = {
    "checked": ("checked", "selected", "marked yes"),
    "unchecked": ("unchecked", "unselected", "clear", "marked no"),
    "disabled": ("disabled", "greyed out", "grayed out", "unavailable", "not enabled"),
    "crossed": ("crossed out", "crossed", "struck through", "struck", "strikethrough", "voided", "cancelled"),
}
#: Entities that have a name.
HTML_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
ENTITY = "(?i)&(?:#x[0-9a-f]+|#[0-9]+|[a-z]+);"
#: White space of any script, as a class that Java and RE2 both read.
SPACE = "[ \\t\\n\\x0B\\f\\r\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
SPACES = SPACE + "+"
#: Edges of words of ASCII letters, digits and low lines.
EDGE, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Marks of a form and the words that they stand for, in the order in which they are read.
FORM_MARKS = (
    (rf"(?i)\[{SPACE}*crossed box{SPACE}*:{SPACE}*([^\]]+)\]", " crossed out $1 "),
    (rf"\[{SPACE}*/{SPACE}*\]", " disabled "),
    (rf"\[{SPACE}*[xX✓]{SPACE}*\]|☑|✅", " checked "),
    (rf"\[{SPACE}*\]|☐|⬜", " unchecked "),
    (r"~~([^~]+)~~", " crossed out $1 "),
    (rf"(?i){EDGE}not{SPACE}+checked{END}", " unchecked "),
    (rf"(?i){EDGE}not{SPACE}+selected{END}", " unselected "),
)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form, which Spark has no function for."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def _compat_table() -> tuple[str, str]:
    """Characters of the basic plane, beyond ASCII, whose compatibility form is one ASCII character; and those forms."""
    pairs = [(c, unicodedata.normalize("NFKC", c)) for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) != "Cs"]
    pairs = [(c, f) for c, f in pairs if len(f) == 1 and f.isascii()]
    return "".join(c for c, _ in pairs), "".join(f for _, f in pairs)


COMPAT = _compat_table()
#: Ligatures and signs whose compatibility form has several characters.
COMPAT_WIDE = tuple((c, unicodedata.normalize("NFKC", c)) for c in "ﬀﬁﬂﬃﬄ…™№℃")


def compat(c: Column) -> Column:
    """Wide digits and letters, raised and lowered digits, odd blanks and ligatures in plain form; ASCII texts are left alone.

    This is the part of NFKC that evidence is written in, by built-in functions; ``nfkc`` is all of it.
    """
    out = F.translate(c, *COMPAT)
    for sign, plain in COMPAT_WIDE:
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return F.when(c.rlike("[^\\x00-\\x7F]"), out).otherwise(c)


def _plain_signs(c: Column, dashes: str) -> Column:
    for sign, plain in SIGNS:
        c = F.replace(c, F.lit(sign), F.lit(plain))
    return F.translate(c, dashes, "-" * len(dashes))


def normalize_ascii(c: Column) -> Column:
    """The scorer's normal form, with ``compat`` for NFKC: lower case, plain signs, words and numbers apart, breaks as `` . ``."""
    c = _plain_signs(F.lower(compat(c)), DASHES)
    c = F.replace(c, F.lit("°c"), F.lit(" c"))
    c = F.regexp_replace(F.regexp_replace(c, "([0-9])([a-z])", "$1 $2"), "([a-z])([0-9])", "$1 $2")
    c = F.regexp_replace(F.regexp_replace(c, r"[\n|]", " . "), "[*_`#]", "")
    return F.trim(F.regexp_replace(c, SPACES, " "))


def normalize_evidence(c: Column) -> Column:
    """``normalize_ascii`` after NFKC."""
    return normalize_ascii(nfkc(c))


def normalize_audit(c: Column) -> Column:
    """The audit's normal form: edges between any letters and digits; pipes, marks and breaks as blanks."""
    c = F.regexp_replace(F.lower(nfkc(c)), rf"\\\\(?:longrightarrow|rightarrow|to){END}", "->")
    c = F.regexp_replace(c, rf"\\\\(?:longleftarrow|leftarrow){END}", "<-")
    for sign, plain in SIGNS[:5]:
        c = F.replace(c, F.lit(sign), F.lit(plain))
    c = F.translate(c, "‐‑‒–—−", "------")
    c = F.regexp_replace(F.regexp_replace(c, r"(\p{N})(\p{L})", "$1 $2"), r"(\p{L})(\p{N})", "$1 $2")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[|*_`#]", " "), r"(?U)\s+", " "))


def normalize_authoring(c: Column) -> Column:
    """The authoring side's normal form, with ``compat`` for NFKC: case folding, plain signs, three dashes only."""
    c = F.replace(F.lower(compat(c)), F.lit("ß"), F.lit("ss"))
    c = F.translate(c, "ς–—−", "σ---")
    for sign, plain in SIGNS[:5]:
        c = F.replace(c, F.lit(sign), F.lit(plain))
    c = F.regexp_replace(F.regexp_replace(c, r"(\p{N})(\p{L})", "$1 $2"), r"(\p{L})(\p{N})", "$1 $2")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[*_`#|]", " "), r"(?U)\s+", " "))


def letter_phrase(phrase: Column, inner: str = r"\p{L}\p{N}") -> Column:
    """A pattern for a phrase, with no letter or digit of any script (or what ``inner`` names) running on where the phrase ends in one."""
    left = F.when(phrase.rlike(r"^[\p{L}\p{N}]"), f"(?<![{inner}])").otherwise("")
    right = F.when(phrase.rlike(r"[\p{L}\p{N}]$"), f"(?![{inner}])").otherwise("")
    return F.concat(left, F.lit("\\Q"), F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"), right)


def has_whole_phrase(text: Column, phrase: Column, inner: str = r"\p{L}\p{N}") -> Column:
    """Whether a text holds a phrase that isn't empty, both in one normal form."""
    return F.coalesce((phrase != "") & F.contains(text, phrase) & F.rlike(text, letter_phrase(phrase, inner)), F.lit(False))


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether a normalised text holds a phrase, with no ASCII letter or digit running on where the phrase ends in one."""
    left = "(?<![a-z0-9])" if phrase[:1].isascii() and phrase[:1].isalnum() else ""
    right = "(?![a-z0-9])" if phrase[-1:].isascii() and phrase[-1:].isalnum() else ""
    return text.rlike(left + "\\Q" + phrase.replace("\\E", "\\E\\\\E\\Q") + "\\E" + right) if phrase else F.lit(False)


def has_alternative(text: Column, alternatives: Sequence[str]) -> Column:
    found = F.lit(False)
    for a in alternatives:
        found = found | has_phrase(text, a)
    return found


def let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_negated(before: Column) -> Column:
    """Whether what stands before a hit negates it: its clause's last negator stands at most 16 words before; ``not only`` frees a clause.

    By definition a negator reaches 128 signs, and a clause is looked for in these alone (``src/evaluator.ts:687`` of the reference).
    """
    clause = F.element_at(F.split(F.right(before, F.lit(128)), rf"[.;!?]|{EDGE}(?:but|however|instead){END}"), -1)
    tail = lambda c: F.filter(F.split(F.regexp_extract(c, rf"(?s)^.*{EDGE}(?:{NEGATORS}){END}(.*)$", 1), SPACES), lambda w: w != "")
    return let(clause, lambda c: ~c.rlike(rf"{EDGE}not{SPACES}only{END}") & c.rlike(rf"{EDGE}(?:{NEGATORS}){END}") & (F.size(tail(c)) <= 16))


def _entity(e: Column) -> Column:
    """What an entity stands for: by name, by number if a character has it, else a blank."""
    body = F.substr(e, F.lit(2), F.length(e) - 2)
    digits = F.when(F.lower(body).startswith("#x"), F.conv(F.substr(body, F.lit(3)), 16, 10)).otherwise(F.substr(body, F.lit(2)))
    code = digits.try_cast("long")
    good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(32)), 8, "0")), "UTF-32")
    named = F.lit(None).cast("string")
    for name, sign in HTML_ENTITIES.items():
        named = F.when(F.lower(body) == name, sign).otherwise(named)
    return F.coalesce(F.when(body.startswith("#"), F.when(good, char)).otherwise(named), F.lit(" "))


def html_text(c: Column) -> Column:
    """Text of an HTML fragment: breaks and tags as blanks, entities decoded once, unknown ones as blanks, white space in one blank.

    A text is cut once into entities and what lies between, so the work grows with its length.
    """
    plain = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?\s*>", " "), "<[^>]*>", " ")
    token = lambda x: F.when(x.startswith("&") & (F.length(x) > 1), _entity(x)).otherwise(x)
    decoded = lambda x: F.array_join(F.transform(F.regexp_extract_all(x, F.lit(f"[^&]+|{ENTITY}|&"), F.lit(0)), token), "")
    return let(plain, lambda x: F.trim(F.regexp_replace(F.when(x.contains("&"), decoded(x)).otherwise(x), SPACES, " ")))


def form_text(c: Column) -> Column:
    """A form's marks as words, then the scorer's normal form."""
    for pattern, word in FORM_MARKS:
        c = F.regexp_replace(c, pattern, word)
    return normalize_ascii(c)


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Halves go up, for negative numbers too; null and NaN give 0."""
    f = float(10**digits)
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(F.floor(c * f + 0.5) / f)


def clamp01(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def evidence_rank(refs: Column) -> Column:
    """Orders evidence: its span, its number of lines, then its lines as text."""
    r = F.array_sort(F.array_distinct(refs))
    return F.struct((F.array_max(r) - F.array_min(r)).alias("span"), F.size(r).alias("n"), F.array_join(F.transform(r, lambda x: x.cast("string")), ",").alias("key"))


def digit_runs(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), ",")


def same_member(a: Column, b: Column, least: float = 0.86) -> Column:
    """Equal, or alike by edit distance with the same runs of digits."""
    longest = F.greatest(F.length(a), F.length(b))
    alike = (1 - F.levenshtein(a, b) / longest >= least) & (F.regexp_replace(a, "[^0-9]+", ",") == F.regexp_replace(b, "[^0-9]+", ","))
    return (a == b) | F.coalesce(alike & (digit_runs(a) == digit_runs(b)), F.lit(False))


def pipe_cells(line: Column) -> Column:
    """Cells of a piped line, or null: bullet and outer pipes go, escaped pipes stay, at least two cells."""
    body = F.regexp_replace(F.regexp_replace(F.trim(line), r"^[-*+] +", ""), r"^\||(?<!\\)\|$", "")
    cells = F.transform(F.split(body, r"(?<!\\)\|"), lambda x: F.trim(F.replace(x, F.lit("\\|"), F.lit("|"))))
    return F.when(line.contains("|") & (F.size(cells) >= 2), cells)


def plain_cells(line: Column) -> Column:
    """Piped cells, else those apart by tabs or two blanks."""
    cells = F.split(F.trim(line), r"\t+| {2,}")
    return F.coalesce(pipe_cells(line), F.when(F.size(cells) >= 2, cells))


def is_delimiter(cells: Column) -> Column:
    return F.forall(cells, lambda c: c.rlike("^:?-{3,}:?$"))


def markdown_row(*cells: Column) -> Column:
    """A table row, with pipes escaped and breaks as blanks."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.replace(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")) for c in cells)), F.lit(" |"))
