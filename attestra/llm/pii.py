"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds email, ip, card and phone follow fixed rules. The method adds spans of kind iban (its country's length, then mod-97;
for other countries the longest end that mod-97 confirms), national identity numbers of the form 123-45-6789, unmarked phone
numbers of 10 digits, and secrets: what stands after a name like ``token`` or ``api_key`` and ``=`` or ``:``, if its signs
are mixed enough (``ENTROPY`` bits a sign), and key blocks, both at any length. Spans that the method adds only count if their score reaches ``least``;
base spans always stay. A score starts at the kind's own, gains where a context word of the kind stands within
``CONTEXT`` characters before or after, and loses where a word that speaks against it does. Context words are whole words.

Defined results: a null or empty text has no spans; rows are handled one by one, so repeated rows have spans of their own; spans that
begin together go by kind, in the order of ``KINDS``; columns besides the id and the text are not looked at; an empty table gives no
rows. Spans count code points, end exclusive. Long runs of digits or signs take time in proportion to their
length (patterns start at a run's first digit, and do not give back what they matched).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

KINDS = ("email", "ip", "card", "phone", "iban", "national_id", "local_phone", "secret")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
#: An IBAN's length by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
SECRET = re.compile(r"(?i)(?<![a-z0-9])(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|password|passwd|pwd|bearer)\b[\"']?\x20{0,4}[=:]\x20{0,4}[\"']?([A-Za-z0-9+/_.=-]{12,}+)")
KEY_BEGIN, KEY_END = (re.compile(rf"-----{edge} [A-Z ]{{0,30}}PRIVATE KEY-----") for edge in ("BEGIN", "END"))
KEY_BODY = re.compile(r"[A-Za-z0-9+/=\s]*+")
ENTROPY = 3.0
NATIONAL_ID = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9.-]*[0-9])")
DIGIT = re.compile(r"[0-9]")
CONTEXT = 40
_words = lambda *ws: re.compile(r"(?i)(?<![a-z0-9])(?:" + "|".join(ws) + r")(?![a-z0-9])")
_PHONE_WORDS, _NUMBER_WORDS = _words("phones?", "telephone", "calls?", "called", "tel", "mobile", "fax", "cell"), _words("orders?", "part", "serial", "isbn", "invoice")
#: Score of a kind by itself, words that raise it, words that lower it.
SCORES = {
    "email": (0.9, _words("e?-?mails?", "contact", "write"), _words("example")),
    "ip": (0.6, _words("ip", "address", "hosts?", "servers?"), _words("versions?", "release", "section")),
    "card": (0.8, _words("cards?", "visa", "pay", "paid", "payment", "credit"), _words("isbn", "orders?", "serial")),
    "phone": (0.8, _PHONE_WORDS, _words("scores?", "version")),
    "iban": (0.9, _words("iban", "banks?", "accounts?"), _words("serial", "part")),
    "national_id": (0.5, _words("ssn", "social", "security", "identity"), _NUMBER_WORDS),
    "local_phone": (0.5, _PHONE_WORDS, _NUMBER_WORDS),
    "secret": (0.8, _words("keys?", "tokens?", "secrets?", "passwords?", "login", "auth", "private"), _words("example", "placeholder", "dummy")),
}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers by their country's length, or for other countries the longest end; what runs on in capitals or digits after a blank is none of it."""
    at = 0
    while m := IBAN.search(text, at):
        at = m.start() + 2
        ends = [i + 1 for i in range(m.start(), m.end()) if text[i] != " "]  # after each sign
        for n in [IBAN_LENGTHS[m[0][:2]]] if m[0][:2] in IBAN_LENGTHS else range(min(34, len(ends)), 14, -1):
            if n > len(ends):
                continue
            end = ends[n - 1]
            if (end == len(text) or not text[end].isalnum()) and mod97(text[m.start() : end].replace(" ", "")):
                yield m.start(), end
                at = end
                break


def mixed(s: str) -> bool:
    """Whether a text's signs are mixed enough to be a secret: bits a sign, and letters with digits or both cases."""
    n = len(s)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    return bits >= ENTROPY and (any(c.isdigit() for c in s) + any(c.islower() for c in s) + any(c.isupper() for c in s)) >= 2


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Key blocks up to their last line; where that is missing before the next block begins, what looks like a key's body."""
    begins = list(KEY_BEGIN.finditer(text)) if "-----BEGIN " in text else []
    ends = [m.span() for m in KEY_END.finditer(text)] if begins else []
    starts = [a for a, _ in ends]
    for m, following in zip(begins, [*(b.start() for b in begins[1:]), len(text)]):
        i = bisect_left(starts, m.end())
        if i < len(ends) and starts[i] < following:
            yield m.start(), ends[i][1]
        else:
            yield m.start(), KEY_BODY.match(text, m.end()).end()


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: the signs before an @ back to the last match, if a domain follows."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_PART:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def score(kind: str, text: str, start: int, end: int) -> float:
    own, for_it, against = SCORES[kind]
    near = text[max(0, start - CONTEXT) : start] + "\n" + text[end : end + CONTEXT]
    return round(min(1.0, max(0.0, own + 0.3 * bool(for_it.search(near)) - 0.3 * bool(against.search(near)))), 2)


def spans(text: str, least: float = 0.7) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) by start, then kind."""
    found = [(a, b, "email") for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() <= 2 * 19 and 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
                found.append((*m.span(), "card"))
        for m in PHONE.finditer(text):
            if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
                found.append((*m.span(), "phone"))
        base = sorted((a, b) for a, b, _ in found)
        starts, ends = [a for a, _ in base], list(accumulate((b for _, b in base), max))
        free = lambda m: not (i := bisect_left(starts, m.end())) or ends[i - 1] <= m.start()
        found += [(a, b, "iban") for a, b in ibans(text)]
        found += [(*m.span(), k) for k, p in (("national_id", NATIONAL_ID), ("local_phone", LOCAL_PHONE)) for m in p.finditer(text) if free(m)]
    found += [(*m.span(1), "secret") for m in SECRET.finditer(text) if mixed(m[1])]
    found += [(a, b, "secret") for a, b in key_blocks(text)]
    scored = [(a, b, k, score(k, text, a, b)) for a, b, k in found]
    return sorted((s for s in scored if s[2] in KINDS[:4] or s[3] >= least), key=lambda s: (s[0], KINDS.index(s[2])))


def find(docs: DataFrame, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): for each row its spans, as structs of kind, start, end and score."""
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e, "score": x} for s, e, k, x in spans(t or "", least)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def redacted(text: str | None, found: list) -> str | None:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    if text is None:
        return None
    out, at = [], 0
    for s in found:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
            at = s["end"]
    return "".join(out) + text[at:]
