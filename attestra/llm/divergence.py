"""Source divergence audit: how far apart the sources of a language are, and which terms a source uses more than its language does.

1. Tasks count terms and the documents that hold them by language and source, in tables of bounded size, so that only sums are shuffled;
   terms in at least ``least_docs`` documents of their language stay.
2. The terms of a language are dealt by hash to slices of about ``slice_terms``, and numbered within a slice in the order of their
   UTF-8 bytes. A vector is what one source has in one slice: numbers and counts, packed and compressed.
3. Systolic rotation: the sources of a language are dealt to seats. In every slice a seat's vectors stay resident in one partition,
   and peers' vectors come to it in the rounds of a tournament (the circle method, in which all seats meet once, each as often
   host as guest). One shuffle brings guests in order of rounds, so a task holds its residents and one guest at a time, and
   a meeting gives both directions. The language's own vector comes first, and a heap keeps each resident's largest excesses over it.
4. Slices are added up, and ranks are taken by source.

A share is 1 + floor(scale * (count + 5) / (all counts + 5 * terms)); all arithmetic is on integers.

Defined results: a null text, lang or source counts as empty; a source without terms has the shares of no counts; a language without
kept terms has distances of 0 and no terms; rows that repeat, or share an id, are documents of their own; equal values are ordered by
UTF-8 bytes; other columns are never looked at; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, written

SCALE = 1_000_000_000
#: Bytes of UTF-8 texts: A to Z in lower case; a to z and all beyond ASCII as they are; the rest as blanks.
BYTES = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256)).lower()
#: Parts into which a language's terms are cut for a join by language.
SALTS = 64
#: Terms that a task's tables hold before they are given out.
KEPT_TERMS = 500_000


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(BYTES).split()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): partial counts of each task; a row without a term stands for a source that occurs."""
    ship(docs.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (g, s), (n, held) in counts.items():
                terms = [None, *(t.decode() for t in n)]
                cols = [pa.array([x] * len(terms), pa.string()) for x in (g, s)]
                cols += [pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(held.__getitem__, n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
            counts.clear()

        for b in batches:
            for g, s, t in zip(*(c.to_pylist() for c in b.columns)):
                n, held = counts.setdefault((g, s), (Counter(), Counter()))
                words = terms_of(t)
                n.update(words)
                held.update(set(words))
            if sum(len(n) for n, _ in counts.values()) > KEPT_TERMS:
                yield from out()
        yield from out()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(counts: DataFrame, least_docs: int = 30) -> DataFrame:
    """(lang, source, term, n, lang_n): counts of the terms that stay, and the rows without a term.

    Sums by source and by language come from one shuffle by language and term; a term has at most a row for each task and source.
    """
    whole = Window.partitionBy("lang", "term")
    cells = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    cells = cells.withColumns({"lang_n": F.sum("n").over(whole), "lang_docs": F.sum("docs").over(whole)})
    return cells.where((F.col("lang_docs") >= least_docs) | F.col("term").isNull()).select("lang", "source", "term", "n", "lang_n")


def pack(at: list[int], n: list[int]) -> bytes:
    """A vector's ascending numbers as steps, and its counts, compressed."""
    steps = np.diff(np.asarray(at, dtype="<i4"), prepend=np.int32(0)).astype("<i4")
    return zlib.compress(steps.tobytes() + np.asarray(n, dtype="<i8").tobytes(), 1)


def unpack(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data) if data else b""
    k = len(raw) // 12
    return np.cumsum(np.frombuffer(raw[: 4 * k], "<i4")), np.frombuffer(raw[4 * k :], "<i8")


def shares(n: np.ndarray, total: int, scale_digits: int = 9) -> np.ndarray:
    """1 + floor(10 ** scale_digits * (n + 5) / total) by long division, three digits at a time, so that 64 bits hold every step."""
    rest, out = n.astype(np.int64) + 5, np.zeros(len(n), dtype=np.int64)
    for _ in range(scale_digits // 3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _host_rounds(seat, seats):
    """(host, round) of each meeting to which a seat goes as a guest: the circle method on an even number of seats, with a seat left empty if need be."""
    m = seats + F.pmod(seats, F.lit(2))

    def meeting(r):
        ring = m - 1
        other = F.pmod(r - seat, ring)
        # The last seat stays; it meets the seat that would meet itself.
        alone = F.pmod(r * F.floor(m / 2), ring)
        other = F.when(seat == ring, alone).when(other == seat, ring).otherwise(other)
        return F.struct(other.cast("int").alias("host"), r.cast("int").alias("round"))

    meetings = F.transform(F.sequence(F.lit(1), F.greatest(m - 1, F.lit(1)).cast("int")), meeting)
    guest = lambda x: (x["host"] < seats) & (x["host"] != seat) & ((x["host"] < seat) == (F.pmod(x["host"] + seat, F.lit(2)) == 0))
    return F.when(seats > 1, F.filter(meetings, guest)).otherwise(F.slice(meetings, 1, 0))


def _packed(rows: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(keys, data): the vector of each key's rows, of which a slice bounds the number."""
    vector = F.pandas_udf(lambda x: x.map(lambda v: pack([i["at"] for i in v], [i["n"] for i in v])), "binary")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", F.col(n).alias("n")))).alias("v")).select(*keys, vector("v").alias("data"))


def _met(rows: DataFrame, top: int) -> DataFrame:
    """(lang, source, slice, other, at, value): distances within a slice of each pair that meets, both ways, and the largest excesses of each resident."""
    names = ["lang", "source", "slice", "other", "at", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, whole, residents = None, None, []
        for b in batches:
            found: list[tuple] = []
            for lang, cut, host, round_, source, total, size, data in zip(*(c.to_pylist() for c in b.columns)):
                if (lang, cut, host) != place:
                    place, whole, residents = (lang, cut, host), None, []
                at, n = unpack(data)
                p = np.zeros(size, dtype=np.int64)
                p[at] = n
                p = shares(p, total)
                if round_ < 0:
                    whole = p
                    continue
                for peer, q in residents:
                    value = int(np.abs(p - q).sum())
                    found += [(lang, source, cut, peer, None, value), (lang, peer, cut, source, None, value)]
                if round_ == 0:
                    residents.append((source, p))
                    over = p[at] - whole[at]
                    best = heapq.nsmallest(top, zip((-over[over > 0]).tolist(), at[over > 0].tolist()))
                    found += [(lang, source, cut, None, i, -v) for v, i in best]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64())
            cols = list(zip(*found)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return rows.mapInArrow(run, "lang string, source string, slice int, other string, at int, value long")


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, slice_terms: int = 1 << 14, seat_groups: int = 8) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of ``docs(lang, source, text)``: part ``pair`` has its distance to each
    other source of its language, part ``term`` its ``top`` terms by excess over the language."""
    ship(docs.sparkSession)
    cells = written(kept_terms(term_counts(docs), least_docs), "term-cells")
    terms = cells.where("term is not null")
    sources = cells.groupBy("lang", "source").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    langs = sources.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("n").alias("lang_total"))
    words = terms.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    langs = langs.join(words.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    part = lambda c, size: F.greatest(F.ceil(F.col(c) / size), F.lit(1)).cast("int")
    langs = langs.select("lang", "lang_total", "v", part("sources", seat_groups).alias("seats"), part("v", slice_terms).alias("slices"))

    # A slice's terms are a bounded number, so a task may number them.
    cut = F.pmod(F.xxhash64("term"), F.col("slices")).cast("int")
    # One language may have nearly all terms, so these meet its number of slices in several tasks.
    salted = langs.select("lang", "slices", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    numbered = words.withColumn("salt", F.pmod(F.hash("term"), F.lit(SALTS))).join(salted, ["lang", "salt"]).select("lang", "term", "lang_n", cut.alias("slice"))
    numbered = written(numbered.withColumn("at", F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1), "terms")
    sizes = numbered.groupBy("lang", "slice").agg(F.count("*").cast("int").alias("size"))

    # Every source has a vector in every slice of its language, if an empty one; so has the language as a whole.
    seats = sources.join(langs, "lang").withColumn("seat", F.pmod(F.xxhash64("source"), F.col("seats")).cast("int"))
    seats = seats.select("lang", "source", (F.col("n") + 5 * F.col("v")).alias("total"), "seat", "seats", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    vectors = seats.join(_packed(terms.join(numbered.select("lang", "term", "slice", "at"), ["lang", "term"]), ["lang", "slice", "source"], "n"), ["lang", "slice", "source"], "left")
    whole = langs.select("lang", F.lit("").alias("source"), (F.col("lang_total") + 5 * F.col("v")).alias("total"), "seats", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    whole = whole.join(_packed(numbered, ["lang", "slice"], "lang_n"), ["lang", "slice"], "left").withColumn("host", F.explode(F.sequence(F.lit(0), F.col("seats") - 1)))
    home = F.array(F.struct(F.col("seat").alias("host"), F.lit(0).alias("round")))
    moved = vectors.select("lang", "slice", F.inline(F.concat(home, _host_rounds(F.col("seat"), F.col("seats")))), "source", "total", "data")
    moved = moved.unionByName(whole.select("lang", "slice", "host", F.lit(-1).alias("round"), "source", "total", "data"))
    moved = moved.join(sizes, ["lang", "slice"], "left").select("lang", "slice", "host", "round", "source", "total", F.coalesce("size", F.lit(0)).alias("size"), "data")
    met = _met(moved.repartition("lang", "slice", "host").sortWithinPartitions("lang", "slice", "host", "round", "source"), top)
    met = written(met, "meetings")

    by = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("value"), "item")
    pairs = met.where("other is not null").groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by("lang", "source")).alias("rank"))
    over = met.where("at is not null").join(numbered.select("lang", "slice", "at", F.col("term").alias("item")), ["lang", "slice", "at"])
    over = over.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(by("lang", "source")).alias("rank"))
    return pairs.unionByName(over.where(F.col("rank") <= top))
