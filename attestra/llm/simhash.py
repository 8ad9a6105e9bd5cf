"""SimHash near-duplicates, with tables of distances to reference fingerprints.

1. Each text gets a 64-bit fingerprint from the XXH64 hashes of its word shingles.
2. Texts with one fingerprint form a class; from here on only distinct fingerprints are handled.
3. The pivot table holds the Hamming distance of every fingerprint to ``pivots`` reference fingerprints: its coordinates.
4. Fingerprints that differ in at most ``max_bits`` of 64 bits agree in all bits of some of the segments that the 64
   bits are cut into. Pivots choose the candidates among those: the first ``bands`` coordinates, cut into bands of
   ``max_bits + 1``, are part of the key, and each fingerprint also looks into the neighbouring bands that a coordinate
   ``max_bits`` away may lie in. That is exact, as no coordinate of a link differs by more than ``max_bits``.
5. Candidates go when any other coordinate differs by more than ``max_bits``; the survivors' bits are compared.
6. A key that over ``group_rows`` fingerprints share is not paired. Its members, and those that look into it, meet at
   fingerprints one bit away: with ``max_bits`` 2, two of them are at most two bits apart if and only if they have such a
   neighbour (or each other) in common, so each is linked to the least around that neighbour; with ``max_bits`` 1 each is
   linked to those that it turns into by one bit. That is exact and linear in the rows.
7. Connected components over the links give each class its group.

Defined results: a null or empty text has fingerprint zero and links like any other; rows that repeat are in one
class; a group's id is its smallest doc_id, null ids left out (null if it has no other); other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written
from .components import connected_components
from .skew import join_hot, one_of_each
from .text import text_key


def fingerprint(text: str | None, size: int = 3) -> int:
    """A text's fingerprint, unsigned: a bit is set if it is in over half of the shingles' hashes."""
    import xxhash

    words = (text or "").encode().lower().split()  # both know A-Z and ASCII white space only
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*(words[i:] for i in range(size))))) or [b" ".join(words)]
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(shingles), 65_536):
        part = shingles[i : i + 65_536]
        h = np.fromiter((digest(s, 42) for s in part), dtype="<u8", count=len(part))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp) by row; fp holds the fingerprint's bits as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["doc_id", "text_key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def reference_fingerprints(n: int, seed: int = 20_240) -> list[int]:
    """Fixed pseudo-random fingerprints, as signed longs."""
    r = random.Random(seed)
    return [r.getrandbits(64) - (1 << 63) for _ in range(n)]


def pivot_table(fps: DataFrame, pivots: int) -> DataFrame:
    """``fps(fp)`` with d: its distances to the reference fingerprints."""
    return fps.withColumn("d", F.array(*(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in reference_fingerprints(pivots))))


def segment_keys(fp, max_bits: int, segments: int) -> list:
    """The values of every choice of ``segments - max_bits`` segments, each with the choice's number."""
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    masks = [sum(1 << b for b in range(i, j)) for i, j in zip(cuts, cuts[1:])]
    keys = []
    for k, chosen in enumerate(itertools.combinations(masks, segments - max_bits)):
        mask = sum(chosen)
        keys.append(F.struct(F.lit(k).cast("byte").alias("k"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("v")))
    return keys


def links(fps: DataFrame, max_bits: int = 2, pivots: int = 16, bands: int = 2, segments: int = 4, group_rows: int = 256) -> DataFrame:
    """(a, b): links between distinct fingerprints of ``fps(fp)``; each linked pair is joined by a path of these."""
    if not 0 < max_bits <= 2 < segments or not 0 <= bands <= pivots:
        raise ValueError("max_bits is 1 or 2, there are at least 3 segments, and no more bands than pivots")
    keyed = fps.select("fp", F.explode(F.array(*segment_keys(F.col("fp"), max_bits, segments))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    keyed = written(pivot_table(keyed.join(shared, "key").select("key", "fp"), pivots), "simhash-segments")
    band = lambda c: F.floor(c / (max_bits + 1)).cast("byte")
    own = [band(F.col("d")[i]).alias(f"b{i}") for i in range(bands)]
    home = keyed.select("key", *own, F.col("fp").alias("a"), F.col("d").alias("da"))
    look = keyed.select("key", F.col("fp").alias("b"), F.col("d").alias("db"))
    for i in range(bands):
        d = F.col("db")[i]
        look = look.withColumn(f"b{i}", F.explode(F.array_distinct(F.array(band(d - max_bits), band(d), band(d + max_bits)))))
    on = ["key", *(f"b{i}" for i in range(bands))]
    crowded = written(home.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select(*on), "simhash-crowds")
    near = reduce(lambda p, q: p & q, (F.abs(F.col("da")[i] - F.col("db")[i]) <= max_bits for i in range(bands, pivots)), F.lit(True))
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = home.join(crowded, on, "left_anti").join(look, on).where((F.col("a") < F.col("b")) & near & exact).select("a", "b")
    large = home.join(crowded, on, "left_semi").select(F.col("a").alias("fp")).union(look.join(crowded, on, "left_semi").select("b")).distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(64)))
    around = large.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("z"))
    if max_bits == 1:
        stars = around.where("fp < z").join(large.select(F.col("fp").alias("z")), "z").select(F.col("fp").alias("a"), F.col("z").alias("b"))
    else:
        hubs = around.groupBy("z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
        stars = around.join(hubs, "z").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, max_bits: int = 2, pivots: int = 16, bands: int = 2, segments: int = 4, group_rows: int = 256) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id): a row for each document, with its group's root and smallest doc_id."""
    rows = written(fingerprints(docs, size), "simhash-fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    roots = connected_components(links(classes.select("fp"), max_bits, pivots, bands, segments, group_rows)).withColumnRenamed("node", "fp")
    linked = roots.join(classes, "fp")
    linked = linked.join(linked.groupBy("root").agg(F.min("least").alias("group_least")), "root").select("fp", "root", "group_least")
    component = F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("group_least"))
    classes = written(classes.join(linked, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), component.alias("component_id")), "simhash-groups")
    return join_hot(rows, classes, "fp", "n").select("doc_id", "text_key", "fp", "root", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id (null ids last), then the smallest text key."""
    return one_of_each(docs, near_duplicates(docs))
