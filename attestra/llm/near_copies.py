"""Near copies by word shingles: SimHash fingerprints in a wide radius, candidates by bands of minima, a check of the sets.

Texts are near copies when the Jaccard index of their sets of ``size``-word shingles is at least ``similarity``. At 0.8
their 64-bit SimHash fingerprints lie about 10 bits apart, some over 16: segments of 64 bits by the pigeonhole principle
would be under four bits wide and pair nearly everything. So pairs are formed otherwise:

1. Texts with one set of shingles form a class, known by the set's XXH64 hash; from here on only classes are handled.
2. Each class has ``BANDS`` keys, each made of ``ROWS`` minima of its shingles' hashes; classes with a key in common are
   candidates. A pair of similarity 0.8 has none with probability 0.0023, one of 0.9 with 3e-7.
3. Candidates whose fingerprints differ in more than ``max_bits`` bits go.
4. The rest are compared by their sets of shingles, as 32 bits of each hash: that halves the disk, and two sets of a
   thousand shingles have a false match with probability 0.0002.
5. Connected components over the links give each class its group.

A key that over ``group_rows`` classes share is a crowd, in which pairs would grow with its square. There each class is compared with the
crowd's hub, the class whose keys most others share, and with the ``NEXT`` before it, in an order by the next two keys, so that
classes that agree in several keys stand together. That is linear and joins most of what belongs together. Then the classes of a crowd that are
still in different groups are compared, each with each, so no link is lost: those within a group could change nothing. Crowds are cut into
blocks, and a task compares two blocks of ``block`` classes at a time by an index of their shingles, so its memory is bounded and a crowd is
spread over all tasks; but where a crowd stays in many groups, the work grows with its square, as all pairs of it must be looked at.

Defined results: null and empty texts are one class; a text with fewer words than ``size`` is one shingle; rows that repeat
are in one class; ties go to the smaller doc_id; other columns are ignored or kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt, forget, ship, written
from .components import connected_components
from .skew import join_hot, one_of_each
from .text import text_key

BANDS, ROWS, NEXT = 20, 6, 8
_R = np.random.RandomState(20_240)
_odd = lambda n: _R.randint(0, 1 << 62, n).astype(np.uint64) * np.uint64(4) + np.uint64(1)
FACTORS, MASKS, MIX, SALT = _odd(BANDS * ROWS), _odd(BANDS * ROWS), _odd(ROWS), _odd(BANDS)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    import xxhash

    words = (text or "").encode().lower().split()  # both know A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    shingles = set(map(b" ".join, zip(*(words[i:] for i in range(size))))) or {b" ".join(words)}
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, 42) for s in shingles), dtype="<u8", count=len(shingles)))


def sketch(h: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Class, fingerprint and band keys of a set of shingles' hashes, as signed longs."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    bits, least = np.zeros(64, dtype=np.int64), np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for i in range(0, len(h), 4096):
        part = h[i : i + 4096]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        mixed = (part[:, None] ^ MASKS) * FACTORS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    fp = int(np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0])
    keys = ((least ^ (least >> np.uint64(29))).reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64) * FACTORS[:BANDS] + SALT
    return signed(xxhash.xxh64_intdigest(h.tobytes(), 7)), signed(fp), keys.view(np.int64)


def sketches(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, text_key, class, fp, keys, shingles) by row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sets = [shingle_set(t, size) for t in b.column(2).to_pylist()]
                made = [sketch(h) for h in sets]
                col = lambda i: pa.array([m[i] for m in made], pa.int64())
                lists = lambda xs: pa.array(xs, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), col(0), col(1), lists([m[2] for m in made]), pa.array([np.unique(h.astype(np.uint32)).view(np.int32) for h in sets], pa.list_(pa.int32()))], names=["doc_id", "text_key", "class", "fp", "keys", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, class long, fp long, keys array<long>, shingles array<int>")


def shared_keys(keyed: DataFrame) -> DataFrame:
    """Rows of keys that several classes have, with ``n``: how many."""
    counted = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(counted, "key")


def with_crowds(keyed: DataFrame, group_rows: int) -> DataFrame:
    """``keyed(class, fp, key, then, n)`` with the key's hub and whether it is a crowd.

    The hub is the class whose keys are shared most, of equals the smallest.
    """
    score = keyed.where(F.col("n") > group_rows).groupBy("class").agg(F.sum("n").alias("score"))
    best = F.max_by(F.struct("class", "fp"), F.struct("score", (-F.col("class").cast("decimal(20,0)")).alias("first"))).alias("hub")
    hubs = keyed.where(F.col("n") > group_rows).join(score, "class").groupBy("key").agg(best)
    return keyed.join(hubs, "key", "left").select("class", "fp", "key", "then", "hub", (F.col("n") > group_rows).alias("crowd"))


def candidates(keyed: DataFrame, max_bits: int) -> DataFrame:
    """(a, b), a < b: classes that share a key and whose fingerprints are near; in crowds each with the hub and those before it."""
    x = keyed.where("not crowd").select("key", F.col("class").alias("a"), F.col("fp").alias("fa"))
    near = lambda p, q: F.bit_count(p.bitwiseXOR(q)) <= max_bits
    y = x.select("key", F.col("a").alias("b"), F.col("fa").alias("fb"))
    pairs = x.join(y, "key").where((F.col("a") < F.col("b")) & near(F.col("fa"), F.col("fb"))).select("a", "b")
    order = Window.partitionBy("key").orderBy("then", "class")
    ahead = F.array(F.col("hub"), *(F.lag(F.struct("class", "fp"), i).over(order) for i in range(1, NEXT + 1)))
    stars = keyed.where("crowd").withColumn("ahead", ahead).select("class", "fp", F.explode(F.filter("ahead", lambda o: o.isNotNull())).alias("o"))
    stars = stars.where((F.col("o.class") != F.col("class")) & near(F.col("fp"), F.col("o.fp"))).select(F.least("class", "o.class").alias("a"), F.greatest("class", "o.class").alias("b"))
    return pairs.union(stars).distinct()


def links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets of shingles, ``sets(class, shingles)``, are similar enough. Sets grow with the corpus, so they are never broadcast."""
    one = lambda c, s: sets.select(F.col("class").alias(c), F.col("shingles").alias(s)).hint("merge")
    held = pairs.join(one("a", "sa"), "a").join(one("b", "sb"), "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return held.where(F.col("both") >= similarity * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def crowd_blocks(crowd: DataFrame, block: int) -> DataFrame:
    """``crowd(class, fp, key, root)`` of keys with several roots, in pairs of blocks (key, i, j): each class is in a pair with every block of its key."""
    mixed = crowd.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("lo < hi").select("key", "blocks")
    own = crowd.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    rows = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("class", "fp", "key", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def block_links(t: pa.Table, similarity: float, max_bits: int) -> pa.Table:
    """(a, b): roots that links join between two blocks of one key, or within one; a pair that shares an earlier key is compared there."""
    t = t.combine_chunks()
    col = lambda n: t.column(n).to_numpy()
    ends = lambda c: (c.offsets.to_numpy(), c.values.to_numpy())
    cls, root, fp, i, j = col("class"), col("root"), col("fp").view(np.uint64), col("i")[0], col("j")[0]
    at, flat = ends(t.column("shingles").chunk(0))
    keys = t.column("keys").chunk(0).values.to_numpy()[t.column("keys").chunk(0).offsets.to_numpy()[0] :].reshape(-1, BANDS)
    place, n = int(np.argmax(keys[0] == col("key")[0])), np.diff(at)
    left, right = np.flatnonzero(col("own") == i), np.flatnonzero(col("own") == j)
    if len(left) == 0 or len(right) == 0:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    values = np.concatenate([flat[at[r] : at[r + 1]] for r in right])
    owner = np.repeat(np.arange(len(right)), n[right])
    order = np.argsort(values, kind="stable")
    values, owner, out = values[order], owner[order], set()
    for x in left:
        near = (root[right] != root[x]) & (np.bitwise_count(fp[right] ^ fp[x]) <= max_bits)
        near &= np.minimum(n[right], n[x]) >= similarity * np.maximum(n[right], n[x])
        near &= ~(keys[right, :place] == keys[x, :place]).any(axis=1)
        if i == j:
            near &= cls[right] > cls[x]
        if not near.any():
            continue
        own = flat[at[x] : at[x + 1]]
        lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        hits = hi - lo
        got = np.repeat(lo - np.concatenate([[0], np.cumsum(hits)[:-1]]), hits) + np.arange(hits.sum()) if len(own) else np.zeros(0, dtype=np.int64)
        both = np.bincount(owner[got], minlength=len(right))
        like = near & (both >= similarity * (n[right] + n[x] - both))
        out |= {(int(min(root[x], r)), int(max(root[x], r))) for r in root[right[like]]}
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def crowd_links(shared: DataFrame, rows: DataFrame, roots: DataFrame, similarity: float, max_bits: int, group_rows: int, block: int) -> DataFrame:
    """(a, b): roots of ``roots(class, root)`` that links within crowds join; of ``shared(class, fp, key, n)`` and ``rows(class, keys, shingles)``."""
    crowd = shared.where(F.col("n") > group_rows).select("class", "fp", "key").join(roots.hint("merge"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    placed = written(crowd_blocks(crowd, block), "near-copies-blocks")
    sets = rows.select("class", "keys", "shingles").join(placed.select("class").distinct().hint("merge"), "class", "left_semi").dropDuplicates(["class"])
    by = ["key", "i", "j"]
    # As many tasks as shuffle partitions: the bytes of two blocks do not tell what comparing them costs.
    met = dealt(placed.join(sets.hint("merge"), "class"), by)
    return met.groupBy(*by).applyInArrow(lambda t: block_links(t, similarity, max_bits), "a long, b long").distinct()


def groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, max_bits: int = 20, group_rows: int = 64, block: int = 512) -> DataFrame:
    """(doc_id, text_key, class, root): a row for each document, with its group's root."""
    rows = written(sketches(docs, size), "near-copies-sketches")
    classes = written(rows.groupBy("class").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.count("*").alias("n")), "near-copies-classes")
    then = F.struct(*(F.element_at("keys", (F.col("at") + i) % BANDS + 1).alias(f"k{i}") for i in (1, 2)))
    keyed = classes.select("class", "fp", "keys", F.posexplode("keys").alias("at", "key")).select("class", "fp", "key", then.alias("then"))
    shared = written(shared_keys(keyed), "near-copies-shared")
    pairs = written(candidates(with_crowds(shared, group_rows), max_bits), "near-copies-pairs")
    used = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().hint("merge")
    # One row of each class before the join: copies of one text are put together where they are read.
    sets = written(rows.select("class", "shingles").dropDuplicates(["class"]).join(used, "class", "left_semi"), "near-copies-sets")
    roots = connected_components(links(pairs, sets, similarity)).withColumnRenamed("node", "class")
    # What links within crowds join as well: the roots of groups are joined by their smallest.
    joined = connected_components(written(crowd_links(shared, rows, roots, similarity, max_bits, group_rows, block), "near-copies-crowds"))
    roots = roots.unionByName(joined.select(F.col("node").alias("class"), F.col("node").alias("root")).join(roots.select("class").hint("merge"), "class", "left_anti"))
    roots = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("least")).hint("merge"), "root", "left").select("class", F.coalesce("least", "root").alias("root"))
    found = written(classes.select("class", "n").join(roots, "class", "left").select("class", "n", F.coalesce("root", "class").alias("root")), "near-copies-groups")
    forget(shared, pairs, sets)
    return join_hot(rows.select("doc_id", "text_key", "class"), found, "class", "n").select("doc_id", "text_key", "class", "root")


def deduplicated(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id (null ids last), then the smallest text key."""
    return one_of_each(docs, groups(docs, size, similarity))
