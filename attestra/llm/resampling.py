"""Target-distribution importance resampling by an external sort-count of hashed n-gram buckets.

1. Each task cuts texts into words, and gives every run of one to ``longest`` words a bucket: the CRC-32 of its UTF-8 bytes modulo
   ``buckets``. The CRC of a longer run follows from those of its words, as appending bytes is linear in the CRC, so each distinct
   word is hashed once. What it writes is blocks: a packed stream of uint16 buckets, the offset at which each document begins in
   it, and the stream's sorted runs (bucket and length).
2. Counts are the sums of the runs, of which a block has at most one a bucket; streams take no part.
3. Blocks are read again: a bucket's gain is looked up for the whole stream, and ``np.add.reduceat`` adds gains up by document.
4. Scores are weights plus Gumbel noise from a hash of the id; the largest ``percent`` of documents with enough words are drawn.
   Ranks come from a range partitioning by score: a row's place in its partition, plus the rows of the partitions before it.

Defined results: a null or empty text has no features and weight 0; a null doc_id hashes as an empty one and comes after all others
among equal scores; rows that repeat are documents of their own, equal ones in any order; other columns are never looked at; an empty
target gives every bucket its gain against no counts; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, ship, written

BUCKETS, LONGEST = 10_000, 3
#: Bytes of UTF-8 texts: A to Z in lower case; digits, a to z and all beyond ASCII as they are; the rest as blanks.
BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256)).lower()
#: Features of a block; words of at most so many bytes go through tables, of which there is one a length.
BLOCK, SHORT = 1 << 20, 48
KEPT_WORDS = 500_000


def _shift_tables(most: int) -> np.ndarray:
    """(length, byte of the CRC, its value): what a byte of a CRC becomes when ``length`` bytes follow; four of them, by exclusive or, give the CRC."""
    one = np.array([[zlib.crc32(b"\0", v << 8 * k) ^ zlib.crc32(b"\0") for v in range(256)] for k in range(4)], dtype=np.uint32)
    tables = [np.array([[v << 8 * k for v in range(256)] for k in range(4)], dtype=np.uint32)]
    for _ in range(most):
        c = tables[-1]
        tables.append(one[0][c & 255] ^ one[1][c >> 8 & 255] ^ one[2][c >> 16 & 255] ^ one[3][c >> 24])
    return np.stack(tables)


class Hasher:
    """Buckets of all runs of words; ``of(words)`` has those of one word first, then of two, and so on."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest = buckets, longest
        self.tables = _shift_tables(SHORT + 1).reshape(-1)
        self._empty()

    def _empty(self) -> None:
        self.at: dict[bytes, int] = {}
        self.known = np.zeros((0, 3), dtype=np.uint32)

    def _learn(self, words: list[bytes]) -> None:
        """Keeps the CRC of a word, that of a blank and the word, and the bytes of both (0: too long for the tables)."""
        rows = [(zlib.crc32(w), zlib.crc32(b" " + w), len(w) + 1 if len(w) <= SHORT else 0) for w in words]
        n, more = len(self.at), len(words)
        if n + more > len(self.known):
            grown = np.zeros((2 * (n + more), 3), dtype=np.uint32)
            grown[:n] = self.known[:n]
            self.known = grown
        self.known[n : n + more] = np.array(rows, dtype=np.uint32)
        self.at.update(zip(words, range(n, n + more)))

    def crcs(self, words: list[bytes]) -> list[np.ndarray]:
        """CRCs of the runs of each length."""
        if len(self.at) >= KEPT_WORDS:
            self._empty()
        if new := [w for w in dict.fromkeys(words) if w not in self.at]:
            self._learn(new)
        rows = self.known[np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words))]
        alone, after, size = rows[:, 0], rows[:, 1], rows[:, 2].astype(np.int64)
        out = [alone]
        for k in range(1, self.longest):
            c, base = out[-1][:-1], size[k:] << 10
            t = self.tables
            c = t[base + (c & 255)] ^ t[base + 256 + (c >> 8 & 255)] ^ t[base + 512 + (c >> 16 & 255)] ^ t[base + 768 + (c >> 24)] ^ after[k:]
            for i in np.flatnonzero(size[k:] == 0).tolist():
                c[i] = zlib.crc32(b" " + words[i + k], int(out[-1][i]))
            out.append(c)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, dtype=np.uint16)
        return (np.concatenate(self.crcs(words)) % np.uint32(self.buckets)).astype(np.uint16)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(BYTES).split()


def runs(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stream's buckets in order and how often each stands in it: sorted and run-length encoded."""
    ordered = np.sort(stream, kind="stable")
    starts = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] + 1)) if len(ordered) else np.zeros(0, dtype=np.int64)
    return ordered[starts], np.diff(starts, append=len(ordered)).astype(np.uint32)


def bucket_streams(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ids, n_words, offsets, stream, run_buckets, run_counts): blocks of about ``block`` features; one document is never cut."""
    ship(docs.sparkSession)
    if buckets > 1 << 16:
        raise ValueError("buckets must fit into 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(buckets, longest)
        ids, n_words, parts, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            stream = np.concatenate(parts)
            offsets = np.cumsum([0] + [len(p) for p in parts[:-1]])
            b, n = runs(stream)
            cols = [pa.array([c], pa.list_(pa.int64())) for c in (ids, n_words, offsets.tolist())]
            cols += [pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in ((stream, "<u2"), (b, "<u2"), (n, "<u4"))]
            return pa.RecordBatch.from_arrays(cols, names=["ids", "n_words", "offsets", "stream", "run_buckets", "run_counts"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                ids.append(doc_id)
                n_words.append(len(words))
                parts.append(hasher.of(words))
                size += len(parts[-1])
                if size >= block:
                    yield out()
                    ids, n_words, parts, size = [], [], [], 0
        if ids:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "ids array<long>, n_words array<long>, offsets array<long>, stream binary, run_buckets binary, run_counts binary")


def bucket_counts(streams: DataFrame) -> DataFrame:
    """(bucket, n) from the blocks' runs, added up within a task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for b in batches:
            for at, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u4")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return streams.select("run_buckets", "run_counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    """Counts by bucket: at most ``buckets`` rows reach the driver, whatever the input."""
    got = counts.toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: a thousand times the log of its smoothed share in the target over that in the source, rounded down."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id: int | None, seed: int = 42) -> int:
    """A thousand times a Gumbel variate by the hash of an id, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(streams: DataFrame, gain: np.ndarray, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score): gains gathered along the streams and added up by document, and noise."""
    ship(streams.sparkSession)
    shared = streams.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            for ids, n_words, offsets, stream in zip(*(c.to_pylist() for c in b.columns)):
                found, at = g[np.frombuffer(stream, "<u2")], np.array(offsets, dtype=np.int64)
                n, sums = np.diff(at, append=len(found)), np.zeros(len(at), dtype=np.int64)
                if len(found):  # reduceat gives the element itself for an empty range
                    sums[n > 0] = np.add.reduceat(found, at[n > 0])
                score = sums + np.array([noise(i, seed) for i in ids], dtype=np.int64)
                cols = [pa.array(ids, pa.int64()), pa.array(n), pa.array(n_words, pa.int64()), pa.array(sums), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_features", "n_words", "weight", "score"])

    return streams.select("ids", "n_words", "offsets", "stream").mapInArrow(run, "doc_id long, n_features long, n_words long, weight long, score long")


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with their ``rank`` (1, 2, ...) in an order, with no task that holds them all: a range partitioning, and how many rows lie in the partitions before."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "ranked").withColumn("_task", F.shiftright("_at", 33))
    before, starts = 0, []
    for task, n in sorted(tuple(r) for r in placed.groupBy("_task").count().collect()):
        starts.append((task, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(starts, "_task long, _before long"))  # a row for each partition
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(starts, "_task").withColumn("rank", rank).drop("_at", "_task", "_before")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank) of every row of ``docs(doc_id, text)``, drawn to be like ``target(text)``; rows that aren't drawn have no rank."""
    streams = written(bucket_streams(docs, buckets, longest), "bucket-streams")
    wanted = bucket_streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, longest)
    gain = gains(_dense(bucket_counts(streams), buckets), _dense(bucket_counts(wanted), buckets))
    rows = written(scores(streams, gain, seed), "scores")
    forget(streams)
    fits = F.col("n_words") >= least_words
    drawn = rows.where(fits).count() * percent // 100
    rows = ranked(rows, fits.desc(), F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
