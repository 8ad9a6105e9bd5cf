"""Line dedup: documents keep a line that many of them hold only in the last one.

1. Each line of at least ``shortest`` code points gives a 128-bit hash of its key, with its document and place.
2. Rows are range-partitioned by hash and document and sorted within by hash, document (largest first) and place.
   As the document is part of the range, the rows of one very common line are spread over many partitions.
3. A task streams its rows: a key's first document keeps its lines, those of the others go if the key has at
   least ``least_docs`` documents. A key that may go on in the partition before or after is left open, and
   the few such keys (two a partition at most) are counted together and settled by a join.
4. What goes is gathered by document into a compressed keep bitmap: a bit for each line, zlib on top. Texts take no part
   until bitmaps are applied.

Defined results: a null or empty text is one empty line; rows with the same doc_id and text count as one document for
least_docs, and so do rows with one id; a null doc_id comes before all others; other columns pass unseen, whatever their names;
a key's lines in its last document all stay; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written
from .skew import unused
from .text import text_key

BLANKS = " \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)


def line_key(line: str) -> str:
    """The line without blanks at its ends, A to Z in lower case."""
    return line.strip(BLANKS).encode().lower().decode()


def long_lines(docs: DataFrame, shortest: int = 40) -> DataFrame:
    """(hi, lo, doc, text_key, at) of every line whose key has at least ``shortest`` code points; a null id is the least long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in batches:
            hashes, docs_, keys, ats = [], [], [], []
            for d, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for at, line in enumerate((t or "").split("\n")):
                    if len(line) >= shortest and len(s := line.strip(BLANKS)) >= shortest:
                        hashes.append(digest(s.encode().lower()))
                        docs_.append(d)
                        keys.append(k)
                        ats.append(at)
            h = np.frombuffer(b"".join(hashes), dtype=">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(docs_, pa.int64()), pa.array(keys, pa.int64()), pa.array(ats, pa.int32())], names=["hi", "lo", "doc", "text_key", "at"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "hi long, lo long, doc long, text_key long, at int")


def _streamed(rows: DataFrame, least_docs: int) -> DataFrame:
    """Rows that go, and all rows of open keys with a summary (n_docs, first doc) in the open key's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, names = TaskContext.get().partitionId(), ["hi", "lo", "doc", "text_key", "at", "open", "task", "n_docs"]

        def out(group: list[np.ndarray], is_open: bool) -> Iterator[pa.RecordBatch]:
            hi, lo, doc, key, at = (np.concatenate(c) for c in zip(*group))
            n = 1 + int((doc[1:] != doc[:-1]).sum())
            if not is_open:
                if n < least_docs:
                    return
                gone = doc != doc[0]
                hi, lo, doc, key, at = hi[gone], lo[gone], doc[gone], key[gone], at[gone]
            ns = np.zeros(len(hi), dtype=np.int64)
            ns[:1] = n
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (hi, lo, doc, key, at, np.full(len(hi), is_open), np.full(len(hi), task), ns)], names=names)

        held: list = []  # the rows of the key that the last batch ended with
        first = True
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy() for i in range(5)]
            hi, lo, doc = cols[0], cols[1], cols[2]
            cuts = np.flatnonzero((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])) + 1
            if held and (held[-1][0][-1] != hi[0] or held[-1][1][-1] != lo[0]):
                yield from out(held, first)
                held, first = [], False
            if not len(cuts):
                held.append(cols)
                continue
            yield from out([*held, [c[: cuts[0]] for c in cols]], first)
            first = False
            # All groups between the first cut and the last at once.
            a, z = int(cuts[0]), int(cuts[-1])
            if z > a:
                mid = [c[a:z] for c in cols]
                start = np.zeros(z - a, dtype=bool)
                start[cuts[:-1] - a] = True
                group = np.cumsum(start) - 1
                begin = np.flatnonzero(start)
                change = start.copy()
                change[1:] |= mid[2][1:] != mid[2][:-1]
                n_docs = np.add.reduceat(change, begin, dtype=np.int64)
                gone = (n_docs[group] >= least_docs) & (mid[2] != mid[2][begin][group])
                k = int(gone.sum())
                if k:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c[gone]) for c in mid), pa.array(np.zeros(k, dtype=bool)), pa.array(np.full(k, task)), pa.array(np.zeros(k, dtype=np.int64))], names=names)
            held = [[c[z:] for c in cols]]
        if held:
            yield from out(held, True)

    return rows.mapInArrow(run, "hi long, lo long, doc long, text_key long, at int, open boolean, task long, n_docs long")


def dropped_lines(docs: DataFrame, least_docs: int = 5, shortest: int = 40) -> DataFrame:
    """(doc, text_key, at) of every line that goes."""
    rows = long_lines(docs, shortest).repartitionByRange("hi", "lo", F.desc("doc")).sortWithinPartitions("hi", "lo", F.desc("doc"), "text_key", "at")
    rows = written(_streamed(rows, least_docs), "line-dedup")
    opened = rows.where("open")
    # One document may lie on both sides of a border, so open keys count documents by their ends in each task.
    ends = opened.groupBy("hi", "lo", "task").agg(F.sum("n_docs").alias("n"), F.max("doc").alias("most"), F.min("doc").alias("least"))
    same = ends.select("hi", "lo", F.col("least").alias("border"), "task")
    again = ends.join(same.withColumnRenamed("task", "other"), ["hi", "lo"]).where((F.col("border") == F.col("most")) & (F.col("other") < F.col("task"))).groupBy("hi", "lo", "task").agg(F.lit(1).alias("twice"))
    totals = ends.join(again, ["hi", "lo", "task"], "left").groupBy("hi", "lo").agg((F.sum("n") - F.sum(F.coalesce("twice", F.lit(0)))).alias("total"), F.max("most").alias("last")).where(F.col("total") >= least_docs)
    # At most two keys a partition are open, so the totals are few; opened rows of one common key stay where they are.
    settled = opened.join(F.broadcast(totals), ["hi", "lo"]).where(F.col("doc") < F.col("last"))
    return rows.where("not open").select("doc", "text_key", "at").union(settled.select("doc", "text_key", "at"))


def keep_bitmaps(docs: DataFrame, least_docs: int = 5, shortest: int = 40) -> DataFrame:
    """(doc, text_key, bitmap) of documents that lose lines: a zero bit for each line that goes, up to the last of them."""

    @F.pandas_udf("binary")
    def bitmap(ats):
        def one(at) -> bytes:
            keep = np.ones(8 * (int(max(at)) // 8 + 1), dtype=bool)
            keep[np.asarray(at)] = False
            return zlib.compress(np.packbits(keep, bitorder="little").tobytes())

        return ats.map(one)

    gone = dropped_lines(docs, least_docs, shortest)
    return gone.groupBy("doc", "text_key").agg(F.collect_set("at").alias("ats")).select("doc", "text_key", bitmap("ats").alias("bitmap"))


def applied(docs: DataFrame, bitmaps: DataFrame, n_lines: str = "_n_lines", n_dropped: str = "_n_dropped") -> DataFrame:
    """``docs`` with the lines that stay as text, and the columns ``n_lines`` and ``n_dropped`` (after columns of such names are dropped)."""

    @F.pandas_udf("kept string, n_lines long, n_dropped long")
    def kept(text, bitmap):
        import pandas as pd

        def one(t: str, bits: bytes | None) -> tuple[str, int, int]:
            n = t.count("\n") + 1
            if bits is None:
                return t, n, 0
            keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), bitorder="little")
            lines = t.split("\n")
            stay = [x for i, x in enumerate(lines) if i >= len(keep) or keep[i]]
            return "\n".join(stay), n, n - len(stay)

        return pd.DataFrame([one(t or "", b) for t, b in zip(text, bitmap)], columns=["kept", "n_lines", "n_dropped"])

    rows = docs.drop(n_lines, n_dropped)
    doc, key, bits, k = unused(rows, "_doc", "_text_key", "_bitmap", "_k")
    marked = rows.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), key: text_key()})
    marked = marked.join(bitmaps.select(F.col("doc").alias(doc), F.col("text_key").alias(key), F.col("bitmap").alias(bits)), [doc, key], "left")
    made = marked.withColumn(k, kept(F.col("text").cast("string"), bits))
    return made.select(*(F.col(f"{k}.kept").alias("text") if c == "text" else c for c in rows.columns), F.col(f"{k}.n_lines").alias(n_lines), F.col(f"{k}.n_dropped").alias(n_dropped))
