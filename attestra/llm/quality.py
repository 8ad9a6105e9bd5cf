"""Quality rules: counts of words, signs and repeats, and compression bands.

The method's verdict: zstandard ratios (compressed over plain bytes) of the whole text and of fixed chunks must lie in
the band for the text's length. Repetitive text compresses too well, random text hardly at all. Short texts
compress worse, so each length has its own limits. Texts of ``CHUNKS``' least sizes are cut into chunks of the size that goes with
them; the last chunk ends with the text and overlaps the one before, so no byte goes unseen. ``max_odd_chunks`` is the
share of chunks outside their band up to which a text is kept.

Defined results: a null or empty text has no words and fails; rows are judged one by one, so repeats and ties don't
matter; columns besides the id and the text are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of a text below which a band holds, its least ratio, its largest.
BANDS = ((512, 0.30, 0.84), (2048, 0.27, 0.78), (8192, 0.20, 0.68), (1 << 62, 0.10, 0.60))
#: Least bytes of a text, the size of its chunks, their least ratio, their largest.
CHUNKS = ((8192, 4096, 0.15, 0.64), (1025, 1024, 0.22, 0.72))
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, odd_chunks double, kept boolean"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def repeat_words(words: list, size: int = 3) -> int:
    """Words that lie in a window of ``size`` words which occurs at least twice."""
    n = len(words)
    if n <= size:
        return 0
    ids: dict = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    key = w[: n - size + 1]
    for i in range(1, size):
        if len(ids) ** 2 * (i > 1) * len(ids) >= 1 << 62:  # renumber, so that the product fits
            _, key = np.unique(key, return_inverse=True)
        key = key * len(ids) + w[i : n - size + 1 + i]
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    at = np.isin(key, again)
    covered = np.zeros(n, dtype=bool)
    for i in range(size):
        covered[i : n - size + 1 + i] |= at
    return int(covered.sum())


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def compression(raw: bytes, compress) -> tuple[float, float, bool]:
    """Ratio of the whole, share of chunks outside their band, and whether the whole is in its band; ``raw`` isn't empty."""
    n = len(raw)
    ratio, odd = len(compress(raw)) / n, 0.0
    for least, size, low, high in CHUNKS:
        if n >= least:
            starts = [*range(0, n - size, size), n - size]
            odd = sum(not low <= len(compress(raw[i : i + size])) / size <= high for i in starts) / len(starts)
            break
    low, high = next((a, b) for size, a, b in BANDS if n < size)
    return ratio, odd, low <= ratio <= high


def judgement(text: str | None, compress, max_odd_chunks: float = 0.25) -> tuple:
    """The five counts, base_failed, ratio, odd_chunks and kept of a text; no text has no ratio."""
    text = text or ""
    found = counts(text)
    n, again = found[0], found[4]
    failed = n < 50 or 100 * again > 50 * n
    ratio, odd, ok = compression(text.encode(), compress) if text else (None, None, False)
    return (*found, failed, ratio, odd, not failed and ok and odd <= max_odd_chunks)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_odd_chunks: float = 0.25) -> DataFrame:
    """The counts, base_failed, ratio, odd_chunks and kept of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        for b in batches:
            rows = [judgement(t, compress, max_odd_chunks) for t in b.column(1).to_pylist()]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=NAMES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "_kept", max_odd_chunks: float = 0.25) -> DataFrame:
    """``docs`` with the column ``mark``, judged in place: each row is read once and no join is needed."""
    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def verdict(texts):
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        return texts.map(lambda t: judgement(t, compress, max_odd_chunks)[-1])

    return docs.withColumn(mark, verdict(F.col(text_col).cast("string")))


def passes(text: str | None, compress, max_odd_chunks: float = 0.25) -> bool:
    """Whether the rules keep a text."""
    return judgement(text, compress, max_odd_chunks)[-1]
