"""Hierarchical multi-length packing of tokenised documents.

Each document is cut into full long windows and a rest; a rest is routed to the smallest context-size tier that holds
it. Tiers are packed from the longest down: a rest opens a window, the largest rests of shorter tiers that fit fill its
gap, and what gap is left is filled with a cut piece, so that windows are full. Within a batch, windows are dealt to step
groups of about equal tokens (longest first, each to the lightest group).

A task packs the documents that it reads, batch after batch, and carries over what fills no window; only a task's last
few windows can hold padding. Nothing is shuffled, so one source or group of copies may hold any share of the rows, and a
task that is run again packs the same rows the same way.

Defined results: a null text counts as empty, and an empty one is its end id alone; rows that repeat are packed as
often as they occur; a null doc_id stays null; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .tokens import CACHED_PIECES, encoder, parts

TIERS = (256, 512, 1024, 2048)
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window long, step_group long"


class Packer:
    """Packs pieces (length, number, row, start): rows are the caller's; ``flush`` gives windows as (size, pieces)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.pools, self.full, self.number = tiers, [[] for _ in tiers], [], 0

    def _route(self, length: int, row: int, start: int) -> None:
        k = next(i for i, t in enumerate(self.tiers) if length <= t)
        insort(self.pools[k], (length, self.number, row, start))
        self.number += 1

    def add(self, length: int, row: int) -> None:
        """A document's ids: all its full windows, and its rest to a tier."""
        most = self.tiers[-1]
        whole = length - length % most
        self.full += [(most, [(most, row, s)]) for s in range(0, whole, most)]
        if length > whole:
            self._route(length - whole, row, whole)

    def _take(self, tier: int, gap: int) -> tuple[int, int, int] | None:
        """The largest rest of at most ``gap`` ids from this tier or a shorter one; else a piece of exactly ``gap`` cut off one."""
        for k in range(tier, -1, -1):
            if i := bisect_right(self.pools[k], (gap, float("inf"))):
                length, _, row, start = self.pools[k].pop(i - 1)
                return length, row, start
        for k in range(tier + 1):
            if self.pools[k]:
                length, _, row, start = self.pools[k].pop(0)
                self._route(length - gap, row, start + gap)
                return gap, row, start
        return None

    def flush(self, last: bool = False) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """The windows that can be filled; with ``last`` also what is left, in the smallest windows that hold it."""
        windows, self.full = self.full, []
        for k in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[k]
            while self.pools[k]:
                length, _, row, start = self.pools[k].pop()
                pieces, gap = [(length, row, start)], size - length
                while gap and (piece := self._take(k, gap)):
                    pieces.append(piece)
                    gap -= piece[0]
                if gap:  # nothing is left: these wait for more
                    for n, r, s in pieces:
                        self._route(n, r, s)
                    break
                windows.append((size, pieces))
        if last:
            rest = sorted((p[1:] + p[:1] for pool in self.pools for p in pool), key=lambda p: (p[1], p[2]))
            rest, self.pools = [[n, r, s] for _, r, s, n in rest], [[] for _ in self.tiers]
            while total := sum(p[0] for p in rest):
                size = next((t for t in reversed(self.tiers) if t <= total), self.tiers[-1])
                pieces, gap = [], size
                while gap and rest:
                    n, r, s = rest[0]
                    take = min(n, gap)
                    pieces.append((take, r, s))
                    gap -= take
                    rest[0] = [n - take, r, s + take]
                    if n == take:
                        rest.pop(0)
                windows.append((size, pieces))
        return windows


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """A group for each window, so that groups have about equal tokens."""
    heap = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    groups = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, g = heapq.heappop(heap)
        groups[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return groups


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, batch_tokens: int = 1 << 20, step_tokens: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", cached_pieces: int = CACHED_PIECES) -> DataFrame:
    """A row for each piece: its document, place there and ids (little-endian unsigned 32-bit), and its sequence and offset.

    ``tokenizer``: a word-level vocabulary file of the tokenizers library. ``window`` is the sequence's padded length.
    ``cached_pieces``: how many pieces a worker keeps, of about 200 bytes each; ids do not depend on it.
    """
    ship(docs.sparkSession)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, rows, held = encoder(tokenizer, "word", cached_pieces), Packer(tiers), {}, 0
        first = TaskContext.get().partitionId() << 33
        row = sequence = group = 0

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, group
            windows = packer.flush(last)
            groups = step_groups([sum(p[0] for p in pieces) for _, pieces in windows], step_tokens)
            cols: list[list] = [[] for _ in range(9)]
            for (size, pieces), g in zip(windows, groups):
                offset = 0
                for n, r, s in pieces:
                    doc_id, ids = rows[r]
                    for c, v in zip(cols, (doc_id, s, n, ids[4 * s : 4 * (s + n)], len(ids) // 4, first + sequence, offset, size, first + group + g)):
                        c.append(v)
                    offset += n
                sequence += 1
            group += max(groups, default=-1) + 1
            kept = {p[2] for pool in packer.pools for p in pool}
            for r in [r for r in rows if r not in kept]:
                del rows[r]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(cols)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window", "step_group"])

        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for i, j in parts(texts):
                for doc_id, e in zip(ids[i:j], enc.encode_batch(texts[i:j])):
                    e += end
                    rows[row] = doc_id, e
                    packer.add(len(e) // 4, row)
                    row += 1
                    held += len(e) // 4
                if held >= batch_tokens:
                    held = 0
                    yield from out(False)
        if rows:
            yield from out(True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
