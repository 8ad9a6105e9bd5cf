"""Token ids in files of length-delimited binary records, with an offset index.

A record: the payload's length (unsigned 64-bit), the masked checksum of those eight bytes, the payload, its masked
checksum; all little-endian. The checksum is CRC-32 (zlib), masked by rotating it right by 15 bits and adding 0xa282ead8,
so that a checksum of data that holds checksums stays useful. The payload: doc_id (signed 64-bit), a byte that is 1 where
the doc_id is null, the bytes of an id (1 byte: 2 or 4), then the ids. Each shard's ``.rec`` has an ``.idx``: for each
record its offset in the file and its number of ids, as unsigned 64-bit integers, so that any record can be read alone.

Documents are range-partitioned and sorted by doc_id (nulls first; equal ids by a hash of their text), so shard after
shard holds them in order, and a range of equal ids can be split. A shard's files are named after its number and a token of the
attempt that wrote them, and only names that a finished task returned are listed, in ``shards.json`` too; what a lost or
doubled attempt leaves is in no list, so nothing is moved or overwritten. Files go to any store that pyarrow's file systems open
by uri; ``s3a`` and ``s3n`` are read as ``s3``.

Defined results: a null text counts as empty, and an empty one is its end id alone; repeated rows are records of their
own; other columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import json
import random
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .text import text_key
from .tokens import encoder, parts

READ_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview, at: int = 0) -> tuple[memoryview, int]:
    """The payload of the record at ``at``, and where the next one begins."""
    size = bytes(data[at : at + 8])
    (n,) = struct.unpack("<Q", size)
    if struct.unpack("<I", data[at + 8 : at + 12])[0] != masked(size):
        raise ValueError("a record's length is damaged")
    payload = data[at + 12 : at + 12 + n]
    if len(payload) != n or struct.unpack("<I", data[at + 12 + n : at + 16 + n])[0] != masked(payload):
        raise ValueError("a record is damaged")
    return payload, at + 16 + n


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<qBB", doc_id or 0, doc_id is None, width) + (np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids)


def parsed(data: memoryview) -> tuple[int | None, bytes]:
    """doc_id, and the ids as unsigned 32-bit integers."""
    doc_id, none, width = struct.unpack("<qBB", data[:10])
    ids = bytes(data[10:])
    return None if none else doc_id, np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's uri, and its path there."""
    scheme, found, rest = folder.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if found and scheme in ("s3a", "s3n") else folder)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Writes the shards under ``folder``; (name, records, ids) of each, in order, is all that the driver gets."""
    ship(docs.sparkSession)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, "byte")
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        store, root = opened(folder)
        name = f"shard-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex[:12]}"
        n = tokens = at = 0
        index: list[bytes] = []
        out = None
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for i, j in parts(texts):
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}.rec", compression=None)
                for d, e in zip(ids[i:j], enc.encode_batch(texts[i:j])):
                    index.append(struct.pack("<QQ", at, len(e) // 4 + 1))
                    out.write(record := frame(payload(d, e + end, width)))
                    at += len(record)
                    tokens += len(e) // 4 + 1
                n += j - i
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{root}/{name}.idx", compression=None) as f:
            f.write(b"".join(index))
        yield pa.RecordBatch.from_pydict({"shard": [name], "records": [n], "ids": [tokens]})

    store, root = opened(folder)
    store.create_dir(root)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_key(text_col).alias("key"))
    rows = rows.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key").select("doc_id", "text")
    shards = sorted(tuple(r) for r in rows.mapInArrow(run, "shard string, records long, ids long").collect())
    with store.open_output_stream(f"{root}/shards.json", compression=None) as f:
        f.write(json.dumps(shards).encode())
    return shards


def read_records(spark: SparkSession, folder: str, shards: list[tuple[str, int, int]] | None = None, seed: int | None = None, block: int = 8 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every record, a task for each shard; ``start`` counts all ids before.

    With ``seed``, the records of a shard are read one by one in a random order, by the offset index. Without ``shards``,
    ``shards.json`` is read for them.
    """
    ship(spark)
    if shards is None:
        store, root = opened(folder)
        with store.open_input_stream(f"{root}/shards.json", compression=None) as f:
            shards = [tuple(x) for x in json.loads(f.read())]
    names = [s for s, _, _ in shards]
    starts = np.cumsum([0] + [t for _, _, t in shards]).tolist()

    def blocks(f, index: np.ndarray) -> Iterator[tuple[int, memoryview]]:
        """Numbers of records and their bytes."""
        n, size = len(index), f.size()
        ends = np.append(index[1:, 0], size)
        if seed is not None:
            for k in random.Random(seed).sample(range(n), n):
                f.seek(int(index[k, 0]))
                yield k, memoryview(f.read(int(ends[k] - index[k, 0])))
            return
        k = 0
        while k < n:
            j = max(k + 1, int(np.searchsorted(ends, int(index[k, 0]) + block, "right")))
            f.seek(int(index[k, 0]))
            data = memoryview(f.read(int(ends[j - 1] - index[k, 0])))
            at = 0
            for i in range(k, j):
                size = int(ends[i] - index[i, 0])
                yield i, data[at : at + size]
                at += size
            k = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        for b in batches:
            for i in b.column(0).to_pylist():
                path = f"{root}/{names[i]}"
                with store.open_input_stream(f"{path}.idx", compression=None) as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)
                before = starts[i] + np.cumsum(index[:, 1]) - index[:, 1]
                with store.open_input_file(f"{path}.rec") as f:
                    rows, size = [], 0
                    for k, data in blocks(f, index):
                        doc_id, ids = parsed(unframe(data)[0])
                        if len(ids) != 4 * index[k, 1]:
                            raise ValueError("the index doesn't fit its file")
                        rows.append((doc_id, int(before[k]), len(ids) // 4, ids))
                        size += len(ids)
                        if size >= block:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, READ_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids"])
