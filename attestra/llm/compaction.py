"""Sharding by size-tiered compaction, with a versioned manifest.

A dataset is a folder of runs and manifests. An arrival is appended as a run of small shards. When ``fanout`` runs
are of one size tier (powers of ``fanout`` of the smallest), they are merged into one run of target-sized files, again and
again until no tier is full. Runs never change. A manifest lists the runs of a version and the dataset's columns; it is written
under another name and renamed, and the rename fails if that version is there already, so a writer that lost the race starts
over and readers see all of a version or nothing. ``vacuum`` deletes runs that no kept manifest lists: those of dropped
manifests at once (readers of a dropped version lose it: keep as many as readers may use), and those that are in no manifest at
all, which failed or lost writes leave, after ``grace_hours``. A vacuum that was cut off is completed by the next.

A merge reads each row once and writes it once, without a shuffle: small shards are put together until they reach the
target size. Rows are not placed by key, so a hot key does not matter. Only run sizes (a few numbers for each run)
reach the driver. Only DataFrame operations touch the rows.

Columns are those of all arrivals, by name; rows of arrivals without a column have null there, also after a merge. An arrival
that has a column with another type is refused before anything is written.

Defined results: rows come back as they were, repeated ones and nulls included; an empty arrival adds no run, but its new columns
count; a dataset without runs reads as an empty table of its columns; a column with a clashing name is stored like any other, and
``read`` adds ``_run`` and ``_shard`` only if asked.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


@dataclass(frozen=True)
class Run:
    name: str
    files: int
    bytes: int
    rows: int


class ShardedDataset:
    """``shard_bytes``: of an arrival's shards; ``target_bytes``: of merged files; both as stored."""

    def __init__(self, spark: SparkSession, folder: str, shard_rows: int = 20_000, target_bytes: int = 128 << 20, fanout: int = 4, least_bytes: int = 1 << 20):
        self.spark, self.folder, self.shard_rows, self.target_bytes, self.fanout, self.least_bytes = spark, folder.rstrip("/"), shard_rows, target_bytes, fanout, least_bytes
        self._jvm = spark._jvm
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), conf)
        self._fs.mkdirs(self._path("manifests"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Run]]:
        """A version (the latest, or 0 with no runs) and its runs."""
        version, runs, _ = self._state(version)
        return version, runs

    def _state(self, version: int | None = None) -> tuple[int, list[Run], StructType]:
        have = self.versions()
        if version is None:
            version = have[-1] if have else 0
        if not version:
            return 0, [], StructType()
        stream = self._fs.open(self._path(f"manifests/v{version:08d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return version, [Run(**r) for r in found["runs"]], StructType.fromJson(found["columns"])

    @staticmethod
    def joined(columns: StructType, more: StructType) -> StructType:
        """The columns of both, by name, all nullable; a name with two types is an error."""
        kinds = {f.name: f.dataType for f in columns}
        for f in more:
            if kinds.setdefault(f.name, f.dataType) != f.dataType:
                raise ValueError(f"column {f.name} is {kinds[f.name].simpleString()} in the dataset and {f.dataType.simpleString()} in the arrival")
        return StructType([StructField(n, k) for n, k in kinds.items()])

    def commit(self, base: int, runs: list[Run], columns: StructType | None = None) -> bool:
        """Version ``base + 1`` with ``runs`` (and the latest columns if none are given); False if another writer has made it meanwhile."""
        columns = self._state()[2] if columns is None else columns
        tmp = self._path(f"manifests/.tmp-{uuid.uuid4().hex}")
        out = self._fs.create(tmp, False)
        try:
            out.write(bytearray(json.dumps({"runs": [r.__dict__ for r in runs], "columns": columns.jsonValue()}).encode()))
        finally:
            out.close()
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            self._context.rename(tmp, self._path(f"manifests/v{base + 1:08d}.json"), options)
        except Exception as e:
            self._fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _write(self, rows: DataFrame, per_file: int) -> Run | None:
        name = f"run-{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", per_file).option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self._measured(name)

    def _measured(self, name: str) -> Run | None:
        files = [f for f in self._fs.listStatus(self._path(name)) if f.getPath().getName().endswith(".parquet")]
        rows = self.spark.read.parquet(f"{self.folder}/{name}").count() if files else 0  # from the footers
        return Run(name, len(files), sum(f.getLen() for f in files), rows) if rows else None

    def append(self, rows: DataFrame) -> int:
        """``rows`` as a run of small shards; the version that holds it."""
        self.joined(self._state()[2], rows.schema)
        return self._add([r for r in [self._write(rows, self.shard_rows)] if r], rows.schema)

    def append_all(self, rows: DataFrame, arrival: str) -> int:
        """Many arrivals, told apart by the column ``arrival`` (not stored), written in one pass: a run for each."""
        schema = rows.drop(arrival).schema
        self.joined(self._state()[2], schema)
        name = f"arrivals-{uuid.uuid4().hex}"
        rows.write.partitionBy(arrival).option("maxRecordsPerFile", self.shard_rows).option("compression", "zstd").parquet(f"{self.folder}/{name}")
        parts = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)) if s.isDirectory() and "=" in s.getPath().getName())
        return self._add([r for p in parts if (r := self._measured(f"{name}/{p}"))], schema)

    def _add(self, runs: list[Run], schema: StructType) -> int:
        while True:
            base, have, columns = self._state()
            wanted = self.joined(columns, schema)
            if not runs and wanted == columns:
                return base
            if self.commit(base, have + runs, wanted):
                return base + 1

    def tier(self, run: Run) -> int:
        size, k = self.least_bytes, 0
        while run.bytes >= size * self.fanout:
            size, k = size * self.fanout, k + 1
        return k

    def compact(self) -> list[tuple[int, int, int]]:
        """Merges until no tier is full; (tier, runs, files written) of each merge."""
        done = []
        while True:
            base, runs, columns = self._state()
            tiers: dict[int, list[Run]] = {}
            for r in runs:
                tiers.setdefault(self.tier(r), []).append(r)
            full = min((k for k, v in tiers.items() if len(v) >= self.fanout), default=None)
            if full is None:
                return done
            old = tiers[full]
            size, rows = sum(r.bytes for r in old), sum(r.rows for r in old)
            files = max(1, round(size / self.target_bytes))
            merged = self._write(self._read(old, columns).coalesce(files), max(1, -(-rows // files) * 2))
            if self.commit(base, [r for r in runs if r not in old] + [merged], columns):
                done.append((full, len(old), merged.files))

    def _read(self, runs: list[Run], columns: StructType) -> DataFrame:
        return self.spark.read.schema(columns).parquet(*(f"{self.folder}/{r.name}" for r in runs))

    def read(self, version: int | None = None, places: bool = False) -> DataFrame:
        """The rows of a version; with ``places`` also their _run and _shard."""
        _, runs, columns = self._state(version)
        if not runs:
            if places:
                columns = StructType([*columns, *(StructField(n, StringType()) for n in ("_run", "_shard"))])
            return self.spark.createDataFrame([], columns)
        rows = self._read(runs, columns)
        if places:
            parts = F.split(F.col("_metadata.file_path"), "/")
            rows = rows.select("*", F.element_at(parts, -2).alias("_run"), F.element_at(parts, -1).alias("_shard"))
        return rows

    def _folders(self) -> dict[str, int]:
        """Names of all run folders and when each was last written to."""
        found = {}
        for s in self._fs.listStatus(self._path("")):
            name = s.getPath().getName()
            if name.startswith("run-"):
                found[name] = s.getModificationTime()
            elif name.startswith("arrivals-"):
                found |= {f"{name}/{p.getPath().getName()}": p.getModificationTime() for p in self._fs.listStatus(s.getPath()) if p.isDirectory() and "=" in p.getPath().getName()}
        return found

    def vacuum(self, keep: int = 1, grace_hours: float = 24) -> int:
        """Deletes all manifests but the last ``keep``, and runs as the module's text says; how many runs went."""
        have = self.versions()
        live = {r.name for v in have[-keep:] for r in self.manifest(v)[1]}
        listed = {r.name for v in have[:-keep] for r in self.manifest(v)[1]}
        oldest = (time.time() - 3600 * grace_hours) * 1000
        gone = {n for n, at in self._folders().items() if n not in live and (n in listed or at < oldest)}
        for v in have[:-keep]:
            self._fs.delete(self._path(f"manifests/v{v:08d}.json"), False)
        for name in gone:
            self._fs.delete(self._path(name), True)
        return len(gone)
