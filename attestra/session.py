"""Session helpers: a local session for tests, the cluster's shared folder, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one on a local master where none is set (tests)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="attestra-", dir="/tmp")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage is cut and it is computed once.

    The table stays until ``forget`` is given it, or ``forget_all`` clears what this session has written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._attestra_path = path
    _WRITTEN[path] = spark.sparkContext.applicationId
    return out


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` in as many parts as there are shuffle partitions: texts are few bytes for what reading them costs."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Written tables that are still there, with the application that wrote them.
_WRITTEN: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.pop(path, None)


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again; frames that are no such table are left alone."""
    for t in tables:
        if path := getattr(t, "_attestra_path", None):
            _delete(t.sparkSession, path)


def forget_all(spark: SparkSession) -> None:
    """Delete all written tables of this session, once their results have been saved."""
    for path in [p for p, app in _WRITTEN.items() if app == spark.sparkContext.applicationId]:
        _delete(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were written within; results must be saved before."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in set(_WRITTEN) - before:
            _delete(spark, path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, as ``spark-submit --py-files`` would, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_attestra_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="attestra-ship-"), "attestra.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(archive)
    context._attestra_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
