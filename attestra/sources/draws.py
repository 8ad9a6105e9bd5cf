"""Cached draws: by the folder that a draw's files lie in, and as a table in parts by model and draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .artifacts import json_or_null

#: A draw's files.
FILES = ("prediction.md", "inference.json", "score.json")
_PLACE = r"/([^/]+)/([^/]+)(?:/draws/([0-9]{3,}))?/(" + "|".join(f.replace(".", "[.]") for f in FILES) + ")$"
INFERENCE = "cacheKey STRING, usage STRUCT<inputTokens BIGINT, outputTokens BIGINT>"
SCORE = "cacheKey STRING, score DOUBLE"


def draw_folder(model_id: Column, case_id: Column, draw: Column) -> Column:
    """Where a draw's files lie: the first in its case's folder, later ones in folders of their own below it."""
    later = F.when(draw > 1, F.concat(F.lit("draws/"), F.lpad(draw.cast("string"), F.greatest(F.lit(3), F.length(draw.cast("string"))), F.lit("0"))))
    return F.concat_ws("/", model_id, case_id, later)


def placed(files: DataFrame) -> DataFrame:
    """(model_id, case_id, draw, file, content) of ``files(path, content)``; other files are left out."""
    get = lambda i: F.regexp_extract("path", _PLACE, i)
    number = F.when(get(3) == "", F.lit(1)).otherwise(get(3).try_cast("int"))
    return files.where(F.col("path").rlike(_PLACE)).select(get(1).alias("model_id"), get(2).alias("case_id"), number.alias("draw"), get(4).alias("file"), F.col("content").cast("string").alias("content"))


def draws(files: DataFrame, inference: str = INFERENCE, score: str = SCORE) -> DataFrame:
    """(model_id, case_id, draw, prediction, inference, score): a row for each draw; what is absent or does not parse is null.

    Spark's reader passes over files without a byte, so an empty file counts as absent.
    """
    of = lambda f: F.max(F.when(F.col("file") == f, F.col("content")))
    rows = placed(files).groupBy("model_id", "case_id", "draw").agg(*(of(f).alias(f"_{i}") for i, f in enumerate(FILES)))
    return rows.select("model_id", "case_id", "draw", F.col("_0").alias("prediction"), json_or_null(F.col("_1"), inference).alias("inference"), json_or_null(F.col("_2"), score).alias("score"))


def read_draws(spark: SparkSession, root: str) -> DataFrame:
    """All draws below a folder, as files are found."""
    return draws(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content"))


def cached_models(spark: SparkSession, root: str, known: list[str]) -> list[str]:
    """The known models that a cache has a folder for, of either layout; none where there is no cache."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = {s.getPath().getName().removeprefix("model_id=") for s in fs.listStatus(at) if s.isDirectory()}
    return sorted(names & set(known))


def write_draws(rows: DataFrame, root: str, files: int = 8) -> None:
    """Adds ``rows(model_id, case_id, draw, key, at, ...)`` to a table in parts by model and draw, at most ``files`` files a part each time.

    A model of very many cases is spread over that many tasks; a draw that is written again is told by ``at``.
    """
    spread = F.pmod(F.xxhash64("case_id"), F.lit(files))
    rows.repartition("model_id", "draw", spread).sortWithinPartitions("model_id", "draw", "case_id").write.mode("append").partitionBy("model_id", "draw").parquet(root)


def latest_draws(spark: SparkSession, root: str, models: list[str] | None = None) -> DataFrame:
    """The last write of each draw; ``models`` are read alone, as their parts are the only ones opened."""
    rows = spark.read.parquet(root)
    rows = rows if models is None else rows.where(F.col("model_id").isin(models))
    by = ["model_id", "case_id", "draw"]
    rest = [c for c in rows.columns if c not in by]
    last = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("at", "key")).alias("x"))
    return last.select(*by, "x.*")
