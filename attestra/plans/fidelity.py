"""The whole way from candidate documents to scores: parse once, gate by joins, add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gates, scoring, tables


def table_fidelity(candidates: DataFrame, leaves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, possible, earned, ratio, score): candidates(keys, text) scored on leaves(keys, leaf_id, row_key, column, value, harm)."""
    status = gates.table_binding(tables.table_cells(candidates, keys), leaves, keys)
    scored = scoring.region_scores(leaves.join(status.hint("merge"), [*keys, "leaf_id"]).select(*keys, "status", "harm"), None, keys)
    return scored.select(*keys, "possible", "earned", "ratio", (100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("ratio")))).alias("score"))
