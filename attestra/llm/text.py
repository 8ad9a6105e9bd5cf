"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z alone."""
    return F.translate(c, UPPER, LOWER)


def text_key(text: str = "text") -> Column:
    """Tells rows with one doc_id and different texts apart; a null text counts as an empty one."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))
