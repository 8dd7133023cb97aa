"""Case folding and blanks, as a store that folds ASCII only sees them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: Column | str) -> Column:
    return F.translate(x, UPPER, LOWER)


def or_unspecified(x: Column | str) -> Column:
    """Null and blank values as one group of their own."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit("unspecified"))


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, digits))
