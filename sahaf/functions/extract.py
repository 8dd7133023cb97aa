"""Evidence in record texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numbers as n

FREE = r"(?iu)(?<!\p{L})(masrafsız|ücretsiz|dosya masrafı yok)(?!\p{L})"


def anchored(text: Column, start: Column, end: Column, value: Column) -> Column:
    """Where a span really is: at its offsets, else where its text stands once; null if neither."""
    there = (start >= 0) & (start < end) & (F.substring(text, start + 1, end - start) == value)
    once = (F.length(text) - F.length(F.replace(text, value, F.lit("")))) == F.length(value)
    at = F.position(value, text)
    return F.when(there, start).when(F.coalesce(once & (at > 0), F.lit(False)), at - 1)


def merged_spans(model: DataFrame, rules: DataFrame) -> DataFrame:
    """Spans (id, start, end, label) of both, each place and label once."""
    return model.unionByName(rules).dropDuplicates(["id", "start", "end", "label"])
