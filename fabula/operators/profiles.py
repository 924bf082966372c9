"""Merging what several texts say of one character."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_profiles(fragments: DataFrame, fields: list[str], name: str = "name", seq: str = "seq", description: str = "description") -> DataFrame:
    """By trimmed name, case aside: of each field the first that is not blank, and the longest description."""
    filled = lambda c: F.when(F.trim(c) != "", F.col(seq))
    aggs = [F.min_by(F.when(F.trim(f) != "", F.col(f)), filled(f)).alias(f) for f in fields]
    longest = F.max_by(description, F.struct(F.length(description), -F.col(seq))).alias(description)
    return fragments.groupBy(F.lower(F.trim(name)).alias("name_key")).agg(F.min_by(F.trim(name), seq).alias(name), *aggs, longest, F.count("*").alias("fragments"))
