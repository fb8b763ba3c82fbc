"""Splitting hot keys: rows of one key stand in several partitions, rows with unique keys are repeated for each.

Every key is split alike, whatever its number of rows, so that plans do not change with the data and no job is
needed to find the hot ones. The side with unique keys should be restricted to the keys that are asked for first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salt(spread: Column, salts: int = SALTS) -> Column:
    """Part of its key that a row belongs to."""
    return F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")


def copies(unique: DataFrame, salts: int = SALTS) -> DataFrame:
    """Each row of a side with unique keys once per part."""
    return unique.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
