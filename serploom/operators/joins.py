"""Joins that stay even when one key owns a large part of one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_lookup(
    rows: DataFrame, lookup: DataFrame, key: str, spread: list[str], salts: int = 16, how: str = "left"
) -> DataFrame:
    """Joins many rows with a lookup that has one row per key.

    The lookup side is copied once per salt and the rows are spread by ``spread``, so the rows of a
    single key are joined in ``salts`` tasks.
    """
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")
