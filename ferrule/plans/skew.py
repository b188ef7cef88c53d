"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_lookup(rows: DataFrame, lookup: DataFrame, on: str, spread_by: str, salts: int = 16, how: str = "left") -> DataFrame:
    """Join many ``rows`` to ``lookup``, which has one row per key, without sending a hot key to one task.

    Every lookup row is repeated for each salt and every row takes the salt of
    its ``spread_by`` value, so a key's rows go to up to ``salts`` tasks. Null
    keys match nothing. The repeated side has one row per distinct key, which
    keeps the shuffle below that of the rows themselves.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [on, "_salt"], how).drop("_salt")
