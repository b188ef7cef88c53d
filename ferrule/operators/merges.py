"""Changes of tables as new versions: upserts, conditional updates, deletes, integrity audits. One writer at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded_batch(batch: DataFrame, key: str, order: str, first: list[str], last: list[str], best: dict[str, Column]) -> DataFrame:
    """One row per key of a batch that may hold it more than once.

    ``first``: value of the first row; ``last``: last non-null value; ``best``:
    value of the row whose rank is highest, the later one among equals. Partial
    aggregates only, so that hot keys are combined before the shuffle.
    """
    aggs = [F.min_by(c, order).alias(c) for c in first]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in last]
    aggs += [F.max_by(c, F.struct(rank, F.col(order))).alias(c) for c, rank in best.items()]
    return batch.groupBy(key).agg(*aggs)


def upsert(base: DataFrame, batch: DataFrame, key: str, keep: list[str], newest: list[str], ranked: dict[str, tuple[str, str]]) -> DataFrame:
    """New version of ``base`` after ``batch`` (one row per key in either).

    ``keep`` columns stay as first written, ``newest`` ones take the batch's value
    unless it is null, and each ranked column {value: (rank in both, marker)} is
    replaced together with its marker where the batch's rank is at least the
    stored one. Rows of either side alone are kept.
    """
    b, n = base.alias("b"), batch.alias("n")
    both = b.join(n, F.col(f"b.{key}") == F.col(f"n.{key}"), "full_outer")
    out = [F.coalesce(F.col(f"b.{key}"), F.col(f"n.{key}")).alias(key)]
    out += [F.coalesce(F.col(f"b.{c}"), F.col(f"n.{c}")).alias(c) for c in keep]
    out += [F.coalesce(F.col(f"n.{c}"), F.col(f"b.{c}")).alias(c) for c in newest]
    for value, (rank, marker) in ranked.items():
        wins = F.coalesce(F.col(f"n.{rank}"), F.lit(-1)) >= F.coalesce(F.col(f"b.{rank}"), F.lit(-1))
        for c in (value, marker, rank):
            out.append(F.when(wins & F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
    return both.select(*out)


def update_where(df: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    """New version with ``values`` in the rows that meet the condition (not where it is null)."""
    hit = F.coalesce(when, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def audit(df: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """rule, severity, key: one row per rule (name, severity, condition of failure) and failing row, in one pass."""
    hits = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, bad in rules)))
    return df.select(F.col(key), F.explode(hits).alias("h")).select("h.rule", "h.severity", key)
