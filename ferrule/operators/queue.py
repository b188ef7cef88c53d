"""State changes of a work queue and of a tracker, each a new version of the table.

A change is guarded by the state (and token) a row must be in; rows that aren't
stay as they are, so that a change seen twice changes nothing more. Null states
and tokens never meet a guard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators.merges import update_where


def claim(df: DataFrame, key: str, state: str, free: str, taken: str, order: list[Column], n: int, token: str, token_column: str) -> DataFrame:
    """The first ``n`` free rows in order are marked as taken with the token; ``n`` is the size of a worker's batch.

    The first rows come from a bounded top-n of every partition; equal places in the order go to the smaller key.
    """
    first = df.where((F.col(state) == free) & F.col(key).isNotNull()).orderBy(*order, key).limit(n).select(key, F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    joined = df.join(F.broadcast(first), key, "left")  # n rows
    return joined.withColumns({token_column: F.when(hit, F.lit(token)).otherwise(F.col(token_column)), state: F.when(hit, F.lit(taken)).otherwise(F.col(state))}).select(*df.columns)


def complete(df: DataFrame, state: str, taken: str, done: str, token_column: str, token: str) -> DataFrame:
    """Rows taken with the token are done, and the token is given up."""
    return update_where(df, (F.col(state) == taken) & (F.col(token_column) == token), {state: F.lit(done), token_column: F.lit(None).cast("string")})


def release(df: DataFrame, state: str, taken: str, free: str, token_column: str, token: str) -> DataFrame:
    """Rows taken with the token are free again, without a retry being counted."""
    return update_where(df, (F.col(state) == taken) & (F.col(token_column) == token), {state: F.lit(free), token_column: F.lit(None).cast("string")})


def fail(df: DataFrame, state: str, taken: str, free: str, failed: str, retries: str, most: int, when: Column) -> DataFrame:
    """Taken rows that meet ``when`` are free for another try, or failed once ``most`` tries are used up; a null count is none."""
    tried = F.coalesce(F.col(retries), F.lit(0)) + 1
    return update_where(df, (F.col(state) == taken) & when, {state: F.when(tried < most, free).otherwise(failed), retries: tried})


def reclaim(df: DataFrame, state: str, taken: str, free: str, since: str, before: Column) -> DataFrame:
    """Taken rows last touched before a time are free again; rows without a time aren't stale."""
    return update_where(df, (F.col(state) == taken) & (F.col(since) < before), {state: F.lit(free)})


def filled_text(df: DataFrame, found: DataFrame, on: list[str], text: str, status: str) -> DataFrame:
    """Rows without text take that of ``found`` (one row per key) and are ``ok``; where there is none, their status is ``error``, unless it says the text is gone.

    A text once set isn't replaced. Null keys find nothing.
    """
    joined = df.join(found.select(*on, F.col(text).alias("_text")), on, "left")
    lacks = F.col(text).isNull()
    status_now = F.when(~lacks, F.col(status)).when(F.col("_text").isNotNull(), "ok").when(F.col(status) == "gone", "gone").otherwise("error")
    return joined.withColumn(status, status_now).withColumn(text, F.coalesce(text, "_text")).select(*df.columns)


def healed_scores(df: DataFrame, scores: DataFrame, on: list[str], score: str) -> DataFrame:
    """Rows whose score is null take the best known of ``scores`` (several rows a key may be given); a score once set stays, and none is set to null."""
    best = scores.where(F.col(score).isNotNull()).groupBy(*on).agg(F.max(score).alias("_score"))
    return df.join(best, on, "left").withColumn(score, F.coalesce(score, "_score")).select(*df.columns)


def merged_additions(base: DataFrame, added: DataFrame, id: str, order: str, same: list[list[str]], score: str, kept_note: str = "notes") -> DataFrame:
    """``base`` with ``added`` rows merged in: id, score, ``kept_note`` and the columns of ``same``, and ``change`` (``none``, ``updated``, ``inserted``).

    An added row meets the base row that agrees in the first list of columns of
    ``same`` under which any does (the first such row in order), else it is new. Of several additions for one row the one of the highest score counts, then the
    first in order. A base row takes a better score only, and its note then begins with the old score; status and all else stay.
    New rows get numbers after the largest id, in order. Null keys agree with nothing.
    """
    columns = [id, *dict.fromkeys(c for keys in same for c in keys), score, kept_note]
    met = None
    for rank, keys in enumerate(same):
        known = base.where(" and ".join(f"`{c}` is not null" for c in keys)).groupBy(*keys).agg(F.min_by(id, order).alias("_base"))
        one = added.join(known, keys).select(F.col(order).alias("_o"), F.lit(rank).alias("_rank"), "_base")
        met = one if met is None else met.unionByName(one)
    chosen = met.groupBy("_o").agg(F.min_by("_base", "_rank").alias("_base"))
    joined = added.join(chosen, F.col(order) == F.col("_o"), "left")
    best = joined.where("_base is not null").groupBy("_base").agg(F.max_by(score, F.struct(F.coalesce(score, F.lit(-1.0)), -F.col(order))).alias("_score"))
    old = base.join(best, base[id] == F.col("_base"), "left")
    better = F.coalesce(F.col("_score") > F.coalesce(score, F.lit(-1.0)), F.lit(False))
    note = F.when(better & F.col(score).isNotNull(), F.concat(F.lit("was "), F.col(score).cast("string"), F.lit("; "), F.coalesce(kept_note, F.lit("")))).otherwise(F.col(kept_note))
    kept = old.select(*(c for c in columns if c not in (score, kept_note)), F.when(better, F.col("_score")).otherwise(F.col(score)).alias(score), note.alias(kept_note), F.when(better, "updated").otherwise("none").alias("change"))
    fresh = joined.where("_base is null")
    from ferrule.operators.ordered import numbered

    top = base.agg(F.coalesce(F.max(id), F.lit(0)).alias("_top"))
    new = numbered(fresh, order, "_n").join(F.broadcast(top))  # top is one row
    return kept.unionByName(new.select((F.col("_top") + F.col("_n")).alias(id), *(c for c in columns if c != id), F.lit("inserted").alias("change")))


def resolved_rows(requests: DataFrame, key: str, rows: DataFrame, id: str, steps: list[list[str]]) -> DataFrame:
    """key, id, outcome: the one row each request means: by the first list of columns of ``steps`` under which any row agrees.

    ``one``: exactly one row does, and is given; ``ambiguous``: several do, none is given; ``none``: no row does under any.
    """
    met = None
    for rank, keys in enumerate(steps):
        known = rows.where(" and ".join(f"`{c}` is not null" for c in keys)).groupBy(*keys).agg(F.count("*").alias("_n"), F.min(id).alias("_id"))
        one = requests.join(known, keys).select(F.col(key), F.struct(F.lit(rank).alias("rank"), "_n", "_id").alias("m"))
        met = one if met is None else met.unionByName(one)
    first = met.groupBy(key).agg(F.min("m").alias("m"))
    got = requests.select(key).distinct().join(first, key, "left")
    outcome = F.when(F.col("m").isNull(), "none").when(F.col("m._n") == 1, "one").otherwise("ambiguous")
    return got.select(key, F.when(F.col("m._n") == 1, F.col("m._id")).alias(id), outcome.alias("outcome"))


def deleted(df: DataFrame, keys: DataFrame, key: str, parts: DataFrame, part_key: str, part_of: str) -> DataFrame:
    """key, removed, orphans: how many rows each deleted key had, and how many rows of ``parts`` refer to it and are left alone."""
    gone = keys.select(key).distinct()
    n = df.join(gone, key, "left_semi").groupBy(key).agg(F.count("*").alias("removed"))
    o = parts.groupBy(F.col(part_of).alias(key)).agg(F.count(part_key).alias("orphans"))
    return gone.join(n, key, "left").join(o, key, "left").select(key, F.coalesce("removed", F.lit(0)).alias("removed"), F.coalesce("orphans", F.lit(0)).alias("orphans"))


def nth_pending(df: DataFrame, kind: str, order: str, state: str, pending: str, name: str = "nth") -> DataFrame:
    """The pending rows with their number within each kind, by which one of them is resolved."""
    w = Window.partitionBy(kind).orderBy(order)
    return df.where(F.col(state) == pending).withColumn(name, F.row_number().over(w))
