"""Operators that depend on an order, which is always a column: ledgers folded, picks, carries, first and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.plans.session import written


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. Null keys form one key. The rank is a top-1, which Spark cuts before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def latest_per_key(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, value: ``value`` of the row with the greatest ``order``; partial aggregates, no sort."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def carried(df: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Adds the last non-null ``value`` at or before each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def changes(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The rows whose ``value`` differs from that of the row before them, and each key's first row."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return df.withColumn("_before", before).withColumn("_first", first).where(F.col("_first") | ~F.col("_before").eqNullSafe(F.col(value))).drop("_before", "_first")


def folded_ledger(df: DataFrame, key: str, line: str, date: str, to: str, source: str) -> DataFrame:
    """key, timeline: array of (state, date) after replaying each key's entries in line order.

    ``-`` takes back the entry made last; a ``correction`` changes the date of the
    last entry of the same state, or adds it; the outcome is sorted by date, equal
    dates in the order of entry. Null states are skipped.
    """
    entries = F.array_sort(F.collect_list(F.struct(F.col(line).alias("line"), F.col(to).alias("to"), F.col(date).alias("date"), F.col(source).alias("source"))))
    empty = F.array().cast("array<struct<state:string,date:string,at:bigint>>")

    def step(acc: Column, e: Column) -> Column:
        entry = F.struct(e["to"].alias("state"), e["date"].cast("string").alias("date"), e["line"].cast("bigint").alias("at"))
        at = F.array_position(F.transform(F.reverse(acc), lambda x: x["state"]), e["to"])
        index = F.size(acc) - at.cast("int")  # from 0, of the last entry of the state
        changed = F.transform(acc, lambda x, i: F.when(i == index, F.struct(x["state"].alias("state"), e["date"].cast("string").alias("date"), x["at"].alias("at"))).otherwise(x))
        popped = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(e["to"].isNull(), acc).when(e["to"] == "-", popped).when((e["source"] == "correction") & (at > 0), changed).otherwise(F.concat(acc, F.array(entry)))

    done = df.groupBy(key).agg(entries.alias("_e")).select(key, F.aggregate("_e", empty, step).alias("_t"))
    ordered = F.array_sort(F.transform("_t", lambda x, i: F.struct(x["date"].alias("date"), i.alias("i"), x["state"].alias("state"))))
    return done.select(key, F.transform(ordered, lambda x: F.struct(x["state"].alias("state"), x["date"].alias("date"))).alias("timeline"))


def assigned_ids(df: DataFrame, id: str, order: str) -> DataFrame:
    """Missing and repeated ids are replaced, in source order, by numbers after the largest one.

    Of a repeated id the first row keeps it. The rows to renumber are numbered range by
    range of the order, each range after those before it, so that no task holds them all.
    """
    first = F.min(order).over(Window.partitionBy(id))
    marked = df.withColumn("_bad", F.col(id).isNull() | (F.col(order) > first))
    top = df.agg(F.coalesce(F.max(id), F.lit(0)).alias("_top"))
    mended = numbered(marked.where("_bad"), order, "_n").join(F.broadcast(top)).withColumn(id, F.col("_top") + F.col("_n")).drop("_n", "_top")  # top is one row
    return marked.where("not _bad").unionByName(mended).drop("_bad")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds the row's number from 1 in ``order`` (without ties): counted by ranges, of which only the counts are summed in one task."""
    parts = written(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    offsets = parts.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", before.alias("_before"))
    r = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return parts.withColumn("_r", r).join(offsets, "_p").withColumn(name, F.col("_before") + F.col("_r")).drop("_p", "_r", "_before")


def anchored_clusters(df: DataFrame, keys: list[str], date: str, days: int, name: str = "cluster") -> DataFrame:
    """keys, date, cluster: runs of dates anchored at their first; a date more than ``days`` after the anchor starts a new run.

    One pass over the distinct dates of each key, whose number the calendar bounds.
    """
    dates = df.where(F.col(date).isNotNull()).select(*keys, F.col(date).cast("date").alias(date)).distinct()
    listed = dates.groupBy(*keys).agg(F.array_sort(F.collect_list(date)).alias("_d"))
    start = F.struct(F.lit(None).cast("date").alias("head"), F.lit(0).alias("n"), F.array().cast("array<struct<d:date,n:int>>").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        new = acc["head"].isNull() | (F.datediff(d, acc["head"]) > days)
        n = acc["n"] + F.when(new, 1).otherwise(0)
        return F.struct(
            F.when(new, d).otherwise(acc["head"]).alias("head"), n.alias("n"), F.concat(acc["out"], F.array(F.struct(d.alias("d"), n.alias("n")))).alias("out")
        )

    runs = listed.select(*keys, F.explode(F.aggregate("_d", start, step, lambda a: a["out"])).alias("r"))
    return runs.select(*keys, F.col("r.d").alias(date), F.col("r.n").alias(name))


def quantiles(df: DataFrame, keys: list[str], value: str, **wanted: tuple[str, float]) -> DataFrame:
    """keys and one column per name of ``wanted``: (``between``, p) interpolates, (``lower``, p) and (``upper``, p) give the value at or after p from below and from above.

    Exact, without gathering a group's values: equal ones are counted first, and the
    running counts of the different values say which stand where. Nulls aren't
    counted; a group without values has null.
    """
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.col(value)).alias("_c"))
    w = Window.partitionBy(*keys)
    placed = counts.withColumn("_n", F.sum("_c").over(w)).withColumn("_b", F.sum("_c").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"))

    def stands(k: Column) -> Column:
        return F.max(F.when((F.col("_b") <= k) & (k < F.col("_b") + F.col("_c")), F.col("_v")))

    out = []
    for name, (kind, p) in wanted.items():
        if kind == "between":
            at = (F.col("_n") - 1) * F.lit(p)
            low, high = stands(F.floor(at)), stands(F.ceil(at))
            out.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
        else:
            k = F.greatest(F.ceil(F.col("_n") * F.lit(p)) - 1, F.lit(0))
            out.append(stands(k if kind == "lower" else F.col("_n") - 1 - k).alias(name))
    return placed.groupBy(*keys).agg(*out)
