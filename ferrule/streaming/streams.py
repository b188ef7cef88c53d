"""The ordered operators over streams: the same rows as in batch, as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def status_changes(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, order, value: events whose value differs from the key's last one.

    Events of one key within a trigger are put in order; one that is older than
    the last seen is late and skipped, as it can't change what was reported. The
    state is one value per key. Null values count as values.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, None)
        known = state.exists
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = []
        for o, v in zip(rows[order], rows[value]):
            v = None if pd.isna(v) else v
            if at is not None and o < at:
                continue
            if not known or v != last:
                out.append((k[0], o, v))
            last, at, known = v, o, True
        if known:
            state.update((last, at))
        yield pd.DataFrame(out, columns=[key, order, value])

    return events.select(key, order, value).groupBy(key).applyInPandasWithState(
        run, schema, f"last {kinds[value]}, at {kinds[order]}", "append", GroupStateTimeout.NoTimeout
    )


def first_seen(postings: DataFrame, key: str, time: str, within: str = "90 days") -> DataFrame:
    """The first row of each key; repeats within the span are dropped, and keys are forgotten after it."""
    return postings.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def weekly_counts(events: DataFrame, time: str, by: str, late: str = "7 days") -> DataFrame:
    """week_start, by, n: counts by week from Monday; a week is given out once no later rows are awaited for it."""
    weeks = F.window(time, "7 days", "7 days", "4 days")  # the epoch began on a Thursday
    g = events.withWatermark(time, late).groupBy(weeks.alias("w"), by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("week_start"), by, "n")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """start_at, end_at, by, n: runs of a key's events with no gap longer than the given one. Engine extra."""
    g = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), by, "n")


def upsert_into(table, key: str, merge):
    """A ``foreachBatch`` function: ``merge(current, batch)`` becomes the table's next version (``VersionedTable``)."""

    def run(batch: DataFrame, _: int) -> None:
        current = table.read()
        rows = batch if current is None else merge(current, batch)
        table.replace(rows)

    return run
