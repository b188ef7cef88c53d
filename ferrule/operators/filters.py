"""Predicates compiled from settings, ordered filter cascades and query specifications."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyword(text: Column, word: str) -> Column:
    """Words of two or three letters must stand alone; longer ones may be part of another word. Case doesn't count."""
    w = word.lower()
    return F.lower(text).rlike(rf"\b{w}\b") if len(w) <= 3 and w.isalnum() else F.lower(text).contains(w)


def any_of(conditions: list[Column], empty: bool = False) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(empty)


def title_filter(title: Column, positive: list[str], negative: list[str]) -> Column:
    """At least one positive keyword (none given: all pass) and no negative one. A null title passes nothing but an empty list."""
    t = F.coalesce(title, F.lit(""))
    return any_of([keyword(t, w) for w in positive], empty=True) & ~any_of([keyword(t, w) for w in negative])


def matched_keywords(title: Column, words: list[str]) -> Column:
    t = F.coalesce(title, F.lit(""))
    return F.array_compact(F.array(*(F.when(keyword(t, w), F.lit(w)) for w in words)))


def place_filter(place: Column, allow: list[str], block: list[str], always: list[str] = ()) -> Column:
    """Blank passes; always-allowed beats blocked, blocked beats allowed, and with nothing allowed all else passes."""
    p = F.lower(F.coalesce(place, F.lit("")))
    has = lambda words: any_of([p.contains(w.lower()) for w in words])
    return F.when(F.trim(p) == "", True).when(has(always), True).when(has(block), False).when(F.lit(not allow), True).otherwise(has(allow))


def at_least_as_new(when: Column, cutoff: Column) -> Column:
    """Unknown dates pass."""
    return when.isNull() | (when >= cutoff)


def ranges_overlap(low: Column, high: Column, least: float | None, most: float | None) -> Column:
    """Missing ends mirror the other one; a row without both passes; a reversed or empty setting filters nothing."""
    if (least is None and most is None) or (least is not None and most is not None and least > most):
        return F.lit(True)
    a, b = F.coalesce(low, high), F.coalesce(high, low)
    ok = F.lit(True)
    if least is not None:
        ok = ok & (b >= least)
    if most is not None:
        ok = ok & (a <= most)
    return a.isNull() | ok


def first_reject(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule whose condition (true: rejected) holds; null: kept. Later rules aren't looked at."""
    out = F.lit(None).cast("string")
    for name, rejects in reversed(rules):
        out = F.when(rejects, F.lit(name)).otherwise(out)
    return out


def date_class(when: Column, cutoff: Column) -> Column:
    return F.when(when.isNull(), "undated").when(when < cutoff, "stale").otherwise("keep")


@dataclass
class Spec:
    """A query over one table: equal values, patterns, least values, order and limit. ``build`` applies them all."""

    equal: dict[str, object] = field(default_factory=dict)
    like: dict[str, str] = field(default_factory=dict)  # % and _ are wildcards, case doesn't count
    least: dict[str, object] = field(default_factory=dict)
    needle: tuple[tuple[str, ...], str] | None = None  # columns, any of which must hold the text
    order: list[tuple[str, bool]] = field(default_factory=list)  # column, descending
    limit: int | None = None
    columns: list[str] | None = None

    def build(self, df: DataFrame) -> DataFrame:
        for c, v in self.equal.items():
            df = df.where(F.col(c) == F.lit(v))
        for c, v in self.like.items():
            df = df.where(F.col(c).ilike(v))
        for c, v in self.least.items():
            df = df.where(F.col(c) >= F.lit(v))
        if self.needle:
            names, text = self.needle
            df = df.where(any_of([F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.lower()) for c in names]))
        if self.order:
            df = df.orderBy(*(F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in self.order))
        if self.limit is not None:
            df = df.limit(max(0, self.limit))
        return df.select(*self.columns) if self.columns else df

    @classmethod
    def from_params(cls, params: dict[str, str], most: int = 500) -> Spec:
        """From a link's parameters: status, company, since, limit (1 to ``most``); unknown ones and bad numbers are ignored."""
        spec = cls()
        if params.get("status"):
            spec.equal["status"] = params["status"]
        if params.get("company"):
            spec.like["company"] = f"%{params['company']}%"
        if params.get("since"):
            spec.least["date"] = params["since"]
        if params.get("limit", "").isdigit():
            spec.limit = min(max(int(params["limit"]), 1), most)
        return spec
