"""Deduplicating new batches against all history: incremental record linkage.

The history is a persisted table of blocking keys, bucketed by key, with the first
row that held each key, the fields that are compared, and the row's representative
(the smallest id of its cluster). A new batch is reduced to its keys and probes
that table once; the history is neither shuffled nor written again. Each candidate
pair is scored field by field (board site, posting code, provider id, employer,
title) with weights learned by expectation-maximization over the counts of
agreement patterns (Fellegi-Sunter), and is linked where a match is likelier than
not. Clusters that a batch joins are kept in a union-find mapping (replaced
representative to present one), which is small and is the only thing rewritten.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions.links import once, posting_parts
from ferrule.plans.session import fresh_path, written
from ferrule.plans.skew import salted_lookup

FIELDS = ("site", "code", "provider", "company", "title")
TYPED = ("provider", "company", "title")
#: Starting chance of each agreement level (other, near, same) in a matching and a differing pair.
START_MATCH = {"site": (0.02, 0.01, 0.97), "code": (0.01, 0.01, 0.98), "provider": (0.05, 0.05, 0.9), "company": (0.1, 0.2, 0.7), "title": (0.05, 0.1, 0.85)}
START_OTHER = {"site": (0.9, 0.01, 0.09), "code": (0.7, 0.01, 0.29), "provider": (0.8, 0.1, 0.1), "company": (0.3, 0.2, 0.5), "title": (0.4, 0.2, 0.4)}
LEAST = 1e-4
ENTRY = ("key", "sig", "rep", *FIELDS)


def letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def likeness(a: Column, b: Column) -> Column:
    """2: equal, 1: at most a fifth of the letters differ, 0: other, -1: one is missing."""
    size = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), -1).when(a == b, 2).when(F.levenshtein(a, b) * 5 <= size, 1).otherwise(0)


@dataclass
class Weights:
    """Per field and level: log2 of how much likelier it is in a matching pair; ``base`` is that of a match before any field is seen."""

    levels: dict[str, tuple[float, float, float]]
    base: float = 0.0

    def score(self, levels: dict[str, Column]) -> Column:
        """Above zero where a match is likelier than not."""
        total = F.lit(float(self.base))
        for name, column in levels.items():
            w = self.levels[name]
            total = total + F.when(column == 2, w[2]).when(column == 1, w[1]).when(column == 0, w[0]).otherwise(0.0)
        return total


def learn_weights(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> Weights:
    """Expectation-maximization over (levels of ``FIELDS``, count). Missing levels (-1) say nothing. No patterns: the starting weights."""
    m = {f: list(START_MATCH[f]) for f in FIELDS}
    u = {f: list(START_OTHER[f]) for f in FIELDS}
    share, total = 0.5, sum(c for _, c in patterns)
    for _ in range(rounds if total else 0):
        gm = {f: [LEAST * total] * 3 for f in FIELDS}
        gu = {f: [LEAST * total] * 3 for f in FIELDS}
        matched = 0.0
        for levels, count in patterns:
            a, b = share, 1 - share
            for f, x in zip(FIELDS, levels):
                if x >= 0:
                    a, b = a * m[f][x], b * u[f][x]
            p = a / (a + b) if a + b else 0.0
            matched += p * count
            for f, x in zip(FIELDS, levels):
                if x >= 0:
                    gm[f][x] += p * count
                    gu[f][x] += (1 - p) * count
        share = min(max(matched / total, 0.01), 0.99)
        m = {f: [x / sum(gm[f]) for x in gm[f]] for f in FIELDS}
        u = {f: [x / sum(gu[f]) for x in gu[f]] for f in FIELDS}
    return bounded({f: tuple(math.log2(m[f][i] / u[f][i]) for i in range(3)) for f in FIELDS}, math.log2(share / (1 - share)))


def bounded(levels: dict[str, tuple[float, float, float]], base: float) -> Weights:
    """The weights, kept from outvoting an identity: a code equal on one site links whatever was typed, a different code or site never does.

    Where site or code is missing, the other fields decide with the weights as learned.
    """
    got = {f: tuple(max(-20.0, min(20.0, x)) for x in w) for f, w in levels.items()}
    room = sum(max(0.0, -w[0], -w[1]) for w in (got[f] for f in TYPED))
    sure = got["site"][2] + got["code"][2] + base - room
    if sure <= 0:
        lift = (1.0 - sure) / 2
        got["site"], got["code"] = (*got["site"][:2], got["site"][2] + lift), (*got["code"][:2], got["code"][2] + lift)
    gain = max(0.0, base) + sum(max(0.0, *got[f]) for f in TYPED)
    for a, b in (("site", "code"), ("code", "site")):
        got[a] = (min(got[a][0], -(gain + max(0.0, got[b][2]) + 1.0)), *got[a][1:])
    return Weights(got, base)


class LinkHistory:
    """The persisted blocking-key table, bucketed by key, the representative mapping, and the weights learned from the first batch."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"ferrule_history_{uuid.uuid4().hex}"
        self.weights: Weights | None = None
        self.mapping: DataFrame | None = None
        self.filled = False

    def entries(self) -> DataFrame | None:
        """key, sig, rep and the fields compared; rep as it was when the entry was written."""
        return self.spark.table(self.name) if self.filled else None

    def append(self, rows: DataFrame) -> None:
        """One file a bucket; none is rewritten."""
        w = rows.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").option("path", self.path).format("parquet")
        w.mode("append").saveAsTable(self.name)
        self.filled = True

    def found(self, rows: DataFrame) -> DataFrame:
        """``rows`` with present representatives."""
        if self.mapping is None:
            return rows
        return rows.join(self.mapping, F.col("rep") == F.col("was"), "left").withColumn("rep", F.coalesce("now", "rep")).drop("was", "now")

    def merge(self, moves: DataFrame) -> None:
        """Takes in (was, now), each ``now`` present: mappings to a replaced representative follow it."""
        if self.mapping is not None:
            old, new = self.mapping.alias("o"), moves.alias("n")
            kept = old.join(new, F.col("o.now") == F.col("n.was"), "left").select("o.was", F.coalesce("n.now", "o.now").alias("now"))
            moves = moves.unionByName(kept)
        self.mapping = written(moves, "mapping")

    def close(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")


def records(jobs: DataFrame, *carried: str) -> DataFrame:
    """job_id, key, sig and ``FIELDS`` (and the columns ``carried``): one row per row and blocking key.

    Keys: site and code of either link; provider id and employer, which meet rows whose link
    is missing or names no posting. ``sig`` tells apart what different postings one key may
    stand for. Rows without any key have nothing to be compared by.
    """
    provider = F.nullif(F.lower(F.trim("provider_job_id")), F.lit(""))
    typed = F.struct(provider.alias("provider"), letters(F.col("company")).alias("company"), letters(F.col("title")).alias("title"))
    links = F.array_distinct(F.filter(F.array_distinct(F.array("raw_url", "canonical_url")), lambda u: u.isNotNull()))
    parts = F.array_distinct(F.filter(F.transform(links, posting_parts), lambda p: p.isNotNull()))
    none = F.struct(F.lit(None).cast("string").alias("site"), F.lit(None).cast("string").alias("code"))
    known = F.struct(F.when(F.size(parts) > 0, parts).otherwise(F.array(none)).alias("parts"), typed.alias("typed"))

    def keys(x: Column) -> Column:
        t = x["typed"]
        provided = t["provider"].isNotNull() & (F.coalesce(t["company"], F.lit("")) != "")
        every = F.transform(
            x["parts"],
            lambda p: F.struct(
                p["site"].alias("site"),
                p["code"].alias("code"),
                F.array(
                    F.when(p["code"].isNotNull(), F.concat_ws("|", F.lit("link"), p["site"], p["code"])),
                    F.when(provided, F.concat_ws("|", F.lit("provider"), t["company"], t["provider"])),
                ).alias("keys"),
            ),
        )
        return F.struct(every.alias("every"), t.alias("typed"))

    rows = jobs.where("job_id is not null").select("job_id", *carried, once(known, keys).alias("x"))
    rows = rows.select("job_id", *carried, "x.typed", F.explode("x.every").alias("p"))
    rows = rows.select("job_id", *carried, "typed", "p.site", "p.code", F.explode(F.array_compact("p.keys")).alias("key"))
    sig = F.when(F.col("code").isNotNull(), F.concat_ws("|", "site", "code")).otherwise(F.concat_ws("|", F.lit("-"), "typed.company", "typed.provider"))
    return rows.select("job_id", *carried, "key", sig.alias("sig"), "site", "code", "typed.provider", "typed.company", "typed.title")


def levels_of(a: str, b: str) -> dict[str, Column]:
    c = lambda side, name: F.col(f"{side}.{name}")
    whole = lambda name: F.when(c(a, name).isNull() | c(b, name).isNull(), -1).when(c(a, name) == c(b, name), 2).otherwise(0)
    return {
        "site": whole("site"),
        "code": whole("code"),
        "provider": whole("provider"),
        "company": likeness(c(a, "company"), c(b, "company")),
        "title": likeness(c(a, "title"), c(b, "title")),
    }


def entries_of(rows: DataFrame, id: str) -> DataFrame:
    """The first row of each key and sig."""
    first = rows.groupBy("key", "sig").agg(F.min(F.struct(F.col(id).alias("rep"), *FIELDS)).alias("m"))
    return first.select("key", "sig", "m.rep", *(f"m.{f}" for f in FIELDS))


def candidates(rows: DataFrame, holders: DataFrame) -> DataFrame:
    """job_id, rep and the fields of both (structs a, b): every row with the earlier holders of its keys; a hot key's rows are spread by salt."""
    a = rows.select("job_id", "key", F.struct(*FIELDS).alias("a"))
    b = holders.select("key", "rep", F.struct(*FIELDS).alias("b"))
    return salted_lookup(a, b, "key", "job_id", salts=4, how="inner").where("rep < job_id").select("job_id", "rep", "a", "b")


def pattern_counts(rows: DataFrame, holders: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """How often each pattern of agreement occurs among the candidate pairs of the first batch and among neighbours: at most a few hundred counts.

    Neighbours, rows next to each other in order of key and in order of employer and
    title (hashed into ranges, so that no group is gathered whole), show how differing pairs look.
    """
    side = F.struct("site", "code", "provider", "company", "title")
    got = candidates(rows, holders).select("a", "b")
    for order in (["key"], ["company", "title", "key"]):
        part = F.pmod(F.xxhash64(*order[: max(1, len(order) - 1)]), F.lit(4096))
        w = Window.partitionBy("_g").orderBy(*order, "job_id")
        grained = rows.withColumn("_g", F.concat_ws("/", part, F.pmod(F.floor(F.col("job_id") / 1000), F.lit(64))))
        got = got.unionByName(grained.select(side.alias("a"), F.lag(side).over(w).alias("b")).where("b is not null"))
    one = got.select(*(c.alias(n) for n, c in levels_of("a", "b").items())).groupBy(*FIELDS).count()
    return [(tuple(int(r[f]) for f in FIELDS), int(r["count"])) for r in one.collect()]


def ingest(history: LinkHistory, batch: DataFrame) -> DataFrame:
    """Link one batch to everything accepted before and extend the history.

    Gives first_job_id, job_id, score: every row of the batch whose posting an
    earlier row (of the history or of the batch) holds, where a match is likelier than
    not by the learned weights. A row without code is linked to the first row it matches and
    never makes one of two postings; a row with a code isn't linked to one without. Batches come in order of job_id. Repeated rows and
    a batch seen before change nothing but are reported again; an empty batch gives
    an empty result.
    """
    return ingest_records(history, written(records(batch), "records"))


def ingest_records(history: LinkHistory, rows: DataFrame) -> DataFrame:
    own = entries_of(rows, "job_id")
    old = history.entries()
    if old is not None:
        probed = history.found(old.join(own.select("key").distinct(), "key", "left_semi").select(*ENTRY))
        both = own.withColumn("new", F.lit(True)).unionByName(probed.withColumn("new", F.lit(False)))
        first = both.groupBy("key", "sig").agg(F.min(F.struct("rep", *FIELDS)).alias("m"), F.min("new").alias("new"))
        holders = first.select("key", "sig", "m.rep", *(f"m.{f}" for f in FIELDS), "new")
    else:
        holders = own.withColumn("new", F.lit(True))
    holders = written(holders, "holders")
    if history.weights is None:
        history.weights = learn_weights(pattern_counts(rows, holders))
    met = candidates(rows, holders).where("a.code is null or b.code is not null")
    scored = met.select("job_id", "rep", F.col("a.code").isNotNull().alias("coded"), history.weights.score(levels_of("a", "b")).alias("score")).where("score > 0")
    # A row has few keys, and a key stands for few postings: reps is short.
    low = written(scored.groupBy("job_id").agg(F.min("rep").alias("low"), F.collect_set("rep").alias("reps"), F.max("coded").alias("coded"), F.max("score").alias("score")), "links")
    links = low.select("job_id", F.col("low").alias("rep"), "score")
    # Representatives that are found to be one with a smaller one: two of one row, and rows of this batch that are linked themselves.
    several = low.where("coded and size(reps) > 1").select(F.explode("reps").alias("was"), F.col("low").alias("now")).where("was <> now")
    chained = low.join(low.select(F.explode("reps").alias("job_id")), "job_id", "left_semi").select(F.col("job_id").alias("was"), F.col("low").alias("now"))
    if not several.unionByName(chained).isEmpty():
        moves = joined_clusters(several.unionByName(chained).distinct())
        links = written(links.join(moves, F.col("rep") == F.col("was"), "left").withColumn("rep", F.coalesce("now", "rep")).drop("was", "now"), "links")
        history.merge(moves)
    found = links.where("rep < job_id").select(F.col("rep").alias("first_job_id"), "job_id", "score")
    fresh = holders.where("new").drop("new").join(found.select(F.col("job_id").alias("rep"), "first_job_id"), "rep", "left")
    history.append(fresh.withColumn("rep", F.coalesce("first_job_id", "rep")).select(*ENTRY))
    return found


def joined_clusters(edges: DataFrame) -> DataFrame:
    """(was, now): union-find over pairs of representatives that are one; every one but the smallest of its cluster, with that.

    Each round gives a node the smallest label among its neighbours and follows labels
    once more, until none changes; only clusters that the batch touches take part.
    """
    both = written(edges, "edges").select(F.col("was").alias("x"), F.col("now").alias("y"))
    both = written(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "pairs")
    labels = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("now")).select(F.col("x").alias("was"), "now")
    labels = written(labels, "labels")
    while True:
        near = both.join(labels, F.col("y") == F.col("was")).groupBy("x").agg(F.min("now").alias("near"))
        step = labels.join(near, F.col("was") == F.col("x")).select("was", "now", F.least("now", "near").alias("next"))
        jump = labels.select(F.col("was").alias("via"), F.col("now").alias("far"))
        step = written(step.join(jump, F.col("next") == F.col("via"), "left").select("was", "now", F.least("next", F.coalesce("far", "next")).alias("next")), "labels")
        stable = step.where("next <> now").isEmpty()
        labels = step.select("was", F.col("next").alias("now"))
        if stable:
            return labels.where("was <> now")


def link_batches(jobs: DataFrame, runs: int | None = None) -> DataFrame:
    """All batches of ``jobs`` taken in one after another, as they came: the old stock, then each later one, or these in ``runs - 1`` runs of several.

    The keys of all rows are made once and written by batch, so that each run reads its
    own batches only. Rows without batch number come with the first. Where a later
    row shows two clusters to be one, rows accepted in earlier runs keep the first sighting
    they were reported with; otherwise ``runs`` changes nothing.
    """
    spark = jobs.sparkSession
    number = F.coalesce(F.col("batch_no").cast("int"), F.lit(-(2**31)))
    slim = jobs.select("job_id", number.alias("batch_no"), "canonical_url", "raw_url", "provider_job_id", "company", "title")
    path = fresh_path(spark, "batches")
    keyed = records(slim, "batch_no")
    keyed.write.partitionBy("batch_no").parquet(path)
    every = spark.read.schema(keyed.schema).parquet(path)
    numbers = sorted(r["batch_no"] for r in every.select("batch_no").distinct().collect())  # a row per batch
    if not numbers:
        return spark.createDataFrame([], "first_job_id bigint, job_id bigint, score double")
    if numbers[0] == -(2**31) and len(numbers) > 1:
        numbers = numbers[1:]
    last = numbers if runs is None else sorted({numbers[round((len(numbers) - 1) * i / max(1, runs - 1))] for i in range(max(1, runs))} | {numbers[-1]})
    history = LinkHistory(spark, fresh_path(spark, "history"))
    out, before = None, -(2**32)
    for n in last:
        found = ingest_records(history, every.where((F.col("batch_no") > before) & (F.col("batch_no") <= n)).drop("batch_no"))
        out, before = found if out is None else out.unionByName(found), n
    return out
