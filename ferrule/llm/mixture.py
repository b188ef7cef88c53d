"""Mixing sources to target weights: Efraimidis-Spirakis sampling to token budgets.

Every document gets the key ``-ln(u) / w``, with ``u`` a uniform number hashed
from its id and ``w`` its quality weight; ascending keys are weighted sampling
without replacement. Within a source the documents are taken in key order up to
the source's token budget. Whole epochs come first: a budget of 2.4 times the
source's tokens takes every document twice and 0.4 of the tokens a third time.

The running token sums are found without gathering a source in one task: keys
are counted in fixed grains, sums over grains (bounded in number) locate the
grain in which the budget ends, and only the documents of that grain are sorted.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.plans.session import spread, written

GRAINS = 4096


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The vocabulary file of a public tokenizer; pass another path where it lies elsewhere."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


_ENCODINGS: dict = {}


def token_counts(documents: DataFrame, text: str = "text", into: str = "tokens", vocabulary: str | None = None) -> DataFrame:
    """Adds the number of tokens of each text (0 for null and empty ones), by a byte-level BPE vocabulary file of ranks."""
    path = vocabulary or tokenizer_path()

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import public_tokenizers
        import tiktoken

        if path not in _ENCODINGS:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        encoding = _ENCODINGS[path]
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in texts], index=texts.index, dtype="int32")

    return documents.withColumn(into, count(F.col(f"`{text}`")))


def quality(text: Column) -> Column:
    """Weight in (0, 1]: the share of letters and blanks, lower for very short texts."""
    size = F.length(text)
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\s]", ""))
    return F.greatest(F.lit(0.05), plain / F.greatest(size, F.lit(1)) * F.least(F.lit(1.0), size / 200))


def uniform(*keys: str) -> Column:
    """A number in (0, 1), the same for the same keys wherever and however often it is computed."""
    return (F.pmod(F.xxhash64(*keys, F.lit(20240701)), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """source, target_share, max_repeats, own_tokens, budget: how many tokens each source is to give.

    Without ``total_tokens`` the total is the largest at which every source that
    has tokens reaches its share without exceeding its repeats, so that the shares
    are met; sources without tokens leave their share to the others in proportion.
    With it, sources that can't reach their share give all they may and the rest is
    shared out among the others in the same proportion, once. Targets with a null
    or non-positive share or repeats below one give nothing; a source named twice
    counts with its shares added and its largest repeats.
    """
    goal = (
        targets.where("source is not null and target_share > 0 and max_repeats >= 1")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    t = goal.join(sizes, "source", "left").withColumn("own_tokens", F.coalesce("own_tokens", F.lit(0)).cast("long"))
    t = t.withColumn("most", F.when(F.col("own_tokens") > 0, F.col("own_tokens") * F.col("max_repeats")).otherwise(0))
    every = Window.partitionBy(F.lit(1))  # one row per target
    present = F.col("most") > 0
    t = t.withColumn("share", F.when(present, F.col("target_share") / F.sum(F.when(present, F.col("target_share"))).over(every)).otherwise(0.0))
    if total_tokens is None:
        total = F.min(F.when(present, F.col("most") / F.col("share"))).over(every)
        return t.withColumn("budget", F.floor(F.coalesce(total * F.col("share"), F.lit(0.0)) + 1e-6).cast("long")).drop("most", "share")
    t = t.withColumn("want", F.lit(float(total_tokens)) * F.col("share")).withColumn("give", F.least("want", "most"))
    free = F.col("give") < F.col("most")
    lack = F.lit(float(total_tokens)) - F.sum("give").over(every)
    room = F.sum(F.when(free, F.col("share"))).over(every)
    t = t.withColumn("budget", F.floor(F.when(free & (room > 0), F.least(F.col("give") + lack * F.col("share") / room, "most")).otherwise(F.col("give")) + 1e-6).cast("long"))
    return t.drop("most", "share", "want", "give")


def sized(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, tokens, order_key: written out once, since counting tokens is the costly part."""
    slim = documents.where("doc_id is not null and source is not null").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    counted = token_counts(spread(slim), "text", "tokens", vocabulary)
    key = -F.log(uniform("doc_id")) / quality(F.col("text"))
    return written(counted.select("doc_id", "source", "tokens", key.alias("order_key")), "sized")


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, tokens, copies: the documents to use and how often, at least once each.

    In every source the tokens taken reach the budget of ``plan`` without
    exceeding it; what is missing is less than the first document that no longer
    fits. No document is used more than max_repeats times. Documents without
    tokens, null ids or sources aren't used; a document given twice counts twice.
    Equal keys are ordered by doc_id.
    """
    docs = sized(documents, vocabulary).where("tokens > 0")
    sizes = docs.groupBy("source").agg(F.sum("tokens").alias("own_tokens"))
    budgets = written(plan(sizes, targets, total_tokens).where("budget > 0"), "budgets")
    epochs = F.floor(F.col("budget") / F.col("own_tokens")).cast("int")
    budgets = budgets.select("source", "max_repeats", epochs.alias("epochs"), (F.col("budget") - epochs * F.col("own_tokens")).alias("rest"))
    grain = F.least(F.lit(GRAINS - 1), F.floor((1 - F.exp(-F.col("order_key"))) * GRAINS)).cast("int")
    placed = docs.join(budgets, "source").withColumn("grain", grain)
    sums = placed.groupBy("source", "grain").agg(F.sum("tokens").alias("grain_tokens"))  # at most GRAINS rows a source
    running = Window.partitionBy("source").orderBy("grain").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("grain_tokens").over(running), F.lit(0)))
    edge = written(
        budgets.join(starts, "source")
        .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("grain_tokens") > F.col("rest")))
        .select("source", F.col("grain").alias("edge"), F.col("before").alias("edge_before")),
        "edges",
    )
    marked = placed.join(edge, "source")
    below = marked.where(F.col("grain") < F.col("edge")).withColumn("extra", F.lit(1))
    beyond = marked.where(F.col("grain") > F.col("edge")).withColumn("extra", F.lit(0))
    order = Window.partitionBy("source", "edge").orderBy("order_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at = marked.where(F.col("grain") == F.col("edge")).withColumn("sum", F.sum("tokens").over(order))
    at = at.withColumn("extra", F.when(F.col("edge_before") + F.col("sum") <= F.col("rest"), 1).otherwise(0)).drop("sum")
    chosen = below.unionByName(beyond).unionByName(at)
    copies = F.least(F.col("epochs") + F.col("extra"), F.col("max_repeats")).cast("int")
    return chosen.select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str | None = None) -> DataFrame:
    """source, target_share, used_documents, used_tokens, actual_share, most_copies: one row per target source, absent ones with zeros."""
    used = mixture(documents, targets, total_tokens, vocabulary).groupBy("source").agg(
        F.count("*").alias("used_documents"), F.sum(F.col("tokens").cast("long") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies")
    )
    goal = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    every = Window.partitionBy(F.lit(1))
    joined = goal.join(used, "source", "left").na.fill(0, ["used_documents", "used_tokens", "most_copies"])
    total = F.sum("used_tokens").over(every)
    return joined.select(
        "source", "target_share", "used_documents", "used_tokens", F.when(total > 0, F.col("used_tokens") / total).otherwise(0.0).alias("actual_share"), "most_copies"
    )
