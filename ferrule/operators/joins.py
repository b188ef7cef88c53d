"""Joins by equality, absence, similarity and containment, all blocked on equal keys."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.scalars import spaced, token_jaccard
from ferrule.plans.session import spread


def unseen(new: DataFrame, seen: list[DataFrame], key: str, order: str) -> DataFrame:
    """Rows of ``new`` whose key is in none of ``seen``, and of those with one key only the first in order. Null keys are dropped."""
    keys = seen[0].select(key)
    for s in seen[1:]:
        keys = keys.unionByName(s.select(key))
    left = new.where(F.col(key).isNotNull()).join(keys.where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return left.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def phrase_matches(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """key, phrase: texts that hold a phrase as whole words, without regard to case and marks.

    Texts are cut into runs of as many words as phrases have, and joined by
    equality. Phrases without words match nothing.
    """
    known = phrases.select(F.col(phrase).alias("phrase")).distinct().withColumn("_run", spaced(F.col("phrase"))).where("_run <> ''")
    known = known.withColumn("_n", F.size(F.split("_run", " ")))
    sizes = sorted(r["_n"] for r in known.select("_n").distinct().collect())  # the different lengths only
    words = spread(texts.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_x"))).select("_k", F.split(spaced(F.col("_x")), " ").alias("_w"))

    def runs(n: int) -> Column:
        last = F.size("_w") - n + 1
        made = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice("_w", i, n), " "))
        return F.when(last >= 1, made).otherwise(F.array().cast("array<string>"))

    if not sizes:
        return texts.select(F.col(key), F.lit(None).cast("string").alias("phrase")).limit(0)
    each = words.select("_k", F.explode(F.array_distinct(F.concat(*(runs(n) for n in sizes)))).alias("_run"))
    return each.join(known.select("_run", "phrase"), "_run").select(F.col("_k").alias(key), "phrase").distinct()


def similar_token_sets(df: DataFrame, key: str, tokens: str, at_least: float, least_shared: int = 2) -> DataFrame:
    """a, b, similarity: pairs of rows whose token sets have a Jaccard similarity of ``at_least`` and share ``least_shared`` tokens.

    Exact: of each set only its rarest tokens, as many as a similar set can't
    miss, are joined, and the pairs verified. Rows with few tokens or null keys
    pair with nothing.
    """
    sets = df.select(F.col(key).alias("k"), F.array_distinct(F.col(tokens)).alias("t")).where(F.size("t") >= least_shared).where("k is not null")
    each = sets.select("k", F.size("t").alias("n"), F.explode("t").alias("w"))
    counts = each.groupBy("w").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy("df", "w"))
    prefix = each.join(counts, "w").withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * at_least) + 1)
    a = prefix.select(F.col("k").alias("a"), F.col("n").alias("na"), "w")
    b = prefix.select(F.col("k").alias("b"), F.col("n").alias("nb"), "w")
    near = (F.col("a") < F.col("b")) & (F.col("na") >= F.col("nb") * at_least) & (F.col("nb") >= F.col("na") * at_least)
    pairs = a.join(b, "w").where(near).select("a", "b").distinct()
    full = pairs.join(sets.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(sets.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
    scored = full.withColumn("similarity", token_jaccard(F.col("ta"), F.col("tb")))
    return scored.where((F.col("similarity") >= at_least) & (F.size(F.array_intersect("ta", "tb")) >= least_shared)).select("a", "b", "similarity")


def near_fingerprints(df: DataFrame, key: str, fingerprint: str, bits: int = 5) -> DataFrame:
    """a, b, distance: pairs of different 64-bit fingerprints at most ``bits`` apart; keys that share one fingerprint are one row, of the smallest key.

    Exact by the pigeonhole: cut into ``bits + 2`` bands, two such fingerprints agree in two, so
    that every two bands together are a key, of 18 bits for the usual five.
    """
    one = df.where(F.col(fingerprint).isNotNull()).groupBy(F.col(fingerprint).alias("f")).agg(F.min(key).alias("k"))
    bands = bits + 2
    edges = [64 * i // bands for i in range(bands + 1)]

    def band(i: int) -> Column:
        width = edges[i + 1] - edges[i]
        return F.shiftrightunsigned("f", edges[i]).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))

    cut = [F.struct(F.lit(i * bands + j).alias("i"), band(i).alias("v"), band(j).alias("w")) for i, j in combinations(range(bands), 2)]
    each = one.select("k", "f", F.explode(F.array(*cut)).alias("c")).select("k", "f", "c.i", "c.v", "c.w")
    a, b = each.select(F.col("k").alias("a"), F.col("f").alias("fa"), "i", "v", "w"), each.select(F.col("k").alias("b"), F.col("f").alias("fb"), "i", "v", "w")
    far = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))
    return a.join(b, ["i", "v", "w"]).where("a < b").withColumn("distance", far).where(F.col("distance") <= bits).select("a", "b", "distance").distinct()


def cross_listings(df: DataFrame, key: str, fingerprint: str, owner: str, link: str, bits: int = 5) -> DataFrame:
    """a, b, distance: rows whose fingerprints are at most ``bits`` apart under different owners and links.

    Rows equal in fingerprint, owner and link are copies, and the smallest key stands for
    them. Of one fingerprint under several owners, the smallest key is given with those of
    every other owner, at distance 0, instead of all pairs; fingerprints that differ are paired in full. Null
    fingerprints and keys are left out; a null owner or link is a value of its own.
    """
    rows = df.select(F.col(key).alias("k"), F.col(fingerprint).alias("f"), F.coalesce(F.col(owner), F.lit("")).alias("o"), F.coalesce(F.col(link), F.lit("")).alias("l")).where("f is not null and k is not null")
    nodes = rows.groupBy("f", "o", "l").agg(F.min("k").alias("k"))
    first = nodes.groupBy("f").agg(F.min(F.struct("k", "o", "l")).alias("m")).select("f", F.col("m.k").alias("ka"), F.col("m.o").alias("oa"), F.col("m.l").alias("la"))
    apart = (F.col("oa") != F.col("ob")) & (F.col("la") != F.col("lb"))
    other = nodes.select("f", F.col("k").alias("kb"), F.col("o").alias("ob"), F.col("l").alias("lb"))
    equal = first.join(other, "f").where(apart).select("ka", "kb", F.lit(0).alias("distance"))
    near = near_fingerprints(first.select(F.col("ka").alias("k"), "f"), "k", "f", bits)
    of = first.select("f", F.col("ka").alias("rep"))
    sides = near.join(of.select(F.col("rep").alias("a"), F.col("f").alias("fa")), "a").join(of.select(F.col("rep").alias("b"), F.col("f").alias("fb")), "b").select("fa", "fb", "distance")
    left = nodes.select(F.col("f").alias("fa"), F.col("k").alias("ka"), F.col("o").alias("oa"), F.col("l").alias("la"))
    far = sides.join(left, "fa").join(other.withColumnRenamed("f", "fb"), "fb").where(apart).select("ka", "kb", "distance")
    return equal.unionByName(far).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "distance").distinct()


def best_name_match(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """name, match, tier: for each distinct left name the best right one: 0 equal, 1 the right begins with it, 2 it begins with the right.

    Names are compared as ``spaced`` words and whole words only; names of fewer
    than four letters match nothing but themselves. Every beginning of a name by
    words is a key, so that all tiers are joins by equality. Equal tiers go to the
    longer, then to the smaller match.
    """

    def keyed(df: DataFrame, out: str) -> DataFrame:
        d = df.select(F.col(name).alias(out)).where(F.col(name).isNotNull()).distinct()
        return d.withColumn(f"{out}_s", spaced(F.col(out))).where(F.col(f"{out}_s") != "")

    def beginnings(c: Column) -> Column:
        w = F.split(c, " ")
        return F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_join(F.slice(w, 1, i), " "))

    x, y = keyed(left, "x"), keyed(right, "y")
    whole = x.join(y.withColumn("b", F.explode(beginnings(F.col("y_s")))), F.col("x_s") == F.col("b")).where((F.length("x_s") >= 4) | (F.col("x_s") == F.col("y_s")))
    part = x.withColumn("b", F.explode(beginnings(F.col("x_s")))).join(y, F.col("b") == F.col("y_s")).where((F.length("y_s") >= 4) & (F.col("x_s") != F.col("y_s")))
    tier = F.when(F.col("x_s") == F.col("y_s"), 0).otherwise(1)
    found = whole.select("x", "y", tier.alias("tier"), F.length("y_s").alias("n")).unionByName(part.select("x", "y", F.lit(2).alias("tier"), F.length("y_s").alias("n")))
    best = found.groupBy("x").agg(F.min(F.struct("tier", (-F.col("n")).alias("n"), "y")).alias("m"))
    return best.select(F.col("x").alias(name), F.col("m.y").alias("match"), F.col("m.tier").alias("tier"))


def nearest_vectors(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """query, neighbour, rank, cosine: the ``k`` nearest rows of each query row, itself left out; equal cosines by the smaller key.

    Queries are taken in blocks of ``block``; each block is multiplied with all
    rows where they lie, and only the ``k`` best of a batch are passed on.
    """
    spark = vectors.sparkSession
    schema = "query bigint, neighbour bigint, cosine double"
    out = spark.createDataFrame([], schema)
    rows: list[tuple[int, list[float]]] = []

    def one_block(block_rows: list[tuple[int, list[float]]]) -> DataFrame:
        ids = np.array([i for i, _ in block_rows], dtype=np.int64)
        m = np.array([v for _, v in block_rows], dtype=np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((ids, m))

        def run(batches):
            q, mat = shared.value
            for b in batches:
                v = np.stack(b["v"].to_numpy()).astype(np.float64)
                keys = b["k"].to_numpy()
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                s = mat @ v.T
                s[keys[None, :] == q[:, None]] = -np.inf
                got = []
                for i in range(len(q)):
                    top = np.lexsort((keys, -s[i]))[: k + 1]
                    got += [(q[i], keys[j], s[i, j]) for j in top if s[i, j] > -np.inf][:k]
                yield pd.DataFrame(got, columns=["query", "neighbour", "cosine"])

        return vectors.select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v")).where("v is not null").mapInPandas(run, schema)

    for r in queries.select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v")).where("v is not null").toLocalIterator():
        rows.append((r["k"], r["v"]))
        if len(rows) == block:
            out, rows = out.unionByName(one_block(rows)), []
    if rows:
        out = out.unionByName(one_block(rows))
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "neighbour", "rank", "cosine")


def best_or_ambiguous(keys: DataFrame, scored: DataFrame, key: str, choice: str, score: str) -> DataFrame:
    """key, choice, verdict: the choice of highest score of each of ``keys``; ``ambiguous`` (and no choice) where several share it, ``none`` without any.

    ``scored``: key, choice, score. Null scores don't count; repeated rows count once.
    """
    top = scored.where(F.col(score).isNotNull()).select(key, choice, score).distinct()
    best = top.groupBy(key).agg(F.max(score).alias("_s"))
    tied = top.join(best, key).where(F.col(score) == F.col("_s")).groupBy(key).agg(F.count("*").alias("_n"), F.min(choice).alias("_c"))
    out = keys.select(key).distinct().join(tied, key, "left")
    verdict = F.when(F.col("_n").isNull(), "none").when(F.col("_n") > 1, "ambiguous").otherwise("match")
    return out.select(key, F.when(F.col("_n") == 1, F.col("_c")).alias(choice), verdict.alias("verdict"))
