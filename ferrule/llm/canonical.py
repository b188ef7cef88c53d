"""Mapping free-entered values to a canonical list.

Token-level repair: each distinct token of the typed values is joined to the
reference vocabulary by edit distance (over deletion neighbourhoods, so that the
join is one of equality), and the repaired tokens are combined with soft TF-IDF
to rank complete entries. Only distinct values pass through the ranking; rows
are joined to its result afterwards.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.plans.session import spread, written
from ferrule.plans.skew import salted_lookup

#: What a value may carry besides the entry itself.
DECORATION = r"\([^)]*\)|\d{1,4}[-./]\d{1,2}[-./]\d{1,4}"


def tokens_of(value: Column) -> Column:
    """Lower-case runs of letters (with a full stop right after kept as the mark of an abbreviation), without dates and bracketed asides that follow other text."""
    low = F.lower(value)
    bare = F.regexp_replace(low, DECORATION, " ")
    text = F.when(F.regexp_replace(bare, r"[^\p{L}]", "") == "", low).otherwise(bare)
    return F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), 1)


def neighbourhood(word: Column) -> Column:
    """The word and every string left after deleting one or two of its characters."""

    def one(x: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.length(x)),
            lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))),
        )

    first = F.when(F.length(word) > 2, one(word)).otherwise(F.array().cast("array<string>"))
    second = F.flatten(F.transform(first, lambda y: F.when(F.length(y) > 2, one(y)).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(F.array(word), first, second))


def first_threes(word: Column) -> Column:
    """The first letter with every two later ones, in order."""
    at = F.sequence(F.lit(2), F.length(word) - 1)
    pairs = F.transform(at, lambda i: F.transform(F.sequence(i + 1, F.length(word)), lambda k: F.concat(F.substring(word, 1, 1), F.substring(word, i, F.lit(1)), F.substring(word, k, F.lit(1)))))
    return F.array_distinct(F.flatten(pairs))


def edit_distance(a: str, b: str) -> int:
    """Edits between two words: insert, delete or change a letter, or swap two neighbours, between which letters may be put in or lost."""
    far = len(a) + len(b)
    table = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        table[i + 1][1] = i
    for j in range(len(b) + 1):
        table[1][j + 1] = j
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        matched = 0
        for j, y in enumerate(b, 1):
            row, column = seen.get(y, 0), matched
            if x == y:
                matched = j
            table[i + 1][j + 1] = min(
                table[i][j] + (x != y),
                table[i + 1][j] + 1,
                table[i][j + 1] + 1,
                table[row][column] + (i - row - 1) + 1 + (j - column - 1),
            )
        seen[x] = i
    return table[-1][-1]


@F.pandas_udf(T.IntegerType())
def edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x, y) for x, y in zip(a, b)], index=a.index, dtype="int32")


def token_repairs(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """token, word, sim: for each distinct ``token`` the vocabulary ``word`` it may stand for.

    Words within two edits (one for tokens under four letters unless they begin
    alike; equal only below three), and words that the token abbreviates: it is their beginning, or has at
    least half of their letters in order from the first one on.
    """
    longest = vocabulary.agg(F.max(F.length("word"))).first()[0] or 0
    near = tokens.where((F.length("token") >= 3) & (F.length("token") <= longest + 2))
    a = near.select("token", F.explode(neighbourhood(F.col("token"))).alias("part"))
    b = vocabulary.where(F.length("word") >= 3).select("word", F.explode(neighbourhood(F.col("word"))).alias("part"))
    few = F.expr("case when least(length(token), length(word)) >= 4 or (length(word) >= 5 and left(token, 1) = left(word, 1)) then 2 else 1 end")
    # Two edits, a swap among them, are at most four changes of single letters; only where swaps may have saved some is Python asked.
    plain = F.expr("levenshtein(token, word, 4)")
    pairs = a.join(b, "part").where("token <> word").select("token", "word").distinct().withColumn("plain", plain).where("plain >= 0").withColumn("few", few)
    close = (
        pairs.withColumn("d", F.when(F.col("plain") <= 1, F.col("plain")).otherwise(edits("token", "word")))
        .withColumn("size", F.greatest(F.length("token"), F.length("word")))
        .where("d <= few and d * 2 < size")
        .select("token", "word", (1 - F.col("d") / F.col("size")).alias("sim"))
    )
    # Beginnings, and the first three letters of what may be left of a word: joins by equality.
    prefixes = vocabulary.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("word") - 1)), lambda i: F.substring(F.col("word"), F.lit(1), i))).alias("token"))
    begun = near.join(prefixes, "token").where("length(token) < length(word)").select("token", "word")
    left = near.where("length(token) >= 4").select("token", F.substring("token", 1, 3).alias("three"))
    thrice = vocabulary.where("length(word) > 4").select("word", F.explode(first_threes(F.col("word"))).alias("three"))
    within = left.join(thrice, "three").where("length(token) < length(word) and length(token) * 2 >= length(word) and word rlike concat('^', regexp_replace(token, '(.)', '$1.*'), '$')")
    short = begun.unionByName(within.select("token", "word")).select("token", "word", F.lit(0.8).alias("sim"))
    same = tokens.join(vocabulary, F.col("token") == F.col("word")).select("token", "word", F.lit(1.0).alias("sim"))
    return same.unionByName(close).unionByName(short).groupBy("token", "word").agg(F.max("sim").alias("sim"))


def rank_entries(values: DataFrame, entries: DataFrame, at_least: float = 0.6) -> DataFrame:
    """value, label, score: the best entry of each distinct ``value`` scoring at least ``at_least``.

    ``entries``: label, spelling. A value is scored by soft TF-IDF over its tokens,
    and by the similarity of its letters run together, which mends blanks lost or
    put in. Equal scores go to the first label by code point. Null and empty
    values, and values without letters, rank nothing. Values may repeat.
    """
    known = entries.where("spelling is not null and label is not null").select("label", "spelling").distinct()
    known = known.withColumn("words", F.array_distinct(tokens_of(F.col("spelling")))).where("size(words) > 0")
    n = known.count()
    terms = known.select("label", "spelling", F.explode("words").alias("word"))
    idf = terms.groupBy("word").agg(F.log(1 + F.lit(n) / F.count_distinct("spelling")).alias("idf"))
    spelled = terms.join(idf, "word")
    norms = spelled.groupBy("spelling", "label").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))

    forms = values.select("value").distinct().withColumn("tokens", F.array_distinct(tokens_of(F.col("value")))).where("size(tokens) > 0")
    keyed = forms.select("value", F.array_join(F.array_sort("tokens"), " ").alias("form"), F.array_join(tokens_of(F.col("value")), "").alias("letters"))
    keyed = written(spread(keyed), "values")
    typed = keyed.select("form").distinct().select("form", F.explode(F.split("form", " ")).alias("token"))
    runs = known.select("label", F.array_join(tokens_of(F.col("spelling")), "").alias("word"))

    repairs = token_repairs(
        typed.select("token").union(keyed.select("letters")).distinct(),
        idf.select("word").union(runs.select("word")).distinct(),
    )
    repairs = written(repairs, "repairs")
    rarest = float(idf.agg(F.max("idf")).first()[0] or 1.0)
    weighed = typed.join(repairs, "token", "left").join(idf, "word", "left")
    token_weight = weighed.groupBy("form", "token").agg(F.coalesce(F.max(F.struct("sim", "idf")).getField("idf"), F.lit(rarest)).alias("w"))
    form_norm = token_weight.groupBy("form").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("form_norm"))
    soft = (
        typed.join(repairs, "token")
        .join(spelled, "word")
        .groupBy("form", "spelling", "label", "token")
        .agg(F.max(F.struct("sim", "idf")).alias("m"))
        .join(token_weight, ["form", "token"])
        .groupBy("form", "spelling", "label")
        .agg(F.sum(F.col("m.sim") * F.col("m.idf") * F.col("w")).alias("dot"))
        .join(norms, ["spelling", "label"])
        .join(form_norm, "form")
        .select("form", "label", (F.col("dot") / F.col("norm") / F.col("form_norm")).alias("score"))
    )
    by_form = keyed.join(soft, "form").select("value", "label", "score")
    by_run = keyed.join(repairs, F.col("letters") == F.col("token")).join(runs, "word").select("value", "label", F.col("sim").alias("score"))
    best = by_form.unionByName(by_run).where(F.col("score") >= at_least)
    return best.groupBy("value", "label").agg(F.max("score").alias("score")).groupBy("value").agg(
        F.min(F.struct((-F.col("score")).alias("less"), "label")).alias("b")
    ).select("value", F.col("b.label").alias("label"), (-F.col("b.less")).alias("score"))


def map_values(rows: DataFrame, value: str, key: str, entries: DataFrame, unmatched: str = "unmatched", at_least: float = 0.6) -> DataFrame:
    """key, value, label, score of each row whose ``value`` isn't exactly a label.

    Rows resembling no entry, and null or empty ones, come out as ``unmatched``
    with a null score. Repeated rows give repeated results.
    """
    slim = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("value"))
    labels = entries.select(F.col("label").alias("value")).where("value is not null").distinct()
    other = slim.join(labels, "value", "left_anti")
    best = written(rank_entries(other.select("value"), entries, at_least), "ranked")
    return salted_lookup(other, best, "value", "key").withColumn("label", F.coalesce("label", F.lit(unmatched)))


def status_states(applications: DataFrame, status_events: DataFrame, states: DataFrame) -> DataFrame:
    """tab, row_id, state, score of each status that isn't exactly a state label."""
    entries = states.select(F.col("state_label").alias("label"), "spelling")
    both = applications.select(F.struct(F.lit("applications").alias("tab"), F.col("id").alias("row_id")).alias("key"), "status").unionByName(
        status_events.select(F.struct(F.lit("status_events").alias("tab"), F.col("id").alias("row_id")).alias("key"), "status")
    )
    got = map_values(both, "status", "key", entries)
    return got.select(F.col("key.tab").alias("tab"), F.col("key.row_id").alias("row_id"), F.col("label").alias("state"), "score", F.col("value").alias("status"))
