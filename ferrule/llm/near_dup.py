"""Near-duplicate records with small edits: a chosen-path similarity join.

A record is its set of runs of three words. A path is grown from the root by
choosing, at each node, a few of the record's sampled tokens (consistent samples,
all tokens alike); two records stay together along a branch with the chance of
their Jaccard similarity. A record needs only itself to grow its paths, so the
first levels are taken in one stride. Records with the same path form a bucket:
small buckets are compared pair by pair on bit sketches, others are split further
along three more branches at a time, until they are small or their records are so
alike that their pairs are the result; those are compared block by block. All is
repeated in independent runs, as many as the target recall needs for a pair right
at the similarity, however deep its buckets are split (``least_recall``).
Pairs that remain are verified exactly.

Records equal in their words are joined once, by their representative.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import comb, erf

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.plans.session import spread, written
from ferrule.plans.skew import salted_lookup

WORD = re.compile(r"[^\W_]+")
SAMPLES = 128  # samples of a record that paths choose from
SKETCH = 192  # drawn tokens by two bits of which records of a bucket are compared
BRANCHES = 3  # at every level: with less than 1 / similarity the recall would fall with each split
FIRST = 2  # levels taken in one stride, whatever the number of records
MISSES = 3.3  # standard deviations by which the sketches of a pair may fall short
WORDS = ("s0", "s1", "s2", "s3", "s4", "s5")  # columns of a sketch
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hash of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=300_000)
def word_hash(word: str) -> int:
    """Signed 64-bit hash."""
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def shingles(text: str, words: int = 3) -> np.ndarray:
    """Hashes of the different runs of consecutive words."""
    h = np.fromiter(map(word_hash, WORD.findall(text.lower())), dtype=np.int64).view(np.uint64)
    n = len(h) - words + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(words):
        out = mixed(out * M1 + h[i : i + n] + np.uint64(i))
    return np.unique(out)


BRANCH_SALTS = mixed(np.arange(20_001, 20_009, dtype=np.uint64) * M1)
DRAWS = mixed(np.arange(1, 2 * (SAMPLES + SKETCH) + 1, dtype=np.uint64) * M1)
DRAW_SALTS = (DRAWS[: SAMPLES + SKETCH] >> np.uint64(32)).astype(np.uint32)[:, None]
DRAW_FACTORS = (DRAWS[SAMPLES + SKETCH :] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)


def drawn_tokens(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples, sketch) of a record's tokens.

    Samples: the token drawn at each of ``SAMPLES`` positions, that of the least hash; two
    records draw the same with the chance of their Jaccard similarity. Sketch: two bits of each
    of ``SKETCH`` further drawn tokens, the first bits in three 64-bit numbers, then the second
    ones; both bits are equal in (1 + 3 * similarity) / 4 of them. The tokens are well-spread hashes, of which 32 bits are mixed
    anew at each position.
    """
    low = (tokens ^ (tokens >> np.uint64(32))).astype(np.uint32)
    best = np.full(SAMPLES + SKETCH, np.uint32(0xFFFFFFFF))
    at = np.zeros(SAMPLES + SKETCH, dtype=np.int64)
    for lo in range(0, len(low), 4096):  # long texts in stretches that stay in the processor's cache
        h = low[None, lo : lo + 4096] ^ DRAW_SALTS
        h *= DRAW_FACTORS
        i = h.argmin(axis=1)
        least = h[np.arange(len(h)), i]
        better = least < best
        best[better], at[better] = least[better], lo + i[better]
    token = tokens[at]
    bits = mixed(token[SAMPLES:] + DRAWS[SAMPLES : SAMPLES + SKETCH])
    both = np.concatenate([bits & np.uint64(1), bits >> np.uint64(1) & np.uint64(1)]).astype(np.uint8)
    return token[:SAMPLES], np.packbits(both).view(np.uint64)


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many drawn tokens the sketches of each row agree."""
    diff = x ^ y
    half = diff.shape[1] // 2
    return SKETCH - np.bitwise_count(diff[:, :half] | diff[:, half:]).sum(axis=1).astype(np.int64)


def grown(samples: np.ndarray, paths: np.ndarray, branches: int) -> np.ndarray:
    """Children of each record's paths: [record, path * branches]."""
    out = []
    start = mixed(paths + BRANCH_SALTS[0])
    for j in range(branches):
        pick = ((start + np.uint64(j * (SAMPLES // branches))) % np.uint64(SAMPLES)).astype(np.int64)  # the branches of a node choose different samples
        out.append(mixed((paths ^ mixed(BRANCH_SALTS[j : j + 1])) * M1 + np.take_along_axis(samples, pick, axis=1)))
    return np.concatenate(out, axis=1)


def roots(n: int, runs: int) -> np.ndarray:
    return np.tile(mixed(np.arange(1, runs + 1, dtype=np.uint64) * M2), (n, 1))


def survival(similarity: float) -> float:
    """Chance that two records share some path of one run, however deep: a branching process with ``BRANCHES`` children, which goes on for ever."""
    q = 1.0
    for _ in range(10_000):
        q = 1 - (1 - similarity * q) ** BRANCHES
    return q


@lru_cache(maxsize=None)
def least_recall(similarity: float, runs: int) -> float:
    """Chance that a pair right at the similarity is compared and agrees on its sketches, however deep its buckets are split.

    The runs choose from the same ``SAMPLES`` positions, of which the pair agrees in
    a binomial number. Pairs that are more alike, and splits that end, do better.
    """
    share = lambda k: comb(SAMPLES, k) * similarity**k * (1 - similarity) ** (SAMPLES - k)
    met = sum(share(k) * (1 - (1 - survival(k / SAMPLES)) ** runs) for k in range(SAMPLES + 1))
    return met * (1 + erf(MISSES / 2**0.5)) / 2


def runs_for(similarity: float, recall: float) -> int:
    """The least number of runs whose ``least_recall`` reaches ``recall``."""
    for runs in range(1, 65):
        if least_recall(similarity, runs) >= recall:
            return runs
    raise ValueError(f"recall {recall} at similarity {similarity} is out of reach of {BRANCHES} branches and {SKETCH} bits")


def least_agreement(similarity: float, misses: float = MISSES) -> int:
    """Drawn tokens in which a pair of the similarity agrees but for ``misses`` standard deviations."""
    p = (1 + 3 * similarity) / 4
    return int(SKETCH * p - misses * (SKETCH * p * (1 - p)) ** 0.5)


def word_form(text: Column) -> Column:
    """Digest of the words in order; equal for records that can't be told apart by their words."""
    return F.md5(F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1), " "))


DENSE, LARGE = 1, 2  # kinds of rows that a bucket over the limit gives back; 0: a pair


def bucket_pairs(limit: int, agree: int, alike: int):
    """Reads rows (path, id, sketch) sorted by path; gives kind, path, a, b.

    Kind 0: a pair (a, b) agreeing in ``agree`` drawn tokens. Buckets over the limit are not
    compared here but given back row by row: as ``DENSE`` where a quarter of
    neighbouring rows agree in ``alike`` of them, since their pairs are the result asked for and splitting would only repeat the work; else as
    ``LARGE``. Holds one batch and at most ``limit`` rows of the bucket in progress.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None  # rows of the bucket in progress
        known: tuple[int, int] | None = None  # its path and kind, once it is known to be over the limit
        for batch in batches:
            if not len(batch):
                continue
            part = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            path = part["path"].to_numpy()
            open_from = int((path == path[-1]).argmax())
            yield from settle(part.iloc[:open_from], known)
            rest = part.iloc[open_from:].reset_index(drop=True)
            if known and path[-1] != known[0]:
                known = None
            if known is None and len(rest) <= limit:
                continue
            known = known or (int(path[-1]), kind_of(rest))
            yield returned(rest, known[1])
            rest = None
        if rest is not None and len(rest):
            yield from settle(rest, known)

    def kind_of(rows: pd.DataFrame) -> int:
        s = bits_of(rows)
        hits = [agreement(s[k:], s[:-k]) >= alike for k in (1, 2, 5, 11) if k < len(s)]
        return DENSE if hits and float(np.concatenate(hits).mean()) >= 0.25 else LARGE

    def settle(closed: pd.DataFrame, known: tuple[int, int] | None) -> Iterator[pd.DataFrame]:
        if not len(closed):
            return
        path = closed["path"].to_numpy()
        edges = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
        size = np.diff(np.r_[edges, len(path)])
        kind = np.zeros(len(edges), dtype=np.int64)
        for i in np.flatnonzero(size > limit):
            kind[i] = kind_of(closed.iloc[edges[i] : edges[i] + size[i]])
        if known:
            kind[path[edges] == known[0]] = known[1]
        each = np.repeat(kind, size)
        keep = closed[each == 0]
        if len(keep):
            yield pairs_frame(*compared(keep["path"].to_numpy(), keep["id"].to_numpy(), bits_of(keep), agree))
        for k in (DENSE, LARGE):
            if (each == k).any():
                yield returned(closed[each == k], k)

    def pairs_frame(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"kind": np.zeros(len(a), dtype=np.int32), "path": np.zeros(len(a), dtype=np.int64), "a": np.minimum(a, b), "b": np.maximum(a, b)})

    def returned(rows: pd.DataFrame, kind: int) -> pd.DataFrame:
        return pd.DataFrame({"kind": np.full(len(rows), kind, dtype=np.int32), "path": rows["path"].to_numpy(), "a": rows["id"].to_numpy(), "b": rows["id"].to_numpy()})

    return run


def bits_of(rows: pd.DataFrame) -> np.ndarray:
    return rows[list(WORDS)].to_numpy().view(np.uint64)


def compared(path: np.ndarray, ids: np.ndarray, s: np.ndarray, agree: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one path that agree in ``agree`` drawn tokens; with ``side``, only those of different sides or of side 2."""
    a, b, i, k = [], [], np.arange(len(path)), 0
    while len(i):
        k += 1
        i = i[i + k < len(path)]
        i = i[path[i] == path[i + k]]
        if not len(i):
            break
        j = i if side is None else i[(side[i] == 2) | (side[i] != side[i + k])]
        hit = j[agreement(s[j], s[j + k]) >= agree]
        a.append(ids[hit])
        b.append(ids[hit + k])
    if not a:
        return ids[:0], ids[:0]
    return np.concatenate(a), np.concatenate(b)


def block_pairs(dense: DataFrame, drawn: DataFrame, limit: int, agree: int, parts: int) -> DataFrame:
    """a, b: the pairs agreeing in ``agree`` drawn tokens within dense buckets (path, id) of any size.

    A bucket is cut into blocks of about ``limit`` rows, and every two blocks meet in a
    group of their own, so that no task holds a bucket; rows are repeated less often than
    they occur in pairs.
    """
    blocks = dense.groupBy("path").agg(F.ceil(F.count("*") / limit).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id", "path"), F.col("blocks")).cast("int")
    each = dense.join(blocks, "path").withColumn("own", own).select("path", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    group = F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    rows = each.select(group.alias("path"), "id", side.alias("side")).join(drawn.select("id", *WORDS), "id")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            part = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            path = part["path"].to_numpy()
            open_from = int((path == path[-1]).argmax()) if len(path) else 0
            yield pairs(part.iloc[:open_from])
            rest = part.iloc[open_from:].reset_index(drop=True)
        if rest is not None:
            yield pairs(rest)

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = compared(rows["path"].to_numpy(), rows["id"].to_numpy(), bits_of(rows), agree, rows["side"].to_numpy())
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.repartition(parts, "path").sortWithinPartitions("path", "id").mapInPandas(compare, "a bigint, b bigint")


def similar_pairs(
    records: DataFrame, key: str = "id", text: str = "text", similarity: float = 0.5, words: int = 3, recall: float = 0.995, limit: int = 400
) -> tuple[DataFrame, DataFrame]:
    """(links, classes): links a, b, jaccard between representatives a < b at least ``similarity`` alike; classes id, class_id of every record.

    Records equal in their words form a class, named by its smallest id. Similarity
    is Jaccard's over runs of ``words`` words. Records with fewer words are equal
    to their copies and similar to nothing else; null texts aren't records. Ids
    must be unique. A pair right at the similarity is found with a chance of at least
    ``recall``, however many records share its words; runs are repeated as that
    needs. The chance rises quickly above it; a link given is always exact.
    """
    spark = records.sparkSession
    slim = spread(records.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null and text is not null"))
    formed = written(slim.withColumn("form", word_form(F.col("text"))), "formed")
    rep = formed.groupBy("form").agg(F.min("id").alias("class_id"))
    classes = written(salted_lookup(formed.select("id", "form"), rep, "form", "id", how="inner").select("id", "class_id"), "classes")
    base = formed.join(classes.where("id = class_id").select("id"), "id", "left_semi").select("id", "text")
    runs = runs_for(similarity, recall)
    sketched = ", ".join(f"{w} bigint" for w in WORDS)

    def sampled_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo : lo + 500]
                rows = []
                for i, t in zip(part["id"], part["text"]):
                    s = shingles(t, words)
                    if len(s):
                        samples, bits = drawn_tokens(s)
                        rows.append((i, s.tobytes(), samples.view(np.int64), *bits.view(np.int64)))
                yield pd.DataFrame(rows, columns=["id", "tokens", "samples", *WORDS])

    drawn = written(spread(base).mapInPandas(sampled_records, f"id bigint, tokens binary, samples array<bigint>, {sketched}"), "samples")
    row = f"path bigint, id bigint, {sketched}"

    def first_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 2000):
                part = b.iloc[lo : lo + 2000]
                samples = np.stack(part["samples"].to_numpy()).astype(np.int64).view(np.uint64)
                paths = roots(len(part), runs)
                for _ in range(FIRST):
                    paths = grown(samples, paths, BRANCHES)
                yield rows_of(part, paths)

    def next_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 20_000):
                part = b.iloc[lo : lo + 20_000]
                samples = np.stack(part["samples"].to_numpy()).astype(np.int64).view(np.uint64)
                yield rows_of(part, grown(samples, part["path"].to_numpy().view(np.uint64)[:, None], BRANCHES))

    def rows_of(part: pd.DataFrame, paths: np.ndarray) -> pd.DataFrame:
        times = paths.shape[1]
        return pd.DataFrame({"path": paths.reshape(-1).view(np.int64), **{c: np.repeat(part[c].to_numpy(), times) for c in ("id", *WORDS)}})

    agree, alike = least_agreement(similarity), least_agreement(similarity, 0)
    found: list[DataFrame] = []
    nodes = drawn.drop("tokens").mapInPandas(first_paths, row)
    parts = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    while True:
        sorted_nodes = nodes.repartition(parts, "path").sortWithinPartitions("path", "id")
        out = written(sorted_nodes.mapInPandas(bucket_pairs(limit, agree, alike), "kind int, path bigint, a bigint, b bigint"), "buckets")
        found.append(out.where("kind = 0").select("a", "b"))
        over = {r["kind"] for r in out.where("kind > 0").select("kind").distinct().collect()}
        if DENSE in over:
            found.append(written(block_pairs(out.where(f"kind = {DENSE}").select("path", F.col("a").alias("id")), drawn, limit, agree, parts), "dense"))
        if LARGE not in over:
            break
        nodes = out.where(f"kind = {LARGE}").select("path", F.col("a").alias("id")).join(drawn.drop("tokens"), "id").mapInPandas(next_paths, row)
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    candidates = candidates.distinct()
    left = drawn.select(F.col("id").alias("a"), F.col("tokens").alias("tokens_a"))
    right = drawn.select(F.col("id").alias("b"), F.col("tokens").alias("tokens_b"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x, y, s, t in zip(batch["a"], batch["b"], batch["tokens_a"], batch["tokens_b"]):
                p, q = np.frombuffer(s, dtype=np.uint64), np.frombuffer(t, dtype=np.uint64)
                if min(len(p), len(q)) < similarity * max(len(p), len(q)):
                    continue
                merged = np.sort(np.concatenate([p, q]))
                both = int((merged[1:] == merged[:-1]).sum())
                j = both / max(1, len(p) + len(q) - both)
                if j >= similarity:
                    rows.append((x, y, j))
            yield pd.DataFrame(rows, columns=["a", "b", "jaccard"])

    checked = candidates.join(left, "a").join(right, "b").select("a", "b", "tokens_a", "tokens_b")
    return written(checked.mapInPandas(verify, "a bigint, b bigint, jaccard double"), "links"), classes


def ads(jobs: DataFrame, cases: DataFrame) -> DataFrame:
    """id, text: jobs with a text under their job_id, cases under minus their number minus one."""
    dash = F.concat(F.coalesce("title", F.lit("")), F.lit(" — "), F.coalesce("company", F.lit("")), F.lit("\n\n"), F.col("jd_text"))
    return (
        jobs.where("jd_text is not null and job_id is not null")
        .select(F.col("job_id").alias("id"), dash.alias("text"))
        .unionByName(cases.where("jd is not null and case_no is not null").select((-F.col("case_no") - 1).alias("id"), F.col("jd").alias("text")))
    )


def record_name(id: Column) -> Column:
    return F.when(id >= 0, F.concat(F.lit("job:"), id.cast("string"))).otherwise(F.concat(F.lit("case:"), (-id - 1).cast("string")))


def ad_pairs(jobs: DataFrame, cases: DataFrame, expand: int | None = None) -> DataFrame:
    """rec_a, rec_b: the pairs of similar ads, by name in code point order.

    Copies are pairs too, and all pairs are given. With ``expand``, more copies than
    that of one text, equal byte by byte, are given as the pairs of the smallest with
    each other one, and only the smallest stands in pairs with different texts; texts
    that differ, if only in case or punctuation, are always paired in full.
    """
    records = ads(jobs, cases)
    links, classes = similar_pairs(records)
    # The members that stand for their class in pairs: all, or of many equal texts the smallest.
    standing, star = classes, None
    if expand is not None:
        texts = records.select(F.col("id").cast("long").alias("id"), F.sha2("text", 256).alias("same"))
        copies = classes.join(texts, "id")
        size = copies.groupBy("class_id", "same").agg(F.count("*").alias("n"), F.min("id").alias("least"))
        sized = written(copies.join(size, ["class_id", "same"]).select("class_id", "id", "n", "least"), "copies")
        standing = sized.where((F.col("n") <= expand) | (F.col("id") == F.col("least"))).select("class_id", "id")
        star = sized.where((F.col("n") > expand) & (F.col("id") != F.col("least"))).select(F.col("least").alias("x"), F.col("id").alias("y"))
    a = standing.select(F.col("class_id").alias("a"), F.col("id").alias("x"))
    b = standing.select(F.col("class_id").alias("b"), F.col("id").alias("y"))
    pairs = links.join(a, "a").join(b, "b").select("x", "y")
    inside = standing.join(standing.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id"), "class_id")
    pairs = pairs.unionByName(inside.select("class_id", F.col("id").alias("x")).join(inside.select("class_id", F.col("id").alias("y")), "class_id").where("x < y").select("x", "y"))
    if star is not None:
        pairs = pairs.unionByName(star)
    names = pairs.select(record_name(F.col("x")).alias("p"), record_name(F.col("y")).alias("q"))
    return names.select(F.least("p", "q").alias("rec_a"), F.greatest("p", "q").alias("rec_b"))


def ad_classes(jobs: DataFrame, cases: DataFrame) -> DataFrame:
    """rec, class_rec, links: every ad with the representative of its copies and the number of other classes like it."""
    links, classes = similar_pairs(ads(jobs, cases))
    ends = links.select(F.col("a").alias("class_id")).unionByName(links.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count("*").alias("links"))
    got = classes.join(ends, "class_id", "left")
    return got.select(record_name(F.col("id")).alias("rec"), record_name(F.col("class_id")).alias("class_rec"), F.coalesce("links", F.lit(0)).alias("links"))
