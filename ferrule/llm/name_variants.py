"""Variant spellings of names typed by people.

Each distinct name is reduced to its own words (without legal form, line of trade,
articles and asides; wrong decoding undone, short forms of given names written
out). Names become vectors of character trigrams weighted by rarity. A distributed
self-join of the prefixes of these sparse vectors finds the pairs that may reach
the cosine threshold, and their cosine is computed. Pairs that reach it pass
if their letters or words agree (``agrees``), since firms that share one word may be
as close in trigrams as two spellings of one firm; average-linkage clustering
then runs on the cosines. The clustering merges all pairs of mutual nearest
neighbours at a time, which gives the same groups as merging one pair after another.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.canonical import edit_distance
from ferrule.llm.mojibake import LOST, RUN, readings
from ferrule.plans.session import spread, written

# Lines of trade and their usual abbreviations.
TRADES = {
    "software": ("sw",),
    "robotics": ("robo",),
    "international": ("intl",),
    "engineering": ("eng", "engr"),
    "laboratories": ("labs", "lab"),
    "health": ("hlth",),
    "services": ("svcs", "svc"),
    "technologies": ("tech", "technology"),
    "systems": ("sys",),
    "brothers": ("bros",),
    "manufacturing": ("mfg",),
    "logistics": ("logist",),
    "energy": ("enrg",),
    "associates": ("assoc",),
    "analytics": ("anlytcs",),
    "foods": ("fds",),
    "consulting": ("consult",),
    "group": ("grp",),
    "holdings": ("hldgs",),
    "industries": ("inds",),
    "solutions": ("solns",),
    "partners": ("ptnrs",),
}
# Legal forms.
LEGAL = frozenset("gmbh corp corporation plc ltd limited ag llc inc incorporated sas sa bv nv co company kg oy ab srl spa".split())
# Words that say nothing about the firm.
FILLERS = frozenset("the and careers jobs hiring und et y".split())
# Short forms of given names.
SHORT_NAMES = {
    "robert": "bob bobby rob robbie", "william": "bill billy will liam", "richard": "dick rick", "james": "jim jimmy", "john": "jack johnny", "jonathan": "jon", "michael": "mike mick",
    "thomas": "tom tommy", "edward": "ed eddie ted", "charles": "charlie chuck", "joseph": "joe joey", "david": "dave", "daniel": "dan danny", "matthew": "matt", "anthony": "tony",
    "christopher": "chris", "alexander": "alex", "benjamin": "ben", "samuel": "sam", "elizabeth": "liz beth betty", "margaret": "maggie peggy", "katherine": "kate kathy katie", "jennifer": "jen jenny",
}
FULL_NAME = {short: name for name, forms in SHORT_NAMES.items() for short in forms.split()}
KEYWORDS = {a: trade for trade, short in TRADES.items() for a in (trade, *short)}
FOLD = str.maketrans({"ß": "ss", "ł": "l", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d"})
ANY = "?"  # stands for a letter lost in decoding
NICK = re.compile(r"^[A-Z][a-z]{2}[A-Z][a-z]{2}$")
ACRONYM = re.compile(r"^[A-Z]{3,5}$")


def undone(name: str) -> str:
    """The name with wrongly decoded runs read as what they must have been: letters or dashes."""

    def one(m: re.Match) -> str:
        for _, text, _ in sorted(readings(m.group()), key=lambda r: (len(r[1]), r[0])):
            if all((c.isalpha() and ord(c) < 0x250) or c in "–—’" for c in text):
                return text
        return m.group()

    return RUN.sub(one, name)


def folded(word: str) -> str:
    return unicodedata.normalize("NFKD", word.translate(FOLD)).encode("ascii", "ignore").decode()


@lru_cache(maxsize=100_000)
def trade_of(word: str, loose: bool = False) -> str | None:
    """The line of trade that a word names, abbreviated or with up to two slips of the pen; ``loose`` also takes slips in short forms."""
    if word in KEYWORDS:
        return KEYWORDS[word]
    best: tuple[int, str] | None = None
    for k, trade in KEYWORDS.items():
        if (loose or (len(word) >= 4 and len(k) >= 5)) and abs(len(k) - len(word)) <= 2:
            d = edit_distance(word, k)
            if (d <= 2 and d * 3 <= len(word)) or (loose and d <= 2 and len(word) + d > 2):
                best = min(best, (d, trade)) if best else (d, trade)
    return best[1] if best else None


def parsed(name: str) -> tuple[str, str, str, bool, str]:
    """(own words in alphabetical order, line of trade or '', nickname or '', whether the nickname is all there is, initials or '' or, of what may be initials only, ``=`` and these).

    ``BarTas (Barbar-Tasklisk Engineering)`` carries a nickname and the name; of
    ``BTE - Barbar-Tasklisk Engineering`` and asides in brackets only the name counts.
    """
    text = undone(name)
    nick = ""
    if m := re.match(r"^\s*(\S+)\s+\(([^()]{8,})\)\s*$", text):
        nick, text = folded(m[1].lower()), m[2]
    text = re.sub(r"\([^()]*\)", " ", text)
    text = re.sub(r"^\s*[A-Z]{2,4}\s+[-–]\s+", "", text)
    text = re.sub(r"\b(?:[A-Za-z]\.)+(?:[A-Za-z]\.?(?=\W|$)|(?<=\.[A-Za-z]\.)(?=\W|$))", lambda m: m.group().replace(".", ""), text)
    found = re.findall(rf"(?:[^\W\d_]|{LOST})+|\d+", text)
    words: list[tuple[str, str]] = [(folded(w.lower().replace(LOST, ANY)), w) for w in found]
    own, trade, first = [], "", ""
    for w, typed in words:
        if not w.strip(ANY) or w in FILLERS or w in LEGAL:
            continue
        first += w[0]
        if (t := trade_of(w)) and not trade:
            trade = t
            continue
        own.append((FULL_NAME.get(w, w), typed))
    if not trade and len(own) > 1:  # an abbreviation with a slip, beside own words long enough to stand without it
        rest = sum(len(w) for w, _ in own)
        for w, typed in sorted((own[-1], own[0]), key=lambda x: len(x[0])):
            if len(w) <= 7 and rest - len(w) >= 10 and (t := trade_of(w, loose=True)):
                trade = t
                own.remove((w, typed))
                break
    initials = first if len(first) >= 3 and ANY not in first else ""
    alone = len(own) == 1 and bool(NICK.match(folded(own[0][1])))
    if len(own) == 1 and not trade and ACRONYM.match(folded(own[0][1])):
        return own[0][0], "", "", False, "=" + own[0][0]
    if alone:
        nick = own[0][0]
    elif not nick and len(own) == 2 and all(len(w) >= 4 and ANY not in w for w, _ in own):
        nick = own[0][0][:3] + own[1][0][:3]
    return " ".join(sorted(w for w, _ in own)), trade, nick, alone, initials


def any_distance(a: str, b: str) -> int:
    """Edits between two letter strings, of which ``ANY`` fits any letter."""
    if ANY not in a and ANY not in b:
        return edit_distance(a, b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y and x != ANY and y != ANY)))
    return row[-1]


def distance(a: str, b: str) -> int:
    """Edits between own words run together, in the order of words that fits best."""
    x, y = a.split(), b.split()
    one = "".join(x)
    orders = permutations(y) if len(y) <= 3 else [y]
    best = min(any_distance(one, "".join(o)) for o in orders)
    if len(x) > 1 and len(y) == 1 and len(x) <= 3:
        best = min(best, *(any_distance("".join(o), y[0]) for o in permutations(x)))
    return best


def may_differ(size: int) -> int:
    """Edits that two spellings of ``size`` letters may be apart: one, and with nine letters or more about two in nine."""
    return max(1, 2 * size // 9)


def is_short(word: str) -> bool:
    """Whether a word may stand for a longer one."""
    return len(word) <= 3


def abbreviates(short: str, word: str) -> bool:
    """Its beginning; or its first letter and further ones in order, up to three letters."""
    if not short or not word or len(short) >= len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return word.startswith(short) or (len(short) <= 3 and all(c in rest for c in short))


def words_agree(a: str, b: str) -> bool:
    """Whether the words of two names stand for each other one by one, some of them abbreviated, at least one of four letters or more in full.

    Of names of two full words or more in common, one may say more than the other.
    """
    x, y = sorted((a.split(), b.split()), key=len)
    same = [w for w in x if w in y]
    full = [w for w in same if len(w) >= 4]
    left, right = [w for w in x if w not in same], [w for w in y if w not in same]
    if not left:
        return len(x) == len(y) or len(full) >= 2
    if not full or len(left) != len(right) or len(left) > 3:
        return False
    return any(all(abbreviates(p, q) or abbreviates(q, p) for p, q in zip(left, o)) for o in permutations(right))


def agrees(a: str, b: str) -> bool:
    """Whether the own words of two names can be spellings of one: few edits for their length, or words that stand for each other."""
    size = min(len(a.replace(" ", "")), len(b.replace(" ", "")))
    return distance(a, b) <= may_differ(size) or words_agree(a, b)


def average_linkage(nodes: DataFrame, edges: DataFrame, at_least: float) -> DataFrame:
    """node, cluster: groups by average linkage; a cluster is named by its smallest node.

    ``nodes``: node, size. ``edges``: a, b, sim; pairs without an edge count as 0.
    The mean over all pairs of members, weighted by their sizes, must reach
    ``at_least``. In each round all clusters that are each other's nearest merge;
    average linkage is reducible, so the order makes no difference. Equal means go
    to the smaller name. The rounds end when no two such clusters are left.
    """
    members = written(nodes.select("node", F.col("node").alias("cluster"), "size"), "members")
    links = edges.where("a <> b").join(nodes.select(F.col("node").alias("a"), F.col("size").alias("sa")), "a").join(
        nodes.select(F.col("node").alias("b"), F.col("size").alias("sb")), "b"
    )
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("sim") * F.col("sa") * F.col("sb")).alias("mass"))
    links = written(links.groupBy("a", "b").agg(F.max("mass").alias("mass")), "links")
    while True:
        sizes = members.groupBy("cluster").agg(F.sum("size").alias("size"))
        means = (
            links.join(sizes.select(F.col("cluster").alias("a"), F.col("size").alias("sa")), "a")
            .join(sizes.select(F.col("cluster").alias("b"), F.col("size").alias("sb")), "b")
            .withColumn("mean", F.round(F.col("mass") / F.col("sa") / F.col("sb"), 12))
            .where(F.col("mean") >= at_least)
            .select("a", "b", "mean")
        )
        both = means.unionByName(means.select(F.col("b").alias("a"), F.col("a").alias("b"), "mean"))
        nearest = both.groupBy("a").agg(F.min(F.struct((-F.col("mean")).alias("less"), "b")).alias("n")).select("a", F.col("n.b").alias("b"))
        back = nearest.select(F.col("b").alias("a"), F.col("a").alias("b"))
        merges = written(nearest.join(back, ["a", "b"]).where("a < b").select(F.col("b").alias("was"), F.col("a").alias("now")), "merges")
        if merges.isEmpty():
            return members.select("node", "cluster")
        members = written(
            members.join(merges, F.col("cluster") == F.col("was"), "left").select("node", F.coalesce("now", "cluster").alias("cluster"), "size"), "members"
        )
        to_a, to_b = merges.select(F.col("was").alias("a"), F.col("now").alias("na")), merges.select(F.col("was").alias("b"), F.col("now").alias("nb"))
        moved = links.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("na", "a").alias("x"), F.coalesce("nb", "b").alias("y"), "mass")
        links = written(
            moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "mass").groupBy("a", "b").agg(F.sum("mass").alias("mass")),
            "links",
        )


def letter_bits(own: str) -> int:
    """Which letters stand in the words once and twice, and which digits: an edit flips at most two of the bits."""
    bits = 0
    for c in own:
        if "a" <= c <= "z":
            at = ord(c) - 97
            bits |= 1 << (at + 26 if bits >> at & 1 else at)
        elif c.isdigit():
            bits |= 1 << (52 + int(c))
    return bits


def cosine_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """a, b, cosine: the pairs of nodes (a < b) whose vectors reach the cosine ``threshold``, of the same trade or one without, and whose letters may agree.

    ``nodes``: node, own, trade, bits, lost, size, short. Of each vector only the prefix of its
    heaviest trigrams is joined: the rest is too light to reach the threshold by
    itself. Trigrams that many names share weigh little and fall behind the prefix.
    Which letters occur is compared in the join, so that hardly any pair leaves it in
    vain (``may_differ`` bounds the edits, each of which changes two of the bits); names with
    short words, which may be abbreviations, and names that hold another's words are let through.
    """
    padded = F.transform(F.split("own", " "), lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    grams = F.array_distinct(
        F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - 2)), lambda i: F.substring(w, i, F.lit(3)))))
    )
    carried = ["trade", "bits", "lost", "size", "short"]
    each = nodes.select("node", *carried, F.explode(F.filter(grams, lambda g: ~g.contains(ANY))).alias("gram"))
    each = written(each, "grams")
    n = nodes.count()
    weight = F.log(F.lit(float(max(n, 1))) / F.col("df")) + 0.1
    df = each.groupBy("gram").agg(F.count("*").alias("df")).withColumn("w", weight).select("gram", "w")
    w2 = F.col("w") * F.col("w")
    heavy = Window.partitionBy("node").orderBy(F.desc("w"), "gram")
    total = Window.partitionBy("node")
    left = F.sum(w2).over(heavy.rowsBetween(0, Window.unboundedFollowing)) / F.sum(w2).over(total)
    weighed = written(each.join(df, "gram").withColumn("left", left), "weighed")
    prefix = weighed.where(F.col("left") >= threshold * threshold).select("node", *carried, "gram")
    x = prefix.select("gram", *(F.col(c).alias(f"{c}_a") for c in ("node", *carried)))
    y = prefix.select("gram", *(F.col(c).alias(f"{c}_b") for c in ("node", *carried)))
    edits = F.greatest(F.lit(1), F.floor(F.least("size_a", "size_b") * 2 / 9))
    differing = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b")))
    near = (differing <= 2 * edits + F.col("lost_a") + F.col("lost_b")) | F.col("short_a") | F.col("short_b")
    # One name holding all letters of the other may hold its words.
    holds = (F.col("bits_a").bitwiseAND(F.col("bits_b")) == F.col("bits_a")) | (F.col("bits_a").bitwiseAND(F.col("bits_b")) == F.col("bits_b"))
    near = near | (holds & (F.least("size_a", "size_b") >= 8))
    same = x.where("trade_a <> ''").join(y.where("trade_b <> ''"), (x["gram"] == y["gram"]) & (F.col("trade_a") == F.col("trade_b")) & near & (F.col("node_a") < F.col("node_b")))
    bare = x.where("trade_a = ''").join(y, (x["gram"] == y["gram"]) & near & (F.col("node_a") != F.col("node_b")))
    ends = [F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")]
    pairs = same.select(*ends).unionByName(bare.select(*ends)).distinct()
    vectors = weighed.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("v"), F.sqrt(F.sum(w2)).alias("norm"))  # as long as a name
    met = pairs.join(vectors.select(F.col("node").alias("a"), F.col("v").alias("va"), F.col("norm").alias("na")), "a").join(
        vectors.select(F.col("node").alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb")), "b"
    )
    shared = F.array_intersect(F.map_keys("va"), F.map_keys("vb"))
    dot = F.aggregate(shared, F.lit(0.0), lambda t, g: t + F.col("va")[g] * F.col("vb")[g])
    return met.select("a", "b", F.round(dot / F.col("na") / F.col("nb"), 9).alias("cosine")).where(F.col("cosine") >= threshold)


def name_clusters(names: DataFrame, threshold: float = 0.2, at_least: float = 0.2) -> DataFrame:
    """name, cluster: each distinct non-null ``name`` with the entity it stands for.

    ``threshold``: least cosine of a pair; ``at_least``: least mean cosine of two
    clusters that merge. Names without own words (empty, or of legal form and trade
    alone) are entities of their own. Names with letters lost in decoding fit any
    letter there. A bare nickname goes to the entity that carries it, first by a name
    that spells it out, then of the same trade, then with more spellings; bare initials
    to the one entity that has them, if there is just one.
    """
    distinct = names.where("name is not null").select("name").distinct()
    columns = "name string, own string, trade string, nick string, alone boolean, initials string, spelt boolean, bits bigint, lost int, size int, short boolean"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(x, *parsed(x)) for x in b["name"]]
            more = [("(" in r[0], letter_bits(r[1]), r[1].count(ANY), len(r[1].replace(" ", "")), any(is_short(w) for w in r[1].split())) for r in rows]
            yield pd.DataFrame([(*r, *m) for r, m in zip(rows, more)], columns=[c.split()[0] for c in columns.split(", ")])

    table = written(spread(distinct).mapInPandas(parse, columns), "names")
    node = F.xxhash64("own", "trade")
    real = table.where("own <> '' and not alone").withColumn("node", node)
    nodes = written(real.groupBy("node", "own", "trade", "bits", "lost", "size", "short").agg(F.count("*").alias("times")), "nodes")
    side = nodes.select("node", "own")
    pairs = cosine_pairs(nodes, threshold).join(side.select(F.col("node").alias("a"), F.col("own").alias("oa")), "a").join(side.select(F.col("node").alias("b"), F.col("own").alias("ob")), "b")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[[agrees(s, t) for s, t in zip(batch["oa"], batch["ob"])], ["a", "b", "sim"]]

    edges = pairs.select("a", "b", "oa", "ob", F.col("cosine").alias("sim")).mapInPandas(judge, "a bigint, b bigint, sim double")
    # Equal vectors, which a trade may part from a name without one: cosine one.
    exact = nodes.select("own", F.col("node").alias("a")).join(nodes.select("own", F.col("node").alias("b"), "trade"), "own").where("trade = '' and a <> b")
    edges = edges.unionByName(exact.select("a", "b", F.lit(1.0).alias("sim")))
    clusters = written(average_linkage(nodes.select("node", F.col("times").alias("size")), edges, at_least), "clusters")
    own = real.join(clusters, "node").select("name", "trade", "nick", "initials", "spelt", "cluster")
    own = written(own, "own")
    holders = own.where("nick <> ''").groupBy("nick", "trade", "cluster").agg(F.max("spelt").alias("spelt"), F.count("*").alias("n"))
    bare = table.where("alone").select("name", "nick", F.col("trade").alias("said"))
    fits = bare.join(holders, "nick").where("said = '' or trade = '' or said = trade")
    chosen = fits.groupBy("name").agg(F.max(F.struct("spelt", (F.col("said") == F.col("trade")).alias("same"), "n", "cluster")).alias("c")).select("name", F.col("c.cluster").alias("cluster"))
    # Names that are initials and nothing else, and like no other name.
    bare_initials = F.col("initials").startswith("=")
    single = own.where("initials <> ''").where(~bare_initials).groupBy("initials").agg(F.min("cluster").alias("to"), F.max("cluster").alias("other")).where("to = other").select("initials", "to")
    only = own.groupBy("cluster").agg(F.min(F.when(bare_initials, F.substring("initials", 2, 9))).alias("initials"), F.min(bare_initials).alias("only")).where("only").join(single, "initials").select("cluster", "to")
    owned = own.join(only, "cluster", "left").select("name", F.coalesce("to", "cluster").alias("cluster"))
    named = owned.unionByName(chosen)
    rest = table.join(named.select("name"), "name", "left_anti").select("name", F.xxhash64("name", F.lit("own")).alias("cluster"))
    return named.unionByName(rest)


def company_names(applications: DataFrame, jobs: DataFrame) -> DataFrame:
    return applications.select(F.col("company").alias("name")).unionByName(jobs.select(F.col("company").alias("name")))


def company_pairs(applications: DataFrame, jobs: DataFrame) -> DataFrame:
    """name_a, name_b: each pair of different company strings of one employer."""
    c = written(name_clusters(company_names(applications, jobs)), "clusters")
    a, b = c.select("cluster", F.col("name").alias("name_a")), c.select("cluster", F.col("name").alias("name_b"))
    return a.join(b, "cluster").where("name_a < name_b").select("name_a", "name_b")
