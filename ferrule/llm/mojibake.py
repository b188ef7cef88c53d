"""Garbled text from wrong character encoding.

A code-page swap turns each letter into a fixed group of other characters, so it
is a substitution cipher. Which groups stand for which letters is learned for
each source by expectation-maximization: the groups found in the text are
assigned to letters (or left as they are) by how well the outcome fits the
bigrams of the language, and bigrams, groups and the shares of the swaps are
re-estimated from that. The learned table is then applied to every cell, again
while it changes anything, since text may have been damaged more than once.
Signs that stand for lost characters mark a cell as damaged for good.

Where text of one single-byte page was read with another, one character stands for
one letter and nothing shows in the bytes. Marks that keep standing inside words
give such a source away; the letter behind each is learned by
expectation-maximization from the letters around it (``learned_swaps``), also for pages
that aren't listed, and put back with ``translate()``.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.plans.session import spread

# Code pages that a text in UTF-8 may have been read with.
PAGES = (
    "cp1252 latin_1 cp437 cp850 cp852 cp858 cp1250 cp1251 cp1254 cp1257 mac_roman mac_cyrillic mac_latin2 koi8_r cp866 "
    "iso8859_2 iso8859_5 iso8859_15 gbk big5 shift_jis euc_kr"
).split()
WIDE = {"gbk", "big5", "shift_jis", "euc_kr"}
LOST = "�"
RUN = re.compile(r"[^\x00-\x7f]+")
DEPTH = 3
#: UTF-8 sequences of two to four bytes.
SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3}")


@lru_cache(maxsize=None)
def byte_of(page: str, char: str) -> bytes | None:
    """The bytes of a character on a page; unassigned places stand for themselves, as lenient readers do."""
    try:
        return codecs.encode(char, page)
    except UnicodeEncodeError:
        return bytes([ord(char)]) if 0x80 <= ord(char) < 0xA0 and page not in WIDE else None


@lru_cache(maxsize=200_000)
def groups(run: str, page: str) -> tuple[tuple[int, int, str], ...]:
    """(start, end, letters) of the parts of a run that are UTF-8 read with ``page``."""
    if page not in WIDE and len(run) < 2:
        return ()
    found: list[tuple[int, int, str]] = []
    stretch: list[bytes] = []
    first = 0
    for i, c in enumerate([*run, None]):
        b = byte_of(page, c) if c is not None else None
        if b is not None and (len(b) > 1 or b[0] >= 0x80):
            if not stretch:
                first = i
            stretch.append(b)
            continue
        if stretch:
            found += within(first, stretch)
            stretch = []
    return tuple(found)


def within(first: int, stretch: list[bytes]) -> list[tuple[int, int, str]]:
    joined = b"".join(stretch)
    edges, at = {0: 0}, 0
    for i, b in enumerate(stretch, 1):
        at += len(b)
        edges[at] = i
    out: list[tuple[int, int, str]] = []
    pending: tuple[int, str] | None = None  # a group that begins but doesn't end at a character's edge
    at = 0
    while at < len(joined):
        m = SEQUENCE.match(joined, at)
        if not m:
            if joined[at] < 0x80 and pending is not None:  # an ASCII byte that a wide page took for half a character
                begin, text = pending
                text, at = text + chr(joined[at]), at + 1
                pending = (begin, text)
                if at in edges:
                    out.append((first + edges[begin], first + edges[at], text))
                    pending = None
                continue
            pending, at = None, at + 1
            continue
        begin, text = (at, "") if pending is None else pending
        text += m.group().decode()
        at = m.end()
        if begin in edges and at in edges:
            out.append((first + edges[begin], first + edges[at], text))
            pending = None
        elif begin in edges:
            pending = (begin, text)
        else:
            pending = None
    return out


@lru_cache(maxsize=200_000)
def readings(run: str) -> tuple[tuple[str, str, tuple[tuple[int, int, str], ...]], ...]:
    """(page, text, groups) of each way to undo a swap, or up to ``DEPTH`` swaps with one page; a group is (start, end, letters) in the run."""
    out = []
    for page in PAGES:
        tokens = [(c, i, i + 1) for i, c in enumerate(run)]
        undone: dict[tuple[int, int], str] = {}
        for _ in range(DEPTH):
            text = "".join(t for t, _, _ in tokens)
            place = [k for k, (t, _, _) in enumerate(tokens) for _ in t]
            found = groups(text, page)
            if not found:
                break
            merged, at = [], 0
            for first, last, letters in found:
                j, k = place[first], place[last - 1]
                if j < at:
                    continue
                merged += tokens[at:j]
                merged.append((letters, tokens[j][1], tokens[k][2]))
                undone = {s: x for s, x in undone.items() if not (s[0] >= tokens[j][1] and s[1] <= tokens[k][2])}
                undone[(tokens[j][1], tokens[k][2])] = letters
                at = k + 1
            tokens = merged + tokens[at:]
            out.append((page, "".join(t for t, _, _ in tokens), tuple((a, b, x) for (a, b), x in sorted(undone.items()))))
    return tuple(out)


def observed(text: str) -> Counter:
    """Counts of (kind, group, letters, neighbour, side): side 0 before, 1 after; kind the page, or empty for characters that form no group."""
    got: Counter = Counter()
    for m in RUN.finditer(text):
        run, start = m.group(), m.start()
        taken = [False] * len(run)
        once: set[tuple[str, int, int, str]] = set()
        for page, _, found in readings(run):
            once |= {(page, a, b, x) for a, b, x in found}
        for page, a, b, letters in once:
            got[(page, run[a:b], letters, text[start + a - 1] if start + a else "^", 0)] += 1
            got[(page, run[a:b], letters, text[start + b] if start + b < len(text) else "$", 1)] += 1
            taken[a:b] = [True] * (b - a)
        for i, c in enumerate(run):
            if not taken[i] and c != LOST:
                got[("", c, c, text[start + i - 1] if start + i else "^", 0)] += 1
                got[("", c, c, text[start + i + 1] if start + i + 1 < len(text) else "$", 1)] += 1
    return got


def block(char: str) -> tuple[int, int]:
    """A stretch of neighbouring code points and its size: 128 of them, for ideographs and the like all."""
    code = ord(char)
    return (code >> 7, 128) if code < 0x3000 else (1 << 20, 30_000) if code < 0xFB00 else (code >> 7, 128)


# First code points of the stretches in which texts in common scripts, marks and currencies lie.
COMMON = {block(chr(c))[0] for c in (0x00, 0x80, 0x100, 0x380, 0x400, 0x580, 0x600, 0x900, 0x2000, 0x2080, 0x2100, 0x3000, 0xFF00)}


class Bigrams:
    """Chance of a character after another, backed off to how common it is, and that to how common its block is."""

    def __init__(self, counts: Counter):
        self.pairs, self.firsts, self.single = dict(counts), Counter(), Counter()
        for (a, b), n in counts.items():
            self.firsts[a] += n
            self.single[b] += n
        self.total = sum(self.single.values()) + 1.0
        self.blocks: Counter = Counter()
        for b, n in self.single.items():
            self.blocks[block(b)[0]] += n

    def alone(self, b: str) -> float:
        name, size = block(b)
        in_block = (self.blocks.get(name, 0) + (1e-3 if name in COMMON else 1e-20)) / self.total / size
        return (self.single.get(b, 0) + in_block) / self.total

    def __call__(self, a: str, b: str) -> float:
        return math.log((self.pairs.get((a, b), 0) + 5.0 * self.alone(b)) / (self.firsts.get(a, 0) + 5.0))

    def inner(self, text: str) -> float:
        return sum(self(a, b) for a, b in zip(text, text[1:]))


# Marks that may rightly stand inside words.
JOINING = set("’‘‐‑–—·•…ªº´ʼ™®©\u00ad\u200b\u200c\u200d\ufeff°²³×" + LOST) - set("²³")
SINGLE_BYTE = [p for p in PAGES if p not in WIDE]


def is_mark(c: str) -> bool:
    """Neither letter nor ASCII, and nothing that joins words."""
    return not c.isascii() and unicodedata.category(c)[0] in "SNP" and c not in JOINING


@lru_cache(maxsize=1)
def page_swaps() -> dict[tuple[str, str], dict[str, str]]:
    """(page read with, page written in) -> character read -> letter meant."""
    read = {p: bytes(range(0x80, 0x100)).decode(p, "replace") for p in SINGLE_BYTE}
    return {(x, y): {a: b for a, b in zip(read[x], read[y]) if a != b and b.isalpha() and LOST not in (a, b)} for x in read for y in read if x != y}


def learned_swaps(rows: list[tuple[str, str, str, str, str, int, int]], rounds: int = 10, least: int = 3, sure: float = 0.9) -> dict[str, dict[str, str]]:
    """source -> {character: letter}: single-byte swaps, from the counts of characters that form no group.

    A mark met ``least`` times, mostly between letters, stands for a letter. How well a
    letter fits is told by the letters around it, as they stand around that letter in
    the clean text of all sources. Swaps of known pages only raise the chance of the letters
    they give; their shares are re-estimated from the assignments. Other characters
    of the source are replaced where the likeliest swap replaces them and their neighbours agree.
    """
    around: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    for source, kind, group, _, near, side, n in rows:
        if not kind:
            around[(source, group)][side][near.lower() if near.isascii() else near] += n
    marks: dict[str, list[str]] = defaultdict(list)
    for (source, c), (before, after) in around.items():
        inside = min(sum(n for x, n in side.items() if x.isalpha()) for side in (before, after))
        if is_mark(c) and inside >= least and 2 * inside > sum(before.values()):
            marks[source].append(c)
    out: dict[str, dict[str, str]] = {}
    for source in marks:
        letters: dict[str, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        for (other, c), sides in around.items():
            if other != source and c.isalpha():
                for total, side in zip(letters[c], sides):
                    total.update(side)
        if not letters:
            continue
        alphabet = {x for sides in letters.values() for side in sides for x in side}
        size = len(alphabet) + 1

        def fit(c: str, letter: str, letters=letters, size=size, source=source) -> float:
            return sum(n * math.log((known[x] + 0.5) / (sum(known.values()) + 0.5 * size)) for known, seen in zip(letters[letter], around[(source, c)]) for x, n in seen.items())

        fits = {c: {x: fit(c, x) for x in letters} for s, c in around if s == source and (is_mark(c) or c.isalpha())}
        swaps = page_swaps()
        share = dict.fromkeys(swaps, 1.0 / len(swaps))
        common = sum(sum(a.values()) for a, _ in letters.values())
        posterior: dict[str, dict[str, float]] = {}
        for _ in range(rounds):
            given: dict[str, Counter] = defaultdict(Counter)
            for pair, p in share.items():
                for c in marks[source]:
                    if (x := swaps[pair].get(c)) in letters:
                        given[c][x] += p
            weight = Counter()
            for c in marks[source]:
                score = {x: f + math.log(0.8 * given[c][x] + 0.2 * (sum(letters[x][0].values()) + 1) / (common + len(letters))) for x, f in fits[c].items()}
                top = max(score.values())
                mass = {x: math.exp(v - top) for x, v in score.items()}
                norm = sum(mass.values())
                posterior[c] = {x: m / norm for x, m in mass.items()}
                for pair, p in share.items():
                    if p and (x := swaps[pair].get(c)) in posterior[c] and given[c][x]:
                        weight[pair] += posterior[c][x] * p / given[c][x]
            norm = sum(weight.values()) or 1.0
            share = {pair: weight[pair] / norm for pair in swaps} if weight else share
        table = {c: x for c in marks[source] for x, p in posterior[c].items() if p >= sure}
        for c in fits:
            if c in marks[source] or not table:
                continue
            likely: Counter = Counter()  # the letter that the likely swaps give, over the pages that have the character
            for pair, p in share.items():
                if (x := swaps[pair].get(c)) in letters:
                    likely[x] += p
            score = {x: fits[c][x] + math.log(p) for x, p in likely.items() if p > 0.01}
            if score:
                best = max(score, key=lambda x: (score[x], x))
                if score[best] > fits[c].get(c, -math.inf) and sum(math.exp(v - score[best]) for v in score.values()) * sure <= 1:
                    table[c] = best
        if any(c in table for c in marks[source]):
            out[source] = table
    return out


class Model:
    """Learned for one source: how common each page's swap is, how surely a group stands for letters, the bigrams, and single-byte swaps."""

    def __init__(self, bigrams: Bigrams, share: dict[str, float], sure: dict[tuple[str, str], float], swap: dict[str, str] | None = None):
        self.bigrams, self.share, self.sure = bigrams, share, sure
        self.cache: dict[tuple[str, str, str], str] = {}
        self.swap = str.maketrans(swap or {})
        marks = "".join(re.escape(c) for c in swap or {} if is_mark(c))
        self.marked = re.compile(rf"(?<=[^\W\d_])[{marks}]|[{marks}](?=[^\W\d_])") if marks else None

    def mended_run(self, before: str, run: str, after: str) -> str:
        key = (before, run, after)
        if key not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            best, top = run, self.bigrams.inner(before + run + after) + math.log(self.share[""])
            for page, text, found in readings(run):
                score = self.bigrams.inner(before + text + after) + math.log(self.share[page])
                score += sum(math.log(max(self.sure.get((run[a:b], x), 0.0), 1e-4)) for a, b, x in found)
                if score > top + 1e-9:
                    best, top = text, score
            self.cache[key] = best
        return self.cache[key]

    def mend(self, text: str) -> str:
        """The text with every damaged run restored; again while that changes anything, as pages may have been mixed."""
        for _ in range(DEPTH):
            mended = RUN.sub(lambda m: self.mended_run(text[m.start() - 1] if m.start() else "^", m.group(), text[m.end()] if m.end() < len(text) else "$"), text)
            if mended == text:
                break
            text = mended
        if self.marked and self.marked.search(text):
            text = text.translate(self.swap)
        return text


def learn(rows: list[tuple[str, str, str, str, str, int, int]], rounds: int = 10) -> dict[str, Model]:
    """A model per source from (source, kind, group, letters, neighbour, side, count).

    The bigrams start from characters that form no group, and those of the groups
    join them as they are assigned. A group may stay as it is. All sources share
    the bigrams; each has its own shares and assignments.
    """
    clean: Counter = Counter()
    contexts: dict[tuple[str, str], dict[int, Counter]] = defaultdict(lambda: {0: Counter(), 1: Counter()})
    choices: dict[tuple[str, str], dict[str, set[str]]] = defaultdict(lambda: defaultdict(set))
    seen: set[tuple] = set()
    sources = {r[0] for r in rows}
    plain: Counter = Counter()
    for source, kind, group, letters, near, side, n in sorted(rows):
        if not kind:
            clean[(near, group) if side == 0 else (group, near)] += n
            plain[source] += n * (side == 0)
            continue
        choices[(source, group)][letters].add(kind)
        if (source, group, near, side) not in seen:  # once, whatever the number of pages
            seen.add((source, group, near, side))
            contexts[(source, group)][side][near] += n
    # Neighbours that may be garbled themselves say nothing; they'd only confirm each other.
    known = {g for _, g in clean} | {a for a, _ in clean if a.isascii()}
    for sides in contexts.values():
        for side in (0, 1):
            sides[2 + side] = Counter({c: n for c, n in sides[side].items() if c.isascii() or c in known})
    share = {s: dict.fromkeys(PAGES, 0.5 / len(PAGES)) | {"": 0.5} for s in sources}
    posterior: dict[tuple[str, str], dict[str, float]] = {}
    bigrams = Bigrams(clean)
    for _ in range(rounds):
        grown = clean.copy()
        weight: dict[str, Counter] = {s: Counter({"": plain[s]}) for s in sources}
        for key, letters_of in choices.items():
            source, group = key
            around = contexts[key]
            total = max(1, sum(around[0].values()))

            def fit(text: str) -> float:
                outer = bigrams.inner(text)
                before, after = sum(around[2].values()), sum(around[3].values())
                outer += sum(n * bigrams(c, text[0]) for c, n in around[2].items()) / before if before else math.log(bigrams.alone(text[0]))
                return outer + (sum(n * bigrams(text[-1], c) for c, n in around[3].items()) / after if after else 0.0)

            score = {text: fit(text) + math.log(sum(share[source][k] for k in kinds)) for text, kinds in letters_of.items()}
            score[""] = fit(group) + math.log(share[source][""])
            top = max(score.values())
            mass = {t: math.exp(v - top) for t, v in score.items()}
            norm = sum(mass.values())
            posterior[key] = {t: m / norm for t, m in mass.items()}
            for text, p in posterior[key].items():
                if p < 1e-6:
                    continue
                final = text or group
                for a, b in zip(final, final[1:]):
                    grown[(a, b)] += p * total
                for c, n in around[2].items():
                    grown[(c, final[0])] += p * n
                for c, n in around[3].items():
                    grown[(final[-1], c)] += p * n
                kinds = letters_of[text] if text else {""}
                whole = sum(share[source][k] for k in kinds)
                for k in kinds:
                    weight[source][k] += p * total * share[source][k] / whole
        bigrams = Bigrams(grown)
        for s in sources:
            total = sum(weight[s].values()) + len(share[s])
            share[s] = {k: (weight[s][k] + 1) / total for k in share[s]}
    sure: dict[str, dict[tuple[str, str], float]] = {s: {} for s in sources}
    for (source, group), p in posterior.items():
        for text, chance in p.items():
            if text:
                sure[source][(group, text)] = chance
    swaps = learned_swaps(rows)
    return {s: Model(bigrams, share[s], sure[s], swaps.get(s)) for s in sources}


def damaged_cells(rows: DataFrame, key: str, fields: list[str], source: str | None = None) -> DataFrame:
    """key, field, damaged_text, restored_text, complete: each damaged cell and its text as far as it can be restored.

    Every field is a source of its own; where ``source`` names a column, every field of each
    of its values. ``complete`` is false where characters are lost for good. Null, empty and pure
    ASCII cells are never damaged; correct text in any script is left alone.
    Texts are read whole. Repeated rows are each reported; other columns of
    ``rows`` aren't carried.
    """
    spark = rows.sparkSession
    cells = rows.select(
        F.col(f"`{key}`").alias("k"),
        (F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")) if source else F.lit("")).alias("s"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"`{f}`").alias("t")) for f in fields))).alias("c"),
    ).select("k", "c.f", F.concat_ws("|", "c.f", "s").alias("s"), "c.t").where("t is not null").where(F.col("t").rlike(r"[^\x00-\x7f]"))
    cells = spread(cells)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total: Counter = Counter()
            for (f, t), n in Counter(zip(b["s"], b["t"])).items():
                for x, c in observed(t).items():
                    total[(f, *x)] += n * c
            yield pd.DataFrame([(*x, c) for x, c in total.items()], columns=["source", "kind", "group", "letters", "near", "side", "n"])

    seen = cells.select("s", "t").mapInPandas(count, "source string, kind string, `group` string, letters string, near string, side int, n bigint")
    # At most one row per group of characters, neighbouring character and page: bounded by the alphabets, not by the rows.
    rows_seen = seen.groupBy("source", "kind", "group", "letters", "near", "side").agg(F.sum("n").alias("n")).collect()
    shared = spark.sparkContext.broadcast(learn([tuple(r) for r in rows_seen]))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = shared.value
        for b in batches:
            out = []
            for k, f, s, t in zip(b["k"], b["f"], b["s"], b["t"]):
                mended = models[s].mend(t) if s in models else t
                if mended != t or LOST in t:
                    out.append((k, f, t, mended, LOST not in mended))
            yield pd.DataFrame(out, columns=[key, "field", "damaged_text", "restored_text", "complete"])

    return cells.mapInPandas(apply, f"{key} bigint, field string, damaged_text string, restored_text string, complete boolean")
