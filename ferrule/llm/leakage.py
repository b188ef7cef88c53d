"""Evaluation texts leaking into training text.

One Aho-Corasick automaton holds every run of four words of the normalised test
texts; each document is scanned once. A passage with at most one altered word in
six must hold at least five such runs on nearly one diagonal (see
``least_hits``), so only documents and cases with that many are aligned. The
alignment counts changed, split, missing and added words exactly, and its place
is reported as character offsets of the original document.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.plans.session import spread

SEED = 4
WORD = re.compile(r"[^\W_]+")
INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|a|code|small|mark|sub|sup|font)(?:\s[^<>]{0,300})?>", re.IGNORECASE)
TAG = re.compile(r"<[/!a-zA-Z][^<>]{0,1000}>")
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]{2,10});")


def blanked(text: str) -> str:
    """Text of the same length without markup: tags and entities become blanks, inline tags vanish between letters by a mark that isn't part of a word."""
    text = TAG.sub(lambda m: (" " if not INLINE.fullmatch(m.group()) else "\x00") * len(m.group()), text)

    def entity(m: re.Match) -> str:
        char = html.unescape(m.group())
        return (char if len(char) == 1 else " ").ljust(len(m.group()), "\x00" if char.isalnum() else " ")

    return ENTITY.sub(entity, text) if "&" in text else text


def words_of(text: str) -> tuple[list[str], list[int], list[int]]:
    """Lower-case words, and where each begins and ends in the text."""
    plain = blanked(text)
    if "\x00" in plain:
        found = list(re.finditer(r"[^\W_]+(?:\x00+[^\W_]+)*", plain))
        words = [m.group().replace("\x00", "").lower() for m in found]
    else:
        found = list(WORD.finditer(plain))
        words = [m.group().lower() for m in found]
    return words, [m.start() for m in found], [m.end() for m in found]


def normalised(text: str) -> str:
    """The words of the text in lower case, one blank between."""
    plain = blanked(text) if "<" in text or "&" in text else text
    if "\x00" in plain:
        return " ".join(words_of(text)[0])
    return " ".join(WORD.findall(plain)).lower()


def least_hits(least: int, one_in: int) -> int:
    """The fewest runs of ``SEED`` equal words that an acceptable passage can have: its n - e equal words lie in at most e + 1 runs."""
    return max(1, min((n - n // one_in) - (SEED - 1) * (n // one_in + 1) for n in range(least, 2 * least)))


def align(case: np.ndarray, doc: np.ndarray, starts: np.ndarray, least: int, one_in: int) -> tuple[int, int, int, int] | None:
    """Whether some window of at least ``least`` case words beginning at one of ``starts`` occurs in ``doc`` with at most one error in ``one_in``.

    Gives (case start, words, errors, end in doc) of the one with the smallest
    share of errors, or None. Windows under twice ``least`` suffice: a longer one
    can be halved, and one half has no larger share. All starts are advanced
    together, one case word at a time.
    """
    m = len(doc)
    small = np.int16 if m < 16_000 else np.int32
    cost = np.zeros((len(starts), m + 1), dtype=small)
    best = None
    columns = np.arange(m + 1, dtype=small)
    for k in range(1, 2 * least):
        at = starts + k - 1
        if at[-1] >= len(case):
            alive = at < len(case)
            starts, cost, at = starts[alive], cost[alive], at[alive]
            if not len(at):
                break
        new = cost + small(1)  # missing
        np.minimum(new[:, 1:], cost[:, :-1] + (case[at][:, None] != doc[None, :]), out=new[:, 1:])
        if m > 1:
            np.minimum(new[:, 2:], cost[:, :-2] + small(1), out=new[:, 2:])  # split in two
        new -= columns
        np.minimum.accumulate(new, axis=1, out=new)
        new += columns  # added words
        cost = new
        if k >= least:
            low = new.min(axis=1)
            i = int(low.argmin())
            e = int(low[i])
            if e * one_in <= k and (best is None or e * best[1] < best[2] * k):
                best = (int(starts[i]), k, e, int(new[i].argmin()))
                if not e:
                    break
        if k >= least // 2:  # a start with more errors than its longest window may have stays so
            alive = cost.min(axis=1) * one_in < 2 * least
            if not alive.all():
                starts, cost = starts[alive], cost[alive]
                if not len(starts):
                    break
    return best


class Scanner:
    """The automaton over the test texts, and the scan of one document."""

    def __init__(self, cases: list[tuple[int, list[str]]], least: int, one_in: int):
        import ahocorasick

        self.least, self.one_in, self.need = least, one_in, least_hits(least, one_in)
        self.ids: dict[str, int] = {}
        self.cases = [(no, np.array([self.ids.setdefault(w, len(self.ids)) for w in words], dtype=np.int64)) for no, words in cases]
        seeds: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, words) in enumerate(cases):
            for i in range(len(words) - SEED + 1):
                seeds[" " + " ".join(words[i : i + SEED]) + " "].append((k, i))
        self.automaton = ahocorasick.Automaton()
        for text, places in seeds.items():
            self.automaton.add_word(text, places)
        if seeds:
            self.automaton.make_automaton()
        self.empty = not seeds

    def scan(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(case, start, end, words, errors): one row per case of which the text holds a passage."""
        if self.empty or not text:
            return []
        norm = " " + normalised(text) + " "
        hits = list(self.automaton.iter(norm))
        if not hits:
            return []
        often = Counter(k for _, places in hits for k, _ in places)
        if max(often.values()) < self.need:
            return []
        words = norm[1:-1].split(" ")
        edge = np.cumsum([1] + [len(w) + 1 for w in words])  # where each word starts in norm
        at = np.searchsorted(edge, np.array([e for e, _ in hits]) + 1) - SEED
        by_case: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for a, (_, places) in zip(at.tolist(), hits):
            for k, i in places:
                if often[k] >= self.need:
                    by_case[k].append((a - i, i))
        doc = np.array([self.ids.get(w, -1) for w in words])
        places = None
        out = []
        slack = 2 * (2 * self.least // self.one_in)
        for k, found in by_case.items():
            no, case = self.cases[k]
            best = None
            for group in self.clusters(sorted(found), slack):
                first = max(0, min(i for _, i in group) - 2 * self.least)
                final = max(i for _, i in group)
                starts = self.possible(case, doc, first, final, group[0][0] - slack, group[-1][0] + slack)
                if not len(starts):
                    continue
                low = max(0, group[0][0] + int(starts[0]) - slack)
                high = min(len(doc), group[-1][0] + int(starts[-1]) + 2 * self.least + slack)
                got = align(case, doc[low:high], starts, self.least, self.one_in)
                if got and (best is None or got[2] * best[1] < best[2] * got[1]):
                    end = low + got[3]
                    best = (low + max(0, got[3] - got[1]), got[1], got[2], end)
            if best:
                if places is None:
                    places = words_of(text)[1:]
                begins, ends = places
                out.append((no, begins[min(best[0], len(begins) - 1)], ends[max(0, best[3] - 1)], best[1], best[2]))
        return out

    def possible(self, case: np.ndarray, doc: np.ndarray, first: int, final: int, low: int, high: int) -> np.ndarray:
        """Starts in [first, final] of which some window has enough words that stand in the document on a diagonal in [low, high].

        Every acceptable passage has such a window, as its words without error are equal on
        diagonals that differ by its errors at most; so the alignment need only look at these starts.
        """
        last = min(len(case), final + 2 * self.least)
        at = np.arange(first, last)[:, None] + np.arange(low, high + 1)[None, :]
        inside = (at >= 0) & (at < len(doc))
        equal = ((doc[np.clip(at, 0, len(doc) - 1)] == case[first:last, None]) & inside).any(axis=1)
        total = np.concatenate([[0], np.cumsum(equal)])
        good = np.zeros(last - first, dtype=bool)
        for k in range(self.least, min(2 * self.least, last - first + 1)):
            good[: last - first - k + 1] |= total[k:] - total[:-k] >= k - k // self.one_in
        return first + np.flatnonzero(good[: final - first + 1])

    def clusters(self, found: list[tuple[int, int]], slack: int) -> list[list[tuple[int, int]]]:
        """Groups of hits on nearly one diagonal, with enough of them within the reach of one window."""
        groups, group = [], [found[0]]
        for hit in found[1:]:
            if hit[0] - group[-1][0] <= slack // 2:
                group.append(hit)
            else:
                groups.append(group)
                group = [hit]
        groups.append(group)
        good = []
        for g in groups:
            places = sorted({i for _, i in g})
            if any(places[j + self.need - 1] - places[j] < 2 * self.least for j in range(len(places) - self.need + 1)):
                good.append(g)
        return good


_BUILT: dict[tuple, Scanner] = {}


def leaks(
    documents: DataFrame,
    cases: DataFrame,
    doc_key: str = "doc_id",
    text: str = "text",
    case_key: str = "case_no",
    case_text: str = "jd",
    least: int = 20,
    one_in: int = 6,
    block_words: int = 400_000,
) -> DataFrame:
    """doc_id, case_no, start_at, end_at, words, errors: each document holding a passage of a test text.

    A passage is at least ``least`` consecutive words of the test text, of which at
    most one in ``one_in`` is changed, split or missing. Letter case, punctuation,
    line breaks and markup don't count. The test texts are taken in blocks of at
    most ``block_words`` words (one text at least), each an automaton of bounded
    size and a pass over the documents. Null and empty texts hold nothing;
    repeated documents are each reported; texts shorter than ``least`` words
    can't leak. Other columns aren't carried.
    """
    spark = documents.sparkSession
    slim = spread(documents.select(F.col(f"`{doc_key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("t is not null"))
    schema = f"{doc_key} bigint, {case_key} bigint, start_at int, end_at int, words int, errors int"
    out = spark.createDataFrame([], schema)
    block: list[tuple[int, list[str]]] = []
    total = 0

    def one_pass(block: list[tuple[int, list[str]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)
        tag = shared._jbroadcast.id() if hasattr(shared, "_jbroadcast") and shared._jbroadcast else id(shared)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key = (tag, least, one_in)
            if key not in _BUILT:
                _BUILT.clear()
                _BUILT[key] = Scanner(shared.value, least, one_in)
            scanner = _BUILT[key]
            for b in batches:
                rows = [(k, *r) for k, t in zip(b["k"], b["t"]) for r in scanner.scan(t)]
                yield pd.DataFrame(rows, columns=[doc_key, case_key, "start_at", "end_at", "words", "errors"])

        return slim.mapInPandas(run, schema)

    first = True
    for row in cases.select(F.col(f"`{case_key}`").alias("k"), F.col(f"`{case_text}`").alias("t")).where("k is not null and t is not null").toLocalIterator():
        words = words_of(row["t"])[0]
        if total and total + len(words) > block_words:
            out, first = (one_pass(block) if first else out.unionByName(one_pass(block))), False
            block, total = [], 0
        block.append((row["k"], words))
        total += len(words)
    if block:
        out = one_pass(block) if first else out.unionByName(one_pass(block))
    return out
