"""Delimited rows that fail to parse: minimum-cost error parse.

A record is read by a finite automaton over four places (cell start, unquoted
cell, quoted cell, just after a quote mark in a quoted cell). Characters that the
automaton can't take are paid for by edit operations on quote marks; a wrong
number of cells is paid for by inserting or deleting delimiters, at the places after
which most cells have the form of their column. The parse of least cost (quote edits
first, then delimiter edits, then misfits) comes from dynamic programming over
characters, done for a whole batch of records at once, and over cells and columns. A record
of cost zero is exactly a well-formed one, and the edits of a costlier one say
why it failed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.plans.session import spread

START, BARE, QUOTED, AFTER = range(4)
KEEP, DELETE_QUOTE, INSERT_OPEN, INSERT_CLOSE, QUOTE_BEFORE = range(5)
FAR = 1 << 28

#: (from, to, cost, edit) by kind of character.
MOVES = {
    "quote": [
        (START, QUOTED, 0, KEEP),
        (START, START, 1, DELETE_QUOTE),
        (BARE, BARE, 1, DELETE_QUOTE),
        (QUOTED, AFTER, 0, KEEP),
        (QUOTED, QUOTED, 1, DELETE_QUOTE),
        (AFTER, QUOTED, 0, KEEP),
        (AFTER, AFTER, 1, DELETE_QUOTE),
    ],
    "comma": [
        (START, START, 0, KEEP),
        (BARE, START, 0, KEEP),
        (AFTER, START, 0, KEEP),
        (QUOTED, QUOTED, 0, KEEP),
        (QUOTED, START, 1, INSERT_CLOSE),
        (START, QUOTED, 1, INSERT_OPEN),
    ],
    "other": [
        (START, BARE, 0, KEEP),
        (BARE, BARE, 0, KEEP),
        (QUOTED, QUOTED, 0, KEEP),
        (AFTER, QUOTED, 1, QUOTE_BEFORE),
        (START, QUOTED, 1, INSERT_OPEN),
    ],
}
EDIT_NAMES = {
    DELETE_QUOTE: "delete quote",
    INSERT_OPEN: "insert quote",
    INSERT_CLOSE: "insert quote",
    QUOTE_BEFORE: "insert quote",
}


def least_cost(lines: list[str], delimiter: str = ",", quote: str = '"') -> tuple[np.ndarray, np.ndarray]:
    """Least quote cost of each line, and the backtrace: [line, position, place] -> move + 1 packed with the place before.

    Lines are handled together, one character position at a time.
    """
    n, width = len(lines), max((len(x) for x in lines), default=0)
    codes = np.zeros((n, width), dtype=np.uint8)  # 0 beyond the end
    for i, x in enumerate(lines):
        if x:
            a = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            codes[i, : len(a)] = np.where(a == ord(quote), 1, np.where(a == ord(delimiter), 2, 3))
    cost = np.full((n, 4), FAR, dtype=np.int32)
    cost[:, START] = 0
    back = np.zeros((n, width, 4), dtype=np.uint8)
    for at in range(width):
        kind = codes[:, at]
        for code, name in ((1, "quote"), (2, "comma"), (3, "other")):
            rows = np.flatnonzero(kind == code)
            if not len(rows):
                continue
            old = cost[rows]
            new = np.full_like(old, FAR)
            came = np.zeros(old.shape, dtype=np.uint8)
            for before, after, price, edit in MOVES[name]:
                offered = old[:, before] + price
                better = offered < new[:, after]
                new[better, after] = offered[better]
                came[better, after] = edit * 4 + before
            cost[rows] = new
            back[rows, at] = came
    return cost, back


def traced(line: str, final: np.ndarray, back: np.ndarray, delimiter: str) -> tuple[list[str], list[str], int, list[int]]:
    """Cells, quote edits, quote cost and places of the delimiters along the least-cost parse of one line."""
    ends = final + np.array([0, 0, 1, 0])
    place = int(ends.argmin())
    price, edits = int(ends[place]), []
    if place == QUOTED:
        edits.append(f"insert quote at {len(line)}")
    steps = []
    for at in range(len(line) - 1, -1, -1):
        packed = int(back[at, place])
        edit, before = packed >> 2, packed & 3
        steps.append((at, before, place, edit))
        if edit != KEEP:
            edits.append(f"{EDIT_NAMES[edit]} at {at}")
        place = before
    cells, cell, places = [], [], []
    for at, before, after, edit in reversed(steps):
        char = line[at]
        if char == delimiter and after == START:
            cells.append("".join(cell))
            cell = []
            places.append(at)
        elif edit == QUOTE_BEFORE:
            cell.append('"')
            cell.append(char)
        elif edit == DELETE_QUOTE or (char == '"' and (before, after) in ((START, QUOTED), (QUOTED, AFTER))):
            continue
        else:
            cell.append(char)
    cells.append("".join(cell))
    return cells, edits[::-1], price, places


def mended(cells: list[str], places: list[int], line: str, types: list[str | None]) -> list[str]:
    """The delimiter edits of least cost that give a row one cell per type, as text with places in the line.

    As many as cells are missing or too many; among these the ones after which most cells
    fit their types (a pattern, or None for free text), found by dynamic programming over cells and
    columns. A delimiter may be inserted within a cell that stands in the line as it
    is, or beside one. Cells joined again hold a delimiter, which only free text may.
    Equal costs go to the edits furthest to the end.
    """
    k, n = len(cells), len(types)
    fits = [re.compile(t) if t is not None else None for t in types]
    bad = lambda text, i: 0 if fits[i] is None or fits[i].fullmatch(text) else 1
    starts, ends = [0] + [p + 1 for p in places], [*places, len(line)]
    best: list[list[tuple[int, tuple | None]]] = [[(FAR, None)] * (k + 1) for _ in range(n + 1)]  # [columns][cells] -> misfits, edit that led here
    best[0][0] = (0, None)
    if k > n:
        for i in range(1, n + 1):
            low = (FAR, -1)  # least over the cells before those joined, one cell further back each time
            for j in range(1, k + 1):
                if j >= 2 and best[i - 1][j - 2][0] < low[0]:
                    low = (best[i - 1][j - 2][0], j - 2)
                joined = (low[0] + (fits[i - 1] is not None), low[1])
                alone = best[i - 1][j - 1][0] + bad(cells[j - 1], i - 1)
                best[i][j] = (alone, (j - 1,)) if alone < joined[0] or joined[1] < 0 else (joined[0], (joined[1],))
        out, j = [], k
        for i in range(n, 0, -1):
            before = best[i][j][1][0]
            out += [f"delete delimiter at {places[c - 1]}" for c in range(j - 1, before, -1)]
            j = before
        return out[::-1]

    def halves(j: int, i: int) -> tuple[int, int]:
        """Misfits of cell j split over columns i and i + 1, and where it is split."""
        text = cells[j]
        low = min((bad(text, i) + bad("", i + 1), -len(text)), (bad("", i) + bad(text, i + 1), 0))
        if line[starts[j] : ends[j]] == text and (fits[i] is not None or fits[i + 1] is not None):
            for p in range(len(text) - 1, 0, -1):
                if not low[0]:
                    break
                price = int(fits[i] is not None and not fits[i].fullmatch(text, 0, p)) + int(fits[i + 1] is not None and not fits[i + 1].fullmatch(text, p))
                low = min(low, (price, -p))
        return low[0], -low[1]

    for i in range(n + 1):
        for j in range(k + 1):
            cost = best[i][j][0]
            if cost >= FAR:
                continue
            steps = []
            if j < k and i < n:
                steps.append((i + 1, j + 1, cost + bad(cells[j], i), None))
            if j < k and i + 1 < n:
                price, p = halves(j, i)
                steps.append((i + 2, j + 1, cost + price, p))
            if i < n and j == k:
                steps.append((i + 1, j, cost + bad("", i), -1))
            for x, y, price, p in steps:
                if price < best[x][y][0]:
                    best[x][y] = (price, (i, j, p))
    out, i, j = [], n, k
    while (i, j) != (0, 0):
        x, y, p = best[i][j][1]
        if p is not None:
            out.append(f"insert delimiter at {len(line) if p < 0 else starts[y] if p == 0 else ends[y] if p == len(cells[y]) else starts[y] + p}")
        i, j = x, y
    return out[::-1]


def parse_batch(lines: list[str], types: list[str | None], delimiter: str = ",") -> list[tuple]:
    """(cells, quote edits, delimiter edits, edits) of each line, by least cost: quote edits first, then delimiter edits (``mended``)."""
    columns = len(types)
    out: list = [None] * len(lines)
    order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
    for lo in range(0, len(order), 2048):  # lines of like length together
        part = order[lo : lo + 2048]
        while part:
            longest = len(lines[part[-1]])
            take = max(1, min(len(part), 40_000_000 // (4 * max(1, longest))))
            some, part = part[-take:], part[:-take]
            cost, back = least_cost([lines[i] for i in some], delimiter)
            for k, i in enumerate(some):
                cells, edits, quotes, places = traced(lines[i], cost[k], back[k], delimiter)
                wrong = len(cells) - columns
                if wrong:
                    edits += mended(cells, places, lines[i], types)
                out[i] = (cells, quotes, abs(wrong), edits)
    return out


def error_parse(df: DataFrame, text: str, columns: int, delimiter: str = ",", into: str = "parse", types: list[str | None] | None = None) -> DataFrame:
    """Adds ``into``: struct(cells array<string>, quote_edits int, delimiter_edits int, edits array<string>).

    ``types``, a pattern per column (None: free text), tell where a delimiter is missing or too many.
    Null text has no cells, no quote edits and ``columns`` delimiter edits; empty
    text is one empty cell. Other columns of ``df``, whatever their names, pass
    through. Repeated rows give repeated results; an empty table gives none.
    """

    @F.pandas_udf("cells array<string>, quote_edits int, delimiter_edits int, edits array<string>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for lines in batches:
            got = parse_batch([x if isinstance(x, str) else "" for x in lines], types or [None] * columns, delimiter)
            for i, x in enumerate(lines):
                if not isinstance(x, str):
                    got[i] = ([], 0, columns, ["insert delimiter at 0"] * columns)
            yield pd.DataFrame(got, columns=["cells", "quote_edits", "delimiter_edits", "edits"])

    return df.withColumn(into, parse(F.col(f"`{text}`")))


# The forms of the tracker's columns; free text is None.
TYPES = [r" {0,9}\d{1,18} {0,9}", r"\d{4}-\d{2}-\d{2}", None, None, r"—|\d{1,9}(?:\.\d{1,9})?/5", r"[^\W\d_][\w ./()-]{0,60}", r"[✅❌—-]?", r"(?:\[.{0,300}\]\(.{0,1000}\))?|—", None]
NAMES = ("num", "date", "company", "role", "score", "status", "pdf", "report", "notes")


def score_valid(score: Column) -> Column:
    """``—``, or a plain number from 0 to 5 followed by ``/5``."""
    number = F.regexp_extract(score, r"^([0-9]+(?:\.[0-9]+)?)/5\z", 1)
    return (score == "—") | (F.when(number != "", number.cast("double")).otherwise(F.lit(9.0)) <= 5.0)


def tracker_checked(lines: DataFrame, states: DataFrame) -> DataFrame:
    """Every raw tracker row with its parse and ``reason`` (null: it loads).

    Reasons in order: quoting, columns, score, status, notes. ``states`` holds
    the accepted spellings; it is joined by equality, so it may be of any size.
    Null text has no cells and so fails on columns, empty text too. Columns
    other than line_no and line_text aren't carried; repeated rows are each given.
    """
    known = states.select(F.lower("spelling").alias("_spelling")).where("_spelling is not null").distinct()
    parsed = error_parse(spread(lines.select("line_no", "line_text")), "line_text", len(NAMES), into="_parse", types=TYPES)
    cell = {n: F.get(F.col("_parse.cells"), i) for i, n in enumerate(NAMES)}
    joined = parsed.withColumn("_status", F.lower(cell["status"])).join(known, F.col("_status") == F.col("_spelling"), "left")
    reason = (
        F.when(F.col("_parse.quote_edits") > 0, "quoting")
        .when(F.col("_parse.delimiter_edits") > 0, "columns")
        .when(~score_valid(cell["score"]), "score")
        .when(F.col("_spelling").isNull(), "status")
        .when(cell["notes"].rlike(r"[\x00-\x08\x0b-\x1f\x7f]"), "notes")
    )
    return joined.withColumn("reason", reason).drop("_status", "_spelling")


def tracker_rejects(lines: DataFrame, states: DataFrame) -> DataFrame:
    """line_no, reason, edits: the rows that fail, each with the first reason that holds and the edits that would mend it."""
    return tracker_checked(lines, states).where("reason is not null").select("line_no", "reason", F.col("_parse.edits").alias("edits"))


def tracker_loaded(lines: DataFrame, states: DataFrame) -> DataFrame:
    """The valid rows, typed: num, date (null where malformed), score (null for ``—``), the rest as text."""
    good = tracker_checked(lines, states).where("reason is null")
    c = {n: F.get(F.col("_parse.cells"), i) for i, n in enumerate(NAMES)}
    iso = F.regexp_extract(c["date"], r"^([0-9]{4}-[0-9]{2}-[0-9]{2})$", 1)
    return good.select(
        "line_no",
        F.expr("try_cast(regexp_extract(_parse.cells[0], '^ *([0-9]{1,9}) *$', 1) as int)").alias("num"),
        F.try_to_date(F.when(iso != "", iso)).alias("date"),
        c["company"].alias("company"),
        c["role"].alias("role"),
        F.when(c["score"] != "—", F.regexp_extract(c["score"], r"^([0-9.]+)/5\z", 1).cast("double")).alias("score"),
        c["status"].alias("status"),
        c["pdf"].alias("pdf"),
        c["report"].alias("report"),
        c["notes"].alias("notes"),
    )
