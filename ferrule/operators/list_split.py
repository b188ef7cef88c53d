"""Several values packed in one field: a quote-aware finite-state tokenizer.

One pass over the characters tracks quoting (double or single marks that open a
value), doubled marks and backslash escapes, and the nesting depth of brackets.
A delimiter counts only outside quotes and at depth zero. Delimiters need not be
the same throughout a cell. Some characters are a delimiter in one place and part
of a value in another; what stands on both sides decides:

* ``/``, ``+`` and raised dots only with blanks around them, so ``CI/CD`` and ``C++`` stay whole;
* ``+`` not before a supplement of a pay figure (``90k + bonus``);
* ``,`` not between digits (``84,000``) and not before a two-letter state code
  that ends a value (``Port Ansel, CO``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.plans.session import spread

# Marks that separate values wherever they stand outside quotes and brackets.
HARD = set(";|\n\t\r")
DOTS = set("•·")
OPENING, CLOSING = {"(": ")", "[": "]", "{": "}"}, set(")]}")
PAY = re.compile(r"(?:[$€£]\s?~?\d|\d[\d.,]*\s?[kK]?\s?(?:USD|EUR|GBP|PLN|CHF|[$€£])|\d[kK]\b)")
SUPPLEMENT = re.compile(r"\s*\+\s*(?:bonus|equity|stock|options|benefits|commission|super|car|RSUs?)\b", re.IGNORECASE)
STATE = re.compile(r",\s*[A-Z]{2}(?=\s*(?:$|[;|\n\t\r•·,\"')])|\s+(?:/|\+|\d+\)))")
NUMBERING = re.compile(r"(?:\(?\d{1,3}[.)]\)?|[-–*•·▪◦✔])(?=\s)\s*")
NUMBERED = re.compile(r"\s*\(?1[.)]\s")
#: A sentence: three words or more up to a closing full stop, question or exclamation mark.
SENTENCE_END = re.compile(r"[.!?…][\"'”’)]*\s*$")


#: A full stop or exclamation mark after a word, not one of an abbreviation or ellipsis.
FULL_STOP = re.compile(r"(?<=[^\W_]{2})[.!]$")


def cut(text: str) -> list[str]:
    """Raw values in order, still with their quotes and list marks."""
    out: list[str] = []
    start, depth, quote, i, n = 0, 0, "", 0, len(text)
    numbered, expected = bool(NUMBERED.match(text)), 1
    closers: list[str] = []

    def blank_so_far(at: int) -> bool:
        return not NUMBERING.sub("", text[start:at], count=1).strip()

    while i < n:
        c = text[i]
        if quote:
            if c == "\\" and i + 1 < n:
                i += 2
                continue
            if c == quote:
                if i + 1 < n and text[i + 1] == quote:
                    i += 2
                    continue
                quote = ""
            i += 1
            continue
        if c in "\"'" and blank_so_far(i) and closes(text, i):
            quote = c
        elif c in OPENING:
            if text.find(OPENING[c], i) > 0:
                depth += 1
                closers.append(OPENING[c])
        elif depth:
            if c == closers[-1]:
                closers.pop()
                depth -= 1
        elif c in HARD:
            out.append(text[start:i])
            start = i + 1
        elif c in DOTS and (not i or text[i - 1].isspace()) and (i + 1 == n or text[i + 1].isspace()):
            if not blank_so_far(i):  # else it is a list mark
                out.append(text[start:i])
                start = i + 1
        elif c == "/" and i and text[i - 1].isspace():
            end = i + 1 + text.startswith("/", i + 1)
            if end >= n or text[end].isspace():
                out.append(text[start:i])
                start = i = end
                continue
        elif c == "+" and i and text[i - 1].isspace() and (i + 1 == n or text[i + 1].isspace()):
            if not (SUPPLEMENT.match(text, i) and PAY.search(text[start:i])):
                out.append(text[start:i])
                start = i + 1
        elif c == ",":
            between = i and i + 1 < n and text[i - 1].isdigit() and text[i + 1].isdigit()
            if not between and not (STATE.match(text, i) and tidy(text[start:i])[:1].isupper()):
                out.append(text[start:i])
                start = i + 1
        elif numbered and c.isdigit() and (not i or text[i - 1].isspace()):
            mark = re.compile(rf"\(?{expected}[.)]\s").match(text, i)
            if mark:
                if expected > 1:
                    out.append(text[start:i])
                start, i, expected = mark.end(), mark.end(), expected + 1
                continue
        i += 1
    out.append(text[start:])
    return out


def closes(text: str, at: int) -> bool:
    """Whether the quote mark at ``at`` has a partner that ends a value."""
    mark, i, n = text[at], at + 1, len(text)
    while i < n:
        if text[i] == "\\":
            i += 2
            continue
        if text[i] == mark:
            if i + 1 < n and text[i + 1] == mark:
                i += 2
                continue
            rest = text[i + 1 : i + 3]
            return not rest.strip() or rest.lstrip()[0] in ";|\n\t\r•·,/+" or rest[0] in ";|\n\t\r•·,"
        i += 1
    return False


def tidy(value: str) -> str:
    """Trimmed, without list mark or numbering, without enclosing quotes, doubled marks made single."""
    value = value.strip()
    value = NUMBERING.sub("", value, count=1).strip() if NUMBERING.match(value) else value
    if len(value) >= 2 and value[0] in "\"'" and value[-1] == value[0]:
        mark = value[0]
        inner = value[1:-1]
        if mark not in inner.replace(mark * 2, "").replace("\\" + mark, ""):
            value = inner.replace(mark * 2, mark).replace("\\" + mark, mark).strip()
    return value


def sentences(text: str, found: list[str]) -> bool:
    """Whether a cell, of which the tokenizer made the values ``found``, is running text.

    It ends like a sentence, no part of it is bulleted, numbered or on a line of its own, and
    the values between its delimiters are clauses rather than facts: some value has more than three
    words (of two values only, more than two), or commas part it in two only.
    """
    if not SENTENCE_END.search(text) or text.count("\n") or NUMBERED.match(text) or len(text.split()) < 3:
        return False
    marked = any(c in text for c in ";|\t•·")
    longest = max((len(v.split()) for v in found), default=0)
    return longest > (3 if len(found) > 2 else 2) or len(found) < (2 if marked else 3)


def values(text: str) -> list[str]:
    """The non-empty values of one cell, in order; [] for running text and for empty cells. A list that ends like a sentence ends without its full stop."""
    if not text or not text.strip():
        return []
    found = [v for v in map(tidy, cut(text)) if v]
    if sentences(text, found):
        return []
    if len(found) > 1 and FULL_STOP.search(found[-1]) and not any(FULL_STOP.search(v) for v in found[:-1]):
        found[-1] = FULL_STOP.sub("", found[-1])
    return found


def split_values(df: DataFrame, key: str, text: str, least: int = 2, index: str = "seq_no", item: str = "item") -> DataFrame:
    """One row per value of ``text``: ``key``, ``index`` (from 1, empty values not counted) and ``item``.

    Cells with fewer than ``least`` values, null and empty cells and running text
    give no rows. Text of any length is read whole; repeated rows of ``df`` give
    repeated rows. Other columns of ``df`` aren't carried.
    """

    @F.pandas_udf("array<string>")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for cells in batches:
            yield pd.Series([values(x) if isinstance(x, str) else None for x in cells], index=cells.index)

    cells = spread(df.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t")).where("_t is not null and _t <> ''"))
    got = cells.select("_k", tokens("_t").alias("_v")).where(F.size("_v") >= least)
    return got.select("_k", F.posexplode("_v").alias("_i", "_x")).select(
        F.col("_k").alias(key), (F.col("_i") + 1).cast("int").alias(index), F.col("_x").alias(item)
    )
