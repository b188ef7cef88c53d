import random
import re
from itertools import combinations, combinations_with_replacement

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrule.operators.error_parse import mended as delimiter_edits
from ferrule.operators.error_parse import parse_batch, tracker_checked, tracker_loaded, tracker_rejects


def strict(line: str) -> int | None:
    """Number of cells, or None where a quote mark is out of place; written as a plain reader."""
    i, cells = 0, 0
    while True:
        if line[i : i + 1] == '"':
            m = re.compile(r'"(?:[^"]|"")*"(?=,|\Z)').match(line, i)
            if not m or (m.end() < len(line) and line[m.end()] != ","):
                return None
        else:
            m = re.compile(r'[^",]*(?=,|\Z)').match(line, i)
            if not m:
                return None
        cells += 1
        if m.end() >= len(line):
            return cells
        i = m.end() + 1


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(alphabet='a",\n ', max_size=12), min_size=1, max_size=6))
def test_zero_cost_is_exactly_well_formed(lines):
    for line, (cells, quotes, delimiters, _) in zip(lines, parse_batch(lines, [None] * 3)):
        n = strict(line)
        assert (quotes == 0) == (n is not None)
        if n is not None:
            assert len(cells) == n and delimiters == abs(n - 3)


def mended(line: str) -> int:
    """Fewest quote marks to insert or delete, by trying all ways."""
    from itertools import combinations

    for k in range(4):
        at = [("d", i) for i, c in enumerate(line) if c == '"'] + [("i", i) for i in range(len(line) + 1)]
        for edits in combinations(at, k):
            out, drop, add = [], {i for e, i in edits if e == "d"}, [i for e, i in edits if e == "i"]
            for i in range(len(line) + 1):
                out += ['"'] * add.count(i)
                if i < len(line) and i not in drop:
                    out.append(line[i])
            if strict("".join(out)) is not None:
                return k
    return 9


@pytest.mark.parametrize("line", ['a"b', '"ab', '"a"b', '"a" ', 'a,"b,c', '""a""', '"a,b"c', '" ","', "a,b", ' "a"', '"a""', '"a"""'])
def test_cost_is_the_fewest_quote_edits(line):
    assert parse_batch([line], [None] * 2)[0][1] == mended(line)


def row(notes="", score="3.0/5", status="Applied"):
    return f"1,2026-01-01,A,B,{score},{status},x,y,{notes}"


@pytest.fixture(scope="module")
def states(spark):
    return spark.createDataFrame([("Applied", "applied"), ("Applied", "submitted"), ("Offer", None)], "state_label string, spelling string")


@pytest.mark.parametrize(
    "line, reason",
    [
        (row(), None),
        (row('"two\nlines, and ""quotes"""'), None),
        (row(score="—"), None),
        (row(score="5/5"), None),
        (row(status="SUBMITTED"), None),
        (row("tab\there"), None),
        ('1,"x,2,' + row(), "quoting"),
        (row('"open'), "quoting"),
        (row('"a" '), "quoting"),
        (row('a"'), "quoting"),
        ("1,2,3", "columns"),
        (row(score="9.9/5") + ",more", "columns"),
        ("", "columns"),
        (None, "columns"),
        (row(score="5.1/5"), "score"),
        (row(score="4.5/5\n"), "score"),
        (row(score=".5/5"), "score"),
        (row(score="-1/5"), "score"),
        (row(score=""), "score"),
        (row(status=""), "status"),
        (row(status="applied "), "status"),
        (row("bell\x07"), "notes"),
        (row("return\r"), "notes"),
        (row("\x7f"), "notes"),
        (row("x" * 200_000), None),
    ],
)
def test_first_reason(spark, states, line, reason):
    df = spark.createDataFrame([(1, line, "clash", "clash")], "line_no bigint, line_text string, reason string, _spelling string")
    assert [r.reason for r in tracker_checked(df, states).collect()] == [reason]


def test_loaded_rows_are_typed_and_nothing_is_lost(spark, states):
    lines = [(1, row("n")), (2, row("n")), (3, row(score="—")), (4, "bad"), (5, '"1",2026-13-45,A,B,3/5,applied,x,y,z')]
    df = spark.createDataFrame(lines, "line_no bigint, line_text string")
    good, bad = tracker_loaded(df, states).orderBy("line_no").collect(), tracker_rejects(df, states).collect()
    assert [r.line_no for r in good] == [1, 2, 3, 5] and [r.line_no for r in bad] == [4]
    assert good[0].num == 1 and str(good[0].date) == "2026-01-01" and good[0].score == 3.0
    assert good[2].score is None and good[3].date is None and bad[0].edits


def test_empty_table(spark, states):
    df = spark.createDataFrame([], "line_no bigint, line_text string")
    assert tracker_rejects(df, states).count() == 0 and tracker_loaded(df, states).count() == 0


def test_all_delimiter_edits_are_given():
    cells, _, wrong, edits = parse_batch([",".join("x" * 60)], [None] * 9)[0]
    assert len(cells) == 60 and wrong == 51 and edits == [f"delete delimiter at {2 * j + 1}" for j in range(8, 59)]


def slow_misfits(cells, places, line, types):
    """The least misfits over every choice of delimiters to delete or of places to insert them."""
    fits = lambda parts: sum(t is not None and not re.fullmatch(t, x) for t, x in zip(types, parts))
    extra = len(cells) - len(types)
    if extra > 0:
        return min(fits(split_at(line, [p for p in places if p not in gone])) for gone in combinations(places, extra))
    marks = range(len(line) + 1)
    return min(fits(split_at(line, places, new)) for new in combinations_with_replacement(marks, -extra))


def split_at(line, places, new=()):
    text, parts = "", []
    for i in range(len(line) + 1):
        for _ in range(list(new).count(i)):
            parts.append(text)
            text = ""
        if i in places:
            parts.append(text)
            text = ""
        elif i < len(line):
            text += line[i]
    return [*parts, text]


def applied(line, places, edits):
    gone = {int(e.split()[-1]) for e in edits if e.startswith("delete")}
    return split_at(line, [p for p in places if p not in gone], [int(e.split()[-1]) for e in edits if e.startswith("insert")])


def test_delimiter_edits_fit_the_types_best():
    rng = random.Random(4)
    types = [r"\d+", r"\d{2}-\d{2}", None, r"[a-z]+|"]
    for _ in range(300):
        line = "".join(rng.choice("12a-,,") for _ in range(rng.randint(0, 9))) if rng.random() < 0.5 else rng.choice(["112-34,x,a", "1,12-34xa", "1,12-34,a,b,c", "1,1,2-3,x", "7,12-34,x,y,z,abc"])
        places = [i for i, c in enumerate(line) if c == ","]
        cells = line.split(",")
        if len(cells) == len(types):
            continue
        edits = delimiter_edits(cells, places, line, types)
        parts = applied(line, places, edits)
        assert len(edits) == abs(len(cells) - len(types)) and len(parts) == len(types)
        got = sum(t is not None and not re.fullmatch(t, x) for t, x in zip(types, parts))
        if len(cells) > len(types) or len(types) - len(cells) == 1:
            assert got == slow_misfits(cells, places, line, types), line


def test_missing_first_delimiter_is_reported_at_its_place(spark, states):
    line = "12026-01-01,A,B,3.0/5,Applied,✅,[0](reports/0.md),z"
    df = spark.createDataFrame([(1, line), (2, "1,2026-01-01,A,B, more,3.0/5,Applied,✅,[0](reports/0.md),z"), (3, "x" * 300_000)], "line_no bigint, line_text string")
    got = {r.line_no: r.edits for r in tracker_rejects(df, states).collect()}
    assert got[1] == ["insert delimiter at 1"] and got[2] == ["delete delimiter at 16"] and len(got[3]) == 8
