import pytest

from ferrule.operators.list_split import split_values, values


@pytest.mark.parametrize(
    "text, items",
    [
        ("a; b;c", ["a", "b", "c"]),
        ("CI/CD / A/B testing // PL/SQL", ["CI/CD", "A/B testing", "PL/SQL"]),
        ("C++ + Go + £90k + bonus", ["C++", "Go", "£90k + bonus"]),
        ("Port Ansel, CO | $84,000-109,500 (POSTED)", ["Port Ansel, CO", "$84,000-109,500 (POSTED)"]),
        ('Python, "Port Ansel, CO", panel (two people; friendly)', ["Python", "Port Ansel, CO", "panel (two people; friendly)"]),
        ('"said ""maybe Q3""";x', ['said "maybe Q3"', "x"]),
        ("'a, b', c", ["a, b", "c"]),
        ("- Rio, CO\n- Go\n- x", ["Rio, CO", "Go", "x"]),
        ("1) said \"maybe\" 2) Scala 3) Go", ['said "maybe"', "Scala", "Go"]),
        ("a |  | b|", ["a", "b"]),
        ("PTO 25d, CI/CD", ["PTO 25d", "CI/CD"]),
        ("a · b • c", ["a", "b", "c"]),
        ("x\ty", ["x", "y"]),
        ("it's, fine", ["it's", "fine"]),
        ("(open; x", ["(open", "x"]),
        ("Recruiter called, sounds keen; will get back next week.", []),
        ("", []),
        ("   ", []),
        (";;;", []),
        ("one", ["one"]),
    ],
)
def test_values(text, items):
    assert values(text) == items


def test_long_text_is_read_whole():
    assert len(values(";".join(["x"] * 50_000))) == 50_000


def test_rows_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a;b", "s"), (1, "a;b", "s"), (2, None, "s"), (3, "one", "s"), (None, "x|y", "s")], "id bigint, notes string, item string")
    got = sorted((r.id or 0, r.seq_no, r["item"]) for r in split_values(df, "id", "notes").collect())
    assert got == [(0, 1, "x"), (0, 2, "y"), (1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]
    assert split_values(df.limit(0), "id", "notes").count() == 0
