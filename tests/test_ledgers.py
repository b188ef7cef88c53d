"""Ledger readers and sinks against small files."""

import os

from pyspark.sql import functions as F

from ferrule.sources import ledgers, sinks


def test_status_log(spark, tmp_path):
    lines = ["1\t2026-06-01\tEvaluated\tApplied\tset-status\t", "2\t2026-06-01\t-\tApplied\tset-status\tx", "5\t2026-06-02\t-\t-\tset-status\tback", "6\t2026-06-03\tEvaluated\tApplied\timport\t", "x\t2026-06-01\tA\tApplied\tset-status\t", "7\t06/01/2026\tA\tApplied\tset-status\t", "8\t2026-02-30\tA\tApplied\tset-status\t", "9\t2026-06-01\tA\tShortlisted\tset-status\t", "9\t2026-06-01", "", "# comment"]
    (tmp_path / "s.tsv").write_text("\n".join(lines))
    states = spark.createDataFrame([("Applied",), ("Evaluated",), (None,)], "label string")
    good, bad, other = ledgers.status_log(spark, str(tmp_path / "s.tsv"), states)
    assert [(r["num"], r["from"], r["to"], r["day_math"]) for r in good.orderBy("line_no").collect()] == [(1, "Evaluated", "Applied", True), (2, None, "Applied", True), (5, None, "-", True), (6, "Evaluated", "Applied", False)]
    assert [r.reason for r in bad.orderBy("line_no").collect()] == ["bad number", "bad date", "bad date", "unknown state Shortlisted", "2 cells, 5 needed"]
    assert [(r.num, r.source) for r in other.collect()] == [(6, "import")]


def test_typed_log(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("num\tday\tscore\tpay\n1\t2026-01-02\t85 %\t84,000\n2\t\t\t\n\t2026-01-02\t1%\t1\n3\t2026-13-02\t120.5\tx\n")
    good, bad = ledgers.typed_log(spark, str(tmp_path / "a.tsv"), {"num": "int", "day": "date", "score": "percent", "pay": "double"}, ("num",))
    assert [(r.num, str(r.day), r.score, r.pay) for r in good.orderBy("num").collect()] == [(1, "2026-01-02", 85.0, 84000.0), (2, "None", None, None)]
    assert [r.reason for r in bad.orderBy("line_no").collect()] == ["bad num", "bad day, pay"]


def test_which_line_counts(spark, tmp_path):
    (tmp_path / "p.md").write_text("- #1 next: 2026-01-02\n- #1 Next 2026-02-03\n- #1 next: 2026-02-31\n- #2 called\n")
    assert [(r.num, str(r.pinned)) for r in ledgers.last_pins(spark, str(tmp_path / "p.md")).collect()] == [(1, "2026-02-03")]
    (tmp_path / "i.tsv").write_text("7\ta.pdf\t1\n8\tb.pdf\t2\n7\tc.pdf\t3\nx\td.pdf\t4\n")
    assert sorted((r.num, r.file, r.n) for r in ledgers.last_per_number(spark, str(tmp_path / "i.tsv"), ["num", "file", "n"]).collect()) == [(7, "c.pdf", "3"), (8, "b.pdf", "2")]
    (tmp_path / "b.md").write_text("| Company | Reason |\n|---|---|\n| Acme Inc | slow |\n| ACME, inc | late |\n| -- | none |\n| Beta |\n")
    assert sorted((r.company_key, r.company, r.reason) for r in ledgers.blacklist(spark, str(tmp_path / "b.md")).collect()) == [("acmeinc", "Acme Inc", "slow"), ("beta", "Beta", "")]
    df = spark.createDataFrame([("x | y | https://a.example/1",), ("https://a.example/1",), ("a | b",), (None,)], "notes string")
    assert [r.link for r in ledgers.links_in_notes(df, "notes").collect()] == ["https://a.example/1", None, None, None]


def test_stories(spark, tmp_path):
    (tmp_path / "s.md").write_text("# Bank\n### [Lead] Moved the team\n**Task:** move it\n**Best for questions about:** Change, Risk; \n### Plain\n**Result:** fine\n")
    got = [(r.theme, r.title, r.task, r.result, r.tags) for r in ledgers.stories(spark, str(tmp_path / "s.md")).orderBy("nth").collect()]
    assert got == [("Lead", "Moved the team", "move it", "", ["change", "risk"]), ("", "Plain", "", "fine", [])]


def test_sections_counters_and_views(spark, tmp_path):
    assert sinks.append_to_section(None, "Pending", ["- [ ] a"]) == "## Pending\n\n- [ ] a\n"
    doc = "# P\n\n## Pending\n\n- [ ] a\n\n## Done\n- [x] z\n"
    assert sinks.append_to_section(doc, "Pending", ["- [ ] b"]) == "# P\n\n## Pending\n\n- [ ] a\n- [ ] b\n\n## Done\n- [x] z\n"
    assert sinks.append_to_section(doc, "Pending", []) == doc and sinks.append_to_section(doc, "New", ["x"]).endswith("## New\n\nx\n")
    for n in (1, 2):
        sinks.append_counters(spark, str(tmp_path / "c"), f"2026-01-0{n}", {"found": n, "kept": 0})
    assert spark.read.parquet(str(tmp_path / "c")).where("name = 'found'").agg(F.sum("n")).first()[0] == 3
    df = spark.createDataFrame([(1, "abcdef"), (None, None)], "a int, b string")
    assert [r.line for r in sinks.rendered(df, "table", {"a": 3, "b": 4}).collect()] == ["1    abc…", ""]
    assert [r.line for r in sinks.rendered(df, "json").collect()] == ['{"a":1,"b":"abcdef"}', '{"a":null,"b":null}']


def test_lock(spark, tmp_path):
    a, b = sinks.TableLock(spark, str(tmp_path)), sinks.TableLock(spark, str(tmp_path), stale_ms=60_000)
    assert a.acquire() and not b.acquire()
    os.utime(tmp_path / "_lock", (1, 1))
    assert b.acquire() and not a.acquire() is True
    b.release()
    assert a.acquire()
