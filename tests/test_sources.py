import json
import zipfile

import pytest

from ferrule.sources import sinks, text_tables
from ferrule.sources.boards import PROVIDERS, board_files, postings_of, provider_for
from ferrule.sources.workbook import register


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    register(spark)


def test_tracker_round_trip(spark, tmp_path):
    rows = [(1, "1", "2026-01-01", "A|B", "Dev", "4.2/5", "Applied", "x", "r", "a\\b"), (2, "2", "", "C", "Ops", "—", "Offer", "", "", "")]
    cols = ["num", "date", "company", "role", "score", "status", "pdf", "report", "notes"]
    df = spark.createDataFrame(rows, "pos int, " + ", ".join(f"{c} string" for c in cols))
    sinks.write_markdown(df, cols, "pos", str(tmp_path / "t"))
    got = text_tables.tracker_rows(spark, str(tmp_path / "t" / "*.txt")).orderBy("pos").collect()
    assert [(r.company, r.notes, r.score) for r in got] == [("A|B", "a\\b", "4.2/5"), ("C", "", "—")]


def test_drifting_columns(spark, tmp_path):
    (tmp_path / "t.md").write_text("intro\r\n\r\n| # | Empresa | Role | Score | Status | Notas |\r\n|---|---|---|---|---|---|\r\n| 7 | X | Dev | Applied | 3/5 | a | b |\r\n| x | Y | Ops |\r\n\r\n| other | table |\r\n")
    got = text_tables.tracker_rows(spark, str(tmp_path / "t.md")).orderBy("pos").collect()
    assert [(r.num, r.company, r.score, r.status, r.notes, r.swapped, r.bad_num) for r in got] == [(7, "X", "3/5", "Applied", "a | b", True, False), (None, "Y", "", "", "", False, True)]


def test_ragged_rows(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("url\tday\tname\n# note\na\tb\tc\textra\nx\ty\nz\n")
    good, bad = text_tables.ragged_rows(spark, str(tmp_path / "h.tsv"), ["url", "day", "name"], 2)
    assert [(r.url, r.name) for r in good.orderBy("line_no").collect()] == [("a", "c"), ("x", None)]
    assert [(r.line, r.reason) for r in bad.collect()] == [("z", "1 cells, 2 needed")]


def test_bullets_and_summary(spark, tmp_path):
    (tmp_path / "p.md").write_text("## Pending\n### Hot\n- [ ] u | c | t\n- [x] v\n## Done\n- [ ] w\ntext\n")
    got = text_tables.bullets(spark, str(tmp_path / "p.md")).orderBy("line_no").collect()
    assert [(r.section, r.subsection, r.done, r.parts) for r in got] == [("Pending", "Hot", False, ["u", "c", "t"]), ("Pending", "Hot", True, ["v"]), ("Done", None, False, ["w"])]
    (tmp_path / "r.md").write_text('# R\n```yaml\ncompany: "Acme"\nscore: 4.5\nother: 1\n```\n')
    r = text_tables.fenced_summary(spark, str(tmp_path / "r.md"), ["company", "score", "role"]).first()
    assert (r.company, r.score, r.role) == ("Acme", "4.5", None)


def test_utf16_table(spark, tmp_path):
    (tmp_path / "e_TX.csv").write_bytes("name\tcity\nÄ Co\tX\n".encode("utf-16-le"))
    assert [(r.name, r.city) for r in text_tables.utf16_table(spark, str(tmp_path / "e_TX.csv")).collect()] == [("Ä Co", "X")]


def test_boards(spark, tmp_path):
    (tmp_path / "acme.leafhire.example.json").write_text(
        json.dumps({"jobs": [{"title": " Dev ", "absolute_url": "u1", "location": {"name": "Rome"}, "updated_at": "2026-01-02T03:04:05Z"}, {"title": "", "absolute_url": "u2"}]})
    )
    (tmp_path / "bad.persona.example.json").write_text("{")
    page = '<script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "Ops", "url": "u3", "hiringOrganization": {"name": "Beta"}}]}</script>'
    (tmp_path / "beta.site.example.html").write_text(page)
    (tmp_path / "feed.rss.example.xml").write_text("<rss><channel><item><title>T</title><link>u4</link></item></channel></rss>")
    got = {r.url: (r.title, r.company, r.location, r.provider) for r in spark.read.format("boards").option("path", f"{tmp_path}/*").load().collect()}
    assert got == {"u1": ("Dev", "acme", "Rome", "leafhire"), "u3": ("Ops", "Beta", "", "page"), "u4": ("T", "feed", "", "feed")}
    assert provider_for("https://boards.leafhire.example/x").name == "leafhire" and provider_for("x", "none") is None
    assert provider_for("https://a.leafhire.example", skip=frozenset({"leafhire"})).name == "page"


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>Ac</t></r><r><t>me</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr(
            "xl/worksheets/sheet2.xml",
            f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>wage</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>12.5</v></c></row><row/></sheetData></worksheet>',
        )
    got = spark.read.format("workbook").option("path", f"{tmp_path}/*.xlsx").load().orderBy("row_no").collect()
    assert [dict(r.cells) for r in got] == [{"name": "Acme", "wage": "12.5"}, {"name": "", "wage": ""}]


def test_versions_and_safe_cells(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "v"))
    assert t.read() is None
    for n in (1, 2, 3):
        t.replace(spark.range(n))
    assert t.version() == 3 and t.read().count() == 3 and not (tmp_path / "v" / "v1").exists()
    df = spark.createDataFrame([("=1+1", "a\tb"), (None, "-x")], "a string, b string")
    sinks.write_separated(df, ["a", "b"], str(tmp_path / "s"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "s")).collect()) == ["\t'-x", "'=1+1\ta b"]


DAY = "2026-01-02T03:04:05Z"
PAYLOADS = {
    "acme.greenhouse.io": {"jobs": [{"title": "Dev", "absolute_url": "https://x/1", "location": {"name": "Rome"}, "first_published": DAY}]},
    "acme.lever.co": [{"text": "Dev", "hostedUrl": "https://x/1", "categories": {"location": "Rome"}, "createdAt": 1767323045000}],
    "acme.ashbyhq.com": {"jobs": [{"title": "Dev", "jobUrl": "https://x/1", "location": "Rome", "publishedAt": DAY}]},
    "acme.myworkdayjobs.com": {"jobPostings": [{"title": "Dev", "externalPath": "/job/1", "locationsText": "Rome"}]},
    "acme.smartrecruiters.com": {"content": [{"name": "Dev", "id": "7", "company": {"identifier": "Acme", "name": "acme"}, "location": {"city": "Rome"}, "releasedDate": DAY}]},
    "acme.recruitee.com": {"offers": [{"title": "Dev", "url": "https://x/1", "city": "Rome", "published_at": DAY}]},
    "acme.breezy.hr": [{"name": "Dev", "url": "https://x/1", "location": {"name": "Rome"}, "published_date": DAY}],
    "acme.bamboohr.com": {"result": [{"jobOpeningName": "Dev", "id": 5, "location": {"city": "Rome"}}]},
    "acme.rippling.com": [{"name": "Dev", "url": "https://x/1", "workLocation": {"label": "Rome"}}],
    "acme.pinpointhq.com": {"data": [{"title": "Dev", "url": "https://x/1", "location": {"city": "Rome"}}]},
    "acme.arbeitnow.com": {"data": [{"title": "Dev", "url": "https://x/1", "company_name": "acme", "location": "Rome", "created_at": 1767323045}]},
    "acme.remotive.com": {"jobs": [{"title": "Dev", "url": "https://x/1", "company_name": "acme", "candidate_required_location": "Rome", "publication_date": "2026-01-02T03:04:05"}]},
    "acme.remoteok.com": [{"legal": "x"}, {"position": "Dev", "url": "https://x/1", "company": "acme", "location": "Rome", "epoch": 1767323045, "salary_min": 1, "salary_max": 2}],
    "acme.himalayas.app": {"jobs": [{"title": "Dev", "applicationLink": "https://x/1", "companyName": "acme", "locationRestrictions": ["Rome"], "pubDate": 1767323045}]},
    "acme.jobicy.com": {"jobs": [{"jobTitle": "Dev", "url": "https://x/1", "companyName": "acme", "jobGeo": "Rome", "pubDate": "2026-01-02 03:04:05"}]},
    "acme.themuse.com": {"results": [{"name": "Dev", "refs": {"landing_page": "https://x/1"}, "company": {"name": "acme"}, "locations": [{"name": "Rome"}], "publication_date": DAY}]},
    "acme.workingnomads.com": [{"title": "Dev", "url": "https://x/1", "company_name": "acme", "location": "Rome", "pub_date": DAY}],
}


@pytest.mark.parametrize("host", sorted(PAYLOADS))
def test_provider_payloads(host):
    p = provider_for(f"https://{host}/x")
    assert p.name in host
    (row,) = postings_of(json.dumps(PAYLOADS[host]), p, "acme", host)
    assert row[2] == "Dev" and row[3].startswith("https://") and row[4:6] == ("acme", "Rome")
    assert row[7] is None or row[7].isoformat() == "2026-01-02T03:04:05+00:00"
    assert postings_of("{", p, "acme") == [] and postings_of('{"jobs": 3}', p, "acme") == []


def test_other_payload_forms():
    by = {p.name: p for p in PROVIDERS}
    xml = "<positions><position><id>9</id><name>Dev</name><office>Rome</office><office>Bari</office><createdAt>2026-01-02T03:04:05+00:00</createdAt></position><position><name>No id</name></position></positions>"
    assert [r[2:6] for r in postings_of(xml, by["personio"], "acme", "acme.personio.de")] == [("Dev", "https://acme.personio.de/job/9", "acme", "Rome, Bari")]
    rss = "<rss><channel><item><title>Dev</title><link>u</link><pubDate>Fri, 02 Jan 2026 03:04:05 +0000</pubDate></item></channel></rss>"
    assert postings_of(rss, by["larajobs"], "b")[0][7].isoformat() == "2026-01-02T03:04:05+00:00"
    page = '<script id="__NEXT_DATA__" type="application/json">{"p": [{"title": "Dev", "url": "/jobs/1", "location": {"name": "Rome"}}, {"title": "Blog", "url": "/blog"}]}</script>'
    page += '<div itemscope itemtype="https://schema.org/JobPosting"><h1 itemprop="title">Ops &amp; co</h1><a itemprop="url" href="/jobs/2">x</a><span itemprop="addressLocality">Bari</span></div>'
    assert [r[2:6] for r in postings_of(page, by["page"], "acme")] == [("Dev", "/jobs/1", "acme", "Rome"), ("Ops & co", "/jobs/2", "acme", "Bari")]


def test_board_files_equal_the_source(spark, tmp_path):
    for host, data in PAYLOADS.items():
        (tmp_path / f"{host}.json").write_text(json.dumps(data))
    (tmp_path / "bad.lever.co.json").write_text("{")
    key = lambda df: sorted((r.provider, r.title, r.url, r.company, r.location, str(r.posted_at)) for r in df.collect())
    got = key(board_files(spark, str(tmp_path)))
    assert len(got) == len(PAYLOADS) and got == key(spark.read.format("boards").option("path", f"{tmp_path}/*").load())
