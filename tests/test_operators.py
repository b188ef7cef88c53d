import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ferrule.functions import scalars as S
from ferrule.functions.links import posting_key
from ferrule.operators import filters, joins, merges, ordered, queue


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(
    "text, low, high",
    [("84k", 84000, 84000), ("$84,000-109,500", 84000, 109500), ("90-80k", 80000, 90000), ("161,500 USD", 161500, 161500), ("ask me", None, None), (None, None, None), ("", None, None)],
)
def test_money(spark, text, low, high):
    got = one(spark, S.money, text)
    assert (got.low, got.high, got.mid) == (low, high, (low + high) / 2) if low else got is None


@pytest.mark.parametrize("day, week", [("2025-12-29", "2026-W01"), ("2026-01-01", "2026-W01"), ("2024-12-31", "2025-W01"), ("2027-01-01", "2026-W53")])
def test_iso_week(spark, day, week):
    assert one(spark, lambda c: S.iso_week(c.cast("date")), day) == week


@pytest.mark.parametrize("x, digits, want", [(-2.5, 0, -2), (2.5, 0, 3), (0.25, 1, 0.3)])
def test_half_up(spark, x, digits, want):
    assert one(spark, lambda c: S.round_half_up(c, digits), x, "double") == want


@pytest.mark.parametrize("text, days, least", [("Posted 30+ Days Ago", 30, True), ("5 days ago", 5, False), ("Posted Today", 0, False), ("Yesterday", 1, False)])
def test_relative_age(spark, text, days, least):
    got = one(spark, S.relative_age, text)
    assert (got.days, got.at_least) == (days, least)


@pytest.mark.parametrize(
    "url, want",
    [
        ("http://Jobs.X.example:443/a/?utm_source=q&b=2&a=1#top", "https://jobs.x.example/a?a=1&b=2"),
        ("https://x.example/p?lang=de", "https://x.example/p"),
        ("https://x.example/p?lang=java", "https://x.example/p?lang=java"),
        ("mailto:a@b", "mailto:a@b"),
        ("not a link", "not a link"),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, S.canonical_url, url) == want


@pytest.mark.parametrize(
    "url, key",
    [
        ("HTTP://Boards.Leafhire.Example:80//embed/job_app?lh_jid=7&for=Acme,", "leafhire|acme|7"),
        ("boards.leafhire.example/acme/jobs/7.", "leafhire|acme|7"),
        ("https://click.mailroute.example/r?u=https%3A%2F%2Facme.jobs.persona.example%2Fjob%2F9%3Fx%3D1", "persona|acme|9"),
        ("(https://acme.wd4.dayworks.example/en%2DUS/careers/job/rome/some-title_R12/apply#x)", "dayworks|acme.wd4|r12"),
        ("https://careers.acme.example/openings?lang=java&ref_no=5", "careers|acme|5"),
        ("https://careers.acme.example/job?source=5&trk=x", "careers|acme|5"),
        ("https://jobs.crankshaft.example/acme/6484733c%2De736-1fbb-617f-43fe07f4e3a9/apply?", "crankshaft|acme|6484733c-e736-1fbb-617f-43fe07f4e3a9"),
        ("https://elsewhere.example/x", None),
        ("%%%", None),
        ("", None),
        (None, None),
    ],
)
def test_posting_key(spark, url, key):
    assert one(spark, posting_key, url) == key


def test_scalars_of_text(spark):
    assert one(spark, S.role_key, "Data Engineer (Remote) [m/f/d]") == "dataengineer"
    assert one(spark, S.html_text, "<p>a &amp; b</p><script>x</script><li>c</li>") == "a & b\nc"
    assert one(spark, S.sentences, "See e.g. this. Now! Ok") == ["See e.g. this.", "Now!", "Ok"]
    assert one(spark, S.slug, " C++ & Go! ") == "c-go"
    assert one(spark, S.initials, "Éva-Maria stone ltd") == "ÉM"
    assert one(spark, S.emails, "to a.b@x.example, c@y.example") == ["a.b@x.example", "c@y.example"]
    assert one(spark, S.last_object_with_status, 'x {"status": "a"} {bad} {"q": "}", "status": "b"} {"z": 1}') == '{"q": "}", "status": "b"}'
    assert one(spark, S.compatibility_key, "ＬeafHire ") == "leafhire"
    assert one(spark, S.strict_date, "2026-2-3") is None and one(spark, S.strict_date, "2026-02-30") is None
    assert one(spark, S.simhash64, "a b") is None and one(spark, S.simhash64, None) is None


def test_fingerprint_counts_every_run_of_any_script(spark):
    text = "дом сад <b>лес</b> &amp; https://x.example/y " * 30 + "река"
    words = " ".join(["дом сад лес"] * 30 + ["река"]).split(" ")
    votes = [0] * 64
    for i in range(len(words) - 2):
        h = int.from_bytes(hashlib.sha1(" ".join(words[i : i + 3]).encode()).digest()[:8], "big")
        votes = [v + (1 if h >> (63 - b) & 1 else -1) for b, v in enumerate(votes)]
    want = sum(1 << (63 - b) for b, v in enumerate(votes) if v > 0)
    assert one(spark, S.simhash64, text) & (2**64 - 1) == want
    assert one(spark, S.simhash64, "word " * 39) is None and one(spark, S.simhash64, "字" * 300) is None


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Senior Data Engineer, Payments", "Principal Data Engineer, Payments", False), ("Senior Data Platform Lead", "Senior Staff Data Platform", True), ("Data Engineer, Payments", "Senior Data Engineer, Payments", True),
        ("Full Stack Engineer, Foundation", "Full Stack Engineer, Guarded Releases", False), ("Software Engineer", "Software Engineer", False), ("AI ML Lead", "AI ML Lead", False), ("API SDK", "SDK, API (Remote)", True), (None, "x", None), ("", "", False),
    ],
)
def test_same_role(spark, a, b, same):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(S.same_role(F.col("a"), F.col("b"))).first()[0] in ({same} if same is not None else {None, False})


def test_cross_listings(spark):
    rows = [(1, 7, "a", "u1"), (2, 7, "b", "u2"), (3, 7, "b", "u2"), (4, 6, "c", "u4"), (5, 7, "a", "u5"), (6, -1, "a", "u6"), (7, 7, "d", "u1"), (8, None, "e", "u8"), (9, 6, None, None)]
    df = spark.createDataFrame(rows, "id int, f bigint, o string, l string")
    got = {(r.a, r.b, r.distance) for r in joins.cross_listings(df, "id", "f", "o", "l", 2).collect()}
    assert got == {(1, 2, 0), (4, 9, 0), (1, 4, 1), (2, 4, 1), (4, 5, 1), (4, 7, 1), (1, 9, 1), (2, 9, 1), (5, 9, 1), (7, 9, 1)}
    assert joins.cross_listings(df.limit(0), "id", "f", "o", "l").count() == 0


def test_filters(spark):
    df = spark.createDataFrame([("Sr AI lead", 1), ("Mainframe", 2), (None, 3), ("Junior data", 4)], "t string, i int")
    ok = lambda c: [r.i for r in df.where(c).orderBy("i").collect()]
    assert ok(filters.title_filter(F.col("t"), ["ai", "data"], ["junior"])) == [1]
    assert ok(filters.title_filter(F.col("t"), [], ["junior"])) == [1, 2, 3]
    assert ok(filters.place_filter(F.col("t"), ["lead"], ["main"], [])) == [1, 3]
    assert filters.Spec.from_params({"limit": "9999", "x": "y", "since": ""}).limit == 500
    ranges = spark.createDataFrame([(1, None, 5.0), (2, 1.0, None), (3, None, None), (4, 8.0, 9.0)], "i int, a double, b double")
    got = lambda lo, hi: [r.i for r in ranges.where(filters.ranges_overlap(F.col("a"), F.col("b"), lo, hi)).orderBy("i").collect()]
    assert got(4, 6) == [1, 3] and got(None, 2) == [2, 3] and got(9, 1) == [1, 2, 3, 4]


LEDGER = [
    (1, "a", "2026-01-05", "Applied", "x"),
    (2, "a", "2026-01-03", "Responded", "x"),
    (3, "a", "2026-01-02", "Applied", "correction"),
    (4, "a", "2026-01-09", "Offer", "x"),
    (5, "a", "2026-01-10", "-", "x"),
    (6, "b", "2026-01-01", "-", "x"),
    (7, "b", None, None, "x"),
]


def replay(rows):
    out: dict = {}
    for _, k, day, to, source in rows:
        t = out.setdefault(k, [])
        same = [i for i, (s, _) in enumerate(t) if s == to]
        if to is None:
            continue
        if to == "-":
            t[-1:] = []
        elif source == "correction" and same:
            t[same[-1]] = (to, day)
        else:
            t.append((to, day))
    return {k: sorted(t, key=lambda x: x[1]) for k, t in out.items()}


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_folded_ledger(spark, parts):
    rng = random.Random(parts)
    more = [(i, rng.choice("cd"), f"2026-02-{rng.randint(1, 28):02d}", rng.choice(["A", "B", "-"]), rng.choice(["x", "correction"])) for i in range(10, 60)]
    df = spark.createDataFrame(LEDGER + more, "line int, k string, day string, to string, source string").repartition(parts)
    got = {r.k: [tuple(x) for x in r.timeline] for r in ordered.folded_ledger(df, "k", "line", "day", "to", "source").collect()}
    assert got == replay(LEDGER + more)
    assert ordered.folded_ledger(df.limit(0), "k", "line", "day", "to", "source").count() == 0


def test_anchored_clusters(spark):
    days = [dt.date(2026, 1, 1) + dt.timedelta(d) for d in (0, 50, 90, 91, 181, 200)]
    df = spark.createDataFrame([("k", x) for x in days] + [("k", days[0]), ("z", None)], "k string, d date")
    got = [r.cluster for r in ordered.anchored_clusters(df, ["k"], "d", 90).orderBy("d").collect()]
    assert got == [1, 1, 1, 2, 2, 3]


def test_assigned_ids(spark):
    df = spark.createDataFrame([(7, 1), (None, 2), (7, 3), (4, 4)], "id bigint, pos int")
    assert [r.id for r in ordered.assigned_ids(df, "id", "pos").orderBy("pos").collect()] == [7, 8, 9, 4]


def test_similar_token_sets_equal_brute_force(spark):
    rng = random.Random(1)
    sets = {i: sorted(rng.sample("abcdefgh", rng.randint(1, 6))) for i in range(60)}
    df = spark.createDataFrame([(i, s) for i, s in sets.items()] + [(99, None)], "k int, t array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= 2 and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.6}
    assert {(r.a, r.b) for r in joins.similar_token_sets(df, "k", "t", 0.6).collect()} == want


def test_near_fingerprints_equal_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    all_ = base + [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << 63) for x in base] + [base[0]]
    signed = [x - (1 << 64) if x >> 63 else x for x in all_]
    df = spark.createDataFrame(list(enumerate(signed)) + [(1000, None)], "k int, f bigint")
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if bin(all_[a] ^ all_[b]).count("1") <= 5}
    assert {(r.a, r.b) for r in joins.near_fingerprints(df, "k", "f", 5).collect()} == want


def test_nearest_vectors_in_blocks(spark):
    rng = random.Random(3)
    v = {i: [rng.random() for _ in range(4)] for i in range(30)}
    v[30] = v[0]
    df = spark.createDataFrame([(i, x) for i, x in v.items()], "i bigint, v array<double>")
    a = joins.nearest_vectors(df.where("i < 5"), df, "i", "v", 3, block=2).orderBy("query", "rank").collect()
    assert len(a) == 15 and a[0].neighbour == 30 and abs(a[0].cosine - 1) < 1e-9
    assert joins.nearest_vectors(df.limit(0), df, "i", "v", 3).count() == 0


def test_upsert_keeps_first_seen_and_takes_better_dates(spark):
    base = spark.createDataFrame([("u", 1, "a", "exact", 3), ("v", 1, None, "unknown", 0)], "k string, first int, p string, c string, r int")
    new = spark.createDataFrame([("u", 9, None, "unknown", 0), ("v", 9, "b", "unknown", 0), ("w", 9, "c", "exact", 3)], "k string, first int, p string, c string, r int")
    got = {x.k: (x.first, x.p, x.c) for x in merges.upsert(base, new, "k", ["first"], ["p"], {"c": ("r", "r")}).select("k", "first", "p", "c").collect()}
    assert got == {"u": (1, "a", "exact"), "v": (1, "b", "unknown"), "w": (9, "c", "exact")}


def test_claims_never_overlap(spark):
    df = spark.createDataFrame([(i, "new", None) for i in range(10)], "i int, s string, t string")
    for token in ("a", "b", "c"):
        df = queue.claim(df, "i", "s", "new", "busy", [F.asc("i")], 4, token, "t")
    got = {r.i: r.t for r in df.collect()}
    assert [got[i] for i in range(10)] == list("aaaabbbbcc")


def test_queue_changes_are_guarded(spark):
    df = spark.createDataFrame([(1, "busy", "a", 0, 5), (2, "busy", "b", 1, None), (3, "new", "a", None, 1), (4, None, None, None, None), (5, "busy", None, None, 1)], "i int, s string, t string, r int, at int")
    states = lambda d: {r.i: (r.s, r.t, r.r) for r in d.collect()}
    old = states(df)
    done = states(queue.complete(df, "s", "busy", "done", "t", "a"))
    assert done == old | {1: ("done", None, 0)} and states(queue.complete(queue.complete(df, "s", "busy", "done", "t", "a"), "s", "busy", "done", "t", "a")) == done
    assert states(queue.release(df, "s", "busy", "new", "t", "b")) == old | {2: ("new", None, 1)}
    assert states(queue.fail(df, "s", "busy", "new", "failed", "r", 2, F.lit(True))) == old | {1: ("new", "a", 1), 2: ("failed", "b", 2), 5: ("new", None, 1)}
    assert states(queue.reclaim(df, "s", "busy", "new", "at", F.lit(3))) == old | {5: ("new", None, None)}
    assert queue.claim(df.limit(0), "i", "s", "new", "busy", [F.asc("i")], 4, "z", "t").count() == 0


def test_merged_additions(spark):
    base = spark.createDataFrame([(1, 1, "A", "Dev", 3.0, "n", 1), (2, 2, "B", "Ops", None, None, 2), (3, 3, "A", "Dev", 4.0, "m", 3), (4, 4, None, None, 1.0, "z", 4)], "id bigint, pos bigint, company string, role string, score double, notes string, num bigint")
    added = spark.createDataFrame(
        [(10, 3, "A", "Dev", 4.5, "x"), (11, 99, "A", "Dev", 2.0, "y"), (12, 98, "B", "Ops", 1.5, "w"), (13, 97, "B", "Ops", 1.5, "v"), (14, 1, "C", "New", 5.0, "c"), (15, None, None, None, 5.0, "d"), (16, 3, "A", "Dev", None, "e")],
        "pos bigint, num bigint, company string, role string, score double, notes string",
    )
    got = {r.id: (r.company, r.score, r.notes, r.change) for r in queue.merged_additions(base, added, "id", "pos", [["num", "company"], ["company", "role"]], "score").collect()}
    assert got == {
        1: ("A", 3.0, "n", "none"), 2: ("B", 1.5, None, "updated"), 3: ("A", 4.5, "was 4.0; m", "updated"), 4: (None, 1.0, "z", "none"),
        5: ("C", 5.0, "c", "inserted"), 6: (None, 5.0, "d", "inserted"),
    }
    empty = queue.merged_additions(base, added.limit(0), "id", "pos", [["num", "company"]], "score")
    assert {r.change for r in empty.collect()} == {"none"} and empty.count() == 4


def test_resolved_rows(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, None, "z")], "id int, c string, r string")
    asks = spark.createDataFrame([(10, "a", "y"), (11, "a", "q"), (12, "b", "q"), (13, "n", None), (14, None, None), (10, "a", "y")], "k int, c string, r string")
    got = sorted((r.k, r.id, r.outcome) for r in queue.resolved_rows(asks, "k", rows, "id", [["c", "r"], ["c"]]).collect())
    assert got == [(10, 2, "one"), (11, None, "ambiguous"), (12, 3, "one"), (13, None, "none"), (14, None, "none")]


def test_quantiles(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 6.0), ("a", 20.0), ("b", 3.0), ("b", 6.0), ("c", 5.0), ("c", 5.0), ("d", None)], "k string, v double")
    got = {r.k: (r.m, r.q, r.l, r.u) for r in ordered.quantiles(df, ["k"], "v", m=("between", 0.5), q=("between", 0.75), l=("lower", 0.5), u=("upper", 0.5)).collect()}
    assert got == {"a": (6.0, 13.0, 6.0, 6.0), "b": (4.5, 5.25, 3.0, 6.0), "c": (5.0, 5.0, 5.0, 5.0), "d": (None,) * 4}
    assert ordered.quantiles(df.limit(0), ["k"], "v", m=("between", 0.5)).count() == 0
