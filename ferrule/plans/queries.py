"""Queries of the core operators over the whole test tables, each with its SQL.

Names begin with the operator's id in the survey. Tables are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import scalars as S
from ferrule.operators import filters, joins, merges, ordered
from ferrule.plans.registry import query
from ferrule.plans.session import spread, table

POSITIVE, NEGATIVE = ["engineer", "data", "ai", "sre"], ["intern", "junior"]
TITLE_SQL = "(contains(t, 'engineer') or contains(t, 'data') or regexp_matches(t, '\\bai\\b') or regexp_matches(t, '\\bsre\\b')) and not (contains(t, 'intern') or contains(t, 'junior'))"
LINK_SQL = "coalesce(nullif(canonical_url, ''), raw_url)"
SQUEEZE_SQL = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
SPACE_SQL = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def link() -> Column:
    return F.coalesce(F.nullif("canonical_url", F.lit("")), F.col("raw_url"))


def confidence_rank() -> Column:
    c = F.col("posted_at_confidence")
    return F.when(c == "exact", 3).when(c == "relative_exact", 2).when(c == "lower_bound", 1).otherwise(0)


# Filters and projections


@query(
    "f1_title_filter",
    f"""select job_id, title, array_to_string(list_filter(['engineer', 'data', case when regexp_matches(t, '\\bai\\b') then 'ai' end, case when regexp_matches(t, '\\bsre\\b') then 'sre' end],
           lambda k: k is not null and (length(k) <= 3 or contains(t, k))), ',') as matched
        from (select job_id, title, lower(coalesce(title, '')) as t from jobs) where {TITLE_SQL}""",
)
def f1_title_filter(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").where(filters.title_filter(F.col("title"), POSITIVE, NEGATIVE))
    return j.select("job_id", "title", F.array_join(filters.matched_keywords(F.col("title"), POSITIVE), ",").alias("matched"))


@query(
    "f4_place_filter",
    """select job_id, location from (select job_id, location, lower(coalesce(location, '')) as p from jobs)
       where case when trim(p) = '' then true when contains(p, 'remote') then true when contains(p, 'westerholt') or contains(p, ', tx') then false
                  else contains(p, ',') or contains(p, 'quillfield') end""",
)
def f4_place_filter(spark: SparkSession, d: str) -> DataFrame:
    keep = filters.place_filter(F.col("location"), [",", "quillfield"], ["westerholt", ", tx"], ["remote"])
    return table(spark, d, "jobs").where(keep).select("job_id", "location")


@query("f5_posting_age", "select job_id, posted_at from jobs where posted_at is null or posted_at >= timestamp '2025-09-01 00:00:00'")
def f5_posting_age(spark: SparkSession, d: str) -> DataFrame:
    cutoff = F.lit("2025-09-01 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "jobs").where(filters.at_least_as_new(F.col("posted_at"), cutoff)).select("job_id", "posted_at")


@query(
    "f6_range_overlap",
    """select l_orderkey, l_linenumber, l_suppkey, l_partkey from (
         select *, case when l_linenumber % 5 = 0 then null else l_extendedprice * (1 - l_discount) end as lo, case when l_linenumber % 7 = 0 then null else l_extendedprice end as hi from lineitem)
       where coalesce(lo, hi) is null or (coalesce(hi, lo) >= 20000 and coalesce(lo, hi) <= 30000)""",
)
def f6_range_overlap(spark: SparkSession, d: str) -> DataFrame:
    low = F.when(F.col("l_linenumber") % 5 != 0, F.col("l_extendedprice") * (1 - F.col("l_discount")))
    high = F.when(F.col("l_linenumber") % 7 != 0, F.col("l_extendedprice"))
    return table(spark, d, "lineitem").where(filters.ranges_overlap(low, high, 20000, 30000)).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query(
    "f7_content_filter",
    """select doc_id from (select doc_id, lower(text) as t, lower(doc_kind) as k from documents)
       where case when k = 'ad' then contains(t, 'kafka') or contains(t, 'spark') when k = 'letter' then contains(t, 'python') else contains(t, 'java') end""",
)
def f7_content_filter(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("text")
    rule = F.when(F.lower("doc_kind") == "ad", t.contains("kafka") | t.contains("spark")).when(F.lower("doc_kind") == "letter", t.contains("python")).otherwise(t.contains("java"))
    return table(spark, d, "documents").where(rule).select("doc_id")


@query(
    "f9_blacklist",
    f"""select job_id, company from jobs where company is not null and {SQUEEZE_SQL.format("company")} not in
        (select {SQUEEZE_SQL.format("company")} from applications where status = 'Discarded' and company is not null)""",
)
def f9_blacklist(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "applications").where("status = 'Discarded' and company is not null").select(S.squeezed(F.col("company")).alias("k")).distinct()
    jobs = table(spark, d, "jobs").where("company is not null").withColumn("k", S.squeezed(F.col("company")))
    return jobs.join(out, "k", "left_anti").select("job_id", "company")


CASCADE_SQL = """case when company in (select company from applications where status = 'Discarded') then 'blacklist'
    when contains(lower(title), 'junior') then 'title' when contains(lower(location), 'westerholt') then 'location'
    when posted_at < timestamp '2025-06-01 00:00:00' then 'age' when retry_count > 2 then 'retries' end"""


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "applications").where("status = 'Discarded' and company is not null").select(F.col("company").alias("_c")).distinct()
    jobs = table(spark, d, "jobs")
    j = jobs.join(listed, jobs["company"] == listed["_c"], "left")
    rules = [
        ("blacklist", F.col("_c").isNotNull()),
        ("title", F.lower("title").contains("junior")),
        ("location", F.lower("location").contains("westerholt")),
        ("age", F.col("posted_at") < F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")),
        ("retries", F.col("retry_count") > 2),
    ]
    return j.withColumn("first_reject", filters.first_reject(rules))


@query("f12_cascade", f"select job_id, {CASCADE_SQL} as first_reject from jobs")
def f12_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _cascade(spark, d).select("job_id", "first_reject")


@query("f12_cascade_counts", f"select coalesce({CASCADE_SQL}, 'kept') as stage, count(*) as n from jobs group by 1")
def f12_cascade_counts(spark: SparkSession, d: str) -> DataFrame:
    return _cascade(spark, d).groupBy(F.coalesce("first_reject", F.lit("kept")).alias("stage")).agg(F.count("*").alias("n"))


@query(
    "f14_date_class",
    "select job_id, case when posted_at is null then 'undated' when posted_at < timestamp '2025-07-01 00:00:00' then 'stale' else 'keep' end as date_class from jobs",
)
def f14_date_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", filters.date_class(F.col("posted_at"), F.lit("2025-07-01 00:00:00").cast("timestamp_ntz")).alias("date_class"))


@query(
    "f23_tracker_query",
    """select id, date, company, role, status from applications where status = 'Applied' and company ilike '%energy%' and date >= '2025-10-01'""",
)
def f23_tracker_query(spark: SparkSession, d: str) -> DataFrame:
    spec = filters.Spec.from_params({"status": "Applied", "company": "energy", "since": "2025-10-01"})
    spec.columns = ["id", "date", "company", "role", "status"]
    return spec.build(table(spark, d, "applications"))


@query(
    "f25_search",
    "select id, company, role from applications where contains(lower(coalesce(company, '')), 'python') or contains(lower(coalesce(role, '')), 'python') or contains(lower(coalesce(notes, '')), 'python')",
)
def f25_search(spark: SparkSession, d: str) -> DataFrame:
    return filters.Spec(needle=(("company", "role", "notes"), "Python"), columns=["id", "company", "role"]).build(table(spark, d, "applications"))


@query("f29_lacking_text", "select job_id from jobs where jd_status not in ('ok', 'gone')")
def f29_lacking_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where(~F.col("jd_status").isin("ok", "gone")).select("job_id")


# Joins


@query(
    "j1_latest_event",
    """select a.id, a.company, e.status as last_status, e.date as last_date from applications a
       left join (select app_id, status, date, row_number() over (partition by app_id order by id desc) r from status_events) e on e.app_id = a.id and e.r = 1""",
)
def j1_latest_event(spark: SparkSession, d: str) -> DataFrame:
    last = ordered.latest_per_key(table(spark, d, "status_events").withColumn("v", F.struct("status", "date")), ["app_id"], "id", "v")
    a = table(spark, d, "applications")
    return a.join(last, a["id"] == last["app_id"], "left").select("id", "company", F.col("v.status").alias("last_status"), F.col("v.date").alias("last_date"))


@query(
    "j3_events_per_application",
    "select a.id, count(e.id) as events, count(distinct e.status) as statuses, min(e.date) as first_date from applications a left join status_events e on e.app_id = a.id group by a.id",
)
def j3_events_per_application(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "status_events").groupBy("app_id").agg(F.count("*").alias("n"), F.count_distinct("status").alias("s"), F.min("date").alias("first_date"))
    a = table(spark, d, "applications").select("id")
    return a.join(e, a["id"] == e["app_id"], "left").select("id", F.coalesce("n", F.lit(0)).alias("events"), F.coalesce("s", F.lit(0)).alias("statuses"), "first_date")


@query(
    "j5_whats_new",
    f"select job_id, company from jobs where {SQUEEZE_SQL.format('company')} not in (select {SQUEEZE_SQL.format('company')} from applications where company is not null)",
)
def j5_whats_new(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "applications").where("company is not null").select(S.squeezed(F.col("company")).alias("k")).distinct()
    return table(spark, d, "jobs").where("company is not null").withColumn("k", S.squeezed(F.col("company"))).join(known, "k", "left_anti").select("job_id", "company")


@query("j6_kept_events", "select id, app_id from status_events where app_id in (select id from applications)")
def j6_kept_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "status_events").join(table(spark, d, "applications").select(F.col("id").alias("app_id")), "app_id", "left_semi").select("id", "app_id")


@query(
    "j7_new_offers",
    f"""select job_id, link from (select job_id, {LINK_SQL} as link, row_number() over (partition by {LINK_SQL} order by job_id) r from jobs where batch_no >= 20 and {LINK_SQL} is not null)
        where r = 1 and link not in (select {LINK_SQL} from jobs where batch_no < 20 and {LINK_SQL} is not null)""",
)
def j7_new_offers(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").select("job_id", "batch_no", link().alias("link"))
    return joins.unseen(j.where("batch_no >= 20").select("job_id", "link"), [j.where("batch_no < 20")], "link", "job_id").select("job_id", "link")


@query(
    "j8_phrase_matches",
    f"""with d as (select doc_id, ' ' || {SPACE_SQL.format("text")} || ' ' as t from documents),
             c as (select company as phrase, {SPACE_SQL.format("company")} as c from (select distinct company from applications where company is not null))
        select doc_id, phrase from d join c on c <> '' and contains(t, ' ' || c || ' ')""",
)
def j8_phrase_matches(spark: SparkSession, d: str) -> DataFrame:
    return joins.phrase_matches(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "applications"), "company")


def _sql_list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


ROLE_TOKENS_SQL = f"list_distinct(list_filter(string_split({{0}}, ' '), lambda w: (length(w) > 3 or w in ({_sql_list(S.SHORT_SPECIALTIES)})) and w not in ({_sql_list(S.ROLE_STOPWORDS)})))"
SENIORITY_SQL = f"list_filter(string_split({{0}}, ' '), lambda w: w in ({_sql_list(S.SENIORITY)}))"


@query(
    "j10_fuzzy_roles",
    f"""with t as (select title, {ROLE_TOKENS_SQL.format(SPACE_SQL.format("title"))} as k, {SENIORITY_SQL.format(SPACE_SQL.format("title"))} as s from (select distinct title from jobs where title is not null)),
             p as (select a.title as a, b.title as b, list_intersect(a.k, b.k) as i, len(list_distinct(list_concat(a.k, b.k))) as u from t a join t b on a.title < b.title
                   where len(a.k) >= 2 and len(b.k) >= 2 and (len(a.s) = 0 or len(b.s) = 0 or len(list_intersect(a.s, b.s)) > 0))
        select a, b, round(len(i) / u::double, 6) as similarity from p where len(i) >= 2 and len(i) / u::double >= 0.6 and len(list_filter(i, lambda w: w not in ({_sql_list(S.BASELINE_WORDS)}))) > 0""",
)
def j10_fuzzy_roles(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "jobs").where("title is not null").select("title").distinct().withColumn("k", S.role_tokens(F.col("title")))
    got = joins.similar_token_sets(titles, "title", "k", 0.6)
    return got.where(S.same_role(F.col("a"), F.col("b"))).select("a", "b", F.round("similarity", 6).alias("similarity"))


FINGERPRINT_SQL = r"""w as (select job_id, string_split(n, ' ') as w from (select job_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(jd_text), '<[^>]*>', ' ', 'g'), '&[a-z#0-9]+;', ' ', 'g'),
         'https?://\S+', ' ', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) as n from jobs where jd_text is not null) where length(n) >= 200),
       s as (select job_id, sha1(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as h from w, unnest(range(1, len(w) - 1)) as r(i)),
       v as (select job_id, b, sum(case when ((strpos('0123456789abcdef', substr(h, b // 4 + 1, 1)) - 1) >> (3 - b % 4)) & 1 = 1 then 1 else -1 end) > 0 as bit from s, range(64) as g(b) group by 1, 2),
       f as (select job_id, string_agg(case when bit then '1' else '0' end, '' order by b) as f from v group by 1)"""


@query(
    "e17_fingerprints",
    f"with {FINGERPRINT_SQL} select job_id, f as bits from f",
)
def e17_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The 64-bit fingerprint of each posting's text, as bits."""
    j = spread(table(spark, d, "jobs").where("jd_text is not null").select("job_id", "jd_text")).select("job_id", S.simhash64(F.col("jd_text")).alias("f"))
    return j.where("f is not null").select("job_id", F.lpad(F.bin("f"), 64, "0").alias("bits"))


@query(
    "e18_similarity",
    f"""with {FINGERPRINT_SQL} select x.job_id as job_id, 1 - len(list_filter(range(1, 65), lambda i: x.f[i] <> y.f[i])) / 64.0 as similarity from f x join jobs j on j.job_id = x.job_id
        join jobs k on k.job_id = j.job_id + 1 join f y on y.job_id = k.job_id""",
)
def e18_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each posting's text compared with that of the row after it."""
    j = spread(table(spark, d, "jobs").where("jd_text is not null").select("job_id", "jd_text")).select("job_id", S.simhash64(F.col("jd_text")).alias("f")).where("f is not null")
    nxt = j.select((F.col("job_id") - 1).alias("job_id"), F.col("f").alias("g"))
    return j.join(nxt, "job_id").select("job_id", S.hamming_similarity(F.col("f"), F.col("g")).alias("similarity"))


@query(
    "j11_cross_listing",
    f"""with {FINGERPRINT_SQL},
       r as (select f.job_id as k, f.f, {SQUEEZE_SQL.format("coalesce(j.company, '')")} as o, coalesce({LINK_SQL}, '') as l from f join jobs j using (job_id) where j.first_seen_at >= (select max(first_seen_at) - interval 90 day from jobs)),
       n as (select f, o, l, min(k) as k from r group by 1, 2, 3),
       m as (select *, k = min(k) over (partition by f) as head from n),
       p as (select least(x.k, y.k) as a, greatest(x.k, y.k) as b, len(list_filter(range(1, 65), lambda i: x.f[i] <> y.f[i])) as distance from m x join m y on x.k < y.k and x.o <> y.o and x.l <> y.l and (x.f <> y.f or x.head))
       select a, b, distance, round(1 - distance / 64.0, 6) as similarity from p where distance <= 5""",
)
def j11_cross_listing(spark: SparkSession, d: str) -> DataFrame:
    """Postings of the last 90 days whose texts' fingerprints are at most five bits apart (a similarity of 0.92), under different employers and links."""
    jobs = table(spark, d, "jobs")
    last = jobs.agg(F.max("first_seen_at").alias("_last"))
    recent = jobs.where("jd_text is not null").join(F.broadcast(last)).where(F.col("first_seen_at") >= F.col("_last") - F.expr("interval 90 days"))  # last is one row
    rows = spread(recent.select("job_id", "jd_text", S.squeezed(F.coalesce("company", F.lit(""))).alias("owner"), link().alias("link")))
    got = joins.cross_listings(rows.withColumn("f", S.simhash64(F.col("jd_text"))), "job_id", "f", "owner", "link")
    return got.select("a", "b", "distance", F.round(1 - F.col("distance") / 64.0, 6).alias("similarity"))


@query(
    "j15_best_name_match",
    f"""with x as (select distinct company as x, {SPACE_SQL.format("company")} as xs from applications where company is not null),
             y as (select distinct company as y, {SPACE_SQL.format("company")} as ys from jobs where company is not null),
             m as (select x, y, case when xs = ys then 0 when starts_with(ys, xs || ' ') and length(xs) >= 4 then 1 when starts_with(xs, ys || ' ') and length(ys) >= 4 then 2 end as tier, length(ys) as n from x, y where xs <> '' and ys <> '')
        select x as company, y as match, tier from (select *, row_number() over (partition by x order by tier, n desc, y) r from m where tier is not null) where r = 1""",
)
def j15_best_name_match(spark: SparkSession, d: str) -> DataFrame:
    return joins.best_name_match(table(spark, d, "applications"), table(spark, d, "jobs"), "company")


@query(
    "j17_first_duplicate",
    """with a as (select id, pos, company, role, report from applications),
            m as (select a.id, b.id as first_id, b.pos, case when a.report = b.report and a.company = b.company then 1 else 2 end as priority
                  from a join a b on b.pos < a.pos and a.company = b.company and (a.report = b.report or a.role = b.role))
       select id, first_id, priority from (select *, row_number() over (partition by id order by priority, pos) r from m) where r = 1""",
)
def j17_first_duplicate(spark: SparkSession, d: str) -> DataFrame:
    """For each row the first earlier one of the same company and report, else of the same company and role: two joins by equality over the first rows of each key."""
    a = table(spark, d, "applications").where("company is not null")

    def firsts(key: str, priority: int) -> DataFrame:
        f = a.where(F.col(key).isNotNull()).groupBy("company", key).agg(F.min(F.struct("pos", "id")).alias("f"))
        return a.join(f, ["company", key]).where(F.col("f.pos") < F.col("pos")).select("id", F.col("f.id").alias("first_id"), F.lit(priority).alias("priority"), F.col("f.pos").alias("p"))

    both = firsts("report", 1).unionByName(firsts("role", 2))
    return both.groupBy("id").agg(F.min(F.struct("priority", "p", "first_id")).alias("m")).select("id", F.col("m.first_id").alias("first_id"), F.col("m.priority").alias("priority"))


@query(
    "j19_orphans",
    """select 'event without application' as kind, id as row_id from status_events where app_id not in (select id from applications)
       union all select 'application without event' as kind, id as row_id from applications where id not in (select app_id from status_events where app_id is not null)""",
)
def j19_orphans(spark: SparkSession, d: str) -> DataFrame:
    e, a = table(spark, d, "status_events"), table(spark, d, "applications")
    one = e.where("app_id is not null").join(a.select(F.col("id").alias("app_id")), "app_id", "left_anti").select(F.lit("event without application").alias("kind"), F.col("id").alias("row_id"))
    two = a.join(e.select(F.col("app_id").alias("id")), "id", "left_anti").select(F.lit("application without event").alias("kind"), F.col("id").alias("row_id"))
    return one.unionByName(two)


@query("j20_producing_sources", "select count(distinct source) as producing from jobs where source in (select source from jobs where queue_status = 'evaluated')")
def j20_producing_sources(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs")
    hit = j.where("queue_status = 'evaluated'").select("source").distinct()
    return j.select("source").distinct().join(hit, "source", "left_semi").agg(F.count("source").alias("producing"))


@query(
    "j21_full_outer",
    """select coalesce(a.company, j.company) as company, coalesce(a.n, 0) as applications, coalesce(j.n, 0) as postings
       from (select company, count(*) n from applications where company is not null group by 1) a full outer join (select company, count(*) n from jobs where company is not null group by 1) j on a.company = j.company""",
)
def j21_full_outer(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "applications").where("company is not null").groupBy("company").agg(F.count("*").alias("applications"))
    j = table(spark, d, "jobs").where("company is not null").groupBy("company").agg(F.count("*").alias("postings"))
    return a.join(j, "company", "full_outer").na.fill(0, ["applications", "postings"])


@query(
    "j23_nearest_vectors",
    """select query, neighbour, rank, round(cosine, 5) as cosine from (select q.vec_id as query, v.vec_id as neighbour, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as cosine,
         row_number() over (partition by q.vec_id order by list_cosine_similarity(q.embedding::double[], v.embedding::double[]) desc, v.vec_id) as rank
       from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0) where rank <= 3""",
)
def j23_nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    got = joins.nearest_vectors(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 3)
    return got.select("query", "neighbour", F.col("rank").cast("bigint").alias("rank"), F.round("cosine", 5).alias("cosine"))


@query(
    "j_as_of_price",
    """select e.event_id, (select o.o_totalprice from orders o where o.o_custkey = e.user_id and o.o_orderdate <= e.ts order by o.o_orderdate desc, o.o_orderkey desc limit 1) as last_price from events e""",
)
def j_as_of_price(spark: SparkSession, d: str) -> DataFrame:
    """Engine extra: the latest order at or before each event, by one pass over the union of both sides per key."""
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), "event_id", F.lit(None).cast("double").alias("p"), F.lit(None).cast("bigint").alias("o"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.lit(None).cast("bigint").alias("event_id"), F.col("o_totalprice").alias("p"), F.col("o_orderkey").alias("o"))
    w = Window.partitionBy("k").orderBy(F.col("t"), F.asc_nulls_last("o")).rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(o).withColumn("last_price", F.last("p", ignorenulls=True).over(w))
    return both.where("event_id is not null").select("event_id", "last_price")


# Aggregates


@query(
    "a1_rollup",
    """select count(*) as total, count(*) filter (where status = 'Applied') as applied, round(avg(s), 4) as avg_score, max(s) as top_score,
         round(100.0 * count(*) filter (where pdf = '✅') / count(*), 4) as pdf_share, count(distinct company) as companies
       from (select *, try_cast(regexp_extract(score, '^([0-9.]+)/5$', 1) as double) as s from applications)""",
)
def a1_rollup(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "applications").withColumn("s", S.leading_number(F.col("score")))
    return a.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "Applied").alias("applied"),
        F.round(F.avg("s"), 4).alias("avg_score"),
        F.max("s").alias("top_score"),
        F.round(100.0 * F.count_if(F.col("pdf") == "✅") / F.count("*"), 4).alias("pdf_share"),
        F.count_distinct("company").alias("companies"),
    )


@query(
    "a1_by_label",
    "select l.state_label as label, count(a.id) as n from (select distinct state_label from states) l left join applications a on a.status = l.state_label group by 1",
)
def a1_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Every label, with zero where no row has it."""
    labels = table(spark, d, "states").select(F.col("state_label").alias("label")).distinct()
    n = table(spark, d, "applications").groupBy(F.col("status").alias("label")).agg(F.count("*").alias("n"))
    return labels.join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "a3_by_week",
    "select strftime(first_seen_at, '%G-W%V') as week, count(*) as n, count(distinct lower(company)) as companies, min(first_seen_at) as first_at, max(first_seen_at) as last_at from jobs where first_seen_at is not null group by 1",
)
def a3_by_week(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").where("first_seen_at is not null")
    return j.groupBy(S.iso_week(F.col("first_seen_at")).alias("week")).agg(
        F.count("*").alias("n"), F.count_distinct(F.lower("company")).alias("companies"), F.min("first_seen_at").alias("first_at"), F.max("first_seen_at").alias("last_at")
    )


@query(
    "a10_outcome_scores",
    """select status, count(s) as scored, round(avg(s), 4) as avg_score, min(s) as low, max(s) as high, median(s) as median_score
       from (select status, try_cast(regexp_extract(score, '^([0-9.]+)/5$', 1) as double) as s from applications) group by status""",
)
def a10_outcome_scores(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "applications").select("status", S.leading_number(F.col("score")).alias("s"))
    return a.groupBy("status").agg(
        F.count("s").alias("scored"), F.round(F.avg("s"), 4).alias("avg_score"), F.min("s").alias("low"), F.max("s").alias("high"), F.median("s").alias("median_score")
    )


@query(
    "a11_breakdown",
    """select source, count(*) as total, count(*) filter (where queue_status = 'evaluated') as evaluated, count(*) filter (where queue_status = 'skipped') as skipped,
         count(*) filter (where queue_status = 'failed') as failed, floor(100.0 * count(*) filter (where queue_status = 'evaluated') / count(*) + 0.5) as conversion from jobs group by source""",
)
def a11_breakdown(spark: SparkSession, d: str) -> DataFrame:
    states = ["evaluated", "skipped", "failed"]
    j = table(spark, d, "jobs").groupBy("source").agg(F.count("*").alias("total"), *(F.count_if(F.col("queue_status") == s).alias(s) for s in states))
    return j.withColumn("conversion", S.round_half_up(100.0 * F.col("evaluated") / F.col("total")))


@query(
    "a12_missing_skills",
    """with s as (select job_id, unnest(from_json(missing_required_skills, '["VARCHAR"]')) as skill from jobs)
       select skill, count(*) as n, round(100.0 * count(*) / (select count(*) from jobs), 4) as share from s group by skill""",
)
def a12_missing_skills(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").select(F.from_json("missing_required_skills", "array<string>").alias("s"))
    total = j.agg(F.count("*").alias("total"))
    n = j.select(F.explode("s").alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(total)).select("skill", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("share"))  # total is one row


@query(
    "a13_source_rates",
    """select source, n, round(100.0 * live / n, 4) as live_rate, round(100.0 * n / sum(n) over (), 4) as share, n >= 20 as enough
       from (select source, count(*) as n, count(*) filter (where liveness_status = 'live') as live from jobs where liveness_status <> 'unchecked' group by 1)""",
)
def a13_source_rates(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "jobs").where("liveness_status <> 'unchecked'").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("liveness_status") == "live").alias("live"))
    total = g.agg(F.sum("n").alias("t"))
    return g.join(F.broadcast(total)).select(
        "source", "n", F.round(100.0 * F.col("live") / F.col("n"), 4).alias("live_rate"), F.round(100.0 * F.col("n") / F.col("t"), 4).alias("share"), (F.col("n") >= 20).alias("enough")
    )


@query(
    "a14_channels",
    """select k as channel, count(*) as n, arg_min(via, pos) as first_label, count(*) filter (where status = 'Interview') as interviews
       from (select *, regexp_replace(lower(replace(via, 'Ｌ', 'L')), '[^a-z0-9]', '', 'g') as k from applications where via is not null) where k <> '' group by k""",
)
def a14_channels(spark: SparkSession, d: str) -> DataFrame:
    """Channels under one key whatever their width, case and blanks, with the label seen first. The key is worked out once per distinct label."""
    a = table(spark, d, "applications").where("via is not null")
    keys = a.select("via").distinct().withColumn("channel", S.compatibility_key(F.col("via")))
    per = a.groupBy("via").agg(F.count("*").alias("n"), F.min("pos").alias("p"), F.count_if(F.col("status") == "Interview").alias("i"))
    return per.join(keys, "via").where("channel <> ''").groupBy("channel").agg(
        F.sum("n").alias("n"), F.min_by("via", "p").alias("first_label"), F.sum("i").alias("interviews")
    )


@query(
    "a17_against_others",
    """with g as (select source, count(*) as n, count(*) filter (where queue_status = 'evaluated') as hit from jobs group by 1)
       select source, round(100.0 * hit / n, 4) as rate, round(100.0 * (sum(hit) over () - hit) / (sum(n) over () - n), 4) as others from g""",
)
def a17_against_others(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "jobs").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("queue_status") == "evaluated").alias("hit"))
    t = g.agg(F.sum("n").alias("tn"), F.sum("hit").alias("th"))
    return g.join(F.broadcast(t)).select(
        "source", F.round(100.0 * F.col("hit") / F.col("n"), 4).alias("rate"), F.round(100.0 * (F.col("th") - F.col("hit")) / F.nullif(F.col("tn") - F.col("n"), F.lit(0)), 4).alias("others")
    )


@query(
    "a22_reasons",
    "select lower(company) as company_key, count(*) as total, count(skip_reason) as skipped, array_to_string(list_sort(list_distinct(list(skip_reason) filter (where skip_reason is not null))), ',') as reasons, arg_min(company, job_id) as label from jobs where company is not null group by 1",
)
def a22_reasons(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").where("company is not null")
    reasons = F.array_join(F.array_sort(F.collect_set("skip_reason")), ",")
    return j.groupBy(F.lower("company").alias("company_key")).agg(
        F.count("*").alias("total"), F.count("skip_reason").alias("skipped"), F.when(F.count("skip_reason") > 0, reasons).alias("reasons"), F.min_by("company", "job_id").alias("label")
    )


@query(
    "a24_upper_median",
    """select p_type, count(*) as filings, count(distinct l_suppkey) as suppliers, quantile_disc(l_extendedprice, 0.5 order by l_extendedprice desc) as upper_median,
         median(l_extendedprice) as median_price from lineitem join part on p_partkey = l_partkey group by p_type""".replace("quantile_disc(l_extendedprice, 0.5 order by l_extendedprice desc)", "list_sort(list(l_extendedprice))[len(list(l_extendedprice)) // 2 + 1]"),
)
def a24_upper_median(spark: SparkSession, d: str) -> DataFrame:
    """The upper of the two middle values, beside the mean of both."""
    j = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    counts = j.groupBy("p_type").agg(F.count("*").alias("filings"), F.count_distinct("l_suppkey").alias("suppliers"))
    middle = ordered.quantiles(j, ["p_type"], "l_extendedprice", upper_median=("upper", 0.5), median_price=("between", 0.5))
    return counts.join(middle, "p_type")


@query(
    "a25_two_counts",
    """select s_name, count(*) as total, count(*) filter (where l_returnflag = 'R') as returned, round(count(*) filter (where l_returnflag = 'R') / sqrt(count(*)), 4) as strength
       from lineitem join supplier on s_suppkey = l_suppkey group by s_name having count(*) filter (where l_returnflag = 'R') >= 5""",
)
def a25_two_counts(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return per.join(s, "l_suppkey").where("returned >= 5").select("s_name", "total", "returned", F.round(F.col("returned") / F.sqrt("total"), 4).alias("strength"))


@query(
    "a26_top_of_group",
    "select source, title, n, r as rank from (select source, title, count(*) as n, row_number() over (partition by source order by count(*) desc, title) as r from jobs where title is not null group by 1, 2) where r <= 3",
)
def a26_top_of_group(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "jobs").where("title is not null").groupBy("source", "title").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("n"), "title")
    return g.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 3").select("source", "title", "n", "rank")


@query(
    "a28_by_nation",
    """select n_name, count(*) as orders, count(distinct o_custkey) as customers, round(count(*) / count(distinct o_custkey)::double, 1) as per_customer
       from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by n_name""",
)
def a28_by_nation(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    g = per.join(c, "o_custkey").groupBy("n_nationkey").agg(F.sum("n").alias("orders"), F.count("*").alias("customers"))
    return g.join(table(spark, d, "nation"), "n_nationkey").select("n_name", "orders", "customers", F.round(F.col("orders") / F.col("customers"), 1).alias("per_customer"))


@query(
    "a29_listed_places",
    "select trim(p) as part, count(*) as n from (select unnest(string_split(location, ',')) as p from jobs where location <> '') where trim(p) <> '' group by 1",
)
def a29_listed_places(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "jobs").where("location <> ''").select(F.explode(F.split("location", ",")).alias("part")).select(F.trim("part").alias("part"))
    return parts.where("part <> ''").groupBy("part").agg(F.count("*").alias("n"))


@query(
    "a31_buckets",
    """select case when s is null then 'none' when s < 2 then 'under 2' when s < 3 then '2 to 3' when s < 4 then '3 to 4' else '4 and more' end as bucket, count(*) as n
       from (select try_cast(regexp_extract(score, '^([0-9.]+)/5$', 1) as double) as s from applications) group by 1""",
)
def a31_buckets(spark: SparkSession, d: str) -> DataFrame:
    s = S.leading_number(F.col("score"))
    b = F.when(s.isNull(), "none").when(s < 2, "under 2").when(s < 3, "2 to 3").when(s < 4, "3 to 4").otherwise("4 and more")
    return table(spark, d, "applications").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("a32_top_companies", "select company, count(*) as n from applications where company is not null group by 1 order by n desc, company limit 10")
def a32_top_companies(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return table(spark, d, "applications").where("company is not null").groupBy("company").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company").limit(10)


@query("a33_queue_counts", "select queue_status, count(*) as n from jobs group by 1")
def a33_queue_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").groupBy("queue_status").agg(F.count("*").alias("n"))


@query(
    "a35_theme_lift",
    """with t as (select doc_id, doc_kind = 'ad' as low, unnest(['spark', 'kafka', 'python', 'java', 'clearance', 'visa']) as theme, lower(text) as x from documents where text is not null)
       select theme, round(count(*) filter (where low and contains(x, theme)) / nullif(count(*) filter (where low), 0)::double, 6) as given_ad,
         round(count(*) filter (where not low and contains(x, theme)) / nullif(count(*) filter (where not low), 0)::double, 6) as given_other from t group by theme""",
)
def a35_theme_lift(spark: SparkSession, d: str) -> DataFrame:
    themes = F.array(*(F.lit(t) for t in ("spark", "kafka", "python", "java", "clearance", "visa")))
    docs = table(spark, d, "documents").where("text is not null").select((F.col("doc_kind") == "ad").alias("low"), F.lower("text").alias("x"))
    t = docs.select("low", F.explode(F.transform(themes, lambda w: F.struct(w.alias("theme"), F.col("x").contains(w).alias("hit")))).alias("h"))
    rate = lambda c: F.round(F.count_if(c & F.col("h.hit")) / F.nullif(F.count_if(c), F.lit(0)), 6)
    return t.groupBy(F.col("h.theme").alias("theme")).agg(rate(F.col("low")).alias("given_ad"), rate(~F.col("low")).alias("given_other"))


@query(
    "a36_rollup",
    "select coalesce(source, 'TOTAL') as source, coalesce(liveness_status, 'TOTAL') as liveness, count(*) as n from jobs where source is not null and liveness_status is not null group by rollup (source, liveness_status)",
)
def a36_rollup(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").where("source is not null and liveness_status is not null")
    r = j.rollup("source", "liveness_status").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("source", F.lit("TOTAL")).alias("source"), F.coalesce("liveness_status", F.lit("TOTAL")).alias("liveness"), "n")


@query(
    "a_cube",
    "select coalesce(l_returnflag, '*') as flag, coalesce(l_linestatus, '*') as status, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by cube (l_returnflag, l_linestatus)",
)
def a_cube(spark: SparkSession, d: str) -> DataFrame:
    """Engine extra."""
    c = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return c.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "quantity")


@query(
    "a37_agreement",
    """select archetype, count(*) as cases, round(avg(score), 4) as mean_score, median(score) as median_score, round(avg(abs(score - m)), 4) as mean_delta
       from (select archetype, score, avg(score) over () as m from golden_cases) group by archetype""",
)
def a37_agreement(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "golden_cases").select("archetype", "score")
    m = c.agg(F.avg("score").alias("m"))
    return c.join(F.broadcast(m)).groupBy("archetype").agg(
        F.count("*").alias("cases"), F.round(F.avg("score"), 4).alias("mean_score"), F.median("score").alias("median_score"), F.round(F.avg(F.abs(F.col("score") - F.col("m"))), 4).alias("mean_delta")
    )


# Order-dependent operators


@query("w1_ledger_fold")
def w1_ledger_fold(spark: SparkSession, d: str) -> DataFrame:
    """Timelines of events replayed as a ledger, in which ``error`` takes the last entry back and ``signup`` corrects the date of the last view."""
    e = table(spark, d, "events").select(
        "user_id",
        "event_id",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.when(F.col("event_type") == "error", "-").when(F.col("event_type") == "signup", "view").otherwise(F.col("event_type")).alias("to"),
        F.when(F.col("event_type") == "signup", "correction").otherwise("log").alias("source"),
    )
    t = ordered.folded_ledger(e, "user_id", "event_id", "day", "to", "source")
    return t.select("user_id", F.size("timeline").alias("entries"), F.array_join(F.transform("timeline", lambda x: F.concat_ws("@", x["state"], x["date"])), ";").alias("timeline"))


@query(
    "w2_first_then_later",
    """with v as (select user_id, min(ts) as t0 from events where event_type = 'view' group by 1)
       select v.user_id, v.t0 as first_view, min(e.ts) as first_purchase from v left join events e on e.user_id = v.user_id and e.event_type = 'purchase' and e.ts > v.t0 group by 1, 2""",
)
def w2_first_then_later(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    v = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("ts").alias("first_view"))
    p = e.where("event_type = 'purchase'").join(v, "user_id").where(F.col("ts") > F.col("first_view")).groupBy("user_id").agg(F.min("ts").alias("first_purchase"))
    return v.join(p, "user_id", "left").select("user_id", "first_view", "first_purchase")


@query(
    "a8_hop_days",
    """with v as (select user_id, min(ts) as t0 from events where event_type = 'view' group by 1),
            h as (select v.user_id, t0, min(e.ts) as t1 from v left join events e on e.user_id = v.user_id and e.event_type = 'purchase' and e.ts > v.t0 group by 1, 2),
            x as (select date_diff('day', t0::date, t1::date) as d from h)
       select count(d) filter (where d > 0) as n, median(d) filter (where d > 0) as median_days, quantile_cont(d, 0.75) filter (where d > 0) as p75, count(*) filter (where d = 0) as same_day, count(*) filter (where d is null) as censored from x""",
)
def a8_hop_days(spark: SparkSession, d: str) -> DataFrame:
    """Days from the first view to the first purchase after it; those on one day and those not there yet are counted apart."""
    days = F.datediff(F.col("first_purchase").cast("date"), F.col("first_view").cast("date"))
    h = w2_first_then_later(spark, d).select(days.alias("d"))
    later = F.when(F.col("d") > 0, F.col("d"))
    return h.agg(
        F.count(later).alias("n"),
        F.median(later).alias("median_days"),
        F.percentile(later, F.lit(0.75)).alias("p75"),
        F.count_if(F.col("d") == 0).alias("same_day"),
        F.count_if(F.col("d").isNull()).alias("censored"),
    )


@query(
    "w3_priority_pick",
    "select company, job_id, posted_at_confidence from (select *, row_number() over (partition by company order by case posted_at_confidence when 'exact' then 3 when 'relative_exact' then 2 when 'lower_bound' then 1 else 0 end desc, posted_at desc nulls last, job_id) r from jobs where company is not null) where r = 1",
)
def w3_priority_pick(spark: SparkSession, d: str) -> DataFrame:
    rank = confidence_rank()
    j = table(spark, d, "jobs").where("company is not null").select("company", "job_id", "posted_at", "posted_at_confidence")
    return ordered.first_per_key(j, ["company"], [rank.desc(), F.desc_nulls_last("posted_at"), F.asc("job_id")]).select("company", "job_id", "posted_at_confidence")


@query("w4_reposts")
def w4_reposts(spark: SparkSession, d: str) -> DataFrame:
    """Postings of one company and title in runs of at most 90 days from the first; runs with several links."""
    j = table(spark, d, "jobs").where("company is not null and title is not null and first_seen_at is not null")
    j = j.select(F.lower("company").alias("company"), S.role_key(F.col("title")).alias("role"), F.col("first_seen_at").cast("date").alias("day"), S.canonical_url(link()).alias("link"))
    first = j.groupBy("company", "role", "link").agg(F.min("day").alias("day"))
    runs = ordered.anchored_clusters(first, ["company", "role"], "day", 90)
    g = first.join(runs, ["company", "role", "day"]).groupBy("company", "role", "cluster").agg(F.count("*").alias("links"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return g.where("links > 1")


@query(
    "w5_status_changes",
    "select id, app_id, status from (select *, lag(status) over (partition by app_id order by id) as b, row_number() over (partition by app_id order by id) as r from status_events) where r = 1 or b is distinct from status",
)
def w5_status_changes(spark: SparkSession, d: str) -> DataFrame:
    return ordered.changes(table(spark, d, "status_events"), "app_id", ["id"], "status").select("id", "app_id", "status")


@query(
    "w6_carried",
    "select job_id, last_value(posted_at ignore nulls) over (partition by source, batch_no order by job_id rows between unbounded preceding and current row) as carried from jobs",
)
def w6_carried(spark: SparkSession, d: str) -> DataFrame:
    return ordered.carried(table(spark, d, "jobs"), ["source", "batch_no"], "job_id", F.col("posted_at"), "carried").select("job_id", "carried")


@query(
    "w7_assigned_ids",
    """with j as (select job_id, try_cast(provider_job_id as bigint) as pid from jobs), k as (select *, row_number() over (partition by pid order by job_id) as r from j),
            b as (select job_id, (select max(pid) from j) + row_number() over (order by job_id) as pid from k where pid is null or r > 1)
       select job_id, pid from k where pid is not null and r = 1 union all select job_id, pid from b""",
)
def w7_assigned_ids(spark: SparkSession, d: str) -> DataFrame:
    return ordered.assigned_ids(table(spark, d, "jobs").select("job_id", F.col("provider_job_id").try_cast("bigint").alias("pid")), "pid", "job_id")


@query("w8_first_occurrence", f"select job_id, link from (select job_id, {LINK_SQL} as link, row_number() over (partition by {LINK_SQL} order by job_id) r from jobs) where r = 1")
def w8_first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", link().alias("link")).groupBy("link").agg(F.min("job_id").alias("job_id")).select("job_id", "link")


@query("w9_latest", "select source, arg_max(job_id, (last_seen_at, job_id)) as job_id from jobs where last_seen_at is not null group by source")
def w9_latest(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").where("last_seen_at is not null").withColumn("o", F.struct("last_seen_at", "job_id"))
    return ordered.latest_per_key(j, ["source"], "o", "job_id")


@query("w10_share", "select status, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 4) as share from applications group by status")
def w10_share(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "applications").groupBy("status").agg(F.count("*").alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("t")))).select("status", "n", F.round(100.0 * F.col("n") / F.col("t"), 4).alias("share"))


@query(
    "w11_duplicate_groups",
    "select company, role, count(*) as n, count(distinct via) as channels, min(id) as first_id from applications where company is not null and role is not null group by 1, 2 having count(*) > 1",
)
def w11_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "applications").where("company is not null and role is not null")
    return a.groupBy("company", "role").agg(F.count("*").alias("n"), F.count_distinct("via").alias("channels"), F.min("id").alias("first_id")).where("n > 1")


@query("s7_sorted_scores", "select id, rank() over (order by s desc nulls last) as place from (select id, try_cast(regexp_extract(score, '^([0-9.]+)/5$', 1) as double) as s from applications)")
def s7_sorted_scores(spark: SparkSession, d: str) -> DataFrame:
    """Places by score, unscored rows last, equal scores sharing a place: from the counts of each score, which are few."""
    a = table(spark, d, "applications").select("id", S.leading_number(F.col("score")).alias("s"))
    g = a.groupBy("s").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc_nulls_last("s")).rowsBetween(Window.unboundedPreceding, -1)
    places = g.withColumn("place", F.coalesce(F.sum("n").over(w), F.lit(0)) + 1).select(F.col("s").alias("s2"), "place")
    return a.join(places, a["s"].eqNullSafe(places["s2"])).select("id", F.col("place").cast("bigint").alias("place"))


# Set operations


@query("u1_seen_links", f"select {LINK_SQL} as link from jobs where batch_no <= 12 union select raw_url as link from jobs")
def u1_seen_links(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs")
    return j.where("batch_no <= 12").select(link().alias("link")).unionByName(j.select(F.col("raw_url").alias("link"))).distinct()


@query(
    "u4_exact_copies",
    "select text, count(*) as n, array_to_string(list_sort(list_distinct(list(source))), ',') as sources from documents group by text having count(*) > 1",
)
def u4_exact_copies(spark: SparkSession, d: str) -> DataFrame:
    """Grouped by digest, so that whole texts aren't shuffled more than once each."""
    docs = table(spark, d, "documents").withColumn("h", F.sha2("text", 256))
    g = docs.groupBy("h").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min("text").alias("text"))
    return g.where("n > 1").select("text", "n", "sources")


@query("u6_set_difference", "select distinct company from jobs except select distinct company from applications")
def u6_set_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("company").subtract(table(spark, d, "applications").select("company"))


@query("u_intersect_all", "select l_suppkey, l_partkey from lineitem where l_returnflag = 'R' intersect all select l_suppkey, l_partkey from lineitem where l_linestatus = 'F'")
def u_intersect_all(spark: SparkSession, d: str) -> DataFrame:
    """Engine extra."""
    li = table(spark, d, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_suppkey", "l_partkey").intersectAll(li.where("l_linestatus = 'F'").select("l_suppkey", "l_partkey"))


# Scalars


@query("e1_canonical_links")
def e1_canonical_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", S.canonical_url(F.col("raw_url")).alias("link"))


@query("e2_company_keys", f"select distinct company, {SQUEEZE_SQL.format('company')} as squeezed, regexp_replace({SPACE_SQL.format('company')}, '( (inc|llc|ltd|corp|corporation|gmbh|ag|sa|sas|bv|plc|co|company|limited))+$', '') as bare from jobs where company is not null")
def e2_company_keys(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "jobs").where("company is not null").select("company").distinct()
    return c.select("company", S.squeezed(F.col("company")).alias("squeezed"), S.without_legal_form(F.col("company")).alias("bare"))


@query("e7_iso_weeks", "select distinct o_orderdate::date as day, strftime(o_orderdate, '%G-W%V') as week from orders")
def e7_iso_weeks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct().select("day", S.iso_week(F.col("day")).alias("week"))


@query(
    "e13_dates_in_notes",
    "select id, len(regexp_extract_all(notes, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) as n, list_max(regexp_extract_all(notes, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) as last_date from applications where regexp_matches(notes, '[0-9]{4}-[0-9]{2}-[0-9]{2}')",
)
def e13_dates_in_notes(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "applications").select("id", S.iso_dates(F.col("notes")).alias("x")).where("size(x) > 0")
    return a.select("id", F.size("x").cast("bigint").alias("n"), F.array_max("x").alias("last_date"))


@query("e15_role_tokens", f"select title, array_to_string(list_sort({ROLE_TOKENS_SQL.format(SPACE_SQL.format('title'))}), ' ') as tokens from (select distinct title from jobs where title is not null)")
def e15_role_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "jobs").where("title is not null").select("title").distinct()
    return t.select("title", F.array_join(F.array_sort(S.role_tokens(F.col("title"))), " ").alias("tokens"))


@query(
    "e21_skills",
    """select skill, count(*) as n from (select doc_id, unnest(list_distinct(regexp_extract_all(text, '\\b(Python|Java|Scala|Kafka|Flink|Terraform|Kubernetes|GraphQL|PostgreSQL|Go)\\b'))) as skill from documents) group by 1""",
)
def e21_skills(spark: SparkSession, d: str) -> DataFrame:
    """Skills of a fixed vocabulary by document; case counts, so that the verb ``go`` is none."""
    found = F.regexp_extract_all("text", F.lit(r"\b(Python|Java|Scala|Kafka|Flink|Terraform|Kubernetes|GraphQL|PostgreSQL|Go)\b"), 1)
    return table(spark, d, "documents").select(F.explode(F.array_distinct(found)).alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))


@query(
    "e22_status_spellings",
    "select a.id, s.state_label as label from applications a left join (select lower(spelling) as k, min(state_label) as state_label from states group by 1) s on s.k = lower(trim(a.status))",
)
def e22_status_spellings(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "states").groupBy(F.lower("spelling").alias("k")).agg(F.min("state_label").alias("label"))
    a = table(spark, d, "applications").select("id", F.lower(F.trim("status")).alias("k"))
    return a.join(s, "k", "left").select("id", "label")


@query(
    "e23_hosts",
    "select case when regexp_matches(h, '(^|\\.)persona\\.example$') then 'persona' when regexp_matches(h, '(^|\\.)dayworks\\.example$') then 'dayworks' when regexp_matches(h, '(^|\\.)leafhire\\.example$') then 'leafhire' else 'other' end as vendor, count(*) as n from (select lower(regexp_extract(raw_url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]+)', 1)) as h from jobs) group by 1",
)
def e23_hosts(spark: SparkSession, d: str) -> DataFrame:
    u = F.coalesce("raw_url", F.lit(""))
    vendor = F.lit("other")
    for v in ("leafhire", "dayworks", "persona"):
        vendor = F.when(S.host_under(u, f"{v}.example"), v).otherwise(vendor)
    return table(spark, d, "jobs").groupBy(vendor.alias("vendor")).agg(F.count("*").alias("n"))


@query("e31_slugs", "select distinct title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from jobs where title is not null")
def e31_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where("title is not null").select("title").distinct().select("title", S.slug(F.col("title")).alias("slug"))


@query("e32_cosine", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def e32_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@query("e33_digests", "select doc_id, sha256(text) as digest from documents where text is not null")
def e33_digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


# Changes of tables

RANK_SQL = "case posted_at_confidence when 'exact' then 3 when 'relative_exact' then 2 when 'lower_bound' then 1 else 0 end"


@query(
    "d3_upsert",
    f"""with f as (select batch_no > 12 as late, {LINK_SQL} as link, min_by(first_seen_at, job_id) as first_seen_at, arg_max(provider_job_id, job_id) filter (where provider_job_id is not null) as provider_job_id,
                arg_max(posted_at_confidence, ({RANK_SQL}, job_id)) as confidence, max({RANK_SQL}) as rank from jobs where {LINK_SQL} is not null group by 1, 2),
             b as (select * from f where not late), n as (select * from f where late)
        select coalesce(b.link, n.link) as link, coalesce(b.first_seen_at, n.first_seen_at) as first_seen_at, coalesce(n.provider_job_id, b.provider_job_id) as provider_job_id,
          case when n.link is not null and n.rank >= coalesce(b.rank, -1) then n.confidence else b.confidence end as confidence from b full outer join n on b.link = n.link""",
)
def d3_upsert(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").withColumn("link", link()).where("link is not null").withColumn("rank", confidence_rank()).withColumn("confidence", F.col("posted_at_confidence"))
    j = j.select("link", "batch_no", "job_id", "first_seen_at", "provider_job_id", "confidence", "rank")

    def side(rows: DataFrame) -> DataFrame:
        return merges.folded_batch(rows, "link", "job_id", ["first_seen_at"], ["provider_job_id"], {"confidence": F.col("rank"), "rank": F.col("rank")})

    new = merges.upsert(side(j.where("batch_no <= 12")), side(j.where("batch_no > 12")), "link", ["first_seen_at"], ["provider_job_id"], {"confidence": ("rank", "rank")})
    return new.select("link", "first_seen_at", "provider_job_id", "confidence")


@query("d4_update_where", "select job_id, case when queue_status = 'new' and coalesce(jd_status = 'gone', false) then 'skipped' else queue_status end as queue_status from jobs")
def d4_update_where(spark: SparkSession, d: str) -> DataFrame:
    hit = (F.col("queue_status") == "new") & (F.col("jd_status") == "gone")
    return merges.update_where(table(spark, d, "jobs"), hit, {"queue_status": F.lit("skipped")}).select("job_id", "queue_status")


@query("d10_delete", "select id from applications where id not in (select app_id from status_events where status = 'Rejected' and app_id is not null)")
def d10_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "status_events").where("status = 'Rejected' and app_id is not null").select(F.col("app_id").alias("id"))
    return merges.delete_keys(table(spark, d, "applications"), gone, "id").select("id")


@query(
    "d15_audit",
    """with a as (select id, status, score, date from applications)
       select 'bold status' as rule, 'error' as severity, id from a where contains(status, '**') union all
       select 'score form' as rule, 'error' as severity, id from a where score <> '—' and not regexp_matches(score, '^[0-9]+(\\.[0-9]+)?/5$') union all
       select 'date form' as rule, 'warning' as severity, id from a where not regexp_matches(date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')""",
)
def d15_audit(spark: SparkSession, d: str) -> DataFrame:
    rules = [
        ("bold status", "error", F.col("status").contains("**")),
        ("score form", "error", (F.col("score") != "—") & ~F.col("score").rlike(r"^\d+(\.\d+)?/5$")),
        ("date form", "warning", ~F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$")),
    ]
    return merges.audit(table(spark, d, "applications"), "id", rules)


# Further filters, picks and orders


@query(
    "f10_cooldown",
    """select j.job_id from jobs j where exists (select 1 from applications a where a.company = j.company and try_cast(a.date as date) is not null and regexp_matches(a.date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')
         and date_diff('day', a.date::date, j.first_seen_at::date) between 0 and 60)""",
)
def f10_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """Postings of a company applied to within the 60 days before.

    Days are cut into blocks of 61, the join key. Only an application in a posting's own block, on its day or
    before, or one in the block before can be that near: the first of the one and the last of the other tell.
    So a company has a row per block, however often it was applied to. As these grow with the
    applications, of which parquet's size tells little, they are merged rather than broadcast.
    """
    wide = 61

    def block(day: Column) -> Column:
        return day - F.pmod(day, F.lit(wide))

    a = table(spark, d, "applications").select("company", F.unix_date(S.strict_date(F.col("date"))).alias("day")).where("company is not null and day is not null")
    own = F.struct(block(F.col("day")).alias("block"), F.col("day").alias("since"), F.lit(None).cast("int").alias("until"))
    after = F.struct((block(F.col("day")) + wide).alias("block"), F.lit(None).cast("int").alias("since"), (F.col("day") + wide - 1).alias("until"))
    spans = a.select("company", F.inline(F.array(own, after))).groupBy("company", "block").agg(F.min("since").alias("since"), F.max("until").alias("until"))
    j = table(spark, d, "jobs").where("company is not null").select("job_id", "company", F.unix_date(F.col("first_seen_at").cast("date")).alias("day")).where("day is not null")
    j = j.withColumn("block", block(F.col("day")))
    return j.join(spans.hint("merge"), ["company", "block"]).where("day >= since or day <= until").select("job_id")


@query(
    "f13_recheck",
    "select job_id, case when queue_status = 'evaluated' then 'known' when last_seen_at >= timestamp '2025-12-01 00:00:00' then 'recent' when retry_count > 3 then 'given up' else 'again' end as policy from jobs",
)
def f13_recheck(spark: SparkSession, d: str) -> DataFrame:
    p = (
        F.when(F.col("queue_status") == "evaluated", "known")
        .when(F.col("last_seen_at") >= F.lit("2025-12-01 00:00:00").cast("timestamp_ntz"), "recent")
        .when(F.col("retry_count") > 3, "given up")
        .otherwise("again")
    )
    return table(spark, d, "jobs").select("job_id", p.alias("policy"))


@query(
    "f24_find",
    "select id from applications where id = 42 or contains(lower(coalesce(role, '')), 'platform') or contains(lower(coalesce(company, '')), 'platform')",
)
def f24_find(spark: SparkSession, d: str) -> DataFrame:
    spec = filters.Spec(needle=(("role", "company"), "platform"), columns=["id"])
    a = table(spark, d, "applications")
    return spec.build(a).unionByName(a.where("id = 42").select("id")).distinct()


@query(
    "f27_facets",
    "select source, count(*) as n, array_to_string(list_sort(list_distinct(list(liveness_status))), ',') as states from jobs where location ilike '%remote%' and first_seen_at >= timestamp '2025-09-01 00:00:00' group by source",
)
def f27_facets(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").where(F.col("location").ilike("%remote%") & (F.col("first_seen_at") >= F.lit("2025-09-01 00:00:00").cast("timestamp_ntz")))
    return j.groupBy("source").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("liveness_status")), ",").alias("states"))


@query(
    "j4_first_seen",
    f"select a.job_id, m.first_at from jobs a join (select {LINK_SQL} as link, min(first_seen_at) as first_at from jobs group by 1) m on m.link = {LINK_SQL.replace('canonical_url', 'a.canonical_url').replace('raw_url', 'a.raw_url')}",
)
def j4_first_seen(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").select("job_id", link().alias("link"), "first_seen_at")
    return j.join(j.groupBy("link").agg(F.min("first_seen_at").alias("first_at")), "link").select("job_id", "first_at")


@query(
    "j13_ranked_overlap",
    f"""with q as (select id, {ROLE_TOKENS_SQL.format(SPACE_SQL.format("role"))} as k from applications where id % 100 = 0 and role is not null),
             t as (select title, {ROLE_TOKENS_SQL.format(SPACE_SQL.format("title"))} as k from (select distinct title from jobs where title is not null)),
             s as (select id, title, 2.0 * len(list_intersect(q.k, t.k)) / (len(q.k) + len(t.k)) as dice from q join t on len(list_intersect(q.k, t.k)) > 0)
        select id, title, round(dice, 6) as dice from (select *, row_number() over (partition by id order by dice desc, title) as r from s) where r <= 5""",
)
def j13_ranked_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The five titles that share most words with each query role (every id divisible by 100), by Dice's measure: counts of shared words from a join on words."""
    q = table(spark, d, "applications").where("id % 100 = 0 and role is not null").select("id", S.role_tokens(F.col("role")).alias("k"))
    t = table(spark, d, "jobs").where("title is not null").select("title").distinct().withColumn("k", S.role_tokens(F.col("title")))
    qw, tw = q.select("id", F.size("k").alias("nq"), F.explode("k").alias("w")), t.select("title", F.size("k").alias("nt"), F.explode("k").alias("w"))
    s = qw.join(tw, "w").groupBy("id", "title", "nq", "nt").agg(F.count("*").alias("shared"))
    s = s.withColumn("dice", 2.0 * F.col("shared") / (F.col("nq") + F.col("nt")))
    w = Window.partitionBy("id").orderBy(F.desc("dice"), "title")
    return s.withColumn("r", F.row_number().over(w)).where("r <= 5").select("id", "title", F.round("dice", 6).alias("dice"))


@query(
    "j16_with_fallback",
    f"""with j as (select provider_job_id as p, min(job_id) as by_id from jobs where provider_job_id is not null group by 1), c as (select company, min(job_id) as by_company from jobs where company is not null group by 1)
        select a.id, coalesce(j.by_id, c.by_company) as job_id from applications a left join j on j.p = a.id::varchar left join c on c.company = a.company""",
)
def j16_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs")
    by_id = jobs.where("provider_job_id is not null").groupBy(F.col("provider_job_id").alias("p")).agg(F.min("job_id").alias("by_id"))
    by_company = jobs.where("company is not null").groupBy("company").agg(F.min("job_id").alias("by_company"))
    a = table(spark, d, "applications").select("id", "company", F.col("id").cast("string").alias("p"))
    return a.join(by_id, "p", "left").join(by_company, "company", "left").select("id", F.coalesce("by_id", "by_company").alias("job_id"))


@query(
    "j18_reconciled",
    f"""with p as (select {LINK_SQL} as link, min(job_id) as job_id from jobs where batch_no <= 12 and {LINK_SQL} is not null group by 1), s as (select {LINK_SQL} as link, max(queue_status) as st from jobs where batch_no > 12 and {LINK_SQL} is not null group by 1)
        select p.job_id, case when s.link is null then 'keep' when s.st = 'evaluated' then 'move' else 'repeat' end as action from p left join s on s.link = p.link""",
)
def j18_reconciled(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").select("job_id", "batch_no", "queue_status", link().alias("link")).where("link is not null")
    p = j.where("batch_no <= 12").groupBy("link").agg(F.min("job_id").alias("job_id"))
    s = j.where("batch_no > 12").groupBy("link").agg(F.max("queue_status").alias("st"))
    return p.join(s, "link", "left").select("job_id", F.when(F.col("st").isNull(), "keep").when(F.col("st") == "evaluated", "move").otherwise("repeat").alias("action"))


@query("j22_without_closed", "select job_id from jobs where queue_status = 'llm_ready' and coalesce(company, '') not in (select company from applications where status in ('Rejected', 'Discarded') and company is not null)")
def j22_without_closed(spark: SparkSession, d: str) -> DataFrame:
    closed = table(spark, d, "applications").where("status in ('Rejected', 'Discarded') and company is not null").select("company").distinct()
    return table(spark, d, "jobs").where("queue_status = 'llm_ready'").join(closed, "company", "left_anti").select("job_id")


@query(
    "a2_cumulative",
    """select count(*) filter (where r >= 1) as applied, count(*) filter (where r >= 2) as responded, count(*) filter (where r >= 3) as interviewed, count(*) filter (where r >= 4) as offered,
         floor(1000.0 * count(*) filter (where r >= 2) / nullif(count(*) filter (where r >= 1), 0) + 0.5) / 10 as response_rate
       from (select case status when 'Offer' then 4 when 'Interview' then 3 when 'Responded' then 2 when 'Applied' then 1 when 'Rejected' then 1 else 0 end as r from applications)""",
)
def a2_cumulative(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    r = F.when(s == "Offer", 4).when(s == "Interview", 3).when(s == "Responded", 2).when(s.isin("Applied", "Rejected"), 1).otherwise(0)
    g = table(spark, d, "applications").select(r.alias("r")).agg(*(F.count_if(F.col("r") >= i).alias(n) for i, n in enumerate(("applied", "responded", "interviewed", "offered"), 1)))
    return g.withColumn("response_rate", S.round_half_up(100.0 * F.col("responded") / F.nullif("applied", F.lit(0)), 1))


@query(
    "a6_run_stats",
    "select batch_no, count(*) as found, count(*) filter (where queue_status = 'failed') as failed, round(100.0 * count(*) filter (where skip_reason is not null) / count(*), 4) as removed_share, round(avg(retry_count), 4) as mean_retries from jobs group by batch_no",
)
def a6_run_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").groupBy("batch_no").agg(
        F.count("*").alias("found"),
        F.count_if(F.col("queue_status") == "failed").alias("failed"),
        F.round(100.0 * F.count("skip_reason") / F.count("*"), 4).alias("removed_share"),
        F.round(F.avg("retry_count"), 4).alias("mean_retries"),
    )


@query(
    "a16_reasons_in_text",
    "select reason, count(*) as n from (select unnest(list_distinct(regexp_extract_all(lower(notes), '(sponsorship|clearance|commute|salary|on-call|years of)'))) as reason from applications where notes is not null) group by reason order by n desc, reason limit 15",
)
def a16_reasons_in_text(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    found = F.regexp_extract_all(F.lower("notes"), F.lit("(sponsorship|clearance|commute|salary|on-call|years of)"), 1)
    r = table(spark, d, "applications").where("notes is not null").select(F.explode(F.array_distinct(found)).alias("reason"))
    return r.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(15)


@query(
    "a20_weighted_skills",
    """with s as (select job_id, retry_count, unnest(from_json(missing_required_skills, '["VARCHAR"]')) as skill from jobs)
       select skill, sum(greatest(0, 5 - retry_count))::bigint as weight, round(avg(case when retry_count >= 2 then 1.0 else 0.0 end), 4) as low_share,
         case when sum(greatest(0, 5 - retry_count)) >= 100 then 'high' when sum(greatest(0, 5 - retry_count)) >= 30 then 'medium' else 'low' end as tier from s where skill not in ('Java', 'Go') group by skill""",
)
def a20_weighted_skills(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "jobs").select("retry_count", F.explode(F.from_json("missing_required_skills", "array<string>")).alias("skill")).where(~F.col("skill").isin("Java", "Go"))
    g = s.groupBy("skill").agg(F.sum(F.greatest(F.lit(0), 5 - F.col("retry_count"))).alias("weight"), F.round(F.avg((F.col("retry_count") >= 2).cast("double")), 4).alias("low_share"))
    return g.withColumn("tier", F.when(F.col("weight") >= 100, "high").when(F.col("weight") >= 30, "medium").otherwise("low"))


@query(
    "a21_skill_classes",
    """with s as (select job_id, from_json(missing_required_skills, '["VARCHAR"]') as k from jobs)
       select job_id, array_to_string(list_sort(list_filter(k, lambda x: x in ('Java', 'Python'))), ',') as existing, array_to_string(list_sort(list_filter(k, lambda x: x not in ('Java', 'Python'))), ',') as gaps from s where len(k) > 0""",
)
def a21_skill_classes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "jobs").select("job_id", F.from_json("missing_required_skills", "array<string>").alias("k")).where("size(k) > 0")
    have = F.array(F.lit("Java"), F.lit("Python"))
    some = lambda c: F.array_join(F.array_sort(c), ",")
    inside, outside = F.filter("k", lambda x: F.array_contains(have, x)), F.filter("k", lambda x: ~F.array_contains(have, x))
    return s.select("job_id", some(inside).alias("existing"), some(outside).alias("gaps"))


@query(
    "a23_by_platform",
    "select source, count(*) as n, count(*) filter (where liveness_status = 'live') as live, count(*) filter (where liveness_status = 'gone') as gone, count(*) filter (where liveness_status not in ('live', 'gone')) as unknown from jobs group by 1",
)
def a23_by_platform(spark: SparkSession, d: str) -> DataFrame:
    live = F.col("liveness_status")
    return table(spark, d, "jobs").groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(live == "live").alias("live"), F.count_if(live == "gone").alias("gone"), F.count_if(~live.isin("live", "gone")).alias("unknown")
    )


@query(
    "a27_name_groups",
    f"select {SQUEEZE_SQL.format('company')} as key, count(*) as n, count(distinct company) as spellings, min(company) as one from jobs where company is not null group by 1 having count(distinct company) > 1",
)
def a27_name_groups(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").where("company is not null").groupBy("company").agg(F.count("*").alias("n"))
    return j.groupBy(S.squeezed(F.col("company")).alias("key")).agg(F.sum("n").alias("n"), F.count("*").alias("spellings"), F.min("company").alias("one")).where("spellings > 1")


@query(
    "a34_before_after",
    "select queue_status as before, coalesce(skip_reason, queue_status) as after, count(*) as n from jobs group by 1, 2",
)
def a34_before_after(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").groupBy(F.col("queue_status").alias("before"), F.coalesce("skip_reason", "queue_status").alias("after")).agg(F.count("*").alias("n"))


@query(
    "a39_flag_counts",
    """select flag, count(*) as n from (select unnest([case when everify_status = 'not_found' then 'no registry' end, case when sponsorship_status = 'fail' then 'sponsorship' end, case when liveness_status = 'gone' then 'gone' end]) as flag from jobs) where flag is not null group by flag""",
)
def a39_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    flags = F.array_compact(
        F.array(
            F.when(F.col("everify_status") == "not_found", "no registry"), F.when(F.col("sponsorship_status") == "fail", "sponsorship"), F.when(F.col("liveness_status") == "gone", "gone")
        )
    )
    return table(spark, d, "jobs").select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("a_approx_distinct")
def a_approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Engine extra: distinct counts by a sketch of bounded size."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.count("*").alias("n"))


@query("s1_newest", "select id, company, status from applications order by id desc limit 20")
def s1_newest(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return filters.Spec(order=[("id", True)], limit=20, columns=["id", "company", "status"]).build(table(spark, d, "applications"))


@query(
    "s2_ready_queue",
    "select job_id from jobs where queue_status = 'llm_ready' order by case posted_at_confidence when 'exact' then 0 when 'relative_exact' then 1 when 'lower_bound' then 2 else 3 end, case everify_status when 'pass' then 0 else 1 end, first_seen_at desc, job_id limit 25",
)
def s2_ready_queue(spark: SparkSession, d: str) -> DataFrame:
    """A worker's next batch: three ranks, then source order."""
    j = table(spark, d, "jobs").where("queue_status = 'llm_ready'")
    return j.orderBy(-confidence_rank(), F.when(F.col("everify_status") == "pass", 0).otherwise(1), F.desc_nulls_last("first_seen_at"), "job_id").limit(25).select("job_id")


@query("s8_newest_first", "select job_id from jobs where queue_status = 'new' order by posted_at desc nulls last, job_id limit 100")
def s8_newest_first(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return table(spark, d, "jobs").where("queue_status = 'new'").orderBy(F.desc_nulls_last("posted_at"), "job_id").limit(100).select("job_id")


@query(
    "s12_mean_of_best",
    """select q, round(avg(c), 5) as strength from (select a.vec_id as q, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as c, row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.vec_id) as r
         from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0) where r <= 3 group by q""",
)
def s12_mean_of_best(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    got = joins.nearest_vectors(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 3)
    return got.groupBy(F.col("query").alias("q")).agg(F.round(F.avg("cosine"), 5).alias("strength"))


@query(
    "s14_story_ranking",
    """select doc_id, score from (select doc_id, 3 * contains(t, 'kafka')::int + 2 * contains(t, 'spark')::int + contains(t, 'python')::int as score from (select doc_id, lower(text) as t from documents where text is not null)) where score > 0 order by score desc, doc_id limit 20""",
)
def s14_story_ranking(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    t = F.lower("text")
    score = 3 * t.contains("kafka").cast("int") + 2 * t.contains("spark").cast("int") + t.contains("python").cast("int")
    return table(spark, d, "documents").where("text is not null").select("doc_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(20)


@query("u2_bag_union", "select company, 'application' as kind from applications union all select company, 'posting' as kind from jobs")
def u2_bag_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "applications").select("company", F.lit("application").alias("kind")).unionByName(table(spark, d, "jobs").select("company", F.lit("posting").alias("kind")))


@query(
    "e4_aliases",
    f"""with s as (select distinct company, {SQUEEZE_SQL.format("company")} as k from jobs where company is not null), u as (select k, min(company) as one from s group by k having count(*) = 1)
        select a.id, coalesce(u.one, a.company) as company from applications a left join u on u.k = {SQUEEZE_SQL.format("a.company")}""",
)
def e4_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Companies under the spelling of the queue where that is unambiguous."""
    s = table(spark, d, "jobs").where("company is not null").select("company").distinct().withColumn("k", S.squeezed(F.col("company")))
    u = s.groupBy("k").agg(F.count("*").alias("n"), F.min("company").alias("one")).where("n = 1").select("k", "one")
    a = table(spark, d, "applications").select("id", "company", S.squeezed(F.col("company")).alias("k"))
    return a.join(u, "k", "left").select("id", F.coalesce("one", "company").alias("company"))


@query(
    "e5_medians",
    "select l_returnflag, median(l_quantity) as mid, quantile_cont(l_quantity, 0.75) as p75, quantile_disc(l_quantity, 0.5) as lower_mid from lineitem group by 1",
)
def e5_medians(spark: SparkSession, d: str) -> DataFrame:
    return ordered.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", mid=("between", 0.5), p75=("between", 0.75), lower_mid=("lower", 0.5))


@query(
    "e8_days_between",
    "select id, date_diff('day', date::date, date '2026-08-01') as days, (date::date + interval 7 day)::date as next_day from applications where regexp_matches(date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') and try_cast(date as date) is not null",
)
def e8_days_between(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "applications").select("id", S.strict_date(F.col("date")).alias("x")).where("x is not null")
    return a.select("id", F.datediff(F.lit("2026-08-01").cast("date"), "x").cast("bigint").alias("days"), F.date_add("x", 7).alias("next_day"))


@query(
    "e14_annual",
    "select l_orderkey, l_linenumber, l_suppkey, l_partkey, case when l_quantity < 10 then l_quantity * 2080 when l_quantity < 30 then l_quantity * 12 else l_quantity end as annual from lineitem",
)
def e14_annual(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.when(q < 10, q * 2080).when(q < 30, q * 12).otherwise(q).alias("annual"))


@query(
    "e16_role_keys",
    r"select distinct title, regexp_replace(lower(regexp_replace(title, '(\s*(\([^()]*\)|\[[^\[\]]*\])){0,3}\s*$', '')), '[^a-z0-9]', '', 'g') as key from jobs where title is not null",
)
def e16_role_keys(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "jobs").where("title is not null").select("title").distinct()
    return t.select("title", S.role_key(F.col("title")).alias("key"))


@query("e20_sentence_counts")
def e20_sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(S.sentences(F.col("text"))).alias("sentences"))


@query(
    "e25_seniority",
    """select job_id, case when regexp_matches(lower(title), '\\b(principal|staff|lead)\\b') then 'lead' when regexp_matches(lower(title), '\\bsenior\\b') then 'senior' when regexp_matches(lower(title), '\\b(junior|associate|werkstudent)\\b') then 'junior' else 'mid' end as seniority from jobs where title is not null""",
)
def e25_seniority(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("title")
    s = F.when(t.rlike(r"\b(principal|staff|lead)\b"), "lead").when(t.rlike(r"\bsenior\b"), "senior").when(t.rlike(r"\b(junior|associate|werkstudent)\b"), "junior").otherwise("mid")
    return table(spark, d, "jobs").where("title is not null").select("job_id", s.alias("seniority"))


@query(
    "e26_ordered_classes",
    """select doc_id, case when contains(t, 'offer') then 'offer' when contains(t, 'interview') then 'interview' when contains(t, 'unfortunately') or contains(t, 'leider') then 'refusal' when contains(t, 'thanks for applying') then 'receipt' end as class
       from (select doc_id, lower(text) as t from documents where doc_kind = 'mail')""",
)
def e26_ordered_classes(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("text")
    classes = [("offer", ["offer"]), ("interview", ["interview"]), ("refusal", ["unfortunately", "leider"]), ("receipt", ["thanks for applying"])]
    return table(spark, d, "documents").where("doc_kind = 'mail'").select(
        "doc_id", filters.first_reject([(n, filters.any_of([t.contains(w) for w in words])) for n, words in classes]).alias("class")
    )


@query(
    "e29_report_numbers",
    "select id, try_cast(regexp_extract(report, '^\\[([0-9]+)\\]', 1) as int) as report_no, regexp_extract(report, '\\(([^)]*)\\)', 1) as path from applications",
)
def e29_report_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "applications").select(
        "id", F.regexp_extract("report", r"^\[([0-9]+)\]", 1).try_cast("int").alias("report_no"), F.regexp_extract("report", r"\(([^)]*)\)", 1).alias("path")
    )


@query(
    "e35_unknown_claims",
    "select doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[0-9]+ years'), lambda x: x not in ('2 years', '3 years', '5 years')))), ',') as claims from documents where regexp_matches(text, '[0-9]+ years')",
)
def e35_unknown_claims(spark: SparkSession, d: str) -> DataFrame:
    known = F.array(*map(F.lit, ("2 years", "3 years", "5 years")))
    docs = table(spark, d, "documents").where(F.col("text").rlike("[0-9]+ years"))
    return docs.select("doc_id", F.array_join(F.array_sort(F.array_except(F.regexp_extract_all("text", F.lit("([0-9]+ years)"), 1), known)), ",").alias("claims"))


@query("d12_reserved_numbers", "select job_id, (select max(id) from applications) + row_number() over (order by job_id) as number from jobs where queue_status = 'in_progress'")
def d12_reserved_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive numbers after the largest in use, for the rows being worked on."""
    top = table(spark, d, "applications").agg(F.max("id").alias("top"))
    j = table(spark, d, "jobs").where("queue_status = 'in_progress'").select("job_id")
    return ordered.numbered(j, "job_id", "n").join(F.broadcast(top)).select("job_id", (F.col("top") + F.col("n")).alias("number"))  # top is one row


@query(
    "d13_missing_events",
    "select id, status, date from applications where status in ('Applied', 'Interview') and id not in (select app_id from status_events where app_id is not null)",
)
def d13_missing_events(spark: SparkSession, d: str) -> DataFrame:
    """Rows to seed: those of the states followed up that have no event yet; seeding again adds nothing."""
    a = table(spark, d, "applications").where("status in ('Applied', 'Interview')")
    return a.join(table(spark, d, "status_events").select(F.col("app_id").alias("id")), "id", "left_anti").select("id", "status", "date")


@query(
    "d14_text_pool",
    "select min(job_id) as job_id, count(*) as n from (select job_id, regexp_replace(lower(jd_text), '\\s+', '', 'g') as k from jobs where jd_text is not null) group by k",
)
def d14_text_pool(spark: SparkSession, d: str) -> DataFrame:
    """One posting per text, blanks and case aside; grouped by digest."""
    k = F.sha2(F.regexp_replace(F.lower("jd_text"), r"\s+", ""), 256)
    return table(spark, d, "jobs").where("jd_text is not null").groupBy(k.alias("k")).agg(F.min("job_id").alias("job_id"), F.count("*").alias("n")).select("job_id", "n")


@query(
    "w12_priority_rank",
    "select id, case status when 'Interview' then 0 when 'Offer' then 1 when 'Responded' then 2 when 'Applied' then 3 when 'Evaluated' then 4 else 9 end as priority from applications",
)
def w12_priority_rank(spark: SparkSession, d: str) -> DataFrame:
    rank = F.create_map(*(F.lit(x) for kv in {"Interview": 0, "Offer": 1, "Responded": 2, "Applied": 3, "Evaluated": 4}.items() for x in kv))
    return table(spark, d, "applications").select("id", F.coalesce(rank[F.col("status")], F.lit(9)).alias("priority"))


@query(
    "w_frames",
    "select user_id, event_id, lag(value) over w as before, sum(value) over (partition by user_id order by event_id rows between 2 preceding and current row) as last_three, ntile(4) over w as quarter from events window w as (partition by user_id order by event_id)",
)
def w_frames(spark: SparkSession, d: str) -> DataFrame:
    """Engine extra."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select(
        "user_id", "event_id", F.lag("value").over(w).alias("before"), F.sum("value").over(w.rowsBetween(-2, 0)).alias("last_three"), F.ntile(4).over(w).cast("bigint").alias("quarter")
    )


@query(
    "x5_state_aliases",
    "select e.id, coalesce(s.state_label, 'none') as label from status_events e left join (select lower(spelling) as k, min(state_label) as state_label from states group by 1) s on s.k = lower(trim(regexp_replace(e.status, '[*!.?]', '', 'g')))",
)
def x5_state_aliases(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "states").groupBy(F.lower("spelling").alias("k")).agg(F.min("state_label").alias("label"))
    e = table(spark, d, "status_events").select("id", F.lower(F.trim(F.regexp_replace("status", "[*!.?]", ""))).alias("k"))
    return e.join(s, "k", "left").select("id", F.coalesce("label", F.lit("none")).alias("label"))


@query(
    "x1_score_cell",
    "select id, case when regexp_matches(score, '^[0-9.]+/5$') and not regexp_matches(status, '^[0-9.]+/5$') then score when regexp_matches(status, '^[0-9.]+/5$') and not regexp_matches(score, '^[0-9.]+/5$') then status end as score from applications",
)
def x1_score_cell(spark: SparkSession, d: str) -> DataFrame:
    """The cell that alone looks like a score."""
    a, b = F.col("score").rlike(r"^[0-9.]+/5\z"), F.col("status").rlike(r"^[0-9.]+/5\z")
    return table(spark, d, "applications").select("id", F.when(a & ~b, F.col("score")).when(b & ~a, F.col("status")).alias("score"))


@query(
    "x48_host_families",
    "select regexp_extract(lower(regexp_extract(raw_url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]+)', 1)), '([a-z0-9-]+\\.[a-z0-9-]+)$', 1) as family, count(*) as n from jobs where raw_url is not null group by 1",
)
def x48_host_families(spark: SparkSession, d: str) -> DataFrame:
    host = F.lower(F.regexp_extract("raw_url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]+)", 1))
    return table(spark, d, "jobs").where("raw_url is not null").groupBy(F.regexp_extract(host, r"([a-z0-9-]+\.[a-z0-9-]+)$", 1).alias("family")).agg(F.count("*").alias("n"))


@query(
    "j12_best_or_ambiguous",
    f"""with d as (select doc_id, ' ' || {SPACE_SQL.format("text")} || ' ' as t from documents where doc_kind = 'mail'),
             c as (select company, {SPACE_SQL.format("company")} as c from (select distinct company from applications where company is not null)),
             s as (select doc_id, company, length(c) as score from d join c on c <> '' and contains(t, ' ' || c || ' ')), m as (select doc_id, max(score) as best from s group by 1),
             k as (select s.doc_id, count(*) as n, min(company) as company from s join m on m.doc_id = s.doc_id and m.best = s.score group by 1)
        select d.doc_id, case when k.n = 1 then k.company end as company, case when k.n is null then 'none' when k.n > 1 then 'ambiguous' else 'match' end as verdict from d left join k on k.doc_id = d.doc_id""",
)
def j12_best_or_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    """The company each mail is about: the longest name it holds, unless two are as long."""
    mails = table(spark, d, "documents").where("doc_kind = 'mail'")
    found = joins.phrase_matches(mails, "doc_id", "text", table(spark, d, "applications"), "company")
    scored = found.select("doc_id", F.col("phrase").alias("company"), F.length(S.spaced(F.col("phrase"))).alias("score"))
    return joins.best_or_ambiguous(mails, scored, "doc_id", "company", "score")


@query(
    "a4_coverage",
    "select count(*) as sources, count(*) filter (where ok > 0) as producing, round(100.0 * count(*) filter (where ok > 0) / count(*), 1) as share from (select source, count(*) filter (where jd_status = 'ok') as ok from jobs group by 1)",
)
def a4_coverage(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "jobs").groupBy("source").agg(F.count_if(F.col("jd_status") == "ok").alias("ok"))
    return g.agg(F.count("*").alias("sources"), F.count_if(F.col("ok") > 0).alias("producing"), F.round(100.0 * F.count_if(F.col("ok") > 0) / F.count("*"), 1).alias("share"))


@query(
    "a5_followed_up",
    """select count(*) as events, count(distinct app_id) as applications, round(count(*) / count(distinct app_id)::double, 4) as per_application,
         (select count(*) from applications where status = 'Applied' and id not in (select app_id from status_events where app_id is not null)) as without from status_events""",
)
def a5_followed_up(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "status_events")
    per = e.groupBy("app_id").agg(F.count("*").alias("n"))
    totals = per.agg(F.sum("n").alias("events"), F.count("app_id").alias("applications"))
    lacking = table(spark, d, "applications").where("status = 'Applied'").join(per.select(F.col("app_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("without"))
    return totals.join(F.broadcast(lacking)).select("events", "applications", F.round(F.col("events") / F.col("applications"), 4).alias("per_application"), "without")


@query("e34_initials", "select distinct company, upper(left(company, 1)) as first_letter from jobs where regexp_matches(company, '^[A-Za-z]')")
def e34_initials(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "jobs").where(F.col("company").rlike("^[A-Za-z]")).select("company").distinct()
    return c.select("company", F.substring(S.initials(F.col("company")), 1, 1).alias("first_letter"))


@query(
    "j14_tiered_lookup",
    f"""select company, tier from (select company, case when s = 'barbar' then 0 when starts_with(s, 'barbar ') then 1 when contains(' ' || s || ' ', ' barbar ') then 2 when contains(s, 'barbar') then 3 end as tier
          from (select distinct company, {SPACE_SQL.format("company")} as s from jobs where company is not null)) where tier is not null""",
)
def j14_tiered_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One name looked up: equal, beginning, whole word, part."""
    s, q = F.col("s"), "barbar"
    tier = F.when(s == q, 0).when(s.startswith(f"{q} "), 1).when(F.concat(F.lit(" "), s, F.lit(" ")).contains(f" {q} "), 2).when(s.contains(q), 3)
    names = table(spark, d, "jobs").where("company is not null").select("company").distinct().withColumn("s", S.spaced(F.col("company")))
    return names.select("company", tier.alias("tier")).where("tier is not null")


@query(
    "a30_dashboard",
    "select status, count(*) as n, count(*) filter (where pdf = '✅') as with_pdf, count(*) filter (where notes is null or notes = '') as without_notes, max(date) as last_date from applications group by status",
)
def a30_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "applications").groupBy("status").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("pdf") == "✅").alias("with_pdf"),
        F.count_if(F.coalesce("notes", F.lit("")) == "").alias("without_notes"),
        F.max("date").alias("last_date"),
    )


@query(
    "a38_host_report",
    "select regexp_extract(lower(raw_url), '([a-z]+)\\.example', 1) as family, count(*) as requests, sum(retry_count)::bigint as retries, count(*) filter (where queue_status = 'failed') as failed from jobs where raw_url is not null group by 1",
)
def a38_host_report(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").where("raw_url is not null")
    return j.groupBy(F.regexp_extract(F.lower("raw_url"), r"([a-z]+)\.example", 1).alias("family")).agg(
        F.count("*").alias("requests"), F.sum("retry_count").alias("retries"), F.count_if(F.col("queue_status") == "failed").alias("failed")
    )


@query(
    "s5_ranked_by_map",
    "select id, dense_rank() over (order by case status when 'Interview' then 0 when 'Responded' then 1 when 'Applied' then 2 else 9 end) as urgency from applications",
)
def s5_ranked_by_map(spark: SparkSession, d: str) -> DataFrame:
    """Dense places by a map of ranks: from the ranks in use, which are few."""
    rank = F.when(F.col("status") == "Interview", 0).when(F.col("status") == "Responded", 1).when(F.col("status") == "Applied", 2).otherwise(9)
    a = table(spark, d, "applications").select("id", rank.alias("r"))
    places = a.select("r").distinct().withColumn("urgency", F.row_number().over(Window.orderBy("r")).cast("bigint"))  # one row a rank
    return a.join(places, "r").select("id", "urgency")


@query("s10_missing_as_zero", "select job_id from jobs order by coalesce(posted_at, timestamp '1970-01-01 00:00:00') desc, job_id limit 50")
def s10_missing_as_zero(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    when = F.coalesce("posted_at", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return table(spark, d, "jobs").orderBy(when.desc(), "job_id").limit(50).select("job_id")


@query("s11_sample", "select job_id from jobs order by md5(job_id::varchar), job_id limit 100")
def s11_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: the same hundred rows every time, in an order that has nothing to do with the data."""
    return table(spark, d, "jobs").orderBy(F.md5(F.col("job_id").cast("string")), "job_id").limit(100).select("job_id")


@query(
    "s13_kept_by_score",
    "select id from (select id, try_cast(regexp_extract(score, '^([0-9.]+)/5$', 1) as double) as s from applications) where s >= 3.5",
)
def s13_kept_by_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "applications").where(S.leading_number(F.col("score")) >= 3.5).select("id")


@query(
    "e30_date_after_word",
    "select id, regexp_extract(notes, '(?:since|on) ([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) as day from applications where regexp_matches(notes, '(?:since|on) [0-9]{4}-[0-9]{2}-[0-9]{2}')",
)
def e30_date_after_word(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "applications").where(F.col("notes").rlike(r"(?:since|on) \d{4}-\d{2}-\d{2}"))
    return a.select("id", F.regexp_extract("notes", r"(?:since|on) (\d{4}-\d{2}-\d{2})", 1).alias("day"))


@query(
    "e24_ordered_class",
    "select job_id, case when location is null or trim(location) = '' then 'unknown' when starts_with(lower(location), 'remote -') then 'remote in region' when contains(lower(location), 'remote') then 'remote' when contains(location, ',') then 'city and state' else 'city' end as mode from jobs",
)
def e24_ordered_class(spark: SparkSession, d: str) -> DataFrame:
    p = F.lower("location")
    mode = (
        F.when(F.col("location").isNull() | (F.trim("location") == ""), "unknown")
        .when(p.startswith("remote -"), "remote in region")
        .when(p.contains("remote"), "remote")
        .when(p.contains(","), "city and state")
        .otherwise("city")
    )
    return table(spark, d, "jobs").select("job_id", mode.alias("mode"))


@query(
    "d2_source_token",
    """select sum(('0x' || substr(h, 1, 8))::bigint)::bigint as token, sum(('0x' || substr(h, 9, 8))::bigint)::bigint as second_token, count(*) as n
       from (select md5(id || '|' || coalesce(company, '') || '|' || coalesce(role, '') || '|' || coalesce(status, '')) as h from applications)""",
)
def d2_source_token(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the table's content: an index built from it is rebuilt when they differ. Sums of row digests, so that no order and no gathering is needed."""
    h = F.md5(F.concat_ws("|", F.col("id").cast("string"), *(F.coalesce(c, F.lit("")) for c in ("company", "role", "status"))))
    part = lambda at: F.sum(F.conv(F.substring("h", at, 8), 16, 10).cast("bigint"))
    return table(spark, d, "applications").select(h.alias("h")).agg(part(1).alias("token"), part(9).alias("second_token"), F.count("*").alias("n"))
