"""Queries of the queue's and the tracker's state changes, orders and record helpers, each with its SQL; tables are read whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import scalars as S
from ferrule.operators import error_parse, queue
from ferrule.plans.queries import LINK_SQL, SQUEEZE_SQL, SPACE_SQL, link
from ferrule.plans.registry import query
from ferrule.plans.session import table

SCORE_SQL = "try_cast(regexp_extract({0}score, '^([0-9.]+)/5$', 1) as double)"
QUEUE = ("queue_status", "in_progress")


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def jobs_with_token(spark: SparkSession, d: str) -> DataFrame:
    """The queue with the token under which a row was taken: here its source."""
    return table(spark, d, "jobs").withColumn("token", F.when(F.col("queue_status") == "in_progress", F.col("source")))


# State changes


@query(
    "d5_claim",
    """select job_id, case when r <= 50 then 'in_progress' else queue_status end as queue_status, case when r <= 50 then 'worker-1' end as token
       from (select job_id, queue_status, case when queue_status = 'llm_ready' then row_number() over (partition by queue_status order by posted_at desc nulls last, job_id) end as r from jobs)""",
)
def d5_claim(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").withColumn("token", F.lit(None).cast("string"))
    got = queue.claim(j, "job_id", "queue_status", "llm_ready", "in_progress", [F.col("posted_at").desc_nulls_last()], 50, "worker-1", "token")
    return got.select("job_id", "queue_status", "token")


@query("d6_complete", "select job_id, case when queue_status = 'in_progress' and source = 'persona-scan' then 'evaluated' else queue_status end as queue_status, case when queue_status = 'in_progress' and source <> 'persona-scan' then source end as token from jobs")
def d6_complete(spark: SparkSession, d: str) -> DataFrame:
    return queue.complete(jobs_with_token(spark, d), "queue_status", "in_progress", "evaluated", "token", "persona-scan").select("job_id", "queue_status", "token")


@query("d6_release", "select job_id, case when queue_status = 'in_progress' and source = 'direct-scan' then 'llm_ready' else queue_status end as queue_status, retry_count from jobs")
def d6_release(spark: SparkSession, d: str) -> DataFrame:
    return queue.release(jobs_with_token(spark, d), "queue_status", "in_progress", "llm_ready", "token", "direct-scan").select("job_id", "queue_status", "retry_count")


@query(
    "d6_fail",
    """select job_id, case when hit and coalesce(retry_count, 0) + 1 < 3 then 'llm_ready' when hit then 'failed' else queue_status end as queue_status, case when hit then coalesce(retry_count, 0) + 1 else retry_count end as retry_count
       from (select *, coalesce(queue_status = 'in_progress' and jd_status = 'error', false) as hit from jobs)""",
)
def d6_fail(spark: SparkSession, d: str) -> DataFrame:
    return queue.fail(table(spark, d, "jobs"), "queue_status", "in_progress", "llm_ready", "failed", "retry_count", 3, F.col("jd_status") == "error").select("job_id", "queue_status", "retry_count")


@query("d6_reclaim", "select job_id, case when queue_status = 'in_progress' and last_seen_at < timestamp '2025-12-01 00:00:00' then 'llm_ready' else queue_status end as queue_status from jobs")
def d6_reclaim(spark: SparkSession, d: str) -> DataFrame:
    return queue.reclaim(table(spark, d, "jobs"), "queue_status", "in_progress", "llm_ready", "last_seen_at", moment("2025-12-01 00:00:00")).select("job_id", "queue_status")


@query(
    "d7_set_text",
    """with t as (select company, title, arg_min(jd_text, job_id) as found from jobs where jd_text is not null and company is not null and title is not null group by 1, 2)
       select job_id, case when jd_text is not null then jd_status when found is not null then 'ok' when jd_status = 'gone' then 'gone' else 'error' end as jd_status, length(coalesce(jd_text, found)) as characters
       from jobs left join t using (company, title)""",
)
def d7_set_text(spark: SparkSession, d: str) -> DataFrame:
    """Postings without text take the first one of the same employer and title."""
    j = table(spark, d, "jobs").select("job_id", "company", "title", "jd_text", "jd_status")
    found = j.where("jd_text is not null and company is not null and title is not null").groupBy("company", "title").agg(F.min_by("jd_text", "job_id").alias("jd_text"))
    return queue.filled_text(j, found, ["company", "title"], "jd_text", "jd_status").select("job_id", "jd_status", F.length("jd_text").cast("bigint").alias("characters"))


@query(
    "d8_healed_scores",
    f"""with s as (select company, role, max({SCORE_SQL.format('')}) as best from applications where company is not null and role is not null group by 1, 2)
        select a.id, coalesce({SCORE_SQL.format('a.')}, s.best) as score from applications a left join s on s.company = a.company and s.role = a.role""",
)
def d8_healed_scores(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "applications").select("id", "company", "role", S.leading_number(F.col("score")).alias("score"))
    return queue.healed_scores(a, a.where("company is not null and role is not null"), ["company", "role"], "score").select("id", "score")


@query("d9_merge_additions")
def d9_merge_additions(spark: SparkSession, d: str) -> DataFrame:
    """The tracker with all tracker lines that load merged in: by number and employer, else by employer and role."""
    a = table(spark, d, "applications").select("id", "pos", "company", "role", "notes", S.leading_number(F.col("score")).alias("score")).withColumn("num", F.col("id"))
    n = error_parse.tracker_loaded(table(spark, d, "tracker_lines"), table(spark, d, "states"))
    n = n.select(F.col("line_no").alias("pos"), F.col("num").cast("bigint").alias("num"), "company", "role", "notes", "score")
    return queue.merged_additions(a, n, "id", "pos", [["num", "company"], ["company", "role"]], "score").select("id", "company", "role", "score", "notes", "change")


@query(
    "d10_delete_report",
    """with g as (select distinct app_id as id from status_events where status = 'Rejected' and app_id is not null)
       select g.id, (select count(*) from applications a where a.id = g.id) as removed, (select count(*) from status_events e where e.app_id = g.id) as orphans from g""",
)
def d10_delete_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "status_events")
    gone = e.where("status = 'Rejected' and app_id is not null").select(F.col("app_id").alias("id"))
    return queue.deleted(table(spark, d, "applications"), gone, "id", e, "id", "app_id")


@query(
    "d11_resolved_rows",
    f"""with r as (select job_id, {SQUEEZE_SQL.format("company")} as c, title from jobs where company is not null and title is not null and queue_status = 'evaluated'),
        a as (select id, {SQUEEZE_SQL.format("company")} as c, role from applications where company is not null),
        x as (select c, count(*) as n, min(id) as id from a group by 1), y as (select c, role, count(*) as n, min(id) as id from a where role is not null group by 1, 2)
        select r.job_id, case when y.n is not null then case when y.n = 1 then y.id end when x.n = 1 then x.id end as id, case when coalesce(y.n, x.n) is null then 'none' when coalesce(y.n, x.n) = 1 then 'one' else 'ambiguous' end as outcome
        from r left join x on x.c = r.c left join y on y.c = r.c and y.role = r.title""",
)
def d11_resolved_rows(spark: SparkSession, d: str) -> DataFrame:
    """The tracker row that each evaluated posting means: by employer and role, else by employer alone; several are ambiguous."""
    r = table(spark, d, "jobs").where("company is not null and title is not null and queue_status = 'evaluated'").select("job_id", S.squeezed(F.col("company")).alias("c"), F.col("title").alias("role"))
    a = table(spark, d, "applications").where("company is not null").select("id", S.squeezed(F.col("company")).alias("c"), "role")
    return queue.resolved_rows(r, "job_id", a, "id", [["c", "role"], ["c"]])


# Orders

AGE_SQL = "case when posted_at is null then 3 when posted_at >= timestamp '2026-02-01 00:00:00' then 0 when posted_at >= timestamp '2026-01-01 00:00:00' then 1 when posted_at >= timestamp '2025-11-01 00:00:00' then 2 else 4 end"


def age_rank() -> Column:
    p = F.col("posted_at")
    return F.when(p.isNull(), 3).when(p >= moment("2026-02-01 00:00:00"), 0).when(p >= moment("2026-01-01 00:00:00"), 1).when(p >= moment("2025-11-01 00:00:00"), 2).otherwise(4)


@query("s3_next_batch", f"select job_id, {AGE_SQL} as bucket from jobs where queue_status = 'new' order by bucket, posted_at desc nulls last, job_id limit 40")
def s3_next_batch(spark: SparkSession, d: str) -> DataFrame:
    """The feature is the batch: the 40 freshest."""
    j = table(spark, d, "jobs").where("queue_status = 'new'").withColumn("bucket", age_rank())
    return j.orderBy("bucket", F.col("posted_at").desc_nulls_last(), "job_id").limit(40).select("job_id", "bucket")


@query(
    "s4_spend_order",
    f"""select job_id, bucket, tier, thin, row_number() over (order by bucket, tier, thin desc, job_id) as place from (select job_id, {AGE_SQL} as bucket,
          case when contains(lower(coalesce(title, '')), 'data') then 0 when contains(lower(coalesce(title, '')), 'engineer') then 1 else 2 end as tier, coalesce(location in ('Veldhaven', 'Quillfield'), false) as thin
        from jobs where queue_status = 'llm_ready') qualify place <= 100""",
)
def s4_spend_order(spark: SparkSession, d: str) -> DataFrame:
    """The feature is the report: the first hundred by freshness, title and market, ties in source order."""
    t = F.lower(F.coalesce("title", F.lit("")))
    j = table(spark, d, "jobs").where("queue_status = 'llm_ready'").select(
        "job_id", age_rank().alias("bucket"), F.when(t.contains("data"), 0).when(t.contains("engineer"), 1).otherwise(2).alias("tier"), F.coalesce(F.col("location").isin("Veldhaven", "Quillfield"), F.lit(False)).alias("thin")
    )
    first = j.orderBy("bucket", "tier", F.desc("thin"), "job_id").limit(100)
    return first.withColumn("place", F.row_number().over(Window.orderBy("bucket", "tier", F.desc("thin"), "job_id")).cast("bigint"))  # a hundred rows


MODE_SQL = "case when contains(lower(location), 'remote') then 0 when contains(lower(location), 'hybrid') then 1 when coalesce(trim(location), '') = '' then 3 else 2 end"


@query(
    "s6_grouped_sort",
    f"""select id, status_rank, mode, row_number() over (order by status_rank, mode, lower(coalesce(location, '')), {SCORE_SQL.format('')} desc nulls last, id) as place
        from (select *, case status when 'Offer' then 0 when 'Interview' then 1 when 'Responded' then 2 when 'Applied' then 3 when 'Evaluated' then 4 else 5 end as status_rank, {MODE_SQL} as mode from applications) qualify place <= 200""",
)
def s6_grouped_sort(spark: SparkSession, d: str) -> DataFrame:
    """The dashboard's grouped view, its first 200 rows: by status, work mode, place, then score."""
    place = F.lower("location")
    rank = F.coalesce(*(F.when(F.col("status") == s, F.lit(i)) for i, s in enumerate(("Offer", "Interview", "Responded", "Applied", "Evaluated"))), F.lit(5))
    mode = F.when(place.contains("remote"), 0).when(place.contains("hybrid"), 1).when(F.coalesce(F.trim("location"), F.lit("")) == "", 3).otherwise(2)
    a = table(spark, d, "applications").select("id", rank.alias("status_rank"), mode.alias("mode"), F.coalesce(place, F.lit("")).alias("p"), S.leading_number(F.col("score")).alias("s"))
    order = ["status_rank", "mode", "p", F.col("s").desc_nulls_last(), "id"]
    first = a.orderBy(*order).limit(200)
    return first.select("id", "status_rank", "mode", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"))  # 200 rows


# Joins


@query(
    "j9_roster_matches",
    f"""with x as (select distinct company as name, {SPACE_SQL.format("company")} as s from applications where company is not null), y as (select distinct company as match, {SPACE_SQL.format("company")} as s from jobs where company is not null),
        xt as (select name, s, unnest(string_split(s, ' ')) as w from x), yt as (select match, s, unnest(string_split(s, ' ')) as w from y),
        p as (select distinct xt.name, xt.s, yt.match, yt.s as t from xt join yt on xt.w = yt.w and length(xt.w) >= 6),
        v as (select name, match from p where len(list_filter(string_split(s, ' '), lambda w: not list_contains(string_split(t, ' '), w))) = 0 or len(list_filter(string_split(t, ' '), lambda w: not list_contains(string_split(s, ' '), w))) = 0)
        select name, match, row_number() over (partition by name order by abs(length(match) - length(name)), match) as place from v qualify place <= 8""",
)
def j9_roster_matches(spark: SparkSession, d: str) -> DataFrame:
    """Names that share a long word with a roster's name and whose words one of the two holds whole: the eight of likest length each."""

    def words(t: str, name: str) -> DataFrame:
        n = table(spark, d, t).where("company is not null").select(F.col("company").alias(name)).distinct()
        return n.withColumn(f"{name}_w", F.split(S.spaced(F.col(name)), " "))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select("*", F.explode(F.filter(F.array_distinct(f"{name}_w"), lambda w: F.length(w) >= 6)).alias("w"))

    pairs = keyed(words("applications", "name"), "name").join(keyed(words("jobs", "match"), "match"), "w").drop("w").distinct()
    held = (F.size(F.array_except("name_w", "match_w")) == 0) | (F.size(F.array_except("match_w", "name_w")) == 0)
    w = Window.partitionBy("name").orderBy(F.abs(F.length("match") - F.length("name")), "match")
    return pairs.where(held).select("name", "match", F.row_number().over(w).cast("bigint").alias("place")).where("place <= 8")


# Record helpers

CELL_SQL = "replace(replace(replace(coalesce({0}, ''), '|', '\\|'), chr(10), ' '), chr(13), ' ')"


def cell(name: str) -> Column:
    c = F.replace(F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))


ROW = ("id", "date", "company", "role", "score", "status", "notes")


@query("x4_rebuilt_rows", "select id, '| ' || " + " || ' | ' || ".join(CELL_SQL.format(f"{c}::varchar") for c in ROW) + " || ' |' as line from applications")
def x4_rebuilt_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "applications").select("id", F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, ROW)), F.lit(" |")).alias("line"))


@query("x34_spliced_rows", "select id, '| ' || " + " || ' | ' || ".join("'Applied'" if c == "status" else CELL_SQL.format(f"{c}::varchar") for c in ROW) + " || ' |' as line from applications where status = 'Evaluated'")
def x34_spliced_rows(spark: SparkSession, d: str) -> DataFrame:
    """One cell of a written row replaced, the others left as they stand: cells end at bars that aren't escaped."""
    rows = x4_rebuilt_rows(spark, d).join(table(spark, d, "applications").where("status = 'Evaluated'").select("id"), "id", "left_semi")
    cells = F.split("line", r"(?<!\\)\|")
    put = F.transform(cells, lambda c, i: F.when(i == ROW.index("status") + 1, F.lit(" Applied ")).otherwise(c))
    return rows.select("id", F.array_join(put, "|").alias("line"))


@query(
    "x7_valid_pins",
    """with p as (select app_id, max(date) as pinned from status_events where status = 'Interview' and regexp_matches(date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') group by 1),
            l as (select app_id, max(date) as last_date from status_events where regexp_matches(date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') group by 1)
       select p.app_id, case when last_date > pinned then null else pinned end as pinned from p join l on l.app_id = p.app_id""",
)
def x7_valid_pins(spark: SparkSession, d: str) -> DataFrame:
    """A pinned date holds unless something later happened."""
    e = table(spark, d, "status_events").where(F.col("date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.col("app_id").isNotNull())
    g = e.groupBy("app_id").agg(F.max(F.when(F.col("status") == "Interview", F.col("date"))).alias("p"), F.max("date").alias("last"))
    return g.where("p is not null").select("app_id", F.when(~(F.col("last") > F.col("p")), F.col("p")).alias("pinned"))


@query(
    "x9_applied_dates",
    """select id, case when ok then date when n <> '' then n else '2026-03-31' end as applied, case when ok then 'given' when n <> '' then 'notes' else 'today' end as origin
       from (select id, date, coalesce(regexp_matches(date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') and try_cast(date as date) is not null, false) as ok, coalesce(regexp_extract(notes, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') as n from applications)""",
)
def x9_applied_dates(spark: SparkSession, d: str) -> DataFrame:
    """The given date where it exists, else the first in the notes, else the day of the run (a parameter)."""
    a = table(spark, d, "applications").select("id", "date", F.coalesce(S.strict_date(F.col("date")).isNotNull(), F.lit(False)).alias("ok"), F.coalesce(F.regexp_extract("notes", "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")).alias("n"))
    pick = lambda x, y, z: F.when(F.col("ok"), x).when(F.col("n") != "", y).otherwise(z)
    return a.select("id", pick(F.col("date"), F.col("n"), F.lit("2026-03-31")).alias("applied"), pick(F.lit("given"), F.lit("notes"), F.lit("today")).alias("origin"))


@query("x12_tags", r"select id, lower(regexp_extract(notes, '\(([^()]+)\)', 1)) as tag from applications where regexp_matches(notes, '\(([^()]+)\)')")
def x12_tags(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower(F.regexp_extract("notes", r"\(([^()]+)\)", 1))
    return table(spark, d, "applications").select("id", t.alias("tag")).where("tag <> ''")


@query(
    "x16_tiers",
    f"""with s as (select id, case when s >= 4 then 'clean' when via is not null then 'anonymous' else 'marginal' end as tier, s from (select id, via, {SCORE_SQL.format('')} as s from applications where status in ('Evaluated', 'Applied')) where s >= 3)
        select id, tier from (select *, row_number() over (partition by tier order by s desc, id) as r from s) where tier <> 'marginal' or r <= 20""",
)
def x16_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The apply sheet: of the last tier the best twenty only, which is the feature, taken after filtering."""
    a = table(spark, d, "applications").where("status in ('Evaluated', 'Applied')").select("id", "via", S.leading_number(F.col("score")).alias("s")).where("s >= 3")
    t = a.withColumn("tier", F.when(F.col("s") >= 4, "clean").when(F.col("via").isNotNull(), "anonymous").otherwise("marginal"))
    return t.where("tier <> 'marginal'").select("id", "tier").unionByName(t.where("tier = 'marginal'").orderBy(F.desc("s"), "id").limit(20).select("id", "tier"))


@query("x17_ticked_rows", "select id, 'Applied' as status, strftime(try_cast(date as date) + interval 7 day, '%Y-%m-%d') as follow_up from applications where pdf = '✅' and status = 'Evaluated'")
def x17_ticked_rows(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "applications").where("pdf = '✅' and status = 'Evaluated'")
    return a.select("id", F.lit("Applied").alias("status"), F.date_add(S.strict_date(F.col("date")), 7).cast("string").alias("follow_up"))


@query("x20_error_classes", "select jd_status, liveness_status, case when jd_status = 'gone' or liveness_status = 'gone' then 'gone' when jd_status = 'error' and max(retry_count) > 2 then 'suspect' when jd_status = 'error' then 'transient' else 'other' end as class, count(*) as n from jobs group by 1, 2")
def x20_error_classes(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "jobs").groupBy("jd_status", "liveness_status").agg(F.max("retry_count").alias("r"), F.count("*").alias("n"))
    kind = F.when((F.col("jd_status") == "gone") | (F.col("liveness_status") == "gone"), "gone").when((F.col("jd_status") == "error") & (F.col("r") > 2), "suspect").when(F.col("jd_status") == "error", "transient").otherwise("other")
    return g.select("jd_status", "liveness_status", kind.alias("class"), "n")


@query(
    "x22_board_membership",
    """with b as (select distinct source, provider_job_id from jobs where provider_job_id is not null and liveness_status = 'live')
       select j.job_id, case when j.provider_job_id is null then 'inconclusive' when b.source is not null then 'active' else 'gone' end as liveness from jobs j left join b on b.source = j.source and b.provider_job_id = j.provider_job_id""",
)
def x22_board_membership(spark: SparkSession, d: str) -> DataFrame:
    """Whether a posting's id is on its board; without id nothing can be said."""
    j = table(spark, d, "jobs")
    b = j.where("provider_job_id is not null and liveness_status = 'live'").select("source", "provider_job_id", F.lit(True).alias("on")).distinct()
    kind = F.when(F.col("provider_job_id").isNull(), "inconclusive").when(F.col("on"), "active").otherwise("gone")
    return j.join(b, ["source", "provider_job_id"], "left").select("job_id", kind.alias("liveness"))


@query("x23_stale_after", "select source, cast(ceil(count(*) / 8.0) * 90 as bigint) as seconds from jobs where queue_status in ('in_progress', 'llm_ready') group by 1")
def x23_stale_after(spark: SparkSession, d: str) -> DataFrame:
    """How long a lease may last: waves of eight workers times the time-out."""
    j = table(spark, d, "jobs").where("queue_status in ('in_progress', 'llm_ready')").groupBy("source").agg(F.count("*").alias("n"))
    return j.select("source", (F.ceil(F.col("n") / 8.0) * 90).cast("bigint").alias("seconds"))


@query("x24_open_keepers", f"select id from applications where {SCORE_SQL.format('')} >= 3.5 and id not in (select app_id from status_events where status in ('Rejected', 'Discarded') and app_id is not null)")
def x24_open_keepers(spark: SparkSession, d: str) -> DataFrame:
    closed = table(spark, d, "status_events").where("status in ('Rejected', 'Discarded')").select(F.col("app_id").alias("id"))
    return table(spark, d, "applications").where(S.leading_number(F.col("score")) >= 3.5).join(closed, "id", "left_anti").select("id")


@query("x25_funnel_lines", "select rpad(queue_status, 12, ' ') || lpad(count(*)::varchar, 8, ' ') || '  ' || printf('%.1f', 100.0 * count(*) / (select count(*) from jobs)) || ' %' as line from jobs group by queue_status")
def x25_funnel_lines(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs")
    total = j.agg(F.count("*").alias("t"))
    g = j.groupBy("queue_status").agg(F.count("*").alias("n")).join(F.broadcast(total))  # total is one row
    return g.select(F.concat(F.rpad("queue_status", 12, " "), F.lpad(F.col("n").cast("string"), 8, " "), F.lit("  "), F.format_string("%.1f", 100.0 * F.col("n") / F.col("t")), F.lit(" %")).alias("line"))


@query("x27_seen_keys", f"select distinct {SQUEEZE_SQL.format('company')} || '|' || {SQUEEZE_SQL.format('role')} as key from applications where company is not null and role is not null union select distinct {SQUEEZE_SQL.format('company')} || '|' || {SQUEEZE_SQL.format('title')} from jobs where company is not null and title is not null")
def x27_seen_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = lambda t, c: table(spark, d, t).where(f"company is not null and {c} is not null").select(F.concat_ws("|", S.squeezed(F.col("company")), S.squeezed(F.col(c))).alias("key"))
    return keys("applications", "role").unionByName(keys("jobs", "title")).distinct()


HOST_SQL = f"lower(regexp_extract({LINK_SQL}, '^[A-Za-z]+://([^/?#:]+)', 1))"


@query("x28_first_of_host", f"select company, host, min(job_id) as first_job, count(distinct link) as links from (select job_id, company, {LINK_SQL} as link, {HOST_SQL} as host from jobs where company is not null) where host <> '' group by 1, 2")
def x28_first_of_host(spark: SparkSession, d: str) -> DataFrame:
    """The first hit of each employer on each host, and how many links it has there."""
    j = table(spark, d, "jobs").where("company is not null").select("job_id", "company", link().alias("link"))
    j = j.withColumn("host", F.lower(F.regexp_extract("link", "^[A-Za-z]+://([^/?#:]+)", 1))).where("host <> ''")
    return j.groupBy("company", "host").agg(F.min("job_id").alias("first_job"), F.count_distinct("link").alias("links"))


@query("x36_report_files", r"select id, coalesce(try_cast(nullif(regexp_extract(report, '\[([0-9]+)\]', 1), '') as bigint), id) as key, nullif(regexp_extract(report, '\(([^()]+)\)', 1), '') as path from applications")
def x36_report_files(spark: SparkSession, d: str) -> DataFrame:
    """The report number without leading zeros, else the row's own, and the file it names."""
    number = F.regexp_extract("report", r"\[([0-9]+)\]", 1).try_cast("bigint")
    return table(spark, d, "applications").select("id", F.coalesce(number, "id").alias("key"), F.nullif(F.regexp_extract("report", r"\(([^()]+)\)", 1), F.lit("")).alias("path"))


@query(
    "x38_context",
    "select 'company' as kind, company as value from (select distinct company from jobs where company is not null order by 1 limit 120) union all select 'role' as kind, title as value from (select distinct title from jobs where title is not null order by 1 limit 60)",
)
def x38_context(spark: SparkSession, d: str) -> DataFrame:
    """The feature is the bound: what is told to a search, 120 employers and 60 titles."""
    some = lambda c, kind, n: table(spark, d, "jobs").where(f"{c} is not null").select(F.col(c).alias("value")).distinct().orderBy("value").limit(n).select(F.lit(kind).alias("kind"), "value")
    return some("company", "company", 120).unionByName(some("title", "role", 60))


@query("x41_tones", f"select id, case when s is null then 'none' when s >= 4 then 'good' when s >= 3 then 'fair' else 'poor' end as tone from (select id, {SCORE_SQL.format('')} as s from applications)")
def x41_tones(spark: SparkSession, d: str) -> DataFrame:
    s = S.leading_number(F.col("score"))
    return table(spark, d, "applications").select("id", F.when(s.isNull(), "none").when(s >= 4, "good").when(s >= 3, "fair").otherwise("poor").alias("tone"))


@query("x43_nth_pending", "select job_id, source, row_number() over (partition by source order by job_id) as nth from jobs where queue_status = 'in_progress'")
def x43_nth_pending(spark: SparkSession, d: str) -> DataFrame:
    got = queue.nth_pending(table(spark, d, "jobs"), "source", "job_id", "queue_status", "in_progress")
    return got.select("job_id", "source", F.col("nth").cast("bigint").alias("nth"))


@query(
    "x44_new_entries",
    f"""with j as (select job_id, batch_no, source, {SQUEEZE_SQL.format('title')} as k from jobs where title is not null and source is not null)
        select source, k, min(job_id) as job_id from j where batch_no >= 20 and not exists (select 1 from j o where o.batch_no < 20 and o.source = j.source and o.k = j.k) group by 1, 2""",
)
def x44_new_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries that their section does not hold yet, each once."""
    j = table(spark, d, "jobs").where("title is not null and source is not null").select("job_id", "batch_no", "source", S.squeezed(F.col("title")).alias("k"))
    new = j.where("batch_no >= 20").groupBy("source", "k").agg(F.min("job_id").alias("job_id"))
    return new.join(j.where("batch_no < 20").select("source", "k").distinct(), ["source", "k"], "left_anti")


@query("x45_pool_counts", "select source, count(*) filter (where queue_status in ('new', 'llm_ready')) as pending, count(*) as total, min(first_seen_at) as since from jobs group by 1")
def x45_pool_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").groupBy("source").agg(F.count_if(F.col("queue_status").isin("new", "llm_ready")).alias("pending"), F.count("*").alias("total"), F.min("first_seen_at").alias("since"))


@query("x49_title_parts", r"select job_id, trim(regexp_extract(title, '^([^,(–]+)', 1)) as role, nullif(trim(regexp_extract(title, '\(([^()]*)\)\s*$', 1)), '') as aside from jobs where title is not null")
def x49_title_parts(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").where("title is not null")
    return j.select("job_id", F.trim(F.regexp_extract("title", "^([^,(–]+)", 1)).alias("role"), F.nullif(F.trim(F.regexp_extract("title", r"\(([^()]*)\)\s*$", 1)), F.lit("")).alias("aside"))
