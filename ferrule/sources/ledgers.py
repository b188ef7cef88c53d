"""Ledgers kept by hand, each with rules of its own: what a line must hold, and which of several lines for one thing counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.scalars import squeezed, strict_date
from ferrule.sources.text_tables import numbered_lines, pipe_tables

# Sources whose dates are when things happened.
DATED_SOURCES = ("set-status", "merge", "dashboard", "correction", "backfill")


def filled_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with text that aren't comments, cut at tabs."""
    return numbered_lines(spark, path).where("trim(line) <> '' and not startswith(ltrim(line), '#')").withColumn("c", F.transform(F.split("line", "\t"), lambda c: F.trim(c)))


def at(i: int) -> Column:
    return F.coalesce(F.get("c", F.lit(i)), F.lit(""))


def status_log(spark: SparkSession, path: str, states: DataFrame, sources: tuple[str, ...] = DATED_SOURCES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations, rejects, unknown sources) of a log of status changes: num, date, from, to, source, note.

    A line is rejected with the first reason that holds: too few cells, a number that is none, a date
    that does not exist, a state (column ``label`` of ``states``) that is none; ``-`` as the state before is
    unknown, as the state after a retraction. Lines of other sources stay, but their dates don't count for
    durations (``day_math``), and are listed too.
    """
    known = states.select(F.col("label").alias("to"), F.lit(True).alias("_known")).where("label is not null").distinct()
    lines = filled_lines(spark, path).select(
        "file", "line_no", "line", F.size("c").alias("n"), at(0).try_cast("int").alias("num"), strict_date(at(1)).alias("date"), F.nullif(at(2), F.lit("-")).alias("from"), at(3).alias("to"), at(4).alias("source"), at(5).alias("note")
    )
    checked = lines.join(known, "to", "left")
    reason = (
        F.when(F.col("n") < 5, F.concat(F.col("n").cast("string"), F.lit(" cells, 5 needed")))
        .when(F.col("num").isNull(), "bad number")
        .when(F.col("date").isNull(), "bad date")
        .when(F.col("_known").isNull() & (F.col("to") != "-"), F.concat(F.lit("unknown state "), F.col("to")))
    )
    checked = checked.withColumn("reason", reason).withColumn("day_math", F.col("source").isin(*sources))
    good = checked.where("reason is null").select("file", "line_no", "num", "date", "from", "to", "source", "note", "day_math")
    return good, checked.where("reason is not null").select("file", "line_no", "line", "reason"), good.where("not day_math").select("file", "line_no", "num", "source")


def typed_log(spark: SparkSession, path: str, columns: dict[str, str], needed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed) of a separated log whose cells have types (``int``, ``double``, ``percent``, ``date``, ``string``).

    A line is malformed where a needed cell is empty or a filled one can't be read as its type; cells
    beyond the columns are left out, missing ones are null.
    """
    readers = {
        "int": lambda c: c.try_cast("int"),
        "double": lambda c: F.regexp_replace(c, "[, ]", "").try_cast("double"),
        "percent": lambda c: F.regexp_extract(c, r"^([0-9]+(?:\.[0-9]+)?)\s*%?$", 1).try_cast("double"),
        "date": strict_date,
        "string": lambda c: c,
    }
    lines = filled_lines(spark, path)
    first = next(iter(columns))
    lines = lines.where(F.lower(at(0)) != first.lower())
    raw = {n: at(i) for i, n in enumerate(columns)}
    out = lines.select("file", "line_no", "line", *(F.when(raw[n] != "", readers[t](raw[n])).alias(n) for n, t in columns.items()), *((raw[n] != "").alias(f"_{n}") for n in columns))
    wrong = F.array_compact(F.array(*(F.when(F.col(f"`{n}`").isNull() & (F.col(f"_{n}") | F.lit(n in needed)), F.lit(n)) for n in columns)))
    out = out.withColumn("wrong", wrong)
    return out.where("size(wrong) = 0").select("file", "line_no", *columns), out.where("size(wrong) > 0").select("file", "line_no", "line", F.concat(F.lit("bad "), F.array_join("wrong", ", ")).alias("reason"))


def last_pins(spark: SparkSession, path: str) -> DataFrame:
    """num, pinned: the last pin of each number among lines like ``- #12 next: 2026-03-04``; dates that don't exist are left out."""
    lines = numbered_lines(spark, path)
    got = lines.select(
        "file", "line_no", F.regexp_extract("line", r"#(\d+)\b", 1).try_cast("int").alias("num"), strict_date(F.regexp_extract("line", r"(?i)\bnext:?\s*(\d{4}-\d{2}-\d{2})", 1)).alias("pinned")
    )
    return got.where("num is not null and pinned is not null").groupBy("num").agg(F.max_by("pinned", F.struct("file", "line_no")).alias("pinned"))


def last_per_number(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One row per number (the first column): its last line."""
    lines = filled_lines(spark, path).select(F.struct("file", "line_no").alias("_at"), at(0).try_cast("int").alias(columns[0]), *(at(i).alias(n) for i, n in enumerate(columns) if i))
    return lines.where(F.col(columns[0]).isNotNull()).groupBy(columns[0]).agg(*(F.max_by(n, "_at").alias(n) for n in columns[1:]))


def links_in_notes(df: DataFrame, notes: str, into: str = "link") -> DataFrame:
    """The link that stands after the last bar of the notes; null where none does."""
    tail = F.trim(F.substring_index(F.col(notes), "| ", -1))
    return df.withColumn(into, F.when(F.col(notes).contains("| ") & tail.rlike(r"^https?://\S+$"), tail))


def blacklist(spark: SparkSession, path: str) -> DataFrame:
    """company_key, company, reason: of a pipe table with a company column, the first row of each employer as it is compared."""
    r = pipe_tables(spark, path).select("file", "line_no", F.col("row")["company"].alias("company"), F.coalesce(F.col("row")["reason"], F.lit("")).alias("reason"))
    keyed = r.withColumn("company_key", squeezed(F.col("company"))).where("company_key <> ''")
    return keyed.groupBy("company_key").agg(F.min(F.struct("file", "line_no", "company", "reason")).alias("m")).select("company_key", "m.company", "m.reason")


def stories(spark: SparkSession, path: str, fields: tuple[str, ...] = ("Source", "Situation", "Task", "Action", "Result", "Reflection"), tagged: str = "Best for questions about") -> DataFrame:
    """file, nth, theme, title, one column per field and tags: blocks under ``### [Theme] Title``, with lines like ``**Task:** text``; a field that isn't there is empty."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("v"))
    blocks = whole.select("file", F.posexplode(F.split("v", r"(?m)^### ")).alias("nth", "block")).where("nth > 0")
    head = F.trim(F.regexp_extract("block", r"^([^\n]*)", 1))
    value = lambda label: F.trim(F.regexp_extract("block", rf"\*\*{label}:\*\*[ \t]*([^\n]*)", 1))
    theme = F.trim(F.regexp_extract(head, r"^\[([^\]]+)\]\s*.+", 1))
    tags = F.filter(F.transform(F.split(F.lower(value(tagged)), "[,;]"), lambda t: F.trim(t)), lambda t: t != "")
    return blocks.select("file", "nth", theme.alias("theme"), F.when(theme != "", F.regexp_replace(head, r"^\[[^\]]+\]\s*", "")).otherwise(head).alias("title"), *(value(f).alias(f.lower()) for f in fields), tags.alias("tags"))
