"""Tables kept as text: pipe tables, ragged ledgers, bullet lists under headings, fenced summaries.

Such a file is one document edited by hand, so each is read whole and cut into
numbered lines where it lies; many files are read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Headings by which columns are known.
ALIASES = {
    "#": "num",
    "no": "num",
    "empresa": "company",
    "firma": "company",
    "puesto": "role",
    "position": "role",
    "title": "role",
    "nota": "score",
    "estado": "status",
    "state": "status",
    "fecha": "date",
    "notas": "notes",
}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), line: of text files with any line ends."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("v"))
    return whole.select("file", F.posexplode(F.split("v", "\n")).alias("i", "line")).select("file", (F.col("i") + 1).alias("line_no"), "line")


def pipe_cells(line: Column) -> Column:
    """Trimmed cells of ``| a | b |``; ``\\|`` is a bar within a cell."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(bare, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def pipe_tables(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, row (map from heading to cell): the first contiguous table of each file.

    Headings are lower-cased and put through ``ALIASES``; of a heading given twice
    the last column counts. Rows with more cells than headings keep the surplus in
    the last column, rows with fewer get empty cells. Rule lines are skipped.
    """
    lines = numbered_lines(spark, path).withColumn("bar", F.trim("line").startswith("|"))
    w = Window.partitionBy("file").orderBy("line_no")
    first = F.min(F.when(F.col("bar"), F.col("line_no"))).over(Window.partitionBy("file"))
    end = F.min(F.when(~F.col("bar") & (F.col("line_no") > F.col("first")), F.col("line_no"))).over(Window.partitionBy("file"))
    table = lines.withColumn("first", first).withColumn("end", end).where("bar and (end is null or line_no < end)")
    cells = table.withColumn("cells", pipe_cells(F.col("line"))).withColumn("head", F.first("cells").over(w))
    body = cells.where("line_no > first").where(~F.forall("cells", lambda c: c.rlike("^:?-*:?$")) | F.forall("cells", lambda c: c == ""))
    known = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    heads = F.transform("head", lambda h: F.coalesce(known[F.lower(h)], F.lower(h)))
    n = F.size("head")
    kept = F.when(F.size("cells") > n, F.concat(F.slice("cells", 1, n - 1), F.array(F.array_join(F.slice("cells", n, F.size("cells")), " | ")))).otherwise(
        F.concat(F.col("cells"), F.array_repeat(F.lit(""), F.greatest(n - F.size("cells"), F.lit(0))))
    )
    pairs = F.arrays_zip(heads.alias("h"), kept.alias("c"))
    # The last of equal headings wins: entries are added one by one.
    row = F.aggregate(
        pairs,
        F.create_map().cast("map<string,string>"),
        lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["h"]), F.create_map(p["h"], p["c"])),
    )
    return body.select("file", "line_no", row.alias("row"))


def tracker_rows(spark: SparkSession, path: str) -> DataFrame:
    """The nine tracker columns (and location, via) of pipe tables that have the required ones, with ``pos`` in source order and a quality flag per repair.

    A score found in the status column is put right; an unreadable number is null.
    """
    r = pipe_tables(spark, path)
    need = ("num", "company", "role", "score", "status")
    has = r.where(F.forall(F.array(*map(F.lit, need)), lambda k: F.map_contains_key("row", k)))
    col = lambda k: F.coalesce(F.col("row")[k], F.lit(""))
    scorelike = lambda c: c.rlike(r"^\d+(?:\.\d+)?/5$")
    swapped = scorelike(col("status")) & ~scorelike(col("score"))
    return has.select(
        "file",
        F.col("line_no").alias("pos"),
        col("num").try_cast("int").alias("num"),
        *(col(k).alias(k) for k in ("date", "company", "role")),
        F.when(swapped, col("status")).otherwise(col("score")).alias("score"),
        F.when(swapped, col("score")).otherwise(col("status")).alias("status"),
        *(col(k).alias(k) for k in ("pdf", "report", "notes", "location", "via")),
        swapped.alias("swapped"),
        col("num").try_cast("int").isNull().alias("bad_num"),
    )


def ragged_rows(spark: SparkSession, path: str, columns: list[str], least: int, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a separated text with as many columns as each line has: missing ones are null, surplus ones ignored.

    Lines with fewer than ``least`` cells are rejected with the reason; a line
    that repeats the column names, empty ones and comments (#) are skipped.
    """
    lines = numbered_lines(spark, path).where("trim(line) <> '' and not startswith(line, '#')").withColumn("c", F.split("line", sep))
    lines = lines.where(F.lower(F.col("c")[0]) != columns[0].lower())
    good = lines.where(F.size("c") >= least).select("file", "line_no", *(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(columns)))
    bad = lines.where(F.size("c") < least).select("file", "line_no", "line", F.concat(F.size("c").cast("string"), F.lit(f" cells, {least} needed")).alias("reason"))
    return good, bad


def bullets(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, section, subsection, done, parts: ``- [ ] a | b | c`` lines under their ``##`` and ``###`` headings."""
    lines = numbered_lines(spark, path)
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    h2, h3 = F.regexp_extract("line", r"^##\s+(.*?)\s*$", 1), F.regexp_extract("line", r"^###\s+(.*?)\s*$", 1)
    top = F.when(F.col("line").rlike(r"^##\s"), h2)
    sub = F.when(F.col("line").rlike(r"^###\s"), h3).when(F.col("line").rlike(r"^##\s"), F.lit(""))
    carried = lines.withColumn("section", F.last(top, True).over(w)).withColumn("subsection", F.nullif(F.last(sub, True).over(w), F.lit("")))
    hit = carried.where(F.col("line").rlike(r"^\s*- \[[ xX]\] "))
    parts = F.transform(F.split(F.regexp_replace("line", r"^\s*- \[[ xX]\] ", ""), r"\s\|\s"), lambda p: F.trim(p))
    return hit.select("file", "line_no", "section", "subsection", F.col("line").rlike(r"^\s*- \[[xX]\]").alias("done"), parts.alias("parts"))


def fenced_summary(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """file and one text column per key: ``key: value`` lines of the first yaml fence of each file; lists come as one text. Other keys are ignored."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_extract("value", r"(?s)```ya?ml\s*\n(.*?)\n```", 1).alias("y"))
    value = lambda k: F.trim(F.regexp_replace(F.regexp_extract("y", rf"(?m)^{k}:[ \t]*(.*?(?:\n[ \t]+-.*|\n-[ \t].*)*)$", 1), r"^[\"']|[\"']$", ""))
    return whole.where("y <> ''").select("file", *(F.nullif(value(k), F.lit("")).alias(k) for k in keys))


def utf16_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A UTF-16 table with headings and the name of its file, as registries export them."""
    df = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-16LE").option("lineSep", "\n").csv(path)
    return df.withColumn("file", F.input_file_name())
