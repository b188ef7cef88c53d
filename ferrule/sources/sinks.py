"""Text views and versioned tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.plans.session import drop_path


def safe_cell(c: Column) -> Column:
    """Text for a separated file: blanks for tabs and line ends, and a quote before what a spreadsheet would take for a formula."""
    flat = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\t\r\n]+", " ")
    return F.when(flat.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), flat)).otherwise(flat)


def markdown_cell(c: Column) -> Column:
    flat = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " ")
    return F.replace(flat, F.lit("|"), F.lit("\\|"))


def markdown_lines(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """pos, line: a pipe table of the rows in order. Reading it back gives the same cells."""
    row = F.concat(F.lit("| "), F.array_join(F.array(*(markdown_cell(F.col(c)) for c in columns)), " | "), F.lit(" |"))
    body = df.select(F.col(order).cast("bigint").alias("pos"), row.alias("line"))
    head = df.sparkSession.createDataFrame([(-2, "| " + " | ".join(columns) + " |"), (-1, "|" + "---|" * len(columns))], "pos bigint, line string")
    return head.unionByName(body)


def write_markdown(df: DataFrame, columns: list[str], order: str, path: str) -> None:
    """One text file, as a view for people: ordered by one task."""
    markdown_lines(df, columns, order).coalesce(1).sortWithinPartitions("pos").select("line").write.mode("overwrite").text(path)


def write_separated(df: DataFrame, columns: list[str], path: str, sep: str = "\t") -> None:
    """Appends rows as separated text, every cell made safe."""
    df.select(F.concat_ws(sep, *(safe_cell(F.col(c)) for c in columns)).alias("value")).write.mode("append").text(path)


class VersionedTable:
    """A table whose versions are folders; readers see a version whole or not at all.

    A new version is written beside the old ones and becomes current by one small
    file, which names it. There is one writer.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_current")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(folder)), default=0)

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.path}/v{v}") if v else None

    def replace(self, df: DataFrame, keep: int = 2) -> int:
        """Writes ``df`` as the next version and makes it current; versions older than ``keep`` are deleted."""
        v = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{v}")
        jvm = self.spark.sparkContext._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_current/{v}")
        mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(mark, True).close()
        if v > keep:
            drop_path(self.spark, f"{self.path}/v{v - keep}")
        return v


def append_to_section(text: str | None, section: str, lines: list[str]) -> str:
    """The document with the lines put at the end of its ``## section``, which is made at the end if it isn't there; None is an empty document."""
    body = (text or "").replace("\r\n", "\n")
    if not lines:
        return body
    added = "\n".join(lines)
    m = re.search(rf"(?m)^## {re.escape(section)}[ \t]*$", body)
    if not m:
        return f"{body.rstrip()}\n\n## {section}\n\n{added}\n".lstrip("\n")
    following = re.compile(r"(?m)^## ").search(body, m.end())
    end = following.start() if following else len(body)
    before, after = body[:end].rstrip(), body[end:]
    return f"{before}\n{added}\n" + (f"\n{after}" if after else "")


def append_counters(spark: SparkSession, path: str, at: str, counts: dict[str, int]) -> None:
    """Appends one run's counters: run_at, name, n."""
    spark.createDataFrame([(at, k, int(v)) for k, v in counts.items()], "run_at string, name string, n bigint").coalesce(1).write.mode("append").parquet(path)


def rendered(df: DataFrame, form: str, widths: dict[str, int] | None = None) -> DataFrame:
    """line: each row as ``json``, or with cells of fixed ``widths`` (longer ones cut, with a mark) as ``table``."""
    if form == "json":
        return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))
    cells = []
    for name, width in (widths or {c: 20 for c in df.columns}).items():
        c = F.coalesce(F.col(name).cast("string"), F.lit(""))
        cells.append(F.rpad(F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 1), F.lit("…"))).otherwise(c), width, " "))
    return df.select(F.rtrim(F.concat_ws("  ", *cells)).alias("line"))


class TableLock:
    """A lock beside a table: a file that only one writer can create. One older than ``stale_ms`` was left by a lost writer and is taken over."""

    def __init__(self, spark: SparkSession, path: str, stale_ms: int = 600_000):
        self.spark, self.stale_ms = spark, stale_ms
        jvm = spark.sparkContext._jvm
        self.file = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_lock")
        self.fs = self.file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def acquire(self) -> bool:
        if self.fs.exists(self.file) and self.spark.sparkContext._jvm.java.lang.System.currentTimeMillis() - self.fs.getFileStatus(self.file).getModificationTime() > self.stale_ms:
            self.fs.delete(self.file, False)
        return bool(self.fs.createNewFile(self.file))

    def release(self) -> None:
        self.fs.delete(self.file, False)
