"""Session helpers: table loading, lineage cutting and partition sizing."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "jobs applications status_events tracker_lines golden_cases states mix_targets"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "ferrule") -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FERRULE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, which the session names in ``spark.checkpoint.dir``.

    Only on a single machine, as in tests, may it be unset: then a temporary folder is made,
    used and deleted at the end. A cluster without it is an error, since its executors
    would write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    made = getattr(spark, "_ferrule_shared", None)
    if made is None:
        if not re.fullmatch(r"local(?:\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="ferrule-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark._ferrule_shared = made  # type: ignore[attr-defined]
        spark.sparkContext.setCheckpointDir(made)
    return made


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/ferrule-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    A lost executor costs only its running tasks, since the written table is on
    storage that all executors share.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever storage it is on."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    """Spread few input files over all cores before costly per-row work.

    The number of partitions is the session's parallelism or its shuffle
    partitions, whichever is more, so that it grows with the cluster. A scan that
    has as many partitions already, as large tables do, is left as it is: whole
    texts are then not shuffled.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")), least)
    if keys:
        return df.repartition(n, *keys)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" not in plan and df.rdd.getNumPartitions() >= n:  # without an exchange nothing runs to tell the number
        return df
    return df.repartition(n)
