"""Queries of the training-data operators, by name, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferrule.llm import batch_linkage, canonical, language, leakage, mixture, mojibake, name_variants, near_dup
from ferrule.plans.session import table

RUNS = 8  # runs in which p3 takes the 24 batches: the plans of 24 runs need all but 40 MB of the 1.5 GB that a small driver has
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return batch_linkage.link_batches(table(spark, d, "jobs"), runs=RUNS).select("first_job_id", "job_id").distinct()


@query("p3_links")
def p3_links(spark: SparkSession, d: str) -> DataFrame:
    return batch_linkage.link_batches(table(spark, d, "jobs"), runs=RUNS)


@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    got = canonical.status_states(*(table(spark, d, t) for t in ("applications", "status_events", "states")))
    return got.select("tab", "row_id", "state").distinct()


@query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "golden_cases")).select("doc_id", "case_no").distinct()


@query("p8_passages")
def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "golden_cases"))


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.relabelled(table(spark, d, "documents")).select("doc_id", "lang").distinct()


@query("p10_segments")
def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return language.segments(documents, language.fit(documents, "text", "lang"))


@query("p9_mixture")
def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.damaged_cells(table(spark, d, "applications"), "id", ["notes", "company", "role"]).select("id", "field").distinct()


@query("p4_restored")
def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.damaged_cells(table(spark, d, "applications"), "id", ["notes", "company", "role"])


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.ad_pairs(table(spark, d, "jobs"), table(spark, d, "golden_cases")).distinct()


@query("p5_classes")
def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.ad_classes(table(spark, d, "jobs"), table(spark, d, "golden_cases"))


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.company_pairs(table(spark, d, "applications"), table(spark, d, "jobs")).distinct()


@query("p1_clusters")
def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.name_clusters(name_variants.company_names(table(spark, d, "applications"), table(spark, d, "jobs")))
