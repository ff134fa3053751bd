"""Counters of discovery runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = (
    "queries_attempted", "pages_fetched", "pages_failed", "jobs_parsed", "jobs_inserted", "jobs_updated",
    "jobs_skipped_duplicates", "detail_enrichment_selected", "detail_fetch_attempts", "detail_pages_fetched",
    "detail_enrichment_successes", "detail_parse_failures",
)


def discovery_counters(queries: DataFrame, visits: DataFrame, parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """The twelve counters per query (AG1).

    ``visits`` from the page walk; ``parsed`` one row per posting before duplicate removal with ``selected``
    and ``detail_found``; ``stored`` one row per kept posting with its ``action``. Three aggregates that
    combine before the shuffle, joined on the query.
    """
    pages = visits.groupBy("query_id").agg(
        F.count_if("found").alias("pages_fetched"),
        F.count_if(~F.col("found")).alias("pages_failed"),
        F.bool_or(F.col("stop").isin("start_missing", "start_unreadable")).alias("failed"),
    )
    selected = F.count_if("selected")
    jobs = parsed.groupBy("query_id").agg(
        F.count("*").alias("jobs_parsed"),
        selected.alias("detail_enrichment_selected"),
        selected.alias("detail_fetch_attempts"),
        F.count_if("detail_found").alias("detail_pages_fetched"),
        F.count_if("detail_found").alias("detail_enrichment_successes"),
        F.count_if(F.col("selected") & ~F.col("detail_found")).alias("detail_parse_failures"),
    )
    kept = stored.groupBy("query_id").agg(
        F.count("*").alias("kept"),
        F.count_if(F.col("action") == "inserted").alias("jobs_inserted"),
        F.count_if(F.col("action") == "updated").alias("jobs_updated"),
    )
    counted = (
        queries.select("query_id", F.lit(1).cast("long").alias("queries_attempted"))
        .join(pages, "query_id", "left").join(jobs, "query_id", "left").join(kept, "query_id", "left")
        .withColumn("failed", F.coalesce("failed", F.lit(True))).fillna(0)
        .withColumn("jobs_skipped_duplicates", F.col("jobs_parsed") - F.col("kept"))
    )
    return counted.select("query_id", query_status().alias("status"), *COUNTERS)


def query_status(parsed: str = "jobs_parsed", failed: str = "failed") -> Column:
    """``error`` when the start page failed, ``warn`` when nothing was parsed, else ``ok`` (AG6)."""
    return F.when(F.col(failed), "error").when(F.col(parsed) == 0, "warn").otherwise("ok")


def with_totals(counters: DataFrame) -> DataFrame:
    """Counters per query and in total over the queries that did not fail (AG2).

    ``rollup`` gives detail rows and total in one pass; the total has a null query.
    """
    good = counters.where("status <> 'error'").drop("status")
    return good.rollup("query_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])
