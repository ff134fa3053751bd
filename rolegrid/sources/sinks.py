"""Outputs: CSV exports, registry file, decision log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.operators.review import attach_decisions
from rolegrid.schemas import DECISION_LOG

EXPORT_COLUMNS = (
    "source_site", "source_job_id", "title", "company", "location", "url", "remote_status", "employment_type",
    "seniority", "score", "reviewed", "decision",
)


def export_rows(postings: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """The twelve exported columns as text; null becomes the empty text (SK1)."""
    rows = attach_decisions(postings, current) if current is not None else postings.withColumn("decision", F.lit(None).cast("string"))
    rows = rows.withColumn("reviewed", F.when(F.col("decision").isNotNull(), "true").otherwise("false"))
    whole = F.when(F.col("score") == F.floor("score"), F.col("score").cast("bigint").cast("string")).otherwise(F.col("score").cast("string"))
    shown = {c: whole if c == "score" else F.col(c).cast("string") for c in EXPORT_COLUMNS}
    return rows.select(*[F.coalesce(v, F.lit("")).alias(c) for c, v in shown.items()])


def export_postings_csv(postings: DataFrame, current: DataFrame | None, path: str) -> None:
    """Write the export with a header line per file; quotes inside a field are doubled (SK1)."""
    export_rows(postings, current).write.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def export_matches_csv(found: DataFrame, path: str) -> None:
    """Matched postings in the same layout, without decisions (SK2)."""
    export_postings_csv(found, None, path)


def registry_json(registry: DataFrame) -> DataFrame:
    """The sorted registry as one text, a JSON list with one entry a line (SK3).

    The registry is a hand-kept configuration, so one row and one file hold it.
    """
    entry = F.to_json(F.struct("company_name", "source_site", "board_url", "tags", "location_hints"))
    order = F.struct(F.lower("company_name").alias("c"), "source_site", "board_url", entry.alias("entry"))
    lines = F.transform(F.array_sort(F.collect_list(order)), lambda x: x["entry"])
    return registry.agg(F.concat(F.lit("[\n"), F.array_join(lines, ",\n"), F.lit("\n]")).alias("value"))


def write_registry(registry: DataFrame, path: str) -> None:
    """Write the registry as a JSON list in one file, which ``read_registry`` reads back (SK3)."""
    registry_json(registry).coalesce(1).write.text(path)


def append_decisions(new: DataFrame, path: str) -> None:
    """Append to the decision log; the current state is derived from it (SK6)."""
    rows = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DECISION_LOG])
    rows.write.mode("append").parquet(path)
