"""Identity keys of a posting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolegrid.functions.text import as_col, fold, free_text_key
from rolegrid.functions.urls import canonical_url


def source_identity(site: Column | str = "source_site", job_id: Column | str = "source_job_id") -> Column:
    """``site:id`` with the id folded; null without an id (FN8)."""
    job_id = as_col(job_id)
    return F.when(job_id != "", F.concat(as_col(site), F.lit(":"), fold(job_id)))


def dedupe_key() -> Column:
    """``source:site:id`` or, without an id, ``url:canonical`` (FN6)."""
    return F.coalesce(
        F.concat(F.lit("source:"), source_identity()),
        F.concat(F.lit("url:"), canonical_url("url", "source_site")),
    )


def fallback_key(title: Column | str = "title", company: Column | str = "company",
                 location: Column | str = "location") -> Column:
    """Folded title, company and location (FN7)."""
    return F.struct(
        free_text_key(title).alias("title"),
        free_text_key(company).alias("company"),
        free_text_key(location).alias("location"),
    )


def same_source_identity(left: str, right: str) -> Column:
    """Both sides of a joined pair carry the same source identity; aliases of the two sides (JN12)."""
    pair = [source_identity(f"{s}.source_site", f"{s}.source_job_id") for s in (left, right)]
    return F.coalesce(pair[0] == pair[1], F.lit(False))


def same_canonical_url(left: str, right: str) -> Column:
    pair = [canonical_url(f"{s}.url", f"{s}.source_site") for s in (left, right)]
    return pair[0] == pair[1]


def same_fallback_identity(left: str, right: str) -> Column:
    pair = [fallback_key(f"{s}.title", f"{s}.company", f"{s}.location") for s in (left, right)]
    return pair[0] == pair[1]


def posting_keys(canonical: bool = False) -> Column:
    """The duplicate keys of a posting as short digests, one name space per rule.

    ``canonical`` says that ``url`` already has its canonical form.

    A digest keeps the shuffled key at a fixed width whatever the length of the text behind it. Rows
    without a source id have no source key.
    """
    key = fallback_key()
    url = F.col("url") if canonical else canonical_url("url", "source_site")
    return F.array_compact(
        F.array(
            F.md5(F.concat(F.lit("s:"), source_identity())),
            F.md5(F.concat(F.lit("u:"), url)),
            F.md5(F.concat(F.lit("f:"), F.to_json(key))),
        )
    )
