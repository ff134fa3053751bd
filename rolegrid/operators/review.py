"""Review work: filters, sorting, paging, decisions and their history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegrid.functions.text import fold, iso_text
from rolegrid.schemas import DECISIONS, JOB_STATUSES

EQUALITY = ("source_site", "company", "job_status", "remote_status", "employment_type", "seniority")
SORT_KEYS = ("discovered_at", "posted_at", "title", "company", "location", "source_site", "score")
FOLDED_KEYS = ("title", "company", "location", "source_site")
DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE = 25, 100
HISTORY_LENGTH = 20


# ---- decisions ---------------------------------------------------------------------------------------


def current_decisions(log: DataFrame) -> DataFrame:
    """The decision written last for every posting (WN2).

    ``max_by`` combines before the shuffle, so a posting with a huge log costs one row per map task.
    """
    last = F.max_by(F.struct("decision", "decided_at", "note"), "seq").alias("d")
    return log.groupBy("posting_url").agg(last).select("posting_url", "d.*")


def decision_history(log: DataFrame, k: int = HISTORY_LENGTH) -> DataFrame:
    """The newest ``k`` log entries of every posting (WN3).

    Spark turns ``row_number() <= k`` into a group limit that already cuts each map task to ``k`` rows
    per posting, so a hot posting never reaches one task as a whole.
    """
    newest = Window.partitionBy("posting_url").orderBy(F.desc("decided_at"), F.desc("seq"))
    return log.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k)


def attach_decisions(postings: DataFrame, current: DataFrame) -> DataFrame:
    """Left join of the current decision, its time and note (JN3)."""
    side = current.select(F.col("posting_url").alias("url"), "decision", "decided_at", "note")
    return postings.join(side, "url", "left")


def with_decision(postings: DataFrame, current: DataFrame, decision: str) -> DataFrame:
    """Postings whose current decision has the given value (JN1)."""
    wanted = current.where(F.col("decision") == decision).select(F.col("posting_url").alias("url"))
    return postings.join(wanted, "url", "left_semi")


def reviewed_only(postings: DataFrame, current: DataFrame, reviewed: bool | None) -> DataFrame:
    """Postings with a decision, without one, or all (JN2)."""
    if reviewed is None:
        return postings
    urls = current.select(F.col("posting_url").alias("url"))
    return postings.join(urls, "url", "left_semi" if reviewed else "left_anti")


def reviewed_filter(value: str) -> bool | None:
    """Name of a review filter to the argument of :func:`reviewed_only`."""
    return {"reviewed": True, "unreviewed": False}.get(value.strip().lower())


def drop_orphans(current: DataFrame, log: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions and history without a posting go (JN4).

    Returns both cleaned tables and one row with the removed counts and their summary text. Semi and anti
    joins, so null urls cannot empty the result.
    """
    urls = postings.select(F.col("url").alias("posting_url"))
    gone = [t.join(urls, "posting_url", "left_anti").agg(F.count("*").alias(name))
            for t, name in ((current, "removed_decisions"), (log, "removed_history"))]
    counts = (
        gone[0].withColumn("removed_history", F.lit(None).cast("long"))
        .unionByName(gone[1].withColumn("removed_decisions", F.lit(None).cast("long")))
        .agg(F.max("removed_decisions").alias("removed_decisions"), F.max("removed_history").alias("removed_history"))
    )
    text = F.format_string(
        "Removed %d orphaned review decisions and %d orphaned review history entries.", "removed_decisions", "removed_history"
    )
    return (
        current.join(urls, "posting_url", "left_semi"),
        log.join(urls, "posting_url", "left_semi"),
        counts.withColumn("summary", text),
    )


# ---- domain checks -----------------------------------------------------------------------------------


def domain_issue(value: Column | str, domain: tuple[str, ...], what: str, plural: str) -> Column:
    """Null for a supported value, else a reason that lists the supported ones (FL5)."""
    col = F.col(value) if isinstance(value, str) else value
    good = F.lower(F.trim(col)).isin(*domain)
    text = F.concat(
        F.lit(f"Invalid {what} '"), F.coalesce(col, F.lit("")), F.lit(f"'. Supported {plural}: {', '.join(domain)}")
    )
    return F.when(~F.coalesce(good, F.lit(False)), text)


def check_decisions(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a decision log into valid rows (normalized) and rows with a reason (FL5)."""
    judged = log.withColumn("reason", domain_issue("decision", DECISIONS, "review decision", "decisions"))
    good = judged.where("reason IS NULL").drop("reason").withColumn("decision", F.lower(F.trim("decision")))
    return good, judged.where("reason IS NOT NULL")


def check_statuses(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for status changes ``(url, job_status)`` (FL5)."""
    judged = changes.withColumn("reason", domain_issue("job_status", JOB_STATUSES, "job status", "statuses"))
    good = judged.where("reason IS NULL").drop("reason").withColumn("job_status", F.lower(F.trim("job_status")))
    return good, judged.where("reason IS NOT NULL")


# ---- filters, lookups, sorting, paging -----------------------------------------------------------------


def filter_postings(postings: DataFrame, *, location_contains: str | None = None, min_score: float | None = None,
                    **equal: str | None) -> DataFrame:
    """Equality on the six listed columns, location pattern, minimum score (FL1, FL2, FL3).

    ``%`` and ``_`` in the location are wildcards, a backslash is itself. A row without a score fails every minimum.
    """
    unknown = set(equal) - set(EQUALITY)
    if unknown:
        raise ValueError(f"cannot filter on {sorted(unknown)}")
    tests = [F.col(name) == value for name, value in equal.items() if value is not None]
    if location_contains is not None:
        escaped = location_contains.replace("\\", "\\\\")
        tests.append(F.col("location").ilike(f"%{escaped}%"))
    if min_score is not None:
        tests.append(F.col("score") >= min_score)
    return postings.where(reduce(lambda a, b: a & b, tests)) if tests else postings


def json_score(extra: Column | str, key: str = "score") -> Column:
    """Number stored under ``key`` in a JSON text; booleans, texts and null give null (FL3)."""
    raw = F.try_variant_get(F.try_parse_json(extra), f"$.{key}", "variant")
    numeric = F.schema_of_variant(raw).rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    return F.when(numeric, F.try_variant_get(raw, "$", "double"))


def find_posting(postings: DataFrame, *, id: int | None = None, url: str | None = None) -> DataFrame:
    """Point lookup by exactly one of id and url (FL4)."""
    if (id is None) == (url is None):
        raise ValueError("give either id or url")
    return postings.where(F.col("id") == id if url is None else F.col("url") == url)


def find_by_source(postings: DataFrame, site: str, job_id: str) -> DataFrame:
    """Point lookup by source identity, case-sensitive (FL4)."""
    return postings.where((F.col("source_site") == site) & (F.col("source_job_id") == job_id))


def sort_order(sort_by: str = "discovered_at", descending: bool = True, tie: str = "id") -> list[Column]:
    """Sort columns; ties follow the id in the same direction, null is the smallest value (SO1)."""
    name = sort_by.strip().lower()
    name = name if name in SORT_KEYS else "discovered_at"
    key = fold(name) if name in FOLDED_KEYS else F.col(name)
    if descending:
        return [key.desc_nulls_last(), F.desc(tie)]
    return [key.asc_nulls_first(), F.asc(tie)]


def slice_rows(ordered: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """Offset, then limit; negative numbers count as zero (SO2)."""
    moved = ordered.offset(max(offset, 0))
    return moved if limit is None else moved.limit(max(limit, 0))


def select_postings(postings: DataFrame, current: DataFrame | None = None, *, reviewed: bool | None = None,
                    decision: str | None = None, **filters) -> DataFrame:
    """All column filters and both review filters, in no order."""
    rows = filter_postings(postings, **filters)
    if decision is not None:
        rows = with_decision(rows, current, decision)
    return reviewed_only(rows, current, reviewed)


def list_postings(postings: DataFrame, current: DataFrame | None = None, *, limit: int | None = None, offset: int = 0,
                  sort_by: str = "discovered_at", sort_desc: bool = True, **filters) -> DataFrame:
    """Review listing: every predicate before the sort, the sort before the slice (LC3)."""
    rows = select_postings(postings, current, **filters)
    return slice_rows(rows.orderBy(*sort_order(sort_by, sort_desc)), limit, offset)


def page_count(rows: DataFrame, per_page: int) -> DataFrame:
    """One row: total rows and pages, at least one page (AG4)."""
    pages = F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(per_page))).cast("int")
    return rows.agg(F.count("*").alias("total_rows"), pages.alias("total_pages"))


def page_of(rows: DataFrame, page: int, per_page: int = DEFAULT_PAGE_SIZE, sort_by: str = "discovered_at",
            sort_desc: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """Page ``page`` of ``rows`` with page numbers clamped to what exists (SO3).

    Sizes outside 1..100 become 25 and 100. The total is one aggregate; the page itself is a top-k.
    """
    size = DEFAULT_PAGE_SIZE if per_page < 1 else min(per_page, MAX_PAGE_SIZE)
    total = page_count(rows, size).first()
    number = min(max(page, 1), total["total_pages"])
    shown = slice_rows(rows.orderBy(*sort_order(sort_by, sort_desc)), size, (number - 1) * size)
    return shown, {"page": number, "per_page": size, **total.asDict()}


def newest(postings: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidates of the maintenance jobs: all rows, or the newest ``limit`` if the caller says so (SO4).

    The top-k runs on time and id alone; the rows are fetched by id afterwards.
    """
    if limit is None:
        return postings
    chosen = postings.select("id", "discovered_at").orderBy(*sort_order()).limit(limit).select("id")
    return postings.join(chosen, "id", "left_semi")


def posting_details(postings: DataFrame, current: DataFrame, log: DataFrame, k: int = HISTORY_LENGTH) -> DataFrame:
    """Postings with decision and the newest history entries as an ordered array (RP7)."""
    recent = decision_history(log, k)
    entries = F.array_sort(F.collect_list(F.struct("rank", "decided_at", "decision", "note"))).alias("history")
    history = recent.groupBy(F.col("posting_url").alias("url")).agg(entries)
    return (
        attach_decisions(postings, current)
        .join(history, "url", "left")
        .withColumn("reviewed", F.when(F.col("decision").isNotNull(), "yes").otherwise("no"))
        .withColumn("decision_time", iso_text("decided_at"))
        .drop("decided_at")
    )
