"""Row checks: invalid rows become rows with reasons, nothing is raised inside a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.functions.text import as_col, company_key, list_has_blank, site_slug, is_site_slug, squash_ws, clean_list
from rolegrid.functions.urls import http_url
from rolegrid.operators.skew import heavy_keys, salted_join
from rolegrid.schemas import BOARD_SITES, EMPLOYMENT_TYPES, JOB_STATUSES, REMOTE_STATUSES, SENIORITY_LEVELS
from rolegrid.session import stage

REQUIRED_TEXT = ("source_site", "title", "company", "location", "description_text")
DOMAINS = {
    "remote_status": REMOTE_STATUSES,
    "employment_type": EMPLOYMENT_TYPES,
    "seniority": SENIORITY_LEVELS,
    "job_status": JOB_STATUSES,
}


def _issue(condition: Column, text: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(text))


def _blank(value: Column | str) -> Column:
    return as_col(value).isNull() | (squash_ws(value) == "")


def split_valid(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without reasons and rows with reasons."""
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def judge_postings(postings: DataFrame) -> DataFrame:
    """Normalize posting fields and add the ``reasons`` a row is invalid for (PR1, PR3, PR4)."""
    checks = [_issue(_blank(name), f"{name}: value must not be empty") for name in REQUIRED_TEXT]
    checks.append(_issue(squash_ws("source_job_id") == "", "source_job_id: value must not be empty"))
    checks.append(
        _issue(~_blank("source_site") & ~is_site_slug("source_site"),
               "source_site: must contain letters, numbers, spaces, hyphens, or underscores")
    )
    checks.append(_issue(F.col("_url").isNull(), "url: not a web address"))
    checks += [
        _issue(~F.coalesce(F.col(name).isin(*domain), F.lit(False)), f"{name}: unsupported value")
        for name, domain in DOMAINS.items()
    ]
    checks.append(_issue(F.col("posted_at") > F.col("discovered_at"), "posted_at cannot be later than discovered_at"))
    checks.append(_issue(F.col("last_seen_at") < F.col("discovered_at"), "last_seen_at cannot be earlier than discovered_at"))
    judged = postings.withColumn("_url", http_url("url")).withColumn("reasons", F.array_compact(F.array(*checks)))
    normal = {name: squash_ws(name) for name in (*REQUIRED_TEXT, "source_job_id")}
    normal["source_site"] = site_slug("source_site")
    normal["url"] = F.coalesce("_url", "url")
    return judged.withColumns(normal).drop("_url")


def validate_postings(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid postings and quarantined ones with reasons (PR4)."""
    return split_valid(judge_postings(postings))


def inconsistent_results(results: DataFrame) -> DataFrame:
    """Filter results whose verdict and reasons disagree; expected to be empty (PR12)."""
    return results.where(F.col("passed") != (F.size("rejection_reasons") == 0))


def failures_without_message(results: DataFrame) -> DataFrame:
    """Failed runs without an error text; expected to be empty (PR12)."""
    return results.where(~F.col("success") & F.coalesce(F.col("error"), F.lit("")).eqNullSafe(""))


def no_list_reasons(names: str) -> Column:
    """Reasons for the fields named in the column ``names``, in which something else stands for a list (PR2)."""
    return F.transform(names, lambda n: F.concat(n, F.lit(": value must be a list")))


def judge_registry(entries: DataFrame) -> DataFrame:
    """Normalize registry entries and add ``reasons`` (PR2, PR3, PR7). A column ``not_lists`` may name fields of a wrong kind."""
    site = site_slug("source_site")
    supported = ", ".join(sorted(BOARD_SITES))
    checks = [
        _issue(_blank("company_name"), "company_name: value must not be empty"),
        _issue(_blank("source_site"), "source_site: value must not be empty"),
        _issue(~_blank("source_site") & ~site.isin(*BOARD_SITES), f"source_site: source_site must be one of: {supported}"),
        _issue(http_url("board_url").isNull(), "board_url: not a web address"),
        _issue(list_has_blank("tags"), "tags: value must not be empty"),
        _issue(list_has_blank("location_hints"), "location_hints: value must not be empty"),
    ]
    reasons = F.array_compact(F.array(*checks))
    if "not_lists" in entries.columns:
        reasons = F.concat(reasons, no_list_reasons("not_lists"))
    return entries.withColumn("reasons", reasons).drop("not_lists").withColumns(
        {
            "company_name": squash_ws("company_name"),
            "source_site": site,
            "board_url": F.coalesce(http_url("board_url"), F.col("board_url")),
            "tags": clean_list("tags"),
            "location_hints": clean_list("location_hints"),
        }
    )


def registry_duplicates(entries: DataFrame, index: str = "idx") -> DataFrame:
    """Entries that repeat the company/site or url/site of an earlier entry, with its first owner (WN4).

    The owner comes from a ``min_by`` that combines before the shuffle; a company with very many entries
    is spread over tasks when the owners are joined back.
    """
    rules = F.array(
        F.struct(F.lit(1).alias("rule"), F.concat_ws("|", F.lit("c"), company_key("company_name"), "source_site").alias("key")),
        F.struct(F.lit(2).alias("rule"), F.concat_ws("|", F.lit("u"), "source_site", "board_url").alias("key")),
    )
    keyed = entries.select(F.col(index).alias("idx"), "company_name", "source_site", "board_url", F.explode(rules).alias("r"))
    keyed = stage(keyed.select("*", "r.*").drop("r"), "registry-keys")
    first = F.min_by(F.struct("idx", "company_name", "board_url"), "idx").alias("owner")
    owners = stage(keyed.groupBy("key").agg(first, F.count("*").alias("n")).where("n > 1"), "owners")
    found = salted_join(keyed, owners.select("key", "owner"), "key", "inner", heavy_keys(owners, "key"), spread="idx")
    text = F.when(
        F.col("rule") == 1,
        F.concat(F.lit("duplicate company/source entry: "), "company_name", F.lit(" on "), "source_site",
                 F.lit(" already maps to "), "owner.board_url"),
    ).otherwise(
        F.concat(F.lit("duplicate board_url/source entry: "), "board_url", F.lit(" on "), "source_site",
                 F.lit(" already exists for "), "owner.company_name")
    )
    return found.where(F.col("idx") > F.col("owner.idx")).select(F.col("idx").alias(index), "rule", text.alias("issue"))


def validate_registry(entries: DataFrame, index: str = "idx") -> tuple[DataFrame, DataFrame]:
    """Valid entries and ``issues(idx, rule, issue)``; order by ``rule = 0`` first, then idx, rule (PR7)."""
    judged = judge_registry(entries)
    good, bad = split_valid(judged)
    invalid = bad.select(
        index, F.lit(0).alias("rule"),
        F.concat(F.lit("entry["), F.col(index).cast("string"), F.lit("] invalid: "), F.array_join("reasons", "; ")).alias("issue"),
    )
    return good, invalid.unionByName(registry_duplicates(good, index))


def ordered_issues(issues: DataFrame, index: str = "idx") -> DataFrame:
    """Invalid entries first, then duplicates in entry order."""
    return issues.orderBy((F.col("rule") > 0).cast("int"), index, "rule")
