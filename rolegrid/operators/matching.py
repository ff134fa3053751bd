"""Hard filters and the split of candidates into matched and rejected.

A candidate row is a posting together with one constraint row in the struct column ``want``. The four
searched text columns are lower-cased once, before the join that makes candidates, into ``title_l``,
``company_l``, ``location_l`` and ``description_l``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.functions.text import as_col, iso_text, string_list
from rolegrid.operators.scoring import constraint_criteria, score_events
from rolegrid.operators.skew import heavy_keys, key_counts, two_sided_join

SEARCHED = ("title", "company", "location", "description")

# What each preference demands and how it is spelled in a reason.
REQUIRED_STATUS = {
    "remote_only": ("remote", "remote-only"),
    "hybrid_only": ("hybrid", "hybrid-only"),
    "onsite_only": ("onsite", "onsite-only"),
}
REJECTS_UNKNOWN = ("remote_only", "hybrid_preferred", "hybrid_only", "onsite_only")


def with_search_text(postings: DataFrame) -> DataFrame:
    """Lower-case the searched columns once per posting."""
    return postings.withColumns(
        {
            "title_l": F.lower("title"),
            "company_l": F.lower("company"),
            "location_l": F.lower("location"),
            "description_l": F.lower("description_text"),
        }
    )


def want(name: str) -> Column:
    return F.col(f"want.{name}")


def _quoted(before: str, value: Column, after: str) -> Column:
    return F.concat(F.lit(before), value, F.lit(after))


def _reason(condition: Column, text: Column) -> Column:
    """One-element array when the condition holds, else an empty array."""
    return F.when(condition, F.array(text)).otherwise(F.array().cast("array<string>"))


def excluded_keyword_reasons() -> Column:
    """Substring match; the first matching field is named (HF1)."""

    def reason(keyword: Column) -> Column:
        low = F.lower(keyword)
        field = F.coalesce(*[F.when(F.col(f"{f}_l").contains(low), F.lit(f)) for f in SEARCHED])
        return F.concat(F.lit("Excluded keyword '"), keyword, F.lit("' matched "), field)

    return F.array_compact(F.transform(string_list(want("exclude_keywords")), reason))


def excluded_company_reasons() -> Column:
    """Equality ignoring case (HF2)."""
    hits = F.filter(string_list(want("exclude_companies")), lambda c: F.lower(c) == F.col("company_l"))
    return F.transform(
        hits,
        lambda c: F.concat(
            F.lit("Company '"), F.col("company"), F.lit("' matched excluded company hint '"), c, F.lit("'")
        ),
    )


def source_site_reasons() -> Column:
    """Posting comes from a site that was not asked for (HF3)."""
    sites = string_list(want("source_site_preferences"))
    text = F.concat(
        F.lit("Source site '"), F.col("source_site"), F.lit("' is outside allowed source sites ["),
        F.array_join(sites, ", "), F.lit("]"),
    )
    return _reason((F.size(sites) > 0) & ~F.array_contains(sites, F.col("source_site")), text)


def location_reasons() -> Column:
    """No required location is part of the posting's location (HF4)."""
    places = string_list(want("location_constraints"))
    unknown = F.col("location_l").startswith("unknown")
    found = F.exists(places, lambda p: F.col("location_l").contains(F.lower(p)))
    text = F.when(
        unknown, F.lit("Job location is unknown and cannot satisfy explicit location constraints")
    ).otherwise(
        F.concat(
            F.lit("Job location '"), F.col("location"),
            F.lit("' did not match any required location constraint ["), F.array_join(places, ", "), F.lit("]"),
        )
    )
    return _reason((F.size(places) > 0) & (unknown | ~found), text)


def remote_reasons() -> Column:
    """Workplace demanded by the remote preference (HF5)."""
    preference, status = want("remote_preference"), F.col("remote_status")
    unknown = F.when(
        (status == "unknown") & preference.isin(*REJECTS_UNKNOWN),
        _quoted("Job remote status is unknown and cannot satisfy explicit requirement '", preference, "'"),
    )
    wrong = [
        F.when(
            (status != "unknown") & (preference == name) & (status != needed),
            F.concat(
                F.lit("Job remote status '"), status,
                F.lit(f"' did not satisfy required {spelled} constraint"),
            ),
        )
        for name, (needed, spelled) in REQUIRED_STATUS.items()
    ]
    return F.array_compact(F.array(F.coalesce(unknown, *wrong)))


def freshness_reasons(now: Column) -> Column:
    """Posted before the freshness window; an unknown date passes (HF6)."""
    days = want("freshness_window_days")
    too_old = F.col("posted_at") < now - F.make_dt_interval(days)
    text = F.concat(
        F.lit("Job posted_at '"), iso_text("posted_at"), F.lit("' is older than allowed freshness window "),
        days.cast("string"), F.lit(" days"),
    )
    return _reason(F.coalesce(too_old, F.lit(False)), text)


def hard_filter(candidates: DataFrame, now: Column | None = None) -> DataFrame:
    """Add ``rejection_reasons`` in rule order and ``passed`` (HF7)."""
    reasons = F.concat(
        excluded_keyword_reasons(), excluded_company_reasons(), source_site_reasons(),
        location_reasons(), remote_reasons(), freshness_reasons(now if now is not None else F.current_timestamp()),
    )
    return candidates.withColumn("rejection_reasons", reasons).withColumn(
        "passed", F.size("rejection_reasons") == 0
    )


def candidates(postings: DataFrame, wants: DataFrame, on: str, spread: str) -> DataFrame:
    """Pair postings with the constraint rows that search their board (JN8).

    ``wants`` holds one row per prompt and board it searches, with the key column ``on``. Each pair is a
    row of the result, so the cost is the size of the result. Boards that hold a large share of the
    postings, or that a large share of the prompts search, are spread over many tasks. What a prompt scores is spelled here
    into ``criteria``, once for a row of ``wants`` and not for each pair.
    """
    ready = with_search_text(postings)
    heavy = [heavy_keys(key_counts(side.where(F.col(on).isNotNull()), on), on) for side in (postings, wants)]
    asked = wants.withColumn("criteria", constraint_criteria(F.col("want")))
    by_prompt = "prompt_id" if "prompt_id" in wants.columns else "want"
    return two_sided_join(ready, asked, on, *heavy, spread=(spread, by_prompt))


def evaluate(pairs: DataFrame, now: Column | None = None) -> DataFrame:
    """Filter, score and explain every candidate (JN8, HF7, SC3, SO6).

    Rejected rows carry no score. One table; ``passed`` tells the two parts from each other.
    """
    judged = hard_filter(pairs, now)
    if "criteria" not in judged.columns:
        judged = judged.withColumn("criteria", constraint_criteria(F.col("want")))
    events = F.when(F.col("passed"), score_events(F.col("criteria")))
    return (
        judged.withColumn("events", events)
        .withColumn("match_score", F.aggregate("events", F.lit(0), lambda a, e: a + e["points"]))
        .withColumn("explanations", F.transform("events", lambda e: e["text"]))
        .withColumn("score_reasons", top_reasons("explanations"))
        .drop("criteria", "events", "title_l", "company_l", "location_l", "description_l")
    )


def top_reasons(explanations: Column | str, limit: int = 3) -> Column:
    """First positive explanations in rule order (SO6)."""
    return F.slice(F.filter(as_col(explanations), lambda x: x.startswith("+")), 1, limit)


def matched(evaluated: DataFrame) -> DataFrame:
    """Passed rows (ST5)."""
    return evaluated.where("passed").withColumn(
        "hard_filter_explanation", F.lit("Passed explicit hard filters.")
    )


def rejected(evaluated: DataFrame) -> DataFrame:
    """Rejected rows with their reasons as one text (ST5, RP6)."""
    return evaluated.where("NOT passed").withColumn("explanation", F.array_join("rejection_reasons", "; "))


def best_per_prompt(found: DataFrame, k: int, prompt: str = "prompt_id", tie: str = "id") -> DataFrame:
    """The ``k`` best matches of every prompt (SO7).

    ``row_number() <= k`` lets Spark cut each map task down to ``k`` rows per prompt before the shuffle.
    """
    from pyspark.sql import Window

    ranked = Window.partitionBy(prompt).orderBy(F.desc("match_score"), F.asc(tie))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def search_summary(plan_rows: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Boards searched, postings discovered, matched and rejected per prompt (AG3)."""
    boards = plan_rows.groupBy("prompt_id").agg(F.count("*").alias("boards"))
    counts = evaluated.groupBy("prompt_id").agg(
        F.count("*").alias("discovered"),
        F.count_if("passed").alias("matched"),
        F.count_if(~F.col("passed")).alias("rejected"),
    )
    zero = {c: 0 for c in ("discovered", "matched", "rejected")}
    return boards.join(counts, "prompt_id", "left").fillna(zero)
