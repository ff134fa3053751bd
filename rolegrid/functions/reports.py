"""Report texts as column expressions, one string per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.functions.text import as_col, iso_text, string_list

# Label of each constraint in the intent line, in print order.
INTENT_LABELS = (
    ("target_titles", "titles"),
    ("preferred_titles", "preferred_titles"),
    ("include_keywords", "include"),
    ("preferred_keywords", "prefer"),
    ("exclude_keywords", "exclude"),
    ("excluded_role_categories", "exclude_roles"),
    ("location_constraints", "locations"),
    ("preferred_locations", "preferred_locations"),
    ("include_companies", "companies"),
    ("exclude_companies", "exclude_companies"),
)
# Label of each constraint in the parser notes.
NOTE_LABELS = (
    ("target_titles", "must-have titles"),
    ("preferred_titles", "preferred titles"),
    ("include_keywords", "must-have keywords"),
    ("preferred_keywords", "preferred keywords"),
    ("excluded_role_categories", "excluded roles/categories"),
    ("location_constraints", "required locations"),
    ("preferred_locations", "preferred locations"),
    ("include_companies", "target companies"),
    ("exclude_companies", "excluded companies"),
)
# Label of each constraint in the intent summary.
SUMMARY_LABELS = (
    ("target_titles", "titles"),
    ("include_keywords", "must"),
    ("preferred_keywords", "prefer"),
    ("exclude_keywords", "exclude"),
    ("location_constraints", "locations"),
    ("include_companies", "companies"),
)


def _labelled(wanted: Column, labels: tuple[tuple[str, str], ...], sep: str) -> list[Column]:
    """One nullable text per constraint list; null for an empty list."""
    return [
        F.when(F.size(string_list(wanted[name])) > 0, F.concat(F.lit(label + sep), F.array_join(wanted[name], ", ")))
        for name, label in labels
    ]


def _remote(wanted: Column, label: str) -> Column:
    preference = wanted["remote_preference"]
    return F.when(preference != "unspecified", F.concat(F.lit(label), preference))


def _freshness(wanted: Column, before: str, after: str) -> Column:
    return F.concat(F.lit(before), wanted["freshness_window_days"].cast("string"), F.lit(after))


def intent_line(wanted: Column) -> Column:
    """Parsed constraints in one line (RP2)."""
    parts = [*_labelled(wanted, INTENT_LABELS, "="), _remote(wanted, "remote="), _freshness(wanted, "freshness=", "d")]
    text = F.concat_ws(" | ", *parts)
    return F.concat(F.lit("Intent: "), F.when(text == "", "no explicit constraints parsed").otherwise(text))


def summary_line() -> Column:
    """Counts of one prompt search (RP2)."""
    return F.format_string(
        "Summary: boards=%d discovered=%d matched=%d rejected=%d", "boards", "discovered", "matched", "rejected"
    )


def parser_notes(wanted: Column) -> Column:
    """What was understood, one note per constraint (IN17)."""
    notes = [
        *_labelled(wanted, NOTE_LABELS, ": "),
        _remote(wanted, "workplace preference: "),
        _freshness(wanted, "freshness window: ", " days"),
    ]
    return F.array_compact(F.array(*notes))


def intent_summary(wanted: Column, unresolved: Column) -> Column:
    """Short form of the constraints; null when there are none (IN19)."""
    parts = [
        *_labelled(wanted, SUMMARY_LABELS, "="),
        _remote(wanted, "remote="),
        _freshness(wanted, "freshness=", "d"),
        F.when(F.size(unresolved) > 0, F.concat(F.lit("unresolved="), F.size(unresolved).cast("string"))),
    ]
    text = F.concat_ws(" | ", *parts)
    return F.when(text != "", text)


def _reworded(explanation: Column) -> Column:
    plain = F.regexp_replace(F.trim(F.regexp_replace(explanation, r"^[+-]+", "")), r"^\d+ ", "")
    return F.replace(plain, F.lit(" matched include keyword "), F.lit(" matched preferred keyword "))


def rule_based_summary(explanations: Column, score: Column) -> Column:
    """Title, score, the two best and the first adverse signal (RP1)."""
    given = F.filter(F.transform(string_list(explanations), F.trim), lambda x: x != "")
    good = F.transform(F.filter(given, lambda x: x.startswith("+")), _reworded)
    bad = F.transform(F.filter(given, lambda x: x.startswith("-")), _reworded)
    role = F.concat(
        F.lit("Potential match: "), F.col("title"), F.lit(" at "), F.col("company"), F.lit(" in "), F.col("location"), F.lit(".")
    )
    points = F.coalesce(F.concat(F.lit("Score: "), score.cast("string"), F.lit(".")), F.lit("Score: n/a."))
    none = F.when(
        F.size(given) == 0,
        "No rule explanations were provided, so this summary uses the stored job fields only.",
    )
    positive = F.when(F.size(good) > 0, F.concat(F.lit("Positive signals: "), F.array_join(F.slice(good, 1, 2), "; "), F.lit(".")))
    concern = F.when(F.size(bad) > 0, F.concat(F.lit("Possible concerns: "), F.element_at(bad, 1), F.lit(".")))
    return F.concat_ws(" ", role, points, none, positive, concern)


def match_sentence(score: str = "score", explanations: str = "score_explanations",
                   summarizer: Callable[[Column, Column], Column] = rule_based_summary) -> Column:
    """Match summary; ``summarizer`` is any function of (explanations, score) to a column (RP1, UD2)."""
    return F.concat(F.lit("Match Summary: "), summarizer(F.col(explanations), F.col(score)))


# Counters in print order and their labels.
DISCOVERY_LABELS = (
    ("queries_attempted", "queries"),
    ("pages_fetched", "pages"),
    ("pages_failed", "failed_pages"),
    ("jobs_parsed", "jobs"),
    ("jobs_inserted", "inserted"),
    ("jobs_updated", "updated"),
    ("jobs_skipped_duplicates", "duplicates"),
    ("detail_enrichment_selected", "detail_selected"),
    ("detail_fetch_attempts", "detail_attempts"),
    ("detail_enrichment_successes", "detail_successes"),
    ("detail_parse_failures", "detail_failures"),
)


def discovery_line() -> Column:
    """Counters of a discovery run in one line (RP3)."""
    return F.concat_ws(
        " ", *[F.concat(F.lit(f"{label}="), F.col(name).cast("string")) for name, label in DISCOVERY_LABELS]
    )


def _number(value: Column) -> Column:
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(F.format_number(value, "0.0"))


def review_list_columns(postings: DataFrame) -> DataFrame:
    """Columns of the review list; the score is text with ``n/a`` for none (PR10)."""
    kind = dict(postings.dtypes)["score"]
    shown = _number(F.col("score")) if kind in ("double", "float") else F.col("score").cast("string")
    return postings.select(
        "id", "source_site", "title", "company", "location",
        F.coalesce(shown, F.lit("n/a")).alias("score"),
        F.col("job_status").alias("status"),
        F.coalesce("decision", F.lit("unreviewed")).alias("review"),
        "url",
    )


def history_lines(history: Column | str) -> Column:
    """Decision history entries as text lines, in the order given (RP7)."""
    return F.transform(
        as_col(history),
        lambda h: F.concat_ws(" | ", iso_text(h["decided_at"]), h["decision"], F.coalesce(h["note"], F.lit("n/a"))),
    )
