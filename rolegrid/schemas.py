"""Row types and value domains."""

from __future__ import annotations

from pyspark.sql import types as T

# Domains of the enumerated columns.
REMOTE_STATUSES = ("onsite", "hybrid", "remote", "unknown")
EMPLOYMENT_TYPES = (
    "full_time", "part_time", "contract", "temporary", "internship", "freelance", "unknown",
)
SENIORITY_LEVELS = (
    "intern", "entry", "mid", "senior", "staff", "principal", "lead", "manager", "director",
    "executive", "unknown",
)
JOB_STATUSES = ("active", "stale", "archived")
DECISIONS = ("saved", "skipped", "applied_elsewhere", "needs_manual_review")
REMOTE_PREFERENCES = (
    "unspecified", "remote_only", "remote_preferred", "hybrid_only", "hybrid_preferred",
    "onsite_only", "onsite_preferred", "onsite_ok",
)
BOARD_SITES = ("greenhouse", "lever", "linkedin")
DEFAULT_PLAN_SITES = ("greenhouse", "lever")
UNKNOWN_TITLE = "Unknown title"
UNKNOWN_COMPANY = "Unknown company"
UNKNOWN_LOCATION = "Unknown location"
LISTING_ONLY_PREFIX = "Listing-only discovery from "
LISTING_ONLY_TEXT = {
    "greenhouse": "Listing-only discovery from Greenhouse jobs page.",
    "lever": "Listing-only discovery from Lever jobs page.",
    "linkedin": "Listing-only discovery from LinkedIn jobs page.",
    "indeed": "Listing-only discovery from Indeed jobs page.",
}

_S = T.StringType()
_LIST = T.ArrayType(_S)
_TS = T.TimestampType()

# Metadata keys that have a column of their own.
METADATA_COLUMNS = {
    "team": _S,
    "workplace_type": _S,
    "employment_type_text": _S,
    "posted_time": _S,
    "snippet": _S,
}

POSTING = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("source_site", _S, False),
        T.StructField("source_job_id", _S),
        T.StructField("url", _S, False),
        T.StructField("title", _S, False),
        T.StructField("company", _S, False),
        T.StructField("location", _S, False),
        T.StructField("remote_status", _S, False),
        T.StructField("employment_type", _S, False),
        T.StructField("seniority", _S, False),
        T.StructField("job_status", _S, False),
        T.StructField("posted_at", _TS),
        T.StructField("discovered_at", _TS, False),
        T.StructField("last_seen_at", _TS, False),
        T.StructField("description_text", _S, False),
        *[T.StructField(name, kind) for name, kind in METADATA_COLUMNS.items()],
        T.StructField("score", T.DoubleType()),
        T.StructField("score_explanations", _LIST),
        T.StructField("extra", _S),
    ]
)

LIST_CONSTRAINTS = (
    "target_titles", "preferred_titles", "include_keywords", "preferred_keywords",
    "exclude_keywords", "excluded_role_categories", "location_constraints",
    "preferred_locations", "seniority_preferences", "source_site_preferences",
    "include_companies", "exclude_companies",
)

CONSTRAINTS = T.StructType(
    [
        *[T.StructField(name, _LIST) for name in LIST_CONSTRAINTS],
        T.StructField("remote_preference", _S),
        T.StructField("freshness_window_days", T.IntegerType()),
    ]
)

DECISION_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("posting_url", _S),
        T.StructField("decision", _S),
        T.StructField("decided_at", _TS),
        T.StructField("note", _S),
    ]
)

REGISTRY = T.StructType(
    [
        T.StructField("company_name", _S),
        T.StructField("source_site", _S),
        T.StructField("board_url", _S),
        T.StructField("tags", _LIST),
        T.StructField("location_hints", _LIST),
    ]
)

RULE_LISTS = (
    "include_keywords", "exclude_keywords", "preferred_companies", "discouraged_companies",
    "preferred_locations", "discouraged_locations", "preferred_seniority_levels",
    "preferred_remote_statuses", "preferred_employment_types",
)
RULES = T.StructType([T.StructField(name, _LIST) for name in RULE_LISTS])

# Scoring rules used when no rule file is given.
DEFAULT_RULES = {
    "include_keywords": ["engineer", "developer", "backend", "platform", "python", "security"],
    "exclude_keywords": ["sales", "recruiter", "account executive"],
    "preferred_remote_statuses": ["remote", "hybrid"],
    "preferred_seniority_levels": ["senior", "staff", "principal", "lead"],
}

DISCOVERY_QUERY = T.StructType(
    [
        T.StructField("query_id", _S),
        T.StructField("source_site", _S),
        T.StructField("label", _S),
        T.StructField("start_url", _S),
        T.StructField("include_keywords", _LIST),
        T.StructField("exclude_keywords", _LIST),
        T.StructField("location_hints", _LIST),
    ]
)
