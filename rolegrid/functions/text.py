"""Text, list and classification expressions. Everything here stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, with ``value`` computed once per row.

    A column that is mentioned several times is otherwise repeated in the plan and in the work.
    """
    return F.transform(F.array(value), body)[0]


def squash_ws(value: Column | str) -> Column:
    """Collapse runs of whitespace to one blank and trim (PR1)."""
    return F.trim(F.regexp_replace(as_col(value), WHITESPACE, " "))


def fold(value: Column | str) -> Column:
    """Case-insensitive comparison form."""
    return F.lower(as_col(value))


def free_text_key(value: Column | str) -> Column:
    return squash_ws(fold(value))


def non_empty(value: Column | str) -> Column:
    """Null for the empty string."""
    col = as_col(value)
    return F.when(col != "", col)


def string_list(value: Column | str) -> Column:
    """Null-safe array."""
    return F.coalesce(as_col(value), F.array().cast("array<string>"))


def clean_list(value: Column | str, folded: bool = False) -> Column:
    """Squashed items of a list; null becomes the empty list (PR2)."""
    step = (lambda x: fold(squash_ws(x))) if folded else squash_ws
    return F.transform(string_list(value), step)


def list_has_blank(value: Column | str) -> Column:
    """True when an item is empty after squashing, which makes the whole list invalid."""
    return F.exists(string_list(value), lambda x: squash_ws(x) == "")


def distinct_ci(value: Column | str, folded: bool = False) -> Column:
    """Keep the first of items equal ignoring case, in order (WN5).

    The lower-cased list is built once; an item stays when its own position is the first one of its
    lower-cased form.
    """
    kept = let(
        string_list(value),
        lambda items: F.when(F.size(items) < 2, F.filter(items, F.isnotnull)).otherwise(let(
            F.transform(items, F.lower),
            lambda low: F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1),
        )),
    )
    return F.transform(kept, F.lower) if folded else kept


def concat_lists(*values: Column | str) -> Column:
    return F.concat(*[string_list(v) for v in values])


def one_of(*words: str) -> str:
    """Patterns as alternatives, gathered by their first letter; alternatives with the same letter stay in order."""
    groups: dict[str, list[str]] = {}
    for word in words:
        groups.setdefault(word[0], []).append(word[1:])
    return "|".join(first + ("(?:" + "|".join(rest) + ")" if len(rest) > 1 else rest[0]) for first, rest in groups.items())


def any_contains(haystack: Column, needles: Iterable[str]) -> Column:
    """Any of the words is a substring; one pattern, so one pass over the text. Words that hold another one add nothing."""
    words = list(dict.fromkeys(needles))
    return haystack.rlike(one_of(*[re.escape(w) for w in words if not any(v != w and v in w for v in words)]))


def any_prefix(text: Column, prefixes: Iterable[str]) -> Column:
    return text.rlike("^(?:" + one_of(*map(re.escape, prefixes)) + ")")


def site_slug(value: Column | str) -> Column:
    """Lower case, blanks and hyphens to underscores (PR3)."""
    return F.translate(fold(squash_ws(value)), " -", "__")


def is_site_slug(value: Column | str) -> Column:
    return site_slug(value).rlike(r"(?U)^[\p{IsAlphabetic}\p{IsDigit}_]*[\p{IsAlphabetic}\p{IsDigit}][\p{IsAlphabetic}\p{IsDigit}_]*$")


def company_key(value: Column | str) -> Column:
    """Letters and digits only (FN9)."""
    return F.regexp_replace(fold(value), "[^a-z0-9]+", "")


def match_key(value: Column | str) -> Column:
    """Letters and digits separated by single blanks (FN9)."""
    return F.trim(F.regexp_replace(fold(value), "[^a-z0-9]+", " "))


# First substring found decides the employment type.
EMPLOYMENT_HINTS = (
    ("full", "full_time"),
    ("part", "part_time"),
    ("contract", "contract"),
    ("intern", "internship"),
    ("temp", "temporary"),
    ("freelance", "freelance"),
)


def employment_type(value: Column | str) -> Column:
    """Employment type named in a free text (FN10)."""
    text = F.coalesce(fold(value), F.lit(""))
    return F.coalesce(
        *[F.when(text.contains(hint), F.lit(kind)) for hint, kind in EMPLOYMENT_HINTS],
        F.lit("unknown"),
    )


def remote_status(value: Column | str) -> Column:
    """Workplace named in a free text; any other non-empty text means on site (FN11)."""
    text = F.coalesce(fold(value), F.lit(""))
    return (
        F.when(text.contains("hybrid"), "hybrid")
        .when(text.contains("remote"), "remote")
        .when(text != "", "onsite")
        .otherwise("unknown")
    )


def title_case(value: Column | str) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others.

    ``initcap`` capitalizes after blanks, so a marked blank is put at each boundary and removed again.
    """
    apart = F.regexp_replace(fold(value), r"(?<=\P{L})(?=\p{L})", "\x01 ")
    return F.replace(F.initcap(apart), F.lit("\x01 "), F.lit(""))


POSTED_TIME_PATTERN = (
    r"(?U)\b\d+\s+(minute|hour|day|week|month|year)s?\s+ago\b|\breposted\b|\bposted\b|^just now$"
)


def is_posted_time(value: Column | str) -> Column:
    """Relative posting time such as "3 days ago" (FN15)."""
    return fold(value).rlike(POSTED_TIME_PATTERN)


def posted_at(value: Column | str) -> Column:
    """ISO text to timestamp; no zone means UTC, unreadable text gives null (FN16)."""
    text = F.trim(as_col(value))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def iso_text(value: Column | str) -> Column:
    """ISO-8601 text of a timestamp, fraction only when there is one (FN19)."""
    col = as_col(value)
    fraction = F.date_format(col, "SSSSSS")
    return F.concat(
        F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)),
        F.date_format(col, "xxx"),
    )


LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def description_text(value: Column | str) -> Column:
    """Squash every line and drop empty ones (FN17)."""
    lines = F.transform(F.split(as_col(value), LINE_BREAKS), squash_ws)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


# Tokens that classify a detail-page fragment.
WORKPLACE_TOKENS = ["remote", "hybrid", "on-site", "onsite"]
EMPLOYMENT_TOKENS = [
    "full-time", "full time", "part-time", "part time", "contract", "intern", "temporary", "freelance",
]


def insight_fields(primary: Column | str, insights: Column | str) -> Column:
    """Sort detail-page fragments into posted time, workplace, employment and location (FN14).

    A fragment is offered to the four slots in that order and goes to the first open slot that accepts
    it. Per slot this is a running choice, so it is one ordered ``aggregate`` over a four-field struct.
    """
    parts = F.filter(F.transform(F.split(as_col(primary), "[|·]"), F.trim), lambda x: x != "")
    fragments = F.transform(
        F.filter(concat_lists(parts, insights), lambda x: F.coalesce(x, F.lit("")) != ""), squash_ws
    )
    slots = ("posted_time", "workplace_type", "employment_type_text", "location")
    empty = F.struct(*[F.lit(None).cast("string").alias(s) for s in slots])

    def offer(state: Column, text: Column) -> Column:
        low = F.lower(text)
        fits = {
            "posted_time": is_posted_time(text),
            "workplace_type": any_contains(low, WORKPLACE_TOKENS),
            "employment_type_text": any_contains(low, EMPLOYMENT_TOKENS),
            "location": ~(low.startswith("over ") | low.startswith("more than ")),
        }
        choice = F.coalesce(
            *[F.when(state[s].isNull() & fits[s], F.lit(s)) for s in slots], F.lit("")
        )
        return F.struct(*[F.when(choice == s, text).otherwise(state[s]).alias(s) for s in slots])

    return F.aggregate(fragments, empty, offer)
