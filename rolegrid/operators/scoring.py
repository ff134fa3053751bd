"""Rule-based scores with an explanation for every point given or taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.functions.text import concat_lists, distinct_ci, string_list

# Points.
INCLUDE_POINTS, EXCLUDE_POINTS = 15, -40
PREFERENCE_POINTS = {"remote_status": (12, -10), "employment_type": (8, -6), "seniority": (8, -6)}
KEYWORD_FIELDS = ("title", "company", "location", "description")

EVENTS = "array<struct<points:int,text:string>>"


def _criteria(**lists: Column) -> Column:
    """Criteria struct with empty lists where nothing is given."""
    names = [f"{kind}_{f}" for f in KEYWORD_FIELDS for kind in ("include", "exclude")]
    names += [f"preferred_{p}" for p in PREFERENCE_POINTS]
    empty = F.array().cast("array<string>")
    return F.struct(*[lists.get(n, empty).alias(n) for n in names])


def rule_criteria(rules: Column) -> Column:
    """Criteria of a scoring rule set; one keyword list serves title and description (PR13)."""
    include = distinct_ci(rules["include_keywords"], folded=True)
    exclude = distinct_ci(rules["exclude_keywords"], folded=True)
    return _criteria(
        include_title=include, exclude_title=exclude,
        include_company=distinct_ci(rules["preferred_companies"], folded=True),
        exclude_company=distinct_ci(rules["discouraged_companies"], folded=True),
        include_location=distinct_ci(rules["preferred_locations"], folded=True),
        exclude_location=distinct_ci(rules["discouraged_locations"], folded=True),
        include_description=include, exclude_description=exclude,
        preferred_remote_status=string_list(rules["preferred_remote_statuses"]),
        preferred_employment_type=string_list(rules["preferred_employment_types"]),
        preferred_seniority=string_list(rules["preferred_seniority_levels"]),
    )


def constraint_criteria(wanted: Column) -> Column:
    """Criteria of a constraint row; titles count as title keywords (PR14, ST6)."""
    keywords = concat_lists(wanted["include_keywords"], wanted["preferred_keywords"])
    titles = concat_lists(wanted["target_titles"], wanted["preferred_titles"])
    places = concat_lists(wanted["location_constraints"], wanted["preferred_locations"])
    preference = wanted["remote_preference"]
    status = F.coalesce(
        *[F.when(preference.isin(f"{s}_only", f"{s}_preferred"), F.array(F.lit(s)))
          for s in ("remote", "hybrid", "onsite")],
        F.array().cast("array<string>"),
    )
    return _criteria(
        include_title=distinct_ci(F.concat(keywords, titles), folded=True),
        include_description=distinct_ci(keywords, folded=True),
        include_company=distinct_ci(wanted["include_companies"], folded=True),
        exclude_company=distinct_ci(wanted["exclude_companies"], folded=True),
        include_location=distinct_ci(places, folded=True),
        preferred_remote_status=status,
        preferred_seniority=string_list(wanted["seniority_preferences"]),
    )


def _signed(points: int) -> str:
    return f"{points:+d}"


def keyword_events(criteria: Column, field: str) -> Column:
    """Points for every keyword found in one field (SC1)."""

    def hits(kind: str, points: int) -> Column:
        found = F.filter(criteria[f"{kind}_{field}"], lambda k: F.col(f"{field}_l").contains(k))
        return F.transform(
            found,
            lambda k: F.struct(
                F.lit(points).alias("points"),
                F.concat(F.lit(f"{_signed(points)} {field} matched {kind} keyword '"), k, F.lit("'")).alias("text"),
            ),
        )

    return F.concat(hits("include", INCLUDE_POINTS), hits("exclude", EXCLUDE_POINTS))


def preference_events(criteria: Column, label: str) -> Column:
    """Points for a preferred value, a penalty for any other, nothing without a preference (SC2)."""
    hit, miss = PREFERENCE_POINTS[label]
    wanted, actual = criteria[f"preferred_{label}"], F.col(label)
    good = F.concat(F.lit(f"{_signed(hit)} {label} matched preferred value '"), actual, F.lit("'"))
    bad = F.lit(f"{_signed(miss)} {label} did not match preferred values")

    def event(points: int, text: Column) -> Column:
        return F.array(F.struct(F.lit(points).alias("points"), text.alias("text")))

    return (
        F.when(F.size(wanted) == 0, F.array().cast(EVENTS))
        .when(F.array_contains(wanted, actual), event(hit, good))
        .otherwise(event(miss, bad))
    )


def score_events(criteria: Column) -> Column:
    """All point events of a posting in rule order (SC3)."""
    return F.concat(
        *[keyword_events(criteria, f) for f in KEYWORD_FIELDS],
        *[preference_events(criteria, p) for p in PREFERENCE_POINTS],
    )


def score(postings: DataFrame, criteria: Column) -> DataFrame:
    """Add ``score`` and ``score_explanations``; needs the lower-cased text columns (SC3)."""
    return (
        postings.withColumn("_criteria", criteria)
        .withColumn("_events", score_events(F.col("_criteria")))
        .withColumn("score", F.aggregate("_events", F.lit(0), lambda a, e: a + e["points"]))
        .withColumn("score_explanations", F.transform("_events", lambda e: e["text"]))
        .drop("_criteria", "_events")
    )


RULE_CHUNK = 2000


def long_rules(rules: DataFrame) -> DataFrame:
    """Rule lists to rows ``(rule_no, field, kind, keyword)``, title before company and so on."""
    criteria = rules.select(rule_criteria(F.struct(*rules.columns)).alias("c"))

    def numbered(block: int, field: str, kind: str) -> Column:
        return F.transform(
            F.col(f"c.{kind}_{field}"),
            lambda keyword, i: F.struct(
                (i.cast("long") + F.lit(block * 1_000_000_000)).alias("rule_no"),
                F.lit(field).alias("field"), F.lit(kind).alias("kind"), keyword.alias("keyword"),
            ),
        )

    blocks = [(f, k) for f in KEYWORD_FIELDS for k in ("include", "exclude")]
    parts = [numbered(n, f, k) for n, (f, k) in enumerate(blocks)]
    return criteria.select(F.explode(F.concat(*parts)).alias("r")).select("r.*")


def score_long(postings: DataFrame, rules: DataFrame, posting_id: str) -> DataFrame:
    """Keyword scoring with rules as rows (SC6): ``posting_id``, ``score``, ``score_explanations``.

    Rules come in chunks of at most ``RULE_CHUNK``; a chunk becomes a literal array, each posting is
    scanned for it in place and only hits turn into rows. So no pair of posting and rule is built unless
    the rule matches, and the grouped rows per posting are bounded by the number of rules. ``rules`` is a
    configuration table read chunk by chunk. Postings without a hit keep score 0.
    """
    text = {f: F.col(f"{f}_l") for f in KEYWORD_FIELDS}
    hits = None
    last = -1
    while True:
        chunk = rules.where(F.col("rule_no") > last).orderBy("rule_no").limit(RULE_CHUNK).collect()
        if not chunk:
            break
        last = chunk[-1]["rule_no"]
        literal = F.array(
            *[F.struct(F.lit(r["rule_no"]).cast("long").alias("rule_no"), F.lit(r["field"]).alias("field"),
                       F.lit(r["kind"]).alias("kind"), F.lit(r["keyword"]).alias("keyword")) for r in chunk]
        )
        found = F.filter(
            literal,
            lambda r: F.coalesce(*[F.when(r["field"] == f, text[f].contains(r["keyword"])) for f in KEYWORD_FIELDS]),
        )
        rows = postings.select(posting_id, F.explode(found).alias("r")).select(posting_id, "r.*")
        hits = rows if hits is None else hits.unionByName(rows)
    if hits is None:
        none = F.array().cast("array<string>")
        return postings.select(posting_id, F.lit(0).alias("score"), none.alias("score_explanations"))
    points = F.when(F.col("kind") == "include", INCLUDE_POINTS).otherwise(EXCLUDE_POINTS)
    text_col = F.concat(
        F.when(points > 0, "+").otherwise(""), points.cast("string"), F.lit(" "), F.col("field"),
        F.lit(" matched "), F.col("kind"), F.lit(" keyword '"), F.col("keyword"), F.lit("'"),
    )
    sums = hits.groupBy(posting_id).agg(
        F.sum(points).cast("int").alias("score"),
        F.transform(F.array_sort(F.collect_list(F.struct("rule_no", text_col.alias("text")))), lambda x: x["text"]).alias(
            "score_explanations"
        ),
    )
    return postings.select(posting_id).join(sums, posting_id, "left").select(
        posting_id,
        F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("score_explanations", F.array().cast("array<string>")).alias("score_explanations"),
    )


def listing_stage_score(include: Column, exclude: Column, places: Column) -> Column:
    """Cheap score that decides which detail pages are worth reading (SC5)."""
    title, company, location, text = (F.col(f"{f}_l") for f in KEYWORD_FIELDS)

    def total(items: Column, points) -> Column:
        return F.aggregate(string_list(items), F.lit(0), lambda acc, k: acc + points(F.lower(k)))

    return (
        total(include, lambda k: F.when(title.contains(k), 3).when(text.contains(k) | company.contains(k), 1).otherwise(0))
        + total(places, lambda k: F.when(location.contains(k), 2).when(title.contains(k) | text.contains(k), 1).otherwise(0))
        + total(exclude, lambda k: F.when(title.contains(k) | location.contains(k), -3).when(text.contains(k), -1).otherwise(0))
    )
