"""Filters, scores, explanations and ranking on small hand-made rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rolegrid.operators import matching as M
from rolegrid.operators import scoring as SC
from rolegrid.operators.store import rule_set
from rolegrid.schemas import CONSTRAINTS, LIST_CONSTRAINTS, RULE_LISTS, RULES

NOW = datetime(2026, 4, 10)
POSTING = dict(id=1, board="b", source_site="linkedin", title="Senior Python Engineer", company="Example Co", location="Remote - Canada",
               remote_status="remote", employment_type="full_time", seniority="senior", posted_at=NOW - timedelta(days=3), description_text="Build internal platforms.")
COLUMNS = ("id long, board string, source_site string, title string, company string, location string, remote_status string, "
           "employment_type string, seniority string, posted_at timestamp, description_text string")


def postings(spark, *rows):
    return spark.createDataFrame([tuple({**POSTING, **r}.values()) for r in rows], COLUMNS)


def wants(spark, *rows):
    data = []
    for i, row in enumerate(rows, 1):
        values = {**{n: [] for n in LIST_CONSTRAINTS}, "remote_preference": "unspecified", "freshness_window_days": None, **row}
        data.append((i, "b", tuple(values[f.name] for f in CONSTRAINTS)))
    return spark.createDataFrame(data, f"prompt_id int, board string, want {CONSTRAINTS.simpleString()}")


def reasons(spark, want, **posting):
    pairs = M.candidates(postings(spark, posting), wants(spark, want), on="board", spread="id")
    row = M.hard_filter(pairs, F.lit(NOW)).first()
    assert row.passed == (not row.rejection_reasons)
    return row.rejection_reasons


CASES = [
    ({}, {}, []),
    ({"exclude_keywords": ["PYTHON", "plat"]}, {}, ["Excluded keyword 'PYTHON' matched title", "Excluded keyword 'plat' matched description"]),
    ({"exclude_companies": ["example co", "Example"]}, {}, ["Company 'Example Co' matched excluded company hint 'example co'"]),
    ({"source_site_preferences": ["lever", "greenhouse"]}, {}, ["Source site 'linkedin' is outside allowed source sites [lever, greenhouse]"]),
    ({"location_constraints": ["toronto", "CANADA"]}, {}, []),
    ({"location_constraints": ["Oslo"]}, {}, ["Job location 'Remote - Canada' did not match any required location constraint [Oslo]"]),
    ({"location_constraints": ["Oslo"]}, {"location": "Unknown place"}, ["Job location is unknown and cannot satisfy explicit location constraints"]),
    ({"remote_preference": "remote_only"}, {"remote_status": "hybrid"}, ["Job remote status 'hybrid' did not satisfy required remote-only constraint"]),
    ({"remote_preference": "hybrid_preferred"}, {"remote_status": "unknown"},
     ["Job remote status is unknown and cannot satisfy explicit requirement 'hybrid_preferred'"]),
    ({"remote_preference": "hybrid_preferred"}, {"remote_status": "onsite"}, []),
    ({"remote_preference": "remote_preferred"}, {"remote_status": "unknown"}, []),
    ({"freshness_window_days": 3}, {}, []),
    ({"freshness_window_days": 2}, {}, ["Job posted_at '2026-04-07T00:00:00+00:00' is older than allowed freshness window 2 days"]),
    ({"freshness_window_days": 2}, {"posted_at": None}, []),
    ({"include_keywords": ["cobol"], "target_titles": ["x"], "include_companies": ["y"], "excluded_role_categories": ["python"]}, {}, []),
]


@pytest.mark.parametrize("want, posting, expected", CASES)
def test_hard_filters(spark, want, posting, expected):
    assert reasons(spark, want, **posting) == expected


def scored(spark, posting, **lists):
    criteria = SC._criteria(**{k: F.array(*[F.lit(x) for x in v]).cast("array<string>") for k, v in lists.items()})
    row = SC.score(M.with_search_text(postings(spark, posting)), criteria).first()
    return row.score, row.score_explanations


def test_known_scores(spark):
    assert scored(spark, {}, include_title=["python", "engineer"], include_company=["example"], include_location=["canada"],
                  preferred_remote_status=["remote"], preferred_employment_type=["full_time"], preferred_seniority=["senior"])[0] == 88
    assert scored(spark, dict(title="Junior Sales Associate", remote_status="onsite", employment_type="part_time", seniority="entry"), exclude_title=["sales", "associate"],
                  preferred_remote_status=["remote"], preferred_employment_type=["full_time"], preferred_seniority=["senior"])[0] == -102
    assert scored(spark, {}, include_title=["python"], exclude_company=["other"], preferred_remote_status=["remote"]) == (
        27, ["+15 title matched include keyword 'python'", "+12 remote_status matched preferred value 'remote'"])


def test_rules_and_long_form_agree(spark):
    values = dict(include_keywords=["Platform", "python", "PLATFORM"], exclude_keywords=["build"], preferred_companies=["Example Co"],
                  discouraged_companies=["Bad"], preferred_locations=["Canada"], discouraged_locations=["remote"])
    rules = spark.createDataFrame([tuple(values.get(n, []) for n in RULE_LISTS)], RULES)
    rows = M.with_search_text(postings(spark, {}, dict(id=2, title="Staff Platform Engineer"), dict(id=3, title="x", company="y", location="z", description_text="w")))
    wide = {r.id: (r.score, r.score_explanations) for r in SC.score(rows, rule_set(rules)).collect()}
    long = {r.id: (r.score, r.score_explanations) for r in SC.score_long(rows, SC.long_rules(rules), "id").collect()}
    assert long == wide and wide[3] == (0, [])
    old = SC.RULE_CHUNK
    try:
        SC.RULE_CHUNK = 2
        assert {r.id: (r.score, r.score_explanations) for r in SC.score_long(rows, SC.long_rules(rules), "id").collect()} == wide
    finally:
        SC.RULE_CHUNK = old


def test_evaluate_and_rank(spark):
    rows = postings(spark, {}, dict(id=2, title="Python dev"), dict(id=3, location="Oslo"), dict(id=4, board="other"))
    want = dict(include_keywords=["Python"], target_titles=["senior python engineer"], location_constraints=["canada"], remote_preference="remote_only")
    found = M.evaluate(M.candidates(rows, wants(spark, want, {}), on="board", spread="id"), F.lit(NOW))
    hits = {(r.prompt_id, r.id): r for r in M.matched(found).collect()}
    assert sorted(hits) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]
    assert hits[1, 1].match_score == 15 + 15 + 15 + 12 and len(hits[1, 1].score_reasons) == 3
    assert hits[2, 1].match_score == 0 and hits[2, 1].score_reasons == []
    out = M.rejected(found).collect()
    assert [(r.prompt_id, r.id, r.match_score) for r in out] == [(1, 3, None)]
    assert out[0].explanation == "Job location 'Oslo' did not match any required location constraint [canada]"
    best = M.best_per_prompt(M.matched(found), k=1)
    assert sorted((r.prompt_id, r.id) for r in best.collect()) == [(1, 1), (2, 1)]
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()


def test_listing_stage_score(spark):
    rows = M.with_search_text(postings(spark, {}))
    lists = [F.array(*[F.lit(x) for x in v]) for v in (["PYTHON", "build", "nope"], ["canada", "platforms"], ["canada", "Senior"])]
    assert rows.select(SC.listing_stage_score(*lists).alias("s")).first().s == (3 + 1) + (2 + 1) - (3 + 1)
