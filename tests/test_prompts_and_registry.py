"""Prompt parsing, plans and registry maintenance."""

import pytest

from rolegrid.operators import registry as R
from rolegrid.operators import validate as V
from rolegrid.operators.intents import parse_prompts
from rolegrid.schemas import CONSTRAINTS, LIST_CONSTRAINTS

#: Own sentences, one or two rules of the prompt language each, and what they must set.
PROMPTS = [
    ("Staff cloud jobs; experience with terraform. Ideally android openings.",
     dict(target_titles=["Cloud Engineer"], preferred_titles=["Android Engineer"], include_keywords=["terraform", "cloud"], seniority_preferences=["staff"])),
    ("qa positions using selenium or cypress. Excluding crypto jobs. Avoid companies like Fnord or Zig.",
     dict(include_keywords=["selenium", "cypress", "QA"], exclude_companies=["Fnord", "Zig"])),
    ("Openings in Gent or Liege. On-site only via Lever.",
     dict(location_constraints=["Gent", "Liege"], remote_preference="onsite_only", source_site_preferences=["lever"])),
    ("Data roles from Quolt and Vemp; posted this week.",
     dict(include_companies=["Quolt", "Vemp"], freshness_window_days=7)),
    ("Platform jobs in Norway. Ideally in Bergen. Preferably hybrid.",
     dict(location_constraints=["Norway"], preferred_locations=["Bergen"], remote_preference="hybrid_preferred")),
    ("Hello there.", dict({n: [] for n in LIST_CONSTRAINTS}, remote_preference="unspecified", freshness_window_days=None)),
    ("past 3 weeks, yesterday", dict(freshness_window_days=21)),
    ("Security roles in tech\n", dict(location_constraints=[])),  # the end of the line is no part of a clause
    ("Security roles at startups \t\n", dict(include_companies=[])),
    ("Security roles in Bern\n", dict(location_constraints=["Bern"])),
]


def test_prompts(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PROMPTS)], "i int, raw_prompt_text string")
    got = {r.i: r for r in parse_prompts(rows).collect()}
    for i, (prompt, expected) in enumerate(PROMPTS):
        want = got[i].want.asDict()
        assert {k: want[k] for k in expected} == expected, prompt
        assert got[i].error is None
    assert "must-have titles: Cloud Engineer" in got[0].parser_notes


def test_unresolved_and_errors(spark):
    rows = spark.createDataFrame([(0, "Platform jobs at Quolt in Norway, maybe near fjord things."), (1, "past 13 months"), (2, " \n"), (3, None), (4, "past 99999999999999999999 days")],
                                 "i int, raw_prompt_text string")
    got = {r.i: r for r in parse_prompts(rows).collect()}
    assert got[0].unresolved_fragments == ["maybe near fjord things"]
    assert got[0].summary == "titles=Platform Engineer | must=platform | locations=Norway | companies=Quolt | unresolved=1"
    assert got[1].error == got[4].error == "freshness window must be between 1 and 365 days"
    assert got[2].error == got[3].error == "prompt text is empty" and got[2].want is None


def intents(spark, *rows):
    data = []
    for i, row in enumerate(rows):
        values = {**{n: [] for n in LIST_CONSTRAINTS}, "remote_preference": "unspecified", "freshness_window_days": None, **row}
        data.append((i, tuple(values[f.name] for f in CONSTRAINTS)))
    return spark.createDataFrame(data, f"prompt_id int, want {CONSTRAINTS.simpleString()}")


BOARDS = [
    (0, "Acme, Inc.", "greenhouse", "https://b.test/acme-gh", ["Payments"], ["Canada"]),
    (1, "Acme Inc", "lever", "https://b.test/acme-lv", ["python"], ["United States"]),
    (2, "Other", "lever", "https://b.test/other", [], []),
]
COLS = "idx long, company_name string, source_site string, board_url string, tags array<string>, location_hints array<string>"


def test_plan_with_registry(spark):
    plan = R.compile_plan(
        intents(
            spark,
            dict(include_companies=["ACME inc"]),
            dict(include_companies=["Acme Inc", "Acme, Inc."], location_constraints=["canada"], include_keywords=["python"]),
            dict(include_companies=["Acme Inc"], location_constraints=["Mars"], include_keywords=["PYTHON"]),
            dict(include_companies=["Nobody"]),
            dict(),
            dict(include_companies=["Other"], source_site_preferences=["monster"]),
            dict(include_companies=["Other"], source_site_preferences=["Lever", "monster"], target_titles=["Dev"]),
        ),
        spark.createDataFrame(BOARDS, COLS),
    )
    queries = sorted((r.prompt_id, r.board_url[15:], r.label) for r in plan["queries"].collect())
    assert queries == [
        (0, "acme-gh", "Greenhouse Acme, Inc."), (0, "acme-lv", "Lever Acme Inc"),
        (1, "acme-gh", "Greenhouse Acme, Inc. python Roles"), (2, "acme-lv", "Lever Acme Inc PYTHON Roles"), (6, "other", "Lever Other Dev"),
    ]
    errors = {r.prompt_id: r.error for r in plan["errors"].collect()}
    assert sorted(errors) == [3, 4, 5] and errors[4] == R.ERROR_NO_COMPANY
    assert errors[3] == "No board registry entries matched companies [Nobody] for supported sources [greenhouse, lever]."
    assert errors[5].startswith("Intent requested unsupported source sites: monster.")
    notes = {r.prompt_id: r.plan_notes for r in plan["notes"].collect()}
    assert notes[6][1] == "Ignored unsupported source-site preferences: monster."
    lists = {r.prompt_id: r for r in R.to_discovery_queries(plan["queries"].where("prompt_id = 2")).collect()}
    assert lists[2].include_keywords == ["PYTHON"] and lists[2].location_hints == ["Mars"]


def test_plan_without_registry(spark):
    plan = R.compile_plan(intents(spark, {}, dict(source_site_preferences=["linkedin"])))
    assert sorted((r.prompt_id, r.source_site, r.label) for r in plan["queries"].collect()) == [
        (0, "greenhouse", "Greenhouse General Search"), (0, "lever", "Lever General Search"), (1, "linkedin", "Linkedin General Search")]
    assert R.not_executable(intents(spark, {}), plan["queries"]).count() == 1


def test_registry_issues_and_changes(spark):
    rows = spark.createDataFrame(
        [(0, " Acme  Co ", "Green House", "https://B.test", ["a"], []), (1, "Acme Co", "greenhouse", "https://b.test", ["a"], None), (2, "ACME-co", "greenhouse", "https://b.test/", [" "], []),
         (3, "acme co", "greenhouse", "https://b.test/x", [], []), (4, "Zeta", "greenhouse", "https://b.test/", [], [])], COLS)
    good, issues = V.validate_registry(rows)
    assert sorted(r.idx for r in good.collect()) == [1, 3, 4]
    assert [r.issue for r in V.ordered_issues(issues).collect()] == [
        "entry[0] invalid: source_site: source_site must be one of: greenhouse, lever, linkedin",
        "entry[2] invalid: tags: value must not be empty",
        "duplicate company/source entry: acme co on greenhouse already maps to https://b.test/",
        "duplicate board_url/source entry: https://b.test/ on greenhouse already exists for Acme Co",
    ]
    base = spark.createDataFrame(BOARDS, COLS)
    asked = spark.createDataFrame([("acme inc", "Lever", None), ("acme inc", "linkedin", None), ("other", "lever", "https://b.test/none")], "company_name string, source_site string, board_url string")
    out = R.remove_entries(base, asked)
    assert sorted(r.idx for r in out["registry"].collect()) == [0, 2]
    assert out["issues"].count() == 2
    merged, bad = R.import_entries(base, base)
    assert merged.count() == 6 and bad.count() == 6
    assert R.import_entries(base, base, replace=True)[1].count() == 0


@pytest.mark.parametrize("reason, change", [
    ("title: value must not be empty", dict(title=" ")), ("url: not a web address", dict(url="x")), ("seniority: unsupported value", dict(seniority="boss")),
    ("source_site: must contain letters, numbers, spaces, hyphens, or underscores", dict(source_site="a/b")),
])
def test_posting_checks(spark, reason, change):
    base = dict(source_site="My Site-x", source_job_id=None, url="https://x.test", title="a  b", company="c", location="l", description_text="d", remote_status="remote",
                employment_type="unknown", seniority="lead", job_status="active")
    rows = spark.createDataFrame([tuple({**base, **change}.values()), tuple(base.values())], ", ".join(f"{k} string" for k in base))
    for name in ("posted_at", "discovered_at", "last_seen_at"):
        rows = rows.selectExpr("*", f"timestamp'2026-01-01' AS {name}")
    good, bad = V.validate_postings(rows)
    assert [r.reasons for r in bad.collect()] == [[reason]]
    row = good.first()
    assert (row.source_site, row.title, row.url) == ("my_site_x", "a b", "https://x.test/")


def test_intents_of_orders_are_made_once(spark):
    """The plan joins written intents; it does not gather the line items of all orders again."""
    from rolegrid.catalog.prompts import QUERIES

    for name in ("discovery_queries", "registry_match"):
        assert not [f for f in QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f]


def test_prompts_of_orders_are_spelled_behind_the_shuffle(spark):
    """Rows are dealt to the cores as given columns; the longer texts made of them are not shuffled."""
    from rolegrid.catalog.prompts import QUERIES

    node = QUERIES["template_prompts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Repartition":
        node = node.children().head()
    assert "raw_prompt_text" not in [node.output().apply(i).name() for i in range(node.output().length())]


def test_many_mentions_and_odd_letters(spark):
    """A mention is judged by the characters before it, however many mentions these hold; odd letters and white space count as before."""
    prompts = [
        "avoid " + "qa jobs " * 30 + "prefer " + "ml\troles " * 200,
        "avoid qa jobs ml roles",
        "Data roleſ at Quolt, ſenior, Krypto. uſing kafka  streams",
        "Data roles/openings at Quolt  Inc or\tVemp",
    ]
    rows = spark.createDataFrame(list(enumerate(prompts)), "i int, raw_prompt_text string")
    got = {r.i: r.want for r in parse_prompts(rows).collect()}
    assert got[0].include_keywords == ["QA", "machine learning"] and got[0].preferred_titles == ["Machine Learning Engineer"]
    assert got[1].include_keywords == [] and got[1].target_titles == []
    assert got[2].include_keywords == ["kafka streams", "data"] and got[2].seniority_preferences == ["senior"]
    assert got[3].include_companies == ["Quolt Inc", "Vemp"]
