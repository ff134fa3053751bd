"""URL forms, keys and text helpers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rolegrid.functions import keys, reports, text, urls


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(col.alias("x")).first().x


#: One url for each rule of the canonical form, then rules combined.
CANONICAL = [
    ("https://WWW.Quolt.TEST/Path", None, "https://www.quolt.test/Path"),  # host lowered, path not
    ("https://quolt.test/p#frag", None, "https://quolt.test/p"),  # no fragment
    ("https://quolt.test/p///", None, "https://quolt.test/p"),  # no slash at the end
    ("https://quolt.test", None, "https://quolt.test/"),  # but the root
    ("https://quolt.test:443/p", None, "https://quolt.test/p"),  # no default port
    ("https://quolt.test:444/p", None, "https://quolt.test:444/p"),
    ("https://me@quolt.test/p", None, "https://quolt.test/p"),  # no user
    ("https://quolt.test/p?z=3&m=2&m=1", None, "https://quolt.test/p?m=1&m=2&z=3"),  # sorted
    ("https://quolt.test/p?k=&n", None, "https://quolt.test/p"),  # no empty values
    ("https://quolt.test/p?fbclid=4&utm_term=x&k=v", None, "https://quolt.test/p?k=v"),  # no tracking
    ("https://quolt.test/p?k=%C3%A9%20%2B", None, "https://quolt.test/p?k=%C3%A9+%2B"),  # quoted anew
    ("//quolt.test/p", None, "https://quolt.test/p"),  # a scheme
    ("https://www.jobs.lever.co/quolt/n?utm_id=3", "lever", "https://jobs.lever.co/quolt/n"),  # no www on the site's own host
    ("https://www.quolt.test/n", "lever", "https://www.quolt.test/n"),  # but on others
    ("https://boards.greenhouse.io/embed/job_board/?for=quolt", "greenhouse", "https://boards.greenhouse.io/job_board?for=quolt"),
    ("https://www.linkedin.com/jobs/view/88/?refId=b", "linkedin", "https://linkedin.com/jobs/view/88"),  # a posting needs no query
]


@pytest.mark.parametrize("url, site, expected", CANONICAL)
def test_canonical_url(spark, url, site, expected):
    assert one(spark, urls.canonical_url("u", "s"), u=url, s=site) == expected
    assert one(spark, urls.canonical_url("u", "s"), u=expected, s=site) == expected


def test_plain_urls_skip_the_long_way(spark, monkeypatch):
    """What the pattern of plain urls lets through is spelled as the long way spells it."""
    hosts = ["a.test", "www.a.test", "jobs.lever.co", "boards.greenhouse.io", "A.test", "a.test:443", "u@a.test"]
    paths = ["/x/7", "/jobs/7", "/Jobs/7", "/embed/job_app", "/view/ 3", "/x//7", "/x/", "", "/a%20b", "/jobsx"]
    queries = ["", "?", "?utm_source=b", "?UTM_x=%zz&ref=1", "?refx=1", "?source=", "?utm_a=1&q=2", "?utm_é=1", "?ref=1#f", "?ref=1\n"]
    rows = [(f"https://{h}{p}{q}", s) for h in hosts for p in paths for q in queries for s in ("greenhouse", "lever", "linkedin", None)]
    table = spark.createDataFrame(rows, "u string, s string")
    short = [r[0] for r in table.select(urls.canonical_url("u", "s")).collect()]
    assert 100 < table.where(F.col("u").rlike(urls.PLAIN_URL)).count() < len(rows) / 2
    monkeypatch.setattr(urls, "PLAIN_URL", "(?!)")
    assert short == [r[0] for r in table.select(urls.canonical_url("u", "s")).collect()]


def test_ids_and_companies_from_urls(spark):
    assert one(spark, urls.linkedin_job_id("u"), u="https://www.linkedin.com/jobs/view/12/?x=1") == "12"
    assert one(spark, urls.linkedin_job_id("u"), u="https://www.linkedin.com/jobs/view") is None
    assert one(spark, urls.linkedin_job_id("u"), u="https://www.linkedin.com/jobs/search?currentJobId=9") == "9"
    assert one(spark, urls.source_id_from_url("u", F.lit("lever")), u="https://jobs.lever.co/a/b/") == "b"
    assert one(spark, urls.source_id_from_url("u", F.lit("lever")), u="https://jobs.lever.co") is None
    assert one(spark, urls.company_from_board_url("u", F.lit("lever")), u="https://jobs.lever.co/x2y-labs_co/1") == "X2Y Labs Co"
    assert one(spark, urls.company_from_board_url("u", F.lit("lever")), u="https://boards.greenhouse.io/acme") is None
    assert one(spark, urls.http_url("u"), u="HTTPS://Acme.TEST:443") == "https://acme.test/"
    assert one(spark, urls.http_url("u"), u="ftp://acme.test") is None


def test_keys(spark):
    values = dict(source_site="linkedin", source_job_id="ABC-1", url="https://acme.test/j/1/?b=2&a=1&utm_x=1", title=" Senior   Dev ", company="Acme", location="Oslo, NO")
    assert one(spark, keys.dedupe_key(), **values) == "source:linkedin:abc-1"
    values["source_job_id"] = None
    assert one(spark, keys.dedupe_key(), **values) == "url:https://acme.test/j/1?a=1&b=2"
    assert tuple(one(spark, keys.fallback_key(), **values)) == ("senior dev", "acme", "oslo, no")
    pair = spark.createDataFrame([("linkedin", "A", "https://x.test/1"), ("linkedin", "a", "https://x.test/1?ref=f"), ("linkedin", None, "https://x.test/2")],
                                 "source_site string, source_job_id string, url string").withColumns({c: F.lit("t") for c in ("title", "company", "location")})
    both = pair.alias("l").join(pair.alias("r"), F.col("l.url") != F.col("r.url")).where("l.url = 'https://x.test/1'")
    rows = both.select(F.col("r.url"), keys.same_source_identity("l", "r"), keys.same_canonical_url("l", "r"), keys.same_fallback_identity("l", "r")).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == {"https://x.test/1?ref=f": (True, True, True), "https://x.test/2": (False, False, True)}


def test_text(spark):
    assert one(spark, text.squash_ws("t"), t=" a  \t b\n") == "a b"
    assert one(spark, text.description_text("t"), t=" a  b \r\n\n  c ") == "a b\nc"
    assert one(spark, text.distinct_ci(F.array(F.lit("Go"), F.lit("x"), F.lit("GO"), F.lit("X"))) ) == ["Go", "x"]
    assert one(spark, text.clean_list(F.lit(None).cast("array<string>"))) == []
    assert one(spark, text.iso_text(F.lit("2026-04-01 10:00:00.25").cast("timestamp"))) == "2026-04-01T10:00:00.250000+00:00"
    assert one(spark, text.posted_at("t"), t="2026-04-01T02:00:00+02:00") == datetime(2026, 4, 1)
    assert one(spark, text.posted_at("t"), t="soon") is None


def test_insights(spark):
    got = one(spark, text.insight_fields("p", F.array(F.lit("Over 90 applicants"), F.lit("Hybrid"), F.lit("Remote"), F.lit("Full-time"), F.lit("Engineering"))), p="Oslo, NO · Reposted 2 days ago")
    assert got.asDict() == {"posted_time": "Reposted 2 days ago", "workplace_type": "Hybrid", "employment_type_text": "Full-time", "location": "Oslo, NO"}
    got = one(spark, text.insight_fields("p", F.array(F.lit("more than 5"), F.lit("just now"))), p="")
    assert got.asDict() == {"posted_time": "just now", "workplace_type": None, "employment_type_text": None, "location": None}


def test_match_sentence(spark):
    base = spark.createDataFrame([("Senior Python Engineer", "Acme", "Remote - Canada", 88)], "title string, company string, location string, score int")
    lines = ["+15 title matched include keyword 'python'", "+12 remote_status matched preferred value 'remote'", "-6 employment_type did not match preferred values"]
    row = base.withColumn("score_explanations", F.array(*[F.lit(x) for x in lines])).select(reports.match_sentence().alias("x")).first()
    assert row.x == (
        "Match Summary: Potential match: Senior Python Engineer at Acme in Remote - Canada. Score: 88. Positive signals: title matched preferred keyword 'python'; "
        "remote_status matched preferred value 'remote'. Possible concerns: employment_type did not match preferred values.")
    empty = base.withColumn("score", F.lit(None).cast("int")).withColumn("score_explanations", F.lit(None).cast("array<string>"))
    assert "Score: n/a. No rule explanations were provided" in empty.select(reports.match_sentence().alias("x")).first().x
    own = base.withColumn("score_explanations", F.array(F.lit("x"))).select(reports.match_sentence(summarizer=lambda e, s: F.concat(F.lit("own "), F.col("title"))).alias("x"))
    assert own.first().x == "Match Summary: own Senior Python Engineer"
