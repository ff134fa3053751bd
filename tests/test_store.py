"""Upsert, folding, lifecycle, new matches, prompts."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rolegrid.operators import lookups
from rolegrid.operators import store as S
from rolegrid.operators.store import STORED
from rolegrid.schemas import POSTING
from rolegrid.session import stage

T0 = datetime(2026, 1, 1)


def posting(id=None, url="https://x.test/1", job_id=None, **over):
    row = dict(
        id=id, source_site="acme", source_job_id=job_id, url=url, title="T", company="C", location="Paris",
        remote_status="unknown", employment_type="unknown", seniority="unknown", job_status="active", posted_at=None,
        discovered_at=T0, last_seen_at=T0, description_text="D", team=None, workplace_type=None,
        employment_type_text=None, posted_time=None, snippet=None, score=None, score_explanations=None, extra=None,
    )
    row.update(over)
    return row


def table(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in POSTING.fieldNames()) for r in rows], POSTING)


def batch(spark, rows):
    return table(spark, [dict(r, id=i) for i, r in enumerate(rows, 1)]).withColumnRenamed("id", "seq")


def by_id(df):
    return {r.id: r.asDict() for r in df.collect()}


def actions(result):
    return {r.seq: r.action for r in result["outcome"].collect()}


def test_update_rules(spark):
    old = posting(1, job_id="A", location="Lyon", remote_status="remote", job_status="archived", posted_at=T0, score=5.0,
                  last_seen_at=T0 + timedelta(days=3), description_text="Long text", team="core", extra='{"b":1,"a":2}')
    new = posting(url="https://x.test/1", location=" Unknown Location ", title="T2", employment_type="contract",
                  description_text="Listing-only discovery from Acme jobs page.", last_seen_at=T0 + timedelta(days=1),
                  extra='{"b":[3]}', workplace_type="w")
    result = S.upsert_postings(table(spark, [old]), batch(spark, [new]))
    row = by_id(result["store"])[1]
    assert actions(result) == {1: "updated"}
    assert (row["title"], row["location"], row["source_job_id"]) == ("T2", "Lyon", "A")
    assert (row["remote_status"], row["employment_type"], row["job_status"]) == ("remote", "contract", "active")
    assert (row["posted_at"], row["last_seen_at"]) == (None, T0 + timedelta(days=3))
    assert (row["description_text"], row["score"], row["team"], row["workplace_type"]) == ("Long text", 5, "core", "w")
    assert row["extra"] == '{"a":2,"b":[3]}'


def test_url_before_id_and_conflicts(spark):
    stored = table(spark, [posting(1, "https://x.test/1", "A"), posting(2, "https://x.test/2", "B"), posting(7, "https://x.test/7")])
    incoming = batch(spark, [
        posting(url="https://x.test/9", job_id="B", title="moved"),
        posting(url="https://x.test/1", job_id="B2", title="by url"),
        posting(url="https://x.test/7", job_id="B2", title="both"),
        posting(url="https://x.test/10", job_id="", title="new"),
        posting(url="https://x.test/11", job_id="b", title="case matters"),
    ])
    result = S.upsert_postings(stored, incoming)
    assert actions(result) == {1: "updated", 2: "updated", 3: "conflict", 4: "inserted", 5: "inserted"}
    rows = by_id(result["store"])
    assert sorted(rows) == [1, 2, 7, 8, 9]
    assert (rows[2]["url"], rows[2]["title"]) == ("https://x.test/9", "moved")
    assert (rows[1]["source_job_id"], rows[7]["title"]) == ("B2", "T")
    assert (rows[8]["title"], rows[9]["title"]) == ("new", "case matters")
    assert [r.title for r in result["conflicts"].collect()] == ["both"]


def sequential(stored, incoming):
    """The rules applied one row at a time; a row that meets two postings changes nothing."""
    rows = {r["id"]: dict(r) for r in stored}
    out = {}
    for seq, new in enumerate(incoming, 1):
        by_url = next((r for r in rows.values() if r["url"] == new["url"]), None)
        by_id = new["source_job_id"] and next((r for r in rows.values() if (r["source_site"], r["source_job_id"]) == (new["source_site"], new["source_job_id"])), None)
        if by_url and by_id and by_url is not by_id:
            out[seq] = "conflict"
            continue
        hit = by_url or by_id
        if not hit:
            i = max(rows, default=0) + 1
            rows[i] = dict(new, id=i)
            out[seq] = "inserted"
        else:
            extra = json.dumps(json.loads(hit["extra"] or "{}") | json.loads(new["extra"] or "{}"), sort_keys=True, separators=(",", ":"), ensure_ascii=False) if hit["extra"] or new["extra"] else None
            hit.update(url=new["url"], title=new["title"], source_job_id=new["source_job_id"] or hit["source_job_id"], extra=extra)
            out[seq] = "updated"
    return {(r["id"], r["url"], r["source_job_id"], r["title"], r["extra"]) for r in rows.values()}, out


def same_as_sequential(spark, stored, incoming):
    result = S.upsert_postings(table(spark, stored), batch(spark, incoming).repartition(3))
    rows, acts = sequential(stored, incoming)
    assert actions(result) == acts
    assert {(r.id, r.url, r.source_job_id, r.title, r.extra) for r in result["store"].collect()} == rows
    return result


@pytest.mark.parametrize("seed", range(6))
def test_moving_urls_and_ids_equal_one_row_at_a_time(spark, seed):
    rng = random.Random(seed)
    stored, urls, ids = [], iter(range(100)), iter(range(100))
    for i in range(rng.randint(0, 5)):
        stored.append(posting(i + 1, f"u{next(urls)}", f"j{next(ids)}" if rng.random() < 0.6 else None, extra='{"old":1}' if rng.random() < 0.5 else None))
    incoming = [
        posting(url=f"u{rng.randrange(8)}", job_id=rng.choice([None, "", *(f"j{k}" for k in range(6))]) or None, title=f"t{n}", extra=rng.choice([None, '{"%s":%d}' % (rng.choice("ab"), n), '{"a":{"x":[%d]},"q\\"":"é"}' % n]))
        for n in range(rng.randint(1, 25))
    ]
    same_as_sequential(spark, stored, incoming)


@pytest.mark.parametrize("seed", range(2))
def test_segments_equal_one_row_at_a_time(spark, monkeypatch, seed):
    """One hot id, moving urls and conflicts, cut in segments of seven rows that are replayed in parallel."""
    monkeypatch.setattr(lookups, "SEGMENT", 7)
    rng = random.Random(100 + seed)
    stored = [posting(1, "u0", "hot"), posting(2, "u1", None), posting(3, "u2", "j1")][: seed + 2]
    incoming = [
        posting(url=f"u{rng.randrange(6 + 4 * seed)}", job_id=rng.choice(["hot", "hot", "hot", None, "j1", f"j{rng.randrange(4)}"]), title=f"t{n}")
        for n in range(80)
    ]
    incoming += [posting(url="u3", job_id="hot", title=f"same{n}") for n in range(30)]
    same_as_sequential(spark, stored, incoming)
    found = lookups.replay_lookups(table(spark, stored), batch(spark, incoming), "seq")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # the segments' results are there, no task is left that replays a whole component


def test_stored_postings_that_share_a_key(spark, monkeypatch):
    """A component in which two stored postings have one key is never cut; the first one holds the key."""
    monkeypatch.setattr(lookups, "SEGMENT", 3)
    stored = [posting(1, "u0", "a"), posting(2, "u0", "b")]
    incoming = [posting(url=u, job_id=j, title=f"{u}{j}{n}") for n in range(4) for u, j in (("u0", None), ("u1", "b"), ("u2", "a"), ("u1", None))]
    found = lookups.replay_lookups(table(spark, stored), batch(spark, incoming), "seq")
    plain, want = lookups.Lookups(), {}
    for r in stored:
        plain.put(f"s{r['id']}", r["url"], r["source_site"], r["source_job_id"])
    for n, r in enumerate(incoming, 1):
        want[n] = plain.meet(f"n{n}", r["url"], r["source_site"], r["source_job_id"])
    assert {r.ord: (r.target, r.action) for r in found.collect()} == want


def test_rows_that_chain(spark):
    """Urls that move along rows of one batch, and four rows that meet one stored posting."""
    empty = same_as_sequential(spark, [], [posting(url="v1", job_id="a"), posting(url="v2", job_id="a"), posting(url="v2", job_id="c")])
    assert [(r.url, r.source_job_id) for r in empty["store"].collect()] == [("v2", "c")]
    same_as_sequential(spark, [posting(1, "v2", "a")], [posting(url="v1", job_id="x"), posting(url="v2", job_id="x"), posting(url="v2", job_id="y"), posting(url="v9", job_id="a")])
    merged = same_as_sequential(spark, [], [posting(url="v", extra='{"a":1}'), posting(url="v", extra='{"b":2}')])
    assert merged["store"].first().extra == '{"a":1,"b":2}'


def test_two_rows_meeting_one_stored_row(spark):
    stored = [posting(1, "https://x.test/1", "A")]
    for incoming in (
        [posting(url="https://x.test/1", title="u"), posting(url="https://x.test/2", job_id="A", title="i")],
        [posting(url="https://x.test/2", job_id="A", title="i"), posting(url="https://x.test/1", title="u")],
        [posting(url="https://x.test/1", job_id="Z", title="u"), posting(url="https://x.test/2", job_id="A", title="i")],
        [posting(url="https://x.test/2", job_id="A", title="i"), posting(url="https://x.test/1", job_id="Z", title="u")],
    ):
        same_as_sequential(spark, stored, incoming)


def test_upsert_twice_changes_nothing(spark):
    incoming = batch(spark, [posting(url=f"https://x.test/{i}", job_id=f"J{i}") for i in range(5)])
    empty = table(spark, [])
    first = S.upsert_postings(empty, incoming)
    once = stage(first["store"], "once")
    second = S.upsert_postings(once, incoming)
    assert set(actions(first).values()) == {"inserted"} and set(actions(second).values()) == {"updated"}
    assert sorted(map(str, once.collect())) == sorted(map(str, second["store"].collect()))
    assert sorted(r.id for r in once.collect()) == [1, 2, 3, 4, 5]


def test_folding_keeps_known_values(spark):
    rows = [
        posting(url="u1", job_id="J", location="Rome", remote_status="remote", description_text="Real", team="a"),
        posting(url="u2", job_id="J", location="unknown location", description_text="Listing-only discovery from X", title="last"),
        posting(url="u3", job_id="K"),
    ]
    result = S.upsert_postings(table(spark, []), batch(spark, rows))
    got = by_id(result["store"])
    assert actions(result) == {1: "inserted", 2: "updated", 3: "inserted"} and sorted(got) == [1, 2]
    assert (got[1]["url"], got[1]["title"], got[1]["location"], got[1]["remote_status"]) == ("u2", "last", "Rome", "remote")
    assert (got[1]["description_text"], got[1]["team"]) == ("Real", "a")


def test_repeated_changes_leave_one_row(spark):
    stored = table(spark, [posting(1, "u1", score=3.5), posting(2, "u2")])
    changes = spark.createDataFrame([("u1", "stale", 2), ("u1", "archived", 1), ("u9", "stale", 1)], "url string, job_status string, at int")
    assert {r.id: r.job_status for r in S.set_status(stored, changes, "at").collect()} == {1: "stale", 2: "active"}
    scores = spark.createDataFrame([("u1", 1.5, ["a"], 1), ("u1", None, None, 2)], "url string, score double, score_explanations array<string>, at int")
    rows = S.write_scores(stored, scores, "at").orderBy("id").collect()
    assert [(r.id, r.score) for r in rows] == [(1, None), (2, None)]


def test_limits_are_the_callers(spark):
    now = T0 + timedelta(days=20)
    stored = table(spark, [posting(i, f"u{i}", discovered_at=T0 + timedelta(hours=i)) for i in range(1, 6)])
    assert S.mark_stale(stored, 7, F.lit(now))["changed"].count() == 5
    cut = S.mark_stale(stored, 7, F.lit(now), limit=2)
    assert {r.id for r in cut["store"].where("job_status = 'stale'").collect()} == {4, 5}
    plan = S.mark_stale(stored, 7, F.lit(now))["store"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_stale_scores_status(spark):
    now = T0 + timedelta(days=20)
    stored = table(spark, [
        posting(1, "u1", last_seen_at=now - timedelta(days=10)),
        posting(2, "u2", last_seen_at=now - timedelta(days=7)),
        posting(3, "u3", last_seen_at=now - timedelta(days=10), job_status="archived"),
    ])
    result = S.mark_stale(stored, 7, F.lit(now))
    assert [r.url for r in result["changed"].collect()] == ["u1"]
    assert {r.url: r.job_status for r in result["store"].collect()} == {"u1": "stale", "u2": "active", "u3": "archived"}
    again = S.upsert_postings(stage(result["store"], "s"), batch(spark, [posting(url="u1")]))
    assert by_id(again["store"])[1]["job_status"] == "active"
    scored = S.rescore(table(spark, [posting(1, "u1", title="Senior Python Engineer", remote_status="remote", seniority="senior"), posting(2, "u2")]))
    assert {r.url: r.score for r in scored["store"].collect()} == {"u1": 50, "u2": -16}
    assert S.maintenance_summary(stale=1, days=7) == "Marked 1 jobs stale using threshold=7 days."


def test_new_matches_only(spark):
    stored = table(spark, [posting(1, "u1", "A")])
    found = batch(spark, [
        posting(url="u1", job_id="Q"), posting(url="u2", job_id="A"), posting(url="u3", job_id="B"),
        posting(url="u4", job_id="B"), posting(url="u3"), posting(url="u4", job_id="C"), posting(url="u9"),
    ])
    fresh = S.insert_new_matches(stored, found, "seq")
    assert sorted(r.seq for r in fresh.collect()) == [3, 6, 7]


def test_prompt_upsert(spark):
    cols = "name string, raw_prompt_text string, created_at timestamp, updated_at timestamp, seq long"
    old = spark.createDataFrame([("a", "one", T0, T0, 1)], cols)
    t1, t2 = T0 + timedelta(days=1), T0 + timedelta(days=2)
    new = spark.createDataFrame([("a", "three", t2, t2, 2), ("a", "two", t1, t1, 1), ("b", "x", t1, t1, 3)], cols)
    got = {r.name: (r.raw_prompt_text, r.created_at, r.updated_at) for r in S.upsert_prompts(old, new).collect()}
    assert got == {"a": ("three", T0, t2), "b": ("x", t1, t1)}


def test_store_columns_are_complete():
    assert set(STORED) | {"id"} == set(POSTING.fieldNames())


def test_repeated_sightings_go_before_their_texts_are_spelled(spark, monkeypatch):
    """The distinct of upsert_moves shuffles numbers, no texts."""
    from rolegrid.catalog import store as catalog

    given = []
    monkeypatch.setattr(catalog.store, "upsert_postings", lambda old, new: given.append(new) or {"store": old})
    catalog.upsert_moves(spark, "/root/testdata/sf0.001")
    plan, exchanges = given[0]._jdf.queryExecution().executedPlan(), 0
    while plan.children().nonEmpty() or plan.nodeName().startswith("AdaptiveSparkPlan"):
        if "Exchange" in plan.nodeName():
            exchanges += 1
            assert "string" not in plan.schema().simpleString()
        plan = plan.executedPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan.children().head()
    assert exchanges == 1
