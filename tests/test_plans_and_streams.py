"""Discovery and search end to end, files in and out, streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rolegrid.functions.reports import discovery_line
from rolegrid.operators import dedupe, review
from rolegrid.operators.crawl import walk_pages
from rolegrid.operators.telemetry import with_totals
from rolegrid.plans import discovery
from rolegrid.plans.discovery import DiscoveryOptions, collect_postings, discover
from rolegrid.plans.search import search
from rolegrid.schemas import DECISION_LOG, DISCOVERY_QUERY, POSTING
from rolegrid.sources import metadata, page_store, readers, sinks
from rolegrid.sources import pages as page_source
from rolegrid.sources.page_store import open_page_store, wanted_pages, write_page_store
from rolegrid.sources.tables import BucketTable
from rolegrid.streaming import live
from tests.test_store import batch, posting, table

HOME = "https://boards.greenhouse.io/acme"


def page(jobs, link=""):
    cards = "".join(f'<div class="opening"><a class="opening" href="/acme/jobs/{k}">{t}</a><span class="location">Remote</span></div>' for k, t in jobs)
    return f'<section class="level-0">Acme</section>{cards}{link}'


NEXT = '<nav><a class="pagination__next" href="{}">Next</a></nav>'
DETAIL = "<h1>x</h1><div class='job-location'>Oslo</div><div class='job-employment-type'>Full-time</div><div class='job-description'><p>Deep work.</p></div>"


def pages(spark, rows):
    return spark.createDataFrame([(u, "greenhouse", k, h) for u, k, h in rows], "url string, site string, kind string, html string")


def queries(spark, *starts):
    return spark.createDataFrame([(f"q{i}", "greenhouse", f"Q{i}", s, [], [], []) for i, s in enumerate(starts)], DISCOVERY_QUERY)


def run(spark, rows, max_pages=1, enrich=False, starts=(HOME,), store=None):
    options = DiscoveryOptions(max_pages=max_pages, enrich_greenhouse_details=enrich)
    return discover(queries(spark, *starts), pages(spark, rows), store or table(spark, []), options)


def test_success_with_details(spark):
    out = run(spark, [(HOME, "listing", page([(1, "Dev"), (2, "Ops"), (1, "Dev again")])), (f"{HOME}/jobs/1", "detail", DETAIL)], enrich=True)
    row = out["counters"].select("status", discovery_line().alias("line"), "detail_pages_fetched").first()
    assert (row.status, row.detail_pages_fetched) == ("ok", 2)
    assert row.line == ("queries=1 pages=1 failed_pages=0 jobs=3 inserted=2 updated=0 duplicates=1 "
                        "detail_selected=3 detail_attempts=3 detail_successes=2 detail_failures=1")
    stored = {r.title: r for r in out["store"].collect()}
    assert (stored["Dev"].location, stored["Dev"].employment_type, stored["Dev"].description_text) == ("Oslo", "full_time", "Deep work.")
    assert (stored["Ops"].location, stored["Ops"].company, stored["Ops"].source_job_id) == ("Remote", "Acme", "2")


def test_second_page_and_detail_missing(spark):
    out = run(spark, [(HOME, "listing", page([(1, "Dev")], NEXT.format("?page=2")))], max_pages=2, enrich=True)
    c = out["counters"].first()
    assert (c.pages_fetched, c.pages_failed, c.jobs_parsed, c.jobs_inserted, c.detail_enrichment_selected, c.detail_parse_failures) == (1, 1, 1, 1, 1, 1)


def test_page_walks(spark):
    first = (HOME, "listing", page([(1, "A")], NEXT.format("?page=2")))
    second = (f"{HOME}?page=2", "listing", page([(2, "B")], NEXT.format("?page=3")))
    third = (f"{HOME}?page=3", "listing", page([(3, "C")]))
    cases = [
        ([first, second, third], 3, 3, 3), ([first, second, third], 2, 2, 2), ([first, second, third], 1, 1, 1),
        ([(HOME, "listing", page([(1, "A")]))], 3, 1, 1),
        ([(HOME, "listing", page([(1, "A")], NEXT.format("")) + NEXT.format("#"))], 3, 1, 1),
        ([first, (f"{HOME}?page=2", "listing", page([], NEXT.format("?page=3"))), third], 3, 2, 1),
        ([(HOME, "listing", page([], NEXT.format("?page=2"))), second], 2, 2, 1),
    ]
    for rows, limit, fetched, parsed in cases:
        c = run(spark, rows, max_pages=limit)["counters"].first()
        assert (c.pages_fetched, c.jobs_parsed) == (fetched, parsed)


def test_failed_query_does_not_stop_the_others(spark):
    out = run(spark, [(HOME, "listing", page([(1, "A")]))], starts=("https://boards.greenhouse.io/gone", HOME, HOME))
    rows = {r.query_id: r for r in out["counters"].collect()}
    assert {k: r.status for k, r in rows.items()} == {"q0": "error", "q1": "ok", "q2": "ok"}
    assert (rows["q1"].jobs_inserted, rows["q2"].jobs_inserted, rows["q2"].jobs_updated) == (1, 0, 1)
    total = with_totals(out["counters"]).where("query_id IS NULL").first()
    assert (total.queries_attempted, total.jobs_inserted, total.jobs_updated) == (2, 1, 1)


def test_search(spark):
    registry = spark.createDataFrame([("Acme", "greenhouse", HOME, [], [])], "company_name string, source_site string, board_url string, tags array<string>, location_hints array<string>")
    prompts = spark.createDataFrame(
        [(1, "Find backend roles at Acme, avoid sales."), (2, "Find backend roles at Acme, remote only."), (3, "backend roles"), (4, "roles at Nobody"), (5, " ")], "prompt_id int, raw_prompt_text string")
    rows = [(HOME, "listing", page([(1, "Backend Dev"), (2, "Sales Lead"), (3, "Cook")]))]
    for selective in (False, True):
        out = search(prompts, registry, pages(spark, rows), DiscoveryOptions(selective_detail_enrichment=selective), F.lit(datetime(2026, 1, 1)))
        assert {r.prompt_id: (r.boards, r.discovered, r.matched, r.rejected) for r in out["summary"].collect()} == {1: (1, 3, 2, 1), 2: (1, 3, 0, 3)}
        found = {(r.prompt_id, r.title): r for r in out["evaluated"].collect()}
        assert found[1, "Backend Dev"].match_score == 30
        assert found[1, "Backend Dev"].score_reasons == ["+15 title matched include keyword 'backend'", "+15 company matched include keyword 'acme'"]
        assert found[1, "Sales Lead"].rejection_reasons == ["Excluded keyword 'sales' matched title"]
        errors = {}
        for r in out["errors"].collect():
            errors.setdefault(r.prompt_id, []).append(r.error)
        assert sorted(errors) == [3, 4, 5] and all(len(v) == 1 for v in errors.values())


def test_files(spark, tmp_path):
    (tmp_path / "registry.json").write_text(json.dumps([
        {"company_name": "b", "source_site": "lever", "board_url": "https://b.test", "tags": ["x"], "location_hints": []},
        {"company_name": "A", "source_site": "lever", "board_url": "https://a.test"}, {"company_name": "", "source_site": "lever", "board_url": "https://c.test"}]))
    good, issues = readers.read_registry(spark, str(tmp_path / "registry.json"))
    assert good.count() == 2 and [r.issue for r in issues.collect()] == ["entry[2] invalid: company_name: value must not be empty"]
    sinks.write_registry(good, str(tmp_path / "out"))
    again, none = readers.read_registry(spark, str(tmp_path / "out"))
    assert none.count() == 0 and [(r.company_name, r.tags) for r in again.orderBy("idx").collect()] == [("A", []), ("b", ["x"])]

    assert readers.read_rules(spark).first().exclude_keywords == ["sales", "recruiter", "account executive"]
    (tmp_path / "rules.json").write_text('{"include_keywords": [" a  b "]}')
    rules = readers.read_rules(spark, str(tmp_path / "rules.json"))
    assert rules.first().include_keywords == ["a b"] and rules.first().preferred_companies == []
    assert [(r.rule, r.value) for r in readers.long_form(rules).collect()] == [("include_keywords", "a b")]

    (tmp_path / "queries.json").write_text(json.dumps([
        {"source_site": "Lever", "label": " L ", "start_url": "https://jobs.lever.co/a", "include_keywords": ["k"]}, {"source_site": "lever", "label": "", "start_url": "nope"}]))
    good, bad = readers.read_discovery_queries(spark, str(tmp_path / "queries.json"))
    assert [(r.query_id, r.source_site, r.label, r.location_hints) for r in good.collect()] == [("0", "lever", "L", [])]
    assert bad.first().reasons == ["label: value must not be empty", "start_url: not a web address"]

    folder = tmp_path / "prompts"
    folder.mkdir()
    (folder / "one.txt").write_text("Find roles.\nAt Acme\n")
    (folder / "two.txt").write_text(" \n ")
    good, bad = readers.read_prompts(spark, str(folder))
    assert [(r.name, r.raw_prompt_text) for r in good.collect()] == [("one", "Find roles.\nAt Acme")]
    assert [r.name for r in bad.collect()] == ["two"] and readers.saved_prompt(good, "one").count() == 1

    rows = table(spark, [posting(1, "u1", "J", title='A, "B"', score=7.0), posting(2, "u2")])
    rows.drop("job_status", "last_seen_at").write.parquet(str(tmp_path / "old"))
    assert readers.read_postings(spark, str(tmp_path / "old")).select("job_status").first().job_status == "active"
    log = spark.createDataFrame([(1, "u1", "saved", datetime(2026, 1, 1), None)], DECISION_LOG)
    sinks.append_decisions(log, str(tmp_path / "log"))
    sinks.append_decisions(log.withColumn("seq", F.lit(2)).withColumn("decision", F.lit("skipped")), str(tmp_path / "log"))
    current = review.current_decisions(spark.read.parquet(str(tmp_path / "log")))
    sinks.export_postings_csv(rows, current, str(tmp_path / "csv"))
    got = {r.url: r.asDict() for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()}
    assert got["u1"]["title"] == 'A, "B"' and (got["u1"]["score"], got["u1"]["reviewed"], got["u1"]["decision"]) == ("7", "true", "skipped")
    assert (got["u2"]["score"], got["u2"]["reviewed"]) == (None, "false")
    sinks.export_matches_csv(rows, str(tmp_path / "matches"))
    assert spark.read.option("header", True).csv(str(tmp_path / "matches")).where("reviewed = 'true'").count() == 0


def test_a_value_that_is_no_list_is_an_issue(spark, tmp_path):
    entry = {"company_name": "A", "source_site": "lever", "board_url": "https://a.test"}
    rows = [entry | {"tags": "one"}, entry | {"board_url": "https://b.test", "company_name": "B", "tags": None, "location_hints": ["x", 3]}, entry | {"company_name": "C", "board_url": "https://c.test", "tags": {"a": 1}, "location_hints": 5}]
    (tmp_path / "registry.json").write_text(json.dumps(rows))
    good, issues = readers.read_registry(spark, str(tmp_path / "registry.json"))
    assert [(r.company_name, r.tags, r.location_hints) for r in good.collect()] == [("B", [], ["x", "3"])]
    assert sorted(r.issue for r in issues.collect()) == ["entry[0] invalid: tags: value must be a list", "entry[2] invalid: tags: value must be a list; location_hints: value must be a list"]
    (tmp_path / "queries.json").write_text(json.dumps([{"source_site": "lever", "label": "L", "start_url": "https://jobs.lever.co/a", "include_keywords": "k"}]))
    good, bad = readers.read_discovery_queries(spark, str(tmp_path / "queries.json"))
    assert good.count() == 0 and bad.first().reasons == ["include_keywords: value must be a list"]
    (tmp_path / "rules.json").write_text('{"include_keywords": "python"}')
    with pytest.raises(ValueError, match="include_keywords: value must be a list"):
        readers.read_rules(spark, str(tmp_path / "rules.json"))


def test_metadata(spark):
    rows = spark.createDataFrame([('{"team":"t","score":true,"z":{"a":1}}',), ('{"score":"12","db_id":3}',), ('{"score":12.5,"score_explanations":["+1"]}',), ("{}",)], "metadata_json string")
    got = [(r.team, r.score, r.score_explanations, r.extra) for r in metadata.decode_metadata(rows).collect()]
    assert got == [("t", None, None, '{"score":true,"z":{"a":1}}'), (None, None, None, '{"score":"12"}'), (None, 12.5, ["+1"], None), (None, None, None, None)]
    again = metadata.encode_metadata(metadata.decode_metadata(rows))
    assert [r.metadata_json for r in again.collect()][:3] == ['{"score":true,"team":"t","z":{"a":1}}', '{"score":"12"}', '{"score":12.5,"score_explanations":["+1"]}']


def test_upsert_stream_is_idempotent(spark, tmp_path):
    source, target = str(tmp_path / "in"), BucketTable(spark, str(tmp_path / "store"), buckets=4)
    batch(spark, [posting(url="https://x.test/1/?utm_a=b", job_id="A"), posting(url="https://x.test/2")]).write.parquet(source)
    schema = spark.read.parquet(source).schema

    def go(checkpoint):
        live.stream_upserts(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / checkpoint)).awaitTermination()

    go("c1")
    assert sorted(r.url for r in target.read().collect()) == ["https://x.test/1", "https://x.test/2"]
    batch(spark, [posting(url="https://x.test/9", job_id="A", title="moved")]).withColumn("seq", F.lit(9).cast("long")).write.mode("append").parquet(source)
    go("c1")
    assert sorted((r.id, r.url) for r in target.read().collect()) == [(1, "https://x.test/9"), (2, "https://x.test/2")]
    batch(spark, [posting(url="https://x.test/7")]).withColumn("seq", F.lit(10).cast("long")).write.mode("append").parquet(source)
    go("c2")  # a new checkpoint reads all again under numbers of its own, so nothing is skipped
    assert sorted((r.id, r.url) for r in target.read().collect()) == [(1, "https://x.test/9"), (2, "https://x.test/2"), (3, "https://x.test/7")]


def test_decision_stream_matches_batch(spark, tmp_path):
    rows = [(i, f"u{i % 3}", ("saved", "skipped")[i % 2], datetime(2026, 1, 1 + i), None) for i in range(8)]
    spark.createDataFrame(rows, DECISION_LOG).repartition(3).write.parquet(str(tmp_path / "log"))
    stream = live.stream_current_decisions(spark.readStream.schema(DECISION_LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("decisions").trigger(availableNow=True).start()
    query.awaitTermination()
    expected = review.current_decisions(spark.createDataFrame(rows, DECISION_LOG))
    assert sorted(map(str, spark.table("decisions").collect())) == sorted(map(str, expected.collect()))


def test_only_visited_pages_are_read(spark):
    """A page that no walk stands on never reaches the page reader; a page of two walks reaches it once."""
    calls = spark.sparkContext.accumulator(0)

    def read(html):
        calls.add(1)
        if "untouched" in html:
            raise ValueError("not to be read")
        return [{"title": html, "href": "/j/1"}]

    page_source.register_extractor("own", read)
    try:
        link = '<a rel="next" href="{}">x</a>'.format
        rows = [("https://o.test/1", "one" + link("/2")), ("https://o.test/2", "two" + link("/3")), ("https://o.test/3", "three" + link("/1")), ("https://o.test/9", "nine" + link("/2"))]
        rows += [(f"https://o.test/x{i}", "untouched") for i in range(40)]
        stored = write_page_store(spark.createDataFrame([(u, "own", "listing", h) for u, h in rows], "url string, site string, kind string, html string"), buckets=4)
        starts = spark.createDataFrame([("a", "own", "A", "https://o.test/1", [], [], []), ("b", "own", "B", "https://o.test/9", [], [], [])], DISCOVERY_QUERY)
        visits = collect_postings(starts, stored, DiscoveryOptions(max_pages=None))["visits"]
        got = sorted((r.query_id, r.hop, r.url[-1], r.stop) for r in visits.collect())
        assert got == [("a", 1, "1", None), ("a", 2, "2", None), ("a", 3, "3", "repeated_page"), ("b", 1, "9", None), ("b", 2, "2", None), ("b", 3, "3", None), ("b", 4, "1", "repeated_page")]
        assert calls.value == 4
    finally:
        page_source._EXTRACTORS.pop("own")


def test_stored_pages_are_not_shuffled(spark):
    rows = [(f"https://o.test/{i}", "greenhouse", "listing", "text") for i in range(50)]
    stored = write_page_store(spark.createDataFrame(rows, "url string, site string, kind string, html string"), buckets=4)
    wanted = stored.where("url like '%7'").select("url", "site")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = wanted_pages(stored, spark.createDataFrame(wanted.collect(), wanted.schema))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 5
        # only the wanted urls are shuffled, nothing between the scan of the pages and the choice of a version
        assert "Bucketed: true" in plan and "Exchange" not in plan[: plan.index("FileScan")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_page_versions_are_defined(spark, tmp_path):
    rows = [("u", "s", "old", datetime(2026, 1, 1)), ("u", "s", "b", datetime(2026, 1, 2)), ("u", "s", "a", datetime(2026, 1, 2)), ("u", "s", "none", None), ("v", "s", "x", None), ("v", "s", "x", None)]
    pages_ = spark.createDataFrame(rows, "url string, site string, html string, fetched_at timestamp")
    wanted = pages_.select("url", "site").distinct()
    first = {r.url: r.html for r in wanted_pages(pages_, wanted).collect()}
    assert first["u"] in ("a", "b") and first["v"] == "x"
    path = str(tmp_path / "pages")
    for seed in range(3):
        stored = write_page_store(pages_.orderBy(F.rand(seed)), f"{path}{seed}", buckets=2)
        again = open_page_store(stored, f"{path}{seed}", 2)
        assert {r.url: r.html for r in wanted_pages(again, wanted).collect()} == first


def test_walk_in_a_given_index_without_bound(spark):
    rows = [(f"p{i}", "s", f"p{i + 1}" if i < 20 else None, 1) for i in range(21)] + [("loop", "s", "loop", 1)]
    index = spark.createDataFrame(rows, "url string, site string, next_url string, n_items int")
    starts = spark.createDataFrame([("a", "s", "p0"), ("b", "s", "p15"), ("c", "s", "loop"), ("d", "s", "gone")], "query_id string, source_site string, start_url string")
    got = {}
    for r in walk_pages(starts, index, None).orderBy("hop").collect():
        got.setdefault(r.query_id, []).append((r.url, r.stop))
    assert {q: (len(v), v[-1][1]) for q, v in got.items()} == {"a": (21, "no_next"), "b": (6, "no_next"), "c": (1, "repeated_page"), "d": (1, "start_missing")}


def test_small_stores_have_few_buckets(spark, monkeypatch):
    """Each hop of a walk opens every bucket, so their number follows the text of the pages, not the shuffle partitions."""
    rows = spark.range(300).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("own").alias("site"), F.repeat(F.lit("x"), 1000).alias("html"))
    cores = spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 10 * cores + 100)
    try:
        stored = write_page_store(rows)
        assert page_store.bucket_count(rows) == cores and stored.rdd.getNumPartitions() <= cores and stored.count() == 300
        monkeypatch.setattr(page_store, "BUCKET_BYTES", 300_000 // (3 * cores))
        assert page_store.bucket_count(rows) == 3 * cores
        assert page_store.bucket_count(rows.limit(0)) == cores
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_walks_are_read_ahead_with_the_same_visits(spark, monkeypatch):
    """Walks over a good part of a store scan it once and not at each hop; every kind of end is the same either way."""
    def read(html):
        if "broken" in html:
            raise ValueError("broken page")
        return [] if "empty" in html else [{"title": html[:5], "href": "/j"}]

    def chain(name, texts, after=None):
        urls = [f"https://o.test/{name}{i}" for i in range(len(texts))]
        links = [*urls[1:], after]
        return [(u, t + (f'<a rel="next" href="{n}">x</a>' if n else "")) for u, t, n in zip(urls, texts, links)]

    page_source.register_extractor("own", read)
    try:
        rows = chain("long", ["card"] * 12) + chain("loop", ["card"] * 5, "https://o.test/loop2") + chain("self", ["empty"], "https://o.test/self0")
        rows += chain("gap", ["empty", "empty", "card", "card", "empty", "card"]) + chain("gone", ["card"] * 3, "https://o.test/nowhere")
        rows += chain("bad", ["card", "card", "broken", "card"]) + chain("badstart", ["broken"]) + chain("wide", ["card"] * 4, "https://o.test/long0") + chain("loopgap", ["card", "empty", "card"], "https://o.test/loopgap0")
        stored = write_page_store(spark.createDataFrame([(u, "own", "listing", h) for u, h in rows], "url string, site string, kind string, html string"), buckets=2)
        names = ["long0", "long0", "long7", "loop0", "loop3", "self0", "gap0", "gap3", "gone0", "bad0", "badstart0", "wide0", "loopgap0", "loopgap2", "missing"]
        starts = spark.createDataFrame([(f"{i:02d}{n}", "own", "A", f"https://o.test/{n}", [], [], []) for i, n in enumerate(names)], DISCOVERY_QUERY)
        added = []
        add = discovery.Rounds.add
        monkeypatch.setattr(discovery.Rounds, "add", lambda self, df: added.append(1) or add(self, df))

        def visits(limit, share, after):
            monkeypatch.setattr(discovery, "AHEAD_SHARE", share)
            monkeypatch.setattr(discovery, "AHEAD_AFTER", after)
            added.clear()
            reader = discovery.ListingReader(stored)
            return sorted(map(str, walk_pages(starts, reader, limit).collect())), len(added)

        for limit in (None, 6):
            (plain, n_plain), (ahead, n_ahead) = visits(limit, 0, 1000), visits(limit, 16, 1000)
            assert ahead == plain and n_ahead == 1 and n_plain >= (16 if limit is None else 6)
        assert {s.split("stop=")[1][:-1] for s in plain} >= {"'no_next'", "'repeated_page'", "'empty_page'", "'page_missing'", "'page_unreadable'", "'start_unreadable'", "'start_missing'", "'page_limit'"}
        # few walks turn to it when their hops have cost more
        assert visits(None, 0, 3) == (visits(None, 0, 1000)[0], 7)
    finally:
        page_source._EXTRACTORS.pop("own")


def test_prompts_of_a_search_are_dealt_to_all_cores(spark, monkeypatch, tmp_path):
    """A table that is one file of one row group would be parsed in one task."""
    from rolegrid.catalog import prompts as catalog_prompts

    for name, columns in (("orders", "id o_orderkey, id o_custkey"), ("lineitem", "id l_orderkey, id l_partkey"), ("part", "id p_partkey"), ("customer", "id c_custkey, id c_nationkey")):
        spark.range(40).selectExpr(*columns.split(", ")).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    asked = []
    monkeypatch.setattr(catalog_prompts, "stage", lambda df, label: df)
    monkeypatch.setattr(catalog_prompts, "write_page_store", lambda pages: pages)
    monkeypatch.setattr(catalog_prompts, "search", lambda prompts, *rest, **options: asked.append(prompts))
    catalog_prompts._searched(spark, str(tmp_path))
    assert asked[0].rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and asked[0].count() == 40


def test_few_duplicates_leave_the_other_postings_where_they_are(spark, monkeypatch):
    """The rounds see rows that share a key only, and no kept posting is written or shuffled again."""
    seen, first = [], dedupe._round
    monkeypatch.setattr(dedupe, "_round", lambda pairs, contract: seen.append(pairs.count()) or first(pairs, contract))
    cards = [(i, f"T{i}") for i in range(40)]
    out = collect_postings(queries(spark, HOME), pages(spark, [(HOME, "listing", page([*cards, (7, "T7")]))]), DiscoveryOptions())
    assert out["postings"].count() == 40 and out["parsed"].count() == 41
    assert seen == [6]  # two rows with three keys each
    plan = out["postings"]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "strategy=broadcast" in plan


def test_search_spells_criteria_once_a_prompt(spark, monkeypatch):
    """What a prompt scores is spelled before it meets postings; a pair carries its own wishes, not those of the walk."""
    from rolegrid.operators import matching

    registry = spark.createDataFrame([("Acme", "greenhouse", HOME, [], [])], "company_name string, source_site string, board_url string, tags array<string>, location_hints array<string>")
    prompts = spark.createDataFrame([(1, "Find backend roles at Acme."), (2, "Find any roles at Acme.")], "prompt_id int, raw_prompt_text string")
    spelled, judge = [], matching.hard_filter
    monkeypatch.setattr(matching, "hard_filter", lambda pairs, now=None: spelled.append("criteria" in pairs.columns) or judge(pairs, now))
    out = search(prompts, registry, pages(spark, [(HOME, "listing", page([(1, "Backend Dev"), (2, "Cook")]))]), now=F.lit(datetime(2026, 1, 1)))
    assert spelled == [True] and "criteria" not in out["evaluated"].columns and "include_keywords" not in out["evaluated"].columns
    assert {(r.prompt_id, r.title): r.match_score for r in out["evaluated"].collect()} == {(1, "Backend Dev"): 30, (1, "Cook"): 15, (2, "Backend Dev"): 15, (2, "Cook"): 15}


def test_canonical_urls_are_spelled_once(spark, monkeypatch):
    """A discovery run spells the canonical url of a posting when it is parsed, and not again for keys and kept rows."""
    monkeypatch.setattr(dedupe, "canonicalize_postings", lambda postings: postings)
    card = '<div class="opening"><a class="opening" href="https://www.boards.greenhouse.io/a/jobs/7/?utm_source=b">T</a></div>'
    stored = spark.createDataFrame([("https://boards.greenhouse.io/a", "greenhouse", card)], "url string, site string, html string")
    starts = spark.createDataFrame([("q", "greenhouse", "A", "https://boards.greenhouse.io/a", [], [], [])], DISCOVERY_QUERY)
    found = collect_postings(starts, stored)
    assert [r.url for r in found["postings"].collect()] == ["https://boards.greenhouse.io/a/jobs/7"]
    assert [r.url for r in found["parsed"].collect()] == ["https://www.boards.greenhouse.io/a/jobs/7/?utm_source=b"]
