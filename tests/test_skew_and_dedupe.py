"""Balanced joins and ordered duplicate removal."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolegrid.operators import dedupe as D
from rolegrid.operators import skew


def scan(rows):
    used, kept = set(), []
    for order, keys in sorted(rows):
        keys = {k for k in keys if k is not None}
        if used.isdisjoint(keys):
            kept.append(order)
            used |= keys
    return kept


def frame(spark, rows):
    return spark.createDataFrame(rows, "ord long, keys array<string>")


def kept(spark, rows, **options):
    return sorted(r.ord for r in D.greedy_keep(frame(spark, rows), "ord", F.array_compact("keys"), **options).collect())


def test_chained_example(spark):
    rows = [(1, ["s1", "u1", "f1"]), (2, ["s1", "u2", "f2"]), (3, [None, "u2", "f3"]), (4, [None, "u9", "f3"]), (5, ["s5", "u5", "f5"]), (6, [])]
    assert kept(spark, rows) == [1, 3, 5, 6]


def test_random_rows_match_the_scan(spark):
    rng = random.Random(7)
    rows = [(i, [f"s{rng.randint(0, 120)}", f"u{rng.randint(0, 200)}", None if i % 7 == 0 else f"f{rng.randint(0, 300)}"]) for i in range(400)]
    assert kept(spark, rows) == scan(rows)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), max_size=3), max_size=14))
def test_any_rows_match_the_scan(spark, lists):
    rows = list(enumerate(lists))
    assert kept(spark, rows) == scan(rows)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """A chain of 20,000 rows, each waiting for the one before: three rounds, and jumps by its logarithm."""
    rounds, written = [], []
    monkeypatch.setattr(D, "_round", lambda pairs, contract, plain=D._round: rounds.append(contract) or plain(pairs, contract))
    monkeypatch.setattr(D, "stage", lambda df, label, plain=D.stage: written.append(label) or plain(df, label))
    rows = [(i, [f"c{i}", f"c{i + 1}"]) for i in range(20_000)]
    assert kept(spark, rows) == list(range(0, 20_000, 2))
    assert len(rounds) <= 4 and written.count("ways") <= 18


@pytest.mark.parametrize("seed", range(2))
def test_chains_with_branches_equal_a_scan(spark, seed):
    """Chains that meet, fork and end at crowded keys."""
    rng = random.Random(seed)
    rows = [(i, [f"c{i}", f"c{max(0, i - rng.choice([1, 1, 1, 2, 5]))}", *(["hub"] if rng.random() < 0.03 else [])]) for i in range(60)]
    rng.shuffle(rows)
    assert kept(spark, rows, contract_after=seed) == scan(rows)


def test_hot_key(spark, monkeypatch):
    """One key on a third of the rows; heavy keys are salted from 50 rows on."""
    monkeypatch.setattr(skew.heavy_keys, "__defaults__", ("n", 50))
    rng = random.Random(3)
    rows = [(i, ["hot" if i % 3 == 0 else f"s{rng.randint(0, 300)}", f"u{rng.randint(0, 500)}"]) for i in range(900)]
    assert kept(spark, rows) == scan(rows)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 10}") for i in range(300)] + [(999, None)], "id long, k string")
    right = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("k0", "z"), ("kz", "w")], "k string, v string")
    heavy = skew.heavy_keys(skew.key_counts(left, "k"), "k", min_rows=50)
    assert [r.k for r in heavy.collect()] == ["hot"]
    plain = left.join(right, "k", how)
    salted = skew.salted_join(left, right, "k", how, heavy, spread="id", buckets=5)
    order = sorted(plain.columns)
    assert sorted(map(str, salted.select(order).collect())) == sorted(map(str, plain.select(order).collect()))


def test_no_heavy_keys_means_the_plain_join(spark):
    left = spark.createDataFrame([(1, "a")], "id long, k string")
    assert skew.heavy_keys(skew.key_counts(left, "k"), "k") is None


def postings(spark, rows):
    cols = "ord long, q string, source_site string, source_job_id string, url string, title string, company string, location string"
    return spark.createDataFrame(rows, cols)


ROWS = [
    (1, "q1", "lever", "A-1", "https://www.jobs.lever.co/x/1/?utm_source=a", "Dev", "Acme", "Oslo"),
    (2, "q1", "lever", "a-1", "https://jobs.lever.co/x/2", "Dev 2", "Acme", "Oslo"),
    (3, "q1", "lever", None, "https://jobs.lever.co/x/1#top", "Other", "Acme", "Oslo"),
    (4, "q1", "lever", None, "https://jobs.lever.co/x/4", " DEV  ", "acme", "oslo"),
    (5, "q1", "lever", None, "https://jobs.lever.co/x/5", "Dev", "Acme", "Bergen"),
    (6, "q2", "lever", "A-1", "https://jobs.lever.co/x/1", "Dev", "Acme", "Oslo"),
]


def test_postings_by_id_url_and_text(spark):
    got = D.dedupe_postings(postings(spark, ROWS), "ord")
    assert {r.ord: r.url for r in got.collect()} == {1: "https://jobs.lever.co/x/1", 5: "https://jobs.lever.co/x/5"}
    scoped = D.dedupe_postings(postings(spark, ROWS), "ord", scope="q")
    assert sorted(r.ord for r in scoped.collect()) == [1, 5, 6]


def test_reasons_and_links(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", "x"), (5, None, "y")], "id long, k1 string, k2 string")
    keys = {"first": F.col("k1"), "second": F.col("k2")}
    reasons = {r.id: (r.kept, r.rule) for r in D.duplicate_reasons(rows, "id", keys).collect()}
    assert reasons == {2: (1, "first"), 4: (1, "second"), 5: (3, "second")}
    links = {(r.id, r.first, r.rule) for r in D.duplicate_links(rows, "id", keys).collect()}
    assert links == {(2, 1, "first"), (3, 2, "second"), (4, 1, "second"), (5, 2, "second")}
    first = D.first_seen(rows, F.col("k2"), "id")
    assert sorted(r.id for r in first.collect()) == [1, 2]


def test_pages_of_one_title_are_the_same_on_any_host(spark, tmp_path):
    from rolegrid.catalog.identity import dedupe_pages

    rows = [(1, "https://a.test/x", "One"), (2, "https://b.test/y", " ONE "), (3, "https://c.test/z", "Two"), (4, "https://a.test/x/?utm_source=f", "Three")]
    pages = spark.createDataFrame([(i, u, f"<title>{t}</title>") for i, u, t in rows], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(r.page_id for r in dedupe_pages(spark, str(tmp_path)).collect()) == [1, 3]


def test_keys_that_many_rows_of_either_side_hold_are_spread(spark):
    left = spark.createDataFrame([(i, "a" if i < 90 else f"k{i}") for i in range(100)], "i int, k string")
    right = spark.createDataFrame([(j, "b" if j < 90 else f"k{j}") for j in range(100)] + [(200, "a"), (201, "a")], "j int, k string").union(spark.createDataFrame([(300, "a")], "j int, k string"))
    left = left.union(spark.createDataFrame([(500, "b"), (501, "b")], "i int, k string"))
    heavy = [skew.heavy_keys(skew.key_counts(side, "k"), "k", min_rows=50) for side in (left, right)]
    assert [[r.k for r in h.collect()] for h in heavy] == [["a"], ["b"]]
    whole = sorted(map(tuple, left.join(right, "k").collect()))
    joined = skew.two_sided_join(left, right, "k", *heavy, spread=("i", "j"), buckets=8)
    assert sorted(map(tuple, joined.collect())) == whole and len(whole) == 90 * 3 + 90 * 2 + 10
    both = skew.two_sided_join(left, right, "k", heavy[0].union(heavy[1]), heavy[1], spread=("i", "j"), buckets=8)
    assert sorted(map(tuple, both.collect())) == whole
    salts = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in salts


@pytest.mark.parametrize("few", [4, 10**9])
def test_survivors_do_not_depend_on_the_search_for_shared_keys(spark, monkeypatch, few):
    rng = random.Random(few)
    rows = [(i, rng.sample([f"k{rng.randrange(150)}", f"k{rng.randrange(150)}", f"u{i}", f"v{i}"], rng.randrange(4))) for i in range(200)]
    monkeypatch.setattr(D, "FEW", few)
    want, taken = [], set()
    for i, keys in rows:
        if not taken.intersection(keys):
            want.append(i)
            taken.update(keys)
    stay = kept(spark, rows)
    dropped = sorted(r.ord for r in D.greedy_drop(frame(spark, rows), "ord", F.array_compact("keys")).collect())
    assert stay == want and sorted(stay + dropped) == list(range(200))
