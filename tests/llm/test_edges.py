"""Every operator meets nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from rolegrid.llm import chat, decontaminate, html, language, line_dedup, mixing, neighbours, simhash, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string"
LONG = "one two three four five six seven eight nine ten eleven twelve " * 400
ROWS = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, LONG, "en", "a"), (4, LONG, "en", "a"), (None, "no id at all here", "en", "b"), (None, None, None, None),
    (5, "gar nicht so schlecht \U0001f600 ß", "de", "b"), (6, "gar nicht so schlecht \U0001f600 ß", "de", "b"), (7, "x", "de", "b"),
]
#: Names that the operators use inside.
CLASHING = ("hits", "row_a", "row_b", "drop_lines", "n_dropped", "keep_id", "keep_key", "keep_n", "f", "mix", "mix_source", "mix_scale", "runs", "run_id", "run_key", "names", "key", "id", "n", "N_Words", "state", "found_")


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("kept") for c in CLASHING})


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(1, LONG[:80]), (2, None), (3, ""), (None, "gar nicht so"), (1, LONG[:80])], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1), (7, 0), (4, 0)], "doc_id long, toxic int")


OPERATORS = {
    "toxicity": lambda d, b: toxicity.with_features(d, toxicity.fit(d, labels(d.sparkSession)), "out"),
    "language": lambda d, b: language.with_language(d, language.fit(d), "out"),
    "decontaminate": lambda d, b: decontaminate.decontaminate(d, b, remove="spans"),
    "line_dedup": lambda d, b: line_dedup.dedup_lines(d, min_docs=2, keep="first"),
    "simhash": lambda d, b: simhash.drop_near_copies(d, radius=8, similarity=0.8),
    "substrings": lambda d, b: substrings.without_repeats(d, "out"),
    "mixing": lambda d, b: mixing.with_sampling(d, "out"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_and_rows_survive(docs, bench, name):
    out = OPERATORS[name](docs, bench)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert len(rows) == (5 if name == "simhash" else len(ROWS))
    assert all(r["hits"] == r["keep_n"] == r["N_Words"] == "kept" for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, bench, name):
    assert OPERATORS[name](docs.limit(0), bench).count() == 0
    assert OPERATORS[name](docs.limit(0), bench.limit(0)).count() == 0


def test_empty_benchmark_and_null_texts(docs, bench):
    state = {(r.doc_id, r.n_words): r for r in decontaminate.contamination(docs, bench).collect()}
    assert state[1, 0].spans == state[2, 0].spans == state[None, 0].spans == []
    assert state[4, 4800].items == ["1"] and state[7, 1].items == []
    assert [(s.start, s.stop) for s in state[5, 6].spans] == [(0, 3)] and state[5, 6].items == []
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(ROWS)


def test_values_of_odd_rows(docs):
    found = {(r.doc_id, r.text): r.out for r in OPERATORS["language"](docs, None).collect()}
    assert found[1, None].lang == found[2, ""].lang == found[3, " \n\t "].lang == "und" and found[1, None].score == 0
    scored = [r.out.score for r in OPERATORS["toxicity"](docs, None).collect()]
    assert all(0 <= s <= 1 for s in scored)
    mixed = OPERATORS["mixing"](docs, None).collect()
    assert all((r.out.probability > 0) == bool((r.text or "").split()) for r in mixed)
    assert all(0 <= r.out.probability <= 1 for r in mixed)
    assert sum(r.out.tokens * r.out.probability for r in mixed) == pytest.approx(0.5 * sum(r.out.tokens for r in mixed))
    kept = {(r.doc_id, r.text): r.out for r in OPERATORS["substrings"](docs, None).collect()}
    assert kept[1, None].bytes == b"" and kept[5, ROWS[7][1]].spans == []
    assert len(kept[4, LONG].bytes) < 200  # a text of one period keeps its first one and what is too short to repeat


def test_pages(spark):
    rows = [(1, "http://h.test/a", None), (2, None, ""), (3, "nonsense", "<p>a<p>b"), (None, "http://h.test/b", "<article>x &amp; <b>y</b></article>" * 2), (1, "http://h.test/a", None), (4, "http://h.test/c", "<div " + "<" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "marks", "key_a", "text")})
    out = sorted((r.page_id or 0, r.text) for r in html.extract(pages).collect())
    assert [t for i, t in out if i in (0, 1, 2, 3)] == ["x & y x & y", "", "", "", "a b"]
    assert html.extract(pages.limit(0)).count() == 0


def test_vectors(spark):
    v = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 1.0, 1.0]), (None, [9.0, 9.0]), (2, [2.0, 0.0]), (10, [])]
    table = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "v", "q", "dim", "rank")})
    out = neighbours.nearest(table, F.lit(True), k=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out] == [(1, 1, 2, 2.0), (1, 2, 3, 2.0), (2, 1, 3, 4.0), (2, 2, 1, 2.0), (3, 1, 2, 4.0), (3, 2, 1, 2.0)]
    assert neighbours.nearest(table.limit(0), F.lit(True)).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, None, None, "a"), (2, 1, "assistant", "é\\"), (2, 0, "a:b\\", "###</turn>\n")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("seq", "kind", "formatted")})
    out = chat.formatted(chat.as_events(talks))
    assert {r.conv_id: chat.read_back(r.formatted) for r in out.collect()} == {1: [("user", ""), ("user", "")], None: [("", "a")], 2: [("a:b\\", "###</turn>\n"), ("assistant", "é\\")]}
    assert chat.digest(chat.formatted(chat.as_events(talks.limit(0)))).count() == 0
