"""Listing, detail and next-link extraction. Pages are generated from the rule tables, with field values, element
choice, wrapping and order drawn at random; what was put in has to come out."""

import random
from datetime import datetime

import pytest

from rolegrid.sources import markup
from rolegrid.sources import pages as P

#: Per site: a board url, links of cards with the id each one carries, fields whose value the listing shows.
SITES = {
    "greenhouse": ("https://boards.greenhouse.io/quolt", "https://boards.greenhouse.io/quolt/jobs/{n}", {"location": "location", "department": "team"}),
    "lever": ("https://jobs.lever.co/quolt", "https://jobs.lever.co/quolt/{n}", {"location": "location", "department": "team"}),
    "linkedin": ("https://www.linkedin.com/jobs", "https://www.linkedin.com/jobs/view/{n}/", {"company": "company", "location": "location", "workplace_type": "workplace_type"}),
    "indeed": ("https://www.indeed.com/jobs", "https://www.indeed.com/viewjob?jk={n}", {"company": "company", "location": "location", "snippet": "snippet"}),
}
LAST_WINS = {"greenhouse"}


def choose(rng, tokens):
    """One class name that satisfies a rule."""
    return tokens if isinstance(tokens, str) else rng.choice(sorted(tokens))


def element(rng, tag, cls, body, attrs=""):
    other = rng.choice(["", "u-1 ", "wide tall "])
    return f'<{tag} class="{other}{cls}"{attrs}>{body}</{tag}>'


def wrapped(rng, body):
    """The same content somewhat deeper, in elements that no rule names."""
    for _ in range(rng.randrange(3)):
        tag = rng.choice(["em", "section", "figure", "b"])
        body = f"<{tag}>{body}</{tag}>"
    return body


def card(rng, site, number, values):
    rules = markup.LISTING_RULES[site]
    link = SITES[site][1].format(n=number)
    tag, classes, _ = rules["cards"][0]
    title = values["title"]
    parts = []
    for field, tags, tokens in rules["fields"]:
        if field in values and field != "title" and tokens is not None and values.get(field) not in [v for f, v in parts if f == field]:
            if not any(f == field for f, _ in parts):
                parts.append((field, element(rng, rng.choice(sorted(tags)), choose(rng, tokens), values[field])))
    fields = [wrapped(rng, p) for _, p in parts]
    rng.shuffle(fields)
    if rules["link_title"]:
        body = "".join([f'<a class="{choose(rng, rules["link"])}" href="{link}">{title}</a>', *fields])
    else:
        heading = next(f for f in rules["fields"] if f[0] == "title")
        name = element(rng, rng.choice(sorted(heading[1])), choose(rng, heading[2]), title)
        body = f'<a class="{choose(rng, rules["link"])}" href="{link}">{wrapped(rng, name)}</a>{"".join(fields)}'
    return element(rng, tag, choose(rng, classes), body)


def listings(spark, rows):
    df = spark.createDataFrame([(f"http://page/{i}", site, board, html) for i, (site, board, html) in enumerate(rows)], "url string, site string, board_url string, html string")
    return [r.asDict() for r in P.extract_listings(df).orderBy("page_url", "position").collect()]


@pytest.mark.parametrize("site", SITES)
def test_generated_listings(spark, site):
    rng = random.Random(site)
    board, _, shown = SITES[site]
    rows, want = [], []
    for page in range(6):
        cards = []
        for i in range(rng.randint(1, 4)):
            number = f"{page}{i}7"
            values = {"title": f"Role {number}"} | {f: f"{f} {number}" for f in shown if rng.random() < 0.8}
            cards.append(card(rng, site, number, values))
            want.append((number, values))
        cards.insert(rng.randrange(len(cards) + 1), element(rng, markup.LISTING_RULES[site]["cards"][0][0], choose(rng, markup.LISTING_RULES[site]["cards"][0][1]), "no link in here"))
        rows.append((site, board, "<body>" + "<hr>".join(cards) + "</body>"))
    got = listings(spark, rows)
    assert [(r["source_job_id"], r["title"]) for r in got] == [(n, v["title"]) for n, v in want]
    for row, (number, values) in zip(got, want):
        for field, column in shown.items():
            if field in values:
                assert row[column] == values[field], (site, field)
        if "location" not in values:
            assert row["location"] == "Unknown location"


def test_titles_of_squeezed_text_and_references(spark):
    html = card(random.Random(1), "greenhouse", "9", {"title": "Night\n  &amp; Day ", "location": " Graz ,  AT "})
    row = listings(spark, [("greenhouse", SITES["greenhouse"][0], html)])[0]
    assert (row["title"], row["location"], row["company"]) == ("Night & Day", "Graz , AT", "Quolt")
    assert row["description_text"].startswith("Listing-only discovery") and row["employment_type"] == row["seniority"] == "unknown"


@pytest.mark.parametrize("shown, status", [("Hybrid", "hybrid"), ("On-site", "onsite"), ("Remote", "remote")])
def test_workplace_and_time_of_a_card(spark, shown, status):
    rng = random.Random(status)
    body = card(rng, "linkedin", "55", {"title": "Tiler", "location": "Kiel", "workplace_type": shown}).replace("</a>", '</a><time datetime="2025-11-30">old</time>', 1)
    row = listings(spark, [("linkedin", SITES["linkedin"][0], body)])[0]
    assert (row["remote_status"], row["posted_at"], row["posted_time"]) == (status, datetime(2025, 11, 30), "old")


def test_unknown_site_has_no_listings_until_an_extractor_is_registered(spark):
    assert listings(spark, [("plainboard", None, "<b>x</b>")]) == []
    P.register_extractor("plainboard", lambda html: [{"href": "/a/1", "title": html.strip("<b>/")}])
    row = listings(spark, [("plainboard", "http://h.test/b", "<b>x</b>")])[0]
    assert (row["url"], row["title"], row["source_job_id"]) == ("http://h.test/a/1", "x", "1")
    assert P.site_capabilities("indeed") == {"supports_listing_html_parse": True, "supports_detail_html_parse": False}


#: What a detail page may show, and the columns it ends in.
DETAIL_VALUES = {"title": "Glazier", "company": "Quolt", "location": "Gent", "department": "Halls", "employment": "Part-time", "workplace": "Hybrid"}
DETAIL_COLUMNS = {"title": "title", "company": "company", "location": "location", "department": "team"}


@pytest.mark.parametrize("site, seed", [(s, i) for s in ("greenhouse", "lever") for i in range(4)])
def test_generated_details(spark, site, seed):
    rng = random.Random(f"{site}{seed}")
    rules = markup.DETAIL_RULES[site]
    parts, used = [], set()
    for field, tags, tokens, _ in rules["fields"]:
        if field in used:
            continue
        used.add(field)
        tag = rng.choice(sorted(tags - {"div"} or tags))
        mark = "" if tokens is None else rng.choice(["x-", ""]) + tokens[0]
        parts.append(f'<{tag} {rng.choice(["class", "id"])}="{mark}">{DETAIL_VALUES[field]}</{tag}>')
    rng.shuffle(parts)
    block = rng.choice(sorted(rules["zone"][0] - {"div"}))
    text = f'<{block} class="{rules["zone"][1][0]}"><p>Cut   panes.</p><style>p{{}}</style><ol><li>Fit</li><li>Seal</li></ol></{block}>'
    df = spark.createDataFrame([(SITES[site][1].format(n=31), site, "".join(parts) + text)], "url string, site string, html string")
    row = P.extract_details(df).first().asDict()
    assert {c: row[c] for c in DETAIL_COLUMNS.values()} == {c: DETAIL_VALUES[f] for f, c in DETAIL_COLUMNS.items()}
    assert (row["employment_type"], row["remote_status"], row["source_job_id"]) == ("part_time", "hybrid", "31")
    assert row["description_text"] == "Cut panes. Fit Seal"


def test_detail_insights_fill_the_slots(spark):
    rules = {f[0]: f for f in markup.DETAIL_RULES["linkedin"]["fields"]}
    notes = "".join(f'<li class="{rules["insight"][2][0]}">{x}</li>' for x in ("Remote", "Contract"))
    html = f'<h1>Miller</h1><span id="{rules["company"][2][-1]}">Quolt</span>{notes}<time datetime="2025-01-02">a while</time>'
    df = spark.createDataFrame([("https://www.linkedin.com/jobs/view/77/", "linkedin", html)], "url string, site string, html string")
    row = P.extract_details(df).first()
    assert (row.title, row.company, row.remote_status, row.employment_type, row.source_job_id) == ("Miller", "Quolt", "remote", "contract", "77")


def test_detail_without_content_uses_the_unknown_texts(spark):
    df = spark.createDataFrame([("https://x.test/", "greenhouse", "<p>nothing</p>")], "url string, site string, html string")
    row = P.extract_details(df).first()
    assert (row.title, row.company, row.location) == ("Unknown title", "Unknown company", "Unknown location")
    assert (row.employment_type, row.source_job_id) == ("unknown", None) and row.description_text.startswith("Listing-only")


def test_next_links(spark):
    cases = []
    for i, (hint, href, target) in enumerate([("class", "?p=4", "http://h.test/b?p=4"), ("rel", "d/e", "http://h.test/d/e"), ("aria-label", "//o.test/z", "http://o.test/z"), ("title", "/r", "http://h.test/r"), ("data-qa", "https://q.test", "https://q.test")]):
        cases.append((f'<a href="/first">1</a><a {hint}="{"go-" * (i % 2)}next" href="{href}">»</a>', target))
    cases += [("<a href='/up'>back</a>", None), ("", None), ('<a href="/t">Next page</a><a rel="next" href="/u">x</a>', "http://h.test/t")]
    df = spark.createDataFrame([("http://h.test/b", i, h) for i, (h, _) in enumerate(cases)], "url string, i int, html string")
    got = df.select("i", P.resolve_url("url", P.next_href("html")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [e for _, e in cases]


class Events:
    """Notes what a walker is fed."""

    def __init__(self):
        self.seen = []

    def start(self, tag, attrs):
        self.seen.append((tag, dict(attrs)))

    def end(self, tag):
        self.seen.append(tag)

    def data(self, data):
        self.seen.append([data])


PIECES = [
    '<div class="a b">', "</div>", "text &amp; more", " ", "<br/>", "<br />", "<!-- c -->", "<!doctype html>", "<script>if (a<b) {}</script>",
    '<STYLE type="x">p{} </b></style>', '<a href="/x?a=1&amp;b=2" x>', "<a href='y' Class=z>", "</a>", "<", ">", "&", "&#60;", "&lt", '"', "'", "=", "</", "/>",
    "<!--", "-->", "<script", "</script>", "<b disabled>", '<img src="a>b"/>', "<p/ >", "</p x>", "<style>", "</ script>", '<i a="1" a="2">', '<i a="1"b="2">',
    "\x0b", "\xa0", '<script src="a"></SCRIPT>', "<?x?>", "<!---->", "<!--->", "<title>a<b></title>", "<script/>", "</script >"]


def test_pages_of_tags_and_texts_are_cut_at_their_brackets():
    page = '<div class="opening">a &amp; b<br/><A href="/x?a=1&amp;b=2" title=\'t\'>x > y</a ></div> end'
    assert markup._cut(page) == [
        (1, "div", {"class": "opening"}), (0, "a & b", None), (1, "br", {}), (2, "br", None),
        (1, "a", {"href": "/x?a=1&b=2", "title": "t"}), (0, "x > y", None), (2, "a", None), (2, "div", None), (0, " end", None)]
    for other in ('<a title="x>y">', '<a title="x<y">', "<script>a</script>", "<STYLE/>", "<!-- c -->", "<p a=b>", "a < b", "<p", "<>"):
        assert markup._cut(other) is None, other
    for i in range(markup.KEPT + 9):
        markup._cut(f'<a href="/{i}">')
    assert len(markup._PIECES) <= markup.KEPT


def test_whole_addresses_are_links_as_they_are(monkeypatch):
    links = ["https://a.test/x?y=1", "https://a.test", "http://a.test:8/x/../y", "https://a.test/x;p", "https://a.test/?", "HTTPS://a.test/", "https://[a/", "/x", "", None]
    bases = ["https://b.test/q/", "https://[b/", "", None]
    short = [markup.resolve(b, h) for b in bases for h in links]
    asked = []
    monkeypatch.setattr(markup, "urljoin", lambda b, h, join=markup.urljoin: asked.append(h) or join(b, h))
    assert markup.resolve("https://b.test/q/", "https://a.test/x?y=1") == "https://a.test/x?y=1" and not asked
    monkeypatch.setattr(markup, "_WHOLE", lambda url: None)
    assert short == [markup.resolve(b, h) for b in bases for h in links]


def test_plain_markup_is_read_as_the_parser_reads_it():
    """Pages cut by one expression give the events of the full parser; pages with other markup are left to it."""
    rng, plain = random.Random(7), 0
    for _ in range(20_000):
        page = "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 9)))
        events = Events(), Events()
        markup._walk(page, events[0])
        reader = markup.Reader(events[1])
        reader.feed(page)
        reader.close()
        assert events[0].seen == events[1].seen, page
        plain += markup._tokens(page) is not None
    assert 2_000 < plain < 18_000
    assert markup._tokens('<p>a<script>b</p>') is None and markup._tokens("<p a=b>") is None
    assert max(len(markup._TAGS), len(markup._CLASSES), len(markup._ROLES)) <= markup.KEPT


def test_pages_are_read_in_slices():
    """Captures of a batch are held as Python objects for a slice at a time."""
    held = []
    read = P.captured(lambda site, page: held.append(page) or {"error": page}, P._DETAIL_TYPE)
    n = 2 * P.SLICE + 3
    out = read(P.pa.array(["x"] * n), P.pa.array([str(i) for i in range(n)]))
    assert out.field("error").to_pylist() == held == [str(i) for i in range(n)] and out.type == P._DETAIL_TYPE
    assert len(read(P.pa.array([], P.pa.string()), P.pa.array([], P.pa.string()))) == 0


@pytest.mark.parametrize("name", ["extract_details", "extract_greenhouse", "extract_lever", "extract_linkedin", "extract_indeed"])
def test_page_text_is_not_shuffled(spark, name):
    """Pages are spelled after the rows are dealt: no exchange of the extraction carries page text."""
    from rolegrid.catalog.pages import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    while plan.children().nonEmpty():
        assert "Exchange" not in plan.nodeName() or "html" not in plan.output().mkString(",")
        plan = plan.inputPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan.children().head()
