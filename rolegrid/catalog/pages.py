"""Registered queries: extraction from pages, page walks, discovery.

The tables hold no job pages, so pages are spelled in Spark from table rows, in the markup of each site.
What comes out of the extraction must equal the columns the pages were made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolegrid.catalog.common import spread, stamp, table
from rolegrid.operators import crawl
from rolegrid.plans.discovery import DiscoveryOptions, discover
from rolegrid.schemas import POSTING
from rolegrid.session import stage
from rolegrid.sources import pages as page_source
from rolegrid.sources.page_store import write_page_store


def html(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def escape(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def greenhouse_card(key: Column, title: Column, place: Column, team: Column, form: Column) -> Column:
    """The three listing markups of greenhouse."""
    opening = html('<div class="opening"><a class="opening" href="/acme/jobs/', key, '"> ', title, ' </a><span class="location">', place,
                   '</span><div><span class="department">', team, "</span></div></div>")
    row = html('<table><tr class="TableRow"><td><a class="Link JobsListings__link" data-mapped="m', key, '" href="https://acme.test/j/', key,
               '">', title, '</a></td><td><ul><li class="JobsListings__departmentsListItem">', team,
               '</li></ul></td><td><span class="JobsListings__locationDisplayName">', place, "</span></td></tr></table>")
    hosted = html('<h3 class="section-header x">', team, '</h3><table><tr class="job-post"><td><a href="https://job-boards.greenhouse.io/acme/jobs/',
                  key, '"><p class="body body--medium">', title, '</p><p class="body body__secondary">', place, "</p></a></td></tr></table>")
    return F.when(form == "R", opening).when(form == "A", row).otherwise(hosted)


def extract_greenhouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per order, one card per line item; the return flag picks the markup."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_extendedprice")
    items = spread(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines")))
    cards = F.transform("lines", lambda x: greenhouse_card(
        html(x["l_partkey"], "-", x["l_suppkey"]), html("Part  ", x["l_partkey"], " &amp; line ", x["l_linenumber"]),
        html("Hall ", x["l_quantity"].cast("int")), html("Team ", x["l_linestatus"]), x["l_returnflag"]))
    pages = items.select(
        F.concat(F.lit("https://boards.greenhouse.io/order"), "l_orderkey").alias("url"), F.lit("greenhouse").alias("site"), "l_orderkey",
        html('<html><section class="level-0"><h1>Order ', F.col("l_orderkey"), "</h1></section><body>", F.array_join(cards, "\n"), "</body></html>").alias("html"),
    )
    return page_source.extract_listings(pages).select(
        "l_orderkey", F.col("position").cast("int").alias("position"), "source_job_id", "url", "title", "company", "location", "team", "remote_status", "description_text"
    )


def extract_lever(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per part with both lever markups."""
    k, name, kind, brand = (F.col(c) for c in ("p_partkey", "p_name", "p_type", "p_brand"))
    wrapped = html(
        '<section><a href="/acme/a', k, '" class="x posting-btn-submit"><div class="wide posting"><p><span class="sort-by-commitment-x">no field</span>'
        '<span class="sort-by-team">', brand, '</span></p><span class="sort-by-commitment">Full-time</span><em><span class="sort-by-location">',
        kind, '</span></em><h5 class="posting-name">', name, "</h5></div></a></section>",
    )
    own = html(
        '<main><div class="posting-category-title">Group ', kind, '</div><div data-qa-posting-id="id-', k,
        '" class="posting"><span class="sort-by-location">Hall ', k, '</span><a class="posting-btn-submit" href="https://jobs.lever.co/acme/b', k,
        '">Send</a><span class="workplaceTypes">On-site</span><h5 data-qa="posting-name"><b>', brand, "</b> ", name, "</h5></div></main>",
    )
    page = F.concat(wrapped, own)
    pages = spread(table(spark, sf_dir, "part")).select(
        k, html("https://jobs.lever.co/part-", k, "_co?x=1").alias("url"), F.lit("lever").alias("site"), page.alias("html"))
    return page_source.extract_listings(pages).select(
        "p_partkey", F.col("position").cast("int").alias("position"), "source_job_id", "url", "title", "company", "location", "team", "workplace_type")


def extract_linkedin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per order with two cards."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    place = F.when(F.col("o_orderstatus") == "F", "Hybrid").when(F.col("o_orderstatus") == "P", "On-site").otherwise("")
    page = html(
        '<ul><li class="jobs-search-results__list-item"><a class="base-card__full-link" href="/jobs/view/', k, '/?trk=x">Order ', k,
        '</a><h4 class="base-search-card__subtitle">Customer ', F.col("o_custkey"), '</h4><ul><li>x</li></ul><span class="job-search-card__location">Place</span><time datetime="', day,
        '">3 days ago</time><span class="job-search-card__workplace-type">', place,
        '</span></li><li class="scaffold-layout__list-item"><a class="job-card-list__title" href="https://www.linkedin.com/jobs/search?currentJobId=', k,
        '&amp;x=1">', F.col("o_orderpriority"), '</a><div class="artdeco-entity-lockup__caption">Remote ', F.col("o_custkey"),
        '</div><div class="artdeco-entity-lockup__caption">ignored</div></li><li class="jobs-search-results__list-item"><span class="job-search-card__location">no link</span></li></ul>',
    )
    pages = spread(table(spark, sf_dir, "orders")).select(
        k, html("https://www.linkedin.com/jobs/search/", k).alias("url"), F.lit("linkedin").alias("site"),
        F.lit(None).cast("string").alias("board_url"), page.alias("html"))
    return page_source.extract_listings(pages).select(
        "o_orderkey", F.col("position").cast("int").alias("position"), "source_job_id", "url", "title", "company", "location", "remote_status",
        stamp("posted_at").alias("posted_at"), "posted_time")


def extract_indeed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per customer with two cards."""
    k, name, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    page = html(
        '<div class="job_seen_beacon"><div><a class="jcs-JobTitle" href="/viewjob?jk=k', k, '&amp;from=serp">', name, '</a></div><span class="companyName">', seg,
        '</span><div class="companyLocation">Nation ', F.col("c_nationkey"), '</div><div class="job-snippet">first ', k, '</div><div class="jobMetaDataGroup">then ', seg,
        '</div></div><div class="slider_item"><a data-jk="d', k, '" href="https://www.indeed.com/viewjob?x=', k, '">', seg, "</a></div>",
    )
    pages = spread(table(spark, sf_dir, "customer")).select(
        k, html("https://www.indeed.com/q", k).alias("url"), F.lit("indeed").alias("site"), F.lit(None).cast("string").alias("board_url"), page.alias("html"))
    return page_source.extract_listings(pages).select(
        "c_custkey", F.col("position").cast("int").alias("position"), "source_job_id", "url", "title", "company", "location", "snippet")


PRIORITY_TEXT = {"1-URGENT": "Full-time", "2-HIGH": "Part time contract", "3-MEDIUM": "Internship", "4-NOT SPECIFIED": "Temporary", "5-LOW": "other"}


def extract_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detail page per order in the markup of each of the three sites."""
    k = F.col("o_orderkey")
    kind = F.create_map(*[F.lit(x) for pair in PRIORITY_TEXT.items() for x in pair])[F.col("o_orderpriority")]
    where = F.when(F.col("o_orderstatus") == "F", "Hybrid").when(F.col("o_orderstatus") == "P", "Remote first").otherwise("On-site")
    body = html("<p>Order  ", k, " of &lt;", F.col("o_custkey"), "&gt;</p><style>p{}</style><ul><li>One ", k, "</li><li>Two</li></ul>")
    greenhouse = html("<h1>Title ", k, '</h1><div class="company-name">Co ', F.col("o_custkey"), '</div><div class="job-location">Lyon ', k,
                      '</div><div class="job-department">Dep</div><div class="job-employment-type">', kind, '</div><div class="job-workplace-type">', where,
                      '</div><section class="job-description">', body, "</section>")
    lever = html('<div class="main-header-text">Co ', F.col("o_custkey"), '</div><h2 class="posting-headline">Title ', k, '</h2><span class="location">Lyon ', k,
                 '</span><span class="team">Dep</span><span class="commitment">', kind, '</span><span class="workplaceTypes">', where,
                 '</span><section class="section-wrapper description">', body, "</section>")
    linkedin = html("<h1>Title ", k, '</h1><a class="topcard__org-name-link" href="/c">Co ', F.col("o_custkey"), '</a><div class="topcard__flavor">Over 90 applicants · Lyon ', k,
                    ' | 3 days ago</div><ul><li class="job-insight">', where, '</li><li class="job-insight">', kind,
                    '</li></ul><div class="show-more-less-html__markup">', body, "</div>")
    forms = F.explode(F.array(
        F.struct(F.lit("greenhouse").alias("site"), html("https://boards.greenhouse.io/acme/jobs/", k).alias("url"), greenhouse.alias("html")),
        F.struct(F.lit("lever").alias("site"), html("https://jobs.lever.co/acme/", k, "/").alias("url"), lever.alias("html")),
        F.struct(F.lit("linkedin").alias("site"), html("https://www.linkedin.com/jobs/view/", k, "/?x=1").alias("url"), linkedin.alias("html")),
    )).alias("f")
    pages = spread(table(spark, sf_dir, "orders")).select(forms).select("f.*")
    return page_source.extract_details(pages).select(
        "source_site", "source_job_id", "title", "company", "location", "employment_type", "remote_status", "team", "posted_time",
        F.coalesce("employment_type_text", F.lit("")).alias("employment_type_text"), "description_text")


def detail_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts inside a detail page come out whole."""
    pages = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("https://h.test/jobs/"), "doc_id").alias("url"), F.lit("greenhouse").alias("site"),
        html("<h1>Doc</h1><script>if (a < b) { x() }</script><div id=\"content\"><p>", escape(F.col("text")), "</p></div>").alias("html"),
    )
    found = page_source.extract_details(spread(pages))
    return found.select(F.col("source_job_id").cast("bigint").alias("doc_id"), F.md5("description_text").alias("text_md5"))


def next_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages with a next link of several kinds put in front of their own markup."""
    k = F.col("page_id")
    kinds = F.array(
        F.lit(""), html('<a rel="next" href="?page=', k, '">more</a>'), html('<a href="/p/', k, '"> <b>Next</b> page</a>'),
        html('<a class="x PageNEXT" href="https://o.test/', k, '">&gt;</a>'), html('<a href="/zzz">see next</a><a aria-label="next" href="//n.test/', k, '">2</a>'),
    )
    pages = spread(table(spark, sf_dir, "pages")).select("page_id", "url", "html", F.posexplode(kinds).alias("kind", "link"))
    both = pages.select("page_id", "kind", "url", F.concat("link", "html").alias("html"))
    return both.select("page_id", "kind", page_source.resolve_url("url", page_source.next_href("html")).alias("next_url"))


def order_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages that point to the next order of the customer; returned line items are the items."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    returned = items.where(F.col("l_returnflag") == "R").groupBy("l_orderkey").agg(F.count("*").alias("n_items"))
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    chain = orders.select(
        "o_orderkey", "o_custkey", F.row_number().over(order).alias("nr"), F.lead("o_orderkey").over(order).alias("nxt"), "o_orderstatus"
    )
    return chain.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_custkey", "nr", F.concat(F.lit("o"), "o_orderkey").alias("url"), F.lit("greenhouse").alias("site"),
        F.concat(F.lit("o"), "nxt").alias("next_url"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "o_orderstatus",
    )


def next_page_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk up to four pages from the first order of every customer; pending orders are missing pages."""
    chain = order_chain(spark, sf_dir)
    starts = chain.where("nr = 1").select(F.col("o_custkey").alias("query_id"), F.col("site").alias("source_site"), F.col("url").alias("start_url"))
    index = chain.where("o_orderstatus <> 'P' OR nr = 1").select("url", "site", "next_url", "n_items")
    return crawl.walk_pages(starts, index, max_pages=4).select("query_id", "hop", "url", "found", "n_items", "stop")


def customer_boards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Boards of customers: one listing page per order, chained, one card per line item's part."""
    items = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = items.groupBy("o_custkey", "o_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("parts"))
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    chain = parts.withColumns({"nr": F.row_number().over(order), "nxt": F.lead("o_orderkey").over(order)})
    cards = F.transform("parts", lambda p: html(
        '<div class="opening"><a class="opening" href="https://boards.greenhouse.io/all/jobs/', p, '?utm_source=b">Part ', p, '</a><span class="location">Hall ', p, "</span></div>"))
    link = F.coalesce(html('<a rel="next" href="/order/', F.col("nxt"), '">Next</a>'), F.lit(""))
    url = html("https://boards.greenhouse.io/order/", F.col("o_orderkey"))
    pages = chain.select(
        url.alias("url"), F.lit("greenhouse").alias("site"), F.lit("listing").alias("kind"),
        html('<section class="level-0">Acme</section>', F.array_join(cards, ""), link).alias("html"))
    details = table(spark, sf_dir, "part").select(
        html("https://boards.greenhouse.io/all/jobs/", F.col("p_partkey"), "?utm_source=b").alias("url"), F.lit("greenhouse").alias("site"), F.lit("detail").alias("kind"),
        html("<h1>x</h1><div class='job-location'>Detail ", F.col("p_partkey"), "</div><div class='job-employment-type'>Full</div>").alias("html"))
    none = F.array().cast("array<string>")
    queries = chain.where("nr = 1").select(
        F.col("o_custkey").cast("string").alias("query_id"), F.lit("greenhouse").alias("source_site"), url.alias("start_url"),
        none.alias("include_keywords"), none.alias("exclude_keywords"), none.alias("location_hints"))
    return queries, pages.unionByName(details)


def _discovered(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    queries, pages = customer_boards(spark, sf_dir)
    # all parts are stored; promoted ones under the url that boards show, the others under an old one
    host = F.when(F.col("p_type") == "PROMO", "https://boards.greenhouse.io/all/jobs/").otherwise("https://old.test/p/")
    stored = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 1).alias("id"), F.lit("greenhouse").alias("source_site"), F.lit(None).cast("string").alias("source_job_id"),
        html(host, F.col("p_partkey")).alias("url"), F.lit("old").alias("title"), F.lit("old").alias("company"),
        F.lit("old").alias("location"), F.lit("remote").alias("remote_status"), F.lit("unknown").alias("employment_type"),
        F.lit("unknown").alias("seniority"), F.lit("old").alias("description_text"))
    from rolegrid.operators.store import to_store_columns

    at = F.lit("2024-01-01").cast("timestamp")
    store = to_store_columns(stored, at).select(*[f.name for f in POSTING])
    options = DiscoveryOptions(max_pages=None, enrich_greenhouse_details=True)
    return discover(queries, write_page_store(stage(pages, "spelled")), store, options, seen_at=at)


def discover_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a discovery run over all pages of all customers' boards."""
    return _discovered(spark, sf_dir)["counters"]


def discover_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after that run; ids of new postings depend on the first customer that shows them."""
    return _discovered(spark, sf_dir)["store"].select("source_job_id", "url", "title", "location", "remote_status", "employment_type", "description_text")


QUERIES = {
    "extract_greenhouse": extract_greenhouse,
    "extract_lever": extract_lever,
    "extract_linkedin": extract_linkedin,
    "extract_indeed": extract_indeed,
    "extract_details": extract_details,
    "detail_descriptions": detail_descriptions,
    "next_links": next_links,
    "next_page_walk": next_page_walk,
    "discover_job": discover_job,
    "discover_store": discover_store,
}

_WALKED = """
it AS (SELECT o_custkey AS c, o_orderkey AS o, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
nr AS (SELECT c, o, dense_rank() OVER (PARTITION BY c ORDER BY o) AS nr FROM (SELECT DISTINCT c, o FROM it)),
seen AS (SELECT c, p FROM it),
kept AS (SELECT DISTINCT c, p FROM seen),
promo AS (SELECT p_partkey FROM part WHERE p_type = 'PROMO')"""

ORACLES = {
    "extract_greenhouse": """
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_extendedprice) - 1 AS INTEGER) AS position,
  CASE l_returnflag WHEN 'A' THEN 'm' ELSE '' END || l_partkey || '-' || l_suppkey AS source_job_id,
  CASE l_returnflag WHEN 'R' THEN 'https://boards.greenhouse.io/acme/jobs/' WHEN 'A' THEN 'https://acme.test/j/' ELSE 'https://job-boards.greenhouse.io/acme/jobs/' END || l_partkey || '-' || l_suppkey AS url,
  'Part ' || l_partkey || ' & line ' || l_linenumber AS title, 'Order ' || l_orderkey AS company, 'Hall ' || CAST(l_quantity AS INTEGER) AS location, 'Team ' || l_linestatus AS team,
  'unknown' AS remote_status, 'Listing-only discovery from Greenhouse jobs page.' AS description_text FROM lineitem""",
    "extract_lever": """
SELECT p_partkey, 0 AS position, 'a' || p_partkey AS source_job_id, 'https://jobs.lever.co/acme/a' || p_partkey AS url, p_name AS title, 'Part ' || p_partkey || ' Co' AS company, p_type AS location, p_brand AS team, CAST(NULL AS VARCHAR) AS workplace_type FROM part
UNION ALL SELECT p_partkey, 1, 'id-' || p_partkey, 'https://jobs.lever.co/acme/b' || p_partkey, p_brand || ' ' || p_name, 'Part ' || p_partkey || ' Co', 'Hall ' || p_partkey, 'Group ' || p_type, NULL FROM part""",
    "extract_linkedin": """
SELECT o_orderkey, 0 AS position, CAST(o_orderkey AS VARCHAR) AS source_job_id, 'https://www.linkedin.com/jobs/view/' || o_orderkey || '/?trk=x' AS url, 'Order ' || o_orderkey AS title, 'Customer ' || o_custkey AS company, 'Place' AS location,
  CASE o_orderstatus WHEN 'F' THEN 'hybrid' ELSE 'onsite' END AS remote_status, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS posted_at, '3 days ago' AS posted_time FROM orders
UNION ALL SELECT o_orderkey, 1, CAST(o_orderkey AS VARCHAR), 'https://www.linkedin.com/jobs/search?currentJobId=' || o_orderkey || '&x=1', o_orderpriority, 'Unknown company', 'Remote ' || o_custkey, 'remote', NULL, NULL FROM orders""",
    "extract_indeed": """
SELECT c_custkey, 0 AS position, 'k' || c_custkey AS source_job_id, 'https://www.indeed.com/viewjob?jk=k' || c_custkey || '&from=serp' AS url, c_name AS title, c_mktsegment AS company, 'Nation ' || c_nationkey AS location, 'first ' || c_custkey || ' then ' || c_mktsegment AS snippet FROM customer
UNION ALL SELECT c_custkey, 1, 'd' || c_custkey, 'https://www.indeed.com/viewjob?x=' || c_custkey, c_mktsegment, 'Unknown company', 'Unknown location', NULL FROM customer""",
    "extract_details": """
WITH o AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'Full-time' WHEN '2-HIGH' THEN 'Part time contract' WHEN '3-MEDIUM' THEN 'Internship' WHEN '4-NOT SPECIFIED' THEN 'Temporary' ELSE 'other' END AS kind FROM orders)
SELECT s AS source_site, CAST(o_orderkey AS VARCHAR) AS source_job_id, 'Title ' || o_orderkey AS title, 'Co ' || o_custkey AS company, 'Lyon ' || o_orderkey AS location,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'full_time' WHEN '2-HIGH' THEN 'part_time' WHEN '3-MEDIUM' THEN 'internship' WHEN '4-NOT SPECIFIED' THEN 'temporary' ELSE 'unknown' END AS employment_type,
  CASE o_orderstatus WHEN 'F' THEN 'hybrid' WHEN 'P' THEN 'remote' ELSE 'onsite' END AS remote_status,
  CASE WHEN s <> 'linkedin' THEN 'Dep' END AS team, CASE WHEN s = 'linkedin' THEN '3 days ago' END AS posted_time,
  CASE WHEN s = 'linkedin' AND kind = 'other' THEN '' ELSE kind END AS employment_type_text,
  'Order ' || o_orderkey || ' of <' || o_custkey || '> One ' || o_orderkey || ' Two' AS description_text
FROM o, (VALUES ('greenhouse'), ('lever'), ('linkedin')) v(s)""",
    "detail_descriptions": r"""
SELECT doc_id, md5(coalesce(nullif(trim(regexp_replace(text, '[\s\x1c-\x1f\x{85}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+', ' ', 'g')), ''), 'Listing-only discovery from Greenhouse jobs page.')) AS text_md5 FROM documents""",
    "next_links": """
SELECT page_id, k AS kind, CASE k WHEN 1 THEN regexp_extract(url, '^[^?#]+') || '?page=' || page_id WHEN 2 THEN regexp_extract(url, '^https?://[^/?#]+') || '/p/' || page_id
  WHEN 3 THEN 'https://o.test/' || page_id WHEN 4 THEN regexp_extract(url, '^https?:') || '//n.test/' || page_id END AS next_url
FROM pages, (VALUES (0), (1), (2), (3), (4)) v(k)""",
    "next_page_walk": """
WITH RECURSIVE r AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
c AS (SELECT o_orderkey AS o, o_custkey AS q, o_orderstatus AS s, coalesce(n, 0) AS n, row_number() OVER w AS nr, lead(o_orderkey) OVER w AS nxt
   FROM orders LEFT JOIN r ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
w AS (SELECT q, 1 AS hop, o, true AS found, n, nxt, false AS filled, CASE WHEN nxt IS NULL THEN 'no_next' END AS stop FROM c WHERE nr = 1
  UNION ALL
  SELECT w.q, w.hop + 1, c.o, c.s <> 'P', CASE WHEN c.s <> 'P' THEN c.n ELSE 0 END, c.nxt, w.filled OR w.n > 0,
    CASE WHEN c.s = 'P' THEN 'page_missing' WHEN c.n = 0 AND (w.filled OR w.n > 0) THEN 'empty_page' WHEN c.nxt IS NULL THEN 'no_next' WHEN w.hop + 1 = 4 THEN 'page_limit' END
  FROM w JOIN c ON c.o = w.nxt WHERE w.stop IS NULL)
SELECT q AS query_id, hop, 'o' || o AS url, found, n AS n_items, stop FROM w""",
    "discover_job": f"""
WITH {_WALKED},
pg AS (SELECT c, max(nr) AS pages FROM nr GROUP BY c), ps AS (SELECT c, count(*) AS parsed FROM seen GROUP BY c),
fst AS (SELECT p, min(CAST(c AS VARCHAR)) AS first_c FROM kept GROUP BY p),
kp AS (SELECT kept.c, count(*) AS kept, count(*) FILTER (kept.p NOT IN (FROM promo) AND first_c = CAST(kept.c AS VARCHAR)) AS ins FROM kept JOIN fst USING (p) GROUP BY kept.c)
SELECT CAST(c AS VARCHAR) AS query_id, 'ok' AS status, 1::BIGINT AS queries_attempted, pages AS pages_fetched, 0::BIGINT AS pages_failed, parsed AS jobs_parsed, ins AS jobs_inserted, kept - ins AS jobs_updated,
  parsed - kept AS jobs_skipped_duplicates, parsed AS detail_enrichment_selected, parsed AS detail_fetch_attempts, parsed AS detail_pages_fetched, parsed AS detail_enrichment_successes, 0::BIGINT AS detail_parse_failures
FROM pg JOIN ps USING (c) JOIN kp USING (c)""",
    "discover_store": f"""
WITH {_WALKED}, f AS (SELECT DISTINCT p FROM kept)
SELECT CASE WHEN p IS NOT NULL THEN p || '?utm_source=b' END AS source_job_id, 'https://boards.greenhouse.io/all/jobs/' || coalesce(p, p_partkey) AS url, CASE WHEN p IS NULL THEN 'old' ELSE 'Part ' || p END AS title,
  CASE WHEN p IS NULL THEN 'old' ELSE 'Detail ' || p END AS location, CASE WHEN p IS NULL THEN 'remote' ELSE 'onsite' END AS remote_status,
  CASE WHEN p IS NULL THEN 'unknown' ELSE 'full_time' END AS employment_type, CASE WHEN p_partkey IS NULL THEN 'Listing-only discovery from Greenhouse jobs page.' ELSE 'old' END AS description_text
FROM f FULL JOIN promo ON p = p_partkey
UNION ALL SELECT NULL, 'https://old.test/p/' || p_partkey, 'old', 'old', 'remote', 'unknown', 'old' FROM part WHERE p_type <> 'PROMO'""",
}
