"""Registered queries: prompt parsing, plans, registry maintenance, prompt search.

Prompts are sentences spelled from table rows; the expected constraints are the columns they were made of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrid.catalog.common import joined, spread, table
from rolegrid.catalog.pages import customer_boards, html
from rolegrid.operators import intents, matching, registry, validate
from rolegrid.plans.discovery import DiscoveryOptions
from rolegrid.plans.search import search
from rolegrid.schemas import CONSTRAINTS, LIST_CONSTRAINTS
from rolegrid.session import stage
from rolegrid.sources.page_store import write_page_store


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    """Constraint columns as flat texts."""
    lists = [joined(F.col(f"want.{n}"), ", ").alias(n) for n in LIST_CONSTRAINTS]
    return df.select(
        *keys, *lists, F.col("want.remote_preference").alias("remote_preference"),
        F.coalesce("want.freshness_window_days", F.lit(-1)).alias("freshness_window_days"),
        joined("parser_notes").alias("parser_notes"), joined("unresolved_fragments").alias("unresolved_fragments"),
        "summary",
    )


def template_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt per order: roles, keywords, places, companies, exclusions, window, workplace."""
    c, n = F.col("o_custkey"), F.col("o_orderkey")
    role = F.when(F.col("o_orderstatus") == "F", "senior backend roles").when(F.col("o_orderstatus") == "P", "Sr. QA engineer jobs").otherwise("site reliability positions")
    place = F.concat(F.lit("Ville "), c)
    work = F.when(F.col("o_orderpriority") == "1-URGENT", ", remote only").when(F.col("o_orderpriority") == "2-HIGH", ", must be hybrid").when(
        F.col("o_orderpriority") == "3-MEDIUM", ", onsite is okay").otherwise("")
    text = html("Find ", role, " at Firm ", c, " in ", place, work, ". Skills with Tool ", c, " and Lib/", n,
                "; avoid Corp ", c, ", sales roles. Prefer Port ", n, ". past 2 weeks. strange wishes here ", n, ".")
    orders = spread(table(spark, sf_dir, "orders").select(n, c, "o_orderstatus", "o_orderpriority"))  # the texts are spelled behind the shuffle
    return _flat(intents.parse_prompts(orders.select(n, text.alias("raw_prompt_text"))), "o_orderkey")


PHRASES = {0: "remote preferred, last 3 days", 1: "Hybrid-only jobs this week on Greenhouse", 2: "must be on-site, past 2 months via LinkedIn",
           3: "principal or staff, on site is fine, past 24 hours", 4: "fully remote or hybrid only lever roles today", 5: "past 14 months",
           6: "on-site ok, last week and past 5 days", 7: "mid-level intern jr. vp yesterday"}


def prompt_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversation texts, each with a phrase picked by its turn, as prompts."""
    phrase = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    prompts = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat("text", F.lit(". "), F.coalesce(phrase[F.col("turn").cast("int")], F.lit("Senior lead manager"))).alias("raw_prompt_text"))
    parsed = intents.parse_prompts(spread(prompts))
    return parsed.select(
        "conv_id", "turn", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("want.remote_preference", F.lit("")).alias("remote_preference"),
        F.coalesce("want.freshness_window_days", F.lit(-1)).alias("days"), F.coalesce(joined("want.seniority_preferences"), F.lit("")).alias("seniority"),
        F.coalesce(joined("want.source_site_preferences"), F.lit("")).alias("sites"))


def supplier_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as boards; nation and region are hint and tag."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    site = F.when(F.col("r_name") == "ASIA", "linkedin").when(F.col("s_acctbal") > 4000, "greenhouse").otherwise("lever")
    return rows.select(
        F.col("s_suppkey").alias("idx"), F.col("s_name").alias("company_name"), site.alias("source_site"),
        html("https://boards.test/s", F.col("s_suppkey")).alias("board_url"), F.array("r_name", F.lit("x-tag")).alias("tags"),
        F.array(F.replace("n_name", F.lit("_"), F.lit(" - ")), F.lit("Far Away")).alias("location_hints"))


def order_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as parsed prompts: the suppliers of their line items are the companies asked for."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("supp"))
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    o = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.array().cast("array<string>")
    sites = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("LinkedIn"), F.lit("monster"))).when(
        F.col("o_orderpriority") == "2-HIGH", F.array(F.lit("My-Site"))).when(F.col("o_orderpriority") == "5-LOW", F.array(F.lit("lever"))).otherwise(none)
    values = {
        "target_titles": F.when(F.col("o_orderstatus") == "F", F.array(F.lit("Backend Engineer"))).otherwise(none),
        "include_keywords": F.when(F.col("o_orderstatus") == "P", F.array(F.lower("r_name"))).otherwise(none),
        "preferred_keywords": F.array(F.lit("api"), F.lit("API")),
        "exclude_keywords": F.array("c_mktsegment"),
        "location_constraints": F.when(F.col("o_totalprice") > 200000, F.array(F.lower("n_name"))).otherwise(none),
        "preferred_locations": F.array(F.lit("Nowhere"), F.lit("Nowhere")),
        "source_site_preferences": sites,
        "include_companies": F.coalesce(F.transform("supp", lambda x: F.concat(F.lit("SUPPLIER "), F.lpad(x.cast("string"), 9, "0"))), none),
    }
    want = F.struct(*[values.get(f.name, none if f.name in LIST_CONSTRAINTS else F.lit("unspecified" if f.name == "remote_preference" else None).cast(f.dataType)).alias(f.name) for f in CONSTRAINTS])
    return o.select(F.col("o_orderkey").alias("prompt_id"), want.alias("want"))


def registry_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of every prompt, with label and notes."""
    plan = registry.compile_plan(stage(order_intents(spark, sf_dir), "intents"), supplier_registry(spark, sf_dir))
    return plan["queries"].select("prompt_id", "company_name", "source_site", "board_url", "label", joined("notes", " ").alias("notes"))


def plan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts without a plan, and the notes of the others."""
    plan = registry.compile_plan(stage(order_intents(spark, sf_dir), "intents"), supplier_registry(spark, sf_dir))
    notes = plan["notes"].select("prompt_id", joined("plan_notes", " ").alias("text"))
    return plan["errors"].select("prompt_id", F.col("error").alias("text")).unionByName(notes)


def plan_without_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per site, none executable."""
    found = order_intents(spark, sf_dir)
    plan = registry.compile_plan(found)
    rows = plan["queries"].join(plan["notes"], "prompt_id")
    return rows.select("prompt_id", "source_site", "label", joined("notes", " ").alias("notes"), joined("plan_notes", " ").alias("plan_notes"),
                       F.col("board_url").isNotNull().alias("executable"))


def discovery_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executable queries with merged keyword and location lists."""
    plan = registry.compile_plan(stage(order_intents(spark, sf_dir), "intents"), supplier_registry(spark, sf_dir))
    rows = registry.to_discovery_queries(plan["queries"])
    return rows.select("prompt_id", "start_url", joined("include_keywords").alias("include_keywords"), joined("exclude_keywords").alias("exclude_keywords"),
                       joined("location_hints").alias("location_hints"))


def customer_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as registry entries with coarse companies, so that keys repeat; some are invalid."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("idx"),
        F.when(F.col("c_acctbal") < 0, F.lit("  ")).otherwise(F.concat("c_mktsegment", F.lit("  Co. "), "c_nationkey")).alias("company_name"),
        F.when(F.col("c_nationkey") > 20, "indeed").when(F.col("c_acctbal") > 5000, "Lever").otherwise("greenhouse").alias("source_site"),
        F.when(F.col("c_acctbal") > 9000, "not a url").otherwise(F.concat(F.lit("https://B.test"), F.when(F.col("c_acctbal") > 2000, F.concat(F.lit("/"), "c_custkey")).otherwise(""))).alias("board_url"),
        F.array("c_mktsegment").alias("tags"), F.array(F.lit(" a  b ")).alias("location_hints"))


def registry_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate_registry(customer_registry(spark, sf_dir))[1].select("idx", "rule", "issue")


def registry_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers added to the suppliers' registry, then entries removed on the word of the orders."""
    base = supplier_registry(spark, sf_dir)
    added = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("idx"), F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("company_name"),
        F.lit("lever").alias("source_site"), html("https://boards.test/c", F.col("c_custkey")).alias("board_url"),
        F.array("c_mktsegment").alias("tags"), F.array(F.lit("x")).alias("location_hints"))
    merged, issues = registry.add_entries(base, added)
    removals = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("p")).select(
        F.concat(F.lit("SUPPLIER "), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("company_name"),
        F.when(F.col("p") == "5-LOW", "Lever").otherwise("greenhouse").alias("source_site"), F.lit(None).cast("string").alias("board_url"))
    out = registry.remove_entries(merged, removals)
    return (
        out["registry"].select(F.lit("left").alias("what"), "company_name", "source_site", F.col("board_url").alias("detail"))
        .unionByName(issues.select(F.lit("duplicate").alias("what"), F.lit("").alias("company_name"), F.lit("").alias("source_site"), F.col("issue").alias("detail")))
        .unionByName(out["issues"].select(F.lit("refused").alias("what"), "company_name", "source_site", F.col("issue").alias("detail")))
    )


def _searched(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every customer asks for parts on two boards, of which all pages and details are read."""
    queries, pages = customer_boards(spark, sf_dir)
    boards = queries.select(
        F.concat(F.lit("Firm "), "query_id").alias("company_name"), "source_site", F.col("start_url").alias("board_url"),
        F.array(F.lit("x")).alias("tags"), F.array(F.lit("y")).alias("location_hints"))
    prompts = spread(table(spark, sf_dir, "customer")).select(
        F.col("c_custkey").alias("prompt_id"),
        html("Find backend roles at Firm ", F.col("c_custkey"), " or Firm ", F.col("c_nationkey"), ". avoid part 1", F.col("c_nationkey"), ".").alias("raw_prompt_text"))
    options = DiscoveryOptions(max_pages=None, enrich_greenhouse_details=True)
    return search(prompts, boards, write_page_store(stage(pages, "spelled")), options, now=F.lit("2024-01-01").cast("timestamp"))


def search_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the whole prompt search, for all customers at once."""
    return _searched(spark, sf_dir)["summary"].select("prompt_id", "boards", "discovered", "matched", "rejected")


def search_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches of that search."""
    found = matching.matched(_searched(spark, sf_dir)["evaluated"])
    return found.select("prompt_id", "query_id", "source_job_id", "title", F.col("match_score").alias("score"), joined("score_reasons").alias("reasons"))


QUERIES = {
    "template_prompts": template_prompts,
    "prompt_constraints": prompt_constraints,
    "registry_match": registry_match,
    "plan_errors": plan_errors,
    "plan_without_registry": plan_without_registry,
    "discovery_queries": discovery_queries,
    "registry_issues": registry_issues,
    "registry_changes": registry_changes,
    "search_job": search_job,
    "search_matches": search_matches,
}

_INTENTS = """
reg AS (SELECT s_suppkey, s_name, n_name, r_name, CASE WHEN r_name = 'ASIA' THEN 'linkedin' WHEN s_acctbal > 4000 THEN 'greenhouse' ELSE 'lever' END AS site, 'https://boards.test/s' || s_suppkey AS url
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
o AS (SELECT o_orderkey AS pid, o_orderpriority AS pr, o_orderstatus AS st, n_name AS nat, lower(r_name) AS reg, c_mktsegment AS seg, o_totalprice > 200000 AS loc,
   CASE o_orderpriority WHEN '1-URGENT' THEN ['linkedin'] WHEN '2-HIGH' THEN ['my_site'] WHEN '5-LOW' THEN ['lever'] ELSE ['greenhouse', 'lever'] END AS sites
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ask AS (SELECT DISTINCT l_orderkey AS pid, l_suppkey FROM lineitem),
cand AS (SELECT o.*, r.*, loc AND r.n_name = nat AS near, st = 'P' AND lower(r.r_name) = reg AS tagged
  FROM o JOIN ask USING (pid) JOIN reg r ON r.s_suppkey = ask.l_suppkey WHERE pr <> '2-HIGH' AND list_contains(sites, r.site)),
c2 AS (SELECT *, bool_or(near) OVER (PARTITION BY pid) AS any_near FROM cand),
c3 AS (SELECT *, bool_or(tagged) OVER (PARTITION BY pid) AS any_tagged FROM c2 WHERE near OR NOT any_near),
boards AS (SELECT * FROM c3 WHERE tagged OR NOT any_tagged)"""
_DESC = "CASE st WHEN 'F' THEN ' Backend Engineer' WHEN 'P' THEN ' ' || reg || ' Roles' ELSE '' END"
_CHOSEN = "CASE WHEN pr IN ('1-URGENT', '5-LOW') THEN 'Source selected from explicit intent source-site preferences.' ELSE 'Source selected by default because the intent did not request specific supported sites.' END"
_PLAN_NOTE = "'Compiled from parsed search intent using currently supported live discovery sources only.' || CASE WHEN pr = '1-URGENT' THEN ' Ignored unsupported source-site preferences: monster.' ELSE '' END"

ORACLES = {
    "template_prompts": """
WITH t AS (SELECT *, CAST(o_custkey AS VARCHAR) AS c, CAST(o_orderkey AS VARCHAR) AS n,
  CASE o_orderstatus WHEN 'F' THEN 'Backend Engineer' WHEN 'P' THEN 'Senior QA Engineer' ELSE 'Site Reliability Engineer' END AS title,
  CASE o_orderstatus WHEN 'F' THEN 'backend' WHEN 'O' THEN 'site reliability' END AS kw,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'remote_only' WHEN '2-HIGH' THEN 'hybrid_only' WHEN '3-MEDIUM' THEN 'onsite_ok' ELSE 'unspecified' END AS rp FROM orders),
u AS (SELECT *, array_to_string(list_filter(['Tool ' || c, 'Lib', n, kw], lambda x: x IS NOT NULL), ', ') AS inc, 'Port ' || n AS pref, 'Corp ' || c || ', sales roles' AS exc FROM t)
SELECT o_orderkey, title AS target_titles, '' AS preferred_titles, inc AS include_keywords, '' AS preferred_keywords, 'sales roles' AS exclude_keywords, 'sales roles' AS excluded_role_categories,
  'Ville ' || c AS location_constraints, pref AS preferred_locations, CASE WHEN o_orderstatus IN ('F', 'P') THEN 'senior' ELSE '' END AS seniority_preferences, '' AS source_site_preferences,
  'Firm ' || c AS include_companies, 'Corp ' || c AS exclude_companies, rp AS remote_preference, 14 AS freshness_window_days,
  'must-have titles: ' || title || ' | must-have keywords: ' || inc || ' | excluded roles/categories: sales roles | required locations: Ville ' || c || ' | preferred locations: ' || pref
   || ' | target companies: Firm ' || c || ' | excluded companies: Corp ' || c || CASE WHEN rp <> 'unspecified' THEN ' | workplace preference: ' || rp ELSE '' END || ' | freshness window: 14 days' AS parser_notes,
  '' AS unresolved_fragments,
  'titles=' || title || ' | must=' || inc || ' | exclude=sales roles | locations=Ville ' || c || ' | companies=Firm ' || c || CASE WHEN rp <> 'unspecified' THEN ' | remote=' || rp ELSE '' END || ' | freshness=14d' AS summary
FROM u""",
    "prompt_constraints": r"""
WITH p AS (SELECT conv_id, turn, lower(text) AS t, turn AS k FROM conversations),
s AS (SELECT *, ['intern', 'entry', 'mid', 'senior', 'staff', 'principal', 'lead', 'manager', 'director', 'executive'] AS lv,
  CASE k WHEN 3 THEN ['staff', 'principal'] WHEN 7 THEN ['intern', 'entry', 'mid', 'executive'] WHEN 0 THEN [] WHEN 1 THEN [] WHEN 2 THEN [] WHEN 4 THEN [] WHEN 5 THEN [] WHEN 6 THEN [] ELSE ['senior', 'lead', 'manager'] END AS own FROM p)
SELECT conv_id, turn, CASE WHEN k = 5 THEN 'freshness window must be between 1 and 365 days' ELSE '' END AS error,
  CASE k WHEN 0 THEN 'remote_preferred' WHEN 1 THEN 'hybrid_only' WHEN 2 THEN 'onsite_only' WHEN 4 THEN 'remote_only' WHEN 5 THEN '' WHEN 6 THEN 'onsite_ok' ELSE 'unspecified' END AS remote_preference,
  CASE k WHEN 0 THEN 3 WHEN 1 THEN 7 WHEN 2 THEN 60 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 6 THEN 5 WHEN 7 THEN 1 ELSE -1 END AS days,
  CASE WHEN k = 5 THEN '' ELSE array_to_string(list_filter(lv, lambda l: list_contains(own, l) OR regexp_matches(t, '\b' || CASE l WHEN 'intern' THEN 'intern(ship)?' WHEN 'entry' THEN '(junior|jr|entry)' WHEN 'senior' THEN '(senior|sr)' WHEN 'executive' THEN '(executive|vp|chief)' ELSE l END || '\b')), ' | ') END AS seniority,
  CASE k WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'linkedin' WHEN 4 THEN 'lever' ELSE '' END AS sites FROM s""",
    "registry_match": f"""WITH {_INTENTS}
SELECT pid AS prompt_id, s_name AS company_name, site AS source_site, url AS board_url, upper(site[1]) || site[2:] || ' ' || s_name || {_DESC} AS label,
  'Planned for supported source site: ' || site || '. ' || {_CHOSEN} || ' Resolved board seed for ' || s_name || ': ' || url AS notes FROM boards""",
    "plan_errors": f"""WITH {_INTENTS}, named AS (SELECT pid, string_agg('SUPPLIER ' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0'), ', ' ORDER BY l_suppkey) AS names FROM ask GROUP BY pid)
SELECT pid AS prompt_id, CASE WHEN pr = '2-HIGH' THEN 'Intent requested unsupported source sites: my_site. Supported live sources: greenhouse, lever, linkedin'
  WHEN names IS NULL THEN 'Intent does not name any companies, so no board URLs can be resolved from the local registry.'
  WHEN pid NOT IN (SELECT pid FROM boards) THEN 'No board registry entries matched companies [' || names || '] for supported sources [' || array_to_string(sites, ', ') || '].'
  ELSE {_PLAN_NOTE} || ' Board seed URLs were selected from the local registry using explicit intent constraints only.' END AS text
FROM o LEFT JOIN named USING (pid)""",
    "plan_without_registry": f"""WITH {_INTENTS}
SELECT pid AS prompt_id, s AS source_site, CASE WHEN st = 'O' THEN upper(s[1]) || s[2:] || ' General Search' ELSE upper(s[1]) || s[2:] || {_DESC} END AS label,
  'Planned for supported source site: ' || s || '. ' || {_CHOSEN} || ' No board seed URL was inferred or generated.' AS notes,
  {_PLAN_NOTE} || ' Generated queries preserve intent constraints but remain non-executable until board seed URLs are provided.'
   || CASE WHEN pid IN (SELECT pid FROM ask) THEN ' Company hints were preserved, but no board URLs were inferred from company names.' ELSE '' END AS plan_notes, false AS executable
FROM (SELECT o.*, unnest(sites) AS s FROM o WHERE pr <> '2-HIGH')""",
    "discovery_queries": f"""WITH {_INTENTS}
SELECT pid AS prompt_id, url AS start_url, CASE st WHEN 'P' THEN reg || ' | ' ELSE '' END || 'api | API' || CASE st WHEN 'F' THEN ' | Backend Engineer' ELSE '' END AS include_keywords, seg AS exclude_keywords,
  CASE WHEN loc THEN lower(nat) || ' | ' ELSE '' END || 'Nowhere' AS location_hints FROM boards""",
    "registry_issues": """
WITH e AS (SELECT c_custkey AS idx, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment || ' Co. ' || c_nationkey END AS co, CASE WHEN c_nationkey > 20 THEN 'indeed' WHEN c_acctbal > 5000 THEN 'lever' ELSE 'greenhouse' END AS site,
   CASE WHEN c_acctbal > 9000 THEN 'x' ELSE 'https://b.test/' || CASE WHEN c_acctbal > 2000 THEN CAST(c_custkey AS VARCHAR) ELSE '' END END AS url FROM customer),
g AS (SELECT *, lower(regexp_replace(co, '[^A-Za-z0-9]+', '', 'g')) || '|' || site AS k1 FROM e WHERE co <> '' AND site <> 'indeed' AND url <> 'x'),
w AS (SELECT *, min(idx) OVER (PARTITION BY k1) AS f1, min(idx) OVER (PARTITION BY site, url) AS f2 FROM g)
SELECT idx, 0 AS rule, 'entry[' || idx || '] invalid: ' || array_to_string(list_filter([CASE WHEN co = '' THEN 'company_name: value must not be empty' END,
  CASE WHEN site = 'indeed' THEN 'source_site: source_site must be one of: greenhouse, lever, linkedin' END, CASE WHEN url = 'x' THEN 'board_url: not a web address' END], lambda x: x IS NOT NULL), '; ') AS issue
FROM e WHERE co = '' OR site = 'indeed' OR url = 'x'
UNION ALL SELECT w.idx, 1, 'duplicate company/source entry: ' || w.co || ' on ' || w.site || ' already maps to ' || b.url FROM w JOIN g b ON b.idx = w.f1 WHERE w.f1 < w.idx
UNION ALL SELECT w.idx, 2, 'duplicate board_url/source entry: ' || w.url || ' on ' || w.site || ' already exists for ' || b.co FROM w JOIN g b ON b.idx = w.f2 WHERE w.f2 < w.idx""",
    "registry_changes": """
WITH a AS (SELECT s_name AS co, CASE WHEN r_name = 'ASIA' THEN 'linkedin' WHEN s_acctbal > 4000 THEN 'greenhouse' ELSE 'lever' END AS site, 'https://boards.test/s' || s_suppkey AS url FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
b AS (SELECT 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS co, 'lever' AS site, 'https://boards.test/c' || c_custkey AS url FROM customer),
m AS (SELECT * FROM a UNION ALL SELECT * FROM b),
q AS (SELECT 'Supplier#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS co, CASE WHEN max(o_orderpriority) = '5-LOW' THEN 'lever' ELSE 'greenhouse' END AS site FROM orders GROUP BY o_custkey),
h AS (SELECT q.co, q.site, count(m.url) AS n, max(m.url) AS url FROM q LEFT JOIN m ON m.co = q.co AND m.site = q.site GROUP BY 1, 2)
SELECT 'left' AS what, co AS company_name, site AS source_site, url AS detail FROM m WHERE url NOT IN (SELECT url FROM h WHERE n = 1)
UNION ALL SELECT 'duplicate', '', '', 'duplicate company/source entry: ' || b.co || ' on lever already maps to ' || a.url FROM a JOIN b USING (co, site)
UNION ALL SELECT 'refused', replace(upper(co), '#', ' '), CASE site WHEN 'lever' THEN 'Lever' ELSE site END, CASE WHEN n = 0 THEN 'No registry entry matched the requested company/source combination.' ELSE 'Multiple registry entries matched. Name the board url to remove exactly one entry.' END FROM h WHERE n <> 1""",
}
_SEARCH = """
WITH it AS (SELECT o_custkey AS c, o_orderkey AS o, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT DISTINCT c, b.o, p FROM it JOIN (SELECT c, min(o) AS o FROM it GROUP BY c) b USING (c)),
ask AS (SELECT c_custkey AS pid, c_nationkey AS nk, b FROM customer, unnest(list_distinct([c_custkey, c_nationkey])) t(b)),
ev AS (SELECT pid, nk, b, o, p, NOT contains('part ' || p, 'part 1' || nk) AS passed FROM ask JOIN f ON f.c = ask.b)
"""
ORACLES["search_job"] = _SEARCH + """
SELECT pid AS prompt_id, count(DISTINCT b) AS boards, count(*) AS discovered, count(*) FILTER (passed) AS matched, count(*) FILTER (NOT passed) AS rejected FROM ev GROUP BY pid"""
ORACLES["search_matches"] = _SEARCH + """
SELECT pid AS prompt_id, 'greenhouse|https://boards.greenhouse.io/order/' || o AS query_id, p || '?utm_source=b' AS source_job_id, 'Part ' || p AS title, 0 AS score, '' AS reasons FROM ev WHERE passed"""
