"""Registered queries: decisions, history, listing, paging, checks, exports.

``events`` plays the decision log: the user is the posting, the event type the decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrid.catalog.common import joined, spread, stamp, table
from rolegrid.functions import reports
from rolegrid.operators import review, telemetry, validate
from rolegrid.sources import metadata, sinks

# event type -> decision; clicks are no decision
DECISION = {"signup": "saved", "error": "skipped", "view": "needs_manual_review", "purchase": "applied_elsewhere"}


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as log rows; the value serves as note where it is above 1."""
    names = F.create_map(*[F.lit(x) for pair in DECISION.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("u"), "user_id").alias("posting_url"),
        F.coalesce(names[F.col("event_type")], F.lit("clicked")).alias("decision"),
        F.date_trunc("day", "ts").alias("decided_at"),
        F.when(F.col("value") > 1, F.col("event_type")).alias("note"),
    )


def current_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = review.current_decisions(decision_log(spark, sf_dir))
    return found.select("posting_url", "decision", stamp("decided_at").alias("decided_at"), "note")


def decision_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest 20 per posting; equal times (whole days) fall back to the write order."""
    found = review.decision_history(decision_log(spark, sf_dir))
    return found.select("posting_url", "rank", "seq", "decision", stamp("decided_at").alias("decided_at"))


def order_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers as stored postings; the customer's key names the reviewed posting."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("u"), "o_custkey").alias("url"),
        F.lower("c_mktsegment").alias("source_site"), F.col("o_orderpriority").alias("title"), F.col("c_name").alias("company"),
        F.concat(F.lit("Nation "), "c_nationkey").alias("location"),
        F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "stale").otherwise("archived").alias("job_status"),
        F.when(F.col("o_totalprice") > 250000, "remote").otherwise("unknown").alias("remote_status"),
        F.lit("unknown").alias("employment_type"), F.lit("unknown").alias("seniority"),
        F.when(F.col("c_acctbal") > 0, F.floor(F.col("o_totalprice") / 1000)).cast("int").alias("score"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("posted_at"),
        F.col("o_orderdate").alias("discovered_at"),
    )


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = review.check_decisions(decision_log(spark, sf_dir))
    return review.current_decisions(good)


def review_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All filters over the whole table, without a page cut, with the decision attached."""
    current = _current(spark, sf_dir)
    kept = review.select_postings(
        order_postings(spark, sf_dir), current, job_status="active", remote_status="remote", location_contains="nation 1_",
        min_score=100, reviewed=False,
    )
    other = review.select_postings(order_postings(spark, sf_dir), current, decision="saved", location_contains="%ION 2")
    shown = review.attach_decisions(kept.unionByName(other), current)
    return reports.review_list_columns(shown)


def review_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of 40 by score, and the page numbers."""
    rows = review.select_postings(order_postings(spark, sf_dir), source_site="building")
    shown, info = review.page_of(rows, page=2, per_page=40, sort_by="score")
    return shown.select("id", "score", *[F.lit(v).cast("long").alias(k) for k, v in info.items()])


def review_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the listing under several sort orders and offsets."""
    rows = order_postings(spark, sf_dir)
    cuts = [("title", True, 30, 5), ("title", False, 30, -3), ("posted_at", False, 30, 0), ("posted_at", True, 30, 10),
            ("company", False, 20, 0), ("nonsense", True, 25, 0)]
    out = None
    for name, desc, limit, offset in cuts:
        part = review.list_postings(rows, sort_by=name, sort_desc=desc, limit=limit, offset=offset)
        part = part.select(F.lit(f"{name}-{desc}").alias("sorting"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of postings that are gone: the remaining postings are the suppliers."""
    log = decision_log(spark, sf_dir)
    postings = table(spark, sf_dir, "supplier").select(F.concat(F.lit("u"), "s_suppkey").alias("url"))
    current, history, counts = review.drop_orphans(review.current_decisions(log), log, postings)
    sizes = current.agg(F.count("*").alias("kept_decisions")).withColumn("k", F.lit(1)).join(
        history.agg(F.count("*").alias("kept_history")).withColumn("k", F.lit(1)), "k"
    )
    return sizes.join(counts.withColumn("k", F.lit(1)), "k").drop("k")


def review_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as postings with decision and history lines."""
    log = decision_log(spark, sf_dir)
    postings = table(spark, sf_dir, "supplier").select(F.concat(F.lit("u"), "s_suppkey").alias("url"), F.col("s_name").alias("title"))
    rows = review.posting_details(postings, review.current_decisions(log), log, k=5)
    return rows.select(
        "url", "title", "decision", "note", "reviewed", "decision_time",
        joined(F.coalesce(reports.history_lines("history"), F.array().cast("array<string>")), " ; ").alias("history"),
    )


def decision_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows with an unsupported decision, with the reason."""
    log = decision_log(spark, sf_dir).withColumn("decision", F.concat(F.lit(" "), F.upper("decision")))
    good, bad = review.check_decisions(log)
    return good.select("seq", "decision", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("seq", "decision", "reason")
    )


def metadata_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores out of JSON where some values are booleans, texts, null or fractions."""
    k = F.get_json_object("props", "$.k")
    doc = F.concat(
        F.lit('{"z":1,"team":"t'), "user_id", F.lit('","score":'),
        F.when(F.col("event_type") == "click", "true").when(F.col("event_type") == "error", F.concat(F.lit('"'), k, F.lit('"')))
        .when(F.col("event_type") == "signup", "null").when(F.col("event_type") == "view", F.concat(k, F.lit(".5"))).otherwise(k),
        F.lit("}"),
    )
    rows = table(spark, sf_dir, "events").select("event_id", doc.alias("metadata_json"))
    decoded = metadata.decode_metadata(spread(rows)).withColumn("number", review.json_score("metadata_json"))
    again = metadata.encode_metadata(decoded.drop("metadata_json"))
    return again.select(
        "event_id", "number", (F.coalesce(F.col("number") >= 50, F.lit(False))).alias("passes"), "team", "extra", "metadata_json"
    )


def export_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported columns of all postings."""
    rows = order_postings(spark, sf_dir).withColumn("source_job_id", F.when(F.col("job_status") == "stale", F.col("id").cast("string")))
    return sinks.export_rows(rows, _current(spark, sf_dir))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers as postings with faults of every kind; reasons per row."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("ma/ch")).otherwise(F.concat(F.lit(" My "), "c_mktsegment", F.lit("-x "))).alias("source_site"),
        F.when(F.col("o_orderstatus") == "P", F.lit("  ")).otherwise(F.col("o_orderkey").cast("string")).alias("source_job_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("ftp://h/"), "o_orderkey")).otherwise(F.concat(F.lit("HTTP://Ho.St?x="), "o_orderkey")).alias("url"),
        F.when(F.col("c_acctbal") < 0, F.lit(" \t ")).otherwise(F.concat(F.lit(" "), "c_name", F.lit("    t"))).alias("title"),
        F.col("c_name").alias("company"), F.lit("x").alias("location"),
        F.lower("o_orderpriority").alias("remote_status"), F.lit("full_time").alias("employment_type"), F.lit("lead").alias("seniority"),
        F.when(F.col("o_orderstatus") == "F", "active").otherwise("gone").alias("job_status"),
        F.col("o_orderdate").alias("posted_at"),
        F.when(F.col("o_totalprice") > 400000, F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("o_orderdate")).alias("discovered_at"),
        F.when(F.col("o_totalprice") < 50000, F.col("o_orderdate") - F.expr("INTERVAL 2 DAY")).otherwise(F.col("o_orderdate")).alias("last_seen_at"),
        F.lit("d").alias("description_text"),
    ).withColumn("remote_status", F.when(F.col("o_orderkey").isNotNull() & (F.col("remote_status") == "1-urgent"), "remote").otherwise(F.col("remote_status")))
    judged = validate.judge_postings(spread(rows))
    good, bad = validate.split_valid(judged)
    columns = ["o_orderkey", "source_site", "title", "url"]
    return good.select(*columns, F.lit("").alias("reasons")).unionByName(bad.select(*columns, joined("reasons", "; ").alias("reasons")))


def telemetry_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters per priority (the query) with orders as page visits and line items as postings."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    visits = orders.select(
        F.col("o_orderpriority").alias("query_id"), (F.col("o_orderstatus") != "F").alias("found"), F.lit("no_next").alias("stop")
    )
    parsed = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("query_id"), (F.col("l_returnflag") == "R").alias("selected"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).alias("detail_found"), "l_returnflag", "l_linestatus",
    )
    stored = parsed.where(F.col("l_returnflag") != "N").withColumn(
        "action", F.when(F.col("l_linestatus") == "O", "inserted").otherwise("updated")
    )
    queries = orders.select(F.col("o_orderpriority").alias("query_id")).distinct()
    counters = telemetry.discovery_counters(queries, visits, parsed, stored)
    totals = telemetry.with_totals(counters)
    return totals.select(F.coalesce("query_id", F.lit("total")).alias("query_id"), reports.discovery_line().alias("line"), "detail_pages_fetched")


QUERIES = {
    "current_decisions": current_decisions,
    "decision_history": decision_history,
    "review_filters": review_filters,
    "review_page": review_page,
    "review_sorts": review_sorts,
    "orphans": orphans,
    "review_detail": review_detail,
    "decision_checks": decision_checks,
    "metadata_score": metadata_score,
    "export_csv_rows": export_csv_rows,
    "quarantine": quarantine,
    "telemetry_rollup": telemetry_rollup,
}

_LOG = """log AS (SELECT event_id AS seq, 'u' || user_id AS posting_url,
  CASE event_type WHEN 'signup' THEN 'saved' WHEN 'error' THEN 'skipped' WHEN 'view' THEN 'needs_manual_review' WHEN 'purchase' THEN 'applied_elsewhere' ELSE 'clicked' END AS decision,
  date_trunc('day', ts) AS decided_at, CASE WHEN value > 1 THEN event_type END AS note FROM events)"""
_CUR = """cur AS (SELECT posting_url, decision, decided_at, note FROM log QUALIFY row_number() OVER (PARTITION BY posting_url ORDER BY seq DESC) = 1)"""
_GOOD = """cur AS (SELECT posting_url, decision, decided_at, note FROM log WHERE decision <> 'clicked' QUALIFY row_number() OVER (PARTITION BY posting_url ORDER BY seq DESC) = 1)"""
_POST = """post AS (SELECT o_orderkey AS id, 'u' || o_custkey AS url, lower(c_mktsegment) AS source_site, o_orderpriority AS title, c_name AS company, 'Nation ' || c_nationkey AS location,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'stale' ELSE 'archived' END AS job_status, CASE WHEN o_totalprice > 250000 THEN 'remote' ELSE 'unknown' END AS remote_status,
  CASE WHEN c_acctbal > 0 THEN CAST(floor(o_totalprice / 1000) AS INTEGER) END AS score, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS posted_at, o_orderdate AS discovered_at
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _sorted(name: str, order: str, limit: int, offset: int) -> str:
    return f"(SELECT '{name}' AS sorting, id FROM post ORDER BY {order} LIMIT {limit} OFFSET {offset})"


ORACLES = {
    "current_decisions": f"""WITH {_LOG}, {_CUR} SELECT posting_url, decision, strftime(decided_at, '%Y-%m-%d %H:%M:%S') AS decided_at, note FROM cur""",
    "decision_history": f"""WITH {_LOG}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY posting_url ORDER BY decided_at DESC, seq DESC) AS INTEGER) AS rank FROM log)
SELECT posting_url, rank, seq, decision, strftime(decided_at, '%Y-%m-%d %H:%M:%S') AS decided_at FROM r WHERE rank <= 20""",
    "review_filters": f"""WITH {_LOG}, {_GOOD}, {_POST},
kept AS (SELECT post.* FROM post WHERE job_status = 'active' AND remote_status = 'remote' AND location ILIKE '%nation 1_%' AND score >= 100 AND NOT EXISTS (SELECT 1 FROM cur WHERE posting_url = url)
  UNION ALL SELECT post.* FROM post WHERE location ILIKE '%%ION 2%' AND EXISTS (SELECT 1 FROM cur WHERE posting_url = url AND decision = 'saved'))
SELECT id, source_site, title, company, location, coalesce(CAST(score AS VARCHAR), 'n/a') AS score, job_status AS status, coalesce(decision, 'unreviewed') AS review, url
FROM kept LEFT JOIN cur ON posting_url = url""",
    "review_page": f"""WITH {_POST}, b AS (SELECT * FROM post WHERE source_site = 'building'), n AS (SELECT count(*) AS total_rows FROM b)
SELECT id, score, 2::BIGINT AS page, 40::BIGINT AS per_page, total_rows, CAST(ceil(total_rows / 40.0) AS BIGINT) AS total_pages
FROM (SELECT * FROM b ORDER BY score DESC NULLS LAST, id DESC LIMIT 40 OFFSET 40), n""",
    "review_sorts": f"""WITH {_POST} """ + " UNION ALL ".join([
        _sorted("title-True", "lower(title) DESC, id DESC", 30, 5), _sorted("title-False", "lower(title), id", 30, 0),
        _sorted("posted_at-False", "posted_at NULLS FIRST, id", 30, 0), _sorted("posted_at-True", "posted_at DESC NULLS LAST, id DESC", 30, 10),
        _sorted("company-False", "lower(company), id", 20, 0), _sorted("nonsense-True", "discovered_at DESC, id DESC", 25, 0)]),
    "orphans": f"""WITH {_LOG}, {_CUR}, p AS (SELECT 'u' || s_suppkey AS url FROM supplier),
c AS (SELECT count(*) FILTER (posting_url IN (FROM p)) AS kept_decisions, count(*) FILTER (posting_url NOT IN (FROM p)) AS removed_decisions FROM cur),
h AS (SELECT count(*) FILTER (posting_url IN (FROM p)) AS kept_history, count(*) FILTER (posting_url NOT IN (FROM p)) AS removed_history FROM log)
SELECT *, 'Removed ' || removed_decisions || ' orphaned review decisions and ' || removed_history || ' orphaned review history entries.' AS summary FROM c, h""",
    "review_detail": f"""WITH {_LOG}, {_CUR}, h AS (SELECT *, row_number() OVER (PARTITION BY posting_url ORDER BY decided_at DESC, seq DESC) AS r FROM log),
t AS (SELECT posting_url, string_agg(strftime(decided_at, '%Y-%m-%dT%H:%M:%S') || '+00:00 | ' || decision || ' | ' || coalesce(note, 'n/a'), ' ; ' ORDER BY r) AS history FROM h WHERE r <= 5 GROUP BY posting_url)
SELECT 'u' || s_suppkey AS url, s_name AS title, decision, note, CASE WHEN decision IS NULL THEN 'no' ELSE 'yes' END AS reviewed,
  strftime(decided_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS decision_time, coalesce(history, '') AS history
FROM supplier LEFT JOIN cur ON cur.posting_url = 'u' || s_suppkey LEFT JOIN t ON t.posting_url = 'u' || s_suppkey""",
    "decision_checks": f"""WITH {_LOG} SELECT seq, CASE WHEN decision = 'clicked' THEN ' CLICKED' ELSE decision END AS decision,
  CASE WHEN decision = 'clicked' THEN 'Invalid review decision '' CLICKED''. Supported decisions: saved, skipped, applied_elsewhere, needs_manual_review' END AS reason FROM log""",
    "metadata_score": """
WITH k AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
n AS (SELECT *, CASE event_type WHEN 'purchase' THEN CAST(k AS DOUBLE) WHEN 'view' THEN k + 0.5 END AS number FROM k)
SELECT event_id, number::DOUBLE AS number, coalesce(number >= 50, false) AS passes, 't' || user_id AS team,
  CASE event_type WHEN 'click' THEN '{"z":1,"score":true}' WHEN 'error' THEN '{"z":1,"score":"' || k || '"}' ELSE '{"z":1}' END AS extra,
  '{' || CASE event_type WHEN 'click' THEN '"score":true,' WHEN 'error' THEN '"score":"' || k || '",' WHEN 'purchase' THEN '"score":' || k || ',' WHEN 'view' THEN '"score":' || k || '.5,' ELSE '' END || '"team":"t' || user_id || '","z":1}' AS metadata_json FROM n""",
    "export_csv_rows": f"""WITH {_LOG}, {_GOOD}, {_POST}
SELECT source_site, CASE WHEN job_status = 'stale' THEN CAST(id AS VARCHAR) ELSE '' END AS source_job_id, title, company, location, url, remote_status, 'unknown' AS employment_type, 'unknown' AS seniority,
  coalesce(CAST(score AS VARCHAR), '') AS score, CASE WHEN decision IS NULL THEN 'false' ELSE 'true' END AS reviewed, coalesce(decision, '') AS decision FROM post LEFT JOIN cur ON posting_url = url""",
    "quarantine": """
WITH o AS (SELECT *, c_mktsegment = 'MACHINERY' AS badsite FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, CASE WHEN badsite THEN 'ma/ch' ELSE 'my_' || lower(c_mktsegment) || '_x' END AS source_site,
  CASE WHEN c_acctbal < 0 THEN '' ELSE c_name || ' t' END AS title,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'ftp://h/' || o_orderkey ELSE 'http://ho.st/?x=' || o_orderkey END AS url,
  array_to_string(list_filter([
    CASE WHEN c_acctbal < 0 THEN 'title: value must not be empty' END,
    CASE WHEN o_orderstatus = 'P' THEN 'source_job_id: value must not be empty' END,
    CASE WHEN badsite THEN 'source_site: must contain letters, numbers, spaces, hyphens, or underscores' END,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'url: not a web address' END,
    CASE WHEN o_orderpriority <> '1-URGENT' THEN 'remote_status: unsupported value' END,
    CASE WHEN o_orderstatus <> 'F' THEN 'job_status: unsupported value' END,
    CASE WHEN o_totalprice > 400000 THEN 'posted_at cannot be later than discovered_at' END,
    CASE WHEN o_totalprice < 50000 THEN 'last_seen_at cannot be earlier than discovered_at' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM o""",
    "telemetry_rollup": """
WITH v AS (SELECT o_orderpriority AS q, count(*) FILTER (o_orderstatus <> 'F') AS fetched, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY 1),
j AS (SELECT o_orderpriority AS q, count(*) AS parsed, count(*) FILTER (l_returnflag = 'R') AS sel, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS hit,
   count(*) FILTER (l_returnflag <> 'N' AND l_linestatus = 'O') AS ins, count(*) FILTER (l_returnflag <> 'N' AND l_linestatus <> 'O') AS upd, count(*) FILTER (l_returnflag = 'N') AS dup
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
t AS (SELECT coalesce(v.q, 'total') AS query_id, count(*) AS n, sum(fetched) AS f, sum(failed) AS e, sum(parsed) AS p, sum(ins) AS i, sum(upd) AS u, sum(dup) AS d, sum(sel) AS s, sum(hit) AS h
   FROM v JOIN j ON v.q = j.q GROUP BY ROLLUP (v.q))
SELECT query_id, 'queries=' || n || ' pages=' || f || ' failed_pages=' || e || ' jobs=' || p || ' inserted=' || i || ' updated=' || u || ' duplicates=' || d
  || ' detail_selected=' || s || ' detail_attempts=' || s || ' detail_successes=' || h || ' detail_failures=' || (s - h) AS line, CAST(h AS BIGINT) AS detail_pages_fetched FROM t""",
}
