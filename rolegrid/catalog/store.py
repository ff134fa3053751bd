"""Registered queries: upsert, new matches, lifecycle, scores, prompts, enrichment, unions."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrid.catalog.common import joined, stamp, table, texts
from rolegrid.operators import crawl, matching, review, scoring, store
from rolegrid.operators.dedupe import canonicalize_postings
from rolegrid.schemas import POSTING, RULE_LISTS, RULES
from rolegrid.session import shared_dir
from rolegrid.sources.tables import BucketTable


def _ts(text: str):
    return F.lit(text).cast("timestamp")


def stored_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a stored posting."""
    rows = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 1).alias("id"), F.lit("shop").alias("source_site"),
        F.when(F.col("p_size") <= 40, F.concat(F.lit("J"), "p_partkey")).alias("source_job_id"),
        F.concat(F.lit("https://shop.test/p/"), "p_partkey").alias("url"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.col("p_type").alias("location"),
        F.when(F.col("p_size") > 25, "remote").otherwise("unknown").alias("remote_status"),
        F.lit("contract").alias("employment_type"), F.lit("unknown").alias("seniority"),
        F.when(F.col("p_size") > 45, "archived").otherwise("active").alias("job_status"),
        _ts("2024-01-01").alias("posted_at"), _ts("2024-01-02").alias("discovered_at"),
        (_ts("2024-01-02") + F.make_dt_interval(F.col("p_size"))).alias("last_seen_at"),
        F.when(F.col("p_size") > 10, F.concat(F.lit("About "), "p_name")).otherwise("Listing-only discovery from Shop").alias("description_text"),
        F.concat(F.lit("team "), "p_type").alias("team"), F.col("p_size").cast("double").alias("score"),
        F.concat(F.lit('{"size":'), "p_size", F.lit(',"old":true}')).alias("extra"),
    )
    return store.to_store_columns(rows).select(*[f.name for f in POSTING])


def incoming_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts seen in line items, and all suppliers: some by their url, some moved to a new url."""
    seen = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty"), F.max("l_shipdate").alias("day"))
    part = table(spark, sf_dir, "part").join(seen, F.col("p_partkey") == F.col("l_partkey"))
    moved = F.col("p_retailprice") > 950
    rows = part.select(
        (F.col("p_partkey") + 1).alias("seq"), F.lit("shop").alias("source_site"),
        F.when((F.col("p_size") <= 40) & (moved | (F.col("p_size") > 20)), F.concat(F.lit("J"), "p_partkey")).alias("source_job_id"),
        F.concat(F.when(moved, F.lit("https://shop.test/moved/")).otherwise(F.lit("https://shop.test/p/")), "p_partkey").alias("url"),
        F.concat(F.lit("New "), "p_name").alias("title"), F.col("p_brand").alias("company"),
        F.when(F.col("p_type") == "PROMO", "Unknown Location").otherwise(F.concat(F.lit("at "), "p_type")).alias("location"),
        F.when(F.col("p_size") < 15, "hybrid").otherwise("unknown").alias("remote_status"),
        F.lit("unknown").alias("employment_type"), F.lit("senior").alias("seniority"),
        _ts("2024-02-01").alias("discovered_at"), _ts("2024-02-01").alias("last_seen_at"),
        F.when(F.col("p_type") == "SMALL", F.lit("Fresh text")).otherwise(F.lit("Listing-only discovery from Shop")).alias("description_text"),
        F.when(F.col("p_type") == "LARGE", F.lit("new team")).alias("team"),
        F.concat(F.lit('{"qty":'), F.col("qty").cast("int"), F.lit(',"size":0}')).alias("extra"),
    )
    new = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1_000_000_000).alias("seq"), F.lit("shop").alias("source_site"), F.lit(None).cast("string").alias("source_job_id"),
        F.concat(F.lit("https://shop.test/s/"), "s_suppkey").alias("url"), F.col("s_name").alias("title"), F.lit("S").alias("company"),
        F.lit("here").alias("location"), F.lit("onsite").alias("remote_status"), F.lit("unknown").alias("employment_type"),
        F.lit("unknown").alias("seniority"), _ts("2024-02-01").alias("discovered_at"), _ts("2024-02-01").alias("last_seen_at"),
        F.lit("supplier").alias("description_text"),
    )
    return store.to_store_columns(rows.unionByName(new, allowMissingColumns=True))


def _plain(postings: DataFrame) -> DataFrame:
    return postings.select(
        "id", "source_job_id", "url", "title", "location", "remote_status", "employment_type", "seniority", "job_status",
        stamp("posted_at").alias("posted_at"), stamp("last_seen_at").alias("last_seen_at"), "description_text", "team",
        F.coalesce("score", F.lit(-1.0)).alias("score"), "extra",
    )


def upsert_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(store.upsert_postings(stored_parts(spark, sf_dir), incoming_parts(spark, sf_dir))["store"])


def upsert_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same parts written to a table in buckets, by an upsert into the empty table and one of what comes in."""
    stored = BucketTable(spark, os.path.join(shared_dir(spark), f"postings-{uuid.uuid4().hex}"), buckets=16)
    stored.upsert(stored_parts(spark, sf_dir).withColumnRenamed("id", "seq"))
    stored.upsert(incoming_parts(spark, sf_dir))
    return _plain(stored.read())


def upsert_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = store.upsert_postings(stored_parts(spark, sf_dir), incoming_parts(spark, sf_dir))
    return result["outcome"].groupBy("action").agg(F.count("*").alias("n"))


def new_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as matches of parts: what the store of all parts lacks (those without an id), first line item first."""
    stored = stored_parts(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem")
    found = items.groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("o")).select(
        F.concat_ws("-", F.lpad(F.col("o").cast("string"), 12, "0"), "l_partkey", "l_suppkey").alias("ord"),
        F.lit("shop").alias("source_site"), F.concat(F.lit("J"), "l_partkey").alias("source_job_id"),
        F.concat(F.lit("https://shop.test/p/"), "l_partkey", F.lit("/"), "l_suppkey").alias("url"),
    )
    return store.insert_new_matches(stored, found, "ord").select("ord", "url", "source_job_id")


def seen_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as stored postings, last seen at their last event."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max("ts").alias("last_seen_at"), F.min("ts").alias("discovered_at"), F.max_by("event_type", "event_id").alias("e")
    ).select(
        F.col("user_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("url"), "last_seen_at", "discovered_at",
        F.when(F.col("e") == "error", "archived").when(F.col("e") == "view", "stale").otherwise("active").alias("job_status"),
        F.col("e").alias("source_site"),
    )


def mark_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table, and the newest 60 only (the maintenance limit)."""
    now = _ts("2024-01-31 12:00:00")
    full = store.mark_stale(seen_users(spark, sf_dir), 1, now, limit=None)["store"]
    cut = store.mark_stale(seen_users(spark, sf_dir), 1, now, limit=60)["store"]
    return full.select("id", "job_status").join(cut.select("id", F.col("job_status").alias("limited_status")), "id")


def upsert_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sightings of their parts, one after the other: each under one of two urls of the part, every
    fourth without the part's id. So urls move, new postings appear beside the stored one, and some sightings conflict."""
    stored = stored_parts(spark, sf_dir)
    # all that a sighting says follows from these three numbers, so repeats go before its texts are spelled
    sighted = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("line"), "l_partkey", (F.col("l_suppkey") % 2).alias("side")).distinct()
    line, side = F.col("line"), F.col("side")
    seq = (line * 1_000_000 + F.col("l_partkey")) * 2 + side
    rows = sighted.select(
        seq.alias("seq"), F.lit("shop").alias("source_site"), F.when(line % 4 != 0, F.concat(F.lit("J"), "l_partkey")).alias("source_job_id"),
        F.concat(F.lit("https://shop.test/m/"), "l_partkey", F.lit("/"), side).alias("url"), F.concat(F.lit("Seen "), seq).alias("title"),
        F.lit("C").alias("company"), F.lit("here").alias("location"), F.lit("unknown").alias("remote_status"), F.lit("unknown").alias("employment_type"), F.lit("unknown").alias("seniority"),
        F.lit("d").alias("description_text"), F.lit(None).cast("string").alias("extra"),
    )
    out = store.upsert_postings(stored, store.to_store_columns(rows, _ts("2024-02-01")))
    return out["store"].select("id", "url", "source_job_id", "title")


RESCORE_RULES = {
    "include_keywords": ["Red", "steel"], "exclude_keywords": ["bolt"], "preferred_locations": ["promo"], "discouraged_companies": ["brand#1"],
    "preferred_remote_statuses": ["remote"],
}


def rescore_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored parts scored again by one rule set."""
    rules = spark.createDataFrame([tuple(RESCORE_RULES.get(n, []) for n in RULE_LISTS)], RULES)
    out = store.rescore(stored_parts(spark, sf_dir), rules)["store"]
    return out.select("id", "score", joined("score_explanations").alias("why"))


def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and states of parts replaced for the urls that have an update."""
    rows = stored_parts(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("https://shop.test/p/"), "l_partkey").alias("url")).agg(
        F.count("*").cast("int").alias("score"), F.max("l_returnflag").alias("flag")
    )
    scored = items.select("url", "score", F.array(F.concat(F.lit("+"), "score")).alias("score_explanations"))
    changes, _ = review.check_statuses(
        items.select("url", F.when(F.col("flag") == "R", " Archived").when(F.col("flag") == "N", "STALE").otherwise("odd").alias("job_status"))
    )
    out = store.set_status(store.write_scores(rows, scored), changes)
    return out.select("id", "score", joined(F.coalesce("score_explanations", F.array().cast("array<string>"))).alias("why"), "job_status")


def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old tables without status and last-seen time."""
    old = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("discovered_at"),
        (F.col("o_orderdate") - F.expr("INTERVAL 3 DAY")).alias("posted_at"),
    )
    return store.backfill(old).select("o_orderkey", "job_status", stamp("last_seen_at").alias("last_seen_at"))


def prompt_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as writes of a named prompt; system and assistant turns are stored already."""
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id").alias("name"), F.col("text").alias("raw_prompt_text"),
        (_ts("2024-01-01") + F.make_dt_interval(F.col("turn").cast("int"))).alias("created_at"), F.col("turn").alias("seq"), "role",
    ).withColumn("updated_at", F.col("created_at"))
    old, new = turns.where("role <> 'user'").drop("role"), turns.where("role = 'user'").drop("role")
    out = store.upsert_prompts(old, new)
    return out.select("name", F.md5("raw_prompt_text").alias("text_md5"), stamp("created_at").alias("created_at"), stamp("updated_at").alias("updated_at"))


def enrich_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listings, their line items as detail pages; selective by listing-stage score."""
    listing = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("p"), "p_partkey").alias("detail_url"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"),
        F.col("p_type").alias("location"), F.lit("Listing-only discovery from Shop").alias("description_text"),
        F.when(F.col("p_size") > 20, "onsite").otherwise("unknown").alias("remote_status"), F.lit("unknown").alias("employment_type"),
        F.lit("unknown").alias("seniority"), F.col("p_type").alias("team"), F.lit("w").alias("workplace_type"),
        F.lit(None).cast("string").alias("employment_type_text"), F.lit(None).cast("string").alias("posted_time"),
        texts("Red", "shop", "brand#1").alias("include_keywords"), texts("BOLT", "listing").alias("exclude_keywords"),
        texts("promo", "small").alias("location_hints"),
    )
    items = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.max("l_returnflag").alias("flag"))
    details = items.select(
        F.concat(F.lit("p"), "l_partkey").alias("url"),
        F.when(F.col("n") > 30, F.concat(F.lit("Hall "), "n")).otherwise("Unknown location").alias("location"),
        F.when(F.col("flag") == "R", "remote").otherwise("unknown").alias("remote_status"), F.lit("full_time").alias("employment_type"),
        F.lit("unknown").alias("seniority"),
        F.when(F.col("n") > 28, F.concat(F.lit("Sold "), "n")).otherwise("Listing-only discovery from X").alias("description_text"),
        F.when(F.col("n") > 29, "floor").alias("team"), F.lit("").alias("workplace_type"), F.lit("Full").alias("employment_type_text"),
        F.lit(None).cast("string").alias("posted_time"),
    )
    chosen = crawl.select_for_enrichment(listing, selective=True, min_score=1)
    points = scoring.listing_stage_score(F.col("include_keywords"), F.col("exclude_keywords"), F.col("location_hints"))
    out = crawl.enrich(chosen, details, order="p_partkey").transform(matching.with_search_text)
    stage_score = matching.with_search_text(listing).select("p_partkey", points.alias("stage_score"))
    return out.join(stage_score, "p_partkey").select(
        "p_partkey", "stage_score", "selected", "detail_found", "location", "remote_status", "employment_type", "description_text",
        "team", "workplace_type", "employment_type_text",
    )


def pages_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of both schemes taken together, and the distinct canonical urls and hosts seen (ST1, AG7)."""
    from rolegrid.functions.urls import url_host

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.lit("acme").alias("source_site"))
    both = pages.where(F.col("url").startswith("https:")).unionByName(pages.where(F.col("url").startswith("http:")))
    seen = canonicalize_postings(both).select("url", url_host("url").alias("host")).distinct()
    return seen.groupBy("host").agg(F.count("*").alias("urls"))


QUERIES = {
    "upsert_store": upsert_store,
    "upsert_buckets": upsert_buckets,
    "upsert_outcome": upsert_outcome,
    "upsert_moves": upsert_moves,
    "rescore_store": rescore_store,
    "new_matches": new_matches,
    "mark_stale": mark_stale,
    "status_updates": status_updates,
    "backfilled": backfilled,
    "prompt_upsert": prompt_upsert,
    "enrich_parts": enrich_parts,
    "pages_union": pages_union,
}

_UPSERT = """
WITH st AS (SELECT p.*, p_partkey + 1 AS id, CASE WHEN p_size <= 40 THEN 'J' || p_partkey END AS jid FROM part p),
li AS (SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1),
inc AS (SELECT p_partkey AS k, p_partkey + 1 AS seq, CASE WHEN p_size <= 40 AND (p_retailprice > 950 OR p_size > 20) THEN 'J' || p_partkey END AS jid, p_retailprice > 950 AS moved,
   'https://shop.test/' || CASE WHEN p_retailprice > 950 THEN 'moved/' ELSE 'p/' END || p_partkey AS url, 'New ' || p_name AS title,
   CASE WHEN p_type = 'PROMO' THEN 'Unknown Location' ELSE 'at ' || p_type END AS location, CASE WHEN p_size < 15 THEN 'hybrid' ELSE 'unknown' END AS rs,
   CASE WHEN p_type = 'SMALL' THEN 'Fresh text' ELSE 'Listing-only discovery from Shop' END AS d, CASE WHEN p_type = 'LARGE' THEN 'new team' END AS team, CAST(qty AS INTEGER) AS qty
  FROM part JOIN li ON l_partkey = p_partkey),
hit AS (SELECT * FROM inc WHERE NOT moved OR jid IS NOT NULL),
fresh AS (SELECT seq, jid, url, title, location, rs, 'unknown' AS et, 'senior' AS sen, d, team, '{"qty":' || qty || ',"size":0}' AS extra FROM inc WHERE moved AND jid IS NULL
  UNION ALL SELECT s_suppkey + 1000000000, NULL, 'https://shop.test/s/' || s_suppkey, s_name, 'here', 'onsite', 'unknown', 'unknown', 'supplier', NULL, NULL FROM supplier),
final AS (
 SELECT st.id, coalesce(h.jid, st.jid) AS source_job_id, coalesce(h.url, 'https://shop.test/p/' || p_partkey) AS url, coalesce(h.title, p_name) AS title,
  CASE WHEN h.k IS NULL OR h.location = 'Unknown Location' THEN p_type ELSE h.location END AS location,
  CASE WHEN h.rs <> 'unknown' THEN h.rs WHEN p_size > 25 THEN 'remote' ELSE 'unknown' END AS remote_status, 'contract' AS employment_type,
  CASE WHEN h.k IS NULL THEN 'unknown' ELSE 'senior' END AS seniority, CASE WHEN h.k IS NULL AND p_size > 45 THEN 'archived' ELSE 'active' END AS job_status,
  CASE WHEN h.k IS NULL THEN '2024-01-01 00:00:00' END AS posted_at,
  strftime(CASE WHEN h.k IS NULL THEN TIMESTAMP '2024-01-02' + to_days(p_size) ELSE greatest(TIMESTAMP '2024-01-02' + to_days(p_size), TIMESTAMP '2024-02-01') END, '%Y-%m-%d %H:%M:%S') AS last_seen_at,
  CASE WHEN h.d = 'Fresh text' THEN h.d WHEN p_size > 10 THEN 'About ' || p_name ELSE 'Listing-only discovery from Shop' END AS description_text,
  coalesce(h.team, 'team ' || p_type) AS team, p_size AS score,
  CASE WHEN h.k IS NULL THEN '{"size":' || p_size || ',"old":true}' ELSE '{"old":true,"qty":' || h.qty || ',"size":0}' END AS extra
 FROM st LEFT JOIN hit h ON h.k = st.p_partkey
 UNION ALL
 SELECT (SELECT max(id) FROM st) + row_number() OVER (ORDER BY seq), jid, url, title, location, rs, et, sen, 'active', NULL, '2024-02-01 00:00:00', d, team, NULL, extra FROM fresh)
"""

ORACLES = {
    "upsert_store": _UPSERT + "SELECT * REPLACE (CAST(coalesce(score, -1) AS DOUBLE) AS score) FROM final",
    "upsert_buckets": _UPSERT + """SELECT * REPLACE (CAST(coalesce(score, -1) AS DOUBLE) AS score, regexp_replace(extra, '^.\"size\":(\\d+),\"old\":true.$', '{"old":true,"size":\\1}') AS extra) FROM final""",
    "upsert_outcome": _UPSERT + "SELECT 'updated' AS action, count(*) AS n FROM hit UNION ALL SELECT 'inserted', count(*) FROM fresh",
    "upsert_moves": """
WITH RECURSIVE li AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY seq) AS n FROM (SELECT DISTINCT l_partkey AS p,
   ((l_orderkey * 8 + l_linenumber)::BIGINT * 1000000 + l_partkey) * 2 + l_suppkey % 2 AS seq, (l_orderkey * 8 + l_linenumber) % 4 <> 0 AS has, l_suppkey % 2 AS k FROM lineitem)),
r AS (
 SELECT p_partkey AS p, 0::BIGINT AS n, 0 AS u0, 0 AS u1, CASE WHEN p_size <= 40 THEN 1 ELSE 0 END AS j, 1 AS cnt, 0 AS t, 0::BIGINT AS seq, 0::BIGINT AS k FROM part
 UNION ALL
 SELECT p, n, CASE WHEN t = 0 THEN u0 WHEN k = 0 THEN t WHEN u0 = t THEN 0 ELSE u0 END, CASE WHEN t = 0 THEN u1 WHEN k = 1 THEN t WHEN u1 = t THEN 0 ELSE u1 END,
  CASE WHEN t = 0 OR NOT has THEN j ELSE t END, greatest(cnt, t), t, seq, k
 FROM (SELECT p, n, u0, u1, j, cnt, has, seq, k, CASE WHEN x > 0 AND y > 0 AND x <> y THEN 0 WHEN x > 0 THEN x WHEN y > 0 THEN y ELSE cnt + 1 END AS t
  FROM (SELECT r.p, li.n, u0, u1, j, cnt, has, li.seq, li.k, CASE li.k WHEN 0 THEN u0 ELSE u1 END AS x, CASE WHEN has THEN j ELSE 0 END AS y
   FROM r JOIN li ON li.p = r.p AND li.n = r.n + 1))),
seen AS (SELECT p, t, arg_max(k, seq) AS k, max(seq) AS seq, min(seq) AS first FROM r WHERE t > 0 GROUP BY p, t),
held AS (SELECT p, arg_max(j, n) AS j FROM r GROUP BY p),
touched AS (SELECT seen.*, CASE WHEN j = t THEN 'J' || p END AS jid FROM seen JOIN held USING (p))
SELECT p_partkey + 1 AS id, coalesce('https://shop.test/m/' || p_partkey || '/' || k, 'https://shop.test/p/' || p_partkey) AS url,
  CASE WHEN k IS NULL THEN CASE WHEN p_size <= 40 THEN 'J' || p_partkey END ELSE jid END AS source_job_id, coalesce('Seen ' || seq, p_name) AS title
FROM part LEFT JOIN touched ON p = p_partkey AND t = 1
UNION ALL
SELECT (SELECT max(p_partkey) + 1 FROM part) + row_number() OVER (ORDER BY first), 'https://shop.test/m/' || p || '/' || k, jid, 'Seen ' || seq FROM touched WHERE t > 1""",
    "rescore_store": """
WITH e AS (SELECT p_partkey + 1 AS id, list_filter([
  CASE WHEN contains(lower(p_name), 'red') THEN {'p': 15, 't': '+15 title matched include keyword ''red'''} END, CASE WHEN contains(lower(p_name), 'steel') THEN {'p': 15, 't': '+15 title matched include keyword ''steel'''} END,
  CASE WHEN contains(lower(p_name), 'bolt') THEN {'p': -40, 't': '-40 title matched exclude keyword ''bolt'''} END,
  CASE WHEN contains(lower(p_brand), 'brand#1') THEN {'p': -40, 't': '-40 company matched exclude keyword ''brand#1'''} END,
  CASE WHEN contains(lower(p_type), 'promo') THEN {'p': 15, 't': '+15 location matched include keyword ''promo'''} END,
  CASE WHEN p_size > 10 AND contains(lower(p_name), 'red') THEN {'p': 15, 't': '+15 description matched include keyword ''red'''} END,
  CASE WHEN p_size > 10 AND contains(lower(p_name), 'steel') THEN {'p': 15, 't': '+15 description matched include keyword ''steel'''} END,
  CASE WHEN p_size > 10 AND contains(lower(p_name), 'bolt') THEN {'p': -40, 't': '-40 description matched exclude keyword ''bolt'''} END,
  CASE WHEN p_size > 25 THEN {'p': 12, 't': '+12 remote_status matched preferred value ''remote'''} ELSE {'p': -10, 't': '-10 remote_status did not match preferred values'} END
 ], lambda x: x IS NOT NULL) AS e FROM part)
SELECT id, list_sum(list_transform(e, lambda x: x.p))::DOUBLE AS score, array_to_string(list_transform(e, lambda x: x.t), ' | ') AS why FROM e""",
    "new_matches": """
WITH stored AS (SELECT p_partkey, CASE WHEN p_size <= 40 THEN 'J' || p_partkey END AS jid FROM part),
f AS (SELECT lpad(CAST(min(l_orderkey) AS VARCHAR), 12, '0') || '-' || l_partkey || '-' || l_suppkey AS ord, 'J' || l_partkey AS jid, 'https://shop.test/p/' || l_partkey || '/' || l_suppkey AS url FROM lineitem GROUP BY l_partkey, l_suppkey)
SELECT ord, url, jid AS source_job_id FROM f WHERE jid NOT IN (SELECT jid FROM stored WHERE jid IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY jid ORDER BY ord) = 1""",
    "mark_stale": """
WITH u AS (SELECT user_id AS id, max(ts) AS seen, min(ts) AS disc, CASE arg_max(event_type, event_id) WHEN 'error' THEN 'archived' WHEN 'view' THEN 'stale' ELSE 'active' END AS s FROM events GROUP BY 1),
c AS (SELECT id FROM u WHERE s = 'active' ORDER BY disc DESC, id DESC LIMIT 60)
SELECT id, CASE WHEN s = 'active' AND seen < TIMESTAMP '2024-01-30 12:00:00' THEN 'stale' ELSE s END AS job_status,
  CASE WHEN s = 'active' AND seen < TIMESTAMP '2024-01-30 12:00:00' AND id IN (FROM c) THEN 'stale' ELSE s END AS limited_status FROM u""",
    "status_updates": """
WITH i AS (SELECT l_partkey, CAST(count(*) AS INTEGER) AS n, max(l_returnflag) AS f FROM lineitem GROUP BY 1)
SELECT p_partkey + 1 AS id, CAST(coalesce(n, p_size) AS DOUBLE) AS score, coalesce('+' || n, '') AS why,
  CASE WHEN f = 'R' THEN 'archived' WHEN f = 'N' THEN 'stale' WHEN p_size > 45 THEN 'archived' ELSE 'active' END AS job_status FROM part LEFT JOIN i ON l_partkey = p_partkey""",
    "backfilled": """
SELECT o_orderkey, 'active' AS job_status, strftime(CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE o_orderdate - INTERVAL 3 DAY END, '%Y-%m-%d %H:%M:%S') AS last_seen_at FROM orders""",
    "prompt_upsert": """
WITH t AS (SELECT 'c' || conv_id AS name, text, turn, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS n FROM conversations)
SELECT name, md5(arg_max(text, (n, turn))) AS text_md5, strftime(TIMESTAMP '2024-01-01' + to_days(CAST(arg_min(turn, (n, turn)) AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS created_at,
  strftime(TIMESTAMP '2024-01-01' + to_days(CAST(arg_max(turn, (n, turn)) AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS updated_at FROM t GROUP BY name""",
    "enrich_parts": """
WITH i AS (SELECT l_partkey, count(*) AS n, max(l_returnflag) AS f FROM lineitem GROUP BY 1),
s AS (SELECT *, (CASE WHEN contains(p_name, 'red') THEN 3 ELSE 0 END) + 1 + (CASE WHEN contains(lower(p_brand), 'brand#1') THEN 1 ELSE 0 END)
   + (CASE WHEN p_type = 'PROMO' THEN 2 ELSE 0 END) + (CASE WHEN p_type = 'SMALL' THEN 2 WHEN contains(p_name, 'small') THEN 1 ELSE 0 END)
   - (CASE WHEN contains(p_name, 'bolt') THEN 3 ELSE 0 END) - 1 AS sc FROM part),
d AS (SELECT s.*, n, f, sc >= 1 AS sel, sc >= 1 AND n IS NOT NULL AS hit FROM s LEFT JOIN i ON l_partkey = p_partkey)
SELECT p_partkey, CAST(sc AS INTEGER) AS stage_score, sel AS selected, hit AS detail_found, CASE WHEN hit AND n > 30 THEN 'Hall ' || n ELSE p_type END AS location,
  CASE WHEN hit AND f = 'R' THEN 'remote' WHEN p_size > 20 THEN 'onsite' ELSE 'unknown' END AS remote_status, CASE WHEN hit THEN 'full_time' ELSE 'unknown' END AS employment_type,
  CASE WHEN hit AND n > 28 THEN 'Sold ' || n ELSE 'Listing-only discovery from Shop' END AS description_text, CASE WHEN hit AND n > 29 THEN 'floor' ELSE p_type END AS team,
  'w' AS workplace_type, CASE WHEN hit THEN 'Full' END AS employment_type_text FROM d""",
    "pages_union": r"""
WITH c AS (SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^(https?)', 1) AS s, rtrim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/') AS p,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '=.') AND NOT starts_with(x, 'utm_') AND split_part(x, '=', 1) NOT IN ('ref', 'source', 'gclid', 'fbclid', 'trk'))), '&') AS q FROM pages)
SELECT host, count(DISTINCT (s, p, q)) AS urls FROM c GROUP BY host""",
}
