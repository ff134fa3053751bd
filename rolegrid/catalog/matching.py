"""Registered queries: filtering, scoring, explaining.

``documents`` plays the postings: text is the description, source the board, language the location.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrid.catalog.common import joined, spread, sql_list, table, texts
from rolegrid.functions.reports import match_sentence
from rolegrid.functions import reports
from rolegrid.operators import matching, scoring
from rolegrid.schemas import LIST_CONSTRAINTS, CONSTRAINTS

NOW = "2024-02-01 00:00:00"

PROMPTS = [
    dict(prompt_id=1, boards=range(0, 12), include_keywords=["Pour", "tion"], preferred_keywords=["POUR", "ing"],
         target_titles=["French Document"], exclude_keywords=["zzz", "copyright"], location_constraints=["France", "spain"],
         remote_preference="remote_only", seniority_preferences=["senior", "lead"],
         source_site_preferences=["src0", "src1", "src2", "src3", "src4"], exclude_companies=["Source src2"]),
    dict(prompt_id=2, boards=range(5, 20), include_keywords=["the", "and"], preferred_titles=["document"],
         exclude_keywords=["license", "England"], preferred_locations=["england"], include_companies=["source src7"],
         remote_preference="hybrid_preferred"),
    dict(prompt_id=3, boards=range(0, 20), preferred_keywords=["ung", "der"], location_constraints=["Germany"],
         preferred_locations=["GERMANY"], remote_preference="onsite_ok", seniority_preferences=["entry"],
         exclude_companies=["Source src4", "source SRC6"]),
    dict(prompt_id=4, boards=[3, 4, 19], include_keywords=["de", "la"], exclude_keywords=["@", "http"],
         remote_preference="unspecified", excluded_role_categories=["sales"]),
]


def _lists(prompt: dict) -> dict:
    return {name: list(prompt.get(name, [])) for name in LIST_CONSTRAINTS}


def prompt_boards(spark: SparkSession) -> DataFrame:
    """One row per prompt and board it searches."""
    rows = [
        (p["prompt_id"], [f"src{b}" for b in p["boards"]],
         tuple({**_lists(p), "remote_preference": p["remote_preference"], "freshness_window_days": None}.values()))
        for p in PROMPTS
    ]
    df = spark.createDataFrame(rows, f"prompt_id int, boards array<string>, want {CONSTRAINTS.simpleString()}")
    return df.select("prompt_id", F.explode("boards").alias("board"), "want")


def document_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.create_map(*[F.lit(x) for x in ("fr", "Paris, France", "de", "Berlin, Germany", "es", "Madrid, Spain", "en", "London, England")])
    status = F.create_map(*[F.lit(x) for x in ("fr", "remote", "de", "onsite", "es", "hybrid", "en", "unknown")])
    name = F.create_map(*[F.lit(x) for x in ("fr", "French", "de", "German", "es", "Spanish", "en", "English")])
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("source_site"),
        F.col("source").alias("board"),
        F.concat(name[F.col("lang")], F.lit(" Document")).alias("title"),
        F.concat(F.lit("Source "), "source").alias("company"),
        place[F.col("lang")].alias("location"),
        status[F.col("lang")].alias("remote_status"),
        F.lit("unknown").alias("employment_type"),
        F.when(F.col("n_chars") > 2000, "senior").otherwise("entry").alias("seniority"),
        F.lit(None).cast("timestamp").alias("posted_at"),
        F.col("text").alias("description_text"),
    )


def evaluated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.candidates(spread(document_postings(spark, sf_dir)), prompt_boards(spark), on="board", spread="id")
    return matching.evaluate(pairs, F.lit(NOW).cast("timestamp"))


def match_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = matching.best_per_prompt(matching.matched(evaluated_documents(spark, sf_dir)), k=50)
    return best.select(
        "prompt_id", F.col("id").alias("doc_id"), "rank", F.col("match_score").alias("score"),
        joined("explanations").alias("explanations"), joined("score_reasons").alias("reasons"),
    )


def rejected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.rejected(evaluated_documents(spark, sf_dir)).select(
        "prompt_id", F.col("id").alias("doc_id"), "explanation"
    )


def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = prompt_boards(spark)
    counts = matching.search_summary(plan, evaluated_documents(spark, sf_dir))
    heads = plan.groupBy("prompt_id").agg(F.any_value("want").alias("want"))
    return counts.join(heads, "prompt_id").select(
        "prompt_id", "boards", "discovered", "matched", "rejected",
        reports.intent_line(F.col("want")).alias("intent_line"),
        reports.summary_line().alias("summary_line"),
    )


def match_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.matched(evaluated_documents(spark, sf_dir))
    return found.select(
        "prompt_id", F.col("id").alias("doc_id"),
        match_sentence(score="match_score", explanations="explanations").alias("sentence"),
    )


RULES = dict(
    include_keywords=["Tion", "document", "TION", "eau"], exclude_keywords=["spanish", "copyright"],
    preferred_companies=["src1"], discouraged_companies=["src2"], preferred_locations=["France", "london"],
    discouraged_locations=["madrid"],
)


def rule_table(spark: SparkSession, **extra: list[str]) -> DataFrame:
    from rolegrid.schemas import RULE_LISTS, RULES as RULE_TYPE

    rules = {**RULES, **extra}
    return spark.createDataFrame([tuple(rules.get(n, []) for n in RULE_LISTS)], RULE_TYPE)


def score_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = matching.with_search_text(spread(document_postings(spark, sf_dir)))
    return scoring.score_long(ready, scoring.long_rules(rule_table(spark)), "id").select(
        F.col("id").alias("doc_id"), "score", joined("score_explanations").alias("explanations")
    )


def freshness_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as postings with their time as posting date, under four windows."""
    windows = F.explode(F.array(*[F.lit(d) for d in (1, 7, 14, 365)]).cast("array<int>")).alias("days")
    pairs = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("posted_at"), windows)
    reasons = pairs.withColumn("want", F.struct(F.col("days").alias("freshness_window_days"))).withColumn(
        "reasons", matching.freshness_reasons(F.lit(NOW).cast("timestamp"))
    )
    return reasons.select("event_id", "days", joined("reasons").alias("reason"), (F.size("reasons") == 0).alias("passed"))


def workplace_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as postings: type decides the workplace, brand is the company; under all preferences."""
    from rolegrid.schemas import REMOTE_PREFERENCES

    kinds = F.create_map(*[F.lit(x) for x in ("ECONOMY", "remote", "SMALL", "hybrid", "STANDARD", "onsite")])
    preference = F.explode(texts(*REMOTE_PREFERENCES)).alias("preference")
    pairs = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("company"), F.lower("p_brand").alias("company_l"),
        F.coalesce(kinds[F.col("p_type")], F.lit("unknown")).alias("remote_status"), preference,
    )
    want = F.struct(F.col("preference").alias("remote_preference"), texts("brand#3", "BRAND#12", "Brand").alias("exclude_companies"))
    return pairs.withColumn("want", want).select(
        "p_partkey", "preference",
        joined(matching.remote_reasons()).alias("remote_reason"),
        joined(matching.excluded_company_reasons()).alias("company_reason"),
    )


def rescore_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as stored postings, scored by a rule set with preferences."""
    rules = rule_table(
        spark, include_keywords=["Red", "widget", "RED", "small"], exclude_keywords=["bolt"],
        preferred_companies=["brand#1"], discouraged_companies=["brand#2"], preferred_locations=["promo"],
        preferred_remote_statuses=["remote", "hybrid"], preferred_employment_types=["full_time"],
        preferred_seniority_levels=["senior"],
    )
    stored = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.col("p_type").alias("location"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("description_text"),
        F.when(F.col("p_size") > 25, "remote").otherwise("onsite").alias("remote_status"),
        F.when(F.col("p_retailprice") > 950, "full_time").otherwise("contract").alias("employment_type"),
        F.when(F.col("p_size") > 40, "senior").otherwise("unknown").alias("seniority"),
    )
    from rolegrid.operators.store import rule_set

    scored = scoring.score(matching.with_search_text(spread(stored)), rule_set(rules))
    return scored.select("p_partkey", "score", joined("score_explanations").alias("explanations"))


QUERIES = {
    "match_documents": match_documents,
    "rejected_documents": rejected_documents,
    "search_summary": search_summary,
    "match_sentence": match_sentences,
    "score_long_form": score_long_form,
    "freshness_events": freshness_events,
    "workplace_filter": workplace_filter,
    "rescore_parts": rescore_parts,
}

# ---- the same in DuckDB SQL -------------------------------------------------------------------------

_PROMPT_VALUES = ",\n".join(
    "(" + ", ".join(
        [str(p["prompt_id"]), sql_list([f"src{b}" for b in p["boards"]]), f"'{p['remote_preference']}'"]
        + [sql_list(v) for v in _lists(p).values()]
    ) + ")"
    for p in PROMPTS
)
_EVALUATED = f"""
WITH prompts(prompt_id, boards, remote_preference, {', '.join(LIST_CONSTRAINTS)}) AS (VALUES {_PROMPT_VALUES}),
postings AS (
  SELECT doc_id, source, 'Source ' || source AS company, text, lower(text) AS text_l,
    CASE lang WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE 'English' END || ' Document' AS title,
    CASE lang WHEN 'fr' THEN 'Paris, France' WHEN 'de' THEN 'Berlin, Germany' WHEN 'es' THEN 'Madrid, Spain' ELSE 'London, England' END AS location,
    CASE lang WHEN 'fr' THEN 'remote' WHEN 'de' THEN 'onsite' WHEN 'es' THEN 'hybrid' ELSE 'unknown' END AS remote_status,
    CASE WHEN n_chars > 2000 THEN 'senior' ELSE 'entry' END AS seniority
  FROM documents),
cand AS (
  SELECT p.*, q.*, lower(title) AS title_l, lower(company) AS company_l, lower(location) AS location_l
  FROM postings p JOIN prompts q ON list_contains(q.boards, p.source)),
judged AS (
  SELECT *,
    list_transform(list_filter(exclude_keywords, lambda k: contains(title_l, lower(k)) OR contains(company_l, lower(k)) OR contains(location_l, lower(k)) OR contains(text_l, lower(k))),
      lambda k: 'Excluded keyword ''' || k || ''' matched ' || CASE WHEN contains(title_l, lower(k)) THEN 'title' WHEN contains(company_l, lower(k)) THEN 'company' WHEN contains(location_l, lower(k)) THEN 'location' ELSE 'description' END)
    || list_transform(list_filter(exclude_companies, lambda c: lower(c) = company_l), lambda c: 'Company ''' || company || ''' matched excluded company hint ''' || c || '''')
    || CASE WHEN len(source_site_preferences) > 0 AND NOT list_contains(source_site_preferences, source)
        THEN ['Source site ''' || source || ''' is outside allowed source sites [' || array_to_string(source_site_preferences, ', ') || ']'] ELSE []::VARCHAR[] END
    || CASE WHEN len(location_constraints) > 0 AND len(list_filter(location_constraints, lambda l: contains(location_l, lower(l)))) = 0
        THEN ['Job location ''' || location || ''' did not match any required location constraint [' || array_to_string(location_constraints, ', ') || ']'] ELSE []::VARCHAR[] END
    || CASE WHEN remote_status = 'unknown' AND remote_preference IN ('remote_only', 'hybrid_only', 'onsite_only', 'hybrid_preferred')
        THEN ['Job remote status is unknown and cannot satisfy explicit requirement ''' || remote_preference || '''']
        WHEN remote_status <> 'unknown' AND remote_preference IN ('remote_only', 'hybrid_only', 'onsite_only') AND remote_preference <> remote_status || '_only'
        THEN ['Job remote status ''' || remote_status || ''' did not satisfy required ' || replace(remote_preference, '_', '-') || ' constraint'] ELSE []::VARCHAR[] END AS reasons
  FROM cand),
lists AS (
  SELECT *, [lower(x) FOR x IN include_keywords || preferred_keywords] AS kw0,
    [lower(x) FOR x IN include_keywords || preferred_keywords || target_titles || preferred_titles] AS tw0,
    [lower(x) FOR x IN location_constraints || preferred_locations] AS lw0,
    [lower(x) FOR x IN include_companies] AS cw, [lower(x) FOR x IN exclude_companies] AS xw,
    CASE WHEN remote_preference LIKE '%\\_only' ESCAPE '\\' OR remote_preference LIKE '%\\_preferred' ESCAPE '\\' THEN split_part(remote_preference, '_', 1) END AS wanted
  FROM judged),
scored AS (
  SELECT *,
    list_filter(kw0, lambda x, i: list_position(kw0, x) = i) AS kw,
    list_filter(tw0, lambda x, i: list_position(tw0, x) = i) AS tw,
    list_filter(lw0, lambda x, i: list_position(lw0, x) = i) AS lw FROM lists),
explained AS (
  SELECT *,
    [{{'p': 15, 't': '+15 title matched include keyword ''' || k || ''''}} FOR k IN tw IF contains(title_l, k)]
    || [{{'p': 15, 't': '+15 company matched include keyword ''' || k || ''''}} FOR k IN cw IF contains(company_l, k)]
    || [{{'p': -40, 't': '-40 company matched exclude keyword ''' || k || ''''}} FOR k IN xw IF contains(company_l, k)]
    || [{{'p': 15, 't': '+15 location matched include keyword ''' || k || ''''}} FOR k IN lw IF contains(location_l, k)]
    || [{{'p': 15, 't': '+15 description matched include keyword ''' || k || ''''}} FOR k IN kw IF contains(text_l, k)]
    || CASE WHEN wanted IS NULL THEN [] WHEN wanted = remote_status THEN [{{'p': 12, 't': '+12 remote_status matched preferred value ''' || remote_status || ''''}}]
        ELSE [{{'p': -10, 't': '-10 remote_status did not match preferred values'}}] END
    || CASE WHEN len(seniority_preferences) = 0 THEN [] WHEN list_contains(seniority_preferences, seniority) THEN [{{'p': 8, 't': '+8 seniority matched preferred value ''' || seniority || ''''}}]
        ELSE [{{'p': -6, 't': '-6 seniority did not match preferred values'}}] END AS ev
  FROM scored),
result AS (
  SELECT *, len(reasons) = 0 AS passed, CAST(coalesce(list_sum([e.p FOR e IN ev]), 0) AS INTEGER) AS score, [e.t FOR e IN ev] AS expl FROM explained)
"""


ORACLES = {
    "match_documents": _EVALUATED + """
SELECT prompt_id, doc_id, rank, score, array_to_string(expl, ' | ') AS explanations,
  array_to_string(list_filter(expl, lambda x: starts_with(x, '+'))[1:3], ' | ') AS reasons
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM result WHERE passed)
WHERE rank <= 50""",
    "rejected_documents": _EVALUATED + """
SELECT prompt_id, doc_id, array_to_string(reasons, '; ') AS explanation FROM result WHERE NOT passed""",
    "search_summary": _EVALUATED + """,
hl AS (SELECT prompt_id, list_filter([
   CASE WHEN len(target_titles) > 0 THEN 'titles=' || array_to_string(target_titles, ', ') END,
   CASE WHEN len(preferred_titles) > 0 THEN 'preferred_titles=' || array_to_string(preferred_titles, ', ') END,
   CASE WHEN len(include_keywords) > 0 THEN 'include=' || array_to_string(include_keywords, ', ') END,
   CASE WHEN len(preferred_keywords) > 0 THEN 'prefer=' || array_to_string(preferred_keywords, ', ') END,
   CASE WHEN len(exclude_keywords) > 0 THEN 'exclude=' || array_to_string(exclude_keywords, ', ') END,
   CASE WHEN len(excluded_role_categories) > 0 THEN 'exclude_roles=' || array_to_string(excluded_role_categories, ', ') END,
   CASE WHEN len(location_constraints) > 0 THEN 'locations=' || array_to_string(location_constraints, ', ') END,
   CASE WHEN len(preferred_locations) > 0 THEN 'preferred_locations=' || array_to_string(preferred_locations, ', ') END,
   CASE WHEN len(include_companies) > 0 THEN 'companies=' || array_to_string(include_companies, ', ') END,
   CASE WHEN len(exclude_companies) > 0 THEN 'exclude_companies=' || array_to_string(exclude_companies, ', ') END,
   CASE WHEN remote_preference <> 'unspecified' THEN 'remote=' || remote_preference END], lambda x: x IS NOT NULL) AS h, len(boards) AS boards FROM prompts)
SELECT hl.prompt_id, hl.boards, count(*) AS discovered, count(*) FILTER (passed) AS matched, count(*) FILTER (NOT passed) AS rejected,
  'Intent: ' || array_to_string(any_value(h), ' | ') AS intent_line,
  'Summary: boards=' || hl.boards || ' discovered=' || count(*) || ' matched=' || count(*) FILTER (passed) || ' rejected=' || count(*) FILTER (NOT passed) AS summary_line
FROM hl JOIN result USING (prompt_id) GROUP BY hl.prompt_id, hl.boards""",
    "match_sentence": _EVALUATED + """,
parts AS (SELECT prompt_id, doc_id, title, company, location, score,
   [replace(regexp_replace(e.t, '^[+-][0-9]+ ', ''), ' matched include keyword ', ' matched preferred keyword ') FOR e IN ev IF e.p > 0] AS pos,
   [replace(regexp_replace(e.t, '^[+-][0-9]+ ', ''), ' matched include keyword ', ' matched preferred keyword ') FOR e IN ev IF e.p < 0] AS neg
  FROM result WHERE passed)
SELECT prompt_id, doc_id, 'Match Summary: Potential match: ' || title || ' at ' || company || ' in ' || location || '. Score: ' || score || '.'
  || CASE WHEN len(pos) + len(neg) = 0 THEN ' No rule explanations were provided, so this summary uses the stored job fields only.'
     ELSE CASE WHEN len(pos) > 0 THEN ' Positive signals: ' || array_to_string(pos[1:2], '; ') || '.' ELSE '' END
       || CASE WHEN len(neg) > 0 THEN ' Possible concerns: ' || neg[1] || '.' ELSE '' END END AS sentence
FROM parts""",
    "score_long_form": """
WITH r(n, field, kind, kw) AS (VALUES (1,'t','include','tion'),(2,'t','include','document'),(3,'t','include','eau'),(4,'t','exclude','spanish'),(5,'t','exclude','copyright'),
  (6,'c','include','src1'),(7,'c','exclude','src2'),(8,'l','include','france'),(9,'l','include','london'),(10,'l','exclude','madrid'),
  (11,'d','include','tion'),(12,'d','include','document'),(13,'d','include','eau'),(14,'d','exclude','spanish'),(15,'d','exclude','copyright')),
p AS (SELECT doc_id, lower(CASE lang WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE 'English' END || ' Document') AS t,
  lower('Source ' || source) AS c,
  lower(CASE lang WHEN 'fr' THEN 'Paris, France' WHEN 'de' THEN 'Berlin, Germany' WHEN 'es' THEN 'Madrid, Spain' ELSE 'London, England' END) AS l, lower(text) AS d FROM documents),
h AS (SELECT doc_id, n, CASE kind WHEN 'include' THEN 15 ELSE -40 END AS pts, kind, kw,
   CASE field WHEN 't' THEN 'title' WHEN 'c' THEN 'company' WHEN 'l' THEN 'location' ELSE 'description' END AS fname
  FROM p JOIN r ON contains(CASE field WHEN 't' THEN t WHEN 'c' THEN c WHEN 'l' THEN l ELSE d END, kw))
SELECT p.doc_id, CAST(coalesce(sum(pts), 0) AS INTEGER) AS score,
  coalesce(string_agg(CASE WHEN pts > 0 THEN '+15 ' ELSE '-40 ' END || fname || ' matched ' || kind || ' keyword ''' || kw || '''', ' | ' ORDER BY n), '') AS explanations
FROM p LEFT JOIN h USING (doc_id) GROUP BY p.doc_id""",
    "freshness_events": f"""
SELECT event_id, days, CASE WHEN old THEN 'Job posted_at ''' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END
   || '+00:00'' is older than allowed freshness window ' || days || ' days' ELSE '' END AS reason, NOT old AS passed
FROM (SELECT event_id, ts, days, ts < TIMESTAMP '{NOW}' - to_days(days) AS old FROM events, (VALUES (1), (7), (14), (365)) v(days))""",
    "workplace_filter": """
WITH k AS (SELECT p_partkey, p_brand, CASE p_type WHEN 'ECONOMY' THEN 'remote' WHEN 'SMALL' THEN 'hybrid' WHEN 'STANDARD' THEN 'onsite' ELSE 'unknown' END AS s FROM part),
f(preference) AS (VALUES ('unspecified'), ('remote_only'), ('remote_preferred'), ('hybrid_only'), ('hybrid_preferred'), ('onsite_only'), ('onsite_preferred'), ('onsite_ok'))
SELECT p_partkey, preference,
  CASE WHEN s = 'unknown' AND preference IN ('remote_only', 'hybrid_only', 'hybrid_preferred', 'onsite_only')
         THEN 'Job remote status is unknown and cannot satisfy explicit requirement ''' || preference || ''''
       WHEN s <> 'unknown' AND preference IN ('remote_only', 'hybrid_only', 'onsite_only') AND split_part(preference, '_', 1) <> s
         THEN 'Job remote status ''' || s || ''' did not satisfy required ' || split_part(preference, '_', 1) || '-only constraint' ELSE '' END AS remote_reason,
  array_to_string(['Company ''' || p_brand || ''' matched excluded company hint ''' || c || '''' FOR c IN ['brand#3', 'BRAND#12', 'Brand'] IF lower(c) = lower(p_brand)], ' | ') AS company_reason
FROM k, f""",
    "rescore_parts": """
WITH p AS (SELECT p_partkey, lower(p_name) AS t, lower(p_brand) AS c, lower(p_type) AS l, lower(p_name || ' ' || p_type || ' ' || p_brand) AS d,
   CASE WHEN p_size > 25 THEN 'remote' ELSE 'onsite' END AS rs, p_retailprice > 950 AS ft, p_size > 40 AS sr FROM part),
e AS (SELECT p_partkey,
   ['+15 title matched include keyword ''' || k || '''' FOR k IN ['red', 'widget', 'small'] IF contains(t, k)]
   || [ '-40 title matched exclude keyword ''' || k || '''' FOR k IN ['bolt'] IF contains(t, k)]
   || CASE WHEN contains(c, 'brand#1') THEN ['+15 company matched include keyword ''brand#1'''] ELSE [] END
   || CASE WHEN contains(c, 'brand#2') THEN ['-40 company matched exclude keyword ''brand#2'''] ELSE [] END
   || CASE WHEN contains(l, 'promo') THEN ['+15 location matched include keyword ''promo'''] ELSE [] END
   || CASE WHEN contains(l, 'madrid') THEN ['-40 location matched exclude keyword ''madrid'''] ELSE [] END
   || ['+15 description matched include keyword ''' || k || '''' FOR k IN ['red', 'widget', 'small'] IF contains(d, k)]
   || ['-40 description matched exclude keyword ''' || k || '''' FOR k IN ['bolt'] IF contains(d, k)]
   || CASE WHEN rs = 'remote' THEN ['+12 remote_status matched preferred value ''remote'''] ELSE ['-10 remote_status did not match preferred values'] END
   || CASE WHEN ft THEN ['+8 employment_type matched preferred value ''full_time'''] ELSE ['-6 employment_type did not match preferred values'] END
   || CASE WHEN sr THEN ['+8 seniority matched preferred value ''senior'''] ELSE ['-6 seniority did not match preferred values'] END AS x FROM p)
SELECT p_partkey, CAST(list_sum([CAST(split_part(y, ' ', 1) AS INTEGER) FOR y IN x]) AS INTEGER) AS score, array_to_string(x, ' | ') AS explanations FROM e""",
}
