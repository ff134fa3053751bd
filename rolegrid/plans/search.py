"""Prompt search: prompts to constraints, boards, postings and verdicts, for a table of prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.operators.intents import parse_prompts
from rolegrid.operators.matching import candidates, evaluate, search_summary
from rolegrid.operators.registry import compile_plan, not_executable, to_discovery_queries
from rolegrid.operators.store import to_store_columns
from rolegrid.plans.discovery import DiscoveryOptions, collect_postings
from rolegrid.session import stage


def search(prompts: DataFrame, registry: DataFrame, pages: DataFrame, options: DiscoveryOptions = DiscoveryOptions(),
           now: Column | None = None) -> dict[str, DataFrame]:
    """Evaluate every prompt against the postings of the boards it resolves to (CJ2).

    ``prompts(prompt_id, raw_prompt_text)``. A board named by many prompts is walked once; its postings
    meet each of those prompts in an equi join on the board. Only with selective enrichment, where the
    prompt's keywords decide what is read, each prompt walks its boards by itself.
    Returns ``intents``, ``queries``, ``errors``, ``evaluated`` and ``summary``.
    """
    intents = stage(parse_prompts(prompts.select("prompt_id", "raw_prompt_text")), "intents")
    bad = intents.where("error IS NOT NULL").select("prompt_id", "error")
    plan = compile_plan(intents.drop("error"), registry)
    queries = stage(plan["queries"], "queries")
    starts = to_discovery_queries(queries)
    board = F.concat_ws("|", "source_site", "start_url")
    if options.selective_detail_enrichment:
        board = F.concat_ws("|", F.col("prompt_id").cast("string"), "source_site", "start_url")
    starts = stage(starts.withColumn("query_id", board), "starts")
    walked = starts.drop("prompt_id", "label").dropDuplicates(["query_id"])
    found = collect_postings(walked, pages, options)
    wants = starts.select("prompt_id", "query_id").join(intents.select("prompt_id", "want"), "prompt_id")
    # the lists that the board was walked with are those of any one of its prompts; a pair has its own prompt's ``want``
    postings = to_store_columns(found["postings"].drop("include_keywords", "exclude_keywords", "location_hints"), now)
    evaluated = stage(evaluate(candidates(postings, wants, on="query_id", spread="ord"), now), "evaluated")
    planned = intents.where("error IS NULL").join(plan["errors"].select("prompt_id"), "prompt_id", "left_anti")
    errors = bad.unionByName(plan["errors"]).unionByName(not_executable(planned, queries))
    return {
        "intents": intents,
        "queries": queries,
        "errors": errors,
        "evaluated": evaluated,
        "summary": search_summary(queries, evaluated),
    }
