"""Board registry: maintenance, and plans that resolve constraints to boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.functions.text import company_key, concat_lists, fold, match_key, site_slug
from rolegrid.functions.urls import http_url
from rolegrid.operators.skew import heavy_keys, key_counts, salted_join
from rolegrid.operators.validate import validate_registry
from rolegrid.schemas import BOARD_SITES, DEFAULT_PLAN_SITES
from rolegrid.session import stage

# Texts of plan notes.
NOTE_SUPPORTED = "Compiled from parsed search intent using currently supported live discovery sources only."
NOTE_FROM_REGISTRY = "Board seed URLs were selected from the local registry using explicit intent constraints only."
NOTE_NO_REGISTRY = "Generated queries preserve intent constraints but remain non-executable until board seed URLs are provided."
NOTE_COMPANIES_KEPT = "Company hints were preserved, but no board URLs were inferred from company names."
NOTE_DEFAULT_SITE = "Source selected by default because the intent did not request specific supported sites."
NOTE_CHOSEN_SITE = "Source selected from explicit intent source-site preferences."
NOTE_NO_BOARD = "No board seed URL was inferred or generated."
ERROR_NO_COMPANY = "Intent does not name any companies, so no board URLs can be resolved from the local registry."
ERROR_NOT_EXECUTABLE = "Compiled search plan did not resolve to any executable board URLs."


def _literals(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def registry_order() -> list[Column]:
    """Company ignoring case, site, url (SO5)."""
    return [fold("company_name"), F.col("source_site"), F.col("board_url")]


# ---- maintenance ---------------------------------------------------------------------------------------


def _renumbered(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union with the entries of ``second`` numbered after those of ``first``."""
    last = first.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("m")).first()["m"]
    return first.unionByName(second.withColumn("idx", F.col("idx") + F.lit(last + 1)))


def import_entries(registry: DataFrame, imported: DataFrame, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """Append or replace, then validate (ST2). Returns valid entries and issues."""
    return validate_registry(imported if replace else _renumbered(registry, imported))


def add_entries(registry: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add a batch of entries, then validate (ST3)."""
    return import_entries(registry, entries)


def remove_entries(registry: DataFrame, removals: DataFrame) -> dict[str, DataFrame]:
    """Remove the entry each request names (ST4, JN11).

    ``removals(company_name, source_site, board_url)``, url optional. A request has to hit exactly one
    entry, otherwise it changes nothing and is returned in ``issues``.
    """
    asked = stage(
        removals.select(
            F.monotonically_increasing_id().alias("request"), "company_name", "source_site", "board_url",
            company_key("company_name").alias("ckey"), site_slug("source_site").alias("skey"),
        ),
        "removals",
    )
    entries = registry.select("idx", company_key("company_name").alias("ckey"), F.col("source_site").alias("skey"), F.col("board_url").alias("url"))
    hits = asked.join(entries, ["ckey", "skey"]).where(F.col("board_url").isNull() | (F.col("board_url") == F.col("url")))
    found = hits.groupBy("request").agg(F.count("*").alias("n"), F.max("idx").alias("idx"))
    judged = stage(asked.join(found, "request", "left").fillna({"n": 0}), "removal-hits")
    remaining = registry.join(judged.where("n = 1").select("idx"), "idx", "left_anti")
    issue = F.when(F.col("n") == 0, "No registry entry matched the requested company/source combination.").otherwise(
        "Multiple registry entries matched. Name the board url to remove exactly one entry."
    )
    return {
        "registry": remaining,
        "issues": judged.where("n <> 1").select("company_name", "source_site", "board_url", issue.alias("issue")),
    }


# ---- plans ---------------------------------------------------------------------------------------------


def planned_sites(want: Column) -> Column:
    """Supported sites asked for, or the default ones (part of CJ3)."""
    asked = F.transform(want["source_site_preferences"], site_slug)
    supported = F.filter(asked, lambda s: s.isin(*BOARD_SITES))
    return F.when(F.size(supported) > 0, supported).otherwise(_literals(DEFAULT_PLAN_SITES))


def site_error(want: Column) -> Column:
    """Reason when only unsupported sites were asked for, else null."""
    asked = F.transform(want["source_site_preferences"], site_slug)
    none = (F.size(asked) > 0) & ~F.exists(asked, lambda s: s.isin(*BOARD_SITES))
    text = F.concat(
        F.lit("Intent requested unsupported source sites: "), F.array_join(asked, ", "),
        F.lit(f". Supported live sources: {', '.join(sorted(BOARD_SITES))}"),
    )
    return F.when(none, text)


def plan_notes(want: Column, with_registry: bool) -> Column:
    """Notes of a plan, among them the sites that were ignored (RP5)."""
    ignored = F.filter(F.transform(want["source_site_preferences"], site_slug), lambda s: ~s.isin(*BOARD_SITES))
    ignored_note = F.when(
        F.size(ignored) > 0,
        F.concat(F.lit("Ignored unsupported source-site preferences: "), F.array_join(ignored, ", "), F.lit(".")),
    )
    notes = [F.lit(NOTE_SUPPORTED), ignored_note]
    if with_registry:
        notes.append(F.lit(NOTE_FROM_REGISTRY))
    else:
        named = F.size(concat_lists(want["include_companies"], want["exclude_companies"])) > 0
        notes += [F.lit(NOTE_NO_REGISTRY), F.when(named, F.lit(NOTE_COMPANIES_KEPT))]
    return F.array_compact(F.array(*notes))


def query_label(site: Column, want: Column, company: Column) -> Column:
    """Site, company, and first title or first keyword (RP4)."""
    title = F.try_element_at(want["target_titles"], F.lit(1))
    keyword = F.concat(F.try_element_at(want["include_keywords"], F.lit(1)), F.lit(" Roles"))
    descriptor = F.coalesce(title, keyword)
    general = F.when(company.isNull() & descriptor.isNull(), F.lit("General Search"))
    return F.concat_ws(" ", F.initcap(site), company, descriptor, general)


def query_notes(site: Column, want: Column, company: Column, board_url: Column) -> Column:
    """Why a site and board were chosen (RP4)."""
    board = F.concat(F.lit("Resolved board seed for "), company, F.lit(": "), board_url)
    return F.array(
        F.concat(F.lit("Planned for supported source site: "), site, F.lit(".")),
        F.when(F.size(want["source_site_preferences"]) == 0, F.lit(NOTE_DEFAULT_SITE)).otherwise(F.lit(NOTE_CHOSEN_SITE)),
        F.coalesce(board, F.lit(NOTE_NO_BOARD)),
    )


def select_boards(intents: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry entries of the companies and sites of every prompt, narrowed (JN6, JN7).

    Entries are narrowed by location and then by tag, each time only if something remains. Whether
    something remains is one aggregate per prompt; no window holds the entries of a prompt together.
    Needs ``prompt_id, want``; result ``prompt_id, company_name, source_site, board_url``.
    """
    want = F.col("want")
    asked = intents.select(
        "prompt_id",
        planned_sites(want).alias("sites"),
        F.transform(concat_lists(want["location_constraints"], want["preferred_locations"]), match_key).alias("places"),
        F.transform(
            concat_lists(
                want["include_keywords"], want["preferred_keywords"], want["target_titles"], want["preferred_titles"],
                want["seniority_preferences"],
            ),
            match_key,
        ).alias("wishes"),
        F.explode(F.array_distinct(F.transform(want["include_companies"], company_key))).alias("ckey"),
    )
    entries = registry.select(
        "company_name", "source_site", "board_url", company_key("company_name").alias("ckey"),
        F.transform("location_hints", match_key).alias("hints"), F.transform("tags", match_key).alias("tag_keys"),
    )
    counts = key_counts(asked, "ckey")
    pairs = salted_join(asked, entries, "ckey", "inner", heavy_keys(counts, "ckey"), spread="prompt_id")
    flagged = stage(
        pairs.where(F.array_contains("sites", F.col("source_site"))).select(
            "prompt_id", "company_name", "source_site", "board_url",
            F.arrays_overlap("hints", "places").alias("near"), F.arrays_overlap("tag_keys", "wishes").alias("tagged"),
        ),
        "boards",
    )
    present = flagged.groupBy("prompt_id").agg(
        F.bool_or("near").alias("any_near"),
        F.bool_or("tagged").alias("any_tagged"),
        F.bool_or(F.col("near") & F.col("tagged")).alias("any_both"),
    )
    keep_near = F.col("near") | ~F.col("any_near")
    some_tagged = F.when(F.col("any_near"), F.col("any_both")).otherwise(F.col("any_tagged"))
    return (
        flagged.join(present, "prompt_id")
        .where(keep_near & (F.col("tagged") | ~some_tagged))
        .select("prompt_id", "company_name", "source_site", "board_url")
    )


def compile_plan(intents: DataFrame, registry: DataFrame | None = None) -> dict[str, DataFrame]:
    """Search queries of every prompt (CJ3).

    ``queries``: with a registry one row per selected board, without one row per site and no url.
    ``notes``: plan notes per prompt. ``errors``: prompts that cannot be planned, with the reason.
    """
    want = F.col("want")
    parsed = intents.where("want IS NOT NULL").withColumn("error", site_error(want))
    plannable = parsed.where("error IS NULL").select("prompt_id", "want")
    errors = parsed.where("error IS NOT NULL").select("prompt_id", "error")
    if registry is None:
        rows = plannable.select("prompt_id", "want", F.explode(planned_sites(want)).alias("source_site")).withColumns(
            {"company_name": F.lit(None).cast("string"), "board_url": F.lit(None).cast("string")}
        )
        planned = plannable
    else:
        nameless = F.size(want["include_companies"]) == 0
        named = plannable.where(~nameless)
        boards = stage(select_boards(named, registry), "plan")
        rows = boards.join(plannable, "prompt_id")
        missed = named.join(boards.select("prompt_id"), "prompt_id", "left_anti")
        text = F.concat(
            F.lit("No board registry entries matched companies ["), F.array_join(want["include_companies"], ", "),
            F.lit("] for supported sources ["), F.array_join(planned_sites(want), ", "), F.lit("]."),
        )
        errors = errors.unionByName(
            plannable.where(nameless).select("prompt_id", F.lit(ERROR_NO_COMPANY).alias("error"))
        ).unionByName(missed.select("prompt_id", text.alias("error")))
        planned = named.join(boards.select("prompt_id"), "prompt_id", "left_semi")
    site, company, url = F.col("source_site"), F.col("company_name"), F.col("board_url")
    queries = rows.select(
        "prompt_id", "source_site", "company_name", "board_url",
        query_label(site, want, company).alias("label"),
        query_notes(site, want, company, url).alias("notes"),
        "want",
    )
    return {
        "queries": queries,
        "notes": planned.select("prompt_id", plan_notes(want, registry is not None).alias("plan_notes")),
        "errors": errors,
    }


def to_discovery_queries(queries: DataFrame) -> DataFrame:
    """Executable plan rows as start pages with keyword and location lists (PR11, FL7)."""
    want = F.col("want")
    return queries.where("board_url IS NOT NULL").select(
        "prompt_id", "source_site", "label",
        http_url("board_url").alias("start_url"),
        F.array_distinct(
            concat_lists(want["include_keywords"], want["preferred_keywords"], want["target_titles"], want["preferred_titles"])
        ).alias("include_keywords"),
        want["exclude_keywords"].alias("exclude_keywords"),
        F.array_distinct(concat_lists(want["location_constraints"], want["preferred_locations"])).alias("location_hints"),
    )


def not_executable(prompts: DataFrame, queries: DataFrame) -> DataFrame:
    """Prompts whose plan holds no board url (FL7)."""
    ready = queries.where("board_url IS NOT NULL").select("prompt_id")
    return prompts.select("prompt_id").join(ready, "prompt_id", "left_anti").withColumn("error", F.lit(ERROR_NOT_EXECUTABLE))
