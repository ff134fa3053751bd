"""Discovery: from start pages to stored postings with counters, for all queries in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.functions.urls import canonical_url
from rolegrid.operators.crawl import enrich, select_for_enrichment, walk_pages
from rolegrid.operators.dedupe import dedupe_postings
from rolegrid.operators.store import to_store_columns, upsert_postings
from rolegrid.operators.telemetry import discovery_counters
from rolegrid.session import Rounds, stage
from rolegrid.sources import pages as page_source
from rolegrid.sources.page_store import newest_pages, wanted_pages

#: All listing pages are read at once if one in so many of them is wanted in one hop, or after so many hops.
AHEAD_SHARE, AHEAD_AFTER = 16, 8


@dataclass(frozen=True)
class DiscoveryOptions:
    """Toggles of a discovery run; linkedin postings are always enriched. ``max_pages`` None walks whole chains."""

    max_pages: int | None = 1
    enrich_greenhouse_details: bool = False
    enrich_lever_details: bool = False
    selective_detail_enrichment: bool = False
    min_listing_stage_score: int = 1

    def enriched_sites(self) -> list[str]:
        chosen = {"greenhouse": self.enrich_greenhouse_details, "lever": self.enrich_lever_details, "linkedin": True}
        return [site for site, on in chosen.items() if on]


def _kind(pages: DataFrame, kind: str) -> DataFrame:
    return pages.where(F.col("kind") == kind) if "kind" in pages.columns else pages


class ListingReader:
    """Reads the listing pages that a walk asks for: cards and next link of each, page text dropped.

    The semi join with the wanted urls comes before the page reader, so that only wanted pages are parsed. But each hop scans the whole
    store; to parse all pages of a site costs about three such scans. So they are all read at once where the walks stand on a good
    part of them, and after so many hops that the scans have cost more.
    """

    def __init__(self, pages: DataFrame) -> None:
        self.listings, self.contents, self.total = _kind(pages, "listing"), Rounds(pages.sparkSession, "contents"), None

    def read(self, wanted: DataFrame, most: int) -> None:
        self._add(wanted_pages(self.listings, wanted, most))

    def read_ahead(self, sites: DataFrame, walks: int, hop: int) -> bool:
        if self.total is None:
            self.total = self.listings.count()
        if walks * AHEAD_SHARE < self.total and hop <= AHEAD_AFTER:
            return False
        self.contents = Rounds(self.listings.sparkSession, "contents")
        self._add(newest_pages(self.listings.join(F.broadcast(sites), "site", "left_semi")))
        return True

    def _add(self, pages: DataFrame) -> None:
        content = pages.select("url", "site", page_source.page_content("site", "html").alias("c"))
        next_url = F.when(F.col("site") != "linkedin", page_source.resolve_url("url", "c.href"))
        self.contents.add(content.select("url", "site", "c.cards", F.size("c.cards").alias("n_items"), "c.error", next_url.alias("next_url")))

    def table(self) -> DataFrame:
        return self.contents.table()


def collect_postings(queries: DataFrame, pages: DataFrame, options: DiscoveryOptions = DiscoveryOptions()) -> dict[str, DataFrame]:
    """Walk, extract, enrich and deduplicate (the part of CJ1 before the store).

    The order of postings is query id, page, position; the separator sorts before every printable
    character, so that a query id that is the beginning of another one comes first.

    ``queries(query_id, source_site, start_url, include_keywords, exclude_keywords, location_hints)``,
    ``pages(url, site, html[, kind, fetched_at])``, best as written by ``sources.page_store``. Returns ``visits``, ``parsed`` (before duplicate removal) and
    ``postings`` with ``query_id`` and the unique order column ``ord``.
    """
    reader = ListingReader(pages)
    visits = walk_pages(queries, reader, options.max_pages)
    # the walk of a query whose start page is missing has no found page, so it brings no postings
    seen = visits.where("found").select("query_id", "hop", "url", F.col("source_site").alias("site"))
    starts = queries.select("query_id", F.col("start_url").alias("board_url"), "include_keywords", "exclude_keywords", "location_hints")
    cards = seen.join(reader.table().select("url", "site", "cards"), ["url", "site"]).join(starts, "query_id")
    rows = page_source.apply_defaults(page_source.listing_hints(cards.withColumnRenamed("url", "page_url")))
    rows = rows.withColumn("ord", F.format_string("%s\x01%06d\x01%09d", F.col("query_id").cast("string"), "hop", "position"))
    rows = select_for_enrichment(rows, options.selective_detail_enrichment, options.min_listing_stage_score)
    on = F.col("source_site").isin(*options.enriched_sites())
    rows = rows.withColumn("selected", on & (F.col("selected") | (F.col("source_site") == "linkedin")))
    # no detail page changes a url, so the canonical form is spelled here for all that follows
    rows = rows.withColumn("canonical", canonical_url("url", "source_site"))
    detail_url = F.when(F.col("source_site") == "linkedin", F.col("canonical")).otherwise(F.col("url"))
    rows = stage(rows.withColumn("detail_url", detail_url), "listings")

    by_site = rows.where("selected").groupBy("detail_url", F.col("source_site").alias("site")).agg(F.count("*").alias("n"))
    by_site = stage(by_site.where("detail_url IS NOT NULL"), "wanted")
    counts = by_site.groupBy("detail_url").agg(F.sum("n").alias("n"))
    details = page_source.extract_details(wanted_pages(_kind(pages, "detail"), by_site.select(F.col("detail_url").alias("url"), "site")))
    parsed = stage(enrich(rows, details, "ord", counts), "parsed")
    kept = dedupe_postings(parsed.withColumn("url", F.col("canonical")).drop("canonical"), order="ord", scope="query_id", canonical=True)
    return {"visits": visits, "parsed": parsed.drop("canonical"), "postings": kept}


def discover(queries: DataFrame, pages: DataFrame, store: DataFrame, options: DiscoveryOptions = DiscoveryOptions(),
             seen_at: Column | None = None) -> dict[str, DataFrame]:
    """Run all queries against the stored pages and update the store (CJ1).

    Returns the next ``store``, ``counters`` per query, ``conflicts`` and ``postings``.
    """
    found = collect_postings(queries, pages, options)
    result = upsert_postings(store, to_store_columns(found["postings"], seen_at), "ord")
    stored = found["postings"].select("query_id", "ord").join(result["outcome"], "ord")
    counters = discovery_counters(queries, found["visits"], found["parsed"], stored)
    return {"store": result["store"], "counters": counters, "conflicts": result["conflicts"], "postings": found["postings"]}
