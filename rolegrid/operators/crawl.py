"""Walking page chains and enriching listings with detail pages."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.functions.text import non_empty
from rolegrid.operators.matching import with_search_text
from rolegrid.operators.scoring import listing_stage_score
from rolegrid.operators.skew import heavy_keys, key_counts, salted_join
from rolegrid.schemas import LISTING_ONLY_PREFIX, METADATA_COLUMNS
from rolegrid.session import Rounds, stage

#: Walks of no more pages than this are never worth reading ahead.
AHEAD_HOPS = 4


class PageReader(Protocol):
    """Reads pages when they are wanted; its table holds ``url, site, next_url, n_items, error``."""

    def read(self, wanted: DataFrame, most: int) -> None:
        """Read the pages ``url, site`` of ``wanted``, of which there are ``most`` at most."""

    def read_ahead(self, sites: DataFrame, walks: int, hop: int) -> bool:
        """Before hop ``hop`` of ``walks`` open walks: read all pages of ``sites(site)`` at once if that costs less than to look
        for pages hop by hop, and say whether that was done."""

    def table(self) -> DataFrame:
        """All pages read so far."""


def walk_pages(starts: DataFrame, pages: DataFrame | PageReader, max_pages: int | None = 1) -> DataFrame:
    """Follow next links from every start page (SR10).

    ``starts(query_id, source_site, start_url)``, one row per query. ``pages`` is a narrow table ``url, site, next_url, n_items[, error]``
    without page text, or a reader that makes such a table as the walk goes on: it is asked for the pages that open walks stand on
    and that were not read before. So only visited pages are read, and each of them once.

    One row per attempted page: ``query_id, source_site, hop, url, found, n_items, stop``. The walk of a query ends at a missing
    page, at one that cannot be read, at an empty page after a filled one, without a next link, at a page seen before,
    or after ``max_pages`` pages; without a bound it still ends, because no query sees a page twice. A start page that is
    missing or cannot be read fails the query. Steps and read pages are tables that grow by a part each hop, so plans stay as small
    in the thousandth hop as in the first.
    """
    steps, stored = Rounds(starts.sparkSession, "steps"), isinstance(pages, DataFrame)
    limit = None if max_pages is None else max(1, max_pages)
    long = limit is None or limit > AHEAD_HOPS
    front = starts.select("query_id", "source_site", F.col("start_url").alias("url"), F.lit(False).alias("filled"))
    open_walks, hop = front.count(), 0
    while open_walks:
        hop += 1
        if not stored and long and pages.read_ahead(starts.select(F.col("source_site").alias("site")).distinct(), open_walks, hop):
            return _visits(_jump(starts, pages.table(), limit))
        if not stored:
            wanted = front.select("url", F.col("source_site").alias("site"))
            pages.read(wanted if hop == 1 else wanted.join(pages.table().select("url", "site"), ["url", "site"], "left_anti"), open_walks)
        known = pages if stored else pages.table()
        error = F.col("error").isNotNull() if "error" in known.columns else F.lit(False)
        known = known.select("url", F.col("site").alias("source_site"), "next_url", "n_items", F.lit(True).alias("hit"), error.alias("unread"))
        unread = F.coalesce("unread", F.lit(False))
        found = F.coalesce("hit", F.lit(False)) & ~unread
        n_items = F.coalesce("n_items", F.lit(0))
        stop = (
            F.when(unread, "start_unreadable" if hop == 1 else "page_unreadable")
            .when(~found, "start_missing" if hop == 1 else "page_missing")
            .when((n_items == 0) & F.col("filled"), "empty_page")
            .when(F.col("next_url").isNull(), "no_next")
        )
        # whoever is back on a page of the same walk has ended on the page before
        if hop > 1:
            front = front.join(steps.table().select("query_id", "url"), ["query_id", "url"], "left_anti")
        step = steps.add(
            front.join(known, ["url", "source_site"], "left").select(
                "query_id", "source_site", "url", found.alias("found"), n_items.alias("n_items"), "next_url", (F.col("filled") | (n_items > 0)).alias("filled"), stop.alias("stop")
            )
        )
        if hop == limit:
            break
        front = step.where("stop IS NULL").select("query_id", "source_site", F.col("next_url").alias("url"), "filled")
        open_walks = front.count()
    return _visits(steps.table())


def _jump(starts: DataFrame, known: DataFrame, limit: int | None) -> DataFrame:
    """The steps of all walks over pages that are all known: ways of 1, 2, 4, ... links are put together from halves, and
    a walk doubles its length in each round.

    Until it comes back to a page a walk sees other pages at each hop, and from then on none but seen ones; so its number of different
    pages is the hop before the first repeated one.
    """
    known = known.select("url", F.col("site").alias("source_site"), "next_url", "n_items", F.col("error").isNotNull().alias("unread"))
    seen = F.struct(F.lit(True).alias("hit"), "unread", F.coalesce("n_items", F.lit(0)).alias("n_items"), "next_url").alias("page")
    nodes = known.select("url", "source_site", seen)
    linked = nodes.where("NOT page.unread AND page.next_url IS NOT NULL")
    ends = nodes.select(F.col("url").alias("to"), "source_site", F.col("page").alias("page_to"))
    ways = linked.select("url", "source_site", F.col("page.next_url").alias("to"), (F.col("page.n_items") > 0).alias("filled_by"))
    ways = stage(ways.join(ends, ["to", "source_site"], "left"), "ways")
    first = starts.select("query_id", "source_site", F.col("start_url").alias("url"))
    rows = first.join(nodes, ["url", "source_site"], "left").select("query_id", "source_site", F.lit(1).alias("hop"), "url", F.lit(False).alias("filled"), "page")
    found = F.coalesce("page.hit", F.lit(False)) & ~F.coalesce("page.unread", F.lit(False))
    n_items = F.coalesce("page.n_items", F.lit(0))
    stop = (
        F.when(F.col("page.unread"), F.when(F.col("hop") == 1, "start_unreadable").otherwise("page_unreadable"))
        .when(~found, F.when(F.col("hop") == 1, "start_missing").otherwise("page_missing"))
        .when((n_items == 0) & F.col("filled"), "empty_page")
        .when(F.col("page.next_url").isNull(), "no_next")
    )
    done, length = [], 1
    while True:
        rows = stage(rows.withColumn("stop", stop), "walks")
        whole = rows.groupBy("query_id").agg(F.min(F.when(F.col("stop").isNotNull(), F.col("hop"))).alias("end"), F.count_distinct("url").alias("n_urls"))
        closed = F.col("end").isNotNull() | (F.col("n_urls") < length)
        if limit is not None and length >= limit:
            closed = F.lit(True)
        cut = F.least("end", F.greatest("n_urls", F.lit(1)), F.lit(limit))
        rows = rows.join(whole.select("query_id", cut.alias("cut"), closed.alias("closed")), "query_id").where("hop <= cut").drop("cut")
        rows = stage(rows, "cut")
        done.append(rows.where("closed").select("query_id", "source_site", "hop", "url", found.alias("found"), n_items.alias("n_items"), "page.next_url", "stop"))
        rows = rows.where("NOT closed").drop("closed", "stop")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)
        if length > 1:
            half = ways.select("url", "source_site", F.col("to").alias("mid"), F.col("filled_by").alias("filled_first"))
            other = ways.select(F.col("url").alias("mid"), "source_site", "to", "filled_by", "page_to")
            both = half.join(other, ["mid", "source_site"])
            ways = stage(both.select("url", "source_site", "to", (F.col("filled_first") | F.col("filled_by")).alias("filled_by"), "page_to"), "ways")
        ahead = rows.join(ways, ["url", "source_site"]).select(
            "query_id", "source_site", (F.col("hop") + length).alias("hop"), F.col("to").alias("url"), (F.col("filled") | F.col("filled_by")).alias("filled"), F.col("page_to").alias("page"))
        rows, length = rows.unionByName(ahead), 2 * length


def _visits(walked: DataFrame) -> DataFrame:
    """Visits from steps: the last step of a walk that did not stop leads to a page seen before, or to one beyond the limit."""
    last = walked.groupBy("query_id").agg(F.max("hop").alias("hop"), F.lit(True).alias("last"))
    again = walked.select("query_id", F.col("url").alias("next_url"), F.lit(True).alias("again")).distinct()
    walked = walked.join(last, ["query_id", "hop"], "left").join(again, ["query_id", "next_url"], "left")
    ended = F.when(F.col("again"), "repeated_page").otherwise("page_limit")
    stop = F.when(F.col("last") & F.col("stop").isNull(), ended).otherwise(F.col("stop"))
    return stage(walked.select("query_id", "source_site", "hop", "url", "found", "n_items", stop.alias("stop")), "visits")


def select_for_enrichment(postings: DataFrame, selective: bool = False, min_score: int = 1) -> DataFrame:
    """Add ``selected``: every posting, or those with a sufficient listing-stage score (FL6, SC5).

    Needs the query's ``include_keywords``, ``exclude_keywords`` and ``location_hints`` on the row.
    """
    if not selective:
        return postings.withColumn("selected", F.lit(True))
    points = listing_stage_score(F.col("include_keywords"), F.col("exclude_keywords"), F.col("location_hints"))
    scored = with_search_text(postings).withColumn("selected", points >= min_score)
    return scored.drop("title_l", "company_l", "location_l", "description_l")


def merge_detail(listing: Column, detail: Column) -> dict[str, Column]:
    """Fields a detail page may fill in; title, company, url, id and date stay those of the listing."""
    known_place = ~F.lower(F.trim(detail["location"])).startswith("unknown")
    described = ~detail["description_text"].startswith(LISTING_ONLY_PREFIX)
    out = {
        "location": F.when(known_place, detail["location"]).otherwise(listing["location"]),
        "description_text": F.when(described, detail["description_text"]).otherwise(listing["description_text"]),
    }
    for name in ("remote_status", "employment_type", "seniority"):
        out[name] = F.when(detail[name] == "unknown", listing[name]).otherwise(detail[name])
    for name in METADATA_COLUMNS:
        if name != "snippet":
            out[name] = F.coalesce(non_empty(detail[name]), listing[name])
    return out


def enrich(postings: DataFrame, details: DataFrame, order: str, counts: DataFrame | None = None) -> DataFrame:
    """Merge detail pages into the selected postings (JN5).

    ``postings`` carries ``selected`` and ``detail_url``; ``details`` holds one row per url. Adds
    ``detail_found``. A posting listed by very many queries is spread over tasks; who has counted the selected postings
    already gives ``counts(detail_url, n)``.
    """
    names = list(merge_detail(F.col("l"), F.col("d")))
    side = details.select(F.col("url").alias("detail_url"), F.struct(*[c for c in names]).alias("d"))
    keyed = postings.withColumn("detail_url", F.when(F.col("selected"), F.col("detail_url")))
    wanted, rest = keyed.where("detail_url IS NOT NULL"), keyed.where("detail_url IS NULL")
    counts = key_counts(wanted, "detail_url") if counts is None else counts
    joined = salted_join(wanted, side, "detail_url", "left", heavy_keys(counts, "detail_url"), spread=order)
    joined = joined.withColumn("detail_found", F.col("d").isNotNull()).withColumn("l", F.struct(*names))
    filled = {
        n: F.when(F.col("detail_found"), c).otherwise(F.col("l")[n]) for n, c in merge_detail(F.col("l"), F.col("d")).items()
    }
    merged = joined.withColumns(filled).drop("l", "d")
    return merged.unionByName(rest.withColumn("detail_found", F.lit(False)))
