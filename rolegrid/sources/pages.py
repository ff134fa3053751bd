"""Postings out of stored pages ``pages(url, site, html)``."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.functions.text import (
    as_col, description_text, employment_type, insight_fields, non_empty, posted_at, remote_status, squash_ws,
)
from rolegrid.functions.urls import (
    SITE_BASE_URL, company_from_board_url, linkedin_job_id, query_value, source_id_from_url, url_tail,
)
from rolegrid.schemas import LISTING_ONLY_TEXT, UNKNOWN_COMPANY, UNKNOWN_LOCATION, UNKNOWN_TITLE
from rolegrid.sources import markup

# Ship the walkers with the functions, so that executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(markup)

CARDS = "array<struct<" + ",".join(f"{f}:string" for f in markup.CARD_FIELDS) + ">>"
DETAIL = "struct<" + ",".join(f"{f}:string" for f in markup.DETAIL_FIELDS) + ",insights:array<string>,description:string,error:string>"

_CARDS_TYPE = pa.list_(pa.struct([(f, pa.string()) for f in markup.CARD_FIELDS]))
_PAGE_TYPE = pa.struct([("cards", _CARDS_TYPE), ("href", pa.string()), ("error", pa.string())])
_DETAIL_TYPE = pa.struct([
    *[(f, pa.string()) for f in markup.DETAIL_FIELDS], ("insights", pa.list_(pa.string())), ("description", pa.string()), ("error", pa.string())])
#: Pages whose captures a worker holds as Python objects at a time.
SLICE = 500


def captured(read: Callable[[str, str], object], kind: pa.DataType) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """``read`` over columns of sites and pages: a slice of a batch at a time, so that a worker's memory does not grow with the batch."""

    def column(sites: pa.Array, pages: pa.Array) -> pa.Array:
        slices = [
            pa.array([read(n, p) for n, p in zip(sites[at:at + SLICE].to_pylist(), pages[at:at + SLICE].to_pylist())], kind)
            for at in range(0, len(pages), SLICE)
        ]
        return pa.concat_arrays(slices) if slices else pa.array([], kind)

    return column


# Extractors by site (UD1): page text in, list of card dicts out.
_EXTRACTORS: dict[str, Callable[[str | None], list[dict]]] = {}


def register_extractor(site: str, read: Callable[[str | None], list[dict]]) -> None:
    """Add or replace the listing extractor of a site (UD1)."""
    _EXTRACTORS[site] = read


def _capabilities(site: str) -> dict[str, bool]:
    return {
        "supports_listing_html_parse": site in markup.LISTING_RULES or site in _EXTRACTORS,
        "supports_detail_html_parse": site in markup.DETAIL_RULES,
    }


def site_capabilities(site: str) -> dict[str, bool]:
    """What can be read from a site's pages (UD1)."""
    return _capabilities(site)


def once(reader):
    """Keep Spark from running a page reader twice.

    For a deterministic column under an explode Spark infers the filter "size > 0", pushes it below, and
    with it evaluates the column a second time. Reading a page is far too dear for that.
    """
    return reader.asNondeterministic()


def page_content(site: Column | str, html: Column | str) -> Column:
    """``cards``, next-link target ``href`` and parse ``error`` of a listing page, read in one pass."""
    own = dict(_EXTRACTORS)

    def one(name, page):
        found = markup.read_page("" if name in own else name, page)
        if name in own:
            try:
                found["cards"] = [{f: c.get(f) for f in markup.CARD_FIELDS} for c in own[name](page)]
            except Exception as failure:  # a page that is read ahead, and that no walk asks for, must not end the job
                return {"cards": [], "href": None, "error": f"{type(failure).__name__}: {failure}"}
        return found

    read = captured(one, _PAGE_TYPE)

    @F.arrow_udf(f"struct<cards:{CARDS},href:string,error:string>")
    def content(sites: pa.Array, pages: pa.Array) -> pa.Array:
        return read(sites, pages)

    return once(content)(as_col(site), as_col(html))


def listing_cards(site: Column | str, html: Column | str) -> Column:
    """Raw cards of a listing page; empty for a site without extractor."""
    own = dict(_EXTRACTORS)

    def one(name, page):
        if name in own:
            return [{f: c.get(f) for f in markup.CARD_FIELDS} for c in own[name](page)]
        return markup.read_cards(name, page)

    read = captured(one, _CARDS_TYPE)

    @F.arrow_udf(CARDS)
    def cards(sites: pa.Array, pages: pa.Array) -> pa.Array:
        return read(sites, pages)

    return once(cards)(as_col(site), as_col(html))


def detail_captures(site: Column | str, html: Column | str) -> Column:
    def one(name, page):
        return markup.read_detail(name, page) if name in markup.DETAIL_RULES else {}

    read = captured(one, _DETAIL_TYPE)

    @F.arrow_udf(DETAIL)
    def captures(sites: pa.Array, pages: pa.Array) -> pa.Array:
        return read(sites, pages)

    return once(captures)(as_col(site), as_col(html))


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Absolute form of a link found on a page (FN18)."""

    @F.arrow_udf("string")
    def absolute(bases: pa.Array, links: pa.Array) -> pa.Array:
        return pa.array([markup.resolve(b, h) for b, h in zip(bases.to_pylist(), links.to_pylist())], pa.string())

    return absolute(as_col(base), as_col(href))


def next_href(html: Column | str) -> Column:
    @F.pandas_udf("string")
    def link(pages: pd.Series) -> pd.Series:
        return pd.Series([markup.read_next_link(p) for p in pages], dtype=object)

    return once(link)(as_col(html))


def extract_next_links(pages: DataFrame) -> DataFrame:
    """``url, next_url``; null when a page announces no next page (SR9)."""
    return pages.select("url", resolve_url("url", next_href("html")).alias("next_url"))


def listing_hints(cards: DataFrame, board_url: str = "board_url") -> DataFrame:
    """Cards exploded to rows with nullable hints (SR5).

    Needs ``site``, ``board_url`` and ``cards``; ``position`` is the order on the page. A posting id
    missing on the card is taken from the link, in the way of the site.
    """
    site, link = F.col("site"), F.col("posting_url")
    base = F.coalesce(F.col(board_url), *[F.when(site == s, F.lit(u)) for s, u in SITE_BASE_URL.items()])
    link_id = (
        F.when(site == "linkedin", linkedin_job_id(link))
        .when(site == "indeed", query_value(link, "jk"))
        .otherwise(non_empty(url_tail(link)))
    )
    # the same for all cards of a page, so it is spelled before they become rows
    named_by_board = F.when(site.isin("greenhouse", "lever"), company_from_board_url(board_url, site))
    return (
        cards.withColumn("_board_company", named_by_board)
        .select("*", F.posexplode("cards").alias("position", "card"))
        .drop("cards")
        .withColumn("posting_url", resolve_url(base, "card.href"))
        .withColumns(
            {
                "source_job_id": squash_ws(F.coalesce(non_empty("card.job_id"), link_id)),
                "title_hint": squash_ws("card.title"),
                "company_hint": squash_ws(F.coalesce(non_empty("card.company"), F.col("_board_company"))),
                "location_hint": squash_ws("card.location"),
                "department_hint": squash_ws("card.department"),
                "workplace_type": F.when(site == "linkedin", F.col("card.workplace_type")),
                "posted_time": F.col("card.posted_time"),
                "posted_at": posted_at("card.datetime"),
                "snippet": F.col("card.snippet"),
            }
        )
        .drop("card", "_board_company")
    )


def extract_listing_hints(pages: DataFrame) -> DataFrame:
    """Listing rows of stored pages before defaults (SR5). ``board_url`` defaults to the page URL."""
    if "board_url" not in pages.columns:
        pages = pages.withColumn("board_url", F.col("url"))
    cards = pages.withColumn("cards", listing_cards("site", "html")).drop("html")
    return listing_hints(cards.withColumnRenamed("url", "page_url"))


def listing_only_text(site: Column) -> Column:
    return F.coalesce(
        *[F.when(site == name, F.lit(text)) for name, text in LISTING_ONLY_TEXT.items()],
        F.concat(F.lit("Listing-only discovery from "), site, F.lit(" jobs page.")),
    )


def apply_defaults(hints: DataFrame) -> DataFrame:
    """Hints to postings: unknown texts, listing-only description, workplace (PR6).

    Only listings that carry a workplace (linkedin) get a remote status.
    """
    site = F.col("site")
    carried = [c for c in hints.columns if c not in (
        "site", "posting_url", "title_hint", "company_hint", "location_hint", "department_hint",
        "source_job_id", "workplace_type", "posted_time", "posted_at", "snippet")]
    workplace = F.coalesce(non_empty("workplace_type"), F.col("location_hint"))
    return hints.select(
        *carried,
        site.alias("source_site"),
        "source_job_id",
        F.col("posting_url").alias("url"),
        F.coalesce(non_empty("title_hint"), F.lit(UNKNOWN_TITLE)).alias("title"),
        F.coalesce(non_empty("company_hint"), F.lit(UNKNOWN_COMPANY)).alias("company"),
        F.coalesce(non_empty("location_hint"), F.lit(UNKNOWN_LOCATION)).alias("location"),
        F.when(site == "linkedin", remote_status(workplace)).otherwise("unknown").alias("remote_status"),
        F.lit("unknown").alias("employment_type"),
        F.lit("unknown").alias("seniority"),
        "posted_at",
        listing_only_text(site).alias("description_text"),
        F.col("department_hint").alias("team"),
        "workplace_type",
        F.lit(None).cast("string").alias("employment_type_text"),
        "posted_time",
        "snippet",
    )


def extract_listings(pages: DataFrame) -> DataFrame:
    """Postings of stored listing pages (SR1 to SR4)."""
    return apply_defaults(extract_listing_hints(pages))


def extract_details(pages: DataFrame) -> DataFrame:
    """One posting per stored detail page that can be read (SR6, SR7, SR8).

    The workplace is inferred from the workplace text or else from the location text, where a missing
    location counts as the text "Unknown location".
    """
    site, url = F.col("site"), F.col("url")
    board = F.col("board_url") if "board_url" in pages.columns else F.lit(None).cast("string")
    raw = pages.select(
        "url", "site", board.alias("board_url"), detail_captures("site", "html").alias("d")
    ).where("d.error IS NULL").withColumn(
        "insight", F.when(site == "linkedin", insight_fields(F.coalesce("d.primary", F.lit("")), "d.insights"))
    )

    def pick(own: str, slot: str) -> Column:
        return F.coalesce(non_empty(f"d.{own}"), F.col(f"insight.{slot}"))

    workplace, employment = pick("workplace", "workplace_type"), pick("employment", "employment_type_text")
    location = F.coalesce(pick("location", "location"), F.lit(UNKNOWN_LOCATION))
    text = description_text("d.description")
    company = F.coalesce(
        non_empty("d.company"), F.when(site != "linkedin", company_from_board_url("board_url", site)), F.lit(UNKNOWN_COMPANY)
    )
    return raw.select(
        site.alias("source_site"),
        source_id_from_url(url, site).alias("source_job_id"),
        "url",
        squash_ws(F.coalesce(non_empty("d.title"), F.lit(UNKNOWN_TITLE))).alias("title"),
        squash_ws(company).alias("company"),
        squash_ws(location).alias("location"),
        remote_status(F.coalesce(workplace, location)).alias("remote_status"),
        employment_type(employment).alias("employment_type"),
        F.lit("unknown").alias("seniority"),
        F.when(site == "linkedin", posted_at("d.datetime")).alias("posted_at"),
        squash_ws(F.coalesce(non_empty(text), listing_only_text(site))).alias("description_text"),
        F.col("d.department").alias("team"),
        workplace.alias("workplace_type"),
        employment.alias("employment_type_text"),
        F.when(site == "linkedin", pick("posted_time", "posted_time")).alias("posted_time"),
    )
