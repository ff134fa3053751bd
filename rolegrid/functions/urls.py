"""URL expressions: canonical form, ids and company names taken from URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolegrid.functions.text import as_col, let, non_empty, title_case

# Query parameters that never identify a posting.
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = [
    "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "source", "trk", "trkinfo",
]
# Start pages used to resolve links when no board is known.
SITE_BASE_URL = {"linkedin": "https://www.linkedin.com", "indeed": "https://www.indeed.com"}

# The generic URI pattern of RFC 3986, appendix B. Unlike parse_url it accepts every input.
URI = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(?s:.*))?$"


def url_part(url: Column | str, part: str) -> Column:
    index = {"scheme": 1, "authority": 2, "path": 3, "query": 4}[part]
    return F.regexp_extract(F.trim(as_col(url)), URI, index)


def url_parts(url: Column) -> Column:
    """Scheme, authority, path, query and the rest after the path, out of one pass of the pattern."""
    rest = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)((?:\?([^#]*))?(?:#(?s:.*))?)$"
    groups = F.split(F.regexp_replace(F.translate(F.trim(url), "\x01", " "), rest, "$1\x01$2\x01$3\x01$5\x01$4"), "\x01")
    names = ("scheme", "authority", "path", "query", "rest")
    return let(groups, lambda g: F.struct(*[g[i].alias(n) for i, n in enumerate(names)]))


def _host_port(url: Column) -> Column:
    return F.regexp_replace(url_part(url, "authority"), "^.*@", "")


def url_host(url: Column | str) -> Column:
    return F.lower(F.regexp_replace(_host_port(as_col(url)), r":\d*$", ""))


def url_port(url: Column | str) -> Column:
    return F.regexp_extract(_host_port(as_col(url)), r":(\d+)$", 1)


def _on_site(site: Column, host: Column, name: str, domain: str) -> Column:
    return (site == name) | host.endswith(domain)


def canonical_host(host: Column, site: Column) -> Column:
    """Site-specific removal of ``www.`` (FN2)."""
    bare = F.when(host.startswith("www."), F.substring(host, 5, 1 << 30)).otherwise(host)
    lever_host = (host == "www.jobs.lever.co") | (host.startswith("www.") & host.endswith(".lever.co"))
    return (
        F.when(_on_site(site, host, "greenhouse", "greenhouse.io"), bare)
        .when(_on_site(site, host, "lever", "lever.co"), F.when(lever_host, bare).otherwise(host))
        .when(site.isin("indeed", "linkedin"), bare)
        .otherwise(host)
    )


def canonical_path(path: Column, host: Column, site: Column) -> Column:
    """Trailing and doubled slashes, embed paths (FN3)."""
    cut = F.regexp_replace(path, "/+$", "")
    rooted = F.when(cut.startswith("/"), cut).otherwise(F.concat(F.lit("/"), cut))
    single = F.regexp_replace(rooted, "/{2,}", "/")
    greenhouse = F.regexp_replace(
        F.regexp_replace(single, r"(?iU)^/embed/job_app\b", "/job_app"),
        r"(?iU)^/embed/job_board\b", "/job_board",
    )
    lever = F.regexp_replace(
        F.regexp_replace(single, r"(?iU)^/jobs/\s*", "/jobs/"), r"(?iU)^/view/\s*", "/view/"
    )
    return (
        F.when(_on_site(site, host, "greenhouse", "greenhouse.io"), greenhouse)
        .when(_on_site(site, host, "lever", "lever.co"), lever)
        .when(_on_site(site, host, "linkedin", "linkedin.com"), single)
        .when(_on_site(site, host, "indeed", "indeed.com"), single)
        .otherwise(rooted)
    )


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.translate(text, "+", " "))


def _encode(text: Column) -> Column:
    """Form encoding with the unreserved characters of RFC 3986."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_items(query: Column) -> Column:
    """Decoded ``(k, v)`` pairs with a value, in input order."""
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike(r"(?s)=."))
    return F.transform(
        pairs,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.regexp_replace(p, r"^[^=]*=", "")).alias("v"),
        ),
    )


def canonical_query(query: Column, path: Column, site: Column) -> Column:
    """Tracking and blank parameters out, the rest sorted and re-encoded (FN4)."""
    kept = F.filter(
        query_items(query),
        lambda p: ~(F.lower(p["k"]).startswith(TRACKING_PREFIX) | F.lower(p["k"]).isin(TRACKING_KEYS)),
    )
    text = F.array_join(
        F.transform(F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&"
    )
    viewed = (site == "linkedin") & F.lower(path).contains("/jobs/view/")
    return F.when(viewed, "").otherwise(text)


def canonical_url(url: Column | str, site: Column | str | None = None) -> Column:
    """Canonical URL used as a duplicate key (FN1, FN5)."""
    url = as_col(url)
    site = F.coalesce(as_col(site), F.lit("")) if site is not None else F.lit("")
    parts = let(
        url_parts(url),
        lambda p: F.struct(
            F.coalesce(non_empty(F.lower(p["scheme"])), F.lit("https")).alias("scheme"),
            F.regexp_replace(p["authority"], "^.*@", "").alias("host_port"),
            p["path"].alias("path"), p["query"].alias("query"), site.alias("site"),
        ),
    )

    def on_host(p: Column, host: Column) -> Column:
        port = F.regexp_extract(p["host_port"], r":(\d+)$", 1).try_cast("int")
        default_port = ((p["scheme"] == "http") & (port == 80)) | ((p["scheme"] == "https") & (port == 443))
        port_text = F.when(port.isNotNull() & ~default_port, F.concat(F.lit(":"), port)).otherwise("")

        def with_path(path: Column) -> Column:
            query = canonical_query(p["query"], path, p["site"])
            mark = F.when(query == "", "").otherwise("?")
            return F.concat(p["scheme"], F.lit("://"), host, port_text, path, mark, query)

        return let(canonical_path(p["path"], host, p["site"]), with_path)

    def on_parts(p: Column) -> Column:
        raw_host = F.lower(F.regexp_replace(p["host_port"], r":\d*$", ""))
        host = let(raw_host, lambda h: canonical_host(h, p["site"]))
        return let(host, lambda h: on_host(p, h))

    plain = F.substring_index(url, "?", 1)
    return F.when(url.rlike(PLAIN_URL), plain).when(url.isNotNull(), let(parts, on_parts))


# A web address of plain characters that is canonical on every site but for a query of tracking parameters alone: no user, port,
# www. or empty path part, and no first path part that a site may spell in another way.
_TRACKED = rf"(?i:{TRACKING_PREFIX}[a-z0-9_]*|{'|'.join(TRACKING_KEYS)})=[^&#\s]*"
PLAIN_URL = (
    r"\Ahttps?://(?!www\.)[a-z0-9.-]+(?!/(?!jobs/|view/)(?i:embed|jobs|view)(?:[/?]|\z))(?:/[A-Za-z0-9_.~%-]+)+"
    rf"(?:\?(?:{_TRACKED}(?:&{_TRACKED})*)?)?\z"
)


def path_parts(url: Column | str) -> Column:
    return F.filter(F.split(url_part(url, "path"), "/"), lambda x: x != "")


def last_path_part(url: Column | str) -> Column:
    """Last non-empty path part, null without one (FN13)."""
    return F.try_element_at(path_parts(url), F.lit(-1))


def url_tail(url: Column | str) -> Column:
    """Text after the last slash of the whole URL."""
    return F.substring_index(F.regexp_replace(as_col(url), "/+$", ""), "/", -1)


def query_value(url: Column | str, key: str) -> Column:
    hits = F.filter(query_items(url_part(url, "query")), lambda p: p["k"] == key)
    return F.try_element_at(hits, F.lit(1))["v"]


def linkedin_job_id(url: Column | str) -> Column:
    """Part after ``view`` on job pages, else the ``currentJobId`` parameter (FN13)."""

    def from_path(parts: Column) -> Column:
        on_job_page = F.array_contains(parts, "view") & F.array_contains(parts, "jobs")
        after_view = F.try_element_at(parts, (F.array_position(parts, "view") + 1).cast("int"))
        return F.when(on_job_page, after_view).otherwise(query_value(url, "currentJobId"))

    return let(path_parts(url), from_path)


def source_id_from_url(url: Column | str, site: Column | str) -> Column:
    """Source id carried by a detail-page URL, per site (FN13)."""
    site = as_col(site)
    return (
        F.when(site == "linkedin", linkedin_job_id(url))
        .when(site == "indeed", query_value(url, "jk"))
        .otherwise(last_path_part(url))
    )


# Hosts whose first path part names the company.
BOARD_HOSTS = {"greenhouse": "boards.greenhouse.io", "lever": "jobs.lever.co"}


def company_from_board_url(url: Column | str, site: Column | str) -> Column:
    """Company name spelled from the board slug (FN12)."""
    site = as_col(site)
    slug = F.try_element_at(F.split(F.regexp_replace(url_part(url, "path"), "^/+|/+$", ""), "/"), F.lit(1))
    known = reduce(
        lambda a, b: a | b,
        [(site == name) & url_host(url).startswith(host) for name, host in BOARD_HOSTS.items()],
    )
    return F.when(known & (slug != ""), title_case(F.translate(slug, "-_", "  ")))


def http_url(url: Column | str) -> Column:
    """Stored form of a web address: scheme and host in lower case, a path always; null when it is none."""
    url = F.trim(as_col(url))

    def whole(p: Column) -> Column:
        scheme, user = F.lower(p["scheme"]), F.regexp_extract(p["authority"], "^(.*@)", 1)
        host_port = F.lower(F.regexp_replace(p["authority"], "^.*@", ""))
        default = F.when(scheme == "http", r":(80)?$").otherwise(r":(443)?$")
        host = F.regexp_replace(host_port, default, F.lit(""))
        path = F.when(p["path"] == "", "/").otherwise(p["path"])
        text = F.concat(scheme, F.lit("://"), user, host, path, p["rest"])
        return F.when(scheme.isin("http", "https") & (host != "") & ~host.startswith(":"), text)

    return F.when(~url.rlike(r"\s"), let(url_parts(url), whole))
