"""Reading markup: a small event walker driven by per-site rule tables.

This is the only row-level Python in the package. It turns one page into raw captures (text of marked
elements and link targets); defaults, ids, company names, employment and workplace are column expressions.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

# Markup of the job sites.
# cards: (tag, class tokens, takes the group heading); link: class tokens of the title link;
# fields: (field, tags, class tokens), the first rule that fits an element wins.
LISTING_RULES = {
    "greenhouse": {
        "cards": [("div", {"opening"}, False), ("tr", {"TableRow"}, False), ("tr", {"job-post"}, True)],
        "restart": True,
        "link": {"opening", "JobsListings__link"},
        "link_title": True,
        "id_attr": "data-mapped",
        "plain_link": ("job-boards.greenhouse.io", "/jobs/"),
        "fields": [
            ("location", {"span"}, {"location", "JobsListings__locationDisplayName"}),
            ("location", {"p"}, "body__secondary"),
            ("title", {"p"}, "body--medium"),
            ("department", {"span"}, {"department", "team"}),
            ("department", {"li"}, {"JobsListings__departmentsListItem"}),
        ],
        "group": ("h3", {"section-header"}, False),
        "company": ({"section"}, "level-0", {"section"}),
    },
    "lever": {
        "cards": [("div", {"posting"}, True)],
        "restart": False,
        "link": {"posting-title", "posting-btn-submit"},
        "outer_link": {"posting-btn-submit"},
        "link_title": False,
        "card_id_attr": "data-qa-posting-id",
        "fields": [
            ("title", {"h5"}, {"posting-name"}),
            ("location", {"span"}, {"sort-by-location"}),
            ("workplace_type", {"span"}, {"workplaceTypes"}),
            ("department", {"span"}, {"sort-by-team", "sort-by-commitment"}),
        ],
        "once": {"department"},
        "group": ("div", {"posting-category-title"}, True),
        "company": ({"h2", "h3", "div"}, {"main-header-text", "posting-headline"}, {"h2", "h3", "div"}),
    },
    "linkedin": {
        "cards": [("li", {"jobs-search-results__list-item", "jobs-search-results-list__list-item", "scaffold-layout__list-item"}, False)],
        "restart": True,
        "link": {"base-card__full-link", "job-card-container__link", "job-search-card__title-link", "job-card-list__title"},
        "link_title": True,
        "fields": [
            ("company", {"h4", "a", "div", "span"}, {"base-search-card__subtitle", "hidden-nested-link", "artdeco-entity-lockup__subtitle"}),
            ("location", {"span", "div"}, {
                "job-search-card__location", "base-search-card__metadata", "job-card-container__metadata-item",
                "artdeco-entity-lockup__caption", "job-card-container__metadata-wrapper", "job-card-list__footer-wrapper"}),
            ("posted_time", {"time"}, None),
            ("workplace_type", {"span"}, {
                "job-search-card__workplace-type", "job-search-card__workplace-type-label",
                "job-card-container__metadata-item--workplace-type"}),
        ],
        "once": {"title", "company", "location", "posted_time", "workplace_type"},
    },
    "indeed": {
        "cards": [("div", {"job_seen_beacon", "slider_item"}, False)],
        "restart": True,
        "link": {"jcs-JobTitle", "jobTitle"},
        "link_attr": "data-jk",
        "link_title": True,
        "id_attr": "data-jk",
        "fields": [
            ("company", {"span"}, {"companyName", "company"}),
            ("location", {"div"}, {"companyLocation", "locationsContainer"}),
            ("snippet", {"div"}, {"job-snippet", "jobMetaDataGroup"}),
        ],
        "append": {"snippet"},
    },
}

# Detail pages. An element belongs to a rule when its class, id or test id contains a token.
# fields: (field, tags, tokens, only while the field is empty)
_BLOCKS = {"div", "section", "article", "main"}
DETAIL_RULES = {
    "greenhouse": {
        "id_attr": "data-qa",
        "zone": (_BLOCKS, ("description", "content", "job-post", "opening", "body")),
        "fields": [
            ("title", {"h1"}, None, True),
            ("company", {"h2", "div"}, ("company",), True),
            ("location", {"div", "span", "p"}, ("location",), False),
            ("department", {"div", "span", "li"}, ("department", "team"), False),
            ("employment", {"div", "span", "li"}, ("commitment", "employment"), False),
            ("workplace", {"div", "span", "li"}, ("workplace", "remote", "location-type"), False),
        ],
    },
    "lever": {
        "id_attr": "data-qa",
        "zone": (_BLOCKS, ("description", "body-copy", "posting-description", "section-wrapper description")),
        "fields": [
            ("title", {"h2"}, ("posting-headline", "posting-title"), True),
            ("title", {"h1"}, None, True),
            ("company", {"div", "h3", "h4"}, ("main-header-text", "company", "posting-categories"), True),
            ("location", {"div", "span", "li"}, ("location",), False),
            ("department", {"div", "span", "li"}, ("team", "department"), False),
            ("employment", {"div", "span", "li"}, ("commitment", "employment"), False),
            ("workplace", {"div", "span", "li"}, ("workplace", "remote"), False),
        ],
    },
    "linkedin": {
        "id_attr": "data-test-id",
        "zone": (_BLOCKS - {"main"}, (
            "show-more-less-html__markup", "jobs-description__content", "jobs-box__html-content",
            "jobs-description-content", "description__text")),
        "fields": [
            ("title", {"h1"}, None, True),
            ("company", {"a", "span", "div"}, (
                "jobs-unified-top-card__company-name", "jobs-details-top-card__company-url",
                "topcard__org-name-link", "company-name"), True),
            ("insight", {"span", "div"}, ("jobs-unified-top-card__bullet",), False),
            ("primary", {"span", "div"}, (
                "jobs-unified-top-card__primary-description", "job-details-jobs-unified-top-card__primary-description",
                "jobs-unified-top-card__subtitle-primary-grouping", "topcard__flavor"), False),
            ("insight", {"span", "li", "div"}, (
                "job-insight", "job-criteria", "job-details-preferences-and-skills",
                "description__job-criteria-item", "job-details-jobs-unified-top-card__job-insight",
                "jobs-unified-top-card__job-insight"), False),
            ("posted_time", {"time"}, None, False),
        ],
    },
}
_BREAKING = {"p", "li", "br"}
_NESTED = {"p", "ul", "ol", "li", "br"}


def _text(parts: list[str]) -> str:
    return " ".join(filter(None, map(str.strip, parts)))


#: What this process knows of tags, class texts and elements it has read, at most so many of each and none that is longer;
#: the layout of a site is the same on all of its pages.
KEPT, KEPT_LENGTH = 4096, 200
_TAGS: dict = {}
_CLASSES: dict = {}
_ROLES: dict = {}
_PIECES: dict = {}


def _keep(memo: dict, key, value):
    if len(memo) >= KEPT:
        memo.clear()
    memo[key] = value
    return value


def _classes(text: str) -> frozenset[str]:
    found = _CLASSES.get(text)
    if found is None:
        found = frozenset(text.split())
        if len(text) <= KEPT_LENGTH:
            _keep(_CLASSES, text, found)
    return found


def _carries(attrs: dict, tokens) -> bool:
    """Class test: a set means whole class names, a string means any part, None accepts everything."""
    if tokens is None:
        return True
    classes = attrs.get("class") or ""
    return tokens in classes if isinstance(tokens, str) else bool(classes) and not tokens.isdisjoint(_classes(classes))


def _detail_roles(site: str, tag: str, *named: str | None) -> tuple[bool, tuple]:
    """Whether an element of these class, id and test id opens the description of a site's pages, and the field rules it fits."""
    key = site, tag, named
    if (found := _ROLES.get(key)) is not None:
        return found
    rules, marks = DETAIL_RULES[site], " ".join(filter(None, named)).lower()
    blocks, tokens = rules["zone"]
    fits = [(field, once) for field, tags, words, once in rules["fields"] if tag in tags and (words is None or any(w in marks for w in words))]
    found = tag in blocks and any(t in marks for t in tokens), tuple(fits)
    return _keep(_ROLES, key, found) if len(tag) + len(marks) <= KEPT_LENGTH else found


def _listing_roles(site: str, tag: str, classes: str, test_id: str | None) -> tuple:
    """What an element of these classes and test id is on a site's listing pages: whether it names the company, heads a group, is a link
    around cards and a title link, the card rule it fits, and the fields that it may fill."""
    key = site, tag, classes, test_id
    if (found := _ROLES.get(key)) is not None:
        return found
    rules, attrs = LISTING_RULES[site], {"class": classes}
    naming, group = rules.get("company"), rules.get("group")
    found = (
        bool(naming and tag in naming[0] and _carries(attrs, naming[1])),
        bool(group and tag == group[0] and _carries(attrs, group[1])),
        tag == "a" and _carries(attrs, rules.get("outer_link", set())),
        tag == "a" and _carries(attrs, rules["link"]),
        next((c for c in rules["cards"] if c[0] == tag and _carries(attrs, c[1])), None),
        tuple(field for field, tags, tokens in rules["fields"] if tag in tags and (_carries(attrs, tokens) or (tag == "h5" and test_id in tokens))),
    )
    return _keep(_ROLES, key, found) if len(tag) + len(classes) + len(test_id or "") <= KEPT_LENGTH else found


class Capture:
    """Text of one open element at a time; a new capture replaces the open one."""

    def __init__(self) -> None:
        self.field = self.tag = None
        self.parts: list[str] = []

    def begin(self, field: str, tag: str) -> None:
        self.field, self.tag, self.parts = field, tag, []

    def end(self, tag: str) -> tuple[str, str] | None:
        if self.field is None or tag != self.tag:
            return None
        done = self.field, _text(self.parts)
        self.field = self.tag = None
        return done if done[1] else None


class ListingWalker:
    """Cards of a listing page as dicts of raw captures."""

    def __init__(self, site: str) -> None:
        self.site, self.rules, self.cards, self.company = site, LISTING_RULES[site], [], None
        self.restart, self.link_title = self.rules["restart"], self.rules["link_title"]
        self.link_attr, self.once = self.rules.get("link_attr"), self.rules.get("once", ())
        self.card: dict | None = None
        self.tag = None
        self.depth = 0
        self.heading = None
        self.outer: str | None = None
        self.capture, self.naming = Capture(), None

    def start(self, tag, attrs):
        names, heads, outer, links, card_rule, fields = _listing_roles(self.site, tag, attrs.get("class") or "", attrs.get("data-qa") if tag == "h5" else None)
        if names:
            self.naming = []
        if self.card is not None and not self.restart:
            card_rule = None
        if heads and card_rule is None and (self.card is None or self.rules["group"][2]):
            self.capture.begin("_group", tag)
            return
        if outer and self.card is None:
            self.outer = attrs.get("href") or self.outer
            return
        if card_rule is not None:
            self._open(tag, attrs, card_rule)
            return
        if self.card is None:
            return
        self.depth += tag == self.tag
        if fields or tag == "a":
            self._inside(tag, attrs, links, fields)

    def _open(self, tag, attrs, card_rule):
        self.card, self.tag, self.depth = {}, tag, 1
        if self.outer:
            self.card["href"] = self.outer
        own_id = attrs.get(self.rules.get("card_id_attr"))
        if own_id:
            self.card["job_id"] = own_id
        if card_rule[2] and self.heading:
            self.card["department"] = self.heading

    def _inside(self, tag, attrs, links, fields):
        rules, card = self.rules, self.card
        if tag == "a":
            href = attrs.get("href")
            if links or attrs.get(self.link_attr) is not None:
                if href and (self.link_title or "href" not in card):
                    card["href"] = href
                    if attrs.get(rules.get("id_attr")):
                        card["job_id"] = attrs[rules["id_attr"]]
                    elif self.link_title:
                        card.pop("job_id", None)
                if self.link_title:
                    self.capture.begin("title", "a")
                return
            if href and any(part in href for part in rules.get("plain_link", ())):
                card["href"] = href
                card.pop("job_id", None)
                return
        for field in fields:
            if field == "title" and tag == "p" and "title" in card:
                continue
            if field == "department" and field in card and "department" in self.once:
                return
            if tag == "time" and attrs.get("datetime"):
                card["datetime"] = attrs["datetime"]
            self.capture.begin(field, tag)
            return

    def end(self, tag):
        done = self.capture.end(tag)
        if done:
            field, value = done
            if field == "_group":
                self.heading = value
            elif self.card is not None:
                held = self.card.get(field)
                if held is None or field not in self.once:
                    append = held and field in self.rules.get("append", ())
                    self.card[field] = f"{held} {value}" if append else value
        if self.card is not None and tag == self.tag:
            self.depth -= 1
            if self.depth == 0:
                if self.card.get("href") and self.card.get("title"):
                    self.cards.append(self.card)
                self.card = self.outer = None
        if self.naming is not None and tag in self.rules["company"][2]:
            self.company = _text(self.naming) or self.company
            self.naming = None

    def data(self, data):
        self.capture.parts.append(data)
        if self.naming is not None:
            self.naming.append(data)

    def over(self, tokens):
        """All tokens of a page; texts and end tags that nothing waits for are passed over."""
        capture, start, end, data = self.capture, self.start, self.end, self.data
        for kind, value, attrs in tokens:
            if kind == 1:
                start(value, attrs)
            elif kind == 0:
                if capture.field is not None or self.naming is not None:
                    data(value)
            elif value == capture.tag or value == self.tag or self.naming is not None:
                end(value)


class DetailWalker:
    """Fields and description of a detail page."""

    def __init__(self, site: str) -> None:
        self.site, self.rules, self.capture = site, DETAIL_RULES[site], Capture()
        self.blocks, self.id_attr = self.rules["zone"][0], self.rules["id_attr"]
        self.fields: dict[str, str] = {}
        self.insights: list[str] = []
        self.skipping = self.depth = 0
        self.parts: list[str] = []
        self.description = ""

    def start(self, tag, attrs):
        if tag in ("script", "style"):
            self.skipping += 1
        if self.skipping:
            return
        opens, fits = _detail_roles(self.site, tag, attrs.get("class"), attrs.get("id"), attrs.get(self.id_attr))
        if self.depth:
            self.depth += tag in self.blocks or tag in _NESTED
        elif opens:
            self.depth = 1
        for field, while_empty in fits:
            if while_empty and field in self.fields:
                continue
            if tag == "time" and attrs.get("datetime"):
                self.fields["datetime"] = attrs["datetime"]
            self.capture.begin(field, tag)
            return

    def end(self, tag):
        if self.skipping:
            self.skipping -= tag in ("script", "style")
            return
        done = self.capture.end(tag)
        if done and done[0] == "insight":
            self.insights.append(done[1])
        elif done:
            self.fields.setdefault(*done)
        if self.depth and (tag in self.blocks or tag in _NESTED):
            self.depth -= 1
            if tag in _BREAKING:
                self.parts.append("\n")
        if not self.depth and self.parts:
            self.description = "".join(self.parts)

    def data(self, data):
        if self.skipping:
            return
        self.capture.parts.append(data)
        if self.depth:
            self.parts.append(data)


class NextLinkWalker:
    """Target of the first link that announces a next page."""

    HINTS = ("class", "rel", "aria-label", "title", "data-qa")

    def __init__(self) -> None:
        self.found = self.href = None
        self.hinted, self.parts = False, []

    def start(self, tag, attrs):
        if self.found is None and tag == "a" and attrs.get("href"):
            self.href, self.parts = attrs["href"], []
            self.hinted = "next" in " ".join(attrs.get(h) or "" for h in self.HINTS).lower()

    def data(self, data):
        self.parts.append(data)

    def end(self, tag):
        if tag == "a" and self.href is not None:
            if self.hinted or _text(self.parts).lower().startswith("next"):
                self.found = self.href
            self.href = None

    def over(self, tokens):
        """All tokens of a page, as far as its first next link; only links and the texts in them matter."""
        for kind, value, attrs in tokens:
            if kind == 0:
                if self.href is not None:
                    self.parts.append(value)
            elif value == "a":
                if kind == 1:
                    self.start(value, attrs)
                else:
                    self.end(value)
                    if self.found is not None:
                        return


class Reader(HTMLParser):
    """Feeds the tags and texts of one page to any number of walkers, in one pass."""

    def __init__(self, *walkers) -> None:
        super().__init__(convert_charrefs=True)
        self.walkers = walkers

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        for walker in self.walkers:
            walker.start(tag, named)

    def handle_endtag(self, tag):
        for walker in self.walkers:
            walker.end(tag)

    def handle_data(self, data):
        for walker in self.walkers:
            walker.data(data)


# Markup in which every way of reading agrees: names of letters and digits, quoted attribute values, closed comments,
# scripts and styles. One expression cuts such a page into tokens; a page with anything else goes to ``Reader`` as a whole.
_ATTRS = r"""(?:[ \t\n\r\f]+[a-zA-Z_:][a-zA-Z0-9_:.-]*(?:="[^"]*"|='[^']*')?)*[ \t\n\r\f]*"""
_TOKEN = re.compile(rf"""
    ([^<]+)
  | </([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*>
  | (<(?!(?i:script|style)[ \t\n\r\f/>])[a-zA-Z][a-zA-Z0-9]*{_ATTRS}/?>)
  | <!--(?![->])(?:[^-]|-(?!-))*-->
  | <!(?i:doctype)[ a-zA-Z0-9]*>
  | (?P<open><(?i:(?P<raw>script|style)){_ATTRS}>)(?P<body>[^<]*(?:<(?!/[ \t\n\r\f]*(?i:(?P=raw)))[^<]*)*)</(?i:(?P=raw))>
  | (<)
""", re.VERBOSE)
_ATTR = re.compile(r"""[ \t\n\r\f]([a-zA-Z_:][a-zA-Z0-9_:.-]*)(?:="([^"]*)"|='([^']*)')?""")


def _tag(text: str) -> tuple[str, dict, bool]:
    """Name and attributes of a start tag, and whether it closes itself."""
    found = _TAGS.get(text)
    if found is None:
        name = re.match("<([a-zA-Z0-9]+)", text)[1]
        attrs = {}
        for m in _ATTR.finditer(text, len(name) + 1):
            value = m[2] if m[2] is not None else m[3]
            attrs[m[1].lower()] = unescape(value) if value and "&" in value else value
        found = name.lower(), attrs, text.endswith("/>")
        if len(text) <= KEPT_LENGTH:
            _keep(_TAGS, text, found)
    return found


_PIECE = re.compile(rf"(?:/([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*|(?!(?i:script|style)(?:[ \t\n\r\f/]|\Z))[a-zA-Z][a-zA-Z0-9]*{_ATTRS}/?)")


def _piece(text: str) -> tuple | None:
    """Tokens of what stands between < and >, None if it is more than a tag in plain markup."""
    match = _PIECE.fullmatch(text)
    if match is None:
        return None
    if match[1]:
        found = ((2, match[1].lower(), None),)
    else:
        name, attrs, closed = _tag(f"<{text}>")
        found = ((1, name, attrs), (2, name, None)) if closed else ((1, name, attrs),)
    return _keep(_PIECES, text, found) if len(text) <= KEPT_LENGTH else found


def _cut(html: str) -> list[tuple] | None:
    """Tokens of a page that is nothing but texts and tags without < or > in their attributes, None for any other page.

    Such a page is cut at its brackets; a tag that ends at its first > and is whole there is what ``_TOKEN`` finds, too.
    """
    head, *pieces = html.split("<")
    found = [(0, unescape(head) if "&" in head else head, None)] if head else []
    for piece in pieces:
        tag, end, text = piece.partition(">")
        tokens = (_PIECES.get(tag) or _piece(tag)) if end else None
        if tokens is None:
            return None
        found += tokens
        if text:
            found.append((0, unescape(text) if "&" in text else text, None))
    return found


def _tokens(html: str) -> list[tuple] | None:
    """Tokens ``(kind, value, attributes)`` of a page in plain markup, None for any other page."""
    if (found := _cut(html)) is not None:
        return found
    found = []
    add = found.append
    for m in _TOKEN.finditer(html):
        kind = m.lastindex
        if kind == 1:
            text = m[1]
            add((0, unescape(text) if "&" in text else text, None))
        elif kind == 3:
            name, attrs, closed = _tag(m[3])
            add((1, name, attrs))
            if closed:
                add((2, name, None))
        elif kind == 2:
            add((2, m[2].lower(), None))
        elif m["raw"]:
            name, attrs, _ = _tag(m["open"])
            add((1, name, attrs))
            if m["body"]:
                add((0, m["body"], None))
            add((2, name, None))
        elif kind:
            return None
    return found


def _walk(html: str | None, *walkers) -> None:
    tokens = _tokens(html or "")
    if tokens is None:
        reader = Reader(*walkers)
        reader.feed(html or "")
        reader.close()
        return
    for walker in walkers:
        if hasattr(walker, "over"):
            walker.over(tokens)
            continue
        start, end, data = walker.start, walker.end, walker.data
        for kind, value, attrs in tokens:
            if kind == 0:
                data(value)
            elif kind == 1:
                start(value, attrs)
            else:
                end(value)


CARD_FIELDS = (
    "href", "job_id", "title", "company", "location", "department", "workplace_type", "posted_time", "datetime", "snippet",
)
DETAIL_FIELDS = ("title", "company", "location", "department", "employment", "workplace", "posted_time", "datetime", "primary")


def _failure(html: str | None, *walkers) -> str | None:
    """Walk a page; what stopped the parser, if anything did. One bad page must not end a job over all of them."""
    try:
        _walk(html, *walkers)
    except Exception as problem:  # noqa: BLE001 - whatever the page provokes becomes a row
        return f"{type(problem).__name__}: {problem}"
    return None


def read_cards(site: str, html: str | None) -> list[dict]:
    """Raw listing cards of one page; every card repeats the page's company name."""
    return read_page(site, html, links=False)["cards"]


def read_page(site: str, html: str | None, links: bool = True) -> dict:
    """Cards and next link of a listing page; a site without rules has no cards.

    A page the parser cannot get through has neither, and an ``error``.
    """
    cards = ListingWalker(site) if site in LISTING_RULES else None
    # a next link shows the word in an attribute or a text, plainly or as character references
    link = NextLinkWalker() if links and html and ("next" in html.lower() or "&#" in html) else None
    walkers = [w for w in (cards, link) if w is not None]
    if walkers and (error := _failure(html, *walkers)):
        return {"cards": [], "href": None, "error": error}
    found = [
        {f: c.get(f) or (cards.company if f == "company" else None) for f in CARD_FIELDS} for c in (cards.cards if cards else [])
    ]
    return {"cards": found, "href": link.found if link else None, "error": None}


def read_detail(site: str, html: str | None) -> dict:
    """Raw captures of one detail page; only an ``error`` if the parser cannot get through it."""
    walker = DetailWalker(site)
    if error := _failure(html, walker):
        return {**dict.fromkeys(DETAIL_FIELDS), "insights": None, "description": None, "error": error}
    return {
        "error": None,
        **{f: walker.fields.get(f) for f in DETAIL_FIELDS},
        "insights": walker.insights,
        "description": walker.description,
    }


def read_next_link(html: str | None) -> str | None:
    """Target of the first next link of any page."""
    return read_page("", html)["href"]


# Whole web addresses of plain characters: as a link such a one stays as it is, and as a base it can be read.
_WHOLE = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9_.~%/+,@:-]*)?(?:\?[A-Za-z0-9_.~%/+&=,@:-]+)?", re.ASCII).fullmatch


def resolve(base: str | None, href: str | None) -> str | None:
    """Absolute form of a link (FN18)."""
    if href is not None and _WHOLE(href) and (not base or _WHOLE(base)):
        return href
    try:
        return None if href is None else urljoin(base or "", href)
    except ValueError:
        return None
