"""Free-text prompts to structured constraints, for a whole table of prompts.

Everything is a column expression. Match offsets, which Spark does not give, come from marking the matches
in the text: ``regexp_replace`` puts a control character before and after each match, and the text before a
match is what the split leaves on its left.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.functions.reports import intent_summary, parser_notes
from rolegrid.functions.text import any_contains, any_prefix, clean_list, distinct_ci, let, one_of, squash_ws
from rolegrid.schemas import LIST_CONSTRAINTS

# Unicode-aware case folding, word characters and word boundaries.
CI = "(?iuU)"
# Letters other than its capital that match an ASCII letter ignoring case; they do not lower-case to it.
ODD_FORMS = {"s": "\u017f", "i": "\u0131\u0130", "k": "\u212a"}
ODD_LETTERS = f"[{''.join(ODD_FORMS.values())}]"
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"
# White space other than blanks, and control characters.
NOT_BLANKS = r"(?=[^ -~])(?U)[\x00-\x1f\s]"


def at_word(letters: str, pattern: str) -> str:
    """A pattern that begins with a word boundary and one of the letters, case ignored.

    A word boundary that knows all scripts costs far more than a look at two characters, so it is only tried
    where one of the letters follows and no ASCII word character precedes; many letters are not worth a look.
    """
    forms = "".join(c + c.upper() + ODD_FORMS.get(c, "") for c in letters)
    return (rf"(?=[{forms}])" if len(letters) < 8 else "") + rf"(?<![A-Za-z0-9_]){CI}(?:{pattern})"


# Role family -> job title.
ROLE_TITLES = {
    "ai": "AI Engineer",
    "ai security": "AI Security Engineer",
    "analytics": "Analytics Engineer",
    "android": "Android Engineer",
    "applied ai": "Applied AI Engineer",
    "backend": "Backend Engineer",
    "cloud": "Cloud Engineer",
    "data": "Data Engineer",
    "data platform": "Data Platform Engineer",
    "devops": "DevOps Engineer",
    "frontend": "Frontend Engineer",
    "front end": "Frontend Engineer",
    "full stack": "Full Stack Engineer",
    "full-stack": "Full Stack Engineer",
    "infrastructure": "Infrastructure Engineer",
    "ios": "iOS Engineer",
    "machine learning": "Machine Learning Engineer",
    "ml": "Machine Learning Engineer",
    "platform": "Platform Engineer",
    "product": "Product Engineer",
    "python": "Python Engineer",
    "qa": "QA Engineer",
    "research": "Research Engineer",
    "security": "Security Engineer",
    "site reliability": "Site Reliability Engineer",
    "sre": "Site Reliability Engineer",
}
# Families whose keywords are not their own words.
ROLE_KEYWORDS = {"ml": ["machine learning"], "machine learning": ["machine learning"], "front end": ["frontend"], "site reliability": ["site reliability"]}
UPPER_WORDS = ("qa", "ml", "ai", "ios")
UPPER_KEYWORDS = ("ai", "qa", "ios")

# Word lists and patterns of the prompt language.
LEVELS = ("senior", r"sr\.?", "junior", r"jr\.?", "staff", "lead", "principal", "mid(?:-level)?")
TITLE_WORD = one_of(
    *LEVELS, "backend", "front(?:-| )end", "full(?:-| )stack", "software", "platform", "data", "product", "devops", "site reliability", "sre",
    "machine learning", "ml", "security", "cloud", "infrastructure", "mobile", "android", "ios", "qa", "applied", "research", "analytics", "python", "ai",
)
TITLE_NOUNS = ("engineer", "developer", "scientist", "analyst", "designer", "manager", "architect", "administrator", "specialist", "recruiter")
TITLE_NOUN = one_of(*TITLE_NOUNS)
TITLE_PATTERN = at_word("abcdefijlmpqrs", rf"\b((?:{TITLE_WORD})(?:\s+(?:{TITLE_WORD})){{0,3}}\s+(?:{TITLE_NOUN})|(?:{TITLE_NOUN}))\b")
FAMILIES = (
    "backend", "front(?:-| )end", "full(?:-| )stack", "platform", "data", "product", "devops", "site reliability", "sre", "machine learning", "ml",
    "security", "cloud", "infrastructure", "android", "ios", "qa", "analytics", "python", "ai",
)
ROLE_PATTERN = at_word(
    "abcdfijlmpqs",
    rf"\b((?:{one_of(*LEVELS, *FAMILIES)})(?:[\s/-]+(?:{one_of(*FAMILIES, 'trust', 'safety')})){{0,3}})\s+(roles?|jobs?|positions?|openings?)\b",
)
LEADING_LEVEL = r"(?U)^(?:senior|sr|junior|jr|staff|lead|principal|mid|mid level)\s+"

# Level, pattern, words one of which it needs.
SENIORITY_PATTERNS = (
    ("intern", at_word("i", r"\bintern(ship)?\b"), ("intern",)),
    ("entry", at_word("je", r"\b(junior|jr\.?|entry(?:-level)?)\b"), ("junior", "jr", "entry")),
    ("mid", at_word("m", r"\bmid(?:-level)?\b"), ("mid",)),
    ("senior", at_word("s", r"\bsenior\b|\bsr\.?\b"), ("senior", "sr")),
    ("staff", at_word("s", r"\bstaff\b"), ("staff",)),
    ("principal", at_word("p", r"\bprincipal\b"), ("principal",)),
    ("lead", at_word("l", r"\blead\b"), ("lead",)),
    ("manager", at_word("m", r"\bmanager\b"), ("manager",)),
    ("director", at_word("d", r"\bdirector\b"), ("director",)),
    ("executive", at_word("evc", r"\bexecutive\b|\bvp\b|\bchief\b"), ("executive", "vp", "chief")),
)
# Tried in this order: preference, pattern, words one of which it needs.
REMOTE_PATTERNS = (
    ("remote_only", at_word("rfom", r"\bremote[- ]only\b|\bfully remote\b|\bremote roles? only\b|\bonly remote\b|\bmust be remote\b"),
     ("remote-only", "remote only", "fully remote", "remote role", "only remote", "must be remote")),
    ("hybrid_only", at_word("hom", r"\bhybrid[- ]only\b|\bonly hybrid\b|\bmust be hybrid\b"), ("hybrid-only", "hybrid only", "only hybrid", "must be hybrid")),
    ("onsite_only", at_word("om", r"\bon-?site[- ]only\b|\bonly on-?site\b|\bmust be on-?site\b"), ("site-only", "site only", "only on", "must be on")),
    ("remote_preferred", at_word("pri", r"\bprefer(?:ably)? remote\b|\bremote preferred\b|\bideally remote\b|"
                         r"\bremote\s+(?:[a-z]+(?:\s+[a-z]+){0,2}\s+)?(?:roles?|jobs?|positions?|openings?)\b"), ("remote",)),
    ("hybrid_preferred", at_word("phi", r"\bprefer(?:ably)? hybrid\b|\bhybrid preferred\b|\bideally hybrid\b"),
     ("prefer hybrid", "preferably hybrid", "hybrid preferred", "ideally hybrid")),
    ("onsite_preferred", at_word("poi", r"\bprefer(?:ably)? on-?site\b|\bon-?site preferred\b|\bideally on-?site\b"),
     ("prefer on", "preferably on", "site preferred", "ideally on")),
    ("onsite_ok", at_word("o", r"\bon-?site (?:is )?(?:ok|okay|fine)\b"), ("site ok", "site is ok", "site fine", "site is fine")),
)
# Tried in this order: pattern, days per unit of the captured number, or days as such, and a needed word.
FRESHNESS_PATTERNS = (
    (at_word("lp", r"\b(?:last|past)\s+(\d+)\s+days?\b"), 1, None, "day"),
    (at_word("lp", r"\b(?:last|past)\s+(\d+)\s+weeks?\b"), 7, None, "week"),
    (at_word("lp", r"\b(?:last|past)\s+(\d+)\s+months?\b"), 30, None, "month"),
    (at_word("lp", r"\b(?:last|past)\s+24\s+hours?\b"), None, 1, "hour"),
    (at_word("lp", r"\b(?:last|past)\s+fortnight\b"), None, 14, "fortnight"),
    (at_word("lp", r"\b(?:last|past)\s+week\b"), None, 7, "week"),
    (at_word("lp", r"\b(?:last|past)\s+month\b"), None, 30, "month"),
    (at_word("t", r"\bthis\s+week\b"), None, 7, "week"),
    (at_word("t", r"\btoday\b"), None, 1, "today"),
    (at_word("y", r"\byesterday\b"), None, 1, "yesterday"),
)
SITE_PATTERNS = (
    ("linkedin", at_word("ouvsl", r"\b(?:on|using|via)\s+linkedin\b|\bsearch\s+linkedin\s+jobs\b|\blinkedin\s+(?:jobs|source|site)\b"), ("linkedin",)),
    ("greenhouse", at_word("g", r"\bgreenhouse\b"), ("greenhouse",)),
    ("lever", at_word("l", r"\blever\b"), ("lever",)),
)
CLAUSE_STOPS = (
    "in", "from", "at", "on", "within", "over", "during", "posted", "last", "past", "today", "yesterday",
    "avoid", "exclude", "excluding", "without", "greenhouse", "lever", "prefer", "preferred", "ideally",
)
CLAUSE_STOP = at_word("adefgiloptwy", rf"\b(?:{one_of(*CLAUSE_STOPS)})\b(?s:.*)")
KEYWORD_MARKERS = (
    "with", "using", "experience with", "skills in", "skill in", "focused on", "focus on",
    "must have", "must include", "required", "require", "requires", "need", "needs",
)
PREFERENCE_MARKERS = ("prefer", "preferred", "ideally", "nice to have", "bonus if", "bonus points for")
EXCLUDE_MARKERS = ("avoid", "excluding", "exclude", "without", "not", "no")
CATEGORY_MARKERS = ("avoid", "exclude", "excluding", "not", "no")
PREFERRED_PLACE_MARKERS = (
    "prefer in", "prefer based in", "prefer located in", "ideally in", "ideally based in", "ideally located in",
    "prefer", "ideally", "preferred",
)
PLACE_PATTERNS = (
    (at_word("rjpo", r"\b(?:roles?|jobs?|positions?|openings?)\s+in\s+([^.;]+)"), ("role", "job", "position", "opening")),
    (at_word("blrmo", r"\b(?:based in|located in|remote in|must be in|only in)\s+([^.;]+)"), ("based in", "located in", "remote in", "must be in", "only in")),
    (at_word("a", r"\b(?:anywhere in)\s+([^.;]+)"), ("anywhere in",)),
    (at_word("af", r"\b(?:at|from)\s+[A-Za-z0-9 .&-]+\s+in\s+([^.;]+)"), ("at", "from")),
)
INCLUDE_COMPANY_PATTERNS = (
    (at_word("af", r"\b(?:at|from)\s+([^.;]+)"), ("at", "from")),
    (at_word("ipt", r"\b(?:include|prefer|target)\s+companies?\s+(?:like\s+)?([^.;]+)"), ("compan",)),
)
EXCLUDE_COMPANY_PATTERNS = (
    (at_word("ae", r"\b(?:avoid|exclude|excluding)\s+companies?\s+(?:like\s+)?([^.;]+)"), ("compan",)),
    (at_word("ae", r"(?-iu)(?U)\b(?:avoid|exclude|excluding)\s+([A-Z][^.;]+)"), ("avoid", "exclud")),
)
PREFERENCE_CONTEXT, PREFERENCE_WINDOW = ("prefer", "preferred", "ideally", "nice to have", "bonus"), 30
EXCLUSION_CONTEXT, EXCLUSION_WINDOW = ("avoid", "exclude", "excluding", "without", "not", "no "), 60
WORKPLACE_STEMS = ("remote", "hybrid", "site")
WORKPLACE_WORDS = ("remote", "hybrid", "onsite", "on-site")
NOT_PREFERRED_KEYWORDS = ("remote", "remote only", "hybrid", "hybrid only", "onsite", "onsite only", "on-site")
NOT_PLACES = ("remote", "preferably remote", "hybrid", "onsite", "on-site", "tech")
KEYWORD_STARTS = ("python", "backend", "frontend", "api", "data", "platform")
VAGUE_STARTS = ("maybe ", "around ", "about ")
CATEGORY_TERMS = (*ROLE_TITLES, "sales", "recruit", "manager", "management", "crypto", "adtech")
NOT_COMPANIES = ("startups", "startup", "companies", "company", "the", "last", "past")
FRESHNESS_WORDS = ("last", "past", "today", "yesterday", "week", "month", "day", "days")
FILLER_WORDS = (
    "a", "an", "and", "at", "based", "be", "can", "company", "companies", "find", "for", "from", "hire", "hiring", "i",
    "ideally", "in", "is", "job", "jobs", "like", "located", "looking", "me", "of", "on", "only", "or", "position",
    "positions", "prefer", "preferred", "role", "roles", "search", "show", "something", "that", "the", "to", "want", "with",
)


# Words looked for once in each prompt; a bit of ``Prompt.seen`` for each.
STEMS = (
    "with", "using", "skill", "focus", "must", "requir", "need", "prefer", "ideally", "nice", "bonus", "avoid", "exclud", "no",
    *WORKPLACE_STEMS, "role", "job", "position", "opening", "compan", "at", "from", "based", "located", "anywhere", "only",
    *TITLE_NOUNS, "day", "week", "month", "hour", "fortnight", "linkedin", "greenhouse", "lever",
    *dict.fromkeys(w for _, _, words in SENIORITY_PATTERNS for w in words if w not in TITLE_NOUNS),
)
# Markers of two lists; the items after them are read once.
SHARED_MARKERS = ("avoid", "exclude", "excluding", "not", "no", "prefer", "preferred", "ideally")


def seen_words(low: Column, odd: Column) -> Column:
    """Bits of the words that occur; all bits for odd texts.

    A pattern that is one literal of four letters or more skips ahead, which ``contains`` does not.
    """
    found = [low.rlike(w) if len(w) > 3 else low.contains(w) for w in STEMS]
    bits = [F.when(test, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, test in enumerate(found)]
    return F.when(odd, F.lit(-1).cast("bigint")).otherwise(reduce(lambda a, b: a.bitwiseOR(b), bits))


@dataclass(frozen=True)
class Prompt:
    """Columns of a prompt text.

    Most patterns occur in few prompts, and a substring test is far cheaper than a pattern. So each pattern
    comes with words one of which must occur in the lower-case text; ``seen`` tells which of ``STEMS`` occur.
    ``odd`` marks texts with letters that match an ASCII letter ignoring case without lower-casing to it; they
    always take the pattern. ``uneven`` marks texts with white space other than single blanks; in others there
    is none to squash.
    """

    text: Column
    low: Column
    odd: Column
    uneven: Column
    seen: Column

    def mentions(self, *words: str) -> Column:
        def any_of(stems: set[str]) -> Column:
            return self.seen.bitwiseAND(F.lit(sum(1 << STEMS.index(x) for x in stems)).cast("bigint")) != 0

        longer = {w: max((x for x in STEMS if x in w), key=len) for w in words if w not in STEMS}
        tests = [any_of({stem}) & (self.odd | self.low.rlike(w)) for w, stem in longer.items()]
        plain = {w for w in words if w in STEMS}
        return reduce(lambda a, b: a | b, [any_of(plain)] * bool(plain) + tests)

    def all(self, pattern: str, *words: str) -> Column:
        """First groups of all matches."""
        return F.when(self.mentions(*words), _all(self.text, pattern)).otherwise(F.array().cast("array<string>"))

    def has(self, pattern: str, *words: str) -> Column:
        return self.mentions(*words) & self.text.rlike(pattern)


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def clean_phrase(text: Column, uneven: Column) -> Column:
    bare = F.btrim(text, F.lit(" ,.;:()[]{}\"'"))
    return F.when(uneven, F.regexp_replace(bare, r"(?U)\s+", " ")).otherwise(bare)


def split_items(text: Column, uneven: Column) -> Column:
    """Items of an enumeration, cleaned, empty ones left out."""
    commas = F.regexp_replace(text, "/|" + at_word("oa", r"\b(?:or|and)\b"), ",")
    return F.filter(F.transform(F.split(commas, ","), lambda x: clean_phrase(x, uneven)), lambda x: F.trim(x) != "")


def clause_items(clauses: Column, uneven: Column) -> Column:
    """Clauses cut at the first stop word, stripped of white space and split into items (IN1)."""

    def items(clause: Column) -> Column:
        cut = F.regexp_replace(clause, CLAUSE_STOP, "")
        return split_items(F.when(uneven, F.regexp_replace(cut, r"(?U)^\s+|\s+$", "")).otherwise(cut), uneven)

    return F.flatten(F.transform(clauses, items))


def after_markers(prompt: Prompt, markers: tuple[str, ...]) -> Column:
    """Items of the clauses that follow each marker, marker by marker (IN1); needs the columns of ``shared_items``."""
    runs = [(shared, list(run)) for shared, run in groupby(markers, lambda m: m in SHARED_MARKERS)]
    return F.concat(*[x for shared, run in runs for x in (map(_after, run) if shared else [clause_items(F.concat(*[_clauses(prompt, m) for m in run]), prompt.uneven)])])


def shared_items(prompt: Prompt) -> dict[str, Column]:
    """A column of items for each marker of two lists."""
    return {f"_after_{m}": clause_items(_clauses(prompt, m), prompt.uneven) for m in SHARED_MARKERS}


def _after(marker: str) -> Column:
    return F.col(f"_after_{marker}")


def _clauses(prompt: Prompt, marker: str) -> Column:
    return prompt.all(at_word(marker[0], rf"\b{marker}\s+([^.;]+)"), marker)


def contexts(prompt: Prompt, pattern: str, words: tuple[str, ...]) -> Column:
    """Matches of a pattern with the text before each (IN16): ``phrase``, ``excluded``, ``preferred``."""
    plain = F.when(prompt.uneven, F.translate(prompt.text, "\x01\x02", "  ")).otherwise(prompt.text)
    marked = F.split(F.regexp_replace(plain, pattern, "\x01$0\x02"), "\x01")
    window = max(EXCLUSION_WINDOW, PREFERENCE_WINDOW)

    def match(part: Column, before: Column) -> Column:
        return F.struct(
            F.regexp_extract(F.substring_index(part, "\x02", 1), pattern, 1).alias("phrase"),
            any_contains(F.right(before, F.lit(EXCLUSION_WINDOW)), EXCLUSION_CONTEXT).alias("excluded"),
            any_contains(F.right(before, F.lit(PREFERENCE_WINDOW)), PREFERENCE_CONTEXT).alias("preferred"),
        )

    def matches(parts: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            # parts but the first hold a match, so this many hold the window
            near = F.slice(parts, F.greatest(i + 2 - window, F.lit(1)), F.least(i + 1, F.lit(window)))
            left = F.lower(F.right(F.replace(F.array_join(near, ""), F.lit("\x02"), F.lit("")), F.lit(window)))
            return let(left, lambda before: match(part, before))

        return F.transform(F.slice(parts, F.lit(2), F.size(parts)), one)

    none = F.array().cast("array<struct<phrase:string,excluded:boolean,preferred:boolean>>")
    return F.when(prompt.mentions(*words), let(marked, matches)).otherwise(none)


def normalize_title(title: Column) -> Column:
    spelled = F.regexp_replace(F.regexp_replace(title, r"[Ss]r\.", "Senior"), r"[Jj]r\.", "Junior")
    words = F.transform(
        F.split(squash_ws(spelled), " "),
        lambda w: F.when(F.lower(w).isin(*UPPER_WORDS), F.upper(w)).otherwise(F.initcap(w)),
    )
    return F.replace(F.array_join(words, " "), F.lit("Devops"), F.lit("DevOps"))


def role_family(phrase: Column) -> Column:
    """Family named by a cleaned phrase, without its level word (IN15)."""
    return F.regexp_replace(F.replace(F.lower(phrase), F.lit("-"), F.lit(" ")), LEADING_LEVEL, "")


def family_title(family: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ROLE_TITLES.items() for x in pair]), family)


def family_keywords(family: Column) -> Column:
    """Keywords of a known family, null for others (IN15)."""
    pairs = []
    for name in ROLE_TITLES:
        words = ROLE_KEYWORDS.get(name) or [w.upper() if w in UPPER_KEYWORDS else w for w in name.split()]
        pairs += [F.lit(name), F.array(*[F.lit(w) for w in words])]
    return F.try_element_at(F.create_map(*pairs), family)


def _roles(roles: Column, preferred: bool, uneven: Column) -> Column:
    """Phrases of the role mentions wanted or preferred, exclusions left out."""
    fit = F.filter(roles, lambda m: ~m["excluded"] & (m["preferred"] == preferred))
    return F.transform(fit, lambda m: clean_phrase(m["phrase"], uneven))


def role_titles(roles: Column, preferred: bool, uneven: Column) -> Column:
    items = F.flatten(F.transform(_roles(roles, preferred, uneven), lambda x: split_items(x, uneven)))
    return F.array_compact(F.transform(items, lambda x: family_title(role_family(x))))


def role_keywords(roles: Column, preferred: bool, uneven: Column) -> Column:
    def words(phrase: Column) -> Column:
        parts = F.flatten(F.array_compact(F.transform(split_items(phrase, uneven), lambda x: family_keywords(role_family(x)))))
        return F.coalesce(family_keywords(role_family(phrase)), parts)

    return F.flatten(F.transform(_roles(roles, preferred, uneven), words))


def _keyword_like(item: Column) -> Column:
    low = F.lower(item)
    return ~low.isin(*WORKPLACE_WORDS) & ~low.contains("company") & (low != "")


def role_or_category(item: Column) -> Column:
    return any_contains(F.lower(item), CATEGORY_TERMS)


def place_like(item: Column) -> Column:
    low = F.lower(item)
    return ~(
        any_prefix(low, KEYWORD_STARTS) | low.contains("company") | low.isin(*NOT_PLACES) | any_prefix(low, VAGUE_STARTS)
        | any_contains(low, WORKPLACE_WORDS) | role_or_category(item)
    )


def _without_prefix(item: Column) -> Column:
    return F.regexp_replace(item, CI + r"^(?:companies?|company)\s+like\s+", "")


def company_hints(prompt: Prompt, patterns: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """Company names after at/from or after an exclusion (IN14)."""
    items = F.transform(clause_items(F.concat(*[prompt.all(p, *words) for p, words in patterns]), prompt.uneven), _without_prefix)

    def fits(x: Column) -> Column:
        low = F.lower(x)
        return ~low.isin(*NOT_COMPANIES) & (F.length(low) >= 2) & ~role_or_category(x)

    return distinct_ci(F.filter(items, fits))


def locations(prompt: Prompt) -> Column:
    """Required places (IN8)."""
    clauses = F.concat(*[prompt.all(p, *words) for p, words in PLACE_PATTERNS])
    return distinct_ci(F.filter(clause_items(clauses, prompt.uneven), place_like))


def preferred_locations(prompt: Prompt) -> Column:
    """Places after a preference (IN9)."""
    return distinct_ci(F.filter(after_markers(prompt, PREFERRED_PLACE_MARKERS), place_like))


def _first(*choices: tuple[Column, Column], default: Column) -> Column:
    return F.coalesce(*[F.when(test, value) for test, value in choices], default)


def remote_preference(prompt: Prompt) -> Column:
    """First pattern group that occurs (IN10)."""
    choices = [(prompt.has(p, *words), F.lit(name)) for name, p, words in REMOTE_PATTERNS]
    none = F.lit("unspecified")
    return F.when(prompt.mentions(*WORKPLACE_STEMS), _first(*choices, default=none)).otherwise(none)


def _named(prompt: Prompt, patterns: tuple[tuple[str, str, tuple[str, ...]], ...]) -> Column:
    return F.array_compact(F.array(*[F.when(prompt.has(p, *words), F.lit(name)) for name, p, words in patterns]))


def seniority_preferences(prompt: Prompt) -> Column:
    """All levels named, in level order (IN11)."""
    return _named(prompt, SENIORITY_PATTERNS)


def source_sites(prompt: Prompt) -> Column:
    """Sites asked for; linkedin only by an explicit phrase (IN12)."""
    return _named(prompt, SITE_PATTERNS)


def freshness_days(prompt: Prompt) -> Column:
    """Window in days of the first pattern that occurs, patterns in list order (IN13)."""
    choices = []
    for pattern, unit, days, word in FRESHNESS_PATTERNS:
        if days is None:
            value = F.regexp_extract(prompt.text, pattern, 1).try_cast("bigint") * F.lit(unit)
            value = F.coalesce(value, F.lit(-1).cast("bigint"))  # a number that does not fit is no valid window
        else:
            value = F.lit(days).cast("bigint")
        choices.append((prompt.has(pattern, word), value))
    return _first(*choices, default=F.lit(None).cast("bigint"))


def unresolved_fragments(text: Column, wanted: Column, uneven: Column) -> Column:
    """Clauses that touch nothing resolved and hold two words of substance (IN18)."""
    tokens = F.filter(F.transform(F.concat(*[wanted[n] for n in LIST_CONSTRAINTS]), F.lower), lambda t: t != "")
    clauses = F.transform(F.split(text, "[.;,]"), lambda x: clean_phrase(x, uneven))

    def untouched(low: Column, tokens: Column) -> Column:
        words = F.filter(_all(low, r"([A-Za-z0-9][A-Za-z0-9+/-]*)"), lambda w: ~w.isin(*FILLER_WORDS))
        return (
            (F.trim(low) != "")
            & ~F.exists(tokens, lambda t: low.contains(t))
            & ~((wanted["remote_preference"] != "unspecified") & any_contains(low, WORKPLACE_WORDS))
            & ~(wanted["freshness_window_days"].isNotNull() & any_contains(low, FRESHNESS_WORDS))
            & (F.size(words) >= 2)
        )

    # the tokens are gathered once for all clauses
    return distinct_ci(let(tokens, lambda found: F.filter(clauses, lambda x: let(F.lower(x), lambda low: untouched(low, found)))))


def parse_prompts(prompts: DataFrame, text: str = "raw_prompt_text") -> DataFrame:
    """Add ``want`` (constraints), ``parser_notes``, ``unresolved_fragments``, ``summary`` and ``error`` (IN20).

    A prompt that is empty or names a window outside 1..365 days gets an error and no constraints.
    """
    t = F.col(text)
    uneven = F.col("_uneven")
    p = Prompt(t, F.col("_low"), F.col("_odd"), uneven, F.col("_seen"))
    base = prompts.withColumns({
        "_low": F.lower(t),
        "_odd": (F.octet_length(t) != F.length(t)) & t.rlike(ODD_LETTERS),
        "_uneven": t.contains("  ") | t.rlike(NOT_BLANKS),
    }).withColumn("_seen", seen_words(p.low, p.odd)).withColumns(
        {
            "_roles": contexts(p, ROLE_PATTERN, ("role", "job", "position", "opening")),
            "_titles": contexts(p, TITLE_PATTERN, TITLE_NOUNS),
            **shared_items(p),
        }
    )
    explicit = F.transform(F.filter("_titles", lambda m: ~m["excluded"]), lambda m: normalize_title(m["phrase"]))
    roles = F.col("_roles")
    keywords = F.concat(after_markers(p, KEYWORD_MARKERS), role_keywords(roles, preferred=False, uneven=uneven))
    step = base.withColumns(
        {
            "target_titles": distinct_ci(F.concat(explicit, role_titles(roles, preferred=False, uneven=uneven))),
            "preferred_titles": distinct_ci(role_titles(roles, preferred=True, uneven=uneven)),
            "include_keywords": distinct_ci(F.filter(keywords, _keyword_like)),
            "_preferred": F.concat(after_markers(p, PREFERENCE_MARKERS), role_keywords(roles, preferred=True, uneven=uneven)),
            "_excluded": after_markers(p, EXCLUDE_MARKERS),
            "excluded_role_categories": distinct_ci(F.filter(after_markers(p, CATEGORY_MARKERS), role_or_category)),
            "location_constraints": locations(p),
            "preferred_locations": preferred_locations(p),
            "remote_preference": remote_preference(p),
            "seniority_preferences": seniority_preferences(p),
            "source_site_preferences": source_sites(p),
            "_days": freshness_days(p),
            "include_companies": company_hints(p, INCLUDE_COMPANY_PATTERNS),
            "exclude_companies": company_hints(p, EXCLUDE_COMPANY_PATTERNS),
        }
    )
    taken = F.transform(F.concat("include_keywords", "preferred_locations"), F.lower)
    companies = F.transform("exclude_companies", lambda c: F.lower(_without_prefix(c)))
    step = step.withColumn("_taken", taken).withColumn("_companies", companies).withColumns(
        {
            "preferred_keywords": distinct_ci(
                F.filter(
                    "_preferred",
                    lambda k: _keyword_like(k) & ~F.array_contains("_taken", F.lower(k)) & ~F.lower(k).isin(*NOT_PREFERRED_KEYWORDS),
                )
            ),
            "exclude_keywords": distinct_ci(
                F.filter(
                    "_excluded",
                    lambda k: _keyword_like(k) & ~F.array_contains("_companies", F.lower(_without_prefix(k))),
                )
            ),
        }
    )
    valid_days = F.col("_days").isNull() | F.col("_days").between(1, 365)
    error = F.when(~t.rlike(NOT_BLANK), "prompt text is empty").when(
        ~valid_days, "freshness window must be between 1 and 365 days"
    )
    want = F.struct(
        *[F.when(uneven, clean_list(n)).otherwise(F.col(n)).alias(n) for n in LIST_CONSTRAINTS],
        F.col("remote_preference"),
        F.col("_days").cast("int").alias("freshness_window_days"),
    )
    step = step.withColumn("error", F.when(t.isNull(), "prompt text is empty").otherwise(error)).withColumn(
        "want", F.when(F.col("error").isNull(), want)
    )
    kept = [c for c in prompts.columns]
    step = step.select(*kept, "want", "error", "_uneven").withColumn(
        "unresolved_fragments", F.when(F.col("want").isNotNull(), unresolved_fragments(t, F.col("want"), uneven))
    ).drop("_uneven")
    return step.withColumn("parser_notes", F.when(F.col("want").isNotNull(), parser_notes(F.col("want")))).withColumn(
        "summary", intent_summary(F.col("want"), F.col("unresolved_fragments"))
    )
