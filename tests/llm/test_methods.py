"""Each operator against a brute-force version, an exact round trip, or held-out rows."""

import hashlib
import random
import string
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from rolegrid.llm import chat, decontaminate, html, language, line_dedup, mixing, neighbours, queries, simhash, substrings, toxicity

SMALL = "/root/testdata/sf0.001"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def near_copies(seed, n=60, words=120):
    """Texts of random words, with copies that differ in a few words, and lines that several share."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 7))) for _ in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            copy = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, words))))
    return texts


# ---- toxicity ----------------------------------------------------------------------------------------


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours."""
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0, :] = np.arange(len(a) + 1), np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[-1, -1]


WORDS = {"abcde": 1, "abxyz": 1, "scum": 0, "bbaabb": 1, "abcdeyzx": 2}
STEMS = {"dead": 1, "dab": 0}
BARRED = frozenset(["abcdd", "ded"])


def stem_edits(token: str, stem: str, most: int):
    """Beginnings of a token near a stem whose last letter, or whose swapped last two, stand."""
    for n in range(1, len(token) + 1):
        part = token[:n]
        costs = [edits(part[:-1], stem[:-1])] * (part[-1] == stem[-1]) + [edits(part[:-2], stem[:-2]) + 1] * (n > 1 and part[-2:] == stem[-1] + stem[-2])
        if costs and min(costs) <= most:
            yield min(costs), stem, part


@settings(max_examples=900, deadline=None)
@given(st.text("abcdexyzsum", max_size=9) | st.tuples(st.sampled_from([*WORDS, *STEMS]), st.lists(st.tuples(st.integers(0, 8), st.sampled_from("abcdexyz")), max_size=2)).map(
    lambda t: "".join([t[0], *(c for _, c in t[1])]) if len(t[1]) < 2 else t[0][: t[1][0][0]] + t[1][0][1] + t[0][t[1][1][0] :]))
def test_automaton_accepts_what_is_near(token):
    found = toxicity.Trie(WORDS, STEMS, BARRED).match(token)
    near = [(edits(token, w), w, token) for w, most in WORDS.items() if edits(token, w) <= most]
    near += [x for s, most in STEMS.items() for x in stem_edits(token, s, most)]
    near = [(n, entry) for n, entry, part in near if not n or part not in BARRED]
    assert (found[::-1] if found else None) == (min(near) if near else None)


def test_quotation_weighs_less():
    memo = toxicity.Memo(toxicity.Trie({"idiot": 1}, {}))
    weight = lambda t: toxicity.features(t.encode(), memo)[:2]
    assert weight('He said "what an idiot" and left')[0] < weight('what an "idea": idiot and left')[0] <= weight("you idiot")[0]
    assert weight("an id1ot")[1] > 0 == weight("an id1ot")[0]
    assert weight("nothing here") == (0.0, 0.0) and weight("„Du Idiot“ é idiot")[0] > 0


def test_toxic_rows_are_found_and_clean_ones_left(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(300)]
    bad = ["zorgle", "vumpkit"]
    rows = []
    for i in range(600):
        words = rng.choices(plain, k=rng.randint(5, 60))
        toxic = i % 5 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.where("doc_id % 3 <> 1").select("doc_id", "toxic"))
    assert set(model.words) == set(bad)
    tested = docs.where("doc_id % 3 = 1").select("doc_id", "text", "toxic").union(spark.createDataFrame([(900, "so vumkpit alter", 1), (901, "zorglle alter", 1)], docs.schema))
    for r in toxicity.with_features(tested, model, "f").collect():
        assert (r.f.score >= 0.7) == bool(r.toxic), r


@pytest.mark.parametrize("seed", range(5))
def test_every_learned_term_is_found_misspelled(seed):
    rng = random.Random(seed)
    make = lambda low, high: "".join(rng.choices(string.ascii_lowercase, k=rng.randint(low, high)))
    clean = {make(2, 9): (0, rng.randint(1, 200)) for _ in range(2000)}
    stem = make(5, 5)
    terms = {make(4, 4), make(4, 7), make(8, 12)} | {stem + make(1, 4) for _ in range(8)}
    counts = clean | {t: (20, 0) for t in terms}
    words, stems, barred, _ = toxicity.choose(counts, 500, 500)
    assert all(any(t.startswith(s) for s in stems) or words[t] == toxicity.allowed(t) >= 1 for t in terms)
    trie = toxicity.Trie(words, stems, barred)
    assert not [w for w in clean if trie.match(w)]
    for term in [*words, *stems]:
        stands = term in stems
        for _ in range(50):
            wrong = term
            for _ in range(toxicity.allowed(term)):
                i, letter = rng.randrange(len(wrong) - 1 - stands), rng.choice("0147*")
                wrong = rng.choice([wrong[:i] + letter + wrong[i + 1 :], wrong[:i] + letter + wrong[i:], wrong[:i] + wrong[i + 1] + wrong[i] + wrong[i + 2 :]])
            if edits(wrong, term) <= toxicity.allowed(term) and not any(wrong.startswith(b) for b in barred):
                assert trie.match(wrong + "s" * stands), (wrong, term)


# ---- language ----------------------------------------------------------------------------------------


def plain_code_length(text: str, trained: list[str]) -> float:
    """Bits by the rule itself, one byte after the other, with dictionaries."""
    k = language.ORDER
    seen, contexts = Counter(), defaultdict(set)
    for t in trained:
        b = b" " * k + t.encode().translate(language.FOLD)
        for i in range(k, len(b)):
            for n in range(k + 1):
                seen[b[i - n : i], b[i]] += 1
                contexts[b[i - n : i]].add(b[i])
    total = Counter()
    for (c, _), n in seen.items():
        total[c] += n
    bits, b = 0.0, b" " * k + text.encode().translate(language.FOLD)
    for i in range(k, len(b)):
        for n in range(k, -1, -1):
            c = b[i - n : i]
            if (c, b[i]) in seen:
                bits += np.log2((total[c] + len(contexts[c])) / seen[c, b[i]])
                break
            if c in contexts:
                bits += np.log2((total[c] + len(contexts[c])) / len(contexts[c]))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(spark, monkeypatch):
    monkeypatch.setattr(language, "PIECE", 64)
    monkeypatch.setattr(language, "REMEMBERED", 40)
    trained = {"a": ["the cat sat on the mat", "a hat"], "b": ["die katze saß auf der matte", "über"]}
    rows = [(i, t, n) for i, (n, t) in enumerate((n, t) for n, ts in trained.items() for t in ts)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tested = ["the mat", "", "ß", "größe 12! der Katzen", "qqqq" * 50, "x"] * 3
    got = model.code_lengths([t.encode() for t in tested], language.Costs(model.trees))
    want = [[plain_code_length(t, trained[n]) for n in model.languages] for t in tested]
    assert np.allclose(got, want, rtol=1e-5)


def test_held_out_languages_are_right(spark):
    found = queries.op2_language(spark, SMALL).where("held_out").join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 20 and np.mean([r.lang == r.lang_pred for r in found]) >= 0.95


# ---- decontamination -----------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abA 1.é", max_size=25), max_size=4), st.text("abA 1.é", max_size=60), st.integers(1, 4))
def test_occurrences_equal_every_window_tried(items, text, size):
    index = decontaminate.window_index([(str(i), t.encode()) for i, t in enumerate(items)], size)
    words = decontaminate.words_of(text.encode())
    hit, met = set(), set()
    for i, item in enumerate(items):
        w = decontaminate.words_of(item.encode())
        n = min(size, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            for b in range(len(words) - n + 1):
                if words[b : b + n] == w[a : a + n]:
                    hit.update(range(b, b + n))
                    met.add(str(i))
    spans, found = decontaminate.occurrences(words, index)
    assert {p for a, b in spans for p in range(a, b)} == hit and found == met
    assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:])) or all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_blocks_of_the_benchmark_and_cut_spans(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(30)], "item_id long, text string")
    docs = frame(spark, ["a " + " ".join(f"w{i}x{j}" for j in range(11)) + "! b. " + " ".join(f"w{i + 1}x{j}" for j in range(9)) for i in range(0, 28, 4)] + ["clean words"])
    whole = sorted(map(str, decontaminate.contamination(docs, items).collect()))
    assert sorted(map(str, decontaminate.contamination(docs, items, block_bytes=300).collect())) == whole
    assert [r.text for r in decontaminate.decontaminate(docs, items).collect()] == ["clean words"]
    assert decontaminate.decontaminate(docs, items, remove="spans").first().text == "a ! b. " + " ".join(f"w1x{j}" for j in range(9))


# ---- chat --------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a: b", "", "\\"]), st.text("#</turn>\\ :\nassistant é", max_size=30)), max_size=5))
def test_rendering_is_reversible(turns):
    text, spans = chat.render(turns)
    assert chat.read_back(text) == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_deltas_edits_and_regenerations(spark):
    log = [
        (1, 5, "delta", 1, "assistant", "lo"), (1, 4, "delta", 1, "assistant", "hel"), (1, 1, "message", 0, "user", "hi"), (1, 6, "edit", 0, None, "hi!"),
        (1, 7, "message", 2, "user", "more"), (1, 8, "regenerate", 1, None, None), (1, 9, "delta", 1, None, "bye"), (1, 10, "edit", 9, None, "nobody"), (1, 11, "odd", 0, "user", "x"), (2, 1, "delta", 0, "assistant", "a"),
    ]
    out = chat.formatted(spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string").repartition(5))
    assert {r.conv_id: chat.read_back(r.formatted) for r in out.collect()} == {1: [("user", "hi!"), ("assistant", "bye")], 2: [("assistant", "a")]}


# ---- html --------------------------------------------------------------------------------------------


def test_template_furniture_and_prose(spark):
    def page(i):
        menu = "".join(f"<li><a href=/{j}>M{j}</a>" for j in range(3))
        return f"""<!DOCTYPE html><html><head><title>t</title><script>if (a < b) "</p>"</script></head><body><nav><ul>{menu}</ul></nav><header><h1>Site</h1></header>
        <div class=wrap><article class="post"><h1>Title &#233;{i}</h1><p>First <b>bo</b>ld &lt;{i}&gt;<br>line<p>Shared line.<div><span>Read also: the same on every page</span></div><ul><li>one {i}<li>two</ul>
        <div class="share-buttons">tweet</div><aside>side</aside><table><tr><td>c{i}<td>d</table><form><input></form></article></div>
        <section id="comments"><article class="comment"><p>I disagree</p></article></section><div>bottom of all pages</div><footer>&copy; x</footer></body></html>"""

    rows = [(i, f"https://A.test/{i}", page(i)) for i in range(12)] + [(99, "https://b.test/", "<body><div>Read also: the same on every page</div><p hidden>no</p>tail")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages, min_pages=10).collect()}
    assert got[3] == "Title é3 First bold <3> line Shared line. one 3 two c3 d"
    assert got[99] == "Read also: the same on every page tail"
    few = {r.page_id: r.text for r in html.extract(pages, min_pages=13).collect()}
    assert few[3] == "Title é3 First bold <3> line Shared line. Read also: the same on every page one 3 two c3 d"


def test_copies_of_a_page_are_no_template(spark):
    same = "<article><div><p>All of this text</p></div></article>"
    pages = spark.createDataFrame([(i, "https://a.test/", same) for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in html.extract(pages, min_pages=5).collect()} == {"All of this text"}


# ---- substrings --------------------------------------------------------------------------------------


def plain_repeats(texts: list[bytes], length: int) -> list[tuple]:
    seen, out = set(), []
    for b in texts:
        cover = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                cover[s : s + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~cover[: len(b)]]) if b else b""
        out.append((len(b), int(cover.sum()), int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length, seed", [(100, 1), (100, 2), (64, 3), (77, 4), (128, 5)])
def test_repeats_equal_a_scan_of_all_windows(spark, monkeypatch, length, seed):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 3000)
    texts = near_copies(seed, n=40) + ["ab " * 150, "é" * 130, "x" * 99, "ab " * 90 + "c" + "ab " * 90]
    got = substrings.digest(frame(spark, texts).repartition(5), length=length).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == plain_repeats([t.encode() for t in texts], length)


def test_small_pieces_give_the_same_anchors(monkeypatch):
    values = [t.encode() for t in near_copies(9, n=8, words=400)]
    whole = substrings.Batch(values, 100)
    monkeypatch.setattr(substrings, "PIECE", 150)
    parts = substrings.Batch(values, 100)
    assert all((getattr(whole, n) == getattr(parts, n)).all() for n in ("anchor", "first", "count", "doc", "name"))


# ---- neighbours --------------------------------------------------------------------------------------


def test_factor_one_is_exact_and_more_keeps_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    v[700:760] = v[700]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    score = np.stack([neighbours.products(v, np.broadcast_to(q, v.shape)) for q in v[::20]])
    want = {}
    for q, s in zip(range(0, 1500, 20), score):
        s[q] = -np.inf
        want[q] = np.lexsort((np.arange(1500), -s))[:20].tolist()
    for factor in (1.0, queries.NEIGHBOUR_FACTOR, 1.5):
        out = neighbours.nearest(table, F.col("vec_id") % 20 == 0, factor=factor, shard_rows=500, block_rows=30).orderBy("query_id", "rank").collect()
        got = defaultdict(list)
        for r in out:
            got[r.query_id].append(r.vec_id)
        if factor == 1:
            assert got == want
        assert np.mean([len(set(got[q]) & set(w)) / 20 for q, w in want.items()]) >= 0.9


# ---- mixing ------------------------------------------------------------------------------------------


def test_weighted_tokens_meet_the_targets(spark):
    rng = random.Random(2)
    cells = spark.createDataFrame([(s, l, t, rng.randint(1, 1000)) for s in "abc" for l in ("en", "de", None) for t in "xy"], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.6, "de": 0.3, None: 0.1}, "topic": {"x": 0.4, "y": 0.6}}
    mix = mixing.rake(cells, targets=targets, sweeps=40)
    weighed = cells.join(mix.sources, "source").withColumn("w", mix.weight(F.col("lang"), F.col("topic"), F.col("scale")) * F.col("tokens"))
    rows = weighed.collect()
    whole = sum(r.w for r in rows)
    for margin, shares in targets.items():
        for value, share in shares.items():
            assert sum(r.w for r in rows if r[margin] == value) / whole == pytest.approx(share, rel=1e-6)


# ---- lines -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["none", "first"])
def test_lines_equal_a_count_of_all(spark, keep):
    rng = random.Random(8)
    pool = [" A b", "a B\t", "c", "", "  ", "é", "É", "d" * 40] + [f"line {i}" for i in range(30)]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 8))) for _ in range(60)]
    key = lambda line: "".join(c.lower() if c in string.ascii_uppercase else c for c in line.strip(" \t\n\x0b\x0c\r"))
    count = Counter(k for t in texts for k in {key(x) for x in t.split("\n")} if k)
    first, want = set(), []
    for t in texts:
        lines = []
        for x in t.split("\n"):
            k = key(x)
            if count[k] < 7 or keep == "first" and k not in first:
                lines.append(x)
            if count[k] >= 7:
                first.add(k)
        want.append("\n".join(lines))
    for bits in (1 << 30, 1 << 4):  # a filter far too small makes every line a suspect and changes nothing
        out = line_dedup.dedup_lines(frame(spark, texts).repartition(4), keep=keep, min_docs=7, max_bits=max(bits, 1 << 4)).orderBy("doc_id").collect()
        assert [r.text for r in out] == want


ARTICLE = "<h1>T</h1><p>one two</p>"


@pytest.mark.parametrize("page", [
    f'<body class="has-sidebar"><nav>x</nav><div>{ARTICLE}</div></body>', f'<article class="post with-comments">{ARTICLE}</article>', f'<article class="post comments-open">{ARTICLE}<div class="comments-area">c</div></article>',
    f'<div class="layout with-sidebar"><article>{ARTICLE}</article><div class="sidebar-left">s</div></div>', f'<main class="with-sidebar">{ARTICLE}<footer>f</footer></main>',
    '<article><header class="entry-header"><h1>T</h1></header><p>one two</p><div class="share-buttons">s</div></article>', f'<div class="notice-board"><article>{ARTICLE}</article></div>',
    f'<article>{ARTICLE}</article><section class="comments"><article class="comment">bad</article></section>', f'<body><header><h1>Site</h1></header><div>{ARTICLE}</div><div class="cookie-banner">c</div></body>',
])
def test_articles_are_not_lost_with_their_layout(page):
    assert html.main_text(html.parse(page)) == "T one two"


@pytest.mark.parametrize("page", ['<a "' + "<a x" * 250_000, "<a x" * 250_000, '<a b="' * 170_000, "<a x" * 250_000 + '">"', '<a "' * 200_000 + ">", "<a '\"" * 150_000 + ">", "<!" * 500_000, "<span>" * 50_000 + "<div>" * 50_000, "<div>" * 50_000 + "</i>" * 100_000])
def test_broken_markup_is_read_in_linear_time(page):
    start = time.perf_counter()
    html.main_text(html.parse(page))
    assert time.perf_counter() - start < 20


def test_ends_of_tags():
    for page, want in (("<p>a < b \"quoted\" c > d</p>", 'a < b "quoted" c > d'), ('<a title="x > y">z</a>', "z"), ("<p class='a>b'>t</p>", "t"), ("<!-- a > b --><p>x</p>", "x"), ('<p>open "quote <b>bold</b>', 'open "quote bold'), ("<b x='>q</b> w", "q w")):
        assert html.main_text(html.parse(page)) == want


# ---- simhash -----------------------------------------------------------------------------------------


def plain_fingerprint(text: str) -> int:
    w = text.encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("parts, tile, radius", [(2, 2048, 3), (4, 8, 3), (8, 2048, 3), (2, 5, 8)])
def test_classes_equal_all_pairs(spark, monkeypatch, parts, tile, radius):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "cell_parts", lambda n, r: parts)
    texts = near_copies(parts + tile, n=90) + ["", " ", "one", "ONE"]
    prints = [plain_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = simhash.classes(frame(spark, texts), radius=radius).orderBy("doc_id").collect()
    assert [(int(r.fingerprint, 16), r.component_id) for r in got] == list(zip(prints, root))


def test_confirmed_links_drop_copies_and_keep_strangers(spark):
    texts = near_copies(21, n=120, words=200)
    shingles = [{tuple(t.split(" ")[i : i + 5]) for i in range(max(1, len(t.split(" ")) - 4))} for t in texts]
    kept = {r.doc_id for r in simhash.drop_near_copies(frame(spark, texts), radius=8, similarity=0.8).collect()}
    close = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.8
    alone = [i for i in range(len(texts)) if not any(close(i, j) for j in range(len(texts)) if j != i)]
    assert kept.issuperset(alone) and len(kept) < len(texts)
    copies = [i for i in range(len(texts)) if any(texts[i] == texts[j] for j in range(i))]
    assert copies and kept.isdisjoint(copies)


def shingled(texts):
    return [{" ".join(t.split(" ")[i : i + 5]) for i in range(max(1, len(t.split(" ")) - 4))} for t in texts]


def plain_classes(texts, similarity=0.8):
    """The smallest index of each text's class: all pairs, full sets of shingles."""
    sets, root = shingled(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


@pytest.mark.parametrize("tile, spare, heavy, cut", [(2048, 4, 1 << 21, 1024), (16, 0, 3000, 50), (2048, 1000, 1 << 21, 1024)])
def test_similar_classes_equal_all_pairs(spark, monkeypatch, tile, spare, heavy, cut):
    """Candidates held back in part, all of them, and none of them."""
    for name, value in (("TILE", tile), ("SPARE", spare), ("HEAVY_TILE", heavy), ("SLICE", cut)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(2000)]
    texts = []
    for base in (rng.choices(vocabulary, k=n) for n in (150, 400)):
        for _ in range(60):
            copy = list(base)
            for _ in range(rng.randint(0, round(0.04 * len(copy)))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += near_copies(8, n=30)
    rng.shuffle(texts)
    want = plain_classes(texts)
    assert 5 < len(set(want)) < len(texts) - 60
    got = simhash.classes(frame(spark, texts).repartition(3), radius=18, similarity=0.8).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == want


def test_large_group_mostly_below_the_similarity(spark):
    """2,000 texts around one passage: all of them candidates of each other, few near copies."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(2000)]
    shared, texts = rng.choices(vocabulary, k=90), []
    for i in range(2000):
        if i % 50 == 1:
            words = texts[-1].split(" ")
            words[rng.randrange(len(words))] = "edited"
        else:
            words = shared + rng.choices(vocabulary, k=40)
        texts.append(" ".join(words))
    sets, want = shingled(texts), list(range(len(texts)))
    for i in range(1, len(texts), 50):
        assert len(sets[i] & sets[i - 1]) >= 0.8 * len(sets[i] | sets[i - 1])
        want[i] = i - 1
    prints = simhash.with_both_fingerprints(frame(spark, texts).select(F.xxhash64("text").alias("row_key"), "text"))
    nodes = prints.select(F.col("p").alias("f"), "g", "n", F.col("row_key").alias("node"))
    assert simhash.candidates(nodes, 18, 0.8, 2000).where("b is null").count() > 1000
    got = simhash.classes(frame(spark, texts), radius=18, similarity=0.8).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == want


def appended(seed, words, low, high, pairs=40):
    """Texts of random words, each followed by itself with more words at its end."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(2000)]
    texts = []
    for _ in range(pairs):
        text = rng.choices(vocabulary, k=words)
        texts += [" ".join(text), " ".join(text + rng.choices(vocabulary, k=round(words * rng.uniform(low, high))))]
    return texts


def test_long_texts_are_judged_by_all_shingles(spark):
    texts = appended(4, 900, 0.22, 0.28)
    want = plain_classes(texts)
    assert 50 < len(set(want)) < 70
    kept = {r.doc_id for r in simhash.drop_near_copies(frame(spark, texts), radius=18, similarity=0.8).collect()}
    assert kept == set(want)


# ---- registered --------------------------------------------------------------------------------------


def test_registered_queries_and_columns(spark):
    names = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
    scored = queries.op1_toxicity(spark, SMALL)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert scored.where("score not between 0 and 1 or predicted <> cast(score >= 0.7 as int)").count() == 0
