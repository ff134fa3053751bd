"""Cross-tokenizer alignment against plain loops over bytes, with the tokenizers' own libraries."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolegrid.llm import alignment

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")

LONG = "Das ist ein sehr langer Satz, and this is another one. " * 40_000
ROWS = [
    (1, "The quick brown fox"), (2, "The quick brown fox"), (2, "The quick brown fox"), (3, None), (4, ""), (5, " \n\t  x"), (6, "▁ not spelled"), (7, "naïve \U0001f600 日本語 ½"),
    (None, "un petit café"), (8, "<s> </s> <|endoftext|> <0x41>"), (9, LONG), (10, "a" * 50_000), (11, "\0"), (12, "l'été, l'hiver; don't!!\r\n\r\n"), (13, "x"),
]


@pytest.fixture(scope="module")
def tools():
    return alignment.Tokenizers(*alignment.read_files())


@pytest.fixture(scope="module")
def plain_tools():
    a = tokenizers.Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.BYTE_BPE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.PIECE_BPE}")
    decode = alignment.byte_decoder()
    names = {i: bytes(decode[c] for c in t) for t, i in a.get_vocab().items() if not t.startswith("<|")}
    return a, b, names


def plain_tokens(plain_tools, text):
    a, b, names = plain_tools
    if not text:
        return [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spell_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    spell_a = [names[i] for i in ids_a]
    whole = b" " + text.encode()
    if b"".join(spell_a) != whole or b"".join(spell_b) != whole:
        return [], []
    return list(zip(ids_a, map(len, spell_a))), list(zip(ids_b, map(len, spell_b)))


def plain_links(a, b):
    """Ends of both sides, overlapping pairs of positions, groups."""
    spans = []
    for side in (a, b):
        at, out = 0, []
        for _, n in side:
            out.append((at, at + n))
            at += n
        spans.append(out)
    links, j = [], 0
    for i, (low, high) in enumerate(spans[0]):
        while spans[1][j][1] <= low:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < high:
            links.append((i, k, min(high, spans[1][k][1]) - max(low, spans[1][k][0])))
            k += 1
    cuts = sorted({h for _, h in spans[0]} & {h for _, h in spans[1]})
    groups = [[sum(h > c for c in cuts) for h in ()] for _ in cuts]
    groups, ends = [([], []) for _ in cuts], {c: g for g, c in enumerate(cuts)}
    for side in (0, 1):
        g = 0
        for t, (_, high) in enumerate(spans[side]):
            groups[g][side].append(t)
            g += high in ends
    return links, groups


def plain(plain_tools, rows):
    tokens = [plain_tokens(plain_tools, t) for _, t in rows]
    found = [plain_links(a, b) for a, b in tokens]
    count = Counter()
    for (a, b), (links, _) in zip(tokens, found):
        count.update({(a[i][0], b[j][0]) for i, j, _ in links})
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (doc_id, _), (a, b), (links, groups) in zip(rows, tokens, found):
        ids = [(a[i][0], b[j][0]) for i, j, _ in links]
        spelled = ";".join(",".join(str(a[i][0]) for i in x) + "|" + ",".join(str(b[j][0]) for j in y) for x, y in groups)
        shared = sum(len(x) * len(y) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), shared, sum(count[p] == best[p[0]] for p in ids), sum(count[p] for p in ids), sha256(spelled.encode()).hexdigest() if spelled else ""))
    return sorted(out, key=str)


def run(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("kept") for c in ("pair", "n", "best", "file", "row", "pairs", "times", "N_A")})
    return sorted((tuple(r) for r in alignment.alignment(table).collect()), key=str)


@pytest.mark.parametrize("small", [10**6, 0])
def test_equals_plain_loops(spark, plain_tools, monkeypatch, small):
    """With the table of pairs broadcast and joined by shuffle; long texts go in several blocks."""
    monkeypatch.setattr(alignment, "SMALL_TABLE", small)
    assert run(spark, ROWS) == plain(plain_tools, ROWS)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_blocks_do_not_change_links(tools, monkeypatch):
    batch = [(t or "").encode() for _, t in ROWS if t is not LONG] + [LONG[:3000].encode()]
    plainly = lambda rows: [(*r[:6], r[6].tolist(), r[7].tolist()) for r in rows]
    whole = plainly(alignment.aligned_texts(batch, tools))
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 64)
    assert plainly(alignment.aligned_texts(batch, tools)) == whole


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_links_of_any_text(tools, plain_tools, text):
    a, b = plain_tokens(plain_tools, text)
    links, groups = plain_links(a, b)
    found = alignment.links_of(text, tools)
    assert found["a"] == [i for i, _ in a] and found["b"] == [i for i, _ in b]
    assert found["overlap"] == links
    assert found["shared"] == sorted((i, j) for x, y in groups for i in x for j in y)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 6), st.integers(1, 6), st.integers(1, 6), st.randoms(use_true_random=False))
def test_row_products_equal_dense(n, k, m, random):
    dense = [np.array([[random.randrange(3) * (random.random() < 0.5) for _ in range(w)] for _ in range(h)], np.int64).reshape(h, w) for h, w in ((n, k), (k, m))]

    def sparse(x):
        rows, columns = np.nonzero(x)
        return alignment.Csr(np.searchsorted(rows, np.arange(len(x) + 1)), columns, x[rows, columns], x.shape[1])

    found = alignment.row_products(*map(sparse, dense))
    out = np.zeros((n, m), np.int64)
    out[alignment.pairs_of(found)] = found.values
    assert (out == dense[0] @ dense[1]).all()
    back = alignment.transposed(sparse(dense[1]))
    flat = np.zeros((m, k), np.int64)
    flat[alignment.pairs_of(back)] = back.values
    assert (flat == dense[1].T).all()
