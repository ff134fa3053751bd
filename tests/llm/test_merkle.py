"""The Merkle manifest against a plain recursive one."""

from hashlib import sha256
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolegrid.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, at):
    """Runs around the node, level by level: what lies left and right of it."""
    out = []
    for level in tree[:-1]:
        low = at - at % 3
        out.append((level[low:at], level[at + 1 : low + 3]))
        at //= 3
    return out


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = levels([leaf_of(r) for r in groups[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for g, s in enumerate(names):
        for i, row in enumerate(groups[s]):
            steps = path(trees[s], i) + path(top, g)
            text = row[4]
            if row[0] is not None and text is not None and crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = leaf_of((*row[:4], text))
            for left, right in steps:
                now = h([*left, now, *right])
            root = top[-1][0]
            out.append((row[0], leaf_of(row), trees[s][-1][0], root, h(x for a, b in steps for x in (*a, *b)), now, now == root))
    return sorted(out, key=str)


def check(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("kept") for c in ("grp", "place", "block", "key", "nodes", "digest", "again")})
    found = sorted((tuple(r) for r in merkle.proof_table(table).collect()), key=str)
    assert found == plain(rows)
    return found


def test_table_equals_plain_trees(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "en", i, f"line {i}\nend" if i % 4 else "no break") for i in range(400)]
    found = check(spark, rows)
    assert {r[6] for r in found} == {True, False}


def test_odd_rows(spark):
    rows = [
        (1, None, None, None, None), (2, "", "", 0, ""), (None, "é", "fr", 3, "a\nb"), (None, "é", "fr", 3, "a\nb"), (3, "Z", "en", 1, "x"), (3, "Z", "en", 1, "x"),
        (3, "Z", "en", 2, "\n" * 500_000), (4, "\U0001f600", "en", 1, "one long line " * 100_000), (-5, "z", "de", 1, "ß\n"),
    ]
    check(spark, rows)


@pytest.mark.parametrize("n", [0, 1, 3, 4])
def test_few_rows(spark, n):
    check(spark, [(i, "a", "en", i, "x\n") for i in range(n)])


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 200))
def test_appender_equals_plain_tree(n):
    nodes = [h([str(i)]) for i in range(n)]
    tree = merkle.Appender()
    for d in nodes:
        tree.append(bytes.fromhex(d))
    whole = levels(nodes)
    assert tree.finish(None).hex() == whole[-1][0]
    for i in range(n):
        assert tree.witness[i].hex() == "".join(x for a, b in path(whole, i) for x in (*a, *b))
        assert merkle.fold(bytes.fromhex(nodes[i]), bytes(tree.witness[i]), [(i, n)]).hex() == whole[-1][0]


def test_witness_grows_with_each_completed_run():
    tree = merkle.Appender()
    sizes = []
    for i in range(9):
        tree.append(bytes([i]) * 32)
        sizes.append(len(tree.witness[0]))
    assert sizes == [0, 0, 64, 64, 64, 64, 64, 64, 128]
