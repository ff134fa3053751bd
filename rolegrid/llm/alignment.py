"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Tokenizer A is a byte-level BPE (its json file), B a sentencepiece model. A reads a space and the text, B the text, before which it
puts a space itself; both then cover the same bytes. The incidence of tokens and bytes of each side is a matrix in
compressed rows (``Csr``). The rows of A times the transposed matrix of B, by Gustavson's row products, give the bytes that each
pair of tokens shares: its entries are the overlap links. Byte offsets where tokens of both sides end cut the tokens into
groups; the product of the incidences with groups gives the shared-group links. Long texts are multiplied in blocks of
whole groups, so that memory is bounded by ``BLOCK_BYTES`` and the longest group.

A link is weighed by its pair of ids: in how many documents of the corpus the pair is linked, and whether no pair of the same A
id is in more. Pairs are counted within batches of documents first, then by an aggregate that combines before its shuffle. The table of
pairs meets the documents in an equi join; Spark broadcasts it only if it has ``SMALL_TABLE`` rows at most, otherwise pairs in
many documents are salted.

Defined results: null and empty texts, and texts whose tokens do not spell the bytes of space and text (for example those with
U+2581), have no tokens, zero counts and no groups. Each of several equal rows is a document. An empty table
gives an empty table.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from hashlib import sha256
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.common import map_batches, shared, staged
from rolegrid.operators.skew import heavy_keys, salted_join

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are multiplied at once.
BLOCK_BYTES = 1 << 20
#: Pairs of ids (20 bytes each) up to which their table may be broadcast.
SMALL_TABLE = 1_000_000


class Csr(NamedTuple):
    """A sparse matrix in compressed rows: the columns of row i are ``columns[starts[i]:starts[i + 1]]``, its entries beside."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int


def incidence(starts: np.ndarray, stops: np.ndarray, width: int) -> Csr:
    """Rows are ranges of columns: row i holds ones from ``starts[i]`` to ``stops[i]``."""
    sizes = stops - starts
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    columns = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - starts, sizes)
    return Csr(bounds, columns, np.ones(bounds[-1], np.int64), width)


def transposed(m: Csr) -> Csr:
    """Counting sort of the entries by column."""
    order = np.argsort(m.columns, kind="stable")
    rows = np.repeat(np.arange(len(m.starts) - 1), np.diff(m.starts))
    starts = np.concatenate([[0], np.cumsum(np.bincount(m.columns, minlength=m.width))])
    return Csr(starts, rows[order], m.values[order], len(m.starts) - 1)


def row_products(a: Csr, b: Csr) -> Csr:
    """``a`` times ``b`` by Gustavson's method: each entry (i, k) of ``a`` scales row k of ``b``, and the scaled rows of one i are
    added up. All rows of ``a`` go at once; the accumulator is a sort by (row, column), skipped where entries come in order."""
    sizes = b.starts[a.columns + 1] - b.starts[a.columns]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) - np.repeat(ends - sizes - b.starts[a.columns], sizes)
    rows = np.repeat(np.repeat(np.arange(len(a.starts) - 1), np.diff(a.starts)), sizes)
    columns, values = b.columns[at], np.repeat(a.values, sizes) * b.values[at]
    keys = rows * b.width + columns
    if total and (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys, rows, columns, values = keys[order], rows[order], columns[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if total else np.empty(0, np.int64)
    added = np.add.reduceat(values, first) if total else values
    starts = np.searchsorted(rows[first], np.arange(len(a.starts)))
    return Csr(starts, columns[first], added, b.width)


def pairs_of(m: Csr) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each entry."""
    return np.repeat(np.arange(len(m.starts) - 1), np.diff(m.starts)), m.columns


def byte_decoder() -> dict[str, int]:
    """The character that stands for each byte in the entries of a byte-level vocabulary: itself if it is printable Latin-1, else
    the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


#: Fixed value: the pattern that cuts a text before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizers:
    """Both tokenizers, made from the contents of their files, and the bytes of their tokens."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        import sentencepiece
        import tiktoken

        model = json.loads(byte_bpe)
        decode = byte_decoder()
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(decode[c] for c in entry): i for entry, i in model["model"]["vocab"].items() if entry not in special}
        merged = [ranks[b"".join(bytes(decode[c] for c in part) for part in (m.split(" ") if isinstance(m, str) else m))] for m in model["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids of the byte-level vocabulary do not follow its merges")
        self.a = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for entry, i in ranks.items():
            self.a_bytes[i] = entry
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # decimal ids, with a comma and with the mark that ends a side of a group
        self.a_names, self.b_names = (np.array([b"%d%s" % (i, m) for m in (b",", end) for i in range(len(t))], object) for t, end in ((self.a_bytes, b"|"), (self.b_bytes, b";")))

    def tokens(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and B; none if they do not spell the text."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not text:
            return none
        try:
            plain = text.decode()
        except UnicodeDecodeError:
            return none
        a, b = self.a.encode_ordinary(" " + plain), self.b.encode(plain)
        whole = b" " + text
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return none
        return np.array(a, np.int64), np.array(b, np.int64)


class Alignment:
    """The tokens of some texts, one after the other: ids, ends in bytes, groups; ``of`` gives the text of a group."""

    def __init__(self, tokens: list[tuple[np.ndarray, np.ndarray]], tools: Tokenizers):
        self.tools, a_sizes = tools, tools.a_sizes
        self.a, self.b = (np.concatenate([t[side] for t in tokens] or [np.empty(0, np.int64)]) for side in (0, 1))
        self.a_ends, self.b_ends = np.cumsum(a_sizes[self.a]), np.cumsum(tools.b_sizes[self.b])
        self.cuts = np.intersect1d(self.a_ends, self.b_ends, assume_unique=True)
        self.a_group, self.b_group = (np.searchsorted(self.cuts, ends) for ends in (self.a_ends, self.b_ends))
        lengths = np.array([a_sizes[a].sum() for a, _ in tokens], np.int64)
        self.text_ends = np.cumsum(lengths)
        self.of = np.searchsorted(self.text_ends, self.cuts)
        self.a_text, self.b_text = self.of[self.a_group], self.of[self.b_group]

    def blocks(self) -> Iterator[tuple[slice, slice, slice]]:
        """Groups of about ``BLOCK_BYTES`` bytes, with their tokens of both sides."""
        low, n = 0, len(self.cuts)
        while low < n:
            start = self.cuts[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(self.cuts, start + BLOCK_BYTES, side="right")))
            sides = (slice(*np.searchsorted(g, [low, high]).tolist()) for g in (self.a_group, self.b_group))
            yield slice(low, high), *sides
            low = high

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Overlap links, block by block: tokens of A, tokens of B, shared bytes."""
        for groups, a, b in self.blocks():
            start, width = (self.cuts[groups.start - 1] if groups.start else 0), self.cuts[groups.stop - 1]
            sides = []
            for ends, part in ((self.a_ends, a), (self.b_ends, b)):
                stops = ends[part] - start
                sides.append(incidence(np.concatenate([[0], stops[:-1]]), stops, int(width - start)))
            links = row_products(sides[0], transposed(sides[1]))
            i, j = pairs_of(links)
            yield a.start + i, b.start + j, links.values

    def group_sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.bincount(g, minlength=len(self.cuts)) for g in (self.a_group, self.b_group))

    def shared(self, rows: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Shared-group links, ``rows`` tokens of A at a time: tokens of A and of B of one group."""
        b = transposed(incidence(self.b_group, self.b_group + 1, len(self.cuts)))
        for low in range(0, len(self.a), rows):
            part = self.a_group[low : low + rows]
            i, j = pairs_of(row_products(incidence(part, part + 1, len(self.cuts)), b))
            yield low + i, j

    def spelled(self) -> list[bytes]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``, decimal ids in order."""
        n_a, n_b = self.group_sizes()
        before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        out = np.empty(len(self.a) + len(self.b), object)
        for ids, group, before, names in ((self.a, self.a_group, before_b, self.tools.a_names), (self.b, self.b_group, before_a + n_a, self.tools.b_names)):
            last = np.diff(group, append=-1) != 0
            out[np.arange(len(ids)) + before[group]] = names[ids + last * (len(names) // 2)]
        tokens = sum(np.bincount(t, minlength=len(self.text_ends)) for t in (self.a_text, self.b_text))
        return [b"".join(out[high - n : high])[:-1] for high, n in zip(np.cumsum(tokens).tolist(), tokens.tolist())]


ID_SHIFT = 32
ROW = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_shared bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


def aligned_texts(batch: list[bytes], tools: Tokenizers) -> list[tuple]:
    """The columns of ``ROW`` for each text; ``pairs`` are its distinct linked pairs of ids, ``times`` how many links each has."""
    out, low = [], 0
    while low < len(batch):
        high, size = low, 0
        while high < len(batch) and (high == low or size + len(batch[high]) <= BLOCK_BYTES):
            size += len(batch[high])
            high += 1
        tokens = [tools.tokens(t) for t in batch[low:high]]
        whole = Alignment(tokens, tools)
        texts, keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, j, _ in whole.overlaps():
            # pairs of a text are told apart from those of the texts before by the text's number
            name = (whole.a[i] << 20) | whole.b[j]
            key, n = np.unique((whole.a_text[i] << 40) | name, return_counts=True)
            texts.append(key >> 40)
            keys.append(key & ((1 << 40) - 1))
            counts.append(n)
        text, key, count = np.concatenate(texts), np.concatenate(keys), np.concatenate(counts)
        if len(keys) > 2:  # a text in several blocks
            joint, at = np.unique((text << 40) | key, return_inverse=True)
            text, key, count = joint >> 40, joint & ((1 << 40) - 1), np.bincount(at, weights=count).astype(np.int64)
        key = ((key >> 20) << ID_SHIFT) | (key & ((1 << 20) - 1))
        n_a, n_b = whole.group_sizes()
        sums = lambda at, w=None: np.bincount(at, weights=w, minlength=high - low).astype(np.int64)  # noqa: B023, E731
        numbers = sums(whole.a_text), sums(whole.b_text), sums(whole.of), sums(text, count), sums(whole.of, n_a * n_b)
        bounds = np.searchsorted(text, np.arange(high - low + 1))
        for k, groups in enumerate(whole.spelled()):
            mine = slice(bounds[k], bounds[k + 1])
            out.append((*(int(n[k]) for n in numbers), sha256(groups).hexdigest() if groups else "", key[mine], count[mine].astype(np.int32)))
        low = high
    return out


def read_files(folder: str = FOLDER, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> tuple[bytes, bytes]:
    """The vocabulary files; the driver reads them and they travel to the tasks."""
    return tuple(Path(folder, f).read_bytes() for f in (byte_bpe, piece_bpe))


def aligned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """``doc_id`` and the columns of ``ROW`` for each row of ``docs``, written to the shared folder."""
    files, made = shared(docs.sparkSession, read_files(folder)), []

    def run(batch: pa.RecordBatch):
        if not made:
            made.append(Tokenizers(*pickle.loads(files.value)))
        rows = aligned_texts([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()], made[0])
        columns = list(zip(*rows)) or [()] * 8
        return [batch.column(0), *(list(c) for c in columns)]

    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return staged(map_batches(narrow, run, f"doc_id bigint, {ROW}"), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, n, best``: in how many documents a pair of ids is linked, and whether no pair of its A id is in more."""
    counts = staged(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    most = counts.groupBy(F.shiftright("pair", ID_SHIFT).alias("a")).agg(F.max("n").alias("most"))
    joined = counts.join(most, F.shiftright("pair", ID_SHIFT) == F.col("a"))
    return staged(joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair_counts")


def alignment(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256``."""
    rows = aligned(docs, doc_id, text, folder)
    counts = pair_counts(rows)
    # a row of the written table is known by its file and place there
    place = [F.xxhash64("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]
    links = rows.select(*place, F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("file", "row", "link.pairs", "link.times")
    links = links.withColumnRenamed("pairs", "pair")
    if counts.count() <= SMALL_TABLE:
        met = links.join(F.broadcast(counts), "pair")
    else:
        met = salted_join(links, counts, "pair", "inner", heavy_keys(counts, "pair"), "row")
    weighed = met.groupBy("file", "row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    plain = rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", *place)
    joined = plain.join(weighed, ["file", "row"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", zero("n_best"), zero("count_sum"), "groups_sha256")


def links_of(text: str, tools: Tokenizers) -> dict[str, list]:
    """Everything about one text: ids, groups, overlap links with shared bytes, shared-group links, by token positions."""
    whole = Alignment([tools.tokens(text.encode())], tools)
    overlap = [(int(x), int(y), int(n)) for i, j, v in whole.overlaps() for x, y, n in zip(i, j, v)]
    shared_links = [(int(x), int(y)) for i, j in whole.shared() for x, y in zip(i, j)]
    return {"a": whole.a.tolist(), "b": whole.b.tolist(), "a_group": whole.a_group.tolist(), "b_group": whole.b_group.tolist(), "overlap": overlap, "shared": shared_links}

