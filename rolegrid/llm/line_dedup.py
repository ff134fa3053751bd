"""Line dedup with two Bloom filters: one for lines seen once, one for lines seen in a second document.

A line's key is the line with ASCII white space stripped at both ends and A-Z lowered; keys of fewer than
``min_chars`` code points are never judged. Each task fills both filters for its documents; merging two tasks sets
``twice |= twice' | (once & once')``, so a line of two documents is always in the second filter. Only lines the
second filter knows are written as suspects; the keys themselves are then counted exactly, by document.

Defined results: a null or empty text is one empty line (a null text stays null in ``dedup_lines`` when it loses
nothing); a key counts once per document however often it occurs there; every row is a document, repeated rows
too; an empty table gives an empty table. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolegrid.llm.common import free_name, map_batches, staged, texts

WHITE = b" \t\n\x0b\x0c\r"
#: Bits of the filters that travel as one row.
CHUNK_BITS = 1 << 20


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line, in order."""
    return [line.strip(WHITE) for line in text.lower().split(b"\n")]


def judged(text: bytes, min_chars: int) -> set[bytes]:
    """The distinct keys of a text that are long enough to be judged."""
    keys = set(line_keys(text))
    return {k for k in keys if len(k) >= min_chars and (min_chars <= 1 or len(k.decode()) >= min_chars)}


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two filter positions for each 64-bit hash; ``bits`` is a power of two."""
    mask = np.uint64(bits - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32)) & mask]).astype(np.int64)


class Filters:
    """Both filters of one task, as arrays of bytes with one bit per position."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    @staticmethod
    def known(filter_bytes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (filter_bytes[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0)

    @staticmethod
    def put(filter_bytes: np.ndarray, at: np.ndarray) -> None:
        np.bitwise_or.at(filter_bytes, (at >> 3).ravel(), (1 << (at & 7)).astype(np.uint8).ravel())

    def add(self, hashes: np.ndarray) -> None:
        """One entry per document and key."""
        distinct, count = np.unique(hashes, return_counts=True)
        at = positions(distinct, self.bits)
        again = self.known(self.once, at) | (count > 1)
        self.put(self.twice, at[:, again])
        self.put(self.once, at)


def filter_bits(docs: DataFrame, text: str, bits_per_line: int, max_bits: int) -> int:
    """Power of two of at least ``bits_per_line`` for each line of the table, at most ``max_bits``."""
    lines = docs.agg(F.sum(F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    return min(max_bits, max(1 << 16, 1 << int(max(1, lines * bits_per_line) - 1).bit_length()))


def repeat_filter(docs: DataFrame, text: str, min_chars: int, bits: int) -> np.ndarray:
    """The merged filter of keys that occur in two documents at least, ``bits / 8`` bytes."""
    chunk_bytes = min(CHUNK_BITS, bits) // 8

    def fill(batches):
        filters = Filters(bits)
        for batch in batches:
            found = [xxhash.xxh64_intdigest(k) for t in texts(batch.column(0)) for k in judged(t, min_chars)]
            if found:
                filters.add(np.array(found, np.uint64))
        once, twice = filters.once.reshape(-1, chunk_bytes), filters.twice.reshape(-1, chunk_bytes)
        for i in np.flatnonzero(once.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([once[i].tobytes()], pa.binary()), pa.array([twice[i].tobytes()], pa.binary())], ["chunk", "once", "twice"])

    def merge(batches):
        now, once, twice = None, None, None
        for batch in batches:
            for i, new_once, new_twice in zip(*(c.to_pylist() for c in batch.columns)):
                new_once, new_twice = np.frombuffer(new_once, np.uint8), np.frombuffer(new_twice, np.uint8)
                if i != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([twice.tobytes()], pa.binary())], ["chunk", "twice"])
                    now, once, twice = i, new_once.copy(), new_twice.copy()
                else:
                    twice |= new_twice | (once & new_once)
                    once |= new_once
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([twice.tobytes()], pa.binary())], ["chunk", "twice"])

    filled = docs.select(text).mapInArrow(fill, "chunk bigint, once binary, twice binary")
    chunks = filled.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk bigint, twice binary")
    out = np.zeros((bits // 8 // chunk_bytes, chunk_bytes), np.uint8)
    for row in chunks.toLocalIterator():
        out[row.chunk] = np.frombuffer(row.twice, np.uint8)
    return out.ravel()


def row_key(doc_id: str, text: str) -> list[Column]:
    """Identity of a row for joins: rows that share it have the same lines, so they get the same decisions."""
    return [F.xxhash64(F.col(doc_id)).alias("row_a"), F.xxhash64(F.col(text), F.length(F.col(text))).alias("row_b")]


def repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text", bits_per_line: int = 8, max_bits: int = 1 << 30) -> DataFrame:
    """Rows ``row_a, row_b, keys, own``: the keys found in ``min_docs`` documents at least that a document has.

    ``own`` are those of them whose first document (by id, then by text) this one is. The filter is at most
    ``max_bits / 8`` bytes; a fuller filter only makes more suspects, never another result.
    """
    bits = filter_bits(docs, text, bits_per_line, max_bits)
    known = docs.sparkSession.sparkContext.broadcast(repeat_filter(docs, text, min_chars, bits))

    def suspect(batch: pa.RecordBatch):
        keys, hashes, rows = [], [], []
        for row, value in enumerate(texts(batch.column(3))):
            for key in judged(value, min_chars):
                keys.append(key)
                hashes.append(xxhash.xxh64_intdigest(key))
                rows.append(row)
        hit = np.flatnonzero(Filters.known(known.value, positions(np.array(hashes, np.uint64), bits))) if keys else np.zeros(0, int)
        rows = pa.array(np.array(rows, np.int64)[hit] if keys else [], pa.int64())
        return [pa.array([keys[i] for i in hit.tolist()], pa.binary()), *(batch.column(c).take(rows) for c in range(3))]

    narrow = docs.select(F.col(doc_id).cast("string").alias("id"), *row_key(doc_id, text), F.col(text).alias("text"))
    suspects = staged(map_batches(narrow, suspect, "key binary, id string, row_a bigint, row_b bigint"), "suspect-lines")
    number = F.coalesce(F.col("id").try_cast("decimal(38,0)"), F.lit(0))
    first = F.min(F.struct(F.col("id").isNull(), number, F.col("id"), F.col("row_b"), F.col("row_a")))
    repeated = suspects.groupBy("key").agg(F.count("*").alias("n"), first.alias("first")).where(F.col("n") >= min_docs)
    # written first, so that the join below reads a table: Spark may broadcast it by its size, or split a hot key
    owners = staged(repeated.select("key", F.col("first.row_a").alias("first_a"), F.col("first.row_b").alias("first_b")), "repeated-lines")
    met = suspects.join(owners, "key").withColumn("own", (F.col("row_a") == F.col("first_a")) & (F.col("row_b") == F.col("first_b")))
    return met.groupBy("row_a", "row_b").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("own"), F.col("key"))).alias("own"))


def kept_lines(text: bytes, drop: set[bytes], own: set[bytes]) -> list[bytes]:
    """Lines that stay: those of a key to drop go, except the first one of a key that this document owns."""
    keep = []
    left = set(own)
    for line, key in zip(text.split(b"\n"), line_keys(text)):
        if key in left:
            left.discard(key)
            keep.append(line)
        elif key not in drop:
            keep.append(line)
    return keep


def with_lines_dropped(docs: DataFrame, count: str, keep: str = "none", doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the text after the dedup and a last column ``count``, the number of lines dropped."""
    if keep not in ("none", "first"):
        raise ValueError(keep)
    a, b, state = free_name(docs, "row_a"), free_name(docs, "row_b"), free_name(docs, "drop_lines")
    drops = repeated_lines(docs, doc_id=doc_id, text=text, **options)
    drops = drops.select(F.col("row_a").alias(a), F.col("row_b").alias(b), F.struct("keys", "own").alias(state))
    key_a, key_b = row_key(doc_id, text)
    joined = docs.withColumns({a: key_a, b: key_b}).join(drops, [a, b], "left").select(*docs.columns, state)
    at, to = joined.columns.index(text), joined.columns.index(state)

    def run(batches):
        for batch in batches:
            out, dropped = [], []
            for value, drop in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(to).to_pylist()):
                n = 0
                if drop is not None and value is not None:
                    lines = kept_lines(value, set(drop["keys"]), set(drop["own"]) if keep == "first" else set())
                    n = value.count(b"\n") + 1 - len(lines)
                    value = b"\n".join(lines)
                out.append(value)
                dropped.append(n)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(out, pa.binary()).cast(pa.string()))
            yield batch.set_column(to, pa.field(count, pa.int64()), pa.array(dropped, pa.int64()))

    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(count, T.LongType())]))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated lines gone from every document, or (``keep="first"``) from all but the first one.

    Columns, their order and the rows stay; only the text changes. Rows that agree in id and text share a decision.
    """
    count = free_name(docs, "n_dropped")
    return with_lines_dropped(docs, count, **options).drop(count)


def line_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: ``doc_id, n_lines, n_dropped, kept_sha256`` of what ``dedup_lines`` leaves."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("n_lines", F.coalesce(lines, F.lit(1)).cast("bigint"))
    out = with_lines_dropped(narrow, "n_dropped", **options)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
