"""Exact substring dedup: bytes covered by a string of ``length`` bytes that also starts earlier.

Prefix doubling on sampled positions. Every window of ``length`` bytes has one anchor: the leftmost of its positions
whose 8 bytes have the smallest hash, so equal windows have their anchor at the same place. Ranks are names: equal
strings of a length have equal names.

1. The strings of ``GRAM`` bytes at all anchors are named and sorted by Spark; a name that occurs once drops out,
   with all windows of its anchor.
2. Windows of the other anchors go on, as the bytes around their anchor, dealt by the anchor's name. There, names of
   8, 16, 32, 64 ... bytes are made of pairs of names at doubling offsets, up to the last power of two below
   ``length``; unique ones drop out; the rest are named by the pair that spans ``length`` and sorted by document and
   start. All but the first of a name are repeats.
3. The covered bytes of each document are joined to its text.

Copies within one batch are settled there: of equal surroundings only the first travels, the others are repeats
whatever the rest of the table holds. So a passage in a third of all documents costs one row for each batch.

Names are 64-bit hashes; windows are compared only under equal anchor names and offsets. Earlier is the smaller id,
then the earlier start. Defined results: a null text is empty; a null id comes first; rows that agree in id and text
are one document and share a result, rows of one id with different texts are ordered by a hash of their text;
matches never cross documents; an empty table gives an empty table. Other columns pass through.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolegrid.llm.common import free_name, map_batches, texts

GRAM = 32
#: Bytes of text handled at once, and bytes of text for each bucket of names.
PIECE, BUCKET_BYTES = 1 << 19, 2 << 20
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of the pair of two names."""
    with np.errstate(over="ignore"):
        x = (a * MIX[0] ^ (a >> np.uint64(29))) * MIX[1] + b
        x = (x ^ (x >> np.uint64(32))) * MIX[2]
        return x ^ (x >> np.uint64(31))


def words(buffer: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position of a padded buffer as one number: the names of that length."""
    return np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each run of ``width``."""
    span = 1
    while 2 * span <= width:
        keys = np.minimum(keys[: len(keys) - span], keys[span:])
        span *= 2
    rest = width - span
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


class Batch:
    """Texts in one padded buffer, and the anchors of all their windows."""

    def __init__(self, values: list[bytes], length: int):
        self.buffer = np.frombuffer(b"".join([*values, bytes(2 * length + GRAM)]), np.uint8)
        sizes = np.array([len(v) for v in values], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.length = length
        parts = [self._anchors(low, high) for low, high in self._pieces()]
        self.anchor, self.first, self.count, self.doc = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else [()] * 4))
        at = words(self.buffer)
        self.name = at[self.anchor]
        for step in range(8, GRAM, 8):
            self.name = pair(self.name, at[self.anchor + step])

    def _pieces(self):
        """Ranges of documents of about ``PIECE`` bytes; a longer document is alone."""
        low = 0
        while low < len(self.ends):
            high = max(low + 1, int(np.searchsorted(self.ends, self.starts[low] + PIECE, "right")))
            yield low, high
            low = high

    def _anchors(self, low: int, high: int):
        found = []
        begin, end = int(self.starts[low]), int(self.ends[high - 1])
        width = self.length - GRAM + 1
        for at in range(begin, end, 2 * PIECE):
            stop = min(at + 2 * PIECE, end)
            with np.errstate(over="ignore"):
                order = words(self.buffer[at : stop + width + 8]) * MIX[0]
            order = (order >> np.uint64(32) << np.uint64(32)) | np.arange(len(order), dtype=np.uint64)
            found.append((sliding_least(order, width)[: stop - at] & np.uint64(0xFFFFFFFF)).astype(np.int64) + at)
        anchors = np.concatenate(found) if found else np.zeros(0, np.int64)
        counts = np.maximum(self.ends[low:high] - self.starts[low:high] - self.length + 1, 0)
        doc = np.repeat(np.arange(low, high), counts)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = self.starts[doc] + within
        anchor = anchors[start - begin]
        new = np.ones(len(doc), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        heads = np.flatnonzero(new)
        return anchor[heads], start[heads], np.diff(np.append(heads, len(doc))), doc[heads]


def _dealt(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the entries by bucket, and where each bucket starts and the last ends."""
    bucket = (names % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _by_bucket(batches, finish):
    """Call ``finish(rows)`` for each run of equal first columns; rows are tuples of the other columns."""
    now, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now and rows:
                yield from finish(rows)
                rows = []
            now = bucket
            rows.append(row)
    if rows:
        yield from finish(rows)


def repeated_names(keyed: DataFrame, length: int, buckets: int) -> DataFrame:
    """``key, names``: for each document, names of its anchors that occur at least twice (packed; several rows)."""

    def deal(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            group = Batch(texts(batch.column(1)), length)
            doc = keys[group.doc]
            names, first, count = np.unique(group.name, return_index=True, return_counts=True)
            at = np.searchsorted(names, group.name)
            here = count[at] > 1
            yield from _packed(doc[here], group.name[here])
            order, bounds = _dealt(names, buckets)
            filled = np.flatnonzero(np.diff(bounds))
            owner = doc[first[order]] if len(order) else doc
            names = names[order]
            yield _arrow(DEALT, filled, [None] * len(filled), [names[bounds[b] : bounds[b + 1]].tobytes() for b in filled], [owner[bounds[b] : bounds[b + 1]].tobytes() for b in filled])

    def settle(rows):
        done = [(key, names) for key, names, owners in rows if key is not None]
        if done:
            yield _arrow(NAMED, *zip(*done))
        names = np.concatenate([np.frombuffer(n, np.uint64) for k, n, _ in rows if k is None] or [np.zeros(0, np.uint64)])
        owners = np.concatenate([np.frombuffer(o, np.int64) for k, _, o in rows if k is None] or [np.zeros(0, np.int64)])
        order = np.argsort(names, kind="stable")
        names, owners = names[order], owners[order]
        same = names[1:] == names[:-1]
        many = np.zeros(len(names), bool)
        many[1:] |= same
        many[:-1] |= same
        order = np.argsort(owners[many], kind="stable")
        names, owners = names[many][order], owners[many][order]
        heads = np.flatnonzero(np.append(True, owners[1:] != owners[:-1])) if len(owners) else np.zeros(0, int)
        if len(heads):
            bounds = np.append(heads, len(owners))
            yield _arrow(NAMED, owners[heads], [names[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])])

    def _packed(doc, names):
        order = np.argsort(doc, kind="stable")
        doc, names = doc[order], names[order]
        heads = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, int)
        if len(heads):
            bounds = np.append(heads, len(doc))
            # settled already: they go along in buckets of their own, spread by document
            yield _arrow(DEALT, [-1 - int(d) % buckets for d in doc[heads]], doc[heads], [np.unique(names[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])], [None] * len(heads))

    dealt = keyed.select("key", "text").mapInArrow(deal, "bucket int, key bigint, names binary, owners binary")
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(lambda batches: _by_bucket(batches, settle), "key bigint, names binary")


DEALT = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("names", pa.binary()), ("owners", pa.binary())])
NAMED = pa.schema([("key", pa.int64()), ("names", pa.binary())])
AROUND = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
RUNS = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("runs", pa.binary())])
#: What travels with the bytes around an anchor.
ENTRY = np.dtype([("name", "<u8"), ("id", "<i8"), ("key", "<i8"), ("start", "<i8"), ("offset", "<i4"), ("count", "<i4"), ("size", "<i4")])
RUN = np.dtype([("id", "<i8"), ("key", "<i8"), ("start", "<i8"), ("stop", "<i8")])


def _arrow(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c) if not isinstance(c, np.ndarray) else c.astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(columns, schema)], schema=schema)


def _by_document(runs: np.ndarray):
    """Runs as rows of a document each."""
    if len(runs):
        runs = runs[np.lexsort((runs["start"], runs["id"], runs["key"]))]
        heads = np.flatnonzero(np.append(True, (runs["key"][1:] != runs["key"][:-1]) | (runs["id"][1:] != runs["id"][:-1])))
        bounds = np.append(heads, len(runs))
        spans = np.stack([runs["start"], runs["stop"]], axis=1)
        yield _arrow(RUNS, runs["id"][heads], runs["key"][heads], [spans[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])])


def later_windows(entries: np.ndarray, around: np.ndarray, length: int) -> np.ndarray:
    """Runs of bytes covered by windows that start earlier too; entries come in order of document and start."""
    sizes = entries["size"].astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    counts = entries["count"].astype(np.int64)
    of = np.repeat(np.arange(len(entries)), counts)
    within = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begin[of] + within
    step, name = 8, words(around)
    while 2 * step <= length:
        name = pair(name[: len(name) - step], name[step:])
        step *= 2
    key = pair(entries["name"][of], (entries["offset"][of] - within).astype(np.uint64))
    key = pair(key, name[at])
    _, group, count = np.unique(key, return_inverse=True, return_counts=True)
    left = np.flatnonzero(count[group] > 1)
    key = pair(key[left], name[at[left] + length - step]) if step < length else key[left]
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(left), bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    hit = left[later]
    if not len(hit):
        return np.zeros(0, RUN)
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(hit)) - 1
    runs = np.zeros(len(heads), RUN)
    entry = of[hit[heads]]
    runs["id"], runs["key"] = entries["id"][entry], entries["key"][entry]
    runs["start"] = entries["start"][entry] + within[hit[heads]]
    runs["stop"] = entries["start"][entry] + within[hit[tails]] + length
    return runs


def repeated_runs(candidates: DataFrame, length: int, buckets: int) -> DataFrame:
    """``id, key, runs`` (packed pairs of start and stop; several rows a document) from ``id, key, text, names``."""

    def deal(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, keys = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(), batch.column(1).to_numpy()
            values = texts(batch.column(2))
            group = Batch(values, length)
            known = [np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in names])) for names in batch.column(3).to_pylist()]
            bounds = np.searchsorted(group.doc, np.arange(len(values) + 1))
            live = np.concatenate([np.isin(group.name[a:b], k, assume_unique=False) for a, b, k in zip(bounds[:-1], bounds[1:], known)] or [np.zeros(0, bool)])
            pick = np.flatnonzero(live)
            doc = group.doc[pick]
            pick = pick[np.lexsort((group.first[pick], keys[doc], ids[doc]))]
            doc = group.doc[pick]
            entries = np.zeros(len(pick), ENTRY)
            entries["name"], entries["id"], entries["key"] = group.name[pick], ids[doc], keys[doc]
            entries["start"] = group.first[pick] - group.starts[doc]
            entries["offset"], entries["count"] = group.anchor[pick] - group.first[pick], group.count[pick]
            entries["size"] = entries["count"] + length - 1
            whole = group.buffer.tobytes()
            around = [whole[a : a + n] for a, n in zip(group.first[pick].tolist(), entries["size"].tolist())]
            seen: set[tuple[bytes, int]] = set()
            fresh = np.zeros(len(pick), bool)
            for i, (text, offset) in enumerate(zip(around, entries["offset"].tolist())):
                mark = xxhash.xxh128_digest(text), offset
                if mark not in seen:
                    seen.add(mark)
                    fresh[i] = True
            stale = entries[~fresh]
            if len(stale):
                runs = np.zeros(len(stale), RUN)
                runs["id"], runs["key"], runs["start"], runs["stop"] = stale["id"], stale["key"], stale["start"], stale["start"] + stale["size"]
                spread = runs[np.argsort(runs["key"] % buckets, kind="stable")]
                cuts = np.searchsorted(spread["key"] % buckets, np.arange(buckets + 1))
                filled = np.flatnonzero(np.diff(cuts))
                yield _arrow(AROUND, filled, [0] * len(filled), [spread[cuts[b] : cuts[b + 1]].tobytes() for b in filled], [None] * len(filled))
            entries, around = entries[fresh], [a for a, f in zip(around, fresh.tolist()) if f]
            order, cuts = _dealt(entries["name"], buckets)
            entries, around = entries[order], [around[i] for i in order.tolist()]
            filled = np.flatnonzero(np.diff(cuts))
            yield _arrow(AROUND, filled, [1] * len(filled), [entries[cuts[b] : cuts[b + 1]].tobytes() for b in filled], [pack.compress(b"".join(around[cuts[b] : cuts[b + 1]])) for b in filled])

    def settle(rows):
        entries = np.concatenate([np.frombuffer(a, ENTRY) for kind, a, _ in rows if kind == 1] or [np.zeros(0, ENTRY)])
        unpack = zstandard.ZstdDecompressor()
        around = np.frombuffer(b"".join([unpack.decompress(b) for kind, _, b in rows if kind == 1] + [bytes(length + 8)]), np.uint8)
        sizes = entries["size"].astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        order = np.lexsort((entries["start"], entries["key"], entries["id"]))
        take = np.repeat(begin[order] - (np.cumsum(sizes[order]) - sizes[order]), sizes[order]) + np.arange(sizes.sum())
        around = np.concatenate([around[take], np.zeros(length + 8, np.uint8)])
        runs = [np.frombuffer(a, RUN) for kind, a, _ in rows if kind == 0]
        yield from _by_document(np.concatenate([*runs, later_windows(entries[order], around, length)]))

    dealt = candidates.select("id", "key", "text", "names").mapInArrow(deal, "bucket int, kind int, a binary, b binary")
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(lambda batches: _by_bucket(batches, settle), "id bigint, key bigint, runs binary")


def merged(packed: list[bytes] | None) -> np.ndarray:
    """Maximal runs, as rows of start and stop."""
    if not packed:
        return np.zeros((0, 2), np.int64)
    spans = np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 2) for p in packed])
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    heads = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[heads, 0], reach[np.append(heads[1:], len(spans)) - 1]], axis=1)


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("bigint"), F.col(text), F.length(F.col(text)))


def _joined(keyed: DataFrame, docs: DataFrame, id_of: Column, key: str, name: str, length: int) -> DataFrame:
    """``docs`` (which have the column ``key``) with the packed runs of ``keyed`` in a last column ``name``."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, math.ceil(size / BUCKET_BYTES))
    names = repeated_names(keyed, length, buckets).groupBy("key").agg(F.collect_list("names").alias("names"))
    runs = repeated_runs(keyed.join(names, "key"), length, buckets).groupBy("key").agg(F.collect_list(F.struct("id", "runs")).alias(name))
    joined = docs.join(runs.withColumnRenamed("key", key), key, "left")
    mine = F.filter(name, lambda r: r["id"] == F.coalesce(id_of, F.lit(int(np.iinfo(np.int64).min)).cast("bigint")))
    return joined.withColumn(name, F.transform(mine, lambda r: r["runs"])).select(*docs.columns, name)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("id"), row_key(doc_id, text).alias("key"), F.col(text).alias("text"))


def with_runs(docs: DataFrame, name: str, length: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a last column ``name``: packed runs of bytes that repeat earlier ones (see ``merged``)."""
    key = free_name(docs, "run_key")
    out = _joined(_keyed(docs, doc_id, text), docs.withColumn(key, row_key(doc_id, text)), F.col(doc_id).cast("bigint"), key, name, length)
    return out.drop(key)


def without_repeats(docs: DataFrame, kept: str = "kept", text: str = "text", **options) -> DataFrame:
    """``docs`` with a last column ``kept``: struct of ``bytes`` (what is left; cuts may fall inside characters),
    ``spans`` (start and stop of the removed runs)."""
    runs = free_name(docs, "runs")
    joined = with_runs(docs, runs, text=text, **options)
    at, to = joined.columns.index(text), joined.columns.index(runs)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    kind = T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("spans", T.ArrayType(span))])
    arrow = pa.struct([("bytes", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    def run(batch: pa.RecordBatch):
        rows = []
        for value, packed in zip(texts(batch.column(at)), batch.column(to).to_pylist()):
            spans = merged(packed).tolist()
            edges = [0, *(x for s in spans for x in s), len(value)]
            rows.append({"bytes": b"".join(value[a:b] for a, b in zip(edges[::2], edges[1::2])), "spans": [{"start": a, "stop": b} for a, b in spans]})
        columns = [c for i, c in enumerate(batch.columns) if i != to]
        return [*columns, pa.array(rows, arrow)]

    return map_batches(joined, run, T.StructType([*docs.schema.fields, T.StructField(kept, kind)]))


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Both joins read the same columns dealt by the same key, so the texts are shuffled once.
    """
    keyed = _keyed(docs, doc_id, text)
    found = _joined(keyed, keyed, F.col("id"), "key", "runs", length).select("id", "text", "runs")

    def run(batch: pa.RecordBatch):
        out = []
        for value, packed in zip(texts(batch.column(1)), batch.column(2).to_pylist()):
            spans, state, last = merged(packed).tolist(), hashlib.sha256(), 0
            for a, b in spans:
                state.update(value[last:a])
                last = b
            state.update(value[last:])
            out.append((len(value), sum(b - a for a, b in spans), len(spans), state.hexdigest()))
        return [batch.column(0), *(zip(*out) if out else [[]] * 4)]

    digests = map_batches(found, run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return digests.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
