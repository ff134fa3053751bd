"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over token windows.

Words are maximal runs of digits, letters a-z (A-Z lowered first) and non-ASCII characters. A window is ``size``
consecutive words of a benchmark item, or the whole item if it has fewer. A document word inside any occurrence of
a window is hit. A candidate is found by vocabulary membership and confirmed by comparing the words themselves.

Defined results: a null or empty text has no words and no hits; an item without words has no window; an item with
a null id makes hits but is not listed; repeated items count once by id; repeated documents are each judged; an
empty benchmark hits nothing. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rolegrid.llm.common import free_name, texts

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
STATE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])

#: Byte to byte: A-Z lowered, everything that is not part of a word made a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def window_index(items: list[tuple[str | None, bytes]], size: int) -> dict:
    """Windows by their words, with the ids of the items that hold them; the vocabulary; the window lengths."""
    windows: dict[tuple, set] = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        length = min(size, len(words))
        for i in range(len(words) - length + 1 if length else 0):
            windows[tuple(words[i : i + length])].add(item)
    return {
        "windows": {k: sorted(x for x in v if x is not None) for k, v in windows.items()},
        "vocabulary": {w for k in windows for w in k},
        "lengths": sorted({len(k) for k in windows}),
    }


def occurrences(words: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged word spans covered by windows, and the items they come from.

    A window of n words covers exactly one position that is n - 1 modulo n, so only every n-th word is looked up;
    around one that the vocabulary knows, the run of known words is tried window by window.
    """
    windows, known, lengths = index["windows"], index["vocabulary"], index["lengths"]
    spans: list[list[int]] = []
    items: set[str] = set()
    if not lengths:
        return [], items
    step, done = lengths[0], 0
    for i in range(step - 1, len(words), step):
        if i < done or words[i] not in known:
            continue
        low, high = i, i + 1
        while low > done and words[low - 1] in known:
            low -= 1
        while high < len(words) and words[high] in known:
            high += 1
        done = high
        for start in range(low, high - step + 1):
            for length in lengths:
                if start + length > high:
                    break
                found = windows.get(tuple(words[start : start + length]))
                if found is not None:
                    items.update(found)
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], start + length)
                    else:
                        spans.append([start, start + length])
    return [(a, b) for a, b in spans], items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def with_hits(docs: DataFrame, benchmark: DataFrame, state: str, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with a column ``state``: number of words, hit word spans, items found.

    The benchmark is broadcast in blocks of about ``block_bytes`` of text; a larger benchmark means more passes
    inside the same stage, not a larger broadcast. No shuffle.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("binary").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    out = docs.withColumn(state, F.lit(None).cast(STATE))
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        index = spark.sparkContext.broadcast(window_index([(r.id, bytes(r.text or b"")) for r in part.toLocalIterator()], size))
        out = _scan(out, text, state, index)
    return out


def _scan(df: DataFrame, text: str, state: str, index) -> DataFrame:
    at, to = df.columns.index(text), df.columns.index(state)
    kind = to_arrow_type(STATE)

    def run(batches):
        for batch in batches:
            rows = []
            for value, before in zip(texts(batch.column(at)), batch.column(to).to_pylist()):
                words = words_of(value)
                spans, items = occurrences(words, index.value)
                if before:
                    spans = merged(spans + [(s["start"], s["stop"]) for s in before["spans"]])
                    items |= set(before["items"])
                rows.append({"n_words": len(words), "spans": [{"start": a, "stop": b} for a, b in spans], "items": sorted(items)})
            yield batch.set_column(to, pa.field(batch.schema.names[to], kind), pa.array(rows, kind))

    return df.mapInArrow(run, df.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: ``doc_id, n_words, spans, items``."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_hits(narrow, benchmark, "hits", **options).select("doc_id", "hits.n_words", "hits.spans", "hits.items")


def _cut(batch: pa.RecordBatch, at: int, to: int) -> pa.Array:
    """Texts without the hit words; what stands between two hit words of one span goes with them."""
    out = []
    for value, state in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(to).to_pylist()):
        if value is not None and state["spans"]:
            folded, bounds, i = value.translate(FOLD), [], 0
            for word in folded.split():
                i = folded.index(word, i)
                bounds.append((i, i + len(word)))
                i += len(word)
            kept, last = [], 0
            for span in state["spans"]:
                kept.append(value[last : bounds[span["start"]][0]])
                last = bounds[span["stop"] - 1][1]
            value = b"".join([*kept, value[last:]])
        out.append(value)
    return pa.array(out, pa.binary()).cast(pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the hit spans cut out of their texts."""
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    state = free_name(docs, "hits")
    found = with_hits(docs, benchmark, state, text=text, **options)
    if remove == "documents":
        return found.where(F.size(F.col(state)["spans"]) == 0).drop(state)
    at, to = found.columns.index(text), found.columns.index(state)

    def run(batches):
        for batch in batches:
            yield batch.set_column(at, batch.schema.field(at), _cut(batch, at, to))

    return found.mapInArrow(run, found.schema).drop(state)
