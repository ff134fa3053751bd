"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to ``ORDER``: how often a byte followed each context of up to that
many bytes. A byte seen n times after a context with T bytes and D distinct ones costs log2((T + D) / n) bits;
an unseen one costs the escape, log2((T + D) / D), and is tried again after the next shorter context; below order 0
every byte costs 8 bits. The statistics are frozen after fitting, so the code length of a text is an exact sum, and
the language with the shortest code wins.

Bytes are folded first: A-Z lowered, all other ASCII but a-z made a space. A text starts after ``ORDER`` spaces.

The trees are fitted on a bounded sample, ``rows_per_language`` rows of each language (those of smallest id hash,
whole texts). Scoring covers whole texts. A (context, byte) pair met before is looked up in a table of costs for
all languages at once; others take the escape chain and are then remembered, within a fixed number of entries.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if no language was learned; on equal
code lengths the language first in byte order wins; rows without language or id are not learned from; repeated rows
are each scored; an empty table gives an empty table. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolegrid.llm.common import map_batches, shared, staged, texts

ORDER = 4
UNKNOWN = "und"
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 32 for b in range(256))
ASCII_LETTER, HIGH_BYTE, LETTER = re.compile(rb"[A-Za-z]"), re.compile(rb"[\x80-\xff]"), re.compile(r"[^\W\d_]")
#: Positions handled at once, and (context, byte) pairs remembered beyond the fitted ones.
PIECE, REMEMBERED = 1 << 19, 1 << 20


def has_letter(text: bytes) -> bool:
    if ASCII_LETTER.search(text):
        return True
    return bool(HIGH_BYTE.search(text) and LETTER.search(text.decode("utf-8", "replace")))


def folded(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, each after ``ORDER`` spaces, and where each text starts in it."""
    pad = b" " * ORDER
    starts = np.cumsum([ORDER] + [len(v) + ORDER for v in values])[: len(values)]
    return np.frombuffer(b"".join(pad + v for v in values).translate(FOLD), np.uint8), starts


def grams(buffer: np.ndarray, low: int, high: int) -> np.ndarray:
    """For each position in [low, high): its byte and the ``ORDER`` bytes before it as one number."""
    out = np.zeros(high - low, np.uint64)
    for back in range(ORDER, -1, -1):
        out = (out << np.uint64(8)) | buffer[low - back : high - back]
    return out


@dataclass
class Tree:
    """Counts of one language: by order, sorted (context, byte) numbers and contexts with their costs."""

    seen: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, full: np.ndarray, counts: np.ndarray) -> Tree:
        seen, contexts = [], []
        for order in range(ORDER + 1):
            keys, at = np.unique(full & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
            n = np.bincount(at, counts, len(keys))
            names, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, distinct = np.bincount(of, n, len(names)), np.bincount(of, minlength=len(names))
            seen.append((keys, np.log2((total + distinct)[of] / n)))
            contexts.append((names, np.log2((total + distinct) / distinct), total))
        return cls(seen, contexts)

    def bits(self, full: np.ndarray) -> np.ndarray:
        """Exact cost of each (context, byte) pair."""
        cost, open_ = np.zeros(len(full)), np.ones(len(full), bool)
        for order in range(ORDER, -1, -1):
            key = full & np.uint64((1 << 8 * (order + 1)) - 1)
            keys, bits = self.seen[order]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = open_ & (keys[at] == key)
            cost[hit] += bits[at[hit]]
            open_ &= ~hit
            names, escape, _ = self.contexts[order]
            context = key >> np.uint64(8)
            at = np.minimum(np.searchsorted(names, context), len(names) - 1)
            out = open_ & (names[at] == context)
            cost[out] += escape[at[out]]
        cost[open_] += 8
        return cost


class Costs:
    """Hash table from (context, byte) to the costs under every language."""

    EMPTY = np.uint64(2**64 - 1)

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        fitted = np.unique(np.concatenate([t.seen[ORDER][0] for t in trees]))
        self.room = len(fitted) + REMEMBERED
        self.shift = np.uint64(64 - (2 * self.room - 1).bit_length())
        self.keys = np.full(1 << (64 - int(self.shift)), self.EMPTY)
        self.rows = np.zeros(len(self.keys), np.int32)
        self.costs = np.zeros((self.room, len(trees)), np.float32)
        self.n = 0
        self.put(fitted)
        self.fitted = self.n

    def slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def put(self, new: np.ndarray) -> None:
        """Add distinct keys that are not there yet."""
        self.costs[self.n : self.n + len(new)] = np.stack([t.bits(new) for t in self.trees], axis=1)
        rows, slots = np.arange(self.n, self.n + len(new), dtype=np.int32), self.slot(new)
        self.n += len(new)
        while len(new):
            free = self.keys[slots] == self.EMPTY
            _, first = np.unique(slots[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slots[won]], self.rows[slots[won]] = new[won], rows[won]
            left = np.ones(len(new), bool)
            left[won] = False
            new, rows, slots = new[left], rows[left], (slots[left] + 1) & (len(self.keys) - 1)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each key, and the positions of those that are not there."""
        slots = self.slot(key)
        held = self.keys[slots]
        rows = self.rows[slots]
        open_ = np.flatnonzero(held != key)
        missing = []
        while len(open_):
            empty = held[open_] == self.EMPTY
            missing.append(open_[empty])
            open_ = open_[~empty]
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            held[open_] = self.keys[slots[open_]]
            rows[open_] = self.rows[slots[open_]]
            open_ = open_[held[open_] != key[open_]]
        return rows, np.concatenate(missing) if missing else np.zeros(0, np.int64)

    def of(self, key: np.ndarray) -> np.ndarray:
        rows, missing = self.find(key)
        if len(missing):
            new = np.unique(key[missing])
            if self.n + len(new) > self.room:
                self.forget()
                return self.of(key) if len(new) <= self.room - self.fitted else np.stack([t.bits(key) for t in self.trees], axis=1)
            self.put(new)
            rows[missing], _ = self.find(key[missing])
        return self.costs[rows]

    def forget(self) -> None:
        """Keep the fitted pairs only."""
        self.keys[self.rows >= self.fitted] = self.EMPTY
        taken = np.flatnonzero(self.keys != self.EMPTY)
        keys = self.keys[taken][np.argsort(self.rows[taken])]
        self.keys[:] = self.EMPTY
        self.n = 0
        self.put(keys)


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]

    def code_lengths(self, values: list[bytes], costs: Costs) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(values), len(self.languages)))
        buffer, starts = folded(values)
        ends = starts + np.array([len(v) for v in values], np.int64) if values else starts
        for low in range(ORDER, len(buffer), PIECE):
            high = min(low + PIECE, len(buffer))
            bits = costs.of(grams(buffer, low, high))
            first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
            a, b = np.maximum(starts[first:last], low) - low, np.minimum(ends[first:last], high) - low
            full = np.flatnonzero(b > a)
            if len(full):
                bounds = np.stack([a[full], b[full]], axis=1).ravel()
                padded = np.concatenate([bits, np.zeros((1, bits.shape[1]), bits.dtype)]).astype(np.float64)
                out[first + full] += np.add.reduceat(padded, bounds, axis=0)[::2]
        return out


def fit(labelled: DataFrame, language: str = "lang", doc_id: str = "doc_id", text: str = "text", rows_per_language: int = 400) -> Model:
    """Trees from a sample of ``rows_per_language`` rows of each language; only counts reach the driver."""
    narrow = labelled.where(F.col(language).isNotNull() & F.col(doc_id).isNotNull())
    ids = narrow.select(F.col(language).cast("string").alias("language"), F.col(doc_id).alias("id"))
    order = Window.partitionBy("language").orderBy(F.xxhash64("id"), "id")
    chosen = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows_per_language).select("id").distinct()
    chosen = staged(chosen, "sample-ids")  # at most rows_per_language for each language the model has a tree of, so it is broadcast
    rows = narrow.select(F.col(language).cast("string").alias("language"), F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id", "left_semi")

    def count(batch: pa.RecordBatch):
        out = ([], [], [])
        names = batch.column(1).to_pylist()
        values = texts(batch.column(2))
        for name in sorted(set(names)):
            mine = [v for n, v in zip(names, values) if n == name and v]
            if not mine:
                continue
            buffer, starts = folded(mine)
            keys, n = np.unique(np.concatenate([grams(buffer, s, s + len(v)) for s, v in zip(starts.tolist(), mine)]), return_counts=True)
            for column, x in zip(out, ([name] * len(keys), keys.astype(np.int64), n)):
                column.append(x)
        return [sum(out[0], []), *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out[1:])]

    counted = map_batches(rows.select("id", "language", "text"), count, "language string, gram bigint, n bigint")
    table = counted.groupBy("language", "gram").agg(F.sum("n").alias("n")).toPandas()
    groups = sorted(table.groupby("language"), key=lambda g: g[0].encode())
    return Model([g for g, _ in groups], [Tree.of(t["gram"].to_numpy().astype(np.uint64), t["n"].to_numpy().astype(float)) for _, t in groups])


def with_language(docs: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """``docs`` with a last column ``name``: struct of ``lang``, ``score`` (posterior, 0 to 1) and ``bits`` a byte."""
    sent = shared(docs.sparkSession, model)
    at = docs.columns.index(text)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())])
    held: list = []

    def run(batch: pa.RecordBatch):
        if not held:
            model = pickle.loads(sent.value)
            held.extend([model, Costs(model.trees) if model.trees else None])
        model, costs = held
        rows = []
        values = texts(batch.column(at))
        if not model.languages:
            return [*batch.columns, pa.array([{"lang": UNKNOWN, "score": 0.0, "bits": None}] * len(values), _STRUCT)]
        lengths = model.code_lengths(values, costs)
        best = lengths.argmin(axis=1)
        least = lengths[np.arange(len(values)), best]
        score = 1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(axis=1)
        for v, b, s, n in zip(values, best.tolist(), score.tolist(), least.tolist()):
            ok = has_letter(v)
            rows.append({"lang": model.languages[b] if ok else UNKNOWN, "score": s if ok else 0.0, "bits": n / len(v) if v else None})
        return [*batch.columns, pa.array(rows, _STRUCT)]

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


_STRUCT = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("bits", pa.float64())])


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in no fold."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))
