"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows that tell quotation from abuse.

The lexicon is learned from a bounded sample of labelled rows. A word enters if it stands in many different contexts
(previous and next word, so that copies of one text count once) of toxic rows and hardly in clean ones; word beginnings shared by several such words enter as stems. Words
and stems form a trie. A token is matched by running the automaton that accepts everything within its allowed distance
(insertions, deletions, substitutions, swaps of neighbours) along the trie; only branches both can follow are visited.
Every entry of four letters or more may be misspelled by one edit, of eight or more by two; a stem in the part before its
last letter, which has to stand. What the clean rows of the sample hold near an entry (a token near a word, the beginning
of a token near a stem) is barred one by one, and leaves the other misspellings of that entry alone; these count less the
more neighbours of the entry the clean rows hold just once, as that many more are to be expected in texts not seen.

Each hit has a weight by its window: less inside quotation marks or near a verb of reporting, more near a pronoun
that addresses somebody. The score of a document is a logistic function, fitted on the same sample, of its weighted
exact and misspelled hits. Texts are read whole; labels, language, source and id are no inputs.

Defined results: a null or empty text is scored like one without hits; rows without label or id are not learned
from, several labels of an id count as toxic if one is; without toxic or without clean rows the lexicon is empty and
all scores are zero; repeated rows are each scored; an empty table gives an empty table. Other columns pass through.
"""

from __future__ import annotations

import pickle
import uuid
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolegrid.llm.common import map_batches, shared, staged, texts

#: A-Z lowered; letters, digits, non-ASCII and the signs that stand in for letters kept; all else a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b in b"*@$" else 32 for b in range(256))
#: Words near a hit that mark reported speech, or that address somebody.
REPORTING = frozenset("said says wrote writes called quoted quote quotes told reported according sagte sagt schrieb nannte zitiert dijo dice escribió llamó citó dit écrit appelé cité".encode().split())
ADDRESS = frozenset("you your youre ur du dich dir dein sie ihr euch tu te ti tus usted vous toi vos votre".encode().split())
QUOTES = ('"', "“”", "„“", "«»", "»«", "‘’")
WINDOW = 6
MISSPELLED, QUOTED = 0.8, 0.2
REMEMBERED = 400_000
#: The model in use and its remembered tokens, kept for the next task of a Python worker.
HELD: dict[str, tuple] = {}


def allowed(entry: str) -> int:
    """Edits that an entry may be misspelled by."""
    return (len(entry) >= 4) + (len(entry) >= 8)


def letters(part: str) -> int:
    """The letters of a string as bits; letters may share a bit."""
    out = 0
    for c in part:
        out |= 1 << ord(c) % 61
    return out


class Trie:
    """Words and stems (which accept every ending) with the edits allowed for each, and the barred misspellings."""

    def __init__(self, words: dict[str, int], stems: dict[str, int], barred: frozenset[str] = frozenset()):
        self.words, self.stems, self.barred = words, stems, barred
        self.root: dict = {"most": 0, "below": 0}
        self.of_size: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        self.stem_letters: list[tuple[int, int, int, int]] = []
        bit = 1
        for kind, entries in (("word", words), ("stem", stems)):
            for entry, edits in entries.items():
                node = self.root
                for letter in entry:
                    node = node.setdefault(letter, {"most": 0, "below": 0})
                    node["most"] = max(node["most"], edits)
                    node["below"] |= bit
                node[kind] = entry
                if kind == "word":
                    for size in range(len(entry) - edits, len(entry) + edits + 1):
                        self.of_size[size].append((letters(entry), edits, bit))
                else:
                    self.stem_letters.append((letters(entry), len(entry), edits, bit))
                bit <<= 1

    def possible(self, token: str) -> int:
        """Bits of the entries that can match: an edit adds one letter at most, and takes one away at most."""
        held, size, out = [0], len(token), 0
        for c in token:
            held.append(held[-1] | 1 << ord(c) % 61)
        whole = held[-1]
        for mask, edits, bit in self.of_size.get(size, ()):
            if (mask & ~whole).bit_count() <= edits and (whole & ~mask).bit_count() <= edits:
                out |= bit
        for mask, length, edits, bit in self.stem_letters:
            if size >= length - edits and (mask & ~held[min(size, length + edits)]).bit_count() <= edits and (held[length - edits] & ~mask).bit_count() <= edits:
                out |= bit
        return out

    def near(self, token: str):
        """All ``(edits, entry, matched part)`` within the allowed edits; a word matches a whole token, a stem a beginning."""
        possible = self.possible(token)
        if not possible:
            return
        first = list(range(len(token) + 1))
        todo = [(self.root, "", first, first)]
        while todo:
            node, letter_before, row, before = todo.pop()
            for letter, child in node.items():
                if len(letter) > 1 or not child["below"] & possible:
                    continue
                new, stands = [row[0] + 1], []
                for i, c in enumerate(token, 1):
                    kept = row[i - 1] + (c != letter)
                    swapped = i > 1 and c == letter_before and token[i - 2] == letter and row is not before
                    if swapped:
                        kept = min(kept, before[i - 2] + 1)
                    new.append(min(new[-1] + 1, row[i] + 1, kept))
                    if c == letter or swapped:
                        stands.append((kept, i))
                if min(new) > child["most"]:
                    continue
                if "stem" in child:
                    for edits, i in stands:
                        if edits <= self.stems[child["stem"]]:
                            yield edits, child["stem"], token[:i]
                if "word" in child and new[-1] <= self.words[child["word"]]:
                    yield new[-1], child["word"], token
                todo.append((child, letter, new, row))

    def match(self, token: str) -> tuple[str, int] | None:
        """The nearest entry that a token matches without a barred misspelling, and the edits between them."""
        best = min(((edits, entry) for edits, entry, part in self.near(token) if not edits or part not in self.barred), default=None)
        return (best[1], best[0]) if best else None


class Memo(dict):
    """Token bytes to (misspelled, trust), or None where nothing matches; forgets all when full."""

    def __init__(self, trie: Trie, trust: dict[tuple[str, int], float] | None = None):
        super().__init__()
        self.trie, self.trust = trie, trust or {}

    def __missing__(self, token: bytes) -> tuple[bool, float] | None:
        found = self.trie.match(token.decode("utf-8", "replace").lower())
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = out = found and (found[1] > 0, self.trust.get(found, 1.0))
        return out


def quoted(text: str, start: int, stop: int) -> bool:
    """Whether quotation marks enclose a place within its line."""
    low, high = text.rfind("\n", 0, start) + 1, text.find("\n", stop)
    before, after = text[low:start], text[stop : high if high >= 0 else len(text)]
    for marks in QUOTES:
        if len(marks) == 1:
            if before.count(marks) % 2 and marks in after:
                return True
        elif before.rfind(marks[0]) > before.rfind(marks[1]) and marks[1] in after:
            return True
    return False


def features(text: bytes, memo: Memo) -> tuple[float, float, float, int]:
    """Weighted exact hits, weighted misspelled hits, weighted hits for a hundred tokens, number of hits."""
    folded = text.translate(FOLD)
    tokens = folded.split()
    hits = [i for i, t in enumerate(tokens) if memo[t]]
    if not hits:
        return 0.0, 0.0, 0.0, 0
    plain = text.decode("utf-8", "replace")
    sums, at, token = [0.0, 0.0], 0, 0
    marked = any(m in plain for marks in QUOTES for m in marks)
    chars = 0 if marked else None
    chars_at = 0
    for i in hits:
        while token <= i:
            at = folded.index(tokens[token], at) + len(tokens[token])
            token += 1
        weight = 1.0
        near = tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + 1 + WINDOW]
        if marked:
            begin = at - len(tokens[i])
            chars += len(text[chars_at:begin].decode("utf-8", "replace"))
            chars_at = begin
            if quoted(plain, chars, chars + len(tokens[i].decode("utf-8", "replace"))):
                weight *= QUOTED
        if not REPORTING.isdisjoint(near):
            weight *= 0.5
        if not ADDRESS.isdisjoint(near):
            weight *= 1.2
        misspelled, trust = memo[tokens[i]]
        sums[misspelled] += weight * trust
    return sums[0], sums[1], 100 * sum(sums) / len(tokens), len(hits)


def load(exact, misspelled):
    """What a document's hits weigh together; a misspelled one counts a little less."""
    return np.log1p(exact + MISSPELLED * misspelled)


@dataclass
class Model:
    words: dict[str, int] = field(default_factory=dict)
    stems: dict[str, int] = field(default_factory=dict)
    barred: frozenset[str] = frozenset()
    trust: dict[tuple[str, int], float] = field(default_factory=dict)
    weights: np.ndarray | None = None

    def score(self, exact: float, misspelled: float) -> float:
        if self.weights is None:
            return 0.0
        z = float(self.weights @ np.array([1.0, load(exact, misspelled)]))
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def choose(counts: dict[str, tuple[int, int]], toxic_rows: int, clean_rows: int, support: int = 5, lift: float = 30.0, bar: float = 3.0) -> tuple[dict[str, int], dict[str, int], frozenset[str], dict[tuple[str, int], float]]:
    """Words and stems with their allowed edits, barred misspellings, and what (entry, edits) is trusted if below 1.

    ``counts`` holds for each word its toxic contexts and its clean occurrences. What is near
    an entry is barred if it occurs in clean rows and is not ``bar`` times as frequent in toxic ones.
    """
    ratio = clean_rows / max(1, toxic_rows)
    strong = lambda pos, neg, least: pos >= least and pos * ratio >= lift * max(neg, 0.5)
    words = {w for w, (pos, neg) in counts.items() if len(w) >= 4 and strong(pos, neg, support)}
    sums: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    for w, (pos, neg) in counts.items():
        for n in range(4, min(9, len(w))):
            s = sums[w[:n]]
            s[0] += pos
            s[1] += neg
            s[2] += pos > 0
    stems: list[str] = []
    for stem in sorted(sums, key=lambda s: (len(s), s)):
        pos, neg, kinds = sums[stem]
        main = max((counts[w][0] for w in words if w.startswith(stem)), default=0)
        if len(stem) > 6 or not (kinds >= 4 and main < 0.6 * pos and strong(pos, neg, 3 * support)) or any(stem.startswith(s) or s.startswith(stem) for s in stems):
            continue
        # as long as nearly all of its words agree in one more letter, a stem takes it: the longer, the surer
        while longer := [s for s, (p, _, k) in sums.items() if len(s) == len(stem) + 1 and s.startswith(stem) and p >= 0.95 * pos and k >= 4]:
            stem = longer[0]
        stems.append(stem)
    kept = {w: allowed(w) for w in words if not any(w.startswith(s) for s in stems)}
    ends = {s: allowed(s) for s in stems}
    trie = Trie(kept, ends)
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    entries: dict[str, set[tuple[str, int]]] = defaultdict(set)
    for w, (pos, neg) in counts.items():
        found = {(part, entry, edits) for edits, entry, part in trie.near(w) if edits}
        for part, entry, edits in found:
            entries[part].add((entry, edits))
        for part in {part for part, _, _ in found}:
            seen[part][0] += pos
            seen[part][1] += neg
    barred = frozenset(part for part, (pos, neg) in seen.items() if neg and pos * ratio < bar * neg)
    once: dict[tuple[str, int], int] = defaultdict(int)
    for part in barred:
        for key in entries[part]:
            once[key] += seen[part][1] == 1
    return kept, ends, barred, {key: 1 / (1 + n) for key, n in once.items() if n}


def regress(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the intercept is not shrunk."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w, shrink = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + shrink, x.T @ (weight * (y - p)) - shrink @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows_per_label: int = 3000) -> Model:
    """Lexicon and weights from at most ``rows_per_label`` rows of each label, those of smallest id hash, whole texts."""
    judged = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    judged = judged.where("toxic in (0, 1)")
    total = {r.toxic: r.n for r in judged.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return Model()
    # hashes are even, so that the smallest ones of a label lie below this bound, and no task gets the rows of a whole label
    bound = {k: min(2**63 - 1, -(2**63) + 2**64 * 2 * (rows_per_label + 50) // n) for k, n in total.items()}
    low = judged.where(F.xxhash64("id") <= F.when(F.col("toxic") == 1, F.lit(bound[1])).otherwise(F.lit(bound[0])))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id")
    chosen = low.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows_per_label).drop("n")
    chosen = staged(chosen, "sample-ids")  # two labels, so at most 2 * rows_per_label rows: bounded, and broadcast below
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    rows = staged(rows.select("text", "toxic"), "sample")

    def count(batch: pa.RecordBatch):
        seen: dict[tuple[str, int], int] = defaultdict(int)
        for value, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
            tokens = value.translate(FOLD).split()
            if toxic:
                for before, token, after in zip([b"", *tokens], tokens, [*tokens[1:], b""]):
                    seen[token, hash_of(before + b" " + after)] = 1
            else:
                for token in tokens:
                    seen[token, 0] += 1
        keys = list(seen)
        return [[k[0].decode("utf-8", "replace").lower() for k in keys], [k[1] for k in keys], [seen[k] for k in keys]]

    counted = map_batches(rows, count, "word string, context bigint, n bigint").groupBy("word", "context").agg(F.sum("n").alias("n"))
    by_word = counted.groupBy("word").agg(F.count(F.when(F.col("context") != 0, 1)).alias("pos"), F.coalesce(F.sum(F.when(F.col("context") == 0, F.col("n"))), F.lit(0)).alias("neg")).toPandas()
    took = {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    words, stems, barred, trust = choose(dict(zip(by_word.word, zip(by_word.pos.tolist(), by_word.neg.tolist()))), took[1], took[0])
    model = Model(words, stems, barred, trust)
    table = with_features(rows, model, "f").select("toxic", "f.*").toPandas()
    weight = table.toxic.map({k: n / took[k] for k, n in total.items()}).to_numpy(float)
    # what the windows are for, as a prior of a twentieth of the toxic rows each: one plain hit, exact or misspelled, is
    # abuse, one in quotation marks is not; samples where single hits say something else outweigh it
    prior = [(1.0, 0.0, 1.0), (0.0, 1.0, 1.0), (QUOTED, 0.0, 0.0)]
    exact, misspelled, toxic = np.concatenate([table[["exact", "misspelled", "toxic"]].to_numpy(float), prior]).T
    weight = np.concatenate([weight, [total[1] / 20] * len(prior)])
    model.weights = regress(load(exact, misspelled)[:, None], toxic, weight)
    return model


def hash_of(value: bytes) -> int:
    """Non-zero 62-bit hash."""
    return (xxhash.xxh64_intdigest(value) >> 2) | 1


def held(key: str, sent: Broadcast) -> tuple[Model, Memo]:
    """A model and its memo, kept in the worker; named in the module, so that tasks of one worker share them."""
    if key not in HELD:
        model = pickle.loads(sent.value)
        HELD.clear()
        HELD[key] = model, Memo(Trie(model.words, model.stems, model.barred), model.trust)
    return HELD[key]


def with_features(docs: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """``docs`` with a last column ``name``: struct of ``exact, misspelled, density, hits, score``."""
    at = docs.columns.index(text)
    sent = shared(docs.sparkSession, model)
    fields = ("exact", "misspelled", "density", "hits", "score")
    kind = T.StructType([T.StructField(f, T.LongType() if f == "hits" else T.DoubleType()) for f in fields])
    arrow = pa.struct([(f, pa.int64() if f == "hits" else pa.float64()) for f in fields])
    key = uuid.uuid4().hex

    def run(batch: pa.RecordBatch):
        model, memo = held(key, sent)
        rows = []
        for value in texts(batch.column(at)):
            found = features(value, memo)
            rows.append(dict(zip(fields, (*found, model.score(*found[:2])))))
        return [*batch.columns, pa.array(rows, arrow)]

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))
