"""Mixing sources to target weights: iterative proportional fitting (raking) of token weights, then sampling.

Tokens are counted in cells of (source, language, topic). Starting from weight one for every token, the weights are
scaled in turn until the weighted tokens of each source, language and topic have their target shares. Each document
is then kept with probability min(1, rate * weight of its cell), where the rate makes the expected tokens of the sample
``keep`` times all tokens. So the expected tokens have the target shares as far as there are enough of them: of what
is scarce everything is kept. Targets default to the observed shares to a power below one per margin,
made to add up to one: large sources, languages and topics are damped, small ones raised.

A sweep is one aggregate over a table with a row for each source; documents are read twice, for the counts and for
the decisions. The document's random number is a hash of its id, so a sample can be repeated.

Defined results: null source, language or topic are a value of their own; a null or empty text has no tokens and
probability zero; a margin whose target is zero or missing goes; a null id has the hash of an empty id; repeated
rows share a decision; an empty table gives an empty table. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.common import free_name, staged

#: Exponents of the observed shares for the default targets.
DAMPING = {"source": 0.7, "lang": 0.7, "topic": 0.7}
SWEEPS = 12
#: Expected part of the tokens that a sample keeps, and steps to find the rate (each fixes the set of cells kept whole).
KEEP, RATE_STEPS = 0.5, 8


def tokens_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def topic_of(text: str) -> Column:
    """A coarse topic by fixed marks in the text: licences, configuration, contact data, tables, else prose."""
    t = F.col(text)
    return (
        F.when(t.contains("Licensed under") | t.contains("All rights reserved"), "legal")
        .when(t.contains("token = ") | t.contains("password"), "config")
        .when(t.contains("@mail"), "contact")
        .when(t.contains(" | "), "table")
        .when(t.isNull() | (t == ""), "empty")
        .otherwise("prose")
    )


def uniform(doc_id: str) -> Column:
    """A number in [0, 1) from the id: the first 52 bits of its MD5."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def share(weights: dict, damping: float) -> dict:
    """Shares of the whole after raising to the power ``damping``; zero weights have none."""
    powered = {k: v**damping for k, v in weights.items() if v > 0}
    whole = sum(powered.values())
    return {k: v / whole for k, v in powered.items()}


@dataclass
class Mix:
    """Raked weights: ``sources`` has ``source, scale``; a cell's weight is the scale times its combination's.

    A document is kept with probability ``min(1, rate * weight)``.
    """

    sources: DataFrame
    combinations: dict[tuple, float]
    rate: float

    def weight(self, lang: Column, topic: Column, scale: Column) -> Column:
        entries = [x for (a, b), w in self.combinations.items() for x in (_pair(F.lit(a), F.lit(b)), F.lit(w))]
        return F.coalesce(scale * F.element_at(F.create_map(*entries), _pair(lang, topic)) if entries else F.lit(0.0), F.lit(0.0))


def _pair(lang: Column, topic: Column) -> Column:
    """One text for a language and a topic; null differs from every text."""
    return F.concat(F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit("-")), F.lit("\x01"), F.coalesce(F.concat(F.lit("="), topic.cast("string")), F.lit("-")))


def rake(cells: DataFrame, damping: dict[str, float] | None = None, targets: dict[str, dict] | None = None, sweeps: int = SWEEPS, keep: float = KEEP, max_combinations: int = 100_000) -> Mix:
    """Rake ``cells`` (``source, lang, topic, tokens``) to the target shares of all three margins.

    ``targets`` may give shares for a margin by value; the others get their damped observed shares. A sweep scales
    sources, then languages, then topics. The scale of a source follows from the weights of its combinations, so a
    sweep is one aggregate over the sources that returns one sum for each (language, topic); there may be any
    number of sources, but at most ``max_combinations`` of those.
    """
    damping, targets = DAMPING | (damping or {}), dict(targets or {})
    cells = staged(cells.where("tokens > 0"), "cells")
    observed = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).limit(max_combinations + 1).collect()
    if len(observed) > max_combinations:
        raise ValueError(f"more than {max_combinations} pairs of language and topic")
    observed.sort(key=lambda r: (r.lang is not None, r.lang or "", r.topic is not None, r.topic or ""))
    pairs, whole = [(r.lang, r.topic) for r in observed], float(sum(r.tokens for r in observed))
    for at, margin in enumerate(("lang", "topic")):
        held: dict = {}
        for pair, r in zip(pairs, observed):
            held[pair[at]] = held.get(pair[at], 0.0) + float(r.tokens)
        targets.setdefault(margin, share(held, damping[margin]))

    number = F.create_map(*[x for j, (a, b) in enumerate(pairs) for x in (_pair(F.lit(a), F.lit(b)), F.lit(j))]) if pairs else F.lit(None).cast("map<string,int>")
    entry = F.struct(F.element_at(number, _pair(F.col("lang"), F.col("topic"))).alias("j"), F.col("tokens").cast("double").alias("tokens"))
    rows = cells.groupBy("source").agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.sum("tokens").cast("double").alias("held"))
    if "source" in targets:
        given = F.create_map(*[x for k, v in targets["source"].items() for x in (F.lit(k), F.lit(float(v)))])
        rows = rows.withColumn("share", F.coalesce(F.element_at(given, F.col("source")), F.lit(0.0)))
    else:
        powered = rows.agg(F.sum(F.pow("held", F.lit(damping["source"])))).first()[0] or 1.0
        rows = rows.withColumn("share", F.pow("held", F.lit(damping["source"])) / F.lit(powered))
    rows = staged(rows, "sources")

    def scale(weights: list[float]) -> Column:
        known = F.array(*[F.lit(w) for w in weights]) if weights else F.array(F.lit(0.0))
        held = F.aggregate("entries", F.lit(0.0), lambda a, e: a + e["tokens"] * F.get(known, e["j"]))
        return F.when(held > 0, F.col("share") * F.lit(whole) / held).otherwise(F.lit(0.0))

    factor = {"lang": {k: 1.0 for k, _ in pairs}, "topic": {k: 1.0 for _, k in pairs}}
    now = lambda: [factor["lang"][a] * factor["topic"][b] for a, b in pairs]
    for _ in range(sweeps if pairs else 0):
        scaled = rows.withColumn("scale", scale(now())).select("scale", F.explode("entries").alias("e"))
        sums = {r.j: r.held for r in scaled.groupBy("e.j").agg(F.sum(F.col("scale") * F.col("e.tokens")).alias("held")).collect()}
        for at, margin in enumerate(("lang", "topic")):
            held = dict.fromkeys(factor[margin], 0.0)
            for j, (pair, w) in enumerate(zip(pairs, now())):
                held[pair[at]] += sums.get(j, 0.0) * w
            for k, h in held.items():
                factor[margin][k] *= targets[margin].get(k, 0.0) * whole / h if h > 0 else 0.0
    weights = now()
    known = F.array(*[F.lit(w) for w in weights]) if weights else F.array(F.lit(0.0))
    sources = rows.select("source", scale(weights).alias("scale"), "entries")
    sources = staged(sources.withColumn("cells", F.transform("entries", lambda e: F.struct(e["tokens"].alias("tokens"), (F.col("scale") * F.get(known, e["j"])).alias("weight")))).drop("entries"), "source-scales")
    cell_weights = sources.select(F.explode("cells").alias("c")).select("c.*")
    rate = keep if pairs else 0.0
    for _ in range(RATE_STEPS if pairs else 0):
        scarce = F.col("weight") * rate >= 1
        full, rest = cell_weights.agg(F.sum(F.when(scarce, F.col("tokens"))), F.sum(F.when(~scarce, F.col("tokens") * F.col("weight")))).first()
        before, rate = rate, (keep * whole - (full or 0.0)) / rest if rest else rate
        if rate == before:
            break
    return Mix(sources.drop("cells"), dict(zip(pairs, weights)), rate)


def with_sampling(docs: DataFrame, name: str, source: str = "source", lang: str = "lang", doc_id: str = "doc_id", text: str = "text", topic: Column | None = None, **options) -> DataFrame:
    """``docs`` with a last column ``name``: struct of ``tokens, topic, weight, probability, sampled``."""
    topic = topic_of(text) if topic is None else topic
    cells = docs.select(F.col(source).alias("source"), F.col(lang).alias("lang"), topic.alias("topic"), tokens_of(text).alias("tokens"))
    mix = rake(cells.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")), **options)
    key, scale = free_name(docs, "mix_source"), free_name(docs, "mix_scale")
    scales = mix.sources.select(F.col("source").alias(key), F.col("scale").alias(scale))
    joined = docs.join(scales, docs[source].eqNullSafe(scales[key]), "left")
    tokens = tokens_of(text)
    weight = F.when(tokens > 0, mix.weight(F.col(lang), topic, F.col(scale))).otherwise(0.0)
    probability = F.least(F.lit(1.0), F.lit(mix.rate) * weight)
    state = F.struct(tokens.alias("tokens"), topic.alias("topic"), weight.alias("weight"), probability.alias("probability"), (uniform(doc_id) < probability).alias("sampled"))
    return joined.withColumn(name, state).select(*docs.columns, name)


def sample(docs: DataFrame, **options) -> DataFrame:
    """The documents kept, with the columns of ``docs``."""
    name = free_name(docs, "mix")
    return with_sampling(docs, name, **options).where(F.col(name)["sampled"]).drop(name)
