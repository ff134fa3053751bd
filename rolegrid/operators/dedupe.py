"""Ordered duplicate removal over several keys at once.

A row is dropped when any of its keys belongs to an earlier *kept* row; keys of dropped rows do not count.
In graph terms the kept rows are the lexicographically first maximal independent set of the graph that
joins rows sharing a key. It is computed in rounds (Blelloch, Fineman, Shun, "Greedy Sequential Maximal
Independent Set and Matching are Parallel on Average", SPAA 2012): a row that comes first on all of its
keys is kept, rows sharing a key with a kept row are dropped, the rest goes into the next round.

Only ``(order, key)`` pairs move, never the payload. Each round starts with ``groupBy(key)`` minimum and
count, which Spark combines before the shuffle, so a key held by a third of all rows costs one row per map
task. A kept row is recognized by the number of keys it won; no join back to the hot key is needed. Chains, in which
each row waits for the one before, are decided by jumping pointers, in a number of steps that grows with the logarithm of
their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.functions.keys import posting_keys
from rolegrid.functions.urls import canonical_url
from rolegrid.operators.skew import heavy_keys, salted_join
from rolegrid.session import stage

# Rounds after which chains are looked for as well; most tables are done before.
CONTRACT_AFTER = 2
# Rows that may be broadcast, and the share of rows up to which those that share a key are looked for first.
SMALL, FEW = 100_000, 4


def canonicalize_postings(postings: DataFrame) -> DataFrame:
    """Replace ``url`` by its canonical form (PR5)."""
    return postings.withColumn("url", canonical_url("url", "source_site"))


def _round(pairs: DataFrame, contract: bool) -> tuple[DataFrame, DataFrame | None]:
    """One round over ``(ord, n_keys, key)``: returns kept orders and what is still undecided, if any."""
    per_key = stage(
        pairs.groupBy("key").agg(
            F.min(F.struct("ord", "n_keys")).alias("first"), F.count("*").alias("n")
        ).select("key", "first.*", "n"),
        "keys",
    )
    kept = stage(
        per_key.groupBy("ord", "n_keys").agg(F.count("*").alias("won"))
        .where(F.col("won") == F.col("n_keys")).select("ord"),
        "kept",
    )
    shared = per_key.where(F.col("n") > 1)
    if shared.isEmpty():
        return kept, None
    heavy = heavy_keys(shared, "key")
    if contract:
        chained = _chains(pairs, shared, heavy)
        kept = stage(kept.unionByName(chained.where("kept").select("ord")).distinct(), "kept")
        taken = pairs.join(kept, "ord", "left_semi").select("key").distinct()
        decided = kept.unionByName(chained.select("ord"))
    else:
        taken, decided = shared.join(kept, "ord", "left_semi").select("key"), kept
    hit = salted_join(pairs, taken, "key", "left_semi", heavy, spread="ord")
    decided = hit.select("ord").unionByName(decided).distinct()
    return kept, pairs.join(decided, "ord", "left_anti")


def _chains(pairs: DataFrame, shared: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """``ord, kept`` of the rows at the end of chains, however long these are.

    A row whose only earlier neighbour is one row, tied by keys that no third row has, is kept exactly if that row
    is dropped. Such rows point to their neighbour; pointers jump to the pointer's own target, doubling their
    length, until they end at a row that comes first on all of its keys, and so is kept, or at one that has to
    wait. Which of the two a row gets depends on the parity of the way.
    """
    tied = salted_join(pairs.select("ord", "key"), shared.select("key", F.col("ord").alias("first"), "n"), "key", "left", heavy, spread="ord")
    later = F.col("n").isNotNull() & (F.col("first") != F.col("ord"))
    rows = tied.groupBy("ord").agg(
        F.min(F.when(later, F.col("first"))).alias("to"), F.max(F.when(later, F.col("first"))).alias("other"), F.bool_or(later & (F.col("n") > 2)).alias("crowded")
    )
    rows = stage(rows, "neighbours")
    first = rows.where("to IS NULL").select("ord")
    ways = stage(rows.where("NOT crowded AND to = other").select("ord", "to", F.lit(True).alias("odd"), F.lit(False).alias("ended")), "ways")
    while not (open_ := ways.where("NOT ended")).isEmpty():
        ahead = ways.select(F.col("ord").alias("to"), F.col("to").alias("far"), F.col("odd").alias("more"), F.col("ended").alias("end"))
        odd = F.col("odd") != F.coalesce("more", F.lit(False))
        # a row that waits, or comes first, is no pointer itself: the way ends there
        jumped = open_.join(ahead, "to", "left").select("ord", F.coalesce("far", "to").alias("to"), odd.alias("odd"), F.coalesce("end", F.lit(True)).alias("ended"))
        ways = stage(ways.where("ended").unionByName(jumped), "ways")
    settled = ways.join(first.withColumnRenamed("ord", "to"), "to", "left_semi").select("ord", (~F.col("odd")).alias("kept"))
    return stage(settled, "chains")


def greedy_keep(rows: DataFrame, order: str, keys: Column, contract_after: int = CONTRACT_AFTER) -> DataFrame:
    """Order values of the rows that survive, as one column ``ord`` (DD1).

    ``order`` has to be unique; ``keys`` is an array of non-null strings. A row without keys survives.
    """
    keyed = rows.select(F.col(order).alias("ord"), F.array_distinct(keys).alias("keys"))
    keyed = stage(keyed.withColumn("n_keys", F.size("keys")), "keyed")
    tied = _tied(keyed)
    if tied is None:
        return _decide(keyed, contract_after)
    alone = keyed.join(tied.select("ord"), "ord", "left_anti").select("ord")
    return alone.unionByName(_decide(tied, contract_after))


def greedy_drop(rows: DataFrame, order: str, keys: Column, contract_after: int = CONTRACT_AFTER) -> DataFrame:
    """Order values of the rows that do not survive, as one column ``ord``: what ``greedy_keep`` leaves out."""
    keyed = rows.select(F.col(order).alias("ord"), F.array_distinct(keys).alias("keys"))
    keyed = stage(keyed.withColumn("n_keys", F.size("keys")), "keyed")
    tied = _tied(keyed)
    tied = keyed if tied is None else tied
    return stage(tied.select("ord").join(_decide(tied, contract_after), "ord", "left_anti"), "dropped")


def _tied(keyed: DataFrame) -> DataFrame | None:
    """The rows of ``ord, keys, n_keys`` that may share a key with another one, by hashes of 64 bits; all others survive, and
    the rounds need not carry them. None if they are too many for that to pay."""
    hashed = keyed.select("ord", F.explode("keys").alias("key")).select("ord", F.xxhash64("key").alias("h"))
    shared = stage(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    found, total = shared.agg(F.count("*"), F.sum("n")).first(), keyed.count()
    if (found[1] or 0) * FEW > total:
        return None
    if found[0] <= SMALL:
        hit = hashed.join(F.broadcast(shared.select("h")), "h", "left_semi")
    else:
        hit = salted_join(hashed, shared.select("h"), "h", "left_semi", heavy_keys(shared, "h"), spread="ord")
    hit = stage(hit.select("ord").distinct(), "tied")
    few = (found[1] or 0) <= SMALL
    return stage(keyed.join(F.broadcast(hit) if few else hit, "ord", "left_semi"), "tied")


def _decide(keyed: DataFrame, contract_after: int) -> DataFrame:
    """Order values of the rows of ``ord, keys, n_keys`` that survive, found in rounds."""
    keyless = keyed.where(F.col("n_keys") == 0).select("ord")
    pairs = keyed.where(F.col("n_keys") > 0).select("ord", "n_keys", F.explode("keys").alias("key"))
    survivors = keyless
    done = 0
    while True:
        kept, left = _round(pairs, contract=done >= contract_after)
        survivors = survivors.unionByName(kept)
        if left is None:
            return survivors
        pairs = stage(left, "undecided")
        done += 1
        if pairs.isEmpty():
            return survivors


def dedupe_postings(postings: DataFrame, order: str, scope: str | None = None, canonical: bool = False) -> DataFrame:
    """Canonicalize and deduplicate postings by source id, URL and title/company/location (DD1).

    With ``scope`` (for example a query id) duplicates are looked for within equal scopes only. ``canonical`` says that ``url``
    already has its canonical form, which is dear and otherwise spelled twice, for the keys and for the rows that stay.
    Few dropped rows are broadcast, so that the others stay where they are.
    """
    postings = postings if canonical else canonicalize_postings(postings)
    dropped = greedy_drop(postings, order, scoped(posting_keys(canonical=True), scope)).withColumnRenamed("ord", order)
    return postings.join(F.broadcast(dropped) if dropped.count() <= SMALL else dropped, order, "left_anti")


def scoped(keys: Column, scope: str | None) -> Column:
    if scope is None:
        return keys
    return F.transform(keys, lambda k: F.concat_ws(":", F.col(scope).cast("string"), k))


def first_seen(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """First row per key (WN1). ``min`` combines before the shuffle, then one join on the unique order."""
    firsts = rows.groupBy(key.alias("_key")).agg(F.min(order).alias(order)).select(order)
    return rows.join(firsts, order, "left_semi")


def duplicate_reasons(rows: DataFrame, order: str, keys: dict[str, Column]) -> DataFrame:
    """Dropped rows with the kept row and the first rule that ties them together (DD2).

    ``keys`` maps a rule name to its key, in rule order; a null key takes no part. Result columns:
    ``order``, ``kept``, ``rule``.
    """
    names = list(keys)
    entries = F.filter(
        F.array(*[F.struct(F.lit(i).alias("rule_no"), F.concat(F.lit(f"{i}:"), keys[n]).alias("key"))
                  for i, n in enumerate(names)]),
        lambda e: e["key"].isNotNull(),
    )
    keyed = stage(rows.select(F.col(order).alias("ord"), entries.alias("entries")), "entries")
    kept = stage(greedy_keep(keyed, "ord", F.transform("entries", lambda e: e["key"])), "survivors")
    pairs = keyed.select("ord", F.explode("entries").alias("e")).select("ord", "e.*")
    owners = pairs.join(kept, "ord", "left_semi").select("key", F.col("ord").alias("kept"))
    dropped = pairs.join(kept, "ord", "left_anti")
    counts = dropped.groupBy("key").agg(F.count("*").alias("n"))
    tied = salted_join(dropped, owners, "key", "inner", heavy_keys(counts, "key"), spread="ord")
    best = tied.where(F.col("kept") < F.col("ord")).groupBy("ord").agg(F.min(F.struct("rule_no", "kept")).alias("b"))
    rule = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("b.rule_no") + 1)
    return best.select(F.col("ord").alias(order), F.col("b.kept").alias("kept"), rule.alias("rule"))


def duplicate_links(rows: DataFrame, order: str, keys: dict[str, Column]) -> DataFrame:
    """Rows that share a key with an earlier row, linked to the first row of that key (JN12).

    One link per row and rule, so the report grows with the rows and not with their pairs.
    """
    entries = F.array(*[F.struct(F.lit(n).alias("rule"), k.alias("key")) for n, k in keys.items()])
    pairs = rows.select(F.col(order).alias("ord"), F.explode(entries).alias("e")).select("ord", "e.*")
    pairs = stage(pairs.where(F.col("key").isNotNull()).select("ord", "rule", F.concat_ws(":", "rule", "key").alias("key")), "links")
    shared = stage(
        pairs.groupBy("key").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n")).where("n > 1"), "shared"
    )
    linked = salted_join(pairs, shared.select("key", "first_ord"), "key", "inner", heavy_keys(shared, "key"), spread="ord")
    return linked.where(F.col("ord") > F.col("first_ord")).select(
        F.col("ord").alias(order), F.col("first_ord").alias("first"), "rule"
    )
