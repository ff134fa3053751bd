"""The postings table: upsert, lifecycle, scores, prompts.

Every operator takes the current table and returns the next one. ``sources.tables`` keeps such a table in buckets, of which
only the changed ones are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegrid.functions.text import fold, non_empty
from rolegrid.operators import review, scoring
from rolegrid.operators.dedupe import greedy_keep
from rolegrid.operators.lookups import replay_lookups
from rolegrid.operators.matching import with_search_text
from rolegrid.schemas import DEFAULT_RULES, LISTING_ONLY_PREFIX, METADATA_COLUMNS, POSTING, RULE_LISTS
from rolegrid.session import stage

# Texts that carry no information in an update.
UNKNOWN_TEXTS = ("unknown location", "unknown company", "unknown title")
STORED = [f for f in POSTING.fieldNames() if f != "id"]
ENUMS = ("remote_status", "employment_type", "seniority")
KEPT_WHEN_MISSING = (*METADATA_COLUMNS, "score", "score_explanations")


def to_store_columns(postings: DataFrame, seen_at: Column | None = None) -> DataFrame:
    """Bring extracted postings into the shape of the store; times default to ``seen_at``.

    Columns that are not part of the store (for example the order) stay.
    """
    now = seen_at if seen_at is not None else F.current_timestamp()
    defaults = {"job_status": F.lit("active"), "discovered_at": now, "last_seen_at": now}
    missing = {
        f.name: defaults.get(f.name, F.lit(None)).cast(f.dataType)
        for f in POSTING if f.name != "id" and f.name not in postings.columns
    }
    return postings.withColumns(missing) if missing else postings


def backfill(postings: DataFrame) -> DataFrame:
    """Add status and last-seen time to tables written without them (PR9)."""
    if "job_status" not in postings.columns:
        postings = postings.withColumn("job_status", F.lit("active"))
    if "last_seen_at" not in postings.columns:
        first = F.coalesce("discovered_at", "posted_at", F.current_timestamp())
        postings = postings.withColumn("last_seen_at", first)
    return postings


def _informative(value: Column) -> Column:
    return ~fold(F.trim(value)).isin(*UNKNOWN_TEXTS)


def _described(value: Column) -> Column:
    return ~value.startswith(LISTING_ONLY_PREFIX)


def merge_json(old: Column, new: Column) -> Column:
    """Shallow merge of two JSON objects, new wins, keys sorted."""
    kind = "map<string,variant>"
    empty = F.from_json(F.lit("{}"), kind)
    left, right = (F.coalesce(F.from_json(c, kind), empty) for c in (old, new))
    entries = F.concat(
        F.filter(F.map_entries(left), lambda e: ~F.map_contains_key(right, e["key"])), F.map_entries(right)
    )
    ordered = F.transform(F.array_sort(F.transform(entries, lambda e: e["key"])), lambda k: F.struct(
        k.alias("key"), F.coalesce(right[k], left[k]).alias("value")))
    return F.when(old.isNull() | new.isNull(), F.coalesce(new, old)).otherwise(F.to_json(F.map_from_entries(ordered)))


def merged(old: Column, new: Column) -> dict[str, Column]:
    """Field by field result of an update of ``old`` by ``new`` (SK5, LC2)."""
    out = {f: new[f] for f in ("source_site", "url", "title", "company", "posted_at", "discovered_at")}
    out["source_job_id"] = F.coalesce(non_empty(new["source_job_id"]), old["source_job_id"])
    out["location"] = F.when(_informative(new["location"]), new["location"]).otherwise(old["location"])
    for name in ENUMS:
        out[name] = F.when(new[name] == "unknown", old[name]).otherwise(new[name])
    out["job_status"] = F.lit("active")
    out["last_seen_at"] = F.greatest(new["last_seen_at"], old["last_seen_at"])
    keep_old = ~_described(new["description_text"]) & (old["description_text"] != "") & _described(old["description_text"])
    out["description_text"] = F.when(keep_old, old["description_text"]).otherwise(new["description_text"])
    for name in KEPT_WHEN_MISSING:
        out[name] = F.coalesce(new[name], old[name])
    out["extra"] = merge_json(old["extra"], new["extra"])
    return out


def _merged_struct(old: Column, new: Column) -> Column:
    fields = merged(old, new)
    return F.struct(*[fields[name].alias(name) for name in STORED])


# ---- upsert ------------------------------------------------------------------------------------------
#
# Which posting each incoming row meets is found by ``lookups``; what the rows then make of it is an aggregate for each field.


def fold_updates(rows: DataFrame, target: str, order: str) -> DataFrame:
    """One row for each target: its incoming rows folded in order with the update rules, each an aggregate."""

    def last(name: str, condition: Column | None = None) -> Column:
        position = F.col(order) if condition is None else F.when(condition, F.col(order))
        return F.max_by(name, position)

    folds = {f: last(f) for f in ("source_site", "url", "title", "company", "posted_at", "discovered_at", "job_status")}
    folds["source_job_id"] = last("source_job_id", F.col("source_job_id") != "")
    folds["location"] = F.coalesce(last("location", _informative(F.col("location"))), F.min_by("location", order))
    for name in ENUMS:
        folds[name] = F.coalesce(last(name, F.col(name) != "unknown"), F.lit("unknown"))
    folds["last_seen_at"] = F.max("last_seen_at")
    folds["description_text"] = F.coalesce(last("description_text", _described(F.col("description_text"))), last("description_text"))
    for name in KEPT_WHEN_MISSING:
        folds[name] = last(name, F.col(name).isNotNull())
    folded = rows.groupBy(target).agg(*[c.alias(n) for n, c in folds.items()], F.count("*").alias("seen"), F.min(order).alias("first_order"))
    return folded.join(fold_metadata(rows, target, order), target, "left")


def fold_metadata(rows: DataFrame, target: str, order: str) -> DataFrame:
    """``target, extra``: the JSON objects of a target's rows merged key by key, the last value of a key wins."""
    given = rows.where(F.col("extra").isNotNull()).select(target, order, F.explode(F.map_entries(F.from_json("extra", "map<string,variant>"))).alias("e"))
    value = F.to_json(F.struct(F.col("e.value").alias("v")))
    by_key = given.select(target, order, F.col("e.key").alias("k"), value.alias("v")).groupBy(target, "k").agg(F.max_by("v", order).alias("v"))

    def inside(json: Column, frame: int) -> Column:
        """JSON text without its frame: ["k"] to "k", {"v":x} to x."""
        return json.substr(F.lit(frame), F.length(json) - frame)

    text = F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda e: F.concat(inside(F.to_json(F.array(e["k"])), 2), F.lit(":"), inside(e["v"], 6)))
    return by_key.groupBy(target).agg(F.concat(F.lit("{"), F.array_join(text, ","), F.lit("}")).alias("extra"))


def dense_ids(rows: DataFrame, order: str, start: int) -> DataFrame:
    """Number rows ``start, start + 1, ...`` in the given order without sorting them in one task.

    Rows are range-partitioned; each partition is numbered by itself and shifted by the sizes of the
    partitions before it. Only one number per partition is ordered globally.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return placed.join(F.broadcast(shifts), "_part").withColumn("id", inside + F.col("_shift") + F.lit(start - 1)).drop("_part", "_shift")


def upsert_postings(store: DataFrame, incoming: DataFrame, order: str = "seq", last_id: int | None = None) -> dict[str, DataFrame]:
    """Insert new postings, update known ones, as if row by row in order (SK5).

    Returns ``store`` (the next table: ``kept``, stored postings with their changes, and ``added`` ones), ``changed`` (the ids
    that incoming rows met), ``outcome`` (``order``, ``action``: inserted, updated or conflict, one row for each
    incoming row) and ``conflicts`` (the incoming rows in conflict; they change nothing). Incoming urls are expected in
    canonical form; the order has to be unique. New ids follow ``last_id``, by default the greatest one of the store.
    """
    store = store.select("id", *STORED)
    batch = stage(to_store_columns(incoming).select(order, *STORED), "incoming")
    met = stage(replay_lookups(store, batch, order), "met")
    rows = batch.join(met.withColumnRenamed("ord", order), order)
    folded = stage(fold_updates(rows.where("action <> 'conflict'"), "target", order), "folded")
    old = folded.where(F.col("target").startswith("s")).select(F.col("target").substr(F.lit(2), F.length("target")).cast(store.schema["id"].dataType).alias("id"), F.struct(*STORED).alias("new"))
    pieces = store.join(old, "id", "left").withColumn("row", F.struct(*STORED))
    kept = pieces.select("id", F.when(F.col("new").isNull(), F.col("row")).otherwise(_merged_struct(F.col("row"), F.col("new"))).alias("row")).select("id", "row.*")
    if last_id is None:
        last_id = store.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    fresh = folded.where(F.col("target").startswith("n")).withColumnRenamed("first_order", order)
    added = dense_ids(fresh.select(order, *STORED), order, last_id + 1)
    kept, added = kept.select("id", *STORED), added.select("id", *STORED)
    return {
        "store": kept.unionByName(added),
        "kept": kept,
        "added": added,
        "changed": old.select("id"),
        "outcome": met.select(F.col("ord").alias(order), "action"),
        "conflicts": rows.where("action = 'conflict'").select(order, *STORED),
    }


def new_only(store: DataFrame, found: DataFrame) -> DataFrame:
    """Rows absent from the store by url and by source identity (JN10)."""
    identity = ["source_site", "source_job_id"]
    fresh = found.join(store.select("url"), "url", "left_anti")
    with_id = F.col("source_job_id") != ""
    known = store.where(with_id).select(*identity)
    # rows without an id cannot match and skip the shuffle on it
    return fresh.where(with_id).join(known, identity, "left_anti").select(*found.columns).unionByName(
        fresh.where(~F.coalesce(with_id, F.lit(False))).select(*found.columns)
    )


def insert_new_matches(store: DataFrame, found: DataFrame, order: str) -> DataFrame:
    """Rows of ``found`` to append: new to the store, earlier rows of the batch first (SK4)."""
    fresh = stage(new_only(store, found), "fresh")
    identity = F.when(F.col("source_job_id") != "", F.concat(F.lit("i:"), "source_site", F.lit(":"), "source_job_id"))
    keys = F.array_compact(F.array(F.md5(F.concat(F.lit("u:"), "url")), F.md5(identity)))
    return fresh.join(greedy_keep(fresh, order, keys).withColumnRenamed("ord", order), order, "left_semi")


# ---- scores and lifecycle ------------------------------------------------------------------------------


def _last_change(changes: DataFrame, fields: list[str], order: str | None) -> DataFrame:
    """One change for each url: the last one by ``order``; without an order, the greatest by its values."""
    value = F.struct(*fields)
    last = F.max_by(value, order) if order else F.max(value)
    return changes.groupBy("url").agg(last.alias("_change"))


def write_scores(store: DataFrame, scored: DataFrame, order: str | None = None) -> DataFrame:
    """Replace score and explanations of the given urls; of several for one url the last counts (SK7)."""
    new = _last_change(scored, ["score", "score_explanations"], order)
    taken = F.col("_change").isNotNull()
    return (
        store.join(new, "url", "left")
        .withColumns({n: F.when(taken, F.col("_change")[n].cast(store.schema[n].dataType)).otherwise(F.col(n)) for n in ("score", "score_explanations")})
        .select(*store.columns)
    )


def set_status(store: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Replace the status of the given urls; ``changes`` holds ``url, job_status``; the last for a url counts (SK8)."""
    new = _last_change(changes, ["job_status"], order)
    return store.join(new, "url", "left").withColumn("job_status", F.coalesce("_change.job_status", "job_status")).select(*store.columns)


def mark_stale(store: DataFrame, days: int, now: Column, current: DataFrame | None = None, *,
               limit: int | None = None, job_status: str | None = None, **filters) -> dict[str, DataFrame]:
    """Active postings not seen for ``days`` days become stale (LC1).

    Returns the next ``store`` and ``changed`` (the urls). All postings are looked at, unless the caller gives a
    ``limit``. Without a limit and without review filters the store is rewritten by a projection, with no shuffle;
    else the rows meant are marked by their ids.
    """
    if days < 1:
        raise ValueError("days must be at least 1")
    status = job_status or "active"
    old = (F.col("last_seen_at") < now - F.make_dt_interval(F.lit(days))) & (F.col("job_status") != "archived")
    rows = review.newest(review.select_postings(store, current, job_status=status, **filters), limit)
    changed = rows.where(old)
    if limit is None and not filters:
        stale = F.coalesce(old & (F.col("job_status") == status), F.lit(False))
        after = store.withColumn("job_status", F.when(stale, "stale").otherwise(F.col("job_status")))
    else:
        meant = changed.select("id", F.lit("stale").alias("_stale"))
        after = store.join(meant, "id", "left").withColumn("job_status", F.coalesce("_stale", "job_status")).select(*store.columns)
    return {"store": after, "changed": changed.select("url", F.lit("stale").alias("job_status"))}


def rule_set(rules: DataFrame | None = None) -> Column:
    """Scoring criteria of a one-row rule table, or of the default rules, as a literal."""
    given = rules.first().asDict() if rules is not None else DEFAULT_RULES
    named = F.struct(
        *[F.array(*[F.lit(v) for v in (given.get(n) or [])]).cast("array<string>").alias(n) for n in RULE_LISTS]
    )
    return scoring.rule_criteria(named)


def rescore(store: DataFrame, rules: DataFrame | None = None, current: DataFrame | None = None, *,
            limit: int | None = None, **filters) -> dict[str, DataFrame]:
    """Score stored postings again, all of them unless a ``limit`` is given (SC4). Returns the next ``store`` and ``scored``."""
    rows = review.newest(review.select_postings(store, current, **filters), limit)
    scored = scoring.score(with_search_text(rows), rule_set(rules)).select("url", "score", "score_explanations")
    return {"store": write_scores(store, scored), "scored": scored}


def maintenance_summary(**counts: int) -> str:
    """Summary line of a maintenance job (AG5)."""
    if "rescored" in counts:
        return f"Rescored {counts['rescored']} jobs."
    if "stale" in counts:
        return f"Marked {counts['stale']} jobs stale using threshold={counts['days']} days."
    return f"Stored {counts['inserted']} new matched jobs out of {counts['total']} matched."


# ---- prompts and decisions -----------------------------------------------------------------------------


def upsert_prompts(prompts: DataFrame, new: DataFrame) -> DataFrame:
    """First ``created_at``, last text and ``updated_at`` per name (SK9).

    Both tables hold ``name, raw_prompt_text, created_at, updated_at, seq``; ``seq`` is the write order and
    rows already stored come before new ones.
    """
    both = prompts.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    at = F.struct("_new", "seq")
    return both.groupBy("name").agg(
        F.max_by("raw_prompt_text", at).alias("raw_prompt_text"),
        F.min_by("created_at", at).alias("created_at"),
        F.max_by("updated_at", at).alias("updated_at"),
        F.max_by("seq", at).alias("seq"),
    )
