"""Which stored posting each incoming row of an upsert meets, as if row by row in order.

An upsert looks up one incoming row after the other: by url first, then by source id, in the store as the rows before have
left it. What a row meets depends on keys alone, and only on rows that it is connected with by shared keys. Rows with the
same url and source id (a combination) always go the same way, so the components are found over combinations, of which a
hot key has few or many, but never one for each row. Then

- a component with one combination and at most one stored posting needs no order: its first row inserts, if nothing is
  stored, all others update. This is an aggregate;
- other components of up to ``SEGMENT`` rows are replayed in order, each by one task;
- larger ones are cut in segments of consecutive rows that are replayed in parallel. What the store looks like at the start of a
  segment is first guessed from the stored postings, then taken from what the segments before have written, until no
  guess changes. Consecutive rows of one combination count as one. Postings that a segment finds have symbolic names, ``in:`` and their url; at last the names are followed
  back to the segment, or the stored posting, where they come from, doubling the step each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolegrid.operators.components import components, shared_key_edges
from rolegrid.operators.skew import heavy_keys, salted_join
from rolegrid.session import stage

#: Rows of a component that one task replays.
SEGMENT = 50_000
FOUND = "ord {kind}, target string, action string"


def key_list(df: DataFrame) -> Column:
    """The keys of a posting: its url, and its site with its source id if there is one."""
    identity = F.when(F.col("source_job_id") != "", F.concat(F.lit("i:"), "source_site", F.lit(":"), "source_job_id"))
    return F.array_compact(F.array(F.concat(F.lit("u:"), "url"), identity))


class Lookups:
    """The keys of a component's postings while rows are looked up; built in the tasks."""

    def __init__(self):
        self.at: dict[tuple, str] = {}
        self.held: dict[str, tuple[tuple, str | None]] = {}
        self.written: set[tuple] = set()

    def put(self, name: str, url: str, site: str, job: str | None) -> None:
        """A posting that is there at the start; of two with one key the first holds it."""
        keys = (("u", url),) + ((("i", site, job),) if job else ())
        self.held[name] = keys, job or None
        for key in keys:
            self.at.setdefault(key, name)

    def meet(self, row: str, url: str, site: str, job: str | None) -> tuple[str | None, str]:
        job = job or None
        by_url = self.at.get(("u", url))
        by_id = self.at.get(("i", site, job)) if job else None
        if by_url and by_id and by_url != by_id:
            return None, "conflict"
        target = by_url or by_id or row
        known = target in self.held
        old_keys, old_job = self.held.get(target, ((), None))
        for key in old_keys:
            if self.at.get(key) == target:
                del self.at[key]
                self.written.add(key)
        job = job or old_job
        keys = (("u", url),) + ((("i", site, job),) if job else ())
        self.held[target] = keys, job
        for key in keys:
            self.at[key] = target
            self.written.add(key)
        return target, "updated" if known else "inserted"

    def writes(self) -> Iterator[tuple]:
        """What was written: key, then url, site, id and name of the posting that holds it now, or nulls."""
        for key in sorted(self.written):
            name = self.at.get(key)
            if name is None:
                yield key, None, None, None, None
            else:
                keys, job = self.held[name]
                yield key, keys[0][1], keys[1][1] if len(keys) > 1 else None, job, name


NARROW = ["url", "source_site", "source_job_id"]


def _replay(group: list[str], tell_writes: bool):
    """Replay rows ``*group, start, ord, row, url, source_site, source_job_id`` by group, those with ``start`` first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kind = None, None, None
        for batch in batches:
            out, writes, kind = [], [], batch.schema.field("ord").type
            columns = [batch.column(n).to_pylist() for n in (*group, "start", "ord", "row", *NARROW)]
            for values in zip(*columns):
                name, (start, order, row, url, site, job) = values[: len(group)], values[len(group) :]
                if name != now:
                    if tell_writes and state:
                        writes.extend((*now, *w) for w in state.writes())
                    now, state = name, Lookups()
                if start:
                    state.put(row, url, site, job)
                else:
                    out.append((*name, order, *state.meet(row, url, site, job)))
            yield from told(kind, out, writes)
        if tell_writes and state:
            yield from told(kind, [], [(*now, *w) for w in state.writes()])

    def told(kind, out, writes) -> Iterator[pa.RecordBatch]:
        if not tell_writes:
            if out:
                _, orders, targets, actions = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(orders, kind), pa.array(targets, pa.string()), pa.array(actions, pa.string())], ["ord", "target", "action"])
            return
        rows = [(c, p, o, t, a, None, None, None, None, None, None) for c, p, o, t, a in out]
        rows += [(c, p, None, None, None, ":".join(("u", k[1]) if k[0] == "u" else ("i", k[1], k[2])), k[1] if k[0] == "u" else None, u, s, j, n) for c, p, k, u, s, j, n in writes]
        if rows:
            names = ["component", "segment", "ord", "target", "action", "key", "key_url", "url", "source_site", "source_job_id", "name"]
            kinds = [pa.string(), pa.int32(), kind, *[pa.string()] * 8]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def replay_lookups(store: DataFrame, batch: DataFrame, order: str, segment: int | None = None) -> DataFrame:
    """``ord, target, action`` for each incoming row: the posting it meets and whether that inserted, updated or is
    in conflict (JN9). Targets are ``s<id>`` for stored rows and ``n<order>`` for the row that inserts a posting.

    A row in conflict meets one posting by url and another by source id; it changes nothing. Stored rows come in
    only if they share a key with the batch.
    """
    segment = segment or SEGMENT
    kind = batch.schema[order].dataType
    rows = batch.select(F.col(order).alias("ord"), *NARROW)
    rows = rows.withColumn("combo", F.concat_ws("\x00", *[F.coalesce(c, F.lit("")) for c in NARROW]))
    incoming = stage(
        rows.groupBy("combo").agg(*[F.first(c).alias(c) for c in NARROW], F.min("ord").alias("first"), F.count("*").alias("n"))
        .withColumn("row", F.concat(F.lit("n"), F.col("first").cast("string"))),
        "combinations",
    )
    keys = incoming.select(F.explode(key_list(incoming)).alias("key")).distinct()
    kept = store.select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("row"), F.col("id").cast("bigint").alias("id"), *NARROW)
    touched = kept.select("row", F.explode(key_list(kept)).alias("key")).join(keys, "key", "left_semi").select("row").distinct()
    stored = stage(kept.join(touched, "row", "left_semi"), "stored")

    nodes = incoming.select("row", *NARROW).unionByName(stored.select("row", *NARROW))
    pairs = nodes.select("row", F.explode(key_list(nodes)).alias("key"))
    tied = components(shared_key_edges(pairs, "row", "key"))
    # joined again where it is used: combinations are narrow, another written copy costs more
    placed = lambda df: df.join(tied.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("root", "row")).drop("root")
    incoming, stored = placed(incoming), placed(stored)
    sizes = incoming.groupBy("component").agg(F.count("*").alias("combos"), F.sum("n").alias("rows"), F.min("first").alias("begin"))
    sizes = sizes.join(stored.groupBy("component").agg(F.count("*").alias("held"), F.min("row").alias("one")), "component", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    # of stored postings that share a key the first holds it; a component with such ones is never cut
    twice = stored.select("component", F.explode(key_list(stored)).alias("key")).groupBy("component", "key").agg(F.count("*").alias("n"))
    sizes = sizes.join(twice.where("n > 1").select("component", F.lit(True).alias("odd")).distinct(), "component", "left")
    plain = (F.col("combos") == 1) & (F.col("held") <= 1)
    whole = (F.col("rows") <= segment) | F.coalesce("odd", F.lit(False))
    sizes = stage(sizes.withColumn("way", F.when(plain, "plain").when(whole, "whole").otherwise("cut")), "components")

    heavy = heavy_keys(incoming.select("combo", "n"), "combo")
    ways = incoming.join(sizes.select("component", "way", "begin", "one"), "component").select("combo", "component", "way", "begin", "one")
    rows = salted_join(rows, ways, "combo", "inner", heavy, "ord").withColumn("row", F.concat(F.lit("n"), F.col("ord").cast("string")))
    ways_met = {r["way"] for r in sizes.select("way").distinct().collect()}
    if ways_met - {"plain"}:
        rows = stage(rows, "lookups")
    target = F.coalesce("one", F.concat(F.lit("n"), F.col("begin").cast("string")))
    action = F.when(F.col("one").isNull() & (F.col("ord") == F.col("begin")), "inserted").otherwise("updated")
    found = rows.where("way = 'plain'").select("ord", target.alias("target"), action.alias("action"))

    nothing = F.lit(None).cast(kind).alias("ord")
    if "whole" in ways_met:
        begin = stored.join(sizes.where("way = 'whole'").select("component"), "component", "left_semi")
        whole = rows.where("way = 'whole'").select("component", F.lit(False).alias("start"), F.lit(None).cast("bigint").alias("id"), "ord", "row", *NARROW)
        whole = whole.unionByName(begin.select("component", F.lit(True).alias("start"), "id", nothing, "row", *NARROW))
        ordered = whole.repartition("component").sortWithinPartitions("component", F.desc("start"), "id", "ord")
        found = found.unionByName(ordered.mapInArrow(_replay(["component"], False), FOUND.format(kind=kind.simpleString())))
    if "cut" in ways_met:
        begin = stored.join(sizes.where("way = 'cut'").select("component"), "component", "left_semi")
        found = found.unionByName(cut_replay(rows.where("way = 'cut'").select("component", "ord", "row", "combo", *NARROW), begin, segment))
    return found


def _runs():
    """Number the runs of equal combinations in each piece of ordered rows; ``run`` is the ``ord`` of the first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = None, None
        for batch in batches:
            runs, at = [], batch.schema.names.index("ord")
            for piece, component, combo, order in zip(*(batch.column(n).to_pylist() for n in ("segment", "component", "combo", "ord"))):
                if (piece, component, combo) != now:
                    now, first = (piece, component, combo), order
                runs.append(first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, batch.schema.field(at).type)], [*batch.schema.names, "run"])

    return run


def cut_replay(rows: DataFrame, stored: DataFrame, segment: int) -> DataFrame:
    """``ord, target, action`` of the rows of large components (``component, ord, row, combo, ...``), in segments."""
    kind = rows.schema["ord"].dataType
    pieces = max(1, -(-rows.count() // segment))
    ranged = rows.repartitionByRange(pieces, "component", "ord").sortWithinPartitions("component", "ord").withColumn("segment", F.spark_partition_id())
    ranged = stage(ranged.mapInArrow(_runs(), T.StructType([*ranged.schema.fields, T.StructField("run", kind)])), "runs")
    events = ranged.where(F.col("ord") == F.col("run")).select("component", "segment", "ord", "row", *NARROW)

    events = stage(events, "events")
    # the stored postings are what was written before the first segment
    holding = stage(stored.select("component", F.lit(-1).alias("segment"), F.explode(key_list(stored)).alias("key"), *NARROW, F.col("row").alias("name")), "holding")
    touched = stage(events.select("component", "segment", F.explode(key_list(events)).alias("key")).distinct(), "touched")
    schema = T.StructType([
        T.StructField("component", T.StringType()), T.StructField("segment", T.IntegerType()), T.StructField("ord", kind), T.StructField("target", T.StringType()), T.StructField("action", T.StringType()),
        *(T.StructField(c, T.StringType()) for c in ("key", "key_url", *NARROW, "name")),
    ])
    writes, before = holding, None
    while True:
        asked = touched.withColumn("asks", F.lit(True))
        known = writes.select("component", "segment", "key", F.struct("url", "source_site", "source_job_id").alias("now")).withColumn("asks", F.lit(False))
        earlier = Window.partitionBy("component", "key").orderBy("segment").rangeBetween(Window.unboundedPreceding, -1)
        seen = asked.withColumn("now", F.lit(None).cast(known.schema["now"].dataType)).unionByName(known).withColumn("found", F.last(F.when(~F.col("asks"), F.col("now")), True).over(earlier))
        begin = seen.where("asks and found.url is not null").select("component", "segment", "found.*").distinct()
        begin = stage(begin, "begin")
        mark = begin.agg(F.count("*"), F.sum(F.xxhash64("component", "segment", *NARROW).cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        start = begin.select("component", "segment", F.lit(True).alias("start"), F.lit(None).cast(kind).alias("ord"), F.concat(F.lit("in:"), "url").alias("row"), *NARROW)
        both = start.unionByName(events.withColumn("start", F.lit(False)))
        ordered = both.repartition("component", "segment").sortWithinPartitions("component", "segment", F.desc("start"), "ord", *NARROW)
        told = stage(ordered.mapInArrow(_replay(["component", "segment"], True), schema), "told")
        writes = holding.unionByName(told.where("key is not null").select("component", "segment", "key", *NARROW, "name"))
    return _named(ranged, told, writes)


def _named(ranged: DataFrame, told: DataFrame, writes: DataFrame) -> DataFrame:
    """Follow names back to where they come from, and give every row the result of its run."""
    results = told.where("key is null").select("component", "segment", "ord", "target", "action")
    urls = writes.where(F.col("key") == F.concat(F.lit("u:"), "url")).select("component", "segment", "url", "name")
    symbol = lambda c: F.when(F.col(c).startswith("in:"), F.expr(f"substr({c}, 4)"))
    asked = results.select("component", "segment", symbol("target").alias("url")).union(urls.select("component", "segment", symbol("name"))).where("url is not null").distinct()
    earlier = Window.partitionBy("component", "url").orderBy("segment").rangeBetween(Window.unboundedPreceding, -1)
    origin = F.last(F.when(F.col("name").isNotNull(), F.struct("segment", "name")), True).over(earlier)
    both = asked.withColumn("name", F.lit(None).cast("string")).withColumn("asks", F.lit(True)).unionByName(urls.withColumn("asks", F.lit(False)))
    links = both.withColumn("origin", origin).where("asks").select("component", "segment", "url", F.col("origin.segment").alias("to_segment"), F.col("origin.name").alias("to_name"))
    links = stage(links, "names")
    while not links.where(F.col("to_name").startswith("in:")).isEmpty():
        far = links.select("component", F.col("segment").alias("to_segment"), F.concat(F.lit("in:"), "url").alias("to_name"), F.struct("to_segment", "to_name").alias("far"))
        jumped = links.join(far, ["component", "to_segment", "to_name"], "left")
        links = stage(jumped.select("component", "segment", "url", F.coalesce("far.to_segment", "to_segment").alias("to_segment"), F.coalesce("far.to_name", "to_name").alias("to_name")), "names")
    real = links.select("component", "segment", F.concat(F.lit("in:"), "url").alias("target"), "to_name")
    results = results.join(real, ["component", "segment", "target"], "left").withColumn("target", F.coalesce("to_name", "target"))
    results = results.select(F.col("ord").alias("run"), "target", F.col("action").alias("first_action"))
    later = F.when(F.col("first_action") == "conflict", "conflict").otherwise("updated")
    action = F.when(F.col("ord") == F.col("run"), F.col("first_action")).otherwise(later)
    return ranged.select("ord", "run").join(results, "run").select("ord", "target", action.alias("action"))
