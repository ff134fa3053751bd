"""Merkle manifest of a table with a witness for each row, by aligned appends.

A row's leaf is H of its fields, each as byte count, colon and value, or ``-`` for null; H is SHA-256 of the inputs one
after the other, digests as lower-case hex text. The rows of a group, ascending by key, make a tree: while several nodes
remain, every ``ARITY`` consecutive ones become their H, a last run of fewer too. What remains is the group's subroot;
the subroots by group (null first, then bytewise) make the root the same way.

Method: rows are numbered in their group by a range sort and the sizes of its pieces, without one task for a group.
Blocks of ``ARITY ** HEIGHT`` rows are aligned subtrees, built by one stream of appends each (``Appender``): an open
subtree carries the partial witnesses of its leaves, and a sibling that completes extends them. Roots of blocks are
appended as nodes of the next round, and so on, a factor of 2,187 fewer each time. In a last pass the leaves stream
through their blocks again, and what lies above a block extends their witnesses. Texts are hashed where they are read
and never shuffled; witnesses are made in the last pass and never shuffled either.

Defined results: null fields are ``-``, empty ones ``0:``; a null key comes first; rows of one key are ordered by leaf, and
each of several equal rows is a leaf with its own witness; a single row is its own root with an empty witness; an empty
table has no rows. A witness holds the siblings' digests, 32 bytes each, level by level and left to right.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rolegrid.llm.common import staged

ARITY = 3
HEIGHT = 7
BLOCK = ARITY**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row, 32 bytes."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def parent(digests: Sequence[bytes]) -> bytes:
    return sha256(b"".join(d.hex().encode() for d in digests)).digest()


class Appender:
    """A tree that grows by appends of complete aligned subtrees; ``witness[i]`` is what is known of leaf i's siblings."""

    def __init__(self, witnesses: bool = True):
        self.open: list[list[tuple[bytes, int, int]]] = [[]]
        self.witness: list[bytearray] | None = [] if witnesses else None
        self.leaves = 0

    def append(self, digest: bytes) -> None:
        if self.witness is not None:
            self.witness.append(bytearray())
        self.leaves += 1
        self._attach(0, (digest, self.leaves - 1, self.leaves))

    def _attach(self, level: int, node: tuple[bytes, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        """Turn the open run of a level into its parent; its leaves learn the other nodes of the run."""
        run, self.open[level] = self.open[level], []
        if self.witness is not None and len(run) > 1:
            for i, (_, low, high) in enumerate(run):
                others = b"".join(d for k, (d, _, _) in enumerate(run) if k != i)
                for at in range(low, high):
                    self.witness[at] += others
        self._attach(level + 1, (parent([d for d, _, _ in run]), run[0][1], run[-1][2]))

    def finish(self, height: int | None) -> bytes:
        """Close open runs up to ``height`` levels, or until one node remains; returns its digest."""
        level = 0
        while level < height if height is not None else len(self.open[level]) != 1 or any(self.open[level + 1 :]):
            if self.open[level]:
                self._close(level)
            level += 1
        return self.open[level][0][0]


def fold(digest: bytes, witness: bytes, steps: Sequence[tuple[int, int]]) -> bytes:
    """The root that ``digest`` leads to with the siblings of ``witness``; ``steps`` holds its place and the number of nodes,
    in its group and then of the group among groups."""
    at = 0
    for place, nodes in steps:
        while nodes > 1:
            mine = place % ARITY
            others = min(ARITY, nodes - (place - mine)) - 1
            run = [witness[at + 32 * i : at + 32 * i + 32] for i in range(others)]
            digest = parent([*run[:mine], digest, *run[mine:]])
            at += 32 * others
            place, nodes = place // ARITY, -(-nodes // ARITY)
    return digest


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place``, the number of a row in its group in the given order, and ``nodes``, the size of the group.

    Pieces of a range sort are counted by group; the sums of the pieces before give each piece its first number. The
    counts have one row for each piece and one more for each group.
    """
    position = F.monotonically_increasing_id()
    pieces = staged(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("place", position), "pieces")
    piece = F.shiftright("place", 33)
    sizes = pieces.groupBy(F.col(group).alias("of"), piece.alias("piece")).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("of").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("of", "piece", (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("minus"), F.sum("n").over(Window.partitionBy("of")).alias("nodes"))
    joined = pieces.join(sizes, F.col(group).eqNullSafe(F.col("of")) & (piece == F.col("piece")))
    return joined.select(*rows.columns, (F.col("place") - F.col("minus")).alias("place"), "nodes")


def _streams(rows: DataFrame, at: Sequence[str]) -> DataFrame:
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", *at)


def block_roots(nodes: DataFrame) -> DataFrame:
    """The roots of the blocks of ``nodes`` (grp, place, nodes, digest), as nodes of the next round."""
    dealt = _streams(nodes.select("grp", F.floor(F.col("place") / BLOCK).alias("block"), "place", "nodes", "digest"), ["place"])
    kind = T.StructType([dealt.schema["grp"], *(T.StructField(c, T.LongType()) for c in ("place", "nodes")), T.StructField("digest", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, tree = [], None, None

        def close():
            size = now[2]
            done.append((now[0], now[1], -(-size // BLOCK), tree.finish(HEIGHT if size > BLOCK else None)))

        for batch in batches:
            for grp, block, size, digest in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if now is None or (grp, block) != now[:2]:
                    if tree:
                        close()
                    now, tree = (grp, block, size), Appender(witnesses=False)
                tree.append(digest)
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(("grp", "place", "nodes", "digest"), d)) for d in done], schema=arrow)
                done = []
        if tree:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("grp", "place", "nodes", "digest"), d)) for d in done], schema=arrow)

    arrow = to_arrow_schema(kind)
    return staged(dealt.mapInArrow(run, kind), "roots")


def above_blocks(blocks: DataFrame) -> DataFrame:
    """What lies above each block of a group: ``grp, place, above`` (digests of siblings) and ``top``, the group's subroot."""
    if blocks.where("nodes > 1").isEmpty():
        return blocks.select("grp", "place", F.unhex(F.lit("")).alias("above"), F.col("digest").alias("top"))
    found = witnesses(blocks, above_blocks(block_roots(blocks)))
    return staged(found.select("grp", "place", F.col("witness").alias("above"), "top"), "above")


def witnesses(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` with ``witness``, their siblings up to the top, and the columns of ``above`` (grp, place of the block, above, ...).

    The row of ``above`` comes before the nodes of its block; the witnesses of a block are held until it is complete.
    """
    told = [f for f in above.schema.fields if f.name not in ("grp", "place", "above")]
    own = nodes.schema.fields
    at = {f.name: i for i, f in enumerate(own)}
    pad = lambda fields: [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    head = above.select(F.col("grp"), F.col("place").alias("block"), F.lit(-1).cast("bigint").alias("order_at"), "above", *(f.name for f in told), *(F.lit(None).cast(f.dataType).alias(f"own_{f.name}") for f in own))
    rows = nodes.select("grp", F.floor(F.col("place") / BLOCK).alias("block"), F.col("place").alias("order_at"), F.lit(None).cast("binary").alias("above"), *pad(told), *(F.col(f.name).alias(f"own_{f.name}") for f in own))
    dealt = _streams(head.unionByName(rows), ["order_at"])
    kind = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in own), T.StructField("witness", T.BinaryType()), *told])
    arrow, first = to_arrow_schema(kind), 4 + len(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None

        def close() -> pa.RecordBatch:
            tree.finish(HEIGHT if held and held[0][at["nodes"]] > BLOCK else None)
            proofs = [bytes(w) + now[2] for w in tree.witness]
            columns = [*map(list, zip(*held)), proofs, *([v] * len(held) for v in now[3])]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                if row[2] < 0:
                    if held:
                        yield close()
                    now, held, tree = (row[0], row[1], row[3], row[4:first]), [], Appender()
                    continue
                if now is None or row[:2] != now[:2]:
                    raise ValueError("a node came before what lies above its block")
                held.append(row[first:])
                tree.append(row[first + at["digest"]])
        if held:
            yield close()

    return dealt.mapInArrow(run, kind)


def witnessed(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "source", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``key, grp, digest`` (the leaf), ``carry``, ``place, nodes, witness, top`` (the subroot), ``root``
    and ``group_place, groups``: the place of the subroot."""
    carry = carry or {}
    rows = docs.select(F.col(key).alias("key"), F.col(group).alias("grp"), leaf([F.col(f) for f in fields]).alias("digest"), *(c.alias(n) for n, c in carry.items()))
    # written first: the range sort looks at its rows twice, and texts should be hashed once
    nodes = staged(numbered(staged(rows, "hashed"), "grp", ["key", "digest"]), "leaves")
    above = above_blocks(block_roots(nodes))
    subroots = above.where("place = 0").select(F.lit(0).alias("grp"), F.col("grp").alias("name"), F.col("top").alias("digest"))
    subroots = staged(numbered(subroots, "grp", ["name"]), "subroots")
    roots = witnesses(subroots, above_blocks(block_roots(subroots)))
    roots = roots.select("name", F.col("witness").alias("rest"), F.col("top").alias("root"), F.col("place").alias("group_place"), F.col("nodes").alias("groups"))
    whole = above.join(roots, F.col("grp").eqNullSafe(F.col("name"))).select("grp", "place", F.concat("above", "rest").alias("above"), "top", "root", "group_place", "groups")
    return witnesses(nodes, whole)


def with_folded(rows: DataFrame, name: str, digest: str) -> DataFrame:
    """``rows`` of ``witnessed`` with a last column ``name``: the root to which the column ``digest`` leads with the row's witness."""
    at = {c: i for i, c in enumerate(rows.columns)}
    kind = T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType())])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take = lambda c: batch.column(at[c]).to_pylist()  # noqa: B023, E731
            rows = zip(take(digest), take("witness"), take("place"), take("nodes"), take("group_place"), take("groups"))
            found = [None if d is None else fold(d, w, ((p, n), (q, m))) for d, w, p, n, q, m in rows]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow)), pa.array(found, pa.binary())], schema=arrow)

    return rows.mapInArrow(run, kind)


def as_hex(column: str) -> Column:
    return F.lower(F.hex(F.col(column)))


def proof_table(docs: DataFrame) -> DataFrame:
    """Leaves, roots, digests of the witnesses, and roots folded from texts whose line breaks were deleted in every second row."""
    harmed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").isNotNull()
    text = F.when(harmed, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    again = leaf([text if f == "text" else F.col(f) for f in FIELDS])
    rows = with_folded(witnessed(docs.select(*FIELDS), carry={"again": again}), "folded", "again")
    return rows.select(
        F.col("key").alias("doc_id"), as_hex("digest").alias("leaf"), as_hex("top").alias("subroot"), as_hex("root").alias("root"),
        F.sha2(as_hex("witness"), 256).alias("proof_sha256"), as_hex("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
