"""Embedding near-dedup by lattice hashing: vectors of one label link at a cosine of ``least`` or more.

A table of the index is a random Gaussian projection of the unit vectors to ``blocks`` times eight numbers, with a random
shift; each eight are decoded to the nearest point of the E8 lattice, and the points together name a cell. A vector lives in
its own cell and visits the ``PROBES`` next cells, where one or several points step to one of their 240 neighbours. Two
vectors meet where one lives and the other lives or visits. Cells get finer with more vectors (``blocks`` grows with the
logarithm of the largest label), and there are as many tables as a pair at the threshold needs to meet in one of them with
probability ``RECALL``; that probability depends on nothing but the cosine and is found by simulation (``plan``).

First only names of cells are shuffled; vectors travel to cells where two meet at least. A crowded cell is cut into tiles of
``TILE`` vectors; tile meets tile, in numpy. Every pair that meets is verified by its cosine in double precision and counted
once, in the first table and cell in which it meets, which both vectors tell. A task returns a count for each of its vectors
and, for each component, links to its smallest vector: never a row for each pair.

Equal vectors of a label are one point with a multiplicity; all their copies are linked. Null labels, null or zero vectors
and vectors with null or non-finite components link with nothing; vectors of different length never link. Repeated ids
are different vectors; a null id is never a component id while its component has another one. An empty table gives
an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.common import staged
from rolegrid.llm.neighbours import usable
from rolegrid.operators.components import components
from rolegrid.operators.skew import heavy_keys, salted_join

SEED = 13
#: Width of the lattice against the unit vectors, and cells that a vector visits for each block of its code.
WIDTH = 2.0
PROBES = 8
#: Chance that a pair at the threshold meets.
RECALL = 0.99
#: Share of far pairs that meet in a table of one block, and how many of them a vector may meet before cells get finer.
FAR, CROWD = 0.045, 4096
TILE = 2048


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: two entries of two, or eight of one with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((2, -2), repeat=2):
            out.append([s if k == i else t if k == j else 0 for k in range(8)])
    out.extend(s for s in product((1, -1), repeat=8) if np.prod(s) == 1)
    return np.array(out, np.int64)


ROOTS = roots()


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest points with whole entries and an even sum."""
    near = np.rint(y)
    off = y - near
    worst = np.abs(off).argmax(axis=-1)[..., None]
    step = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0) * (near.sum(axis=-1, keepdims=True) % 2 != 0)
    np.put_along_axis(near, worst, np.take_along_axis(near, worst, -1) + step, -1)
    return near


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8 to the rows of ``y`` (..., 8), doubled: the better of whole and of half entries."""
    whole, half = _even(y), _even(y - 0.5) + 0.5
    nearer = ((y - whole) ** 2).sum(axis=-1) <= ((y - half) ** 2).sum(axis=-1)
    return np.rint(2 * np.where(nearer[..., None], whole, half)).astype(np.int64)


def steps(y: np.ndarray, at: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``y`` (n, blocks, 8) the ``count`` cheapest steps to other cells: for each block the number of a root,
    or -1 to stay; nearest first, without the row that stays everywhere."""
    n, blocks, _ = y.shape
    chosen, cost = np.full((n, 1, 0), -1), np.zeros((n, 1))
    for b in range(blocks):
        rest = y[:, b] - at[:, b] / 2
        along = np.zeros((n, len(ROOTS)))
        for i in range(8):  # sums in a fixed order, so that a vector has the same cells in every batch
            along += rest[:, i, None] * (ROOTS[:, i] / 2.0)
        price = np.concatenate([np.zeros((n, 1)), np.sort(2 - 2 * along, axis=1)[:, :count]], axis=1)
        root = np.concatenate([np.full((n, 1), -1), np.argsort(2 - 2 * along, axis=1, kind="stable")[:, :count]], axis=1)
        both = cost[:, :, None] + price[:, None, :]
        keep = np.argsort(both.reshape(n, -1), axis=1, kind="stable")[:, : count + 1]
        left, right = keep // price.shape[1], keep % price.shape[1]
        rows = np.arange(n)[:, None]
        chosen = np.concatenate([chosen[rows, left], root[rows, right][..., None]], axis=2)
        cost = np.take_along_axis(both.reshape(n, -1), keep, 1)
    return chosen[:, 1:], cost[:, 1:]


class Index:
    """The tables of an index: cells of unit vectors of one length."""

    def __init__(self, dim: int, tables: int, blocks: int):
        rng = np.random.default_rng([SEED, dim, blocks])
        self.tables, self.blocks, self.probes = tables, blocks, PROBES * blocks
        self.projection = [rng.normal(size=(dim, 8 * blocks)) / WIDTH for _ in range(tables)]
        self.shift = [rng.uniform(0, 2, 8 * blocks) for _ in range(tables)]
        self.odd = [rng.integers(0, 2**63, (blocks, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(tables)]

    def _name(self, table: int, points: np.ndarray) -> np.ndarray:
        """A 64-bit name for cells, rows of doubled lattice points (..., blocks, 8)."""
        mixed = (points.astype(np.int64).view(np.uint64) * self.odd[table]).sum(axis=(-1, -2), dtype=np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) + np.uint64(table)).view(np.int64)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Names of the cells of each vector (n, tables, 1 + probes); the first of a table is its own."""
        out = np.empty((len(unit), self.tables, 1 + self.probes), np.int64)
        for t in range(self.tables):
            y = np.zeros((len(unit), 8 * self.blocks)) + self.shift[t]
            for i in range(unit.shape[1]):
                y += unit[:, i, None] * self.projection[t][i]
            y = y.reshape(len(unit), self.blocks, 8)
            for low in range(0, len(unit), 256):
                part = y[low : low + 256]
                at = decode(part)
                step, _ = steps(part, at, self.probes)
                moved = at[:, None] + np.where(step[..., None] >= 0, ROOTS[step], 0)
                out[low : low + 256, t, 0] = self._name(t, at)
                out[low : low + 256, t, 1:] = self._name(t, moved)
        return out


def chance(least: float, blocks: int, pairs: int = 4000) -> float:
    """The share of pairs with the cosine ``least`` that meet in one table."""
    rng = np.random.default_rng([SEED, blocks])
    x = rng.uniform(0, 2, (pairs, blocks, 8))
    y = x + rng.normal(size=x.shape) * math.sqrt(2 - 2 * least) / WIDTH
    a, b = decode(x), decode(y)
    met = (a == b).all(axis=(1, 2))
    for p, q, at in ((x, b, a), (y, a, b)):
        step, _ = steps(p, at, PROBES * blocks)
        moved = at[:, None] + np.where(step[..., None] >= 0, ROOTS[step], 0)
        met |= (moved == q[:, None]).all(axis=(2, 3)).any(axis=1)
    return float(met.mean())


def plan(largest: int, least: float) -> tuple[int, int]:
    """Tables and blocks for an index whose largest label has so many vectors."""
    blocks = max(1, math.ceil(math.log(max(largest, 1) / CROWD) / math.log(1 / FAR)))
    missed = max(1 - chance(least, blocks), 1e-3)
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(missed))), blocks


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length one; no sum or square overflows, and a row does not depend on its neighbours."""
    scaled = vectors / np.abs(vectors).max(axis=1, initial=0, keepdims=True)
    square = np.zeros(len(scaled))
    for x in scaled.T:
        square += x * x
    return scaled / np.sqrt(square)[:, None]


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def with_cells(points: DataFrame, tables: int, blocks: int) -> DataFrame:
    """``grp, node, cells`` of all points, whose vectors have one length for each ``grp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Index] = {}
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():
                at = pa.array(np.flatnonzero(sizes == dim))
                part = batch.take(at)
                index = kept.setdefault(dim, Index(dim, tables, blocks))
                for low in range(0, len(at), 1024):
                    piece = part.slice(low, 1024)
                    cells = index.cells(unit_rows(matrix(piece.column(2), len(piece)))).reshape(len(piece), -1)
                    offsets = np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.ravel()))], ["grp", "node", "cells"])

    return points.select("grp", "node", "v").mapInArrow(run, "grp bigint, node bigint, cells array<bigint>")


class Meeting:
    """A tile of vectors that live in a cell (the host) and all that is compared with it."""

    def __init__(self, table: int, cell: int, least: float, index: Index):
        self.table, self.cell, self.least, self.index = table, cell, least, index
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.nodes = None

    def host(self, nodes: np.ndarray, weight: np.ndarray, unit: np.ndarray) -> None:
        self.parts.append((nodes, weight, unit))

    def settle(self) -> Iterator[pa.RecordBatch]:
        """All rows of the host are there: compare them with each other."""
        self.nodes, self.weight, self.unit = (np.concatenate(x) for x in zip(*self.parts))
        yield from self.compare(self.nodes, self.weight, self.unit, own=True)

    def compare(self, nodes: np.ndarray, weight: np.ndarray, unit: np.ndarray, own: bool = False, guests: bool = False) -> Iterator[pa.RecordBatch]:
        strip = max(1, 262_144 // len(self.nodes))
        for low in range(0, len(nodes), strip):
            near = unit[low : low + strip] @ self.unit.T >= self.least
            j, i = np.nonzero(near)
            j += low
            if own:
                i, j = i[i < j], j[i < j]
            if len(i):
                first = self.meet_first(i, j, unit, guests)
                i, j = i[first], j[first]
            if len(i):
                yield from self.tell(nodes, weight, i, j)

    def meet_first(self, i: np.ndarray, j: np.ndarray, unit: np.ndarray, guests: bool) -> np.ndarray:
        """Which of the pairs (host row i, other row j) meet in no earlier table or cell than this one."""
        here, there = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
        mine, other = self.index.cells(self.unit[here[0]]), self.index.cells(unit[there[0]])
        a, b = here[1], there[1]
        first = np.ones(len(i), bool)
        for t in range(self.table):
            x, y = mine[:, t], other[:, t]
            first &= ~((x[a, :1] == y[b]).any(axis=1) | (y[b, :1] == x[a, 1:]).any(axis=1))
        if guests:
            home = other[b, self.table, 0]
            again = (mine[a, self.table, 1:] == home[:, None]).any(axis=1)
            first &= ~(again & (home < self.cell))
        return first

    def tell(self, nodes: np.ndarray, weight: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts for the nodes of the pairs, and links to the smallest node of each component."""
        names, at = np.unique(np.concatenate([self.nodes[i], nodes[j]]), return_inverse=True)
        p, q = at[: len(i)], at[len(i) :]
        count = np.zeros(len(names), np.int64)
        np.add.at(count, p, weight[j])
        np.add.at(count, q, self.weight[i])
        label, before = np.arange(len(names)), None
        while before is None or (label != before).any():
            before = label.copy()
            low = np.minimum(label[p], label[q])
            np.minimum.at(label, p, low)
            np.minimum.at(label, q, low)
            label = label[label]
        tied = np.flatnonzero(label != np.arange(len(names)))
        a, b = np.concatenate([names, names[tied]]), np.concatenate([names, names[label[tied]]])
        n = np.concatenate([count, np.zeros(len(tied), np.int64)])
        counts = np.arange(len(a)) < len(names)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=counts), pa.array(n)], ["a", "b", "n"])


def meetings(points: DataFrame, cells: DataFrame, tables: int, blocks: int, least: float) -> DataFrame:
    """Rows ``a, b, n``: without ``b`` the number of ``n`` vectors linked to node ``a``, else a link of a component."""
    probes = 1 + PROBES * blocks
    visits = cells.select("grp", "node", F.posexplode("cells").alias("slot", "cell"))
    bucket = F.struct("grp", F.floor(F.col("slot") / probes).cast("int").alias("t"), "cell").alias("bucket")
    visits = staged(visits.select(bucket, "node", (F.col("slot") % probes > 0).alias("guest")), "visits")
    home = F.sum(F.when(F.col("guest"), 0).otherwise(1))
    sizes = visits.groupBy("bucket").agg(home.alias("homes"), F.count("*").alias("n")).where("homes > 0 and n > 1")
    sizes = staged(sizes, "cells")
    busy = salted_join(visits, sizes, "bucket", "inner", heavy_keys(sizes, "bucket"), "node")
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    tile = F.pmod(F.xxhash64("node"), F.when(F.col("guest"), tiles(F.col("n") - F.col("homes"))).otherwise(tiles(F.col("homes")))).cast("int")
    busy = busy.select("bucket", "node", "guest", tile.alias("tile"), tiles(F.col("homes")).alias("hosts"))
    hosts = F.explode(F.when(F.col("guest"), F.sequence(F.lit(0), F.col("hosts") - 1)).otherwise(F.sequence(F.lit(0), F.col("tile"))))
    dealt = busy.select("bucket", "node", "guest", "tile", hosts.alias("host"))
    role = F.when(F.col("guest"), 2).when(F.col("tile") == F.col("host"), 0).otherwise(1)
    dealt = dealt.join(points.select("node", "v", "copies"), "node").select("bucket.*", "host", role.alias("role"), "node", "copies", "v")
    dealt = dealt.repartition("grp", "t", "cell", "host").sortWithinPartitions("grp", "t", "cell", "host", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Index] = {}
        now, meeting = None, None
        for batch in batches:
            key = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:5]], axis=1)
            cuts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                grp, t, cell, host, role = key[low].tolist()
                part = batch.slice(low, high - low)
                unit = unit_rows(matrix(part.column(7), len(part)))
                nodes, copies = (part.column(i).to_numpy(zero_copy_only=False) for i in (5, 6))
                if (grp, t, cell, host) != now:
                    if meeting is not None and meeting.nodes is None:
                        yield from meeting.settle()
                    if role:
                        raise ValueError("a guest came before its host")
                    dim = unit.shape[1]
                    now, meeting = (grp, t, cell, host), Meeting(t, cell, least, kept.setdefault(dim, Index(dim, tables, blocks)))
                if role == 0:
                    meeting.host(nodes, copies, unit)
                    continue
                if meeting.nodes is None:
                    yield from meeting.settle()
                yield from meeting.compare(nodes, copies, unit, guests=role == 2)
        if meeting is not None and meeting.nodes is None:
            yield from meeting.settle()

    return staged(dealt.mapInArrow(run, "a bigint, b bigint, n bigint"), "meetings")


def near_copies(table: DataFrame, least: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of ``table``: ``vec_id, n_links`` (other vectors linked directly), ``component_id`` (the smallest id reachable,
    its own included) and ``kept``, true for the one of a component whose id that is."""
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), F.when(usable(F.col(vector)) & F.col(label).isNotNull(), F.xxhash64(F.col(label), F.size(F.col(vector)))).alias("grp"))
    whole = F.concat(F.hex(F.xxhash64("grp", "v")), F.lit("-"), F.hex(F.xxhash64(F.lit(SEED), "v", "grp")))
    rows = rows.withColumn("vkey", F.when(F.col("grp").isNotNull(), whole))
    points = rows.where("grp is not null").groupBy("grp", "vkey").agg(F.any_value("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    points = staged(points.withColumn("node", F.monotonically_increasing_id()), "points")
    largest = points.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    tables, blocks = plan(largest, least)
    met = meetings(points, staged(with_cells(points, tables, blocks), "coded"), tables, blocks, least)
    links = met.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    tied = components(met.where("b is not null").select("a", "b"))
    found = points.select("vkey", "node", "copies", "least_id").join(links, "node", "left").join(tied, "node", "left")
    found = staged(found.select("vkey", "least_id", "copies", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "found")
    smallest = found.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = found.join(smallest, "root").select("vkey", "n_links", "component_id", F.lit(True).alias("in"))
    heavy = heavy_keys(points.select("vkey", F.col("copies").alias("n")), "vkey")
    out = salted_join(rows.select("vkey", "vec_id"), found, "vkey", "left", heavy, "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("in"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
