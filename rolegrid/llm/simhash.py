"""SimHash near-dedup: 64-bit fingerprints of three-word shingles, linked by tiled exact comparison.

Words are runs of anything but ASCII white space, A-Z lowered; a shingle is three words joined by spaces (all words,
if fewer); its hash is XXH64 with seed 42; bit b of a fingerprint is 1 if b is set in over half of the hashes,
repeats included. A text without words has fingerprint zero. Fingerprints link at ``radius`` differing bits or fewer.

Comparison: distinct fingerprints are put in cells by the population counts of equal parts of their bits. Two
fingerprints differ in at least as many bits as their counts differ over all parts, so cells further apart than the
radius are skipped; all others meet tile by tile (numpy exclusive-or and bit counts). A task returns a spanning
forest of the links it finds, never all pairs. Components are found by min-label steps with shortcutting in Spark.

A fingerprint says little of a short or a much edited text. With ``similarity`` the links are between distinct texts,
equal fingerprints too, and each must be confirmed: the texts share that part of all their distinct shingles of five
words, counted in full. Only confirmed links join texts. Candidates are the pairs at ``radius`` bits or fewer, and at
twice that together with a second fingerprint of other hashes, whose numbers of shingles allow the similarity; both
fingerprints count distinct shingles once here, as the similarity does. Where candidates are few, they are confirmed by a join
with the shingles of their texts. Where a block of a tile has many, its texts are held back and meet again tile by tile with
their shingles: an upper bound of what two texts share (counts of shingles by hash bucket) drops pairs that cannot reach the
similarity, the others are counted in full in the task, and only confirmed links that join two trees leave it. So
the rows of every join grow with the texts, however many candidates a group has.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a null id never becomes
a component id while the component has another; repeated rows stay, each with its class; an empty table gives an
empty table. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolegrid.llm.common import free_name, map_batches, staged, texts

SEED = 42
BITS = 64
#: Fingerprints of one cell that are compared as one tile.
TILE = 2048
#: Candidates for each text of a block that are confirmed by a join; beyond that the texts are held back.
SPARE = 2
#: Shingles of the texts of a tile that travels with its shingles, and of a row on the way.
HEAVY_TILE, SLICE = 1 << 21, 1024


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """The hashes of a text's shingles in order, repeats included."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, "<u8")
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
        starts = [0, *(ends[: len(tokens) - words] + 1).tolist()]
        stops = [*ends[words - 1 :].tolist(), len(joined)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, stops)]
    return np.array(hashes, "<u8")


def majority(values: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(values), 65536):
        ones += np.unpackbits(values[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Other hashes made from hashes, for a second fingerprint."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """The hashes of the distinct shingles of a text, all of them."""
    return np.unique(shingle_hashes(text, words)).view(np.int64)


def with_fingerprint(docs: DataFrame, name: str, text: str = "text", words: int = 3) -> DataFrame:
    """``docs`` with a last column ``name``: the fingerprint as a signed long."""
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch):
        prints = np.array([fingerprint(t, words) for t in texts(batch.column(at))], np.uint64).view(np.int64)
        return [*batch.columns, pa.array(prints)]

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def with_both_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` without its column ``text``; ``f`` is the fingerprint, ``p`` and ``g`` are two of distinct shingles for the
    search, ``n`` counts the distinct shingles of five words."""
    at, rest = docs.columns.index("text"), docs.drop("text")

    def run(batch: pa.RecordBatch):
        found = []
        for t in texts(batch.column(at)):
            hashes = shingle_hashes(t, words)
            distinct = np.unique(hashes)
            found.append((majority(hashes), majority(distinct), majority(mixed(distinct)), len(shingle_set(t))))
        numbers = np.array(found, np.uint64).reshape(-1, 4).T.copy().view(np.int64)
        return [*(c for i, c in enumerate(batch.columns) if i != at), *map(pa.array, numbers)]

    return map_batches(docs, run, T.StructType([*rest.schema.fields, *(T.StructField(c, T.LongType()) for c in "fpgn")]))


def cell_parts(n: int, radius: int) -> int:
    """Into how many parts the bits are cut; more fingerprints get finer cells. No choice changes the result.

    A cell is sent to all cells within the radius, so a wide radius keeps to two parts, and one that skips next to
    nothing to one.
    """
    if radius > 12:
        return 1
    return 2 if n <= 50_000 or radius > 3 else 4 if n <= 5_000_000 else 8


def cell_of(fingerprint_column: Column, parts: int) -> Column:
    """Population counts of equal parts of the bits, as one number in base 65."""
    if parts == 1:
        return F.bit_count(fingerprint_column).cast("bigint")
    width = BITS // parts
    out = F.lit(0).cast("bigint")
    for i in range(parts):
        part = F.shiftrightunsigned(fingerprint_column, i * width).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        out = out * 65 + F.bit_count(part)
    return out


def half_ball(parts: int, radius: int) -> list[int]:
    """Steps from a cell to itself and to one half of the cells within ``radius``; the others step to it."""
    out = []

    def walk(step: int, left: int, depth: int) -> None:
        if depth == parts:
            out.append(step)
            return
        for s in range(-left, left + 1):
            walk(step * 65 + s, left - abs(s), depth + 1)

    walk(0, radius, 0)
    return sorted(s for s in out if s >= 0)


class Forest:
    """Union-find over fingerprints; ``links`` are those that joined two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = up = self.parent.get(up, up)
            x = up
        return x

    def add(self, p: int, q: int) -> None:
        a, b = self.root(p), self.root(q)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((p, q))


def compare(a: np.ndarray, b: np.ndarray, radius: int, forest: Forest) -> None:
    """All pairs of two tiles, nearest first; blocks of rows skip what differs too much in population count.

    Pairs of one distance are joined as in Boruvka's algorithm: each tree takes one link to another tree a round.
    """
    a, b = (x[np.argsort(np.bitwise_count(x), kind="stable")] for x in (a, b))
    pop, high = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    met = []
    for i in range(0, len(a), 256):
        rows = a[i : i + 256]
        low, top = np.searchsorted(high, [pop[i] - radius, pop[min(i + 255, len(a) - 1)] + radius + 1])
        apart = np.bitwise_count(rows[:, None] ^ b[None, low:top])
        x, y = np.nonzero(apart <= radius)
        if len(x):
            met.append((rows[x], b[low + y], apart[x, y]))
    if not met:
        return
    p, q, apart = (np.concatenate(m) for m in zip(*met))
    for distance in range(1, radius + 1):
        at = apart == distance
        left, right = p[at], q[at]
        while len(left):
            names, of = np.unique(np.concatenate([left, right]), return_inverse=True)
            roots = np.array([forest.root(v) for v in names.view(np.int64).tolist()], np.int64)[of]
            mine, other = roots[: len(left)], roots[len(left) :]
            open_ = mine != other
            left, right, mine = left[open_], right[open_], mine[open_]
            _, first = np.unique(mine, return_index=True)
            for v, w in zip(left[first].view(np.int64).tolist(), right[first].view(np.int64).tolist()):
                forest.add(v, w)


def dealt(rows: DataFrame, columns: list[str], radius: int, n: int) -> DataFrame:
    """Every tile of ``rows`` as host, followed by itself and by the tiles to compare it with: ``at_cell, at_tile, guest, members``.

    ``members`` has the values of ``columns``, longs of which the first is the fingerprint ``f``, row after row.
    """
    parts = cell_parts(n, radius)
    size = TILE if n <= 100_000 or parts > 1 else 4 * TILE
    celled = rows.withColumn("cell", cell_of(F.col("f"), parts))
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("tiles"))
    tile = F.pmod(F.xxhash64(*columns), F.col("tiles")).cast("int").alias("tile")
    listed = F.flatten(F.collect_list(F.array(*columns)))
    tiles = staged(celled.join(sizes, "cell").select("cell", tile, *columns).groupBy("cell", "tile").agg(listed.alias("members")), "tiles")
    index = tiles.select("cell", "tile")
    steps = F.explode(F.array(*[F.lit(s).cast("bigint") for s in half_ball(parts, radius)]))
    to = index.select(F.col("cell").alias("at_cell"), F.col("tile").alias("at_tile"), steps.alias("step")).withColumn("cell", F.col("at_cell") + F.col("step"))
    pairs = to.join(index, "cell").where("step > 0 or tile > at_tile").select("at_cell", "at_tile", "cell", "tile")
    guests = tiles.join(pairs, ["cell", "tile"]).select("at_cell", "at_tile", F.lit(1).alias("guest"), "members")
    hosts = tiles.select(F.col("cell").alias("at_cell"), F.col("tile").alias("at_tile"), F.lit(0).alias("guest"), "members")
    return hosts.unionByName(guests).repartition("at_cell", "at_tile").sortWithinPartitions("at_cell", "at_tile", "guest")


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``a, b`` between values of the single column of ``prints``, enough to connect all that is connected."""
    distinct = staged(prints.toDF("f").where("f is not null").distinct(), "fingerprints")

    def run(batches):
        now, host, forest = None, None, Forest()
        for batch in batches:
            lists = batch.column(3)
            bounds = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for i, at in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]))):
                members = values[bounds[i] : bounds[i + 1]]
                if at[2] == 0:
                    now, host, forest = at[:2], members.copy(), Forest()
                if at[:2] != now:
                    raise ValueError("a tile came before its host")
                forest.links = []
                compare(host, members, radius, forest)
                if forest.links:
                    a, b = zip(*forest.links)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt(distinct, ["f"], radius, distinct.count()).mapInArrow(run, "a bigint, b bigint")


def by_population(prints: np.ndarray) -> np.ndarray:
    return np.argsort(np.bitwise_count(prints.view(np.uint64)), kind="stable")


def near(host: np.ndarray, guest: np.ndarray, radius: int, similarity: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The candidates of two tiles, block by block: row numbers of host and guest, nearest first.

    Rows are ``f, g, n, node, ...`` by population count of ``f``; a last ``root``, if there is one, tells texts that are joined already.
    """
    print_a, print_b = np.ascontiguousarray(host[:, 0]).view(np.uint64), np.ascontiguousarray(guest[:, 0]).view(np.uint64)
    pop, high = np.bitwise_count(print_a).astype(np.int64), np.bitwise_count(print_b).astype(np.int64)
    for i in range(0, len(host), 256):
        low, top = np.searchsorted(high, [pop[i] - radius, pop[min(i + 255, len(host) - 1)] + radius + 1])
        apart = np.bitwise_count(print_a[i : i + 256, None] ^ print_b[None, low:top])
        x, y = np.nonzero(apart <= radius)
        apart = apart[x, y].astype(np.int64)
        x, y = x + i, y + low
        p, q = host[x], guest[y]
        apart += np.bitwise_count((p[:, 1] ^ q[:, 1]).view(np.uint64))
        fit = (apart <= 2 * radius) & (np.minimum(p[:, 2], q[:, 2]) >= similarity * np.maximum(p[:, 2], q[:, 2]))
        if host.shape[1] > 4:
            fit &= p[:, 4] != q[:, 4]
        if same:
            fit &= p[:, 3] < q[:, 3]
        order = np.argsort(apart[fit], kind="stable")
        if len(order):
            yield x[fit][order], y[fit][order]


def candidates(nodes: DataFrame, radius: int, similarity: float, n: int) -> DataFrame:
    """Pairs ``a, b`` of nodes (``f, g, n, node``) to check; a row without ``b`` says that ``a`` has too many and is held back."""
    width = len(nodes.columns)

    def run(batches):
        now, host, told, spare = None, None, set(), []

        def settle():
            """The host has met all its guests. A pair of two texts that are held back meets in the next pass."""
            a, b = (np.concatenate([s[i] for s in spare]) if spare else np.empty(0, np.int64) for i in (0, 1))
            held = np.array(sorted(told), np.int64)
            open_ = ~(np.isin(a, held) & np.isin(b, held))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a[open_], held])), pa.array([*b[open_].tolist(), *[None] * len(held)], pa.int64())], ["a", "b"])

        for batch in batches:
            lists = batch.column(3)
            bounds = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            for i, at in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]))):
                members = values[bounds[i] : bounds[i + 1]].reshape(-1, width)
                members = members[by_population(np.ascontiguousarray(members[:, 0]))]
                if at[2] == 0:
                    if now is not None:
                        yield settle()
                    now, host, told, spare = at[:2], members, set(), []
                if at[:2] != now:
                    raise ValueError("a tile came before its host")
                # a host is followed by itself as its first guest: it comes once, as host
                for x, y in near(host, members, radius, similarity, at[2] == 0):
                    a, b = host[x, 3], members[y, 3]
                    met = np.unique(np.concatenate([a, b]))
                    if len(a) > SPARE * len(met):
                        told.update(met.tolist())
                    else:
                        spare.append((a, b))
        if now is not None:
            yield settle()

    return dealt(nodes, nodes.columns, radius, n).mapInArrow(run, "a bigint, b bigint")


class ShingleTile:
    """Texts of a tile with all their shingles: rows ``f, g, n, node, root`` by population count, ``sets`` beside."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, list[np.ndarray]]] = []
        self.cache: dict[int, np.ndarray] = {}

    def add(self, rows: np.ndarray, slices: list[np.ndarray]) -> None:
        self.parts.append((rows, slices))

    def close(self) -> "ShingleTile":
        """Put the slices of each text together; they come one after the other."""
        rows, slices = np.concatenate([r for r, _ in self.parts]), [v for _, s in self.parts for v in s]
        first = np.flatnonzero(np.concatenate([[True], rows[1:, 3] != rows[:-1, 3]]))
        stops = [*first[1:].tolist(), len(rows)]
        sets = [np.sort(np.concatenate(slices[a:b])) for a, b in zip(first.tolist(), stops)]
        order = by_population(np.ascontiguousarray(rows[first, 0]))
        self.rows, self.sets, self.parts = rows[first][order], [sets[i] for i in order.tolist()], []
        return self

    def counts(self, buckets: int) -> np.ndarray:
        """How many shingles each text has in each hash bucket."""
        if buckets not in self.cache:
            sizes = np.array([len(s) for s in self.sets])
            text = np.repeat(np.arange(len(self.sets)), sizes)
            bucket = (np.concatenate(self.sets).view(np.uint64) >> np.uint64(20)) & np.uint64(buckets - 1)
            table = np.bincount(text * buckets + bucket.astype(np.int64), minlength=len(self.sets) * buckets)
            self.cache = {buckets: table.astype(np.min_scalar_type(int(table.max(initial=0)))).reshape(-1, buckets)}
        return self.cache[buckets]

    def buckets(self) -> int:
        """About twice the shingles of a text, a power of two."""
        mean = sum(map(len, self.sets)) / len(self.sets)
        return 1 << int(np.clip(np.ceil(np.log2(2 * mean + 1)), 6, 13))


def confirm(host: ShingleTile, guest: ShingleTile, radius: int, similarity: float, forest: Forest) -> None:
    """Add the confirmed links of two tiles to ``forest``: pairs in one tree are left out, and those that a bound excludes."""
    buckets = max(host.buckets(), guest.buckets())
    for x, y in near(host.rows, guest.rows, radius, similarity, host is guest):
        for low in range(0, len(x), 4096):
            p, q = x[low : low + 4096], y[low : low + 4096]
            both = host.rows[p, 2] + guest.rows[q, 2]
            most = np.minimum(host.counts(buckets)[p], guest.counts(buckets)[q]).sum(axis=1, dtype=np.int64)
            able = most >= similarity * (both - most) - 1e-9
            for i, j, n in zip(p[able].tolist(), q[able].tolist(), both[able].tolist()):
                a, b = int(host.rows[i, 4]), int(guest.rows[j, 4])
                if forest.root(a) != forest.root(b):
                    shared = len(np.intersect1d(host.sets[i], guest.sets[j], assume_unique=True))
                    if shared >= similarity * (n - shared):
                        forest.add(a, b)


def confirmed_in_tiles(held: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Confirmed links ``a, b`` between roots of ``held`` (``f, g, n, node, root, shingles``): enough to connect all that is connected.

    A tile is a share of the texts of one population count with some ``HEAVY_TILE`` shingles; each meets itself and the tiles
    within the radius.
    """
    placed = held.withColumn("cell", F.bit_count("f").cast("int"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.sum("n") / HEAVY_TILE).alias("tiles"))
    sliced = F.expr(f"explode(transform(sequence(0, greatest(size(shingles) - 1, 0), {SLICE}), i -> slice(shingles, i + 1, {SLICE})))")
    placed = placed.join(sizes, "cell").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiles = staged(placed.select("cell", "tile", "f", "g", "n", "node", "root", sliced.alias("slice")), "heavy-tiles")
    index = tiles.select("cell", "tile").distinct()
    steps = F.explode(F.sequence(F.col("cell"), F.least(F.col("cell") + radius, F.lit(BITS)))).alias("cell")
    to = index.select(F.col("cell").alias("at_cell"), F.col("tile").alias("at_tile"), "cell").select("at_cell", "at_tile", steps)
    pairs = to.join(index, "cell").where("cell > at_cell or tile >= at_tile")
    rows = tiles.join(pairs, ["cell", "tile"])
    own = (F.col("cell") == F.col("at_cell")) & (F.col("tile") == F.col("at_tile"))
    rows = rows.select("at_cell", "at_tile", (~own).cast("int").alias("guest"), "cell", "tile", "f", "g", "n", "node", "root", "slice")
    ordered = rows.repartition("at_cell", "at_tile").sortWithinPartitions("at_cell", "at_tile", "guest", "cell", "tile", "node")

    def run(batches):
        at, name, host, tile, forest = None, None, None, None, None

        def settle():
            """The tile that came last is complete: it is the host, or meets the host."""
            nonlocal host
            tile.close()
            host = tile if host is None else host
            confirm(host, tile, radius, similarity, forest)

        def told():
            links, forest.links = forest.links, []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

        for batch in batches:
            keys = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:5]], axis=1)
            members = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[5:10]], axis=1)
            bounds, values = batch.column(10).offsets.to_numpy(), batch.column(10).values.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                key = tuple(keys[low].tolist())
                if key != name:
                    if name is not None:
                        settle()
                    if key[:2] != at:
                        if forest is not None:
                            yield told()
                        if key[2]:
                            raise ValueError("a tile came before its host")
                        at, host, forest = key[:2], None, Forest()
                    name, tile = key, ShingleTile()
                tile.add(members[low:high].copy(), [values[bounds[i] : bounds[i + 1]].copy() for i in range(low, high)])
        if name is not None:
            settle()
            yield told()

    return ordered.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """Rows ``node, root`` for every node of ``edges`` (a, b): the smallest node reachable.

    Large-star and small-star rounds: every node's neighbours are tied to its smallest one, until nothing changes.
    Edges are written each round; a round shuffles edges only.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    now, mark = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        mark = seen
        around = both(now)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = staged(tied.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")


def shingle_sets(nodes: DataFrame, prints: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, shingles`` of all ``nodes``: the hashes of all distinct shingles. One document stands for each text."""
    chosen = prints.join(nodes, prints["row_key"] == nodes["node"], "left_semi").groupBy("row_key").agg(F.min("doc_id").alias("one"))
    chosen = chosen.select(F.xxhash64("one").alias("id_hash"), "row_key")
    keyed = docs.withColumn("id_hash", F.xxhash64("doc_id")).join(chosen, ["id_hash", "row_key"]).select(F.col("row_key").alias("node"), "text")
    found = map_batches(keyed, lambda b: [b.column(0), [shingle_set(t) for t in texts(b.column(1))]], "node bigint, shingles array<bigint>")
    return staged(found.groupBy("node").agg(F.any_value("shingles").alias("shingles")), "shingles")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` whose texts share ``similarity`` of their distinct shingles at least."""
    met = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    met = met.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("both"))
    return met.where(F.col("shared") >= F.lit(similarity) * (F.col("both") - F.col("shared"))).select("a", "b")


def similar_links(prints: DataFrame, docs: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Confirmed links between the texts of ``docs``, enough to connect all candidates that can be confirmed."""
    nodes = staged(prints.select(F.col("p").alias("f"), "g", "n", F.col("row_key").alias("node")).distinct(), "nodes")
    tried = staged(candidates(nodes, radius, similarity, nodes.count()).distinct(), "candidates")
    pairs, held = tried.where("b is not null"), tried.where("b is null").select(F.col("a").alias("node")).distinct()
    sets = shingle_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(held).distinct(), prints, docs)
    found = staged(confirmed(pairs, sets, similarity), "links")
    roots = components(found)
    heavy = nodes.join(held, "node").join(roots, "node", "left").select("f", "g", "n", "node", F.coalesce("root", "node").alias("root"))
    return found.union(staged(confirmed_in_tiles(heavy.join(sets, "node").select("f", "g", "n", "node", "root", "shingles"), radius, similarity), "links"))


def classes(docs: DataFrame, radius: int = 3, doc_id: str = "doc_id", text: str = "text", words: int = 3, similarity: float | None = None) -> DataFrame:
    """Per row: ``doc_id, row_key, fingerprint, component_id, first_key``.

    ``row_key`` is a hash of the text; the row of a class that stays is the one with ``doc_id = component_id`` and
    ``row_key = first_key``. With ``similarity``, links are between texts and must be ``confirmed``.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text), F.length(F.col(text))).alias("row_key"), F.col(text).alias("text"))
    if similarity is None:
        prints = staged(with_fingerprint(narrow, "f", words=words).drop("text"), "prints")
        key, edges = "f", links(prints.select("f"), radius)
    else:
        prints = staged(with_both_fingerprints(narrow, words), "prints")
        key, edges = "row_key", similar_links(prints, narrow, radius, similarity)
    roots = components(edges)
    rooted = prints.join(roots, prints[key] == roots["node"], "left").select("doc_id", "row_key", "f", F.coalesce("root", key).alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    least = rooted.groupBy("root").agg(first.alias("least")).select("root", F.col("least.doc_id").alias("component_id"), F.col("least.row_key").alias("first_key"))
    return rooted.join(least, "root").select("doc_id", "row_key", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id", "first_key")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class: the smallest id, then the smallest text hash; columns and their order stay."""
    a, b, n = free_name(docs, "keep_id"), free_name(docs, "keep_key"), free_name(docs, "keep_n")
    found = classes(docs, doc_id=doc_id, text=text, **options)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row_key") == F.col("first_key")))
    stay = stay.groupBy(F.xxhash64("doc_id").alias(a), F.col("row_key").alias(b)).agg(F.count("*").alias(n))
    keyed = docs.withColumns({a: F.xxhash64(F.col(doc_id)), b: F.xxhash64(F.col(text), F.length(F.col(text)))}).join(stay, [a, b])
    numbered = keyed.withColumn(n, F.row_number().over(Window.partitionBy(a, b).orderBy(n)))
    return numbered.where(F.col(n) == 1).select(*docs.columns)
