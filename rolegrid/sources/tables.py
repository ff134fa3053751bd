"""The stored postings as buckets of files: an upsert writes the buckets it changes and takes over the others by reference.

A version of the table is a small manifest, ``commits/<number>.json``: for each bucket of rows (by id) and of the key index
(by key: url, or site and source id) the folders that hold it, the next free id, and the last batch of each stream. A
manifest is published by creating its file, which fails if another writer was first; the loser starts again from what the other
one has published, so no update is lost. A job that dies before its commit leaves the table as it was.

Reads and writes of rows are Spark jobs over the touched buckets; the driver holds manifests and lists of buckets only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolegrid.operators.lookups import key_list
from rolegrid.operators.store import STORED, to_store_columns, upsert_postings
from rolegrid.schemas import POSTING
from rolegrid.session import stage

INDEX = T.StructType([T.StructField("key", T.StringType()), T.StructField("id", T.LongType())])
#: Commits that may be lost to other writers before an upsert gives up.
ATTEMPTS = 20


class Files:
    """Small files of the driver in whatever file system Spark reads, through Spark's own client."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.gateway, self.jvm = spark.sparkContext._gateway, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        there = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(there)] if self.fs.exists(there) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Create a file with its whole text at once; false if it exists already."""
        folder, _, last = name.rpartition("/")
        draft = self.path(f"{folder}/.{uuid.uuid4().hex}")
        out = self.fs.create(draft)
        out.write(bytearray(text, "utf-8"))
        out.close()
        target = self.path(name)
        try:
            if self.fs.getScheme() == "file":  # a local rename would replace the file, a link does not
                paths = self.jvm.java.nio.file.Paths
                place = lambda p: paths.get(self.fs.makeQualified(p).toUri().getPath(), self.gateway.new_array(self.jvm.String, 0))
                self.jvm.java.nio.file.Files.createLink(place(target), place(draft))
            else:
                options = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(self.conf).getUri(), self.conf).rename(draft, target, options)
            return True
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        finally:
            if self.fs.exists(draft):
                self.fs.delete(draft, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class BucketTable:
    """Stored postings under ``root``; ``buckets`` counts for a new table, one that exists keeps its own number."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.new_buckets = spark, root.rstrip("/"), buckets
        self.files = Files(spark, root)

    # ---- versions

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self.files.names(f"{self.root}/commits") if n.endswith(".json") and not n.startswith("."))

    def _name(self, version: int) -> str:
        return f"{self.root}/commits/{version:020d}.json"

    def state(self) -> dict:
        """The last published manifest."""
        versions = self.versions()
        if not versions:
            return {"version": 0, "buckets": self.new_buckets, "next_id": 1, "rows": {}, "keys": {}, "batches": {}}
        return json.loads(self.files.read(self._name(versions[-1])))

    def _publish(self, before: dict, **changes) -> bool:
        after = before | changes | {"version": before["version"] + 1}
        return self.files.create(self._name(after["version"]), json.dumps(after))

    def committed(self, stream: str, number: int) -> bool:
        return self.state()["batches"].get(stream, -1) >= number

    # ---- buckets

    def _bucket(self, state: dict, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(state["buckets"])).cast("int")

    def _touched(self, state: dict, rows: DataFrame, column: str) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket(state, column)).distinct().collect())

    def _scan(self, folders: dict[str, list[str]], schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
        chosen = folders if buckets is None else [str(b) for b in buckets if str(b) in folders]
        paths = [f"{self.root}/{p}" for b in chosen for p in folders[b]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, state: dict, kind: str, column: str, rows: DataFrame, replaced: list[int]) -> dict[str, list[str]]:
        """Write rows by bucket. ``replaced`` buckets are given as a whole, to others the rows are added; returns the new folders."""
        folder = f"{kind}/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket(state, column)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        written = [n.split("=")[1] for n in self.files.names(f"{self.root}/{folder}") if n.startswith("bucket=")]
        after = {b: p for b, p in state[kind].items() if int(b) not in replaced}
        for b in written:
            after[b] = [*after.get(b, []), f"{folder}/bucket={b}"]
        return after

    # ---- use

    def read(self) -> DataFrame:
        """All postings of the last version."""
        return self._scan(self.state()["rows"], POSTING)

    def lookup(self, keys: DataFrame, state: dict | None = None) -> DataFrame:
        """The postings in the buckets that hold one of the ``keys`` (key); the index is read in the buckets of the keys only."""
        state = state or self.state()
        entries = self._scan(state["keys"], INDEX, self._touched(state, keys, "key")).join(keys.select("key").distinct(), "key", "left_semi")
        return self._scan(state["rows"], POSTING, self._touched(state, entries, "id"))

    def upsert(self, incoming: DataFrame, order: str = "seq", batch: tuple[str, int] | None = None) -> dict[str, DataFrame] | None:
        """``upsert_postings`` into the table. Returns its ``outcome`` and ``conflicts``, or None if ``batch`` (a stream and a number)
        is in the table already."""
        rows = stage(to_store_columns(incoming).select(order, *STORED), "incoming")
        keys = stage(rows.select(F.explode(key_list(rows)).alias("key")).distinct(), "incoming-keys")

        def merge(state: dict) -> tuple[dict, dict]:
            old = self.lookup(keys, state)
            result = upsert_postings(old, rows, order, last_id=state["next_id"] - 1)
            changed, added = stage(result["changed"], "changed"), stage(result["added"], "added")
            return result, self._changes(state, old, result["kept"], changed, added)

        return self._commit(merge, batch)

    def update(self, change: Callable[[DataFrame], DataFrame], keys: DataFrame | None = None, batch: tuple[str, int] | None = None) -> DataFrame | None:
        """Replace postings by ``change`` of them, which keeps ids; with ``keys`` only the buckets that hold one of these are read.
        Buckets without a change are not written. Returns the changed ids."""

        def merge(state: dict) -> tuple[DataFrame, dict]:
            old = self._scan(state["rows"], POSTING) if keys is None else self.lookup(keys, state)
            new = stage(change(old).select(*POSTING.fieldNames()), "updated")
            whole = F.struct(*STORED)
            other = old.select("id", whole.alias("a")).join(new.select("id", whole.alias("b")), "id").where(~F.col("a").eqNullSafe(F.col("b")))
            changed = stage(other.select("id"), "changed")
            return changed, self._changes(state, old, new, changed, new.limit(0))

        return self._commit(merge, batch)

    def _changes(self, state: dict, old: DataFrame, new: DataFrame, changed: DataFrame, added: DataFrame) -> dict:
        """Write what changes; ``old`` and ``new`` are all postings of the read buckets, ``changed`` the ids that differ."""
        added = added.select(*POSTING.fieldNames())
        replaced = self._touched(state, changed, "id")
        kept = new.select(*POSTING.fieldNames()).where(self._bucket(state, "id").isin(replaced)) if replaced else added.limit(0)
        rows = self._write(state, "rows", "id", kept.unionByName(added), replaced)
        entries = lambda df: df.select(F.explode(key_list(df)).alias("key"), "id")
        before, after = (stage(entries(df.join(changed, "id", "left_semi")), "entries") for df in (old, new))
        gone, fresh = before.join(after, ["key", "id"], "left_anti"), after.join(before, ["key", "id"], "left_anti").unionByName(entries(added))
        shrunk = self._touched(state, gone, "key")
        left = self._scan(state["keys"], INDEX, shrunk).join(gone, ["key", "id"], "left_anti")
        keys = self._write(state, "keys", "key", left.unionByName(fresh), shrunk)
        return {"rows": rows, "keys": keys, "next_id": state["next_id"] + added.count()}

    def _commit(self, merge: Callable[[dict], tuple], batch: tuple[str, int] | None):
        for _ in range(ATTEMPTS):
            state = self.state()
            if batch and state["batches"].get(batch[0], -1) >= batch[1]:
                return None
            result, changes = merge(state)
            if batch:
                changes["batches"] = state["batches"] | {batch[0]: batch[1]}
            if self._publish(state, **changes):
                return result
        raise RuntimeError(f"other writers were first {ATTEMPTS} times")

    def compact(self, folders: int = 1) -> None:
        """Rewrite buckets that are spread over more than so many folders."""
        while True:
            state, changes = self.state(), {}
            for kind, column, schema in (("rows", "id", POSTING), ("keys", "key", INDEX)):
                crowded = [int(b) for b, p in state[kind].items() if len(p) > folders]
                changes[kind] = self._write(state, kind, column, self._scan(state[kind], schema, crowded), crowded) if crowded else state[kind]
            if self._publish(state, **changes):
                return

    def clean(self, keep: int = 10) -> None:
        """Delete all versions but the last ``keep`` and what only they refer to. Not for use while other writers work."""
        versions = self.versions()
        states = [json.loads(self.files.read(self._name(v))) for v in versions[-keep:]]
        for kind in ("rows", "keys"):
            used = {p.split("/")[1] for s in states for paths in s[kind].values() for p in paths}
            for folder in self.files.names(f"{self.root}/{kind}"):
                if folder not in used:
                    self.files.delete(f"{self.root}/{kind}/{folder}")
        for version in versions[:-keep]:
            self.files.delete(self._name(version))
