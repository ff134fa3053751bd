"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # call-site capture doubles the time it takes to build large column expressions
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "rolegrid", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; ``conf`` keys use ``__`` for dots (``spark__ui__enabled="false"``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder; on a cluster the folder has to be
    reachable from every executor, so a missing setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="rolegrid-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as a plain scan.

    Used where a table is read several times or inside a loop: the plan behind it is cut, the columns
    stay prunable, and a lost executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """A staged table that grows by one part a round; reading it all needs one scan, however many rounds there were."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.path = spark, os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
        self.schema, self.rounds = None, 0

    def add(self, df: DataFrame) -> DataFrame:
        """Write the part of the next round and return it as a plain scan."""
        self.rounds, self.schema = self.rounds + 1, df.schema
        part = os.path.join(self.path, f"hop={self.rounds}")
        df.write.parquet(part)
        return self.spark.read.schema(df.schema).parquet(part)

    def table(self) -> DataFrame:
        """All parts, with the number of the round as ``hop``."""
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("hop", T.IntegerType())])).parquet(self.path)
