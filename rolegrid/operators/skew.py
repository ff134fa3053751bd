"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is heavy if it holds more than one part in HEAVY_PARTS of all rows. There are fewer than HEAVY_PARTS such keys,
# however many rows there are, so their list is safe to collect and to broadcast; every other key is at most the
# share of one task among HEAVY_PARTS. Keys of few rows are never worth a split.
HEAVY_PARTS = 1000
HEAVY_ROWS = 20_000


def heavy_keys(counts: DataFrame, key: str, count: str = "n", min_rows: int = HEAVY_ROWS) -> DataFrame | None:
    """All keys that hold more than one part in ``HEAVY_PARTS`` of the rows and ``min_rows`` at least, or None.

    ``counts`` holds one row per key; it comes from an aggregate that combines before the shuffle.
    """
    large = counts.where((F.col(count) >= min_rows) & F.col(key).isNotNull())
    if large.isEmpty():
        return None
    total = counts.agg(F.sum(count)).first()[0]
    found = large.where(F.col(count) > total / HEAVY_PARTS).select(key)
    rows = found.collect()
    return counts.sparkSession.createDataFrame(rows, found.schema) if rows else None


def two_sided_join(left: DataFrame, right: DataFrame, key: str, heavy_left: DataFrame | None, heavy_right: DataFrame | None,
                   spread: tuple[str, str], buckets: int | None = None) -> DataFrame:
    """Inner equi join where the side that makes a key heavy is spread, and the other one repeated.

    A key that is heavy on both sides is spread on the left. ``spread`` names a column with many values for each side.
    """
    if heavy_right is None:
        return salted_join(left, right, key, "inner", heavy_left, spread[0], buckets)
    buckets = buckets or max(8, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sides = heavy_right.select(key, F.lit("r").alias("_heavy"))
    if heavy_left is not None:
        sides = heavy_left.select(key, F.lit("l").alias("_heavy")).unionByName(sides.join(heavy_left, key, "left_anti"))
    every = F.sequence(F.lit(0), F.lit(buckets - 1))

    def salted(side: DataFrame, own: str, column: str) -> DataFrame:
        one = F.array(F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int"))
        salts = F.when(F.col("_heavy") == own, one).when(F.col("_heavy").isNotNull(), every).otherwise(F.array(F.lit(0)))
        return side.join(F.broadcast(sides), key, "left").withColumn("_salt", F.explode(salts)).drop("_heavy")

    return salted(left, "l", spread[0]).join(salted(right, "r", spread[1]), [key, "_salt"]).drop("_salt")


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str, heavy: DataFrame | None,
                spread: str, buckets: int | None = None) -> DataFrame:
    """Equi join where rows of heavy left keys are spread over ``buckets`` partitions.

    ``spread`` names a left column with many values; it decides the bucket, so a retried task puts a row
    in the same place. Right rows of a heavy key are repeated once per bucket, all others are not.
    Valid for inner, left, left_semi and left_anti: every left row meets all right rows of its key.
    Without heavy keys this is the plain join.
    """
    if heavy is None:
        return left.join(right, key, how)
    buckets = buckets or max(8, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    mark = F.broadcast(heavy.select(F.col(key), F.lit(True).alias("_heavy")))
    bucket = F.when(F.col("_heavy"), F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int")).otherwise(0)
    salted = left.join(mark, key, "left").withColumn("_salt", bucket).drop("_heavy")
    copies = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(mark, key, "left").withColumn("_salt", F.explode(copies)).drop("_heavy")
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
