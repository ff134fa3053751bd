"""Stored pages bucketed by url, and the lookup of wanted pages.

A walk looks up other pages at each hop. In a table that is bucketed and sorted by url the pages stay where they are: only the
wanted urls are shuffled to the buckets, page text is not, and what remains after the semi join is dealt by url already, for the
choice of the newest version and for the page reader.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.session import shared_dir

#: Wanted urls that may be broadcast.
SMALL = 100_000
#: Page text of a bucket, about, in a store that chooses its buckets itself.
BUCKET_BYTES = 64 << 20


def bucket_count(pages: DataFrame) -> int:
    """Buckets for ``pages`` by their text, one for each core at least: every hop of a walk opens all buckets, so that many small
    ones cost more than the pages in them. Reads the text once, so ``pages`` should be a stored table."""
    size = pages.agg(F.sum(F.octet_length("html").cast("bigint"))).first()[0] or 0
    return max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))


def write_page_store(pages: DataFrame, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Write ``pages(url, site, html[, kind, fetched_at, ...])`` in ``buckets`` files by url and return the stored table.

    Choose ``buckets`` so that one of them fits a task; it is also the number of tasks that read pages. By default
    ``bucket_count`` chooses.
    """
    spark = pages.sparkSession
    name = f"pages_{uuid.uuid4().hex}"
    path = path or os.path.join(shared_dir(spark), name)
    buckets = buckets or bucket_count(pages)
    order = [c for c in ("kind", "url") if c in pages.columns]
    pages.repartition(buckets, "url").write.bucketBy(buckets, "url").sortBy(*order).option("path", path).saveAsTable(name)
    return spark.table(name)


def open_page_store(example: DataFrame, path: str, buckets: int) -> DataFrame:
    """A store written before, by another session too; ``example`` gives the columns and ``buckets`` the number it was written with."""
    spark = example.sparkSession
    name = f"pages_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in example.schema)
    order = ", ".join(c for c in ("kind", "url") if c in example.columns)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (url) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def newest_pages(pages: DataFrame) -> DataFrame:
    """One version of each page ``url, site``: the newest by ``fetched_at`` (null is oldest), of several such the one with the greatest
    hash of its columns."""
    rest = [c for c in pages.columns if c not in ("url", "site")]
    version = F.struct(F.col("fetched_at") if "fetched_at" in rest else F.lit(0), F.xxhash64(*rest))
    return pages.groupBy("url", "site").agg(F.max_by(F.struct(*rest), version).alias("_page")).select("url", "site", "_page.*")


def wanted_pages(pages: DataFrame, wanted: DataFrame, most: int | None = None) -> DataFrame:
    """The pages ``url, site`` of ``wanted``, one version of each as in ``newest_pages``. The caller may know that there are ``most``
    wanted pages at most; up to ``SMALL`` they are broadcast, and pages that nobody wants end at the scan."""
    # joined on the url alone, so that a store bucketed by url is not shuffled
    sites = wanted.groupBy(F.col("url").alias("_url")).agg(F.collect_set("site").alias("_sites"))
    if most is not None and most <= SMALL:
        sites = F.broadcast(sites)
    hit = pages.join(sites, (F.col("url") == F.col("_url")) & F.array_contains("_sites", F.col("site")), "left_semi")
    return newest_pages(hit)
