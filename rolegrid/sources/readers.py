"""Inputs: stored tables, registry, rules, queries and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolegrid.functions.text import clean_list, is_site_slug, list_has_blank, site_slug, squash_ws
from rolegrid.functions.urls import http_url
from rolegrid.operators.store import backfill
from rolegrid.operators.validate import no_list_reasons, split_valid, validate_registry
from rolegrid.schemas import DEFAULT_RULES, DISCOVERY_QUERY, REGISTRY, RULE_LISTS, RULES


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """Stored postings; older tables get the columns they lack (SR11, PR9)."""
    return backfill(spark.read.parquet(path))


def read_postings_jdbc(spark: SparkSession, url: str, table: str = "jobs", **options: str) -> DataFrame:
    """Postings kept in a database, read in parallel when partition options are given (SR11)."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    return backfill(reader.load())


def _json_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON file with their position ``idx``, and ``not_lists``: the list fields whose value is something else."""
    lists = [f.name for f in schema if isinstance(f.dataType, T.ArrayType)]
    loose = T.StructType([T.StructField(f.name, T.VariantType() if f.name in lists else f.dataType) for f in schema])
    rows = spark.read.schema(loose).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    wrong = [F.when(~F.schema_of_variant(n).rlike("^(ARRAY|VOID)"), n) for n in lists]
    rows = rows.withColumns({"idx": F.monotonically_increasing_id(), "not_lists": F.array_compact(F.array(*wrong).cast("array<string>"))})
    return rows.withColumns({n: F.try_variant_get(n, "$", "array<string>") for n in lists})


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Registry entries of a JSON list, and the issues found in it (SR13).

    ``idx`` is the position in the file; a multi-line JSON file is read by one task, in order.
    """
    return validate_registry(_json_rows(spark, path, REGISTRY))


def read_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row of scoring rule lists: a JSON object, or the defaults without a path (SR14). A value that is no list is an error."""
    if path is None:
        return spark.createDataFrame([tuple(DEFAULT_RULES.get(n, []) for n in RULE_LISTS)], RULES)
    rules = _json_rows(spark, path, RULES)
    wrong = rules.select(F.explode("not_lists")).first()
    if wrong:
        raise ValueError(f"{wrong[0]}: value must be a list")
    return rules.select(*[clean_list(n).alias(n) for n in RULE_LISTS])


def long_form(rules: DataFrame) -> DataFrame:
    """Rule lists as rows ``(rule, position, value)``."""
    parts = [
        rules.select(F.lit(n).alias("rule"), F.posexplode(n).alias("position", "value")) for n in RULE_LISTS
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_discovery_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Start pages of a JSON list, and the entries that are invalid with reasons (SR15)."""
    fields = T.StructType([f for f in DISCOVERY_QUERY if f.name != "query_id"])
    rows = _json_rows(spark, path, fields)
    lists = ("include_keywords", "exclude_keywords", "location_hints")
    checks = [
        F.when(F.coalesce(squash_ws("label"), F.lit("")) == "", "label: value must not be empty"),
        F.when(~F.coalesce(is_site_slug("source_site"), F.lit(False)), "source_site: not a site name"),
        F.when(http_url("start_url").isNull(), "start_url: not a web address"),
        *[F.when(list_has_blank(n), f"{n}: value must not be empty") for n in lists],
    ]
    judged = rows.withColumn("reasons", F.concat(F.array_compact(F.array(*checks)), no_list_reasons("not_lists"))).drop("not_lists")
    good, bad = split_valid(judged)
    good = good.select(
        F.col("idx").cast("string").alias("query_id"),
        site_slug("source_site").alias("source_site"),
        squash_ws("label").alias("label"),
        http_url("start_url").alias("start_url"),
        *[clean_list(n).alias(n) for n in lists],
    )
    return good, bad


def read_prompts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A folder of text files with one prompt each; empty ones are set aside (SR16)."""
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("name"),
        F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("raw_prompt_text"),
    )
    empty = squash_ws("raw_prompt_text") == ""
    return files.where(~empty), files.where(empty).withColumn("reason", F.lit("prompt text is empty"))


def saved_prompt(prompts: DataFrame, name: str) -> DataFrame:
    """The saved prompt of a name (SR16)."""
    return prompts.where(F.col("name") == name)
