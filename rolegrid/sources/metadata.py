"""JSON metadata to typed columns and back (PR8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.operators.review import json_score
from rolegrid.schemas import METADATA_COLUMNS

KNOWN = (*METADATA_COLUMNS, "score", "score_explanations")


def decode_metadata(rows: DataFrame, json: str = "metadata_json") -> DataFrame:
    """Known keys become columns, the rest stays as JSON in ``extra``; so does a score that is not a number."""
    doc = F.try_parse_json(json)
    fields = F.from_json(json, "map<string,variant>")
    number = json_score(json)
    odd_score = number.isNull() & ~F.coalesce(F.is_variant_null(F.try_variant_get(doc, "$.score", "variant")), F.lit(True))
    rest = F.map_filter(fields, lambda k, _: ~k.isin(*KNOWN, "db_id") | ((k == "score") & odd_score))
    out = {n: F.try_variant_get(doc, f"$.{n}", "string") for n in METADATA_COLUMNS}
    out["score"] = number
    out["score_explanations"] = F.try_variant_get(doc, "$.score_explanations", "array<string>")
    out["extra"] = F.when(F.size(rest) > 0, F.to_json(rest))
    return rows.withColumns(out)


def encode_metadata(rows: DataFrame, json: str = "metadata_json") -> DataFrame:
    """Typed columns and ``extra`` as one JSON object with sorted keys."""
    return rows.withColumn(json, metadata_json())


def metadata_json() -> Column:
    # a whole number is written without a fraction, as it came
    whole = F.when(F.col("score") == F.floor("score"), F.col("score").cast("bigint").cast("string")).otherwise(F.col("score").cast("string"))
    score = F.when(F.col("score").isNotNull(), F.map_from_arrays(F.array(F.lit("score")), F.array(F.parse_json(whole))))
    other = F.from_json(F.to_json(F.struct(*[F.col(n) for n in KNOWN if n != "score"])), "map<string,variant>")
    known = F.map_concat(other, F.coalesce(score, F.from_json(F.lit("{}"), "map<string,variant>")))
    extra = F.coalesce(F.from_json("extra", "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    entries = F.concat(F.map_entries(known), F.map_entries(extra))
    keys = F.array_sort(F.transform(entries, lambda e: e["key"]))
    both = F.map_from_entries(entries)
    return F.to_json(F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), both[k].alias("value")))))
