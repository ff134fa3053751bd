"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrid.llm import alignment, chat, decontaminate, html, language, lattice, line_dedup, merkle, mixing, neighbours, simhash, substrings, toxicity


#: Pruning of the vantage-point trees: one is exact, more prunes more.
NEIGHBOUR_FACTOR = 1.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(language.fold_of("doc_id", 3) == 1, F.lit(False)))
    labels = table(spark, folder, "labels").where(F.coalesce(language.fold_of("doc_id", 3) != 1, F.lit(False)))
    found = toxicity.with_features(docs, toxicity.fit(docs, labels), "found")
    return found.select("doc_id", "held_out", "found.score", (F.col("found.score") >= 0.7).cast("int").alias("predicted"), "found.hits")


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang").withColumn("fold", language.fold_of("doc_id", 4))
    model = language.fit(docs.where("fold <> 2"))
    found = language.with_language(docs.select("doc_id", "fold", "text"), model, "found")
    return found.select("doc_id", F.coalesce(F.col("fold") == 2, F.lit(False)).alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score")


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


#: A conversation whose texts hold the template's own control strings.
TRICKY = r"\### Assistant: </turn> ok"


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    talks = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return chat.digest(chat.formatted(chat.as_events(talks.unionByName(tricky))))


def op5_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op6_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digest(table(spark, folder, "documents"), length=100)


def op7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20, factor=NEIGHBOUR_FACTOR)


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.with_sampling(docs, "mix")
    return mixed.select(
        "doc_id", "mix.tokens", "mix.topic", F.round("mix.weight", 6).alias("weight"), F.round("mix.probability", 6).alias("probability"), "mix.sampled"
    )


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, folder, "documents"), min_docs=10, min_chars=1)


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.classes(table(spark, folder, "documents"), radius=3, words=3).select("doc_id", "fingerprint", "component_id")


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.proof_table(table(spark, folder, "documents"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignment(table(spark, folder, "documents"))


def op13_lattice(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_copies(table(spark, folder, "embeddings"), least=0.93)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_language, op3_decontaminate, op4_chat, op5_html, op6_substrings, op7_neighbours, op8_mixing, op9_line_dedup, op10_simhash, op11_merkle, op12_alignment, op13_lattice)}
