"""The corpus pipeline: toxicity, near duplicates, decontamination, personal data, packing.

Stages go by row: doc_id may be null or repeat, and each row is judged by its own text. A null text is an empty
one, which is neither toxic nor contaminated and is near-duplicate to other empty ones only. No rows give no
rows; columns other than those of documents go.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import decontamination, packing, pii, similar, toxicity
from wakeline.llm.shared import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Not SQL: the model, the components and the packing iterate. What run() keeps is tested against plain Python.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go, each row by its own text. The model learns from labelled documents given."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity(docs, model, keep=COLUMNS).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (sets of five-word shingles, similarity 0.8) the row with the least doc_id stays.

    A row without a doc_id comes after those with one; of rows with the same doc_id one stays.
    """
    # what is in all of its columns tells a row from others of its doc_id
    content = F.unhex(F.md5(F.to_json(F.struct(*COLUMNS))))
    by_id = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), content.alias("content"))
    rows = docs.select(by_id.alias("id"), *COLUMNS)
    found = similar.groups(rows.select("id", "text"))
    stays = cut(found.groupBy("root").agg(F.min_by("id", F.struct("id.none", "id.doc_id", "num")).alias("id")).select("id"), "stays")
    return similar.once(rows).join(stays, "id", "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go, each row by its own text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contamination(docs, benchmark, keep=COLUMNS).where("NOT contaminated").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows."""
    # what is masked follows from the text, so spans go back to the rows by its digest and texts aren't written with them
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*COLUMNS).withColumn("text", text).withColumn("_text", F.unhex(F.md5("text")))
    found = pii.detect(rows.select("doc_id", "text", "_text"), keep=("_text",))
    masks = found.where(F.size("masks") > 0).groupBy("_text").agg(F.first("masks").alias("masks"))
    joined = rows.join(masks, "_text", "left")
    clean = joined.withColumn("text", F.when(F.col("masks").isNull(), F.col("text")).otherwise(pii.redact(F.col("text"), F.col("masks"))))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("best_two_fit", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; the pieces of what is left, packed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
