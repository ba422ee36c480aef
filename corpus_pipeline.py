"""From raw documents to a training mix: five stages, each on all that the one before has kept.

1. language ID drops documents in none of the languages that the corpus is labelled with: gibberish, encoded data, other
   languages and texts without letters, by the fused evidence;
2. near-duplicates: of each class one document stays;
3. benchmark decontamination drops contaminated documents;
4. personal data is replaced by the name of its kind, and ``n_chars`` follows the new text;
5. sources are interleaved to equal weights (``mixing`` takes others): the columns of documents and the order to read in.

``run`` writes what a stage returns in the shared folder before the next stage reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontam, langid, mixing, ordminhash, pii
from cairn.session import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs, langid.train(docs), host="source", declared="lang")
    return found.where("lang_accepted").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ordminhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.interleave(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", redact_pii),
    ("mix", mix_sources),
]

#: SQL can't express the language model; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
