"""The corpus pipeline: documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as
Parquet in the shared folder and reads it back as the next stage's ``docs``. All but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.common import crc_mod, materialize
from rollcall.llm.forest import drop_near_duplicates
from rollcall.llm.language import fit, told
from rollcall.llm.mixing import mixed
from rollcall.llm.packing import pack, tokenized_pieces
from rollcall.llm.pii import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language. Learned from the documents with a lang whose
    crc32(doc_id) modulo 3 is not 1; a null text, a text without a letter and a text that fits
    its decoded language no better than chance go. When no document has a lang, only null
    texts and those without a letter go; an empty table gives no rows."""
    model = fit(docs.filter(crc_mod(F.col("doc_id"), 3) != 1))
    if not model["langs"]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return docs.filter(told(spark, model)("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class at a shingle similarity of 0.8: the first stored."""
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind in brackets."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights; a document may come up to three times."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place in it."""
    return pack(tokenized_pieces(docs))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

# Learned models, hashed draws and tokeniser ids: SQL expresses none of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
