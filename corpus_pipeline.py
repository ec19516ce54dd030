"""A training corpus from documents: language, near-duplicates, benchmark passages, personal data, mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.llm.common import free_name, written
from sampleloom.llm.decontaminate import decontaminate
from sampleloom.llm.language import UNKNOWN, identify_languages, result_names
from sampleloom.llm.mixing import mixed_documents
from sampleloom.llm.near_dup import near_duplicates
from sampleloom.llm.pii import redact

# All stages: other columns stay as they are, whatever their names; long texts count whole; an empty table gives an empty one.


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told (operator 5); a low score of a short clean text is no reason to drop it.

    A null text and one without letters go. Rows are judged one by one: repeats and null ids make no difference.
    """
    pred, _ = result_names(docs)
    return identify_languages(docs).where(F.col(f"`{pred}`") != UNKNOWN).select(*_own(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (operator 4): five words, similarity 0.8.

    Rows that share a doc_id are one document, of which one row stays: that with the smallest text hash. A row without doc_id
    is known by its text, so of equal texts without id one stays, and one with an id is preferred to it. Texts without words link with nothing.
    """
    key = free_name(docs, "key")
    named = (F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit((1 << 61) - 1))).bitwiseOR(F.lit(1 << 62))  # above all ids
    rows = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), named))
    keyed = rows.select(F.col(f"`{key}`").alias("doc_id"), "text")
    gone = near_duplicates(keyed).where("not kept").select(F.col("doc_id").alias(key)).distinct()
    left = rows.join(written(gone, "gone"), key, "left_anti")
    often = written(keyed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(key)), "often")
    once = left.join(often, key, "left_anti").select(*_own(docs))
    several = left.join(often, key, "left_semi")
    one = several.groupBy(key).agg(F.min_by(F.struct(*_own(docs)), F.struct(F.xxhash64(F.col("text").cast("string")), F.col("text").cast("string"))).alias("row"))
    return once.unionByName(one.select("row.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a benchmark window (operator 7).

    Null and empty texts have none and stay. Rows with the same id and text share their fate; a null id is an id here.
    """
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    doc, text = free_name(docs, "hit_doc"), free_name(docs, "hit_text")
    found = written(found.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)), "contaminated")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text)), "left_anti")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind (operator 8). Null and empty texts, repeats and null ids stay as they are."""
    return redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, taken and copies (operator 6).

    The three names get underscores where docs has them. Null sources are one source; null and empty texts have no
    words to take and go; rows that repeat are documents of their own and share what is taken of them evenly.
    """
    return mixed_documents(docs)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("personal_data", without_personal_data),
    ("mix", mixed),
]

#: SQL can't express the model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
