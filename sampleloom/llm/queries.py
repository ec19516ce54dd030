"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_documents
from .chat import CHAT_SQL, conversations, preference_examples, stale_reply_pairs
from .common import new_path, written
from .decontaminate import DECONTAMINATE_SQL, decontaminate
from .embeddings import VECTORS_SQL, near_duplicate_vectors
from .fingerprints import grouped_fingerprints
from .language import held_out, identify_languages
from .mixing import MIX_SQL, mix_sources
from .near_dup import NEAR_DUP_SQL, near_duplicates
from .phrases import PHRASES_SQL, mine_phrases
from .pii import personal_data_digest
from .token_counts import TokenRollup, replayed, token_rows, vocabulary
from .toxicity import fit_toxicity, labelled_sample, predict_severity
from .warc import WARC_SQL, read_archives, write_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Session setting that names the folder of the public tokenizers' vocabulary files, and its value where it is unset.
TOKENIZERS = ("sampleloom.tokenizers", "/opt/tokenizers")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, by a rollup that has gone through loads, deletes, revisions, repeats and compaction."""
    vocabularies = {"byte_bpe_50k": vocabulary("byte_bpe_50k.tiktoken", spark.conf.get(*TOKENIZERS))}
    rows = written(token_rows(table(spark, sf_dir, "documents"), vocabularies), "token_rows")
    return replayed(TokenRollup(spark, new_path(spark, "rollup")), rows)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, _ = fit_toxicity(labelled_sample(docs, table(spark, sf_dir, "labels")))
    return predict_severity(docs, model)


def op3_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preference_examples(stale_reply_pairs(conversations(table(spark, sf_dir, "conversations"))))
    for c in ("chosen_mask", "rejected_mask"):
        found = found.withColumn(c, F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"], x["end"])), ","))
    return found


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "text_hash")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digest(table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_archives(write_archives(table(spark, sf_dir, "pages")), payloads=False)
    return read.where("gap is null").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), spark.conf.get(*TOKENIZERS))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_chat_preferences": op3_chat_preferences,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_language_id": op5_language_id,
    "op6_mix_sources": op6_mix_sources,
    "op7_decontaminate": op7_decontaminate,
    "op8_personal_data": op8_personal_data,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_warc": op10_warc,
    "op11_token_alignment": op11_token_alignment,
    "op12_phrases": op12_phrases,
    "op13_fingerprints": op13_fingerprints,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_preferences": CHAT_SQL,
    "op4_minhash_near_dedup": NEAR_DUP_SQL,
    "op6_mix_sources": MIX_SQL.format(docs="documents"),
    "op7_decontaminate": DECONTAMINATE_SQL.format(docs="documents"),
    "op9_embedding_near_dedup": VECTORS_SQL,
    "op10_warc": WARC_SQL,
    "op12_phrases": PHRASES_SQL,
}
