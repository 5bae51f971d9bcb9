"""A corpus pipeline of training-data operators, each stage written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierwise.llm import decontamination, language_id, near_dedup, packing, secret_scan
from tierwise.llm.common import stored, table

#: A text whose language is less certain is rejected: the least score where chance is 0.25, that is with four languages.
LEAST_SCORE = 0.3


def least_score(languages: int) -> float:
    """The score as far above chance, as a share of what is left to certainty, as LEAST_SCORE is with four languages."""
    chance = 1 / languages
    return chance + (LEAST_SCORE - 0.25) / 0.75 * (1 - chance)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts; those without a letter or with a low score go.

    The classifier learns from the documents' own language labels, on the folds that are not held out.
    Without any label only texts without a letter go; with one language every other text is certain.
    """
    model = language_id.train(docs)
    texts = docs.withColumn("text", F.col("text").cast("string"))
    if model is None:
        return language_id.with_letters(texts)
    lang, score = "__lang_pred", "__score"
    found = language_id.identify(texts, model, "text", lang, score)
    return found.where((F.col(lang) != "und") & (F.col(score) >= least_score(len(model.languages)))).select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8): the smallest id. Rows without an id stay."""
    found = near_dedup.near_duplicates(docs, size=5, num=80, den=100)
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    own = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    one = own.withColumn("__turn", F.row_number().over(first)).where(F.col("__turn") == 1).drop("__turn")
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item, nor a passage of one, is found."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark."""
    return secret_scan.redacted(docs, secret_scan.train(known=secret_scan.dictionary(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens."""
    placed = packing.pack(stored(packing.pieces(docs)))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identified),
    ("near_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: Several stages cannot be expressed in SQL (a trained model, signatures, a tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of sf_dir; the rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
