"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, secret scans, best-fit packing.

Each stage takes the rows its predecessor kept and makes its decisions take effect; all but the last return
the columns of ``documents``, whatever other names they have, the last the pieces of each document with their places in
sequences. In every stage a null text counts as empty, texts of any length are taken whole, and no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, langid, near_copies, packing, secrets
from tidemark.llm.common import temporary, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter in their text go (null and empty texts too); a missing ``lang`` is filled in.

    Where nothing can be learned, for want of labels, a missing ``lang`` stays null. Repeated rows are judged alike; of
    languages equally near the first by name is taken.
    """
    model = langid.train_on_documents(docs)
    if not model.languages:
        return docs.where(langid.has_letter(F.col("text")))
    pred, score, ambiguous = temporary("lang_pred", "score", "ambiguous")
    found = langid.identify(docs, model, (pred, score, ambiguous))
    kept = found.where(F.col(score) > 0)  # 0 just for texts without a letter; ``und`` may also be a label
    return kept.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal text, white space aside, stays: the longest, then that of the smallest doc_id (null first), of repeated
    rows any one."""
    with exact_dedup.DigestIndex(spark) as index:
        return exact_dedup.keep_first(docs, index)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id (null last), of repeated rows one.

    Near copies share 0.8 of their five-word shingles; fingerprints of the distinct words bring them together.
    """
    return near_copies.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, repeated rows too; the secrets in their texts are masked, character by character; a null text stays null."""
    return secrets.redact(docs, secrets.BlobLedger(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences; a null or empty text is one piece of one token; repeated rows are packed like others."""
    pieces = packing.tokenize(docs)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("secret_scan", secret_scan),
    ("best_fit_packing", packed),
]

#: No SQL tokenizes or computes SimHash; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
