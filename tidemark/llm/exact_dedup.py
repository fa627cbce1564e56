"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one winner
for each digest before it meets the index (so a group of copies of any size is one row there),
new digests are found by a sort-merge anti-join that leaves the index unshuffled, and appended.
Only built-in functions run; document texts are never shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, delete, exists, full_text, new_path, rename, temporary, written


def normalised_digest(column: str = "text"):
    """SHA-256 (32 bytes) of the text without white space."""
    return F.unhex(F.sha2(F.translate(full_text(column), SPACES, ""), 256))


class DigestIndex:
    """``digest, keep_id`` for every digest seen, at ``path``; made there if absent.

    The number of buckets is kept with the table, so every session that opens it finds the files of a digest. The catalog
    entry is only a name for the files: ``close`` (or ``with``) drops it and leaves the files.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or new_path(spark, "digest-index")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        if exists(spark, f"{self.path}/next/_SUCCESS") and not exists(spark, f"{self.path}/table"):
            rename(spark, f"{self.path}/next", f"{self.path}/table")  # ``compact`` ended between its two steps
        made = f"{self.path}/buckets"
        if exists(spark, f"{made}/_SUCCESS"):
            self.buckets = spark.read.schema("n int").parquet(made).first().n
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(self.buckets,)], "n int").write.mode("overwrite").parquet(made)
        self._create(self.name, "table")

    def _create(self, name: str, folder: str) -> None:
        self.spark.sql(
            f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'"
        )

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, fresh: DataFrame) -> None:
        fresh.select("digest", "keep_id").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


    def compact(self) -> None:
        """One sorted file a bucket again, each digest once; for after many batches, with no reader or writer at work.

        The new files are whole before the old ones go, and a run that dies between is ended by the next that opens the index.
        """
        after = f"{self.name}_next"
        delete(self.spark, f"{self.path}/next")
        self._create(after, "next")
        # Read by bucket, so a digest's rows meet without an exchange and every bucket is one task.
        self.table().groupBy("digest").agg(F.min("keep_id").alias("keep_id")).write.insertInto(after)
        self.spark.sql(f"DROP TABLE {after}")
        self.close()
        delete(self.spark, f"{self.path}/table")
        rename(self.spark, f"{self.path}/next", f"{self.path}/table")
        self._create(self.name, "table")


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, keep_id, group_size, kept,
    digest, n_chars``.

    Of rows with equal text (white space aside) one stays: the document that the index names for it, and
    if it names none, the row with the most code points, then the smallest doc_id, then any one of
    repeated rows, which the index is told. A document that the index names stays whenever it is met again, so a
    batch that is run again, after a lost job or not, gives what it gave. ``group_size`` counts rows of this batch. A null
    text counts as empty; a null doc_id sorts first, and all documents of one text without an id are one to the
    index; very long texts are read as they are; an empty table gives no rows; other columns are ignored.
    """
    batch = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.length(full_text()).alias("n_chars"),
            normalised_digest().alias("digest"),
            F.monotonically_increasing_id().alias("row_id"),
        ),
        "digests",
    )
    winners = written(
        batch.groupBy("digest")
        .agg(F.min(F.struct(-F.col("n_chars"), "doc_id", "row_id")).alias("first"), F.count("*").alias("group_size"))
        .select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row_id").alias("keep_row"), "group_size"),
        "winners",
    )
    held = index.table().groupBy("digest").agg(F.min("keep_id").alias("held_id"))  # one row a digest, but for two runs at once
    fresh = written(winners.hint("merge").join(held, "digest", "left_anti"), "fresh")
    seen = written(winners.hint("merge").join(held, "digest").select("digest", F.col("held_id").alias("keep_id"), "group_size"), "seen")
    again = batch.join(seen, "digest").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    rows = again.groupBy("digest").agg(F.min(F.struct(-F.col("n_chars"), "row_id")).alias("first")).select("digest", F.col("first.row_id").alias("keep_row"))
    decided = written(fresh.unionByName(seen.join(rows, "digest", "left")), "decided")
    index.append(fresh)
    # Both sides are plain exchanges of narrow rows, so a digest with a third of all rows is split at run time.
    kept = F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(False))
    return batch.join(decided, "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest", "n_chars")


def keep_first(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that ``deduplicate`` keeps, with all their columns, whatever they are called."""
    doc_id, digest, n_chars = temporary("doc_id", "digest", "n_chars")
    key = {doc_id: F.col("doc_id").cast("long"), digest: normalised_digest(), n_chars: F.length(full_text())}
    stays = written(deduplicate(docs, index).where("kept").select(F.col("doc_id").alias("k_id"), F.col("digest").alias("k_digest"), F.col("n_chars").alias("k_n")), "kept").alias("stays")
    keyed = docs.withColumns(key)
    # Keyed by document and digest, so copies do not meet in one task; the narrow side is hashed and texts are not sorted.
    same = (F.col(digest) == F.col("stays.k_digest")) & F.col(doc_id).eqNullSafe(F.col("stays.k_id")) & (F.col(n_chars) == F.col("stays.k_n"))
    out = keyed.join(stays.hint("shuffle_hash"), same, "left_semi")
    narrow = docs.select(*(v.alias(k) for k, v in key.items()))
    if not narrow.groupBy(*key).count().where("count > 1").isEmpty():
        out = out.dropDuplicates(list(key))
    return out.select(*docs.columns)
