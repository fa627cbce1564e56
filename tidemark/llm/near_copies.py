"""Near copies by SimHash with covering masks, each link confirmed.

Every document gets several fingerprints of its distinct words, of independent hashes. Fingerprints of one kind within two bits are
found by ``simhash.links``; an edit that moves one fingerprint over the radius seldom moves all of them. Linked documents are
near copies if they share enough of their five-word shingles, which is counted on the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import full_text, temporary, written
from tidemark.llm.graph import components
from tidemark.llm.simhash import BITS, SEED, links, shingles, words_of

#: Kinds of fingerprints, words of a shingle, and the share of shingles that near copies have in common.
KINDS, SHINGLE, LIKENESS = 12, 5, 0.8
_SALTS = np.random.default_rng(17).integers(0, 1 << 64, KINDS, dtype=np.uint64)


def several(text: str | None, kinds: int = KINDS) -> list[int]:
    """Fingerprints of the distinct words, a bit of each being 1 if it is set in over half of the words' hashes of that kind; 0 without words."""
    words = set(words_of(text))
    if not words:
        return [0] * kinds
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    ones = np.zeros(kinds * BITS, dtype=np.int64)
    for at in range(0, len(h), 1024):
        k = (h[at : at + 1024, None] ^ _SALTS[:kinds]) * np.uint64(0x9E3779B97F4A7C15)
        k = (k ^ (k >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        k ^= k >> np.uint64(29)
        ones += np.unpackbits(k.astype("<u8").view(np.uint8).reshape(len(k), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<i8").tolist()


def likeness(a: str | None, b: str | None) -> float:
    """The share of the shingles of either text that both have; 1 for two texts without words."""
    x, y = _shingle_set(a), _shingle_set(b)
    return len(x & y) / len(x | y) if x or y else 1.0


@lru_cache(maxsize=8)
def _shingle_set(text: str | None) -> frozenset[bytes]:
    return frozenset(shingles(words_of(text), SHINGLE))


def near_copies(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """One row for each distinct ``doc_id, text`` of ``docs``: ``doc_id, text_key`` (a hash of the text), ``group_id, first``.

    ``group_id``: the same for documents that links of ``least`` likeness connect; ``first``: whether the document is its group's
    smallest doc_id (a null one comes last, then the smaller text_key). Texts that only lack words are near copies of one another; repeated rows are one
    document; texts of any length are compared whole; an empty table gives no rows; other columns are ignored.
    """
    key = ["doc_id", "text_key"]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(full_text()).alias("text_key"), full_text().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([several(t.as_py()) for t in b["text"]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_key"], fps], names=[*key, "fps"])

    prints = own.mapInArrow(run, "doc_id long, text_key long, fps array<long>")
    nodes = written(prints.groupBy(*key).agg(F.first("fps").alias("fps")).withColumn("node", F.monotonically_increasing_id()), "prints")
    each = nodes.select("node", F.posexplode("fps").alias("k", "fp"))
    # One document stands for all of a fingerprint; the others are tied to it.
    by_print = written(each.groupBy("k", "fp").agg(F.min("node").alias("stands"), F.count("*").alias("n")), "by-print")
    same = each.join(by_print.where("n > 1"), ["k", "fp"]).where("node <> stands").select(F.col("stands").alias("a"), F.col("node").alias("b"))
    tied = links(by_print.select("k", "fp"))
    stands = lambda x: by_print.select("k", F.col("fp").alias(x), F.col("stands").alias(f"{x}_node"))
    close = tied.join(stands("a"), ["k", "a"]).join(stands("b"), ["k", "b"]).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    pairs = same.unionByName(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges = _confirmed(own, nodes.select("node", *key), written(pairs, "pairs"), least)
    found = nodes.select("node", *key).join(components(edges).withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    grouped = written(found.select(*key, F.coalesce("component", "node").alias("group_id")), "groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    firsts = grouped.groupBy("group_id").agg(F.min(order).alias("f"))
    return grouped.join(firsts, "group_id").select(*key, "group_id", order.eqNullSafe(F.col("f")).alias("first"))


def _confirmed(own: DataFrame, nodes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (``a, b``) of nodes whose texts have ``least`` likeness, written."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node"), "linked")
    same = (F.col("o.text_key") == F.col("i.text_key")) & F.col("o.doc_id").eqNullSafe(F.col("i.doc_id"))
    texts = own.alias("o").join(ids.alias("i").hint("shuffle_hash"), same).select("i.node", "o.text").dropDuplicates(["node"])
    texts = written(texts, "texts")
    # ``a`` may stand for very many copies ``b``: their texts go to it, once for each pair, and its own goes nowhere with them.
    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    both = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a").select("a", "b", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([likeness(x.as_py(), y.as_py()) >= least for x, y in zip(b["a_text"], b["b_text"], strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(keep)

    return written(both.mapInArrow(run, "a long, b long"), "confirmed")


def keep_first(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever they are called: of each group of near copies the first (see ``near_copies``),
    of repeated rows one."""
    stays = written(near_copies(docs, least).where("first").select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text")), "kept").alias("stays")
    doc_id, text_key = temporary("doc_id", "text_key")
    key = {doc_id: F.col("doc_id").cast("long"), text_key: F.xxhash64(full_text())}
    same = (F.col(text_key) == F.col("stays.k_text")) & F.col(doc_id).eqNullSafe(F.col("stays.k_id"))
    out = docs.withColumns(key).join(stays.hint("shuffle_hash"), same, "left_semi")
    narrow = docs.select(*(v.alias(k) for k, v in key.items()))
    if not narrow.groupBy(*key).count().where("count > 1").isEmpty():
        out = out.dropDuplicates(list(key))
    return out.select(*docs.columns)
