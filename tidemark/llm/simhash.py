"""SimHash near-dedup by covering locality-sensitive hashing.

Bit positions are dealt to the nonzero vectors of ``radius + 1`` bits. For every nonzero vector
there is one table, whose mask keeps the positions with an odd inner product. Any ``radius``
positions leave some vector orthogonal to all of them, so two fingerprints that differ in at most
``radius`` bits agree under some mask: they collide in that table, surely and not just probably.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.graph import components

BITS = 64
SHINGLE = 3
RADIUS = 2
SEED = 42


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space


def shingles(words: list[bytes], n: int) -> Iterable[bytes]:
    """Runs of ``n`` words, repeats included; of fewer words the whole sequence; of none, none."""
    if not words:
        return []
    return [b" ".join(words)] if len(words) < n else map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text as a signed 64-bit integer; 0 if it has no words.

    A-Z is lower-cased; bit i is 1 if it is set in over half of the shingles' hashes, repeats included.
    """
    grams = shingles(words_of(text), shingle)
    if not grams:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (long) for every row of ``docs`` (``doc_id, text``): 0 for a null text and one without words; repeated rows and
    equal texts are alike; texts of any length are read whole; an empty table gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array((simhash(t.as_py(), shingle) for t in b["text"]), pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], fp], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """A mask (signed 64-bit) for each nonzero vector of ``radius + 1`` bits."""
    n = 2 ** (radius + 1) - 1
    masks = [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _signed(bit: int) -> int:
    return (1 << bit) - (1 << 64) if bit == 63 else 1 << bit


def links(fps: DataFrame) -> DataFrame:
    """Edges ``k, a, b`` whose components are those of all pairs of distinct ``fp`` with one ``k`` within two bits.

    Only buckets with more than one fingerprint are looked at. There, each fingerprint is placed
    at itself and at every fingerprint one bit away (outside the mask); two meet in a place just if
    they differ in at most two bits, and are tied to the one there that a hash puts first. A place holds 65 fingerprints at
    most, so a bucket of any size is done whole without making its pairs.
    """
    masks = covering_masks(RADIUS)
    keyed = fps.select(
        "k", "fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])).alias("m")
    ).select("k", "fp", "m.t", "m.key")
    shared = written(keyed.groupBy("k", "t", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "buckets")
    members = keyed.join(shared, ["k", "t", "key"])
    around = [F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(i))) for i in range(BITS) if not m >> i & 1]) for m in masks]
    places = members.select("k", "fp", F.explode(F.element_at(F.array(*around), F.col("t") + 1)).alias("place")).distinct()
    met = places.groupBy("k", "place").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    first = F.array_min(F.transform("fps", lambda f: F.named_struct(F.lit("order"), F.xxhash64(f), F.lit("fp"), f)))["fp"]
    return met.select("k", first.alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, fp, component_id``.

    ``component_id``: the smallest doc_id reachable over links of two or fewer differing bits,
    itself included. Texts with one fingerprint (copies, and all texts without words, null
    among them: 0) are one node; a null doc_id is no candidate for the smallest. An empty table
    gives no rows; other columns are ignored.
    """
    prints = written(fingerprints(docs, shingle), "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = components(links(nodes.select(F.lit(0).alias("k"), "fp")).select("a", "b"))
    named = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    # Written narrow tables: a fingerprint or component with a third of all rows is split at run time.
    named = written(named, "named")
    least = written(named.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    by_print = written(named.join(least, "component").select("fp", "component_id"), "by-print")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def as_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
