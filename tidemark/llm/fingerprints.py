"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so it grows with
its document, sketches merge by union, and containment can be estimated between documents of
very unequal length. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import full_text, words, written

SHINGLE = 5
#: A hash stays if its top bits are 0: the fraction kept is 2 ** -SCALE_BITS.
SCALE_BITS = 3
#: A block of ``with_next`` has 2 ** BLOCK_BITS ids, so no more documents than that, as ids differ.
BLOCK_BITS = 7
#: Rows of block starts that may be broadcast (16 bytes each).
MAX_BROADCAST_ROWS = 200_000


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def sketch(hashes: str) -> Column:
    """Sorted distinct shingle hashes under the threshold, from the column ``hashes`` of word hashes.

    Fewer words than a shingle make one shingle of all of them; no words, an empty sketch.
    """
    n = F.size(hashes)
    at = lambda i: F.get(F.col(hashes), i)
    low = lambda h: F.shiftrightunsigned(h, 64 - SCALE_BITS) == 0
    long = F.filter(
        F.transform(F.slice(hashes, 1, F.greatest(n - (SHINGLE - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[at(i + j) for j in range(1, SHINGLE)])), low
    )
    short = F.filter(F.array(F.xxhash64(F.col(hashes))), low)
    return F.when(n >= SHINGLE, F.array_sort(F.array_distinct(long))).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))


def as_text(sketch_: Column) -> Column:
    return F.array_join(F.transform(sketch_, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def resemblance(a: Column, b: Column, same_if_empty: Column) -> Column:
    """Estimated share of the shingles of either that both have; of two empty sketches ``same_if_empty`` decides."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, same_if_empty.cast("double")).otherwise(both.cast("double") / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; null for an empty sketch."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)).cast("double") / F.size(a))


def _block(key: Column) -> Column:
    return F.shiftright(key, BLOCK_BITS)


def _following(keys: DataFrame) -> DataFrame:
    """``key, next_key`` for distinct longs: the least larger key, null after the last.

    Keys are taken in blocks; block starts are few, and ordered the same way until a window over
    one partition holds few rows.
    """
    blocks = keys.withColumn("block", _block(F.col("key")))
    starts = written(blocks.groupBy("block").agg(F.min("key").alias("start")), "starts")
    if starts.count() <= 2**BLOCK_BITS:
        after = starts.withColumn("next_start", F.lead("start").over(Window.orderBy("block")))
    else:
        order = _following(starts.select(F.col("block").alias("key"))).alias("o")
        after = (
            starts.join(order, F.col("block") == F.col("o.key"), "left")
            .join(starts.select(F.col("block").alias("next_block"), F.col("start").alias("next_start")), F.col("o.next_key") == F.col("next_block"), "left")
            .select("block", "start", "next_start")
        )
    inside = F.lead("key").over(Window.partitionBy("block").orderBy("key"))
    return blocks.withColumn("inside", inside).join(after, "block").select("key", F.coalesce("inside", "next_start").alias("next_key"))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id, text``) in blocks of ids: adds ``block`` and ``borrowed``.

    Each block also gets, as ``borrowed`` rows at its end, the first document of the next block
    (of the first, after the last), so ``lead`` inside a block finds the next document. Texts
    are shuffled once, and no window spans more than a block.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text"))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    block = _block(key)
    starts = written(own.groupBy(block.alias("block")).agg(F.min(key).alias("start")), "block-starts")
    n = starts.count()
    order = _following(starts.select(F.col("block").alias("key")))
    first = starts.agg(F.min("block")).first()[0]
    lends = written(
        order.withColumn("to", F.col("key"))
        .select("to", F.coalesce("next_key", F.lit(first).cast("long")).alias("block"))
        .join(starts, "block")
        .select("to", F.col("start").alias("lent_key")),
        "lends",
    )
    lends = F.broadcast(lends) if n <= MAX_BROADCAST_ROWS else lends
    placed = own.join(lends, key == F.col("lent_key"), "left").withColumn("own_block", block)
    copies = F.when(F.col("to").isNull(), F.array(F.struct(F.col("own_block").alias("block"), F.lit(False).alias("borrowed")))).otherwise(
        F.array(F.struct(F.col("own_block").alias("block"), F.lit(False).alias("borrowed")), F.struct(F.col("to").alias("block"), F.lit(True).alias("borrowed")))
    )
    return placed.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", "c.block", "c.borrowed")


def fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id, text``) with ``sketch`` (array of longs); other columns are ignored.

    A null text counts as empty and has an empty sketch; equal texts have equal sketches.
    """
    hashed = docs.select("doc_id", full_text().alias("text")).withColumn("hashes", word_hashes(F.col("text")))
    return hashed.select("doc_id", "text", sketch("hashes").alias("sketch"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each row's sketch, that of its edited text, and how alike they and the next document's are.

    The edited text has its last half (rounded down) replaced by the first as many code points
    of the next document in order of doc_id; the last document's next is the first. Rows that
    share a doc_id are taken in order of their texts; a null doc_id comes first; a null text
    counts as empty; a single document is its own next; an empty table gives no rows.
    """
    inside = Window.partitionBy("block").orderBy("borrowed", "doc_id", "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = (
        with_next(docs)
        .withColumn("next_text", F.lead("text").over(inside))
        .withColumn("edited", edited)
        .withColumn("hashes", word_hashes(F.col("text")))
        .withColumn("edited_hashes", F.when(~F.col("borrowed"), word_hashes(F.col("edited"))))
        .withColumn("sketch", sketch("hashes"))
        .withColumn("edited_sketch", F.when(~F.col("borrowed"), sketch("edited_hashes")))
        .select("doc_id", "block", "borrowed", "text", n.cast("long").alias("n_chars"), "edited", "sketch", "edited_sketch", (F.col("text") == F.col("edited")).alias("same_edited"), (F.col("text") == F.col("next_text")).alias("same_next"))
        .withColumn("next_sketch", F.lead("sketch").over(inside))
    )
    return rows.where("NOT borrowed").select(
        "doc_id",
        "n_chars",
        "edited",
        "sketch",
        "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), F.col("same_edited")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), F.col("same_next")).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_in_doc"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("doc_in_next"),
    )
