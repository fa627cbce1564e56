"""Merkle manifest of a dataset: one digest for all rows, one for each source, and for each row the proof that ties it to both.

A row's leaf is the digest of its fields. The leaves of a source stand in order of doc_id (null first; of one doc_id by leaf, so repeated rows stand
side by side and each has its own place), every run of 16 becomes the digest of its digests until one is left, and the sources' digests, in order of
source (null first), make the root in the same way.

Nothing is sorted as a whole. A row's rank is the number of rows before its bucket plus its place inside: buckets are prefixes of the digits of doc_id
(and, where many rows share one, of the leaf), long enough to hold few rows, and histograms of ever shorter prefixes give the rows before each. The
digits of the rank, to base 16, then key the tree's nodes: one group holds the ``256`` nodes that share all digits but the last two.

No rows give no rows. Other columns, whatever they are called, are not read; texts of any length are hashed where they are read and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN_OUT, LEVELS = 16, 2  # digests in a run, and levels of the tree that one grouping makes
CHUNK_BITS = 8  # log2(FAN_OUT**LEVELS)
#: Rows that a bucket may hold before its prefix is made longer, and the digits that prefixes grow by.
BUCKET, DIGITS = 4096, 3
#: The flag of a missing id, and 14 of the 16 digits of one: 256 neighbouring ids.
PREFIX = 15


def leaf(fields: Sequence[str | Column] = FIELDS) -> Column:
    """The digest of fields: each its length in bytes, a colon and itself, or ``-`` if null."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def prove(docs: DataFrame, own: Column | None = None, claimed: Column | None = None, proofs: bool = False) -> DataFrame:
    """``doc_id, leaf, claimed, subroot, root, proof_sha256, folded_root`` of every row of ``docs`` (``doc_id, source`` and what the leaves read).

    ``claimed`` is the leaf that someone shows for the row (by default its own); ``folded_root`` is the root that it and the row's siblings make, so the
    claim holds just if that is ``root``. With ``proofs`` the siblings themselves are there too: ``proof``, for each level the digests to the left and right.
    """
    own = leaf() if own is None else own
    read = docs.select(F.col("doc_id").cast("long").alias("id"), _group(F.col("source")).alias("g"), own.alias("leaf"), (own if claimed is None else claimed).alias("claimed"))
    leaves = _ranked(read)
    stages = _tree(leaves)
    tops = written(stages[-1].select("g", F.col("hash").alias("subroot")), "subroots")
    top_stages = _tree(_ordered(tops))
    root = top_stages[-1].select("hash").first()  # one row
    none = F.array().cast("array<struct<l:string,r:string>>")
    seed = top_stages[-1].select("g", "rank", none.alias("path"), F.col("hash").alias("subroot"))
    for lower in top_stages[-2::-1]:
        seed = _paths(lower, seed)
    # The node of the sources' tree is a source; its path is that of the source's digest.
    named = top_stages[0].select("g", "rank", "name")
    known = named.join(seed.drop("subroot"), ["g", "rank"]).join(tops.withColumnRenamed("g", "name"), "name")
    seed = known.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("rank"), "path", "subroot")
    for lower in stages[-2:0:-1]:
        seed = _paths(lower, seed)
    out = _leaf_proofs(leaves, seed, proofs)
    return out.withColumn("root", F.lit(root.hash if root else None).cast("string"))


def _group(source: Column) -> Column:
    """A key that is never null and keeps the order, null first."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _ranked(read: DataFrame) -> DataFrame:
    """``g, rank, hash, n, id, claimed``: every row with its place in its group from 0, and the group's number of rows; written."""
    digits = F.coalesce(F.concat(F.lit("1"), F.lpad(F.hex(F.col("id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), F.lpad(F.lit("0"), 17, "0"))
    # Repeated rows are one row with a count until they have their places.
    rows = written(read.groupBy("g", "id", "leaf", "claimed").agg(F.count("*").alias("copies")).withColumn("key", F.concat(digits, "leaf")), "leaves")
    placed, buckets = _buckets(rows)
    local = Window.partitionBy("g", "prefix").orderBy("key", "claimed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.col("before") + F.sum("copies").over(local) - F.col("copies")
    met = placed.join(_offsets(buckets), ["g", "prefix"]).withColumn("first", first)
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    out = written(met.select("g", "id", "leaf", "claimed", "n", "first", copy).select("g", (F.col("first") + F.col("copy")).alias("rank"), F.col("leaf").alias("hash"), "n", "id", "claimed"), "ranked")
    dropped(rows)
    return out


def _buckets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``prefix``, and the histogram ``g, prefix, n`` of all prefixes, written. Prefixes grow where more than BUCKET rows share one."""
    length, placed = PREFIX, rows.withColumn("prefix", F.substring("key", 1, PREFIX))
    counts = lambda df: df.groupBy("g", "prefix").agg(F.count("*").alias("rows"), F.sum("copies").alias("n"))
    done, crowded = None, written(counts(placed), "histogram")
    while True:
        fits = crowded.where((F.col("rows") <= BUCKET) | (F.length("prefix") >= 81))
        done = fits if done is None else done.unionByName(fits)
        over = crowded.where((F.col("rows") > BUCKET) & (F.length("prefix") < 81)).select("g", "prefix", F.lit(True).alias("over"))
        if over.isEmpty():
            return placed, written(done, "buckets")
        length += DIGITS
        placed = placed.join(over, ["g", "prefix"], "left").withColumn("prefix", F.when(F.col("over"), F.substring("key", 1, length)).otherwise(F.col("prefix"))).drop("over")
        crowded = written(counts(placed.where(F.length("prefix") == length)), "histogram")


def _offsets(buckets: DataFrame) -> DataFrame:
    """``g, prefix, before, n``: the rows of the group before each bucket, from histograms of prefixes that lose DIGITS digits at a time."""
    longest = buckets.agg(F.max(F.length("prefix"))).first()[0] or PREFIX  # one number
    cuts = list(range(longest - DIGITS, 0, -DIGITS)) + [0]
    tables = [buckets.select("g", "prefix", "n")]
    for cut in cuts:
        tables.append(tables[-1].groupBy("g", F.substring("prefix", 1, cut).alias("prefix")).agg(F.sum("n").alias("n")))
    known = tables[-1].select("g", F.col("prefix").alias("parent"), F.lit(0).cast("long").alias("base"), F.col("n").alias("total"))
    for table, cut in zip(tables[-2::-1], cuts[::-1], strict=True):
        siblings = Window.partitionBy("g", "parent").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = table.withColumn("parent", F.substring("prefix", 1, cut)).withColumn("upto", F.sum("n").over(siblings) - F.col("n"))
        known = own.join(known, ["g", "parent"]).select("g", F.col("prefix").alias("parent"), (F.col("base") + F.col("upto")).alias("base"), "total")
    return written(known.select("g", F.col("parent").alias("prefix"), F.col("base").alias("before"), F.col("total").alias("n")), "offsets")


def _ordered(tops: DataFrame) -> DataFrame:
    """The digests of the sources as the leaves of one group, in order of source: places inside range partitions, and the rows of those before."""
    parts = written(tops.repartitionByRange("g").withColumn("part", F.spark_partition_id()), "ordered")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", before)  # one row a partition
    place = F.row_number().over(Window.partitionBy("part").orderBy("g")) - 1
    n = parts.count()
    met = parts.withColumn("place", place).join(sizes.select("part", "before"), "part")
    return written(met.select(F.lit("").alias("g"), (F.col("before") + F.col("place")).alias("rank"), F.col("subroot").alias("hash"), F.lit(n).cast("long").alias("n"), F.col("g").alias("name")), "sources")


# What follows hashes a group's digests inside a task; a group has at most 256.


def _chunk() -> Column:
    return F.shiftright("rank", CHUNK_BITS).alias("chunk")


def _digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _grown(hashes: list[str], n: int) -> list[list[str]]:
    """The digests and the levels above them: LEVELS, or as many as leave one of the ``n`` digests that the whole tree has here."""
    levels = [hashes]
    while len(levels) <= LEVELS and n > 1:
        levels.append([_digest(levels[-1][i : i + FAN_OUT]) for i in range(0, len(levels[-1]), FAN_OUT)])
        n = -(-n // FAN_OUT)
    return levels


def _siblings(levels: list[list[str]], i: int) -> list[dict[str, str]]:
    """For each level the digests to the left and to the right of the one that ``i`` is under, inside its run."""
    out = []
    for level in levels[:-1]:
        at = i - i % FAN_OUT
        out.append({"l": "".join(level[at:i]), "r": "".join(level[i + 1 : at + FAN_OUT])})
        i //= FAN_OUT
    return out


_PATH = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))


def _tree(leaves: DataFrame) -> list[DataFrame]:
    """Tables of nodes (``g, rank, hash, n``), the leaves first, each with those LEVELS above the last, until every group has one; all written."""

    def up(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        n = table["n"][0].as_py()
        top = _grown(table["hash"].to_pylist(), n)[-1][0]
        return pa.table({"g": table["g"][:1], "rank": table["chunk"][:1], "hash": [top], "n": pa.array([-(-n >> CHUNK_BITS) if n > 1 << CHUNK_BITS else 1], pa.int64())})

    stages = [leaves]
    while True:
        most = stages[-1].agg(F.max("n")).first()[0]  # one number
        if most is None or most <= 1:
            return stages
        nodes = stages[-1].select("g", "rank", "hash", "n", _chunk())
        stages.append(written(nodes.groupBy("g", "chunk").applyInArrow(up, "g string, rank long, hash string, n long"), "nodes"))


def _paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``g, rank, path, subroot`` of ``nodes``: their siblings, then those of the node over them (``above``, with the same columns)."""

    def down(table: pa.Table, parent: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        levels = _grown(table["hash"].to_pylist(), table["n"][0].as_py())
        rest = parent["path"][0].as_py()
        paths = [_siblings(levels, i) + rest for i in range(len(table))]
        return pa.table({"g": table["g"], "rank": table["rank"], "path": pa.array(paths, _PATH), "subroot": pa.array([parent["subroot"][0].as_py()] * len(table), pa.string())})

    own = nodes.select("g", "rank", "hash", "n", _chunk()).groupBy("g", "chunk")
    found = own.cogroup(above.withColumnRenamed("rank", "chunk").groupBy("g", "chunk")).applyInArrow(down, "g string, rank long, path array<struct<l:string,r:string>>, subroot string")
    return written(found, "paths")


def _leaf_proofs(leaves: DataFrame, above: DataFrame, proofs: bool) -> DataFrame:
    """What ``prove`` returns, but for the root: every leaf with the digest of its siblings and what its claim folds to."""

    def fold(table: pa.Table, parent: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        levels = _grown(table["hash"].to_pylist(), table["n"][0].as_py())
        rest, folded, digests, shown = parent["path"][0].as_py(), [], [], []
        for i, claim in enumerate(table["claimed"].to_pylist()):
            path = _siblings(levels, i) + rest
            for step in path:
                claim = _digest((step["l"], claim, step["r"]))
            folded.append(claim)
            digests.append(_digest([s for step in path for s in (step["l"], step["r"])]))
            shown.append(path)
        out = {"doc_id": table["id"], "leaf": table["hash"], "claimed": table["claimed"], "subroot": pa.array([parent["subroot"][0].as_py()] * len(table), pa.string()), "proof_sha256": digests, "folded_root": folded}
        return pa.table(out | ({"proof": pa.array(shown, _PATH)} if proofs else {}))

    schema = "doc_id long, leaf string, claimed string, subroot string, proof_sha256 string, folded_root string" + (", proof array<struct<l:string,r:string>>" if proofs else "")
    own = leaves.select("g", "rank", "hash", "n", "id", "claimed", _chunk()).groupBy("g", "chunk")
    return own.cogroup(above.withColumnRenamed("rank", "chunk").groupBy("g", "chunk")).applyInArrow(fold, schema)
