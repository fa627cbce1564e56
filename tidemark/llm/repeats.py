"""Repeated windows of documents, found by a parse into phrases (see ``windows``).

The parse of every document is met with the triggers that occur more than once; what is left makes a
dictionary of distinct phrases. A phrase that occurs twice has only repeated windows, however
many copies there are, so copies are never compared. Where distinct phrases share a trigger, one of each
is cut out of its document, and these stretches are looked into.

Rows are keyed by ``id`` (the doc_id; null counts as the smallest) and ``tkey`` (a hash of the text), so
rows that repeat a document's id and text are judged alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, full_text, written
from tidemark.llm.windows import Parser

#: Of a text (UTF-8): two 64-bit numbers for each symbol.
Symbols = Callable[[bytes], tuple[np.ndarray, np.ndarray]]
_KEY = ["id", "tkey"]


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` (null: empty) with the key; text stays with its row."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(doc_id, F.lit(-(2**63))).alias("id"),
        F.shiftright(F.xxhash64(full_text()), 32).cast("int").alias("tkey"),
        full_text().alias("text"),
    )


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


_PHRASE = ["trigger", "content", "content2"]


def parse(docs: DataFrame, parser: Parser, symbols: Symbols) -> DataFrame:
    """The phrases of ``keyed`` documents: ``trigger, content, content2, id, tkey, first, n, d``.

    ``first``: start of the phrase's first window; ``n``: its windows; ``d``: from there to the trigger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, k, t in zip(b["id"].to_pylist(), b["tkey"].to_pylist(), b["text"], strict=True):
                p = parser.phrases(symbols(utf8(t.as_py())))
                m = len(p.first)
                if m:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(p.trigger), pa.array(p.content), pa.array(p.content2), pa.array(np.full(m, i)), pa.array(np.full(m, k, np.int32)),
                         *(pa.array(x.astype(np.int32)) for x in (p.first, p.last - p.first + 1, p.at - p.first))],
                        names=[*_PHRASE, "id", "tkey", "first", "n", "d"],
                    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return docs.select("id", "tkey", "text").mapInArrow(joined, "trigger long, content long, content2 long, id long, tkey int, first int, n int, d int")


def repeated_phrases(docs: DataFrame, parser: Parser, symbols: Symbols) -> DataFrame:
    """The phrases whose trigger occurs more than once, written. Every text is parsed once; the triggers' counts are
    pre-aggregated, and the join with them may be split at run time."""
    parsed = written(parse(docs, parser, symbols), "parsed")
    triggers = written(parsed.groupBy("trigger").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "triggers")
    out = written(parsed.join(triggers, "trigger"), "phrases")
    for done in (parsed, triggers):
        dropped(done)
    return out


def dictionary(phrases: DataFrame) -> DataFrame:
    """Distinct phrases, written: ``entry`` (a number), ``trigger, content, content2, copies`` and the earliest occurrence
    ``first_in`` (``id, first, tkey, n, d``)."""
    where = F.struct("id", "first", "tkey", "n", "d")
    found = phrases.groupBy(*_PHRASE).agg(F.count("*").alias("copies"), F.min(where).alias("first_in"))
    return written(found.withColumn("entry", F.monotonically_increasing_id()), "dictionary")


def with_rivals(entries: DataFrame) -> DataFrame:
    """Dictionary entries as phrases at their earliest occurrences: ``entry, trigger, copies, rivals`` (entries with that trigger)
    ``, id, tkey, first, n, d``."""
    rivals = written(entries.groupBy("trigger").agg(F.count("*").alias("rivals")), "rivals")
    return entries.join(rivals, "trigger").select("entry", "trigger", "copies", "rivals", *[f"first_in.{c}" for c in ("id", "tkey", "first", "n", "d")])


def compressed(docs: DataFrame) -> DataFrame:
    """``keyed`` documents with ``text`` as zstandard bytes, which shuffles carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            packed = pa.array((pack.compress(utf8(t.as_py())) for t in b["text"]), pa.binary())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["id"], b["tkey"], packed], names=["doc_id", "id", "tkey", "packed"])

    return docs.select("doc_id", "id", "tkey", "text").mapInArrow(run, "doc_id long, id long, tkey int, packed binary")


def lists(column: pa.ListArray) -> tuple[list[int], pa.Array]:
    """Where each row's list starts and ends among all elements (a null list is empty), and these."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return [0, *np.cumsum(size).tolist()], column.flatten()


def unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


def stretches(
    docs: DataFrame, phrases: DataFrame, carry: list[str], cut: Callable[[bytes], Callable[[int, int], bytes]], give: Callable[[bytes, int, int], tuple], schema: str, parser: Parser
) -> DataFrame:
    """For each of ``phrases`` (``id, tkey, first, n, d`` and the longs of ``carry``), what ``give(stretch, n, d)`` makes of its
    content, read from its document: the columns of ``carry``, ``id, tkey, first, n, d`` and those of ``schema``.

    ``cut(text)(start, end)`` gives the symbols from ``start`` to ``end``, as many as there are.
    """
    by_document = phrases.groupBy(*_KEY).agg(F.collect_list(F.struct(*carry, "first", "n", "d")).alias("own"))  # bounded by the document's length
    one = docs
    if not docs.groupBy(*_KEY).count().where("count > 1").isEmpty():
        one = docs.dropDuplicates(_KEY)
    whole = ", ".join([*(f"{c} long" for c in carry), "id long", "tkey int", "first int", "n int", "d int", schema])
    names = [c.split()[0] for c in whole.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in whole.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_ in batches:
            for at in range(0, whole_.num_rows, 64):
                b = whole_.slice(at, 64)
                ends, own = lists(b["own"])
                given = []
                places = list(zip(*(own.field(c).to_pylist() for c in ("first", "n", "d")), strict=True))
                for k, packed in enumerate(b["packed"]):
                    part = cut(unpack(packed.as_py()))
                    for first, n, d in places[ends[k] : ends[k + 1]]:
                        given.append(give(part(first, max(first + n - 1 + parser.window, first + d + parser.reach)), n, d))
                times = np.repeat(np.arange(b.num_rows), np.diff(ends))
                columns = [*(own.field(c) for c in carry), *(b[c].take(pa.array(times)) for c in _KEY), *(own.field(c) for c in ("first", "n", "d"))]
                columns += [pa.array(c, t) for c, t in zip(zip(*given, strict=True), types[len(columns) :], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    met = compressed(one).join(by_document, _KEY).select("id", "tkey", "packed", "own")
    return met.mapInArrow(run, whole)


def with_removals(docs: DataFrame, removals: DataFrame, finish: Callable[[bytes, np.ndarray], dict], schema: str) -> DataFrame:
    """One row per row of ``keyed`` documents: ``doc_id`` and what ``finish(text, removed)`` gives.

    ``removals``: ``id, tkey, lo, hi, kind``, stretches of starts of repeated windows (``lo`` to ``hi``, inclusive).
    ``removed`` holds them as rows of three, in no order.
    """
    own = removals.groupBy(*_KEY).agg(F.collect_list(F.struct("lo", "hi", "kind")).alias("removed"))  # bounded by the document's length
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                ends, own = lists(b["removed"])
                spans = np.stack([own.field(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "kind")], axis=1)
                out = [finish(unpack(packed.as_py()), spans[ends[k] : ends[k + 1]]) for k, packed in enumerate(b["packed"])]
                yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array([o[n] for o in out]) for n in names)], names=["doc_id", *names])

    met = compressed(docs).join(own, _KEY, "left").select("doc_id", "packed", "removed")
    return met.mapInArrow(run, f"doc_id long, {schema}")
