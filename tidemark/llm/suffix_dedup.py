"""Dedup of repeated byte strings by prefix-free parsing.

Rolling-hash triggers cut every document into phrases. The dictionary holds each distinct phrase once with the number of its
copies; where a phrase has copies, all suffixes that start in it have an equal neighbour in corpus order, and that
settles them. The other phrases are put in order: the dictionary's suffixes that end at a trigger are sorted from
their ends, the parse's suffixes, which start at a trigger, from their starts (``suffix_array``). A suffix of the
corpus is one of the dictionary's followed by one of the parse's, so its class of equal prefixes in corpus order is a
pair of intervals, one of each array, and it repeats just if another suffix is in both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import repeats, suffix_array
from tidemark.llm.common import dropped, written
from tidemark.llm.windows import Parser, byte_values, covered

#: Strings of LENGTH bytes are removed; the parse finds all repeats from SEED bytes on.
LENGTH, SEED, GRAM = 400, 200, 40
#: Marks of a start: of a repeated string of SEED bytes, of one of LENGTH bytes.
_SHORT, _LONG = 1, 2


def byte_symbols(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text, dtype=np.uint8)
    return byte_values(0)[data], byte_values(1)[data]


def cut_bytes(text: bytes):
    return lambda start, end: text[start:end]


def _both_sides(stretch: bytes, n: int, d: int) -> tuple[bytes, bytes, bytes, bytes]:
    """What is before the trigger (backwards) and from it on, each with a key."""
    before, after = stretch[:d][::-1], stretch[d:]
    return before, after, xxhash.xxh3_128_digest(before), xxhash.xxh3_128_digest(after)


def _pairs(n: int, d: int, left: tuple[list[int], list[int], int], right: tuple[list[int], list[int], int], length: int) -> Iterator[tuple[int, int, int, int]]:
    """The classes of the strings of ``length`` bytes that start in a phrase: left and right interval, first and last start.

    ``left``, ``right``: ``hi, node, uses`` of ``suffix_array.intervals``. A string that starts k bytes before the trigger shares k bytes
    to the left and ``length - k`` from the trigger on. Strings that nothing else can equal are left out.
    """
    (lhi, lnode, luses), (rhi, rnode, ruses) = left, right
    i, j = 0, len(rhi) - 1
    k = max(d - n + 1, length - rhi[-1])
    while k <= d:
        while lhi[i] < k:
            i += 1
        while j and rhi[j - 1] >= length - k:
            j -= 1
        end = min(d, lhi[i], length - (rhi[j - 1] if j else -1) - 1)
        if not (luses == 1 and lnode[i] & suffix_array.LEAF == suffix_array.LEAF or ruses == 1 and rnode[j] & suffix_array.LEAF == suffix_array.LEAF):
            yield lnode[i], rnode[j], d - end, d - k
        k = end + 1


def _classes(stretches: DataFrame, length: int, seed: int) -> DataFrame:
    """``entry, left, right, kind, lo, hi`` (starts in the phrase): rows of one class have equal ``left, right, kind``."""

    def arrays(side: str, key: str) -> DataFrame:
        strings = stretches.groupBy(F.col("trigger").alias("group"), F.col(key).alias("key")).agg(F.min(side).alias("s"), F.count("*").alias("uses"))
        found = suffix_array.intervals(strings, side)
        return found.select(F.col("group").alias("trigger"), F.col("key").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in ("hi", "node", "uses")])

    dictionary, parse = arrays("before", "before_key"), arrays("after", "after_key")
    # A string that is a class of its own on either side throughout has nothing to equal.
    alone = lambda side: (F.col(f"{side}_uses") == 1) & (F.get(f"{side}_node", 0).bitwiseAND(suffix_array.LEAF) == suffix_array.LEAF)
    dictionary, parse = dictionary.where(~alone("before")), parse.where(~alone("after"))
    met = stretches.select("entry", "trigger", "before_key", "after_key", "n", "d").join(dictionary, ["trigger", "before_key"]).join(parse, ["trigger", "after_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sides = []
            for side in ("before", "after"):
                ends, his = repeats.lists(b[f"{side}_hi"])
                his, nodes = his.to_pylist(), repeats.lists(b[f"{side}_node"])[1].to_pylist()
                sides.append([(his[i:j], nodes[i:j], u) for i, j, u in zip(ends, ends[1:], b[f"{side}_uses"].to_pylist(), strict=False)])
            rows: list[int] = []
            out: list[tuple[int, int, int, int]] = []
            kinds: list[int] = []
            for size, kind in ((seed, _SHORT), (length, _LONG)):
                for r, (n, d, left, right) in enumerate(zip(b["n"].to_pylist(), b["d"].to_pylist(), *sides, strict=True)):
                    found = list(_pairs(n, d, left, right, size))
                    out += found
                    rows += [r] * len(found)
                kinds += [kind] * (len(out) - len(kinds))
            if out:
                types = [pa.int64()] * 2 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays(
                    [b["entry"].take(pa.array(rows)), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)), pa.array(kinds, pa.int8())],
                    names=["entry", "left", "right", "lo", "hi", "kind"],
                )

    columns = [f"{side}_{c}" for side in ("before", "after") for c in ("hi", "node", "uses")]
    return met.select("entry", "n", "d", *columns).mapInArrow(run, "entry long, left long, right long, lo int, hi int, kind byte")


def repeated_starts(docs: DataFrame, length: int = LENGTH, seed: int = SEED, gram: int = GRAM) -> DataFrame:
    """Of ``keyed`` documents: ``id, tkey, lo, hi, kind``, runs of starts of strings that also start elsewhere."""
    parser = Parser(seed, gram, length)
    phrases = repeats.repeated_phrases(docs, parser, byte_symbols)
    entries = repeats.dictionary(phrases)
    contested = repeats.with_rivals(entries).where("rivals > 1")
    sides = "before binary, after binary, before_key binary, after_key binary"
    stretches = written(repeats.stretches(docs, contested, ["entry", "trigger"], cut_bytes, _both_sides, sides, parser), "stretches")
    classes = written(_classes(stretches, length, seed), "classes")
    dropped(stretches)
    key = ["left", "right", "kind"]
    # Counts are pre-aggregated, and the join with them may be split at run time.
    again = written(classes.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").drop("c"), "again")
    inside = written(classes.join(again, key).groupBy("entry").agg(F.collect_set(F.struct("lo", "hi", "kind")).alias("spans")), "inside")  # bounded by the phrase's length
    everything = F.array(F.struct(F.lit(0).alias("lo"), F.lit(-1).alias("hi"), F.lit(_SHORT | _LONG).cast("byte").alias("kind")))
    verdicts = written(
        entries.join(inside, "entry", "left")
        .where("copies > 1 OR spans IS NOT NULL")
        .select("trigger", "content", "content2", F.when(F.col("copies") > 1, everything).otherwise(F.col("spans")).alias("spans")),
        "verdicts",
    )
    found = phrases.join(verdicts, ["trigger", "content", "content2"]).select("id", "tkey", "first", "n", F.explode("spans").alias("s"))
    hi = F.when(F.col("s.hi") < 0, F.col("n") - 1).otherwise(F.col("s.hi"))
    return found.select("id", "tkey", (F.col("first") + F.col("s.lo")).alias("lo"), (F.col("first") + hi).alias("hi"), "s.kind")


def deduplicate(docs: DataFrame, length: int = LENGTH, seed: int = SEED, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, n_bytes, n_removed, n_spans, n_repeated, kept`` (bytes).

    Every byte (UTF-8) covered by a string of ``length`` bytes that starts anywhere else too, in the same
    document or another, is removed; the input is judged, not what is left. ``n_spans``: maximal removed runs. ``n_repeated``:
    bytes covered by strings of ``seed`` bytes (at most ``length``) that also start elsewhere; these stay where the longer
    ones do not hold them. Texts shorter than ``length``
    keep everything, null texts are empty, repeated rows are elsewhere for one another; an empty table
    gives no rows; other columns are ignored. ``kept`` may begin or end inside a character.
    """

    def finish(text: bytes, starts: np.ndarray) -> dict:
        runs = {}
        for kind, size in ((_LONG, length), (_SHORT, seed)):
            own = starts[(starts[:, 2] & kind > 0) & (starts[:, 0] <= len(text) - size)]
            runs[kind] = covered(own[:, 0], np.minimum(own[:, 1], len(text) - size) + size, len(text))
        gone = runs[_LONG]
        edges = np.concatenate([[0], gone.ravel(), [len(text)]]).reshape(-1, 2)
        kept = b"".join(text[lo:hi] for lo, hi in edges)
        return {"n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(gone), "n_repeated": int((runs[_SHORT][:, 1] - runs[_SHORT][:, 0]).sum()), "kept": kept}

    own = repeats.keyed(docs)
    return repeats.with_removals(own, repeated_starts(own, length, seed, gram), finish, "n_bytes long, n_removed long, n_spans long, n_repeated long, kept binary")
