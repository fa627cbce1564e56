"""Dedup of repeated phrases with sharded Aho-Corasick automata.

Documents are parsed into phrases, and those whose trigger recurs are kept (see ``repeats``). Windows that more than one distinct
phrase has are confirmed as recurring passages and compiled into Aho-Corasick automata over words, sharded
by trigger; every distinct phrase that can hold a passage of a shard is streamed through it, once however many copies it has, which
locates each occurrence by its words, and the copies of a phrase share what is found in it. A trigger with very many passages or stretches is split over several
automata and streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import repeats
from tidemark.llm.common import dropped, written
from tidemark.llm.windows import Parser, Rolling, _mix, covered

LENGTH, GRAM = 20, 5
#: Passages of an automaton, and stretches of a stream, about.
PASSAGES, STRETCHES = 4000, 8000
_SALT = np.uint64(0x5851F42D4C957F2D)


def word_symbols(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    words = text.split()  # bytes: at the six white-space characters of ASCII
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    return h, _mix(h ^ _SALT)


def cut_words(text: bytes):
    words = text.split()
    return lambda start, end: b" ".join(words[start:end])


def _recurring(stretches: DataFrame, length: int) -> DataFrame:
    """Windows that occur in more than one stretch, written: ``trigger, entry, at`` (where the text can be read) and the
    earliest occurrence's ``first`` (``id, start``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            for r in b.to_pylist():
                at = np.arange(r["n"])
                m = len(at)
                hashes = [Rolling(v, k).grams(length).view(np.int64) for k, v in enumerate(word_symbols(r["stretch"]))]
                for k, v in enumerate((*hashes, np.full(m, r["trigger"]), np.full(m, r["id"]), at.astype(np.int32) + np.int32(r["first"]), np.full(m, r["entry"]), at.astype(np.int32))):
                    out[k].append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["w1", "w2", "trigger", "id", "start", "entry", "at"])

    rows = stretches.mapInArrow(run, "w1 long, w2 long, trigger long, id long, start int, entry long, at int")
    found = rows.groupBy("w1", "w2", "trigger").agg(F.count("*").alias("c"), F.min(F.struct("id", "start")).alias("first"), F.min(F.struct("entry", "at")).alias("source"))
    return written(found.where("c > 1").select("trigger", "source.entry", "source.at", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start")), "recurring")


def _located(stretches: DataFrame, recurring: DataFrame, length: int) -> DataFrame:
    """Windows of stretches that also start earlier: ``entry, lo, hi``, runs of their places in the phrase."""
    texts = stretches.select("entry", F.col("stretch").alias("passage"))
    taken = recurring.groupBy("entry").agg(F.collect_list(F.struct("at", "trigger", "first_id", "first_start")).alias("p"))  # bounded by the phrase
    passages = taken.join(texts, "entry").select("passage", F.explode("p").alias("p")).select("passage", "p.*")
    # How many automata and streams a trigger needs: one of each but for very common ones.
    parts = written(
        recurring.groupBy("trigger").agg(F.count("*").alias("p")).join(stretches.groupBy("trigger").agg(F.count("*").alias("s")), "trigger")
        .select("trigger", F.ceil(F.col("p") / PASSAGES).cast("int").alias("a"), F.ceil(F.col("s") / STRETCHES).cast("int").alias("b")),
        "parts",
    )
    shards = max(1, recurring.count() // PASSAGES)
    shard = F.pmod(F.xxhash64("trigger"), F.lit(shards)).alias("shard")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    automata = passages.join(parts, "trigger").select(shard, F.pmod(F.xxhash64("first_id", "first_start"), "a").cast("int").alias("i"), upto("b").alias("j"), "passage", "at", "first_id", "first_start")
    streams = stretches.join(parts, "trigger").select(shard, upto("a").alias("i"), F.pmod(F.xxhash64("entry"), "b").cast("int").alias("j"), "entry", "id", F.col("first").alias("start"), "stretch")

    def locate(stream: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        numbers: dict[bytes, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, (passage, at) in enumerate(zip(known["passage"], known["at"], strict=True)):
            automaton.add_word(tuple(numbers.setdefault(w, len(numbers) + 1) for w in passage.split()[at : at + length]), k)
        if len(known):
            automaton.make_automaton()
            number, first = numbers.get, list(zip(known["first_id"].tolist(), known["first_start"].tolist(), strict=True))
            for entry, i, start, stretch in zip(stream["entry"].tolist(), stream["id"].tolist(), stream["start"].tolist(), stream["stretch"], strict=True):
                for end, k in automaton.iter(tuple([number(w, 0) for w in stretch.split()])):
                    at = end - length + 1
                    if first[k] < (i, start + at):
                        if out and out[-1][0] == entry and out[-1][2] == at - 1:
                            out[-1] = (entry, out[-1][1], at)
                        else:
                            out.append((entry, at, at))
        return pd.DataFrame(out, columns=["entry", "lo", "hi"])

    cells = ["shard", "i", "j"]
    return streams.groupBy(*cells).cogroup(automata.groupBy(*cells)).applyInPandas(locate, "entry long, lo int, hi int")


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Of ``keyed`` documents: ``id, tkey, lo, hi, kind``, runs of starts of windows that also start earlier."""
    parser = Parser(length, gram)
    phrases = repeats.repeated_phrases(docs, parser, word_symbols)
    entries = repeats.dictionary(phrases)
    contested = repeats.with_rivals(entries).where("rivals > 1")
    stretches = written(repeats.stretches(docs, contested, ["entry", "trigger"], cut_words, lambda stretch, n, d: (stretch,), "stretch binary", parser), "stretches")
    located = _located(stretches, _recurring(stretches, length), length)
    inside = written(located.groupBy("entry").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "inside")  # bounded by the phrase
    dropped(stretches)
    verdicts = written(
        entries.join(inside, "entry", "left")
        .where("copies > 1 OR spans IS NOT NULL")
        .select("trigger", "content", "content2", F.col("first_in.id").alias("first_id"), F.col("first_in.first").alias("first_start"), "spans"),
        "verdicts",
    )
    found = phrases.join(verdicts, ["trigger", "content", "content2"])
    # A later copy of a phrase goes whole; the earliest one loses what other phrases had before.
    all_of_it = F.array(F.struct(F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi")))
    earliest = (F.col("id") == F.col("first_id")) & (F.col("first") == F.col("first_start"))
    return (
        found.select("id", "tkey", "first", F.explode(F.when(earliest, F.col("spans")).otherwise(all_of_it)).alias("s"))
        .select("id", "tkey", (F.col("first") + F.col("s.lo")).alias("lo"), (F.col("first") + F.col("s.hi")).alias("hi"), F.lit(1).cast("byte").alias("kind"))
    )


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, n_words, n_removed, kept``.

    Every word covered by a window of ``length`` words whose sequence also starts earlier (in a smaller
    doc_id, or before it in the same document) is removed; the input is judged, not what is left. ``kept``: the other words,
    joined by one space. A null doc_id is the smallest; rows that share doc_id and text are
    one document and judged alike; a null text has no words; an empty table gives no rows; other columns are ignored.
    """

    def finish(text: bytes, starts: np.ndarray) -> dict:
        words = text.split()
        edges = np.concatenate([[0], covered(starts[:, 0], starts[:, 1] + length, len(words)).ravel(), [len(words)]]).reshape(-1, 2)
        kept = [w for lo, hi in edges for w in words[lo:hi]]
        return {"n_words": len(words), "n_removed": len(words) - len(kept), "kept": b" ".join(kept).decode("utf-8", "replace")}

    own = repeats.keyed(docs)
    return repeats.with_removals(own, repeated_starts(own, length, gram), finish, "n_words long, n_removed long, kept string")
