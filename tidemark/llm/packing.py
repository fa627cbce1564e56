"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Pieces are dealt to blocks of bounded size, and each block to a few islands. On an island, genomes are whole packings of
its block: crossover injects well-filled bins of one parent into the other, removes what that duplicates, and
best-fits the displaced pieces. Between epochs each island's elite migrates to the next island of the ring. The
block's best packing then settles its well-filled bins, and the pieces of the others are dealt anew, until one block is left.
"""

from __future__ import annotations

import bisect
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from tidemark.llm.byte_bpe import LATER, byte_characters
from tidemark.llm.common import temporary, written

CAPACITY = 4096
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
#: Pieces of a block, about; a settled bin wastes at most this share.
BLOCK, SETTLED = 2048, 1 / 256
#: Islands of a block, epochs between which elites migrate, and an island's genomes, generations and children of each.
ISLANDS, EPOCHS = 2, 2
GENOMES, GENERATIONS, CHILDREN = 4, 4, 2
#: A block that has settled this share of its pieces' tokens or less is packed for good.
PROGRESS = 1 / 64
#: Words that a worker remembers the ids of (those met lately), and their longest length.
MAX_WORDS, WORD_CHARS = 250_000, 40
#: Documents encoded at once, and words that are new to a worker.
BATCH, LEARNED = 512, 16_384

#: Characters that libraries disagree about being white space, or that lower-case by their context: such texts are encoded whole.
_ODD = r"[\x1c-\x1f\x{85}\x{180e}\x{200b}\x{feff}\x{3a3}]"
#: A letter and a mark after it: no match holds both (but for apostrophes, which can begin one), so a word ends there and is met without its marks.
_EDGE = r"([a-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])"
#: The vocabulary's pattern for what is encoded by itself (fixed value), or the end of a line of words.
_MATCH = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")


class WordEncoder:
    """Ids of whole texts by way of their words.

    The vocabulary lower-cases and drops white space, and no match of its pattern crosses it, so a text's ids are those
    of its words in order. Each word goes through the library's model once, as long as it is remembered; marks after
    it are words of their own, so ``word``, ``word.`` and ``word,`` are one word to it.
    """

    def __init__(self, path: str = VOCABULARY):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.spelling = np.array([ord(c) for c in byte_characters()], dtype="<u4")
        self.spelling[[ord(" "), ord("\n")]] = ord(" "), ord("\n")  # between matches and between words
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of words that are not remembered: all are lower-cased, matched and spelled as one text, a line each."""
        text = "\n".join(words).lower()
        text = " ".join(_MATCH.findall(text)).encode()
        lines = self.spelling[np.frombuffer(text, dtype=np.uint8)].tobytes().decode("utf-32-le").split("\n")
        tokenize = self.model.tokenize
        found = [[t.id for match in line.split() for t in tokenize(match)] for line in lines]
        data = np.fromiter(chain.from_iterable(found), dtype="<u4").tobytes()
        ends = [0, *accumulate(4 * len(f) for f in found)]
        return [data[a:b] for a, b in pairwise(ends)]

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each of these different words."""
        if 2 * len(self.known) > MAX_WORDS:
            self.known, self.older = {}, self.known
        ids = list(map(self.known.get, words))
        new = [k for k, i in enumerate(ids) if i is None]
        unknown = []
        for k in new:
            word = words[k]
            ids[k] = self.older.get(word)
            if ids[k] is None:
                if word.isascii() or max(low := word.lower()) < LATER:
                    unknown.append(k)
                else:
                    ids[k] = self.whole(low)
        for at in range(0, len(unknown), LEARNED):
            some = unknown[at : at + LEARNED]
            for k, i in zip(some, self._learn([words[k] for k in some]), strict=True):
                ids[k] = i
        self.known.update((words[k], ids[k]) for k in new if len(words[k]) <= WORD_CHARS)
        return ids

    def encode_batch(self, texts: pa.StringArray) -> list[bytes]:
        """The ids of each text, little-endian and 32 bits each; a null text has none."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(~pc.string_is_ascii(texts).to_numpy(zero_copy_only=False) & ~odd):
            odd[k] = not unicodedata.is_normalized("NFC", texts[int(k)].as_py())
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), _EDGE, r"\1 \2"))
        coded = words.flatten().dictionary_encode()
        # The distinct words as one text, cut by Python: much quicker than a list made of Arrow's values.
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py()
        ids, codes = self._ids(joined.split(" ")), coded.indices.to_numpy()
        # Each word's ids, one after another: a gather from the ids of the distinct words.
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        start, per_word = np.cumsum(size) - size, size[codes]
        ends = np.cumsum(per_word)
        out = np.frombuffer(b"".join(ids), dtype="<u4")[np.repeat(start[codes] - (ends - per_word), per_word) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[words.offsets.to_numpy()]
        return [self.whole(texts[k].as_py()) if odd[k] else out[edges[k] : edges[k + 1]].tobytes() for k in range(len(texts))]


@cache
def _encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path)


def tokenize(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``doc_id, piece, start, length, ids`` (binary, little-endian 32-bit).

    A document is its ids and the end id; only longer ones are cut, whatever their length. A null or empty text is the end id alone; repeated
    rows give repeated pieces; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, size, own = struct.pack("<I", END_ID), 4 * capacity, _encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                out = [
                    (i, p // size, p // 4, len(ids[p : p + size]) // 4, ids[p : p + size])
                    for i, body in zip(b["doc_id"].to_pylist(), own.encode_batch(b["text"]), strict=True)
                    for ids in [body + end]
                    for p in range(0, len(ids), size)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )
            pa.default_memory_pool().release_unused()  # workers live on into later stages

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, order: np.ndarray, room: list[int], capacity: int) -> np.ndarray:
    """The bin of each piece of ``order``, placed in turn where least room is left over; ``room`` grows by the bins opened."""
    free = sorted((r, i) for i, r in enumerate(room))
    out = np.empty(len(order), dtype=np.int64)
    for k, piece in enumerate(order):
        need = int(lengths[piece])
        at = bisect.bisect_left(free, (need, -1))
        if at < len(free):
            r, i = free.pop(at)
        else:
            r, i = capacity, len(room)
            room.append(capacity)
        room[i] = r - need
        out[k] = i
        bisect.insort(free, (r - need, i))
    return out


def _fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the greater mean of squared fill: full bins, and what is left over in as few as can be. The least is the best."""
    fill = np.bincount(bins, weights=lengths)
    fill = fill[fill > 0]
    return len(fill), -float(((fill / capacity) ** 2).mean())


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Well-filled bins of ``a`` go whole into ``b``; bins of ``b`` they touch dissolve; displaced pieces are best-fitted."""
    fill = np.bincount(a, weights=lengths)
    good = np.flatnonzero(fill >= np.quantile(fill[fill > 0], 0.5))
    chosen = rng.choice(good, size=max(1, len(good) // 2), replace=False)
    injected = np.isin(a, chosen)
    broken = np.isin(b, np.unique(b[injected]))
    stays = ~injected & ~broken
    child = np.empty_like(a)
    names = np.unique(a[injected], return_inverse=True)[1]
    child[injected] = names
    kept, own = np.unique(b[stays], return_inverse=True)
    base = int(names.max()) + 1
    child[stays] = base + own
    settled = injected | stays
    room = (capacity - np.bincount(child[settled], weights=lengths[settled], minlength=base + len(kept))).astype(np.int64).tolist()
    displaced = np.flatnonzero(~settled)
    displaced = displaced[np.argsort(-lengths[displaced], kind="stable")]
    child[displaced] = best_fit(lengths, displaced, room, capacity)
    return child


def evolve(lengths: np.ndarray, genomes: list[np.ndarray], capacity: int, rng: np.random.Generator, counts: dict[str, int] | None = None) -> list[np.ndarray]:
    """An epoch of an island: ``genomes``, and packings of its own to make up their number, through all generations; the best comes first.

    It ends early only when no packing can be better: the least number of bins, all full but one. ``counts`` gets the number of crossovers.
    """
    n = len(lengths)
    least, rest = divmod(int(lengths.sum()), capacity)
    perfect = (least + (rest > 0), -(least + (rest / capacity) ** 2) / max(1, least + (rest > 0)))
    fitness = lambda g: _fitness(g, lengths, capacity)
    genomes = list(genomes)
    while len(genomes) < GENOMES:
        # Best fit in about falling order; each island and genome has an order of its own.
        order = np.argsort(-lengths * rng.uniform(0.7, 1.0, n), kind="stable")
        place = np.empty(n, dtype=np.int64)
        place[order] = best_fit(lengths, order, [], capacity)
        genomes.append(place)
    genomes.sort(key=fitness)
    for _ in range(GENERATIONS):
        number, fill = fitness(genomes[0])
        if n < 3 or number <= perfect[0] and fill <= perfect[1] + 1e-12:
            break
        pairs = [(int(rng.integers(2)), int(rng.integers(len(genomes)))) for _ in range(CHILDREN)]
        children = [crossover(genomes[a], genomes[b], lengths, capacity, rng) for a, b in pairs]
        if counts is not None:
            counts["crossovers"] = counts.get("crossovers", 0) + len(children)
        genomes = sorted(genomes + children, key=fitness)[:GENOMES]
    return genomes


def _epoch(capacity: int, round_: int, epoch: int):
    """What an island does in an epoch: its block's pieces come with the island's own elite and the one that migrated to it."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        pdf = pdf.sort_values(["_length", "_key"], ascending=False, kind="stable").reset_index(drop=True)
        lengths = pdf["_length"].to_numpy(dtype=np.int64)
        known = [np.unique(pdf[c], return_inverse=True)[1] for c in ("_elite", "_guest") if epoch or (island == 0 and c == "_elite" and round_)]
        if not epoch and island == 0:  # one genome of the first island is packed in falling order
            place = np.empty(len(lengths), dtype=np.int64)
            down = np.arange(len(lengths))
            place[down] = best_fit(lengths, down, [], capacity)
            known.append(place)
        best = evolve(lengths, known, capacity, np.random.default_rng([round_, epoch, block, island]))[0]
        number, fill = _fitness(best, lengths, capacity)
        keys = pdf["_key"].to_numpy()
        name = np.full(int(best.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(name, best, keys)  # a name that no other bin has: its least piece
        return pd.DataFrame({"_block": block, "_island": island, "_key": keys, "_length": lengths, "_elite": name[best], "_bins": number, "_fill": -fill})

    return run


_STATE = "_block int, _island int, _key long, _length long, _elite long, _bins long, _fill double"


def _best_of_block(state: DataFrame) -> DataFrame:
    """The packing of each block's best island."""
    islands = state.groupBy("_block", "_island").agg(F.first("_bins").alias("bins"), F.first("_fill").alias("fill"))
    best = islands.groupBy("_block").agg(F.min(F.struct("bins", -F.col("fill"), "_island")).alias("b")).select("_block", F.col("b._island").alias("_island"))
    return state.join(best, ["_block", "_island"]).select("_block", "_key", "_length", "_elite")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length``) with ``sequence_id`` and ``offset`` added, columns of those names replaced and others kept, whatever they are
    called: every piece has its place in a sequence of at most ``capacity``, gapless from 0. Lengths are from 1 to ``capacity``.

    Equal lengths are told apart by a number of the row, so repeated rows are packed like any others. Only keys and lengths
    go through the search. Every epoch is written before the next. Blocks hold about BLOCK pieces whatever the
    input's size; the pieces dealt anew are a small share, so a few rounds end in one block. An empty table gives no rows.
    """
    key, bin_, at, done = temporary("key", "bin", "at", "done")
    keyed = written(pieces.withColumn(key, F.monotonically_increasing_id()), "pieces")
    left = keyed.select(F.col(key).alias("_key"), F.col("length").cast("long").alias("_length"), F.lit(-1).cast("long").alias("_elite"))
    settled: list[DataFrame] = []
    n, tokens, round_ = keyed.count(), None, 0
    while n:
        blocks = -(-n // BLOCK)
        # Bins stay together: a bin's pieces share its name, and so the next block.
        dealt = F.pmod(F.xxhash64("_elite" if round_ else "_key", F.lit(round_)), F.lit(blocks)).cast("int")
        state = left.select(dealt.alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("_island"), "_key", "_length", "_elite", F.col("_elite").alias("_guest"))
        for epoch in range(EPOCHS):
            evolved = written(state.groupBy("_block", "_island").applyInPandas(_epoch(capacity, round_, epoch), _STATE), "epoch")
            guests = evolved.select("_block", F.pmod(F.col("_island") + 1, F.lit(ISLANDS)).alias("_island"), "_key", F.col("_elite").alias("_guest"))
            state = evolved.join(guests, ["_block", "_island", "_key"])
        best = _best_of_block(evolved)
        fill = best.groupBy("_elite").agg(F.sum("_length").alias("fill"))
        now = written(best.join(fill, "_elite").select("_key", "_length", "_elite", (F.col("fill") >= capacity * (1 - SETTLED)).alias("full")), "packed")
        rest = now.agg(F.count_if(~F.col("full")).alias("n"), F.sum(F.when(~F.col("full"), F.col("_length"))).alias("tokens")).first()
        last = blocks == 1 or not rest.n or (tokens is not None and rest.tokens > tokens * (1 - PROGRESS))
        settled.append(now if last else now.where("full"))
        if last:
            break
        left, n, tokens, round_ = now.where("NOT full").drop("full"), rest.n, rest.tokens, round_ + 1
    none = keyed.select(F.col(key).alias("_key"), F.col("length").cast("long").alias("_length"), F.lit(0).cast("long").alias("_elite")).limit(0)
    out = none
    for more in settled:
        out = out.unionByName(more.select("_key", "_length", "_elite"))
    before = F.sum("_length").over(Window.partitionBy("_elite").orderBy("_key")) - F.col("_length")  # a sequence holds at most ``capacity`` pieces
    placed = out.select(F.col("_key").alias(key), F.col("_elite").alias(bin_), before.alias(at))
    return keyed.join(placed, key).select(*[c for c in pieces.columns if c not in ("sequence_id", "offset")], F.col(bin_).alias("sequence_id"), F.col(at).alias("offset"))
