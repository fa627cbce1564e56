"""URL filter by a cascade of Bloom filters.

A URL's keys are its host suffixes, each followed by the first characters of its path. Level 1
encodes the listed keys; level 2 the keys of the corpus that level 1 takes for listed; level 3 the
listed keys that level 2 takes for those; and so on until a level has no false positive. Over
the complete set of the corpus's keys, membership is then exact, without a join. Built-in
functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, written


#: Keys that a level of the cascade may hold.
MAX_KEYS = 4_000_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    n_hashes: int
    words: np.ndarray  # the bits, 64 to a word

    def holds(self, key: Column, number: int) -> Column:
        """Whether all bits of ``key`` are set. The words are in the plan once, whatever the number of hashes."""
        n_bits = 64 * len(self.words)

        def all_set(bits: Column) -> Column:
            out = F.lit(True)
            for j in range(self.n_hashes):
                at = _position(key, number, j, n_bits)
                out = out & (F.getbit(F.element_at(bits, (F.floor(at / 64) + 1).cast("int")), (at % 64).cast("int")) == 1)
            return out

        return F.exists(F.array(F.lit(self.words)), all_set)


def _position(key: Column, number: int, j: int, n_bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(number), F.lit(j)), F.lit(n_bits))


def _level(keys: DataFrame, n_keys: int, number: int, rate: float) -> Level:
    """A Bloom filter of ``keys``; its bits are set by an aggregate, at most one row a word."""
    n_hashes = max(1, round(-math.log2(rate)))
    n_words = max(1, math.ceil(n_keys * n_hashes / math.log(2) / 64))
    at = F.explode(F.array(*[_position(F.col("key"), number, j, 64 * n_words) for j in range(n_hashes)]))
    rows = (
        keys.select(at.alias("at"))
        .groupBy(F.floor(F.col("at") / 64).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(at % 64))")).alias("bits"))
        .collect()  # n_words rows at most
    )
    words = np.zeros(n_words, dtype=np.int64)
    for r in rows:
        words[r.word] = r.bits
    return Level(n_hashes, words)


class TooManyKeys(Exception):
    """A level of a cascade would hold more keys than it may."""


class Cascade:
    """Exact membership of ``listed`` keys among the keys of ``universe`` (both: distinct ``key``).

    ``max_keys`` bounds what any level may hold, since about 2 bytes a key go with each task; beyond it building raises
    ``TooManyKeys``, and membership is found by a shuffled join instead (see ``filter_urls``).
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, rate: float = 1 / 256, max_keys: int = MAX_KEYS):
        yes, no = listed, universe.join(listed, "key", "left_anti")
        self.levels: list[Level] = []
        while n := yes.count():
            if n > max_keys:
                raise TooManyKeys(f"{n} keys in level {len(self.levels) + 1}")
            self.levels.append(_level(yes, n, len(self.levels), rate if not self.levels else 0.5))
            wrong = no.where(self.levels[-1].holds(F.col("key"), len(self.levels) - 1))
            yes, no = written(wrong, "cascade"), yes

    def holds(self, key: Column) -> Column:
        """Level 1 and not (level 2 and not (level 3 and not ...))."""
        out = F.lit(False)
        for number, level in reversed(list(enumerate(self.levels))):
            out = level.holds(key, number) & ~out
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end; path: then up to ``? #`` or the end."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def _keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Each suffix of whole labels of ``host`` with the first characters of ``path``, longest first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True)]), lambda x: x.isNotNull()
    )
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda h: F.struct((-F.length(s) - F.length(h)).alias("order"), F.concat(s, h).alias("key")))))
    return F.transform(F.array_sort(keys), lambda k: k["key"])


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", max_keys: int = MAX_KEYS) -> DataFrame:
    """``pages`` (``page_id, url``) with ``host, path, rule, verdict``; the longest fitting rule wins.

    A rule fits its host and all its subdomains where the path starts with the rule's. A URL that
    no rule fits gets ``default`` and a null rule. Null urls and urls without ``://`` have empty
    host and path, which no rule fits. Where one key is both blocked and allowed, it is blocked.
    Repeated rows give repeated rows; very long urls are parsed whole; no pages give no rows; other columns are ignored.
    Where the cascade would need a level of more than ``max_keys`` keys, the keys meet the rules in a shuffled join; results are the same.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    lengths = sorted({len(r.path) for r in rules})
    keyed = parsed.withColumn("keys", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(_keys(F.col("host"), F.col("path"), lengths)))
    universe = written(keyed.select(F.explode("keys").alias("key")).distinct(), "url-keys")
    block = {r.key for r in rules if r.verdict == "block"}
    listed = {"block": block, "allow": {r.key for r in rules if r.verdict == "allow"} - block}
    frames = {verdict: spark.createDataFrame([(k,) for k in sorted(keys)], "key string") for verdict, keys in listed.items()}
    try:
        cascades = {verdict: Cascade(frame, universe, max_keys=max_keys) for verdict, frame in frames.items()}
    except TooManyKeys:
        return _joined(keyed, frames["block"].withColumn("verdict", F.lit("block")).unionByName(frames["allow"].withColumn("verdict", F.lit("allow"))), default)
    # Each cascade once: of every key what it says, then the first key that either holds.
    said = F.transform("keys", lambda k: F.struct(k.alias("key"), cascades["block"].holds(k).alias("block"), cascades["allow"].holds(k).alias("allow")))
    best = F.get(F.filter(said, lambda x: x["block"] | x["allow"]), 0)
    ruled = keyed.withColumn("best", best)
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.block"), "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))


def _joined(keyed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same without filters: every key meets the rules (``key, verdict``), which are distinct, so a key of a third of all rows can be split."""
    rows = written(keyed.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    each = rows.select("row", F.posexplode("keys").alias("at", "key")).join(rules.withColumnRenamed("verdict", "said"), "key")
    best = each.groupBy("row").agg(F.min(F.struct("at", "key", "said")).alias("b")).select("row", F.col("b.key").alias("rule"), "b.said")
    return rows.join(best, "row", "left").select("page_id", "host", "path", "rule", F.coalesce("said", F.lit(default)).alias("verdict"))
