"""Language identification by error-correcting output codes.

Every language has a codeword. One binary classifier over character n-grams predicts each bit;
a document gets the codeword nearest to the predictions, each bit weighed by the loss of its margin.
Documents for which two codewords are about as near are flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import full_text, temporary

#: Hash buckets of the n-grams, and their lengths in bytes of UTF-8.
FEATURES, GRAMS = 1 << 16, (2, 4)
#: The classifiers are fitted on about this many labelled rows at most, drawn evenly by hash over the whole table.
TRAIN_ROWS = 12_000
MAX_LANGUAGES = 500
UNDETERMINED = "und"
#: Documents whose two nearest codewords differ by less than this share of the loss are ambiguous.
AMBIGUOUS = 0.1

_LETTER = re.compile(r"[^\W\d_]")
_FACTOR = np.uint32(0x9E3779B1)
_CHUNK = 1 << 15


def features(text: str) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of the lower-cased text, a chunk of bytes at a time."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    for n in GRAMS:
        for at in range(0, max(len(data) - n + 1, 0), _CHUNK):
            part = data[at : at + _CHUNK + n - 1].astype(np.uint32)
            m = len(part) - n + 1
            h = np.full(m, n, dtype=np.uint32)
            for j in range(n):
                h = (h + part[j : j + m]) * _FACTOR
                h ^= h >> np.uint32(15)
            yield h & np.uint32(FEATURES - 1)


def codewords(n: int) -> np.ndarray:
    """``n`` rows of -1 and 1. Up to seven classes get the exhaustive code; more, the best spread of a
    fixed series of random codes of ``8 * ceil(log2 n)`` bits."""
    if n <= 7:
        bits = max(1, 2 ** (n - 1) - 1)
        columns = [[1] + [1 if (v >> i) & 1 else -1 for i in range(n - 1)] for v in range(bits)]
        return np.array(columns, dtype=np.float64).T
    rng = np.random.default_rng(7)
    codes = [rng.choice([-1.0, 1.0], size=(n, 8 * int(np.ceil(np.log2(n))))) for _ in range(50)]

    def spread(c: np.ndarray) -> float:
        dots = c @ c.T
        np.fill_diagonal(dots, -np.inf)
        return -float(dots.max())

    return max(codes, key=spread)


@dataclass(frozen=True)
class LanguageCode:
    """The fitted model: languages, their codewords, and weights of n-gram buckets for each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for f in features(text):
            total += self.weights[f].sum(axis=0, dtype=np.float64)
            n += len(f)
        return total / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (0 to 1) and whether it is ambiguous."""
        if text is None or not _LETTER.search(text):
            return UNDETERMINED, 0.0, True
        loss = np.logaddexp(0.0, -4.0 * self.margins(text) * self.code).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        likely = np.exp(-(loss - loss[order[0]]))
        ambiguous = len(order) > 1 and loss[order[1]] - loss[order[0]] < AMBIGUOUS * loss[order[1]]
        return self.languages[order[0]], float(1.0 / likely.sum()), bool(ambiguous)


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> LanguageCode:
    """Fits on ``labelled`` (``text, lang``; neither null), on an even draw of about ``rows`` rows.

    The draw is by a hash of the text over every row. Only counts of n-gram buckets by language reach the
    driver: ``MAX_LANGUAGES * FEATURES`` numbers at most. No labelled rows give a model without
    languages, which knows only ``und``.
    """
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    n = labelled.count()
    step = 1 << 20
    drawn = labelled.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(step)) < int(step * min(1.0, rows / max(n, 1))))
    if rows >= n:
        drawn = labelled

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                own = counts.setdefault(lang.as_py(), np.zeros(FEATURES, dtype=np.int64))
                if len(counts) > MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
                for f in features(text.as_py()):
                    own += np.bincount(f, minlength=FEATURES)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "f": pa.array(at, pa.int32()), "n": pa.array(own[at], pa.int64())})

    rows_ = drawn.select("text", "lang").mapInArrow(count, "lang string, f int, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows_["lang"].unique())
    if not languages:
        return LanguageCode([], np.zeros((0, 1)), np.zeros((FEATURES, 1), np.float32))
    counts = np.zeros((len(languages), FEATURES))
    counts[rows_["lang"].map({x: i for i, x in enumerate(languages)}), rows_["f"]] = rows_["n"]
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)  # languages weigh alike
    code = codewords(len(languages))
    weights = np.stack(
        [np.log(_mean(share[code[:, b] > 0])) - np.log(_mean(share[code[:, b] < 0])) for b in range(code.shape[1])], axis=1
    )
    return LanguageCode(languages, code, weights.astype(np.float32))


def _mean(rows: np.ndarray) -> np.ndarray:
    return rows.mean(axis=0) if len(rows) else np.full(rows.shape[1], 1.0 / rows.shape[1])


def identify(docs: DataFrame, model: LanguageCode, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """``docs`` with language, score (0 to 1) and whether it is ambiguous added as ``names``, from ``text`` alone.

    ``und`` (score 0, ambiguous) for a null text and one without a letter, and for any text if the
    model has no languages. Very long texts are read whole, a chunk at a time; repeated rows and equal texts are judged
    alike; of codewords equally near the first language by name wins, flagged ambiguous. Columns of those names are replaced; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES * bits * 4 bytes, whatever the data

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        own = shared.value
        found = [own.predict(t if own.languages else None) for t in text]
        pa.default_memory_pool().release_unused()  # workers live on into later stages
        return pd.DataFrame(found, columns=["lang_pred", "score", "ambiguous"])

    (found,) = temporary("found")
    once = predict.asNondeterministic()  # else a filter on the result has every text predicted twice
    out = docs.withColumn(found, once(F.col("text")))
    return out.withColumns({c: F.col(f"{found}.{f}") for c, f in zip(names, ("lang_pred", "score", "ambiguous"), strict=True)}).drop(found)


def has_letter(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def found(text: pd.Series) -> pd.Series:
        return pd.Series([t is not None and bool(_LETTER.search(t)) for t in text], dtype=bool)

    return found(text)


def held_out(doc_id: str = "doc_id"):
    """True for a quarter of the documents, by the id: those that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on_documents(docs: DataFrame, rows: int = TRAIN_ROWS) -> LanguageCode:
    """The model that ``op4`` and the pipeline use, learned from documents that are not held out."""
    return train(docs.where(~held_out()).where(F.length(full_text()) > 0).select("text", "lang"), rows)
