"""The language classifier against one in plain Python, n-gram by n-gram."""

import math
import random
from collections import Counter

import pytest

from tidemark.llm import langid

WORDS = {
    "de": "der die das und nicht über für größe straße".split(),
    "en": "the and not over for size street with".split(),
    "es": "el la los niño pequeño calle con más".split(),
    "fr": "le la les été garçon rue avec où".split(),
}


def sample():
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(1, 40))), lang) for i, lang in enumerate(sorted(WORDS) * 30)]
    return rows + [(900, None, "en"), (901, "12 34 !", "de"), (902, "", None), (903, "the straße el été " * 3, None), (904, "the " * 30_000, None), rows[0]]


def buckets(text):
    data = text.lower().encode()
    for n in (2, 4):
        for i in range(len(data) - n + 1):
            h = n
            for b in data[i : i + n]:
                h = (h + b) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            yield h & 0xFFFF


def plain_model(rows):
    counts = {}
    for _, text, lang in rows:
        if text and lang:
            counts.setdefault(lang, Counter()).update(buckets(text))
    languages = sorted(counts)
    share = {x: (lambda f, c=counts[x], total=sum(counts[x].values()) + 0.5 * (1 << 16): (c[f] + 0.5) / total) for x in languages}
    code = langid.codewords(len(languages))

    def weight(f, bit):
        mean = lambda sign: (lambda own: sum(share[x](f) for x in own) / len(own) if own else 2**-16)([x for x, row in zip(languages, code, strict=True) if row[bit] == sign])
        return math.log(mean(1)) - math.log(mean(-1))

    return languages, code, weight


def plain_prediction(text, languages, code, weight):
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    grams = Counter(buckets(text))
    n = sum(grams.values())
    margins = [sum(k * weight(f, b) for f, k in grams.items()) / max(n, 1) for b in range(code.shape[1])]
    loss = {x: sum(math.log1p(math.exp(-4 * m * s)) for m, s in zip(margins, row, strict=True)) for x, row in zip(languages, code, strict=True)}
    best = min(languages, key=lambda x: loss[x])
    return best, 1 / sum(math.exp(loss[best] - loss[x]) for x in languages)


def test_every_prediction_equals_the_plain_ones(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(df.select("text", "lang"))
    plain = plain_model(rows)
    assert model.languages == plain[0]
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score = plain_prediction(r.text, *plain)
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score, abs=1e-5)), r.doc_id
    assert sum(r.lang_pred == r.lang for r in got if r.lang and r.lang_pred != "und") >= 118
