"""The pipeline's stages against brute force, and language ID on held-out documents."""

import random
import re
import zlib

import corpus_pipeline
import pytest
from fixtures import SCHEMA, sample
from test_text_operators import brute_spans, check_packing

from tidemark.llm import langid, near_copies
from tidemark.llm.simhash import shingles, words_of

TRAIN = {"en": "the house and this that with water", "de": "der und nicht das haus wasser mit", "fr": "le est pas maison eau avec dans", "es": "el los casa agua pero con muy"}


def corpus():
    rows = [(i, t, None, "s", len(t or "")) for i, t in sample(3)]
    rows += [(9000 + 4 * k + j, f"{words} {words.upper()} {k}" + " tok" * (k % 3) + f" token=abc{k}{j}def", lang, None, 0) for k in range(30) for j, (lang, words) in enumerate(TRAIN.items())]
    return rows


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output."""
    docs, out = spark.createDataFrame(corpus(), SCHEMA).repartition(3), []
    for _, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, "").cache()
        out.append((docs.collect(), done.collect(), docs.columns))
        docs = done
    return out


def test_language_stage(stages):
    before, after, columns = stages[0]
    assert sorted(r.text for r in before if r.text and any(c.isalpha() for c in r.text)) == sorted(r.text for r in after)
    assert all(r.lang for r in after) and list(after[0].asDict()) == columns


def test_exact_stage(stages):
    before, after, _ = stages[1]
    best = {}
    for r in before:
        k = re.sub(r"[\x20\x09-\x0D]+", "", r.text)
        rank = (-len(r.text), r.doc_id is not None, r.doc_id or 0)
        best[k] = min(best.get(k, rank), rank)
    assert sorted((-len(r.text), r.doc_id is not None, r.doc_id or 0) for r in after) == sorted(best.values())


def groups_of_near_copies(texts, least=0.8):
    """Smallest id over chains of texts that share ``least`` of their five-word shingles."""
    sets = {i: set(shingles(words_of(t), 5)) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and (len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in texts}


def test_near_stage(stages):
    before, after, _ = stages[2]
    texts = {r.doc_id: r.text for r in before if r.doc_id is not None}
    want = groups_of_near_copies(texts)
    kept = {r.doc_id for r in after if r.doc_id is not None}
    assert {i for i in texts if want[i] == i} <= kept  # no clean document goes
    assert len(kept - {i for i in texts if want[i] == i}) <= 1


def near_rows():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdefghij", k=4))
    rows, n = [], 0
    for length in (40, 80, 200, 600):
        for _ in range(12):
            base = [word() for _ in range(length)]
            for edits in (0, 1, length // 60, length // 40):
                w = list(base)
                for _ in range(edits):
                    w[rnd.randrange(len(w))] = word()
                rows.append((n, " ".join(w)))
                n += 1
    return rows


def test_near_copies_are_found(spark):
    rows = near_rows()
    want = groups_of_near_copies(dict(rows))
    got = {r.doc_id: r for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {r.group_id: i for i, r in got.items() if r.first}
    pairs = [(a, b) for a in want for b in want if a < b and want[a] == want[b]]
    found = [first[got[a].group_id] == first[got[b].group_id] for a, b in pairs]
    assert len(pairs) > 100 and sum(found) >= 0.95 * len(pairs)
    assert all(want[a] == want[b] for a in want for b in want if got[a].group_id == got[b].group_id)


def test_near_copies_of_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "one two"), (5, "One  TWO"), (6, "one three"), (4, "one two"), (None, "one two"), (None, "x " * 3000), (7, "x " * 3001), (8, "y")]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    by = {(r.doc_id, r.text_key): r for r in got.collect()}
    assert len(by) == 10
    groups = {}
    for (i, _), r in by.items():
        groups.setdefault(r.group_id, []).append(i)
    assert sorted((sorted(map(str, g)) for g in groups.values())) == [["1", "2", "3"], ["4", "5", "None"], ["6"], ["7", "None"], ["8"]]
    assert sorted(str(i) for (i, _), r in by.items() if r.first) == ["1", "4", "6", "7", "8"]
    kept = near_copies.keep_first(spark.createDataFrame([(t, "a", 1, i) for i, t in rows], "text string, node string, fp int, doc_id long")).collect()
    assert sorted((r.doc_id, r.node, r.fp) for r in kept) == [(i, "a", 1) for i in (1, 4, 6, 7, 8)]


def test_stages_keep_columns_of_clashing_names(spark):
    """Every column that the stages or the operators use themselves, as a user's own."""
    names = "score lang_pred ambiguous _found _id _digest _n digest keep_id kept group_size node fps fp k text_key first blob spans _blob _spans row_id".split()
    own = [(t, *["mine"] * len(names), lang, "s", n, i) for i, t, lang, _, n in corpus()]
    docs = spark.createDataFrame(own, "text string, " + ", ".join(f"{c} string" for c in names) + ", lang string, source string, n_chars long, doc_id long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == ["text", *names, "lang", "source", "n_chars", "doc_id"]
        assert docs.where(" OR ".join(f"{c} IS NULL OR {c} <> 'mine'" for c in names)).isEmpty() and docs.count() > 100


def test_secret_stage(stages):
    before, after, _ = stages[3]
    by_id = {r.doc_id: r.text for r in after}
    assert len(after) == len(before) and any("token=***" not in t and "*****" in t for t in by_id.values())
    for r in before:
        want = list(r.text)
        for start, _, _, end in brute_spans(r.text):
            want[start:end] = "*" * (end - start)
        assert by_id[r.doc_id] == "".join(want)


def test_packing_stage(stages):
    before, after, _ = stages[4]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    check_packing(after, 4096)


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_language_id_on_held_out_documents(spark):
    rows = [(i, " ".join((TRAIN[lang] + " x").split()[i % 4 :]) + f" {i}", lang, "s", 0) for i, lang in enumerate(list(TRAIN) * 60)] + [(999, None, "en", "s", 0), (998, "12 -- 34", "en", "s", 0), (None, "water house", None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train_on_documents(docs)
    got = langid.identify(docs.withColumn("held", langid.held_out()), model).collect()
    held = [r for r in got if r.held and r.lang and r.text and r.doc_id < 900]
    assert len(held) > 30 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    for r in got:
        assert r.doc_id is None or r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text)) and 0 <= r.score <= 1
    nothing = langid.identify(docs, langid.train(docs.where("lang = 'xx'")))
    assert nothing.where("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 7, 8, 30])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert code.shape[0] == n and len({tuple(c) for c in code}) == n


@pytest.mark.parametrize("labels", ["none", "held out", "und"])
def test_language_stage_without_usable_labels(spark, labels):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    texts = ["water house", "das haus", None, "12 -- 34", "", "日本"]
    lang = lambda i: "und" if labels == "und" else "de" if labels == "held out" and held(i) else None
    rows = [(i, texts[i % 6], lang(i), "s", 0) for i in range(60)]
    got = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(((r.doc_id, r.text, r.lang) for r in got), key=lambda r: r[0]) == [r[:3] for r in rows if r[1] and any(c.isalpha() for c in r[1])]
