"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest
from tidemark.llm.common import ascii_lower

SCHEMA = "text string, prefix string, doc_id long, rank int, source string, g string, lang string, hash string, n_chars long, n int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        at = i // 16 * 16
        yield "".join(level[at:i]), "".join(level[i + 1 : at + 16])
        i //= 16


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for members in by.values():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = {k: levels([leaf(*r) for r in by[k]]) for k in keys}
    top = levels([trees[k][-1][0] for k in keys])
    for j, k in enumerate(keys):
        for i, r in enumerate(by[k]):
            path = [*siblings(trees[k], i), *siblings(top, j)]
            shown = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                shown = leaf(*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)}))
            folded = shown
            for left, right in path:
                folded = digest(left, folded, right)
            yield r[0], leaf(*r), shown, trees[k][-1][0], digest(*(s for step in path for s in step)), folded, top[-1][0]


def rows(n_sources, n, seed=3):
    rnd = random.Random(seed)
    sources = [None, "", "Ü", "z", "~"] + [f"s{i}" for i in range(n_sources)]
    word = lambda: rnd.choice(["Sea", "the", "日本", "x y", ""])
    out = [(rnd.choice([i, -i, i * 10**12, i % 7]), rnd.choice(sources), rnd.choice([None, "en"]), rnd.choice([None, i]), rnd.choice([None, word() * 3])) for i in range(n)]
    hot = [(i, "hot", "de", 1, "T" * (i % 3)) for i in range(n // 2)]
    none = [(None, "hot", None, None, f"Text {i}") for i in range(n // 4)]
    return out + hot + none + [(4, "hot", None, None, None)] * 20 + [out[0], hot[0], (9, "alone", "en", 2, "word " * 20000)]


def found(spark, rows):
    df = spark.createDataFrame([(r[4], "p", r[0], 1, r[1], "g", r[2], "h", r[3], 2) for r in rows], SCHEMA)
    own, changed = manifest.leaf(), manifest.leaf(["doc_id", "source", "lang", "n_chars", ascii_lower(F.col("text"))])
    claimed = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, changed).otherwise(own)
    out = manifest.prove(df, own, claimed)
    return [tuple(r) for r in out.select("doc_id", "leaf", "claimed", "subroot", "proof_sha256", "folded_root", "root").collect()]


@pytest.mark.parametrize("n_sources, n, bucket", [(2, 700, 4096), (300, 900, 16), (0, 40, 2)])
def test_manifest(spark, monkeypatch, n_sources, n, bucket):
    monkeypatch.setattr(manifest, "BUCKET", bucket)  # small buckets make prefixes grow into the leaf's digits
    own = rows(n_sources, n)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(found(spark, own), key=key) == sorted(brute(own), key=key)


@pytest.mark.parametrize("own", [[], [(1, None, None, None, None)], [(5, "a", "en", 3, "ABC"), (6, "b", "en", 3, "abc")]])
def test_few_rows(spark, own):
    assert sorted(found(spark, own), key=str) == sorted(brute(own), key=str) if own else not found(spark, own)


def test_proofs_fold_to_the_root(spark):
    df = spark.createDataFrame([(r[4], "p", r[0], 1, r[1], "g", r[2], "h", r[3], 2) for r in rows(40, 300)], SCHEMA)
    for r in manifest.prove(df, proofs=True).collect():
        at = r.leaf
        for step in r.proof:
            at = digest(step.l, at, step.r)
        assert at == r.root == r.folded_root
