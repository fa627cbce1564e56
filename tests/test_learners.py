"""Trees: Shapley values against all subsets of features, and large trees."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from tidemark.operators import boosting, learners, trees


def expected(tree, x, known, node=0):
    """A row's mean value where only the features of ``known`` are known."""
    if tree.feature[node] < 0:
        return tree.value[node]
    a, b = tree.left[node], tree.right[node]
    if tree.feature[node] in known:
        return expected(tree, x, known, a if tree.goes_left(node, x[None])[0] else b)
    share = tree.cover[a] / (tree.cover[a] + tree.cover[b])
    return share * expected(tree, x, known, a) + (1 - share) * expected(tree, x, known, b)


def by_subsets(tree, x):
    out, m = np.zeros(x.shape), x.shape[1]
    for i, row in enumerate(x):
        for f in range(m):
            for k in range(m):
                for s in combinations([j for j in range(m) if j != f], k):
                    out[i, f] += factorial(k) * factorial(m - k - 1) / factorial(m) * (expected(tree, row, {*s, f}) - expected(tree, row, set(s)))
    return out


def random_tree(rng, leaves, features):
    """Splits a leaf at random until there are enough, so paths meet features again and again."""
    tree = trees.Tree()
    tree.add(0.0, 1000.0)
    open_leaves = [0]
    while len(open_leaves) < leaves:
        node = open_leaves.pop(rng.integers(len(open_leaves)))
        share = rng.uniform(0.1, 0.9)
        tree.feature[node], tree.cut[node], tree.missing_left[node] = int(rng.integers(features)), float(rng.uniform(-1, 1)), bool(rng.integers(2))
        for side, part in (("left", share), ("right", 1 - share)):
            new = tree.add(float(rng.normal()), tree.cover[node] * part)
            getattr(tree, side)[node] = new
            open_leaves.append(new)
    return tree


@pytest.mark.parametrize("leaves, features", [(1, 3), (2, 1), (6, 4), (14, 5)])
def test_shapley_equals_the_subset_form(leaves, features):
    rng = np.random.default_rng(leaves)
    x = rng.uniform(-1, 1, (12, features))
    x[rng.random(x.shape) < 0.15] = np.nan
    tree = random_tree(rng, leaves, features)
    assert tree.shapley(x) == pytest.approx(by_subsets(tree, x), abs=1e-12)


def test_shapley_of_deep_trees_with_many_features_adds_up():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (500, 40))
    own = [random_tree(rng, 31, 40) for _ in range(20)]
    chain = trees.Tree()  # one path of thirty features
    node = chain.add(0.0, 1e6)
    for f in range(30):
        chain.feature[node], chain.cut[node] = f, 0.0
        chain.left[node], chain.right[node] = chain.add(float(f), chain.cover[node] / 2), chain.add(0.0, chain.cover[node] / 2)
        node = chain.right[node]
    model = trees.Boosted([*own, chain], 0.3, 0.1)
    base = model.base + 0.1 * sum(expected(t, x[0], set()) for t in model.trees)
    assert model.shapley(x).sum(axis=1) + base == pytest.approx(model.margin(x))


def rows(n, seed=0):
    """Two values of ``by`` with an edge, one with a single class, one with few rows; some values are missing, many are alike."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a, b, c = rng.normal(), float(rng.integers(0, 4)), None if rng.random() < 0.1 else rng.normal()
        out.append((i % 2, i, 0.8 * a - 0.5 * (b > 2) + (c or 0) * 0.3 + rng.normal(), float(rng.uniform(0.5, 1)), a, b, c))
    return out + [(7, n + i, 1.0, 1.0, 0.0, 0.0, 0.0) for i in range(30)] + [(8, n + 40 + i, float(i % 2), 1.0, 0.0, 0.0, 0.0) for i in range(5)]


def test_summed_histograms_grow_the_same_trees(spark, monkeypatch):
    monkeypatch.setattr(boosting, "ROUNDS", 2)  # margins are written on the way
    train = spark.createDataFrame(rows(900), "split int, pos int, r double, weight double, a double, b double, c double").repartition(5)
    settings = {0: {"features": ["a", "b", "c"], "depth": 3, "rate": 0.1}, 3: {"features": ["c", "a"], "depth": 2, "rate": 0.3}}
    local = learners._fitted(train, "split", ["a", "b", "c"], settings, 5)
    spread = learners._fitted(train, "split", ["a", "b", "c"], settings, 5, fit_rows=10)
    assert set(local) == set(spread) == {(t, s) for t in settings for s in (0, 1, 7, 8)}
    for key in local:
        (names, one), (all_names, many) = local[key], spread[key]
        if isinstance(one, float):
            assert many == pytest.approx(one)
            continue
        at = {j: all_names.index(f) for j, f in enumerate(names)} | {-1: -1}
        for t, u in zip(one.trees, many.trees, strict=True):
            assert [at[f] for f in t.feature] == u.feature and (t.left, t.right, t.missing_left) == (u.left, u.right, u.missing_left)
            assert t.cut == u.cut and t.value == pytest.approx(u.value) and t.cover == pytest.approx(u.cover)


def test_quantiles_in_memory_and_by_counting_agree(spark):
    train = spark.createDataFrame([r for r in rows(501, 4)], "by int, pos int, r double, w double, a double, b double, c double")
    found = boosting._cuts(train, ["a", "b", "c"])
    for by in (0, 1):
        own = [r for r in rows(501, 4) if r[0] == by]
        assert found[by] == [trees.cuts_of(np.array([np.nan if r[4 + j] is None else r[4 + j] for r in own])) for j in range(3)]
