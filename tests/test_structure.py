"""Trees and clusters against hand-worked cases and plain versions."""

import itertools
import random

import numpy as np
import pytest

from simlattice.operators import kernels as K
from simlattice.operators import structure as S


def random_tree(seed, n):
    """An additive tree: its path lengths determine it."""
    rng = random.Random(seed)
    tree = [(0, None, 0.0, None)]
    open_, new = [0], 1
    while len(open_) < n:
        at = open_.pop(rng.randrange(len(open_)))
        for _ in range(3 if at == 0 else 2):
            tree.append((new, at, rng.uniform(0.1, 1), None))
            open_.append(new)
            new += 1
    names = {node: f"t{k:02d}" for k, node in enumerate(sorted(open_))}
    return [(a, b, c, names.get(a)) for a, b, c, _ in tree]


@pytest.mark.parametrize("seed", range(5))
def test_neighbour_joining_recovers_additive_trees(seed):
    tree = random_tree(seed, 14)
    names, d = K.tip_distances(tree)
    for made in (K.neighbour_joining(d, names), K.midpoint_rooted(K.neighbour_joining(d, names))):
        got, far = K.tip_distances(made)
        assert got == names and np.allclose(far, d)
        assert K.robinson_foulds(tree, made) == 0.0 and K.cophenetic_r(tree, made) == pytest.approx(1.0)


@pytest.mark.parametrize("seed", range(5))
def test_midpoint(seed):
    tree = random_tree(seed, 11)
    made = K.midpoint_rooted(tree)
    depth = {n: x for n, x, _ in K.layout(made)}
    own = {t[0]: t for t in made}
    below = K.children(made)
    tips = lambda x: [x] if own[x][3] else [t for k in below.get(x, []) for t in tips(k)]
    sides = [max(depth[t] for t in tips(k)) for k in below[below[None][0]]]
    _, d = K.tip_distances(tree)
    assert sorted(sides)[-2:] == [pytest.approx(d.max() / 2)] * 2


def test_small_trees():
    assert K.newick(K.neighbour_joining(np.zeros((0, 0)), [])) == "()"
    assert K.newick(K.neighbour_joining(np.zeros((1, 1)), ["a"])) == "(a);"
    assert K.newick(K.average_linkage(np.array([[0, 2.0], [2.0, 0]]), ["a", "b"])) == "(a:1,b:1);"
    assert K.adjacent_pairs(["A0", "A1", "A2"]) == "(A0,A1);" and K.adjacent_pairs([]) == "()"


def test_average_linkage_by_hand():
    d = np.array([[0, 2, 6, 10], [2, 0, 6, 10], [6, 6, 0, 10], [10, 10, 10, 0]], float)
    own = {name: length for _, _, length, name in K.average_linkage(d, list("abcd")) if name}
    assert own == {"a": 1.0, "b": 1.0, "c": 3.0, "d": 5.0}


def test_greedy_clusters():
    d = np.array([[0, 0.1, 0.9], [0.1, 0, 0.4], [0.9, 0.4, 0]])
    assert K.greedy_clusters(d, 0.5) == [0, 0, 0]
    assert K.greedy_clusters(d[[0, 2]][:, [0, 2]], 0.5) == [0, 1]


def test_hdbscan():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.1, (12, 2)) for c in ((0, 0), (5, 5), (0, 5))] + [np.array([[20.0, -20.0]])])
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    labels = K.hdbscan(d, 5)
    groups = [set(labels[k * 12 : k * 12 + 12]) - {-1} for k in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3 and labels[-1] == -1
    assert K.hdbscan(np.zeros((1, 1))) == [-1] and K.hdbscan(np.zeros((0, 0))) == []
    pairs = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 1], [9, 9, 1, 0]], float)
    got = K.hdbscan(pairs)
    assert got[0] == got[1] != got[2] == got[3] and -1 not in got


def test_clade_and_layout():
    tree = random_tree(3, 12)
    tips = sorted(t[3] for t in tree if t[3])
    assert K.clade_around(tree, tips[0], 1) == [tips[0]]
    assert len(K.clade_around(tree, tips[0], 12, 12)) == 12
    assert all(len(K.clade_around(tree, t, 12, 5)) <= 5 for t in tips)
    heights = {n: h for n, _, h in K.layout(tree)}
    assert sorted(heights[t[0]] for t in tree if t[3]) == [float(k) for k in range(12)]


def test_splits_differ():
    d = np.array([[0, 1, 4, 4], [1, 0, 4, 4], [4, 4, 0, 1], [4, 4, 1, 0]], float)
    a = K.neighbour_joining(d, list("abcd"))
    b = K.neighbour_joining(d[[0, 2, 1, 3]][:, [0, 2, 1, 3]], list("abcd"))
    assert K.robinson_foulds(a, b) == 1.0


def test_tables(spark):
    names = [f"n{k}" for k in range(9)]
    rng = np.random.default_rng(4)
    rows = [(a, b, float(x)) for (a, b), x in zip(itertools.combinations(names, 2), rng.uniform(0.1, 1, 36))]
    pairs = spark.createDataFrame(rows, "i string, j string, d double")
    ids = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "id string, row_idx long")
    d = np.zeros((9, 9))
    for a, b, x in rows:
        d[names.index(a), names.index(b)] = d[names.index(b), names.index(a)] = x
    tree = S.neighbour_joining(pairs, ids, midpoint=False)
    assert S.collected(tree) == K.neighbour_joining(d, names)
    labels = {r["id"]: r["label"] for r in S.greedy_clusters(pairs, ids, 0.4).collect()}
    assert [labels[n] for n in names] == K.greedy_clusters(d, 0.4)
    same = S.compare(tree, tree).first()
    assert (same["robinson_foulds"], round(same["cophenetic_r"], 9)) == (0.0, 1.0)
    assert S.hdbscan(pairs, ids).count() == 9
    with pytest.raises(ValueError):
        S.hdbscan(pairs, ids, most=5)


def test_mantel_query_has_all_permutations(spark, tiny, monkeypatch):
    from simlattice.plans import run_queries

    monkeypatch.setattr(run_queries.B, "mantel", lambda pairs, permutations=999: permutations)
    assert run_queries.mantel(spark, tiny) == 999
