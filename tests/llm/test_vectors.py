"""Operator 6 against all pairs, on odd vectors and for recall; components against plain union-find."""

import numpy as np

from pactum.llm import vector_dedup
from pactum.llm.components import components


def _expected(rows, limit=0.98):
    ids = [r[0] for r in rows]
    root = {i: i for i in ids if i is not None}
    links = dict.fromkeys(root, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    usable = [
        (i, np.array(v, float), label) for i, v, label in rows
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    for k, (i, v, a) in enumerate(usable):
        for j, w, b in usable[:k]:
            if a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= limit:
                links[i] += 1
                links[j] += 1
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (links[i], find(i)) for i in root}


def test_vector_duplicates(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for family in range(30):
        base = rng.standard_normal(64)
        for _ in range(20 if family else 60):
            v = base + rng.standard_normal(64) * 0.1 * rng.random()
            rows.append((n, v.tolist(), family % 3))
            n += 1
    same = rng.standard_normal(64)
    rows += [(n + k, (same * (1 if k < 5 else 3)).tolist(), 1) for k in range(8)]
    rows += [(n + 20, None, 1), (n + 21, [0.0] * 64, 1), (n + 22, [float("nan")] * 64, 1), (n + 23, [None, 1.0], 1), (n + 24, same.tolist(), None)]
    rows += [(n + 25, [], 1), (n + 26, [1.0, 2.0], 1), (n + 27, [2.0, 4.0], 1), (n + 28, [float("inf"), 1.0], 1), (None, same.tolist(), 1)]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, id string")
    want = _expected(rows)
    got = vector_dedup.duplicates(vectors).collect()
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got)
    assert 0.999 * sum(v[0] for v in want.values()) <= found <= sum(v[0] for v in want.values())
    assert sum((r.n_links, r.component_id) != want[r.vec_id] for r in got if r.vec_id is not None) <= 2
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert vector_dedup.duplicates(vectors.limit(0)).count() == 0


def test_short_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 2.0], 0), (1, [2.0, 4.0], 0), (2, [-1.0, -2.0], 0), (3, [3.0], 0), (4, [5.0], 0), (5, [-5.0], 0)]
    for length in (2, 3, 8, 13, 15, 16, 20, 24, 32):
        for _ in range(20):
            a, b = rng.standard_normal((2, length))
            a /= np.linalg.norm(a)
            b -= (a @ b) * a
            near = 0.982 * a + np.sqrt(1 - 0.982**2) * b / np.linalg.norm(b)
            rows += [(len(rows), a.tolist(), 0), (len(rows) + 1, (near * 3).tolist(), 0)]
    got = vector_dedup.duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == _expected(rows)


def test_recall_at_the_limit_by_length():
    for length in (16, 24, 32, 64, 128):
        rng = np.random.default_rng(length)
        a, b = rng.standard_normal((2, 300, length))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        near = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        met = [np.intersect1d(x, y).size > 0 for x, y in zip(vector_dedup.filters(a), vector_dedup.filters(near))]
        assert sum(met) >= 299


def test_blocks_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = rng.standard_normal(64)
    rows = [(k, (base + rng.standard_normal(64) * 0.03).tolist(), 0) for k in range(100)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == _expected([(i, np.array(v, np.float32).tolist(), 0) for i, v, _ in rows])


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5300)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
