"""Dual-tree search against brute force, covering radii, and pruning."""

from __future__ import annotations

import math

import numpy as np
import pytest

from conftest import SF001
from mktpulse.llm import cover_tree as ct
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def _brute(rows, k=5, every=50):
    v = [(i, tuple(math.floor(256 * x) for x in e)) for i, e in rows
         if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, q in dict.fromkeys((i, q) for i, q in v if i % every == 0):
        s = sorted((-sum(a * b for a, b in zip(q, e)), j) for j, e in v if j != i and len(e) == len(q))[:k]
        out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def _got(df):
    return sorted(tuple(r) for r in df.collect())


def test_covering_radii_and_rows():
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.normal(0, 50, (300, 8)).round(), np.tile(rng.normal(0, 50, (1, 8)).round(), (200, 1))])

    def walk(n):
        assert np.sqrt(((p[n.rows] - n.centre) ** 2).sum(1)).max() <= n.radius + 1e-9
        if n.children:
            assert sorted(np.concatenate([c.rows for c in n.children])) == sorted(n.rows)
            for c in n.children:
                walk(c)

    walk(ct.build(p, leaf=16))


@pytest.mark.parametrize("seed", range(4))
def test_levels_of_the_cover_tree(seed):
    """Nesting, separation, covering and parents, at every level but the last, which may end early."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 300, (12, 5))
    p = np.concatenate([np.repeat(centres, 30, 0) + rng.normal(0, [1, 4, 20][seed % 3], (360, 5)), np.tile(centres[:1], (20, 1))]).round()
    rng.shuffle(p)
    picked, parent, level, owner = ct.cover(p, [len(p), 60, 7, len(p)][seed])
    assert (np.diff(level) <= 0).all() and len(set(picked.tolist())) == len(picked)  # nesting: a level is a beginning of the order
    dist = np.sqrt(((p[:, None, :] - p[None, picked, :]) ** 2).sum(2))
    assert (dist[np.arange(len(p)), owner] == dist.min(1)).all()
    last = int(level[-1])
    for i in sorted(set(level.tolist())):
        inside = np.flatnonzero(level >= i)
        apart = dist[picked[inside]][:, inside]
        assert (apart[~np.eye(len(inside), dtype=bool)] > 2.0 ** i).all()  # separation
        if i > last or len(picked) == len(np.unique(p, axis=0)):
            assert (dist[:, inside].min(1) <= 2.0 ** i).all()  # covering
    for c in range(1, len(picked)):
        above = np.flatnonzero(level > level[c])
        d = dist[picked[c], above]
        assert level[parent[c]] > level[c] and d.min() == dist[picked[c], parent[c]] <= 2.0 ** (level[c] + 1)


def test_clustered_points_are_pruned():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 400, (40, 6))
    p = (np.repeat(centres, 50, 0) + rng.normal(0, 5, (2000, 6))).round()
    s = ct.Search(np.arange(0, 2000, 50), p[::50], np.arange(2000), p, 5, ct.build(p[::50], 1), ct.build(p, 32))
    for i, best in zip(s.qid, s.best):
        score = p @ p[i]
        score[i] = -np.inf
        want = sorted((-int(x), j) for j, x in enumerate(score) if np.isfinite(x))[:5]
        assert best == want
    assert s.pairs < 0.5 * len(s.qid) * len(p)
    # a bound known beforehand cuts more and loses nothing
    low = [-best[-1][0] for best in s.best]
    again = ct.Search(np.arange(0, 2000, 50), p[::50], np.arange(2000), p, 5, ct.build(p[::50], 1), ct.build(p, 32), low)
    assert again.best == s.best and again.pairs <= s.pairs


@pytest.mark.parametrize("block", [None, 40])
def test_table(spark, block):
    df = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert _got(ct.top_k(df, F.col("_id") % 50 == 0, block=block)) == _brute(rows)


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]),
            (50, [0.0, 0.0]), (100, [-1.0, 0.5]), (7, None), (8, [None, 1.0]), (9, [nan, 1.0]), (10, [inf, 1.0]), (150, [nan, 0.0]),
            (None, [1.0, 1.0]), (11, [1.0, 2.0, 3.0]), (200, [1.0, 0.0, 0.0]), (250, []), (12, []), (2, [1.0, 2.0]), (100, [-1.0, 0.5])]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA).selectExpr("*", "1 AS _d", "2 AS score")
    assert _got(ct.top_k(df, F.col("_id") % 50 == 0)) == _brute(rows)
    assert ct.top_k(df.limit(0), F.col("_id") % 50 == 0).collect() == []


def test_one_id_many_times(spark):
    """An id that repeats is a candidate as often as it stands there, spread over the blocks."""
    rows = [(7, [float(i % 5), 1.0]) for i in range(200)] + [(50, [1.0, 1.0]), (100, [1.0, -1.0]), (100, [2.0, 1.0])]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    got = _got(ct.top_k(df.where("vec_id <> 100"), F.col("_id") % 50 == 0, block=20))
    assert got == _brute([r for r in rows if r[0] != 100])


def test_large_components_are_exact(spark):
    """Scores beyond 2^53, beyond a long, and components near the end of a double's range."""
    rows = [(i, [1e6 + i / 256, -1e6, 3.0]) for i in range(60)] + [(100, [1e6, 1e6 + 0.5, -2.0])]
    got = _got(ct.top_k(spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id bigint, embedding array<double>, label int"), F.col("_id") % 50 == 0))
    assert got == _brute(rows)
    top = (1 << 63) - 1
    rows = [(0, [1e20, 1.0]), (1, [1e20, 1.0]), (2, [2e20, 1.0]), (3, [-1e20, 1.0]), (4, [-3e20, 1.0]), (5, [1e20, 2.0]), (6, [1e20, 1.0]), (50, [1e308, -1e308])]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id bigint, embedding array<double>, label int")
    want = [(q, r, j, max(min(s, top), -top - 1)) for q, r, j, s in _brute_ints(rows)]
    for block in (None, 3):
        assert _got(ct.top_k(df, F.col("_id") % 50 == 0, block=block)) == sorted(want)


def _brute_ints(rows, k=5):
    v = [(i, [int(x) * 256 if abs(x) > 1e15 else math.floor(256 * x) for x in e]) for i, e in rows]
    out = []
    for i, q in v:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, e)), j) for j, e in v if j != i)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return out
