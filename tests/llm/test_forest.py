"""Recall of the forest against brute force, whatever the vectors' lengths and structure."""

import numpy as np
import pytest

from gleanbin.llm import lsh_forest as L


def unit(rng, n, dim=24):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tables(kind, n, rng):
    x = unit(rng, n)
    if kind == "lognormal":
        return x * np.exp(rng.normal(0, 1.5, size=(n, 1)))
    if kind == "outlier":
        x[7] *= 10_000
    if kind == "component":
        x[9, 3] = 300.0
    if kind == "clustered":
        return unit(rng, 40)[rng.integers(40, size=n)] + 0.02 * rng.normal(size=x.shape)
    if kind == "huge":
        return x * 1e200
    return x


def recall(spark, x):
    ids = np.arange(len(x))
    d = spark.createDataFrame([(int(k), [float(c) for c in v]) for k, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for r in L.nearest(d).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in ids[ids % L.EVERY == 0]:
        with np.errstate(over="ignore", invalid="ignore"):
            s = x @ x[q]
        s[q] = -np.inf
        best = set(np.lexsort((ids, -s))[: L.K])
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, L.K + 1))
        assert np.allclose([v for _, _, v in own], s[[i for _, i, _ in own]], rtol=1e-9, atol=1e-12)
        hit += len(best & {i for _, i, _ in own})
        total += L.K
    return hit / total


@pytest.mark.parametrize("kind", ["unit", "lognormal", "outlier", "component", "clustered"])
def test_recall_in_one_block(spark, kind):
    assert recall(spark, tables(kind, 2_000, np.random.default_rng(4))) >= 0.9


@pytest.mark.parametrize("kind", ["lognormal", "clustered"])
def test_recall_over_several_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(L, "BLOCK", 300)
    assert recall(spark, tables(kind, 2_500, np.random.default_rng(5))) >= 0.9


def test_lengths_that_overflow_when_squared(spark):
    x = tables("huge", 300, np.random.default_rng(6))
    d = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert L.nearest(d).count() == 15 * L.K


def test_clusters_need_few_candidates(monkeypatch):
    rng = np.random.default_rng(7)
    x = tables("clustered", 20_000, rng)
    forest = L.Forest(np.arange(len(x)), x)
    scored, best = [], forest._best
    forest._best = lambda at, scores, floor: scored.append(len(at)) or best(at, scores, floor)
    found = forest.search(x[:100], np.full(100, -np.inf))
    s = x[:100] @ x.T
    hit = sum(len(set(np.argsort(-s[k])[: L.K + 1]) & set(found[k][0])) for k in range(100))
    assert hit / (100 * (L.K + 1)) >= 0.9 and len(scored) == 100 and sum(scored) < 100 * len(x) / 4
