"""Near copies inside a large group of texts that share a template."""

import random

import numpy as np

from gleanbin.llm import bagminhash as B
from tests.llm.test_dedup import brute


def templates(n, pairs, seed=3):
    """n texts of one template at about 0.78, and near copies of some, edited in their own part."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(180)]
    docs = [shared + [word() for _ in range(25)] for _ in range(n)]
    for d in docs[:pairs]:
        docs.append(d[:184] + [word() for _ in range(21)])
    rng.shuffle(docs)
    return list(enumerate(map(" ".join, docs)))


def test_copies_in_a_template_group_are_found(spark):
    docs = templates(400, 40)
    want = brute(docs)
    assert 300 < len(set(want.values())) < len(docs)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in B.near_duplicates(d).collect()} == want


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 50)
    docs = templates(150, 15)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in B.near_duplicates(d).collect()} == brute(docs)


def test_counts_in_common():
    rng = np.random.default_rng(0)
    sets = [set(rng.choice(300, rng.integers(0, 90), replace=False)) | (set(range(1000, 1020)) if k % 2 else set()) for k in range(80)]
    items = np.array([x for s in sets for x in sorted(s)], np.int64)
    owner = np.repeat(np.arange(80), [len(s) for s in sets])
    want = np.array([[len(a & b) for b in sets] for a in sets])
    assert (B.in_common(items, owner, 80, 80) == np.triu(want, 1)).all()
    assert (B.in_common(items, owner, 80, 30) == want[:30, 30:]).all()
