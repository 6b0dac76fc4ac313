"""BagMinHash: unbiased estimates, and classes against brute force."""

import random
from collections import Counter

import numpy as np

from gleanbin.llm import bagminhash as B


def test_estimates_weighted_jaccard():
    rng = random.Random(0)
    for _ in range(4):
        a = Counter({k: rng.choice([1, 1, 2, 3, 7]) for k in range(60)})
        b = Counter({k: w if rng.random() < 0.6 else rng.choice([1, 2, 9]) for k, w in a.items() if rng.random() < 0.8}) + Counter({100 + k: 1 for k in range(10)})
        items = np.array([x for s in (a, b) for x in s.elements()], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        owner = np.array([k for k, s in enumerate((a, b)) for _ in s.elements()])
        reg = B.signatures(B.mixed(items), owner, 2, 4096)
        assert abs((reg[0] == reg[1]).mean() - B.overlap(a, b)) < 0.04


def test_signature_does_not_depend_on_the_batch():
    x = B.mixed(np.arange(40, dtype=np.uint64))
    alone = B.signatures(x, np.zeros(40, int), 1)
    beside = B.signatures(np.concatenate([B.mixed(np.arange(100, 400, dtype=np.uint64)), x]), np.repeat([0, 1], [300, 40]), 2)
    assert (alone[0] == beside[1]).all()


def brute(docs):
    """class of each doc_id by all pairs."""
    bags = {d: B.shingles((t or "").encode()) for d, t in docs}
    texts = dict(docs)
    parent = {d: d for d in bags}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (texts[a] or "") == (texts[b] or "") or bags[a] and bags[b] and B.overlap(bags[a], bags[b]) >= B.LEAST:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: top(d) for d in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 30, 120]))]
        docs.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 6])):  # copies of the original, further from each other than from it
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
        chain = list(base)
        for _ in range(rng.choice([0, 4])):  # a chain of copies of copies
            chain[rng.randrange(len(chain))] = word()
            docs.append(" ".join(chain))
    return list(enumerate(docs))


def test_classes_against_brute_force(spark):
    docs = corpus(1)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in B.near_duplicates(d).collect()} == brute(docs)


def test_one_document_of_each_class_stays(spark):
    docs = corpus(2)
    d = spark.createDataFrame([(a, b, "en") for a, b in docs], "doc_id long, text string, class_id string")
    kept = B.first_of_each(d)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute(docs).values())) and kept.columns == d.columns


def test_table_cases(spark):
    rows = [(5, None), (3, ""), (2, "a b"), (2, "a b"), (9, "a b"), (None, "a b"), (None, "only here without an id at all"), (7, "x y z")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["class_id"]) for r in B.near_duplicates(d).collect())
    assert got == Counter({(5, 3): 1, (3, 3): 1, (2, 2): 2, (9, 2): 1, (None, 2): 1, (None, None): 1, (7, 7): 1})
    assert B.near_duplicates(d.limit(0)).count() == 0
