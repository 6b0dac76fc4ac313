"""Language ID, token counts and nearest neighbours; the pipeline's stages."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanbin.llm import langid, lsh_forest, tokencount
from gleanbin.llm.queries import QUERIES, tokenizer_path


def test_gradients_are_right():
    net = langid.Network(["a", "b"], hidden=3, seed=2)
    for p in net.parameters():
        p[...] = p.astype(np.float32)
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 5, size=(6, 4)).astype(np.int16), np.array([0, 1, 1, 0])
    _, grads = net.gradients(x, y)
    for p, g in zip(net.parameters(), grads):
        for k in rng.choice(p[:5].size if p.ndim == 2 and len(p) > 5 else p.size, 3):
            at = np.unravel_index(k, p.shape)
            old, eps = p[at], 1e-2
            p[at] = old + eps
            up = net.gradients(x, y)[0]
            p[at] = old - eps
            down = net.gradients(x, y)[0]
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-3


def test_held_out_accuracy_and_cases(spark, smallest):
    d = spark.read.parquet(f"{smallest}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "12 34 !!", "en"), (-3, "", None), (None, "The of and", None)], "doc_id long, text string, lang string")
    got = langid.op5(d.unionByName(odd)).join(d.select("doc_id", "lang"), "doc_id", "left").collect()
    assert len(got) == d.count() + 4
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (-1, -2, -3))
    out = [r for r in got if r["held_out"] and r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_without_training_rows(spark):
    d = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in langid.op5(d).collect()] == [("und", 0.0)]
    assert langid.op5(d.limit(0)).count() == 0


def test_clashing_names_pass(spark):
    d = spark.createDataFrame([(k, "the of and that with " * 9, "en", "s", 0.5) for k in range(9)] + [(9, "12", "en", "s", 0.5)], "doc_id long, text string, lang string, lang_pred string, score double")
    kept = langid.identified(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(9))


def test_segments_do_not_mix_documents():
    net = langid.Network(["a", "b"], seed=3)
    texts = [bytes([65 + k % 7]) * (1 + 97 * k) for k in range(9)]
    ends = np.cumsum([len(t) for t in texts])
    both = net.pooled(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], np.array([len(t) for t in texts]))
    for k, t in enumerate(texts):
        alone = net.pooled(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))
        assert np.allclose(both[k], alone[0], rtol=1e-4) and abs(both[k].sum() - len(t)) < 1e-2 * len(t)


def plain_score(net, data: bytes) -> np.ndarray:
    """The mean of each label's probability over all positions, byte by byte and segment by segment."""

    def states(gru, run):
        n = gru.state.shape[0]
        h, out = np.zeros(n), []
        for b in run:
            given, own = gru.inputs[b].astype(float), h @ gru.state
            z, r = (1 / (1 + np.exp(-(given[k * n : (k + 1) * n] + own[k * n : (k + 1) * n]))) for k in (0, 1))
            h = z * h + (1 - z) * np.tanh(given[2 * n :] + r * own[2 * n :])
            out.append(h)
        return out

    total = np.zeros(len(net.langs))
    for k in range(0, len(data), langid.SEGMENT):
        part = data[k : k + langid.SEGMENT]
        left, right = states(net.left, part), states(net.right, part[::-1])[::-1]
        for a, b in zip(left, right):
            e = np.concatenate([a, b]) @ net.out + net.bias
            e = np.exp(e - e.max())
            total += e / e.sum()
    return total / len(data)


def test_predictions_against_a_plain_recurrence(spark, smallest):
    d = spark.read.parquet(f"{smallest}/documents.parquet").select("doc_id", "text", "lang")
    net = langid.fitted(d)
    d = d.orderBy(F.length("text")).limit(40).unionByName(spark.createDataFrame([(-1, "é ß 한 x", None), (-2, "ab " * 500, None)], "doc_id long, text string, lang string"))
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    compared = 0
    for r in langid.predict(d, net, ["doc_id"]).collect():
        t = texts[r["doc_id"]]
        if t and any(c.isalpha() for c in t):
            p = plain_score(net, t.encode())
            assert abs(p.max() - r["score"]) < 1e-3 and (r["lang_pred"] == net.langs[p.argmax()] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-3)
            compared += 1
    assert compared >= 20


# --- token counts -----------------------------------------------------------------------------------------------------------


def brute_count(word: bytes, score: dict) -> int:
    table = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        table.append(max(((table[a][0] + score[word[a:d]], -table[a][1] - 1) for a in range(d) if word[a:d] in score), key=lambda x: x) if True else None)
        table[-1] = (table[-1][0], -table[-1][1])
    return table[-1][1]


@pytest.fixture(scope="module")
def unigram():
    return tokencount.Unigram.from_tiktoken(tokenizer_path("byte_bpe_50k.tiktoken"))


def test_counts_against_plain_programming(unigram):
    rng = random.Random(9)
    trie = tokencount.Trie(unigram)
    words = ["".join(rng.choice(["the", "ing", "é", "zq", "x", "tion", " ", "1"]) for _ in range(rng.randrange(1, 12))).encode() for _ in range(300)]
    assert [trie.count_of(w) for w in words] == [brute_count(w, unigram.score) for w in words]
    long = "".join(rng.choice(["the", "ing", "zq", "tion"]) for _ in range(300)).encode()
    assert trie.count_of(long) == brute_count(long, unigram.score) == trie.streamed(long)


def test_prefixes_are_computed_once(unigram):
    trie = tokencount.Trie(unigram)
    trie.count_of(b"nation")
    n = len(trie.best)
    trie.count_of(b"national")
    assert n == 7 and len(trie.best) == 9


def test_table_of_counts(spark, smallest):
    import regex

    from gleanbin.llm.bpe_stream import PATTERN

    d = spark.read.parquet(f"{smallest}/documents.parquet").limit(20).select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    model = tokencount.Unigram.from_tiktoken(tokenizer_path("byte_bpe_50k.tiktoken"))
    memo = {}
    for r in tokencount.token_counts(d, tokenizer_path("byte_bpe_50k.tiktoken")).join(d, "doc_id").collect():
        words = regex.findall(PATTERN, r["text"] or "")
        for w in words:
            if w not in memo:
                memo[w] = brute_count(w.encode(), model.score)
        assert (r["n_pretokens"], r["n_tokens"]) == (len(words), sum(memo[w] for w in words))


# --- neighbours -------------------------------------------------------------------------------------------------------------


def test_recall_and_exact_scores(spark, smallest):
    e = spark.read.parquet(f"{smallest}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in e.collect()]
    got = {}
    for r in QUERIES["op8_hash_prefix_forest"](spark, smallest).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = sorted(zip(-s, ids))[:20]
        own = sorted(got[q])
        assert [k for k, _, _ in own] == list(range(1, 21))
        assert all(math.isclose(v, s[ids == i][0], rel_tol=1e-9) for _, i, v in own)
        hit += len({i for _, i in best} & {i for _, i, _ in own})
        total += 20
    assert hit / total >= 0.9


def test_neighbour_cases(spark):
    nan, inf = float("nan"), float("inf")
    v = [(k, [1.0, 0.0] if k % 2 else [0.5, 2.0]) for k in range(60)] + [(80, None), (100, [0.0, 0.0]), (120, [nan, 1.0]), (140, [inf, 1.0]), (160, [None, 1.0]), (180, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (3, [1.0, 0.0])]
    d = spark.createDataFrame([(*r, 1) for r in v], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in lsh_forest.nearest(d).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40}
    assert [i for _, i, _ in sorted(got[0])] == [k for k in range(2, 42, 2)] and all(s == 4.25 for _, _, s in got[0])
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in lsh_forest.nearest(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert lsh_forest.nearest(few.limit(0)).count() == 0


# --- pipeline ---------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, smallest):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, smallest)
        assert out.columns == docs.columns, name
        kept, _ = p.written(out, "test")
        assert 0 < kept.count() <= docs.count() and kept.join(docs, docs.columns, "left_anti").count() == 0
        docs = kept
    last = p.STAGES[-1][1](spark, docs, smallest)
    assert last.count() == docs.count() and last.where(F.col("n_tokens") == 0).count() == 0
