"""Odd tables: clashing names, null ids, zero weights, long payloads, mixed layouts; URL templates against brute force."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanbin.llm import bagminhash, chatfmt, mixing, quality, urltree, warc

CLASHING = ["_text", "_n_words", "_lines", "_place", "_taken", "_tokens", "_domain", "_salt", "_key", "_node", "_h", "h", "node", "_k0", "_d1", "_digits", "_whole", "_lang", "_score", "tree"]


def clashing(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, len(r[1] or ""), *[f"{c}!" for c in CLASHING]) for r in rows], schema)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def odd_documents(spark):
    rng = random.Random(1)
    texts = [prose(rng, 40) for _ in range(24)]
    rows = [(k, t, "en", f"src{k % 3}") for k, t in enumerate(texts)]
    rows += [(30, texts[0], "en", "src0"), (30, texts[0], "en", "src0"), (None, prose(rng, 40), "en", "src1"), (None, texts[1], None, None), (31, None, "en", "src0"), (32, "", None, "src0")]
    return clashing(spark, rows)


@pytest.mark.parametrize("stage", [quality.kept_documents, mixing.mixed_documents, bagminhash.first_of_each])
def test_columns_of_any_name_pass_unchanged(odd_documents, stage):
    kept = stage(odd_documents)
    assert kept.columns == odd_documents.columns
    rows = kept.collect()
    assert rows and all(r[c] == f"{c}!" for r in rows for c in CLASHING)


def test_pipeline_over_odd_rows(spark, odd_documents, smallest):
    docs = odd_documents
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = corpus_pipeline.written(stage(spark, docs, smallest), "odd")
        if name != "encoding":
            assert docs.columns == odd_documents.columns, name
    assert docs.count() > 0


def test_one_of_each_with_repeated_and_missing_ids(spark):
    long = " ".join(f"w{k}" for k in range(60))
    near = long.replace("w59", "other")
    rows = [(5, long), (5, prose(random.Random(2), 30)), (7, near), (None, long), (None, "alone without an id here"), (8, long)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"] or -1, r["text"][:5]) for r in bagminhash.first_of_each(d).collect())
    assert [k for k, _ in kept] == [-1, 5]
    got = Counter((r["doc_id"], r["class_id"]) for r in bagminhash.near_duplicates(d).collect())
    assert got == Counter({(5, 5): 2, (7, 5): 1, (None, 5): 1, (None, None): 1, (8, 5): 1})


def test_very_long_texts_are_signed_whole(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "CHUNK", 700)
    rng = random.Random(3)
    words = prose(rng, 5_000).split()
    other = words[:2_500] + prose(rng, 2_500).split()
    edited = [w if k % 100 else "x" for k, w in enumerate(words)]
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(edited))], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(d).collect()} == {1: 1, 2: 2, 3: 1}


# --- mixing -----------------------------------------------------------------------------------------------------------------


def test_weights_of_zero_take_nothing(spark):
    rows = [(k, "w " * 4, "en" if k % 2 else "de", f"src{k % 3}") for k in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = mixing.mixed(d, share=90, epochs=1, weights={"domain": {"web": 0, "books": 2}, "lang": {"de": 0}, "source": {}})
    got = {(r["_domain"], r["_lang"]): r["n"] for r in taken.groupBy("_domain", "_lang").agg(F.sum("_taken").alias("n")).collect()}
    assert got == {("books", "en"): 80, ("reference", "en"): 80}
    assert mixing.mixed(d, weights={"domain": {"web": 0, "books": 0, "reference": 0}}).count() == 0


def test_null_ids_are_spread_by_text(spark):
    rng = random.Random(4)
    rows = [(None, prose(rng, 1 + k % 5), "en", "src0") for k in range(200)] + [(None, None, "en", "src0"), (3, " ", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    total = sum(1 + k % 5 for k in range(200))
    taken = mixing.mixed(d, share=50, epochs=2)
    assert taken.agg(F.sum("_taken")).first()[0] == total // 2
    a, b = (sorted(r["text"] for r in x.collect()) for x in (taken, mixing.mixed(d.repartition(5), share=50, epochs=2)))
    assert a == b


# --- quality ----------------------------------------------------------------------------------------------------------------


def test_filter_keeps_what_the_judge_keeps(spark, smallest):
    d = spark.read.parquet(f"{smallest}/documents.parquet")
    rows = [(-1, None), (-2, "a\rb\r" * 20), (-3, "- a\n- b\n- c d e f g h i j k\n"), (-4, "1 2 3 4 5 6 7 8 9 10 11"), (-5, "  x" * 30)]
    d = d.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    want = sorted(r["doc_id"] for r in quality.judge(d).where("kept").collect())
    assert sorted(r["doc_id"] for r in quality.kept_documents(d).collect()) == want


def test_order_is_the_same_in_every_run(spark, smallest):
    d = spark.read.parquet(f"{smallest}/documents.parquet")
    rules = [*quality.BASE, *quality.RULES]
    first = [r.name for r in quality.order(d, rules)]
    assert first == [r.name for r in quality.order(d.repartition(3), rules[::-1])]
    assert first.index("repeated_words") > 0


def test_later_rules_are_not_evaluated(spark):
    fails = quality.Rule("fails", lambda m: F.raise_error(F.concat(F.lit("read "), m.text)).cast("boolean"), ("letters",))
    all_short = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = all_short.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    ordered = [*quality.BASE, fails]
    assert rows.where(quality.verdict(ordered, quality.OfText(F.col("t"))).isNull()).count() == 0


# --- chats ------------------------------------------------------------------------------------------------------------------


def test_second_elements_count_in_the_fingerprint(spark):
    records = [{"messages": [{"role": "user"}, {"role": "assistant", "content": "yo"}]}, {"messages": [{"role": "user"}]}, {"messages": ["x", {"content": "c"}, {"role": "user"}]}]
    d = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "k int, r string")
    got = {r["conv_id"]: r for r in chatfmt.from_json_records(d, "r", "k").collect()}
    assert [tuple(t) for t in got[0]["turns"]] == [("user", ""), ("assistant", "yo")] and got[1]["turns"] is None
    assert got[2]["mapping"] == "messages" and got[0]["fingerprint"] == got[2]["fingerprint"] != got[1]["fingerprint"]


def test_rows_of_one_table_select_mappings_of_their_own(spark):
    schema = "conv_id long, turn long, role string, text string, prompt string, completion string, messages array<struct<role: string, content: string>>"
    rows = [
        (1, 0, "user", "hi", None, None, None),
        (1, 1, "assistant", None, None, None, None),
        (2, None, None, None, "ask", "tell", None),
        (3, None, None, None, None, None, [("user", "a"), ("assistant", "b")]),
        (4, None, None, None, "no answer", None, None),
    ]
    d = spark.createDataFrame(rows, schema)
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in chatfmt.turn_rows(d).collect())
    layouts = [(1, 0, "user", "hi"), (1, 1, "assistant", ""), (2, 0, "user", "ask"), (2, 1, "assistant", "tell"), (3, 0, "user", "a"), (3, 1, "assistant", "b")]
    assert got == layouts


# --- WARC -------------------------------------------------------------------------------------------------------------------


def test_long_payloads_have_archives_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(warc, "SMALL", 64)
    monkeypatch.setattr(warc, "FILE_RECORDS", 8)
    rows = [(k, f"http://h/{k}", f"{k}" * size) for k, size in enumerate([10, 63, 64, 65, 900, 17_000, 300_000, 0])]
    d = spark.createDataFrame([*rows, (99, None, rows[6][2])], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.history(d).collect()}
    assert {k: r["payload_bytes"] for k, r in got.items()} == {k: len(t) for k, _, t in rows} | {99: 300_000}
    assert got[99]["refers_to"] == 6 and len({got[k]["archive"] for k in (3, 5, 6)}) == 3


# --- URLs -------------------------------------------------------------------------------------------------------------------


def brute_verdicts(pages, labels):
    """The template tree over plain dictionaries: page_id -> (verdict, template)."""
    at = {}
    for page, url in pages:
        host, _, rest = url.removeprefix("http://").partition("/")
        at[page] = (host, "/" + rest)
    stats = defaultdict(lambda: [0, 0, 0])
    for page, key in at.items():
        s = stats[key]
        s[0] += 1
        s[1] += page in labels
        s[2] += labels.get(page, False)
    total = sum(s[2] for s in stats.values()) / (sum(s[1] for s in stats.values()) or 1)
    template, blind = {}, set()

    def walk(keys, name, depth):
        n, bad = sum(stats[k][0] for k in keys), sum(stats[k][2] for k in keys)
        segments = {k: k[1][1:].split("/") for k in keys}
        if not 0 < bad < n or len(keys) < 2:
            for k in keys:
                template[k] = name + "/*" * max(0, len(segments[k]) - depth)
            return
        groups = defaultdict(list)
        for k in keys:
            if len(segments[k]) <= depth:
                template[k] = name
            else:
                s = segments[k][depth]
                groups["*" if any(c.isdigit() for c in s) else s].append(k)
        sums = {s: [sum(stats[k][j] for k in own) for j in range(3)] for s, own in groups.items()}
        words = [s for s in groups if s != "*"]
        l, b = (sum(sums[s][j] for s in words) for j in (1, 2))
        p = (b + 0.5) / (l + 1)
        crowded = len(words) >= urltree.CROWD and 2 * len(words) > sum(sums[s][0] for s in words)
        below = defaultdict(list)
        for s, own in groups.items():
            apart = s != "*" and sums[s][1] > 0 and abs(sums[s][2] - sums[s][1] * p) > urltree.NEAR * (sums[s][1] * p * (1 - p)) ** 0.5
            if apart:
                below[s] += own
            elif s == "*" or crowded:
                below["*"] += own
            elif sums[s][1]:
                below["+"] += own
            else:
                for k in own:
                    blind.add(k)
                    template[k] = name + "/*" * (len(segments[k]) - depth)
        for s, own in below.items():
            walk(own, f"{name}/{s}", depth + 1)

    for host in {k[0] for k in stats}:
        walk([k for k in stats if k[0] == host], "", 0)
    pure = defaultdict(lambda: [0, 0])
    for k, s in stats.items():
        if k not in blind:
            pure[k[0], template[k]][0] += s[1]
            pure[k[0], template[k]][1] += s[2]
    out = {}
    for page, k in at.items():
        n, bad = pure[k[0], template[k]]
        block = k not in blind and n > 0 and (bad + urltree.PRIOR * total) / (n + urltree.PRIOR) >= urltree.LEAST
        out[page] = ("block" if block else "allow", template[k])
    return out


def test_templates_against_brute_force(spark):
    rng = random.Random(5)
    pages, labels = [], {}
    for k in range(1500):
        host = rng.choice(["a.org", "b.net", "b.net", "c.com"])
        top = rng.choice(["en", "es", "fr", "de", "news", "spam"])
        parts = [top, *[rng.choice(["x", "y", "post", str(rng.randrange(50)), f"{rng.choice('pqrstuvw')}{rng.choice('pqrstuvw')}"]) for _ in range(rng.randrange(0, 5))]]
        pages.append((k, f"http://{host}/{'/'.join(parts)}"))
        if rng.random() < 0.5 and top not in ("de", "news"):
            labels[k] = (top == "spam" or (top == "es" and "post" in parts)) != (rng.random() < 0.05)
    pages.append((9_000, "http://b.net/" + "deep/" * 3_000))
    d = spark.createDataFrame(pages, "page_id long, url string")
    marks = spark.createDataFrame(list(labels.items()), "page_id long, bad boolean")
    got = {r["page_id"]: (r["verdict"], r["template"]) for r in urltree.judged(d, rules=[], labels=marks).collect()}
    want = brute_verdicts(pages, labels)
    assert got == want and 0 < sum(v == "block" for v, _ in got.values()) < len(got)
    assert all(got[k][0] == "allow" for k, u in pages if "/news" in u.split("//")[1][5:10] or "/de" in u.split("//")[1][5:8])


def test_branches_without_labels_are_not_rejected_with_their_siblings(spark):
    pages = [(k, f"http://x.net/{seg}/{k}") for k, seg in enumerate(["es", "fr", "en", "de"] * 30)] + [(500, "http://x.net/es/"), (501, "http://x.net/")]
    d = spark.createDataFrame(pages, "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urltree.op10(d).collect()}
    assert all((got[k] == "block") == ("/es/" in u or "/fr/" in u) for k, u in pages)
