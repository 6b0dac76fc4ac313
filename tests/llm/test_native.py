"""WARC archives, mixing, chat formatting, quality rules and URL templates on small tables; SQL on the driver's."""

import hashlib
import json
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from gleanbin.llm import chatfmt, mixing, quality, urltree, warc
from gleanbin.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, smallest, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.sql(f"create view {t} as select * from '{smallest}/{t}.parquet'")
    df = QUERIES[name](spark, smallest)
    want = c.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    order = [list(want.columns).index(x) for x in columns]
    assert Counter(tuple(r[x] for x in columns) for r in df.collect()) == Counter(tuple(r[k] for k in order) for r in want.fetchall())


# --- WARC ---------------------------------------------------------------------------------------------------------------


def test_loser_tree_merges_any_runs():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(20), i, j) for j in range(rng.randrange(9))) for i in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda r: r)) == sorted(x for r in runs for x in r)


def test_warc_cases(spark):
    big = "\r\n\r\nWARC/1.1\r\né" * 20
    rows = [(4, "http://www.B.example/x?q#f", big), (2, "http://a.example/\r\nX: y", big), (9, None, big), (1, "http://b.example/", None), (7, "http://b.example/", "small"), (8, "u", "small"), (None, "v", big), (2, "http://a.example/", big)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    h = warc.history(d)
    got = h.collect()
    assert len(got) == len(rows)
    by = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert by == Counter({(4, "revisit", 2): 1, (2, "response", None): 2, (9, "revisit", 2): 1, (1, "response", None): 1, (7, "response", None): 1, (8, "response", None): 1, (None, "revisit", 2): 1})
    digest = hashlib.sha256(big.encode()).hexdigest()
    assert all(r["payload_digest"] == digest and r["payload_bytes"] == len(big.encode()) for r in got if r["page_id"] in (4, 2, 9, None))
    # partition after partition, the index is in order
    keys = [(r["url_key"], r["capture_ts"], r["page_id"] is not None, r["page_id"] or 0) for r in got]
    assert keys == sorted(keys)
    assert warc.url_key("http://www.B.example:80/x?q#f") == "example,b)/x?q" and warc.url_key("") == ""
    assert warc.history(d.limit(0)).count() == 0


def test_archives_are_read_by_a_plain_parser(spark, tmp_path):
    import gzip

    d = spark.createDataFrame([(1, "http://a/", "x" * 200), (2, "http://b/", "x" * 200)], "page_id long, url string, html string")
    warc.write_archives(d.coalesce(1), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.gz")))
    assert data.count(b"WARC/1.1\r\n") == 2 and data.count(b"x" * 200) == 1 and data.endswith(b"\r\n\r\n")


# --- mixing ---------------------------------------------------------------------------------------------------------------


def brute_fill(budget, children):
    """Water filling by repeated rounds; children: {key: (cap, weight)}."""
    got, open_ = {}, dict(children)
    while open_:
        w = sum(x[1] for x in open_.values())
        left = budget - sum(got.values())
        full = {k for k, (cap, own) in open_.items() if cap * w <= left * own}
        if not full:
            part = {k: left * own // w for k, (_, own) in open_.items()}
            extra = left - sum(part.values())
            for k in sorted(open_, key=lambda k: (-open_[k][1], k))[:extra]:
                part[k] += 1
            return got | part
        got |= {k: open_.pop(k)[0] for k in full}
    return got


def test_filling_equals_repeated_rounds(spark):
    rng = random.Random(6)
    cases = [{f"k{i}": (rng.randrange(1, 60), rng.randrange(1, 6)) for i in range(rng.randrange(1, 8))} for _ in range(30)]
    budgets = [rng.randrange(0, sum(c for c, _ in x.values()) + 30) for x in cases]
    rows = [(n, k, c, w, min(b, sum(v[0] for v in x.values()))) for n, (x, b) in enumerate(zip(cases, budgets)) for k, (c, w) in x.items()]
    d = spark.createDataFrame(rows, "p int, k string, cap long, w long, b long").select("p", "k", F.col("cap").cast("decimal(25,0)").alias("_cap"), F.col("w").cast("decimal(12,0)").alias("_w"), F.col("b").cast("decimal(25,0)").alias("_budget"))
    got = {(r["p"], r["k"]): int(r["_got"]) for r in mixing.filled(d, ["p"], "k").collect()}
    for n, (x, b) in enumerate(zip(cases, budgets)):
        assert {k: got[n, k] for k in x} == brute_fill(min(b, sum(v[0] for v in x.values())), x)


def test_mixing_takes_the_budget_and_epochs(spark):
    d = spark.createDataFrame([(k, "w " * (1 + k % 7), "en" if k % 3 else None, ["src0", "src4", None][k % 3], "x") for k in range(300)] + [(1, None, "en", "src0", "x")], "doc_id long, text string, lang string, source string, _taken string")
    docs = d.drop("_taken")
    m = mixing.mixed(docs, share=150, epochs=2)
    total = sum(1 + k % 7 for k in range(300))
    assert m.agg(F.sum("_taken")).first()[0] == total * 150 // 100
    assert m.agg(F.max("_epoch")).first()[0] == 1
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


# --- chats ------------------------------------------------------------------------------------------------------------------


def test_layouts_become_the_same_turns(spark):
    ok = [("user", "hi"), ("assistant", "yo")]
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "id": 3},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"prompt": "hi", "completion": "yo"},
        {"prompt": "hi", "response": "yo", "extra": {"a": 1}},
        {"instruction": "hi", "output": "yo"},
        {"question": "hi", "answer": "yo"},
    ]
    odd = ["{}", "not json", None, json.dumps({"prompt": "hi"}), json.dumps({"messages": []})]
    d = spark.createDataFrame([(k, r) for k, r in enumerate([*map(json.dumps, records), *odd])], "k int, r string")
    got = {r["conv_id"]: r for r in chatfmt.from_json_records(d, "r", "k").collect()}
    for k in range(len(records)):
        assert [tuple(t) for t in got[k]["turns"]] == ok, records[k]
    assert all(got[len(records) + k]["turns"] is None for k in range(len(odd)))
    both = spark.createDataFrame([(1, json.dumps({"instruction": "sum", "input": "1 2", "output": "3", "system": "be brief"}))], "k int, r string")
    assert [tuple(t) for t in chatfmt.from_json_records(both, "r", "k").first()["turns"]] == [("system", "be brief"), ("user", "sum\n\n1 2"), ("assistant", "3")]
    typed = spark.createDataFrame([("hi", "yo")], "prompt string, response string")
    assert [(r["role"], r["text"]) for r in chatfmt.turn_rows(typed).orderBy("turn").collect()] == ok


def test_format_is_reversible(spark):
    rng = random.Random(7)
    parts = ["\\", "<turn", "</turn>", "</turn>\n", "<turn user>\n", "\\l", "\\b", "\n", "é", "🙂", "a", "### Assistant:", ">", "\\n"]
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
    rows = [(c, t, rng.choice(["user", "assistant", "a>b\n\\", None]), text()) for c in (1, 2, None) for t in (*range(150), 3, 3, None)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").select("conv_id", "turn", "role", "text")
    segments = chatfmt.formatted(chatfmt.turn_rows(d))
    assert segments.agg(F.max(F.size(F.split("formatted", "</turn>\n")))).first()[0] <= chatfmt.SEGMENT + 3
    got = {r["conv_id"]: r for r in chatfmt.digests(segments).collect()}
    for c in (1, 2, None):
        own = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c]["loss_sha256"], got[c]["loss_chars"], got[c]["n_turns"]) == (hashlib.sha256(loss.encode()).hexdigest(), len(loss), len(own))


# --- quality ----------------------------------------------------------------------------------------------------------------


def test_measures_against_brute_force(spark):
    import re

    rng = random.Random(8)
    words = ["a", "bb", "c#", "é", "<x>", "$", "w\u00a0w"]
    texts = [None, "", " \n\t ", "one"] + ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\n\n"]) for _ in range(rng.randrange(1, 80))) for _ in range(120)]
    d = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: r for r in quality.judge(d, ordered=quality.RULES).collect()}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        again = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))
        assert tuple(got[k][m] for m in quality.MEASURES) == want, t
        assert got[k]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[k]["kept"] and got[k]["base_failed"])


def test_rule_order_moves_no_verdict(spark, smallest):
    d = spark.read.parquet(f"{smallest}/documents.parquet")
    a = quality.judge(d, ordered=quality.RULES).select("doc_id", "kept").collect()
    b = quality.judge(d, ordered=quality.RULES[::-1]).select("doc_id", "kept").collect()
    assert sorted(a) == sorted(b)
    assert sorted(quality.order(d), key=lambda r: r.name) == sorted(quality.RULES, key=lambda r: r.name)
    assert quality.judge(d.limit(0)).count() == 0 and quality.kept_documents(d).columns == d.columns


# --- URLs -------------------------------------------------------------------------------------------------------------------


def test_rules_and_parts(spark):
    urls = ["http://A.com/x", "https://example.com/en/1?q#f", "http://WWW.example.com/en/", "http://m.www.example.com/en/z", "http://x.net/es/1", "http://x.net/de/1", "http://notcom", "http://com", "http://xcom/", None, "no url", "http://É.com/a b", "http://a.b.com?x=/y", "x://http://z.net/fr/#"]
    d = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urltree.op10(d).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow") and got[1] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow") and got[3][2:] == ("www.example.com/en/", "allow")
    assert got[4] == ("x.net", "/es/1", "net/es/", "block") and got[5] == ("x.net", "/de/1", None, "allow")
    assert got[6][:3] == ("notcom", "", None) and got[7][:3] == ("com", "", None) and got[8][2] is None
    assert got[9] == ("", "", None, "allow") == got[10] and got[11][:2] == ("É.com", "/a b") and got[12][:3] == ("a.b.com", "", None) and got[13][:2] == ("http:", "//z.net/fr/")
    assert urltree.op10(d.limit(0)).count() == 0


def test_templates_split_by_labels_and_reject_by_purity(spark):
    rows = [(k, f"http://h.org/{'spam' if k % 4 == 0 else 'news'}/{k}") for k in range(400)] + [(1000 + k, f"http://h.org/{'spam' if k % 2 else 'blog'}/{k}x") for k in range(40)]
    d = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, k % 4 == 0) for k in range(400)], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in urltree.judged(d, rules=[], labels=labels).collect()}
    assert all((r["verdict"] == "block") == ("/spam/" in r["path"]) for r in got.values())
    assert {r["template"] for r in got.values()} == {"/spam/*", "/news/*", "/*/*"}
