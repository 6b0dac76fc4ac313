"""The whole pipeline against each stage's SQL or brute force, stage by stage on the same input."""

import hashlib

import duckdb

import corpus_pipeline as p
from gleanbin.llm import langid, mixing, quality
from gleanbin.llm.queries import tokenizer_path


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_run_equals_brute_force(spark, smallest):
    from tokenizers import Tokenizer

    from tests.llm.test_dedup import brute

    docs = p.table(spark, smallest, "documents")
    network = langid.fitted(docs)
    kept = docs.join(langid.predict(docs, network, ["doc_id"]).where("lang_pred <> 'und' and score >= 0.3").select("doc_id"), "doc_id", "left_semi").toPandas()
    c = duckdb.connect()
    c.register("all_documents", kept)
    c.sql("create table documents as select * from all_documents")
    good = {r[0] for r in c.sql(f"select doc_id from ({quality.ORACLE}) where kept").fetchall()}
    rows = [(a, b) for a, b in zip(kept["doc_id"], kept["text"]) if a in good]
    first = sorted(set(brute(rows).values()))
    c.register("first", kept[kept["doc_id"].isin(first)])
    c.sql("create or replace table documents as select * from first")
    mixed = sorted(r[0] for r in c.sql(f"select doc_id from ({mixing.ORACLE})").fetchall())
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    text = dict(rows)
    want = {}
    for d in mixed:
        x = tok.encode(text[d], add_special_tokens=False).ids
        want[d] = (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(tok.decode(x, skip_special_tokens=False).encode()).hexdigest())
    rows = p.run(spark, smallest).collect()
    assert sorted(r["doc_id"] for r in rows) == mixed  # a row for each epoch taken
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_clean_documents(spark, smallest):
    """Of documents labelled good and not toxic that the base rules pass, the filtering stages keep all but a few."""
    docs = p.table(spark, smallest, "documents")
    labels = p.table(spark, smallest, "labels").where("quality = 1 and toxic = 0")
    clean = ids(docs.join(labels, "doc_id", "left_semi"))
    base = {r["doc_id"] for r in quality.judge(docs, ordered=quality.RULES).where("not base_failed").select("doc_id").collect()}
    after = ids(p.identify_language(spark, docs, smallest))
    assert len(clean - after) <= 0.01 * len(clean)
    assert len((clean & base) - ids(p.apply_quality_rules(spark, docs, smallest))) <= 0.02 * len(clean)


def test_near_duplicates_leave_one_of_each(spark, smallest):
    from tests.llm.test_dedup import brute

    docs = p.table(spark, smallest, "documents")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert ids(p.drop_near_duplicates(spark, docs, smallest)) == set(brute(pairs).values())


def test_empty_table_goes_through(spark, smallest):
    docs = p.table(spark, smallest, "documents").limit(0)
    for _, stage in p.STAGES:
        docs, _ = p.written(stage(spark, docs, smallest), "empty")
        assert docs.count() == 0
