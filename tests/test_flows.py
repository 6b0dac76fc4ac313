"""Flows, utilities, configuration and debug prototypes."""

import pytest
from pyspark.sql import functions as F

from gleanbin import config, schema
from gleanbin.functions import text
from gleanbin.operators import vocab
from gleanbin.plans import flows
from gleanbin.sources import dwarf


def test_configuration():
    c = config.parse('# a comment\n{"analysis": {"threads": 4, "fast": "True"},\n  # another\n "name": "x"}', ("analysis",))
    assert (c.analysis.threads, c.analysis.fast, c.name) == (4, True, "x")
    with pytest.raises(ValueError):
        config.parse("{}", ("analysis",))


def test_text_functions(spark):
    r = spark.range(1).select(text.ordinal_follower(F.lit(21)), text.plural_follower(F.lit(1)), text.list_to_string(F.array(F.lit(1), F.lit(2))), text.bytes_of_bits(F.lit("0000000111111111")), text.chunks_of_total(F.array(*map(F.lit, [3.0, 3.0, 5.0, 9.0, 1.0])), 6.0)).first()
    assert tuple(r) == ("st", "", "1,2", [1, 255], [[3.0, 3.0], [5.0], [9.0], [1.0]])


def test_debug_types(spark):
    rows = [(1, 1, None, "base_type", "char", None), (1, 2, None, "const_type", None, 1), (1, 3, None, "pointer_type", None, 2), (1, 4, None, "pointer_type", None, None), (1, 10, None, "subprogram", "puts", 1), (1, 11, 10, "formal_parameter", "s", 3), (1, 12, 10, "formal_parameter", "p", 4), (1, 5, None, "pointer_type", None, 5)]
    e = spark.createDataFrame(rows, "binary_id long, offset long, parent long, tag string, name string, type long")
    got = {r["offset"]: r["type_name"] for r in dwarf.type_names(e).collect()}
    assert got[3] == "const char*" and got[4] == "void"
    p = dwarf.prototypes(e).first()
    assert (p["name"], p["returns"], [tuple(x) for x in p["params"]]) == ("puts", "char", [("s", "const char*"), ("p", "void")])


def test_settings_and_closures(spark):
    f = schema.struct(schema.FUNCTIONS)
    base = {x.name: None for x in f}
    rows = [tuple({**base, "id": k, "binary_id": k % 40, "name": f"init_file{k % 3}", "real_name": f"f{k}", "callees": [f"f{k + 40}", "printf"], "callers": [], "imported_data_refs": ["stdin"]}.values()) for k in range(80)]
    functions = spark.createDataFrame(rows, f)
    binaries = functions.select(F.col("binary_id").alias("id")).distinct()
    s = flows.settings(functions, binaries, vocab.alpha_numeric)
    assert s["split"].count() == 40 and s["tokens"].where("item = 'init'").count() == 1
    assert all(df.count() >= 0 for df in s.values())
    c = {r["name"]: r["closure"] for r in flows.closures(functions).where("binary_id = 3").collect()}
    assert c == {"f3": ["f3", "f43", "f83", "printf"], "f43": ["f43", "f83", "printf"]}


def test_frames_and_evaluation(spark):
    labels = spark.createDataFrame([(k, f"l{k % 2}") for k in range(40)] + [(1, "rare")], "row long, label string")
    x = spark.range(41).select(F.col("id").alias("row"), F.array(F.col("id").cast("double")).alias("vector"))
    split = vocab.hash_split(x.select("row"), "row")
    frames = flows.training_frames(x, labels, split, 10)
    assert sum(a.count() for a, _ in frames.values()) == 40 and all(y.where("label = 'rare'").count() == 0 for _, y in frames.values())
    scores = labels.select("row", "label", F.lit(0.9).alias("score"))
    names = labels.select("row", F.lit("main").alias("name")).distinct()
    e = flows.evaluated(scores, labels, names).first()
    assert e["micro_f1"] == 1 and e["macro_f1"] == 1 and e["ndcg"] == 1
    assert 0.001 <= flows.fitted_threshold(scores, labels) < 0.9
    a, b = flows.propensity_fit(labels)
    assert a >= 0 and b >= 0


def test_vectors_with_contexts(spark):
    f = spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (3, 8, "c")], "id long, binary_id long, real_name string")
    v = spark.createDataFrame([(1, 0, 1.0), (2, 0, 3.0), (3, 0, 5.0)], "row long, pos int, value double")
    e = spark.createDataFrame([(1, 2)], "src long, dst long")
    s = spark.createDataFrame([(7, "train"), (8, "test")], "id long, split string")
    got = {r["row"]: (r["own"], r["binary"], r["near"]) for r in flows.with_contexts(f, e, v, s).collect()}
    assert got == {1: ([-1.0], [0.0], [1.0]), 2: ([1.0], [0.0], [-1.0]), 3: ([3.0], [3.0], [0.0])}


def test_references(spark):
    f = spark.createDataFrame([(1,)], "id long")
    refs = spark.createDataFrame([(9, 1, 100), (9, 1, 205), (9, 1, 77)], "binary_id long, function_id long, address long")
    named = spark.createDataFrame([(9, "function", 100, 150, "f"), (9, "data", 200, 210, "d")], "binary_id long, kind string, start long, end long, name string")
    sections = spark.createDataFrame([(9, 90, 300)], "binary_id long, start long, end long")
    r = flows.referenced(f, refs, named, sections).first()
    assert (r["callees"], r["data_refs"], r["imported_data_refs"], r["constants"]) == (["f"], ["d"], None, [77])
