"""Hand-computed cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from gleanbin import schema
from gleanbin.operators import dataflow, features, graph, intervals, knn, learning, lm, metrics, names, similarity, store, vocab
from gleanbin.sources import io


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def labelled(spark):
    truth = spark.createDataFrame([(1, 0), (1, 2), (2, 1)], "row int, label int")
    scores = [(1, [0.9, 0.1, 0.4, 0.2]), (2, [0.3, 0.2, 0.8, 0.0]), (3, [0.0, 0.6, 0.1, 0.1])]
    return truth, spark.createDataFrame([(r, k, x) for r, xs in scores for k, x in enumerate(xs)], "row int, label int, score double")


def test_multi_label_metrics(labelled):
    truth, scores = labelled
    c = metrics.confusion(truth, metrics.predicted(scores, 0.25))
    m = metrics.micro(c).first()
    assert (m["tp"], m["fp"], m["fn"]) == (2, 3, 1)
    assert [round(m[k], 6) for k in ("precision", "recall", "f1")] == [0.4, 0.666667, 0.5]
    a = metrics.macro(c).first()
    assert round(a["precision"], 6) == 0.333333 and round(a["recall"], 6) == 0.666667 and round(a["f1"], 6) == 0.666667
    assert c.agg(F.sum(F.col("tp") + F.col("fn"))).first()[0] == truth.count()


def test_ranking_metrics(labelled):
    truth, scores = labelled
    g = {r["row"]: r for r in metrics.gains(scores, truth, 2).collect()}
    assert round(g[1]["dcg"], 6) == 1.630930 and [g[k]["ndcg"] for k in (1, 2, 3)] == [1, 0, 1]
    assert metrics.label_recall_at_k(scores, truth, 2).agg(F.avg("recall")).first()[0] == 0.5


def test_threshold_sweep_equals_direct_counts(labelled):
    truth, scores = labelled
    grid = [0.05, 0.1, 0.2, 0.25, 0.4, 0.5, 0.8]
    for r in metrics.threshold_sweep(scores, truth, grid).collect():
        m = metrics.micro(metrics.confusion(truth, metrics.predicted(scores, r["threshold"]))).first()
        assert (r["tp"], r["fp"], r["fn"]) == (m["tp"], m["fp"], m["fn"])
    assert metrics.best_threshold(scores, truth, grid).count() == 1


def test_propensity_and_preconditioning(spark):
    d = spark.range(1).select(vocab.inverse_propensity(F.lit(10), F.lit(100)).alias("p"))
    assert round(d.first()["p"], 6) == 2.332893
    labels = spark.createDataFrame([(k, "x") for k in range(4)] + [(k, "y") for k in range(2, 5)], "row int, label string")
    assert rows(vocab.preconditioned(labels, 10), "row", "label") == [(0, "x"), (1, "x"), (2, "x"), (3, "x")]
    a, b, cost = vocab.fit_propensity(list(range(1, 400)), 1000)
    assert 0 <= a <= 100 and 0 <= b <= 100 and cost < 3


def test_band_is_strict_on_both_ends(spark):
    items = spark.createDataFrame([(x,) for x in "abbcccdddd"], "x string")
    assert rows(store.frequent(items, "x", 1, 4), "x") == [("b",), ("c",)]


def test_splits_do_not_depend_on_partitions(spark):
    a = vocab.hash_split(spark.range(500, numPartitions=1), "id")
    b = vocab.hash_split(spark.range(500, numPartitions=7), "id")
    assert rows(a, "id", "split") == rows(b, "id", "split")


def test_closure_holds_cycles_and_self(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "printf")], "src string, dst string")
    c = graph.transitive_closure(e)
    assert rows(c.where("src = 'a'"), "dst") == [("a",), ("b",), ("c",), ("printf",)]
    assert c.where("src = 'printf'").count() == 0
    again = graph.transitive_closure(c)
    assert rows(again, "src", "dst") == rows(c, "src", "dst")


def test_components_and_kernel(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (20, 21), (21, 20)], "src long, dst long")
    assert rows(graph.components(e), "node", "component") == [(3, 3), (4, 3), (5, 3), (7, 7), (8, 7), (9, 3), (20, 20), (21, 20)]
    assert rows(graph.largest_component(e), "node") == [(3,), (4,), (5,), (9,)]
    h = spark.createDataFrame([("x",), ("y",)], "label string")
    assert graph.wl_kernel(h, h).first()[0] == pytest.approx(1)


def test_kernel_of_large_graphs_and_missing_labels(spark):
    many = spark.range(200_000).select(F.when(F.col("id") % 4 > 0, "x").otherwise("y").alias("label"))  # 150,000 x, 50,000 y
    assert graph.wl_kernel(many, many).first()[0] == pytest.approx(1)
    one = spark.createDataFrame([("x",), (None,)], "label string")
    assert graph.wl_kernel(one, one).first()[0] == pytest.approx(1)
    assert math.isnan(graph.wl_kernel(one, one.where("false")).first()[0])
    assert graph.wl_kernel(one.where("false"), one.where("false")).first()[0] is None


def test_taint_closure_is_order_free(spark):
    flows = [("f", "rdi", "g", "rsi"), ("g", "rsi", "h", "rdx"), ("h", "rdx", "f", "rdi")]
    a = graph.taint_closure(spark.createDataFrame(flows, "func string, arg string, callee string, reg string"))
    b = graph.taint_closure(spark.createDataFrame(flows[::-1], "func string, arg string, callee string, reg string"))
    assert rows(a, "func", "arg", "callee", "reg") == rows(b, "func", "arg", "callee", "reg")
    assert ("f", "rdi", "h", "rdx") in rows(a, "func", "arg", "callee", "reg") and a.count() == 9


def test_names(spark):
    d = spark.createDataFrame([("__imp_foo_64",), ("sym.imp.bar.isra.0",), ("memcpy_ssse3",), ("initNetworkFile",)], "n string")
    got = [r[0] for r in d.select(names.strip_decorations(F.col("n"))).collect()]
    assert got == [names.strip_decorations_text(n) for n in ("__imp_foo_64", "sym.imp.bar.isra.0", "memcpy_ssse3", "initNetworkFile")]
    assert got[:3] == ["foo", "bar", "memcpy"]
    assert sorted(d.where("n = 'initNetworkFile'").select(names.camel_words(F.col("n"))).first()[0]) == ["File", "Network", "init"]
    known = names.Dictionary(["init", "network", "file", "true", "base"], ["str", "cmp"])
    assert names.canonical_set("init_networkfile", known) == {"init", "network", "file"}
    assert "_".join(names.label_order("initnetworktruebase", names.canonical_set("initnetworktruebase", known))) == "init_network_true_base"
    assert names.canonical_set("strcmp", known) == {"str", "cmp"}
    assert names.label_order("subkeykey", ["key", "sub"]) == ["sub", "key", "key"]
    assert names.best_cover("abcabd", ["ab", "abc"]) == [(0, 3), (3, 5)]


def test_segmenter_over_arrow(spark):
    known = names.Dictionary(["init", "network", "file"])
    d = names.segmented(spark.createDataFrame([("init_networkfile",), (None,)], "s string"), "s", known)
    assert {r["s"]: (r["label_set"], r["canonical_name"]) for r in d.collect()} == {"init_networkfile": (["file", "init", "network"], "init_network_file"), None: (None, None)}


def test_name_similarity(spark):
    d = spark.createDataFrame([("", ""), ("a", ""), ("init_network", "initialised_networked"), ("alpha", "omega_zulu")], "a string, b string")
    stem = lambda ws: F.transform(ws, lambda w: F.substring(w, 1, 4))
    assert [r[0] for r in d.select(names.similar(F.col("a"), F.col("b"), stem=stem)).collect()] == [True, False, True, False]
    assert names.smith_waterman("abcd", "bc") == 2 and names.smith_waterman("abc", "xyz") == 0


def test_scaler_and_contexts(spark):
    v = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (1, 1, 1.0), (2, 1, 3.0)], "row int, pos int, value double")
    assert rows(features.scaled(v, features.scaler(v)), "row", "pos", "value") == [(1, 0, 0.0), (1, 1, -1.0), (2, 0, 0.0), (2, 1, 1.0)]
    e = spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int")
    assert rows(features.neighbour_context(e, v), "row", "pos", "value") == [(1, 0, 1.0), (1, 1, 3.0), (2, 0, 1.0), (2, 1, 1.0)]


def test_quantitative_vector_over_the_full_schema(spark):
    f = spark.createDataFrame([], schema.struct(schema.FUNCTIONS))
    one = f.select(features.quantitative(["Ijk_Boring"], ["Iop_Add64"]).alias("v"))
    assert one.count() == 0 and one.dtypes == [("v", "array<double>")]
    empty = spark.range(1).select(*[F.lit(None).cast(x.dataType).alias(x.name) for x in f.schema])
    assert len(empty.select(features.quantitative(["a"], ["b"])).first()[0]) == 16 + 1 + 1 + 240 + 136 + 8


def test_minhash_estimates_jaccard(spark):
    items = spark.createDataFrame([(1, f"a{k}") for k in range(60)] + [(2, f"a{k}") for k in range(20, 80)], "row int, item string")
    s = {r["row"]: r["signature"] for r in features.minhash(items, 128).collect()}
    assert abs(sum(x == y for x, y in zip(s[1], s[2])) / 128 - 0.5) < 0.15


def test_intervals(spark):
    held = spark.createDataFrame([(0, 10, 20, "f"), (0, 20, 20, "g")], "k int, start long, end long, name string")
    at = spark.createDataFrame([(0, x) for x in (10, 19, 20, 21)], "k int, at long")
    assert rows(intervals.lookup(at, held, ["k"], 8), "at", "name") == [(10, "f"), (19, "f"), (20, "g")]
    assert rows(intervals.outside(at, held, ["k"], 8), "at") == [(21,)]


def test_boundary_texts(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    n = intervals.nucleus_functions(lines("function 48841: entry@0xffffffff828a1131 321 bytes", "noise")).first()
    assert (int(n["vaddr"]), int(n["size"])) == (0xFFFFFFFF828A1131, 321)
    b = intervals.bap_functions(lines("(sub_6020 24710 24714)")).first()
    assert (int(b["vaddr"]), int(b["size"]), b["name"]) == (0x24710, 4, "sub_6020")
    o = intervals.objdump_symbols(lines("0000000000001139 g     F .text\t000000000000000f              main")).first()
    assert (int(o["vaddr"]), int(o["size"]), o["name"]) == (0x1139, 15, "main")
    assert int(intervals.ghidra_functions(lines("0x401000   32")).first()["size"]) == 32


def test_liveness_and_taint(spark):
    st = spark.createDataFrame([(1, 0, 0, [], ["a"]), (1, 1, 0, ["a"], ["b"]), (1, 2, 0, ["b", "c"], [])], "function_id long, bb_idx int, stmt_idx int, inputs array<string>, outputs array<string>")
    e = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 1)], "function_id long, src int, dst int")
    live = dataflow.live_variables(dataflow.block_liveness(st), e)
    assert rows(live, "bb_idx", "live_in") == [(0, ["c"]), (1, ["a", "c"]), (2, ["a", "b", "c"])]
    b = spark.createDataFrame([(1, 0, ["a"], []), (1, 1, [], [(["a"], ["b"])]), (1, 2, [], [(["x"], ["a"])])], "function_id long, bb_idx int, sources array<string>, statements array<struct<inputs:array<string>,outputs:array<string>>>")
    assert rows(dataflow.tainted_variables(b, e), "bb_idx", "tainted") == [(0, ["a"]), (1, ["a", "b"]), (2, ["b"])]


def test_constants_meet_at_top(spark):
    a = "array<struct<target:string,op:string,a:string,b:string>>"
    b = spark.createDataFrame([(1, 0, [("r", "const", "1", None)]), (1, 1, [("r", "const", "2", None), ("q", "const", "5", None)]), (1, 2, [("s", "add", "q", "3")])], f"function_id long, bb_idx int, assigns {a}")
    e = spark.createDataFrame([(1, 0, 2), (1, 1, 2)], "function_id long, src int, dst int")
    got = {r["bb_idx"]: {x["name"]: x["value"] for x in r["constants"]} for r in dataflow.propagated_constants(b, e).collect()}
    assert got[2] == {"r": "T", "q": "5", "s": "8"}


def test_dependencies_go_through_temporaries_only(spark):
    u = spark.createDataFrame([(1, "t1", "t2"), (1, "t2", "rdi"), (1, "rdi", "rsi")], "function_id long, var string, depends string")
    assert rows(dataflow.data_dependencies(u), "var", "depends") == [("rdi", "rsi"), ("t1", "rdi"), ("t1", "t2"), ("t2", "rdi")]


def test_matrix_text_round_trip(spark, tmp_path):
    entries = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (0, 2, 0.5)], "row long, idx int, value double")
    lines = [r["value"] for r in io.matrix_lines(entries, 2, 3).orderBy("line_no").collect()]
    assert lines == ["2 3", "0:1.000000 2:0.500000", ""]
    io.write_matrix(entries, 2, 3, str(tmp_path / "m"))
    assert rows(io.read_matrix(spark, str(tmp_path / "m")), "row", "idx", "value") == [(0, 0, 1.0), (0, 2, 0.5)]


def test_line_numbers_over_many_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}").write_text("".join(f"{k}-{j}\n" for j in range(4 - k)))
    got = [r["value"] for r in io.line_numbers(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == ["0-0", "0-1", "0-2", "0-3", "1-0", "1-1", "1-2", "2-0", "2-1"]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "A", "x")], "id int, a string, b string")
    new = spark.createDataFrame([(1, "B"), (2, "C")], "id int, a string")
    assert rows(io.upsert(old.select("id", "a"), new, ["id"]), "id", "a") == [(1, "B"), (2, "C")]
    assert rows(io.upsert_columns(old, new, ["id"]).fillna("-"), "id", "a", "b") == [(1, "B", "x"), (2, "C", "-")]


def test_binaries_and_ingest(spark, tmp_path):
    from gleanbin.streaming.ingest import ingest_new

    d = tmp_path / "bin"
    (d / "sub").mkdir(parents=True)
    (d / "a").write_bytes(b"\x7fELF1")
    (d / "sub" / "b").write_bytes(b"\x7fELF2")
    (d / "c").write_bytes(b"text")
    (d / "d").write_bytes(b"")
    assert io.collect_binaries(spark, str(d)).count() == 2
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    ingest_new(spark, str(d), out, chk)
    (d / "e").write_bytes(b"\x7fELF3")
    ingest_new(spark, str(d), out, chk)
    assert spark.read.parquet(out).count() == 3


def test_store_lookups(spark):
    protos = spark.createDataFrame([(7, "open"), (3, "open"), (1, "opan")], "id int, name string")
    wanted = spark.createDataFrame([("open",), ("close",)], "name string")
    assert rows(store.resolve_prototypes(wanted, protos), "name", "id") == [("open", 3)]
    like = spark.createDataFrame([("op_n",)], "name string")
    assert rows(store.resolve_prototypes(like, protos, like=True), "id") == [(1,)]


def test_neighbours_and_weights(spark):
    pts = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, math.sqrt(0.75)]), (3, [0.0, 1.0])], "id long, vector array<double>")
    n = knn.nearest(pts.where("id = 1"), pts, 1, same=True)
    r = n.first()
    assert (r["id"], round(r["cosine"], 6)) == (2, 0.5)
    w = knn.name_pmf(n, spark.createDataFrame([(2, "x")], "id long, name string")).first()
    assert w["p"] == 1.0
    assert spark.range(1).select(knn.angular(F.lit(math.sqrt(0.5)))).first()[0] == 0.5
    num = spark.range(1).select(similarity.numeric(F.lit(3), F.lit(4)), similarity.numeric(F.lit(0), F.lit(0))).first()
    assert tuple(num) == (0.75, 1.0)


def test_language_model(spark):
    seqs = spark.createDataFrame([(["get", "file", "name"],)] * 5 + [(["set", "file", "size"],)] * 3, "labels array<string>")
    model = lm.fitted(seqs, "labels")
    assert model.best_order(["name", "file", "get"]) == ["get", "file", "name"]
    sets = spark.createDataFrame([(["size", "file", "set"],)], "labels array<string>")
    assert lm.ordered(sets, "labels", model).first()["ordered"] == ["set", "file", "size"]


def test_ensemble_beats_label_frequency(spark):
    import random

    rng = random.Random(4)
    data = [(k, [float(k % 3 == c) + rng.gauss(0, 0.2) for c in range(3)], f"l{k % 3}") for k in range(240)]
    x = spark.createDataFrame([(r, v) for r, v, _ in data], "row long, vector array<double>")
    y = spark.createDataFrame([(r, label) for r, _, label in data], "row long, label string")
    p = y.select("label", F.lit(1.0).alias("inv_prop")).distinct()
    model = learning.train_ensemble(x.where("row < 180"), y.where("row < 180"), p, trees=6)
    best = learning.top_labels(learning.predict_ensemble(x.where("row >= 180"), model), 1).join(y.withColumnRenamed("label", "truth"), "row")
    assert best.where("label = truth").count() >= 54


def test_autoencoder_learns():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 10))
    losses = learning.Autoencoder(10, 16, 4).fit(x, epochs=15, rate=5e-3)
    assert len(losses) == 15 and losses[-1] < losses[0]


def test_constants_through_memory_and_stack(spark):
    a = "array<struct<target:string,op:string,a:string,b:string>>"
    steps = [("rsp", "sub", "rsp", "16"), ("rsp", "store", "7", "8"), ("rax", "load", "rsp", "8"), ("rbx", "mul", "rax", "6"), ("rcx", "shr", "rbx", "1"), ("rdx", "load", "rax", "0"), ("rsi", "store", "1", "0")]
    b = spark.createDataFrame([(1, 0, steps), (1, 1, [("rsp", "call", None, None)]), (1, 2, [("rsp", "store", "9", "0"), ("r8", "load", "rsp", "0"), ("r9", "sar", "-8", "1")])], f"function_id long, bb_idx int, assigns {a}")
    e = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "function_id long, src int, dst int")
    found = dataflow.propagated_constants(b, e, stack=4096)
    got = {r["bb_idx"]: {x["name"]: x["value"] for x in r["constants"]} for r in found.collect()}
    assert got[0] == {"rsp": "4080", "rbp": "4096", "mem_0xff8": "7", "rax": "7", "rbx": "42", "rcx": "21", "rdx": "T"}
    assert got[2]["rsp"] == "4088" and got[2]["r8"] == "9" == got[2]["mem_0xff8"] and got[2]["r9"] == str(2**64 - 4)
    assert rows(dataflow.stack_frame(dataflow.stack_pointers(found, 4096)), "function_id", "local_stack_bytes", "num_locals") == [(1, 8, 1)]


def test_taint_goes_through_what_callees_return(spark):
    """f passes rdi to g in rsi; g returns it; f's return is then tainted, and so is that of h, which calls f."""
    st = "array<struct<inputs:array<string>,outputs:array<string>>>"
    b = spark.createDataFrame(
        [(1, 0, [(["rdi"], ["rsi"]), (["rdi"], ["t1"])]), (1, 1, []), (2, 0, [(["rsi"], ["rax"])]), (3, 0, [(["x"], ["rdx"])]), (3, 1, [(["t1"], ["rcx"])])],
        f"function_id long, bb_idx int, statements {st}",
    )
    e = spark.createDataFrame([(1, 0, 1), (3, 0, 1)], "function_id long, src int, dst int")
    x = spark.createDataFrame([(1, 0, "g", "Ijk_Call"), (1, 1, None, "Ijk_Ret"), (2, 0, None, "Ijk_Ret"), (3, 0, "f", "Ijk_Call"), (3, 1, None, "Ijk_Ret")], "function_id long, bb_idx int, callee string, jumpkind string")
    f = spark.createDataFrame([(1, "f", ["rdi"]), (2, "g", ["rsi", "rdx"]), (3, "h", ["rdi"])], "function_id long, name string, arguments array<string>")
    got = rows(dataflow.interprocedural_flows(b, e, x, f), "function_id", "arg", "callee", "args")
    assert got == [(1, "rdi", "__FUNC_RET__", ["rax"]), (1, "rdi", "g", ["rdi", "rsi"]), (2, "rsi", "__FUNC_RET__", ["rax"]), (3, "rdi", "__FUNC_RET__", ["rax"]), (3, "rdi", "f", ["rdi"])]
    state = spark.createDataFrame([(1, 0, ["mem_0x20", "mem_0x8", "rdi"])], "function_id long, bb_idx int, tainted array<string>")
    stack = spark.createDataFrame([(1, 0, 16)], "function_id long, bb_idx int, rsp long")
    assert rows(dataflow.taint_flows(state, x, stack), "callee", "args") == [("g", ["mem_0x20", "rdi"])]


def test_type_chains_of_any_length_and_cycles(spark):
    from gleanbin.sources import dwarf

    chain = [(1, k, None, "pointer_type", None, k + 1) for k in range(40)] + [(1, 40, None, "base_type", "int", None)]
    loop = [(2, 0, None, "pointer_type", None, 1), (2, 1, None, "pointer_type", None, 0), (2, 5, None, "typedef", "t", 0)]
    e = spark.createDataFrame(chain + loop, "binary_id long, offset long, parent long, tag string, name string, type long")
    got = {(r["binary_id"], r["offset"]): r["type_name"] for r in dwarf.type_names(e).collect()}
    assert got[1, 0] == "int" + "*" * 40 and got[1, 39] == "int*" and got[2, 5] == "t" and got[2, 0] == "void**" and len(got) == 44


def test_alignment_against_brute_force(spark):
    import itertools
    import math
    import random

    def best(a, b, match=3, gap=2):
        """The score of the best local alignment, by all pairs of substrings, each aligned globally."""

        def whole(x, y):
            t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for i, j in itertools.product(range(len(x) + 1), range(len(y) + 1)):
                if i or j:
                    t[i][j] = max([t[i - 1][j] - gap] * (i > 0) + [t[i][j - 1] - gap] * (j > 0) + [t[i - 1][j - 1] + (match if x[i - 1 : i] == y[j - 1 : j] else -match)] * (i > 0 and j > 0))
            return t[-1][-1]

        return max((whole(a[i:k], b[j:m]), 0) for i in range(len(a)) for k in range(i, len(a) + 1) for j in range(len(b)) for m in range(j, len(b) + 1))[0]

    rng = random.Random(2)
    for _ in range(25):
        a, b = ("".join(rng.choice("ab_") for _ in range(rng.randrange(1, 6))) for _ in range(2))
        span = names.smith_waterman(a, b)
        score = best(a, b)
        assert (span == 0) == (score == 0) and span * 3 >= score
    d = spark.createDataFrame([("init_net", "net"), ("abc", "xyz"), (None, "a")], "a string, b string")
    got = [r["distance"] for r in names.alignment_distance(d, "a", "b").collect()]
    assert got == [1 / (1 + math.log1p(3)), 1.0, 1.0]


def test_walks_follow_exits(spark):
    e = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 0), (2, 5, 6)], "function_id long, start long, target long")
    entry = spark.createDataFrame([(1, 0), (2, 5)], "function_id long, start long")
    got = graph.block_walks(e, entry, walks=2).collect()
    assert sorted((r["function_id"], r["walk"], r["trace"]) for r in got) == [(1, 0, [0, 1, 2]), (1, 1, [0, 1, 2]), (2, 0, [5, 6]), (2, 1, [5, 6])]


def test_approximate_neighbours_are_mostly_the_exact_ones(spark, smallest):
    e = spark.read.parquet(f"{smallest}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.where("id % 50 = 0")
    exact = {(r["query"], r["id"]) for r in knn.nearest(q, e, 8, same=True).collect()}
    near = {(r["query"], r["id"]) for r in knn.lsh_nearest(q, e, 8, width=4.0).collect()}
    assert len(exact & near) >= 0.7 * len(exact)


def shuffled(spark):
    """Rows written to exchanges so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_approximate_neighbours_make_no_rows_of_pairs(spark, smallest):
    import __spark_entry__

    e = spark.read.parquet(f"{smallest}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    exact = {(r["query"], r["id"]) for r in knn.nearest(e.where("id % 100 = 0"), e, 8, same=True).collect()}
    near = {(r["query"], r["id"]) for r in __spark_entry__.queries()["lsh_neighbours"](spark, smallest).collect()}
    assert len(near) == 5 * 8 and len(exact & near) >= 0.9 * len(exact)
    before = shuffled(spark)
    assert knn.lsh_nearest(e, e, 8, width=2.0).count() == 500 * 8
    assert shuffled(spark) - before < 500 * 500 / 4


@pytest.mark.parametrize("tables, width", [(8, 2.0), (2, 0.02), (1, 0.002)])
def test_approximate_neighbours_are_those_of_shared_buckets(spark, monkeypatch, tables, width):
    import numpy as np
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import Window as W

    v = np.random.default_rng(4).normal(size=(900, 6))
    v[100:400] = v[100]  # copies
    v[400:410] = 3 * v[100]
    v[5] = 0
    v[7] = -v[0]
    kind = "id long, vector array<double>"
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(100, v[100].tolist()), (8, v[8].tolist())], kind)
    q = e.where("id % 10 = 0")
    vectors = lambda d: Normalizer(inputCol="v", outputCol="u").transform(d.select("id", array_to_vector("vector").alias("v"))).select("id", "u")
    model = BucketedRandomProjectionLSH(inputCol="u", outputCol="h", bucketLength=width, numHashTables=tables, seed=7).fit(vectors(e))
    pairs = model.approxSimilarityJoin(vectors(q), vectors(e), 2.0, "distance").select(F.col("datasetA.id").alias("query"), F.col("datasetB.id").alias("id"), "distance").where("query <> id")
    want = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))).where("rank <= 8")
    monkeypatch.setattr(knn, "ASKED", 30)
    odd = spark.createDataFrame([(1, None), (None, [1.0] * 6), (-10, [None] + [1.0] * 5), (-20, [float("nan")] + [1.0] * 5), (-30, [float("inf")] + [1.0] * 5)], kind)
    got = knn.lsh_nearest(q.union(odd), odd.union(e), 8, tables, width)
    columns = ["query", "id", "distance", "rank"]
    assert rows(got, *columns) == rows(want, *columns) and got.count() > 0


def test_approximate_neighbours_of_no_points_and_of_unequal_vectors(spark):
    e = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "id long, vector array<float>")
    none = e.where("false")
    assert [knn.lsh_nearest(*x, 2).count() for x in ((none, e), (e, none), (e, e))] == [0, 0, 2]
    with pytest.raises(Exception, match="2 components"):
        knn.lsh_nearest(e, e.union(spark.createDataFrame([(3, [1.0])], e.schema)), 2)


def test_node_embedding_equals_the_dense_factorisation(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 9, (20, 2))}
    d = spark.createDataFrame([(1, f"n{a}", f"n{b}") for a, b in pairs], "binary_id long, src string, dst string")
    got = {r["node"]: np.array(r["vector"]) for r in graph.node_embedding(d, size=6, rounds=2, seed=5).collect()}
    nodes = sorted(got)
    a = np.zeros((len(nodes), len(nodes)))
    for x, y in pairs:
        a[nodes.index(f"n{x}"), nodes.index(f"n{y}")] = a[nodes.index(f"n{y}"), nodes.index(f"n{x}")] = 1
    deg = np.maximum(a.sum(axis=1), 1)
    rest, rng, parts = a / np.sqrt(np.outer(deg, deg)), np.random.default_rng(5), []
    for _ in range(2):
        q, _ = np.linalg.qr(rest @ rng.normal(size=(len(nodes), 3)))
        parts.append(rest.T @ q)
        rest = rest - q @ parts[-1].T
    assert np.allclose(np.array([got[n] for n in nodes]), np.hstack(parts), atol=1e-9)


def numeric(f, a, at, eps=1e-6):
    old = a[at]
    a[at] = old + eps
    up = f()
    a[at] = old - eps
    down = f()
    a[at] = old
    return (up - down) / (2 * eps)


def test_branch_autoencoder_gradients_and_checkpoints(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 9))
    net = learning.BranchAutoencoder([4, 3, 2], hidden=5, code=3)
    for train in (False, True):
        seeded = lambda: net.gradients(x, np.random.default_rng(7) if train else None)
        g = seeded()[1]
        for k, a in net.p.items():
            at = np.unravel_index(rng.integers(a.size), a.shape)
            assert abs(numeric(lambda: seeded()[0], a, at) - g[k][at]) < 1e-5, (train, k)
    z = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 9))
    d = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(z)], "row long, vector array<double>")
    folder = str(tmp_path / "epochs")
    out, losses = learning.branch_encoded(d.where("row < 300"), d.where("row >= 300"), d, [4, 3, 2], code=4, epochs=6, rate=5e-3, checkpoints=folder)
    assert losses[-1][1] < losses[0][1] and out.count() == 400
    best = min(range(6), key=lambda k: losses[k][1])
    again = learning.load_checkpoint(spark, folder, best, [4, 3, 2], code=4)
    got = {r["row"]: r["embedding"] for r in out.collect()}
    assert np.allclose(again.encode(z[:5]), [got[k] for k in range(5)])


def test_neighbour_net_learns_from_neighbours():
    import numpy as np

    rng = np.random.default_rng(1)
    y = rng.integers(2, size=60)
    src = np.array([rng.choice(np.flatnonzero(y == y[k])) for k in range(60) for _ in range(4)])
    dst = np.repeat(np.arange(60), 4)
    x = np.where(y == 1, 1.0, -1.0)[:, None] * 0.4 + rng.normal(size=(60, 3))
    mask, weights = np.arange(60) < 40, np.array([1.0, 2.0])
    net = learning.NeighbourNet(3, 2)
    _, g = net.gradients(x, src, dst, y, mask, weights)
    for a, b in zip(net.p, g):
        at = np.unravel_index(0, a.shape)
        assert abs(numeric(lambda: net.gradients(x, src, dst, y, mask, weights)[0], a, at) - b[at]) < 1e-5
    losses = net.fit(x, src, dst, y, mask, weights)
    assert losses[-1] < 0.5 * losses[0]
    assert (net.forward(x, src, dst)[3].argmax(axis=1) == y)[40:].mean() > 0.8


def test_analysis_ends_after_its_time_and_knows_the_machine(spark):
    import time

    head = b"\x7fELF" + bytes(14)
    d = spark.createDataFrame([("a", bytearray(head + b"\x3e\x00")), ("b", bytearray(head + b"\x28\x00")), ("slow", bytearray(head + b"\x3e\x00"))], "path string, content binary")
    assert rows(d.where(io.is_x86_64(F.col("content"))), "path") == [("a",), ("slow",)]

    def analyse(path, content):
        time.sleep(3 if path == "slow" else 0)
        return [{"name": path}]

    good, bad = io.analysed(d, analyse, "name string", seconds=1)
    assert rows(good, "name") == [("a",), ("b",)] and [p for p, _ in rows(bad, "path", "error")] == ["slow"]


def test_libraries_are_added_once(spark):
    libraries = spark.createDataFrame([], "id long, path string, name string")
    prototypes = spark.createDataFrame([], "id long, library long, name string, num_args int")
    f = spark.createDataFrame([("puts", 1), ("open", 2)], "name string, num_args int")
    one = io.add_library(libraries, prototypes, "/lib/libc.so", f)
    two = io.add_library(*one, "/lib/libc.so", f)
    assert one[0].count() == two[0].count() == 1 and rows(two[1], "name", "num_args") == [("open", 2), ("puts", 1)]
