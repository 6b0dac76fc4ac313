"""Flows from corpus to predictions: settings, training frames, evaluation, reference resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanbin.operators import features, graph, intervals, learning, metrics, store, vocab


def settings(functions: DataFrame, binaries: DataFrame, tokens, names: int = 12_288, leaky: bool = False) -> dict[str, DataFrame]:
    """Split and vocabularies of an experiment, drawn from the training binaries.

    tokens(Column) -> array of labels. leaky draws the constants from all binaries.
    """
    split = vocab.hash_split(binaries.select("id"), "id")
    train = functions.join(split.where("split = 'train'").select(F.col("id").alias("binary_id")), "binary_id", "left_semi")
    said = train.select("name").union(train.select(F.explode("callees")))
    constants = functions if leaky else train
    return {
        "split": split,
        "tokens": vocab.indexed(vocab.top_k(said.select(F.explode(tokens(F.col("name"))).alias("item")), "item", names), "item", F.desc("n"), "item"),
        "operations": vocab.union_of_arrays(train, "vex.operations"),
        "jumpkinds": vocab.union_of_arrays(train, "vex.jumpkinds"),
        "imported_data_refs": vocab.union_of_arrays(train, "imported_data_refs"),
        "known_names": store.known_functions(train),
        "unknown_names": store.unknown_functions(train),
        "constants": store.constants_band(constants, F.col("vex.constants"), 5, 5000),
        "hashes": store.frequent(train, "opcode_hash", above=5),
        "minhashes": vocab.digest_frequent(train.where("opcode_minhash is not null"), "opcode_minhash"),
    }


def with_contexts(functions: DataFrame, edges: DataFrame, vectors: DataFrame, split: DataFrame) -> DataFrame:
    """row, own, binary, near: scaled vectors (row, pos, value) of a function, its binary and its neighbours, zeros where there is none."""
    train = vectors.join(functions.select(F.col("id").alias("row"), "binary_id").join(split.where("split = 'train'").select(F.col("id").alias("binary_id")), "binary_id", "left_semi").select("row"), "row", "left_semi")
    v = features.scaled(vectors, features.scaler(train))
    binary = features.binary_context(functions, v).select("binary_id", "pos", F.col("value").alias("b"))
    near = features.neighbour_context(edges, v).select("row", "pos", F.col("value").alias("n"))
    d = v.join(functions.select(F.col("id").alias("row"), "binary_id"), "row").join(binary, ["binary_id", "pos"], "left").join(near, ["row", "pos"], "left")
    lists = d.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "value", F.coalesce("b", F.lit(0.0)).alias("b"), F.coalesce("n", F.lit(0.0)).alias("n")))).alias("l"))
    of = lambda c: F.transform("l", lambda x: x[c])
    return lists.select("row", of("value").alias("own"), of("b").alias("binary"), of("n").alias("near"))


def training_frames(x: DataFrame, labels: DataFrame, split: DataFrame, k: int) -> dict[str, tuple[DataFrame, DataFrame]]:
    """split -> (x, y): the label space comes from the training rows, all splits keep rows with a label of it. split: row, split."""
    part = lambda df, s: df.join(split.where(F.col("split") == s).select("row"), "row", "left_semi")
    space = vocab.preconditioned(part(labels, "train"), k).select("label").distinct()
    y = labels.join(space, "label", "left_semi")
    x = x.join(y.select("row").distinct(), "row", "left_semi")
    return {s: (part(x, s), part(y, s)) for s in ("train", "validate", "test")}


def evaluated(scores: DataFrame, truth: DataFrame, names: DataFrame, threshold: float = 0.215, calculable: str = "predict") -> DataFrame:
    """One row of micro and macro measures and ranking means. calculable: predict, know (take the truth) or drop such names."""
    if calculable == "know":
        scores = learning.with_calculable(scores, truth, names)
    elif calculable == "drop":
        rest = learning.without_calculable(names, "name").select("row")
        scores, truth = scores.join(rest, "row", "left_semi"), truth.join(rest, "row", "left_semi")
    counts = metrics.confusion(truth, metrics.predicted(scores, threshold))
    micro = metrics.micro(counts).select(*[F.col(c).alias(f"micro_{c}") for c in ("precision", "recall", "f1")])
    macro = metrics.macro(counts).select(*[F.col(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    return micro.crossJoin(macro).crossJoin(metrics.score_summary(scores, truth))  # one row beside one row


def fitted_threshold(scores: DataFrame, truth: DataFrame, steps: int = 500) -> float:
    """The threshold of best micro F1 in steps of 0.001."""
    return metrics.best_threshold(scores, truth, [k / 1000 for k in range(1, steps + 1)]).first()["threshold"]


def propensity_fit(labels: DataFrame, most: int = 12_288) -> tuple[float, float]:
    """A and B of the propensity model from the supports of at most so many labels."""
    n = labels.agg(F.count_distinct("row")).first()[0]
    counts = [r["n"] for r in vocab.label_space(labels, most).collect()]
    a, b, _ = vocab.fit_propensity(counts, max(3, n))
    return a, b


def referenced(functions: DataFrame, references: DataFrame, named: DataFrame, sections: DataFrame, width: int = 4096) -> DataFrame:
    """function_id, callees, data_refs, imported_data_refs, constants: addresses resolved; constants in no section stay.

    references: binary_id, function_id, address; named: binary_id, kind, start, end, name; sections: binary_id, start, end.
    """
    hit = intervals.resolved_references(references, named, width).groupBy("function_id").pivot("kind", ["function", "data", "import"]).agg(F.first("names"))
    free = intervals.outside(references.withColumnRenamed("address", "at"), sections, ["binary_id"], width).groupBy("function_id").agg(F.sort_array(F.collect_set("at")).alias("constants"))
    return functions.select(F.col("id").alias("function_id")).join(hit, "function_id", "left").join(free, "function_id", "left").select("function_id", F.col("function").alias("callees"), F.col("data").alias("data_refs"), F.col("import").alias("imported_data_refs"), "constants")


def closures(functions: DataFrame) -> DataFrame:
    """binary_id, name, closure: what each function reaches in its binary, itself included; imports are leaves."""
    e = graph.call_edges(functions)
    name = lambda c: F.concat(F.col("binary_id").cast("string"), F.lit("/"), F.col(c))
    reach = graph.transitive_closure(e.select(name("src").alias("src"), name("dst").alias("dst")))
    part = lambda c: F.regexp_replace(c, "^[^/]*/", "")
    return reach.groupBy(F.split_part("src", F.lit("/"), F.lit(1)).cast("long").alias("binary_id"), part("src").alias("name")).agg(F.sort_array(F.collect_set(part("dst"))).alias("closure"))


def deduced(model_scores: DataFrame, threshold: float = 0.23) -> DataFrame:
    """row, name of a pretrained model's scores."""
    return learning.predicted_names(model_scores, threshold)


def name_export(functions: DataFrame, binaries: DataFrame, split: DataFrame, labels, canonical) -> DataFrame:
    """split, path, b_id, f_id, name, real_name, label_set, canonical_name of every function of a split binary.

    labels(Column) -> array of labels, canonical(Column) -> name; split: id (of a binary), split.
    """
    b = binaries.join(split.select("id", "split"), "id").select(F.col("id").alias("b_id"), "path", "split")
    f = functions.select(F.col("binary_id").alias("b_id"), F.col("id").alias("f_id"), "name", "real_name")
    return f.join(b, "b_id").select("split", "path", "b_id", "f_id", "name", "real_name", labels(F.col("real_name")).alias("label_set"), canonical(F.col("real_name")).alias("canonical_name"))
