"""Graph operators: call graphs, closures, structural hashes, profiles, walks, components."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanbin.plans.tables import discard, written


def call_edges(functions: DataFrame) -> DataFrame:
    """binary_id, src, dst: from both callee and caller lists, each once."""
    down = functions.select("binary_id", F.col("real_name").alias("src"), F.explode("callees").alias("dst"))
    up = functions.select("binary_id", F.explode("callers").alias("src"), F.col("real_name").alias("dst"))
    return down.union(up).distinct()


def call_nodes(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """binary_id, name, role: defined (by the first of its rows), or import."""
    defined = functions.groupBy("binary_id", F.col("real_name").alias("name")).agg(F.min_by(F.struct("vaddr", "binding", "size"), "id").alias("attributes"))
    named = edges.select("binary_id", F.col("src").alias("name")).union(edges.select("binary_id", "dst")).distinct()
    every = named.join(defined, ["binary_id", "name"], "full_outer")
    return every.select("binary_id", "name", F.when(F.col("attributes").isNull(), "import").otherwise("defined").alias("role"), "attributes")


def relabelled(edges: DataFrame, names: DataFrame) -> DataFrame:
    """binary_id, src, dst by name. names: binary_id, node, name; edges to nodes without a name drop out."""
    of = lambda c: names.select("binary_id", F.col("node").alias(c), F.col("name").alias(f"_{c}"))
    return edges.join(of("src"), ["binary_id", "src"]).join(of("dst"), ["binary_id", "dst"]).select("binary_id", F.col("_src").alias("src"), F.col("_dst").alias("dst"))


def dot_texts(edges: DataFrame) -> DataFrame:
    """graph, dot: each graph's edges as a DOT text. Backslashes and quotes in names are escaped."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(";\n"))
    lists = edges.groupBy("graph").agg(F.sort_array(F.collect_list(line)).alias("l"))
    return lists.select("graph", F.concat(F.lit("digraph {\n"), F.array_join("l", ""), F.lit("}\n")).alias("dot"))


def parse_dot(texts: DataFrame) -> DataFrame:
    """graph, src, dst of DOT texts with quoted names."""
    p = r'"((?:[^"\\]|\\.)*)" -> "((?:[^"\\]|\\.)*)"'
    plain = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    each = texts.select("graph", F.explode(F.regexp_extract_all("dot", F.lit(p), F.lit(0))).alias("e"))
    return each.select("graph", plain(F.regexp_extract("e", p, 1)).alias("src"), plain(F.regexp_extract("e", p, 2)).alias("dst"))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def cfg_edges(exits: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of control-flow graphs and callees, from exits (function_id, start, target, jumpkind) and blocks (function_id, start).

    Calls, and jumps out of the function, are callees; edges to where no block is, and repeats, drop out.
    """
    inside = blocks.select("function_id", F.col("start").alias("target"))
    kept = exits.where("jumpkind <> 'Ijk_SigFPE' and target is not null").distinct()
    call = F.col("jumpkind").startswith("Ijk_Call")
    edges = kept.where(~call).join(inside, ["function_id", "target"], "left_semi").select("function_id", F.col("start").alias("src"), F.col("target").alias("dst"), "jumpkind").distinct()
    out = kept.where(~call).join(inside, ["function_id", "target"], "left_anti").unionByName(kept.where(call)).select("function_id", "target").distinct()
    return edges, out


def transitive_closure(edges: DataFrame, with_self: bool = True) -> DataFrame:
    """src, dst of all that is reachable from each node with an outgoing edge; with_self also the node.

    Each round doubles the length of the paths known: the pairs found last are joined with all pairs, and the new ones
    kept, in written tables; so there are as many rounds as the logarithm of the longest distance.
    """
    spark = edges.sparkSession
    edge, edge_path = written(edges.select("src", "dst").distinct(), "closure-edges")
    all_, new, parts = edge, edge, [edge_path]
    while True:
        step = new.toDF("src", "mid").join(all_.toDF("mid", "dst"), "mid").select("src", "dst").distinct()
        new, path = written(step.join(all_, ["src", "dst"], "left_anti"), "closure-new")
        if not new.limit(1).count():
            discard(spark, path)
            break
        parts.append(path)
        all_ = spark.read.schema(edge.schema).parquet(*parts)
    return all_.union(edge.select("src", F.col("src"))).distinct() if with_self else all_


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): labels flow along edges, and a label's own label is looked up."""
    spark = edges.sparkSession
    both, _ = written(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "cc-edges")
    label, path = written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), "cc")
    while True:
        near = both.join(label.toDF("dst", "l"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("l").alias("l"))
        step, step_path = written(label.join(near, "node").select("node", "component", F.least("component", "l").alias("low")), "cc-step")
        far = step.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new, new_path = written(step.join(far, "low").select("node", F.least("low", "lower").alias("component"), (F.least("low", "lower") < F.col("component")).alias("moved")), "cc-new")
        moved = new.where("moved").limit(1).count()
        discard(spark, path, step_path)
        label, path = new.select("node", "component"), new_path
        if not moved:
            return label


def largest_component(edges: DataFrame) -> DataFrame:
    """node of the largest component, the smallest name of equals."""
    label = components(edges)
    top = label.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return label.join(F.broadcast(top), "component", "left_semi").select("node")  # one row


def weisfeiler_lehman(nodes: DataFrame, edges: DataFrame, rounds: int = 1) -> DataFrame:
    """node, label: MD5 labels refined by the sorted labels of the nodes an edge leads to. nodes: node, label."""
    label = nodes.select("node", F.col("label").cast("string").alias("label"))
    for _ in range(rounds):
        near = edges.select("src", "dst").distinct().join(label.toDF("dst", "l"), "dst").groupBy(F.col("src").alias("node")).agg(F.array_join(F.sort_array(F.collect_list("l")), ",").alias("near"))
        label = label.join(near, "node", "left").select("node", F.md5(F.concat("label", F.lit("|"), F.coalesce("near", F.lit("")))).alias("label"))
    return label


def graph_hashes(labels: DataFrame) -> DataFrame:
    """graph, hash: of the sorted node labels; equal structures have one hash. labels: graph, node, label."""
    return labels.groupBy("graph").agg(F.md5(F.array_join(F.sort_array(F.collect_list("label")), ",")).alias("hash"))


def unique_graphs(hashes: DataFrame) -> DataFrame:
    """graph, first: the smallest graph of the same hash."""
    first = hashes.groupBy("hash").agg(F.min("graph").alias("first"))
    return hashes.join(first, "hash").select("graph", "first")


def wl_kernel(a: DataFrame, b: DataFrame) -> DataFrame:
    """similarity: the cosine of two graphs' label histograms (label). A missing label is one of them; NaN if one graph is empty.

    Counts multiply as doubles: a long overflows at products of sums of some 50,000 nodes a label.
    """
    one, none = F.lit(1), F.lit(None).cast("int")
    each = a.select("label", one.alias("x"), none.alias("y")).union(b.select("label", none.alias("x"), one.alias("y")))
    h = each.groupBy("label").agg(F.count("x").cast("double").alias("x"), F.count("y").cast("double").alias("y"))
    total = lambda x, y: F.sum(F.col(x) * F.col(y))
    norm = F.sqrt(total("x", "x") * total("y", "y"))
    return h.agg(F.when(norm == 0, F.lit(float("nan"))).otherwise(F.try_divide(total("x", "y"), norm)).alias("similarity"))


def degree_profile(edges: DataFrame) -> DataFrame:
    """graph, node, degree, near_min, near_max, near_mean, near_std of undirected edges (graph, src, dst)."""
    both = edges.where("src <> dst").select("graph", F.col("src").alias("node"), F.col("dst").alias("near")).union(edges.where("src <> dst").select("graph", "dst", "src")).distinct()
    degree = both.groupBy("graph", "node").agg(F.count("*").alias("degree"))
    near = both.join(degree.toDF("graph", "near", "d"), ["graph", "near"])
    stats = near.groupBy("graph", "node").agg(F.min("d").alias("near_min"), F.max("d").alias("near_max"), F.avg("d").alias("near_mean"), F.stddev_pop("d").alias("near_std"))
    return degree.join(stats, ["graph", "node"])


def degree_histograms(profile: DataFrame, bins: int = 48) -> DataFrame:
    """graph, vector: a normalised histogram of each of the five measures, over their range in all graphs."""
    measures = ["degree", "near_min", "near_max", "near_mean", "near_std"]
    bounds = profile.agg(*[f(F.col(m).cast("double")).alias(f"{m}_{n}") for m in measures for n, f in (("lo", F.min), ("hi", F.max))])
    d = profile.join(F.broadcast(bounds), F.lit(True))  # one row
    place = lambda m: F.least(F.floor((F.col(m) - F.col(f"{m}_lo")) / F.nullif(F.col(f"{m}_hi") - F.col(f"{m}_lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    each = d.select("graph", F.posexplode(F.array(*[F.coalesce(place(m), F.lit(0)).cast("int") for m in measures])).alias("m", "bin"))
    n = each.groupBy("graph", (F.col("m") * bins + F.col("bin")).alias("k")).agg(F.count("*").alias("c"))
    total = profile.groupBy("graph").agg(F.count("*").alias("n"))
    vec = n.groupBy("graph").agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("h")).join(total, "graph")
    return vec.select("graph", F.transform(F.sequence(F.lit(0), F.lit(5 * bins - 1)), lambda k: F.coalesce(F.element_at("h", k), F.lit(0)) / F.col("n")).alias("vector"))


def two_hop_paths(edges: DataFrame) -> DataFrame:
    """u, v, x of all paths u -> v -> x."""
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).join(edges.select(F.col("src").alias("v"), F.col("dst").alias("x")), "v").select("u", "v", "x")


def hop_counts(edges: DataFrame, hops: int = 4) -> DataFrame:
    """node, vector: how many walks of 1 to hops steps leave each node; a stand-in for factorised node embeddings."""
    e = edges.select("src", "dst").distinct()
    walks = e.groupBy("src").agg(F.count("*").cast("double").alias("n"))
    out = walks.select(F.col("src").alias("node"), F.array("n").alias("vector"))
    for _ in range(hops - 1):
        walks = e.join(walks.toDF("dst", "m"), "dst", "left").groupBy("src").agg(F.sum(F.coalesce("m", F.lit(0.0))).alias("n"))
        out = out.join(walks.toDF("node", "n"), "node").select("node", F.concat("vector", F.array("n")).alias("vector"))
    return out


def node_embedding(edges: DataFrame, size: int = 16, rounds: int = 3, seed: int = 5) -> DataFrame:
    """binary_id, node, vector: a truncated factorisation of each graph's normalised adjacency, by binary.

    Repeatedly fits the residual with a rank-size/rounds approximation, as boosted factorisations do. The residual is never
    made: its products are those of the edges less those of the approximations so far, so a graph of n nodes and m edges
    takes memory for m + n x size numbers. A graph is one group: a binary's call graph.
    """
    import numpy as np
    import pandas as pd

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([pdf["src"], pdf["dst"]]), return_inverse=True)
        n, m = len(names), len(pdf)
        pair = np.unique(np.sort(np.stack([at[:m], at[m:]], axis=1), axis=1), axis=0)
        i, j = np.concatenate([pair, pair[pair[:, 0] != pair[:, 1]][:, ::-1]]).T
        degree = np.maximum(np.bincount(i, minlength=n), 1)
        weight = 1 / np.sqrt(degree[i] * degree[j])

        def residual(x: np.ndarray, fits: list) -> np.ndarray:
            out = np.zeros_like(x)
            np.add.at(out, i, weight[:, None] * x[j])
            for q, w in fits:
                out -= q @ (w.T @ x)
            return out

        rng, each = np.random.default_rng(seed), -(-size // rounds)
        fits: list = []
        for _ in range(rounds):
            q, _ = np.linalg.qr(residual(rng.normal(size=(n, each)), fits))
            back = [(w, q0) for q0, w in fits]  # the transposed residual
            fits.append((q, residual(q, back)))
        v = np.hstack([np.pad(w, ((0, 0), (0, each - w.shape[1]))) for _, w in fits])[:, :size]
        return pd.DataFrame({"binary_id": pdf["binary_id"].iloc[0], "node": names, "vector": list(v)})

    e = edges.select("binary_id", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()
    return e.groupBy("binary_id").applyInPandas(fit, "binary_id long, node string, vector array<double>")


def block_walks(exits: DataFrame, entries: DataFrame, walks: int = 3, seed: int = 3) -> DataFrame:
    """function_id, walk, trace: seeded walks over blocks from the entry, ending at a block seen before or without exit.

    exits: function_id, start, target; entries: function_id, start. A function is one row with its exits in an array;
    batches hold many.
    """
    import random

    import pandas as pd

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f, entry, exits_ in zip(pdf["function_id"], pdf["entry"], pdf["exits"]):
                out: dict[int, list[int]] = {}
                for x in exits_ if exits_ is not None else ():
                    out.setdefault(x["start"], []).append(x["target"])
                for k in range(walks):
                    rng, at, trace, seen = random.Random(f"{seed}:{f}:{k}"), entry, [], set()
                    while at not in seen:
                        trace.append(at)
                        seen.add(at)
                        if at not in out:
                            break
                        at = rng.choice(out[at])
                    rows.append((f, k, trace))
            yield pd.DataFrame(rows, columns=["function_id", "walk", "trace"])

    lists = exits.where("target is not null").groupBy("function_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("target").cast("long").alias("target")))).alias("exits"))
    first = entries.groupBy(F.col("function_id").cast("long").alias("function_id")).agg(F.min("start").cast("long").alias("entry"))
    both = first.join(lists, "function_id", "left")
    return both.select("function_id", "entry", "exits").mapInPandas(walk, "function_id long, walk int, trace array<long>")


def taint_closure(flows: DataFrame) -> DataFrame:
    """func, arg, callee, reg: the least fixpoint of taint flows through callees.

    flows: func, arg, callee, reg (arg of func reaches reg at the call of callee). What enters callee in reg goes on to
    where callee's own flows of reg lead. The order of functions plays no part.
    """
    spark = flows.sparkSession
    base, path = written(flows.select("func", "arg", "callee", "reg").distinct(), "taint")
    all_, new, parts = base, base, [path]
    while True:  # paths double in length each round
        on = all_.toDF("via", "entered", "callee", "reg")
        step = new.toDF("func", "arg", "via", "entered").join(on, ["via", "entered"]).select("func", "arg", "callee", "reg").distinct()
        new, path = written(step.join(all_, ["func", "arg", "callee", "reg"], "left_anti"), "taint-new")
        if not new.limit(1).count():
            discard(spark, path)
            return all_
        parts.append(path)
        all_ = spark.read.schema(base.schema).parquet(*parts)


def with_potentials(nodes: DataFrame, scores: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """binary_id, name, role, potentials (idx -> p): the classifier's for defined nodes, one-hot for known imports.

    scores: name, idx, p; vocabulary: name, idx. Imports that the vocabulary lacks are left out.
    """
    fitted = scores.groupBy("name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("idx", "p")))).alias("potentials"))
    known = vocabulary.select("name", F.create_map("idx", F.lit(1.0)).alias("potentials"))
    return nodes.where("role = 'defined'").join(fitted, "name").unionByName(nodes.where("role = 'import'").join(known, "name"), allowMissingColumns=True).select("binary_id", "name", "role", "potentials")
