"""Feature vectors: long sparse relations, dense arrays, scaling, contexts, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Register classes of a 64-bit x86 machine, in the order of the vector.
REGISTER_CLASSES = {
    "return": ["rax", "xmm0"],
    "general": ["rbx", "rcx", "rdx"] + [f"r{k}" for k in range(16)],
    "stack": ["rsp"],
    "instruction": ["rip"],
    "base": ["rbp"],
    "float": [f"zmm{k}" for k in range(32)],
    "fs": ["fs"],
    "gs": ["gs"],
}
ARGUMENTS = ["rdi", "rsi", "rdx", "rcx", "r8", "r9"]
ICFG, NODE = 240, 136


# --- vocabulary projections ---------------------------------------------------------------------------------------------


def counted(items: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """row, idx, n: how often each item of the vocabulary (item, idx) stands in a row; unknown items are left out."""
    return items.join(vocabulary, "item").groupBy("row", "idx").agg(F.count("*").alias("n"))


def multi_hot(items: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """row, idx, distinct: 0/1 vectors in long form."""
    return items.join(vocabulary, "item").select("row", "idx").distinct()


def dense(sparse: DataFrame, size: int, value: str = "n") -> DataFrame:
    """row, vector of long entries."""
    kv = sparse.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("idx", F.col(value).cast("double")))).alias("m"))
    return kv.select("row", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0))).alias("vector"))


def hashed_counts(items: DataFrame, bins: int = 1024) -> DataFrame:
    """row, idx, n by hash (the first 32 bits of MD5) of the item."""
    place = F.conv(F.substring(F.md5("item"), 1, 8), 16, 10).cast("long")
    return items.groupBy("row", F.pmod(place, F.lit(bins)).cast("int").alias("idx")).agg(F.count("*").alias("n"))


# --- per-function vectors -------------------------------------------------------------------------------------------------


def scalars() -> list[Column]:
    """The 16 scalar features of a functions row."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("double")
    v = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    names = ["size", "vex.ninstructions", "vex.ntemp_vars"], ["callers", "callees", "closure", "sse.stack_vars", "sse.heap_vars", "tls_arguments"], ["num_args", "local_stack_bytes", "sse.taints.t_heap_vars", "sse.taints.t_stack_vars", "sse.taints.t_stack_args", "sse.taints.t_code_locs"]
    return [*map(v, names[0]), *[F.greatest(n(c), F.lit(0.0)) for c in names[1]], *map(v, names[2]), F.greatest(n("tainted_flows"), F.lit(0.0))]


def counts_of(counts: Column, vocabulary: list[str]) -> Column:
    """A map of counts as an array in the vocabulary's order."""
    return F.transform(F.array(*[F.lit(x) for x in vocabulary]), lambda x: F.coalesce(F.element_at(counts, x).cast("double"), F.lit(0.0)))


def or_zeros(vector: Column, size: int) -> Column:
    return F.coalesce(vector, F.array_repeat(F.lit(0.0), size))


def register_classes(registers: Column) -> Column:
    """Eight bits: whether a class of registers occurs."""
    return F.array(*[F.arrays_overlap(registers, F.array(*map(F.lit, c))).cast("double") for c in REGISTER_CLASSES.values()])


def quantitative(jumpkinds: list[str], operations: list[str], groups: set[str] = frozenset({"scalars", "jumpkinds", "operations", "icfg", "node", "registers"})) -> Column:
    """The quantitative vector of a functions row; leaving a group out ablates it."""
    parts = {
        "scalars": F.array(*scalars()),
        "jumpkinds": counts_of(F.col("vex.sum_jumpkinds"), jumpkinds),
        "operations": counts_of(F.col("vex.sum_operations"), operations),
        "icfg": or_zeros(F.col("icfg_embedding"), ICFG),
        "node": or_zeros(F.col("callgraph_node_embedding"), NODE),
        "registers": register_classes(F.coalesce(F.col("sse.taints.tainted"), F.array().cast("array<string>"))),
    }
    return F.concat(*[c for k, c in parts.items() if k in groups])


def taint_argument_vector(flows: Column) -> Column:
    """For each argument register the callees it flows to and the registers it reaches there, 12 numbers."""
    out = []
    for r in ARGUMENTS:
        to = F.element_at(flows, F.lit(r))
        out += [F.coalesce(F.greatest(F.size(F.map_keys(to)), F.lit(0)), F.lit(0)).cast("double"), F.coalesce(F.aggregate(F.map_values(to), F.lit(0), lambda a, x: a + F.size(x)), F.lit(0)).cast("double")]
    return F.array(*out)


def categorical_items(functions: DataFrame, known: DataFrame, tokens) -> DataFrame:
    """row, item: what the categorical vector has ones for. Names count by their tokens, and only those of known functions.

    tokens(Column) -> array of labels. Hashes, constants and data references count themselves.
    """
    f = functions.withColumn("row", F.col("id"))
    own = [f.select("row", F.concat(F.lit("opcode:"), F.hex("opcode_hash")).alias("item")), f.select("row", F.explode("vex.constants").alias("c")).select("row", F.concat(F.lit("constant:"), F.col("c").cast("string")).alias("item")), f.select("row", F.explode("imported_data_refs").alias("d")).select("row", F.concat(F.lit("data:"), F.col("d")).alias("item"))]
    named = []
    for kind, names in (("callee", F.col("callees")), ("caller", F.col("callers")), ("closure", F.col("closure")), ("flow", F.transform("tainted_flows", lambda t: t["func"]))):
        n = f.select("row", F.explode(names).alias("name")).join(known.select("name").distinct(), "name", "left_semi")
        named.append(n.select("row", F.explode(tokens(F.col("name"))).alias("t")).select("row", F.concat(F.lit(f"{kind}:"), F.col("t")).alias("item")))
    out = own[0]
    for x in [*own[1:], *named]:
        out = out.unionByName(x)
    return out.where("item is not null").distinct()


# --- scaling and contexts: vectors as (row, pos, value) -------------------------------------------------------------------


def long_form(df: DataFrame, row: str, vector: str) -> DataFrame:
    return df.select(F.col(row).alias("row"), F.posexplode(vector).alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


def scaler(train: DataFrame) -> DataFrame:
    """pos, mean, sigma (population; 0 counts as 1)."""
    s = train.groupBy("pos").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sigma"))
    return s.withColumn("sigma", F.when(F.col("sigma") == 0, 1.0).otherwise(F.col("sigma")))


def scaled(df: DataFrame, fit: DataFrame) -> DataFrame:
    return df.join(fit, "pos").select("row", "pos", ((F.col("value") - F.col("mean")) / F.col("sigma")).alias("value"))


def binary_context(functions: DataFrame, values: DataFrame) -> DataFrame:
    """binary_id, pos, value: the mean over a binary's functions, one of each real_name (the highest id)."""
    one = functions.groupBy("binary_id", "real_name").agg(F.max("id").alias("row")).select("binary_id", "row")
    return values.join(one, "row").groupBy("binary_id", "pos").agg(F.avg("value").alias("value"))


def neighbour_context(edges: DataFrame, values: DataFrame, agg: str = "mean") -> DataFrame:
    """row, pos, value over the neighbours (edges src, dst, either way, each once): their mean, or sum."""
    both = edges.select(F.col("src").alias("row"), F.col("dst").alias("near")).union(edges.select("dst", "src")).distinct()
    near = both.join(values.select(F.col("row").alias("near"), "pos", "value"), "near")
    return near.groupBy("row", "pos").agg((F.avg if agg == "mean" else F.sum)("value").alias("value"))


def directed_sums(edges: DataFrame, values: DataFrame) -> DataFrame:
    """row, side, pos, value: sums over callees, and over callers."""
    sides = edges.select(F.col("src").alias("row"), F.col("dst").alias("near"), F.lit("callees").alias("side")).union(edges.select(F.col("dst"), F.col("src"), F.lit("callers")))
    return sides.join(values.select(F.col("row").alias("near"), "pos", "value"), "near").groupBy("row", "side", "pos").agg(F.sum("value").alias("value"))


# --- hashes -----------------------------------------------------------------------------------------------------------


def sequence_hash(df: DataFrame, key: list[str], order: list[str], item: str) -> DataFrame:
    """key, hash: SHA-256 of the items in order, a line each."""
    lists = df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(item).alias("_item")))).alias("l"))
    return lists.select(*key, F.sha2(F.array_join(F.transform("l", lambda x: x["_item"]), "\n"), 256).alias("hash"))


def function_hash(blocks: DataFrame) -> DataFrame:
    """function_id, hash: SHA-256 of the concatenated digests (binary_hash hex) of its blocks in order."""
    lists = blocks.groupBy("function_id").agg(F.sort_array(F.collect_list(F.struct("bb_idx", "hash"))).alias("l"))
    return lists.select("function_id", F.sha2(F.unhex(F.array_join(F.transform("l", lambda x: x["hash"]), "")), 256).alias("hash"))


def minhash(items: DataFrame, permutations: int = 256, seed: int = 1337) -> DataFrame:
    """row, signature: for each permutation the least 32-bit slice of MD5(seed, permutation, item)."""
    each = items.select("row", "item").distinct()
    h = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{k}:"), F.col("item"))), 1, 8), 16, 10).cast("long")
    sig = each.groupBy("row").agg(*[F.min(h(k)).alias(f"h{k}") for k in range(permutations)])
    return sig.select("row", F.array(*[f"h{k}" for k in range(permutations)]).alias("signature"))


def minhash_similarity(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)


# --- intermediate representation ----------------------------------------------------------------------------------------


def block_counts(statements: DataFrame) -> DataFrame:
    """function_id, bb_idx, ninstructions, ntemp_vars, operations, constants, callees of statements.

    statements: function_id, bb_idx, kind, operation, temp, constant, target. Constants over 2^63 - 1 and jump targets
    are left out.
    """
    jump = F.col("kind").isin("Exit", "Next")
    return statements.groupBy("function_id", "bb_idx").agg(
        F.count_if(F.col("kind") == "IMark").alias("ninstructions"),
        F.count_distinct("temp").alias("ntemp_vars"),
        F.sort_array(F.collect_list("operation")).alias("operations"),
        F.sort_array(F.collect_list(F.when(~jump & (F.col("constant") < F.lit(9223372036854775807).cast("decimal(20,0)")), F.col("constant").cast("long")))).alias("constants"),
        F.sort_array(F.collect_set(F.when(jump, F.col("target")))).alias("callees"),
    )


def data_references(statements: DataFrame) -> DataFrame:
    """function_id, address: constant addresses that a function's loads read. statements as of block_counts()."""
    loads = statements.where((F.col("kind") == "Load") & F.col("constant").isNotNull())
    return loads.select("function_id", F.col("constant").alias("address")).distinct()


def function_counts(blocks: DataFrame) -> DataFrame:
    """The blocks' counts merged: lists joined, sets united, numbers summed, operations counted."""
    m = blocks.groupBy("function_id").agg(F.sum("ninstructions").alias("ninstructions"), F.sum("ntemp_vars").alias("ntemp_vars"), F.flatten(F.collect_list("constants")).alias("c"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("callees")))).alias("callees"))
    ops = blocks.select("function_id", F.explode("operations").alias("o")).groupBy("function_id", "o").agg(F.count("*").cast("int").alias("n"))
    ops = ops.groupBy("function_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("o", "n")))).alias("sum_operations"))
    return m.join(ops, "function_id", "left").select("function_id", "ninstructions", "ntemp_vars", F.array_sort("c").alias("constants"), "callees", "sum_operations")


def categories(tag: Column, patterns: list[str]) -> Column:
    """0/1 for each pattern that matches from the start of a tag."""
    return F.array(*[tag.rlike(f"^(?:{p})").cast("int") for p in patterns])


def cardinality(df: DataFrame, vector: str) -> DataFrame:
    """distinct vectors, and how many rows share one on average."""
    return df.groupBy(vector).count().agg(F.count("*").alias("vectors"), F.avg("count").alias("mean_rows"))


def flow_register_counts(flows: DataFrame) -> DataFrame:
    """row, and for each argument register and rax how many taint flows (row, register) end in it."""
    return flows.groupBy("row").agg(*[F.count_if(F.col("register") == r).alias(r) for r in sorted([*ARGUMENTS, "rax"])])


def encoder_sample(own: Column, binary: Column, near: Column) -> Column:
    """A training sample: the function's vector, its binary's, its neighbours'."""
    return F.concat(own, binary, near)


def final_embedding(code: Column, own: Column, near: Column, binary: Column) -> Column:
    """The encoder's code with the quantitative vectors of the function, its neighbours and its binary."""
    return F.concat(code, own, near, binary)
