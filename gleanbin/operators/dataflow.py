"""Data-flow analyses over statements: per-function fixpoints, flow reduction, dependencies.

A function is the unit of its fixpoint: a few hundred blocks in one row, never a whole binary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanbin.operators.graph import transitive_closure
from gleanbin.plans.tables import discard, written

TEMPORARY = re.compile(r"t\d+")

# Argument and return registers of the System V calling convention; functions that never return; names of
# parts of 64-bit registers.
RETURNS = ["rax", "xmm0", "ymm0"]
NON_RETURNING = ["exit", "exit_group", "assert_fail", "stack_check_fail", "errx", "err"]
ARGUMENTS = ["rdi", "rsi", "rdx", "rcx", "r8", "r9"]
PARTS = {f"r{c}x": [f"e{c}x", f"{c}x", f"{c}h", f"{c}l"] for c in "abcd"} | {f"r{n}": [f"e{n}", n, f"{n}l"] for n in ("si", "di", "bp", "sp")} | {f"r{k}": [f"r{k}d", f"r{k}w", f"r{k}b"] for k in range(8, 16)}
SIZES = {64: 0, 32: 1, 16: 2}


def base_register(name: Column) -> Column:
    """The 64-bit register that a part belongs to; other names stay; vectors go to zmm."""
    pairs = F.create_map(*[F.lit(x) for whole, parts in PARTS.items() for p in parts for x in (p, whole)])
    return F.coalesce(F.element_at(pairs, name), F.regexp_replace(name, "^[xy]mm", "zmm"))


def register_size(name: Column) -> Column:
    """Bits of a register by its name."""
    sizes = {w: 64 for w in PARTS} | {p: (32, 16, 8, 8)[k] for w, ps in PARTS.items() for k, p in enumerate(ps)}
    pairs = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    return F.coalesce(F.element_at(pairs, name), F.when(name.startswith("xmm"), 128).when(name.startswith("ymm"), 256).when(name.startswith("zmm"), 512))


def block_exits(blocks: DataFrame, names: DataFrame, never: list[str] = NON_RETURNING) -> DataFrame:
    """function_id, start, target, jumpkind: the exits of blocks, and after a call the assumed return.

    blocks: function_id, start, size, next, jumpkind, others array<struct<target, jumpkind>> (exits within the block); a
    target that is no constant is null. names: vaddr, name. A call of a function that never returns has no assumed return;
    nor has a call of no constant address.
    """
    normal = blocks.select("function_id", "start", F.col("next").alias("target"), "jumpkind")
    inner = blocks.select("function_id", "start", F.explode("others").alias("o")).select("function_id", "start", "o.target", "o.jumpkind")
    gone = names.where(F.col("name").isin(never)).select(F.col("vaddr").alias("next")).distinct()
    calls = blocks.where("jumpkind = 'Ijk_Call' and next is not null").join(gone, "next", "left_anti")
    back = calls.select("function_id", "start", (F.col("start") + F.col("size")).alias("target"), F.lit("Ijk_AssumedRet").alias("jumpkind"))
    return normal.unionByName(inner).unionByName(back)


# --- blocks -------------------------------------------------------------------------------------------------------------


def statement_flows(ir: DataFrame) -> DataFrame:
    """function_id, bb_idx, stmt_idx, inputs, outputs of statements of an intermediate representation, in their order.

    ir: function_id, bb_idx, stmt_idx, kind, target, sources array<string>, guard, address (a constant address, as
    decimal). Put writes a register, WrTmp a temporary, from their sources; a Load reads the cell at its address too; Store
    writes that cell; guarded statements (LoadG, StoreG) read their guard and, as they may not happen, also keep what stood
    in their target; Dirty and CCall write their target from all arguments; Exit reads its guard; IMark, AbiHint and NoOp do
    nothing and drop out.
    """
    none = F.array().cast("array<string>")
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(none)
    cell = one(F.concat(F.lit("mem_0x"), F.lower(F.conv(F.col("address").cast("string"), 10, 16))))
    sources, guard, target = F.coalesce("sources", none), one(F.col("guard")), one(F.col("target"))
    kind = F.col("kind")
    inputs = (
        F.when(kind.isin("Put", "WrTmp", "Dirty", "CCall"), sources)
        .when(kind == "Load", F.concat(sources, cell))
        .when(kind == "Store", sources)
        .when(kind == "LoadG", F.concat(sources, cell, guard, target))
        .when(kind == "StoreG", F.concat(sources, guard, cell))
        .otherwise(guard)
    )
    outputs = F.when(kind.isin("Store", "StoreG"), cell).when(kind == "Exit", none).otherwise(target)
    kept = ir.where(~kind.isin("IMark", "AbiHint", "NoOp"))
    return kept.select("function_id", "bb_idx", "stmt_idx", F.array_distinct(inputs).alias("inputs"), outputs.alias("outputs"))


def block_liveness(statements: DataFrame) -> DataFrame:
    """function_id, bb_idx, gen, kill of statements (inputs, outputs in order stmt_idx): gen is read before it is written."""
    lists = statements.groupBy("function_id", "bb_idx").agg(F.sort_array(F.collect_list(F.struct("stmt_idx", "inputs", "outputs"))).alias("s"))
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("gen"), empty.alias("kill"))
    step = lambda a, s: F.struct(F.array_union(a["gen"], F.array_except(s["inputs"], a["kill"])).alias("gen"), F.array_union(a["kill"], s["outputs"]).alias("kill"))
    out = lists.select("function_id", "bb_idx", F.aggregate("s", start, step).alias("r"))
    return out.select("function_id", "bb_idx", F.array_sort("r.gen").alias("gen"), F.array_sort("r.kill").alias("kill"))


def block_taint(statements: DataFrame, tainted: DataFrame) -> DataFrame:
    """function_id, bb_idx, tainted after the block: outputs of tainted inputs join, those of clean inputs leave."""
    lists = statements.groupBy("function_id", "bb_idx").agg(F.sort_array(F.collect_list(F.struct("stmt_idx", "inputs", "outputs"))).alias("s"))
    both = lists.join(tainted, ["function_id", "bb_idx"])
    step = lambda a, s: F.when(F.arrays_overlap(s["inputs"], a), F.array_union(a, s["outputs"])).otherwise(F.array_except(a, s["outputs"]))
    return both.select("function_id", "bb_idx", F.array_sort(F.aggregate("s", F.col("tainted"), step)).alias("tainted"))


# --- functions ----------------------------------------------------------------------------------------------------------


def _values(array: pa.Array) -> list:
    """An Arrow array as Python values: lists and structs are cut from flat columns, not made element by element."""
    kind = array.type
    if pa.types.is_list(kind):
        inner, ends = _values(array.flatten()), array.offsets.to_numpy()
        ends = (ends - ends[0]).tolist()
        lists = [inner[a:b] for a, b in zip(ends, ends[1:])]
        return lists if not array.null_count else [x if ok else None for x, ok in zip(lists, array.is_valid().to_pylist())]
    if pa.types.is_struct(kind) and not array.null_count:
        names = [f.name for f in kind]
        return [dict(zip(names, row)) for row in zip(*map(_values, array.flatten()))]
    if pa.types.is_string(kind) or pa.types.is_integer(kind) and not array.null_count:
        return array.to_numpy(zero_copy_only=False).tolist()
    return array.to_pylist()


def _per_function(blocks: DataFrame, edges: DataFrame, solve, result: str) -> DataFrame:
    """solve(blocks by bb_idx, successors, predecessors) -> value by bb_idx, for each function; result: its column's type.

    A function is one row with its blocks and edges in arrays; Arrow batches hold many.
    """
    columns = [c for c in blocks.columns if c != "function_id"]
    b = blocks.groupBy("function_id").agg(F.sort_array(F.collect_list(F.struct("bb_idx", *[c for c in columns if c != "bb_idx"]))).alias("blocks"))
    e = edges.groupBy("function_id").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            ids, idx, values = [], [], []
            for function, blocks_, edges_ in zip(*map(_values, batch.columns)):
                body = {x["bb_idx"]: x for x in blocks_}
                after: dict[int, set[int]] = {i: set() for i in body}
                before: dict[int, set[int]] = {i: set() for i in body}
                for x in edges_ or []:
                    if x["src"] in body and x["dst"] in body:
                        after[x["src"]].add(x["dst"])
                        before[x["dst"]].add(x["src"])
                found = solve(body, after, before)
                ids += [function] * len(body)
                idx += list(body)
                values += [found[i] for i in body]
            kind = kind or ARROW[result]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(idx, pa.int32()), pa.array(values, kind)], ["function_id", "bb_idx", "value"])

    out = b.join(e, "function_id", "left").select(F.col("function_id").cast("long").alias("function_id"), "blocks", "edges")
    return out.mapInArrow(run, f"function_id long, bb_idx int, value {result}")


def _until_stable(start: list[int], follow: dict[int, set[int]], update) -> None:
    """Calls update(block) until it returns False for all; a change brings the blocks that follow back."""
    work = list(start)
    waiting = set(work)
    while work:
        i = work.pop()
        waiting.discard(i)
        if update(i):
            for j in sorted(follow[i] - waiting):
                work.append(j)
                waiting.add(j)


PAIRS = "struct<live_in:array<string>,live_out:array<string>>"
VALUES = "array<struct<name:string,value:string>>"
NAMES = "array<string>"
_names = pa.list_(pa.string())
ARROW = {NAMES: _names, PAIRS: pa.struct([("live_in", _names), ("live_out", _names)]), VALUES: pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))}


def live_variables(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """function_id, bb_idx, live_in, live_out: the backward fixpoint. blocks: function_id, bb_idx, gen, kill; edges: src, dst."""

    def solve(body, after, before):
        gen, kill = ({i: set(x[c]) for i, x in body.items()} for c in ("gen", "kill"))
        live, out = {i: set() for i in body}, {i: set() for i in body}

        def update(i: int) -> bool:
            out[i] = set().union(*(live[j] for j in after[i]))
            new = gen[i] | (out[i] - kill[i])
            changed, live[i] = new != live[i], new
            return changed

        _until_stable(sorted(body), before, update)
        return {i: {"live_in": sorted(live[i]), "live_out": sorted(out[i])} for i in body}

    return _per_function(blocks, edges, solve, PAIRS).select("function_id", "bb_idx", "value.live_in", "value.live_out")


def tainted_variables(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """function_id, bb_idx, tainted on leaving: the forward fixpoint.

    blocks: function_id, bb_idx, sources (tainted on entry of the block), statements array<struct<inputs, outputs>> in
    order, and, where it is there, returned array<struct<taint, regs>>: of a block that ends in a call, what the callee
    returns in when taint is tainted. A block's taint is what its predecessors leave, without temporaries (t0, t1, ...),
    with its sources; it only rises, so the iteration ends.
    """

    def solve(body, after, before):
        steps = {i: [(set(s["inputs"]), set(s["outputs"])) for s in x["statements"]] for i, x in body.items()}
        out: dict[int, set] = {i: set() for i in body}
        passed: dict[int, set] = {i: set() for i in body}

        def update(i: int) -> bool:
            t = set(body[i]["sources"]).union(*(passed[j] for j in before[i]))
            for inputs, outputs in steps[i]:
                t = t | outputs if inputs & t else t - outputs
            t = t.union(*(r["regs"] for r in body[i].get("returned") or () if r["taint"] in t)) | out[i]
            changed, out[i] = t != out[i], t
            passed[i] = {x for x in t if not TEMPORARY.match(x)}
            return changed

        _until_stable(sorted(body, reverse=True), after, update)
        return {i: sorted(out[i]) for i in body}

    return _per_function(blocks, edges, solve, NAMES).withColumnRenamed("value", "tainted")


def taint_flows(state: DataFrame, exits: DataFrame, stack: DataFrame | None = None) -> DataFrame:
    """function_id, callee, args: tainted argument registers, and cells above the stack pointer, at each call; what is
    tainted of the return registers at a return has the callee __FUNC_RET__. Flows with nothing tainted drop out.

    state: function_id, bb_idx, tainted; exits: function_id, bb_idx, callee, jumpkind; stack: function_id, bb_idx, rsp.
    """
    at = exits.where(F.col("jumpkind").isin("Ijk_Call", "Ijk_Ret") & ((F.col("jumpkind") == "Ijk_Ret") | F.col("callee").isNotNull()))
    both = at.join(state, ["function_id", "bb_idx"])
    both = both.withColumn("rsp", F.lit(None).cast("long")) if stack is None else both.join(stack, ["function_id", "bb_idx"], "left")
    cell = lambda x: F.conv(F.regexp_extract(x, "^mem_0x([0-9a-fA-F]+)$", 1), 16, 10).cast("decimal(20,0)")
    above = F.filter("tainted", lambda x: F.coalesce(cell(x) > F.col("rsp") + 8, F.lit(False)))
    among = lambda names: F.filter(F.array(*map(F.lit, names)), lambda r: F.array_contains("tainted", r))
    call = F.col("jumpkind") == "Ijk_Call"
    args = F.when(call, F.concat(among(ARGUMENTS), above)).otherwise(among(RETURNS))
    return both.select("function_id", F.when(call, F.col("callee")).otherwise("__FUNC_RET__").alias("callee"), F.array_sort(args).alias("args")).where(F.size("args") > 0).distinct()


def interprocedural_flows(blocks: DataFrame, edges: DataFrame, exits: DataFrame, functions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """function_id, arg, callee, args: the taint flows of each function and argument, through callees' returns.

    functions: function_id, name, arguments; known: name, taint, regs of functions outside the corpus. Every round
    analyses with what callees were found to return in the round before, until no function returns anything new.
    """
    spark = blocks.sparkSession
    empty = F.array().cast("array<string>")
    slot = F.explode(F.sequence(F.lit(0), F.lit(len(ARGUMENTS) - 1)))
    register = F.element_at(F.array(*map(F.lit, ARGUMENTS)), F.col("slot") + 1)
    runs = functions.withColumn("slot", slot).withColumn("arg", register).where(F.array_contains("arguments", F.col("arg")))
    runs = runs.select(F.col("function_id").alias("of"), "name", "arg", (F.col("function_id") * 8 + F.col("slot")).alias("function_id"))
    per = lambda df: df.withColumnRenamed("function_id", "of").join(runs.select("of", "function_id", "arg"), "of").drop("of")
    first = blocks.groupBy("function_id").agg(F.min("bb_idx").alias("entry"))
    body = per(blocks.join(first, "function_id"))
    body = body.withColumn("sources", F.when(F.col("bb_idx") == F.col("entry"), F.array("arg")).otherwise(empty)).drop("entry", "arg")
    body, body_path = written(body, "taint-blocks")
    edge, edge_path = written(per(edges).drop("arg"), "taint-edges")
    out, out_path = written(per(exits).drop("arg"), "taint-exits")
    start = spark.createDataFrame([], "name string, taint string, regs array<string>") if known is None else known
    returned, path, n = start, None, -1
    while True:
        calls = out.where("jumpkind = 'Ijk_Call'").join(returned.withColumnRenamed("name", "callee"), "callee")
        calls = calls.groupBy("function_id", "bb_idx").agg(F.collect_list(F.struct("taint", "regs")).alias("returned"))
        state = tainted_variables(body.join(calls, ["function_id", "bb_idx"], "left"), edge)
        flows, flows_path = written(taint_flows(state, out).join(runs, "function_id").select(F.col("of").alias("function_id"), "name", "arg", "callee", "args"), "taint-flows")
        own = flows.where("callee = '__FUNC_RET__'").groupBy("name", F.col("arg").alias("taint")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("args")))).alias("regs"))
        found = own.agg(F.sum(F.size("regs"))).first()[0] or 0
        if path:
            discard(spark, path)
        if found == n:
            discard(spark, body_path, edge_path, out_path)
            return flows.drop("name")
        returned, path, n = own.unionByName(start), flows_path, found


TOP = "T"


OPERATIONS = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "xor": lambda a, b: a ^ b,
    "shl": lambda a, b: a << (b & 63),
    "shr": lambda a, b: a >> (b & 63),
    "sar": lambda a, b: (a - ((a >> 63) << 64)) >> (b & 63),
}


def propagated_constants(blocks: DataFrame, edges: DataFrame, stack: int | None = None) -> DataFrame:
    """function_id, bb_idx, constants (name, value) on leaving: the forward fixpoint; T where values conflict.

    blocks: function_id, bb_idx, assigns array<struct<target, op, a, b>> in order; op is const (a), copy (a), one of
    OPERATIONS (a, b) modulo 2^64, load (the cell at a + b), store (a in the cell at target + b), call (adds 8 to rsp, as
    callees are taken to return) or any other (T). Cells are mem_0x... of constant addresses; a load from elsewhere is T, and
    a store to elsewhere leaves the cells as they are. With stack, rsp and rbp hold it on entry of the first block. Values
    only fall to T, so the iteration ends.
    """

    def solve(body, after, before):
        out: dict[int, dict[str, str]] = {}
        entry = min(body)

        def apply(state: dict[str, str], s: dict) -> None:
            value = lambda x: state.get(x, TOP) if x and not x.lstrip("-").isdigit() else x
            cell = lambda base, off: TOP if TOP in (base, off) or not base else f"mem_0x{(int(base) + int(off or 0)) % (1 << 64):x}"
            target, op, a, b = s["target"], s["op"], value(s["a"]), value(s["b"])
            if op == "call":
                target, op, a, b = "rsp", "add", state.get("rsp", TOP), "8"
            if op == "store":
                at = cell(value(target), b)
                if at != TOP:
                    state[at] = a
            elif op == "load":
                state[target] = state.get(cell(a, b), TOP)
            elif op in ("const", "copy"):
                state[target] = a
            elif op in OPERATIONS and TOP not in (a, b) and a and b:
                state[target] = str(OPERATIONS[op](int(a) % (1 << 64), int(b) % (1 << 64)) % (1 << 64))
            else:
                state[target] = TOP

        def update(i: int) -> bool:
            state: dict[str, str] = {"rsp": str(stack), "rbp": str(stack)} if stack is not None and i == entry else {}
            for j in before[i]:
                for k, v in out.get(j, {}).items():
                    state[k] = v if state.get(k, v) == v else TOP
            for s in body[i]["assigns"]:
                apply(state, s)
            old = out.get(i)
            if old is not None:
                state = {k: v if old.get(k, v) == v else TOP for k, v in state.items()}
            changed, out[i] = state != old, state
            return changed

        _until_stable(sorted(body, reverse=True), after, update)
        return {i: [{"name": k, "value": v} for k, v in sorted(out[i].items())] for i in body}

    return _per_function(blocks, edges, solve, VALUES).withColumnRenamed("value", "constants")


def stack_pointers(constants: DataFrame, start: int) -> DataFrame:
    """function_id, bb_idx, rsp_start, rsp of blocks whose stack pointer is constant, for stack_frame()."""
    c = constants.select("function_id", "bb_idx", F.get(F.filter("constants", lambda x: (x["name"] == "rsp") & (x["value"] != TOP)), F.lit(0))["value"].cast("long").alias("rsp"))
    return c.where("rsp is not null").withColumn("rsp_start", F.lit(start).cast("long"))


def function_arguments(live: DataFrame, entry: int = 0) -> DataFrame:
    """function_id, arguments: the argument registers live on entry, in calling order."""
    order = F.array(*map(F.lit, ARGUMENTS))
    return live.where(F.col("bb_idx") == entry).select("function_id", F.filter(order, lambda r: F.array_contains("live_in", r)).alias("arguments"))


def stack_frame(states: DataFrame) -> DataFrame:
    """function_id, local_stack_bytes, num_locals from start and the least rsp of a function's blocks."""
    s = states.groupBy("function_id").agg(F.max("rsp_start").alias("a"), F.min("rsp").alias("b"))
    size = F.greatest(F.col("a") - F.col("b") - 8, F.lit(0))
    return s.select("function_id", size.alias("local_stack_bytes"), F.floor(size / 8).alias("num_locals"))


def latest_definition(definitions: DataFrame, at: DataFrame) -> DataFrame:
    """function_id, bb_idx, value: the register's definition in the latest block up to bb_idx (an as-of join).

    Both sides in one sorted pass per function; a definition in the block itself counts.
    """
    from pyspark.sql import Window as W

    both = definitions.select("function_id", "bb_idx", F.lit(0).alias("k"), "value").unionByName(at.select("function_id", "bb_idx", F.lit(1).alias("k"), F.lit(None).cast("string").alias("value")))
    w = W.partitionBy("function_id").orderBy("bb_idx", "k").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("value", F.last("value", ignorenulls=True).over(w)).where("k = 1").select("function_id", "bb_idx", "value")


def reduced_flows(flows: DataFrame, arguments: DataFrame) -> DataFrame:
    """function_id, callee, args: the flow's registers that are arguments of the callee; flows left with none drop out."""
    kept = flows.join(arguments.select(F.col("name").alias("callee"), F.col("arguments").alias("_of")), "callee")
    return kept.select("function_id", "callee", F.array_sort(F.array_intersect("args", "_of")).alias("args")).where(F.size("args") > 0)


def return_registers(flows: DataFrame) -> DataFrame:
    """function_id, returns: the registers that reach a function's own return."""
    r = flows.where(F.col("callee") == "__FUNC_RET__").select("function_id", F.explode("args").alias("r"))
    return r.groupBy("function_id").agg(F.sort_array(F.collect_set("r")).alias("returns"))


def data_dependencies(uses: DataFrame) -> DataFrame:
    """function_id, var, depends: what a variable is computed from, through temporaries (t0, t1, ...) only.

    uses: function_id, var, depends. Registers and memory are leaves.
    """
    name = lambda c: F.concat(F.col("function_id").cast("string"), F.lit("/"), F.col(c))
    edge = uses.select(name("var").alias("src"), name("depends").alias("dst")).distinct()
    temp = lambda c: F.col(c).rlike("/t[0-9]+$")
    inner = transitive_closure(edge.where(temp("dst")), with_self=False)
    far = inner.where(temp("dst")).toDF("src", "mid").join(edge.toDF("mid", "dst"), "mid").select("src", "dst")
    part = lambda c, k: F.split_part(c, F.lit("/"), F.lit(k))
    return edge.union(far).distinct().select(part("src", 1).cast("long").alias("function_id"), part("src", 2).alias("var"), part("dst", 2).alias("depends"))
