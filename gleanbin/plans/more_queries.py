"""More operators as queries: names, vocabularies, vectors, texts of other tools, program facts, learning, similarity, the store.

An order stands in for a function with all its nested columns; its customer is the binary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanbin.functions import text
from gleanbin.operators import dataflow, features, graph, intervals, learning, lm, metrics, names, similarity, store, vocab
from gleanbin.plans import flows
from gleanbin.plans.queries import (
    BINARIES,
    EDGES,
    FUNCTIONS,
    IMPORTING,
    IR,
    SCORES,
    TRUTH,
    _ir_statements,
    _joined,
    _neighbours,
    _rounded,
    binaries,
    functions,
    importing_functions,
    label_scores,
    line_edges,
    lineitem,
    lines,
    query,
    table,
)
from gleanbin.plans.tables import scratch
from gleanbin.sources import io

# --- names --------------------------------------------------------------------------------------------------------------


@query("""with p as (select p_partkey, ['sym.imp.', 'sym.', '', '__imp_'][p_partkey % 4 + 1] || p_name || case when p_size % 2 = 0 then '@@V' || p_size else '' end as n from part)
  select p_partkey, regexp_replace(regexp_replace(n, '^sym\\.imp\\.', ''), '^sym\\.', '') as r2, replace(n, '__imp_', '') as ida, regexp_replace(n, '@@.*', '') as library from p""")
def strip_tool_decorations(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(*map(F.lit, ["sym.imp.", "sym.", "", "__imp_"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    name = F.concat(head, "p_name", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("@@V"), F.col("p_size").cast("string"))).otherwise(""))
    p = table(spark, sf_dir, "part").select("p_partkey", name.alias("n"))
    return p.select("p_partkey", names.strip_r2(F.col("n")).alias("r2"), names.strip_ida(F.col("n")).alias("ida"), names.strip_data_library(F.col("n")).alias("library"))


@query("select p_partkey, array_to_string(list_filter([p_name, case when p_size % 3 = 0 then '' else p_brand end, 'sub_' || p_size], lambda x: x <> '' and not starts_with(x, 'sub_')), ',') as names from part")
def names_without_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.array("p_name", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")), F.concat(F.lit("sub_"), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names.without_junk(given), ",").alias("names"))


@query("select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: case x when 'rod' then 'stick' when 'hot' then 'warm' else x end), ' ') as expanded from part")
def expanded_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names.expanded(F.split("p_name", " "), {"rod": "stick", "hot": "warm"}), " ").alias("expanded"))


WORDS = "n as (select p_partkey as id, string_split(p_name, ' ') as w from part), p as (select a.id, list_distinct(a.w) as a, list_distinct(b.w) as b, greatest(len(a.w), len(b.w)) as n from n a join n b on b.id = a.id + 1)"


def _word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("a"))
    return p.join(p.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")


@query(f"""with {WORDS}, y as (select * from (values ('hot', 'cold'), ('cold', 'hot'), ('red', 'blue'), ('rod', 'bolt'), ('bolt', 'plate')) as v(w, s)),
  wa as (select id, unnest(a) as w from p), wb as (select id, unnest(b) as w from p), sa as (select id, wa.w, wa.w as s from wa join y on y.w = wa.w union select id, wa.w, s from wa join y on y.w = wa.w),
  sb as (select id, wb.w as s from wb join y on y.w = wb.w union select id, s from wb join y on y.w = wb.w), h as (select id, count(distinct w) as k from sa join sb using (id, s) group by id)
  select p.id, round(coalesce(k, 0) / n, 6) as share from p left join h on h.id = p.id""")
def synonym_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("hot", "cold"), ("cold", "hot"), ("red", "blue"), ("rod", "bolt"), ("bolt", "plate")]
    return _rounded(names.synonym_overlap(_word_pairs(spark, sf_dir), spark.createDataFrame(pairs, "word string, synonym string")), "share")


@query("""select a.s_suppkey as id, round(case when a.s_nationkey = b.n_nationkey then 1 when r.n_regionkey = b.n_regionkey then 4 / 6 else 2 / 6 end, 6) as similarity
  from supplier a join nation r on r.n_nationkey = a.s_nationkey join nation b on b.n_nationkey = a.s_suppkey % 25""")
def taxonomy_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations stand under their region, regions under one root."""
    n = table(spark, sf_dir, "nation")
    senses = n.select(F.col("n_name").alias("word"), F.col("n_nationkey").alias("sense"))
    up = lambda ancestor, depth: n.select(F.col("n_nationkey").alias("sense"), ancestor.alias("ancestor"), F.lit(depth).alias("depth"))
    ancestors = up(F.col("n_nationkey"), 3).union(up(F.col("n_regionkey") + 100, 2)).union(up(F.lit(1000), 1))
    own = n.select(F.col("n_nationkey").alias("s_nationkey"), F.array("n_name").alias("a"))
    other = n.select(F.col("n_nationkey").cast("long").alias("k"), F.array("n_name").alias("b"))
    s = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey") % 25).join(own, "s_nationkey").join(other, "k")
    return _rounded(names.wu_palmer(s.select(F.col("s_suppkey").alias("id"), "a", "b"), senses, ancestors), "similarity")


@query()
def alignment_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local alignments of neighbouring names; held against brute force in the tests."""
    p = _word_pairs(spark, sf_dir).select("id", F.array_join("a", "_").alias("a"), F.array_join("b", "_").alias("b"))
    return names.alignment_distance(p, "a", "b")


# --- the stand-in for whole functions -------------------------------------------------------------------------------------

WHOLE = """x as (select l_orderkey as id, count(*)::bigint as lines, count(distinct l_partkey) as parts, list_sort(list(distinct l_suppkey)) as supps, list_sort(list(l_returnflag)) as flags,
    list_sort(list(l_linestatus)) as states, list_sort(list(distinct l_partkey)) as keys, count(*) filter (l_returnflag = 'R') as returned from lineitem group by l_orderkey),
  w as (select o_orderkey as id, o_custkey as binary_id, floor(o_totalprice)::bigint as size, o_orderpriority as priority, x.* exclude (id) from orders join x on x.id = o_orderkey)"""


def whole_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as functions with the nested columns that feature vectors read."""
    text_of = lambda c: F.transform(c, lambda x: x.cast("string"))
    x = lineitem(spark, sf_dir).groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count("*").alias("lines"),
        F.sort_array(F.collect_set("l_suppkey")).alias("supps"),
        F.sort_array(F.collect_list("l_returnflag")).alias("flags"),
        F.sort_array(F.collect_list("l_linestatus")).alias("states"),
        F.sort_array(F.collect_set("l_partkey")).alias("keys"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
    )
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("binary_id"), F.floor("o_totalprice").alias("size"), "o_orderpriority")
    counts = lambda c: F.map_from_arrays(F.array_distinct(c), F.transform(F.array_distinct(c), lambda k: F.size(F.filter(c, lambda v: v == k))))
    nothing = F.array().cast("array<string>")
    taints = F.struct(F.col("returned").alias("t_heap_vars"), F.lit(1).alias("t_stack_vars"), F.lit(None).cast("int").alias("t_stack_args"), F.size("keys").alias("t_code_locs"), F.transform("flags", lambda f: F.when(f == "R", "rax").when(f == "A", "rbp").otherwise("rdi")).alias("tainted"))
    vex = F.struct(F.col("lines").alias("ninstructions"), F.size("keys").alias("ntemp_vars"), counts(F.col("flags")).alias("sum_jumpkinds"), counts(F.col("states")).alias("sum_operations"), F.col("keys").alias("constants"), F.array_distinct("states").alias("operations"), F.array_distinct("flags").alias("jumpkinds"))
    return o.join(x, "id").select(
        "id",
        "binary_id",
        "size",
        F.concat(F.lit("fn_"), "o_orderpriority").alias("name"),
        vex.alias("vex"),
        text_of("supps").alias("callers"),
        text_of("keys").alias("callees"),
        F.concat(text_of("supps"), text_of("keys")).alias("closure"),
        F.struct(F.col("states").alias("stack_vars"), F.lit(None).cast("array<string>").alias("heap_vars"), taints.alias("taints")).alias("sse"),
        F.array_distinct("flags").alias("tls_arguments"),
        F.col("returned").alias("num_args"),
        (F.col("lines") * 8).alias("local_stack_bytes"),
        F.transform("supps", lambda s: F.struct(F.concat(F.lit("s"), s.cast("string")).alias("func"))).alias("tainted_flows"),
        F.lit(None).cast("array<double>").alias("icfg_embedding"),
        F.lit(None).cast("array<double>").alias("callgraph_node_embedding"),
        F.when(F.col("returned") > 0, F.encode(F.array_join("flags", ""), "utf-8")).alias("opcode_hash"),
        F.transform("keys", lambda k: k % 7).alias("opcode_minhash"),
        F.when(F.col("lines") > 4, F.slice(text_of("keys"), 1, 1)).otherwise(nothing).alias("imported_data_refs"),
    )


SIXTEEN = "[size, lines, parts, len(supps), len(keys), len(supps) + len(keys), len(states), 0, len(list_distinct(flags)), returned, lines * 8, returned, 1, 0, len(keys), len(supps)]"


@query(f"with {WHOLE} select id as row, unnest(range(16))::int as pos, unnest({SIXTEEN})::double as value from w")
def function_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_functions(spark, sf_dir).select(F.col("id").alias("row"), F.posexplode(F.array(*features.scalars())).alias("pos", "value"))


FLAGS, STATES = ["A", "N", "R"], ["F", "O"]


@query(f"""with {WHOLE}, v as (select id as row, list_concat({SIXTEEN}, list_transform(['A', 'N', 'R'], lambda k: len(list_filter(flags, lambda f: f = k))), list_transform(['F', 'O'], lambda k: len(list_filter(states, lambda f: f = k))),
    list_transform(range(376), lambda k: 0), [list_contains(flags, 'R')::int, 0, 0, 0, list_contains(flags, 'A')::int, 0, 0, 0]) as v from w)
  select * from (select row, unnest(range(len(v)))::int as pos, unnest(v)::double as value from v) where value <> 0""")
def quantitative_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = whole_functions(spark, sf_dir)
    return f.select(F.col("id").alias("row"), F.posexplode(features.quantitative(FLAGS, STATES)).alias("pos", "value")).where("value <> 0")


@query(f"""with {WHOLE}, k as (select distinct part::varchar as name from (select unnest(keys) as part from w) where part % 2 = 0) select distinct id as row, item from (
    select id, 'opcode:' || upper(hex(encode(array_to_string(flags, '')))) as item from w where returned > 0 union all select id, 'constant:' || unnest(keys) from w
    union all select id, 'data:' || keys[1] from w where lines > 4 union all select id, 'callee:' || c from (select id, unnest(keys)::varchar as c from w) where c in (select name from k)
    union all select id, 'caller:' || c from (select id, unnest(supps)::varchar as c from w) where c in (select name from k)
    union all select id, 'closure:' || c from (select id, unnest(list_concat(supps, keys))::varchar as c from w) where c in (select name from k)
    union all select id, 'minhash:' || h from (select id, unnest(list_distinct(list_transform(keys, lambda x: x % 7))) as h from w) where false)""")
def categorical_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = whole_functions(spark, sf_dir)
    known = f.select(F.explode("callees").alias("name")).where("try_cast(name as long) % 2 = 0")
    items = features.categorical_items(f.drop("opcode_minhash").withColumn("opcode_minhash", F.lit(None).cast("array<long>")), known, lambda c: F.array(c))
    return items.where("not startswith(item, 'minhash:')")


@query(f"""with {WHOLE}, s as (select *, ('0x' || substr(md5(id::varchar), 1, 4))::int % 100 < 80 as train from w), t as (select * from s where train), h as (select count(*) as n, array_to_string(flags, '') as f from t where returned > 0 group by f)
  select 'operations' as kind, o as item from (select distinct unnest(states) as o from t) union all select 'jumpkinds', j from (select distinct unnest(flags) as j from t)
  union all select 'known', c from (select distinct unnest(list_concat(supps, keys))::varchar as c from t) union all select 'unknown', n from (select distinct 'fn_' || priority as n from t)
  union all select 'data', d from (select distinct keys[1]::varchar as d from t where lines > 4) union all select 'split', id::varchar from s where train union all select 'hashes', f from h where n > 5""")
def experiment_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabularies that an experiment draws from its training binaries; here each function is a binary of its own."""
    f = whole_functions(spark, sf_dir).withColumn("binary_id", F.col("id"))
    kinds = flows.settings(f, f.select("id"), lambda c: F.array(c))
    of = {"operations": ("operations", "item"), "jumpkinds": ("jumpkinds", "item"), "known": ("known_names", "name"), "unknown": ("unknown_names", "name"), "data": ("imported_data_refs", "item")}
    out = kinds["split"].where("split = 'train'").select(F.lit("split").alias("kind"), F.col("id").cast("string").alias("item"))
    for kind, (name, column) in of.items():
        out = out.unionByName(kinds[name].select(F.lit(kind).alias("kind"), F.col(column).alias("item")))
    hashes = kinds["hashes"].where("opcode_hash is not null")
    return out.unionByName(hashes.select(F.lit("hashes").alias("kind"), F.decode("opcode_hash", "utf-8").alias("item")))


@query("""with i as (select distinct l_orderkey as row, l_returnflag || l_linestatus as item from lineitem), d as (select distinct item from i),
  h as (select item, k, ('0x' || substr(md5('1337:' || k || ':' || item), 1, 8))::bigint as h from d, (select unnest(range(256)) as k)),
  s as (select row, k, min(h) as h from i join h using (item) group by row, k), g as (select row, md5(string_agg(h, ',' order by k)) as digest from s group by row)
  select digest, count(*) as n from g group by digest having count(*) > 5""")
def frequent_minhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 256 permutations."""
    items = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("row"), F.concat("l_returnflag", "l_linestatus").alias("item"))
    return vocab.digest_frequent(features.minhash(items), "signature")


@query("select distinct unnest([event_type, 'user' || user_id % 10]) as item from events")
def union_of_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.array("event_type", F.concat(F.lit("user"), (F.col("user_id") % 10).cast("string")))
    return vocab.union_of_arrays(table(spark, sf_dir, "events").select(a.alias("a")), "a")


# --- vectors ------------------------------------------------------------------------------------------------------------


@query("select l_orderkey as row, " + ", ".join(f"count(*) filter (l_partkey % 8 = {k}) as {r}" for k, r in enumerate(["r8", "r9", "rax", "rcx", "rdi", "rdx", "rsi"])) + " from lineitem group by l_orderkey")
def flow_register_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    registers = F.array(*map(F.lit, ["r8", "r9", "rax", "rcx", "rdi", "rdx", "rsi", "rbx"]))
    flows_ = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("row"), F.element_at(registers, (F.col("l_partkey") % 8 + 1).cast("int")).alias("register"))
    return features.flow_register_counts(flows_)


@query(f"with {EDGES}, v as (select l_orderkey * 100 + l_linenumber as near, l_quantity as q from lineitem) select src as row, 'callees' as side, 0 as pos, q as value from e join v on near = dst union all select dst, 'callers', 0, q from e join v on near = src")
def directed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = lines(spark, sf_dir).select(F.col("id").alias("row"), F.lit(0).alias("pos"), F.col("size").cast("double").alias("value"))
    return features.directed_sums(line_edges(spark, sf_dir), values)


@query(f"with {EDGES}, n as (select src as row, dst as near from e union select dst, src from e) select row, 0 as pos, sum(l_quantity) as value from n join lineitem on l_orderkey * 100 + l_linenumber = near group by row")
def neighbour_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = lines(spark, sf_dir).select(F.col("id").alias("row"), F.lit(0).alias("pos"), F.col("size").cast("double").alias("value"))
    return features.neighbour_context(line_edges(spark, sf_dir), values, agg="sum")


@query("select vec_id as row, unnest(range(10))::int as pos, round(unnest(list_concat(embedding[1:2], embedding[3:5], embedding[60:62], embedding[63:64]))::double, 6) as value from embeddings")
def final_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda a, n: F.slice("embedding", a, n)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), features.final_embedding(part(1, 2), part(3, 3), part(60, 3), part(63, 2)).alias("v"))
    return e.select("row", F.posexplode("v").alias("pos", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("select vec_id as row, unnest(range(6))::int as pos, round(unnest(list_concat(embedding[1:2], embedding[3:4], embedding[5:6]))::double, 6) as value from embeddings")
def encoder_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda a: F.slice("embedding", a, 2)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), features.encoder_sample(part(1), part(3), part(5)).alias("v"))
    return e.select("row", F.posexplode("v").alias("pos", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("select user_id as row, (('0x' || substr(md5(props), 1, 8))::bigint % 1024)::int as idx, count(*) as n from events group by 1, 2")
def hashed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.hashed_counts(table(spark, sf_dir, "events").select(F.col("user_id").alias("row"), F.col("props").alias("item")))


@query("""with k as (select event_type as item, (row_number() over (order by event_type) - 1)::int as idx from (select distinct event_type from events)),
  c as (select user_id as row, idx, count(*)::double as n from events join k on item = event_type group by 1, 2)
  select u.row, k.idx as pos, coalesce(c.n, 0) as value from (select distinct row from c) u join k on true left join c on c.row = u.row and c.idx = k.idx""")
def dense_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("row"), F.col("event_type").alias("item"))
    c = features.counted(e, vocab.indexed(e.select("item").distinct(), "item"))
    return features.dense(c, 5).select("row", F.posexplode("vector").alias("pos", "value"))


@query("with b as (select l_orderkey as f, l_linenumber as i, sha256(l_returnflag || l_linestatus) as h from lineitem) select f as function_id, sha256(unhex(string_agg(h, '' order by i))) as hash from b group by f")
def data_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lineitem(spark, sf_dir)
    return features.function_hash(l.select(F.col("l_orderkey").alias("function_id"), F.col("l_linenumber").alias("bb_idx"), F.sha2(F.concat("l_returnflag", "l_linestatus"), 256).alias("hash")))


@query(f"""with {IR}, o as (select f, string_agg(op || '=' || n, ',' order by op) as ops from (select f, op, count(*) as n from s group by f, op) group by f),
  c as (select f, coalesce(string_agg(c, ',' order by c) filter (k <> 1 and c % 5 <> 0), '') as constants, coalesce(string_agg(distinct t, ',' order by t) filter (k = 1), '') as callees from s group by f)
  select g.f as function_id, sum(ninstructions)::bigint as ninstructions, sum(ntemp_vars)::bigint as ntemp_vars, any_value(c.constants) as constants, any_value(c.callees) as callees, any_value(ops) as operations from g join o using (f) join c using (f) group by g.f""")
def function_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.function_counts(features.block_counts(_ir_statements(spark, sf_dir)))
    ops = F.array_join(F.transform(F.array_sort(F.map_entries("sum_operations")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return _joined(f, "constants", "callees").select("function_id", "ninstructions", "ntemp_vars", "constants", "callees", ops.alias("operations"))


@query("select distinct l_orderkey as function_id, l_partkey::decimal(20,0) as address from lineitem where l_linenumber % 3 = 1")
def data_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 3 == 1, "Load").otherwise("Put")
    l = lineitem(spark, sf_dir)
    return features.data_references(l.select(F.col("l_orderkey").alias("function_id"), kind.alias("kind"), F.col("l_partkey").cast("decimal(20,0)").alias("constant")))


@query("select n, count(*) as values from (select count(*) as n from events group by props) group by n")
def frequency_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.frequency_distribution(table(spark, sf_dir, "events"), "props")


@query(f"""with {FUNCTIONS}, {BINARIES}, s as (select id, ('0x' || substr(md5(id::varchar), 1, 4))::int % 100 as p from b)
  select case when p < 80 then 'train' when p < 90 then 'validate' else 'test' end as split, path, b.id as b_id, f.id as f_id, name, 'sub.' || name as real_name, array_to_string(list_sort(list_distinct(string_split('sub ' || name, ' '))), ',') as label_set, replace('sub_' || name, ' ', '_') as canonical_name
  from f join b on b.id = binary_id join s on s.id = b.id""")
def name_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = binaries(spark, sf_dir)
    f = functions(spark, sf_dir).withColumn("real_name", F.concat(F.lit("sub."), "name"))
    labels = lambda c: F.array_sort(vocab.alpha_numeric(c))
    return _joined(flows.name_export(f, b, vocab.hash_split(b.select("id"), "id"), labels, lambda c: F.regexp_replace(c, "[^a-z0-9]+", "_")), "label_set")


# --- graphs ---------------------------------------------------------------------------------------------------------------


@query("with h as (select l_returnflag || l_linestatus as k, count(*) filter (l_orderkey % 2 = 0)::double as x, count(*) filter (l_orderkey % 2 = 1)::double as y from lineitem group by 1) select round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) as similarity from h")
def graph_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lineitem(spark, sf_dir).select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("label"))
    return _rounded(graph.wl_kernel(l.where("l_orderkey % 2 = 0"), l.where("l_orderkey % 2 = 1")), "similarity")


@query("with c as (select l_orderkey as o, max(l_linenumber) as n from lineitem group by 1), t as (select o from c where n > 1 order by n desc, o limit 1) select l_orderkey * 100 + l_linenumber as node from lineitem where l_orderkey in (select o from t)")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.largest_component(line_edges(spark, sf_dir))


@query(f"""with {EDGES}, b as (select src // 100 as graph, src as node, dst as near from e union select src // 100, dst, src from e), d as (select graph, node, count(*) as d from b group by all), t as (select graph, count(*) as n, max(d) as top from d group by 1),
  m as (select max(d) as hi, min(d) as lo from d) select graph, count(*) filter (least(floor((d - lo) / nullif(hi - lo, 0) * 4), 3) = 0 or hi = lo)::double / count(*) as low, count(*) filter (least(floor((d - lo) / nullif(hi - lo, 0) * 4), 3) = 3)::double / count(*) as high from d, m group by graph""")
def degree_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = line_edges(spark, sf_dir).select(F.expr("src div 100").alias("graph"), "src", "dst")
    h = graph.degree_histograms(graph.degree_profile(e), bins=4)
    return h.select("graph", F.col("vector")[0].alias("low"), F.col("vector")[3].alias("high"))


@query(f"""with {IMPORTING}, n as (select binary_id, name, 'defined' as role from i union select binary_id, s_name, 'import' from i)
  select binary_id, name, role, (p_rank % 3)::int as idx, 0.5::double as p from n join (select p_name, min(p_partkey) as p_rank from part group by 1) on p_name = name where role = 'defined'
  union all select binary_id, name, role, s_suppkey::int, 1.0 from n join supplier on s_name = name where role = 'import' and s_suppkey % 2 = 0""")
def node_potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = importing_functions(spark, sf_dir).select("binary_id", "id", F.col("name").alias("real_name"), "callees", "callers", F.col("id").alias("vaddr"), F.lit("GLOBAL").alias("binding"), "size")
    nodes = graph.call_nodes(f, graph.call_edges(f))
    scores = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg((F.min("p_partkey") % 3).cast("int").alias("idx")).withColumn("p", F.lit(0.5))
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("int").alias("idx"))
    return graph.with_potentials(nodes, scores, known).select("binary_id", "name", "role", F.explode("potentials").alias("idx", "p"))


@query()
def block_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded walks; held against the edges in the tests."""
    l = lineitem(spark, sf_dir)
    exits = l.select(F.col("l_orderkey").alias("function_id"), F.col("l_linenumber").cast("long").alias("start"), (F.col("l_partkey") % 8 + 1).alias("target"))
    return graph.block_walks(exits, exits.select("function_id", F.lit(1).cast("long").alias("start")).distinct())


# --- intervals and texts of other tools -----------------------------------------------------------------------------------


@query("""with p as (select p_partkey, p_name || '.isra.0' as name, p_name as bare, p_size from part), a as (select p_name as name, min(p_brand) as args from part where p_size < 25 group by 1)
  select distinct p.name, coalesce(x.args, y.args, '') as arguments from p left join a x on x.name = p.name left join a y on y.name = p.bare""")
def resolved_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    calls = p.select(F.concat("p_name", F.lit(".isra.0")).alias("name"))
    prototypes = p.where("p_size < 25").select(F.col("p_name").alias("name"), F.array("p_brand").alias("arguments"))
    return _joined(store.resolved_arguments(calls, prototypes, F.regexp_replace("name", r"\.isra\.[0-9]+$", "")), "arguments")


@query("select l_orderkey * 100 + l_linenumber as id, l_partkey as at from lineitem where not exists (select 1 from supplier where l_partkey >= s_suppkey * 10 and l_partkey < s_suppkey * 10 + 5)")
def constants_outside_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = lines(spark, sf_dir).select("id", F.lit(0).alias("k"), F.col("part").alias("at"))
    sections = table(spark, sf_dir, "supplier").select(F.lit(0).alias("k"), (F.col("s_suppkey") * 10).alias("start"), (F.col("s_suppkey") * 10 + 5).alias("end"))
    return intervals.outside(points, sections, ["k"], 8).select("id", "at")


@query("""with r as (select s_nationkey as b, s_suppkey as v, 'n' || (s_suppkey % 7) as n from supplier), m as (select b, n, min(v) as v from r group by all)
  select c_nationkey as binary_id, 'n' || (c_custkey % 9) || '@plt' as name, case when c_custkey % 2 = 0 then coalesce(m.v, 0) else c_custkey end as vaddr from customer left join m on m.b = c_nationkey and m.n = 'n' || (c_custkey % 9)""")
def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c, k: F.concat(F.lit("n"), (F.col(c) % k).cast("string"))
    relocations = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("binary_id"), n("s_suppkey", 7).alias("name"), F.col("s_suppkey").alias("vaddr"))
    c = table(spark, sf_dir, "customer")
    imports = c.select(F.col("c_nationkey").alias("binary_id"), F.concat(n("c_custkey", 9), F.lit("@plt")).alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.lit(0)).otherwise(F.col("c_custkey")).alias("vaddr"))
    return intervals.resolved_imports(imports, relocations, F.regexp_replace("name", "@plt$", ""))


@query("select p_partkey, case p_size % 4 when 1 then 'object' when 2 then 'executable' when 3 then case when p_partkey % 2 = 0 then 'executable' else 'shared_library' end end as kind from part")
def binary_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", intervals.binary_type(F.col("p_size") % 4, F.col("p_partkey") % 2 == 0).alias("kind"))


@query("""select s_nationkey as binary_id, s_suppkey as vaddr, case s_suppkey % 4 when 0 then 'main' when 1 then 'csu_init' else 'csu_fini' end as name from supplier
  where s_suppkey % 4 < 3 and s_suppkey % 3 = 0""")
def entry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    registers = F.element_at(F.array(*map(F.lit, ["rdi", "rcx", "r8", "rax"])), (F.col("s_suppkey") % 4 + 1).cast("int"))
    entries = s.select(F.col("s_nationkey").alias("binary_id"), registers.alias("register"), F.col("s_suppkey").alias("value"))
    symbols = s.where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("binary_id"), F.col("s_suppkey").alias("vaddr"))
    return intervals.entry_names(entries, symbols)


@query("""select s_nationkey as binary_id, 'frame_dummy' as name, 'frame_dummy.part.' || s_suppkey as real_name, s_suppkey * 16 as vaddr, 8::bigint as size from supplier
  union all select s_nationkey, 'do_global_dtors_aux', '__do_global_dtors_aux', s_suppkey * 16 + 8, 8 from supplier where s_suppkey % 2 = 0""")
def constructor_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda name, at: F.array(F.struct(name.alias("name"), at.alias("address"), F.lit(8).cast("long").alias("size")))
    at = F.col("s_suppkey") * 16
    ctors = f(F.concat(F.lit("frame_dummy.part."), F.col("s_suppkey").cast("string")), at)
    dtors = F.when(F.col("s_suppkey") % 2 == 0, f(F.lit("__do_global_dtors_aux"), at + 8))
    h = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("binary_id"), ctors.alias("constructors"), dtors.alias("destructors"))
    return intervals.constructor_symbols(h, names.strip_decorations)


@query("select l_orderkey as binary_id, min(l_suppkey) as vaddr, 'init' as name from lineitem where l_linenumber = 1 and l_returnflag = 'R' and l_orderkey % 2 = 0 group by l_orderkey")
def init_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of even number have a csu_init, whose blocks are their lines."""
    l = lineitem(spark, sf_dir)
    kind = F.when(F.col("l_returnflag") == "R", "Ijk_Call").otherwise("Ijk_Boring")
    exits = l.select(F.col("l_orderkey").alias("binary_id"), F.lit(64).alias("function"), (F.col("l_linenumber") - 1).alias("bb_idx"), F.col("l_suppkey").alias("target"), kind.alias("jumpkind"))
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("binary_id"), F.lit(64).alias("vaddr"), F.when(F.col("o_orderkey") % 2 == 0, "csu_init").otherwise("main").alias("name"))
    return intervals.init_names(entries, exits)


def _hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


@query("select p_partkey::decimal(20,0) as vaddr, p_size::decimal(20,0) as size, p_brand || '_' || p_partkey as name from part where p_size % 3 <> 0")
def objdump_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, " g     O .data\t").otherwise(" g     F .text\t")
    line = F.concat(F.lpad(_hexed(F.col("p_partkey")), 16, "0"), kind, F.lpad(_hexed(F.col("p_size")), 16, "0"), F.when(F.col("p_size") % 2 == 0, "              .hidden ").otherwise("              "), "p_brand", F.lit("_"), F.col("p_partkey").cast("string"))
    return intervals.objdump_symbols(table(spark, sf_dir, "part").select(line.alias("value")))


@query("select p_partkey::decimal(20,0) as vaddr, p_size::decimal(20,0) as size, 'func.' || p_partkey as name from part")
def nucleus_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    line = F.concat(F.lit("function "), key, F.lit(": entry@0x"), _hexed(F.col("p_partkey")), F.lit(" "), F.col("p_size").cast("string"), F.lit(" bytes"))
    return intervals.nucleus_functions(table(spark, sf_dir, "part").select(line.alias("value")))


@query("select p_partkey::decimal(20,0) as vaddr, p_size::decimal(20,0) as size, 'fcn.' || lower(to_hex(p_partkey)) as name from part")
def ghidra_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("0x"), _hexed(F.col("p_partkey")), F.lit("   "), F.col("p_size").cast("string"))
    return intervals.ghidra_functions(table(spark, sf_dir, "part").select(line.alias("value")))


@query("select p_partkey::decimal(20,0) as vaddr, (p_size * 4)::decimal(20,0) as size, 'sym.f' || p_partkey as name from part where p_size % 5 <> 0")
def radare_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function lists of address, blocks, size (with -> where it was resized) and name; other lines drop out."""
    key, size = F.col("p_partkey").cast("string"), (F.col("p_size") * 4).cast("string")
    sizes = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("7 -> "), size)).otherwise(size)
    line = F.concat(F.lit("0x"), F.lpad(_hexed(F.col("p_partkey")), 8, "0"), F.lit("    3 "), sizes, F.lit("   sym.f"), key)
    return intervals.radare_functions(table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value")))


@query("""with o as (select distinct s_suppkey * 10 as start, s_suppkey * 10 + s_nationkey + 1 as stop from supplier), n as (select start, stop, (select count(*) from part where p_partkey % 13 = 0 and p_partkey >= start and p_partkey + 1 <= stop) as n from o),
  f as (select *, stop - start > 15 as late from n where n <= 1 and stop - start <= 20) select start, stop as "end", n, late from f where not late or not exists (select 1 from f e where not e.late and e.start >= f.start and e.start < f.stop)""")
def accepted_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.lit(0).alias("k"), (F.col("s_suppkey") * 10).alias("start"), (F.col("s_suppkey") * 10 + F.col("s_nationkey") + 1).alias("end"))
    inner = table(spark, sf_dir, "part").where("p_partkey % 13 = 0").select(F.lit(0).alias("k"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + 1).alias("end"))
    return intervals.accepted_boundaries(s, inner, ["k"], 16, most=20, delayed=15).select("start", "end", "n", "late")


@query("""with r as (select distinct c_nationkey as b, c_custkey as f, c_custkey % 400 as spot from customer), n as (select s_nationkey as b, s_suppkey % 40 * 10 as lo, 'n' || s_suppkey as name, case when s_suppkey % 2 = 0 then 'function' else 'data' end as kind from supplier)
  select r.b as binary_id, f as function_id, kind, string_agg(distinct name, ',' order by name) as names from r join n on n.b = r.b and spot >= lo and spot < lo + 10 group by all""")
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("binary_id"), F.col("c_custkey").alias("function_id"), (F.col("c_custkey") % 400).alias("address"))
    s = table(spark, sf_dir, "supplier")
    named = s.select(F.col("s_nationkey").alias("binary_id"), F.when(F.col("s_suppkey") % 2 == 0, "function").otherwise("data").alias("kind"), (F.col("s_suppkey") % 40 * 10).alias("start"), (F.col("s_suppkey") % 40 * 10 + 10).alias("end"), F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("name"))
    return _joined(intervals.resolved_references(r, named, 16), "names")


# --- data flow --------------------------------------------------------------------------------------------------------------


@query("select l_orderkey as function_id, coalesce(string_agg(distinct r, ',' order by r) filter (r in ('rdi', 'rsi', 'r8')), '') as arguments from (select l_orderkey, ['rsi', 'rdi', 'r8', 'rax'][l_partkey % 4 + 1] as r from lineitem where l_linestatus = 'F') group by l_orderkey")
def function_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    registers = F.element_at(F.array(*map(F.lit, ["rsi", "rdi", "r8", "rax"])), (F.col("l_partkey") % 4 + 1).cast("int"))
    live = lineitem(spark, sf_dir).where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("function_id")).agg(F.collect_set(registers).alias("live_in")).withColumn("bb_idx", F.lit(0))
    found = dataflow.function_arguments(live).withColumn("arguments", F.array_sort("arguments"))
    return _joined(found, "arguments")


@query("""with recursive x as (select l_orderkey as f, l_linenumber as i, 'r' || (l_partkey % 5) as a, 'r' || (l_suppkey % 5) as b from lineitem), n as (select f, max(i) as n from x group by f),
  r as (select f, 0 as i, ['r0', 'r1'] as t from n union all select x.f, x.i, case when list_contains(t, a) then list_distinct(list_append(t, b)) else list_filter(t, lambda v: v <> b) end from r join x on x.f = r.f and x.i = r.i + 1)
  select r.f as function_id, array_to_string(list_sort(t), ',') as tainted from r join n on n.f = r.f and n.n = r.i""")
def block_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of an order as one block."""
    reg = lambda c: F.array(F.concat(F.lit("r"), (F.col(c) % 5).cast("string")))
    s = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("function_id"), F.lit(0).alias("bb_idx"), F.col("l_linenumber").alias("stmt_idx"), reg("l_partkey").alias("inputs"), reg("l_suppkey").alias("outputs"))
    start = s.select("function_id", "bb_idx").distinct().withColumn("tainted", F.array(F.lit("r0"), F.lit("r1")))
    return _joined(dataflow.block_taint(s, start), "tainted").select("function_id", "tainted")


@query("""with recursive x as (select l_orderkey as f, l_linenumber as i, l_linenumber % 5 as k, 'r' || (l_partkey % 4) as a, 'r' || (l_suppkey % 4) as b, 'mem_0x' || lower(to_hex(l_suppkey % 3 + 16)) as m, 'g' || (l_partkey % 2) as g from lineitem),
  y as (select f, i, case k when 0 then [a] when 1 then [a, m] when 2 then [a] when 3 then [a, m, g, b] else [g] end as inp, case k when 2 then [m] when 4 then [] else [b] end as outp from x), n as (select f, max(i) as n from y group by f),
  r as (select f, 0 as i, ['r0', 'mem_0x10'] as t from n union all select y.f, y.i, case when len(list_intersect(t, inp)) > 0 then list_distinct(list_concat(t, outp)) else list_filter(t, lambda v: not list_contains(outp, v)) end from r join y on y.f = r.f and y.i = r.i + 1)
  select r.f as function_id, array_to_string(list_sort(t), ',') as tainted from r join n on n.f = r.f and n.n = r.i""")
def ir_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as Put, Load, Store, LoadG and Exit statements of one block; r0 and one cell are tainted."""
    reg = lambda c, n, letter="r": F.concat(F.lit(letter), (F.col(c) % n).cast("string"))
    k = F.col("l_linenumber") % 5
    kind = F.element_at(F.array(*map(F.lit, ["Put", "Load", "Store", "LoadG", "Exit"])), (k + 1).cast("int"))
    ir = lineitem(spark, sf_dir).select(
        F.col("l_orderkey").alias("function_id"),
        F.lit(0).alias("bb_idx"),
        F.col("l_linenumber").alias("stmt_idx"),
        kind.alias("kind"),
        reg("l_suppkey", 4).alias("target"),
        F.array(reg("l_partkey", 4)).alias("sources"),
        reg("l_partkey", 2, "g").alias("guard"),
        (F.col("l_suppkey") % 3 + 16).cast("decimal(20,0)").alias("address"),
    )
    start = ir.select("function_id", "bb_idx").distinct().withColumn("tainted", F.array(F.lit("r0"), F.lit("mem_0x10")))
    return _joined(dataflow.block_taint(dataflow.statement_flows(ir), start), "tainted").select("function_id", "tainted")


@query("""select s_suppkey, ['rax', 'rax', 'r9', 'zmm3', 'rdi', 'rip'][s_suppkey % 6 + 1] as base, [32, 8, 16, 128, 8, null][s_suppkey % 6 + 1] as bits from supplier""")
def register_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ["eax", "ah", "r9w", "xmm3", "dil", "rip"])), (F.col("s_suppkey") % 6 + 1).cast("int"))
    s = table(spark, sf_dir, "supplier").withColumn("r", name)
    return s.select("s_suppkey", dataflow.base_register(F.col("r")).alias("base"), dataflow.register_size(F.col("r")).alias("bits"))


@query("with s as (select l_orderkey as f, greatest(1000 - min(1000 - l_partkey % 100) - 8, 0)::bigint as b from lineitem group by 1) select f as function_id, b as local_stack_bytes, (b // 8)::bigint as num_locals from s")
def stack_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lineitem(spark, sf_dir)
    return dataflow.stack_frame(l.select(F.col("l_orderkey").alias("function_id"), F.lit(1000).cast("long").alias("rsp_start"), (1000 - F.col("l_partkey") % 100).alias("rsp")))


@query("select l_orderkey as function_id, string_agg(distinct 'r' || (l_partkey % 6), ',' order by 'r' || (l_partkey % 6)) as returns from lineitem where l_suppkey % 3 = 0 group by 1")
def return_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lineitem(spark, sf_dir)
    callee = F.when(F.col("l_suppkey") % 3 == 0, "__FUNC_RET__").otherwise("other")
    flows_ = l.select(F.col("l_orderkey").alias("function_id"), callee.alias("callee"), F.array(F.concat(F.lit("r"), (F.col("l_partkey") % 6).cast("string"))).alias("args"))
    return _joined(dataflow.return_registers(flows_), "returns")


@query("""with c as (select l_orderkey as f, (l_linenumber * 16)::bigint as start, l_returnflag as r, case when l_suppkey % 4 > 0 then l_suppkey end as next, l_partkey as p from lineitem)
  select f as function_id, start, next as target, case r when 'R' then 'Ijk_Call' when 'A' then 'Ijk_Ret' else 'Ijk_Boring' end as jumpkind from c union all select f, start, p, 'Ijk_Boring' from c where p % 2 = 0
  union all select f, start, start + 12, 'Ijk_AssumedRet' from c where r = 'R' and next is not null and next % 10 <> 3""")
def block_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exits with assumed returns; every tenth supplier is a function that never returns."""
    l = lineitem(spark, sf_dir)
    kind = F.when(F.col("l_returnflag") == "R", "Ijk_Call").when(F.col("l_returnflag") == "A", "Ijk_Ret").otherwise("Ijk_Boring")
    other = F.array(F.struct(F.col("l_partkey").alias("target"), F.lit("Ijk_Boring").alias("jumpkind")))
    b = l.select(
        F.col("l_orderkey").alias("function_id"),
        (F.col("l_linenumber") * 16).cast("long").alias("start"),
        F.lit(12).alias("size"),
        F.when(F.col("l_suppkey") % 4 > 0, F.col("l_suppkey")).alias("next"),
        kind.alias("jumpkind"),
        F.when(F.col("l_partkey") % 2 == 0, other).otherwise(F.slice(other, 1, 0)).alias("others"),
    )
    s = table(spark, sf_dir, "supplier")
    return dataflow.block_exits(b, s.select(F.col("s_suppkey").alias("vaddr"), F.when(F.col("s_suppkey") % 10 == 3, "exit").otherwise("other").alias("name")))


@query("""with recursive x as (select l_orderkey as f, l_linenumber as i, ['rdi', 'rsi', 'rbx'][l_partkey % 3 + 1] as a, ['rsi', 'rbx', 'rdi'][l_suppkey % 3 + 1] as b, l_returnflag = 'R' as call, l_suppkey % 5 as callee from lineitem),
  r as (select f, 0 as i, ['rdi'] as t from (select distinct f from x)
    union all select z.f, z.i, case when call and callee < 2 and list_contains(t, 'rsi') then list_distinct(list_append(t, 'rax')) else t end from (
      select x.f, x.i, call, callee, case when list_contains(t, a) then list_distinct(list_append(t, b)) else list_filter(t, lambda v: v <> b) end as t from r join x on x.f = r.f and x.i = r.i + 1) z)
  select distinct r.f as function_id, case when call then 'fn' || callee else '__FUNC_RET__' end as callee, array_to_string(list_sort(list_filter(t, lambda v: case when call then v in ('rdi', 'rsi') else v = 'rax' end)), ',') as args
  from r join x on x.f = r.f and x.i = r.i join (select f as mf, max(i) as n from x group by f) on mf = r.f where (call or r.i = n) and len(list_filter(t, lambda v: case when call then v in ('rdi', 'rsi') else v = 'rax' end)) > 0""")
def callee_return_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taint of rdi through an order's lines; two callees return rax when rsi is tainted; the last line returns unless it calls."""
    pick = lambda items, c, n: F.element_at(F.array(*map(F.lit, items)), (F.col(c) % n + 1).cast("int"))
    l = lineitem(spark, sf_dir)
    one = F.array(F.struct(F.array(pick(["rdi", "rsi", "rbx"], "l_partkey", 3)).alias("inputs"), F.array(pick(["rsi", "rbx", "rdi"], "l_suppkey", 3)).alias("outputs")))
    b = l.select(F.col("l_orderkey").alias("function_id"), F.col("l_linenumber").alias("bb_idx"), one.alias("statements"))
    last = l.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"))
    call = F.col("l_returnflag") == "R"
    exits = l.join(last, "l_orderkey").where(call | (F.col("l_linenumber") == F.col("n"))).select(F.col("l_orderkey").alias("function_id"), F.col("l_linenumber").alias("bb_idx"), F.when(call, F.concat(F.lit("fn"), (F.col("l_suppkey") % 5).cast("string"))).alias("callee"), F.when(call, "Ijk_Call").otherwise("Ijk_Ret").alias("jumpkind"))
    f = l.select(F.col("l_orderkey").alias("function_id")).distinct().select("function_id", F.concat(F.lit("own"), F.col("function_id").cast("string")).alias("name"), F.array(F.lit("rdi")).alias("arguments"))
    known = spark.createDataFrame([("fn0", "rsi", ["rax"]), ("fn1", "rsi", ["rax"])], "name string, taint string, regs array<string>")
    edges = line_edges(spark, sf_dir).select(F.expr("src div 100").alias("function_id"), (F.col("src") % 100).cast("int").alias("src"), (F.col("dst") % 100).cast("int").alias("dst"))
    return _joined(dataflow.interprocedural_flows(b, edges, exits, f, known), "args").select("function_id", "callee", "args")


# --- learning and metrics -------------------------------------------------------------------------------------------------


@query(f"with {SCORES}, r as (select row, label, score, row_number() over (partition by row order by score desc, label) as rank from s) select row, label, score, rank::int as rank from r where rank <= 5")
def top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.top_labels(label_scores(spark, sf_dir)[0])


@query(f"with {SCORES}, {TRUTH} select row, label, score from s where class <> 3 union all select row, label, 1.0 from t where row in (select row from s where class = 3)")
def scores_with_calculable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of class 3 have a name that is known by rule."""
    s, t = label_scores(spark, sf_dir)
    named = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.when(F.col("label") == 3, "frame_dummy").otherwise("other").alias("name"))
    return learning.with_calculable(s, t, named)


@query("select vec_id from embeddings where label % 5 > 0")
def without_calculable(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("name", F.when(F.col("label") % 5 == 0, "main").otherwise("other"))
    return learning.without_calculable(e, "name").select("vec_id")


@query(f"with {SCORES} select row, string_agg(label::varchar, '_' order by score desc, label) as name from s where score > 0.23 group by row")
def deduced_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.deduced(label_scores(spark, sf_dir)[0])


@query("with u as (select label, unnest(range(64))::int as pos, unnest(list_transform(embedding::double[], lambda x: x / sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y))))) as v from embeddings) select label, pos, round(avg(v), 6) as v from u group by all")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    x = e.select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("vector"))
    c = learning.tail_classifier(x, e.select(F.col("vec_id").alias("row"), "label"))
    return _rounded(c.select("label", F.posexplode("centroid").alias("pos", "v")), "v")


@query("select round(avg((label % 4 = vec_id % 4)::int), 6) as accuracy from embeddings")
def equality_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select((F.col("label") % 4).alias("a"), (F.col("vec_id") % 4).cast("int").alias("b"))
    return _rounded(metrics.equality_accuracy(e, "a", "b"), "accuracy")


@query("select round(avg((list_sort(string_split(p_name, ' ')) = string_split(p_name, ' '))::int), 6) as accuracy from part")
def exact_order_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("a")).withColumn("b", F.array_sort("a"))
    return _rounded(lm.exact_order_accuracy(p, "a", "b"), "accuracy")


PER_LABEL = f"{SCORES}, {TRUTH}, p as (select row, label from s where score > 0.1), c as (select coalesce(t.label, p.label) as label, count(*) filter (t.row is not null and p.row is not null) as tp, count(*) filter (t.row is null) as fp, count(*) filter (p.row is null) as fn from t full join p on t.row = p.row and t.label = p.label group by 1)"


@query(f"with {PER_LABEL} select label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(case when tp > 0 then 2 * tp / (2 * tp + fp + fn) end, 6) as f1 from c")
def per_label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = label_scores(spark, sf_dir)
    d = metrics.per_label(metrics.confusion(t, metrics.predicted(s, 0.1)))
    return _rounded(d.select("label", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], "precision", "recall", "f1"), "precision", "recall", "f1")


@query(f"""with {SCORES}, {TRUTH}, r as (select s.row, s.label, row_number() over (partition by s.row order by score desc, s.label) as k, t.row is not null as rel from s left join t on t.row = s.row and t.label = s.label),
  g as (select row, sum(rel::int)::double as cg, sum(rel::int / log2(k + 1)) as dcg from r where k <= 5 group by row), n as (select row, least(count(*), 5) as n from t group by row),
  i as (select row, (select sum(1 / log2(j + 1)) from (select unnest(range(1, n + 1)) as j)) as ideal from n), h as (select t.row, count(r.row)::double / count(*) as recall from t left join r on r.row = t.row and r.label = t.label and k <= 5 group by t.row)
  select round((select avg(cg) from g), 6) as cg, round((select avg(dcg) from g), 6) as dcg, round((select avg(case when ideal is null then 1 else dcg / ideal end) from g left join i using (row)), 6) as ndcg, round((select avg(recall) from h), 6) as recall""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.score_summary(*label_scores(spark, sf_dir)), "cg", "dcg", "ndcg", "recall")


@query(f"""with {SCORES}, {TRUTH}, g as (select unnest(range(1, 51)) / 100.0::double as threshold), j as (select score, t.row is not null as rel from s left join t on t.row = s.row and t.label = s.label), n as (select count(*) as n from t),
  c as (select threshold, count(*) filter (rel) as tp, count(*) filter (not rel) as fp from g left join j on score > threshold group by threshold), f as (select threshold, coalesce(2 * tp / nullif(2 * tp + fp + n - tp, 0), 0) as f1 from c, n)
  select threshold, round(f1, 6) as f1 from f order by f1 desc, threshold limit 1""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.best_threshold(*label_scores(spark, sf_dir), [k / 100 for k in range(1, 51)]).select("threshold", "f1"), "f1")


@query()
def lsh_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours of every hundredth vector; held against the exact ones in the tests."""
    from gleanbin.operators import knn

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return knn.lsh_nearest(e.where("id % 100 = 0"), e, 8, width=2.0)


@query()
def branch_encoded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of three slices of each vector, fitted on the training split; gradients and recovery are held in the tests."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("vector"))
    split = vocab.hash_split(e, "row")
    part = lambda s: split.where(F.col("split") == s).select("row", "vector")
    return learning.branch_encoded(part("train"), part("validate"), e, [24, 20, 20], code=8, epochs=3)[0]


# --- language model ---------------------------------------------------------------------------------------------------------

ESTIMATES = """p as (select p_partkey, list_concat(['<s>'], list_concat(string_split(p_name, ' '), ['</s>'])) as p from part),
  g as (select 1 as n, array_to_string(p[i:i], ' ') as gram, '' as tail from (select p, unnest(range(1, len(p) + 1)) as i from p) union all select 2, array_to_string(p[i:i + 1], ' '), p[i + 1] from (select p, unnest(range(1, len(p))) as i from p)
    union all select 3, array_to_string(p[i:i + 2], ' '), array_to_string(p[i + 1:i + 2], ' ') from (select p, unnest(range(1, len(p) - 1)) as i from p)),
  c as (select n, gram, tail, count(*) as c from g group by all),
  a as (select n, gram, c as a from c where (n = 3 or starts_with(gram, '<s> ')) union all select n - 1, tail, count(*) from c where n > 1 group by all),
  t as (select n, count(*) filter (a = 1) as t1, count(*) filter (a = 2) as t2, count(*) filter (a = 3) as t3, count(*) filter (a = 4) as t4 from a group by n),
  y as (select n, 1 - 2 * t1 / nullif(t1 + 2 * t2, 0) * t2 / nullif(t1, 0) as x1, 2 - 3 * t1 / nullif(t1 + 2 * t2, 0) * t3 / nullif(t2, 0) as x2, 3 - 4 * t1 / nullif(t1 + 2 * t2, 0) * t4 / nullif(t3, 0) as x3 from t),
  d as (select n, coalesce(x1 between 0 and 1 and x2 between 0 and 2 and x3 between 0 and 3, false) as ok, x1, x2, x3 from y),
  e as (select a.n, gram, a, case when a = 1 then case when ok then x1 else 0.5 end when a = 2 then case when ok then x2 else 1 end else case when ok then x3 else 1.5 end end as d,
    string_split(gram, ' ') as w from a join d on d.n = a.n),
  f as (select *, array_to_string(w[1:n - 1], ' ') as context, array_to_string(w[2:], ' ') as tail from e),
  s as (select n, context, sum(a) as al, sum(d) / sum(a) as gamma, count(*) as kinds from f group by n, context),
  u as (select gamma / (kinds + 1) as unk from s where n = 1),
  p1 as (select 1 as n, gram, (a - d) / al + unk as p from f join s on s.n = f.n and s.context = f.context, u where f.n = 1 union all select 1, '<unk>', unk from u),
  p2 as (select 2 as n, f.gram, (a - d) / al + gamma * p1.p as p from f join s on s.n = f.n and s.context = f.context join p1 on p1.gram = f.tail where f.n = 2),
  p3 as (select 3 as n, f.gram, (a - d) / al + gamma * p2.p as p from f join s on s.n = f.n and s.context = f.context join p2 on p2.gram = f.tail where f.n = 3),
  m as (select x.n, x.gram, log10(p) as prob, coalesce(log10(gamma), 0) as backoff from (select * from p1 union all select * from p2 union all select * from p3 union all select 1, '<s>', 1e-99) x left join s on s.n > 1 and s.context = x.gram)"""


def _name_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", lm.split_labels(F.col("p_name")).alias("labels"))


@query(f"with {ESTIMATES} select n, gram, round(prob, 6) as prob, round(backoff, 6) as backoff from m")
def lm_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lm.estimates(lm.ngrams(_name_labels(spark, sf_dir), "labels")), "prob", "backoff")


@query(f"""with {ESTIMATES}, q as (select p_partkey as row, list_concat(['<s>'], list_concat(list_reverse(string_split(p_name, ' ')), ['</s>'])) as q from part),
  k as (select row, i, q[i] as g1, array_to_string(q[i - 1:i], ' ') as g2, case when i > 2 then array_to_string(q[i - 2:i], ' ') end as g3, q[i - 1] as c1, case when i > 2 then array_to_string(q[i - 2:i - 1], ' ') end as c2 from (select row, q, unnest(range(2, len(q) + 1)) as i from q))
  select row, round(sum(coalesce(m3.prob, coalesce(b2.backoff, 0) + coalesce(m2.prob, coalesce(b1.backoff, 0) + coalesce(m1.prob, log10(unk))))), 6) as score
  from k left join m m1 on m1.gram = g1 left join m m2 on m2.gram = g2 left join m m3 on m3.gram = g3 left join m b1 on b1.gram = c1 left join m b2 on b2.gram = c2, u group by row""")
def lm_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from the last word to the first, so that contexts are met that the model has not seen."""
    s = _name_labels(spark, sf_dir)
    model = lm.fitted(s, "labels")
    return _rounded(lm.backoff_scores(s.withColumn("labels", F.reverse("labels")), "p_partkey", "labels", model.table), "score")


# --- similarity -----------------------------------------------------------------------------------------------------------

PAIRS = """m as (select l_orderkey as id, count(*)::int as n, sum(l_quantity)::bigint as size, string_agg(l_returnflag, '' order by l_linenumber) as h, list_sort(list(distinct l_partkey)) as keys, list(l_returnflag order by l_linenumber) as seq,
    count(*) filter (l_returnflag = 'A')::double as a, count(*) filter (l_returnflag = 'N')::double as nn, count(*) filter (l_returnflag = 'R')::double as r from lineitem group by 1),
  q as (select x.id, x as x, y as y, x.a * y.a + x.nn * y.nn + x.r * y.r as dot, sqrt((x.a * x.a + x.nn * x.nn + x.r * x.r) * (y.a * y.a + y.nn * y.nn + y.r * y.r)) as len,
    ((x.a > 0 and y.a > 0)::int + (x.nn > 0 and y.nn > 0)::int + (x.r > 0 and y.r > 0)::int) / greatest((x.a > 0)::int + (x.nn > 0)::int + (x.r > 0)::int, (y.a > 0)::int + (y.nn > 0)::int + (y.r > 0)::int) as kinds from m x join m y on y.id = x.id + 1)"""


def _pair_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring orders as pairs of functions, and of blocks."""
    l = lineitem(spark, sf_dir)
    seq = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"])
    m = l.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").cast("int").alias("n"), F.sum("l_quantity").cast("long").alias("size"), seq.alias("seq"), F.sort_array(F.collect_set("l_partkey")).alias("keys"))
    counts = F.map_from_arrays(F.array_distinct("seq"), F.transform(F.array_distinct("seq"), lambda k: F.size(F.filter("seq", lambda v: v == k))))
    h = F.array_join("seq", "")
    whole = F.struct("size", h.alias("hash"), F.md5(h).alias("opcode_hash"), F.col("n").alias("ninstructions"), F.size("keys").alias("ntemps"), F.element_at("seq", 1).alias("jumpkind"), F.col("seq").alias("jumpkinds"), *[counts.alias(c) for c in ("sum_jumpkinds", "temps", "statements", "expressions", "operations")], F.col("keys").alias("constants"), F.array(counts, counts, counts).alias("categories"), F.col("keys").alias("callees"))
    a = m.select("id", whole.alias("a"))
    return a.join(a.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")


def _near(x: str, y: str) -> str:
    return f"case when greatest({x}, {y}) = 0 then 1 else (greatest({x}, {y}) - abs({x} - {y})) / greatest({x}, {y}) end"


ANGLE = "round(1 - acos(least(dot / len, 1)) / (pi() / 2), 5)"
PREFIX = "coalesce((select min(k) - 1 from (select unnest(range(1, greatest(x.n, y.n) + 1)) as k) where x.seq[k] is distinct from y.seq[k]), greatest(x.n, y.n)) / greatest(x.n, y.n)"
KEYS = "len(list_intersect(x.keys, y.keys)) / greatest(len(x.keys), len(y.keys))"


@query(f"""with {PAIRS} select id, unnest(range(14))::int as pos, round(unnest([{_near('x.size', 'y.size')}, (x.h = y.h)::int, (x.h = y.h)::int, {_near('x.n', 'y.n')}, kinds, {ANGLE}, kinds, {ANGLE}, {PREFIX}, {KEYS}, {ANGLE}, {ANGLE}, {ANGLE}, {_near('len(x.keys)', 'len(y.keys)')}])::double, 5) as value from q""")
def function_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = similarity.functions(_pair_structs(spark, sf_dir))
    return v.select("id", F.posexplode("similarity").alias("pos", "value")).withColumn("value", F.round("value", 5))


BLOCK_ANGLE = "1 - acos(least(dot / len, 1))"


@query(f"""with {PAIRS} select id, unnest(range(13))::int as pos, round(unnest([{_near('x.size', 'y.size')}, (x.h = y.h)::int, (x.h = y.h)::int, {_near('x.n', 'y.n')}, {_near('len(x.keys)', 'len(y.keys)')}, (x.seq[1] = y.seq[1])::int, kinds, {BLOCK_ANGLE}, kinds, {BLOCK_ANGLE}, kinds, {BLOCK_ANGLE}, {_near('len(x.keys)', 'len(y.keys)')}])::double, 5) as value from q""")
def block_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = similarity.blocks(_pair_structs(spark, sf_dir))
    return v.select("id", F.posexplode("similarity").alias("pos", "value")).withColumn("value", F.round("value", 5))


# --- the store ------------------------------------------------------------------------------------------------------------


@query(f"with {BINARIES} select id from b")
def binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.ids(binaries(spark, sf_dir))


@query(f"with {BINARIES} select id, path from b where id in (select o_orderkey from orders where o_orderpriority = '1-URGENT')")
def binaries_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return store.among(binaries(spark, sf_dir), "id", wanted).select("id", "path")


@query(f"with {BINARIES} select id, path from b where sha256(path) = sha256('/bin/7')")
def binary_of_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = binaries(spark, sf_dir).withColumn("sha256", F.unhex(F.sha2("path", 256)))
    import hashlib

    return store.binary(b, sha256=hashlib.sha256(b"/bin/7").digest()).select("id", "path")


@query(f"with {FUNCTIONS} select f.id, name, callee, caller from f where binary_id = 7 and name = (select name from f where binary_id = 7 and pos = 1)")
def callers_and_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = functions(spark, sf_dir)
    first = f.where("binary_id = 7 and pos = 1").select("name").first()
    found = store.callers_callees(f, binaries(spark, sf_dir), "/bin/7", first["name"] if first else "")
    return found.select("id", "name", F.get("callees", F.lit(0)).alias("callee"), F.get("callers", F.lit(0)).alias("caller"))


@query(f"with {FUNCTIONS}, {BINARIES} select f.id, name from f join b on b.id = binary_id where path = '/bin/7' and pos % 2 = 1 union all select f.id, name from f join b on b.id = binary_id where path = '/bin/14'")
def global_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global symbols of one binary; in inference all symbols of another."""
    f = functions(spark, sf_dir).withColumn("binding", F.when(F.col("pos") % 2 == 1, "GLOBAL").otherwise("LOCAL"))
    b = binaries(spark, sf_dir)
    return store.global_symbols(f, b, "/bin/7").select("id", "name").unionByName(store.global_symbols(f, b, "/bin/14", inference=True).select("id", "name"))


@query("select kind, count(*) as n from (select case o_orderstatus when 'F' then 'executable' when 'O' then 'shared_library' else 'object' end as kind from orders) group by kind union all select kind || ' functions', count(*) from (select case o_orderstatus when 'F' then 'executable' when 'O' then 'shared_library' else 'object' end as kind from lineitem join orders on o_orderkey = l_orderkey) group by kind")
def six_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the views of binaries and of their functions, by kind."""
    b, f, out = binaries(spark, sf_dir), lines(spark, sf_dir), None
    for kind in ("executable", "shared_library", "object"):
        for name, df in ((kind, store.of_kind(b, kind)), (f"{kind} functions", store.functions_of_kind(f, b, kind))):
            n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
            out = n if out is None else out.unionByName(n)
    return out.where("n > 0")


@query("select n_name as name, min(p_partkey) as id from nation join part on p_brand like 'Brand#' || n_nationkey || '%' group by n_name")
def prototypes_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string"), F.lit("%")).alias("name"), "n_name")
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("id"))
    found = store.resolve_prototypes(n.select("name"), p, like=True)
    return n.join(found.select("name", "id"), "name").select(F.col("n_name").alias("name"), "id")


@query("select distinct unnest([l_partkey, l_suppkey]) as constant from lineitem")
def all_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.constants(lineitem(spark, sf_dir).select(F.array("l_partkey", "l_suppkey").alias("c")), F.col("c"))


@query("select p_partkey, p_name from part where p_brand in ('Brand#1', 'Brand#2') and p_type = 'ECONOMY'")
def selected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"p_brand": ["Brand#1", "Brand#2"], "p_type": ["ECONOMY"], "p_size": [1]}
    return store.selected(table(spark, sf_dir, "part"), wanted, ["p_brand", "p_type"], ["p_partkey", "p_name"])


@query("select p_partkey, ['debian', 'ubuntu', 'arch'][p_size % 3 + 1] as distribution, ['clang', 'gcc'][p_size % 2 + 1] as compiler, 'o' || p_size % 4 as optimisation, 'b' || p_partkey as bin_name from part")
def path_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda items, c: F.element_at(F.array(*map(F.lit, items)), (c + 1).cast("int"))
    s = F.col("p_size")
    path = F.concat_ws("/", F.lit("/data"), pick(["debian", "ubuntu", "arch"], s % 3), pick(["clang", "gcc"], s % 2), F.concat(F.lit("o"), (s % 4).cast("string")), F.concat(F.lit("b"), F.col("p_partkey").cast("string")))
    return store.path_fields(table(spark, sf_dir, "part").select("p_partkey", path.alias("path")), "path", ["distribution", "compiler", "optimisation", "bin_name"]).drop("path")


@query("select c_custkey as id, s_suppkey as callee from customer join supplier on c_custkey % 1000 >= s_suppkey * 5 and c_custkey % 1000 < s_suppkey * 5 + 3 and s_nationkey = c_nationkey")
def callers_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The function that holds a calling address, in the same binary."""
    calls = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("binary_id"), (F.col("c_custkey") % 1000).alias("vaddr"))
    f = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("binary_id"), (F.col("s_suppkey") * 5).alias("vaddr"), F.lit(3).alias("size"), F.col("s_suppkey").alias("callee"))
    return store.functions_at(calls, f, 4).select("id", "callee")


@query(f"with {FUNCTIONS} select binary_id, src, dst from (select binary_id, 'fn_' || pos as src, 'fn_' || (pos + 1) as dst, callee from f) where callee is not null")
def relabelled_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = functions(spark, sf_dir)
    nodes = f.select("binary_id", F.col("id").alias("node"), F.concat(F.lit("fn_"), F.col("pos").cast("string")).alias("name"))
    edges = line_edges(spark, sf_dir).withColumn("binary_id", F.expr("src div 100"))
    return graph.relabelled(edges, nodes)


@query(f"with {EDGES} select src // 100 as graph, src, dst from e")
def dot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs as DOT texts, one line each, written and read back."""
    e = line_edges(spark, sf_dir).withColumn("graph", F.expr("src div 100"))
    path = scratch(spark, "dot")
    graph.dot_texts(e).write.parquet(path)
    back = graph.parse_dot(spark.read.parquet(path))
    return back.select("graph", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query("select vec_id as id, label from embeddings where vec_id % 2 = 0 order by vec_id limit 50")
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader's own limit of rows."""
    e = table(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 0, F.col("embedding")).alias("vector"))
    return store.feature_vectors(e.select(F.col("vec_id").alias("id")), v, 50).join(e.select(F.col("vec_id").alias("id"), "label"), "id").select("id", "label")


@query(f"with {FUNCTIONS} select id, name from f where name in ('cold rod', 'red bolt') union all select id, name from (select f.id, name, '/bin/' || binary_id as path from f) where regexp_matches(path, '/bin/1[0-9]$')")
def symbols_by_name_and_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = functions(spark, sf_dir)
    chosen = store.binaries_like(binaries(spark, sf_dir), "/bin/1[0-9]$").select("id")
    return store.symbols_named(f, ["cold rod", "red bolt"]).select("id", "name").unionByName(store.among(f, "binary_id", chosen).select("id", "name"))


@query("""with n as (select o_orderkey as k, '/new/' || o_orderkey as path from orders where o_orderkey % 3 = 0), c as (select l_orderkey, count(*) as c from lineitem group by 1)
  select 'binaries' as kind, ((select count(*) from n) + (select count(*) from orders))::bigint as n union all select 'functions', ((select count(*) from lineitem) + (select sum(c) from c join n on k = l_orderkey))::bigint""")
def analysed_binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third order comes as an analysed binary of a new path with its lines nested; how many rows the store then has."""
    stored = binaries(spark, sf_dir).withColumn("id", F.col("id").cast("long"))
    f = lines(spark, sf_dir).select("id", "binary_id", "size")
    nested = f.groupBy(F.col("binary_id").alias("k")).agg(F.sort_array(F.collect_list(F.struct("size"))).alias("functions"))
    new = stored.where("id % 3 = 0").join(nested.withColumnRenamed("k", "id"), "id", "left").select(F.concat(F.lit("/new/"), F.col("id").cast("string")).alias("path"), "bin_type", F.coalesce("functions", F.array().cast("array<struct<size:double>>")).alias("functions"))
    b, g = io.add_analysed(stored, f, new)
    b, g = io.add_analysed(b, g, new)  # again: replaced, not doubled
    return b.agg(F.count("*").alias("n")).select(F.lit("binaries").alias("kind"), "n").unionByName(g.agg(F.count("*").alias("n")).select(F.lit("functions").alias("kind"), "n"))


# --- texts and chunks -----------------------------------------------------------------------------------------------------


@query("select p_partkey::int as idx, p_name || ':x' as label from part")
def numbered_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("idx"), F.concat("p_name", F.lit(":x")).alias("label"))
    path = scratch(spark, "labels")
    io.numbered_lines(p, "label").select("value").write.text(path)
    return io.parse_numbered(io.non_blank_lines(spark, path))


@query("select p_name as function_name, array_to_string(list_filter(string_split(replace(p_name, ' ', '_'), '_'), lambda x: x <> ''), ',') as labels from part where p_size % 4 <> 0")
def name_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_size") % 4 == 0, "more"))
    path = scratch(spark, "names")
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return _joined(io.name_dataset(io.non_blank_lines(spark, path)), "labels")


@query("select 'w' || vec_id as word, unnest(range(64))::int as pos, round(unnest(embedding)::double, 6) as value from embeddings")
def word_vector_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    numbers = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " ")
    path = scratch(spark, "vectors")
    head = spark.createDataFrame([("5 64",)], "value string")
    head.unionByName(e.select(F.concat(F.lit("w"), F.col("vec_id").cast("string"), F.lit(" "), numbers).alias("value"))).write.text(path)
    v = io.word_vectors(io.non_blank_lines(spark, path))
    return _rounded(v.select("word", F.posexplode("vector").alias("pos", "value")), "value")


@query("select 'p' || c_nationkey as path, 'f' || (c_custkey % 5) as name, string_agg(distinct 'a' || (c_custkey % 11), ',' order by 'a' || (c_custkey % 11)) as callees, coalesce(string_agg(distinct c_mktsegment, ',' order by c_mktsegment) filter (c_acctbal > 0), '') as callers from customer group by 1, 2")
def merged_xrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    c = table(spark, sf_dir, "customer")
    calls = F.when(F.col("c_acctbal") > 0, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>"))
    r = c.select(n("p", F.col("c_nationkey")).alias("path"), n("sub.f", F.col("c_custkey") % 5).alias("name"), F.array(n("a", F.col("c_custkey") % 11)).alias("ct"), calls.alias("cf"))
    return _joined(io.merge_xrefs(r, F.regexp_replace("name", r"^sub\.", "")), "callees", "callers")


@query("select c_mktsegment as experiment, 'k' || (c_custkey % 3) as key, arg_max(c_name, c_custkey) as value from customer group by 1, 2")
def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return io.latest_results(c.select(F.col("c_mktsegment").alias("experiment"), F.concat(F.lit("k"), (F.col("c_custkey") % 3).cast("string")).alias("key"), F.col("c_name").alias("value"), F.col("c_custkey").alias("ts")))


@query("select l_orderkey, l_linenumber, ((row_number() over (partition by l_orderkey order by l_linenumber) - 1) // 3)::bigint as chunk from lineitem")
def chunked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.chunks_of_size(lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber"), 3, "l_linenumber", ["l_orderkey"])
    return c.withColumn("chunk", F.col("chunk").cast("long"))


@query("select l_orderkey, l_linenumber, ntile(2) over (partition by l_orderkey order by l_linenumber)::int - 1 as chunk from lineitem")
def even_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.n_chunks(lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber"), 2, "l_linenumber", ["l_orderkey"])
