"""The operators as queries over the driver's tables, each with SQL for the same rows where SQL can express it.

The tables stand in for the corpus: an order is a binary, its lines are functions in order, a part's name is a symbol, the
part on the next line is a callee, a user's events are opcodes, an embedding is a row of 64 label scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanbin.operators import dataflow, features, graph, intervals, knn, learning, lm, metrics, names, similarity, store, vocab
from gleanbin.plans.tables import scratch
from gleanbin.sources import io

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


#: Lines of an order are numbered anew, as some numbers stand twice.
NUMBERED = "li as (select * replace (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)::int as l_linenumber) from lineitem)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql and "lineitem" in sql:
            head = "with recursive " if sql.startswith("with recursive ") else "with "
            rest = sql.removeprefix(head).replace("lineitem", "li")
            ORACLES[f.__name__] = head + NUMBERED + (", " if sql.startswith(head) else " ") + rest
        elif sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- stand-ins ----------------------------------------------------------------------------------------------------------


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.row_number().over(w))


def binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "executable").when(F.col("o_orderstatus") == "O", "shared_library").otherwise("object")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("/bin/"), F.col("o_orderkey").cast("string")).alias("path"), kind.alias("bin_type"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """binary_id, pos, id, part, size."""
    return lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("binary_id"), F.col("l_linenumber").alias("pos"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("size"))


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their part's name, and the next and last part's names as callees and callers."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"))
    f = lines(spark, sf_dir).join(part, "part")
    w = W.partitionBy("binary_id").orderBy("pos")
    some = lambda c: F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    return f.withColumns({"callees": some(F.lead("name").over(w)), "callers": some(F.lag("name").over(w))})


FUNCTIONS = """f as (select l_orderkey as binary_id, l_linenumber as pos, l_orderkey * 100 + l_linenumber as id, l_partkey as part, l_quantity as size, p_name as name,
  lead(p_name) over (partition by l_orderkey order by l_linenumber) as callee, lag(p_name) over (partition by l_orderkey order by l_linenumber) as caller
  from lineitem join part on p_partkey = l_partkey)"""
BINARIES = "b as (select o_orderkey as id, '/bin/' || o_orderkey as path, case o_orderstatus when 'F' then 'executable' when 'O' then 'shared_library' else 'object' end as bin_type from orders)"
LABELS = "l as (select distinct doc_id as row, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as label from documents)"
SCORES = "s as (select vec_id as row, unnest(range(64))::int as label, round(unnest(embedding)::double, 6) as score, label as class from embeddings)"
TRUTH = "t as (select row, label from s where label % 7 = class % 7)"


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.labels_of(table(spark, sf_dir, "documents"), "doc_id", vocab.alpha_numeric(F.col("text")))


def label_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scores (row, label, score), and the truth: every seventh label from the class on."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("label").alias("class"), F.posexplode("embedding").alias("label", "score"))
    s = e.withColumn("score", F.round(F.col("score").cast("double"), 6))
    return s.select("row", "label", "score"), s.where(F.col("label") % 7 == F.col("class") % 7).select("row", "label")


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: from each line of an order to the next."""
    f = lines(spark, sf_dir).select("binary_id", "pos", "id")
    return f.join(f.select("binary_id", (F.col("pos") - 1).alias("pos"), F.col("id").alias("dst")), ["binary_id", "pos"]).select(F.col("id").alias("src"), "dst")


EDGES = "e as (select a.l_orderkey * 100 + a.l_linenumber as src, b.l_orderkey * 100 + b.l_linenumber as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber + 1 = b.l_linenumber)"


# --- vocabularies -------------------------------------------------------------------------------------------------------


@query(f"""with {LABELS}, k as (select label, count(*) as n from l group by label order by n desc, label limit 1024), c as (select * from k where n > 3),
  p as (select row, label from l join c using (label)), n as (select count(distinct row) as n from p)
  select label, n_t, round(1 + (ln(n.n) - 1) * pow(1.425, 0.5) * exp(-0.5 * ln(n_t + 0.425)), 6) as inv_prop from (select label, count(*) as n_t from p group by label), n""")
def propensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.propensities(doc_labels(spark, sf_dir), 1024).withColumn("inv_prop", F.round("inv_prop", 6))


@query(f"with {LABELS} select label, count(*) as n from l group by label order by n desc, label limit 1024")
def label_space_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.label_space(doc_labels(spark, sf_dir), 1024)


@query(f"with {LABELS}, k as (select label, count(*) as n from l group by label order by n desc, label limit 256) select row, label from l join k using (label) where n > 3")
def preconditioned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.preconditioned(doc_labels(spark, sf_dir), 256)


@query("select o_orderkey, case when p < 80 then 'train' when p < 90 then 'validate' else 'test' end as split from (select o_orderkey, ('0x' || substr(md5(o_orderkey::varchar), 1, 4))::int % 100 as p from orders)")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.hash_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("select o_orderkey, case when h < 0.9 then 'train' when h < 0.95 then 'validate' else 'test' end as split from (select o_orderkey, ('0x' || substr(md5('r1' || o_orderkey), 1, 8))::bigint / 4294967296.0::double as h from orders)")
def reshuffled_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.reshuffled(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "r1")


@query("select (props::json->>'$.k')::bigint as constant, count(*) as n from events where (props::json->>'$.k')::bigint > 16 group by 1 having count(*) > 5 and count(*) < 5000")
def constants_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.array(F.get_json_object("props", "$.k").cast("long")).alias("c"))
    return store.constants_band(e, F.col("c"), 5, 5000, 16)


# --- store ---------------------------------------------------------------------------------------------------------------


@query(f"with {FUNCTIONS}, {BINARIES} select f.id, name, path from f join b on b.id = binary_id where path like '/bin/1%'")
def binary_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = functions(spark, sf_dir).select("id", "binary_id", "name")
    b = binaries(spark, sf_dir).where(F.col("path").like("/bin/1%"))
    return store.binary_symbols(f, b, F.col("path")).select("id", "name", "path")


@query(f"with {FUNCTIONS}, {BINARIES} select f.id, name from f where binary_id in (select id from b where bin_type = 'executable')")
def executables_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.functions_of_kind(functions(spark, sf_dir), binaries(spark, sf_dir), "executable").select("id", "name")


@query("select distinct s_name as name from supplier join lineitem on l_suppkey = s_suppkey")
def dynamic_imports_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.dynamic_imports(importing_functions(spark, sf_dir))


@query(f"with {FUNCTIONS} select distinct callee as name from f where callee is not null")
def callees_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.elements(functions(spark, sf_dir), "callees")


@query(f"with {FUNCTIONS} select distinct x as name from (select name as x from f union all select callee from f union all select caller from f) where x is not null")
def referenced_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.referenced_names(functions(spark, sf_dir))


@query(f"with {FUNCTIONS} select '/bin/' || binary_id as path, (count(callee) + count(caller))::bigint as n from f group by binary_id")
def xref_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = functions(spark, sf_dir).withColumn("path", F.concat(F.lit("/bin/"), F.col("binary_id").cast("string")))
    return store.xref_counts(f).withColumn("n", F.col("n").cast("long"))


@query(f"with {FUNCTIONS} select binary_id, callee as name, string_agg(distinct name, ',' order by name) as callers from f where callee is not null group by binary_id, callee")
def callers_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.callers_of(functions(spark, sf_dir)).withColumn("callers", F.array_join("callers", ","))


@query("with r as (select n_nationkey as id, n_name as name from nation union all select 1000 + n_nationkey, n_name from nation) select s_suppkey, n_name as name, n_nationkey as id from supplier join nation on n_nationkey = s_nationkey")
def resolved_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    p = n.unionByName(n.withColumn("id", F.col("id") + 1000))
    s = table(spark, sf_dir, "supplier").join(n.select(F.col("id").alias("s_nationkey"), "name"), "s_nationkey").select("s_suppkey", "name")
    return s.join(store.resolve_prototypes(s.select("name").distinct(), p).select("name", "id"), "name").select("s_suppkey", "name", F.col("id").cast("int").alias("id"))


@query("select id, v from (select vec_id as id, label * 2 as v from embeddings where vec_id % 3 = 0 union all select vec_id, label from embeddings where vec_id % 3 <> 0 union all select vec_id + 1000000, label * 2 from embeddings where vec_id % 3 = 0)")
def upsert_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("v"))
    new = stored.where("id % 3 = 0").withColumn("v", F.col("v") * 2)
    return io.upsert(stored, new.unionByName(new.withColumn("id", F.col("id") + 1_000_000)), ["id"])


@query("select * from (select vec_id as row, (unnest(range(64)))::int as idx, round(unnest(embedding)::double, 6) as value from embeddings) where value <> 0")
def xml_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the matrix as text and reads the files back."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.max("vec_id")).first()[0] or 0
    entries = e.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("idx", "value")).withColumn("value", F.col("value").cast("double"))
    path = scratch(spark, "matrix")
    io.write_matrix(entries, n + 1, 64, path)
    return io.read_matrix(spark, path).where("value <> 0").select("row", "idx", F.round("value", 6).alias("value"))


# --- names ---------------------------------------------------------------------------------------------------------------


@query("select c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '#', '_'), '_+[0-9]+$', ''), '[_.]+$', '') as bare from customer")
def strip_decorations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("symbol", F.concat(F.lit("sym.imp."), F.replace("c_name", F.lit("#"), F.lit("_")), F.lit(".isra.0")))
    return c.select("c_custkey", names.strip_decorations(F.col("symbol")).alias("bare"))


@query(r"select p_partkey, array_to_string(list_sort(list_distinct(string_split(regexp_replace(p_brand || p_name, '([a-z])([A-Z])', '\1 \2', 'g'), ' '))), ',') as words from part where not regexp_matches(p_brand || p_name, ' ') union all select p_partkey, array_to_string(list_sort(list_distinct(string_split(regexp_replace(replace(p_brand || p_name, ' ', ''), '([a-z])([A-Z])', '\1 \2', 'g'), ' '))), ',') from part where regexp_matches(p_brand || p_name, ' ')")
def camel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.replace(F.concat("p_brand", "p_name"), F.lit(" "), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(names.camel_words(joined)), ",").alias("words"))


@query("""with p as (select a.p_partkey, a.p_name as a, b.p_name as b from part a join part b on b.p_partkey = a.p_partkey + 1),
  w as (select *, list_filter(list_distinct(regexp_extract_all(lower(a), '[a-z0-9]+')), lambda x: length(x) > 2) as wa, list_filter(list_distinct(regexp_extract_all(lower(b), '[a-z0-9]+')), lambda x: length(x) > 2) as wb from p),
  j as (select *, len(list_intersect(wa, wb)) as i, len(list_distinct(list_concat(wa, wb))) as u from w)
  select p_partkey, case when contains(a, b) or contains(b, a) then true when 1 - levenshtein(a, b)::double / greatest(length(a), length(b)) >= 0.5 then true
    when u > 0 and 1 - i::double / u < 0.36787968862663154641 then true else coalesce(u > 0 and 1 - i::double / u < 1 - 0.36787968862663154641, false) end as similar from j""")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"))
    pairs = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")
    return pairs.select("p_partkey", names.similar(F.col("a"), F.col("b")).alias("similar"))


@query()
def segment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    tokens = part.select(F.explode(vocab.alpha_numeric(F.col("p_name"))).alias("token"))
    known = names.Dictionary(names.corpus_words(tokens, "token", 3, 2000))
    return names.segmented(part.select("p_partkey", F.concat(F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("")), F.lit("64")).alias("symbol")), "symbol", known)


# --- features -------------------------------------------------------------------------------------------------------------


@query("""with v as (select l_orderkey * 100 + l_linenumber as row, unnest([0, 1, 2]) as pos, unnest([l_quantity, l_extendedprice, l_discount]) as value from lineitem),
  s as (select pos, avg(value) as m, stddev_pop(value) as d from v group by pos) select row, pos::int as pos, round((value - m) / (case when d = 0 then 1 else d end), 5) as value from v join s using (pos)""")
def scale_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lineitem(spark, sf_dir).select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row"), F.array("l_quantity", "l_extendedprice", "l_discount").alias("v"))
    v = features.long_form(l, "row", "v")
    return features.scaled(v, features.scaler(v)).withColumn("value", F.round("value", 5))


@query(f"with {FUNCTIONS}, o as (select binary_id, name, max(id) as id from f group by binary_id, name) select o.binary_id, 0 as pos, round(avg(size), 6) as value from o join f using (id) group by o.binary_id")
def binary_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = functions(spark, sf_dir)
    values = f.select(F.col("id").alias("row"), F.lit(0).alias("pos"), F.col("size").cast("double").alias("value"))
    return features.binary_context(f.withColumn("real_name", F.col("name")), values).withColumn("value", F.round("value", 6))


@query(f"with {EDGES}, n as (select src as row, dst as near from e union select dst, src from e) select row, 0 as pos, round(avg(l_quantity), 6) as value from n join lineitem on l_orderkey * 100 + l_linenumber = near group by row")
def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = lines(spark, sf_dir).select(F.col("id").alias("row"), F.lit(0).alias("pos"), F.col("size").cast("double").alias("value"))
    return features.neighbour_context(line_edges(spark, sf_dir), values).withColumn("value", F.round("value", 6))


@query(f"with {LABELS}, k as (select label, (row_number() over (order by label) - 1)::int as idx from (select label from (select label, count(*) as n from l group by label order by n desc, label limit 200))) select row, idx from l join k using (label)")
def sparse_multi_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = doc_labels(spark, sf_dir)
    v = vocab.indexed(vocab.label_space(labels, 200).select("label"), "label").withColumnRenamed("label", "item")
    return features.multi_hot(labels.withColumnRenamed("label", "item"), v)


@query("with k as (select event_type as item, (row_number() over (order by event_type) - 1)::int as idx from (select distinct event_type from events)) select user_id as row, idx, count(*) as n from events join k on item = event_type group by user_id, idx")
def count_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("row"), F.col("event_type").alias("item"))
    return features.counted(e, vocab.indexed(e.select("item").distinct(), "item"))


@query("select s_suppkey, array_to_string([(r in ('rax'))::int, (r in ('rbx','rcx','rdx','r0','r1','r2','r3','r4','r5','r6','r7','r8','r9','r10','r11','r12','r13','r14','r15'))::int, (r = 'rsp')::int, 0, (r = 'rbp')::int, 0, 0, 0], '') as bits from (select s_suppkey, ['rax', 'rbx', 'r9', 'rsp', 'rbp', 'rsi'][(s_nationkey % 6) + 1] as r from supplier)")
def register_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.element_at(F.array(*map(F.lit, ["rax", "rbx", "r9", "rsp", "rbp", "rsi"])), F.col("s_nationkey") % 6 + 1)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.transform(features.register_classes(F.array(r)), lambda x: x.cast("int").cast("string")), "").alias("bits"))


@query("""with c as (select user_id, event_type, count(distinct event_id % 5) as n from events group by user_id, event_type)
  select user_id, count(*)::double as callees, sum(n)::double as registers from c group by user_id""")
def taint_arg_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.concat(F.lit("r"), (F.col("event_id") % 5).cast("string")).alias("reg"))
    to = e.groupBy("user_id", "event_type").agg(F.collect_set("reg").alias("regs")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "regs"))).alias("to"))
    v = features.taint_argument_vector(F.create_map(F.lit("rdi"), F.col("to")))
    return to.select("user_id", v[0].alias("callees"), v[1].alias("registers"))


@query("select user_id, sha256(string_agg(event_type, chr(10) order by ts, event_id)) as hash from events group by user_id")
def opcode_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.sequence_hash(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("select h as hash, count(*) as n from (select sha256(string_agg(l_returnflag || l_linestatus, chr(10) order by l_linenumber)) as h from lineitem group by l_orderkey) group by h having count(*) > 5")
def frequent_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lineitem(spark, sf_dir).withColumn("op", F.concat("l_returnflag", "l_linestatus"))
    return store.frequent(features.sequence_hash(l, ["l_orderkey"], ["l_linenumber"], "op"), "hash", above=5)


@query("select user_id as row, " + ", ".join(f"min(('0x' || substr(md5('1337:{k}:' || event_type || (event_id % 10)), 1, 8))::bigint) as h{k}" for k in range(8)) + " from events group by user_id")
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "events").select(F.col("user_id").alias("row"), F.concat("event_type", (F.col("event_id") % 10).cast("string")).alias("item"))
    return features.minhash(items, 8).select("row", *[F.col("signature")[k].alias(f"h{k}") for k in range(8)])


# --- graphs --------------------------------------------------------------------------------------------------------------


@query(f"with recursive {EDGES}, r as (select src, dst from e union select r.src, e.dst from r join e on e.src = r.dst) select src, dst from r union select src, src from e")
def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transitive_closure(line_edges(spark, sf_dir))


@query(f"with {EDGES}, n as (select src as node from e union select dst from e), s as (select node, node // 100 as o from n), m as (select l_orderkey, l_linenumber, l_linenumber - row_number() over (partition by l_orderkey order by l_linenumber) as run from (select distinct l_orderkey, l_linenumber from lineitem)) select l_orderkey * 100 + l_linenumber as node, min(l_orderkey * 100 + l_linenumber) over (partition by l_orderkey, run) as component from m join n on node = l_orderkey * 100 + l_linenumber")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(line_edges(spark, sf_dir))


@query(f"with {EDGES}, n as (select l_orderkey * 100 + l_linenumber as node, l_returnflag as label from lineitem), s as (select e.src as node, string_agg(label, ',' order by label) as near from (select distinct * from e) e join n on n.node = e.dst group by e.src) select n.node, md5(label || '|' || coalesce(near, '')) as label from n left join s using (node)")
def wl_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = lineitem(spark, sf_dir).select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("node"), F.col("l_returnflag").alias("label"))
    return graph.weisfeiler_lehman(nodes, line_edges(spark, sf_dir))


@query(f"with {EDGES}, b as (select src // 100 as graph, src as node, dst as near from e union select src // 100, dst, src from e), d as (select graph, node, count(*) as d from b group by all) select b.graph, b.node, d1.d as degree, min(d2.d) as near_min, max(d2.d) as near_max, round(avg(d2.d), 6) as near_mean, round(stddev_pop(d2.d), 6) as near_std from b join d d1 on d1.node = b.node join d d2 on d2.node = b.near group by b.graph, b.node, d1.d")
def degree_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = line_edges(spark, sf_dir).select(F.expr("src div 100").alias("graph"), "src", "dst")
    return graph.degree_profile(e).withColumns({"near_mean": F.round("near_mean", 6), "near_std": F.round("near_std", 6)})


@query(f"with {EDGES} select a.src as u, a.dst as v, b.dst as x from e a join e b on a.dst = b.src")
def two_hop_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.two_hop_paths(line_edges(spark, sf_dir))


IMPORTING = f"{FUNCTIONS}, i as (select binary_id, name, callee, s_name from f join (select l_orderkey, l_linenumber, l_suppkey from lineitem) on l_orderkey = binary_id and l_linenumber = pos join supplier on s_suppkey = l_suppkey)"


def importing_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """functions() that also call their supplier's name, which no binary defines."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    l = lineitem(spark, sf_dir).select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), "l_suppkey").join(s, "l_suppkey").select("id", "s_name")
    return functions(spark, sf_dir).join(l, "id").withColumn("callees", F.concat("callees", F.array("s_name"))).drop("s_name")


@query(f"with {IMPORTING}, n as (select binary_id, name, 'defined' as role from i union select binary_id, s_name, 'import' from i) select binary_id, name, role from n")
def node_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = importing_functions(spark, sf_dir).select("binary_id", "id", F.col("name").alias("real_name"), "callees", "callers", F.col("id").alias("vaddr"), F.lit("GLOBAL").alias("binding"), "size")
    return graph.call_nodes(f, graph.call_edges(f)).select("binary_id", "name", "role")


FLOWS = "x as (select distinct l_orderkey * 100 + l_linenumber as func, l_partkey % 3 as arg, l_orderkey * 100 + l_linenumber + 1 as callee, l_suppkey % 3 as reg from lineitem)"


@query(f"with recursive {FLOWS}, r as (select * from x union select r.func, r.arg, x.callee, x.reg from r join x on x.func = r.callee and x.arg = r.reg) select func, arg, callee, reg from r")
def taint_flow_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line is a function that calls the next: one argument in, one register out."""
    own = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return graph.taint_closure(lineitem(spark, sf_dir).select(own.alias("func"), (F.col("l_partkey") % 3).alias("arg"), (own + 1).alias("callee"), (F.col("l_suppkey") % 3).alias("reg")))


# --- intervals -----------------------------------------------------------------------------------------------------------


@query("select l_orderkey * 100 + l_linenumber as id, s_suppkey from lineitem join supplier on l_partkey >= s_suppkey * 10 and l_partkey < s_suppkey * 10 + 15")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = lines(spark, sf_dir).select("id", F.lit(0).alias("k"), F.col("part").alias("at"))
    held = table(spark, sf_dir, "supplier").select(F.lit(0).alias("k"), (F.col("s_suppkey") * 10).alias("start"), (F.col("s_suppkey") * 10 + 15).alias("end"), "s_suppkey")
    return intervals.lookup(points, held, ["k"], 16).select("id", "s_suppkey")


@query("select start, \"end\", (select count(*) from part where p_partkey >= start and p_partkey + p_size % 4 + 1 <= \"end\") as n from (select distinct s_suppkey * 10 as start, s_suppkey * 10 + 15 as \"end\" from supplier)")
def envelop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = table(spark, sf_dir, "supplier").select(F.lit(0).alias("k"), (F.col("s_suppkey") * 10).alias("start"), (F.col("s_suppkey") * 10 + 15).alias("end"))
    inner = table(spark, sf_dir, "part").select(F.lit(0).alias("k"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size") % 4 + 1).alias("end"))
    return intervals.enveloped(outer, inner, ["k"], 16).select("start", "end", "n")


@query("with l as (select distinct l_orderkey as function_id, l_partkey as start from lineitem), m as (select l_orderkey as function_id, max(l_partkey) + 8 as stop from lineitem group by 1) select function_id, start, coalesce(lead(start) over (partition by function_id order by start), stop) as \"end\" from l join m using (function_id)")
def block_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lines(spark, sf_dir).select(F.col("binary_id").alias("function_id"), F.col("part").alias("address"))
    return intervals.blocks(l, l.groupBy("function_id").agg((F.max("address") + 8).alias("end")))


@query("select c_custkey // 10 as function_id, count(distinct c_custkey) filter (c_acctbal > 0 and c_acctbal < 5000) as stack_vars, count(distinct c_custkey) filter (c_acctbal >= 5000) as stack_args, count(distinct c_custkey) filter (c_acctbal <= 0) as heap_vars from (select c_custkey, c_acctbal from customer where floor(c_acctbal) = floor(c_acctbal)) group by 1")
def memory_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    # a cell of its own for each customer: the band by balance
    at = F.when(F.col("c_acctbal") >= 5000, 1_000_000_000 + F.col("c_custkey") % 4096).when(F.col("c_acctbal") > 0, 500_000_000 + F.col("c_custkey")).otherwise(F.col("c_custkey"))
    cells = c.select(F.expr("c_custkey div 10").alias("function_id"), F.concat(F.lit("m_0x"), F.lower(F.hex(at))).alias("cell"), F.lit(1_000_000_000).alias("stack_start"), F.lit(100_000_000).alias("stack_end"))
    return intervals.memory_bands(cells)


# --- data flow -----------------------------------------------------------------------------------------------------------


@query("""with a as (select s_nationkey as callee, list_distinct(list('r' || (s_suppkey % 4))) as args from supplier group by 1), x as (select l_orderkey as function_id, l_suppkey % 25 as callee, list_distinct(list('r' || (l_partkey % 6))) as args from lineitem group by 1, 2)
  select function_id, callee::bigint as callee, array_to_string(list_sort(list_intersect(x.args, a.args)), ',') as args from x join a using (callee) where len(list_intersect(x.args, a.args)) > 0""")
def flow_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = lambda c, n: F.concat(F.lit("r"), (F.col(c) % n).cast("string"))
    a = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("name")).agg(F.collect_set(reg("s_suppkey", 4)).alias("arguments"))
    x = lineitem(spark, sf_dir).groupBy(F.col("l_orderkey").alias("function_id"), (F.col("l_suppkey") % 25).alias("callee")).agg(F.collect_set(reg("l_partkey", 6)).alias("args"))
    return dataflow.reduced_flows(x, a).withColumn("args", F.array_join("args", ","))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as statements of one function an order, a block a line."""
    reg = lambda c, n: F.concat(F.lit("r"), (F.col(c) % n).cast("string"))
    l = lineitem(spark, sf_dir)
    return l.select(F.col("l_orderkey").alias("function_id"), F.col("l_linenumber").alias("bb_idx"), F.lit(0).alias("stmt_idx"), F.array(reg("l_partkey", 5)).alias("inputs"), F.array(reg("l_suppkey", 5)).alias("outputs"))


def _flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_edges(spark, sf_dir).select(F.expr("src div 100").alias("function_id"), (F.col("src") % 100).cast("int").alias("src"), (F.col("dst") % 100).cast("int").alias("dst"))


LIVE = """with recursive x as (select l_orderkey as f, l_linenumber as i, 'r' || (l_partkey % 5) as g, 'r' || (l_suppkey % 5) as k from lineitem), r as (select f, i, g as v from x union select x.f, x.i, r.v from r join x on x.f = r.f and x.i = r.i - 1 and x.k <> r.v)
  select f as function_id, i as bb_idx, string_agg(v, ',' order by v) as live_in from r group by f, i"""


@query(LIVE)
def liveness_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = dataflow.block_liveness(_statements(spark, sf_dir))
    return dataflow.live_variables(blocks, _flow_edges(spark, sf_dir)).select("function_id", "bb_idx", F.array_join("live_in", ",").alias("live_in"))


@query("""with recursive x as (select l_orderkey as f, l_linenumber as i, 'r' || (l_partkey % 5) as a, 'r' || (l_suppkey % 5) as b from lineitem),
  r as (select f, i, case when a in ('r0', 'r1') then list_distinct(['r0', 'r1', b]) else list_filter(['r0', 'r1'], lambda v: v <> b) end as t from x where i = 1
    union all select x.f, x.i, case when list_contains(t, a) then list_distinct(list_append(t, b)) else list_filter(t, lambda v: v <> b) end from r join x on x.f = r.f and x.i = r.i + 1)
  select f as function_id, i as bb_idx, array_to_string(list_sort(t), ',') as tainted from r""")
def taint_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _statements(spark, sf_dir).select("function_id", "bb_idx", F.when(F.col("bb_idx") == 1, F.array(F.lit("r0"), F.lit("r1"))).otherwise(F.array().cast("array<string>")).alias("sources"), F.array(F.struct("inputs", "outputs")).alias("statements"))
    return _joined(dataflow.tainted_variables(s, _flow_edges(spark, sf_dir)), "tainted")


STEP = "case when o = 1 then p when coalesce(case a when 0 then r0 when 1 then r1 when 2 then r2 else r3 end, -1) < 0 then -1 else (case a when 0 then r0 when 1 then r1 when 2 then r2 else r3 end) + 8 end"


@query(f"""with recursive x as (select l_orderkey as f, l_linenumber as i, l_linenumber % 3 as o, l_partkey as p, l_partkey % 4 as a, l_suppkey % 4 as t from lineitem),
  r as (select f, 0 as i, null::bigint as r0, null::bigint as r1, null::bigint as r2, null::bigint as r3 from (select distinct f from x)
    union all select x.f, x.i, {", ".join(f"case when t = {k} then {STEP} else r{k} end" for k in range(4))} from r join x on x.f = r.f and x.i = r.i + 1)
  select f as function_id, i as bb_idx, concat_ws(',', {", ".join(f"case when r{k} < 0 then 'r{k}=T' else 'r{k}=' || r{k} end" for k in range(4))}) as constants from r where i > 0""")
def constants_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = lambda c, n: F.concat(F.lit("r"), (F.col(c) % n).cast("string"))
    l = lineitem(spark, sf_dir)
    op = F.when(F.col("l_linenumber") % 3 == 1, "const").otherwise("add")
    first = F.when(op == "const", F.col("l_partkey").cast("string")).otherwise(reg("l_partkey", 4))
    s = l.select(F.col("l_orderkey").alias("function_id"), F.col("l_linenumber").alias("bb_idx"), F.array(F.struct(reg("l_suppkey", 4).alias("target"), op.alias("op"), first.alias("a"), F.lit("8").alias("b"))).alias("assigns"))
    c = dataflow.propagated_constants(s, _flow_edges(spark, sf_dir))
    return c.select("function_id", "bb_idx", F.array_join(F.transform("constants", lambda x: F.concat(x["name"], F.lit("="), x["value"])), ",").alias("constants"))


@query("with d as (select l_orderkey as f, l_linenumber as i, l_returnflag as v from lineitem where l_linestatus = 'F') select l_orderkey as function_id, l_linenumber as bb_idx, (select v from d where f = l_orderkey and i <= l_linenumber order by i desc limit 1) as value from lineitem")
def latest_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("function_id"), F.col("l_linenumber").alias("bb_idx"), "l_returnflag", "l_linestatus")
    return dataflow.latest_definition(l.where("l_linestatus = 'F'").withColumnRenamed("l_returnflag", "value"), l)


# --- metrics -------------------------------------------------------------------------------------------------------------

CONFUSION = f"{SCORES}, {TRUTH}, p as (select row, label from s where score > 0.1), c as (select coalesce(t.label, p.label) as label, count(*) filter (t.row is not null and p.row is not null) as tp, count(*) filter (t.row is null) as fp, count(*) filter (p.row is null) as fn from t full join p on t.row = p.row and t.label = p.label group by 1)"


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = label_scores(spark, sf_dir)
    return metrics.confusion(t, metrics.predicted(s, 0.1))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"with {CONFUSION}, m as (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from c) select tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from m")
def ml_prf_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.micro(_confusion(spark, sf_dir)), "precision", "recall", "f1")


@query(f"with {CONFUSION}, q as (select tp / nullif(tp + fp, 0) as p, tp / nullif(tp + fn, 0) as r from c) select round(avg(p), 6) as precision, round(avg(r), 6) as recall, round(avg(2 * p * r / nullif(p + r, 0)), 6) as f1 from q")
def ml_prf_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.macro(_confusion(spark, sf_dir)), "precision", "recall", "f1")


@query(f"with {SCORES}, {TRUTH}, r as (select s.row, s.label, row_number() over (partition by s.row order by score desc, s.label) as k, t.row is not null as rel from s left join t on t.row = s.row and t.label = s.label), d as (select row, sum(rel::int)::double as cg, sum(rel::int / log2(k + 1)) as dcg from r where k <= 5 group by row), n as (select row, least(count(*) filter (rel), 5) as n from r group by row) select row, cg, round(dcg, 6) as dcg, round(case when n = 0 then 1.0 else dcg / (select sum(1 / log2(i + 1)) from range(1, 6) x(i) where i <= n) end, 6) as ndcg from d join n using (row)")
def ndcg_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = label_scores(spark, sf_dir)
    return _rounded(metrics.gains(s, t), "dcg", "ndcg")


@query(f"with {SCORES}, {TRUTH}, r as (select s.row, s.label, row_number() over (partition by s.row order by score desc, s.label) as k from s) select t.row, round(count(r.row)::double / count(*), 6) as recall from t left join r on r.row = t.row and r.label = t.label and k <= 5 group by t.row")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = label_scores(spark, sf_dir)
    return _rounded(metrics.label_recall_at_k(s, t), "recall")


THRESHOLDS = [k / 100 for k in range(1, 51)]


@query(f"with {SCORES}, {TRUTH}, g as (select unnest(range(1, 51)) / 100.0::double as threshold), j as (select score, t.row is not null as rel from s left join t on t.row = s.row and t.label = s.label), n as (select count(*) as n from t), c as (select threshold, count(*) filter (rel) as tp, count(*) filter (not rel) as fp from g join j on score > threshold group by threshold), a as (select g.threshold, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp from g left join c on c.threshold = g.threshold) select threshold, tp, fp, n - tp as fn, round(coalesce(2.0::double * tp / nullif(2 * tp + fp + n - tp, 0), 0), 6) as f1 from a, n")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = label_scores(spark, sf_dir)
    d = metrics.threshold_sweep(s, t, THRESHOLDS)
    return _rounded(d, "f1").select("threshold", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], "f1")


@query(f"with {SCORES} select row, string_agg(label::varchar, '_' order by score desc, label) as name from s where score > 0.25 group by row")
def predicted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.predicted_names(label_scores(spark, sf_dir)[0], 0.25)


# --- neighbours ----------------------------------------------------------------------------------------------------------

UNIT = "u as (select vec_id as id, label, list_transform(embedding::double[], lambda x: x / sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y)))) as v from embeddings)"
KNN = f"{UNIT}, n as (select a.id as query, b.id, list_dot_product(a.v, b.v) as cosine from u a, u b where a.id % 100 = 0 and a.id <> b.id), k as (select *, row_number() over (partition by query order by round(cosine, 9) desc, id) as rank from n)"


def _neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return knn.nearest(e.where("id % 100 = 0"), e, k, same=True)


@query(f"with {KNN} select query, id, round(cosine, 5) as cosine, rank::int as rank from k where rank <= 8")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, 8).withColumn("cosine", F.round("cosine", 5))


PMF = f"{KNN}, w as (select query, label as name, sum(1 - sqrt(2 * greatest(1 - cosine, 0)) / sqrt(2)) as w from k join embeddings on vec_id = id where rank <= 8 group by query, label), p as (select query, name, w / sum(w) over (partition by query) as p from w)"


@query(f"with {PMF} select query, name, round(p, 5) as p from p")
def name_pmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("name"))
    return knn.name_pmf(_neighbours(spark, sf_dir, 8), labels).withColumn("p", F.round("p", 5))


@query(f"with {PMF}, r as (select query, name, row_number() over (partition by query order by p desc, name) as rank from p) select avg(hit) as accuracy from (select query, max((rank <= 2 and name = label)::int) as hit from r join embeddings on vec_id = query group by query)")
def top_n_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("name"))
    return metrics.top_n_hits(knn.ranked_names(knn.name_pmf(_neighbours(spark, sf_dir, 8), labels), labels), 2)


@query("select a.p_partkey as id, round(case when greatest(a.p_size, b.p_size) = 0 then 1 else (greatest(a.p_size, b.p_size) - abs(a.p_size - b.p_size)) / greatest(a.p_size, b.p_size) end, 6) as size, (a.p_brand = b.p_brand)::int::double as same from part a join part b on b.p_partkey = a.p_partkey + 1")
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pairs = p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("x"), F.col("p_brand").alias("bx")).join(p.select((F.col("p_partkey") - 1).alias("id"), F.col("p_size").alias("y"), F.col("p_brand").alias("by")), "id")
    return pairs.select("id", F.round(similarity.numeric(F.col("x"), F.col("y")), 6).alias("size"), similarity.equal(F.col("bx"), F.col("by")).alias("same"))


# --- language model ---------------------------------------------------------------------------------------------------------

PADDED = "p as (select p_partkey, list_concat(['<s>'], list_concat(string_split(p_name, ' '), ['</s>'])) as p from part)"
GRAMS = f"{PADDED}, g as (" + " union all ".join(f"select {n} as n, array_to_string(p[i:i + {n - 1}], ' ') as gram from (select p, unnest(range(1, len(p) - {n - 2})) as i from p)" for n in (1, 2, 3)) + "), c as (select n, gram, count(*) as count from g group by n, gram)"


def _name_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", lm.split_labels(F.col("p_name")).alias("labels"))


@query(f"with {GRAMS} select n, gram, count from c")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.ngrams(_name_labels(spark, sf_dir), "labels")


@query(f"with {GRAMS}, t as (select p_partkey as row, array_to_string(p[i:i + 2], ' ') as g3, array_to_string(p[i:i + 1], ' ') as g2 from (select p_partkey, p, unnest(range(1, len(p) - 1)) as i from p)) select row, round(sum(log10(c3.count / c2.count)), 6) as score from t join c c3 on c3.n = 3 and c3.gram = g3 join c c2 on c2.n = 2 and c2.gram = g2 group by row")
def lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _name_labels(spark, sf_dir)
    return lm.scored(s, "p_partkey", "labels", lm.ngrams(s, "labels")).withColumn("score", F.round("score", 6))


@query()
def order_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _name_labels(spark, sf_dir)
    sets = s.select("p_partkey", F.array_sort(F.array_distinct("labels")).alias("labels"))
    return lm.ordered(sets, "labels", lm.fitted(s, "labels"))


@query()
def xml_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    x = e.select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("vector"))
    y = e.select(F.col("vec_id").alias("row"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"))
    split = vocab.hash_percent("row") < 80
    n = y.count()
    props = y.groupBy("label").agg(F.count("*").alias("n_t")).select("label", vocab.inverse_propensity(F.col("n_t"), F.lit(float(max(n, 3)))).alias("inv_prop"))
    model = learning.train_ensemble(x.where(split), y.where(split), props, trees=16)
    return learning.predict_ensemble(x.where(~split), model)


# --- more of the store ------------------------------------------------------------------------------------------------------


@query("select distinct p_brand as path from part")
def distinct_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.paths(table(spark, sf_dir, "part").select(F.col("p_brand").alias("path")))


@query(f"with {BINARIES} select id from b where path = '/bin/7'")
def id_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.id_of(binaries(spark, sf_dir), "/bin/7")


@query("select c_custkey, c_name from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
def ids_among(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey")
    return store.among(table(spark, sf_dir, "customer"), "c_nationkey", chosen).select("c_custkey", "c_name")


@query("select n_nationkey as id from nation where regexp_matches(n_name, '[A-Z].*[13579]$')")
def libraries_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.resolve_library(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "[A-Z].*[13579]$")


@query("select o_orderkey as id from orders where o_orderkey not in (select o_orderkey from orders where o_orderkey % 3 = 0)")
def embedding_work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    done = o.where("id % 3 <= 1").select(F.col("id").alias("function_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0))).alias("embedding"))
    return store.without_embeddings(o, done)


@query(f"with {FUNCTIONS}, {BINARIES}, e as (select vec_id * 100 + 1 as id, label from embeddings) select f.id, path, label from f join b on b.id = f.binary_id join e on e.id = f.id")
def functions_with_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = functions(spark, sf_dir).withColumn("binding", F.lit("GLOBAL"))
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 100 + 1).alias("function_id"), "embedding", "label")
    return store.with_embeddings(f, binaries(spark, sf_dir), e).select("id", "path", "label")


@query("select distinct len(string_split(p_name, ' '))::int as size from part")
def distinct_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.distinct_sizes(table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("a")), "a")


@query("select p_name as name, string_agg(p_size::varchar, ',' order by p_size) as sizes, string_agg(distinct p_brand, ',' order by p_brand) as paths from part group by p_name")
def grouped_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_size", F.col("p_brand").alias("path"))
    g = store.grouped_by_name(p, "p_size")
    return g.select("name", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("sizes"), F.array_join("paths", ",").alias("paths"))


@query("select p_brand || ' ' || p_size || ' ' || p_name as name from part group by 1 having not bool_or(p_partkey % 2 = 1)")
def static_only_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"), "p_name")
    p = table(spark, sf_dir, "part").select(name.alias("name"), F.when(F.col("p_partkey") % 2 == 1, "dynamic").otherwise("static").alias("linkage"))
    return store.static_only(p)


@query("select p_partkey from part where not regexp_matches(p_brand, '(?i)brand#1')")
def unknown_binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.by_library_path(table(spark, sf_dir, "part").withColumn("path", F.col("p_brand")), "brand#1", known=False).select("p_partkey")


@query("select distinct p_name as name, case when d is not null then 'defined' when i is not null then 'imported' when q is not null then 'prototype' end as source, coalesce(d, i, q) as value from part left join (select p_name as n, min(p_partkey) as d from part where p_size < 10 group by 1) on n = p_name left join (select p_name as n2, min(p_partkey) as i from part where p_size < 30 group by 1) on n2 = p_name left join (select p_name as n3, min(p_partkey) as q from part where p_size < 45 group by 1) on n3 = p_name")
def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("value"), "p_size")
    return store.symbol_lookup(p.select("name").distinct(), p.where("p_size < 10"), p.where("p_size < 30"), p.where("p_size < 45"))


@query("with s as (select s_suppkey as binary_id, unnest([s_nationkey, s_suppkey % 30]) as k from supplier), l as (select n_nationkey as k from nation) select binary_id, bool_and(l.k is not null) as complete, case when bool_and(l.k is not null) then string_agg(distinct l.k::varchar, ',' order by l.k::varchar) else '' end as ids from s left join l using (k) group by binary_id")
def linked_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    soname = lambda c: F.concat(F.lit("libn"), c.cast("string"), F.lit(".so.6"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("binary_id"), F.explode(F.array(F.col("s_nationkey").cast("long"), F.col("s_suppkey") % 30)).alias("k"))
    libs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("/usr/lib/libn"), F.col("n_nationkey").cast("string"), F.lit(".so")).alias("name"))
    found = store.linked_libraries(s.select("binary_id", soname(F.col("k")).alias("soname")), libs)
    return found.select("binary_id", "complete", F.array_join(F.array_sort(F.transform("library_ids", lambda x: x.cast("string"))), ",").alias("ids"))


@query(f"with {BINARIES} select case when id % 2 = 0 then 'train' else 'test' end as split, id from b where bin_type = 'executable'")
def remapped_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = binaries(spark, sf_dir)
    old = b.select(F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"), "path")
    return store.remap_splits(old, b, store.of_kind(b, "executable").select("id"))


@query("select e.vec_id from embeddings e where vec_id in (select vec_id from embeddings where label < 5) and vec_id in (select vec_id from embeddings where vec_id % 2 = 0)")
def in_all_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return vocab.in_all(e, e.where("label < 5"), e.where("vec_id % 2 = 0"), key="vec_id").select("vec_id")


# --- more features, graphs and programs -------------------------------------------------------------------------------------


def _ir_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as statements: three kinds, a constant each, and a target where they jump; a block is a line status."""
    l = lineitem(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ["IMark", "Exit", "Put"])), (F.col("l_linenumber") % 3 + 1).cast("int"))
    block = F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    big = F.when(F.col("l_suppkey") % 5 == 0, F.lit(9223372036854775807)).otherwise(F.col("l_suppkey")).cast("decimal(20,0)")
    return l.select(F.col("l_orderkey").alias("function_id"), block.alias("bb_idx"), kind.alias("kind"), F.col("l_returnflag").alias("operation"), F.col("l_partkey").alias("temp"), big.alias("constant"), F.col("l_partkey").cast("decimal(20,0)").alias("target"))


IR = """s as (select l_orderkey as f, case l_linestatus when 'F' then 0 else 1 end as b, l_linenumber % 3 as k, l_returnflag as op, l_partkey as t, l_suppkey as c from lineitem),
  g as (select f, b, count(*) filter (k = 0) as ninstructions, count(distinct t) as ntemp_vars, string_agg(op, ',' order by op) as operations,
    coalesce(string_agg(c, ',' order by c) filter (k <> 1 and c % 5 <> 0), '') as constants, coalesce(string_agg(distinct t, ',' order by t) filter (k = 1), '') as callees from s group by f, b)"""


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in columns})


@query(f"with {IR} select f as function_id, b as bb_idx, ninstructions, ntemp_vars, operations, constants, callees from g")
def block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(features.block_counts(_ir_statements(spark, sf_dir)), "operations", "constants", "callees")


@query("select p_partkey, regexp_matches(p_name, '^[a-m]')::int as a, regexp_matches(p_name, '^s')::int as s from part")
def category_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = features.categories(F.col("p_name"), ["[a-m]", "s"])
    return table(spark, sf_dir, "part").select("p_partkey", c[0].alias("a"), c[1].alias("s"))


@query("select count(*) as vectors, avg(n) as mean_rows from (select p_size, count(*) as n from part group by 1)")
def vector_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.cardinality(table(spark, sf_dir, "part"), "p_size")


@query("with c as (select l_orderkey as f, l_linenumber as b, l_partkey % 8 as t, case when l_returnflag = 'R' then 'Ijk_Call' when l_returnflag = 'A' then 'Ijk_SigFPE' else 'Ijk_Boring' end as j from lineitem), k as (select distinct f, b, t, j from c where j <> 'Ijk_SigFPE') select distinct f as function_id, b::bigint as src, t as dst, j as jumpkind from k where j <> 'Ijk_Call' and exists (select 1 from c where c.f = k.f and c.b = k.t)")
def cfg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lineitem(spark, sf_dir)
    kind = F.when(F.col("l_returnflag") == "R", "Ijk_Call").when(F.col("l_returnflag") == "A", "Ijk_SigFPE").otherwise("Ijk_Boring")
    exits = l.select(F.col("l_orderkey").alias("function_id"), F.col("l_linenumber").cast("long").alias("start"), (F.col("l_partkey") % 8).alias("target"), kind.alias("jumpkind"))
    return graph.cfg_edges(exits, exits.select("function_id", "start").distinct())[0]


@query("with h as (select l_orderkey as graph, md5(string_agg(l_returnflag, ',' order by l_returnflag)) as hash from lineitem group by 1) select graph, min(graph) over (partition by hash) as first from h")
def unique_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").alias("node"), F.col("l_returnflag").alias("label"))
    return graph.unique_graphs(graph.graph_hashes(l))


@query(f"with {EDGES}, a as (select src, count(*)::double as n from e group by src), b as (select e.src, sum(coalesce(a.n, 0)) as n from e left join a on a.src = e.dst group by e.src) select a.src as node, a.n as one, b.n as two from a join b using (src)")
def hop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = graph.hop_counts(line_edges(spark, sf_dir), 2)
    return h.select("node", F.col("vector")[0].alias("one"), F.col("vector")[1].alias("two"))


@query("select p_partkey, case p_size % 3 when 0 then 'static' else 'dynamic' end as linkage, case p_size % 2 when 0 then 'gcc' else 'unknown' end as compiler, 'o' || (p_size % 4) as optimisation from part")
def inferred_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    segment = F.when(F.col("p_size") % 2 == 0, "gcc").otherwise("other")
    b = p.select("p_partkey", F.concat(F.lit("/B/"), segment, F.lit("/O"), (F.col("p_size") % 4).cast("string"), F.lit("/x")).alias("path"), (F.col("p_size") % 3 == 0).alias("static"), F.lit("unknown").alias("compiler"))
    return intervals.inferred_parameters(b).select("p_partkey", "linkage", "compiler", "optimisation")


@query("select distinct p_name as real_name, p_size as size, p_partkey % 100 as vaddr from part where p_size <= 40 and p_partkey % 3 <> 0")
def extracted_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_name").alias("real_name"), F.when(F.col("p_partkey") % 3 == 0, "OBJECT").otherwise("FUNC").alias("type"), F.lit("GLOBAL").alias("binding"), F.col("p_size").alias("size"), (F.col("p_partkey") % 100).alias("vaddr"), F.encode("p_name", "utf-8").alias("data"))
    return intervals.extracted_symbols(p, largest=40)[0].select("real_name", "size", "vaddr")


@query("select p_partkey::decimal(20,0) as vaddr, p_size::decimal(20,0) as size, 'sub_' || p_partkey as name from part")
def boundary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = lambda c: F.lower(F.hex(c))
    text = F.concat(F.lit("(sub_"), F.col("p_partkey").cast("string"), F.lit(" "), hexed(F.col("p_partkey")), F.lit(" "), hexed(F.col("p_partkey") + F.col("p_size")), F.lit(")"))
    return intervals.bap_functions(table(spark, sf_dir, "part").select(text.alias("value")))


@query("""with recursive u as (select c_custkey // 100 as f, 't' || (c_custkey % 100) as var, case when c_nationkey % 2 = 0 then 'r' || c_nationkey else 'm' || c_nationkey end as dep from customer
    union select c_custkey // 100, 't' || (c_custkey % 100), 't' || (c_custkey % 100 - 1) from customer where c_custkey % 10 > 0 union select c_custkey // 100, 'x' || (c_custkey % 100), 't' || (c_custkey % 100) from customer),
  r as (select * from u union select r.f, r.var, u.dep from r join u on u.f = r.f and u.var = r.dep) select f as function_id, var, dep as depends from r""")
def data_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables x of temporaries t, each computed from a register or a cell and, nine times in ten, the temporary before."""
    k = F.col("c_custkey") % 100
    named = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    c = table(spark, sf_dir, "customer").withColumn("function_id", F.expr("c_custkey div 100"))
    leaf = F.when(F.col("c_nationkey") % 2 == 0, named("r", F.col("c_nationkey"))).otherwise(named("m", F.col("c_nationkey")))
    uses = c.select("function_id", named("t", k).alias("var"), leaf.alias("depends"))
    uses = uses.union(c.where("c_custkey % 10 > 0").select("function_id", named("t", k), named("t", k - 1)))
    return dataflow.data_dependencies(uses.union(c.select("function_id", named("x", k), named("t", k))))


@query("select label, (select count(*) from embeddings)::double / ((select count(distinct label) from embeddings) * count(*)) as weight from embeddings group by label")
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.balanced_weights(table(spark, sf_dir, "embeddings"))


@query(f"with {EDGES}, m as (select e.dst as row, avg(l_quantity) as v from e join lineitem on l_orderkey * 100 + l_linenumber = e.src group by e.dst) select row, 0 as pos, round(v * 2 + 1, 6) as value from m union all select row, 1, round(v * -0.5 + 3, 6) from m")
def neighbour_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = lines(spark, sf_dir).select(F.col("id").alias("row"), F.lit(0).alias("pos"), F.col("size").cast("double").alias("value"))
    out = learning.neighbour_layer(line_edges(spark, sf_dir), values, [[2.0, -0.5]], [1.0, 3.0])
    return out.select("row", F.col("pos").cast("int").alias("pos"), F.round("value", 6).alias("value"))


@query()
def encoded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("vector"))
    return learning.encoded(e, code=8, epochs=3)


@query()
def principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").alias("vector"))
    return learning.principal_axes(e, 4)


@query()
def node_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("binary_id"), F.col("s_suppkey").alias("src"), F.expr("s_suppkey div 2").alias("dst"))
    return graph.node_embedding(f, size=8, rounds=2)


from gleanbin.plans import more_queries  # noqa: E402, F401  adds its own
