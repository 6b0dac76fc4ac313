"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

The tree has a level for each given column (domain, language, source). Capacities (tokens x epochs) are summed upwards.
A budget is dealt downwards: at each node among its children by weight; a child that can't hold its share is filled, and
what it lacks goes to its siblings by their weights. So a shortage stays among siblings while they can take it, and
reaches the ancestors' siblings only through the capacity of a whole subtree. All of it is whole numbers: what rounding
leaves goes to the children of most weight, then by name.

A leaf's budget is taken from its seeded epochs: each epoch orders the leaf by MD5 of seed, epoch and doc_id. Whole
epochs are taken whole; of the last, the prefix whose tokens make up the rest, where the document at the end counts with
the tokens still wanted. The prefix is found without ordering the leaf: tokens are summed by the first two hex digits of
the hash, then within the one digit pair at the boundary by the next two, and only the rows left (1 in 65,536 of the
leaf) are ordered. So a leaf that holds most rows is never in one task.

Defined cases: null lang is und, null source is unknown, a source without a number has domain other; null and blank
texts have no tokens and are never taken; a leaf under a weight of 0 is never taken, nor does it hold what its siblings
lack; null doc_id hashes the text instead; repeated rows count each; rows of equal hash (rows that repeat a doc_id) go by
tokens, then text, and those at a leaf's boundary are ordered in one task; texts are counted whole, however long; empty
tables give empty results; other columns are passed by, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanbin.llm.common import Scratch, restored, shielded, written

LEVELS = ["domain", "lang", "source"]
#: Target weights by level; what isn't named weighs 1.
WEIGHTS = {"domain": {"web": 5, "books": 3, "reference": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}
#: The budget, in hundredths of all tokens; the most epochs of a leaf; the seed.
SHARE, EPOCHS, SEED = 60, 2, "mix-1"
LEAF = [f"_{x}" for x in LEVELS]
#: Parts in which a leaf's rows meet its budget, so that a leaf of most rows is dealt to many tasks.
SALTS = 64


def with_leaf(documents: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of documents (shielded), a document's place in the tree, its tokens (words) and the id that epochs hash."""
    doc_id, text, lang, source = (F.col(names[c]) for c in ("doc_id", "text", "lang", "source"))
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1)
    number = F.expr("try_cast(nullif(_digits, '') as bigint)")
    start = documents.withColumn("_digits", digits)
    domain = F.when(F.pmod(number, F.lit(3)) == 0, "web").when(F.pmod(number, F.lit(3)) == 1, "books").when(F.pmod(number, F.lit(3)) == 2, "reference").otherwise("other")
    return start.select(
        *[F.col(c) for c in documents.columns],
        domain.alias("_domain"),
        F.coalesce(lang, F.lit("und")).alias("_lang"),
        F.coalesce(source, F.lit("unknown")).alias("_source"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("_tokens"),
        F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(text))).alias("_id"),
    )


def _weight(level: str, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("decimal(12,0)")
    pairs = [F.lit(x) for kv in sorted(weights.items()) for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(f"_{level}")), F.lit(1)).cast("decimal(12,0)")


def filled(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Water filling: deals _budget among the rows of each parent by _w, none above _cap; adds _got.

    Children in order of cap / w: one is full if, with those before it full, its share of the rest is no less than its cap.
    """
    by = W.partitionBy(*parent).orderBy("_ratio", key)
    d = children.withColumn("_ratio", F.col("_cap").cast("double") / F.col("_w").cast("double"))
    d = d.withColumn("_before", F.coalesce(F.sum("_cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("decimal(25,0)")).withColumn("_after_w", F.sum("_w").over(by.rowsBetween(0, W.unboundedFollowing)).cast("decimal(12,0)"))
    d = d.withColumn("_full", F.col("_cap") * F.col("_after_w") <= (F.col("_budget") - F.col("_before")) * F.col("_w"))
    every = W.partitionBy(*parent)
    d = d.withColumn("_rest", (F.col("_budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(every), F.lit(0))).cast("decimal(25,0)")).withColumn("_rest_w", F.sum(F.when(~F.col("_full"), F.col("_w"))).over(every).cast("decimal(12,0)"))
    d = d.withColumn("_got", F.when(F.col("_full"), F.col("_cap").cast("long")).otherwise(F.expr("(_rest * _w) div _rest_w")))
    d = d.withColumn("_left", F.col("_rest").cast("long") - F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_got"))).over(every), F.lit(0))).withColumn("_turn", F.row_number().over(every.orderBy("_full", F.desc("_w"), key)))
    return d.withColumn("_got", F.col("_got") + F.when(~F.col("_full") & (F.col("_turn") <= F.col("_left")), 1).otherwise(0)).drop("_ratio", "_before", "_after_w", "_full", "_rest", "_rest_w", "_left", "_turn")


def budgets(rows: DataFrame, own: Scratch, share: int = SHARE, epochs: int = EPOCHS, weights: dict[str, dict[str, int]] = WEIGHTS) -> DataFrame:
    """Each leaf with its _supply and _got tokens; as small as the tree. A leaf under a weight of 0 holds nothing."""
    weighs = F.lit(True)
    for name in LEVELS:
        weighs = weighs & (_weight(name, weights.get(name, {})) > 0)
    sums = rows.groupBy(*LEAF).agg(F.sum("_tokens").alias("_supply"))
    leaves = own.written(sums.withColumn("_holds", F.when(weighs, F.col("_supply")).otherwise(0)), "leaves")
    total, holds = (x or 0 for x in leaves.agg(F.sum("_supply"), F.sum("_holds")).first())
    level = leaves.limit(0).select(F.lit(0).cast("decimal(25,0)").alias("_budget"))
    for k, name in enumerate(LEVELS):
        node, above = LEAF[: k + 1], LEAF[:k]
        caps = leaves.groupBy(*node).agg((F.sum("_holds") * epochs).cast("decimal(25,0)").alias("_cap"))
        nodes = caps.withColumn("_w", F.greatest(_weight(name, weights.get(name, {})), F.lit(1).cast("decimal(12,0)")))
        whole = F.lit(min(total * share // 100, holds * epochs)).cast("decimal(25,0)")
        nodes = nodes.join(level, above) if k else nodes.withColumn("_budget", whole)
        level = filled(nodes, above or [F.lit(1)], f"_{name}").select(*node, F.col("_got").cast("decimal(25,0)").alias("_budget"))
    dealt = leaves.join(level, LEAF).select(*LEAF, "_supply", F.col("_budget").cast("long").alias("_got"))
    return own.written(dealt, "budgets")


def _boundary(sums: DataFrame, group: list[str], digit: str, want: str) -> DataFrame:
    """Of each group, the digit at which the running sum of tokens reaches want, and what is wanted of it."""
    run = F.coalesce(F.sum("_sum").over(W.partitionBy(*group).orderBy(digit).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = sums.withColumn("_run", run)
    return d.where((F.col("_run") < F.col(want)) & (F.col("_run") + F.col("_sum") >= F.col(want))).select(*group, F.col(digit).alias(f"{digit}_at"), (F.col(want) - F.col("_run")).alias(f"{want}_{digit}"))


def _mixed(documents: DataFrame, names: dict[str, str], share: int, epochs: int, seed: str, weights: dict[str, dict[str, int]]) -> DataFrame:
    """The columns of documents (shielded) for every document and epoch taken, with LEAF, _tokens, _epoch, _taken."""
    own = Scratch(documents.sparkSession)
    lite = own.written(with_leaf(documents, names).select(*LEAF, "_id", "_tokens").where("_tokens > 0"), "lite")
    leaf = budgets(lite, own, share, epochs, weights).withColumn("_whole", F.expr("_got div _supply")).withColumn("_want", F.expr("_got - _whole * _supply"))
    leaf = leaf.drop("_supply", "_got")

    def keyed(rows: DataFrame, by: DataFrame) -> DataFrame:
        key = F.md5(F.concat_ws("|", F.lit(seed), F.col("_whole").cast("string"), F.col("_id")))
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
        every = by.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return salted.join(every, [*LEAF, "_salt"]).withColumn("_key", key).withColumn("_d1", F.substring("_key", 1, 2)).withColumn("_d2", F.substring("_key", 3, 2))

    first = keyed(lite, leaf.where("_want > 0")).groupBy(*LEAF, "_d1").agg(F.sum("_tokens").alias("_sum"), F.first("_want").alias("_want"))
    first = own.written(_boundary(first, LEAF, "_d1", "_want"), "first")
    second = keyed(lite, leaf.join(first, LEAF)).where("_d1 = _d1_at").groupBy(*LEAF, "_d2").agg(F.sum("_tokens").alias("_sum"), F.first("_want__d1").alias("_want__d1"))
    second = _boundary(second, LEAF, "_d2", "_want__d1")
    bounds, _ = written(leaf.join(first, LEAF, "left").join(second, LEAF, "left"), "bounds")
    own.clear()  # what is returned reads the written bounds alone
    rows = keyed(with_leaf(documents, names).where("_tokens > 0"), bounds)
    before = (F.col("_want") > 0) & ((F.col("_d1") < F.col("_d1_at")) | ((F.col("_d1") == F.col("_d1_at")) & (F.col("_d2") < F.col("_d2_at"))))
    some = F.col("_whole").cast("int") + before.cast("int")
    out = [*documents.columns, *LEAF, "_tokens", "_epoch", "_taken"]
    plain = rows.where(some > 0).withColumn("_epoch", F.explode(F.sequence(F.lit(0), some - 1))).withColumn("_taken", F.col("_tokens"))
    at = rows.where((F.col("_want") > 0) & (F.col("_d1") == F.col("_d1_at")) & (F.col("_d2") == F.col("_d2_at")))
    by = W.partitionBy(*LEAF).orderBy("_key", "_id", "_tokens", F.md5(F.col(names["text"]))).rowsBetween(W.unboundedPreceding, -1)
    last = at.withColumn("_run", F.coalesce(F.sum("_tokens").over(by), F.lit(0))).where("_run < _want__d1__d2")
    last = last.withColumn("_epoch", F.col("_whole").cast("int")).withColumn("_taken", F.least(F.col("_tokens"), F.col("_want__d1__d2") - F.col("_run")))
    return plain.select(*out).unionByName(last.select(*out))


def mixed(documents: DataFrame, share: int = SHARE, epochs: int = EPOCHS, seed: str = SEED, weights: dict[str, dict[str, int]] = WEIGHTS) -> DataFrame:
    """The columns of documents for every document and epoch taken, with _domain, _lang, _source, _tokens, _epoch, _taken.

    Columns of documents that have one of those names are left out.
    """
    rows, names = shielded(documents)
    extra = [*LEAF, "_tokens", "_epoch", "_taken"]
    taken = _mixed(rows, names, share, epochs, seed, weights)
    return taken.select(*[F.col(k).alias(c) for c, k in names.items() if c not in extra], *extra)


def op4(documents: DataFrame) -> DataFrame:
    taken = mixed(documents.select("doc_id", "text", "lang", "source"))
    return taken.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens"), F.col("_taken").alias("taken_tokens"))


def mixed_documents(documents: DataFrame) -> DataFrame:
    """A row for each document and epoch taken, with the document's own columns; the last of a leaf's budget is whole."""
    rows, names = shielded(documents)
    return restored(_mixed(rows, names, SHARE, EPOCHS, SEED, WEIGHTS), names)


def _level_sql(k: int) -> str:
    own, above = ", ".join(LEVELS[: k + 1]), ", ".join(LEVELS[:k])
    part = f"partition by {above}" if k else ""
    pairs = " ".join(f"when '{n}' then {w}" for n, w in sorted(WEIGHTS[LEVELS[k]].items()))
    weight = f"case {LEVELS[k]} {pairs} else 1 end" if pairs else "1"
    budget = f"join b{k - 1} using ({above})" if k else "cross join root"
    x = LEVELS[k]
    return f"""
n{k} as (select {own}, n.cap, n.w, budget from (select {own}, sum(supply)::hugeint * {EPOCHS} as cap, {weight} as w from leaves group by {own}) n {budget}),
o{k} as (select *, coalesce(sum(cap) over ({part} order by cap::double / w, {x} rows between unbounded preceding and 1 preceding), 0) as bef,
  sum(w) over ({part} order by cap::double / w, {x} rows between current row and unbounded following) as aft from n{k}),
f{k} as (select *, cap * aft <= (budget - bef) * w as f from o{k}),
r{k} as (select *, budget - coalesce(sum(case when f then cap end) over ({part}), 0) as rest, sum(case when not f then w end) over ({part}) as rw from f{k}),
g{k} as (select *, case when f then cap else (rest * w) // rw end as got from r{k}),
t{k} as (select *, rest - coalesce(sum(case when not f then got end) over ({part}), 0) as lft, row_number() over ({part} order by f, w desc, {x}) as turn from g{k}),
b{k} as (select {own}, (got + case when not f and turn <= lft then 1 else 0 end)::hugeint as budget from t{k})"""


ORACLE = f"""
with d as (select doc_id, coalesce(lang, 'und') as lang, coalesce(source, 'unknown') as source, coalesce(text, '') as text,
    case try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') as bigint) % 3 when 0 then 'web' when 1 then 'books' when 2 then 'reference' else 'other' end as domain from documents),
lite as (select doc_id, domain, lang, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::bigint as n, text from d where regexp_matches(text, '[^\\x20\\x09-\\x0D]')),
leaves as (select domain, lang, source, sum(n) as supply from lite group by all),
root as (select (sum(supply)::hugeint * {SHARE}) // 100 as budget from leaves),
{",".join(_level_sql(k) for k in range(len(LEVELS)))},
lf as (select domain, lang, source, (budget // supply)::bigint as whole, (budget % supply)::bigint as want from leaves join b2 using (domain, lang, source)),
rw as (select lite.*, whole, want, md5('{SEED}|' || whole || '|' || doc_id) as k from lite join lf using (domain, lang, source)),
cu as (select *, coalesce(sum(n) over (partition by domain, lang, source order by k, doc_id rows between unbounded preceding and 1 preceding), 0) as run from rw)
select doc_id, domain, lang, source, e::int as epoch, n as n_tokens, n as taken_tokens from (select *, unnest(range(whole)) as e from cu)
union all
select doc_id, domain, lang, source, whole::int, n, least(n, want - run)::bigint from cu where run < want
"""
