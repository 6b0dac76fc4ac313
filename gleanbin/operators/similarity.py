"""Similarity of pairs of functions or basic blocks, component by component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanbin.operators.knn import angular


def numeric(a: Column, b: Column) -> Column:
    """(max - |a - b|) / max; 1 where both are 0."""
    top = F.greatest(a, b)
    return F.when(top == 0, 1.0).otherwise((top - F.abs(a - b)) / top)


def overlap(a: Column, b: Column) -> Column:
    """Common elements over the larger set; 1 for two empty ones."""
    top = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(top == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / top)


def count_cosine(a: Column, b: Column) -> Column:
    """Cosine of two count maps; 1 for two empty ones, 0 for one."""
    value = lambda m, k: F.coalesce(F.element_at(m, k).cast("double"), F.lit(0.0))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    both = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + value(a, k) * value(b, k))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.coalesce(F.try_divide(both, F.sqrt(total(a) * total(b))), F.lit(0.0)))


def common_prefix(a: Column, b: Column) -> Column:
    """Equal leading elements over the longer list; 1 for two empty ones."""
    top = F.greatest(F.size(a), F.size(b))
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(top == 0, 1.0).otherwise(F.when(first > 0, first - 1).otherwise(F.size(same)) / top)


def equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b).cast("double")


def functions(pairs: DataFrame, kernel: Column | None = None) -> DataFrame:
    """id and the similarity vector of pairs (id, a, b: structs of size, hash, opcode_hash, ninstructions, jumpkinds,
    sum_jumpkinds, temps, constants, categories array<map>, callees). kernel: the graph kernel, where it is defined."""
    a, b = F.col("a"), F.col("b")
    parts = [numeric(a["size"], b["size"]), equal(a["hash"], b["hash"]), equal(a["opcode_hash"], b["opcode_hash"]), numeric(a["ninstructions"], b["ninstructions"])]
    for counts in ("sum_jumpkinds", "temps"):
        parts += [overlap(F.map_keys(a[counts]), F.map_keys(b[counts])), angular(count_cosine(a[counts], b[counts]))]
    parts += [common_prefix(a["jumpkinds"], b["jumpkinds"]), overlap(a["constants"], b["constants"])]
    parts += [angular(count_cosine(a["categories"][k], b["categories"][k])) for k in range(3)]
    parts += [numeric(F.size(a["callees"]), F.size(b["callees"]))]
    return pairs.select("id", F.array(*parts, *([] if kernel is None else [kernel])).alias("similarity"))


def blocks(pairs: DataFrame) -> DataFrame:
    """id and the similarity vector of pairs of basic blocks: angles here are 1 - acos, not scaled to a right angle."""
    a, b = F.col("a"), F.col("b")
    parts = [numeric(a["size"], b["size"]), equal(a["hash"], b["hash"]), equal(a["opcode_hash"], b["opcode_hash"]), numeric(a["ninstructions"], b["ninstructions"]), numeric(a["ntemps"], b["ntemps"]), equal(a["jumpkind"], b["jumpkind"])]
    for counts in ("statements", "expressions", "operations"):
        parts += [overlap(F.map_keys(a[counts]), F.map_keys(b[counts])), 1 - F.acos(F.least(count_cosine(a[counts], b[counts]), F.lit(1.0)))]
    parts += [numeric(F.size(a["callees"]), F.size(b["callees"]))]
    return pairs.select("id", F.array(*parts).alias("similarity"))


def graph_kernel_defined(nodes_a: Column, nodes_b: Column, kernel: Column) -> Column:
    """1 for two graphs of two nodes, the kernel where the smaller has over 0.6 of the larger's nodes, else 0."""
    ratio = F.least(nodes_a, nodes_b) / F.greatest(nodes_a, nodes_b)
    return F.when((nodes_a == 2) & (nodes_b == 2), 1.0).when(ratio > 0.6, kernel).otherwise(0.0)
