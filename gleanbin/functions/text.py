"""Small column functions: followers of numbers, lists as text, bits, chance, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordinal_follower(n: Column) -> Column:
    """st, nd, rd or th, by the last digit alone."""
    last = F.right(n.cast("string"), F.lit(1))
    return F.when(last == "1", "st").when(last == "2", "nd").when(last == "3", "rd").otherwise("th")


def plural_follower(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def list_to_string(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), ",")


def bytes_of_bits(bits: Column) -> Column:
    """The numbers of eight binary digits each."""
    return F.transform(F.sequence(F.lit(0), (F.length(bits) / 8 - 1).cast("int")), lambda k: F.conv(F.substring(bits, k * 8 + 1, F.lit(8)), 2, 10).cast("int"))


def with_probability(p: float, key: Column, seed: int = 0) -> Column:
    """True for about p of all keys, the same ones in every run."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(p * 1_000_000)


def chunks_of_size(df: DataFrame, size: int, order: str, key: list[str]) -> DataFrame:
    """Adds chunk: rows of each key in order, size at a time."""
    return df.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy(*key).orderBy(order)) - 1) / size))


def n_chunks(df: DataFrame, n: int, order: str, key: list[str]) -> DataFrame:
    """Adds chunk: rows of each key in order, in n parts as even as can be."""
    return df.withColumn("chunk", F.ntile(n).over(W.partitionBy(*key).orderBy(order)) - 1)


def chunks_of_total(items: Column, total: float) -> Column:
    """The elements of an array of numbers as arrays, each begun when the next element would bring the last over total."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<array<double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        x = x.cast("double")
        fresh = (F.size(acc["out"]) == 0) | (acc["sum"] + x > total)
        last = F.concat(F.element_at(acc["out"], -1), F.array(x))
        grown = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(last))
        return F.when(fresh, F.struct(x.alias("sum"), F.concat(acc["out"], F.array(F.array(x))).alias("out"))).otherwise(F.struct((acc["sum"] + x).alias("sum"), grown.alias("out")))

    return F.aggregate(items, start, step, lambda a: a["out"])
