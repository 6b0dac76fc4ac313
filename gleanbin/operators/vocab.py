"""Vocabularies, seeded splits, label spaces and their preconditioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanbin.plans.tables import written


def hash_percent(key: str | Column, salt: str = "") -> Column:
    """0 to 99 from the MD5 of a key: the same in every run, engine and partitioning."""
    text = F.concat(F.lit(salt), (F.col(key) if isinstance(key, str) else key).cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int"), F.lit(100))


def hash_split(df: DataFrame, key: str, train: int = 80, validate: int = 10, salt: str = "") -> DataFrame:
    """Adds split, by key (a binary's id keeps its functions together)."""
    p = hash_percent(key, salt)
    return df.withColumn("split", F.when(p < train, "train").when(p < train + validate, "validate").otherwise("test"))


def reshuffled(df: DataFrame, key: str, salt: str = "") -> DataFrame:
    """Adds split, 90/5/5 by hash range of the key: exact shares in expectation, without one global order."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(1 << 32)
    return df.withColumn("split", F.when(h < 0.9, "train").when(h < 0.95, "validate").otherwise("test"))


def alpha_numeric(name: Column) -> Column:
    """The distinct lower-case alphanumeric runs of a name."""
    return F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0)))


def labels_of(df: DataFrame, row: str, tokens: Column) -> DataFrame:
    """row, label, distinct."""
    return df.select(F.col(row).alias("row"), F.explode(tokens).alias("label")).distinct()


def top_k(items: DataFrame, column: str, k: int) -> DataFrame:
    """column, n of the k most frequent; ties by value."""
    return items.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def indexed(vocabulary: DataFrame, column: str, *order) -> DataFrame:
    """Adds idx from 0; vocabularies are bounded by their k."""
    return vocabulary.withColumn("idx", F.row_number().over(W.orderBy(*(order or (column,)))) - 1)


def union_of_arrays(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(column).alias("item")).distinct()


def label_space(labels: DataFrame, k: int) -> DataFrame:
    """label, n: the k most frequent labels of row, label pairs."""
    return top_k(labels, "label", k)


def preconditioned(labels: DataFrame, k: int, least: int = 3) -> DataFrame:
    """row, label of the top k labels with a support over least; rows left without a label drop out.

    Dropping those rows lowers no kept label's support, so this is the fixpoint of the repeated form.
    """
    kept = label_space(labels, k).where(F.col("n") > least).select("label")
    return labels.join(kept, "label", "left_semi").select("row", "label")


def inverse_propensity(n_t: Column, n: Column, a: float = 0.5, b: float = 0.425) -> Column:
    """1 + (ln N - 1) (B + 1)^A e^(-A ln(N_t + B))."""
    return 1 + (F.ln(n) - 1) * F.pow(F.lit(b + 1), F.lit(a)) * F.exp(-a * F.ln(n_t + b))


def propensities(labels: DataFrame, k: int, a: float = 0.5, b: float = 0.425, least: int = 3) -> DataFrame:
    """label, n_t, inv_prop; N is the number of rows that keep a label.

    The pairs are written once; a label's support is its n_t, so only the rows are counted again.
    """
    pairs, _ = written(labels, "labels")
    kept, _ = written(label_space(pairs, k).where(F.col("n") > least), "label-space")
    rows = pairs.join(F.broadcast(kept.select("label")), "label", "left_semi")  # k labels at most
    n = rows.agg(F.count_distinct("row").alias("rows"))
    with_n = kept.join(F.broadcast(n), F.lit(True))  # one row
    return with_n.select("label", F.col("n").alias("n_t"), inverse_propensity(F.col("n"), F.col("rows"), a, b).alias("inv_prop"))


def fit_propensity(counts: list[int], n: int, samples: int = 26) -> tuple[float, float, float]:
    """A, B and the objective: sorted propensities at evenly spaced places against a sigmoid from -5 to 5.

    A coarse grid in [0, 100]^2, then ever finer steps around the best. counts: label supports (as many as the vocabulary).
    """
    import numpy as np

    support = np.sort(np.asarray(counts, float))
    at = np.linspace(0, len(support) - 1, samples).round().astype(int)
    want = 1 / (1 + np.exp(-np.linspace(-5, 5, samples)))

    def cost(a: float, b: float) -> float:
        c = (math.log(n) - 1) * (b + 1) ** a
        return float(np.linalg.norm(np.sort(1 / (1 + c * np.exp(-a * np.log(support[at] + b)))) - want))

    grid = [0.0, *np.geomspace(0.01, 100, 40)]
    best = min((cost(a, b), a, b) for a in grid for b in grid)
    step = 0.5
    while step > 1e-4:
        near = [(cost(a, b), a, b) for a in (best[1] * (1 - step), best[1], min(100, best[1] * (1 + step))) for b in (best[2] * (1 - step), best[2], min(100, best[2] * (1 + step)))]
        found = min(near)
        best, step = (found, step) if found[0] < best[0] - 1e-12 else (best, step / 2)
    return best[1], best[2], best[0]


def frequency_distribution(items: DataFrame, column: str) -> DataFrame:
    """n, values: how many values occur n times; what a plot of the distribution shows."""
    return items.groupBy(column).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("values"))


def in_all(*frames: DataFrame, key: str) -> DataFrame:
    """Rows of the first whose key is in every other."""
    first, *rest = frames
    for other in rest:
        first = first.join(other.select(key).distinct(), key, "left_semi")
    return first


def digest_frequent(df: DataFrame, hashes: str, above: int = 5) -> DataFrame:
    """digest, n of MinHash signatures found more often than above."""
    return df.select(F.md5(F.array_join(F.transform(hashes, lambda x: x.cast("string")), ",")).alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > above)
