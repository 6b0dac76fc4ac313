"""A token-order language model: n-gram counts, scores, and the likeliest order of a label set."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanbin.plans.tables import written

BEGIN, END, UNKNOWN = "<s>", "</s>", "<unk>"


def split_labels(text: Column) -> Column:
    """Labels of a line, apart at white space or underscores."""
    return F.filter(F.split(text, r"[\s_]+"), lambda x: x != "")


def padded(labels: Column) -> Column:
    return F.concat(F.array(F.lit(BEGIN)), labels, F.array(F.lit(END)))


def _slices(n: int):
    return lambda i: F.array_join(F.slice("p", i, n), " ")


def ngrams(sequences: DataFrame, labels: str, order: int = 3) -> DataFrame:
    """n, gram, count of all n-grams up to order, with marks of begin and end."""
    p = sequences.select(padded(F.col(labels)).alias("p"))
    each = None
    for n in range(1, order + 1):
        spots = F.when(F.size("p") >= n, F.sequence(F.lit(1), F.size("p") - n + 1)).otherwise(F.array().cast("array<int>"))
        grams = p.select(F.lit(n).alias("n"), F.explode(F.transform(spots, _slices(n))).alias("gram"))
        each = grams if each is None else each.unionByName(grams)
    return each.groupBy("n", "gram").agg(F.count("*").alias("count"))


# --- estimates ------------------------------------------------------------------------------------------------------------


def adjusted(counts: DataFrame, order: int = 3) -> DataFrame:
    """n, gram, a: counts of the longest n-grams and of those that begin a sequence; of others, how many words precede them."""
    begins = (F.col("gram") == BEGIN) | F.startswith("gram", F.lit(f"{BEGIN} "))
    own = counts.where((F.col("n") == order) | begins).select("n", "gram", F.col("count").alias("a"))
    tail = F.expr("substring(gram, instr(gram, ' ') + 1)")
    left = counts.where("n > 1").groupBy((F.col("n") - 1).alias("n"), tail.alias("gram")).agg(F.count("*").alias("a"))
    return own.unionByName(left)


def estimates(counts: DataFrame, order: int = 3) -> DataFrame:
    """n, gram, prob, backoff (log10) by interpolated modified Kneser-Ney, and <unk>; BEGIN is never predicted.

    Discounts of adjusted counts of 1, 2 and more come from the counts of counts; where those are too few to give discounts
    between 0 and the count, they are 0.5, 1 and 1.5. All of it is joins and sums: what a gram needs is the sums of its
    context and the estimate of its tail.
    """
    a, _ = written(adjusted(counts, order).where(F.col("gram") != BEGIN), "lm-adjusted")
    t = a.groupBy("n").agg(*[F.count_if(F.col("a") == k).alias(f"t{k}") for k in (1, 2, 3, 4)])
    y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))
    raw = [k - (k + 1) * y * F.try_divide(F.col(f"t{k + 1}"), F.col(f"t{k}")) for k in (1, 2, 3)]
    fine = F.lit(True)
    for k, d in enumerate(raw, 1):
        fine = fine & F.coalesce((d >= 0) & (d <= k), F.lit(False))
    discounts = t.select("n", *[F.when(fine, d).otherwise(float(k) / 2).alias(f"d{k}") for k, d in enumerate(raw, 1)])
    a = a.join(F.broadcast(discounts), "n")  # a row for each order
    a = a.withColumns({"context": F.expr("substring_index(gram, ' ', n - 1)"), "tail": F.expr("substring(gram, instr(gram, ' ') + 1)")})
    d = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
    sums = a.groupBy("n", "context").agg(F.sum("a").alias("all"), F.sum(d).alias("left"), F.count("*").alias("kinds"))
    sums, _ = written(sums.select("n", "context", "all", (F.col("left") / F.col("all")).alias("gamma"), "kinds"), "lm-contexts")
    words = sums.where("n = 1").select("gamma", (F.col("kinds") + 1).alias("size"))
    out = low = None
    for n in range(1, order + 1):
        of = a.where(F.col("n") == n).join(sums.where(F.col("n") == n).drop("n", "kinds"), "context")
        own = (F.col("a") - d) / F.col("all")
        if n == 1:
            level = of.drop("gamma").join(F.broadcast(words), F.lit(True)).select("gram", (own + F.col("gamma") / F.col("size")).alias("p"))  # one row
            level = level.unionByName(words.select(F.lit(UNKNOWN).alias("gram"), (F.col("gamma") / F.col("size")).alias("p")))
        else:
            level = of.join(low.select(F.col("gram").alias("tail"), F.col("p").alias("lower")), "tail").select("gram", (own + F.col("gamma") * F.col("lower")).alias("p"))
        level, _ = written(level, f"lm-{n}")
        low, out = level, level.withColumn("n", F.lit(n)) if out is None else out.unionByName(level.withColumn("n", F.lit(n)))
    out = out.unionByName(out.limit(0).unionByName(counts.sparkSession.createDataFrame([(BEGIN, 1e-99, 1)], "gram string, p double, n int")))
    back = sums.where("n > 1").select(F.col("context").alias("gram"), F.log10("gamma").alias("backoff"))
    return out.join(back, "gram", "left").select("n", "gram", F.log10("p").alias("prob"), F.coalesce("backoff", F.lit(0.0)).alias("backoff"))


def backoff_scores(sequences: DataFrame, row: str, labels: str, table: DataFrame) -> DataFrame:
    """row, score: log10 of each sequence under the estimates (order 3): the longest n-gram that is there, and the weights
    of the contexts that aren't continued so. Words are met by joins, however large the table is."""
    p = sequences.select(F.col(row).alias("row"), padded(F.col(labels)).alias("p"))
    join = lambda i, n: F.when(i >= n, F.array_join(F.slice("p", i - n + 1, n), " "))
    spots = F.transform(F.sequence(F.lit(2), F.size("p")), lambda i: F.struct(i.alias("pos"), *[join(i, n).alias(f"g{n}") for n in (1, 2, 3)], join(i - 1, 1).alias("c1"), join(i - 1, 2).alias("c2")))
    each = p.select("row", F.explode(spots).alias("s")).select("row", "s.*")
    kinds = ["g1", "g2", "g3", "c1", "c2"]
    long = each.select("row", "pos", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("gram")) for k in kinds], F.struct(F.lit("unk").alias("kind"), F.lit(UNKNOWN).alias("gram")))).alias("k"))
    hit = long.select("row", "pos", "k.kind", "k.gram").join(table, "gram")
    value = lambda kind, column: F.max(F.when(F.col("kind") == kind, F.col(column)))
    at = hit.groupBy("row", "pos").agg(*[value(k, "prob").alias(k) for k in ("g1", "g2", "g3", "unk")], *[value(k, "backoff").alias(k) for k in ("c1", "c2")])
    zero = F.lit(0.0)
    one = F.coalesce("g1", "unk")
    two = F.coalesce(F.col("g2"), F.coalesce("c1", zero) + one)
    return at.groupBy("row").agg(F.sum(F.coalesce(F.col("g3"), F.coalesce("c2", zero) + two)).alias("score"))


# --- order ----------------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """The estimates that some labels need: gram -> (log10 probability, log10 weight of its shorter context)."""

    table: dict[str, tuple[float, float]]
    order: int = 3

    def log_prob(self, context: tuple[str, ...], word: str) -> float:
        """log10 of the word after its context."""
        context = context[max(0, len(context) - self.order + 1) :]
        weight = 0.0
        for k in range(len(context) + 1):
            found = self.table.get(" ".join([*context[k:], word]))
            if found is not None:
                return weight + found[0]
            if k < len(context):
                weight += self.table.get(" ".join(context[k:]), (0.0, 0.0))[1]
        return weight + self.table.get(UNKNOWN, (-99.0, 0.0))[0]

    def score(self, labels: list[str], bos: bool = True, eos: bool = True) -> float:
        context, out = (BEGIN,) if bos else (), 0.0
        for w in [*labels, *([END] if eos else [])]:
            out += self.log_prob(context, w)
            context = (*context, w)[-(self.order - 1) :] if self.order > 1 else ()
        return out

    def greedy(self, labels: list[str]) -> list[str]:
        """Appends the label that scores best, again and again; ties by name."""
        rest, out = sorted(set(labels)), []
        while rest:
            best = max(rest, key=lambda w: self.score([*out, w], eos=False))
            out.append(best)
            rest.remove(best)
        return out

    def best_order(self, labels: list[str], most_steps: int | None = None) -> list[str]:
        """The order of highest score: depth first from the greedy one, dropping prefixes that are no better.

        A prefix's score bounds its extensions', as every word adds a negative logarithm. The search ends by its bound;
        most_steps ends it earlier, with the best order so far.
        """
        names = sorted(set(labels))
        best = self.greedy(names)
        bound, stack, steps = self.score(best), [[w] for w in names], 0
        while stack and (most_steps is None or steps < most_steps):
            steps += 1
            at = stack.pop()
            if len(at) == len(names):
                s = self.score(at)
                if s > bound:
                    best, bound = at, s
                continue
            next_ = [(self.score([*at, w], eos=False), [*at, w]) for w in names if w not in at]
            stack += [x for s, x in sorted(next_) if s > bound]
        return best


def _needed(sets: DataFrame) -> DataFrame:
    """labels, gram: the n-grams that orders of each set of labels (labels, distinct) can hold."""
    own, first, last = F.col("labels"), F.concat(F.array(F.lit(BEGIN)), "labels"), F.concat("labels", F.array(F.lit(END)))
    pairs = F.flatten(F.transform(first, lambda x: F.transform(F.filter(last, lambda y: y != x), lambda y: F.concat_ws(" ", x, y))))
    triples = F.flatten(F.transform(first, lambda x: F.flatten(F.transform(F.filter(own, lambda y: y != x), lambda y: F.transform(F.filter(last, lambda z: (z != x) & (z != y)), lambda z: F.concat_ws(" ", x, y, z))))))
    return sets.select("labels", F.explode(F.concat(F.array(F.lit(BEGIN), F.lit(END), F.lit(UNKNOWN)), own, pairs, triples)).alias("gram"))


@dataclass
class Fitted:
    """A model as a table of estimates; nothing of it is held by the driver but what one set of labels needs."""

    table: DataFrame

    def model(self, labels: list[str]) -> Model:
        one = self.table.sparkSession.createDataFrame([(sorted(set(labels)),)], "labels array<string>")
        return Model({r["gram"]: (r["prob"], r["backoff"]) for r in _needed(one).join(self.table, "gram").collect()})

    def best_order(self, labels: list[str]) -> list[str]:
        return self.model(labels).best_order(labels)


def fitted(sequences: DataFrame, labels: str) -> Fitted:
    """The model of order 3 of all n-grams, as a written table."""
    return Fitted(written(estimates(ngrams(sequences, labels)), "lm")[0])


def ordered(sets: DataFrame, labels: str, model: Fitted, most_steps: int | None = None) -> DataFrame:
    """Adds ordered (array) and score: the likeliest order of each label set.

    Each distinct set meets the estimates that its orders can need by a join; a worker holds those of one set.
    """
    key = F.array_sort(F.array_distinct(F.coalesce(labels, F.array().cast("array<string>"))))
    distinct = sets.select(key.alias("labels")).distinct()
    own = _needed(distinct).join(model.table.select("gram", "prob", "backoff"), "gram").groupBy("labels").agg(F.collect_list("gram").alias("g"), F.collect_list("prob").alias("p"), F.collect_list("backoff").alias("b"))

    @F.pandas_udf("struct<ordered:array<string>,score:double>")
    def run(names: pd.Series, grams: pd.Series, probs: pd.Series, weights: pd.Series) -> pd.DataFrame:
        out = []
        for x, g, p, b in zip(names, grams, probs, weights):
            m = Model(dict(zip(g, zip(p, b))))
            best = m.best_order(list(x), most_steps)
            out.append((best, m.score(best)))
        return pd.DataFrame(out, columns=["ordered", "score"])

    best = own.select("labels", run("labels", "g", "p", "b").alias("_o")).select(F.col("labels").alias("_key"), "_o")
    return sets.withColumn("_key", key).join(best, "_key", "left").select(*sets.columns, "_o.ordered", "_o.score")


def scored(sequences: DataFrame, row: str, labels: str, counts: DataFrame) -> DataFrame:
    """row, score: the sum over trigrams of log10(count / context count), joined with the counts; unseen ones add nothing."""
    p = sequences.select(F.col(row).alias("row"), padded(F.col(labels)).alias("p")).where(F.size("p") >= 3)
    tri = p.select("row", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 2), lambda i: F.struct(F.array_join(F.slice("p", i, 3), " ").alias("gram"), F.array_join(F.slice("p", i, 2), " ").alias("context")))).alias("t")).select("row", "t.gram", "t.context")
    three, two = counts.where("n = 3").select("gram", F.col("count").alias("c3")), counts.where("n = 2").select(F.col("gram").alias("context"), F.col("count").alias("c2"))
    return tri.join(three, "gram").join(two, "context").groupBy("row").agg(F.sum(F.log10(F.col("c3") / F.col("c2"))).alias("score"))


def exact_order_accuracy(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"))
