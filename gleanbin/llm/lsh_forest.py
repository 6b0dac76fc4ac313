"""Nearest neighbours by inner product with hash-prefix forests.

Placing. Distinct vectors are dealt to shells by length (a factor of two each), so that one long vector tells nothing
about the rest, and in a shell to cells by the first bits of a routing string, the sides of random hyperplanes; as many
bits as make about BLOCK vectors a cell. A cell that still holds more is dealt to several blocks by hash. Each block has
a cone: a centre, and the widest angle to it.

Forest. In a block, each of TREES trees gives every vector a string of BITS bits, the sides of random hyperplanes (the
vector is first lengthened by one component to the block's greatest length, so that angle orders as inner product does),
and holds its strings as a sorted array. Descending: each prefix of the query's string is a slice of the array, found by
binary search. Ascending: the prefix is shortened in all trees together, and what the slices newly hold is scored, until
a vector nearer than the K + 1st best so far would have been met with a probability of at least SURE: at angle t from the
query, a tree holds it in the slice of depth d with probability (1 - t / pi)^d. So the stop is set by what was found, not
by the table's size: in clusters after few candidates; vectors without structure (the 20 nearest of 50,000 random ones
stand at 66 degrees) lead the ascent on. Once the slices hold as many entries as the block has vectors, the ascent goes to
the root, whose slice is the block.

Search. A query first meets the block it lies in, which gives a floor for its K + 1st best score; then it meets those
other blocks whose length and cone allow a score above that floor. A block of very many queries is copied for parts of
them. Scores in a block are double; the best are scored again, term by term, on the original vectors. Equal vectors
are one point, with their smallest K + 1 ids, as no other could be among K nearest (128 bits of hash decide equality).

Defined cases: null, zero, null-holding and non-finite vectors, those not of the most frequent length, and rows without
vec_id take no part; ties go to the smaller vec_id; repeated rows of one vec_id count once; with fewer candidates than K
all are returned; a score beyond doubles is infinite, and then ties; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanbin.llm.common import Scratch, written

K, EVERY = 20, 20
TREES, BITS, SURE, SEED = 24, 32, 0.95, 11
#: Vectors of a block, about; bits of the routing string; queries that meet one copy of a block, about.
BLOCK, ROUTE, QUERIES = 20_000, 24, 100_000
#: Blocks and queries, about, that are held against each other at once.
CONES, ASKING = 1_000, 20_000
#: Scored beyond K + 1 on the original vectors, as sums in another order differ in the last bits.
SPARE = 12
#: Rows that equal vectors are first ranked in: parts of a group of equal vectors.
SALTS = 32
KEY = ["shell", "cell", "sub"]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    d = d.where((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    sizes = d.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return d.where(F.size("v") == (sizes[0]["size"] if sizes else 0))


def distinct_vectors(rows: DataFrame, own: Scratch) -> tuple[DataFrame, DataFrame]:
    """gid, v, ids (the K + 1 smallest) of each distinct vector; vec_id, gid of the queries. Written tables."""
    keyed = rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64("v", F.lit(SEED))})
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    ids = keyed.select("k1", "k2", "vec_id").distinct()
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("vec_id"))
    first = ids.withColumn("r", rank("k1", "k2", salt)).where(F.col("r") <= K + 1)
    few = first.withColumn("r", rank("k1", "k2")).where(F.col("r") <= K + 1)
    groups = few.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("gid", F.get("ids", F.lit(0)))
    groups = own.written(groups, "groups")
    reps = keyed.join(groups, ["k1", "k2"]).where("vec_id = gid").dropDuplicates(["gid", "k1", "k2"])
    asked = keyed.where(F.pmod("vec_id", F.lit(EVERY)) == 0).select("k1", "k2", "vec_id").distinct()
    queries = asked.join(groups, ["k1", "k2"]).select("vec_id", "gid")
    return own.written(reps.select("gid", "v", "ids"), "reps"), own.written(queries, "queries")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the base-2 logarithms of the lengths; neither overflows."""
    most = np.abs(v).max(axis=1, keepdims=True)
    scaled = v / most
    length = np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return scaled / length, (np.log2(most) + np.log2(length))[:, 0]


def placed(reps: DataFrame, dim: int) -> DataFrame:
    """gid, v, u (its direction), log_length, shell, route (the routing string as a number) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(SEED + 1).normal(size=(dim, ROUTE))
        bit = 1 << np.arange(ROUTE - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                u, log = directions(_matrix(batch.column(1), dim))
                route = ((u @ planes > 0) * bit).sum(axis=1)
                shell = np.floor(log + 0.5).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * dim), pa.array(u.ravel()))
                columns = [batch.column(0), batch.column(1), flat, pa.array(log), pa.array(shell), pa.array(route)]
                yield pa.RecordBatch.from_arrays(columns, ["gid", "v", "u", "log_length", "shell", "route"])

    return reps.select("gid", "v").mapInArrow(run, "gid long, v array<double>, u array<double>, log_length double, shell int, route long")


def blocked(reps: DataFrame, dim: int, own: Scratch) -> DataFrame:
    """gid, v, u, log_length and the block (KEY) of each vector."""
    rows = own.written(placed(reps, dim), "placed")
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("n") / BLOCK)), F.lit(0)), F.lit(ROUTE)).cast("int")
    shells = rows.groupBy("shell").agg(F.count("*").alias("n")).select("shell", bits.alias("bits"))
    in_cell = rows.join(F.broadcast(shells), "shell")  # a row for each power of two: 2,200 at most
    in_cell = in_cell.withColumn("cell", F.expr(f"shiftright(route, {ROUTE} - bits)").cast("long")).drop("route", "bits")
    cells = in_cell.groupBy("shell", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("subs"))
    out = in_cell.join(cells, ["shell", "cell"]).withColumn("sub", F.pmod(F.xxhash64("gid"), F.col("subs")))
    return own.written(out.select(*KEY, "gid", "v", "u", "log_length"), "blocked")


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cones(points: DataFrame, own: Scratch) -> DataFrame:
    """Of each block its centre (a vector of its own), the widest angle to it, and the greatest length (its logarithm)."""
    u = points.select(*KEY, "gid", "log_length", "u")
    centres = own.written(u.groupBy(*KEY).agg(F.min_by("u", F.xxhash64("gid")).alias("centre")), "centres")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot("u", "centre"))))
    wide = u.join(centres, KEY).groupBy(*KEY).agg(F.max(angle).alias("wide"), F.max("log_length").alias("longest"))
    return own.written(centres.join(wide, KEY), "cones")


class Forest:
    """The trees of one block."""

    def __init__(self, gid: np.ndarray, v: np.ndarray):
        self.gid, self.v, dim = gid, v, v.shape[1]
        u, log = directions(v)
        self.longest = log.max()
        share = np.exp2(log - self.longest)[:, None]
        self.planes = np.random.default_rng(SEED).normal(size=(dim + 1, TREES * BITS))
        self.bit = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        strings = np.concatenate(
            [self._strings(u[k : k + 2000] * share[k : k + 2000], np.sqrt(np.maximum(0, 1 - share[k : k + 2000] ** 2))) for k in range(0, len(u), 2000)]
        )
        self.order = [np.argsort(strings[:, t], kind="stable") for t in range(TREES)]
        self.sorted = [strings[o, t] for t, o in enumerate(self.order)]

    def _strings(self, u: np.ndarray, last: np.ndarray) -> np.ndarray:
        sides = np.hstack([u, last]) @ self.planes > 0
        return (sides.reshape(len(u), TREES, BITS) * self.bit).sum(axis=2)

    def slices(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries u, of each tree and depth, where in the sorted array the slice begins and ends."""
        h = self._strings(u, np.zeros((len(u), 1)))
        shift = np.arange(BITS, -1, -1, dtype=np.int64)  # of depths 0 to BITS
        low = (h[:, :, None] >> shift) << shift
        high = low + (np.int64(1) << shift)
        begin, end = np.empty(low.shape, np.int32), np.empty(low.shape, np.int32)
        for t in range(TREES):
            begin[:, t], end[:, t] = np.searchsorted(self.sorted[t], low[:, t]), np.searchsorted(self.sorted[t], high[:, t])
        return begin, end

    def deepest(self, score: float, log_length: float) -> float:
        """The depth from which on a vector of score or more, to a query so long, is met with probability SURE."""
        if score <= 0:
            return 0.0  # at a right angle or beyond
        t = np.arccos(min(1.0, np.exp2(np.log2(score) - log_length - self.longest))) / np.pi
        return np.inf if t <= 0 else np.log(1 - (1 - SURE) ** (1 / TREES)) / np.log1p(-t)

    def search(self, q: np.ndarray, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query the places of its best in the block, at least floor, and their scores."""
        u, log = directions(q)
        begin, end = self.slices(u)
        held = (end - begin).sum(axis=1, dtype=np.int64)  # by query and depth
        found: list = [None] * len(q)
        to_root, n = [], len(self.gid)
        seen = np.zeros(n, bool)
        for k in range(len(q)):
            depth = int(np.flatnonzero(held[k] >= min(2 * (K + 1), n))[-1])
            at, scores, best = [], [], floor[k]
            while depth > 0 and held[k, depth] < n:
                new = np.concatenate([self.order[t][begin[k, t, depth] : end[k, t, depth]] for t in range(TREES)])
                new = np.unique(new[~seen[new]])
                if len(new):
                    seen[new] = True
                    at.append(new)
                    scores.append(self.v[new] @ q[k])
                    every = np.concatenate(scores)
                    if len(every) > K:
                        best = max(best, np.partition(every, len(every) - K - 1)[-K - 1])
                if best == -np.inf:  # fewer than K + 1 met so far
                    depth -= 1
                    continue
                needed = self.deepest(best, log[k])
                if depth <= needed:
                    break
                depth = depth - 1 if held[k, int(needed)] < n else 0  # where it would end at the root, at once
            else:
                to_root.append(k)
            if at:
                seen[np.concatenate(at)] = False
            if not to_root or to_root[-1] != k:
                found[k] = self._best(np.concatenate(at), np.concatenate(scores), floor[k])
        for a in range(0, len(to_root), 128):
            part = to_root[a : a + 128]
            for k, s in zip(part, q[part] @ self.v.T):
                found[k] = self._best(np.arange(n), s, floor[k])
        return found

    def _best(self, at: np.ndarray, scores: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        most = K + 1 + SPARE
        least = floor - abs(floor) * 1e-9
        if len(scores) > most:
            least = max(least, np.partition(scores, len(scores) - most)[-most])
        keep = np.flatnonzero(scores >= least)
        keep = keep[np.lexsort((self.gid[at[keep]], -scores[keep]))[:most]]
        return at[keep], scores[keep]


def met(points: DataFrame, visits: DataFrame, dim: int) -> DataFrame:
    """qgid, gid, score of the best that each query finds in each block it visits. visits: KEY, gid, v, floor."""
    spark = points.sparkSession
    copies = visits.groupBy(*KEY).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("copies"))
    dealt = points.join(copies, KEY).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    asking = visits.join(copies, KEY).withColumn("copy", F.pmod(F.xxhash64("gid"), F.col("copies")).cast("int"))
    both = dealt.select(*KEY, "copy", F.lit(0).alias("kind"), "gid", "v", F.lit(0.0).alias("floor"))
    both = both.unionByName(asking.select(*KEY, "copy", F.lit(1).alias("kind"), "gid", "v", "floor"))
    at = [*KEY, "copy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, forest, block = [], None, None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(k)) for k in range(5)], axis=1)
            gid, v, floor = np.asarray(batch.column(5)), _matrix(batch.column(6), dim), np.asarray(batch.column(7))
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)]):
                if a == b:
                    continue
                if tuple(key[a, :4]) != block:
                    held, forest, block = [], None, tuple(key[a, :4])
                if key[a, 4] == 0:
                    held.append((gid[a:b], v[a:b]))
                    continue
                if forest is None:  # a block's points all come before its queries
                    forest, held = Forest(*(np.concatenate(x) for x in zip(*held))), []
                for k in range(a, b, 512):
                    part = slice(k, min(b, k + 512))
                    got = forest.search(v[part], floor[part])
                    who = np.repeat(gid[part], [len(x) for x, _ in got])
                    near = np.concatenate([forest.gid[x] for x, _ in got])
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(near), pa.array(np.concatenate([s for _, s in got]))], ["qgid", "gid", "score"])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return both.repartition(n, *at).sortWithinPartitions(*at, "kind").mapInArrow(run, "qgid long, gid long, score double")


def to_visit(floors: DataFrame, blocks: DataFrame, dim: int, own: Scratch) -> DataFrame:
    """KEY, gid: the blocks other than its own in which a query can find a score of its floor or more.

    The stated query set meets one row for each block, both in parts.
    """
    n_blocks, n_queries = blocks.count(), floors.count()
    parts, slices = -(-n_blocks // CONES), -(-n_queries // ASKING)
    turn = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(max(n, 1))).cast("int")
    left = floors.select(deal(slices, "gid").alias("s"), turn(parts).alias("p"), *KEY, "gid", "u", "log_length", "floor")
    right = blocks.select(deal(parts, *KEY).alias("p"), turn(slices).alias("s"), *KEY, "centre", "wide", "longest")

    def run(queries: pa.Table, cones: pa.Table) -> pa.Table:
        q, c = queries.combine_chunks(), cones.combine_chunks()
        centre, keys = _matrix(c.column("centre").combine_chunks(), dim), np.stack([c.column(x).to_numpy() for x in KEY], axis=1)
        wide, longest = c.column("wide").to_numpy(), c.column("longest").to_numpy()
        u, own_keys = _matrix(q.column("u").combine_chunks(), dim), np.stack([q.column(x).to_numpy() for x in KEY], axis=1)
        gid, log, floor = (q.column(x).to_numpy() for x in ("gid", "log_length", "floor"))
        who, where = [], []
        for a in range(0, len(u), 1000):
            part = slice(a, a + 1000)
            angle = np.maximum(np.arccos(np.clip(u[part] @ centre.T, -1, 1)) - wide - 1e-6, 0)
            with np.errstate(over="ignore"):
                most = np.exp2(log[part, None] + longest) * np.cos(angle)
            visit = (most + np.abs(most) * 1e-9 >= floor[part, None]) & (own_keys[part, None] != keys[None]).any(axis=2)
            x, y = np.nonzero(visit)
            who.append(gid[part][x])
            where.append(keys[y])
        who, where = np.concatenate(who), np.concatenate(where)
        return pa.table({"shell": where[:, 0].astype(np.int32), "cell": where[:, 1], "sub": where[:, 2], "gid": who})

    met_in = left.groupBy("p", "s").cogroup(right.groupBy("p", "s"))
    return own.written(met_in.applyInArrow(run, "shell int, cell long, sub long, gid long"), "to-visit")


def nearest(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score of each query's nearest found."""
    spark = vectors.sparkSession
    own = Scratch(spark)
    reps, queries = distinct_vectors(usable(vectors.select("vec_id", "embedding")), own)
    most = F.max(F.array_max(F.transform("v", F.abs)))
    stats = reps.agg(most.alias("top"), F.max(F.size("v")).alias("dim")).first()
    if stats["dim"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, scale = stats["dim"], 1.0
    if not 1e-100 < stats["top"] < 1e100:  # a power of two, so that it takes nothing from the scores
        scale = 2.0 ** -math.frexp(stats["top"])[1]
        reps = reps.withColumn("v", F.transform("v", lambda x: x * scale))
    points = blocked(reps, dim, own)
    asked = own.written(points.join(queries.select("gid").distinct(), "gid", "left_semi"), "asked")
    home = own.written(met(points, asked.withColumn("floor", F.lit(float("-inf"))), dim), "home")
    at = F.row_number().over(W.partitionBy("qgid").orderBy(F.desc("score")))
    # the K + 1st best of the home block: at least K vectors other than the query itself reach it
    floors = home.withColumn("r", at).where(F.col("r") == K + 1).select(F.col("qgid").alias("gid"), F.col("score").alias("floor"))
    floors = own.written(asked.join(floors, "gid", "left").fillna({"floor": float("-inf")}), "floors")
    visits = to_visit(floors, cones(points, own), dim, own).join(floors.select("gid", "v", "floor"), "gid")
    rest = met(points, own.written(visits, "visits"), dim)
    order = W.partitionBy("qgid").orderBy(F.desc("score"), "gid")
    best = home.unionByName(rest).withColumn("r", F.row_number().over(order)).where(F.col("r") <= K + 1 + SPARE).select("qgid", "gid")
    asking = reps.select(F.col("gid").alias("qgid"), F.col("v").alias("qv"))
    scored = best.join(reps, "gid").join(asking, "qgid").select("qgid", (_dot("qv", "v") / scale / scale).alias("score"), F.explode("ids").alias("vec_id"))
    by = W.partitionBy("qgid").orderBy(F.desc("score"), "vec_id")
    near = scored.withColumn("r", F.row_number().over(by)).where(F.col("r") <= K + 1)
    near, _ = written(near.select(F.col("qgid").alias("gid"), "vec_id", "score"), "near")
    asked_by, _ = written(queries.withColumnRenamed("vec_id", "query_id"), "asked-by")
    own.clear()
    ranked = asked_by.join(near, "gid").where("query_id <> vec_id")
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= K).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
