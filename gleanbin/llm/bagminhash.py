"""Near duplicates by BagMinHash: weighted-Jaccard signatures of word shingles, banded, verified by multiset overlap.

Signature. A text is the multiset of its five-word shingles; a shingle found w times has weight w. Weights are
discretised to whole numbers and cut into blocks (0, 1], (1, 2], (2, 4], (4, 8] ... Each shingle and block has a Poisson
process of its own, with a rate as the block's width, whose points are seeded by shingle, block and number. Each point
falls on one register and, halving the block again and again, on one level in it; it counts if that level is not above w.
A register keeps its earliest point. Two texts agree in a register with a probability of their weighted Jaccard
similarity. Points are made in rising time, and a process ends once it is later than the text's latest register.

Bands. 32 bands of 6 registers: texts of similarity 0.8 share a bucket with a probability of 0.99994. Copies of a text are
first gathered by its digest, so buckets hold different texts only.

Verification. In a bucket, each text is first compared with one pivot, the text that shares most buckets (most likely the
original of its copies). Texts of at least 0.8 by their true multisets are linked; components of the links are found.
Then, as long as it pays, buckets that hold several components compare one text of the largest with one of each other
component: the pairs of a round are as many as the components, not the texts. These rounds only save work. At the end
each pair of different components in each bucket is compared in full: all but a bucket's largest component meet all its
texts, dealt to blocks; shingles common to two texts are counted by their hashes, which can't miss a pair, and pairs that
reach 0.8 are verified by their texts. So every pair that shares a bucket is compared or joined already, and components
of the links are the classes. A bucket whose m texts stay in different components costs m^2 / 2 such counts; one whose r
texts stand apart from the rest, r x m. What can be missed is the bands' own odds alone; tests hold the classes against
brute force.

Defined cases: null text is empty; texts of fewer than five words have one shingle, of all their words; texts without a
word are in a class with equal texts only; class_id is the smallest doc_id of the class; of rows that repeat a doc_id with
different texts, those texts of which it is the smallest id are one class; rows without doc_id share the class of equal
texts, null if there is none with an id; very long texts are read whole, CHUNK shingles at a time; an empty table gives
an empty result; other columns are passed by, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanbin.llm.common import Scratch, among, discard, give_back, restored, shielded, written

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Shingles that are worked on at once; words whose hashes a worker remembers.
BATCH, REMEMBERED = 200_000, 400_000
#: Shingles whose processes run at once.
CHUNK = 500_000
#: Share of a round's pairs that must be links for another round; what rounds leave is compared in full, so it moves time only.
WORTH = 0.125
#: Texts and shingles, about, of a block in which each text is compared with each; texts that make a shingle frequent.
BLOCK, BLOCK_ITEMS, FREQUENT = 512, 500_000, 32
U = np.uint64
ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * ODD[1]
    x = (x ^ (x >> U(27))) * ODD[2]
    return x ^ (x >> U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    """A hash of each five-word window; of all words, if there are fewer."""
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    if len(h) < WORDS:
        h = np.concatenate([h, np.full(WORDS - len(h), len(h), np.uint64)]) if len(h) else h
    n = len(h) - WORDS + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(WORDS):
        out = (out ^ h[k : k + n]) * ODD[k] + (out >> U(29))
    return mixed(out)


def signatures(items: np.ndarray, owner: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """Registers of n texts; items: shingle hashes with repeats, owner: the text of each. Rows of inf have no shingle."""
    reg = np.full(n * registers, np.inf)
    if not len(items):
        return reg.reshape(n, registers)
    key = items + mixed(owner.astype(np.uint64) + ODD[0])
    by = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
    weight = np.diff(np.concatenate([starts, [len(by)]]))
    item, doc = items[by[starts]], owner[by[starts]]
    block = 0
    at_item, at_doc, at_weight = item, doc, weight
    while len(at_item):  # blocks (0, 1], (1, 2], (2, 4] ...: few shingles reach the later ones
        low, width = (0, 1) if not block else (1 << block - 1, 1 << block - 1)
        for k in range(0, len(at_item), CHUNK):
            part = slice(k, k + CHUNK)
            _points(reg, registers, at_item[part], at_doc[part], at_weight[part] - low, block, width)
        block += 1
        more = at_weight > (1 << block - 1)
        at_item, at_doc, at_weight = at_item[more], at_doc[more], at_weight[more]
    return reg.reshape(n, registers)


def _points(reg: np.ndarray, registers: int, item: np.ndarray, doc: np.ndarray, levels: np.ndarray, block: int, width: int) -> None:
    """Runs the processes of one block: times into reg until each is past its text's latest register."""
    seed = mixed(item + U(int(ODD[3]) * (block + 1) % 2**64))
    t, k = np.zeros(len(seed)), 0
    while len(seed):
        c = int(max(1, min(512, 65536 // len(seed))))
        h = mixed(seed[:, None] + ODD[0] * np.arange(k + 1, k + c + 1, dtype=np.uint64)[None, :])
        gap = -np.log(((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        times = t[:, None] + (np.cumsum(gap, axis=1) if c > 1 else gap)
        latest = reg.reshape(-1, registers).max(axis=1)
        alive = times < latest[doc][:, None]
        g = mixed(h + ODD[4])
        if width > 1:  # the level in the block, by halving: the leading bits
            alive &= (g >> U(64 - (width.bit_length() - 1))).astype(np.int64) < levels[:, None]
        r, _ = np.nonzero(alive)
        np.minimum.at(reg, doc[r] * registers + ((g[alive] & U(0xFFFFFFFF)) % U(registers)).astype(np.int64), times[alive])
        t, k = times[:, -1], k + c
        stay = t < reg.reshape(-1, registers).max(axis=1)[doc]
        seed, doc, levels, t = seed[stay], doc[stay], levels[stay], t[stay]


def band_hashes(reg: np.ndarray, bands: int = BANDS) -> np.ndarray:
    bits = np.ascontiguousarray(reg).view(np.uint64).reshape(len(reg), bands, -1)
    out = np.zeros(bits.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * ODD[3]
    for k in range(bits.shape[2]):
        out = mixed((out ^ bits[:, :, k]) * ODD[0] + ODD[k % 5])
    return out.view(np.int64)


def signed(documents: DataFrame) -> DataFrame:
    """doc_id, h (digest of the text), n (shingles), bands array<long> of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()

        def emit(ids, digests, parts):
            sizes = np.array([len(p) for p in parts], np.int64)
            reg = signatures(np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes), len(parts))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(parts) * BANDS + 1, BANDS), pa.int32()), pa.array(band_hashes(reg).ravel()))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string()), pa.array(sizes), bands], ["doc_id", "h", "n", "bands"])

        for batch in batches:
            ids, digests, parts, held = [], [], [], 0
            for doc_id, h, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                ids.append(doc_id.as_py())
                digests.append(h.as_py())
                parts.append(shingle_hashes((text.as_py() or b"").split(), cache))
                held += len(parts[-1])
                if held >= BATCH:
                    yield emit(ids, digests, parts)
                    ids, digests, parts, held = [], [], [], 0
            if ids:
                yield emit(ids, digests, parts)
        cache.clear()
        give_back()

    text = F.coalesce("text", F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("h"), text.cast("binary").alias("text")).mapInArrow(run, "doc_id long, h string, n long, bands array<long>")


def overlap(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    if len(a) > len(b):
        a, b = b, a
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / ((a.total() + b.total() - both) or 1)


def shingles(text: bytes) -> Counter:
    w = text.split()
    return Counter(zip(*(w[k:] for k in range(WORDS)))) if len(w) >= WORDS else Counter([tuple(w)] if w else [])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, similarity of the pairs a, b (node ids), from the texts themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bag = None, Counter()
        for batch in batches:
            sims = []
            for ta, tb in zip(batch.column(2), batch.column(3)):
                if last is None or not ta.equals(last):  # rows come by a
                    last, bag = ta, shingles(ta.as_py())
                sims.append(overlap(bag, shingles(tb.as_py())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    of = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", F.col("text_a").cast("binary"), F.col("text_b").cast("binary")).mapInArrow(run, "a long, b long, similarity double")


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """node, component (its smallest node) of the nodes of edges a, b: labels flow along edges and are looked up again."""
    spark = edges.sparkSession
    both, both_path = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label, path = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "label")
    while True:
        near = both.join(label.toDF("b", "_l"), "b").groupBy(F.col("a").alias("node")).agg(F.min("_l").alias("_near"))
        near, near_path = written(near, "near")
        step, step_path = written(label.join(near, "node").select("node", F.least("component", "_near").alias("component"), (F.col("_near") < F.col("component")).alias("moved")), "step")
        short, short_path = written(step.join(step.select(F.col("node").alias("component"), F.col("component").alias("_far")), "component").select("node", F.least("component", "_far").alias("component"), (F.col("moved") | (F.col("_far") < F.col("component"))).alias("moved")), "short")
        moved = short.where("moved").limit(1).count()
        discard(spark, path, near_path, step_path)
        label, path = short.select("node", "component"), short_path
        if not moved:
            discard(spark, both_path)
            return label, path


def _buckets(nodes: DataFrame, own: Scratch) -> DataFrame:
    """bucket, node, n, size, pop of the buckets with several texts; pop: texts that a text meets, summed over its buckets."""
    step = Scratch(nodes.sparkSession)
    every = step.written(nodes.select("node", "n", F.explode("bands").alias("bucket")), "bands")
    shared = step.written(every.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    member = step.written(every.join(shared, "bucket").select("bucket", "node", "n", "size"), "member")
    pop = step.written(member.groupBy("node").agg(F.sum("size").alias("pop")), "pop")
    out = own.written(member.join(pop, "node").select("bucket", "node", "n", "size", "pop"), "buckets")
    step.clear()
    return out


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _sized(n: str, m: str):
    """Sizes that allow the similarity."""
    return F.least(n, m) >= LEAST * F.greatest(n, m)


def _star(members: DataFrame) -> DataFrame:
    """Pairs of each bucket's most met text with all others."""
    first = F.max(F.struct("pop", -F.col("node"), "node", "n")).alias("p")
    pivot = members.groupBy("bucket").agg(first).select("bucket", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"))
    pairs = members.join(pivot, "bucket").where((F.col("node") != F.col("pivot")) & _sized("n", "pivot_n"))
    return pairs.select(*_pair("node", "pivot")).distinct()


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members with the component of each."""
    return members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _apart(of: DataFrame, own: Scratch) -> DataFrame:
    """Pairs of components that meet in a bucket: one text of the largest with one of each other."""
    first = F.max(F.struct("pop", -F.col("node"), "node", "n")).alias("p")
    reps = own.written(of.groupBy("bucket", "component").agg(F.count("*").alias("m"), first), "reps")
    top = reps.groupBy("bucket").agg(F.max(F.struct("m", "p")).alias("top"), F.count("*").alias("k")).where("k > 1")
    pairs = reps.join(top, "bucket").select("p.node", "p.n", F.col("top.p.node").alias("pivot"), F.col("top.p.n").alias("pivot_n"))
    return pairs.where((F.col("node") != F.col("pivot")) & _sized("n", "pivot_n")).select(*_pair("node", "pivot")).distinct()


def elements(texts: DataFrame) -> DataFrame:
    """node, items of texts: a hash for each shingle and time it occurs, so that multisets overlap as sets of these do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            parts = []
            for text in batch.column(1):
                h = np.sort(shingle_hashes(text.as_py().split(), cache))
                at = np.arange(len(h))
                first = np.maximum.accumulate(np.where(np.concatenate([[True], h[1:] != h[:-1]]), at, 0)) if len(h) else at
                parts.append(mixed(h + (at - first).astype(U) * ODD[1]).view(np.int64))
            ends = np.cumsum([0] + [len(x) for x in parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))], ["node", "items"])
        cache.clear()
        give_back()

    return texts.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(run, "node long, items array<long>")


def in_common(items: np.ndarray, owner: np.ndarray, n: int, left: int) -> np.ndarray:
    """Of n sets, how many items each of the first left ones shares with each of the others; with each later one, if left = n."""
    by = np.argsort(items, kind="stable")
    items, owner = items[by], owner[by]
    starts = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]])) if len(items) else np.empty(0, int)
    times = np.diff(np.concatenate([starts, [len(items)]]))
    of = np.repeat(times, times)
    out = np.zeros((left, n), np.int64)
    rare = (of > 1) & (of < FREQUENT)
    e, o = items[rare], owner[rare]
    for k in range(1, FREQUENT):  # rows of one item stand together, by owner
        same = e[k:] == e[:-k]
        if not same.any():
            break
        low, high = o[:-k][same], o[k:][same]
        cross = (low < left) & ((high >= left) | (left == n))
        out += np.bincount(low[cross] * n + high[cross], minlength=left * n).reshape(left, n)
    far = 0 if left == n else left
    out = out[:, far:]
    often = np.flatnonzero(times >= FREQUENT)
    column = np.repeat(np.arange(len(often)), times[often])
    o = owner[of >= FREQUENT]
    for at in range(0, len(often), 2048):
        a, b = np.searchsorted(column, [at, at + 2048])
        x = np.zeros((n, min(2048, len(often) - at)), np.float32)
        x[o[a:b], column[a:b] - at] = 1
        out += (x[:left] @ x[far:].T).astype(np.int64)
    return np.triu(out, 1) if left == n else out


def _open(of: DataFrame, own: Scratch) -> DataFrame:
    """Buckets that hold several components: top (the largest component), lo, hi (shingles that can be near a text of
    the rest), and into how many parts the rest and all its texts are dealt. Buckets of the same texts are one."""
    sizes = of.groupBy("bucket", "component").agg(
        F.count("*").alias("m"),
        F.sum("n").alias("shingles"),
        F.min("n").alias("lo"),
        F.max("n").alias("hi"),
        F.bit_xor(F.xxhash64("node")).alias("x1"),
        F.bit_xor(F.xxhash64("node", F.lit(7))).alias("x2"),
    )
    sizes = own.written(sizes, "sizes")
    whole = sizes.groupBy("bucket").agg(
        F.max(F.struct("m", "component"))["component"].alias("top"),
        F.count("*").alias("k"),
        F.sum("m").alias("m"),
        F.sum("shingles").alias("shingles"),
        F.bit_xor("x1").alias("x1"),
        F.bit_xor("x2").alias("x2"),
    )
    whole = whole.where("k > 1 and m > 2")  # of two texts one was the pivot
    whole = whole.groupBy("m", "x1", "x2").agg(F.min(F.struct("bucket", "top", "shingles")).alias("b")).select("b.*", "m")
    rest = sizes.select("bucket", "component", "lo", "hi", F.col("m").alias("r"), F.col("shingles").alias("r_shingles"))
    rest = rest.join(whole, "bucket").where("component <> top").groupBy("bucket", "top", "m", "shingles")
    rest = rest.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("r").alias("r"), F.sum("r_shingles").alias("r_shingles"))
    parts = lambda rows, items: F.ceil(F.greatest(F.col(rows) / BLOCK, F.col(items) / BLOCK_ITEMS)).cast("int")
    return own.written(
        rest.select(
            "bucket",
            "top",
            (F.col("lo") * LEAST).alias("lo"),
            (F.col("hi") / LEAST).alias("hi"),
            parts("r", "r_shingles").alias("parts_rest"),
            parts("m", "shingles").alias("parts_all"),
        ),
        "open",
    )


def _every(of: DataFrame, texts: DataFrame, own: Scratch) -> DataFrame:
    """Pairs a, b of different components that share a bucket and, by hashes of their shingles, reach LEAST.

    In a bucket, texts of all but the largest component (the rest) meet all texts, in blocks.
    """
    held = of.join(_open(of, own), "bucket").withColumn("rest", F.col("component") != F.col("top"))
    held = held.where(F.col("rest") | F.col("n").between(F.col("lo"), F.col("hi")))
    deal = lambda parts: F.pmod(F.xxhash64("node", "bucket"), F.col(parts)).cast("int")
    held = held.select("bucket", "node", "component", "rest", "parts_rest", "parts_all", deal("parts_rest").alias("i"), deal("parts_all").alias("j"))
    held = own.written(held, "held")
    items = own.written(elements(among(texts, "node", own.written(held.select("node").distinct(), "ids"))), "items")
    turn = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    asking = held.where("rest").withColumn("j", turn("parts_all")).withColumn("right", F.lit(False))
    asked = held.withColumn("i", turn("parts_rest")).withColumn("right", F.lit(True))
    dealt = asking.unionByName(asked).select("bucket", "i", "j", "right", "node", "component").join(items, "node")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("right")
        right, node, component = (group.column(c).to_numpy() for c in ("right", "node", "component"))
        lists = group.column("items").combine_chunks()
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        m, left = len(node), int(len(node) - right.sum())
        both = in_common(lists.flatten().to_numpy(), np.repeat(np.arange(m), n), m, left)
        near = both >= LEAST * np.maximum(n[:left, None] + n[None, left:] - both, 1)
        x, y = np.nonzero(near & (component[:left, None] != component[None, left:]))
        x, y = node[x], node[left + y]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long").distinct()


def links(nodes: DataFrame, texts_of, own: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links a, b of at least LEAST, and node, component of what they join; both read tables of own.

    nodes: node, n, bands; texts_of(ids): node, text.
    """
    members = _buckets(nodes.where("n > 0"), own)
    texts = own.written(texts_of(members.select("node").distinct()), "texts")
    near = F.col("similarity") >= LEAST

    def joined(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        labels, path = components(found)
        own.paths.append(path)
        return own.written(_labelled(members, labels), "labelled"), labels

    tried = own.written(verified(_star(members), texts), "tried")
    found, seen = tried.where(near), tried.select("a", "b")
    while True:
        of, labels = joined(found)
        tried = own.written(verified(_apart(of, own).join(seen, ["a", "b"], "left_anti"), texts), "tried")
        counts = tried.agg(F.count("*").alias("n"), F.count_if(near).alias("near")).first()
        if counts["near"]:
            found, seen = found.unionByName(tried.where(near)), seen.unionByName(tried.select("a", "b"))
        if counts["near"] < counts["n"] * WORTH or not counts["near"]:
            break
    if counts["near"]:
        of, labels = joined(found)
    rest = own.written(verified(own.written(_every(of, texts, own), "every"), texts).where(near), "rest")
    if rest.limit(1).count():
        found = found.unionByName(rest)
        labels, path = components(found)
        own.paths.append(path)
    return found, labels


def classed(documents: DataFrame) -> tuple[DataFrame, DataFrame, Scratch]:
    """Every row's doc_id and text digest h; of each h its node (smallest doc_id) and class_id; what holds both."""
    own, kept = Scratch(documents.sparkSession), Scratch(documents.sparkSession)
    sig = own.written(signed(documents), "signed")
    each = sig.groupBy("h").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = own.written(each, "nodes")

    def texts_of(ids: DataFrame) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        t = documents.select(F.col("doc_id").cast("long").alias("node"), text.alias("text"))
        near = among(t, "node", own.written(ids, "ids")).withColumn("h", F.md5("text"))
        # of a doc_id that repeats, the texts of which it is the smallest
        return near.join(nodes.select("node", "h"), ["node", "h"], "left_semi").dropDuplicates(["node", "h"]).drop("h")

    _, labels = links(nodes.where("node is not null").select("node", "n", "bands"), texts_of, own)
    label = F.coalesce("component", "node").alias("class_id")
    classes = kept.written(nodes.join(labels, "node", "left").select("h", "node", label), "classes")
    rows = kept.written(sig.select("doc_id", "h"), "rows")
    own.clear()
    return rows, classes, kept


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id and class_id of every row."""
    rows, classes, _ = classed(documents.select("doc_id", "text"))
    return rows.join(classes, "h").select("doc_id", "class_id")


def first_of_each(documents: DataFrame) -> DataFrame:
    """One row of each class, that of the smallest doc_id, with its own columns."""
    _, classes, _ = classed(documents.select("doc_id", "text"))
    first = classes.where("node <=> class_id").groupBy("node", F.when(F.col("node").isNull(), F.col("h")).alias("alone"))
    first = first.agg(F.min("h").alias("h")).select("h", "node")
    rows, names = shielded(documents)
    text, doc_id = (F.col(names[c]) for c in ("text", "doc_id"))
    kept = rows.withColumn("h", F.md5(F.coalesce(text, F.lit("")))).join(first, "h").where(doc_id.cast("long").eqNullSafe(F.col("node")))
    return restored(kept.dropDuplicates(["h"]), names)
