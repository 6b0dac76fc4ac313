"""Multi-label prediction: a tree ensemble with propensity-weighted leaves, threshold rules, an autoencoder, neighbour layers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanbin.plans.tables import discard, written

# Names that are known by rule and need no prediction.
CALCULABLE = ["init", "fini", "csu_init", "csu_fini", "start", "libc_csu_init", "libc_csu_fini", "libc_start", "deregister_tm_clones", "register_tm_clones", "rtld_init", "main", "do_global_dtors_aux", "frame_dummy", "frame_dummy_init_array_entry", "do_global_dtors_aux_fini_array_entry", "init_array_end", "init_array_start", "start_main", "libc_start_main"]


def predicted_names(scores: DataFrame, threshold: float) -> DataFrame:
    """row, name: labels with a score above the threshold, by score, joined by underscores."""
    s = scores.where(F.col("score") > threshold).groupBy("row").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "label"))).alias("l"))
    return s.select("row", F.array_join(F.transform("l", lambda x: x["label"].cast("string")), "_").alias("name"))


def top_labels(scores: DataFrame, k: int = 5) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "label"))).where(F.col("rank") <= k)


def without_calculable(df: DataFrame, name: str) -> DataFrame:
    return df.where(~F.col(name).isin(CALCULABLE))


def with_calculable(scores: DataFrame, truth: DataFrame, names: DataFrame) -> DataFrame:
    """Scores of rows with a calculable name (row, name) are those of the truth."""
    known = names.where(F.col("name").isin(CALCULABLE)).select("row")
    return scores.join(known, "row", "left_anti").unionByName(truth.join(known, "row", "left_semi").select("row", "label", F.lit(1.0).alias("score")))


# --- the ensemble -------------------------------------------------------------------------------------------------------


def train_ensemble(x: DataFrame, y: DataFrame, propensities: DataFrame, trees: int = 32, leaf: int = 10, kept: int = 100, share: int = 20_000, seed: int = 1) -> DataFrame:
    """tree, node, w, left, right, labels: trees of balanced two-means splits, each on a seeded sample of share rows.

    x: row, vector; y: row, label; propensities: label, inv_prop. A node's rows are split by two centroids of their
    vectors and weighted label sets until leaf rows are left; a leaf has its kept best labels by share x inv_prop.
    A tree is one group: share bounds its memory, more trees see more rows.
    """
    import numpy as np
    import pandas as pd

    n = x.count()
    odds = min(1.0, share / max(1, n))
    labels = y.join(propensities, "label").groupBy("row").agg(F.collect_list(F.struct("label", "inv_prop")).alias("labels"))
    rows = x.join(labels, "row").select("row", "vector", "labels")
    spread = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    pick = (F.pmod(F.xxhash64("row", "tree", F.lit(seed)), F.lit(1_000_000)) < int(odds * 1_000_000)) if odds < 1 else F.lit(True)
    spread = spread.where(pick)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        tree, rng = int(pdf["tree"].iloc[0]), np.random.default_rng(seed * 1000 + int(pdf["tree"].iloc[0]))
        v = np.array([np.asarray(a, float) for a in pdf["vector"]])
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        names = sorted({d["label"] for ls in pdf["labels"] for d in ls})
        at = {w: k for k, w in enumerate(names)}
        inv = np.ones(len(names))
        own = []
        for ls in pdf["labels"]:
            own.append([at[d["label"]] for d in ls])
            for d in ls:
                inv[at[d["label"]]] = d["inv_prop"]
        # labels as a fixed random projection, so that rows of rare common labels stand close
        code = rng.normal(size=(len(names), 24)) * inv[:, None]
        z = np.array([code[o].sum(axis=0) for o in own])
        z = np.hstack([v, z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)])
        nodes, open_ = [], [(0, np.arange(len(v)))]
        next_id = 1
        while open_:
            node, idx = open_.pop()
            if len(idx) > leaf:
                a, b = z[idx[rng.integers(len(idx))]], z[idx[rng.integers(len(idx))]]
                for _ in range(8):
                    side = z[idx] @ (a - b)
                    half = np.argsort(side, kind="stable")
                    left, right = idx[half[: len(idx) // 2]], idx[half[len(idx) // 2 :]]
                    b, a = z[left].mean(axis=0), z[right].mean(axis=0)
                w = v[right].mean(axis=0) - v[left].mean(axis=0)
                s = v[idx] @ w
                cut = float(np.median(s))
                go = s > cut
                if 0 < go.sum() < len(idx):
                    nodes.append((tree, node, [*map(float, w), cut], next_id, next_id + 1, []))
                    open_ += [(next_id, idx[~go]), (next_id + 1, idx[go])]
                    next_id += 2
                    continue
            count = np.zeros(len(names))
            for i in idx:
                count[own[i]] += 1
            score = count / len(idx) * inv
            best = np.argsort(-score, kind="stable")[:kept]
            nodes.append((tree, node, [], -1, -1, [{"label": names[k], "p": float(score[k])} for k in best if score[k] > 0]))
        return pd.DataFrame(nodes, columns=["tree", "node", "w", "left", "right", "labels"])

    return spread.groupBy("tree").applyInPandas(grow, "tree int, node int, w array<double>, left int, right int, labels array<struct<label:string,p:double>>")


def predict_ensemble(x: DataFrame, model: DataFrame, most_nodes: int = 400_000) -> DataFrame:
    """row, label, score: the mean over trees of the leaf's scores, scaled to at most 1 in each row.

    The model is written before it is read twice, so it is trained once. It is shipped to the workers; it has at most
    trees x 2 x share / leaf nodes, which is checked. A batch of rows goes down a tree together.
    """
    import numpy as np
    import pandas as pd

    model, path = written(model, "ensemble")
    nodes = model.count()
    if nodes > most_nodes:
        raise ValueError(f"the model has {nodes} nodes; train fewer trees or smaller shares")
    by_tree: dict[int, list] = {}
    for r in model.collect():
        by_tree.setdefault(r["tree"], []).append(r)
    discard(x.sparkSession, path)
    names = sorted({d["label"] for rows in by_tree.values() for r in rows for d in r["labels"]})
    at = {label: k for k, label in enumerate(names)}
    dim = max((len(r["w"]) for rows in by_tree.values() for r in rows), default=1)
    forest = []
    for rows in by_tree.values():
        n = max(r["node"] for r in rows) + 1
        w, below, leaves = np.zeros((n, dim)), np.full((n, 2), -1), {}
        for r in rows:
            if r["left"] >= 0:
                w[r["node"]], below[r["node"]] = r["w"], (r["left"], r["right"])
            else:
                leaves[r["node"]] = np.array([at[d["label"]] for d in r["labels"]], int), np.array([d["p"] for d in r["labels"]])
        forest.append((w, below, leaves))
    shared = x.sparkSession.sparkContext.broadcast((forest, np.array(names, object)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, names = shared.value
        for pdf in batches:
            for begin in range(0, len(pdf), 1000):
                part = pdf.iloc[begin : begin + 1000]
                v = np.array([np.asarray(a, float) for a in part["vector"]])
                v = np.hstack([v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), np.full((len(v), 1), -1.0)])
                total = np.zeros((len(v), len(names)))
                for w, below, leaves in forest:
                    node = np.zeros(len(v), int)
                    while (go := np.flatnonzero(below[node, 0] >= 0)).size:
                        right = (v[go] * w[node[go]]).sum(axis=1) > 0
                        node[go] = below[node[go], right.astype(int)]
                    for leaf in np.unique(node):
                        own, p = leaves[leaf]
                        total[np.ix_(node == leaf, own)] += p
                top = np.maximum(total.max(axis=1, initial=0), 1e-300)
                r, label = np.nonzero(total)
                yield pd.DataFrame({"row": part["row"].to_numpy()[r], "label": names[label], "score": (total / top[:, None])[r, label]})

    kind = dict(x.dtypes)["row"]
    return x.select("row", "vector").mapInPandas(run, f"row {kind}, label string, score double")


def tail_classifier(x: DataFrame, y: DataFrame, gamma: float = 30.0) -> DataFrame:
    """label, centroid: of unit vectors; scores fall off as exp(-gamma/2 |x - centroid|^2)."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v))
    unit = x.select("row", F.transform("vector", lambda v: v / norm).alias("u"))
    pos = y.join(unit, "row").select("label", F.posexplode("u").alias("pos", "v")).groupBy("label", "pos").agg(F.avg("v").alias("v"))
    return pos.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("centroid"), F.lit(gamma).alias("gamma"))


# --- dense layers -------------------------------------------------------------------------------------------------------


def principal_axes(x: DataFrame, k: int) -> DataFrame:
    """row, embedding: the k leading principal components; the deterministic encoder."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = x.select("row", array_to_vector(F.transform("vector", lambda a: a.cast("double"))).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="e").fit(v).transform(v).select("row", vector_to_array("e").alias("embedding"))


class Autoencoder:
    """A two-layer encoder and mirrored decoder in numpy, trained by Adam on mini-batches of a bounded sample."""

    def __init__(self, size: int, hidden: int = 64, code: int = 32, noise: float = 0.1, seed: int = 1):
        import numpy as np

        rng, self.noise, self.seed = np.random.default_rng(seed), noise, seed
        shapes = [(size, hidden), (hidden, code), (code, hidden), (hidden, size)]
        self.w = [rng.normal(0, a**-0.5, (a, b)) for a, b in shapes]
        self.b = [np.zeros(b) for _, b in shapes]

    def layers(self, x):
        import numpy as np

        out = [x]
        for k, (w, b) in enumerate(zip(self.w, self.b)):
            x = x @ w + b
            out.append(np.tanh(x) if k < 3 else x)
        return out

    def encode(self, x):
        return self.layers(x)[2]

    def fit(self, x, epochs: int = 20, batch: int = 64, rate: float = 1e-3) -> list[float]:
        """Mean squared error after each epoch, the last included."""
        import numpy as np

        rng = np.random.default_rng(self.seed)
        params = [*self.w, *self.b]
        m, v, t, losses = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, []
        for _ in range(epochs):
            for idx in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                clean = x[idx]
                acts = self.layers(clean + rng.normal(0, self.noise, clean.shape))
                d, gw, gb = 2 * (acts[4] - clean) / clean.size, [None] * 4, [None] * 4
                for k in range(3, -1, -1):
                    gw[k], gb[k] = acts[k].T @ d, d.sum(axis=0)
                    if k:
                        d = d @ self.w[k].T * (1 - acts[k] ** 2)
                t += 1
                for p, g, a, b in zip(params, [*gw, *gb], m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
            losses.append(float(((self.layers(x)[4] - x) ** 2).mean()))
        return losses


def encoded(x: DataFrame, code: int = 32, sample: int = 20_000, **options) -> DataFrame:
    """row, embedding by an autoencoder trained on about sample rows, those of the smallest hashes."""
    import numpy as np
    import pandas as pd

    train = _sampled(x, sample)
    net = Autoencoder(train.shape[1] if len(train) else 1, code=code)
    if len(train):
        net.fit(train, **options)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"row": pdf["row"], "embedding": list(net.encode(np.array(list(pdf["vector"]), float))) if len(pdf) else []})

    return x.select("row", "vector").mapInPandas(run, f"row {dict(x.dtypes)['row']}, embedding array<double>")


class BranchAutoencoder:
    """An encoder for each slice of the vector, joined into one code, and mirrored decoders; numpy, Adam, mini-batches.

    A branch is dense, batch normalisation, tanh and dropout; the code is dense on all branches together, with an L1 penalty
    on it and an L2 penalty on the weights. Dropout and batch statistics act in training only: encode() uses the running
    means and variances, so a row's code doesn't depend on its batch.
    """

    def __init__(self, slices: list[int], hidden: int = 32, code: int = 32, dropout: float = 0.25, penalty: float = 0.01, seed: int = 1):
        import numpy as np

        self.slices, self.hidden, self.dropout, self.penalty, self.seed = list(slices), hidden, dropout, penalty, seed
        rng, k = np.random.default_rng(seed), len(slices)
        dense = lambda a, b: rng.normal(0, max(a, 1) ** -0.5, (a, b))
        self.p = {"code.w": dense(k * hidden, code), "code.b": np.zeros(code), "open.w": dense(code, k * hidden), "open.b": np.zeros(k * hidden)}
        for i, n in enumerate(slices):
            self.p |= {f"in{i}.w": dense(n, hidden), f"in{i}.b": np.zeros(hidden), f"scale{i}": np.ones(hidden), f"shift{i}": np.zeros(hidden), f"out{i}.w": dense(hidden, n), f"out{i}.b": np.zeros(n)}
        self.mean, self.var = np.zeros((k, hidden)), np.ones((k, hidden))

    def _parts(self, x):
        import numpy as np

        return np.split(x, np.cumsum(self.slices)[:-1], axis=1)

    def _forward(self, x, rng=None):
        """Output, code and what backward needs; with rng as in training."""
        import numpy as np

        p, kept = self.p, []
        for i, part in enumerate(self._parts(x)):
            z = part @ p[f"in{i}.w"] + p[f"in{i}.b"]
            m, v = (z.mean(axis=0), z.var(axis=0)) if rng is not None else (self.mean[i], self.var[i])
            n = (z - m) / np.sqrt(v + 1e-5)
            t = np.tanh(n * p[f"scale{i}"] + p[f"shift{i}"])
            drop = (rng.random(t.shape) >= self.dropout) / (1 - self.dropout) if rng is not None else np.ones_like(t)
            kept.append((part, m, v, n, t, drop))
        joined = np.hstack([t * drop for *_, t, drop in kept])
        code = np.tanh(joined @ p["code.w"] + p["code.b"])
        back = np.tanh(code @ p["open.w"] + p["open.b"])
        out = np.hstack([h @ p[f"out{i}.w"] + p[f"out{i}.b"] for i, h in enumerate(np.split(back, len(self.slices), axis=1))])
        return out, code, (kept, joined, back)

    def encode(self, x):
        return self._forward(x)[1]

    def loss(self, x) -> float:
        """Mean squared error of the reconstruction."""
        return float(((self._forward(x)[0] - x) ** 2).mean())

    def gradients(self, x, rng=None):
        """The loss with its penalties, the gradients, and each branch's batch mean and variance."""
        import numpy as np

        p, h = self.p, self.hidden
        out, code, (kept, joined, back) = self._forward(x, rng)
        weights = [k for k in p if k.endswith(".w")]
        loss = ((out - x) ** 2).mean() + self.penalty * np.abs(code).mean() + self.penalty * sum((p[k] ** 2).mean() for k in weights)
        g, d_back = {}, np.empty_like(back)
        for i, (d, part) in enumerate(zip(self._parts(2 * (out - x) / x.size), np.split(back, len(self.slices), axis=1))):
            g[f"out{i}.w"], g[f"out{i}.b"] = part.T @ d, d.sum(axis=0)
            d_back[:, i * h : (i + 1) * h] = d @ p[f"out{i}.w"].T
        d_back *= 1 - back**2
        g["open.w"], g["open.b"] = code.T @ d_back, d_back.sum(axis=0)
        d_code = (d_back @ p["open.w"].T + self.penalty * np.sign(code) / code.size) * (1 - code**2)
        g["code.w"], g["code.b"] = joined.T @ d_code, d_code.sum(axis=0)
        d_joined = d_code @ p["code.w"].T
        for i, (part, m, v, n, t, drop) in enumerate(kept):
            d = d_joined[:, i * h : (i + 1) * h] * drop * (1 - t**2)
            g[f"scale{i}"], g[f"shift{i}"] = (d * n).sum(axis=0), d.sum(axis=0)
            d = d * p[f"scale{i}"]
            if rng is not None:  # through the batch's own mean and variance
                d = d - d.mean(axis=0) - n * (d * n).mean(axis=0)
            d /= np.sqrt(v + 1e-5)
            g[f"in{i}.w"], g[f"in{i}.b"] = part.T @ d, d.sum(axis=0)
        for k in weights:
            g[k] = g[k] + 2 * self.penalty * p[k] / p[k].size
        return float(loss), g, [(m, v) for _, m, v, *_ in kept]

    def fit(self, x, validate, epochs: int = 10, batch: int = 64, rate: float = 1e-3, checkpoint=None) -> list[tuple[float, float]]:
        """(training, validation) error after each epoch; the parameters of the best validation epoch are kept.

        checkpoint(epoch, state) is called after each epoch with state().
        """
        import numpy as np

        rng, t, losses, best = np.random.default_rng(self.seed), 0, [], None
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            for idx in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                _, g, stats = self.gradients(x[idx], rng)
                t += 1
                for i, (mean, var) in enumerate(stats):
                    self.mean[i] += 0.1 * (mean - self.mean[i])
                    self.var[i] += 0.1 * (var - self.var[i])
                for k, a in self.p.items():
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.001 * (g[k] ** 2 - v[k])
                    a -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            losses.append((self.loss(x), self.loss(validate)))
            if best is None or losses[-1][1] < best[0]:
                best = losses[-1][1], self.state()
            if checkpoint:
                checkpoint(epoch, self.state())
        if best:
            self.load(best[1])
        return losses

    def state(self) -> dict:
        return {k: a.copy() for k, a in self.p.items()} | {"mean": self.mean.copy(), "var": self.var.copy()}

    def load(self, state: dict) -> None:
        self.p = {k: a.copy() for k, a in state.items() if k not in ("mean", "var")}
        self.mean, self.var = state["mean"].copy(), state["var"].copy()


def _sampled(x: DataFrame, sample: int):
    """About sample vectors of row, vector, those of the smallest hashes, as an array; bounded by twice that."""
    import numpy as np

    n = x.count()
    place = F.xxhash64("row")
    chosen = x.where(F.pmod(place, F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, sample / max(n, 1)))))
    return np.array([r["vector"] for r in chosen.select("vector", place.alias("h")).orderBy("h").limit(2 * sample).collect()], float)


def branch_encoded(train: DataFrame, validate: DataFrame, x: DataFrame, slices: list[int], code: int = 32, sample: int = 20_000, checkpoints: str | None = None, **options) -> tuple[DataFrame, list[tuple[float, float]]]:
    """row, embedding of x by a branch autoencoder fitted on samples of train and validate, and the errors by epoch.

    checkpoints: a folder that gets the parameters of each epoch as a Parquet table (epoch, name, shape, numbers).
    """
    import numpy as np
    import pandas as pd

    net, spark = BranchAutoencoder(slices, code=code), x.sparkSession

    def save(epoch: int, state: dict) -> None:
        rows = [(epoch, k, list(a.shape), [float(v) for v in a.ravel()]) for k, a in state.items()]
        spark.createDataFrame(rows, "epoch int, name string, shape array<int>, numbers array<double>").write.mode("append").parquet(checkpoints)

    own, held = _sampled(train, sample), _sampled(validate, sample)
    losses = net.fit(own, held if len(held) else own, checkpoint=save if checkpoints else None, **options) if len(own) else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"row": pdf["row"], "embedding": list(net.encode(np.array(list(pdf["vector"]), float))) if len(pdf) else []})

    return x.select("row", "vector").mapInPandas(run, f"row {dict(x.dtypes)['row']}, embedding array<double>"), losses


def load_checkpoint(spark, folder: str, epoch: int, slices: list[int], code: int = 32) -> BranchAutoencoder:
    """The autoencoder of a written epoch."""
    import numpy as np

    net = BranchAutoencoder(slices, code=code)
    rows = spark.read.parquet(folder).where(F.col("epoch") == epoch).collect()
    net.load({r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in rows})
    return net


class NeighbourNet:
    """Two layers, each on the mean of a node and its neighbours, and a softmax; trained on the nodes of a mask by class weights.

    A layer's mean is a sum over edges, so nothing of nodes x nodes is made; one graph is held in memory, as a group.
    """

    def __init__(self, inputs: int, classes: int, hidden: int = 16, seed: int = 1):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, inputs**-0.5, (inputs, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, classes)), np.zeros(classes)]

    @staticmethod
    def mean(x, src, dst):
        """The mean over each node's in-neighbours and itself."""
        import numpy as np

        out, n = x.copy(), np.bincount(dst, minlength=len(x)) + 1.0
        np.add.at(out, dst, x[src])
        return out / n[:, None]

    @staticmethod
    def mean_back(d, src, dst):
        import numpy as np

        d = d / (np.bincount(dst, minlength=len(d)) + 1.0)[:, None]
        out = d.copy()
        np.add.at(out, src, d[dst])
        return out

    def forward(self, x, src, dst):
        import numpy as np

        w1, b1, w2, b2 = self.p
        a = self.mean(x, src, dst)
        h = np.maximum(a @ w1 + b1, 0)
        c = self.mean(h, src, dst)
        z = c @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return a, h, c, z / z.sum(axis=1, keepdims=True)

    def gradients(self, x, src, dst, y, mask, weights):
        import numpy as np

        a, h, c, p = self.forward(x, src, dst)
        own = np.where(mask, weights[y], 0.0)
        own = own / max(own.sum(), 1e-12)
        loss = float(-(own * np.log(p[np.arange(len(y)), y] + 1e-12)).sum())
        d = p.copy()
        d[np.arange(len(y)), y] -= 1
        d *= own[:, None]
        dh = self.mean_back(d @ self.p[2].T, src, dst) * (h > 0)
        return loss, [a.T @ dh, dh.sum(axis=0), c.T @ d, d.sum(axis=0)]

    def fit(self, x, src, dst, y, mask, weights, epochs: int = 100, rate: float = 0.02) -> list[float]:
        import numpy as np

        m, v, losses = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], []
        for t in range(1, epochs + 1):
            loss, g = self.gradients(x, src, dst, y, mask, weights)
            losses.append(loss)
            for a, b, i, j in zip(self.p, g, m, v):
                i += 0.1 * (b - i)
                j += 0.001 * (b * b - j)
                a -= rate * (i / (1 - 0.9**t)) / (np.sqrt(j / (1 - 0.999**t)) + 1e-8)
        return losses


def neighbour_layer(edges: DataFrame, values: DataFrame, weights: list[list[float]], bias: list[float]) -> DataFrame:
    """row, pos, value: the mean of in-neighbours' vectors (row, pos, value), then a linear layer."""
    mean = edges.select(F.col("src").alias("row"), F.col("dst").alias("to")).distinct().join(values, "row").groupBy("to", "pos").agg(F.avg("value").alias("value"))
    flat = [(i, j, float(w)) for i, line in enumerate(weights) for j, w in enumerate(line)]
    w = F.broadcast(values.sparkSession.createDataFrame(flat, "pos int, out int, w double"))  # a layer's weights
    b = F.element_at(F.array(*[F.lit(float(x)) for x in bias]), F.col("pos") + 1)
    return mean.join(w, "pos").groupBy(F.col("to").alias("row"), F.col("out").alias("pos")).agg(F.sum(F.col("value") * F.col("w")).alias("value")).withColumn("value", F.col("value") + b)


def balanced_weights(labels: DataFrame) -> DataFrame:
    """label, weight: rows over classes times the class's rows."""
    n = labels.groupBy("label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("all"), F.count("*").alias("classes"))
    return n.join(F.broadcast(total), F.lit(True)).select("label", (F.col("all") / (F.col("classes") * F.col("n"))).alias("weight"))  # one row
