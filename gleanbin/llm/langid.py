"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Each byte moves two gated recurrent units, one from the left and one from the right; a softmax over both states labels
every position, and a document's probabilities are the means of its positions'. The whole text is read, in segments of
SEGMENT bytes that run side by side, so a step is a few matrix operations over thousands of segments.

Training is by backpropagation through time with Adam, on the driver, on a sample of documented bounds: of each of the
LANGUAGES most frequent languages one document for each of BUCKETS hash values of doc_id, WINDOWS windows of it. The
training rows are those whose crc32(doc_id as text) mod 3 is not 1.

Defined cases: null texts and texts without a letter are und with score 0; so is every text if there is no training row;
null lang is never learned; null doc_id is a training row (crc32 of the empty text is 0); ties go to the language first
in order; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanbin.llm.common import give_back

#: Bounds of the sample: languages, documents of each, windows of each, characters of a window.
LANGUAGES, BUCKETS, WINDOWS, WINDOW = 64, 256, 6, 96
HIDDEN, STEPS, TRAIN_LENGTH, TRAIN_BATCH, RATE, SEED = 8, 320, 48, 256, 0.02, 7
SEGMENT, SIDE_BY_SIDE = 128, 4096
UNKNOWN = "und"


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1


def sample(documents: DataFrame) -> list[tuple[str, bytes]]:
    """(lang, window) of the training sample; bounded by LANGUAGES x BUCKETS x WINDOWS windows."""
    rows = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    turn = F.xxhash64("doc_id", F.lit(SEED))
    chosen = rows.where(F.col("lang").isin(langs)).groupBy("lang", F.pmod(turn, F.lit(BUCKETS)).alias("bucket")).agg(F.min_by("doc_id", turn).alias("doc_id")).select("doc_id")
    start = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - WINDOW + 1, F.lit(1))) + 1
    texts = rows.join(F.broadcast(chosen), "doc_id")  # LANGUAGES x BUCKETS rows at most
    cut = texts.select("doc_id", "lang", F.array(*[F.col("text").substr(start(k).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS)]).alias("w")).groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("w").alias("w"))
    found = sorted((r["lang"], w.encode()) for r in cut.collect() for w in r["w"])
    return [x for x in found if x[1]]


class Gru:
    """One direction. inputs: what each byte adds to update gate, reset gate and candidate; state: what the state adds."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.inputs = rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
        self.state = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)

    def forward(self, x: np.ndarray, keep: bool = False, valid: np.ndarray | None = None):
        """States of bytes x (time, batch); with keep also what backward() needs. Where not valid the state is zero."""
        steps, batch = x.shape
        n = self.state.shape[0]
        h = np.zeros((batch, n), np.float32)
        states, memory = np.empty((steps, batch, n), np.float32), []
        for t in range(steps):
            given, own = self.inputs[x[t]], h @ self.state
            gates = given[:, : 2 * n] + own[:, : 2 * n]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :n], gates[:, n:]
            new = np.tanh(given[:, 2 * n :] + r * own[:, 2 * n :])
            if keep:
                memory.append((h, z, r, new, own[:, 2 * n :]))
            h = new + z * (h - new)
            if valid is not None:
                h *= valid[t][:, None]
            states[t] = h
        return (states, memory) if keep else states

    def backward(self, x: np.ndarray, memory: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of inputs and state, through time."""
        n = self.state.shape[0]
        d_inputs, d_state = np.zeros_like(self.inputs), np.zeros_like(self.state)
        dh = np.zeros_like(d_states[0])
        for t in range(len(memory) - 1, -1, -1):
            before, z, r, new, own = memory[t]
            dh = dh + d_states[t]
            d_new = dh * (1 - z) * (1 - new * new)
            d_z = dh * (before - new) * z * (1 - z)
            d_r = d_new * own * r * (1 - r)
            given = np.concatenate([d_z, d_r, d_new], axis=1)
            through = np.concatenate([d_z, d_r, d_new * r], axis=1)
            np.add.at(d_inputs, x[t], given)
            d_state += before.T @ through
            dh = dh * z + through @ self.state.T
        return d_inputs, d_state


class Network:
    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.left, self.right = Gru(rng, hidden), Gru(rng, hidden)
        self.out = rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions of x (time, batch), and the gradient of each parameter."""
        n = self.left.state.shape[0]
        a, kept_a = self.left.forward(x, True)
        b, kept_b = self.right.forward(x[::-1], True)
        both = np.concatenate([a, b[::-1]], axis=2)
        p = self._softmax(both @ self.out + self.bias)
        loss = float(-np.log(p[:, np.arange(len(y)), y] + 1e-9).mean())
        p[:, np.arange(len(y)), y] -= 1
        p /= p.shape[0] * p.shape[1]
        d_both = p @ self.out.T
        d_out = both.reshape(-1, 2 * n).T @ p.reshape(-1, p.shape[2])
        left = self.left.backward(x, kept_a, d_both[:, :, :n])
        right = self.right.backward(x[::-1], kept_b, np.ascontiguousarray(d_both[::-1, :, n:]))
        return loss, [*left, *right, d_out, p.sum(axis=(0, 1))]

    def parameters(self) -> list[np.ndarray]:
        return [self.left.inputs, self.left.state, self.right.inputs, self.right.state, self.out, self.bias]

    def train(self, windows: list[tuple[str, bytes]], steps: int = STEPS, seed: int = SEED) -> list[float]:
        """Adam over random crops, languages in equal shares."""
        rng = np.random.default_rng(seed)
        by = [[np.frombuffer(w, np.uint8) for lang, w in windows if lang == name] for name in self.langs]
        params = self.parameters()
        first, second, losses = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], []
        for step in range(1, steps + 1):
            y = rng.integers(len(self.langs), size=TRAIN_BATCH)
            x = np.empty((TRAIN_LENGTH, TRAIN_BATCH), np.int16)
            for k, lang in enumerate(y):
                w = by[lang][rng.integers(len(by[lang]))]
                at = rng.integers(max(1, len(w) - TRAIN_LENGTH + 1))
                x[:, k] = np.resize(w[at : at + TRAIN_LENGTH], TRAIN_LENGTH)  # a short one is repeated
            loss, grads = self.gradients(x, y)
            losses.append(loss)
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, g, m, v in zip(params, grads, first, second):
                np.clip(g, -1, 1, out=g)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return losses

    def pooled(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums over positions of each document's label probabilities; data holds their bytes."""
        n, k = self.left.state.shape[0], len(self.langs)
        parts = -(-lengths // SEGMENT)
        doc = np.repeat(np.arange(len(lengths)), parts)
        inside = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        begin, size = starts[doc] + inside, np.minimum(SEGMENT, lengths[doc] - inside)
        by = np.argsort(-size, kind="stable")  # short ends of documents go together
        sums = np.zeros((len(lengths), k))
        for at in range(0, len(by), SIDE_BY_SIDE):
            own = by[at : at + SIDE_BY_SIDE]
            steps = int(size[own[0]])
            where = begin[own][None, :] + np.arange(steps)[:, None]
            valid = np.arange(steps)[:, None] < size[own][None, :]
            x = np.where(valid, data[np.minimum(where, len(data) - 1)], 256).astype(np.int16)
            some = None if valid.all() else valid[::-1]  # from the right, a short segment begins with what isn't there
            left = self.left.forward(x)
            right = self.right.forward(x[::-1], valid=some)[::-1]
            total = np.zeros((len(own), k), np.float32)
            for t in range(steps):
                p = self._softmax(left[t] @ self.out[:n] + right[t] @ self.out[n:] + self.bias)
                if not valid[t, -1]:
                    p *= valid[t][:, None]
                total += p
            np.add.at(sums, doc[own], total)
        return sums


def fitted(documents: DataFrame) -> Network | None:
    windows = sample(documents)
    if not windows:
        return None
    network = Network(sorted({lang for lang, _ in windows}))
    network.train(windows)
    return network


def _predicted(documents: DataFrame, network: Network | None, keep: list[str]) -> DataFrame:
    """keep as _k0, _k1, ..., then _lang and _score, so that no name of the input can clash. The text is sent once."""
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    own = [F.col(f"`{c}`").alias(f"_k{k}") for k, c in enumerate(keep)]
    rows = documents.select(*own, letter, *([] if "text" in keep else [F.col("text").alias("_text")]))
    names = [f"_k{k}" for k in range(len(keep))]
    at = keep.index("text") if "text" in keep else len(keep) + 1
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]], "_lang string", "_score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, letter = batch.column(at), batch.column(len(keep)).to_numpy(zero_copy_only=False)
            n = len(letter)
            pred, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if network is not None and n and letter.any():
                wide = pa.types.is_large_binary(text.type) or pa.types.is_large_string(text.type)
                _, ends, data = text.buffers()
                ends = np.frombuffer(ends, np.int64 if wide else np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
                lengths = np.where(letter, np.diff(ends), 0)
                sums = network.pooled(np.frombuffer(data, np.uint8), ends[:-1], lengths)
                mean = sums / np.maximum(lengths, 1)[:, None]
                pred = np.where(lengths > 0, np.array(network.langs, object)[mean.argmax(axis=1)], UNKNOWN)
                score = np.where(lengths > 0, np.clip(mean.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "_lang", "_score"])
        give_back()

    return rows.mapInArrow(run, schema)


def predict(documents: DataFrame, network: Network | None, keep: list[str]) -> DataFrame:
    """keep (plain columns), lang_pred and score of every row."""
    return _predicted(documents, network, keep).toDF(*keep, "lang_pred", "score")


def op5(documents: DataFrame) -> DataFrame:
    d = documents.select("doc_id", "text", "lang")
    return predict(d.withColumn("held_out", held_out()), fitted(d), ["doc_id", "held_out"])


def identified(documents: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows whose language is identified with a score of least or more, with their own columns."""
    network = fitted(documents.select("doc_id", "text", "lang"))
    names = documents.columns
    found = _predicted(documents, network, names).where((F.col("_lang") != UNKNOWN) & (F.col("_score") >= least))
    return found.select(*[F.col(f"_k{k}").alias(c) for k, c in enumerate(names)])
