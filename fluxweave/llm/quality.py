"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages, 512 bytes of its UTF-8 text each, all of them used. A passage is encoded from the
square roots of its hashed byte-pair frequencies, h = tanh(W x + b). Gated attention weighs the passages,
a = softmax(w . (tanh(V h) * sigmoid(U h))), and the document's score is sigmoid(c . sum(a h) + d). Only document labels
are known; the attention is learnt from them.

The model is fitted on the driver from at most ``sample`` labelled rows (those of smallest hash), with at most
``passages`` evenly spaced passages of each; both bounds are parameters and hold for fitting alone. Null and empty texts
are one empty passage and get a score like any other. Without labels every score is 1; with labels of one kind only it
is that kind. Repeated rows are scored alike, repeated labels count each. An empty table gives no rows. Very long texts
are read block by block, so that they need little more memory than their bytes. Columns may have any names; only those
that are named are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.llm.common import per_batch, release, slices

PASSAGE = 512
BUCKETS = 512
FEATURES = BUCKETS + 2
#: Bytes added to a passage's length, so that a few words aren't taken for a whole style; lags at which it may repeat.
DAMPING = 48
LAGS = 20
HIDDEN, GATE = 24, 12
SAMPLE, PASSAGES = 6000, 32
#: Passages encoded at once.
BLOCK = 256


def blocks(text: str | None) -> Iterator[np.ndarray]:
    """Feature rows, float32, of a text's passages, BLOCK at a time: square roots of byte-pair shares, damped where a
    passage is short; the number of distinct pairs for the length; and how much of the passage repeats at its best lag."""
    whole = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(whole) < 2:
        yield np.zeros((1, FEATURES), np.float32)
        return
    for start in range(0, len(whole), BLOCK * PASSAGE):
        end = min(len(whole), start + BLOCK * PASSAGE)
        raw = whole[start : end + 1].astype(np.int32)  # one byte more, for the last pair
        n, m = -(-(end - start) // PASSAGE), end - start
        pair = ((raw[:-1] * 40503 + raw[1:] * 30011) >> 3) % BUCKETS
        place = np.arange(m) // PASSAGE
        counts = np.bincount(place[: len(pair)] * BUCKETS + pair, minlength=n * BUCKETS).reshape(n, BUCKETS)
        total = counts.sum(axis=1)
        out = np.zeros((n, FEATURES), np.float32)
        out[:, :BUCKETS] = np.sqrt(counts / (total + DAMPING)[:, None])
        out[:, BUCKETS] = np.count_nonzero(counts, axis=1) / np.sqrt(total + 1) / 8
        best = np.zeros(n)
        before = whole[max(0, start - LAGS) : end]  # with the bytes that lags reach back to
        skip = start - max(0, start - LAGS)
        for lag in range(3, LAGS):
            first = max(skip, lag)
            if len(before) > first:
                same = before[first:] == before[first - lag : len(before) - lag]
                np.maximum(best, np.bincount(place[first - skip :][same], minlength=n), out=best)
        out[:, BUCKETS + 1] = 2 * best / (np.bincount(place, minlength=n) + DAMPING)
        yield out


def passages(text: str | None) -> np.ndarray:
    return np.concatenate(list(blocks(text)))


def some_passages(text: str | None, limit: int) -> np.ndarray:
    """At most ``limit`` evenly spaced passages, as float16."""
    n = max(1, -(-len((text or "").encode("utf-8", "surrogatepass")) // PASSAGE))
    wanted, out, at = np.linspace(0, n - 1, min(limit, n)).astype(int), [], 0
    for x in blocks(text):
        out.append(x[wanted[(wanted >= at) & (wanted < at + len(x))] - at].astype(np.float16))
        at += len(x)
    return np.concatenate(out)


@dataclass
class Model:
    """Weights; ``constant`` stands in where there was nothing to learn from."""

    w: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int):
        """Scores of n bags and what the gradients need; ``bag`` numbers each passage's document, ascending."""
        w = self.w
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-h @ w["U"]))
        e = (t * g) @ w["w"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, bag, e)
        a = np.exp(e - top[bag])
        a /= np.bincount(bag, a, n)[bag]
        z = np.zeros((n, h.shape[1]))
        np.add.at(z, bag, a[:, None] * h)
        return 1 / (1 + np.exp(-(z @ w["c"] + w["d"]))), (h, t, g, a, z)

    def gradients(self, x: np.ndarray, bag: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over bags."""
        w, n = self.w, len(labels)
        p, (h, t, g, a, z) = self.forward(x, bag, n)
        d = (p - labels) / n
        dz = d[:, None] * w["c"][None, :]
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - np.bincount(bag, a * da, n)[bag])
        dt, dg = de[:, None] * g * w["w"] * (1 - t * t), de[:, None] * t * w["w"] * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ d, "d": np.array([d.sum()])}

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        w = self.w
        # One pass with a running maximum, so that the longest text needs no more than a block of features.
        top, total, z = -np.inf, 0.0, np.zeros(HIDDEN)
        for x in blocks(text):
            h = np.tanh(x @ w["W"] + w["b"])
            e = (np.tanh(h @ w["V"]) * (1 / (1 + np.exp(-h @ w["U"])))) @ w["w"]
            new = max(top, float(e.max()))
            a = np.exp(e - new)
            keep = np.exp(top - new) if np.isfinite(top) else 0.0
            total, z, top = total * keep + a.sum(), z * keep + a @ h, new
        return float(1 / (1 + np.exp(-(z / total @ w["c"] + w["d"][0]))))


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the log loss, over batches of documents."""
    if not len(labels) or labels.min() == labels.max():
        return Model({}, 1.0 if not len(labels) else float(labels[0]))
    rng = np.random.default_rng(seed)
    w = {
        "W": rng.normal(0, 1.0, (FEATURES, HIDDEN)) / np.sqrt(HIDDEN),
        "b": np.zeros(HIDDEN),
        "V": rng.normal(0, 0.3, (HIDDEN, GATE)),
        "U": rng.normal(0, 0.3, (HIDDEN, GATE)),
        "w": rng.normal(0, 0.3, GATE),
        "c": rng.normal(0, 0.3, HIDDEN),
        "d": np.array([np.log(labels.mean() / (1 - labels.mean()))]),
    }
    model = Model(w)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for start in range(0, len(order), 64):
            rows = order[start : start + 64]
            x = np.concatenate([bags[i] for i in rows]).astype(np.float64)
            bag = np.repeat(np.arange(len(rows)), [len(bags[i]) for i in rows])
            grads = model.gradients(x, bag, labels[rows])
            step += 1
            for k, grad in grads.items():
                grad = grad + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad * grad
                w[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: int = PASSAGES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``sample`` of the labelled rows; their passages' features are made where the texts are."""
    chosen = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "label").limit(sample)  # a bounded set, so it may be broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def convert(batch):
        features = [some_passages(t, limit).tobytes() for t in batch.column(1).to_pylist()]
        return {"id": batch.column(0), "label": batch.column(2), "x": features}

    found = sorted((r.id, r.label, bytes(r.x)) for r in per_batch(rows, convert, "id long, label int, x binary").orderBy(F.xxhash64("id")).limit(sample).collect())
    model = fit([np.frombuffer(x, np.float16).reshape(-1, FEATURES) for _, _, x in found], np.array([y for _, y, _ in found], dtype=np.float64))
    del found
    release()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row."""

    def convert(batch):
        return {"id": batch.column(0), "score": [model.score(t) for t in batch.column(1).to_pylist()]}

    out = per_batch(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), convert, "id long, score double")
    return out.withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``least``; all columns stay, nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([model.score(t) >= least for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
