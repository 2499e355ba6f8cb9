"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Each passage is encoded from dense counts (letters,
capitals, punctuation, repetition, word lengths) by a hidden layer; gated attention, tanh(V h) times
sigmoid(U h), weighs the passages; the weighted sum of the encodings is scored by a logistic unit. All
layers are learned together from document labels, by Adam with hand-written gradients, from a sample of
about MOST_DOCS labelled documents (fewer, where these have over MOST_PASSAGES passages in all), with all
passages of each. Scoring takes every passage of every text. Words end where a part of CHUNK_BYTES of a
long text does, so a text of any length is read part by part.

Defined results: null and empty texts are one passage without bytes, and have a score; equal texts have
equal scores; with no labels, or labels of one kind, all scores are the share of ones (0.5 if none);
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscope.llm.common import CHUNK_BYTES, byte_chunks, discard, held_out, materialise, table
from twinscope.llm.lexical import DIGIT, LETTER, PUNCT, SPACE, UPPER, WIDE, byte_set, counts, labelled_sample, lower, prefix_sums, span_hash, word_bounds

PASSAGE = 512
MOST_DOCS = 8000
#: Passages of the whole sample; it gets fewer documents where they are longer.
MOST_PASSAGES = 500_000
HIDDEN, GATE = 24, 16
EPOCHS, BATCH, RATE, DECAY = 25, 64, 0.01, 1e-4
SYMBOL = byte_set(b"*$%&#@~^+=<>{}[]\\_")


def passages(raw: np.ndarray, offs: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Cuts between the passages of all rows, and the number of passages of each row (1 at least)."""
    length = np.diff(offs)
    n = np.maximum(1, -(-length // size))
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return np.r_[offs[row] + k * size, offs[-1]], n


def encode(raw: np.ndarray, offs: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The dense counts of each passage."""
    size = np.maximum(1, np.diff(cuts)).astype(float)
    letters = LETTER[raw]
    starts, ends = word_bounds(letters, offs)
    at = np.searchsorted(starts, cuts)
    n_words = np.maximum(1, np.diff(at)).astype(float)
    hashes = span_hash(prefix_sums(lower(raw)), starts, ends)
    length = (ends - starts).astype(float)
    home = np.repeat(np.arange(len(cuts) - 1), np.diff(at))

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(home, values, len(cuts) - 1) / n_words

    def again(back: int) -> np.ndarray:
        same = np.zeros(len(hashes))
        same[back:] = (hashes[back:] == hashes[:-back]) & (home[back:] == home[:-back]) if back < len(hashes) else 0
        return same

    order = np.lexsort((hashes, home))
    fresh = np.ones(len(hashes))
    if len(order) > 1:
        fresh[order[1:]] = (hashes[order[1:]] != hashes[order[:-1]]) | (home[order[1:]] != home[order[:-1]])
    upper = UPPER[raw]
    caps = np.zeros(len(starts))
    if len(starts):
        total = np.r_[0, np.cumsum(upper)]
        caps = ((total[ends] - total[starts]) * 2 > length) & (length > 1)
    punct = PUNCT[raw]
    twice = punct.copy()
    twice[1:] &= punct[:-1]
    twice[offs[:-1][np.diff(offs) > 0]] = False  # before a row stands another one
    mean = per_word(length)
    n_letters = np.maximum(1, counts(letters, cuts))
    return np.stack([
        np.log1p(np.diff(cuts)) / 6, n_letters / size, counts(upper, cuts) / n_letters, per_word(caps.astype(float)), counts(punct, cuts) / size, counts(twice, cuts) / size,
        counts(raw == 33, cuts) / size, counts(raw == 124, cuts) / size, counts(SYMBOL[raw], cuts) / size, counts(DIGIT[raw], cuts) / size, counts(SPACE[raw], cuts) / size,
        counts(raw == 10, cuts) / size, counts(raw == 46, cuts) / size, counts(raw == 44, cuts) / size, counts(WIDE[raw], cuts) / size,
        mean / 8, np.sqrt(np.maximum(0, per_word(length * length) - mean * mean)) / 8, per_word((length <= 3).astype(float)), per_word(again(1)), per_word(again(2)), per_word(fresh),
    ], axis=1).astype(np.float32)


N_FEATURES = 21


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Attention:
    """The network. `bags`: how many passages each document has, in the order of the rows."""

    def __init__(self, n_features: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(n_features, np.float32), np.ones(n_features, np.float32)
        self.p = {"W": draw(n_features, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "a": draw(GATE), "w": draw(HIDDEN), "c": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, bags: np.ndarray) -> tuple:
        p = self.p
        first = np.cumsum(bags) - bags
        h = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), bags))
        weight = e / np.repeat(np.add.reduceat(e, first), bags)
        z = np.add.reduceat(weight[:, None] * h, first, axis=0)
        return h, t, g, weight, z, z @ p["w"] + p["c"][0]

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        """In double precision and rounded, since the last places of a product of matrices differ with the rows beside."""
        double = Attention.__new__(Attention)
        double.mean, double.scale, double.p = self.mean.astype(float), self.scale.astype(float), {k: a.astype(float) for k, a in self.p.items()}
        return np.round(sigmoid(double.forward(x.astype(float), bags)[-1]), 6)

    def gradient(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, np.cumsum(bags) - bags
        h, t, g, weight, z, logit = self.forward(x, bags)
        d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        dz = np.repeat(d, bags)[:, None] * p["w"]
        dh = weight[:, None] * dz
        dw = (dz * h).sum(1)
        de = weight * (dw - np.repeat(np.add.reduceat(weight * dw, first), bags))
        dtg = de[:, None] * p["a"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        xs = np.clip((x - self.mean) / self.scale, -8, 8)
        return {"W": xs.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "w": z.T @ d, "c": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, seed: int = 7) -> Attention:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        rng, first = np.random.default_rng(seed), np.cumsum(bags) - bags
        m, v, step = {k: 0 * a for k, a in self.p.items()}, {k: 0 * a for k, a in self.p.items()}, 0
        for epoch in range(max(EPOCHS, -(-400 * BATCH // len(bags)))):
            order = rng.permutation(len(bags))
            rate = RATE / (1 + epoch / 8)
            for lo in range(0, len(order), BATCH):
                own = order[lo : lo + BATCH]
                rows = np.concatenate([np.arange(first[i], first[i] + bags[i]) for i in own])
                grad, step = self.gradient(x[rows], bags[own], y[own]), step + 1
                for k, a in self.p.items():
                    gk = grad[k] + DECAY * a
                    m[k], v[k] = 0.9 * m[k] + 0.1 * gk, 0.999 * v[k] + 0.001 * gk * gk
                    a -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def bag_features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: (first row, end row, passage features, passages of each row)."""
    for lo, hi, raw, offs in byte_chunks(column):
        if hi - lo == 1 and len(raw) > CHUNK_BYTES:
            parts = [raw[a : a + CHUNK_BYTES] for a in range(0, len(raw), CHUNK_BYTES)]
            x = np.concatenate([encode(p, o, passages(p, o)[0]) for p in parts for o in (np.array([0, len(p)]),)])
            yield lo, hi, x, np.array([len(x)])
        else:
            cuts, n = passages(raw, offs)
            yield lo, hi, encode(raw, offs, cuts), n


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_DOCS) -> Attention | float:
    """The network, or the share of ones where labels of both kinds are lacking."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x, n in bag_features(batch.column("text")):
                ends = np.cumsum(n)
                bags = [x[e - k : e].astype("<f4").tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "label": batch.column("label").slice(lo, hi - lo), "bag": pa.array(bags, pa.binary())})

    sample = drawn = materialise(labelled_sample(docs, labels, "quality", 3, 1, most), "quality-sample")
    size = sample.agg(F.sum(F.ceil(F.octet_length("text") / PASSAGE)).alias("n")).first().n or 0
    if size > MOST_PASSAGES:
        sample = sample.where(F.pmod(F.xxhash64("doc_id", F.lit(19)), F.lit(1 << 30)) < int(MOST_PASSAGES / size * (1 << 30)))
    rows = sample.mapInArrow(run, "doc_id long, label int, bag binary").collect()
    discard(drawn)
    rows.sort(key=lambda r: (r.doc_id, bytes(r.bag)))
    y = np.array([r.label for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    bags = [np.frombuffer(r.bag, "<f4").reshape(-1, N_FEATURES) for r in rows]
    return Attention(N_FEATURES).fit(np.concatenate(bags), np.array([len(b) for b in bags]), y)


def score_documents(docs: DataFrame, model: Attention | float) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, model if isinstance(model, float) else 0.5)
            if not isinstance(model, float):
                for lo, hi, x, n in bag_features(batch.column("text")):
                    scores[lo:hi] = model.score(x, n)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(scores), "predicted": pa.array((scores >= 0.5).astype(np.int32))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, with all their columns."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.full(batch.num_rows, isinstance(model, float) and model >= 0.5)
            if not isinstance(model, float):
                for lo, hi, x, n in bag_features(batch.column("text").cast(pa.string())):
                    good[lo:hi] = model.score(x, n) >= 0.5
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
