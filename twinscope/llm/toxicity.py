"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of three lexicons, second-person proximity of their words, capitals,
punctuation and obfuscation rates. One lexicon is fixed; two are learned from the labelled sample, of
whole words and of word beginnings, keeping all those whose documents are toxic far more often than chance
allows. Trees are grown on histograms of the features by the driver, from about MOST_DOCS labelled
documents at most. Scores are calibrated by isotonic regression on the margins that each fold gets from
lexicons and trees learned from the other folds alone.

Features are ratios of sums over a text's words and bytes; a long text is summed part by part, cut at blanks.

Defined results: null and empty texts have no words and a score; equal texts have equal scores; with no
labels, or labels of one kind, all scores are the share of ones (0 if none); other columns of the input
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscope.llm.common import byte_chunks, discard, held_out, materialise, table
from twinscope.llm.lexical import DIGIT, LETTER, LOWER, PUNCT, SPACE, UPPER, byte_set, counts, hash_words, labelled_sample, lower, member, prefix_sums, segments, span_hash, word_bounds

MOST_DOCS = 12_000
#: A learned entry: in so many toxic documents, so many times as often there, so many deviations above chance.
LEAST_DOCS, LEAST_RATIO, LEAST_Z = 3, 4.0, 4.0
FOLDS = 3
BEGINNING = 4
NEAR = 6
INSULTS = "idiot moron stupid loser trash scum worthless pathetic disgusting clown dumb fool jerk filth hate kill ugly dummkopf blöd idioten arschloch abschaum widerlich idiote imbécile crétin ordure pourriture débile idiota imbécil estúpido basura escoria asqueroso".split()
SECOND_PERSON = "you your yours yourself du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro".split()
LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$!", b"oieastasi", strict=True):
    LEET[_a] = _b
INNER = byte_set(b"0134579@$!*.-_#")


@dataclass
class Lexicons:
    """Sorted word hashes with weights: whole words, and beginnings of BEGINNING bytes."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    word_weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    start_weight: np.ndarray = field(default_factory=lambda: np.zeros(0))


INSULT_TABLE, YOU_TABLE = np.sort(hash_words(INSULTS)), np.sort(hash_words(SECOND_PERSON))


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words: starts, ends, row, hash, hash of the beginning (of longer words, else 0)."""
    starts, ends = word_bounds(LETTER[raw], offs)
    sums = prefix_sums(lower(raw))
    home = np.searchsorted(offs, starts, side="right") - 1
    begin = np.where(ends - starts > BEGINNING, span_hash(sums, starts, np.minimum(starts + BEGINNING, ends)), np.uint64(0))
    return starts, ends, home, span_hash(sums, starts, ends), begin


def tallies(raw: np.ndarray, offs: np.ndarray, lex: Lexicons) -> np.ndarray:
    """The sums of each row from which its features are made."""
    n = len(offs) - 1
    starts, ends, home, hashes, begins = tokens(raw, offs)

    def per_row(values: np.ndarray) -> np.ndarray:
        return np.bincount(home, values, n)

    word, begin = member(hashes, lex.words), member(begins, lex.starts)
    word_w = np.where(word >= 0, np.r_[lex.word_weight, 0.0][word], 0.0)
    begin_w = np.where(begin >= 0, np.r_[lex.start_weight, 0.0][begin], 0.0)
    fixed, you = member(hashes, INSULT_TABLE) >= 0, member(hashes, YOU_TABLE) >= 0
    bad = (word >= 0) | (begin >= 0) | fixed
    near = np.zeros(len(bad), bool)
    if you.any() and bad.any():
        at = np.flatnonzero(you)
        spot = np.flatnonzero(bad)
        right = np.minimum(np.searchsorted(at, spot), len(at) - 1)
        for side in (at[right], at[np.maximum(right - 1, 0)]):
            near[spot] |= (np.abs(side - spot) <= NEAR) & (home[side] == home[spot])
    letters, upper, punct = LETTER[raw], UPPER[raw], PUNCT[raw]
    twice = punct.copy()
    twice[1:] &= punct[:-1]
    hidden = np.zeros(len(raw), bool)
    if len(raw) > 2:
        hidden[1:-1] = INNER[raw[1:-1]] & letters[:-2] & letters[2:]
    full = np.diff(offs) > 0  # what stands beside a row's ends is another row
    twice[offs[:-1][full]] = hidden[offs[:-1][full]] = hidden[offs[1:][full] - 1] = False
    masked = np.zeros(n)
    if hidden.any():  # words again, with the signs inside them read as letters
        plain = np.where(hidden, LEET[raw], raw)
        s2, e2 = word_bounds(letters | (hidden & LOWER[plain]), offs)
        total = np.r_[0, np.cumsum(hidden)]
        odd = total[e2] > total[s2]
        s2, e2 = s2[odd], e2[odd]
        h2 = span_hash(prefix_sums(lower(plain)), s2, e2)
        hit = (member(h2, INSULT_TABLE) >= 0) | (member(h2, lex.words) >= 0)
        masked = np.bincount((np.searchsorted(offs, s2, side="right") - 1)[hit], minlength=n)
    caps = np.zeros(len(starts), bool)
    if len(starts):
        total = np.r_[0, np.cumsum(upper)]
        caps = (total[ends] - total[starts] == ends - starts) & (ends - starts > 1)
    return np.stack([
        np.bincount(home, minlength=n), np.diff(offs), counts(letters, offs), per_row(word >= 0), per_row(word_w), per_row(begin >= 0), per_row(begin_w), per_row(fixed), masked, per_row(you), per_row(near), per_row(bad),
        counts(upper, offs), per_row(caps), counts(punct, offs), counts(twice, offs), counts(raw == 33, offs), counts(raw == 63, offs), counts(hidden, offs), counts(DIGIT[raw], offs), counts(SPACE[raw], offs),
        per_row((ends - starts).astype(float)),
    ], axis=1).astype(float)


def features(raw: np.ndarray, offs: np.ndarray, lex: Lexicons) -> np.ndarray:
    n_words, size, n_letters, hits, word_w, begin_hits, begin_w, fixed, masked, you, near, bad, upper, caps, punct, twice, bang, query, hidden, digit, space, length = sum(tallies(r, o, lex) for r, o in segments(raw, offs)).T
    n_words, size, n_letters = np.maximum(1, n_words), np.maximum(1, size), np.maximum(1, n_letters)
    return np.stack([
        hits / n_words, np.log1p(hits), word_w / n_words, begin_hits / n_words, np.log1p(begin_hits), begin_w / n_words, fixed / n_words, np.log1p(fixed), np.log1p(masked), masked / n_words,
        you / n_words, near / np.maximum(1, bad), np.log1p(near), upper / n_letters, caps / n_words, punct / size, twice / size, bang / size, query / size, hidden / size, digit / size, space / size,
        length / n_words, np.log1p(n_words),
    ], axis=1)


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(41)), F.lit(FOLDS)).cast("int")


def learn_lexicons(sample: DataFrame) -> list[Lexicons]:
    """Words and beginnings that mark toxic documents: of the sample (doc_id, text, label, fold), then of it without each fold.

    Documents are counted, not occurrences. A word needs LEAST_DOCS toxic documents, so entries are bounded by
    the sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, fold = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "fold"))
            for lo, _, raw, offs in byte_chunks(batch.column("text")):
                seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for part, cut in segments(raw, offs):
                    _, _, home, hashes, begins = tokens(part, cut)
                    seen += [(np.full(len(h), kind, np.uint64), h, home.astype(np.uint64)) for kind, h in ((0, hashes), (1, begins))]
                kind, key, home = (np.concatenate(x) for x in zip(*seen, strict=True))
                once = np.unique(np.stack([kind, key, home], axis=1)[key != 0], axis=0)
                if len(once):
                    row = lo + once[:, 2].astype(int)
                    group, at = np.unique(np.c_[once[:, :2], fold[row].astype(np.uint64)], axis=0, return_inverse=True)
                    yield pa.record_batch({
                        "kind": group[:, 0].astype(np.int32), "key": np.ascontiguousarray(group[:, 1]).view(np.int64), "fold": group[:, 2].astype(np.int32),
                        "toxic": np.bincount(at.ravel(), labels[row], len(group)).astype(np.int64), "n": np.bincount(at.ravel(), minlength=len(group)).astype(np.int64),
                    })

    totals = {r.fold: (r.toxic, r.n) for r in sample.groupBy("fold").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).collect()}
    folds = range(FOLDS)
    parts = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in folds for c in ("toxic", "n")]
    counted = sample.select("text", "label", "fold").mapInArrow(run, "kind int, key long, fold int, toxic long, n long").groupBy("kind", "key").agg(*parts)
    weights = []
    for without in (None, *folds):
        used = [k for k in folds if k != without]
        all_toxic, all_n = (sum(totals.get(k, (0, 0))[c] for k in used) for c in (0, 1))
        toxic, n = (sum((F.col(f"{c}{k}") for k in used), F.lit(0)) for c in ("toxic", "n"))
        share = all_toxic / max(1, all_n)
        ratio = (toxic + 0.5) / (all_toxic + 1) / ((n - toxic + 0.5) / (all_n - all_toxic + 1))
        z = (toxic - n * share) / F.sqrt(F.greatest(n, F.lit(1)) * max(share * (1 - share), 1e-9))
        weights.append(F.when((toxic >= LEAST_DOCS) & (ratio >= LEAST_RATIO) & (z >= LEAST_Z), F.log(ratio)))
    told = counted.select("kind", "key", F.array(*weights).alias("weights")).where(F.exists("weights", lambda w: w.isNotNull())).collect()
    out = []
    for j in range(1 + FOLDS):
        lex = Lexicons()
        for kind, names in ((0, ("words", "word_weight")), (1, ("starts", "start_weight"))):
            own = sorted((r.key & 0xFFFFFFFFFFFFFFFF, r.weights[j]) for r in told if r.kind == kind and r.weights[j] is not None)
            setattr(lex, names[0], np.array([k for k, _ in own], np.uint64))
            setattr(lex, names[1], np.array([w for _, w in own], float))
        out.append(lex)
    return out


class Trees:
    """Boosted regression trees of one depth on binned features, for logistic loss."""

    def __init__(self, n: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 1.0, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.least, self.ridge = n, depth, rate, bins, least, ridge
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        grid = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = []
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            some = x[x[:, f] != 0, f]  # rare features get cuts among their own values too
            own = np.quantile(some, grid) if len(some) else values[:0]
            cuts = np.unique(np.r_[np.quantile(x[:, f], grid), own, 0.0])
            self.cuts.append(cuts[(cuts >= values[0]) & (cuts < values[-1])])
        b = self.binned(x)
        wide = max((len(c) for c in self.cuts), default=0) + 1
        share = y.mean()
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        flat = b + np.arange(b.shape[1]) * wide
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-12)
            node = np.zeros(len(y), int)
            feature, cut = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1, int)
            for level in range(self.depth):
                for k in range(2**level):
                    at, spot = np.flatnonzero(node == k), 2**level - 1 + k
                    if len(at):
                        idx = flat[at].ravel()
                        gs = np.bincount(idx, np.repeat(g[at], b.shape[1]), b.shape[1] * wide).reshape(-1, wide).cumsum(1)
                        hs = np.bincount(idx, np.repeat(h[at], b.shape[1]), b.shape[1] * wide).reshape(-1, wide).cumsum(1)
                        gt, ht = gs[:, -1:], hs[:, -1:]
                        gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                        gain[(hs < self.least) | (ht - hs < self.least)] = 0
                        best = int(gain.argmax())
                        if gain.flat[best] > 1e-6:
                            feature[spot], cut[spot] = divmod(best, wide)
                right = (feature[2**level - 1 + node] >= 0) & (b[np.arange(len(y)), np.maximum(feature[2**level - 1 + node], 0)] > cut[2**level - 1 + node])
                node = 2 * node + right
            leaves = 2**self.depth
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            self.trees.append((feature, cut, value))
            margin += value[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                f = feature[2**level - 1 + node]
                node = 2 * node + ((f >= 0) & (b[rows, np.maximum(f, 0)] > cut[2**level - 1 + node]))
            out += value[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots of a rising, piecewise linear map from margin to probability."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, count, sum of margins
    for m, label in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([label, 1, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    at = np.array([b[2] / b[1] for b in blocks])
    return at, np.array([b[0] / b[1] for b in blocks])


class Toxicity:
    """Lexicons, trees and calibration."""

    def __init__(self, lex: Lexicons):
        self.lex, self.trees, self.knots = lex, Trees(), (np.zeros(1), np.zeros(1))

    def fit(self, x: np.ndarray, y: np.ndarray, apart: list[np.ndarray], fold: np.ndarray) -> Toxicity:
        """`x`: features by all lexicons; `apart`: by those learned without each fold; `fold`: that of each row."""
        self.trees.fit(x, y)
        margin = self.trees.margin(x)
        for k, own_x in enumerate(apart):
            own = fold == k
            rest = y[~own]
            if own.any() and len(rest) and 0 < rest.mean() < 1:
                margin[own] = Trees().fit(own_x[~own], rest).margin(own_x[own])
        self.knots = isotonic(margin, y)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a hundredth comes from the margin itself, so that ties keep their order."""
        margin = self.trees.margin(x)
        return np.round(0.99 * np.interp(margin, *self.knots) + 0.01 / (1 + np.exp(-margin)), 9)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_DOCS) -> Toxicity | float:
    """The classifier, or the share of ones where labels of both kinds are lacking."""
    sample = materialise(labelled_sample(docs, labels, "toxic", 5, 0, most).withColumn("fold", fold_of(F.col("doc_id"))), "toxic-sample")
    kinds = sample.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if kinds.lo is None or kinds.lo == kinds.hi:
        return float(kinds.lo or 0)
    lexicons = learn_lexicons(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offs in byte_chunks(batch.column("text")):
                x = np.concatenate([features(raw, offs, lex) for lex in lexicons], axis=1).astype("<f8")
                yield pa.record_batch({**{c: batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "label", "fold")}, "x": pa.array([r.tobytes() for r in x], pa.binary())})

    rows = sorted(sample.mapInArrow(run, "doc_id long, label int, fold int, x binary").collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    discard(sample)
    x, *apart = np.split(np.stack([np.frombuffer(r.x, "<f8") for r in rows]), 1 + FOLDS, axis=1)
    return Toxicity(lexicons[0]).fit(x, np.array([float(r.label) for r in rows]), apart, np.array([r.fold for r in rows]))


def batch_scores(column: pa.Array, model: Toxicity | float) -> np.ndarray:
    scores = np.full(len(column), model if isinstance(model, float) else 0.0)
    if not isinstance(model, float):
        for lo, hi, raw, offs in byte_chunks(column):
            scores[lo:hi] = model.score(features(raw, offs, model.lex))
    return scores


def score_documents(docs: DataFrame, model: Toxicity | float) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = batch_scores(batch.column("text"), model)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(scores), "predicted": pa.array((scores >= 0.5).astype(np.int32))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that aren't predicted toxic, with all their columns."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(batch_scores(batch.column("text").cast(pa.string()), model) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
