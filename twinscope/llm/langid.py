"""Language ID with bit-sliced Bloom filters of n-grams.

Each language learns the byte n-grams (GRAM bytes of lower-case words with their borders) that are
typical of it: from about MOST_DOCS documents of each language, those seen LEAST_COUNT times whose rate
is at least SHARE of the highest rate of any language, all of them: the filter is sized to the language that
has most. Every language of the labelled rows is learned. One Bloom filter holds all languages: a slot is a bit mask with a bit for each, so HASHES look-ups and an AND return all languages
that contain an n-gram. A text's popcount of each language is corrected for that language's chance of a
false positive; the largest corrected count decides, and its share of all is the score.

Defined results: a null text or one without a letter is `und` with score 0; a text with letters but no
known n-gram gets the commonest language with an even score; ties go to the commoner language; equal
texts give equal results; with no labelled documents all are `und`; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscope.llm.common import byte_chunks, crc_mod, discard, held_out, materialise, splitmix, table
from twinscope.llm.lexical import LETTER, LOWER, UPPER, lower, segments

GRAM = 4
MOST_DOCS = 1500
LEAST_COUNT = 3
SHARE = 0.3
#: Bits beside an n-gram for the number of its language.
LANGUAGE_BITS = 24
SLOTS_PER_GRAM, HASHES = 16, 3
UNKNOWN = "und"


def grams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all rows and the row of each: a word's letters, with one border on either side at most."""
    n = len(offs) - 1
    spaced = np.full(len(raw) + 2 * n, 32, np.uint8)  # two blanks after each row, so that no n-gram spans rows
    home = np.repeat(np.arange(n), np.diff(offs))
    low = lower(raw)
    spaced[np.arange(len(raw)) + 2 * home + 1] = np.where(LETTER[raw], low, 32)
    if len(spaced) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    inner = spaced != 32
    at = np.flatnonzero(inner[1:-2] & inner[2:-1])
    wide = spaced.astype(np.uint32)
    value = wide[at] | wide[at + 1] << np.uint32(8) | wide[at + 2] << np.uint32(16) | wide[at + 3] << np.uint32(24)
    starts = offs[:-1] + 2 * np.arange(n)
    return value, np.searchsorted(starts, at, side="right") - 1


class Filters:
    """One table of bit masks for all languages."""

    def __init__(self, languages: list[str], entries: list[np.ndarray]):
        self.languages = languages
        planes = -(-len(languages) // 8)
        size = 1 << 10
        while size < SLOTS_PER_GRAM * max((len(e) for e in entries), default=0):
            size *= 2
        self.table = np.zeros((size, planes), np.uint8)
        for k, e in enumerate(entries):
            self.table[self.slots(e).ravel(), k // 8] |= np.uint8(1 << (k % 8))
        fill = np.array([((self.table[:, k // 8] >> (k % 8)) & 1).mean() for k in range(len(languages))])
        self.false_rate = fill**HASHES

    def slots(self, values: np.ndarray) -> np.ndarray:
        """HASHES slots of each n-gram."""
        h = splitmix(values.astype(np.uint64) + np.uint64(0x51ED))
        first, step = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        return ((first + np.arange(HASHES, dtype=np.uint64)[:, None] * step) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def masks(self, values: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as bits."""
        at = self.slots(values)
        out = self.table[at[0]]
        for row in at[1:]:
            out &= self.table[row]
        return out

    def counts(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Of each row and language, the n-grams that it contains, corrected for false positives; a long row part by part."""
        found, total = 0, 0
        for part, cut in segments(raw, offs):
            n = len(cut) - 1
            values, home = grams(part, cut)
            total = total + np.bincount(home, minlength=n)[:n, None].astype(float)
            masks = self.masks(values)
            found = found + np.stack([np.bincount(home, (masks[:, k // 8] >> (k % 8)) & 1, n) for k in range(len(self.languages))], axis=1)
        return np.clip((found - total * self.false_rate) / (1 - self.false_rate), 0, None)


def learn(docs: DataFrame, most: int = MOST_DOCS) -> Filters | None:
    """Filters from the documents that have a language and aren't held out; None without any."""
    spark = docs.sparkSession
    able = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(crc_mod(F.col("doc_id"), 4), F.lit(0)) != 2))
    rows = able.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row for each language
    if not rows:
        return None
    languages = [r.lang for r in rows]
    numbered = spark.createDataFrame([(r.lang, k, min(1.0, most / r["count"])) for k, r in enumerate(rows)], "l string, number int, share double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    named = able.select(F.col("lang").alias("l"), F.col("text").cast("string").alias("text"), draw.alias("draw"))
    sample = named.join(F.broadcast(numbered), "l").where("draw < share").select("number", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("number").to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, _, raw, offs in byte_chunks(batch.column("text")):
                for part, cut in segments(raw, offs):
                    values, home = grams(part, cut)
                    key, n = np.unique(values.astype(np.int64) << LANGUAGE_BITS | own[lo + home], return_counts=True)
                    yield pa.record_batch({"language": (key & (1 << LANGUAGE_BITS) - 1).astype(np.int32), "gram": key >> LANGUAGE_BITS, "n": n.astype(np.int64)})

    counted = materialise(sample.mapInArrow(run, "language int, gram long, n long").groupBy("gram", "language").agg(F.sum("n").alias("n")), "grams")
    totals = counted.groupBy("language").agg(F.sum("n").cast("double").alias("total"))
    # by n-gram there is at most one row for each language
    rated = counted.join(F.broadcast(totals), "language").groupBy("gram").agg(F.collect_list(F.struct("language", "n", (F.col("n") / F.col("total")).alias("rate"))).alias("seen"))
    best = F.array_max(F.transform("seen", lambda s: s.rate))
    rated = rated.select("gram", F.explode(F.filter("seen", lambda s: (s.rate >= SHARE * best) & (s.n >= LEAST_COUNT))).alias("s")).select("gram", "s.language")
    got = rated.select("language", "gram").toArrow()  # n-grams of the sample, which is bounded
    language, gram = (got.column(c).to_numpy() for c in ("language", "gram"))
    discard(counted)
    return Filters(languages, [np.sort(gram[language == k]) for k in range(len(languages))])


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(docs: DataFrame, model: Filters | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for lo, hi, raw, offs in byte_chunks(batch.column("text")) if model else ():
                found = model.counts(raw, offs)
                total, best = found.sum(1), found.argmax(1)
                letters = np.diff(np.searchsorted(np.flatnonzero(UPPER[raw] | LOWER[raw]), offs)) > 0
                for k in np.flatnonzero(~letters & (np.diff(offs) > 0)):
                    letters[k] = has_letter(raw[offs[k] : offs[k + 1]].tobytes())
                scores[lo:hi] = np.where(letters, np.where(total > 0, found.max(1) / np.maximum(total, 1e-9), 1 / len(model.languages)), 0)
                for k in np.flatnonzero(letters):
                    names[lo + k] = model.languages[best[k]]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(np.round(scores, 9))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
