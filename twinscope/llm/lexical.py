"""Vectorised views of UTF-8 text: lower case, words, word hashes, counts by segment."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscope.llm.common import CHUNK_BYTES, crc_mod, splitmix

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, LOWER, DIGIT = byte_set(bytes(range(65, 91))), byte_set(bytes(range(97, 123))), byte_set(b"0123456789")
WIDE = np.arange(256) >= 128
#: Letters; the bytes of all characters beyond ASCII count as letters.
LETTER = UPPER | LOWER | WIDE
SPACE = byte_set(b" \t\n\r\x0b\x0c")
PUNCT = ~(LETTER | DIGIT | SPACE)
WORDLY = UPPER | LOWER | DIGIT
_LOWER_TABLE = np.arange(256, dtype=np.uint8)
_LOWER_TABLE[65:91] += 32


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK_BYTES + 4096
    while size < n:
        size *= 2
    return _powers(size)


def lower(raw: np.ndarray) -> np.ndarray:
    """Bytes in lower case: ASCII, and the Latin-1 letters in UTF-8."""
    out = _LOWER_TABLE[raw]
    if len(raw) > 1:
        second = np.flatnonzero(raw[:-1] == 0xC3) + 1
        b = raw[second]
        out[second[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]] += 32
    return out


def safe_cuts(raw: np.ndarray, limit: int = CHUNK_BYTES) -> np.ndarray:
    """Cuts of one long text into passes of about `limit` bytes, each at a blank between ASCII letters or digits."""
    cuts, at = [0], 0
    while len(raw) - at > limit:
        lo = at + limit // 2
        while True:
            hi = min(len(raw), lo + limit // 2)
            part = raw[lo - 1 : hi + 1]
            found = np.flatnonzero((part[1:-1] == 32) & WORDLY[part[:-2]] & WORDLY[part[2:]])
            if len(found) or hi == len(raw):
                break
            lo = hi
        if not len(found):
            break
        at = lo + int(found[-1])
        cuts.append(at)
    return np.array([*cuts, len(raw)])


def segments(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes and offsets of some rows as they are, or a single long row part by part."""
    if len(offs) == 2 and len(raw) > CHUNK_BYTES:
        cuts = safe_cuts(raw)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield raw[a:b], np.array([0, b - a])
    else:
        yield raw, offs


def word_bounds(letters: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run ends where its row does."""
    if not len(letters):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(letters) + 1, bool)
    first[offs[:-1]] = True
    first = first[:-1]
    before = np.r_[False, letters[:-1]]
    starts = np.flatnonzero(letters & (first | ~before))
    last = np.zeros(len(letters), bool)
    last[:-1] = first[1:]
    last[-1] = True
    after = np.r_[letters[1:], False]
    return starts, np.flatnonzero(letters & (last | ~after)) + 1


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which `span_hash` takes the hash of any span."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, wherever it stands."""
    _, down = powers(len(sums))
    return splitmix((sums[ends] - sums[starts]) * down[starts])


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that `span_hash` gives for these words (given in lower case)."""
    data = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in data])
    raw = np.frombuffer(b"".join(data), np.uint8)
    return span_hash(prefix_sums(raw), np.r_[0, ends[:-1]].astype(np.int64), ends.astype(np.int64))


def counts(mask: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many True lie between consecutive cuts."""
    return np.diff(np.searchsorted(np.flatnonzero(mask), cuts))


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Position of each value in a sorted table, -1 where it isn't there."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def thin(rows: DataFrame, key: Column, most: int, seed: int) -> DataFrame:
    """About `most` rows, chosen by a hash of the key; all if there are no more."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int, seed: int = 17) -> DataFrame:
    """doc_id, text and label of about `most` labelled documents that aren't held out.

    Where a document has labels that differ, the larger counts. The chosen labels, at most a few
    percent over `most` rows, are broadcast, so that the texts aren't shuffled.
    """
    able = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), modulus) != remainder))
    able = thin(able.groupBy(F.col("doc_id").alias("label_id")).agg(F.max(label).cast("int").alias("label")), F.col("label_id"), most, seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(able), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label")
