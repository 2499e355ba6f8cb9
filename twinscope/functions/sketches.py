"""MinHash and SimHash of sets, each computed in its own row: the set is there, so nothing is exploded or shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscope.functions.hashing import ROWS, list_rows, md5_sets, shingle_sets
from twinscope.functions.text import let

HASHES, BANDS = 128, 32
WORD = (1 << 32) - 1


def coefficients(n: int = HASHES, seed: int | None = None) -> list[tuple[int, int]]:
    """Pairs (odd multiplier, addend) below 2^32, from the shared seed unless another is given."""
    draws = mulberry32(SHARED_SEED if seed is None else seed)
    return [(next(draws) | 1, next(draws)) for _ in range(n)]


def hash32(text: Column) -> Column:
    """The first 32 bits of the md5, which SQL engines have in common."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hashes32(items: Column) -> Column:
    """hash32 of each item of an array."""
    return F.transform(items, hash32)


def hashes64(items: Column) -> Column:
    """Two 32-bit halves of the md5 of each item, the first in front, as a signed number."""
    half = lambda digest, at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.transform(items, lambda x: let(F.md5(x), lambda d: F.shiftleft(half(d, 1), 32).bitwiseOR(half(d, 9))))


def utf16_units(text: Column) -> Column:
    """The code units of a text in UTF-16, each as 4 hexadecimal digits."""
    return F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("([0-9A-F]{4})"), F.lit(1))


def fnv1a32(text: Column) -> Column:
    """FNV-1a over UTF-16 code units, for sets hashed elsewhere with it."""
    def step(h: Column, unit: Column) -> Column:
        x = h.bitwiseXOR(F.conv(unit, 16, 10).cast("long"))
        return (F.shiftleft((F.shiftrightunsigned(x, 16) * 16777619).bitwiseAND(F.lit(0xFFFF)), 16) + x.bitwiseAND(F.lit(0xFFFF)) * 16777619).bitwiseAND(F.lit(WORD))

    return F.aggregate(utf16_units(text), F.lit(0x811C9DC5).cast("long"), step)


def text_hashes(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """key and hashes64 of the distinct word shingles of each text, in the row itself."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: md5_sets(batches, k), f"key {rows.schema['key'].dataType.simpleString()}, hashes array<long>").withColumnRenamed("key", key)


def high_halves(hashes: Column) -> Column:
    """hashes32 from hashes64."""
    return F.transform(hashes, lambda h: F.shiftrightunsigned(h, 32))


def lowest(values: np.ndarray, cut: np.ndarray, n: int = HASHES) -> pa.ListArray:
    """The signature of each set of 32-bit hashes, given end to end."""
    a, b = (np.array(x, np.uint64)[:, None] for x in zip(*coefficients(n), strict=True))
    out = np.full((len(cut) - 1, n), WORD, np.int64)
    for k in range(len(out)):
        low = np.full(n, WORD, np.uint64)
        for lo in range(cut[k], cut[k + 1], 1 << 14):
            h = values[lo : min(lo + (1 << 14), cut[k + 1])].astype(np.uint64)
            low = np.minimum(low, ((a * h + b) & np.uint64(WORD)).min(1))
        out[k] = low
    return pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * n, pa.array(out.ravel()))


def signatures(sets: DataFrame, key: str, hashes: str = "hashes", n: int = HASHES) -> DataFrame:
    """key, signature: of each set of 32-bit hashes the minimum of each of `n` affine hashes; an empty set has the largest number throughout."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({key: batch.column(key), "signature": lowest(*list_rows(batch.column("hashes")), n)})

    rows = sets.select(key, F.col(hashes).alias("hashes"))
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, signature array<long>")


def estimate(x: Column, y: Column) -> Column:
    """Share of equal slots of two signatures."""
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda e: e)) / F.size(x)


def bands(signature: Column, n_bands: int = BANDS, hashes: int = HASHES) -> Column:
    """The band keys of a signature: 64-bit hashes of a band's number and its slots."""
    rows = hashes // n_bands
    return F.array(*[F.xxhash64(F.lit(b), F.slice(signature, b * rows + 1, rows)) for b in range(n_bands)])


def print_words(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The simhash of each set of 64-bit hashes, given end to end."""
    n = np.diff(cut)
    votes = np.zeros((len(n), 64), np.int64)
    for k in np.flatnonzero(n):
        for lo in range(cut[k], cut[k + 1], 1 << 14):
            part = np.ascontiguousarray(values[lo : min(lo + (1 << 14), cut[k + 1])].astype("<i8"))
            votes[k] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * votes > n[:, None], axis=1, bitorder="little").view("<i8").ravel()


def printed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """key, items and simhash of rows (key, text)."""
    for batch in batches:
        for sets, hashed in zip(shingle_sets(iter([batch]), k), md5_sets(iter([batch]), k), strict=True):
            yield pa.record_batch({"key": sets.column("key"), "items": sets.column("items"), "simhash": pa.array(print_words(*list_rows(hashed.column("hashes"))))})


def carrying(batches: Iterator[pa.RecordBatch], k: int, carried: list[str]) -> Iterator[pa.RecordBatch]:
    """key, items and what is `carried` (simhash, signature; other columns as they are) of rows (key, text and those columns)."""
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            sets = next(shingle_sets(iter([batch]), k))
            out = {"key": sets.column("key"), "items": sets.column("items")} | {c: batch.column(c) for c in carried if c not in ("simhash", "signature")}
            if {"simhash", "signature"} & set(carried):
                values, cut = list_rows(next(md5_sets(iter([batch]), k)).column("hashes"))
                if "simhash" in carried:
                    out["simhash"] = pa.array(print_words(values, cut))
                if "signature" in carried:
                    out["signature"] = lowest(values.view(np.uint64) >> np.uint64(32), cut)
            yield pa.record_batch({c: out[c] for c in ("key", "items", *carried)})


def close_prints(batches: Iterator[pa.RecordBatch], bits: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """x < y of the fingerprints of each cell's two blocks that differ in 1 to `bits` bits, from rows in order of cells (cell: i * blocks + j for blocks i <= j, own, simhash)."""
    def compared(number: int, cell: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, word = (np.concatenate([b.column(c).to_numpy() for b in cell]) for c in ("own", "simhash"))
        i, j = divmod(int(number), blocks)
        one, two = word[own == i], word[own == j]
        raw = two.view(np.uint64)
        for lo in range(0, len(one), 1 << 10):
            found = []
            for p in one[lo : lo + (1 << 10)]:
                d = np.bitwise_count(p.view(np.uint64) ^ raw)
                at = np.flatnonzero(d <= bits)
                q = two[at[d[at] > 0]]
                if i == j:
                    q = q[q > p]  # the other order is found from the other side
                if len(q):
                    found.append((np.minimum(p, q), np.maximum(p, q)))
            if found:
                x, y = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.record_batch({"x": pa.array(x), "y": pa.array(y)})

    at, cell = None, []
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        edges = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            if at is not None and cells[lo] != at:
                yield from compared(at, cell)
                cell = []
            at = cells[lo]
            cell.append(batch.slice(lo, hi - lo))
    if cell:
        yield from compared(at, cell)


def simhashes(sets: DataFrame, key: str, hashes: str = "hashes") -> DataFrame:
    """key, n_items, simhash of sets of 64-bit hashes: bit k is set where more items have it than not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, cut = list_rows(batch.column("hashes"))
            yield pa.record_batch({key: batch.column(key), "n_items": pa.array(np.diff(cut), pa.int64()), "simhash": pa.array(print_words(values, cut))})

    rows = sets.select(key, F.col(hashes).alias("hashes"))
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, n_items long, simhash long")


#: Seed of the coefficients that signatures made elsewhere share.
SHARED_SEED = 0x1F2E3D4C


def mulberry32(seed: int) -> Iterator[int]:
    """The published 32-bit generator of that name."""
    state = seed
    while True:
        state = (state + 0x6D2B79F5) & WORD
        t = (state ^ state >> 15) * (state | 1) & WORD
        t ^= (t + ((t ^ t >> 7) * (t | 61) & WORD)) & WORD
        yield (t ^ t >> 14) & WORD
