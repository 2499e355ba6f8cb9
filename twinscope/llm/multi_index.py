"""Approximate nearest neighbours by inner product with an inverted multi-index.

Vectors get one more component, the root of (largest squared norm - own squared norm), so that the
nearest by distance are those of the largest inner product. Each half of the vector is quantised by its
own k-means (up to CENTROIDS centroids, fitted on at most MOST_SAMPLE vectors), and a pair of centroids is
a cell. A query takes cells in order of summed distance from a heap until they hold a share of all entries;
the entries of those cells are ranked again by their exact inner products.

The share is measured, not set: it is what RECALL of the true neighbours of MOST_TRIED queries of the sample
need, searched in the sample by brute force. In a whole table neighbours are closer than in a sample of it,
so recall there is higher. Vectors with clusters need a small share, vectors without any a large one.

Entries are dealt into blocks of about ENTRY_BLOCK in the order of their cells, a query to those blocks that
hold a cell it takes. Each task reads a block's entries and then the block's queries as they come, so an
entry is sent once for each QUERY_BLOCK queries, and no group has to fit in memory. Copies of a vector beyond
the K + 1 of smallest id can't be among K nearest, so they are left out before, with no effect on the result.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do rows without id; shorter vectors count as ending in zeros; rows that repeat id and vector count
once; a query with fewer candidates than K gets them all, as far as they lie in cells that it takes, which
are all cells in tables of up to FEW rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscope.llm.common import materialise, shuffle_partitions, splitmix, table, text_bytes
from twinscope.llm.lexical import thin

K = 20
CENTROIDS = 128
MOST_SAMPLE, MOST_TRIED = 20_000, 200
RECALL = 0.95
#: Up to so many rows a query takes all cells, since it may need all of them for K candidates.
FEW = 4 * K
ENTRY_BLOCK, QUERY_BLOCK, QUERIES_AT_ONCE = 4096, 100_000, 256
ROW = "block int, q_block int, kind int, id long, c1 int, c2 int, reach double, vec binary"
ROW_KINDS = {"block": pa.int32(), "q_block": pa.int32(), "kind": pa.int32(), "id": pa.int64(), "c1": pa.int32(), "c2": pa.int32(), "reach": pa.float64(), "vec": pa.binary()}
ENTRY_ROW, QUERY_ROW = 0, 1


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part."""
    vec = F.col("embedding").cast("array<double>")
    ok = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)  # NaN is above infinity
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    return rows.where(F.coalesce(ok, F.lit(False)))


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centre)
        n = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(1))


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return distances(x, centre).argmin(1)


def traverse(first: np.ndarray, second: np.ndarray, held: np.ndarray, target: int) -> tuple[list[tuple[int, int]], float]:
    """Cells that hold entries, by rising sum of distances, until `target` entries are in them, and the largest sum."""
    a, b = first.argsort(kind="stable").tolist(), second.argsort(kind="stable").tolist()
    da, db = first[a].tolist(), second[b].tolist()
    rows = held[np.ix_(a, b)].tolist()
    heap, out, found, reach = [(da[0] + db[0], 0, 0)], [], 0, 0.0
    while heap and found < target:
        total, i, j = heapq.heappop(heap)
        if rows[i][j]:
            out.append((a[i], b[j]))
            found += rows[i][j]
            reach = total
        if j + 1 < len(b):  # each cell is reached once: along its row, or down the first column
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
    return out, reach


class Quantiser:
    def __init__(self, sample: np.ndarray, largest: float, centroids: int = CENTROIDS):
        self.dim, self.largest = sample.shape[1], largest
        full = self.extend(sample)
        self.cut = full.shape[1] // 2 if full.shape[1] > 1 else 1
        k = max(1, min(centroids, len(sample) // 8))
        self.one, self.two = kmeans(full[:, : self.cut], k), kmeans(full[:, self.cut :], k)
        self.share = self.needed(sample)

    def extend(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(0, self.largest - (x * x).sum(1)))]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        full = self.extend(x)
        return nearest(full[:, : self.cut], self.one), nearest(full[:, self.cut :], self.two)

    def query_distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        full = np.c_[x, np.zeros(len(x))]
        return distances(full[:, : self.cut], self.one), distances(full[:, self.cut :], self.two)

    def needed(self, sample: np.ndarray, k: int = K) -> float:
        """The share of the sample's entries, in the order of their cells, within which RECALL of the true neighbours lie."""
        n = len(sample)
        if n <= FEW:
            return 1.0
        one, two = self.cells(sample)
        places = []
        for q in np.unique(np.linspace(0, n - 1, MOST_TRIED).astype(int)):
            score = sample @ sample[q]
            score[q] = -np.inf
            d1, d2 = self.query_distances(sample[q : q + 1])
            total = d1[0, one] + d2[0, two]
            own = total[np.argpartition(-score, k)[:k]]
            places.append(np.searchsorted(np.sort(total), own, side="right") / n)
        return float(np.quantile(np.concatenate(places), RECALL, method="higher"))


class Blocks:
    """Which block an entry of a cell is in: consecutive cells share one, a large cell has several of its own."""

    def __init__(self, held: np.ndarray):
        self.held = held
        flat = held.ravel()
        self.parts = np.maximum(1, -(-flat // ENTRY_BLOCK))
        self.first = np.zeros(len(flat), np.int64)
        block = filled = 0
        for c in np.flatnonzero(flat).tolist():
            if filled and (filled + flat[c] > ENTRY_BLOCK):
                block, filled = block + 1, 0
            self.first[c] = block
            filled += int(flat[c])
            if self.parts[c] > 1:
                block, filled = block + int(self.parts[c]), 0

    def of_entries(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> np.ndarray:
        cell = one * self.held.shape[1] + two
        return self.first[cell] + (splitmix(ids.astype(np.uint64)) % self.parts[cell].astype(np.uint64)).astype(np.int64)

    def of_cells(self, cells: list[tuple[int, int]]) -> np.ndarray:
        at = np.array(cells, np.int64).reshape(-1, 2) @ np.array([self.held.shape[1], 1])
        return np.unique(np.repeat(self.first[at], self.parts[at]) + np.concatenate([np.arange(p) for p in self.parts[at]] or [np.zeros(0, np.int64)]).astype(np.int64))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column without nulls, all of length `dim`."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)


class Block:
    """The entries of a block, in order of their ids."""

    def __init__(self, model: Quantiser, ids: np.ndarray, one: np.ndarray, two: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.model, self.ids, self.one, self.two, self.x = model, ids[order], one[order], two[order], x[order]

    def nearest(self, ids: np.ndarray, reach: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each query, its id and the ids and exact scores of its best among the entries of cells within its reach."""
        d1, d2 = self.model.query_distances(queries)
        rough = queries @ self.x.T
        slack = 1e-9 * (1 + np.abs(rough).max(initial=0))
        taken = d1[:, self.one] + d2[:, self.two] <= reach[:, None] * (1 + 1e-9) + 1e-12
        taken &= self.ids != ids[:, None]
        for q in range(len(ids)):
            at = np.flatnonzero(taken[q])
            if len(at) > k:
                near = rough[q, at]
                at = at[near >= np.partition(near, len(at) - k)[len(at) - k] - slack]
            score = (self.x[at] * queries[q]).sum(1)  # a row's sum doesn't depend on the rows beside
            best = np.lexsort((self.ids[at], -score))[:k]
            if len(best):
                yield int(ids[q]), self.ids[at[best]], score[best]


def rows_of(batch: pa.RecordBatch, dim: int) -> dict[str, np.ndarray]:
    out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ROW_KINDS if c != "vec"}
    raw, offs = text_bytes(batch.column("vec"))
    return out | {"vec": np.frombuffer(raw[offs[0] : offs[-1]], float).reshape(-1, dim)}


def search(vectors: DataFrame, is_query: Column | None = None, k: int = K, share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest entries found for each query row. `share`: as measured, if None."""
    spark = vectors.sparkSession
    rows = valid(vectors)
    stats = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)).alias("largest"), F.max(F.size("vec")).alias("dim")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not stats.n:
        return spark.createDataFrame([], schema)
    dim = stats.dim
    rows = rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vec"))))
    sample = thin(rows, F.col("vec_id"), MOST_SAMPLE, 29).select("vec_id", "vec").collect()
    sample.sort(key=lambda r: (r.vec_id, r.vec))
    model = Quantiser(np.array([r.vec for r in sample] or [rows.first().vec], float), stats.largest)
    # copies: the k + 1 of smallest id; the limit is applied before the shuffle as well
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    entries = rows.dropDuplicates(["vec_id", "vec"]).withColumn("copy", rank).where(F.col("copy") <= k + 1).select("vec_id", "vec")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vec"), dim)
                one, two = model.cells(x)
                yield pa.record_batch({"id": batch.column("vec_id"), "c1": one.astype(np.int32), "c2": two.astype(np.int32), "vec": pa.array([r.tobytes() for r in x], pa.binary())})

    entries = materialise(entries.mapInArrow(assign, "id long, c1 int, c2 int, vec binary"), "cells")
    held = np.zeros((len(model.one), len(model.two)), np.int64)
    for r in entries.groupBy("c1", "c2").count().collect():  # a row for each cell
        held[r.c1, r.c2] = r["count"]
    target = int(np.ceil((share or model.share) * held.sum()))
    blocks = Blocks(held)
    queries = rows.where(F.pmod("vec_id", F.lit(20)) == 0 if is_query is None else is_query).dropDuplicates(["vec_id", "vec"])
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, one, two = (batch.column(c).to_numpy() for c in ("id", "c1", "c2"))
            block = blocks.of_entries(one.astype(np.int64), two.astype(np.int64), ids)
            for q in range(query_blocks):
                n = len(ids)
                whole = {"block": block.astype(np.int32), "q_block": np.full(n, q, np.int32), "kind": np.full(n, ENTRY_ROW, np.int32), "id": ids, "c1": one, "c2": two, "reach": np.zeros(n), "vec": batch.column("vec")}
                yield pa.record_batch(whole)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, QUERIES_AT_ONCE):
                part = batch.slice(lo, QUERIES_AT_ONCE)
                x, ids = matrix(part.column("vec"), dim), part.column("vec_id").to_numpy()
                out: list[tuple] = []
                for q, vec, d1, d2 in zip(ids.tolist(), x, *model.query_distances(x), strict=True):
                    cells, reach = traverse(d1, d2, held, target)
                    own, data = int(splitmix(np.array([q], np.int64).view(np.uint64))[0] % np.uint64(query_blocks)), vec.tobytes()
                    out += [(b, own, QUERY_ROW, q, 0, 0, reach, data) for b in blocks.of_cells(cells).tolist()]
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ROW_KINDS.values(), strict=True)], names=[*ROW_KINDS])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held_rows, block = None, [], None
        for batch in batches:
            r = rows_of(batch, dim)
            group = np.stack([r["block"], r["q_block"], r["kind"]], axis=1)
            edges = np.r_[0, np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1, len(group)] if len(group) else np.zeros(1, int)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                key, kind = tuple(group[lo, :2].tolist()), group[lo, 2]
                if key != current:
                    current, held_rows, block = key, [], None
                if kind == ENTRY_ROW:
                    held_rows.append([r[c][lo:hi] for c in ("id", "c1", "c2", "vec")])
                    continue
                if block is None and held_rows:
                    block = Block(model, *(np.concatenate(c) for c in zip(*held_rows, strict=True)))
                for a in range(lo, hi, QUERIES_AT_ONCE) if block else ():
                    b = min(hi, a + QUERIES_AT_ONCE)
                    found = list(block.nearest(r["id"][a:b], r["reach"][a:b], r["vec"][a:b], k))
                    if found:
                        ids, scores = [x[1] for x in found], [x[2] for x in found]
                        yield pa.record_batch({"query_id": pa.array([x[0] for x in found], pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float64()))})

    asked = queries.select("vec_id", "vec").repartition(shuffle_partitions(spark)).mapInArrow(probe, ROW)
    met = entries.mapInArrow(place, ROW).unionByName(asked).repartition(shuffle_partitions(spark), "block", "q_block").sortWithinPartitions("block", "q_block", "kind", "id")
    found = met.mapInArrow(best, "query_id long, ids array<long>, scores array<double>")
    pairs = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
