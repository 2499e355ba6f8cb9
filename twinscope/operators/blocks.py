"""Sets kept in blocks, and all pairs of them by cells of two blocks.

Blocks are written once, with the items that other sets have too; a cell reads its two blocks and counts their pairs
in memory, so neither matches of items nor candidates are sent or written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscope.functions import cells
from twinscope.operators.storage import folder, spent_shuffles

#: About so many sets are of one bucket of items, and of one block; a small input has up to LEAST blocks of a few sets.
BUCKET, BLOCK, LEAST, FEW = 1 << 14, 1 << 15, 8, 64
TYPES = {"simhash": "long", "lang": "long", "signature": "array<long>", "family": "long"}


@dataclass(frozen=True)
class Blocks:
    """Distinct sets in blocks, in a folder that executors share."""

    spark: SparkSession
    path: str
    count: int
    carried: tuple[str, ...]

    def table(self, keep_block: bool = False) -> DataFrame:
        """rep, n, members, items that other sets have too, and what sets carry (`lang` as langs and the tally of each)."""
        found = self.spark.read.schema(schema(self.carried)).parquet(self.path)
        return found if keep_block else found.drop("block")


def schema(carried: tuple[str, ...]) -> str:
    more = [", langs array<long>, tally array<long>" if c == "lang" else f", {c} {TYPES[c]}" for c in carried]
    return f"block int, rep long, n int, members long{''.join(more)}, items array<long>"


def in_blocks(sets: DataFrame, many: int | None = None) -> Blocks:
    """The distinct sets of (key long, items; members where a row stands for several; simhash, lang, signature), written in blocks.

    Items are dealt into buckets with the 64-bit marks of their sets: a bucket tells those that one set alone has, copies
    aside, which nothing can share, from the others, whose number of sets orders them. `many` is the number of sets, if known.
    """
    spark, carried = sets.sparkSession, [c for c in cells.CARRIED if c in sets.columns]
    many = sets.count() if many is None else many
    buckets, blocks = max(16, -(-many // BUCKET)), max(1, min(LEAST, many // FEW), -(-many // BLOCK))
    rows = sets.select("key", (F.col("members").cast("long") if "members" in sets.columns else F.lit(1).cast("long")).alias("members"), "items", *carried)
    sent = ", marks array<long>, counts array<int>, items array<long>, mark long, key long, n int, members long" + "".join(f", {c} {TYPES[c]}" for c in carried)
    dealt = rows.mapInArrow(lambda batches: cells.dealt_items(batches, buckets, carried), "bucket int" + sent).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    held = dealt.mapInArrow(lambda batches: cells.held_items(batches, blocks, carried), "block int" + sent).repartition(blocks, "block").sortWithinPartitions("block")
    path = folder(spark, "blocks")
    with spent_shuffles(spark):
        held.mapInArrow(lambda batches: cells.blocked(batches, carried), schema(tuple(carried))).write.partitionBy("block").parquet(path)
    return Blocks(spark, path, blocks, tuple(carried))


def read_block(path: str, k: int, columns: list[str]) -> cells.Block | None:
    fs, local = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    found = fs.get_file_info(pafs.FileSelector(f"{local}/block={k}", allow_not_found=True))
    parts = [pq.read_table(f.path, columns=columns, filesystem=fs, partitioning=None) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".parquet")]
    return cells.Block(pa.concat_tables(parts)) if parts else None


def over_cells(sets: Blocks, columns: list[str], run: Callable[[cells.Block, cells.Block, bool], Iterator[pa.RecordBatch]], made: str) -> DataFrame:
    """What `run` makes of each two blocks, the same twice included; a row of the job is a cell."""
    path, count = sets.path, sets.count

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = one = None
        for batch in batches:
            for cell in batch.column("id").to_pylist():
                i, j = cell_of(cell, count)
                if i != at:
                    at, one = i, read_block(path, i, columns)
                two = one if i == j else read_block(path, j, columns)
                if one is not None and two is not None:
                    yield from run(one, two, i == j)

    total = count * (count + 1) // 2
    return sets.spark.range(0, total, 1, min(total, 4096)).mapInArrow(each, made)


def searched(thresholds: dict[str, float]) -> Callable:
    """How the pairs of two blocks are found: by first items where Jaccard similarity is asked alone, else by the counts of all items."""
    if set(thresholds) == {"jaccard"}:
        return lambda one, two, same: cells.near_sets(one, two, same, thresholds["jaccard"])
    return lambda one, two, same: cells.told_sets(one, two, same, thresholds)


def read_columns(*names: str) -> list[str]:
    return ["rep", "n", "members", "items", *(c for x in sorted({*names} & {*cells.CARRIED}) for c in (("langs", "tally") if x == "lang" else (x,)))]


def pairs_of(sets: Blocks, thresholds: dict[str, float], carried: tuple[str, ...] = ()) -> DataFrame:
    """a < b, n_a, n_b, shared, members_a, members_b of all pairs of distinct sets, of n > 0, that reach the threshold of one metric at least (within 1e-9).

    Of what sets carry and `carried` names: hamming of fingerprints, positives (pairs of members of one lang), agree (equal slots of signatures).
    """
    names, search = list(carried), searched(thresholds)

    def run(one: cells.Block, two: cells.Block, same: bool) -> Iterator[pa.RecordBatch]:
        for x, y, shared in search(one, two, same):
            for lo in range(0, len(x), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield cells.told(one, two, x[part], y[part], shared[part], names)

    kinds = {pa.int64(): "long", pa.int32(): "int"}
    return over_cells(sets, read_columns(*names, *thresholds), run, ", ".join(f"{c} {kinds[k]}" for c, k in cells.told_fields(names).items()))


def forest_of(sets: Blocks, thresholds: dict[str, float], parts: int = 1, last: int = 0) -> DataFrame:
    """metric, part, a, b: edges that join what the pairs at each metric's threshold join, in each cell one for each set but the first of its component.

    The part of a pair is that of its larger rep among `parts` equal ranges of 0 to `last`.
    """
    search = searched(thresholds)

    def run(one: cells.Block, two: cells.Block, same: bool) -> Iterator[pa.RecordBatch]:
        forests, rep = {}, np.concatenate((one.rep, two.rep))
        for x, y, shared in search(one, two, same):
            part = (np.maximum(one.rep[x], two.rep[y]) * parts / (last + 1)).astype(np.int64)
            for metric, t in thresholds.items():
                found = cells.reaches(one, two, x, y, shared, metric, t)
                for p in np.unique(part[found]).tolist():
                    at = found & (part == p)
                    forests.setdefault((metric, p), cells.Forest(len(rep))).add(x[at], y[at] + (0 if same else len(one.n)))
        for (metric, p), forest in forests.items():
            a, b = forest.edges()
            yield pa.record_batch({"metric": pa.array([metric] * len(a), pa.string()), "part": pa.array(np.full(len(a), p, np.int32)), "a": pa.array(np.minimum(rep[a], rep[b])), "b": pa.array(np.maximum(rep[a], rep[b]))})

    return over_cells(sets, read_columns(*thresholds), run, "metric string, part int, a long, b long")


def family_floors(sets: Blocks, families: DataFrame) -> DataFrame:
    """family and a column for each metric with the least value among all pairs of sets (with simhash) of each family (node, family), however far apart.

    The sets of families are written in blocks once more, with their family; a cell sends one row for a family, not its pairs.
    """
    placed = sets.table(keep_block=True).join(families, F.col("rep") == F.col("node")).select("block", "rep", "n", "members", "simhash", "family", "items")
    path = folder(sets.spark, "families")
    with spent_shuffles(sets.spark):
        placed.repartition(sets.count, "block").write.partitionBy("block").parquet(path)
    names = [*cells.RATIOS, "simhash"]

    def run(one: cells.Block, two: cells.Block, same: bool) -> Iterator[pa.RecordBatch]:
        least = {}
        for family, values in cells.family_floors(one, two, same):
            least[family] = tuple(map(min, least.get(family, values), values))
        table = np.array([*least.values()], np.float64).reshape(-1, len(names))
        yield pa.record_batch({"family": pa.array([*least], pa.int64())} | {m: pa.array(table[:, k]) for k, m in enumerate(names)})

    held = Blocks(sets.spark, path, sets.count, ("simhash", "family"))
    return over_cells(held, read_columns("simhash", "family"), run, "family long, " + ", ".join(f"{m} double" for m in names)).groupBy("family").agg(*[F.min(m).alias(m) for m in names])


def cell_of(cell: int, count: int) -> tuple[int, int]:
    """The blocks i <= j of a cell's number."""
    i = 0
    while cell >= count - i:
        cell -= count - i
        i += 1
    return i, i + cell
