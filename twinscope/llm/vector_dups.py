"""Near duplicates among the vectors of one label, by sorted projection passes.

Vectors link when their labels are equal and their cosine, in double precision, is THRESHOLD or more.

1. Rows of one label and vector are one class; only classes meet.
2. In each pass a class gets 64 signs of random projections, the first plane in the highest bit. Classes are
   ordered by label and these bits over the whole table, the order is cut into cells of CELL places that
   reach WINDOW places into the next, and all classes of a cell are compared. A cell sends on a spanning
   forest of the links that it verified, so a dense cell of n classes sends n - 1 links and not n squared.
3. Passes are joined by connected components. There are as many passes as leave a pair at the threshold apart
   with a probability of MISS: two classes that agree on the first bits are neighbours wherever no more than
   WINDOW classes share these bits. Groups denser than that are chained by their overlapping windows.
4. All links lie inside components, so they are counted there, all of them and exactly, whatever the windows
   have seen: a component of up to BLOCK classes in one task, a larger one by the angles of its classes to the
   component's first class. Two classes whose angles add up to less than the threshold's are linked and only
   counted, two whose angles differ by more aren't, and only the rest meet, block by block.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those of null
label, link with nothing and are components of their own; shorter vectors count as ending in zeros; rows of
equal vec_id are rows of their own; a component is named by its smallest vec_id, null if it has none, and a
row without id is never kept; other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from twinscope.llm.common import discard, materialise, shuffle_partitions, table
from twinscope.llm.multi_index import matrix
from twinscope.llm.near_dups import components

THRESHOLD = 0.93
WINDOW, CELL, BLOCK = 256, 1024, 128
MISS = 1e-6
SEED = 20240311
#: Widths of an angle bin, in parts of the threshold's angle, and what rounding may do to an angle.
BINS, SLACK = 64, 1e-6


def passes(classes: int, threshold: float = THRESHOLD) -> int:
    """How many passes a label of so many classes needs."""
    bits = max(1, math.ceil(math.log2(max(1.0, classes / WINDOW))) + 1)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(MISS) / math.log1p(-agree))


def units(column: pa.Array, kind: str) -> np.ndarray:
    """The vectors of a binary column, in double precision."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1).astype(float)


def cosines(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and of y reach the threshold; what a product of matrices leaves open is summed by itself."""
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    rough = (x / nx[:, None]) @ (y / ny[:, None]).T
    linked = rough >= threshold
    for i, j in np.argwhere(np.abs(rough - threshold) < 1e-9):
        linked[i, j] = (x[i] * y[j]).sum() / (nx[i] * ny[j]) >= threshold
    return linked


def forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    free = np.ones(len(linked), bool)
    for root in range(len(linked)):
        if free[root]:
            free[root], queue = False, [root]
            for u in queue:
                found = np.flatnonzero(linked[u] & free)
                free[found] = False
                queue += found.tolist()
                yield from ((u, v) for v in found.tolist())


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo < hi:
                key = tuple(c[lo] for c in columns)
                if key != current and held:
                    yield pa.Table.from_batches(held)
                    held = []
                current = key
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def prepared(vectors: DataFrame) -> tuple[DataFrame, str]:
    """row, vec_id and, of rows that take part, label, key (128 bits of label and vector) and vec; and the numbers' kind."""
    element = vectors.schema["embedding"].dataType
    kind = "<f4" if isinstance(element, ArrayType) and isinstance(element.elementType, FloatType) else "<f8"
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)  # NaN is above infinity
    rows = rows.withColumn("vec", F.when(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)), F.col("vec")))
    dim = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    padded = F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(max(0, dim)) - F.size("vec")))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.when(F.col("vec").isNotNull(), padded).alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch.column("vec").is_valid()
            packed: list[bytes | None] = [None] * batch.num_rows
            at = np.flatnonzero(there.to_numpy(zero_copy_only=False)).tolist()
            if at:
                for k, v in zip(at, matrix(batch.column("vec").filter(there), dim) + 0.0, strict=True):  # no negative zeros
                    packed[k] = v.astype(kind).tobytes()
            labels = batch.column("label").to_pylist()
            key = [v and hashlib.blake2b(v, digest_size=16, key=hashlib.blake2b(w.encode(), digest_size=16).digest()).digest() for v, w in zip(packed, labels, strict=True)]
            yield pa.record_batch({"row": batch.column("row"), "vec_id": batch.column("vec_id"), "label": batch.column("label"), "key": pa.array(key, pa.binary()), "vec": pa.array(packed, pa.binary())})

    return rows.mapInArrow(run, "row long, vec_id long, label string, key binary, vec binary"), kind


def ordered(classes: DataFrame, kind: str, n_passes: int) -> DataFrame:
    """cell, pass, node: the cells of each class, by its place in the order of each pass."""
    spark = classes.sparkSession

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = units(batch.column("vec"), kind)
            for p in range(n_passes if len(x) else 0):
                planes = np.random.default_rng((SEED, p)).standard_normal((x.shape[1], 64))
                signs = np.packbits(x @ planes > 0, axis=1).view(">i8").ravel().astype(np.int64)
                yield pa.record_batch({"pass": pa.array(np.full(len(x), p, np.int32)), "label": batch.column("label"), "signs": pa.array(signs), "node": batch.column("node")})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.record_batch({"part": pa.array(np.full(n, part, np.int32)), "at": pa.array(np.arange(at, at + n)), "pass": batch.column("pass"), "node": batch.column("node")})
            at += n

    order = "pass", "label", "signs", "node"
    entries = classes.select("label", "node", "vec").mapInArrow(project, "pass int, label string, signs long, node long")
    placed = entries.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(place, "part int, at long, pass int, node long")
    placed = materialise(placed, "order")
    starts, start = [], 0
    for part, n in sorted(placed.groupBy("part").count().collect()):  # a row for each partition
        starts.append((part, start))
        start += n
    place_of = F.col("at") + F.col("start")
    cell = F.floor(place_of / CELL)
    cells = F.when((place_of % CELL < WINDOW) & (cell > 0), F.array(cell, cell - 1)).otherwise(F.array(cell))
    return placed.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part").select(F.explode(cells).alias("cell"), "pass", "node")


def verified(cells: DataFrame, classes: DataFrame, kind: str, threshold: float = THRESHOLD) -> DataFrame:
    """a < b: a spanning forest of the links of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ("cell", "pass", "label")):
            node = rows.column("node").to_numpy()
            x = units(rows.column("vec").combine_chunks(), kind)
            edges = np.array([*forest(cosines(x, x, threshold))], np.int64).reshape(-1, 2)
            if len(edges):
                ends = np.sort(node[edges], axis=1)
                yield pa.record_batch({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})

    met = cells.join(classes.select("node", "label", "vec"), "node").repartition("cell").sortWithinPartitions("cell", "pass", "label")
    return met.select("cell", "pass", "label", "node", "vec").mapInArrow(run, "a long, b long").distinct()


def relation(i, j):
    """Of two angle bins: True if all their pairs are linked, False if none is, null if they must meet."""
    width, limit = 1 / BINS, 1.0
    sure, never = (i + j + 2) * width <= limit - SLACK, (F.abs(i - j) - 1) * width > limit + SLACK
    return F.when(sure, True).when(never, False)


def counted(placed: DataFrame, kind: str, threshold: float = THRESHOLD) -> DataFrame:
    """node, n: the rows of other classes that each class (component, node, members, vec) is linked with."""
    sizes = placed.groupBy("component").agg(F.count("*").alias("classes"))
    small = placed.join(sizes.where(F.col("classes") <= BLOCK), "component").select("component", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("block"), "node", "members", "vec")
    # beyond one block: by angle to the class that names the component
    large = sizes.where(F.col("classes") > BLOCK).select("component")
    pivot = placed.where("node = component").join(large, "component").select("component", F.col("vec").alias("pivot"))
    angle = math.acos(threshold)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = units(batch.column("vec"), kind), units(batch.column("pivot"), kind)
            if not len(x):
                continue
            c = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            bins = np.floor(np.arccos(np.clip(c, -1, 1)) / angle * BINS).astype(np.int64)
            yield pa.record_batch({n: batch.column(n) for n in ("component", "node", "members", "vec")} | {"bin": pa.array(bins)})

    turned = placed.join(pivot, "component").select("component", "node", "members", "vec", "pivot").mapInArrow(turn, "component long, node long, members long, vec binary, bin long")
    turned = materialise(turned, "angles")
    bins = turned.groupBy("component", "bin").agg(F.sum("members").alias("weight"), F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
    met = bins.join(bins.select("component", F.col("bin").alias("other"), F.col("weight").alias("other_weight"), F.col("parts").alias("other_parts")), "component").withColumn("sure", relation(F.col("bin"), F.col("other")))
    # linked for sure: all rows of such bins, without those of the class itself
    own = F.when(relation(F.col("bin"), F.col("bin")) == F.lit(True), F.col("members")).otherwise(0)
    sure = met.where("sure").groupBy("component", "bin").agg(F.sum("other_weight").alias("rows"))
    sure = turned.join(sure, ["component", "bin"]).select("node", (F.col("rows") - own).alias("n"))
    open_bins = met.where("sure IS NULL").groupBy("component", "bin").agg(F.max("parts").alias("parts"), F.collect_list(F.struct("other", "other_parts")).alias("others"))  # at most 150 bins a component
    block = F.col("bin") * (1 << 24) + F.pmod(F.xxhash64("node"), F.col("parts"))
    dealt = turned.join(open_bins, ["component", "bin"]).withColumn("block", block).withColumn("o", F.explode("others")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o.other_parts") - 1)))
    other = F.col("o.other") * (1 << 24) + F.col("part")
    dealt = dealt.select("component", F.least("block", other).alias("lo"), F.greatest("block", other).alias("hi"), "block", "node", "members", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ("component", "lo", "hi")):
            block, node, members = (rows.column(c).to_numpy() for c in ("block", "node", "members"))
            x = units(rows.column("vec").combine_chunks(), kind)
            one = block == rows.column("lo")[0].as_py()
            if one.all():
                linked = cosines(x, x, threshold)
                np.fill_diagonal(linked, False)
                n = linked @ members
            else:
                linked = cosines(x[one], x[~one], threshold)
                n = np.zeros(len(x), np.int64)
                n[one], n[~one] = linked @ members[~one], linked.T @ members[one]
            yield pa.record_batch({"node": pa.array(node[n > 0]), "n": pa.array(n[n > 0].astype(np.int64))})

    key = "component", "lo", "hi"
    met_blocks = small.unionByName(dealt).repartition(*key).sortWithinPartitions(*key).select(*key, "block", "node", "members", "vec")
    return met_blocks.mapInArrow(run, "node long, n long").unionByName(sure).groupBy("node").agg(F.sum("n").alias("n"))


def vector_dups(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of (vec_id, embedding, label)."""
    found, kind = prepared(vectors)
    rows = materialise(found, "vectors")
    classes = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("row").alias("node"), F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("members"), F.min("vec_id").alias("low"))
    classes = materialise(classes, "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    links = materialise(verified(ordered(classes, kind, passes(most, threshold)), classes, kind, threshold), "found") if most > 1 else None
    if links is None or links.isEmpty():
        named = classes.select("key", (F.col("members") - 1).alias("n_links"), F.col("low").alias("component_id"))
    else:
        labels = components(links).withColumnRenamed("class", "component")
        placed = materialise(classes.join(labels, "node").select("component", "node", "members", "low", "vec"), "placed")
        near = materialise(counted(placed.drop("low"), kind, threshold), "counted")
        names = placed.groupBy("component").agg(F.min("low").alias("component_id"))
        linked = placed.select("component", "node").join(names, "component").join(near, "node", "left").select("node", "component_id", F.coalesce("n", F.lit(0)).alias("n"))
        named = classes.select("key", "node", "members", "low").join(linked, "node", "left").select(
            "key", (F.col("members") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.when(F.col("n").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"),
        )
    # the rows of one class are a hot key on one side only, which Spark's skew join splits
    out = rows.select("vec_id", "key").join(named, "key", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op13_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups(table(spark, sf_dir, "embeddings"))
