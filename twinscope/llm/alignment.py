"""Alignment of two tokenizers over a corpus: which tokens end together, and how often each pair does.

A text with a blank before it is encoded by a byte-level BPE (side A) and by a piece model (side B), which puts
that blank itself. Where tokens of both sides end on the same byte, the text is cut into groups, and the two
tokens are linked.

Links are counted over the corpus in dense matrices, striped by side B's ids: a stripe holds every `stripes`-th
id and all of side A, DENSE_BYTES at most. Tasks add up what they have seen of a pair before they send it;
a stripe's task adds these sums with numpy.add.at, and a row's maximum is its id's best count. With many tasks
the sums of GROUP tasks are added first, so that no stripe waits for all of them. Scoring deals the links to
the stripe of their B id, where they meet the counts; a stripe of more than CELL_LINKS links is dealt to several
cells by document, each with the stripe's counts. What a document gets from each cell is summed.

Texts are encoded by distinct spans (see splitting); the piece model is cut before a blank that follows something
else, and around control characters that none of its pieces holds, since no piece reaches across. A long text
is aligned part by part.

Defined results: a text that is null or empty, or whose tokens don't give its bytes back (one with U+2581, for
one), has no tokens: zeros, and an empty digest; rows of equal doc_id are rows of their own; other columns of
the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from twinscope.llm.common import byte_chunks, materialise, table
from twinscope.llm.lexical import safe_cuts
from twinscope.llm.packed import BYTE_NAMES, Encoder
from twinscope.llm.splitting import Memo, encode_pass

SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
PASS_BYTES, MEMO_SPANS = 1 << 20, 500_000
DENSE_BYTES = 64 << 20
#: Links that one cell scores, pairs that a task holds before it sends their sums, tasks whose sums are added first.
CELL_LINKS, HELD_PAIRS, GROUP = 4_000_000, 2_000_000, 256
PAIR = np.dtype([("a", "<u4"), ("b", "<u4"), ("n", "<i8")])
LINK = np.dtype([("row", "<i8"), ("a", "<u4"), ("b", "<u4"), ("n", "<u4")])
COUNT = np.dtype([("a", "<u4"), ("b", "<u4"), ("n", "<i8"), ("best", "<i8")])


class ByteSide(Encoder):
    """Side A: special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        byte_of = {c: b for b, c in BYTE_NAMES.items()}
        added = {i: t.content.encode() for i, t in self.library.get_added_tokens_decoder().items()}
        names = ((i, self.library.id_to_token(i) or "") for i in range(self.library.get_vocab_size(with_added_tokens=True)))
        self.pieces = [added[i] if i in added else bytes(byte_of[c] for c in name) for i, name in names]

    def ids(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.split:
            return encode_pass(raw, offs, self.memo)
        data = raw.tobytes()
        found = [self.whole(data[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum([0, *(len(f) // 4 for f in found)])


class PieceSide:
    """Side B: texts come with the blank that the model would put before them."""

    def __init__(self, path: str):
        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        byte = {i for i in range(n) if self.model.is_byte(i)}
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.pieces = [bytes([int(name[3:5], 16)]) if i in byte else name.replace("▁", " ").encode() for i, name in enumerate(names)]
        text = [name for i, name in enumerate(names) if i not in byte]
        used = set("".join(text))
        self.breaks = np.zeros(256, bool)
        self.breaks[[c for c in range(9, 14) if chr(c) not in used]] = True
        # beyond these assumptions a text is one span
        self.cuts = bool(self.breaks[10]) and not any("▁" in name.lstrip("▁") for name in text)
        self.blank = np.array([self.model.piece_to_id("▁")], "<u4").tobytes()
        self.memo = Memo(self.encode_spans, MEMO_SPANS)

    def encode_spans(self, spans: list[bytes]) -> list[bytes]:
        """A span without a blank in front comes behind a line end, of which the model keeps two tokens: the blank that it puts, and the line end."""
        texts = [s.decode() for s in spans]
        found = self.model.encode([t[1:] if t[0] == " " else "\n" + t for t in texts], num_threads=1)
        return [self.blank if t == " " else np.array(ids if t[0] == " " else ids[2:], "<u4").tobytes() for t, ids in zip(texts, found, strict=True)]

    def starts(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(raw), bool)
        if self.cuts and len(raw):
            blank, brk = raw == 32, self.breaks[raw]
            cut[1:] = (blank[1:] & ~blank[:-1]) | brk[1:] | brk[:-1]
        cut[offs[:-1][offs[:-1] < offs[1:]]] = True
        return np.flatnonzero(cut)

    def ids(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return encode_pass(raw, offs, self.memo, self.starts)


class Aligned:
    """Rows of one pass: counts of tokens and groups, links (row, a, b, n), and the groups written out; rows that aren't whole have none."""

    def __init__(self, sides: Sides, raw: np.ndarray, offs: np.ndarray, there: np.ndarray, final: bool = True):
        n = len(offs) - 1
        ids, cuts = zip(*(side.ids(raw, offs) for side in (sides.a, sides.b)), strict=True)
        self.good = there.copy()
        for k in range(2):
            self.good &= sides.gives_back(k, ids[k], cuts[k], raw, offs)
        row = [np.repeat(np.arange(n), np.diff(c)) for c in cuts]
        if not self.good.all():
            kept = [self.good[r] for r in row]
            ids, row = [i[x] for i, x in zip(ids, kept, strict=True)], [r[x] for r, x in zip(row, kept, strict=True)]
        (a, b), (row_a, row_b) = ids, row
        end_a, end_b = np.cumsum(sides.sizes[0][a]), np.cumsum(sides.sizes[1][b])
        size = int(end_a[-1]) if len(end_a) else 0
        ends = np.zeros((2, size + 1), bool)
        ends[0, end_a] = ends[1, end_b] = True
        last_a, last_b = ends[1, end_a], ends[0, end_b]  # ends a group
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        groups = int(last_a.sum())
        before_b = np.r_[0, np.cumsum(np.bincount(group_b, minlength=groups))]
        upto_a = np.cumsum(np.bincount(group_a, minlength=groups))
        said = np.empty(len(a) + len(b), np.int64)
        said[np.arange(len(a)) + before_b[group_a]] = 2 * a.astype(np.int64) + last_a
        closing = last_b.astype(np.int64)
        if final and len(b):
            closing[np.r_[row_b[1:] != row_b[:-1], True]] = 2  # nothing follows the last group of a text
        said[np.arange(len(b)) + upto_a[group_b]] = 2 * len(sides.sizes[0]) + 3 * b.astype(np.int64) + closing
        self.n_a, self.n_b, self.n_groups = (np.bincount(r, minlength=n) for r in (row_a, row_b, row_a[last_a]))
        written = sides.written.take(pa.array(said))
        self.text = np.frombuffer(written.buffers()[2] or b"", np.uint8)
        at = np.frombuffer(written.buffers()[1], np.int64) if len(said) else np.zeros(1, np.int64)
        self.at = at[np.r_[0, np.cumsum(self.n_a + self.n_b)]]
        one, two = len(sides.sizes[0]), len(sides.sizes[1])
        key, times = np.unique((row_a[last_a] * one + a[last_a]) * two + b[last_b], return_counts=True)
        self.links = np.zeros(len(key), LINK)
        self.links["row"], self.links["a"], self.links["b"], self.links["n"] = key // (one * two), key // two % one, key % two, times


class Sides:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteSide(path_a), PieceSide(path_b)
        self.pieces = [pa.array(side.pieces, pa.large_binary()) for side in (self.a, self.b)]
        self.sizes = [np.array([len(p) for p in side.pieces]) for side in (self.a, self.b)]
        one, two = map(len, self.sizes)
        self.written = pa.array([f"{i}{s}".encode() for i in range(one) for s in (",", "|")] + [f"{i}{s}".encode() for i in range(two) for s in (",", ";", "")], pa.large_binary())

    def gives_back(self, side: int, ids: np.ndarray, cut: np.ndarray, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Of each row, whether its tokens' bytes are the row's."""
        joined = np.frombuffer(self.pieces[side].take(pa.array(ids)).buffers()[2] or b"", np.uint8)
        at = np.r_[0, np.cumsum(self.sizes[side][ids])][cut]
        joined = joined[: at[-1]]
        if np.array_equal(at, offs) and np.array_equal(joined, raw):
            return np.ones(len(offs) - 1, bool)
        return np.array([np.array_equal(joined[at[k] : at[k + 1]], raw[offs[k] : offs[k + 1]]) for k in range(len(offs) - 1)], bool)

    def stripes(self) -> int:
        one, two = map(len, self.sizes)
        return -(-two // max(1, DENSE_BYTES // (8 * one)))

    def rows(self, column: pa.Array) -> Iterator[tuple[np.ndarray, list[int], list[int], list[int], list[str], list[bytes]]]:
        """n_a, n_b, n_groups, digest and packed links of consecutive rows; texts come with a blank before them, null where there is none."""
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        for lo, hi, raw, offs in byte_chunks(column, PASS_BYTES):
            there = valid[lo:hi] & (np.diff(offs) > 1)
            if hi - lo == 1 and len(raw) > PASS_BYTES:
                yield self.long(raw, there)
                continue
            x = Aligned(self, raw, offs, there)
            digests = ["" if not ok else hashlib.sha256(x.text[a:b]).hexdigest() for ok, a, b in zip(x.good.tolist(), x.at[:-1].tolist(), x.at[1:].tolist(), strict=True)]
            edges = np.searchsorted(x.links["row"], np.arange(hi - lo + 1))
            pairs = packed(x.links)
            yield x.n_a, x.n_b, x.n_groups, digests, [pairs[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def long(self, raw: np.ndarray, there: np.ndarray) -> tuple:
        """One long text, part by part: both sides cut at a blank behind a letter."""
        cuts = safe_cuts(raw, PASS_BYTES).tolist()
        digest, counts, links, good = hashlib.sha256(), np.zeros(3, np.int64), [], bool(there[0])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            x = Aligned(self, raw[lo:hi], np.array([0, hi - lo]), there, hi == len(raw))
            good &= bool(x.good[0])
            digest.update(x.text[: x.at[-1]])
            counts += x.n_a[0], x.n_b[0], x.n_groups[0]
            links.append(packed(x.links))
            if len(links) > 16:
                links = [summed(np.concatenate(links))]
        if not good:
            return [0], [0], [0], [""], [b""]
        return *counts[:, None], [digest.hexdigest()], [summed(np.concatenate(links)).tobytes()]


def packed(links: np.ndarray) -> np.ndarray:
    out = np.zeros(len(links), PAIR)
    for name in PAIR.names:
        out[name] = links[name]
    return out


def summed(pairs: np.ndarray) -> np.ndarray:
    """PAIR with each pair once."""
    key, own = np.unique(pairs["b"].astype(np.int64) << 32 | pairs["a"], return_inverse=True)
    out = np.zeros(len(key), PAIR)
    out["b"], out["a"] = key >> 32, key & 0xFFFFFFFF
    np.add.at(out["n"], own, pairs["n"])
    return out


@functools.lru_cache(maxsize=1)
def sides(path_a: str, path_b: str) -> Sides:
    return Sides(path_a, path_b)


ENCODED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary"


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """ENCODED: a row for each document, with its distinct links packed as PAIR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for n_a, n_b, n_groups, digests, pairs in sides(path_a, path_b).rows(batch.column("t")):
                n = len(digests)
                yield pa.record_batch({
                    "row": batch.column("row").slice(lo, n), "doc_id": batch.column("doc_id").slice(lo, n), "n_a": pa.array(n_a, pa.int64()), "n_b": pa.array(n_b, pa.int64()),
                    "n_groups": pa.array(n_groups, pa.int64()), "groups_sha256": pa.array(digests, pa.string()), "pairs": pa.array(pairs, pa.binary()),
                })
                lo += n

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit(" "), F.col("text").cast("string")).alias("t"))
    return rows.mapInArrow(run, ENCODED)


def by_stripe(pairs: np.ndarray, stripes: int) -> Iterator[tuple[int, np.ndarray]]:
    stripe = pairs["b"] % stripes
    order = np.argsort(stripe, kind="stable")
    stripe, pairs = stripe[order], pairs[order]
    edges = np.r_[np.flatnonzero(np.r_[True, stripe[1:] != stripe[:-1]]), len(stripe)] if len(stripe) else np.zeros(1, int)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(stripe[lo]), pairs[lo:hi]


SUMS = "stripe int, part int, links long, sums binary"


def task_sums(rows: DataFrame, stripes: int) -> DataFrame:
    """SUMS: what each task has seen of the pairs of each stripe, added up, and how many links of documents that were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, entries, n, fresh = [], np.zeros(stripes, np.int64), 0, 0

        def send() -> Iterator[pa.RecordBatch]:
            for stripe, pairs in by_stripe(summed(np.concatenate(held)), stripes):
                yield pa.record_batch({"stripe": pa.array([stripe], pa.int32()), "part": pa.array([part], pa.int32()), "links": pa.array([int(entries[stripe])]), "sums": pa.array([pairs.tobytes()], pa.binary())})
                entries[stripe] = 0

        for batch in batches:
            for data in batch.column("pairs").to_pylist():
                pairs = np.frombuffer(data, PAIR)
                held.append(pairs)
                entries += np.bincount(pairs["b"] % stripes, minlength=stripes)
                fresh += len(pairs)
                if fresh >= HELD_PAIRS:
                    held, fresh = [summed(np.concatenate(held))], 0
                    n = len(held[0])
                    if n >= HELD_PAIRS:
                        yield from send()
                        held = []
        if held:
            yield from send()

    return rows.select("pairs").mapInArrow(run, SUMS)


def cells_of(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """The rows of each key as they come, from batches sorted by it."""
    rows = (row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist())
    yield from itertools.groupby(rows, lambda r: tuple(r[k] for k in keys))


def added(sums: DataFrame, shape: tuple[int, int], stripes: int, best: bool) -> DataFrame:
    """The sums of each stripe (and group of tasks, unless `best`) added in a dense matrix: SUMS, or COUNT with each B id's best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((-(-shape[1] // stripes), shape[0]), np.int64)
        for (stripe, part), rows in cells_of(batches, "stripe", "part"):
            dense[:] = 0
            links = 0
            for row in rows:
                pairs = np.frombuffer(row["sums"], PAIR)
                np.add.at(dense, (pairs["b"] // stripes, pairs["a"]), pairs["n"])
                links += row["links"]
            b, a = np.nonzero(dense)
            out = np.zeros(len(a), COUNT if best else PAIR)
            out["a"], out["b"], out["n"] = a, b * stripes + stripe, dense[b, a]
            if best:
                out["best"] = dense.max(1)[b]
            yield pa.record_batch({"stripe": pa.array([stripe], pa.int32()), "part": pa.array([part], pa.int32()), "links": pa.array([links]), "sums": pa.array([out.tobytes()], pa.binary())})

    part = F.lit(0) if best else F.floor(F.col("part") / GROUP).cast("int")
    dealt = sums.withColumn("part", part).repartition("stripe", "part").sortWithinPartitions("stripe", "part")
    return dealt.mapInArrow(run, SUMS)


def scored(rows: DataFrame, counts: DataFrame, shape: tuple[int, int], stripes: int, cells: dict[int, int]) -> DataFrame:
    """row, n_best, count_sum: what documents get from each cell, from ENCODED and the counts of stripes."""
    spark = rows.sparkSession
    several = np.ones(stripes, np.int64)
    several[list(cells)] = list(cells.values())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("pairs").to_pylist()
            sizes = np.array([len(d) for d in data]) // PAIR.itemsize
            pairs, links = np.frombuffer(b"".join(data), PAIR), np.zeros(int(sizes.sum()), LINK)
            links["row"], links["a"], links["b"], links["n"] = np.repeat(batch.column("row").to_numpy(), sizes), pairs["a"], pairs["b"], pairs["n"]
            out = []
            for stripe, own in by_stripe(links, stripes):
                cell = own["row"] % several[stripe]
                out += [(stripe, int(c), own[cell == c].tobytes()) for c in np.unique(cell).tolist()]
            if out:
                stripe, cell, blobs = zip(*out, strict=True)
                yield pa.record_batch({"stripe": pa.array(stripe, pa.int32()), "cell": pa.array(cell, pa.int32()), "links": pa.array([True] * len(out)), "data": pa.array(blobs, pa.binary())})

    kind = "stripe int, cell int, links boolean, data binary"
    links = rows.select("row", "pairs").mapInArrow(deal, kind)
    known = spark.createDataFrame([(s, int(several[s])) for s in range(stripes)], "stripe int, cells int")  # a row for each stripe
    counts = counts.join(F.broadcast(known), "stripe").select("stripe", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(False).alias("links"), F.col("sums").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((-(-shape[1] // stripes), shape[0]), np.int64)
        for _, found in cells_of(batches, "stripe", "cell"):
            dense[:] = 0
            best = np.zeros(len(dense), np.int64)
            for row in found:
                if not row["links"]:
                    c = np.frombuffer(row["data"], COUNT)
                    dense[c["b"] // stripes, c["a"]] = c["n"]
                    best[c["b"] // stripes] = c["best"]
                    continue
                x = np.frombuffer(row["data"], LINK)
                own, place = np.unique(x["row"], return_inverse=True)
                times, b = x["n"].astype(np.int64), x["b"] // stripes
                count = dense[b, x["a"]]
                sums = np.zeros((2, len(own)), np.int64)
                np.add.at(sums[0], place, times * (count == best[b]))
                np.add.at(sums[1], place, times * count)
                yield pa.record_batch({"row": pa.array(own), "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])})

    dealt = links.unionByName(counts).repartition("stripe", "cell").sortWithinPartitions("stripe", "cell", "links")  # counts before links
    return dealt.mapInArrow(run, "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the counts of all pairs (stripe, sums: COUNT)."""
    path_a, path_b = path_a or public_tokenizers.path(SIDE_A), path_b or public_tokenizers.path(SIDE_B)
    both = sides(path_a, path_b)
    shape, stripes = tuple(map(len, both.sizes)), both.stripes()
    rows = materialise(encoded(docs, path_a, path_b), "aligned")
    sums = task_sums(rows, stripes)
    if rows.select(F.spark_partition_id().alias("part")).distinct().count() > GROUP:
        sums = added(sums, shape, stripes, best=False)
    counts = materialise(added(sums, shape, stripes, best=True), "counts")
    cells = {s: -(-n // CELL_LINKS) for s, n in counts.select("stripe", "links").collect()}  # a row for each stripe
    told = rows.drop("pairs").join(scored(rows, counts, shape, stripes, cells), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return told.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256"), counts


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))[0]
