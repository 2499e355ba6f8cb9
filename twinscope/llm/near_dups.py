"""Near duplicates by Order MinHash, verified by banded alignment.

A text is its words in lower case (runs of letters and digits). Its k-mers are WORDS words long and
labelled with their occurrence, so each is unique in its text. A sketch holds the KEPT labelled k-mers
of smallest hash in the order they have in the text, so two texts share it if they share these k-mers
and their order; SKETCHES sketches bucket the texts. Two texts are linked when an alignment matches m of their
n_a and n_b words in order with m / (n_a + n_b - m) >= THRESHOLD, which up to one word in nine replaced
reaches, and when their k-mers' Jaccard similarity is at least LEAST, which few pairs that share a sketch
miss. The alignment takes a chain of common k-mers, in a band as wide as the unmatched words of a pair at the threshold allow, and
between its links the longest common subsequence of words, by bits.

No bucket is expanded into all pairs, and none is capped:
1. star: a text is paired with the most central text of its buckets (the one it resembles most);
2. rest: in buckets that verified links haven't made one class, texts that have a partner in another class
   are brought to it, and all such pairs are aligned there, each in the first bucket that it shares; only
   links leave the task, one for two classes, so its output is no larger than its input.
A bucket of more than BLOCK texts is dealt into blocks. Its stars are made block by block, then among the
blocks' centres, and so on until one is left; in 2 each two blocks that can hold a pair of different
classes meet in a task of their own. So no task holds more than two blocks, and no pair is left out.
Links of 2 join classes, so the components are made anew among these classes only.

Resemblance is estimated from BINS one-byte minima of one permutation. A pair is passed over when one text
has fewer than THRESHOLD of the other's words, which loses nothing, or when the estimate is below FLOOR, which
those of a pair with one of nine words replaced are with a probability of 2e-6. A link
inside a class can't change the classes, so leaving it out loses nothing.

Equal word sequences are one node throughout, so copies never meet each other in buckets. Classes are
connected components, found by label propagation with pointer jumping over the cluster.

Defined results: null texts are classes of their own; texts without words are classed with equal texts;
a text of fewer than WORDS words is one k-mer; a class is named by its smallest doc_id (null if none has
one); repeated rows fall into one class; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscope.llm.common import byte_chunks, discard, materialise, splitmix, table, text_bytes
from twinscope.llm.lexical import DIGIT, LETTER, lower, prefix_sums, segments, span_hash, word_bounds

WORDS = 5
KEPT = 2
SKETCHES = 24
#: Hashes that one numpy step of the sketches makes.
WIDE_ITEMS = 1 << 16
BINS = 128
THRESHOLD = 0.8
#: The k-mers' similarity that a pair needs besides: one of ten words moved leaves about 0.2, one of nine replaced 0.38.
LEAST = 0.15
#: The estimate of that below which a pair is passed over, unless both are short; a pair of 0.285 is with a probability of 2e-6, one of 0.2 with 2e-3.
FLOOR = 0.1
#: Members that stand for a bucket when its most central one is sought.
SOUNDED = 32
#: Texts of a bucket that meet in one task; two such blocks at most.
BLOCK = 2048
#: Texts whose k-mers a task keeps at hand.
HELD = 256
#: Words of a cell's texts that are kept as slots at once, twice.
TILE_WORDS, SLOT_BITS = 1 << 21, 20
_RNG = np.random.default_rng(20240229)
SEEDS = _RNG.integers(1, 1 << 63, SKETCHES, dtype=np.uint64)
FACTORS = _RNG.integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = np.cumprod(np.full(WORDS, 0xD6E8FEB86659FD93, np.uint64))
GOLD = np.uint64(0x9E3779B97F4A7C15)
TOKEN = LETTER | DIGIT
#: Of a text: a byte for each bin, and how many k-mers it has.
PROFILE = np.dtype([("bins", "u1", BINS), ("size", "<u4")])
NODE = np.dtype("V16")


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each row's begin (one more than rows). A long row is read part by part."""
    found = []
    for part, cut in segments(raw, offs):
        starts, ends = word_bounds(TOKEN[part], cut)
        found.append(span_hash(prefix_sums(lower(part)), starts, ends))
    if len(found) > 1:
        words = np.concatenate(found)
        return words, np.array([0, len(words)])
    return found[0], np.searchsorted(starts, cut)


def labelled_kmers(words: np.ndarray) -> np.ndarray:
    """The k-mers of a word sequence in order, each hashed with its occurrence number."""
    n = len(words) - WORDS + 1
    if n < 1:
        return splitmix(np.array([(words * PLACES[: len(words)]).sum()], np.uint64)) if len(words) else words
    return labelled(splitmix(sum(words[j : j + n] * PLACES[j] for j in range(WORDS))))


def labelled(values: np.ndarray) -> np.ndarray:
    """Hashes in order, those that came before in the row hashed with their occurrence number."""
    order = np.argsort(values, kind="stable")
    same = np.r_[False, values[order][1:] == values[order][:-1]]
    if same.any():
        at = np.arange(len(values))
        count = np.zeros(len(values), np.uint64)
        count[order] = at - np.maximum.accumulate(np.where(same, 0, at))
        values = np.where(count > 0, splitmix(values + count * GOLD), values)
    return values


def sketches(kmers: np.ndarray) -> np.ndarray:
    """SKETCHES hashes, each of the KEPT smallest labelled k-mers in text order."""
    at = np.empty((SKETCHES, min(KEPT, len(kmers))), np.int64)
    rows = max(1, WIDE_ITEMS // max(1, len(kmers)))  # of a long text one sketch at a time
    for s in range(0, SKETCHES, rows):
        v = (kmers ^ SEEDS[s : s + rows, None]) * FACTORS[s : s + rows, None]
        v ^= v >> np.uint64(32)
        at[s : s + rows] = np.argpartition(v, KEPT - 1, axis=1)[:, :KEPT] if len(kmers) > KEPT else np.arange(len(kmers))
    at.sort(axis=1)
    key = SEEDS.copy()
    for k in range(at.shape[1]):
        key = (key ^ kmers[at[:, k]]) * GOLD
        key ^= key >> np.uint64(29)
    return key


def profile(kmers: np.ndarray) -> bytes:
    """As PROFILE: one byte for each bin of the hash range, from its smallest k-mer (0 if it has none), and the number of k-mers."""
    whole = np.zeros(1, PROFILE)
    whole["size"] = len(kmers)
    out = whole["bins"][0]
    s = np.sort(kmers)
    b = (s >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.r_[True, b[1:] != b[:-1]]
    out[b[first]] = 1 + (s[first] & np.uint64(0xFFFF)) % np.uint64(255)
    return whole.tobytes()


SKETCHED = "doc_id long, text64 long, node binary, keys array<long>, bins binary"


def sketch(docs: DataFrame) -> DataFrame:
    """A row for each document: its node (128 bits of its word sequence), sketches and minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            for lo, hi, raw, offs in byte_chunks(batch.column("text")):
                words, cut = word_hashes(raw, offs)
                nodes, keys, bins = [], [], []
                for k in range(hi - lo):
                    own = words[cut[k] : cut[k + 1]]
                    kmers = labelled_kmers(own)
                    if len(own):
                        nodes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                        keys.append(sketches(kmers).view(np.int64))
                        bins.append(profile(kmers))
                    else:
                        nodes.append(None if null[lo + k] else hashlib.blake2b(raw[offs[k] : offs[k + 1]].tobytes(), digest_size=16, person=b"wordless").digest())
                        keys.append(None)
                        bins.append(None)
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(lo, hi - lo), "text64": batch.column("text64").slice(lo, hi - lo), "node": pa.array(nodes, pa.binary()),
                    "keys": pa.array(keys, pa.list_(pa.int64())), "bins": pa.array(bins, pa.binary()),
                })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text64", F.xxhash64("text"))
    return rows.mapInArrow(run, SKETCHED)


def estimates(one: np.void, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated resemblance of one text with many, by their profiles, and whether the pair has to be looked at."""
    bins, own = many["bins"], one["bins"]
    used = ((own != 0) | (bins != 0)).sum(1)
    same = ((own == bins) & (own != 0)).sum(1) / np.maximum(1, used)
    few = WORDS - 1.0  # words beyond k-mers
    small, large = np.minimum(one["size"], many["size"]) + few, np.maximum(one["size"], many["size"]) + few
    return same, (same >= np.where(used >= BINS // 2, FLOOR, 0)) & (small >= THRESHOLD * large - 1e-9)


def star(profiles: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Each text of a cell with the most central one."""
    spots = np.unique(np.linspace(0, len(profiles) - 1, SOUNDED).astype(int))
    best = max(spots.tolist(), key=lambda k: (estimates(profiles[k], profiles)[0].sum(), -k))
    same, good = estimates(profiles[best], profiles)
    for k in np.flatnonzero(good):
        if k != best:
            yield k, best, float(same[k])


def several(blocks: np.ndarray) -> np.ndarray | None:
    """The blocks of a cell, if it has two."""
    return blocks if blocks.min() != blocks.max() else None


def apart(classes: np.ndarray, blocks: np.ndarray | None, k: int) -> np.ndarray:
    """Which texts of a cell are of another class than the k-th and, where the cell has two blocks, of the other one."""
    other = classes != classes[k]
    return other if blocks is None else other & (blocks != blocks[k])


def unsettled(keys: np.ndarray, bucket: int, profiles: np.ndarray, classes: np.ndarray, blocks: np.ndarray, rows: range | None = None, among: range | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For members of a cell (those in `rows`), the later ones (in `among`) of other classes that have to be looked at and share no earlier bucket."""
    blocks = several(blocks)
    end = len(profiles) if among is None else among.stop
    for k in range(len(profiles) - 1) if rows is None else rows:
        first = k + 1 if among is None else max(k + 1, among.start)
        other = np.flatnonzero(apart(classes, blocks, k)[first:end]) + first
        if len(other):
            other = other[estimates(profiles[k], profiles[other])[1]]
            shared = keys[other] == keys[k]
            yield k, other[keys[k][shared.argmax(1)] == bucket] if len(other) else other


def column_values(name: str, column: pa.Array) -> np.ndarray:
    """A column without nulls as numpy: nodes, classes and profiles by their width, keys as rows."""
    if name == "keys":
        return column.flatten().to_numpy().reshape(-1, SKETCHES)
    kind = {"node": NODE, "class": NODE, "bins": PROFILE}.get(name)
    if kind is None:
        return column.to_numpy(zero_copy_only=False)
    raw, offs = text_bytes(column)
    return np.frombuffer(raw[offs[0] : offs[-1]], kind)


def grouped(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """cell and its columns, from batches sorted by cell."""
    held: list[list[np.ndarray]] = []
    current = None
    for batch in batches:
        cell = batch.column("cell").to_numpy(zero_copy_only=False)
        columns = [column_values(c, batch.column(c)) for c in names]
        edges = np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)] if len(cell) else np.zeros(1, int)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if cell[lo] != current:
                if held:
                    yield current, [np.concatenate(c) for c in zip(*held, strict=True)]
                held, current = [], cell[lo]
            held.append([c[lo:hi] for c in columns])
    if held:
        yield current, [np.concatenate(c) for c in zip(*held, strict=True)]


MEMBER = {"cell": "long", "bucket": "long", "block": "long", "node": "binary", "bins": "binary", "keys": "array<long>", "class": "binary"}


def remaining(cells: DataFrame) -> DataFrame:
    """The members of cells that have an unsettled partner, as MEMBER."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, (nodes, bucket, blocks, bins, keys, classes) in grouped(batches, ("node", "bucket", "block", "bins", "keys", "class")):
            hit = np.zeros(len(nodes), bool)
            for k, partners in unsettled(keys, bucket[0], bins, classes, blocks):
                hit[partners] = True
                hit[k] |= len(partners) > 0
            if hit.any():
                n = int(hit.sum())
                yield pa.record_batch({
                    "cell": pa.array(np.full(n, cell), pa.int64()), "bucket": pa.array(bucket[hit], pa.int64()), "block": pa.array(blocks[hit], pa.int64()), "node": pa.array(nodes[hit].tolist(), pa.binary()),
                    "bins": pa.array([x.tobytes() for x in bins[hit]], pa.binary()), "keys": pa.array(list(keys[hit]), pa.list_(pa.int64())), "class": pa.array(classes[hit].tolist(), pa.binary()),
                })

    return dealt(cells, "bucket", "block", "bins", "keys", "class").mapInArrow(run, ", ".join(f"{k} {v}" for k, v in MEMBER.items()))


def tiles(words: np.ndarray) -> list[range]:
    """The texts of a cell, given by their numbers of words, in runs of about TILE_WORDS words."""
    run = np.cumsum(words) // TILE_WORDS
    edges = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(words)]
    return [range(lo, hi) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def cell_links(nodes: np.ndarray, bucket: int, blocks: np.ndarray, bins: np.ndarray, keys: np.ndarray, classes: np.ndarray, zipped: np.ndarray) -> list[list[bytes]]:
    """The classes of a cell that links join, in pairs.

    All partners of a text are measured against it in one numpy step: a link needs so many words in common, and
    the slots of a bag (its words' hashes, cut to SLOT_BITS) count at least those. Few pairs pass, and only these
    are aligned.
    """
    unzip = zstandard.ZstdDecompressor()
    texts: dict[int, Words] = {}

    def read(k: int) -> Words:
        if k not in texts:
            if len(texts) >= HELD:
                texts.pop(next(iter(texts)))
            texts[k] = Words(unzip.decompress(zipped[k]))
        return texts[k]

    def slots(k: int) -> np.ndarray:
        return bag_slots(unzip.decompress(zipped[k]))

    number: dict[bytes, int] = {}
    own = np.array([number.setdefault(c, len(number)) for c in classes.tolist()])
    links, mark = [], np.zeros(1 << SLOT_BITS, np.uint8)
    runs = tiles(bins["size"].astype(np.int64) + WORDS - 1)
    for i, rows in enumerate(runs):
        ours = {k: slots(k) for k in rows}
        for among in runs[i:]:
            theirs = ours if among is rows else {k: slots(k) for k in among}
            for k, partners in unsettled(keys, bucket, bins, classes, blocks, rows, among):
                partners = partners[own[partners] != own[k]]
                if not len(partners):
                    continue
                bags = [theirs[j] for j in partners.tolist()]
                sizes = np.array([len(x) for x in bags])
                mark[ours[k]] = 1
                common = np.add.reduceat(mark[np.concatenate(bags)], np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64)
                mark[ours[k]] = 0
                for j in partners[common >= words_needed(len(ours[k]), sizes)].tolist():
                    if own[j] != own[k]:
                        b = read(j)
                        if read(k).like(b):
                            links.append(sorted((classes[k].tobytes(), classes[j].tobytes())))
                            own[own == own[j]] = own[k]
    return links


def settle(cells: DataFrame) -> DataFrame:
    """a, b: classes of a cell that links join, from MEMBER and zipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (nodes, bucket, *columns) in grouped(batches, ("node", "bucket", "block", "bins", "keys", "class", "zipped")):
            links = cell_links(nodes, bucket[0], *columns)
            if links:
                a, b = zip(*links, strict=True)
                yield pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return dealt(cells, "bucket", "block", "bins", "keys", "class", "zipped").mapInArrow(run, "a binary, b binary")


def dealt(cells: DataFrame, *columns: str) -> DataFrame:
    """Cells whole in a partition, in order."""
    return cells.repartition("cell").sortWithinPartitions("cell", "node").select("cell", "node", *columns)


def stars_of(cells: DataFrame) -> DataFrame:
    """The texts of cells with their centre, and the estimate of both, from (cell, bucket, node, bins)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (nodes, bucket, bins) in grouped(batches, ("node", "bucket", "bins")):
            found = [*star(bins)] if len(nodes) > 1 else []
            if found:
                text, partner, same = zip(*found, strict=True)
                yield pa.record_batch({
                    "bucket": pa.array([bucket[0]] * len(found), pa.int64()), "node": pa.array(nodes[list(text)].tolist(), pa.binary()), "partner": pa.array(nodes[list(partner)].tolist(), pa.binary()), "same": pa.array(same, pa.float64()),
                })

    return dealt(cells, "bucket", "bins").mapInArrow(run, "bucket long, node binary, partner binary, same double")


def in_order(pairs: DataFrame) -> DataFrame:
    """a < b, same of each pair."""
    return pairs.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b"), "same")


def sized(members: DataFrame) -> DataFrame:
    """bucket, node, members of buckets with several members; counted before the join, which may split a hot bucket."""
    counts = members.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    return members.join(counts, "bucket").select("bucket", "node", "members")


def split(hash_of: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(hash_of), parts)


def in_blocks(buckets: DataFrame) -> DataFrame:
    """The blocks of buckets as cells, for stars."""
    blocks = F.ceil(F.col("members") / BLOCK)
    cell = F.when(blocks == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", split("node", blocks)))
    return buckets.select(cell.alias("cell"), "bucket", "node")


def in_pairs_of_blocks(named: DataFrame) -> DataFrame:
    """cell, bucket, block, node, class of buckets with several classes, from (bucket, node, class).

    In a large bucket, the blocks of its largest class meet those of the rest, which meet each other too.
    """
    sizes = named.groupBy("bucket", "class").agg(F.count("*").alias("size"))
    about = sizes.groupBy("bucket").agg(F.count("*").alias("kinds"), F.max_by("class", F.struct("size", "class")).alias("main"), F.max("size").alias("n_main"), F.sum("size").alias("n")).where("kinds > 1")
    few, is_main = F.col("n") <= BLOCK, F.col("class") == F.col("main")
    main_blocks, rest_blocks = F.ceil(F.col("n_main") / BLOCK), F.ceil((F.col("n") - F.col("n_main")) / BLOCK)
    block = F.when(few, 0).when(is_main, rest_blocks + split("node", main_blocks)).otherwise(split("node", rest_blocks))
    met = F.when(few, 1).when(is_main, rest_blocks).otherwise(rest_blocks + main_blocks)
    placed = named.join(about, "bucket").select("bucket", "node", "class", few.alias("few"), block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), met - 1)).alias("other"))
    cell = F.when(F.col("few"), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")))
    return placed.select(cell.alias("cell"), "bucket", "block", "node", "class")


def longest_rise(values: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        at = bisect.bisect_left(tails, v)
        before[k] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(v)
            ends.append(k)
        else:
            tails[at], ends[at] = v, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def common_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence: a bit for each place of `a`, a step for each of `b`."""
    places: dict[int, int] = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    whole = (1 << len(a)) - 1
    row = whole
    for w in b:
        hit = row & places.get(w, 0)
        if hit:
            row = (row + hit | row - hit) & whole
    return len(a) - row.bit_count()


class Words:
    """The words of a text, as hashes, and its k-mers."""

    def __init__(self, text: bytes):
        raw = np.frombuffer(text, np.uint8)
        self.words = word_hashes(raw, np.array([0, len(raw)]))[0]
        self.kmers = labelled_kmers(self.words)
        self.ordered = np.sort(self.kmers)
        self.bag = np.sort(labelled(self.words)) if len(self.words) else self.words

    def like(self, other: Words) -> bool:
        """Whether the two are linked. No alignment matches more words than both hold, which settles most pairs that aren't."""
        if not len(self.words) or not len(other.words):
            return False
        both = in_common(self.ordered, other.ordered)
        if both < LEAST * (len(self.kmers) + len(other.kmers) - both) - 1e-9:
            return False
        needed = words_needed(len(self.words), len(other.words))
        return in_common(self.bag, other.bag) >= needed and alignment(self, other) >= THRESHOLD


def words_needed(n_a: int, n_b: int | np.ndarray) -> float | np.ndarray:
    """How many words two texts of so many words match at the threshold."""
    return THRESHOLD * (n_a + n_b) / (1 + THRESHOLD) - 1e-9


def bag_slots(text: bytes) -> np.ndarray:
    """A slot for each word of a text, repeated ones by their occurrence."""
    raw = np.frombuffer(text, np.uint8)
    words = word_hashes(raw, np.array([0, len(raw)]))[0]
    return (splitmix(labelled(words)) >> np.uint64(64 - SLOT_BITS)).astype(np.uint32) if len(words) else words.astype(np.uint32)


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays without repeats both hold."""
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()) if len(a) else 0


def chain(a: Words, b: Words, band: int) -> Iterator[tuple[int, int, int]]:
    """Runs of words (place in a, place in b, length) that a chain of common k-mers inside the band matches, in order."""
    _, at, to = np.intersect1d(a.kmers, b.kmers, assume_unique=True, return_indices=True)
    order = np.argsort(at)
    at, to = at[order], to[order]
    near = np.abs(at - to) <= band
    at, to = at[near], to[near]
    if not (np.diff(to) > 0).all():
        rise = longest_rise(to.tolist())
        at, to = at[rise], to[rise]
    if not len(at):
        return
    size = min(WORDS, len(a.words), len(b.words))
    # k-mers of one diagonal that touch are one run
    new = np.r_[True, (np.diff(at) != np.diff(to)) | (np.diff(at) > size)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(at) - 1]
    end_a = end_b = 0
    for i, j, n in zip(at[first].tolist(), to[first].tolist(), (at[last] - at[first] + size).tolist(), strict=True):
        over = max(0, end_a - i, end_b - j)  # words that the run before has used
        if over < n:
            yield i + over, j + over, n - over
            end_a, end_b = i + n, j + n


def alignment(a: Words, b: Words, threshold: float = THRESHOLD) -> float:
    """Similarity m / (n_a + n_b - m) of an alignment of words inside the band; 0 where it can't reach the threshold."""
    x, y = a.words.tolist(), b.words.tolist()
    total = len(x) + len(y)
    band = int(total * (1 - threshold) / (1 + threshold)) + 1
    gaps, matched, end_a, end_b = [], 0, 0, 0
    for i, j, n in [*chain(a, b, band), (len(x), len(y), 0)]:
        if i > end_a and j > end_b:
            gaps.append((x[end_a:i], y[end_b:j]))
        matched, end_a, end_b = matched + n, i + n, j + n
    needed = threshold * total / (1 + threshold) - 1e-9
    possible = matched + sum(min(len(p), len(q)) for p, q in gaps)
    for p, q in gaps:
        if possible < needed:
            return 0.0
        found = common_length(p, q)
        possible -= min(len(p), len(q)) - found
        matched += found
    return matched / (total - matched) if total > matched else 1.0


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b and whether their alignment reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        seen: dict[bytes, Words] = {}  # a star's centre comes again and again
        for batch in batches:
            linked = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                for key, data in ((a, ta), (b, tb)):
                    if key not in seen:
                        if len(seen) >= 64:
                            seen.pop(next(k for k in seen if k not in (a, b)))
                        seen[key] = Words(unzip.decompress(data))
                linked.append(seen[a].like(seen[b]))
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(linked, pa.bool_())})

    first = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("zipped").alias("ta")), "a")
    return first.join(texts.select(F.col("node").alias("b"), F.col("zipped").alias("tb")), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """node and class (the smallest node of its component) of all nodes with a link.

    In each round a node takes the smallest class that it or a neighbour has, and then its whole former class
    follows the smallest one that a member took, two steps on.
    """
    links = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))), "links")
    labels = links.groupBy("u").agg(F.min("v").alias("near")).select(F.col("u").alias("node"), F.least("u", "near").alias("class"))
    labels = materialise(labels, "labels")
    while True:
        near = links.join(labels.select(F.col("node").alias("v"), "class"), "v").groupBy("u").agg(F.min("class").alias("near"))
        step = labels.join(near, labels.node == near.u).select("node", F.col("class").alias("was"), F.least("class", "near").alias("class"))
        step = materialise(step, "labels")
        discard(labels)
        if step.where(F.col("class") != F.col("was")).isEmpty():
            discard(links)
            return step.select("node", "class")
        moves = materialise(step.groupBy("was").agg(F.min("class").alias("to")), "moves")
        onward = moves.select(F.col("was").alias("to"), F.col("to").alias("further"))
        labels = step.join(moves, "was").join(onward, "to", "left").select("node", F.coalesce("further", "to").alias("class"))
        labels = materialise(labels, "labels")
        discard(step, moves)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of what has been written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def zipped_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The compressed text of each node, taken from the row that stands for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.record_batch({"node": part.column("node"), "zipped": pa.array([pack.compress(t.encode()) for t in part.column("text").to_pylist()], pa.binary())})

    rows = docs.select(id_key(F.col("doc_id")).alias("id_key"), F.xxhash64(F.col("text").cast("string")).alias("text64"), F.col("text").cast("string").alias("text"))
    found = rows.join(nodes, ["id_key", "text64"]).dropDuplicates(["id_key", "text64"])
    return found.select("node", "text").mapInArrow(run, "node binary, zipped binary")


def id_key(doc_id: Column) -> Column:
    """An id that joins nulls too."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text64, class_id, class_text64 (of the row that stands for the class) and class_size of each row."""
    spark = docs.sparkSession
    rows = materialise(sketch(docs), "sketches")
    standing = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text64"))  # an id before none
    # one row for each word sequence: partial aggregation keeps hot copies from meeting in a task
    nodes = materialise(rows.where(F.col("keys").isNotNull()).groupBy("node").agg(standing.alias("row"), F.first("keys").alias("keys"), F.first("bins").alias("bins")), "nodes")
    buckets = materialise(sized(nodes.select("node", F.explode("keys").alias("bucket"))), "buckets")
    release(spark)
    bins = nodes.select("node", "bins")

    def stars(buckets: DataFrame) -> DataFrame:
        return stars_of(in_blocks(buckets).join(bins, "node"))

    candidates = in_order(stars(buckets.where(F.col("members") <= BLOCK)))
    rounds, level = [], buckets.where(F.col("members") > BLOCK)
    while not level.isEmpty():
        rounds.append(materialise(stars(level), "stars"))
        candidates = candidates.unionByName(in_order(rounds[-1]))
        level = materialise(sized(rounds[-1].select("bucket", F.col("partner").alias("node")).distinct()), "centres")
    # of each text the centre it resembles most; a centre may be either end of its pairs
    found = materialise(candidates.groupBy("a", "b").agg(F.max("same").alias("same")), "pairs")
    ends = found.select(F.col("a").alias("end"), "a", "b", "same").unionByName(found.select(F.col("b").alias("end"), "a", "b", "same"))
    pairs = ends.groupBy("end").agg(F.max_by(F.struct("a", "b"), F.struct("same", "a", "b")).alias("p")).select("p.a", "p.b")
    for joints in rounds[1:]:  # centres with centres
        pairs = pairs.unionByName(in_order(joints).select("a", "b"))
    spent = [found, *rounds]
    pairs = materialise(pairs.distinct(), "pairs")
    wanted = buckets.select("node").distinct().join(nodes.select("node", "row"), "node").select("node", id_key(F.col("row.doc_id")).alias("id_key"), F.col("row.text64").alias("text64"))
    texts = materialise(zipped_texts(docs, wanted), "texts")
    release(spark)
    tested = materialise(verify(pairs, texts), "verified")
    spent += [pairs, tested]
    labels = components(tested.where("linked").select("a", "b"))

    # members of buckets with several classes
    mixed = in_pairs_of_blocks(buckets.join(labels, "node", "left").select("bucket", "node", F.coalesce("class", "node").alias("class")))
    unmet = materialise(remaining(mixed.join(nodes.select("node", "bins", "keys"), "node")), "open")
    release(spark)
    named = rows.select("doc_id", "text64", "node").join(labels, "node", "left").select("doc_id", "text64", F.coalesce("class", "node").alias("class"))
    if not unmet.isEmpty():
        joined = materialise(settle(unmet.join(texts, "node")), "settled")
        spent.append(joined)
        if not joined.isEmpty():
            moved = components(joined).select(F.col("node").alias("class"), F.col("class").alias("to"))
            named = named.join(moved, "class", "left").select("doc_id", "text64", F.coalesce("to", "class").alias("class"))
    release(spark)
    named = materialise(named, "named")
    discard(rows, nodes, buckets, texts, unmet, *spent)  # all that the result reads is in `named`
    sizes = named.where(F.col("class").isNotNull()).groupBy("class").agg(standing.alias("row"), F.count("*").alias("class_size"))
    # a class of many rows is a hot key on one side only, which Spark's skew join splits
    with_text = named.where(F.col("class").isNotNull()).join(sizes, "class").select("doc_id", "text64", F.col("row.doc_id").alias("class_id"), F.col("row.text64").alias("class_text64"), "class_size")
    without = named.where(F.col("class").isNull()).select("doc_id", "text64", F.col("doc_id").alias("class_id"), F.col("text64").alias("class_text64"), F.lit(1).cast("long").alias("class_size"))
    return with_text.unionByName(without)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns; all rows whose text is null."""
    kept = classes(docs).select(id_key(F.col("class_id")).alias("tw_id"), F.col("class_text64").alias("tw_text")).distinct()
    rows = docs.withColumn("tw_id", id_key(F.col("doc_id"))).withColumn("tw_text", F.xxhash64(F.col("text").cast("string")))
    found = rows.where(F.col("text").isNotNull()).join(kept, ["tw_id", "tw_text"], "left_semi").dropDuplicates(["tw_id", "tw_text"])
    return found.unionByName(rows.where(F.col("text").isNull())).select(*docs.columns)


def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
