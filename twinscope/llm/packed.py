"""Token ids in fixed-width bit packing.

A shard file holds blocks of BLOCK_IDS ids, each id in the fewest bits that hold the largest id of the
vocabulary (least significant bit first), then a footer with the document ids, where each document
starts, and the byte offset of each block. Block offsets give random access; numpy unpacks a block at
once. Shards are written in ascending doc_id order, one for each range partition, straight from the
task to the shared folder; a small manifest tells their order. A task that runs again writes a file of
another name, and the manifest names the one whose task succeeded.

File: MAGIC, blocks, doc_ids (int64), valid (uint8, 0: the id is null), starts (uint64, one more than
documents), block offsets (uint64), then TRAILER.

Defined results: null and empty texts have the end id only; rows of equal doc_id stay rows of their
own, next to each other, in the order of their texts' hashes; rows of null id come first.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinscope.llm.common import byte_chunks, discard, materialise, open_fs, shuffle_partitions, table, work_dir
from twinscope.llm.splitting import Memo, encode_column

TOKENIZER_FILE = "byte_bpe_50k.json"
END_ID = 0
#: Bytes of text that are encoded at once, and spans that one worker's memo holds.
PASS_BYTES, MEMO_SPANS = 2 << 20, 500_000
#: A splitting at the public pattern without a blank put before the text.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
BLOCK_IDS = 1 << 16
MAGIC = b"TWPACK1\n"
#: bits, documents, ids, blocks, where the footer starts, MAGIC again.
TRAILER = struct.Struct("<IQQQQ8s")


def byte_names() -> dict[int, str]:
    """How byte-level vocabularies write each byte: itself if it prints, else the next unused from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_NAMES = byte_names()


def width(vocabulary_size: int) -> int:
    """The bits that hold every id of a vocabulary."""
    return max(1, (max(1, vocabulary_size) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    planes = np.zeros((count, 32), np.uint8)
    planes[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return np.packbits(planes, axis=1, bitorder="little").reshape(-1).view("<u4")


class ShardWriter:
    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.at = stream.write(MAGIC) and len(MAGIC)
        self.doc_ids: list[int | None] = []
        self.starts, self.offsets = [0], []
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        whole = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for lo in range(0, whole, BLOCK_IDS):
            data = pack(ids[lo : min(lo + BLOCK_IDS, whole)], self.bits)
            self.offsets.append(self.at)
            self.stream.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[whole:].copy()], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        valid = np.array([x is not None for x in self.doc_ids], np.uint8)
        for part in (np.array([x or 0 for x in self.doc_ids], "<i8"), valid, np.array(self.starts, "<u8"), np.array(self.offsets, "<u8")):
            self.stream.write(part.tobytes())
        self.stream.write(TRAILER.pack(self.bits, len(self.doc_ids), self.starts[-1], len(self.offsets), self.at, MAGIC))


class Shard:
    """Random access to the ids of one file."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.bits, self.n_docs, self.n_ids, n_blocks, foot, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        data = self.file.read_at(size - TRAILER.size - foot, foot)
        at = 8 * self.n_docs
        self.doc_ids, valid = np.frombuffer(data, "<i8", self.n_docs), np.frombuffer(data, np.uint8, self.n_docs, at)
        self.valid = valid.astype(bool)
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at + self.n_docs).astype(np.int64)
        self.ends = np.r_[np.frombuffer(data, "<u8", n_blocks, at + self.n_docs + 8 * (self.n_docs + 1)).astype(np.int64), foot]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from `start` up to `stop`; only the blocks that hold them are read."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // BLOCK_IDS, (stop - 1) // BLOCK_IDS
        data = self.file.read_at(int(self.ends[last + 1] - self.ends[first]), int(self.ends[first]))
        cut = self.ends[first : last + 2] - self.ends[first]
        parts = [unpack(data[cut[k] : cut[k + 1]], self.bits, min(BLOCK_IDS, self.n_ids - (first + k) * BLOCK_IDS)) for k in range(last + 1 - first)]
        return np.concatenate(parts)[start - first * BLOCK_IDS : stop - first * BLOCK_IDS]

    def document(self, row: int) -> np.ndarray:
        return self.ids(int(self.starts[row]), int(self.starts[row + 1]))

    def close(self) -> None:
        self.file.close()


class Encoder:
    """The tokenizers library behind a bounded memo of spans (see splitting).

    Where the file's splitting and merging are the plain byte-level ones, the library is asked for the spans
    that the memo lacks: its model for letters alone, which are one piece, itself for others. A text that
    holds one of the file's added strings goes to the library whole, and so does any text for other files.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.bits = width(self.library.get_vocab_size(with_added_tokens=True))
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        kind = json.loads(self.library.to_str())
        self.split = kind["normalizer"] is None and kind["pre_tokenizer"] == BYTE_LEVEL and kind["model"]["type"] == "BPE"
        self.memo = Memo(self.encode_spans, MEMO_SPANS)

    def whole(self, text: bytes) -> bytes:
        return array("I", self.library.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def encode_spans(self, spans: list[bytes]) -> list[bytes]:
        tokenize, out = self.model.tokenize, []
        for span in spans:
            text = span.decode()
            if (text[1:] if text[0] == " " else text).isalpha():
                out.append(array("I", [t.id for t in tokenize(span.decode("latin-1").translate(BYTE_NAMES))]).tobytes())
            else:
                out.append(self.whole(span))
        return out

    def rows(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of rows: (first row, end row, their ids, where each row's begin). Nulls count as empty."""
        for lo, hi, raw, offs in byte_chunks(column, PASS_BYTES):
            data = raw.tobytes()
            if self.split and not any(s in data for s in self.special):
                for _, _, ids, cut in encode_column(column.slice(lo, hi - lo), self.memo, PASS_BYTES):
                    yield lo, hi, ids, cut
            else:
                for k in range(hi - lo):
                    text = data[offs[k] : offs[k + 1]]
                    if self.split and not any(s in text for s in self.special):
                        for _, _, ids, cut in encode_column(column.slice(lo + k, 1), self.memo, PASS_BYTES):
                            yield lo + k, lo + k + 1, ids, cut
                    else:
                        ids = np.frombuffer(self.whole(text), "<u4")
                        yield lo + k, lo + k + 1, ids, np.array([0, len(ids)])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


MANIFEST = "part int, path string, n_docs long, n_ids long"


def write_shards(docs: DataFrame, text: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encodes, sorts by doc_id and writes shards; returns the manifest with `start`, the ids before each shard."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path(TOKENIZER_FILE)
    folder = work_dir(spark, "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, uri = TaskContext.get().partitionId(), f"{folder}/ids-{uuid.uuid4().hex}.twpack"
        writer = stream = None
        end = np.array([end_id], "<u4")
        for batch in batches:
            enc = encoder(path)
            if writer is None:
                fs, local = open_fs(uri)
                stream = fs.open_output_stream(local)
                writer = ShardWriter(stream, enc.bits)
            doc_ids = batch.column("doc_id").to_pylist()
            for lo, hi, ids, cut in enc.rows(batch.column("t")):
                for k in range(lo, hi):
                    writer.add(doc_ids[k], np.r_[ids[cut[k - lo] : cut[k - lo + 1]], end])
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([uri]), pa.array([len(writer.doc_ids)], pa.int64()), pa.array([writer.starts[-1]], pa.int64())], names=["part", "path", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(shuffle_partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    manifest = materialise(rows.mapInArrow(run, MANIFEST), "manifest")
    shards = sorted(manifest.collect())  # a row for each shard
    discard(manifest)
    start, said = 0, []
    for s in shards:
        said.append((s.part, s.path, s.n_docs, s.n_ids, start))
        start += s.n_ids
    return spark.createDataFrame(said, MANIFEST + ", start long")


RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_shards(manifest: DataFrame) -> DataFrame:
    """A row for each document of the shards: where its ids start, their count and crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard, lo = Shard(uri), 0
                while lo < shard.n_docs:
                    hi = max(lo + 1, int(np.searchsorted(shard.starts, shard.starts[lo] + 16 * BLOCK_IDS, side="right")) - 1)
                    ids = memoryview(shard.ids(int(shard.starts[lo]), int(shard.starts[hi])).tobytes())
                    cut = shard.starts[lo : hi + 1] - shard.starts[lo]
                    crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    yield pa.record_batch(
                        [pa.array(shard.doc_ids[lo:hi], pa.int64(), mask=~shard.valid[lo:hi]), pa.array(shard.starts[lo:hi] + base, pa.int64()), pa.array(np.diff(cut), pa.int64()), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    lo = hi
                shard.close()

    spread = manifest.select("path", "start").repartition(shuffle_partitions(manifest.sparkSession))
    return spread.mapInArrow(run, RESULT)


def op9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents")))
