"""Media columns: ISO base media containers, walked without decoding payloads.

`pack_media` wraps a byte payload as an uncompressed grey-scale video track: each media sample is a
16 x 12 picture of 8-bit samples (192 bytes), so the payload is kept as it is. A picture is a keyframe
(sync table, stss) if it is one of every KEYFRAME_EVERY, or its mean is SCENE away from that of the one
before. The media column is written to the shared folder and read again. `probe` walks the nested boxes of
any ISO media file, decodes the sample tables (stts, stsc, stsz, stco/co64, stss) and returns codec,
duration and the byte ranges of keyframes, which `probe_media` stores as columns; it never reads the
sample bytes.

Defined results: a null text is an empty one; an empty payload becomes one padded picture; equal texts
give equal containers; rows may repeat; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscope.llm.common import byte_chunks, materialise, table

WIDTH, HEIGHT = 16, 12
SAMPLE_BYTES = WIDTH * HEIGHT
#: Pictures a second of the track, which is also its time scale.
TIMESCALE = 25
SAMPLES_PER_CHUNK = 64
KEYFRAME_EVERY, SCENE = 12, 6.0
#: Bytes of text that are packed at once.
PASS_BYTES = 1 << 20
#: Boxes that only hold boxes, with the bytes of their own before the first of those.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"udta": 0, b"mvex": 0, b"meta": 4}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 > 0xFFFFFFFF:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def pad(data: bytes) -> bytes:
    """`data` with blanks up to a positive multiple of SAMPLE_BYTES."""
    n = max(1, -(-len(data) // SAMPLE_BYTES)) * SAMPLE_BYTES
    return data.ljust(n, b" ")


def keyframes_of(payload: bytes) -> list[int]:
    """1-based numbers of the pictures that are keyframes."""
    mean = np.frombuffer(payload, np.uint8).reshape(-1, SAMPLE_BYTES).mean(1)
    key = np.arange(len(mean)) % KEYFRAME_EVERY == 0
    key[1:] |= np.abs(np.diff(mean)) >= SCENE
    return (np.flatnonzero(key) + 1).tolist()


FTYP = box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  isom")
HDLR = full(b"hdlr", 0, b"\0\0\0\0vide", bytes(12), b"raw\0")
MINF_HEAD = full(b"vmhd", 1, bytes(8)) + box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), full(b"url ", 1)))
STSD = full(
    b"stsd", 0, struct.pack(">I", 1),
    box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1)),
)


def movie(payload: bytes, sync: list[int] | None = None) -> bytes:
    """A container of `payload`, a positive multiple of SAMPLE_BYTES; `sync`: 1-based keyframes, all if None."""
    n, rest = divmod(len(payload), SAMPLE_BYTES)
    if rest or not n:
        raise ValueError(f"the payload must be a positive multiple of {SAMPLE_BYTES} bytes")
    chunks, last = divmod(n, SAMPLES_PER_CHUNK)
    runs = [(1, SAMPLES_PER_CHUNK)] * bool(chunks) + [(chunks + 1, last)] * bool(last)
    count = chunks + bool(last)
    wide = len(payload) > 0xF0000000
    offsets, step = np.arange(count, dtype=">u8" if wide else ">u4"), SAMPLE_BYTES * SAMPLES_PER_CHUNK
    stss = b"" if sync is None else full(b"stss", 0, struct.pack(f">I{len(sync)}I", len(sync), *sync))
    tables = [
        STSD, full(b"stts", 0, struct.pack(">III", 1, n, 1)), stss, full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
        full(b"stsz", 0, struct.pack(">II", SAMPLE_BYTES, n)),
    ]

    def moov(start: int) -> bytes:
        at = (offsets * step + start).astype(offsets.dtype).tobytes()
        stbl = box(b"stbl", *tables, full(b"co64" if wide else b"stco", 0, struct.pack(">I", count), at))
        mdia = box(b"mdia", full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), HDLR, box(b"minf", MINF_HEAD, stbl))
        tkhd = full(b"tkhd", 7, struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16))
        mvhd = full(b"mvhd", 0, struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = len(FTYP) + len(moov(0)) + (16 if len(payload) + 8 > 0xFFFFFFFF else 8)
    return b"".join((FTYP, moov(head), box(b"mdat", payload)))


@dataclass
class Track:
    """What the sample tables of one track say."""

    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sync: np.ndarray | None = None

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def keyframes(self) -> np.ndarray:
        """(offset, length) of each keyframe; touching ones are one range."""
        at = np.arange(len(self.sizes)) if self.sync is None else self.sync[(self.sync >= 0) & (self.sync < len(self.sizes))]
        off, size = self.offsets[at], self.sizes[at]
        if not len(off):
            return np.zeros((0, 2), np.int64)
        first = np.flatnonzero(np.r_[True, off[1:] != off[:-1] + size[:-1]])
        return np.stack([off[first], np.add.reduceat(size, first)], axis=1)


def walk(data: bytes) -> Iterator[tuple[int, bytes, int, int]]:
    """Each box, parents first: (depth, kind, body start, end). A box that leaves its parent ends the walk there; nesting is kept on a stack."""
    open_boxes = [(0, len(data))]
    while open_boxes:
        lo, hi = open_boxes.pop()
        if lo + 8 > hi:
            continue
        size, kind = struct.unpack_from(">I4s", data, lo)
        body = lo + 8
        if size == 1:
            if lo + 16 > hi:
                continue
            size, body = struct.unpack_from(">Q", data, lo + 8)[0], lo + 16
        end = hi if size == 0 else lo + size
        if end < body or end > hi:
            continue
        yield len(open_boxes), kind, body, end
        open_boxes.append((end, hi))
        if kind in CONTAINERS:
            open_boxes.append((body + CONTAINERS[kind], end))


def ints(data: bytes, at: int, end: int, columns: int, kind: str = ">u4") -> np.ndarray:
    """The rows of a table box whose count stands at `at`; a count beyond the box is cut to it."""
    width = columns * np.dtype(kind).itemsize
    n = min(struct.unpack_from(">I", data, at)[0], max(0, end - at - 4) // width)
    return np.frombuffer(data, kind, n * columns, at + 4).astype(np.int64).reshape(n, columns)


def probe(data: bytes) -> list[Track]:
    """The tracks of a container; bytes that hold no box give none."""
    tracks: list[Track] = []
    raw: dict[bytes, np.ndarray] = {}
    fixed = (0, 0)

    def close() -> None:
        if not tracks:
            return
        t = tracks[-1]
        sizes = np.full(fixed[1], fixed[0], np.int64) if fixed[0] else raw.get(b"stsz", np.zeros((0, 1), np.int64))[:, 0]
        chunks, runs = raw.get(b"stco", np.zeros((0, 1), np.int64))[:, 0], raw.get(b"stsc", np.zeros((0, 3), np.int64))
        if len(chunks) and len(runs):
            run = np.searchsorted(runs[:, 0], np.arange(1, len(chunks) + 1), side="right") - 1
            per = np.where(run >= 0, runs[np.maximum(run, 0), 1], 0)
            n = min(len(sizes), int(per.sum()))
            sizes, chunk = sizes[:n], np.repeat(np.arange(len(chunks)), per)[:n]
            before = np.cumsum(sizes) - sizes
            first = np.searchsorted(chunk, chunk, side="left")
            t.offsets, t.sizes = chunks[chunk] + before - before[first], sizes
        if b"stts" in raw and not t.duration:
            t.duration = int((raw[b"stts"][:, 0] * raw[b"stts"][:, 1]).sum())
        t.sync = raw[b"stss"][:, 0] - 1 if b"stss" in raw else None

    for _, kind, body, end in walk(data):
        room = end - body
        if kind == b"trak":
            close()
            tracks.append(Track())
            raw, fixed = {}, (0, 0)
        elif not tracks:
            continue
        elif kind == b"mdhd" and room >= 24:
            long = data[body] == 1
            tracks[-1].timescale, tracks[-1].duration = struct.unpack_from(">IQ" if long else ">II", data, body + (20 if long else 12))
        elif kind == b"hdlr" and room >= 12:
            tracks[-1].handler = data[body + 8 : body + 12].decode("latin-1")
        elif kind == b"stsd" and room >= 16:
            tracks[-1].codec = data[body + 12 : body + 16].decode("latin-1")
        elif kind == b"stsz" and room >= 12:
            fixed = struct.unpack_from(">II", data, body + 4)
            if not fixed[0]:
                raw[b"stsz"] = ints(data, body + 8, end, 1)
        elif kind in (b"stts", b"stsc", b"stco", b"co64", b"stss") and room >= 8:
            columns = {b"stts": 2, b"stsc": 3}.get(kind, 1)
            raw[b"stco" if kind == b"co64" else kind] = ints(data, body + 4, end, columns, ">u8" if kind == b"co64" else ">u4")
    close()
    return tracks


def feature(tracks: list[Track]) -> str:
    """A line on each track: codec, seconds, samples, keyframe ranges (count, first, last, crc32 of all)."""
    said = []
    for t in tracks:
        keys = t.keyframes()
        ends = f"{keys[0, 0]}+{keys[0, 1]}..{keys[-1, 0]}+{keys[-1, 1]}" if len(keys) else "none"
        said.append(f"{t.handler}:{t.codec.strip()} {t.seconds:.3f}s samples={len(t.sizes)} keyframe_ranges={len(keys)} {ends} crc={zlib.crc32(keys.astype('<i8').tobytes()):08x}")
    return "; ".join(said)


def stored_payload(data: bytes, tracks: list[Track]) -> bytes:
    """The sample bytes of the first track, in order, read from where its tables point."""
    if not tracks:
        return b""
    t = tracks[0]
    if not len(t.sizes):
        return b""
    first = np.flatnonzero(np.r_[True, t.offsets[1:] != t.offsets[:-1] + t.sizes[:-1]])
    return b"".join(data[o : o + s] for o, s in zip(t.offsets[first].tolist(), np.add.reduceat(t.sizes, first).tolist(), strict=True))


PACKED = "doc_id long, n_bytes long, media binary"
PROBED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "codec string, duration double, keyframes array<struct<at: long, size: long>>"
)
RANGES = pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64())]))
PROBED_KINDS = {
    "doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(),
    "codec": pa.string(), "duration": pa.float64(), "keyframes": RANGES,
}


def pack_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and the media column of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offs in byte_chunks(batch.column("t"), PASS_BYTES):
                payloads = [pad(raw[a:b].tobytes()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "n_bytes": pa.array(np.diff(offs), pa.int64()), "media": pa.array([movie(x, keyframes_of(x)) for x in payloads], pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, PACKED)


def probed(doc_id: int | None, n_bytes: int, media: bytes) -> tuple:
    tracks = probe(media)
    payload = stored_payload(media, tracks)
    first = tracks[0] if tracks else Track()
    ranges = [{"at": a, "size": n} for a, n in first.keyframes().tolist()]
    return (
        doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(tracks),
        first.codec.strip(), first.seconds, ranges,
    )


def probe_media(packed: DataFrame) -> DataFrame:
    """Digests of a media column, and codec, duration and keyframe ranges of the first track, from the stored bytes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offs in byte_chunks(batch.column("media"), PASS_BYTES):
                ids, sizes = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("doc_id", "n_bytes"))
                rows = [probed(i, n, raw[a:b].tobytes()) for i, n, a, b in zip(ids, sizes, offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), PROBED_KINDS.values(), strict=True)], names=[*PROBED_KINDS])

    return packed.mapInArrow(run, PROBED)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe_media(materialise(pack_media(table(spark, sf_dir, "documents")), "media"))
