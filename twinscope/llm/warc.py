"""WARC archives with a two-level capture index.

`write_archives`: each task writes the records of its pages, gzipped one by one, to a file in the shared
folder. Equal payloads of at least SMALLEST_SHARED bytes are stored once, by the smallest page_id; the
other pages become revisit records that refer to it.
`write_index`: the captures, keyed by reversed host and path (com,example,blog)/a/b) and then page_id, are
sorted over the cluster; each range partition writes a shard of gzipped blocks of BLOCK_LINES lines, with a
sparse directory of the blocks' first keys at its end. The index is a table of one row a shard.
`CaptureIndex`: binary search among the shards' first keys, in the directory of one shard, and in the lines
of one block, then a range read of the record. `read_captures` does that for a table of keys, dealt out in
the order of the index, so that a task reads a directory and a block once.

A task that runs again writes a file of another name; the index names those whose tasks succeeded.

Defined results: a null html is an empty payload; a null url has an empty key and target; rows that
repeat a page_id are records of their own, and those with the smallest page_id of a payload are all
responses; a null page_id sorts after every number, so it never stands for others while they have one.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscope.llm.common import discard, materialise, open_fs, shuffle_partitions, table, work_dir

SMALLEST_SHARED = 100
BLOCK_LINES = 1000
DATE = "2024-01-01T00:00:00Z"
MOST_BROADCAST = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URL = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):/*(?:[^/?#@]*@)?(\[[^\]/]*\]|[^/?#:]*)(?::(\d*))?([^#]*)", re.S)


def surt(url: str | None) -> str:
    """The sort key of a url: host reversed and in lower case, then path and query; no scheme, port 80/443 or fragment."""
    if not url:
        return ""
    m = URL.match(url)
    if not m:
        return re.sub(r"\s", "%20", url)
    _, host, port, rest = m.groups()
    host = host.lower().rstrip(".")
    host = host if host.startswith("[") else ",".join(reversed(host.split(".")))
    port = f":{port}" if port and port not in ("80", "443") else ""
    return re.sub(r"\s", "%20", f"{host}{port}){rest or '/'}")


def one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", "%0A", value)


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One gzipped WARC record; a revisit holds the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line(url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


def headers(data: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in data.decode("utf-8").split("\r\n")[1:])}


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and HTTP body of one gzipped record."""
    raw = zlib.decompress(data, 31)
    cut = raw.index(b"\r\n\r\n")
    warc = headers(raw[:cut])
    block = raw[cut + 4 : cut + 4 + int(warc["content-length"])]
    split = block.index(b"\r\n\r\n")
    return warc, headers(block[:split]), block[split + 4 :]


def page_of(urn: str | None) -> int | None:
    found = re.search(r"x-page:(-?\d+)", urn or "")
    return int(found[1]) if found else None


CAPTURES = "surt string, page_id long, url string, kind string, digest string, path string, at long, size long"


def write_archives(pages: DataFrame, smallest: int = SMALLEST_SHARED) -> DataFrame:
    """Writes a record for each page; returns the captures (a table in the shared folder)."""
    spark = pages.sparkSession
    folder = work_dir(spark, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    # only digests are shuffled, after partial aggregation
    shared = rows.where(F.col("n_bytes") >= smallest).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    shared = materialise(shared, "payloads")
    small = shared.count() <= MOST_BROADCAST
    rows = rows.join(F.broadcast(shared) if small else shared, "digest", "left").withColumn("first_id", F.expr(f"IF(n_bytes >= {int(smallest)}, first_id, NULL)"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        stream, at = None, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                if stream is None:
                    fs, local = open_fs(uri)
                    stream = fs.open_output_stream(local, compression=None)
                out = []
                for digest, page_id, url, text, n_bytes, first in zip(*(part.column(c).to_pylist() for c in ("digest", "page_id", "url", "payload", "n_bytes", "first_id")), strict=True):
                    kind = "response" if first is None or first == page_id else "revisit"
                    data = record(kind, page_id, url, text.encode(), digest, n_bytes, first)
                    stream.write(data)
                    out.append((surt(url), page_id, url, kind, digest, uri, at, len(data)))
                    at += len(data)
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=CAPTURES.replace(",", "").split()[::2])
        if stream is not None:
            stream.close()

    captures = materialise(rows.select("digest", "page_id", "url", "payload", "n_bytes", "first_id").mapInArrow(run, CAPTURES), "captures")
    discard(shared)
    return captures


SHARDS = "first_key string, first_page long, path string, at long, size long, n_blocks long, n_lines long"
#: Directories, blocks and archives that a task keeps at hand.
KEPT_DIRECTORIES, KEPT_BLOCKS, KEPT_FILES = 16, 4, 32
Key = tuple[str, int]


def key_of(surt_key: str, page_id: int | None) -> Key:
    """Sorts as Spark does: by the bytes of the text, a null page_id first."""
    return surt_key, -(1 << 63) - 1 if page_id is None else page_id


def zipped(lines: list[str]) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("".join(lines).encode()) + z.flush()


def said(page_id: int | None) -> str:
    return "-" if page_id is None else str(page_id)


def told(text: str) -> int | None:
    return None if text == "-" else int(text)


class ShardWriter:
    """Blocks of sorted captures, then the directory: key, page_id, start and size of each block."""

    def __init__(self, uri: str, lines: int):
        fs, local = open_fs(uri)
        self.uri, self.lines, self.stream = uri, lines, fs.open_output_stream(local, compression=None)
        self.at, self.n_lines, self.first = 0, 0, None
        self.held: list[str] = []
        self.directory: list[str] = []

    def add(self, key: str, page_id: int | None, kind: str, path: str, at: int, size: int) -> None:
        if not self.held:
            self.head = (key, page_id)
            self.first = self.first or self.head
        self.held.append(f"{key} {said(page_id)} {kind} {path} {at} {size}\n")
        if len(self.held) >= self.lines:
            self.flush()

    def flush(self) -> None:
        if self.held:
            data = zipped(self.held)
            self.stream.write(data)
            self.directory.append(f"{self.head[0]} {said(self.head[1])} {self.at} {len(data)}\n")
            self.at, self.n_lines, self.held = self.at + len(data), self.n_lines + len(self.held), []

    def close(self) -> tuple:
        self.flush()
        data = zipped(self.directory)
        self.stream.write(data)
        self.stream.close()
        return *self.first, self.uri, self.at, len(data), len(self.directory), self.n_lines


def write_index(captures: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the shards; returns the index, a row for each."""
    spark = captures.sparkSession
    folder = work_dir(spark, "cdx")
    columns = ("surt", "page_id", "kind", "path", "at", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                shard = shard or ShardWriter(f"{folder}/index-{uuid.uuid4().hex}.cdx.gz", lines)
                shard.add(*row)
        if shard:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array([x], k) for x, k in zip(shard.close(), kinds, strict=True)], names=SHARDS.replace(",", "").split()[::2])

    # the page_id parts ranges within one host or url
    rows = captures.repartitionByRange(shuffle_partitions(spark), "surt", "page_id").sortWithinPartitions("surt", "page_id", "path", "at")
    return materialise(rows.select(*columns).mapInArrow(run, SHARDS), "index")


def read_range(uri: str, at: int, size: int) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(size, at)


def read_lines(uri: str, at: int, size: int) -> list[list[str]]:
    return [line.split(" ") for line in zlib.decompress(read_range(uri, at, size), 31).decode().split("\n")[:-1]]


class CaptureIndex:
    """Searches over the shards: (first_key, first_page, path, at, size) of each. A shard's directory and blocks are read when a search needs them."""

    def __init__(self, shards: list[tuple]):
        self.shards = sorted((key_of(s[0], s[1]), *s[2:5]) for s in shards)
        self.firsts = [s[0] for s in self.shards]
        self.directory = functools.lru_cache(KEPT_DIRECTORIES)(self._directory)
        self.block = functools.lru_cache(KEPT_BLOCKS)(self._block)

    def _directory(self, shard: int) -> tuple[list[Key], list[tuple[int, int]]]:
        lines = read_lines(*self.shards[shard][1:])
        return [key_of(x[0], told(x[1])) for x in lines], [(int(x[2]), int(x[3])) for x in lines]

    def _block(self, shard: int, block: int) -> tuple[list[Key], list[list[str]]]:
        lines = read_lines(self.shards[shard][1], *self.directory(shard)[1][block])
        return [key_of(x[0], told(x[1])) for x in lines], lines

    def captures_from(self, key: Key) -> Iterator[tuple[Key, list[str]]]:
        """The captures from the first that isn't before `key` on; equal keys may begin in the block before."""
        for shard in range(max(0, bisect.bisect_left(self.firsts, key) - 1), len(self.shards)):
            keys = self.directory(shard)[0]
            for block in range(max(0, bisect.bisect_left(keys, key) - 1), len(keys)):
                own, lines = self.block(shard, block)
                for k in range(bisect.bisect_left(own, key), len(own)):
                    yield own[k], lines[k]

    def of_page(self, surt_key: str, page_id: int | None) -> list[list[str]]:
        key = key_of(surt_key, page_id)
        return [line for _, line in itertools.takewhile(lambda x: x[0] == key, self.captures_from(key))]

    def of_url(self, url: str | None) -> list[list[str]]:
        key = surt(url)
        return [line for _, line in itertools.takewhile(lambda x: x[0][0] == key, self.captures_from(key_of(key, None)))]

    def lookup(self, url: str | None) -> list[tuple[dict[str, str], dict[str, str], bytes]]:
        """The records of a url."""
        return [parse(read_range(x[3], int(x[4]), int(x[5]))) for x in self.of_url(url)]


def capture_index(index: DataFrame) -> CaptureIndex:
    """Of an index, of which a row for each shard is held: as many as partitions wrote it."""
    return CaptureIndex([tuple(r) for r in index.collect()])


def capture_keys(pages: DataFrame) -> DataFrame:
    """surt and page_id of the pages to look up, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"surt": pa.array(map(surt, batch.column("url").to_pylist()), pa.string()), "page_id": batch.column("page_id")})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.mapInArrow(run, "surt string, page_id long").distinct()


RESULT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class Archives:
    """Random access to archive files, of which the last KEPT_FILES stay open."""

    def __init__(self):
        self.opened: dict[str, pa.NativeFile] = {}

    def read(self, uri: str, at: int, size: int) -> bytes:
        if uri not in self.opened:
            if len(self.opened) >= KEPT_FILES:
                self.opened.pop(next(iter(self.opened))).close()
            fs, local = open_fs(uri)
            self.opened[uri] = fs.open_input_file(local)
        return self.opened[uri].read_at(size, at)

    def close(self) -> None:
        for f in self.opened.values():
            f.close()


def read_captures(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The records of the keys (surt, page_id), found by search. A response's digest and size are those of the bytes read."""
    shards = [tuple(r) for r in index.select("first_key", "first_page", "path", "at", "size").collect()]  # a row for each shard
    spark = index.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = RESULT.replace(",", "").split()[::2]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        searched, archives = CaptureIndex(shards), Archives()
        for batch in batches:
            found = [line for key, page in zip(batch.column("surt").to_pylist(), batch.column("page_id").to_pylist(), strict=True) for line in searched.of_page(key, page)]
            out = []
            for _, _, kind, archive, start, length in sorted(found, key=lambda x: (x[3], int(x[4]))):
                warc, http, body = parse(archives.read(archive, int(start), int(length)))
                digest, n_bytes = warc["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"])
                if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != n_bytes):
                    raise ValueError(f"{archive} at {start}: the payload isn't the one written")
                out.append((page_of(warc["warc-record-id"]), warc["warc-target-uri"], n_bytes, digest, warc["warc-type"], page_of(warc.get("warc-refers-to"))))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        archives.close()

    dealt = keys.select("surt", "page_id").repartitionByRange(shuffle_partitions(spark), "surt", "page_id").sortWithinPartitions("surt", "page_id")
    return dealt.mapInArrow(run, RESULT)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = write_archives(pages)
    index = write_index(captures)
    discard(captures)
    return read_captures(index, capture_keys(pages)).drop("url")


OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
