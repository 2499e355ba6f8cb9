"""BPE, packed ids, media, WARC and mixing: round trips and odd rows."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from twinscope.llm import bpe, media, mixing, packed, warc

TEXTS = [None, "", " ", "\n", "a", "The end.", "The end.", "two  blanks\n\nand\ttabs ", "Ünïcödé 漢字 😀 İǅ", "x" * 30000, "ab" * 5000, "<|endoftext|> mid <|endoftext|>", "it's we'll 123abc!?", "\0nul \0", "a\r\nb\x85c\xa0d　e"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, label int, copies int, t string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i}", 1, "clash", 7, 5, "clash") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, None, "c", 1, 1, "c"), (3, TEXTS[3], "en", "hot", 1, "clash", 7, 5, "clash")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(bpe.RANK_FILE)), special_tokens={})


def by_id(rows):
    return sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id))


def test_bpe(docs, tik):
    got = by_id(bpe.round_trip(docs).collect())
    for r, d in zip(got, by_id(docs.collect()), strict=True):
        ids = np.array(tik.encode_ordinary(d.text or ""), "<u4")
        assert (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) == (d.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_bpe_random(tik):
    codec, rng = bpe.codec(P.path(bpe.RANK_FILE), P.PATTERN), np.random.default_rng(4)
    parts = ["a", "b", "ab", " ", "\n", "é", "'s", "22", "!", "\t", "漢", "the", " and", "_", "-", "ing", "tion", "\x1c"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 16)))
        assert codec.encode_bytes(text) == np.array(tik.encode_ordinary(text), "<u4").tobytes(), text


def test_small_vocabulary():
    """Against the merges done naively, where tokens overlap in every way."""
    ranks = {b: i for i, b in enumerate([b"a", b"b", b"c", b"ab", b"bc", b"abc", b"ca", b"aa", b"aaaa", b"bcab"])}
    vocabulary, rng = bpe.Vocabulary(ranks), np.random.default_rng(5)

    def naive(data):
        parts = [bytes([x]) for x in data]
        while True:
            best = min(((ranks[p + q], k) for k, (p, q) in enumerate(zip(parts, parts[1:], strict=False)) if p + q in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for _ in range(3000):
        data = bytes(rng.choice(list(b"abc"), rng.integers(1, 14)).astype(np.uint8))
        if data not in ranks:
            assert vocabulary.encode(data.decode("latin-1")) == naive(data), data


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_pack(bits):
    ids = np.random.default_rng(1).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    assert (packed.unpack(packed.pack(ids, bits), bits, 1001) == ids).all() and len(packed.pack(ids, bits)) == -(-1001 * bits // 8)
    assert packed.width(1 << bits) == bits
    with pytest.raises(ValueError):
        packed.pack(np.array([1 << 16], "<u4"), 16)


def test_packed(docs):
    manifest = packed.write_shards(docs)
    got = sorted(packed.read_shards(manifest).collect(), key=lambda r: r.start)
    library, start = Tokenizer.from_file(P.path(packed.TOKENIZER_FILE)), 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]
    for r in got:
        ids = np.array([*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    shard = packed.Shard(max(manifest.collect(), key=lambda r: r.n_ids).path)
    row = int(np.diff(shard.starts).argmax())
    assert (shard.document(row) == shard.ids(0, shard.n_ids)[shard.starts[row] : shard.starts[row + 1]]).all()
    assert packed.read_shards(packed.write_shards(docs.limit(0))).count() == 0


def test_media(docs):
    for r, d in zip(by_id(media.probe_media(media.pack_media(docs)).collect()), by_id(docs.collect()), strict=True):
        data = (d.text or "").encode()
        whole = data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:]))
        assert r.feature.startswith("vide:raw ") and r.media_bytes > r.payload_bytes
        assert r.codec == "raw" and r.duration == len(whole) / 192 / 25 and sum(k.size for k in r.keyframes) <= len(whole)
        assert sorted(sum([[*range(k.at, k.at + k.size, 192)] for k in r.keyframes], [])) == [r.media_bytes - len(whole) + 192 * (n - 1) for n in media.keyframes_of(whole)]
    assert media.probe_media(media.pack_media(docs.limit(0))).count() == 0


def test_media_boxes():
    data = media.movie(bytes(192 * 130), [1, 2, 65, 130])
    (track,) = media.probe(data)
    start = len(data) - 192 * 130
    assert (track.seconds, track.codec, len(track.sizes)) == (130 / 25, "raw ", 130)
    assert track.keyframes().tolist() == [[start, 384], [start + 64 * 192, 192], [start + 129 * 192, 192]]
    for broken in (b"", b"abc", data[:100], b"\0" * 64, data[:40] + b"\xff" * 400):
        assert isinstance(media.probe(broken), list)


def test_warc(spark):
    long = "<p>" + "x" * 200
    rows = [(1, "http://a.B.c:8080/x y?q#f", long), (2, "https://a.b.c/", long), (7, None, None), (8, "", "<b>"), (9, "no url\n", "<b>"), (2, "https://a.b.c/", long), (None, "http://z/", long), (3, "http://ü.de/é", "é" * 60), (4, "http://[::1]/a", "y" * 100000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures = warc.write_archives(pages)
    index = warc.write_index(captures, lines=2)
    got = sorted((tuple(r) for r in warc.read_captures(index, warc.capture_keys(pages)).drop("url").collect()), key=str)
    walked = []  # the archives read from end to end
    for path in {r.path for r in captures.select("path").collect()}:
        data = open(path.removeprefix("file://"), "rb").read()
        while data:
            z = zlib.decompressobj(31)
            z.decompress(data)
            w, h, _ = warc.parse(data[: len(data) - len(z.unused_data)])
            walked.append((warc.page_of(w["warc-record-id"]), int(h["content-length"]), w["warc-payload-digest"].removeprefix("sha256:"), w["warc-type"], warc.page_of(w.get("warc-refers-to"))))
            data = z.unused_data
    assert got == sorted(walked, key=str)
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    assert got == sorted((tuple(r) for r in con.sql(warc.OP7_SQL).fetchall()), key=str)
    index = warc.capture_index(index)
    assert sorted(w["warc-type"] for w, _, _ in index.lookup("https://a.b.c/")) == ["revisit", "revisit"]
    assert [b.decode() for _, _, b in index.lookup("http://a.b.C:8080/x y?q")] == [long]
    assert len(index.lookup(None)) == 2 and index.lookup("http://nowhere/") == []
    assert warc.surt("https://www.Example.org:443/a?b=1#c") == "org,example,www)/a?b=1"
    none = pages.limit(0)
    assert warc.read_captures(warc.write_index(warc.write_archives(none)), warc.capture_keys(none)).count() == 0
    assert warc.read_captures(warc.write_index(captures), spark.createDataFrame([("nowhere)/", 1), ("a,b,c)/", 5)], "surt string, page_id long")).count() == 0


def test_warc_hot_url(spark):
    """One url for most pages: its captures fill many blocks and shards, and each is found by its page."""
    pages = spark.range(900).selectExpr("id as page_id", "IF(id % 3 = 0, concat('http://x.org/', id), 'http://hot.org/') as url", "concat('body ', id) as html")
    index = warc.write_index(warc.write_archives(pages), lines=7)
    got = warc.read_captures(index, warc.capture_keys(pages)).collect()
    assert sorted(r.page_id for r in got) == [*range(900)]
    assert len(warc.capture_index(index).of_url("http://hot.org/")) == 600


def test_mixing(spark, docs):
    mixed = mixing.mix(docs)
    assert [c for c in mixed.columns if c not in ("copy_no", "mix_key")] == docs.columns
    rows = mixed.collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r.doc_id or -1, r.copy_no, r.mix_key) for r in rows) == sorted((r.doc_id or -1, r.copy_no, r.mix_key) for r in again)
    assert mixing.mix(docs.limit(0)).count() == 0
    many = spark.range(4000).selectExpr("id as doc_id", "'word word' as text", "IF(id % 4 = 0, 'small', 'big') as source")
    weights = spark.createDataFrame([("small", 3.0), ("big", 1.0)], "source string, weight double")
    counts = {r.source: r["count"] for r in mixing.mix(many, weights).groupBy("source").count().collect()}
    assert abs(counts["small"] - 3000) < 200 and abs(counts["big"] - 1000) < 130
    heavy = mixing.mix(many.where("doc_id < 3"), weights, total=30000.0).count()  # means above STEP
    assert abs(heavy - 3000) < 250


def test_mixing_odd_weights(spark):
    """Weights that aren't positive numbers give no copies; a source named twice has the sum."""
    docs = spark.range(900).selectExpr("id as doc_id", "'word' as text", "element_at(array('a', 'b', 'c', 'd', null), cast(id % 5 + 1 as int)) as source")
    weights = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", -3.0), ("c", None), ("d", float("nan")), (None, 2.0), ("nowhere", 9.0), ("e", float("inf"))], "source string, weight double")
    counts = {r.source: r["count"] for r in mixing.mix(docs, weights).groupBy("source").count().collect()}
    assert set(counts) == {"a", None} and all(abs(n - 450) < 90 for n in counts.values())
    for none in (weights.where("weight < 0"), weights.limit(0), weights.where("source = 'nowhere'")):
        assert mixing.mix(docs, none).count() == 0
    assert mixing.mix(docs, weights, total=0.0).count() == mixing.mix(docs, weights, total=-5.0).count() == 0
