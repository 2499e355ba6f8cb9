"""Classifiers, language ID and the pipeline against plain versions; very long texts."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from twinscope.llm import bpe, langid, lexical, media, mixing, near_dups, packed, quality, splitting, toxicity
from twinscope.llm.common import CHUNK_BYTES, table

SF = "/root/testdata/sf0.001"
TEXTS = ["", "You are an IDIOT, a l0ser and m0ron!! Why?", "Nice day. Nice   day; nice\nday", "du bist ein Arschloch 12 ÄÖÜ *$%", "x", "THE END THE END the end", "a" * 700 + " b" * 400, "..!!?? --", "moron " * 200]
LETTERS = "A-Za-z\u0080-\U0010ffff"


def column(texts):
    return pa.array(texts, pa.string())


def lowered(text):
    return "".join(c.lower() if c < "\u0080" or "À" <= c <= "Þ" and c != "×" else c for c in text)


def plain_tallies(text, lex):
    """The sums that toxicity's features are made of, word by word."""
    data = text.encode()
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(rf"[{LETTERS}]+", text)]
    known = dict(zip(lex.words.tolist(), lex.word_weight.tolist(), strict=True))
    starts = dict(zip(lex.starts.tolist(), lex.start_weight.tolist(), strict=True))

    def hashed(data):
        raw = np.frombuffer(data, np.uint8)
        return int(lexical.span_hash(lexical.prefix_sums(raw), np.array([0]), np.array([len(raw)]))[0])

    h = [hashed(lowered(w).encode()) for _, _, w in words]
    begin = [hashed(lowered(w).encode()[:4]) if len(w.encode()) > 4 else None for _, _, w in words]
    fixed, you = [lowered(w) in toxicity.INSULTS for _, _, w in words], [lowered(w) in toxicity.SECOND_PERSON for _, _, w in words]
    bad = [a in known or b in starts or c for a, b, c in zip(h, begin, fixed, strict=True)]
    near = [bad[k] and any(you[max(0, k - 6) : k + 7]) for k in range(len(words))]
    punct = [re.match(r"[!-/:-@\[-`{-~\x00-\x08\x0e-\x1f\x7f]", chr(b)) is not None for b in data]
    masked = 0
    for m in re.finditer(rf"[{LETTERS}](?:[0134579@$!*.\-_#](?=[{LETTERS}])|[{LETTERS}])*", text):
        leet = m[0].translate(str.maketrans("013457@$!", "oieastasi"))
        for part in re.finditer(rf"[{LETTERS}]+", leet):
            own = m[0][part.start() : part.end()]
            masked += own != part[0] and (lowered(part[0]) in toxicity.INSULTS or hashed(lowered(part[0]).encode()) in known)
    letters = sum(len(w.encode()) for _, _, w in words)
    return {
        "words": len(words), "size": len(data), "letters": letters, "hits": sum(x in known for x in h), "word_w": sum(known.get(x, 0) for x in h), "begins": sum(b in starts for b in begin),
        "begin_w": sum(starts.get(b, 0) for b in begin), "fixed": sum(fixed), "masked": masked, "you": sum(you), "near": sum(near), "bad": sum(bad), "upper": sum(65 <= b <= 90 for b in data),
        "caps": sum(len(w.encode()) > 1 and re.fullmatch("[A-Z]+", w) is not None for _, _, w in words), "punct": sum(punct), "twice": sum(a and b for a, b in zip(punct, punct[1:], strict=False)),
        "bang": data.count(b"!"), "query": data.count(b"?"),
    }


def test_toxicity_tallies():
    lex = toxicity.Lexicons(np.sort(lexical.hash_words(["nice", "end"])), np.array([1.5, 2.5]), np.sort(lexical.hash_words(["arsc", "niceday"])), np.array([0.5, 0.25]))
    for text in TEXTS:
        raw = np.frombuffer(text.encode(), np.uint8)
        got = toxicity.tallies(raw, np.array([0, len(raw)]), lex)[0]
        want = plain_tallies(text, lex)
        assert got[: len(want)].tolist() == pytest.approx(list(want.values())), text


def test_rows_apart():
    """What stands in the rows beside changes nothing."""
    lex = toxicity.Lexicons(lexical.hash_words(["nice"]), np.array([1.5]))
    alone = [toxicity.features(*(lambda r: (r, np.array([0, len(r)])))(np.frombuffer(t.encode(), np.uint8)), lex)[0] for t in TEXTS]
    bags = [next(quality.bag_features(column([t])))[2] for t in TEXTS]
    for order in (range(len(TEXTS)), [8, 4, 7, 1, 7, 4, 7, 3, 7, 0, 5]):
        texts = [TEXTS[k].encode() for k in order]
        raw, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        assert np.abs(toxicity.features(raw, offs, lex) - [alone[k] for k in order]).max() == 0
        ((_, _, x, _),) = quality.bag_features(column([TEXTS[k] for k in order]))
        assert np.abs(x - np.concatenate([bags[k] for k in order])).max() == 0


def test_toxicity_scores():
    """Trees walked one by one, calibration by linear interpolation; equal margins share a block."""
    rng = np.random.default_rng(3)
    x = rng.random((300, 5)).round(1)
    y = (x[:, 0] + x[:, 3] + rng.normal(0, 0.2, 300) > 1).astype(float)
    fold = np.arange(300) % 3
    model = toxicity.Toxicity(toxicity.Lexicons()).fit(x, y, [x, x, x], fold)
    at, value = model.knots

    def plain(row):
        margin = model.trees.base
        for feature, cut, leaf in model.trees.trees:
            node = 0
            for level in range(model.trees.depth):
                f = feature[2**level - 1 + node]
                right = f >= 0 and sum(row[f] > c for c in model.trees.cuts[f]) > cut[2**level - 1 + node]
                node = 2 * node + right
            margin += leaf[node]
        if margin <= at[0]:
            p = value[0]
        elif margin >= at[-1]:
            p = value[-1]
        else:
            k = max(i for i in range(len(at)) if at[i] <= margin)
            p = value[k] + (value[k + 1] - value[k]) * (margin - at[k]) / (at[k + 1] - at[k])
        return round(0.99 * p + 0.01 / (1 + math.exp(-margin)), 9)

    assert model.score(x).tolist() == pytest.approx([plain(r) for r in x], abs=2e-9)
    assert (np.diff(value) >= 0).all() and (model.score(x[:1].repeat(3, 0)) == model.score(x[:1])[0]).all()
    held = [toxicity.Trees().fit(x[fold != k], y[fold != k]).margin(x[fold == k]) for k in range(3)]
    margins = np.empty(300)
    for k in range(3):
        margins[fold == k] = held[k]
    same = toxicity.isotonic(margins, y)
    assert (same[0] == at).all() and (same[1] == value).all()  # no margin comes from its own fold


def test_isotonic_is_best():
    """No rising step function over a grid fits better."""
    margin, y = np.array([0.0, 10, 11, 12, 20, 21]), np.array([0.0, 1, 0, 0, 1, 1])
    at, value = toxicity.isotonic(margin, y)
    fitted = np.array([value[np.argmin(np.abs(at - m))] for m in margin])
    grid = np.linspace(0, 1, 7)
    best = min(((np.array(v) - y) ** 2).sum() for v in np.stack(np.meshgrid(*[grid] * 6), -1).reshape(-1, 6) if (np.diff(v) >= 0).all())
    assert ((fitted - y) ** 2).sum() <= best + 1e-9


def test_lexicons(spark):
    """Counted by hand: of the whole sample, and without each fold."""
    rows = [(i, f"bad{'' if i % 2 else 'ly'} word{i % 7}", int(i % 2 == 0), i % 3) for i in range(60)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int, fold int")
    for j, lex in enumerate(toxicity.learn_lexicons(sample)):
        own = [(t, y) for _, t, y, f in rows if j == 0 or f != j - 1]
        n_toxic = sum(y for _, y in own)
        want = {}
        for w in {w for t, _ in own for w in t.split()}:
            toxic, n = sum(y for t, y in own if w in t.split()), sum(w in t.split() for t, _ in own)
            share = n_toxic / len(own)
            ratio = (toxic + 0.5) / (n_toxic + 1) / ((n - toxic + 0.5) / (len(own) - n_toxic + 1))
            if toxic >= toxicity.LEAST_DOCS and ratio >= toxicity.LEAST_RATIO and (toxic - n * share) / math.sqrt(n * share * (1 - share)) >= toxicity.LEAST_Z:
                want[w] = math.log(ratio)
        assert {"badly"} <= set(want)
        keys = {int(k): w for k, w in zip(lex.words, lex.word_weight, strict=True)}
        assert keys == {int(lexical.hash_words([w])[0]): pytest.approx(v) for w, v in want.items()}


def test_langid_counts():
    """Against sets of n-grams, one text at a time; ties go to the commoner language."""
    rng = np.random.default_rng(5)

    def plain_grams(text):
        words = re.findall(rf"[{LETTERS}]+", text)
        out = []
        for w in words:
            data = b" " + lowered(w).encode() + b" "
            # four bytes with one border on either side at most; of a word of two letters both borders
            out += [data[k : k + 4] for k in range(len(data) - 3)]
        return [int.from_bytes(g, "little") for g in out]

    texts = ["Hello big world", "über alles", "a bc def", "", "12 34", "la la lande"]
    entries = [np.unique(rng.integers(0, 1 << 32, 500)), np.unique(plain_grams("hello world lande")), np.unique(plain_grams("hello über alles la lande"))]
    model = langid.Filters(["x", "y", "z"], entries)
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        values, _ = langid.grams(raw, np.array([0, len(raw)]))
        assert sorted(values.tolist()) == sorted(plain_grams(text)), text
        masks = [model.masks(np.array([g]))[0, 0] for g in plain_grams(text)]
        found = [sum(int(m) >> k & 1 for m in masks) for k in range(3)]
        want = [max(0, (f - len(masks) * r) / (1 - r)) for f, r in zip(found, model.false_rate, strict=True)]
        assert model.counts(raw, np.array([0, len(raw)]))[0].tolist() == pytest.approx(want)


def test_langid_many_languages(spark):
    """Over 256 languages are learned, rare ones too, without a window over any."""
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(98 + k % 25)}zq{chr(97 + (k * 7) % 26)}" for k in range(300)]
    rows = [(1000 * k + j, " ".join([words[k]] * 8), f"l{k}") for k in range(300) for j in range(2 if k else 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    learned = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    assert len(learned) > 256 and set(model.languages) == learned
    assert np.mean([got[i] == lang for i, _, lang in rows if lang in learned]) > 0.97


def test_quality_scores():
    """Attention computed one passage at a time; all passages of a long text count."""
    rng = np.random.default_rng(8)
    net = quality.Attention(quality.N_FEATURES)
    texts = [t for t in TEXTS] + [" ".join(rng.choice(["good", "words", "here"], 4000)), " ".join(rng.choice(["good", "words", "here"], 2000)) + " $$$ ### " * 300]
    rows = list(quality.bag_features(column(texts)))
    x, n = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])
    assert n.tolist() == [max(1, -(-len(t.encode()) // quality.PASSAGE)) for t in texts]
    net.fit(x, n, (np.arange(len(n)) % 2).astype(np.float32))
    p = net.p
    at = 0
    for k, size in enumerate(n.tolist()):
        h = [np.tanh(np.clip((v - net.mean) / net.scale, -8, 8) @ p["W"] + p["b"]) for v in x[at : at + size]]
        e = [math.exp(float((np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["a"])) for v in h]
        z = sum(w / sum(e) * v for w, v in zip(e, h, strict=True))
        assert float(net.score(x[at : at + size], np.array([size]))[0]) == pytest.approx(1 / (1 + math.exp(-float(z @ p["w"] + p["c"][0]))), abs=2e-5), k
        at += size


def test_quality_passages():
    """Counts of single passages."""
    text = "AB cd, cd!\n1|2 * é " * 60
    raw = np.frombuffer(text.encode(), np.uint8)
    cuts, n = quality.passages(raw, np.array([0, len(raw)]))
    x = quality.encode(raw, np.array([0, len(raw)]), cuts)
    for k in range(n[0]):
        part = text.encode()[k * quality.PASSAGE : (k + 1) * quality.PASSAGE]
        size = len(part)
        assert x[k, 0] == pytest.approx(math.log1p(size) / 6, abs=1e-6)
        for place, signs in ((6, b"!"), (7, b"|"), (11, b"\n"), (9, b"12"), (8, b"*|")):
            if place != 8:
                assert x[k, place] == pytest.approx(sum(part.count(bytes([s])) for s in signs) / size, abs=1e-6), place


@pytest.mark.parametrize("texts", [["plain words here " * 40_000, "short", None, "x" * (CHUNK_BYTES + 50) + " tail"], ["é" * (CHUNK_BYTES // 2 + 7) + " und mehr"], ["a b " * (CHUNK_BYTES // 4), ""]])
def test_parts_of_long_texts(texts):
    """A text read part by part gives what it gives alone in one pass."""
    lex = toxicity.Lexicons(lexical.hash_words(["words"]), np.array([2.0]))
    model = langid.Filters(["x"], [np.array([1])])
    for text in texts:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        offs = np.array([0, len(raw)])
        parts = list(lexical.segments(raw, offs))
        assert b"".join(p.tobytes() for p, _ in parts) == raw.tobytes()
        if len(raw):
            whole = toxicity.tallies(raw, offs, lex).sum(0)
            assert sum(toxicity.tallies(p, o, lex) for p, o in parts)[0] == pytest.approx(whole, rel=1e-4)
            assert sum(len(langid.grams(p, o)[0]) for p, o in parts) == len(langid.grams(raw, offs)[0])
            words = near_dups.word_hashes(raw, offs)[0]
            starts, ends = lexical.word_bounds(near_dups.TOKEN[raw], offs)
            assert (words == lexical.span_hash(lexical.prefix_sums(lexical.lower(raw)), starts, ends)).all()
            assert model.counts(raw, offs).shape == (1, 1)
    ids = [(hi - lo, len(x)) for lo, hi, x, _ in splitting.encode_column(column(texts), lambda spans: [b"\0\0\0\0"] * len(spans), 1 << 16)]
    assert sum(n for n, _ in ids) == len(texts)


def test_very_long_text():
    """50 MB in one text, by each operator that takes texts."""
    text = "Once upon a time, 42 small l0sers went home; you didn't see them. Ünder the bridge!\n" * 600_000
    raw = np.frombuffer(text.encode(), np.uint8)
    offs, one = np.array([0, len(raw)]), column([text])
    assert len(raw) > 50_000_000
    assert toxicity.features(raw, offs, toxicity.Lexicons()).shape == (1, 24)
    assert langid.Filters(["x"], [np.array([1])]).counts(raw, offs).shape == (1, 1)
    ((_, _, x, n),) = quality.bag_features(one)
    assert len(x) == n[0] == -(-len(raw) // quality.PASSAGE)
    kmers = near_dups.Words(text.encode()).kmers
    assert len(near_dups.sketches(kmers)) == near_dups.SKETCHES and len(np.unique(kmers)) == len(kmers)
    codec = bpe.codec(P.path(bpe.RANK_FILE), P.PATTERN)
    ((_, _, ids, _),) = codec.encode_rows(one)
    digest = hashlib.sha256()
    for part in codec.decoded(ids):
        digest.update(part)
    assert digest.digest() == hashlib.sha256(text.encode()).digest()
    again = sum(len(x) for _, _, x, _ in packed.encoder(P.path(packed.TOKENIZER_FILE)).rows(one))
    assert again == len(ids)
    payload = media.pad(text.encode())
    (track,) = media.probe(media.movie(payload, media.keyframes_of(payload)))
    assert len(track.sizes) == len(payload) // 192


def test_spans_random():
    """Spans and the library against whole texts, odd white space and signs included."""
    rng = np.random.default_rng(11)
    alphabet = [*"ab \n\t'sre1,!.é×Ü漢😀", " ", "\xa0", "　", "\x1c", "\x85", "​", "\r", " a", "'ll", " 's", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 14))) for _ in range(4000)]
    library, tik = Tokenizer.from_file(P.path(packed.TOKENIZER_FILE)), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(bpe.RANK_FILE)), special_tokens={})
    for rows, wanted in ((packed.encoder(P.path(packed.TOKENIZER_FILE)).rows, lambda t: library.encode(t, add_special_tokens=False).ids), (bpe.codec(P.path(bpe.RANK_FILE), P.PATTERN).encode_rows, tik.encode_ordinary)):
        for lo, hi, ids, cut in rows(column(texts)):
            for k in range(lo, hi):
                assert ids[cut[k - lo] : cut[k - lo + 1]].tolist() == wanted(texts[k]), texts[k]


def test_memo_forgets():
    asked = []
    memo = splitting.Memo(lambda spans: asked.extend(spans) or [s * 4 for s in spans], 8)
    for k in range(40):
        assert memo([b"%d" % (k % 13), b"x"]) == [b"%d" % (k % 13) * 4, b"xxxx"]
        assert len(memo.young) <= 4 and len(memo.old) <= 4
    assert asked.count(b"x") < 20


def test_pipeline_by_hand(spark):
    """The rows of run() against the stages in plain versions: scores, all pairs, SQL and the library."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = corpus_pipeline.run(spark, SF).collect()
    rows = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == docs.count()

    def frame(ids):
        return spark.createDataFrame([tuple(rows[i]) for i in sorted(ids)], docs.schema)

    good = {r.doc_id for r in quality.score_documents(docs, quality.train(docs, labels)).where("score >= 0.5").collect()}
    clean = {r.doc_id for r in toxicity.score_documents(frame(good), toxicity.train(frame(good), labels)).where("score < 0.5").collect()}
    words = {i: near_dups.Words((rows[i].text or "").encode()) for i in clean}
    smallest = {i: i for i in clean}
    order = sorted(clean)
    linked = [(a, b) for x, a in enumerate(order) for b in order[x + 1 :] if rows[a].text == rows[b].text or words[a].like(words[b])]
    for _ in order:
        for a, b in linked:
            smallest[a] = smallest[b] = min(smallest[a], smallest[b])
    single = sorted({*smallest.values()})
    con = duckdb.connect()
    con.register("kept", pd.DataFrame([tuple(rows[i]) for i in single], columns=docs.columns))
    mixed = con.sql(mixing.MIX_SQL.format(docs="kept", seed=mixing.SEED, columns="doc_id, text")).fetchall()
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(bpe.RANK_FILE)), special_tokens={})
    want = []
    for doc_id, text, *_ in mixed:
        ids = np.array(tik.encode_ordinary(text or ""), "<u4")
        want.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 20
