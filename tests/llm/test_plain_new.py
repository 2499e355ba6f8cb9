"""Alignment, click windows and near vectors against plain versions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from twinscope.llm import alignment, click_windows, vector_dups
from twinscope.llm.packed import BYTE_NAMES

ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "<|endoftext|> x <s> </s> <unk>"), (6, "a▁b"), (7, "\n\n a\n\tb  c   \n   x"), (8, "x" * 3000), (9, "日本語 テスト 😀 é́ \xa0 ａ"),
    (10, "\x00\x01 \r\n"), (12, "  lead"), (13, "tail  "), (14, "don't 12345 $%^ it's"), (15, "  \x85  x"), (5, "dup id"), (None, "no id"), (16, "ß" * 1000 + " " * 500), (17, "the same text"), (18, "the same text"),
]


def plain_alignment(docs):
    a_side, b_side = Tokenizer.from_file(P.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a_side.encode_special_tokens = True
    byte_of = {c: b for b, c in BYTE_NAMES.items()}
    a_bytes = lambda i: bytes(byte_of[c] for c in a_side.id_to_token(i))
    b_bytes = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    counts, out = Counter(), []
    for doc_id, text in docs:
        a, b = (a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            out.append((doc_id, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((a_bytes, a), (b_bytes, b))]
        groups, links, i, j = [], [], 0, 0
        for end in sorted({*ends[0]} & {*ends[1]}):
            first = i, j
            while i < len(a) and ends[0][i] <= end:
                i += 1
            while j < len(b) and ends[1][j] <= end:
                j += 1
            groups.append(",".join(map(str, a[first[0] : i])) + "|" + ",".join(map(str, b[first[1] : j])))
            links.append((a[i - 1], b[j - 1]))
        counts.update(links)
        out.append((doc_id, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(((d, a, b, len(x), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), h) for d, a, b, x, h in out), key=str)


COLUMNS = "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, monkeypatch, small):
    """Odd texts, one that is aligned in parts, and columns of clashing names; with limits so low that sums, cells and groups of tasks are split."""
    if small:
        monkeypatch.setattr(alignment, "CELL_LINKS", 3)
        monkeypatch.setattr(alignment, "GROUP", 1)
    rng = np.random.default_rng(3)
    docs = [*ODD, (11, "a b" * 400_000)] + [(100 + k, " ".join(rng.choice(["the", "of", "und", "straße", "été", "x9", "Lorem", "ipsum!"], 60))) for k in range(30)]
    frame = spark.createDataFrame([(d, t, "x", 1.5) for d, t in docs], "doc_id long, text string, row string, pairs double").repartition(5)
    got, counts = alignment.align(frame)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=str) == plain_alignment(docs)
    assert counts.count() > 0


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none)[0].count() == 0
    assert [tuple(r) for r in alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string"))[0].select(*COLUMNS).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


CLICK = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, batch string"


def plain_windows(rows):
    epoch = datetime(1970, 1, 1)
    micros = lambda t: (t - epoch) // timedelta(microseconds=1)
    said = lambda x: "" if x is None else str(x)
    copies = []
    for click, ts, arrived, client, kind, value, props, *_ in rows:
        if click is None or arrived is None:
            continue
        for j in range(int(math.fmod(click, 3)) + 1):
            c = zlib.crc32(f"{click}:{j}".encode())
            hour = micros(arrived) // 3_600_000_000 + 6 * j * (c % 10)
            text = "|".join([said(client), said(kind), said(None if value is None else math.floor(100 * value + 0.5)), said(None if ts is None else micros(ts)), said(props), str(c % 3)])
            copies.append((hour + c // 10 % 200, click, hour, hashlib.sha256(text.encode()).hexdigest()))
    low, high = min(c[0] for c in copies), max(c[0] for c in copies)
    batches = defaultdict(list)
    for late, *copy in copies:
        batches[(late - low) * 8 // (high - low + 1)].append(tuple(copy))
    known, out, latest = {}, [], None
    for b in range(8):
        for click, hour, digest in sorted(batches[b]):
            if b and latest is not None and hour < latest - 96:
                continue
            w = known.get(click)
            if w and hour <= w[0] + 24:
                w[1] += 1
                if digest != w[4]:
                    w[2], w[3] = w[2] + 1, w[3] + zlib.crc32(digest.encode())
            else:
                if w:
                    out.append((click, w[0], b, *w[1:]))
                known[click] = [hour, 0, 0, 0, digest]
        latest = max([c[1] for c in batches[b]] + ([latest] if latest is not None else []))
        for click in [k for k, w in known.items() if b == 7 or w[0] + 24 < latest - 96]:
            w = known.pop(click)
            out.append((click, w[0], b, *w[1:]))
    return sorted(out)


def test_click_windows(spark, tmp_path):
    """Repeated, late and broken rows, one id with a third of them, ids that are zero and negative; the session's settings stay as they were."""
    rng = np.random.default_rng(5)
    start, rows = datetime(2024, 1, 3), []
    for k in range(700):
        click = 5 if k % 3 == 0 else int(rng.integers(-20, 200))
        at = start + timedelta(hours=float(rng.exponential(30)) if k % 9 == 0 else k * 2, microseconds=int(rng.integers(10**6)))
        rows.append((click, at if k % 7 else None, at, k % 5 if k % 11 else None, ("view", "buy|x", None)[k % 3], [1.25, -3.005, None, 1e6][k % 4], None if k % 13 == 0 else '{"a": 1}', "x"))
    rows += rows[50:90] + [(None, start, start, 1, "view", 1.0, "{}", "x"), (7, start, None, 1, "view", 1.0, "{}", "x")]
    spark.createDataFrame(rows, CLICK).write.parquet(f"{tmp_path}/clicks.parquet")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    columns = "click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash"
    got = click_windows.op12_click_windows(spark, str(tmp_path))
    want = plain_windows(rows)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == want and len(want) > 300 and any(w[4] for w in want)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    spark.createDataFrame(rows[-2:], CLICK).write.parquet(f"{tmp_path}/none/clicks.parquet")
    none = click_windows.op12_click_windows(spark, f"{tmp_path}/none")
    assert none.count() == 0 and set(none.columns) == set(columns)


def test_click_windows_opens(spark, tmp_path, monkeypatch):
    """Each run of the stream opens the stores once, and the last once more; batches without rows between others change nothing."""
    rng, start, folders = np.random.default_rng(6), datetime(2024, 1, 3), []
    hours = [*rng.integers(0, 300, 200), *rng.integers(1400, 1700, 200), *rng.integers(4000, 4300, 200)]
    rows = [(int(rng.integers(0, 60)), at, at, k % 5, "view", 1.0, "{}", "x") for k, at in enumerate(start + timedelta(hours=int(h)) for h in hours)]
    spark.createDataFrame(rows, CLICK).write.parquet(f"{tmp_path}/clicks.parquet")
    monkeypatch.setattr(click_windows, "work_dir", lambda *_: folders.append(f"{tmp_path}/work") or folders[-1])
    got = click_windows.op12_click_windows(spark, str(tmp_path))
    columns = "click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash"
    want = plain_windows(rows)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == want and 3 < len({w[2] for w in want}) < 8
    assert len([x for x in (tmp_path / "work/checkpoint/commits").iterdir() if x.name.isdigit()]) == click_windows.BATCHES + 1
    assert spark.conf.get(click_windows.EMPTY_RUNS) == "true"


def plain_links(rows, threshold=0.93):
    """vec_id, n_links, component_id, kept of (vec_id, vector, label)."""
    able = [v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    dim = max((len(v) for (_, v, _), ok in zip(rows, able, strict=True) if ok), default=0)
    x = np.array([[*v, *[0.0] * (dim - len(v))] if ok else [0.0] * dim for (_, v, _), ok in zip(rows, able, strict=True)]).reshape(len(rows), dim)
    norm = np.sqrt((x * x).sum(1))
    linked = np.zeros((len(rows), len(rows)), bool)
    for i in range(len(rows)):
        for j in range(i):
            if able[i] and able[j] and rows[i][2] == rows[j][2]:
                linked[i, j] = linked[j, i] = (x[i] * x[j]).sum() / (norm[i] * norm[j]) >= threshold
    out, seen = [None] * len(rows), set()
    for k in range(len(rows)):
        if k not in seen:
            queue = [k]
            seen.add(k)
            for u in queue:
                fresh = [int(v) for v in np.flatnonzero(linked[u]) if v not in seen]
                seen.update(fresh)
                queue += fresh
            ids = [rows[q][0] for q in queue if rows[q][0] is not None]
            for q in queue:
                name = min(ids) if ids else None
                out[q] = (rows[q][0], int(linked[q].sum()), name, rows[q][0] is not None and rows[q][0] == name)
    return sorted(out, key=str)


@pytest.mark.parametrize("window,cell,block", [(vector_dups.WINDOW, vector_dups.CELL, vector_dups.BLOCK), (8, 32, 16)])
def test_near_vectors(spark, monkeypatch, window, cell, block):
    """Dense groups larger than windows and blocks, a chain, copies, scaled copies, other labels and vectors that take no part."""
    for name, value in (("WINDOW", window), ("CELL", cell), ("BLOCK", block)):
        monkeypatch.setattr(vector_dups, name, value)
    rng = np.random.default_rng(7)
    unit = lambda v: (v / np.linalg.norm(v)).astype(np.float32).tolist()
    rows = []
    for size, noise in ((90, 0.02), (70, 0.06), (40, 0.045), (3, 0.01)):
        base = rng.standard_normal(16)
        base /= np.linalg.norm(base)
        rows += [(unit(base + noise * rng.standard_normal(16)), label) for k in range(size) for label in ((1, 2) if k % 10 == 0 else (1,))]
    rows += [(unit(rng.standard_normal(16)), int(rng.integers(1, 3))) for _ in range(150)]
    rows += [(unit([math.cos(t), math.sin(t), *[0.0] * 14]), 3) for t in np.arange(0, 3.1, 0.3)]  # a chain of neighbours
    rows += [(rows[0][0], 1)] * 30 + [([2 * x for x in rows[1][0]], 1), ([-x for x in rows[1][0]], 1)]
    rows += [(None, 1), ([], 1), ([0.0] * 16, 1), ([None] + [1.0] * 15, 1), ([float("nan")] * 16, 1), ([float("inf")] + [0.0] * 15, 1), (rows[0][0], None), ([1.0], 4), ([1.0, 0.0, 0.0], 4)]
    ids = rng.permutation(len(rows)).tolist()
    ids[:4] = [None, ids[7], ids[7], None]
    told = [(i, v, label) for i, (v, label) in zip(ids, rows, strict=True)]
    frame = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in told], "vec_id long, embedding array<float>, label int, node string, key int")
    got = vector_dups.vector_dups(frame.repartition(3)).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_links(told)
    assert vector_dups.vector_dups(frame.limit(0)).count() == 0


def test_passes():
    """A pair at the threshold that shares its first bits in no pass is as rare as MISS says."""
    for n in (2, 1000, 10**6, 10**9):
        bits = max(1, math.ceil(math.log2(max(1, n / vector_dups.WINDOW))) + 1)
        assert (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** vector_dups.passes(n) <= vector_dups.MISS
    linked = np.zeros((6, 6), bool)
    for a, b in ((0, 1), (1, 2), (0, 2), (3, 4)):
        linked[a, b] = linked[b, a] = True
    assert sorted(map(sorted, vector_dups.forest(linked))) == [[0, 1], [0, 2], [3, 4]]
