"""Queries on small tables against plain versions that judge every pair."""

import functools
import hashlib
import itertools
import random

import pytest

from twinscope.operators.evaluate import DEFAULT_THRESHOLDS, ESCALATED
from twinscope.operators.pairs import pairs_within
from twinscope.plans.queries import QUERIES

VALUE = {
    "jaccard": lambda a, b: len(a & b) / len(a | b),
    "cosine": lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5,
    "overlap": lambda a, b: len(a & b) / min(len(a), len(b)),
    "dice": lambda a, b: 2 * len(a & b) / (len(a) + len(b)),
    "simhash": lambda a, b: 1 - (fingerprint(a) ^ fingerprint(b)).bit_count() / 64,
}


@functools.cache
def fingerprint(items):
    hashes = [int.from_bytes(hashlib.md5(" ".join(i).encode()).digest()[:8]) for i in items]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def shingles(text):
    w = (text or "").split()
    return frozenset(zip(w, w[1:], w[2:], strict=False))


def similarity(metric, a, b):
    return VALUE[metric](a, b) if a and b else float(a == b)


def families(sets, edge):
    """(key, family) of all keys with an edge."""
    family = {k: k for k in sets}
    linked = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if edge(sets[a], sets[b])]
    for _ in sets:
        for a, b in linked:
            family[a] = family[b] = min(family[a], family[b])
    return {(k, family[k]) for k in {x for e in linked for x in e}}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folder of documents and their rows: a text inside longer ones, near copies of all grades, copies without another twin."""
    rnd = random.Random(3)
    texts = []
    for g in range(6):
        base = [f"w{g}x{i}" for i in range(40)]
        texts += [" ".join(base), " ".join(base[:10]), " ".join(base[5:25]), " ".join(base + [f"v{g}x{i}" for i in range(60)])]
        texts.append(" ".join(base[10:] + [f"q{g}x{i}" for i in range(10)]))  # near the base, far from its other twins
        for k in (3, 8, 14, 19, 22, 24, 27):
            texts.append(" ".join(base[:-k] + [f"r{rnd.random()}" for _ in range(k)]))
        texts += [" ".join(base[:-8] + [f"s{g}"] * 8)] * (g + 1)
    texts += ["only copies of one text stand here"] * 5
    texts += ["", None, "two words", "other words", " "]  # empty sets
    rows = [(i, t, ("en", "de", None)[i % 3], "web", len(t or "")) for i, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_metric_families(spark, tables):
    folder, rows = tables
    sets = {r[0]: shingles(r[1]) for r in rows}
    got = {tuple(r) for r in QUERIES["metric_families"](spark, folder).select("metric", "node", "family").collect()}
    for m, t in DEFAULT_THRESHOLDS.items():
        assert {x[1:] for x in got if x[0] == m} == families(sets, lambda a, b, m=m, t=t: similarity(m, a, b) >= t), m


def test_threshold_sweep(spark, tables):
    folder, rows = tables
    sets = {r[0]: shingles(r[1]) for r in rows}
    lang = {r[0]: r[2] for r in rows}
    scored = [(similarity("jaccard", sets[a], sets[b]), lang[a] == lang[b], sets[a] == sets[b]) for a, b in itertools.combinations(sets, 2)]
    assert any(0.2 <= s < 0.4 for s, *_ in scored)
    got = {r.threshold: (r.kept, r.positives, r.negatives, r.known) for r in QUERIES["threshold_sweep"](spark, folder).collect()}
    for t in range(20, 99, 2):
        at = [(same, copy) for s, same, copy in scored if int(round(s * 100, 6)) >= t]
        same = sum(s for s, _ in at)
        assert got[t] == (len(at), same, len(at) - same, sum(copy and not s for s, copy in at)), t
    kept = [t for t in got if got[t][2] == got[t][3]]
    assert [r.threshold for r in QUERIES["best_threshold"](spark, folder).collect()] == ([min(kept, key=lambda t: (-got[t][1], t))] if kept else [])


def every_value(rows):
    """(metric, value, one language, copies) of every pair of documents that share what the metric escalates at least."""
    sets, lang = {r[0]: shingles(r[1]) for r in rows}, {r[0]: r[2] for r in rows}
    return [({m: round(similarity(m, sets[a], sets[b]), 6) for m in VALUE}, lang[a] == lang[b], sets[a] == sets[b]) for a, b in itertools.combinations(sets, 2)]


def test_verdicts_are_of_all_pairs(spark, tables):
    """Overlap flags texts inside longer ones, whose Jaccard similarity is far below its own threshold."""
    folder, rows = tables
    judged = [x for x in every_value(rows) if any(x[0][m] >= t for m, t in ESCALATED.items())]
    want = {}
    for m, t in DEFAULT_THRESHOLDS.items():
        for values, same, _ in judged:
            v = "flag" if values[m] >= t else "escalate" if values[m] >= ESCALATED[m] else "ignore"
            row = want.setdefault((m, not same), {"flag": 0, "escalate": 0, "ignore": 0})
            row[v] += 1
    assert any(values["overlap"] >= 0.75 and values["jaccard"] < 0.3 for values, *_ in judged)
    got = {(r.metric, r.is_control): {"flag": r.flag, "escalate": r.escalate, "ignore": r.ignore} for r in QUERIES["verdict_tally"](spark, folder).collect()}
    assert got == want


def test_best_setting(spark, tables):
    folder, rows = tables
    pairs = every_value(rows)
    got = {r.metric: (r.threshold, r.flags, r.escalations, r.unknown_fp) for r in QUERIES["best_setting"](spark, folder).collect()}
    for m in DEFAULT_THRESHOLDS:
        low, best = 78 if m == "simhash" else 20, None
        placed = [(int(round(values[m] * 100, 6)), same, copy) for values, same, copy in pairs]
        for g in range(low, 99, 2):
            flags, escalations = sum(same and at >= g for at, same, _ in placed), sum(same and max(low, g - 10) <= at < g for at, same, _ in placed)
            if not any(at >= g and not same and not copy for at, same, copy in placed) and (best is None or (flags, escalations) > best[1:3]):
                best = (g, flags, escalations, 0)
        assert got.get(m) == best, m


def test_one_signature(spark, tmp_path):
    words = [f"w{i}" for i in range(20_000)]
    texts = [" ".join(words), " ".join(words[:9000] + ["other"] + words[9001:])] * 2
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    signatures = {r.signature for r in QUERIES["minhash_signature"](spark, str(tmp_path)).collect()}
    assert len(signatures) == 1  # the texts differ, their signatures don't
    assert [(r.a, r.b) for r in QUERIES["lsh_candidates"](spark, str(tmp_path)).collect()] == [(0, 1)]
    assert [(r.a, r.b) for r in QUERIES["twin_pairs"](spark, str(tmp_path)).collect()] == [(0, 1)]


def test_metric_floor(spark, tables):
    folder, rows = tables
    sets = {r[0]: shingles(r[1]) for r in rows}
    members = {}
    for k, f in families(sets, lambda a, b: similarity("jaccard", a, b) >= 0.4):
        members.setdefault(f, []).append(sets[k])
    floor = {(f, m): min(similarity(m, a, b) for a, b in itertools.combinations(x, 2)) for f, x in members.items() for m in DEFAULT_THRESHOLDS}
    got = {(r.family, r.metric): (r.floor, r.margin) for r in QUERIES["metric_floor"](spark, folder).collect()}
    assert got == {k: (pytest.approx(v, abs=1e-6), pytest.approx(v - DEFAULT_THRESHOLDS[k[1]], abs=1e-6)) for k, v in floor.items()}
    assert min(margin for (_, m), (_, margin) in got.items() if m == "jaccard") < 0
    best = {f: max(floor[f, m] - t for m, t in DEFAULT_THRESHOLDS.items()) for f in members}
    assert {r.family: r.margin for r in QUERIES["metric_rescue"](spark, folder).collect()} == {f: pytest.approx(v, abs=1e-6) for f, v in best.items() if v >= 0}


def test_pairs_within_blocks(spark):
    placed = spark.createDataFrame([(g, g * 100 + i, [g * 100 + i], i) for g, n in ((0, 1), (1, 2), (2, 23)) for i in range(n)], "family int, rep long, items array<long>, simhash long")
    got = sorted((r.family, *sorted((r.ia[0], r.ib[0]))) for r in pairs_within(placed, "family", 3).collect())
    assert got == sorted((g, g * 100 + i, g * 100 + j) for g, n in ((1, 2), (2, 23)) for i, j in itertools.combinations(range(n), 2))
