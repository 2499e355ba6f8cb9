"""Classifiers, language ID, near duplicates, search and the pipeline, by held-out accuracy or brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinscope.llm import langid, lexical, multi_index, near_dups, quality, toxicity
from twinscope.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "!!!", "a", "word " * 4000, "Ünïcödé", "é" * 50, "漢字", "😀"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 1, "clash", 3) for i, t in enumerate(ODD)] + [(None, "none", None, None, None, "c", 1), (5, "a", "en", "s", 1, "clash", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string, held_out int")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, "/root/testdata/sf0.01", "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, "/root/testdata/sf0.01", "labels")


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier(spark, docs, labels, odd, module, label):
    model = module.train(docs, labels)
    got = module.score_documents(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    right = (got.predicted == got[label]).mean()
    assert right >= 0.93, right
    scored = module.score_documents(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert len({r.score for r in scored if r.doc_id == 5}) == 1
    kept = (module.keep_good if module is quality else module.keep_clean)(odd.unionByName(docs.limit(50), allowMissingColumns=True), labels)
    assert kept.columns == odd.columns
    assert module.train(docs, labels.limit(0)) in (0.5, 0.0)
    assert module.score_documents(odd.limit(0), model).count() == 0


def test_gradient():
    """Hand-written gradients against differences."""
    rng = np.random.default_rng(2)
    x, bags, y = rng.standard_normal((9, 4)).astype(np.float32), np.array([1, 3, 5]), np.array([0, 1, 1], np.float32)
    net = quality.Attention(4)
    for a in net.p:
        net.p[a] = net.p[a].astype(np.float64)
    net.p["b"] += 0.1

    def loss():
        p = quality.sigmoid(net.forward(x.astype(np.float64), bags)[-1])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = net.gradient(x, bags, y)
    for name, a in net.p.items():
        flat = a.reshape(-1)
        for k in range(0, len(flat), max(1, len(flat) // 5)):
            flat[k] += 1e-5
            up = loss()
            flat[k] -= 2e-5
            down = loss()
            flat[k] += 1e-5
            assert abs((up - down) / 2e-5 - grad[name].reshape(-1)[k]) < 1e-4, name


def test_isotonic():
    at, value = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert at.tolist() == [1, 2.5, 4] and value.tolist() == [0, 0.5, 1]


def test_words():
    text = "Über the ÉTÉ, the x1".encode()
    raw = np.frombuffer(text, np.uint8)
    starts, ends = lexical.word_bounds(lexical.LETTER[raw], np.array([0, len(raw)]))
    assert [text[a:b].decode() for a, b in zip(starts, ends, strict=True)] == ["Über", "the", "ÉTÉ", "the", "x"]
    h = lexical.span_hash(lexical.prefix_sums(lexical.lower(raw)), starts, ends)
    assert (h == lexical.hash_words(["über", "the", "été", "the", "x"])).all() and h[1] == h[3]


def test_langid(spark, docs, odd):
    model = langid.learn(docs)
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() >= 0.97
    rows = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert {d for d, p, s in rows if p == "und" and s == 0} == {0, 1, 2, 3, 4, 10}
    assert langid.learn(docs.limit(0)) is None and {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}


def test_bloom():
    """Every entry is found, and corrected counts of strangers are near zero."""
    rng = np.random.default_rng(3)
    entries = [rng.integers(0, 1 << 31, 3000) for _ in range(11)]
    f = langid.Filters([f"l{k}" for k in range(11)], entries)
    for k, e in enumerate(entries):
        assert ((f.masks(e)[:, k // 8] >> (k % 8)) & 1).all()
    strangers = f.masks(rng.integers(1 << 31, 1 << 32, 20000))
    rate = np.array([((strangers[:, k // 8] >> (k % 8)) & 1).mean() for k in range(11)])
    assert (np.abs(rate - f.false_rate) < 0.01).all()


def edited(words, rng, share):
    return [w if rng.random() > share else "edit" + str(rng.integers(1e6)) for w in words]


@pytest.mark.parametrize("block", [near_dups.BLOCK, 3])
def test_near_dups(spark, monkeypatch, block):
    """Against all pairs; with small blocks, so that buckets are dealt into many."""
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rng = np.random.default_rng(9)
    vocabulary = [f"w{k}" for k in range(3000)]
    shared = list(rng.choice(vocabulary, 60))
    texts = {}
    for g in range(12):
        base = list(rng.choice(vocabulary, 200))
        for _ in range(8):
            texts[len(texts)] = " ".join(edited(base, rng, rng.choice([0, 0.005, 0.01, 0.02, 0.06])))
    for _ in range(60):  # one passage in many documents
        texts[len(texts)] = " ".join([*rng.choice(vocabulary, 60), *shared, *rng.choice(vocabulary, 60)])
    for t in ("", "", "...", "one two", "One, TWO!", "one two three", None, None):
        texts[len(texts)] = t
    docs = spark.createDataFrame([(k, t, "c") for k, t in texts.items()], "doc_id long, text string, node string")
    got = {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()}
    words = {k: near_dups.Words((t or "").encode()) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in texts:
        for b in range(a):
            if texts[a] is not None and texts[b] is not None and (texts[a] == texts[b] or words[a].like(words[b])):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {k: root(k) for k in texts}
    kept = near_dups.keep_one(docs.unionByName(docs.limit(3)))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*got.values()})
    assert near_dups.classes(docs.limit(0)).count() == 0


def test_alignment():
    a, b = (near_dups.Words(" ".join(f"w{k}" for k in order).encode()) for order in (range(60), range(59, -1, -1)))
    assert near_dups.alignment(a, a) == 1.0 and a.like(a)
    assert near_dups.alignment(a, b) < 0.05
    assert near_dups.longest_rise([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    rng = np.random.default_rng(4)
    for _ in range(200):  # against the table of the longest common subsequence
        x, y = (rng.integers(0, 6, rng.integers(0, 25)).tolist() for _ in range(2))
        row = np.zeros(len(y) + 1, int)
        for w in x:
            new = row.copy()
            for k, v in enumerate(y):
                new[k + 1] = row[k] + 1 if v == w else max(new[k], row[k + 1])
            row = new
        assert near_dups.common_length(x, y) == row[-1]


def changed(words, rng, share, how):
    words = list(words)
    for _ in range(round(share * len(words))):
        k = int(rng.integers(len(words)))
        if how == "replaced":
            words[k] = f"new{rng.integers(10**6)}"
        elif how == "dropped":
            words.pop(k)
        else:
            words.insert(int(rng.integers(len(words))), words.pop(k))
    return words


def test_near_copies_are_found(spark):
    """Copies with 1 to 10 of 100 words replaced, dropped or moved; unrelated texts and texts that share a passage stay apart."""
    rng = np.random.default_rng(12)
    vocabulary = [f"w{k}" for k in range(4000)]
    texts, planted = {}, []
    passage = list(rng.choice(vocabulary, 80))
    for share in (0.01, 0.02, 0.04, 0.06, 0.08, 0.1):
        for how in ("replaced", "dropped", "moved"):
            for _ in range(12):
                base = list(rng.choice(vocabulary, 300))
                for words in (base, changed(base, rng, share, how)):
                    texts[len(texts)] = " ".join(words)
                planted.append((len(texts) - 2, len(texts) - 1, share, how))
    apart = range(len(texts), len(texts) + 60)
    for k in apart:
        texts[k] = " ".join([*rng.choice(vocabulary, 100), *passage, *rng.choice(vocabulary, 100)])
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()}
    found = [got[a] == got[b] for a, b, _, _ in planted]
    assert np.mean(found) >= 0.95
    for share in (0.01, 0.02, 0.04, 0.06, 0.08, 0.1):
        assert np.mean([f for f, (_, _, s, _) in zip(found, planted, strict=True) if s == share]) >= 0.85
    mates = {a: {a, b} for a, b, _, _ in planted} | {b: {a, b} for a, b, _, _ in planted}
    assert all(got[k] in mates.get(k, {k}) for k in texts)  # nothing else is linked


def test_labels_of_kmers():
    rep = near_dups.labelled_kmers(np.zeros(50, np.uint64) + np.uint64(7))
    assert len(np.unique(rep)) == len(rep) == 46


def test_search(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16)).astype(np.float32) * rng.uniform(0.2, 3, (600, 1)).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(1000 + 20 * i, [float(v) for v in x[7]], 0) for i in range(60)]  # many copies
    rows += [(2001, None, 0), (2002, [], 0), (2003, [0.0] * 16, 0), (2020, [float("nan")] * 16, 0), (2040, [None] * 16, 0), (None, [1.0] * 16, 0), (20, rows[20][1], 0)]
    got = multi_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")).toPandas()
    ids = np.array([r[0] for r in rows[:660]])
    full = np.array([r[1] for r in rows[:660]], float)
    hits = total = 0
    for q, own in got.sort_values("rank").groupby("query_id"):
        score = full @ full[ids == q][0]
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score.round(9)))[:20]]
        hits, total = hits + len({*best} & {*own.vec_id}), total + 20
        assert len(own) == 20 and (np.diff(own.score) <= 1e-12).all() and own["rank"].tolist() == list(range(1, 21))
    assert set(got.query_id) == {i for i in ids if i % 20 == 0} and hits / total >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in multi_index.search(few).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]
    assert multi_index.search(few.limit(0)).count() == 0


def test_short_vectors(spark):
    """A shorter vector counts as ending in zeros."""
    rows = spark.createDataFrame([(0, [1.0, 2.0, 2.0]), (1, [3.0]), (2, [0.0, 1.0]), (20, [5.0, 5.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in multi_index.search(rows).collect()}
    assert got == {(0, 1): (20, 15.0), (0, 2): (1, 3.0), (0, 3): (2, 2.0), (20, 1): (0, 15.0), (20, 2): (1, 15.0), (20, 3): (2, 5.0)}


@pytest.mark.parametrize("n,clusters", [(2000, 0), (10_000, 0), (50_000, 0), (10_000, 40)])
def test_recall(spark, monkeypatch, n, clusters):
    """Recall against brute force, and the share of the entries that queries take."""
    rng = np.random.default_rng(n + clusters)
    x = rng.standard_normal((n, 32)) if not clusters else rng.standard_normal((clusters, 32))[rng.integers(0, clusters, n)] + 0.15 * rng.standard_normal((n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = multi_index.Quantiser(x[:: max(1, n // 20_000)], 1.0)
    monkeypatch.setattr(multi_index, "ENTRY_BLOCK", 700)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 1500)
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    step = 20 if n < 50_000 else 200
    found = {}
    for r in multi_index.search(frame, F.col("vec_id") % step == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, n, step):
        score = x @ x[q]
        score[q] = -9
        hits += len(found[q] & {*np.argpartition(-score, 20)[:20].tolist()})
    recall = hits / (20 * len(found))
    print(f"n={n} clusters={clusters} share={model.share:.3f} recall={recall:.3f}")
    assert len(found) == len(range(0, n, step)) and recall >= 0.9
    assert model.share < (0.15 if clusters else 0.6)


def test_blocks():
    held = np.array([[3, 0, 9000], [4000, 200, 5]])
    blocks = multi_index.Blocks(held)
    seen = {}
    for one in range(2):
        for two in range(3):
            own = blocks.of_entries(np.full(held[one, two], one), np.full(held[one, two], two), np.arange(held[one, two]))
            assert {*own.tolist()} <= {*blocks.of_cells([(one, two)]).tolist()}
            for b, n in zip(*np.unique(own, return_counts=True), strict=True):
                seen[int(b)] = seen.get(int(b), 0) + int(n)
    assert sum(seen.values()) == held.sum() and max(seen.values()) <= 2 * multi_index.ENTRY_BLOCK
    assert len(blocks.of_cells([])) == 0


def test_traverse():
    rng = np.random.default_rng(6)
    a, b, held = rng.random(9), rng.random(7), rng.integers(0, 4, (9, 7))
    cells, reach = multi_index.traverse(a, b, held, 10**9)
    ranked = [(s, i, j) for s, i, j in sorted((a[i] + b[j], i, j) for i in range(9) for j in range(7)) if held[i, j]]
    assert cells == [(i, j) for _, i, j in ranked] and reach == ranked[-1][0]
    some, reach = multi_index.traverse(a, b, held, 20)
    assert some == cells[: len(some)] and sum(held[c] for c in some) >= 20 > sum(held[c] for c in some[:-1]) and reach == ranked[len(some) - 1][0]


def test_pipeline(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert 4 <= len(stages) <= 5 and corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    known = {r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect()}
    assert {r.doc_id for r in out.collect()} <= known
    bad = table(spark, SF, "labels").where((F.col("quality") == 0) & (F.col("doc_id") >= 0)).select("doc_id")
    assert out.join(bad, "doc_id").count() <= 0.2 * bad.count()
