"""Operators on few large groups."""

import numpy as np
import zstandard

from twinscope.llm import click_windows, near_dups


def test_near_dups_hot_cell(monkeypatch):
    """Texts with one common passage share buckets without being linked: a cell's links are those of all pairs, and its texts aren't read pair by pair."""
    rng = np.random.default_rng(5)
    passage = ["is", "onhe"] * 40
    texts = [" ".join([*passage, *(f"w{x}" for x in rng.integers(0, 10**6, 60))]) for _ in range(300)]
    texts += [" ".join(w if k % 30 else f"v{rng.integers(10**6)}" for k, w in enumerate(t.split())) for t in texts[:40]]
    read = []

    class Counted(near_dups.Words):
        def __init__(self, text):
            read.append(text)
            super().__init__(text)

    words = [near_dups.Words(t.encode()) for t in texts]
    nodes = np.frombuffer(b"".join(k.to_bytes(16, "big") for k in range(len(texts))), near_dups.NODE)
    keys = np.zeros((len(texts), near_dups.SKETCHES), np.int64)
    bins = np.frombuffer(b"".join(near_dups.profile(w.kmers) for w in words), near_dups.PROFILE)
    zipped = np.array([zstandard.compress(t.encode()) for t in texts], object)
    expected = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if words[a].like(words[b])}
    assert len(expected) == 40
    monkeypatch.setattr(near_dups, "Words", Counted)
    for size in (near_dups.TILE_WORDS, 5000):  # one tile of texts, and many
        monkeypatch.setattr(near_dups, "TILE_WORDS", size)
        read.clear()
        links = near_dups.cell_links(nodes, 0, np.zeros(len(texts), int), bins, keys, nodes, zipped)
        assert {tuple(int.from_bytes(x, "big") for x in link) for link in links} == expected
        assert len(read) < len(texts)


def test_near_dups_rounds(spark, monkeypatch):
    """Texts that share buckets without being linked are verified with their centres only; what is left is aligned in its cells, and only the classes that this joins are labelled anew."""
    rng = np.random.default_rng(8)
    passage = [f"p{x}" for x in range(60)]
    texts = [" ".join([*passage, *(f"w{x}" for x in rng.integers(0, 10**6, 30))]) for _ in range(30)]
    texts += [" ".join(w if k % 30 else f"v{rng.integers(10**6)}" for k, w in enumerate(t.split())) for t in texts[:10]]
    verified, labelled = [], []
    verify, components = near_dups.verify, near_dups.components
    monkeypatch.setattr(near_dups, "verify", lambda pairs, texts: verified.append(pairs.count()) or verify(pairs, texts))
    monkeypatch.setattr(near_dups, "components", lambda *links: labelled.append(links[0].count()) or components(*links))
    rows = near_dups.classes(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    words = [near_dups.Words(t.encode()) for t in texts]
    smallest = [*range(len(texts))]
    linked = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if words[a].like(words[b])]
    for _ in texts:
        for a, b in linked:
            smallest[a] = smallest[b] = min(smallest[a], smallest[b])
    assert len(linked) >= 10 and {r.doc_id: r.class_id for r in rows} == dict(enumerate(smallest))
    assert len(verified) == 1 and verified[0] <= len(texts)
    assert len(labelled) <= 2 and sum(labelled[1:]) < len(linked)


def test_click_windows_memory(spark, tmp_path):
    """Copies are cut into batches without a sort, and a page of windows takes less than half a megabyte."""
    rows = spark.range(300).selectExpr("id AS click_id", *(f"timestamp_seconds(1700000000 + 3600 * id) AS {c}" for c in ("ts", "arrived_at")), "id % 5 AS client_id", "'view' AS kind", "1.5D AS value", "'{}' AS props")
    rows.write.parquet(f"{tmp_path}/clicks.parquet")
    done = spark._jsparkSession.sharedState().statusStore()
    before = done.executionsList().size()
    assert click_windows.op12_click_windows(spark, str(tmp_path)).count() >= 300
    plans = [done.executionsList().apply(k).physicalPlanDescription() for k in range(before, done.executionsList().size())]
    cuts = [p for p in plans if "/cut" in p and "InsertIntoHadoopFsRelationCommand" in p and "batch" in p.split("InsertIntoHadoopFsRelationCommand")[-1] and "sha2" in p]
    assert cuts and not any("Sort" in p for p in cuts)
    assert click_windows.WINDOW.itemsize * click_windows.BUCKET_EVENTS / click_windows.PAGES < 1 << 19
