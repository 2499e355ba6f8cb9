"""Pairs of sets by cells of two blocks: all of them, without anything sent or written for a pair."""

import itertools
import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinscope.functions import cells
from twinscope.operators import blocks, pairs


def made(seed=7, n=150):
    """Sets of few words each, with near copies, common words, copies and empty ones."""
    rnd = random.Random(seed)
    common, sets = [rnd.getrandbits(63) for _ in range(5)], []
    for k in range(n):
        base = list(sets[rnd.randrange(k)]) if k > 10 and k % 3 else [rnd.getrandbits(63) for _ in range(rnd.randrange(1, 30))]
        for _ in range(rnd.randrange(3)):
            if base:
                base[rnd.randrange(len(base))] = rnd.getrandbits(63)
        sets.append(set(base) | set(rnd.sample(common, rnd.randrange(4))) if k % 40 else set())
    return sets, [rnd.getrandbits(64) - (1 << 63) for _ in sets]


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 40)
    monkeypatch.setattr(blocks, "BUCKET", 20)


def test_pairs_of_blocks(spark, few):
    """Every threshold against all pairs, with copies counted as one set, and what sets carry."""
    sets, prints = made()
    prints = [prints[sets.index(s)] ^ (k % 7 == 0) for k, s in enumerate(sets)]  # of copies, that of the smallest key counts
    rows = [(k, sorted(s), prints[k], k % 3) for k, s in enumerate(sets)]
    held = blocks.in_blocks(spark.createDataFrame(rows, "key long, items array<long>, simhash long, lang long"))
    assert held.count == 4
    reps, members = {}, {}
    for k, s in enumerate(sets):
        members.setdefault(reps.setdefault(frozenset(s), k), []).append(k)
    table = {r.rep: r for r in held.table().collect()}
    assert {r: t.members for r, t in table.items()} == {r: len(m) for r, m in members.items()}
    for s, r in reps.items():
        # what no other set has isn't kept
        assert set(table[r]["items"]) == {i for i in s if sum(i in o for o in reps) > 1} and table[r].n == len(s)
    value = {"jaccard": lambda a, b, both: both / len(a | b), "overlap": lambda a, b, both: both / min(len(a), len(b)), "cosine": lambda a, b, both: both / (len(a) * len(b)) ** 0.5}
    every = [(x, y) for x, y in itertools.combinations([s for s in reps if s], 2)]
    for lows in ({"jaccard": 0.2}, {"jaccard": 0.4}, {"jaccard": 0.9}, {"overlap": 0.5, "simhash": 0.78}, {"cosine": 0.6, "jaccard": 0.5}):
        want = set()
        for x, y in every:
            a, b = sorted((reps[x], reps[y]))
            far = ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count()
            if any((1 - far / 64 if m == "simhash" else value[m](x, y, len(x & y))) >= t for m, t in lows.items()):
                sizes = (len(x), len(y)) if reps[x] < reps[y] else (len(y), len(x))
                want.add((a, b, *sizes, len(x & y), len(members[a]), len(members[b]), far, sum(p % 3 == q % 3 for p in members[a] for q in members[b])))
        found = blocks.pairs_of(held, lows, ("simhash", "lang"))
        got = [tuple(r) for r in found.collect()]
        assert set(got) == want and len(got) == len(want) > 5, lows
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan  # neither matches nor candidates are sent


def test_parts_of_a_cell(monkeypatch):
    """A cell holds a bounded number of matches, whatever all sets have in common."""
    monkeypatch.setattr(cells, "MATCHES", 50)
    monkeypatch.setattr(cells, "COUNTS", 400)
    rnd = random.Random(3)
    hot = rnd.getrandbits(62)
    sets = [sorted({hot, *(rnd.getrandbits(62) for _ in range(k % 3))}) for k in range(40)]
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    one = cells.Block(pa.table({"rep": range(40), "n": [len(s) for s in sets], "members": [1] * 40, "items": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))}))
    want = {(a, b) for a, b in itertools.combinations(range(40), 2) if len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.3}
    for search in (cells.near_sets(one, one, True, 0.3), cells.told_sets(one, one, True, {"jaccard": 0.3})):
        parts = [list(zip(x.tolist(), y.tolist(), strict=True)) for x, y, _ in search]
        assert sum(map(len, parts)) == len(want) and {p for part in parts for p in part} == want
        assert max(map(len, parts)) <= 400


def test_forests(spark, few):
    """Components of all pairs from far fewer edges."""
    sets, prints = made(9, 200)
    hot = [random.Random(1).getrandbits(62) for _ in range(20)]
    sets += [{*hot, k} for k in range(60)]
    prints += [5] * 60
    held = blocks.in_blocks(spark.createDataFrame([(k, sorted(s), p) for k, (s, p) in enumerate(zip(sets, prints, strict=True))], "key long, items array<long>, simhash long"))
    lows = {"jaccard": 0.4, "overlap": 0.75, "simhash": 0.8}
    edges = blocks.forest_of(held, lows, 3, len(sets) - 1).collect()

    def joined(pairs):
        root = {}
        find = lambda k: k if root.setdefault(k, k) == k else find(root[k])
        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {k: find(k) for k in root}

    every = pairs.reached(blocks.pairs_of(held, lows, ("simhash",)), lows)
    values = pairs.metrics.of_pairs()
    for m, t in lows.items():
        want = [(r.a, r.b) for r in every.where(values[m] >= t).collect()]
        assert joined((e.a, e.b) for e in edges if e.metric == m) == joined(want)
        for p in range(2):
            assert joined((e.a, e.b) for e in edges if e.metric == m and e.part == p) == joined((a, b) for a, b in want if b * 3 // len(sets) == p)
    assert sum(e.metric == "jaccard" for e in edges) < 700 < every.count()


def test_done_jobs_leave_no_shuffles(spark):
    """What is kept has its shuffles deleted."""
    from twinscope.operators.storage import cut

    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    held = lambda: {name for d in root for _, _, names in os.walk(d.getPath()) for name in names if name.startswith("shuffle_")}
    before = held()
    kept = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(100):
        if held() <= before:
            break
        time.sleep(0.1)  # Spark deletes them beside
    assert held() <= before and {r["count"] for r in kept.collect()} == {142, 143}


def test_sizes_whose_product_is_large(spark):
    """Cosine of sets of over 46 340 items each."""
    row = spark.createDataFrame([(100_000, 90_000, 60_000)], "n int, m int, both int")
    assert abs(row.select(pairs.metrics.cosine(F.col("n"), F.col("m"), F.col("both")).alias("v")).first().v - 60_000 / (9e9) ** 0.5) < 1e-12


def test_verdicts_arent_joined(spark):
    """Cases aren't sent to be compared with themselves under another metric, nor found anew by their languages."""
    from twinscope.plans.queries import QUERIES

    for name in ("verdict_changes", "verdict_tally", "best_setting", "threshold_sweep"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.split("\n") if "Join" in line]
        assert name != "verdict_changes" and name != "verdict_tally" or not joins, name
        assert len(joins) <= 1, name  # the grid of thresholds


def test_items_arent_kept_for_asymmetry(spark, monkeypatch):
    """Of all units only the class is kept, not the items."""
    from twinscope.operators import asymmetry

    kept, cut = [], asymmetry.cut
    monkeypatch.setattr(asymmetry, "cut", lambda df: kept.append(df.columns) or cut(df))
    rows = [("a", "s", "f1", True, ["x", "y", "z"]), ("b", "s", "f2", False, ["x", "y", "z", "w"]), ("c", "s", "f3", False, [])]
    found = asymmetry.asymmetric(spark.createDataFrame(rows, "unit string, scope string, file string, has_sort boolean, identifiers array<string>"), "scope")
    assert [tuple(r) for r in found.collect()] == [("a", 1)]
    assert kept and not any("items" in c for c in kept)
