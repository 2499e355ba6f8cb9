"""Pairs of sets counted block against block, in numpy over Arrow batches.

Sets are named by 64 bits (`mark`) of their items, so copies are one. An item that no other set has can't be shared:
such items are found first and left out, and those that stay are ordered by the number of sets that have them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from twinscope.functions.hashing import BASE, list_rows, mixed

#: About so many items are of one row that is sent.
ITEMS = 4096
#: At most about so many matches of items, or counts of pairs, are held at once.
MATCHES, COUNTS = 1 << 22, 1 << 21
#: What a set may carry: the fingerprint, the group that its documents are counted by, the signature, the family.
CARRIED = {"simhash": pa.int64(), "lang": pa.int64(), "signature": pa.list_(pa.int64()), "family": pa.int64()}


def set_marks(items: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """64 bits of each set of items given end to end, whatever their order."""
    n = np.diff(cut)
    sums = np.zeros(len(n), np.uint64)
    if len(items):
        sums[n > 0] = np.add.reduceat(mixed(items.view(np.uint64) + BASE), cut[:-1][n > 0])
    return mixed(sums + n.astype(np.uint64) * BASE).view(np.int64)


def deal(values: np.ndarray, parts: int) -> np.ndarray:
    return ((mixed(values.view(np.uint64)) >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)


def lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.asarray(ends, np.int32), pa.array(values))


def runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    n = len(sorted_columns[0])
    new = np.zeros(max(0, n - 1), bool)
    for c in sorted_columns:
        new |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [n])) if n else np.zeros(1, np.int64)


def grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The value and the parts of each run of rows of one value."""
    at, held = None, []
    for batch in batches:
        values = batch.column(column).to_numpy()
        edges = runs(values)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if held and values[lo] != at:
                yield at, held
                held = []
            at = values[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield at, held


def flat(parts: list[pa.RecordBatch], column: str, kind: type = np.int64) -> np.ndarray:
    found = [p.column(column).drop_null() for p in parts]
    return np.concatenate([(c.flatten() if pa.types.is_list(c.type) else c).to_numpy(zero_copy_only=False) for c in found]).astype(kind, copy=False)


def sent(count: int, fields: dict[str, pa.DataType], **given: pa.Array) -> pa.RecordBatch:
    return pa.record_batch({c: given.get(c, pa.nulls(count, kind)) for c, kind in fields.items()})


def fields_of(first: str, carried: list[str]) -> dict[str, pa.DataType]:
    """Of what is sent: rows of items (marks; of each its number, or of each item its `counts`) and rows of one set each (mark, key and more)."""
    listed = {"marks": pa.list_(pa.int64()), "counts": pa.list_(pa.int32()), "items": pa.list_(pa.int64())}
    return {first: pa.int32(), **listed, "mark": pa.int64(), "key": pa.int64(), "n": pa.int32(), "members": pa.int64()} | {c: CARRIED[c] for c in carried}


def dealt_items(batches: Iterator[pa.RecordBatch], buckets: int, carried: list[str]) -> Iterator[pa.RecordBatch]:
    """Items in buckets, with the sets that have them, from (key, members, items and what is carried)."""
    fields = fields_of("bucket", carried)
    for whole in batches:
        sizes = np.diff(list_rows(whole.column("items"))[1])
        parts = np.cumsum(sizes) // (ITEMS * buckets)
        edges = runs(parts)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            batch = whole.slice(a, b - a)
            items, cut = list_rows(batch.column("items"))
            n, mark = np.diff(cut), set_marks(items, cut)
            yield sent(len(n), fields, bucket=pa.array(deal(mark, buckets)), mark=pa.array(mark), n=pa.array(n.astype(np.int32)), **{c: batch.column(c) for c in ("key", "members", *carried)})
            if not len(items):
                continue
            bucket, home = deal(items, buckets), np.repeat(np.arange(len(n)), n)
            order = np.argsort(bucket, kind="stable")
            bucket, home, items = bucket[order], home[order], items[order]
            at, each = runs(bucket), runs(bucket, home)
            yield sent(len(at) - 1, fields, bucket=pa.array(bucket[at[:-1]]), marks=lists(mark[home[each[:-1]]], np.searchsorted(each, at)), counts=lists(np.diff(each).astype(np.int32), np.searchsorted(each, at)), items=lists(items, at))


def held_items(batches: Iterator[pa.RecordBatch], blocks: int, carried: list[str]) -> Iterator[pa.RecordBatch]:
    """Of each bucket (rows in order of buckets) the items that two sets or more have, with the sets and their number, for the blocks of the sets."""
    fields = fields_of("block", carried)

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(batch.column("key").is_valid())
        return sent(batch.num_rows, fields, block=pa.array(deal(batch.column("mark").to_numpy(), blocks)), **{c: batch.column(c) for c in fields if c in ("mark", "key", "n", "members", *carried)})

    for _, parts in grouped(batches, "bucket"):
        for part in parts:
            if (out := named(part)).num_rows:
                yield out
        items = flat(parts, "items")
        marks = np.repeat(flat(parts, "marks"), flat(parts, "counts"))
        del parts
        order = np.lexsort((marks, items))
        items, marks = items[order], marks[order]
        first = runs(items, marks)[:-1]  # copies of a set are one
        items, marks = items[first], marks[first]
        edges = runs(items)
        held = np.repeat(np.diff(edges), np.diff(edges)).astype(np.int32)
        keep = np.flatnonzero(held > 1)
        items, marks, held = items[keep], marks[keep], held[keep]
        block = deal(marks, blocks)
        order = np.lexsort((marks, block))
        items, marks, held, block = items[order], marks[order], held[order], block[order]
        ends = runs(block, np.arange(len(block)) // ITEMS)
        if len(block):
            yield sent(len(ends) - 1, fields, block=pa.array(block[ends[:-1]]), marks=lists(marks, ends), counts=lists(held, ends), items=lists(items, ends))


def blocked(batches: Iterator[pa.RecordBatch], carried: list[str]) -> Iterator[pa.RecordBatch]:
    """The sets of each block (rows in order of blocks): rep, n, members, the items that other sets have too, those of few sets first, and what is carried (of `lang` the members of each)."""
    for block, parts in grouped(batches, "block"):
        info = pa.Table.from_batches([p.filter(p.column("key").is_valid()) for p in parts]).combine_chunks()
        mark, key = (info.column(c).to_numpy() for c in ("mark", "key"))
        order = np.lexsort((key, mark))
        at = runs(mark[order])
        first, names = order[at[:-1]], mark[order[at[:-1]]]
        weight = info.column("members").to_numpy()[order]
        told = {"rep": pa.array(key[first]), "n": info.column("n").take(pa.array(first)).combine_chunks(), "members": pa.array(np.add.reduceat(weight, at[:-1]))}
        for c in carried:
            if c == "lang":
                home, lang = np.repeat(np.arange(len(first)), np.diff(at)), info.column(c).to_numpy()[order]
                by = np.lexsort((lang, home))
                each = runs(home[by], lang[by])
                ends = np.searchsorted(home[by][each[:-1]], np.arange(len(first) + 1))
                told |= {"langs": lists(lang[by][each[:-1]], ends), "tally": lists(np.add.reduceat(weight[by], each[:-1]), ends)}
            else:
                told[c] = info.column(c).take(pa.array(first)).combine_chunks()
        items, held = flat(parts, "items"), flat(parts, "counts", np.int32)
        home = np.searchsorted(names, flat(parts, "marks"))
        del parts, info
        order = np.lexsort((items, held, home))
        out = pa.table({"block": pa.array(np.full(len(first), block, np.int32)), **told, "items": lists(items[order], np.r_[0, np.cumsum(np.bincount(home, minlength=len(first)))])})
        yield from out.to_batches(max_chunksize=1000)


def spread(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, filled with 0."""
    values, cut = list_rows(column)
    out = np.zeros((len(cut) - 1, width), np.int64)
    home = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    out[home, np.arange(len(values)) - cut[home]] = values
    return out


class Block:
    """The sets of a block as read."""

    def __init__(self, table: pa.Table):
        column = lambda c: table.column(c).combine_chunks() if table.column(c).num_chunks != 1 else table.column(c).chunk(0)
        self.rep, self.n, self.members = (column(c).to_numpy().astype(np.int64) for c in ("rep", "n", "members"))
        self.items, self.cut = list_rows(column("items"))
        self.simhash = column("simhash").to_numpy() if "simhash" in table.column_names else None
        self.signature = list_rows(column("signature"))[0].reshape(len(self.n), -1) if "signature" in table.column_names and len(self.n) else None
        self.family = column("family").to_numpy() if "family" in table.column_names else None
        self.langs = None
        if "langs" in table.column_names:
            width = int(np.diff(list_rows(column("langs"))[1]).max(initial=1))
            self.langs, self.tally = spread(column("langs"), width), spread(column("tally"), width)

    def first(self, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items and sets of the first n - ceil(threshold n) + 1 items of each set, and ceil(threshold n). Items that no other set has are the first of all and aren't here."""
        size = np.diff(self.cut)
        least = np.ceil(threshold * self.n - 1e-9).astype(np.int64)
        home = np.repeat(np.arange(len(size)), size)
        kept = np.arange(len(self.items)) - self.cut[home] < (size - least + 1)[home]
        return self.items[kept], home[kept], least

    def postings(self, items: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(items, kind="stable")
        return items[order], home[order]


def matches(items: np.ndarray, home: np.ndarray, values: np.ndarray, docs: np.ndarray, sets: int, rows: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """lo, hi and x, y of all pairs of sets with an item in common, once for each item, part by part of the x (at most `rows` sets and about MATCHES matches); `home` ascends, `values` are sorted."""
    lo, hi = np.searchsorted(values, items, "left"), np.searchsorted(values, items, "right")
    some = np.flatnonzero(hi > lo)
    home, lo, count = home[some], lo[some], (hi - lo)[some]
    ends = np.r_[0, np.cumsum(count)]
    at = np.searchsorted(home, np.arange(sets + 1))  # the matched items of each set
    reach = ends[at]
    a = 0
    while a < sets:
        b = int(np.searchsorted(reach, reach[a] + MATCHES, "right")) - 1
        b = min(max(a + 1, b), a + rows, sets)
        p, q = at[a], at[b]
        c = count[p:q]
        place = np.arange(ends[q] - ends[p]) - np.repeat(ends[p:q] - ends[p], c) + np.repeat(lo[p:q], c)
        yield a, b, np.repeat(home[p:q], c), docs[place]
        a = b


def near_sets(one: Block, two: Block, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """x, y, shared of all pairs of sets of two blocks with Jaccard >= threshold, by their first items; then counted."""
    items, home, least = one.first(threshold)
    other, docs, fewest = two.first(threshold)
    values, docs = two.postings(other, docs)
    for _, _, x, y in matches(items, home, values, docs, len(one.n), len(one.n)):
        long_enough = np.minimum(one.n[x], two.n[y]) >= threshold * np.maximum(one.n[x], two.n[y]) - 1e-9
        if same:
            long_enough &= x < y
        code = np.sort(x[long_enough] * len(two.n) + y[long_enough])
        edges = runs(code)
        met, code = np.diff(edges), code[edges[:-1]]
        x, y = np.divmod(code, len(two.n))
        # what isn't shared among the first items lies behind those of the set whose first items end earlier
        needed = threshold / (1 + threshold) * (one.n[x] + two.n[y]) - 1e-9
        enough = met + np.maximum(least[x], fewest[y]) - 1 >= needed
        x, y, needed = x[enough], y[enough], needed[enough]
        shared = np.zeros(len(x), np.int64)
        each = runs(x)
        for lo, hi in zip(each[:-1].tolist(), each[1:].tolist(), strict=True):
            mine = np.sort(one.items[one.cut[x[lo]] : one.cut[x[lo] + 1]])
            for k in range(lo, hi, 1024):
                ys = y[k : min(hi, k + 1024)]
                size = two.cut[ys + 1] - two.cut[ys]
                ends = np.cumsum(size)
                theirs = two.items[np.arange(ends[-1]) + np.repeat(two.cut[ys] - ends + size, size)]
                spot = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                shared[k : k + len(ys)] = np.add.reduceat((mine[spot] == theirs).astype(np.int64), ends - size)
        reached = shared >= needed
        yield x[reached], y[reached], shared[reached]


RATIOS = {
    "jaccard": lambda n, m, both: both / (n + m - both),
    "cosine": lambda n, m, both: both / np.sqrt(n * m),
    "overlap": lambda n, m, both: both / np.minimum(n, m),
    "dice": lambda n, m, both: 2 * both / (n + m),
}


def told_sets(one: Block, two: Block, same: bool, thresholds: dict[str, float]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """x, y, shared of all pairs of sets of two blocks that reach one threshold at least, by the counts of all of their items."""
    values, docs = two.postings(two.items, np.repeat(np.arange(len(two.n)), np.diff(two.cut)))
    width = max(1, len(two.n))
    bits = int((1 - thresholds["simhash"]) * 64 + 1e-9) if "simhash" in thresholds else None
    for lo, hi, x, y in matches(one.items, np.repeat(np.arange(len(one.n)), np.diff(one.cut)), values, docs, len(one.n), max(1, COUNTS // width)):
        both = np.bincount((x - lo) * width + y, minlength=(hi - lo) * width)
        del x, y
        at = np.flatnonzero(both)
        x, y = np.divmod(at, width)
        n, m, shared = one.n[lo + x], two.n[y], both[at]
        reached = np.zeros(len(at), bool)
        for name, t in thresholds.items():
            if name in RATIOS:
                reached |= RATIOS[name](n, m, shared) >= t - 1e-9
        at = at[reached]
        if bits is not None:
            far = np.bitwise_count(one.simhash[lo:hi, None].view(np.uint64) ^ two.simhash[None, :].view(np.uint64))
            close = np.flatnonzero(far.ravel() <= bits)
            at = np.union1d(at, close)
        x, y = np.divmod(at, width)
        x += lo
        kept = (one.n[x] > 0) & (two.n[y] > 0)
        if same:
            kept &= x < y
        yield x[kept], y[kept], both[at[kept]]


def told_fields(carried: list[str]) -> dict[str, pa.DataType]:
    more = {"simhash": ("hamming", pa.int32()), "lang": ("positives", pa.int64()), "signature": ("agree", pa.int32())}
    base = {"a": pa.int64(), "b": pa.int64(), "n_a": pa.int32(), "n_b": pa.int32(), "shared": pa.int32(), "members_a": pa.int64(), "members_b": pa.int64()}
    return base | dict(more[c] for c in carried)


def told(one: Block, two: Block, x: np.ndarray, y: np.ndarray, shared: np.ndarray, carried: list[str]) -> pa.RecordBatch:
    """Pairs as rows, the smaller rep first."""
    turned = one.rep[x] > two.rep[y]
    side = lambda c: (np.where(turned, getattr(two, c)[y], getattr(one, c)[x]), np.where(turned, getattr(one, c)[x], getattr(two, c)[y]))
    (a, b), (n_a, n_b), (members_a, members_b) = side("rep"), side("n"), side("members")
    out = {"a": a, "b": b, "n_a": n_a, "n_b": n_b, "shared": shared, "members_a": members_a, "members_b": members_b}
    if "simhash" in carried:
        out["hamming"] = np.bitwise_count((one.simhash[x] ^ two.simhash[y]).view(np.uint64))
    if "signature" in carried:
        out["agree"] = np.count_nonzero(one.signature[x] == two.signature[y], axis=1) if len(x) else x
    if "lang" in carried:
        out["positives"] = np.zeros(len(x), np.int64)
        for p in range(one.langs.shape[1]):
            mine = np.flatnonzero(one.tally[x, p])
            for q in range(two.langs.shape[1]):
                u, v = x[mine], y[mine]
                out["positives"][mine] += np.where(one.langs[u, p] == two.langs[v, q], one.tally[u, p] * two.tally[v, q], 0)
    return pa.record_batch({c: pa.array(out[c]).cast(kind) for c, kind in told_fields(carried).items()})


def family_floors(one: Block, two: Block, same: bool) -> Iterator[tuple[int, tuple[float, ...]]]:
    """A family and the least value of each metric (jaccard, cosine, overlap, dice, simhash) among its pairs of two blocks of sets with a `family`, part by part."""
    members = [np.split(np.argsort(b.family, kind="stable"), runs(np.sort(b.family))[1:-1]) for b in (one, two)]
    named = [{int(b.family[m[0]]): m for m in found if len(m)} for b, found in zip((one, two), members, strict=True)]
    for family in named[0].keys() & named[1].keys():
        x, y = named[0][family], named[1][family]
        if same and len(x) < 2:
            continue
        parts = [(np.concatenate([b.items[b.cut[k] : b.cut[k + 1]] for k in m]), np.repeat(np.arange(len(m)), b.cut[m + 1] - b.cut[m])) for b, m in ((one, x), (two, y))]
        order = np.argsort(parts[1][0], kind="stable")
        width = len(y)
        for lo, hi, p, q in matches(*parts[0], parts[1][0][order], parts[1][1][order], len(x), max(1, COUNTS // width)):
            both = np.bincount((p - lo) * width + q, minlength=(hi - lo) * width).reshape(-1, width)
            n, m = one.n[x[lo:hi], None], two.n[None, y]
            far = np.bitwise_count((one.simhash[x[lo:hi], None] ^ two.simhash[None, y]).view(np.uint64))
            values = [f(n, m, both) for f in RATIOS.values()] + [1 - far / 64]
            if same:
                other = x[lo:hi, None] != y[None, :]
                values = [v[other] for v in values]
            yield family, tuple(float(v.min()) for v in values)


class Forest:
    """Components of the sets of two blocks, from pairs in parts: what holds a component together is one edge for each set but its first."""

    def __init__(self, sets: int):
        self.label = np.arange(sets)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        label = self.label
        while len(x):
            one, two = label[x], label[y]
            apart = one != two
            x, y, one, two = x[apart], y[apart], one[apart], two[apart]
            np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
            while len(x) and (label[label] != label).any():
                label[:] = label[label]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        y = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.label[y], y


def reaches(one: Block, two: Block, x: np.ndarray, y: np.ndarray, shared: np.ndarray, metric: str, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold of a metric, exactly."""
    if metric in RATIOS:
        return RATIOS[metric](one.n[x], two.n[y], shared) >= threshold
    return 1 - np.bitwise_count((one.simhash[x] ^ two.simhash[y]).view(np.uint64)) / 64 >= threshold
