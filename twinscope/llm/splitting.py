"""Texts cut into spans where the public splitting pattern always cuts, and ids of whole columns by span.

A span is a run of whole matches of the pattern, whatever stands around it, so its ids can be looked up.
Cuts are found by byte classes in numpy: letters (ASCII and the Latin-1 ones), digits, signs and white
space; next to any other character there is no cut but the one before white space. The spans of a pass
become a dictionary, only its distinct entries are encoded, and the ids of all rows are gathered from
them. A text of more than PASS_BYTES is cut into passes at blanks between letters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from twinscope.llm.common import byte_chunks
from twinscope.llm.lexical import safe_cuts

PASS_BYTES = 1 << 20
#: Spans that a memo holds at most, in two halves, and the longest that it keeps.
MEMO_SPANS, LONGEST_KEPT = 240_000, 48
# Byte classes: 0 other, 1 letter, 2 digit, 3 sign, 4 white space, 5 white space to some engines only.
OTHER, LETTER, DIGIT, SIGN, SPACE, ODD = range(6)
CLASS = np.zeros(256, np.uint8)
CLASS[33:127] = SIGN
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[28:32] = ODD
#: First two bytes of the characters beyond ASCII that may be white space, or stand with such in a block.
ODD_PAIRS = ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A, 0xA0)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,)))


def classes(raw: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8 text."""
    out = CLASS[raw]
    wide = np.flatnonzero(raw[:-1] >= 0xC2) if len(raw) else np.zeros(0, np.int64)
    if not len(wide):
        return out
    lead, second = raw[wide], raw[wide + 1]
    letter = wide[(lead == 0xC3) & (second != 0x97) & (second != 0xB7)]  # all but the signs of times and division
    out[letter] = out[letter + 1] = LETTER
    for first, seconds in ODD_PAIRS:
        odd = wide[(lead == first) & np.isin(second, seconds)]
        for k in range(2 if first == 0xC2 else 3):
            out[odd[odd + k < len(out)] + k] = ODD
    return out


def span_starts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where spans begin, those of all rows; each row that isn't empty begins one."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes(raw)
    inner = np.ones(n + 1, bool)  # False where a row begins or all end
    inner[offs] = False
    cut = np.zeros(n, bool)
    before, here = kind[:-1], kind[1:]
    space = kind == SPACE
    sure = ~space & (kind != ODD)
    word = (kind >= LETTER) & (kind <= SIGN)
    # before white space, and between words' classes, but not behind an apostrophe that letters follow
    cut[1:] = (sure[:-1] & space[1:]) | (word[:-1] & word[1:] & (before != here) & ~((raw[:-1] == 39) & (here == LETTER)))
    # the last of some white space belongs to what follows, unless it isn't a blank
    last = space[:-1] & sure[1:] & inner[1:-1]
    several = np.zeros(n - 1, bool)
    several[1:] = space[:-2] & inner[1:-2]
    cut[:-1] |= last & several
    clear = np.ones(n - 1, bool)
    clear[1:] = (kind[:-2] != ODD) | ~inner[1:-2]
    cut[1:] |= last & (raw[:-1] != 32) & clear
    cut |= ~inner[:-1]
    return np.flatnonzero(cut)


class Memo:
    """Ids of spans as bytes, bounded: when the younger half is full, it becomes the older one and that is forgotten."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], most: int = MEMO_SPANS):
        self.make, self.half = make, most // 2
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __call__(self, spans: list[bytes]) -> list[bytes]:
        """The ids of distinct spans; `make` is asked once for those that aren't known."""
        young, old = self.young.get, self.old.get
        out = [young(s) or old(s) for s in spans]
        lacking = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(lacking, self.make([spans[k] for k in lacking]), strict=True):
            out[k] = ids
        if len(self.young) + len(spans) > self.half:
            self.old, self.young = self.young, {}
        self.young.update((s, ids) for s, ids in zip(spans[: self.half], out, strict=False) if len(s) <= LONGEST_KEPT)
        return out


def encode_pass(raw: np.ndarray, offs: np.ndarray, ids_of: Callable[[list[bytes]], list[bytes]], starts_of: Callable = span_starts) -> tuple[np.ndarray, np.ndarray]:
    """The ids of consecutive rows and where each row's begin (one more than rows)."""
    starts = starts_of(raw, offs)
    if not len(starts):
        return np.zeros(0, "<u4"), np.zeros(len(offs), np.int64)
    bounds = np.r_[starts, len(raw)].astype(np.int32)
    spans = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    found = ids_of(spans.dictionary.to_numpy(zero_copy_only=False).tolist())
    flat = np.frombuffer(b"".join(found), "<u4")
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    first = np.cumsum(sizes) - sizes
    own = spans.indices.to_numpy()
    n = sizes[own]
    ends = np.r_[0, np.cumsum(n)]
    ids = flat[np.arange(ends[-1]) + np.repeat(first[own] - ends[:-1], n)]
    return ids, ends[np.searchsorted(starts, offs)]


def encode_column(column: pa.Array, ids_of: Callable[[list[bytes]], list[bytes]], limit: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows: (first row, end row, their ids, where each row's begin). Nulls count as empty."""
    for lo, hi, raw, offs in byte_chunks(column, limit):
        if hi - lo == 1 and len(raw) > limit:
            cuts = safe_cuts(raw, limit)
            parts = [encode_pass(raw[a:b], np.array([0, b - a]), ids_of)[0] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            ids = np.concatenate(parts)
            yield lo, hi, ids, np.array([0, len(ids)])
        else:
            yield lo, hi, *encode_pass(raw, offs, ids_of)
