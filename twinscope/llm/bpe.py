"""Byte-level BPE encoding and decoding over an Aho-Corasick automaton of the vocabulary.

The rank file's tokens, as Latin-1 strings (one character for each byte), go into a pyahocorasick
automaton. A piece of text is encoded by taking the longest token at each position and stepping back to
the next shorter prefix, or over the token before, whenever two neighbours can't stand side by side in
the output of the merges. Whether they can is decided by undoing merges at their border and is memoised.
Each position is given up at most once, so the work is linear in the piece. The result is the one of
the rank-ordered merges, because a sequence of tokens whose neighbours are all compatible is unique.

A batch's texts are cut into spans (see splitting), and only spans that a bounded memo lacks are encoded.
The longest tokens of many pieces come from one scan of the automaton; a piece all of whose neighbours are
compatible is done, and only the others are stepped back through one by one.

Defined results: null and empty texts give no ids; texts of any length work, a run of one character
too; rows may repeat; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscope.llm.common import table
from twinscope.llm.splitting import Memo, encode_column

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Pairs of tokens whose compatibility one worker remembers before it starts anew.
MEMO_PAIRS = 300_000
#: Pieces whose longest tokens are taken in one scan, and ids that are decoded at once.
SCANNED, DECODED = 4096, 1 << 16
#: Parts pieces in a scan; no token has it, since bytes end at 255.
APART = "\u0100"

class Vocabulary:
    """Tokens, their automaton and how merges build them, for ranks given as {bytes: rank}."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.name_of = {i: b.decode("latin-1") for b, i in ranks.items()}
        self.id_of = {s: i for i, s in self.name_of.items()}
        self.length = {i: len(b) for i, b in self.bytes_of.items()}
        self.lengths = np.zeros(max(self.length) + 1, np.int64)
        self.lengths[list(self.length)] = list(self.length.values())
        self.automaton = ahocorasick.Automaton()
        for i, s in self.name_of.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.longest_name = max(map(len, self.id_of))
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.memo: dict[int, bool] = {}
        self.shorter = self._shorter()
        for i in sorted(self.name_of):
            self.parts[i] = self._split(i)

    def _shorter(self) -> dict[int, int | None]:
        """Of each token, the longest other token that it starts with."""
        out: dict[int, int | None] = {}
        for i, s in self.name_of.items():
            out[i] = next((t for n in range(len(s) - 1, 0, -1) if (t := self.id_of.get(s[:n])) is not None), None)
        return out

    def _split(self, i: int) -> tuple[int, int]:
        """The last merge that makes token i: its two parts are lower ranks that can stand side by side."""
        left, s = self.shorter[i], self.name_of[i]
        while left is not None:
            right = self.id_of.get(s[self.length[left] :])
            if right is not None and left < i and right < i and self._fits(left, right):
                self.merged[left, right] = i
                return left, right
            left = self.shorter[left]
        return i, i

    def _fits(self, left: int, right: int) -> bool:
        """Whether merges leave `left` and `right` as neighbours.

        The later-made of the two is undone, again and again, down to the border; a pair there that
        merges at a rank below that of the token just undone would have merged first.
        """
        merged, parts = self.merged, self.parts
        bound = 1 << 62
        while True:
            rank = merged.get((left, right))
            if rank is not None and rank < bound:
                return False
            left_parts, right_parts = parts.get(left, (left, left)), parts.get(right, (right, right))
            can_left, can_right = left_parts[0] != left, right_parts[0] != right
            if not can_left and not can_right:
                return True
            if can_left and (left > right or not can_right):
                bound, left = left, left_parts[1]
            else:
                bound, right = right + 1, right_parts[0]

    def fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= MEMO_PAIRS:
                self.memo.clear()
            known = self.memo[key] = self._fits(left, right)
        return known

    def longest(self, text: str, at: int) -> int:
        """The longest token at a position. Each byte is a token, so there is one."""
        window = text[at : at + self.longest_name]
        for n in range(self.automaton.longest_prefix(window), 0, -1):
            found = self.id_of.get(window[:n])
            if found is not None:
                return found
        raise ValueError("the vocabulary can't spell this piece")

    def encode(self, text: str, tokens: list[int] | None = None) -> list[int]:
        """The ids of a piece, given as Latin-1. `tokens`: longest tokens from its start on whose neighbours are known to fit."""
        whole = self.id_of.get(text)
        if whole is not None:
            return [whole]
        fits, length, shorter = self.fits, self.length, self.shorter
        open_end = bytearray(b"\1") * (len(text) + 1)
        tokens = tokens or []
        at, token, end_of_text = sum(map(length.__getitem__, tokens)), None, len(text)
        while at < end_of_text:
            if token is None:
                token = self.longest(text, at)
            before = tokens[-1] if tokens else None
            while token is not None:
                end = at + length[token]
                if open_end[end] and (before is None or fits(before, token)):
                    tokens.append(token)
                    at = end
                    break
                token = shorter[token]
            if token is not None:
                token = None
                continue
            if not tokens:
                raise ValueError("the vocabulary can't spell this piece")
            open_end[at] = 0
            token = tokens.pop()
            at -= length[token]
        return tokens

    def encode_many(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, little-endian unsigned 32-bit.

        One scan takes the longest tokens of all pieces; where all neighbours of a piece fit, these are its ids.
        """
        ends, ids = np.fromiter(itertools.chain.from_iterable(self.automaton.iter_long(APART.join(pieces))), np.int64).reshape(-1, 2).T
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        home = np.searchsorted(np.cumsum(size + 1) - 1, ends, side="right")
        covered = np.bincount(home, self.lengths[ids], len(pieces))[: len(pieces)] == size
        inner = np.flatnonzero(home[1:] == home[:-1])
        pairs, which = np.unique(ids[inner] << 32 | ids[inner + 1], return_inverse=True)
        fit = np.array([self.fits(k >> 32, k & 0xFFFFFFFF) for k in pairs.tolist()], bool)
        apart = inner[~fit[which]]
        torn, first = np.unique(home[apart], return_index=True)
        cut = np.searchsorted(home, np.arange(len(pieces) + 1))
        data = ids.astype("<u4").tobytes()
        out = [data[4 * a : 4 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for k, last in zip(torn.tolist(), apart[first].tolist(), strict=True):  # the tokens up to the first misfit stand
            if covered[k]:
                out[k] = np.array(self.encode(pieces[k], ids[cut[k] : last + 1].tolist()), "<u4").tobytes()
        for k in np.flatnonzero(~covered).tolist():
            out[k] = np.array(self.encode(pieces[k]), "<u4").tobytes()
        return out


class Codec:
    """Encodes whole texts to ids (little-endian unsigned 32-bit) and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self.spans = Memo(self.encode_spans)

    def encode_spans(self, spans: list[bytes]) -> list[bytes]:
        """The ids of each span; letters alone, or behind a blank, are one piece, others go through the pattern."""
        pieces, count = [], []
        for span in spans:
            text = span.decode()
            if (text[1:] if text[0] == " " else text).isalpha():
                pieces.append(span.decode("latin-1"))
                count.append(1)
            else:
                found = self.pattern.findall(text)
                pieces += [p.encode().decode("latin-1") for p in found]
                count.append(len(found))
        ids = [x for lo in range(0, len(pieces), SCANNED) for x in self.vocabulary.encode_many(pieces[lo : lo + SCANNED])]
        rest = iter(ids)
        return [next(rest) if n == 1 else b"".join(itertools.islice(rest, n)) for n in count]

    def encode_rows(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of rows: (first row, end row, their ids, where each row's begin)."""
        return encode_column(column, self.spans)

    def encode_bytes(self, text: str) -> bytes:
        return b"".join(ids.tobytes() for _, _, ids, _ in self.encode_rows(pa.array([text], pa.string())))

    def decoded(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes of ids, in runs of DECODED ids."""
        get = self.vocabulary.bytes_of.__getitem__
        for lo in range(0, len(ids), DECODED):
            yield b"".join(map(get, ids[lo : lo + DECODED].tolist()))

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(self.decoded(np.frombuffer(ids, "<u4")))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(read_ranks(path), pattern)


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of each row."""
    path, pattern = path or public_tokenizers.path(RANK_FILE), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for lo, hi, ids, cut in c.encode_rows(batch.column("t")):
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "ids": pa.array([ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, ids binary")


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes each whole text, decodes its ids, and returns counts and digests of both."""
    path, pattern = path or public_tokenizers.path(RANK_FILE), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for lo, hi, ids, cut in c.encode_rows(batch.column("t")):
                ids_sha, text_sha = [], []
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    ids_sha.append(hashlib.sha256(ids[a:b].tobytes()).hexdigest())
                    text = hashlib.sha256()
                    for data in c.decoded(ids[a:b]):
                        text.update(data)
                    text_sha.append(text.hexdigest())
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "n_tokens": pa.array(np.diff(cut), pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, RESULT)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
