"""Byte-level BPE encoding and decoding by ranks, with a segment tree over byte positions.

A text is cut by a pattern; each match is encoded by itself. A match that is a token as a whole is
that token. Otherwise every byte starts as a token and a segment tree over the positions holds the
rank of the pair that starts at each live position; the root names the leftmost pair of the
smallest rank. A merge updates three leaves (the merged position, its live left neighbour and the
position that dies), each along one path to the root, so a match of n bytes takes O(n log n) even
if it is one very long run. Short matches of a batch are merged side by side in numpy: one tree a
row, one merge a row and step.

Defined cases: null and empty texts have no tokens; repeated rows each give a row; very long texts
and matches are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.llm.common import small_batches
from scorelane.llm.pieces import Pieces, gather

#: Rank of a pair that doesn't merge; above every rank.
NEVER = np.int64(1) << 40
#: Matches up to this many bytes are merged side by side, longer ones one by one.
SIDE_BY_SIDE = 64


class Ranks:
    """A vocabulary of byte strings by rank, and its encoder."""

    def __init__(self, tokens: dict[bytes, int], pattern: str):
        self.tokens = tokens
        self.bytes = {i: t for t, i in tokens.items()}
        self.base = max(tokens.values()) + 1
        self.byte_ids = np.array([tokens[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in tokens.items():
            for cut in range(1, len(token)):
                a, b = tokens.get(token[:cut]), tokens.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.pieces = Pieces(pattern, self.encode_matches, b"".join)
        self.vocabulary = pa.array([self.bytes.get(i) for i in range(self.base)], pa.binary())
        self.decimals = pa.array([str(i) for i in range(self.base)], pa.string())

    @staticmethod
    def read(path: str, pattern: str) -> Ranks:
        with open(path, "rb") as f:
            return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NEVER)

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one match. tree[1] is the root; a node holds rank * width + position."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        ids: list[int] = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        none = int(NEVER) * width + width
        tree = [none] * (2 * width)

        def leaf(i: int) -> int:
            j = after[i]
            rank = self.pairs.get(ids[i] * self.base + ids[j]) if j < n else None
            return none if rank is None else rank * width + i

        for i in range(n):
            tree[width + i] = leaf(i)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def update(i: int, value: int) -> None:
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                value = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == value:
                    return
                tree[i] = value

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            update(j, none)
            update(i, leaf(i))
            if before[i] >= 0:
                update(before[i], leaf(before[i]))
        return [t for t in ids if t >= 0]

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of matches of at most SIDE_BY_SIDE bytes; a row of the arrays is a match."""
        out: list[list[int]] = [[]] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = 1
        while width < SIDE_BY_SIDE:
            width *= 2
            rows = np.flatnonzero((size <= width) & (size > width // 2 if width > 2 else size <= width))
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                for r, ids in zip(part.tolist(), self._merge_rows([pieces[r] for r in part], size[part], width), strict=True):
                    out[r] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], size: np.ndarray, width: int) -> list[list[int]]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        column = np.arange(width)
        ids = np.where(column < size[:, None], self.byte_ids[raw], -1)
        before = np.broadcast_to(column - 1, (n, width)).copy()
        after = np.broadcast_to(column + 1, (n, width)).copy()
        ids = np.concatenate([ids, np.full((n, 1), -1)], axis=1)  # a place after the last
        none = NEVER * width + width
        tree = np.full((n, 2 * width), none)
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        tree[:, width:] = np.where(rank < NEVER, rank * width + column, none)
        for i in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])

        def update(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            i = i + width
            tree[r, i] = value
            while i[0] > 1:
                i = i >> 1
                tree[r, i] = np.minimum(tree[r, 2 * i], tree[r, 2 * i + 1])

        def leaf(r: np.ndarray, i: np.ndarray) -> np.ndarray:
            rank = self._rank(ids[r, i], ids[r, np.minimum(after[r, i], width)])
            return np.where(rank < NEVER, rank * width + i, none)

        live = np.flatnonzero(tree[:, 1] < none)
        while len(live):
            rank, i = np.divmod(tree[live, 1], width)
            j = after[live, i]
            nxt = after[live, j]
            ids[live, i], ids[live, j], after[live, i] = rank, -1, nxt
            has = nxt < width
            before[live[has], nxt[has]] = i[has]
            update(live, j, np.full(len(live), none))
            update(live, i, leaf(live, i))
            prev = before[live, i]
            has = prev >= 0
            if has.any():
                update(live[has], prev[has], leaf(live[has], prev[has]))
            live = live[tree[live, 1] < none]
        alive = ids >= 0
        flat, count = ids[alive].tolist(), alive.sum(axis=1)
        ends = np.cumsum(count).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_matches(self, matches: list[str]) -> list[bytes]:
        """Packed ids of each match."""
        raw = [m.encode("utf-8") for m in matches]
        ids: list[list[int] | None] = [None if (t := self.tokens.get(r)) is None else [t] for r in raw]
        short = [k for k, r in enumerate(raw) if ids[k] is None and len(r) <= SIDE_BY_SIDE]
        for k, found in zip(short, self.merge_many([raw[k] for k in short]), strict=True):
            ids[k] = found
        done = [self.merge_one(r) if i is None else i for r, i in zip(raw, ids, strict=True)]
        return [struct.pack(f"<{len(i)}i", *i) for i in done]

    def encode_many(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text."""
        packed, codes, ends = self.pieces.encoded(texts)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ids = np.frombuffer(b"".join(packed), "<i4")[gather(sizes, codes)]
        stops = np.concatenate([[0], np.cumsum(sizes[codes])])[ends]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(ids))

    def encode(self, text: str) -> list[int]:
        return self.encode_many(pa.array([text], pa.string()))[0].as_py()

    def decode_many(self, ids: pa.ListArray) -> pa.Array:
        """Bytes of each list of ids."""
        flat = self.vocabulary.take(ids.flatten())
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, flat), b"")

    def digits_many(self, ids: pa.ListArray) -> pa.Array:
        """Decimal ids joined by commas."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.decimals.take(ids.flatten())), ",")


@lru_cache(maxsize=4)
def ranks(path: str, pattern: str) -> Ranks:
    """One vocabulary a worker process."""
    return Ranks.read(path, pattern)


def _local(path: str) -> str:
    """The vocabulary as a file of this machine: installed there, or sent along by addFile."""
    import os

    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def token_ids(text: Column, path: str, pattern: str) -> Column:
    """Array of ids of a text."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return ranks(_local(path), pattern).encode_many(texts).cast(pa.list_(pa.int32()))

    return encode(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """Bytes of an array of ids; null ids give null."""

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        r = ranks(_local(path), pattern)
        lists = lists.cast(pa.list_(pa.int32()))
        return pc.if_else(lists.is_null(), None, r.decode_many(pc.if_else(lists.is_null(), pa.scalar([], lists.type), lists))).cast(pa.binary())

    return decode(ids)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and lossless of every text, encoded then decoded.

    The digests are of the decimal ids joined by commas and of the decoded bytes. Ids stay in the
    worker, so no token array crosses to the JVM.
    """
    small_batches(docs.sparkSession)
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("lossless", pa.bool_())]

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")
    def digest(texts: pa.Array) -> pa.Array:
        r = ranks(_local(path), pattern)
        ids = r.encode_many(texts)
        back = r.decode_many(ids)
        whole = pc.fill_null(texts, "").cast(pa.binary())
        sha = lambda values: [hashlib.sha256(v.as_buffer()).hexdigest() for v in values]
        columns = [pc.list_value_length(ids), sha(r.digits_many(ids)), sha(back), pc.equal(back, whole)]
        return pa.StructArray.from_arrays([pa.array(c, t) if isinstance(c, list) else c.cast(t) for c, (_, t) in zip(columns, fields, strict=True)], fields=[pa.field(*f) for f in fields])

    return docs.select(F.col(id_col), digest(F.col(text_col)).alias("d")).select(id_col, "d.*")
