"""Byte-level BPE by monoid tree reduction.

Each match of the split pattern is a byte string. Its halves are encoded recursively and joined: while
the pair of tokens at the seam would be merged, the bytes around it are encoded anew in a window that
grows by doubling, until the pair of tokens at either edge of the window stands when encoded alone. A token
sequence is the encoding of its bytes exactly if each adjacent pair is the encoding of its own bytes,
so tokens outside the window then provably stay. Decoding concatenates up a tree.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .batches import map_texts

#: Byte strings up to this length are leaves of the tree.
LEAF = 16
#: Matches and pairs that a worker remembers; then it starts anew.
CACHE = 400_000


class ByteBpe:
    """Encoder and decoder of a rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes_of = ranks, {v: k for k, v in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)

    def _leaf(self, data: bytes) -> list[int]:
        """Merges the adjacent pair of lowest rank, leftmost first, until no pair has a rank."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        if len(data) > 8 * LEAF:
            return self._long_leaf(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _long_leaf(self, data: bytes) -> list[int]:
        """The same by a heap over a linked list, for windows that had to grow far."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at: list[int | None] = [None] * n
        heap: list[tuple[int, int]] = []

        def offer(i: int) -> None:
            r = ranks.get(data[i : end[end[i]]]) if end[i] < n else None
            rank_at[i] = r
            if r is not None:
                heappush(heap, (r, i))

        for i in range(n):
            offer(i)
        while heap:
            r, i = heappop(heap)
            if rank_at[i] != r:
                continue
            gone = end[i]
            end[i], rank_at[gone] = end[gone], None
            if end[i] < n:
                before[end[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def _stands(self, a: int, b: int) -> bool:
        """Whether the two tokens are the encoding of their bytes."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            found = self.pairs[a, b] = self._leaf(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self._stands(left[-1], right[0]):
            return left + right
        i, j = 1, 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self._leaf(b"".join(self.bytes_of[t] for t in left[-i:] + right[:j]))
            good_left = i == len(left) or self._stands(left[-i - 1], window[0])
            good_right = j == len(right) or self._stands(window[-1], right[j])
            if good_left and good_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if good_left else 2 * i, j if good_right else 2 * j

    def tree(self, data: bytes) -> list[int]:
        """The ids of one match."""
        if len(data) <= LEAF:
            return self._leaf(data) if data else []
        middle = len(data) // 2
        return self._join(self.tree(data[:middle]), self.tree(data[middle:]))

    def _match(self, match: str) -> bytes:
        packed = array("I", self.tree(match.encode())).tobytes()
        if len(match) <= 64:
            if len(self.known) > CACHE:
                self.known.clear()
            self.known[match] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        get, match = self.known.get, self._match
        return b"".join([get(m) or match(m) for m in self.split(text)])

    def decode(self, packed: bytes) -> bytes:
        """The bytes of such ids: neighbours are concatenated level by level."""
        ids, of = array("I", packed), self.bytes_of
        level = [b"".join([of[t] for t in ids[i : i + 1024]]) for i in range(0, len(ids), 1024)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


_ENCODERS: dict[tuple[str, str], ByteBpe] = {}


def encoder(path: str, pattern: str) -> ByteBpe:
    """One for each worker process, file and pattern."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = ByteBpe.from_file(path, pattern)
    return _ENCODERS[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): ids of each whole text, as little-endian unsigned 32-bit integers.

    Null and empty text: no ids. Repeated rows and null ids stay. Other columns are not read.
    """

    def make() -> Callable:
        own = encoder(path, pattern)
        return lambda ids, texts: [ids, [own.encode(t or "") for t in texts]]

    return map_texts(docs, make, "doc_id long, ids binary", ["doc_id", "ids"], [pa.int64(), pa.binary()], id_col, text_col)


def decode_ids(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data binary): the bytes of each row's ids; null ids give no bytes."""

    def make() -> Callable:
        own = encoder(path, pattern)
        return lambda ids, packed: [ids, [own.decode(p or b"") for p in packed]]

    return map_texts(df, make, "doc_id long, data binary", ["doc_id", "data"], [pa.int64(), pa.binary()], id_col, ids_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to.

    Encodes and decodes as encode_texts and decode_ids do, in one pass; only digests leave the worker.
    """

    def make() -> Callable:
        own = encoder(path, pattern)
        digest = lambda x: hashlib.sha256(x).hexdigest()

        def work(ids: list, texts: list) -> list:
            packed = [own.encode(t or "") for t in texts]
            return [ids, [len(p) // 4 for p in packed], [digest(p) for p in packed], [digest(own.decode(p)) for p in packed]]

        return work

    return map_texts(docs, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()], id_col, text_col)


def rank_file() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
