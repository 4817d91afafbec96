"""Best-fit packing by sums of squares: documents, as token pieces, into sequences of fixed capacity.

Tokenising is one narrow pass. Its small result (no text) is checkpointed, counted, and dealt evenly to
shards of about SHARD_PIECES pieces, whatever the ids or texts are; each shard is packed on its own in
bounded memory. Placed from the longest to the shortest piece, a shard wastes less than one sequence
on the tables here, that is below 0.1 %.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import checkpointed, map_texts

CAPACITY = 2048
SHARD_PIECES = 10_000
#: Words and their parts that a worker remembers, twice as many at most: what was not met among the last so many is forgotten.
CACHE_WORDS, CACHE_PARTS = 300_000, 100_000

_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Below U+0250 every character is stable under NFC and lower-cases alone, so words can be split here.
_PLAIN = re.compile(r"[\x00-\u024f]*\Z")
_SIGNS = frozenset(".,;:!?")
#: Python's split() takes these four for white space, the tokenizer does not.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")


def _byte_letters() -> dict[int, int]:
    """Byte-level tokenizers show each byte as a letter: printable ones as they are, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of a tokenizer that drops white space, remembered word by word.

    Normalising, splitting and merging never reach across white space, so a text's ids are those of
    its words. Words below U+0250 are split here and only their parts go to the model; all other
    words, and texts that hold an added token such as <|endoftext|>, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        #: Tokens that the library takes out of a text before it normalises and splits the rest.
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.model, self.letters = self.whole.model, _byte_letters()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = self.old_parts.get(part)
            if found is None:
                shown = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
                found = self._pack([t.id for t in self.model.tokenize(shown)])
            self.parts[part] = found
        return found

    def _word(self, word: str) -> bytes:
        found = self.old_words.get(word)
        if found is None:
            if not word.isascii() and not _PLAIN.match(word):
                found = self._pack(self.whole.encode(word, add_special_tokens=False).ids)
            else:
                low = word.lower()
                # letters alone, or with one sign at their end, split without the pattern
                if low.isalpha():
                    found = self._part(low)
                elif low[-1] in _SIGNS and low[:-1].isalpha():
                    found = self._part(low[:-1]) + self._part(low[-1])
                else:
                    found = b"".join(map(self._part, _SPLIT.findall(low)))
        self.words[word] = found
        return found

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if _SEPARATORS.search(text) or any(t in text for t in self.added):
            return self._pack(self.whole.encode(text, add_special_tokens=False).ids)
        if len(self.words) > CACHE_WORDS:
            self.old_words, self.words = self.words, {}
        if len(self.parts) > CACHE_PARTS:
            self.old_parts, self.parts = self.parts, {}
        get, word = self.words.get, self._word
        return b"".join([get(w) or word(w) for w in text.split()])


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, slot[, ids]): each document's ids and end_id, cut at capacity.

    Null text counts as empty: one piece that holds end_id alone. Repeated rows are documents of their
    own. slot numbers the pieces of a task; pieces are dealt out by it.
    """

    def make() -> Callable:
        encode, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        task = TaskContext.get()
        state = {"slot": (task.partitionId() if task else 0) * 7919}
        width = 4 * capacity

        def work(ids: list, texts: list) -> list:
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(ids, texts, strict=True):
                packed = encode(text or "") + end
                for piece, at in enumerate(range(0, len(packed), width)):
                    own = packed[at : at + width]
                    for column, value in zip(out, (doc, piece, at // 4, len(own) // 4, zlib.crc32(own), state["slot"], own), strict=True):
                        column.append(value)
                    state["slot"] += 1
            return out if keep_ids else out[:6]

        return work

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "slot", "ids"][: 6 + keep_ids]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 6 + keep_ids]
    return map_texts(docs, make, "doc_id long, piece int, start long, length long, ids_crc32 long, slot long" + ", ids binary" * keep_ids, names, types, id_col, text_col)


def sum_of_squares(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length, placed in the given order.

    Among the open bins that a piece fits, it goes where the sum of the squared numbers of open bins
    per residual gap becomes smallest, ties to the smallest gap; a bin is opened only where it fits
    none. Moving a bin from gap g to g - s changes the sum by 2 (n[g - s] - n[g]) + 2; filling it up,
    by 1 - 2 n[g].
    """
    open_at = np.zeros(capacity + 1, np.int64)
    stacks: dict[int, list[int]] = {}
    bins, offsets, opened = [], [], 0
    never = np.iinfo(np.int64).max
    for s in lengths:
        change = 2 * (open_at[: capacity - s + 1] - open_at[s:]) + 2
        change[0] = 1 - 2 * open_at[s]
        change[open_at[s:] == 0] = never
        k = int(change.argmin())
        if change[k] == never:
            own, gap, opened = opened, capacity, opened + 1
        else:
            gap = s + k
            own = stacks[gap].pop()
            open_at[gap] -= 1
        bins.append(own)
        offsets.append(capacity - gap)
        if gap > s:
            stacks.setdefault(gap - s, []).append(own)
            open_at[gap - s] += 1
    return bins, offsets


def _pack_shard(capacity: int) -> Callable[[pa.Table], pa.Table]:
    def pack(table: pa.Table) -> pa.Table:
        order = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("slot", "ascending")])
        bins, offsets = sum_of_squares(order.column("length").to_pylist(), capacity)
        first = order.column("shard")[0].as_py() << 32
        order = order.append_column("sequence_id", pa.array([first + b for b in bins], pa.int64()))
        return order.append_column("offset", pa.array(offsets, pa.int64())).drop_columns(["slot", "shard"])

    return pack


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False, shard_pieces: int = SHARD_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): all documents packed.

    A document's ids by the tokenizer file `path`, then end_id. Only documents longer than `capacity`
    are cut, into pieces of that length; the last may be shorter. The offsets in a sequence are
    gapless from 0. Null and empty text: one piece that holds end_id. Repeated rows are packed each.
    A null id stays null. An empty table gives an empty one. Columns other than id and text, of any
    name, are not read.
    """
    pieces = checkpointed(token_pieces(docs, path, capacity, end_id, keep_ids, id_col, text_col))
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.col("slot"), F.lit(shards)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return dealt.groupBy("shard").applyInArrow(_pack_shard(capacity), schema)


def word_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
