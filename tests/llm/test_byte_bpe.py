import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken

from personweave.llm import byte_bpe


@pytest.fixture(scope="module")
def both():
    path, pattern = byte_bpe.rank_file()
    own = byte_bpe.ByteBpe.from_file(path, pattern)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return own, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def same(own, library, text):
    packed = own.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text), text[:80]
    assert own.decode(packed) == text.encode()


def test_random_texts(both):
    rng = random.Random(5)
    parts = ["a", "aa", "the", "ing", "é", "漢", "\x1c", " ", "  ", "\n", "1", "!!", "🙂", "ab", "=", "-", "'s", "　"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 120)))
        same(*both, text.replace(" ", "") if rng.random() < 0.3 else text)


@pytest.mark.parametrize("text", ["", "a" * 20_001, "ab" * 9_000, "=" * 7_001, "the" * 5_000, "x" * 4097 + "y" * 333, "漢字" * 3_000, "0" * 5_001, " " * 3_000])
def test_long_matches(both, text):
    same(*both, text)


def test_tree_of_any_bytes(both):
    """The tree alone, on byte strings, against merging the whole string."""
    own, rng = both[0], random.Random(6)
    for _ in range(2000):
        data = bytes(rng.choice(b"abcdeth \xc3\xa9e") for _ in range(rng.randint(0, 90)))
        assert own.tree(data) == (own._leaf(data) if data else [])
        assert not data or own._long_leaf(data) == own._leaf(data)


def test_query(spark, docs, both):
    rows = [(1, None), (2, ""), (2, ""), (None, "Hello world's 123"), (3, "word " * 40_000)]
    path, pattern = byte_bpe.rank_file()
    df = docs(rows).selectExpr("*", "1 AS id", "2 AS n_tokens")
    found = sorted(map(tuple, byte_bpe.round_trip(df, path, pattern).collect()), key=str)
    expected = []
    for doc, text in rows:
        ids = np.array(both[1].encode_ordinary(text or ""), "<u4")
        expected.append((doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(expected, key=str)
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(df, path, pattern), path, pattern)
    assert sorted(bytes(r["data"]).decode() for r in back.collect()) == sorted(t or "" for _, t in rows)
    assert byte_bpe.round_trip(df.limit(0), path, pattern).count() == 0
