import random
import zlib

import numpy as np
import pytest

from personweave.llm import packing


@pytest.fixture(scope="module")
def tok():
    return packing.tokenizer(packing.word_file())


def test_words_equal_whole_texts(tok):
    rng = random.Random(1)
    parts = ["a", "A", "'S", "'ll", "É", "ß", "Σ", "ς", "漢", "\x1c", "\x85", "\xa0", " ", "\n", "1", "!!", "🙂", "İ", "é", "\x00", "<|endoftext|>", "</w>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(tok(text), "<u4").tolist() == tok.whole.encode(text, add_special_tokens=False).ids


def test_added_tokens_as_in_the_library(tok):
    from tokenizers import Tokenizer

    fresh, rng = Tokenizer.from_file(packing.word_file()), random.Random(3)
    ids = lambda t: np.frombuffer(tok(t), "<u4").tolist()
    assert ids("a <|endoftext|> b") == [320, 49407, 321]
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "endoftext", "|>", "a", "É", "'s", " ", "\n", "1", "!", "漢", "\x1c"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        assert ids(text) == fresh.encode(text, add_special_tokens=False).ids, text


def brute(lengths, capacity):
    """Sum of squares, by counting all bins anew for each choice."""
    bins = []
    for s in lengths:
        fitting = [k for k, used in enumerate(bins) if used + s <= capacity]
        if not fitting:
            bins.append(s)
            continue

        def cost(k):
            after = [u + (s if j == k else 0) for j, u in enumerate(bins)]
            counts = {}
            for u in after:
                counts[u] = counts.get(u, 0) + (0 < capacity - u)
            return sum(v * v for v in counts.values()), capacity - bins[k]

        best = min(fitting, key=cost)
        bins[best] += s
    return bins


def test_sum_of_squares_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.randint(5, 40)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 50))]
        bins, offsets = packing.sum_of_squares(lengths, capacity)
        fill = {}
        for b, o, s in zip(bins, offsets, lengths, strict=True):
            assert fill.get(b, 0) == o
            fill[b] = o + s
        assert sorted(fill.values()) == sorted(brute(lengths, capacity))


def check(rows, found, tok, capacity):
    expected = sorted(zlib.crc32(p[a : a + 4 * capacity]) for _, t in rows for p in [tok(t or "") + b"\0\0\0\0"] for a in range(0, len(p), 4 * capacity))
    assert sorted(r["ids_crc32"] for r in found) == expected
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return by


def test_whole_and_few_sequences(spark, docs, tok):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 90)))) for i in range(400)]
    rows += [(1, None), (1, None), (None, ""), (7, "word " * 5000)]
    found = packing.pack_documents(docs(rows), packing.word_file(), capacity=64, shard_pieces=150, keep_ids=True).collect()
    by = check(rows, found, tok, 64)
    total = sum(r["length"] for r in found)
    assert len(by) <= -(-total // 64) + 2 * 4
    long = sorted((r["piece"], r["start"], r["length"]) for r in found if r["doc_id"] == 7 and r["length"] == 64)
    assert [p[1] for p in long] == [64 * p[0] for p in long]
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in found)


def test_empty_table_and_clashing_columns(spark, docs, tok):
    df = docs([(1, "a b")]).selectExpr("*", "1 AS slot", "2 AS shard", "3 AS length")
    assert packing.pack_documents(df, packing.word_file()).first()["length"] == 3
    assert packing.pack_documents(df.limit(0), packing.word_file()).count() == 0
