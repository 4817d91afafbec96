import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from personweave.llm import language_id

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, language_id.train(docs)


def test_held_out_accuracy(trained):
    docs, model = trained
    found = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out()).where("lang_pred <> 'und'").collect()
    right = sum(r["lang_pred"] == r["lang"] for r in found)
    assert len(found) > 150 and right / len(found) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)
    assert sum(r["accepted"] for r in found) / len(found) > 0.98


def test_fold_and_bounds(spark, docs, monkeypatch):
    ids = [r[0] for r in docs([(i, "x") for i in range(200)]).where(language_id.held_out()).select("doc_id").collect()]
    assert sorted(ids) == [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    monkeypatch.setattr(language_id, "DICTIONARY_BYTES", 50)
    model = language_id.train(docs([(i, f"some words number {i}", "en" if i % 2 else "xx") for i in range(60)]))
    assert set(model.dictionaries) == {"en", "xx"} and max(map(len, model.dictionaries.values())) == 50


def test_smallest_size_wins():
    model = language_id.LanguageModel({"aa": language_id.letters("lorem ipsum dolor sit amet " * 20), "bb": language_id.letters("quick brown foxes jump over lazy dogs " * 20)})
    text = "the quick brown foxes jump"
    sizes = {}
    for lang, content in model.dictionaries.items():
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(language_id.COARSE[0], write_content_size=0, write_checksum=0, write_dict_id=0)
        sizes[lang] = len(zstandard.ZstdCompressor(dict_data=own, compression_params=params).compress(language_id.letters(text)))
    assert model.sizes(language_id.letters(text), language_id.COARSE) == sizes
    assert model.classify(text)[0] == "bb" == min(sizes, key=sizes.get)
    assert model.classify("quick brown ipsum lorem dolor " * 3000)[1] > 0
    tie = language_id.LanguageModel({"aa": b"same", "bb": b"same"})
    assert tie.classify("whatever") == ("aa", 0.0)


def test_edges(spark, docs, trained):
    model = trained[1]
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the"), (4, "the"), (None, "est que les des " * 20), (5, "the and of " * 60_000)]
    df = docs(rows).selectExpr("*", "1 AS margin", "2 AS id")
    found = language_id.identify(df, model).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 and not by[k]["accepted"] for k in (1, 2, 3))
    assert by[None]["lang_pred"] == "fr" and by[5]["lang_pred"] == "en"
    kept = language_id.keep_identified(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found if r["accepted"]}
    none = language_id.train(docs([(1, None), (2, "text", None)]))
    assert language_id.identify(df, none).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(df.limit(0), model).count() == 0


def test_sample_is_that_of_ranking_everything(spark, docs):
    rng = random.Random(1)
    # a language of many rows, one of few, one of which one row fills nearly all
    rows = [(i, f"text {rng.random()}", "aa") for i in range(4000)] + [(i, f"few {i}", "bb") for i in range(5)] + [(1, "same", "cc")] * 3000 + [(i, f"other {i}", "cc") for i in range(40)]
    own = docs(rows).select(F.col("lang"), F.xxhash64("doc_id", "text").alias("h"), "text")
    found = {(r["lang"], r["text"]) for r in language_id._sample(own, 20, None).collect()}
    expected = set()
    for lang in ("aa", "bb", "cc"):
        expected |= {(lang, t) for _, t in sorted({(r["h"], r["text"]) for r in own.where(F.col("lang") == lang).collect()})[:20]}
    assert found == expected
    assert language_id._sample(own.limit(0), 20, None).count() == 0


def test_rows_shuffled_for_the_sample_do_not_grow_with_partitions(spark, docs, monkeypatch):
    rows = docs([(i, f"text {i}", "en") for i in range(6000)]).select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    plans = []
    stage = language_id.checkpointed
    monkeypatch.setattr(language_id, "checkpointed", lambda df: (plans.append(df), stage(df))[1])
    first, second = ({r["text"] for r in language_id._sample(rows.repartition(n), 20, None).collect()} for n in (2, 64))
    assert first == second and len(plans) == 2
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        # no text is dealt by language before the bound is applied
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    below = rows.where(F.col("h") <= int((2 * 4 * 20 / 6000 - 1) * (1 << 63))).count()
    assert 20 <= below < 200


def test_pieces_come_from_the_whole_text(spark, docs):
    text = "".join(f"{k:05d}" for k in range(4000))
    got = docs([(1, text), (2, "short"), (3, "")]).select("doc_id", language_id._spread(F.col("text"), 800).alias("t")).collect()
    by = {r["doc_id"]: r["t"] for r in got}
    pieces = by[1].split(" ")
    assert len(pieces) == 8 and all(len(p) == 100 and p in text for p in pieces) and text.startswith(pieces[0]) and text.endswith(pieces[-1])
    assert by[2] == "short" and by[3] == ""
    words = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(4000))
    train = lambda chars: language_id.train(docs([(i, f"{words} {i}", "en") for i in range(1, 4)]), sample_chars=chars, dictionary_bytes=1 << 20).dictionaries["en"]
    assert len(train(None)) > 3 * 20_000 and len(train(800)) < 3 * 1000
