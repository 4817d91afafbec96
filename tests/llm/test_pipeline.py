import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from personweave.llm import packing, secret_scan, simhash
from personweave.llm.batches import exists, shared_folder

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "secret_scans", "best_fit_packing"]
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    first = stages["language_id"](spark, docs, SF).cache()
    assert first.columns == columns and first.count() > 0.95 * docs.where("text rlike '[a-z]'").count()
    assert all(any(map(str.isalpha, t)) for t in rows(first).values())

    second = stages["line_dedup"](spark, first, SF).cache()
    assert second.columns == columns
    seen, expected = set(), {}
    for doc, text in sorted(rows(first).items()):
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            gone |= {i, i + 1, i + 2} if w in seen and any(w) else set()
            seen.add(w)
        if not gone or len(gone) < len(lines):
            expected[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    assert rows(second) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in second.collect())

    third = stages["simhash_near_dedup"](spark, second, SF).cache()
    prints = {d: simhash.fingerprint(t, 5) for d, t in expected.items()}
    root = {d: d for d in prints}
    for _ in range(8):
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 6:
                    root[a] = root[b] = min(root[a], root[b])
    kept = {d: t for d, t in expected.items() if root[d] == d}
    assert third.columns == columns and rows(third) == kept

    fourth = stages["secret_scans"](spark, third, SF).cache()
    assert fourth.columns == columns and rows(fourth) == {d: secret_scan.redact(t) for d, t in kept.items()}
    assert not any(secret_scan.find(t) for t in rows(fourth).values())

    packed = stages["best_fit_packing"](spark, fourth, SF).collect()
    tok = packing.tokenizer(packing.word_file())
    own = [tok(t) + b"\0\0\0\0" for t in rows(fourth).values()]
    pieces = sorted(zlib.crc32(p[a : a + 8192]) for p in own for a in range(0, len(p), 8192))
    assert sorted(r["ids_crc32"] for r in packed) == pieces
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)


def test_empty_documents(spark, docs):
    df = docs([(1, "x")]).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, SF)
    assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == 0


def test_stages_take_nulls_repeats_and_columns_of_any_name(spark, docs):
    text = "the house of the man and the dog by the river was old\nand it stood there for years and years\nwith the door open"
    df = docs([(1, text), (1, text), (2, text + "\nand more of it"), (3, None), (4, ""), (None, "token = abcdef123 of the other man and his son"), (5, "le chat et la souris dans la maison", None), (6, "the long road " * 9000)])
    odd = ["__n_lines", "__n_removed", "__id", "__th", "__text_hash", "__row_text", "__k_id", "__k_n", "a.b"]
    for k, name in enumerate(odd):
        df = df.withColumn(name, F.lit(f"v{k}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        alone = stage(spark, df, SF)
        assert alone.columns == df.columns, name
        assert all(r[n] == f"v{k}" for r in alone.collect() for k, n in enumerate(odd))
        df = alone.cache()
    rows = {r["doc_id"]: r for r in df.collect()}
    assert 3 not in rows and 4 not in rows and 1 in rows and rows[None]["text"].startswith("[SECRET] of the other")
    assert rows[2]["text"] == "and more of it" and rows[2]["n_chars"] == 14
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, df, SF).collect()} == set(rows)


def test_a_failed_run_goes_on(spark, monkeypatch):
    folder = f"{shared_folder(spark)}/resumed"
    calls, stages = [], corpus_pipeline.STAGES
    logged = lambda name, stage: lambda *args: (calls.append(name), stage(*args))[1]

    def broken(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, broken if n == "secret_scans" else logged(n, f)) for n, f in stages])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, SF, folder)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, logged(n, f)) for n, f in stages])
    found = corpus_pipeline.run(spark, SF, folder).count()
    assert calls == ["language_id", "line_dedup", "simhash_near_dedup", "secret_scans", "best_fit_packing"]
    assert found == corpus_pipeline.run(spark, SF).count()
    assert not exists(spark, f"{folder}/staged-simhash_near_dedup") and not exists(spark, f"{folder}/line_dedup")
