import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from personweave.llm import simhash
from personweave.llm.components import component_roots


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute(prints):
    """(id, fingerprint) -> component of each."""
    component = [i for i, _ in prints]
    changed = True
    while changed:
        changed = False
        for a, (_, x) in enumerate(prints):
            for b, (_, y) in enumerate(prints):
                if (x ^ y).bit_count() <= 4 and component[a] != component[b]:
                    component[a] = component[b] = min(component[a], component[b])
                    changed = True
    return component


def test_fingerprints():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["Ab", "c", "É", " ", "\t", "\n", "\x1c", "\xa0", "D"]) for _ in range(rng.randint(0, 80)))
        assert simhash.fingerprint(text) == slow_fingerprint(text), repr(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    long = " ".join(str(i) for i in range(20_000))
    assert simhash.fingerprint(long) == slow_fingerprint(long)


def test_embedding_bounds_the_distance():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    counts = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * k)) & np.uint64(3)) for k in range(32)]).astype(int)
    manhattan = np.abs(counts(a) - counts(b)).sum(0)
    assert (np.bitwise_count(simhash.embed(a) ^ simhash.embed(b)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def test_every_close_pair_shares_a_cell():
    rng = random.Random(3)
    for z in (1, 2, 3):
        masks = simhash.grid_masks(z)
        for _ in range(2000):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            u, v = (int(simhash.embed(np.array([x], np.uint64))[0]) for x in (a, b))
            assert any(u & m == v & m for m in masks)


def clusters(rng, n):
    out = []
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << bit
            out.append(x)
    return out


def test_links_against_all_pairs(spark):
    rng = random.Random(4)
    values = sorted(set(clusters(rng, 40)) | {0})
    classes = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    expected = brute(list(enumerate(values)))
    for n, members in ((len(values), 10_000), (len(values), 3), (simhash.GRIDS[0] + 1, 10_000), (simhash.GRIDS[1] + 1, 5)):
        pairs = simhash.links(classes, n, cell_members=members)
        for r in pairs.collect():
            assert ((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count() <= 4
        roots = {r["node"]: r["root"] for r in component_roots(pairs).collect()}
        groups = {}
        for i, v in enumerate(values):
            s = simhash.signed(v)
            groups.setdefault(roots.get(s, s), set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted([i for i, c in enumerate(expected) if c == k] for k in set(expected))


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (1001, 1000)]
    found = {r["node"]: r["root"] for r in component_roots(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 201)) and all(found[1000 + i] == 1000 for i in range(1, 300))
    assert component_roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, docs):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    base = [rng.choice(words) for _ in range(400)]
    rows = [(50, " ".join(base)), (7, " ".join([*base[:-1], "other"])), (9, " ".join(base).upper()), (9, " ".join(base).upper()), (1, "quite another text of words"), (2, None), (3, ""), (4, "\n"), (None, "lone words here")]
    found = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs(rows).selectExpr("*", "1 AS fp")).collect()), key=str)
    prints = [(10**9 if d is None else d, simhash.fingerprint(t)) for d, t in rows]
    component = brute(prints)
    expected = [(d, f"{p:016x}", None if c == 10**9 else c) for (d, _), (_, p), c in zip(rows, prints, component, strict=True)]
    assert found == sorted(expected, key=str)
    assert simhash.near_duplicates(docs(rows).limit(0)).count() == 0


def test_one_of_each_group_stays(spark, docs):
    rows = [(4, "a b c d e"), (4, "a b c d e"), (6, "A B C D E"), (5, None), (8, ""), (9, "f g h i"), (9, "other words altogether here"), (None, "nobody has this one")]
    df = docs(rows).withColumn("fp", F.lit("mine")).withColumn("th", F.lit(1))
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    found = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert found == sorted([(4, "a b c d e"), (5, None), (9, "f g h i"), (9, "other words altogether here"), (None, "nobody has this one")], key=str)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_columns_named_like_those_inside(spark, docs):
    odd = ["__row_text", "__k_id", "__k_th", "__k_n", "th", "fp", "root", "n", "a.b", "component_id"]
    df = docs([(4, "a b c d e"), (4, "a b c d e"), (6, "A B C D E"), (None, "nobody has this one")])
    for k, name in enumerate(odd):
        df = df.withColumn(name, F.lit(f"v{k}"))
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == {4, None} and len(rows) == 2
    assert all(r[name] == f"v{k}" for r in rows for k, name in enumerate(odd))


def test_hot_keys_join_as_others_do(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_KEYS", 3)
    rows = spark.createDataFrame([(i, 1) for i in range(5000)] + [(i, 2 + i % 7) for i in range(900)], "id long, k long")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    found = simhash.join_by_hot_key(rows, groups, "k", 5900)
    assert found.count() == 5900 and found.where("least = if(k = 1, 0, k - 2)").count() == 5900
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 2


def test_shingles_of_other_lengths():
    text = "a b c d e f"
    assert simhash.fingerprint(text, 6) == simhash.fingerprint("a b c d e f", 9) == xxhash.xxh64_intdigest(text.encode(), 42)
    assert simhash.fingerprint(text, 5) != simhash.fingerprint(text, 4)
