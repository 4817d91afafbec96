import math
import random

import numpy as np

from personweave.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    good = [(i, [math.floor(1024 * x) for x in np.asarray(v, np.float32).astype(float)]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in sorted(good):
        if i % every == 0:
            asked.setdefault(i, v)
    out = []
    for q, x in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in good if i != q)  # noqa: B905  shorter vectors lack the last terms
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, k=10, every=100):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(rows, SCHEMA), k, every).collect())


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(8)], 0) for i in range(900)]
    assert run(spark, rows, 10, 100) == brute(rows, 10, 100)


def test_ties_nulls_and_short_vectors(spark):
    v = [0.5, 0.25]
    rows = [(0, v, 1), (5, v, 1), (3, v, 1), (3, v, 1), (100, [1.0], 1), (200, [], 1), (7, None, 1), (None, v, 1), (8, [None, 1.0], 1), (9, [float("nan"), 1.0], 1), (300, [float("inf"), 0.0], 1), (100, [0.5], None)]
    assert run(spark, rows) == brute(rows, 10, 100)


def test_blocks_of_queries(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(topk, "CELL_QUERIES", 2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)], 0) for i in range(150)]
    assert run(spark, rows, 5, 3) == brute(rows, 5, 3)


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0], 0)]) == []
    empty = spark.createDataFrame([], SCHEMA).selectExpr("*", "1 AS query_id", "2 AS ids")
    assert topk.top_k(empty).count() == 0


def test_components_beyond_64_bits(spark):
    rows = [(0, [1e300, 0.0]), (1, [1.0, 0.0]), (2, [-1e300, 1.0]), (100, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cells = {k: [max(-(2**63 - 1024), min(2**63 - 1024, int(x * 1024 // 1))) for x in v] for k, v in rows}
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    score = lambda a, b: wrap(sum(x * y for x, y in zip(cells[a], cells[b], strict=True)))
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(df).collect()}
    assert found == {(q, v): score(q, v) for q in (0, 100) for v in (0, 1, 2, 100) if v != q}


def test_no_block_goes_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)], 0) for i in range(300)]
    df = topk.top_k(spark.createDataFrame(rows, SCHEMA), 5, 3)
    assert sorted(tuple(r) for r in df.collect()) == brute(rows, 5, 3)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_few_queries_among_many_candidates_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    rows = [(100 * i + 1, [0.1, 0.2], 0) for i in range(200)] + [(0, [0.5, 0.5], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = []
    kept = topk.F.spark_partition_id
    monkeypatch.setattr(topk, "_cells", lambda k: parts.append(k) or _count_rows)
    found = topk.top_k(df).select("score", kept()).collect()
    assert parts == [10] and len(found) > 1 and max(r["score"] for r in found) < 8


def _count_rows(batches):
    n = sum(batch.num_rows for batch in batches)
    if n:
        yield topk.pa.RecordBatch.from_pydict({"query_id": topk.pa.array([n], topk.pa.int64()), "vec_id": topk.pa.array([n], topk.pa.int64()), "score": topk.pa.array([n], topk.pa.int64())})


def test_best_of_many_blocks_with_equal_and_wide_scores():
    rng = np.random.default_rng(4)
    ids, cells = rng.permutation(400), rng.integers(-2, 3, (400, 4))
    cells[ids % 7 == 0] *= 1 << 40
    asked = ids[:60].copy()
    best = topk.Best(asked, topk._narrow(cells[:60]), 9)
    for at in range(0, 400, 25):
        best.meet(ids[at : at + 25], topk.Postings(topk._narrow(cells[at : at + 25])))
    whole = cells[:60] @ cells.T
    expected = [(int(q), int(i), int(s)) for q, row in zip(asked, whole, strict=True) for s, i in sorted(((s, i) for s, i in zip(row, ids, strict=True) if i != q), key=lambda x: (-int(x[0]), x[1]))[:9]]
    assert list(zip(asked[best.rows].tolist(), best.found.tolist(), best.scores.tolist(), strict=True)) == expected
