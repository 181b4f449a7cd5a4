"""Exact top-k against brute force."""

import math
import random

import numpy as np

from runsift.llm import topk


def brute(queries, rows, k):
    def clean(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    out = []
    vectors = [(i, clean(v)) for i, v in rows]
    best = {}
    for i, v in queries:
        v = clean(v)
        if i is not None and v is not None:
            best[i] = max(best.get(i, v), v)
    for i, q in best.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j is not None and v is not None and j != i)
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def check(spark, rows, k=5, every=3):
    schema = "vec_id bigint, embedding array<float>, label int, rank string"
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], schema)
    queries = table.where(f"vec_id % {every} = 0 or vec_id is null")
    plain = [(i, [None if x is None else float(x) for x in v] if v is not None else None) for i, v in rows]
    found = sorted(map(tuple, topk.top_k(queries, table, k).collect()))
    assert found == brute([r for r in plain if r[0] is None or r[0] % every == 0], plain, k)


def vectors(n, width, seed):
    dice = random.Random(seed)
    return [(i, [round(dice.gauss(0, 1) * 64) / 64 for _ in range(width)]) for i in range(n)]


def test_random_vectors_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "ROW_BLOCK", 16)
    check(spark, vectors(150, 32, 1))
    check(spark, vectors(60, 7, 2), k=2)


def test_levels_and_thresholds_lose_nothing(monkeypatch):
    dice = np.random.default_rng(3)
    centres = dice.normal(size=(12, 64)) * 40
    rows = np.floor(np.concatenate([centres[dice.integers(0, 12, 500)] + dice.normal(size=(500, 64)) * 4, dice.normal(size=(200, 64)) * 256])).astype(np.int64)
    ids = dice.permutation(len(rows)).astype(np.int64)
    queries, q_ids = rows[:40], ids[:40]
    want = []
    for i in range(40):
        scored = sorted((-int(queries[i] @ rows[j]), int(ids[j])) for j in range(len(rows)) if ids[j] != q_ids[i])
        want += [(i, j, -s) for s, j in scored[:5]]
    for dense in (0.0, 0.3, 2.0):
        monkeypatch.setattr(topk, "DENSE", dense)
        some = topk.thresholds(queries, q_ids, rows[::7], ids[::7], 5)
        q, r, score = topk.best(queries, q_ids, rows, ids, 5, some)
        assert [(int(a), int(ids[b]), int(s)) for a, b, s in zip(q, r, score)] == want


def test_values_beyond_doubles(spark):
    dice = random.Random(8)
    check(spark, [(i, [float(dice.randrange(-(2**22), 2**22)) for _ in range(3)]) for i in range(40)])


def test_ties_copies_and_fewer_rows_than_k(spark):
    same = [(i, [0.5, -0.25, 1.0]) for i in range(40)] + [(40, [0.0, 0.0, 0.0]), (41, [2.0, 0.0, 0.0])]
    check(spark, same, every=20)
    check(spark, same[:3], every=1)
    check(spark, same[:1], every=1)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, []), (9, [1.0, 2.0, 3.0]), (12, [-1.5, 2.0])]
    check(spark, odd)
    check(spark, [])


def test_queries_are_sent_in_groups_and_never_copied_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "ROW_BLOCK", 16)
    rows = vectors(120, 8, 5)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    plan = topk.top_k(table.where("vec_id % 3 = 0"), table, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("BroadcastExchange") == 1
    monkeypatch.setattr(topk, "SENT_NUMBERS", 100)
    check(spark, rows)
