import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k=10):
    usable = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(b) == len(a))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, **options).collect())


@pytest.mark.parametrize("options", [{}, {"query_block": 2, "seeds": 7}, {"levels": (1, 3, 9)}])
def test_against_brute_force(spark, options):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 24))
    rows = [(k, (centres[k % 5] + 0.3 * rng.normal(size=24)).tolist()) for k in range(500)]
    assert run(spark, rows, **options) == brute(rows)


def test_ties_and_repeats(spark):
    rows = [(k, [1.0, 2.0]) for k in range(300)] + [(250, [1.0, 2.0]), (7, [0.5, 0.5])]
    got = run(spark, rows, seeds=20)
    assert [r[2] for r in got if r[0] == 0] == list(range(1, 11))
    assert got == brute(rows)
    assert run(spark, [*rows, (100, [4.0, 1.0])], k=2)[0] == (0, 1, 100, 1024 * 1024 * 6)


def test_unusable_rows_take_no_part(spark):
    rows = [(0, [1.0, 1.0]), (1, [2.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [-0.5, 0.25]), (None, [9.0, 9.0]), (6, [1.0, 1.0, 1.0]), (7, []), (100, [])]
    assert run(spark, rows) == brute(rows) == [(0, 1, 5, -256 * 1024), (100, 1, 7, 0)]
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == []


def test_large_components_stay_exact(spark):
    rows = [(k, [float(3 + k) * 2.0**17, -(2.0**16), 1.0]) for k in range(30)]
    assert run(spark, rows) == brute(rows)


def test_components_of_any_size(spark):
    """Scores beyond a long are held at its ends; a component that overflows when scaled isn't finite."""
    huge = [(0, [1e18, 1.0]), (1, [1e18, 2.0]), (2, [-1e18, 3.0]), (3, [1e-3, 0.5]), (4, [1e200, -1e200]), (5, [1e306, 0.0]), (100, [-3.0, 0.0]), (200, [1e300, 1e300])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in huge], SCHEMA.replace("float", "double"))
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(df, seeds=3).collect()}
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in huge if i != 5}
    want = {(q, i): min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1) for q, a in whole.items() if q % 100 == 0 for i, b in whole.items() if i != q}
    assert got == want


def test_a_query_that_is_repeated_often(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(1, 60)] + [(100, [1.0] * 6)] * 40
    assert run(spark, rows, query_block=7) == brute(rows)


def test_levels_prune_more_and_more():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 64))
    x = np.floor(1024 * (centres[np.arange(3000) % 30] + 0.1 * rng.normal(size=(3000, 64))))
    best, ids = topk.Best(20, 10), np.arange(3000)
    ask = lambda part: topk.search(x[:20], ids[:20], x[part], ids[part], best, np.arange(20), (4, 16))
    ask(slice(0, 500))
    pairs, first, second = ask(slice(500, 3000))
    assert pairs == 20 * 2500 > first > second >= 20 * 10 // 2
    exact = x[:20] @ x.T
    exact[np.arange(20), np.arange(20)] = -np.inf
    assert (np.sort(best.score, axis=1)[:, ::-1] == -np.sort(-exact, axis=1)[:, :10]).all()


def test_bounds_are_never_below_the_product():
    rng = np.random.default_rng(1)
    q, x = np.floor(rng.normal(size=(40, 64)) * 300), np.floor(rng.normal(size=(60, 64)) * 300)
    exact, before = q @ x.T, None
    for parts in (1, 4, 16, 64):
        bound = topk.segments(q, parts) @ topk.segments(x, parts).T
        assert (bound >= exact - 1e-3).all()
        assert before is None or bound.mean() <= before
        before = bound.mean()
    # one dimension a segment leaves means alone: the bound is the product
    assert np.allclose(bound, exact)


def test_queries_by_any_rule(spark):
    df = spark.createDataFrame([(k, [float(k)], 0, "x") for k in range(5)], SCHEMA)
    assert topk.top_k(df, is_query=F.col("vec_id") == 3, k=1).first()["vec_id"] == 4
