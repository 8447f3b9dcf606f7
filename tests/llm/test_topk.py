"""Exact top-k against Python integers, with vectors of any size."""

import math
import random

import pytest

from loomcat.llm import topk


def brute(rows, ask):
    vectors = [(i, [math.floor(1024 * x) if math.isfinite(1024 * x) else 1024 * int(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, own in vectors:
        if ask(q):
            found = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in vectors if i != q)[:10]
            out |= {(q, k): (i, max(-(1 << 63), min((1 << 63) - 1, -s))) for k, (s, i) in enumerate(found, 1)}
    return out


def search(spark, rows):
    q = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")).cache()
    found = topk.search(topk.build_index(q, 40), q.where("vec_id % 10 = 0"), chunk=3).collect()
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found}


def test_wide_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, rng.uniform(-1, 1), 200000.0, -4096.0, 1e300, -1.7e308, 4095.999, 5e-324]) for _ in range(5)]) for i in range(150)]
    rows += [(i, [rng.uniform(-1, 1) for _ in range(rng.randint(0, 7))]) for i in range(150, 250)]
    rows += [(300, None), (310, [None, 1.0]), (320, [math.inf]), (330, [math.nan]), (None, [1.0]), (340, []), (350, [200000.0]), (351, [200000.0])]
    assert search(spark, [(*r, 1) for r in rows]) == brute(rows, lambda i: i % 10 == 0)


def test_few_and_equal_rows(spark):
    rows = [(10, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0])]
    assert search(spark, [(*r, 1) for r in rows]) == brute(rows, lambda i: i == 10)
    assert search(spark, []) == {}


@pytest.mark.parametrize("n", [0, 1, -1, 255, 256, -255, -256, 1 << 80, -(1 << 80)])
def test_bytes_have_the_order_of_the_integers(n):
    for m in (n - 1, n + 1, -n, 0):
        assert (topk.sortable(n) < topk.sortable(m)) == (n < m)
