"""Mixing against water-filling in fractions and one threshold a source."""

import random
from collections import defaultdict

import pytest

from loomcat.llm import mixing as M

COLUMNS = "doc_id long, text string, source string, target string, whole long, below long, source_size int, _copy int, _hash long, row string, skey string, hash long, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, 3, 4, 5, "r", "s", 6, 7) for r in rows], COLUMNS).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_words_taken(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "Z", "é", "z", "\U0001f600", "￿", *(f"host{i}.org" for i in range(40))]
    rows = [(rng.choice([None, i]), "w " * rng.choice([0, 1, 5, 30, 100]), s) for i, s in enumerate(rng.choices(names, [rng.choice([1, 3, 30, 200]) for _ in names], k=900))]
    docs = table(spark, rows)
    found = M.mix(docs).collect()
    size = defaultdict(int)
    for _, text, s in rows:
        size[s] += len(text.split())
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(order, M.water_fill([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], M.SHARE * sum(size.values())), strict=True))
    for s in order:
        own = [r for r in found if r.source == s]
        assert {r.source_size for r in own} == {size[s]}
        assert len({r.target for r in own}) == 1 and own[0].target == pytest.approx(float(target[s]))
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
        assert abs(sum(r.taken for r in own) - float(target[s])) <= 100
    assert sorted(map(str, found)) == sorted(map(str, M.mix(docs.repartition(7)).collect()))
    copies = M.repeated(docs)
    assert copies.columns == docs.columns
    assert sum(len(r.text.split()) for r in copies.collect()) == sum(r.taken for r in found)


def test_one_group_of_equal_rows_and_an_empty_table(spark):
    docs = table(spark, [(None, "same words", None)] * 300 + [(1, None, "a")])
    found = M.mix(docs).collect()
    assert abs(sum(r.taken for r in found) - found[0].target) <= 2
    assert M.mix(docs.limit(0)).count() == 0 and M.repeated(docs.limit(0)).count() == 0
    assert M.repeated(table(spark, [(1, "", "a"), (2, None, None)])).count() <= 4
