from __future__ import annotations

import random
from itertools import combinations

import pytest
from helpers import frame

from tradewind.operators.itemsets import frequent_itemsets

KIND = "basket bigint, item string"


def plain(data, min_support, max_size):
    baskets: dict = {}
    for b, i in data:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    least = max(2, -(-len(baskets) * min_support // 1))
    out = {}
    for size in range(1, max_size + 1):
        for held in baskets.values():
            for items in combinations(sorted(held), size):
                out[items] = out.get(items, 0) + 1
    return {k: n for k, n in out.items() if n >= least}


@pytest.mark.parametrize(("seed", "support", "size"), [(1, 0.05, 3), (2, 0.2, 4), (3, 0.001, 2), (4, 0.9, 3)])
def test_against_all_subsets(spark, seed, support, size):
    r = random.Random(seed)
    data = [(r.choice([None, *range(60)]), r.choice([None, *"abcdefgh"])) for _ in range(400)]
    got = frequent_itemsets(frame(spark, KIND, data), "basket", "item", support, size).collect()
    assert {tuple(g["items"]): g["n"] for g in got} == plain(data, support, size)
    assert all(g["size"] == len(g["items"]) for g in got)


def test_edges(spark):
    assert frequent_itemsets(frame(spark, KIND, []), "basket", "item", 0.1).collect() == []
    one = frequent_itemsets(frame(spark, KIND, [(1, "a"), (1, "b")] * 3), "basket", "item", 0.5).collect()
    assert one == []  # one basket is not two
    busy = [(1, f"i{k:03d}") for k in range(60)] + [(2, "i000"), (2, "i001"), (2, "i002")]
    got = {tuple(g["items"]): g["support"] for g in frequent_itemsets(frame(spark, KIND, busy), "basket", "item", 0.5).collect()}
    assert len(got) == 7 and got["i000", "i001", "i002"] == 1
    for bad in (dict(min_support=0.0), dict(min_support=0.1, max_size=0)):
        with pytest.raises(ValueError, match="share"):
            frequent_itemsets(frame(spark, KIND, []), "basket", "item", **bad)
