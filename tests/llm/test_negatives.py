"""Hard negatives against brute force, on odd rows."""

import math
import random

import pytest

from blastradius.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id string, score string"


def rows(scale: float = 0.2) -> list[tuple]:
    rnd = random.Random(3)
    out = [(i, [rnd.gauss(0, scale) for _ in range(6)], rnd.choice((1, 1, 1, 2, 3)), "x", "y") for i in range(400)]
    same = out[5][1]
    out += [(1000 + i, same, 1 + i % 2, "x", "y") for i in range(150)]  # a vector that is very common: ties
    out += [
        (2000, [0.0] * 6, 1, "x", "y"), (2050, [], 2, "x", "y"), (2100, [0.5, -0.25], 1, "x", "y"), (2150, None, 1, "x", "y"), (2200, [0.1] * 6, None, "x", "y"),
        (2250, [0.1, None, 0.2, 0.3, 0.1, 0.1], 1, "x", "y"), (2300, [float("nan")] * 6, 1, "x", "y"), (2350, [float("inf")] * 6, 2, "x", "y"), (None, [0.3] * 6, 1, "x", "y"),
        (2400, [0.4] * 6, 9, "x", "y"), out[50], (50, [0.9] * 6, 3, "x", "y"),
    ]
    return out


def brute(table: list[tuple]) -> set[tuple]:
    held: dict = {}
    for i, v, label, *_ in table:
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v):
            held[i] = min(held.get(i, (label, v)), (label, v))
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in held.items()}
    out = set()
    for a, (label, v) in whole.items():
        if a % 50:
            continue
        scored = sorted((-min(max(sum(x * y for x, y in zip(v, w, strict=False)), -(2**63)), 2**63 - 1), i, other == label) for i, (other, w) in whole.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            fit = [(n, i) for n, i, same in scored if not same and 50 * -s <= 100 * -n <= 95 * -s]
            out |= {(a, p, rank, i, -s, -n) for rank, (n, i) in enumerate(fit[:3], 1)}
    return out


@pytest.mark.parametrize("scale,block,lists", [(0.2, 4096, 8192), (0.2, 64, 16), (3e5, 64, 32)])
def test_against_all_pairs(spark, monkeypatch, scale, block, lists):
    # The last scale takes sums beyond what a double holds exactly.
    monkeypatch.setattr(negatives, "SMALL_BLOCK", block)
    monkeypatch.setattr(negatives, "BLOCK", max(block, 64))
    table = rows(scale)
    if scale > 1:
        table += [(3000 + 25 * i, [x * 1e4 for x in r[1]], r[2], "x", "y") for i, r in enumerate(table[:60])]
    got = negatives.mine(spark.createDataFrame(table, SCHEMA).repartition(3))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(table)
    assert want and {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_reading_stops_early():
    import numpy as np

    rnd = np.random.default_rng(1)
    x = np.floor(rnd.normal(0, 20, (4000, 3)))
    lists = negatives.SortedLists(np.arange(4000), np.ones(4000, int), x)
    a = np.array([30.0, -7.0, 0.0])
    asked = negatives.Asked(5)
    lists.search(a, -1, 1, True, [asked])
    assert asked.best == sorted(((int(s), i) for i, s in enumerate(x @ a)), key=lambda t: (-t[0], t[1]))[:5]
    assert lists.seen.sum() < 2000


def test_nothing_to_mine(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = [(1, [1.0], 1, "", ""), (7, [2.0], 2, "", "")]
    assert negatives.mine(spark.createDataFrame(alone, SCHEMA)).count() == 0
