"""Assignment under caps: a loop over all pairs, stability, caps and exclusions."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from marlstone.operators import assign


def near(a, b):
    return sum((math.log(max(x, 1)) - math.log(max(y, 1))) ** 2 for x, y in zip(a, b))


def greedy(targets, items, cap):
    """Pairs of sizes, nearest first: how many of each are assigned."""
    need, have, out = Counter((c, s) for _, c, s, _ in targets), Counter(), Counter()
    for _, c, s, _ in items:
        have[c, s] += cap
    for _, c, s, u in sorted((near(s, u), c, s, u) for c, s in need for d, u in have if d == c):
        n = min(need[c, s], have[c, u])
        if n:
            out[c, s, u] += n
            need[c, s] -= n
            have[c, u] -= n
    return out


def frames(spark, targets, items):
    rows = lambda own: [(i, c, *s, a) for i, c, s, a in own]
    return spark.createDataFrame(rows(targets), "target_id long, cls string, w int, h int, apart long"), spark.createDataFrame(rows(items), "item_id long, cls string, w int, h int, apart long")


@pytest.mark.parametrize("seed,cap", [(1, 1), (2, 3)])
def test_stable_against_a_loop(spark, seed, cap):
    rng = random.Random(seed)
    sizes = [(rng.randrange(1, 90), rng.randrange(1, 90)) for _ in range(25)]
    made = lambda n, base, at: [(base + i, rng.choice("ab"), rng.choice(sizes[at:]), base + i) for i in range(n)]
    targets, items = made(300, 0, 0), made(200 // cap + 40, 10_000, 5)
    t, i = frames(spark, targets, items)
    got = [(r.target_id, r.item_id) for r in assign.assigned(t.repartition(5), i, cap).collect()]
    of_t, of_i = {x[0]: x for x in targets}, {x[0]: x for x in items}
    assert max(Counter(b for _, b in got).values()) <= cap and len({a for a, _ in got}) == len(got)
    assert Counter((of_t[a][1], of_t[a][2], of_i[b][2]) for a, b in got) == greedy(targets, items, cap)
    assert all(of_t[a][1] == of_i[b][1] for a, b in got)
    again = [(r.target_id, r.item_id) for r in assign.assigned(t, i.repartition(3), cap).collect()]
    assert sorted(again) == sorted(got)


def test_no_pair_prefers_each_other():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(40, 2)), rng.normal(size=(30, 2))
    need, have = rng.integers(0, 5, 40), rng.integers(0, 5, 30)
    flows = assign.flows_of(need, have, a, b)
    d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    got = np.zeros((40, 30), int)
    for s, c, n in flows:
        got[s, c] += n
    assert (got.sum(1) <= need).all() and (got.sum(0) <= have).all() and got.sum() == min(need.sum(), have.sum())
    for s in range(40):
        for c in range(30):
            worse_s = got.sum(1)[s] < need[s] or (got[s][d[s] > d[s, c]] > 0).any()
            worse_c = got.sum(0)[c] < have[c] or (got[:, c][d[:, c] > d[s, c]] > 0).any()
            assert not (need[s] and have[c] and worse_s and worse_c)


def test_apart_rows_and_edges(spark):
    targets = [(k, "a", (10, 10), k % 3) for k in range(60)]
    items = [(1000 + k, "a", (10, 11), k % 3) for k in range(60)]
    t, i = frames(spark, targets, items)
    got = assign.assigned(t, i, 2).collect()
    assert len(got) == 60 and all(r.target_id % 3 != (r.item_id - 1000) % 3 for r in got) and max(Counter(r.item_id for r in got).values()) <= 2
    same = assign.assigned(t.where("apart = 0"), i.where("apart = 0"), 2)
    assert same.count() == 0
    assert assign.assigned(t.limit(0), i, 1).count() == 0 and assign.assigned(t, i.limit(0), 1).count() == 0
    other, _ = frames(spark, [(1, "z", (5, 5), None), (2, None, (5, 5), 1)], items)
    assert assign.assigned(other, i, 1).count() == 0


def test_later_phases_rank_few_items(spark, monkeypatch):
    """What the first phase leaves asks for few uses; items whose hash lies behind those are not sorted again."""
    ranked, summed = [], assign.running_sum

    def seen(rows, n, order, partition):
        if "item_id" in order:
            ranked.append(rows.count())
        return summed(rows, n, order, partition)

    monkeypatch.setattr(assign, "running_sum", seen)
    t, i = frames(spark, [(k, "a", (10, 10), k) for k in range(400)], [(1000 + k, "a", (10, 10), k if k % 10 == 0 else -1) for k in range(2000)])
    got = assign.assigned(t, i, 1).collect()
    assert len(got) == len({r.item_id for r in got}) == 400 and all(r.target_id != r.item_id - 1000 or r.target_id % 10 for r in got)
    assert len(ranked) > 1 and all(n < 400 for n in ranked[1:])
