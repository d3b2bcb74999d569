import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow.llm import mixing


def brute_targets(sizes):
    """Caps taken off one after the other, smallest cap for its weight first."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(mixing.WEIGHTS[i % len(mixing.WEIGHTS)]) for i, s in enumerate(order)}
    left, open_, target = mixing.SHARE * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > mixing.MOST_COPIES * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: mixing.MOST_COPIES * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"s{i}": int(rng.pareto(0.6) * 10 + 1) for i in range(200)} | {None: 77, "": 5, "é": 0, "\U0001f600": 9, "￮": 9}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def brute_fold(items, seed, draw):
    """Pivotal steps on (id, weight, mass), one after the other; the share of each item that is taken, and what is left."""
    left, done = None, {}
    for i, w, m in items:
        if left is None:
            left = (i, w, m)
            continue
        j, v, k = left
        up, down = min(v - k, m), min(k, w - m)
        if draw(seed, j, i) * (up + down) < down:
            k, m = k + up, m - up
        else:
            k, m = k - down, m + down
        left = None
        for x, weight, mass in ((j, v, k), (i, w, m)):
            if mass <= 1e-9 or mass >= weight - 1e-9:
                done[x] = mass > weight / 2
            else:
                left = (x, weight, mass)
    return done, left


def test_rounding_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    items = [(i, int(rng.integers(1, 50))) for i in range(60)]
    items = [(i, w, w * float(rng.uniform(0.05, 0.95))) for i, w in items]
    pairs = spark.createDataFrame([(a, b) for a, _, _ in items for b, _, _ in items], "a long, b long")
    drawn = {(r["a"], r["b"]): r["d"] for r in pairs.select("a", "b", mixing._draw(7, F.col("a"), F.col("b")).alias("d")).collect()}
    done, left = brute_fold(items, 7, lambda _, a, b: drawn[a, b])
    rows = spark.createDataFrame([([(i, w, 1, float(w), m) for i, w, m in items],)], f"items array<{mixing._ITEM}>")
    got = rows.select(mixing._fold(F.col("items"), 7).alias("r")).first()["r"]
    assert {d["id"]: d["full"] for d in got["done"]} == done
    assert (got["left"] and got["left"]["id"]) == (left and left[0])
    taken = sum(w for i, w, _ in items if done.get(i)) + (left[2] if left else 0)
    assert taken == pytest.approx(sum(m for _, _, m in items))  # no mass is lost


def test_copies_and_hot_source(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), "hot" if i % 3 else f"s{i % 1500}", "a", "b", "c") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies string, row string, size string")
    plan = {r["doc_id"]: (r["copies"], r["target"], r["source_size"], r["size"]) for r in mixing.allot(docs).collect()}
    copies = collections.Counter(r["doc_id"] for r in mixing.repeated(docs).collect())
    assert copies == collections.Counter({i: c for i, (c, *_) in plan.items() if c})
    assert all(int(t / s) <= c <= int(t / s) + 1 for c, t, s, _ in plan.values()) and mixing.repeated(docs).columns == docs.columns
    hot = [(c * n, t) for i, (c, t, _, n) in plan.items() if i % 3]
    assert sum(x for x, _ in hot) == pytest.approx(hot[0][1], abs=120)
