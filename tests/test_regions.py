import random

import pytest

from lumenflow.operators.regions import Reduction, regions


def kinds(follow, handlers=None):
    return [(k, h, b) for _, k, h, b, _ in Reduction(follow, handlers or {}, 0).run()]


def test_each_pattern():
    assert kinds({0: [1], 1: [2]}) == [("block", 1, [1, 2]), ("block", 0, [0, 1, 2])]
    assert kinds({0: [1, 2], 1: [2]})[0] == ("if", 0, [0, 1])
    assert kinds({0: [1, 2], 1: [3], 2: [3]})[0] == ("if_else", 0, [0, 1, 2])
    assert kinds({0: [1, 2], 1: [3, 4], 2: [4]})[0] == ("if_exit", 1, [1, 3])
    assert kinds({0: [0, 1]})[0] == ("self_loop", 0, [0])
    assert ("while_loop", 1, [1, 2]) in kinds({0: [1], 1: [2, 3], 2: [1]})
    assert ("do_while_loop", 1, [1, 2]) in kinds({0: [1], 1: [2], 2: [1, 3]})
    assert kinds({0: [1, 2, 3], 1: [4], 2: [4], 3: [4]})[0] == ("switch", 0, [0, 1, 2, 3])
    assert kinds({0: [2], 1: [2]}, {0: {1}})[0] == ("try_catch", 0, [0, 1])
    assert ("natural_loop", 1, [1, 2, 3]) in kinds({0: [1], 1: [2, 4], 2: [3, 4], 3: [1]})
    assert kinds({0: [1, 2], 1: [2], 2: [1]})[-1][0] == "abstract"  # a loop of two entries
    assert kinds({}) == kinds({5: [6]}) == []


@pytest.mark.parametrize("seed", range(200))
def test_regions_nest_and_end_in_one(seed):
    rng = random.Random(seed)
    n = rng.randrange(2, 12)
    follow = {b: [rng.randrange(n) for _ in range(rng.randrange(3))] + ([b + 1] if b + 1 < n else []) for b in range(n)}
    handlers = {b: {rng.randrange(n)} - set(follow[b]) for b in range(n) if rng.random() < 0.2}
    reach, work = {0}, [0]
    while work:
        b = work.pop()
        new = {*follow[b], *handlers.get(b, ())} - reach
        reach |= new
        work += new
    found = Reduction(follow, handlers, 0).run()
    assert set(found[-1][3]) == reach and found[-1][4] is None
    by = {r: set(blocks) for r, _, _, blocks, _ in found}
    for r, _, head, blocks, parent in found:
        assert head in blocks and (parent is None) == (r == found[-1][0])
        assert parent is None or (parent > r and by[r] <= by[parent])
    for a in by.values():
        assert all(a <= b or b <= a or not a & b for b in by.values())


def test_methods_side_by_side(spark):
    rows = [(1, 0, 0, 1, False), (1, 0, 1, 2, False), (1, 1, 0, 2, False), (2, 0, 0, 2, False), (2, 0, 9, 1, True), (2, 1, 0, 2, None)]
    got = regions(spark.createDataFrame(rows, "method long, src long, succ_idx int, dst long, exceptional boolean")).collect()
    assert {(r["method"], r["kind"], tuple(r["blocks"]), r["parent"]) for r in got} == {(1, "if", (0, 1), 2), (1, "block", (0, 1, 2), None), (2, "try_catch", (0, 1), 2), (2, "block", (0, 1, 2), None)}
