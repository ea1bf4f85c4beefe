"""Removal of every edge of strongly connected graphs, against measuring each graph anew."""

import random
import time

import numpy as np

from plumbline.operators.bridges import in_rectangles, removals


def reached(start, targets):
    seen, todo = set(), [start]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += targets[v]
    return seen


def cyclic(n, edges):
    """The sizes of cyclic components."""
    there, back = ({v: [] for v in range(n)} for _ in range(2))
    for a, b in edges:
        there[a].append(b)
        back[b].append(a)
    left, sizes = set(range(n)), []
    while left:
        v = min(left)
        own = reached(v, there) & reached(v, back)
        if len(own) > 1 or v in there[v]:
            sizes.append(len(own))
        left -= own
    return sizes


def test_every_edge_of_random_graphs():
    rng, done = random.Random(4), 0
    while done < 250:
        n = rng.randint(1, 9)
        edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 2 * n + 2))})
        if cyclic(n, edges) != [n]:
            continue
        done += 1
        largest, free = removals(n, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
        sizes = [cyclic(n, [x for x in edges if x != e]) for e in edges]
        assert largest.tolist() == [max(s, default=0) for s in sizes], edges
        assert free.tolist() == [n - sum(s) for s in sizes], edges


def test_a_cycle_of_100_000_edges_takes_seconds():
    n, begun = 100_000, time.monotonic()
    largest, free = removals(n, np.arange(n), (np.arange(n) + 1) % n)
    assert (largest == 0).all() and (free == n).all()
    assert time.monotonic() - begun < 30


def test_points_in_rectangles():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 50, 300), rng.integers(0, 40, 300)
    x0, y0 = rng.integers(0, 50, 100), rng.integers(0, 40, 100)
    x1, y1 = x0 + rng.integers(0, 30, 100), y0 + rng.integers(0, 30, 100)
    want = [((x >= a) & (x < b) & (y >= c) & (y < d)).sum() for a, b, c, d in zip(x0, x1, y0, y1)]
    assert in_rectangles(x, y, x0, x1, y0, y1).tolist() == want
