"""Links of flow vectors against all cosines."""

import numpy as np
import pytest

from tapline.llm import vector_copies
from tapline.llm.vector_copies import Hashing, local_roots, near_flows

SCHEMA = "flow_id long, features array<double>, label string, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def usable(v, label):
    return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, least=0.98):
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for i, (_, v, label) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows):
            if i != j and label == other and usable(v, label) and usable(w, other) and len(v) == len(w):
                a, b = np.array(v), np.array(w)
                linked[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= least
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for k in np.flatnonzero(linked[todo.pop()]).tolist():
                if k not in group:
                    group.add(k)
                    todo.append(k)
        seen |= group
        first = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
        for k in group:
            out[k] = (rows[k][0], int(linked[k].sum()), first, rows[k][0] == first)
    return sorted(out, key=repr)


def run(spark, rows, **options):
    return sorted(map(tuple, near_flows(frame(spark, rows), **options).collect()), key=repr)


def groups(rng, plan, size=24):
    out = []
    for label, count, noise in plan:
        centre = rng.normal(size=size)
        out += [((centre + rng.normal(size=size) * noise).tolist(), label) for _ in range(count)]
    return [(i, v, label) for i, (v, label) in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    made = groups(rng, [("x", 1, 0)] * 60 + [("y", 1, 0)] * 60 + [("x", 3, 0.05)] * 8 + [("y", 6, 0.1)] * 5 + [("x", 90, 0.1), ("y", 50, 0.14), ("y", 40, 0.0)])
    return made


@pytest.mark.parametrize("block, tile", [(32, 2048), (4, 8), (10_000, 2048)])
def test_against_all_pairs(spark, monkeypatch, rows, block, tile):
    monkeypatch.setattr(vector_copies, "BLOCK", block)
    monkeypatch.setattr(vector_copies, "TILE", tile)
    assert run(spark, rows) == brute(rows)


def test_defined_results(spark):
    v = [1.0, 2.0, 3.0]
    odd = [
        (1, v, "a"), (2, [2.0, 4.0, 6.0], "a"), (3, v, "b"), (4, v, None), (5, None, "a"), (6, [], "a"), (7, [0.0] * 3, "a"), (8, [1.0, None, 3.0], "a"),
        (9, [float("nan"), 2.0, 3.0], "a"), (10, [float("inf"), 2.0, 3.0], "a"), (11, [1.0, 2.0], "a"), (None, v, "a"), (1, v, "a"), (None, v, "c"), (12, [1e-200, 2e-200, 3e-200], "a"),
        (13, [1e200, 2e200, 3e200], "a"), (14, [-1.0, -2.0, -3.0], "a"), (15, v, ""), (16, v, ""),
    ]
    got = {(r[0], r[1]): r[2:] for r in run(spark, odd)}
    assert got[1, 5] == (1, True) and got[2, 5] == (1, False) and got[None, 5] == (1, False) and got[12, 5] == (1, False)
    assert got[13, 5] == (1, False) and got[16, 1] == (15, False) and got[None, 0] == (None, True)
    assert all(got[k, 0] == (k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11, 14))
    assert run(spark, []) == []


def test_threshold_is_a_parameter(spark):
    rng = np.random.default_rng(2)
    rows = groups(rng, [("x", 5, 0.3)] * 12)
    assert run(spark, rows, least=0.9) == brute(rows, 0.9)


def test_hashing_meets_its_chance():
    rng = np.random.default_rng(1)
    hashing = Hashing.for_vectors(1000, 0.98)
    a = vector_copies.unit_rows(rng.normal(size=(4000, 32)))
    side = rng.normal(size=a.shape)
    side = vector_copies.unit_rows(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * side
    same = np.zeros(len(a), np.uint64)
    missed = 1 - (hashing.buckets(a, same) == hashing.buckets(b, same)).any(axis=1).mean()
    assert missed < 4e-3
    far = (hashing.buckets(a, same) == hashing.buckets(a[::-1], same)).sum(axis=1).mean()
    assert far < 0.05


def test_local_roots():
    links = np.zeros((6, 6), bool)
    for a, b in [(5, 4), (4, 2), (1, 3)]:
        links[a, b] = links[b, a] = True
    assert local_roots(links).tolist() == [0, 1, 2, 1, 2, 2]
