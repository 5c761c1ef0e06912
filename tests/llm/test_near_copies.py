import random

import pytest

from tapline.llm import near_copies as nc
from tapline.llm.near_copies import near_copies


def brute(rows, width, percent):
    def shingles(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for (k, _), g in zip(rows, group, strict=True):
        if k is not None:
            least[g] = min(k, least.get(g, k))
    return sorted((k is None, k or 0, len(s), least.get(g) if s else k) for (k, _), s, g in zip(rows, sets, group, strict=True))


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    passage, rows = text(30), []
    for n, copies, changes in ((120, 150, 2), (60, 90, 3), (200, 12, 4), (40, 5, 1), (15, 60, 1), (300, 3, 9)):
        base = text(n)
        for _ in range(copies):
            mine = list(base)
            for _ in range(r.randint(0, changes)):
                mine[r.randrange(n)] = r.choice(words)
            rows.append(" ".join(mine))
    rows += [" ".join(text(r.randint(0, 40)) + passage + text(r.randint(0, 40))) for _ in range(80)]
    rows += [" ".join(text(r.randint(1, 60))) for _ in range(60)] + [" ".join(passage)] * 4
    rows += [None, "", " \n\t", "One", "one", "ONE two", "one TWO ", "ÉTÉ one two", "été one two", "a b c", "a b c", "x " * 5000]
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(5, rows[5]), (None, "one"), (None, None)]


@pytest.mark.parametrize("width,percent,block", [(4, 85, 64), (5, 80, 4)])
def test_brute_force(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(nc, "BLOCK", block)
    monkeypatch.setattr(nc, "LEAST_COMMON", 40 if block == 64 else 8)
    rows = corpus(width)
    events = spark.createDataFrame([(k, t, 0) for k, t in rows], "event_id long, raw string, component_id int").repartition(5)
    got = near_copies(events, width, percent).collect()
    assert sorted((x.event_id is None, x.event_id or 0, x.n_shingles, x.component_id) for x in got) == brute(rows, width, percent)


def test_empty(spark):
    assert near_copies(spark.createDataFrame([], "event_id long, raw string")).count() == 0
    one = spark.createDataFrame([("x", None), ("y", "")], "event_id string, raw string")
    assert {(r.event_id, r.n_shingles, r.component_id) for r in near_copies(one).collect()} == {("x", 0, "x"), ("y", 0, "y")}
