"""Look-alike labels against a comparison of all labels."""

import random
from collections import Counter

import pytest

from tapline.llm import name_variants
from tapline.llm.name_variants import label_variants, looked_up_labels


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(seen, least_length=7, least_seen=2, ratio=10):
    n = {w: c for w, c in Counter(seen).items() if w is not None and len(w) >= least_length and c >= least_seen}
    out = {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = (form, n[w], len(others), n.get(form))
    roots = {}
    for w in out:
        roots[w] = w
        while out[roots[w]][0] is not None:
            roots[w] = out[roots[w]][0]
    return {w: (form, roots[w], *rest) for w, (form, *rest) in out.items()}


def run(spark, seen, **options):
    frame = spark.createDataFrame([(w, "clash") for w in seen], "label string, form string")
    rows = label_variants(frame, **options).collect()
    assert len({r.label for r in rows}) == len(rows)
    return {r.label: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.fixture(scope="module")
def seen():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 10))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "ÿÿÿÿÿÿÿ"]
    out = [None, "", "short", "short"]
    for stem in stems:
        out += [stem] * rng.choice([2, 30, 400])
        for _ in range(12):
            k = rng.randrange(len(stem) + 1)
            variant = rng.choice([stem[:k] + stem[k + 1 :], stem[:k] + rng.choice("abc😀") + stem[k:], stem[:k] + rng.choice("abé") + stem[k + 1 :]])
            out += [variant] * rng.choice([1, 2, 3, 30])
    return out


@pytest.mark.parametrize("range_labels", [4_000, 9])
def test_against_all_pairs(spark, monkeypatch, seen, range_labels):
    monkeypatch.setattr(name_variants, "RANGE_LABELS", range_labels)
    expected = brute(seen)
    assert run(spark, seen) == expected
    assert any(form for form, *_ in expected.values())


def test_chains_and_ties(spark):
    seen = ["abcdefg"] * 2 + ["abcdefgh"] * 20 + ["abcdefghi"] * 200 + ["abcdefghij"] * 2000 + ["abcdefgg"] * 20
    found = run(spark, seen)
    assert found == brute(seen)
    assert found["abcdefg"][:2] == ("abcdefgg", "abcdefgg") and found["abcdefgh"][1] == "abcdefghij"
    assert run(spark, seen, ratio=2, least_length=8, least_seen=21) == brute(seen, 8, 21, 2)
    with pytest.raises(ValueError):
        run(spark, seen, ratio=1)


def test_empty_long_and_shared_prefixes(spark, monkeypatch):
    assert run(spark, []) == {} and run(spark, ["", None, "alone-label"]) == {}
    monkeypatch.setattr(name_variants, "RANGE_LABELS", 3)
    long = "ab" * 20_000
    seen = [w for w in (long, long[:-1], long + "c", *("a" * k for k in range(7, 60))) for _ in range(2)]
    found = run(spark, seen)
    assert found[long] == (None, long, 2, 2, None) and found[long + "c"][3] == 1
    assert all(found["a" * k][3] == (2 if 7 < k < 59 else 1) for k in range(7, 60))


def test_labels_of_dns_events(spark):
    dns = spark.createDataFrame([("WWW.Example-Bank.com", 1), (None, 2), ("..", 3), ("example-benk.com", 4)], "query string, label int")
    assert sorted(r.label for r in looked_up_labels(dns).collect()) == ["com", "com", "example-bank", "example-benk", "www"]
