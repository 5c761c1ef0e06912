import math
import random

import numpy as np
import pandas as pd

from tapline.llm import language_model, quality_model
from tapline.llm.language_model import ContextTree, LanguageModel

WORDS = {"aa": ["conn", "closed", "reset", "syn", "flood"], "bb": ["requête", "réponse", "domaine", "fermée"]}


def sample(lang, seed, n=30):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def test_code_length():
    """The automaton's lengths are those of the context trees, and those are lengths of a code."""
    tree = ContextTree({"syn": 3, "sym": 1})
    assert tree.length("syn") < tree.length("sym") < tree.length("zzz")
    assert sum(2 ** -tree.length(w) for w in ("syn", "sym", "s", "zz", "sn", "")) <= 1
    texts = pd.DataFrame({"lang": ["a", "b", "a"], "text": ["syn sym syn", "réponse domaine", "flood"]})
    model = LanguageModel(texts)
    trees = [ContextTree({"syn": 2, "sym": 1, "flood": 1}), ContextTree({"réponse": 1, "domaine": 1})]
    words = ["syn", "", "réponse", "floods", "zz漢", "domainedomaine", "s" * 500]
    want = [[t.length(w) for t in trees] for w in words]
    assert np.allclose(model.lengths(words), want, rtol=1e-5)


def test_every_context_counts():
    """Lengths are those of the whole trees also with many contexts, and where one language has far fewer texts."""
    r = random.Random(4)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
    texts = {"a": [word("abcdefghijklm\0") for _ in range(6000)], "b": [word("éèabcnopq漢") for _ in range(3000)], "c": [word("abxyz") for _ in range(40)]}
    trees = [ContextTree(language_model.Counter(texts[x])) for x in "abc"]
    assert len({c for t in trees for c in t.follow}) > 24_000
    model = LanguageModel(pd.DataFrame({"lang": list("abc"), "text": [" ".join(texts[x]) for x in "abc"]}))
    words = [w for x in "abc" for w in texts[x][-300:]] + [word("abcé漢xyz-") for _ in range(300)] + ["", "ab" * 200_000]
    assert np.allclose(model.lengths(words), [[t.length(w) for t in trees] for w in words], rtol=1e-9)


def test_language(spark):
    rows = [(i, sample("aa" if i % 3 else "bb", i), "aa" if i % 3 else "bb", "x") for i in range(90)]
    odd = [(900, None, "aa", "x"), (901, "", None, "x"), (902, "123 $$", "bb", "x"), (903, sample("aa", 5), None, "x"), (903, sample("aa", 5), None, "x"), (None, sample("bb", 6), "bb", "x"), (904, "requête " * 50_000, None, "x")]
    events = spark.createDataFrame(rows + odd, "event_id long, raw string, lang string, score string")
    model = language_model.train_language(events.filter("event_id < 60"))
    got = [(r.event_id, r.lang_pred, r.score) for r in language_model.identify_language(events, model).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == len(rows) + len(odd)
    assert all(by[i][1] == ("aa" if i % 3 else "bb") for i in range(60, 90))
    assert [by[i][1:] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by[903][1] == "aa" and by[None][1] == by[904][1] == "bb" and all(0 <= g[2] <= 1 for g in got)
    assert sum(g[0] == 903 for g in got) == 2
    none = language_model.train_language(events.limit(0))
    assert {r.lang_pred for r in language_model.identify_language(events, none).collect()} == {"und"}
    assert LanguageModel(pd.DataFrame({"lang": ["a", "b"], "text": ["syn", "syn"]})).predict(["syn"])[0][0] == "a"


def test_identity():
    """The linear-time score equals the sum over all pairs."""
    r = np.random.default_rng(1)
    rows = pd.DataFrame({"words": [[1, 2, 3], [4], [1, 1]], "metadata": [[7], [], [8]], "statistics": list(r.random((3, quality_model.STATISTICS))), "label": [1, 0, 1]})
    m = quality_model.FactorisationMachine.fit(rows, epochs=2)
    statistics = np.stack(rows["statistics"])
    ids, values, starts = m.entries(rows["words"].tolist(), rows["metadata"].tolist(), statistics)
    logit, _ = m.logits(ids, values, starts)
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
        x = list(zip(ids[a:b], values[a:b], strict=True))
        pairs = sum(float(m.factors[i] @ m.factors[j]) * u * v for n, (i, u) in enumerate(x) for j, v in x[n + 1 :])
        assert math.isclose(logit[k], m.bias + sum(m.weights[i] * v for i, v in x) + pairs, rel_tol=1e-3, abs_tol=1e-3)


def test_quality(spark):
    good = lambda i: sample("aa", i)
    bad = lambda i: sample("aa", i).upper().replace(" ", "!! ")
    rows = [(i, bad(i) if i % 4 == 0 else good(i), "x") for i in range(200)] + [(500, None, "x"), (501, "", "x"), (502, "a " * 100_000, "x"), (7, good(7), "x"), (None, good(3), "x")]
    events = spark.createDataFrame(rows, "event_id long, raw string, score string")
    reviews = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(150)] + [(151, None), (None, 1)], "event_id long, label int")
    model = quality_model.train_quality(events, reviews)
    got = quality_model.score_quality(events, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert sum(r.predicted == int(r.event_id % 4 != 0) for r in got if r.event_id is not None and 150 <= r.event_id < 200) >= 48
    blank = quality_model.train_quality(events, reviews.limit(0))
    assert quality_model.score_quality(events.limit(0), blank).count() == 0
    with_tags = quality_model.train_quality(events, reviews, metadata_cols=("score",))
    assert quality_model.score_quality(events, with_tags, metadata_cols=("score",)).count() == len(rows)


def test_bounds_count_rows(spark, monkeypatch):
    """Any bound fits a model, and repeated ids bring no more rows to the driver than it says."""
    sizes = []
    build = LanguageModel.__init__
    monkeypatch.setattr(LanguageModel, "__init__", lambda self, frame: sizes.append(frame.groupby("lang").size().to_dict()) or build(self, frame))
    rows = [(i % 400, sample("aa" if i % 2 else "bb", i), "aa" if i % 2 else "bb") for i in range(800)]
    rows += [(7, sample("aa", 1000 + i), "aa") for i in range(500)] + [(8, "equal rows", "bb")] * 500
    events = spark.createDataFrame(rows, "event_id long, raw string, lang string")
    for bound in (1, 10, 16, 21):
        model = language_model.train_language(events, rows_per_language=bound)
        assert model.langs and all(0 < n <= bound for n in sizes[-1].values())
    found = language_model.identify_language(events, language_model.train_language(events, rows_per_language=10)).filter("lang_pred = 'und'")
    assert found.count() == 0
    held = []
    fit = quality_model.FactorisationMachine.fit
    monkeypatch.setattr(quality_model.FactorisationMachine, "fit", staticmethod(lambda frame: held.append(len(frame)) or fit(frame)))
    reviews = spark.createDataFrame([(i, i % 2) for i in range(40)], "event_id long, label int")
    quality_model.train_quality(events, reviews, max_rows=25)
    assert held == [25]
