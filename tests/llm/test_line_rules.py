import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def quality(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA)
    return {r.doc_id: r for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}


def body(i, n=25):
    return " ".join(f"w{i}x{chr(97 + k)}" for k in range(n))


def test_near_copies_leave_one(spark):
    """Of some thousand near copies at one source one stays whole; a line below the host's share stays everywhere."""
    lines = [" ".join(f"l{k}{chr(97 + j)}{x}" for j in range(6)) for k, x in enumerate("abcdefgh")]
    rows = [(i, "\n".join([*lines, f"copy number is {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}"]), "hot") for i in range(3000)]
    got = quality(spark, rows)
    assert set(got) == {0} and got[0].text == rows[0][1]
    rows = [(i, body(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}") + ("\nseen now and then" if i < 150 else ""), "big") for i in range(16_000)]
    got = quality(spark, rows)
    assert len(got) == 16_000 and all(got[i].text == rows[i][1] for i in range(150))


def test_lines_are_removed(spark):
    """Kept documents come out without the lines above the limit, the first holder of them excepted."""
    own = lambda i: body(f"{chr(97 + i % 26)}{chr(97 + i // 26)}")
    rows = [(i, f"{own(i)}\n  Common LINE 7 here\n\n{own(i + 300)}\ncommon line 3 here", "s") for i in range(130)]
    rows += [(500, own(400) + "\ncommon line 3 here", "t")]
    got = quality(spark, rows)
    assert len(got) == 131 and got[0].text == rows[0][1] and got[500].text == rows[-1][1]
    for i in range(1, 130):
        assert got[i].text == f"{own(i)}\n\n{own(i + 300)}" and got[i].n_chars == len(got[i].text)
    places = spark.range(1).select(corpus_pipeline.line_rules.remaining(F.lit("a\nb\na"), F.array(F.lit(0), F.lit(2))).alias("t")).head().t
    assert places == "b"


def test_a_failing_record_holds_nothing(spark):
    """The holder of common lines is one that passes the base rules, so the group is not lost with it."""
    own = lambda i: body(f"{chr(97 + i % 26)}{chr(97 + i // 26)}", 20)
    shared = body("shared", 40)
    rows = [(0, f"{shared}\n" + "again and again it says the same words here " * 20, "s")] + [(i, f"{shared}\n{own(i)}", "s") for i in range(1, 130)]
    got = quality(spark, rows)
    assert set(got) == {1} and got[1].text == rows[1][1]
    rows = [(i, f"{shared}\n" + "again and again it says the same words here " * 20, "s") for i in range(130)]
    assert quality(spark, rows) == {}


def test_removal_keeps_rows_and_columns(spark):
    from tapline.llm.line_rules import remove_common_lines

    own = lambda i: body(f"{chr(97 + i % 26)}{chr(97 + i // 26)}")
    rows = [(i, f"{own(i)}\ncommon words stand here", "s", i, "x") for i in (*range(6), 5)] + [(None, own(30), None, 7, "y"), (9, None, "s", 8, "z"), (10, "", "s", 9, "z")]
    frame = spark.createDataFrame(rows, "event_id long, raw string, sensor string, body long, `judged.id` string")
    got = sorted((r.body, r.raw, r.lines_removed) for r in remove_common_lines(frame, max_documents=3).collect())
    assert got == [(0, rows[0][1], False), *[(i, own(i), True) for i in (1, 2, 3, 4, 5, 5)], (7, own(30), False)]
    assert remove_common_lines(frame.limit(0)).count() == 0
