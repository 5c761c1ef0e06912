"""The pipeline against plain Python, stage by stage, and the registered queries that SQL checks."""

import hashlib
import os
import re
import sys

import duckdb
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools"), os.path.dirname(os.path.abspath(__file__))]

import check  # noqa: E402
import corpus_pipeline  # noqa: E402
from test_near_copies import brute  # noqa: E402

from tapline.llm import queries, secrets  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


def tokens(text):
    return [w.strip(".,!?;:\"'()[]{}*#$%&|<>~`«»¡¿…-–—").lower() for w in text.split()]


def leaks(text, items):
    mine = tokens(text)
    for item in items:
        other = tokens(item)
        need = min(13, -(-len(other) // 2))
        for i in range(len(other) - 7):
            for j in (j for j in range(len(mine) - 7) if mine[j] == other[i]):
                k = 0
                while i + k < len(other) and j + k < len(mine) and other[i + k] == mine[j + k]:
                    k += 1
                if k >= max(8, need):
                    return True
    return False


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}
    items = pq.read_table(f"{FOLDER}/benchmark.parquet")["text"].to_pylist()
    names = [n for n, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    docs = stages[names[0]](spark, docs, FOLDER)
    judged = check.connect(FOLDER).execute(queries.ORACLES["op10_line_quality"]).fetchdf()
    want = set(judged[judged["kept"]]["doc_id"])
    assert ids(docs) == want

    docs = stages[names[1]](spark, docs, FOLDER)
    want = {k for none, k, n, c in brute([(k, rows[k]["text"]) for k in sorted(want)], 5, 80) if c == k}
    assert ids(docs) == want

    docs = stages[names[2]](spark, docs, FOLDER)
    want = {k for k in want if not leaks(rows[k]["text"], items)}
    assert ids(docs) == want

    docs = stages[names[3]](spark, docs, FOLDER)
    clean = {k: secrets.redact(rows[k]["text"], secrets.find_secrets(rows[k]["text"])) for k in want}
    got = {r.doc_id: r for r in docs.collect()}
    assert {k: r.text for k, r in got.items()} == clean and all(r.n_chars == len(r.text) for r in got.values())
    assert docs.columns == list(rows[0]) and not any(re.search("[0-9a-f]{32}", t) for t in clean.values())

    coded = {r.doc_id: r for r in stages[names[4]](spark, docs, FOLDER).collect()}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, text in clean.items():
        assert coded[k].token_ids == t.encode(text, add_special_tokens=False).ids
        assert coded[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert ids(corpus_pipeline.run(spark, FOLDER)) == want


def test_stages_on_odd_rows(spark):
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (None, None, None, None, None, 1), (3, "x " * 60, "en", "s", 120, 1)]
    good = " ".join(f"word{i}" for i in range(40))
    rows += [(4, good, "en", "s", len(good), 1), (4, good, "en", "s", len(good), 1), (5, good + " end", "en", None, 0, 1), (6, "token: 0123456789abcdef " + good[::-1], "en", "s", 0, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept_id int")
    for start in (frame, frame.limit(0)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
            if name != "encoding":
                assert docs.columns == frame.columns
        assert sorted(r.doc_id for r in docs.collect()) == ([4, 6] if start is frame else [])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = check.connect(FOLDER)
    frame = queries.QUERIES[name](spark, FOLDER)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    got, got_names = check.normalised(frame.columns, frame.collect())
    assert (got, got_names) == check.normalised(names, result.fetchall())


def test_line_rules(spark):
    """Removal, depletion and odd rows, against the SQL over the same rows."""
    common = "this line stands in every record of the sensor and says nothing"
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(25))
    rows = [(i, f"{body(i)}\n{common}\n  {common.upper()} ", "s1") for i in range(120)] + [(200 + i, f"{common}\n" * 3 + " ".join(body(i).split()[:12]), "s1") for i in range(5)]
    rows += [(300, body(300) + "\n" + common, "s2"), (301, None, "s1"), (302, "", None), (303, "a b c d e f g h " * 9, None), (304, "é" * 10 + "\t" + body(1) + "\r\n" + body(1), "s1"), (304, body(2), None), (305, "\n\n", "s1"), (306, body(9), "s2"), (306, body(9), "s2")]
    frame = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, source string, kept string")
    got = queries.line_rules.line_quality(frame.select(queries.F.col("doc_id").alias("event_id"), queries.F.col("text").alias("raw"), queries.F.col("source").alias("sensor"), "kept"))
    table = frame.toPandas()  # noqa: F841 - DuckDB reads it by name
    con = duckdb.connect()
    con.register("documents", table)
    result = con.execute(queries.ORACLES["op10_line_quality"])
    names = [d[0] for d in result.description]
    got = got.withColumnRenamed("event_id", "doc_id")
    assert check.normalised(got.columns, got.collect()) == check.normalised(names, result.fetchall())
    kept = {r.doc_id for r in got.filter("kept").collect()}
    assert set(range(120)) <= kept and not kept & {200, 201, 301, 302, 303, 305} and 300 in kept
    assert queries.line_rules.line_quality(frame.limit(0).selectExpr("doc_id event_id", "text raw", "source sensor")).count() == 0
