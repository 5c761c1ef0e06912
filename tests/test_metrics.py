import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tapline.operators import alerts as A
from tapline.operators import isolation as I
from tapline.operators import joins as J
from tapline.operators import metrics as M
from tapline.operators import reports as R
from tapline.operators import splits as L


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(8)
    data = [(i, rng.randint(0, 1), round(rng.random(), 2), "big" if i % 3 else f"s{i % 7}") for i in range(600)]
    return spark.createDataFrame(data, "id long, label long, score double, source string").cache()


def pair_auc(frame):
    p, q = frame[frame.label == 1].score.to_numpy(), frame[frame.label == 0].score.to_numpy()
    return None if not len(p) or not len(q) else float(((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q)))


def test_auc_against_all_pairs(scored):
    frame = scored.toPandas()
    assert abs(M.roc_auc(scored, "label", "score").first().roc_auc - pair_auc(frame)) < 1e-12
    for r in M.roc_auc(scored, "label", "score", ["source"]).collect():
        assert abs(r.roc_auc - pair_auc(frame[frame.source == r.source])) < 1e-12
    assert M.roc_auc(scored.filter("label = 1"), "label", "score").first().roc_auc is None


def test_score_totals_do_not_depend_on_chunks(scored):
    shape = lambda df: sorted((r.source, r.score, r.p_below, r.q_below, r.all_p, r.all_q) for r in df.collect())
    small = M._by_score(scored, "label", "score", ["source"], rows=10)
    assert shape(small) == shape(M._by_score(scored, "label", "score", ["source"]))


@pytest.mark.parametrize("name", list(M.GRIDS))
def test_sweep_against_each_threshold(scored, name):
    grid = M.threshold_grid(name)
    frame = scored.toPandas()
    got = {r.threshold: (r.tp, r.fp, r.tn, r.fn) for r in M.threshold_sweep(scored, "label", "score", grid).collect()}
    assert len(got) == len(grid)
    for t in grid:
        hit, pos = frame.score >= t, frame.label == 1
        assert got[t] == ((hit & pos).sum(), (hit & ~pos).sum(), (~hit & ~pos).sum(), (~hit & pos).sum())


def test_published_confusion_rates(spark):
    one = spark.range(1).select(*[v.alias(k) for k, v in M.confusion_metrics(F.lit(2559), F.lit(836), F.lit(160525), F.lit(3374)).items()]).first()
    assert (round(one.accuracy, 6), round(one.fpr, 6), round(one.recall, 6)) == (0.974835, 0.005181, 0.431316)


def test_latency_golden(spark):
    df = spark.createDataFrame([("queue_wait", float(v)) for v in (1, 2, 3, 4)], "metric string, v double")
    r = R.latency_report(df, "metric", "v").first()
    assert (r["count"], r["p50"], round(r["p95"], 9), round(r["p99"], 9), r["max"]) == (4, 2.5, 3.85, 3.97, 4.0)


def test_run_report_needs_every_count(spark):
    df = spark.createDataFrame([("packet", 2, 10), ("packet", 3, None), ("conn", None, None)], "kind string, n long, size long")
    r = R.run_report(df, "kind", "n", "size", 2.0).first()
    assert (r.packets_per_second, r.packet_bytes, r.megabits_per_second, r.flows_per_second) == (2.5, None, None, 0.5)


def test_alert_store(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("a", 4)], "alert_id string, at long")
    assert [r["alert_id"] for r in rows(A.keep_latest(df, "alert_id", "at", 2), "at")] == ["b", "c"]
    assert {(r["alert_id"], r["at"]) for r in rows(J.merge_latest(df, "alert_id", "at"))} == {("a", 4), ("b", 2), ("c", 3)}


def test_incidents_on_a_hot_entity(spark):
    data = [("h", i * 10 if i < 50 else 5000 + i, f"c{i % 2}") for i in range(100)] + [("k", 0, "c0")]
    df = spark.createDataFrame(data, "entity string, s long, threat_class string").withColumn("ts", F.timestamp_seconds("s"))
    for size in (6, 10_000):
        got = rows(A.correlate_alerts(df, "entity", gap_seconds=60, rows=size), "entity", "incident_no")
        assert [(r["entity"], r["alert_count"], r["threat_chain"]) for r in got] == [("h", 50, "c0 > c1"), ("h", 50, "c0 > c1"), ("k", 1, "c0")]


def test_gate_and_risk(spark):
    status = spark.createDataFrame([("d1", True, None)], "detector string, ready boolean, error_reason string")
    good, bad = A.gate_ready(spark.createDataFrame([("d1",), ("d2",)], "detector string"), status)
    assert good.count() == 1 and bad.first().reject_reason == "Skipped: Detector is not ready_for_inference"
    df = spark.createDataFrame([(0.9, None, 0.9, 0.9), (0.9, "LOW", 0.9, 0.9)], "s double, c string, p double, i double")
    got = [r.severity for r in A.risk_score(df, "s", "c", "p", "i").orderBy(F.desc("risk_score")).collect()]
    assert got == ["CRITICAL", "HIGH"]


def test_risk_on_a_limit(spark):
    # each of these is exactly 0.4 or 0.6 in decimal and just below it as a sum of doubles
    data = [(52.5 / 300, None, 0.7, 0.7), (81.75 / 300, "HIGH", 0.18, 0.3), (105.0 / 300, None, 0.95, 0.9)]
    out = A.risk_score(spark.createDataFrame(data, "s double, c string, p double, i double"), "s", "c", "p", "i")
    assert [r.severity for r in out.orderBy("s").collect()] == ["MEDIUM", "MEDIUM", "HIGH"]


def test_folds_keep_sources_whole(scored):
    folded = L.assign_folds(scored, L.group_kfold(scored, "source", "label", 3), "source")
    report = rows(L.fold_report(folded, "source", "label"), "fold")
    assert sum(r["validation_rows"] for r in report) == 600 and all(r["leaking_sources"] == 0 for r in report)


def test_ground_truth(spark):
    alerts = spark.createDataFrame([("t", 100), ("t", 5000), ("u", 100)], "target string, s long").withColumn("ts", F.timestamp_seconds("s"))
    plan = spark.createDataFrame([("s1", "t", 50, 4000), ("s2", "u", 200, 300)], "scenario_id string, target string, a long, b long")
    plan = plan.select("scenario_id", "target", F.timestamp_seconds("a").alias("start_time"), F.timestamp_seconds("b").alias("end_time"))
    got = rows(J.detection_latency(alerts, plan, ["target"]), "scenario_id")
    assert [(r["alert_count"], r["detection_latency"], r["missed"]) for r in got] == [(1, 50.0, False), (0, None, True)]


def test_isolation_finds_the_odd_rows(spark):
    rng = np.random.default_rng(1)
    data = [(i, *map(float, rng.normal(0, 1, 3))) for i in range(400)]
    df = spark.createDataFrame(data, "id long, a double, b double, c double")
    model = I.fit_isolation(df, ["a", "b", "c"], "id", trees=60, sample_size=64)
    odd = spark.createDataFrame([(900, 9.0, -9.0, 9.0), (901, 0.0, 0.0, 0.0)], df.schema)
    got = rows(I.assess(odd, model), "id")
    assert got[0]["is_outlier"] and not got[1]["is_outlier"] and got[0]["anomaly_score"] > 0.6
    flagged = I.assess(df, model).filter("is_outlier").count()
    assert flagged == 8  # two per cent of the baseline
    again = I.fit_isolation(df.repartition(7), ["a", "b", "c"], "id", trees=60, sample_size=64)
    assert again.limit == model.limit
    with pytest.raises(ValueError, match="At least 20"):
        I.fit_isolation(df.limit(5), ["a", "b", "c"], "id")
