"""Evaluation, profile, split and model queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..operators import isolation as I
from ..operators import drift as K
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import profile as D
from ..operators import splits as L
from ..operators import stability as Y
from ..operators.alerts import review_reasons, review_records
from . import views as V
from .registry import Tables, query, rounded

_CONF = """sum(CASE WHEN score>={t} AND label=1 THEN 1 ELSE 0 END)::bigint AS tp, sum(CASE WHEN score>={t} AND label=0 THEN 1 ELSE 0 END)::bigint AS fp,
  sum(CASE WHEN score<{t} AND label=0 THEN 1 ELSE 0 END)::bigint AS tn, sum(CASE WHEN score<{t} AND label=1 THEN 1 ELSE 0 END)::bigint AS fn"""
_DIV = lambda a, b: f"CASE WHEN ({b})<>0 THEN ({a})/({b}) ELSE 0 END"
_F1 = _DIV("2*tp", "2*tp+fp+fn")
_RATES = f"""tp, fp, tn, fn, round({_DIV('tp+tn', 'tp+fp+tn+fn')},6) AS accuracy, round({_DIV('tp', 'tp+fp')},6) AS "precision", round({_DIV('tp', 'tp+fn')},6) AS recall,
  round({_F1},6) AS f1, round({_DIV('fp', 'fp+tn')},6) AS fpr, round({_DIV('fn', 'fn+tp')},6) AS fnr, round({_DIV('tn', 'tn+fp')},6) AS specificity,
  round(({_F1}+{_DIV('2*tn', '2*tn+fp+fn')})/2,6) AS macro_f1"""


@query("binary_metrics", f"WITH {V.SCORED_SQL}, c AS (SELECT count(*) AS rows, {_CONF.format(t=0.5)} FROM v_scored) SELECT rows, {_RATES} FROM c")
def binary_metrics(t: Tables):
    return rounded(M.binary_metrics(V.scored(t), "label", "score", 0.5))


def _auc_sql(source: str, key: str) -> str:
    """Rank AUC of v over label per key, as a CTE body."""
    part = f"PARTITION BY {key} " if key else ""
    cols = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    return f"""rk AS (
  SELECT {cols}label, rank() OVER ({part}ORDER BY v) AS lo, count(*) OVER (PARTITION BY {cols}v) AS same FROM {source}),
au AS (SELECT {cols}sum(CASE WHEN label=1 THEN lo+(same-1)/2.0 ELSE 0 END) AS s, count(*) FILTER (label=1) AS p, count(*) FILTER (label=0) AS q FROM rk {group}),
auc AS (SELECT {cols}p, q, CASE WHEN p>0 AND q>0 THEN (s-p*(p+1)/2.0)/(p*q) END AS a FROM au)"""


@query(
    "metrics_by_source",
    f"""WITH {V.SCORED_SQL}, x AS (SELECT origin, label, score AS v FROM v_scored), {_auc_sql('x', 'origin')},
c AS (SELECT origin, count(*) AS rows, {_CONF.format(t=0.5)} FROM v_scored GROUP BY origin)
SELECT c.origin, rows, {_RATES}, round(a,6) AS roc_auc FROM c JOIN auc ON c.origin=auc.origin""",
)
def metrics_by_source(t: Tables):
    return rounded(M.metrics_by_group(V.scored(t), "label", "score", 0.5, ["origin"]))


def _sweep_sql(first: float, step: float, n: int) -> str:
    return f"""g AS (SELECT round({first}+i*{step},6)::double AS threshold FROM (SELECT unnest(range(0,{n})) AS i)),
sw AS (SELECT threshold, {_CONF.format(t='threshold')} FROM v_scored, g GROUP BY threshold),
sr AS (SELECT threshold, {_RATES} FROM sw)"""


_COARSE = _sweep_sql(0.05, 0.01, 91)


@query("threshold_sweep", f"WITH {V.SCORED_SQL}, {_COARSE} SELECT * FROM sr")
def threshold_sweep(t: Tables):
    return rounded(M.threshold_sweep(V.scored(t), "label", "score", M.threshold_grid("coarse")))


@query("threshold_sweep_dense", f"WITH {V.SCORED_SQL}, {_sweep_sql(0.001, 0.001, 999)} SELECT threshold, tp, fp, tn, fn FROM sr")
def threshold_sweep_dense(t: Tables):
    out = M.threshold_sweep(V.scored(t), "label", "score", M.threshold_grid("dense"))
    return rounded(out.select("threshold", "tp", "fp", "tn", "fn"))


@query(
    "pick_threshold",
    f"""WITH {V.SCORED_SQL}, {_COARSE}, a AS (SELECT 'best_f1' AS rule, * FROM sr ORDER BY f1 DESC, threshold LIMIT 1),
b AS (SELECT 'recall_90' AS rule, * FROM sr WHERE recall>=0.9 ORDER BY f1 DESC, threshold LIMIT 1),
c AS (SELECT 'nearest_0333' AS rule, * FROM sr ORDER BY abs(threshold-0.333), threshold LIMIT 1)
SELECT rule, threshold, recall, f1, fpr FROM a UNION ALL SELECT rule, threshold, recall, f1, fpr FROM b UNION ALL SELECT rule, threshold, recall, f1, fpr FROM c""",
)
def pick_threshold(t: Tables):
    sweep = rounded(M.threshold_sweep(V.scored(t), "label", "score", M.threshold_grid("coarse")))
    rules = {"best_f1": M.pick_threshold(sweep), "recall_90": M.pick_threshold(sweep, min_recall=0.9), "nearest_0333": M.nearest_threshold(sweep, 0.333)}
    picked = [v.select(F.lit(k).alias("rule"), "threshold", "recall", "f1", "fpr") for k, v in rules.items()]
    return J.concat(*picked)


@query(
    "precision_target",
    f"""WITH {V.SCORED_SQL}, {_COARSE}, p AS (SELECT target, sr.*, row_number() OVER (PARTITION BY target ORDER BY recall DESC, threshold) AS rn
FROM sr, (SELECT unnest([0.01,0.05,0.1,0.2,0.3,0.5])::double AS target) WHERE "precision">=target)
SELECT target, threshold, "precision", recall, f1, fpr FROM p WHERE rn=1""",
)
def precision_target(t: Tables):
    sweep = rounded(M.threshold_sweep(V.scored(t), "label", "score", M.threshold_grid("coarse")))
    return M.precision_targets(sweep, [0.01, 0.05, 0.1, 0.2, 0.3, 0.5])


@query("threshold_neighbourhood", f"WITH {V.SCORED_SQL}, {_COARSE} SELECT threshold, recall, f1 FROM sr WHERE abs(threshold-0.5)<=0.05+1e-9")
def threshold_neighbourhood(t: Tables):
    sweep = M.threshold_sweep(V.scored(t), "label", "score", M.threshold_grid("coarse"))
    return rounded(M.threshold_neighbourhood(sweep, 0.5).select("threshold", "recall", "f1"))


@query(
    "roc_auc",
    f"WITH {V.SCORED_SQL}, x AS (SELECT label, score AS v FROM v_scored), {_auc_sql('x', '')} SELECT round(a,6) AS roc_auc, p AS positives, q AS negatives FROM auc",
)
def roc_auc(t: Tables):
    return rounded(M.roc_auc(V.scored(t), "label", "score"))


_POINTS = """pt AS (SELECT source, score, count(*) FILTER (label=1) AS p, count(*) FILTER (label=0) AS q FROM v_scored GROUP BY 1,2),
pc AS (SELECT source, score, p, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY source) AS pp, sum(q) OVER (PARTITION BY source) AS qq FROM pt
  WINDOW w AS (PARTITION BY source ORDER BY score DESC))"""


@query("average_precision", f"WITH {V.SCORED_SQL}, {_POINTS} SELECT source, round(sum(p/nullif(pp,0)*tp/(tp+fp)),6) AS average_precision FROM pc GROUP BY 1")
def average_precision(t: Tables):
    return rounded(M.average_precision(V.scored(t), "label", "score", ["source"]))


@query(
    "roc_points",
    f"""WITH {V.SCORED_SQL}, {_POINTS} SELECT source, score, tp::bigint AS tp, fp::bigint AS fp, round(coalesce(tp/nullif(pp,0),0),6) AS tpr, round(coalesce(fp/nullif(qq,0),0),6) AS fpr,
  round(tp/(tp+fp),6) AS "precision", round(coalesce(tp/nullif(pp,0),0)-coalesce(fp/nullif(qq,0),0),6)+0.0 AS youden_j FROM pc""",
)
def roc_points(t: Tables):
    return rounded(M.roc_points(V.scored(t), "label", "score", ["source"]).drop("f1"))


@query(
    "best_points",
    f"""WITH {V.SCORED_SQL}, {_POINTS}, v AS (SELECT source, score, coalesce(tp/nullif(pp,0),0)-coalesce(fp/nullif(qq,0),0) AS j, 2*tp/(tp+fp+pp) AS f FROM pc)
SELECT source, arg_max(score, round(j,12)*1e6+score*1e-9) AS youden_score, round(max(j),6)+0.0 AS youden_j, round(max(f),6) AS max_f1 FROM v GROUP BY 1""",
)
def best_points(t: Tables):
    out = M.best_points(M.roc_points(V.scored(t), "label", "score", ["source"]), ["source"])
    return rounded(out.drop("f1_score"))


@query(
    "univariate_auc",
    f"""WITH {V.SCORED_SQL}, x AS (SELECT 'n_chars' AS feature, label, n_chars::double AS v FROM v_scored UNION ALL SELECT 'quality', label, quality FROM v_scored
UNION ALL SELECT 'score', label, score FROM v_scored UNION ALL SELECT 'constant', label, 1 FROM v_scored), {_auc_sql('x', 'feature')}
SELECT feature, round(a,6) AS raw_auc, round(greatest(a,1-a),6) AS auc, CASE WHEN a>0.5 THEN 'positive' WHEN a<0.5 THEN 'negative' ELSE 'none' END AS direction FROM auc""",
)
def univariate_auc(t: Tables):
    rows = V.scored(t).withColumn("constant", F.lit(1))
    return rounded(M.univariate_auc(rows, ["n_chars", "quality", "score", "constant"], "label"))


@query(
    "calibration",
    f"""WITH {V.SCORED_SQL}, b AS (SELECT least(floor(score*10),9)::bigint AS bin, count(*) AS rows, avg(score) AS m, avg(label) AS o, sum((score-label)*(score-label)) AS sq FROM v_scored GROUP BY 1)
SELECT bin, rows, round(m,6) AS mean_score, round(o,6) AS observed_rate, round(abs(m-o)*rows/sum(rows) OVER (),6) AS ece_part, round(sq/sum(rows) OVER (),6) AS brier_part FROM b""",
)
def calibration(t: Tables):
    return rounded(M.calibration_report(V.scored(t), "label", "score"))


@query(
    "calibration_summary",
    f"""WITH {V.SCORED_SQL}, b AS (SELECT least(floor(score*10),9) AS bin, count(*) AS rows, abs(avg(score)-avg(label)) AS gap, sum((score-label)*(score-label)) AS sq FROM v_scored GROUP BY 1)
SELECT round(sum(sq)/sum(rows),6) AS brier, round(sum(gap*rows)/sum(rows),6) AS ece FROM b""",
)
def calibration_summary(t: Tables):
    return rounded(M.calibration_summary(M.calibration_report(V.scored(t), "label", "score")))


@query(
    "score_report",
    f"""WITH {V.SCORED_SQL}, g AS (SELECT unnest([0.1,0.2,0.35,0.9])::double AS threshold),
c AS (SELECT threshold, count(*) AS rows, {_CONF.format(t='threshold')} FROM v_scored, g GROUP BY threshold) SELECT threshold, rows, {_RATES} FROM c""",
)
def score_report(t: Tables):
    return rounded(M.score_report(V.scored(t), "label", "score", [0.1, 0.2, 0.35, 0.9]))


@query("false_negatives", f"WITH {V.SCORED_SQL} SELECT doc_id, score FROM v_scored WHERE label=1 AND score<0.5")
def false_negatives(t: Tables):
    return M.false_negatives(V.scored(t), "label", "score", 0.5).select("doc_id", "score")


@query(
    "drift_score",
    """WITH x AS (SELECT CASE WHEN event_id%2=0 THEN 0 ELSE 1 END AS live, f AS feature, CASE f WHEN 'value' THEN value ELSE cast(json_extract_string(props,'$.k') AS double) END AS v
  FROM events, (SELECT unnest(['value','k']) AS f)),
s AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM x WHERE live=0 GROUP BY 1),
b AS (SELECT x.feature, greatest(0, least(9, floor((v-lo)*10/(hi-lo)))) AS bin, count(*) FILTER (live=0) AS a, count(*) FILTER (live=1) AS c FROM x JOIN s ON x.feature=s.feature GROUP BY 1,2),
p AS (SELECT feature, greatest(a/sum(a) OVER (PARTITION BY feature),1e-4) AS a, greatest(c/sum(c) OVER (PARTITION BY feature),1e-4) AS c FROM b),
q AS (SELECT feature, sum((c-a)*ln(c/a)) AS psi FROM p GROUP BY 1),
d AS (SELECT feature, v, count(*) FILTER (live=0) AS a, count(*) FILTER (live=1) AS c FROM x GROUP BY 1,2),
e AS (SELECT feature, abs(sum(a) OVER (PARTITION BY feature ORDER BY v)/sum(a) OVER (PARTITION BY feature)-sum(c) OVER (PARTITION BY feature ORDER BY v)/sum(c) OVER (PARTITION BY feature)) AS gap FROM d)
SELECT q.feature, round(any_value(psi),6)+0.0 AS psi, round(max(gap),6) AS ks FROM q JOIN e ON q.feature=e.feature GROUP BY q.feature""",
)
def drift_score(t: Tables):
    rows = V.events(t)
    even = F.col("event_id") % 2 == 0
    return rounded(M.drift_score(rows.filter(even), rows.filter(~even), ["value", "k"]))


@query("drift_of_profiles", "SELECT unnest(['value','k']) AS feature, true AS psi_near, true AS ks_near")
def drift_of_profiles(t: Tables):
    """Whether drift from stored daily profiles and a live one is within the stated error of the exact drift."""
    rows, columns = V.events(t), ["value", "k"]
    even = F.col("event_id") % 2 == 0
    daily = K.profile_features(rows.filter(even).withColumn("day", F.to_date("ts")), columns, by=["day"])
    sketched = K.drift_from_profiles(K.merge_profiles(daily), K.profile_features(rows.filter(~even), columns))
    exact = M.drift_score(rows.filter(even), rows.filter(~even), columns).toDF("feature", "exact_psi", "exact_ks")
    near = lambda c, most: (F.abs(F.col(c) - F.col(f"exact_{c}")) <= most).alias(f"{c}_near")
    return sketched.join(exact, "feature").select("feature", near("psi", 0.05), near("ks", 0.015))


# --- profiles ----------------------------------------------------------------------------------

_LINE = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(
    "class_distribution",
    "SELECT l_returnflag, l_linestatus, count(*) AS rows, round(count(*)/(SELECT count(*) FROM lineitem),6) AS share FROM lineitem GROUP BY 1,2",
)
def class_distribution(t: Tables):
    return rounded(D.class_distribution(t.lineitem, ["l_returnflag", "l_linestatus"]))


@query("source_label_matrix", f"WITH {V.SCORED_SQL} SELECT origin, count(*) FILTER (label=0) AS label_0, count(*) FILTER (label=1) AS label_1, count(*) AS rows FROM v_scored GROUP BY 1")
def source_label_matrix(t: Tables):
    return D.source_label_matrix(V.scored(t), "origin", "label")


@query(
    "duplicate_report",
    f"""WITH p AS (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(_LINE)})
SELECT sum(n)::bigint AS total_rows, count(*) AS unique_vectors, coalesce(sum(n) FILTER (n>1),0)::bigint AS rows_in_duplicated, sum(n-1)::bigint AS surplus_rows, max(n) AS max_multiplicity,
  count(*) FILTER (n>1) AS patterns_over_1, count(*) FILTER (n>=5) AS patterns_5_plus, count(*) FILTER (n>=10) AS patterns_10_plus FROM p""",
)
def duplicate_report(t: Tables):
    return D.duplicate_report(t.lineitem, _LINE)


@query(
    "duplicate_rate_by_source",
    """WITH p AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_quantity, l_discount)
SELECT l_returnflag, sum(n)::bigint AS rows, count(*) AS unique_vectors, round((sum(n)-count(*))/sum(n),6) AS duplicate_rate FROM p GROUP BY 1""",
)
def duplicate_rate(t: Tables):
    return rounded(D.duplicate_rate_by_source(t.lineitem, ["l_quantity", "l_discount"], "l_returnflag"))


_CONFLICT = """p AS (SELECT l_quantity, l_discount, l_tax, count(*) AS n, sum(CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END) AS a,
  min(l_returnflag) AS s0, max(l_returnflag) AS s1 FROM lineitem GROUP BY 1,2,3)"""


@query(
    "label_conflicts",
    f"""WITH {_CONFLICT} SELECT count(*) AS patterns, count(*) FILTER (a>0 AND a<n) AS conflicting_patterns, coalesce(sum(n) FILTER (a>0 AND a<n),0)::bigint AS conflicting_rows,
  count(*) FILTER (s0<>s1) AS cross_source_patterns, coalesce(sum(n) FILTER (s0<>s1),0)::bigint AS cross_source_rows FROM p""",
)
def label_conflicts(t: Tables):
    rows = t.lineitem.withColumn("label", (F.col("l_linestatus") == "O").cast("long"))
    return D.label_conflicts(rows, ["l_quantity", "l_discount", "l_tax"], "label", "l_returnflag")


_KIND = "CASE WHEN a=0 THEN 'Benign-only' WHEN a=n THEN 'Attack-only' ELSE 'Mixed' END"


@query(
    "pattern_stats",
    f"""WITH {_CONFLICT} SELECT l_quantity, l_discount, l_tax, n AS train_count, a::bigint AS train_attack_count, round(a/n,6) AS train_attack_rate, {_KIND} AS pattern_type,
  round(greatest(a/n,1-a/n),6) AS majority_accuracy, round(0.5-abs(a/n-0.5),6)+0.0 AS ambiguity FROM p""",
)
def pattern_stats(t: Tables):
    rows = t.lineitem.withColumn("label", (F.col("l_linestatus") == "O").cast("long"))
    return rounded(D.pattern_stats(rows, ["l_quantity", "l_discount", "l_tax"], "label"))


def _halves(t: Tables):
    """Lines of even orders as training rows, of odd orders as test rows, with a pattern key."""
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", (F.col("l_linestatus") == "O").cast("long").alias("label"),
        P.pattern_key("l_quantity", "l_discount").alias("key"), P.canonical_key("l_quantity", "l_returnflag").alias("raw_key"),
    )
    even = F.col("l_orderkey") % 2 == 0
    return rows.filter(even), rows.filter(~even)


@query(
    "attach_pattern_stats",
    """WITH p AS (SELECT l_quantity, l_discount, count(*) AS n, sum(CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END) AS a FROM lineitem WHERE l_orderkey%2=0 GROUP BY 1,2)
SELECT CASE WHEN n IS NULL THEN 'Unseen' WHEN a=0 THEN 'Benign-only' WHEN a=n THEN 'Attack-only' ELSE 'Mixed' END AS pattern_type, coalesce(a,0)>0 AS seen_as_attack,
  count(*) AS rows FROM lineitem t LEFT JOIN p ON t.l_quantity=p.l_quantity AND t.l_discount=p.l_discount WHERE l_orderkey%2=1 GROUP BY 1,2""",
)
def attach_pattern_stats(t: Tables):
    train, test = _halves(t)
    stats = D.pattern_stats(train, ["key"], "label").select("key", "train_count", "train_attack_count")
    out = J.attach_pattern_stats(test, stats, "key")
    return out.groupBy("pattern_type", "seen_as_attack").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "key_overlap",
    """WITH tr AS (SELECT * FROM lineitem WHERE l_orderkey%2=0), te AS (SELECT * FROM lineitem WHERE l_orderkey%2=1),
e AS (SELECT DISTINCT l_quantity, l_discount FROM tr), r AS (SELECT DISTINCT l_quantity, l_returnflag FROM tr),
j AS (SELECT e.l_quantity IS NOT NULL AS e, r.l_quantity IS NOT NULL AS r FROM te LEFT JOIN e ON te.l_quantity=e.l_quantity AND te.l_discount=e.l_discount
  LEFT JOIN r ON te.l_quantity=r.l_quantity AND te.l_returnflag=r.l_returnflag)
SELECT count(*) AS rows, count(*) FILTER (e) AS engineered_seen, count(*) FILTER (r) AS raw_seen, count(*) FILTER (e AND r) AS both_seen,
  count(*) FILTER (e AND NOT r) AS engineered_only, count(*) FILTER (r AND NOT e) AS raw_only FROM j""",
)
def key_overlap(t: Tables):
    train, test = _halves(t)
    return J.key_overlap(train, test, "key", "raw_key")


@query(
    "fp_contribution",
    f"""WITH {V.SCORED_SQL}, c AS (SELECT origin, count(*) FILTER (label=0) AS b, count(*) FILTER (label=0 AND score>=0.5) AS f FROM v_scored GROUP BY 1)
SELECT origin, b AS benign_rows, f AS false_positives, round(CASE WHEN b<>0 THEN f/b ELSE 0 END,6) AS fpr, round(f/sum(f) OVER (),6) AS fp_share FROM c""",
)
def fp_contribution(t: Tables):
    rows = V.scored(t).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return rounded(D.fp_contribution(rows, "origin", "label", "predicted"))


@query(
    "fp_patterns",
    f"""WITH {V.SCORED_SQL} SELECT source, quality, count(*) AS false_positives FROM v_scored WHERE label=0 AND score>=0.5 GROUP BY 1,2 ORDER BY 3 DESC, 1, 2 LIMIT 20""",
)
def fp_patterns(t: Tables):
    rows = V.scored(t).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return D.fp_patterns(rows, ["source", "quality"], "label", "predicted")


@query(
    "column_profile",
    """WITH x AS (SELECT f AS feature, CASE f WHEN 'o_orderstatus' THEN o_orderstatus WHEN 'o_orderpriority' THEN o_orderpriority WHEN 'o_custkey' THEN cast(o_custkey AS varchar)
    ELSE CASE WHEN o_orderkey%3=0 THEN NULL ELSE 'x' END END AS v FROM orders, (SELECT unnest(['o_orderstatus','o_orderpriority','o_custkey','holes']) AS f)),
c AS (SELECT feature, v, count(*) AS n FROM x GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, v NULLS FIRST) AS rn FROM c)
SELECT feature, sum(n)::bigint AS rows, coalesce(sum(n) FILTER (v IS NULL),0)::bigint AS nulls, count(*) AS distinct_values, max(n) AS dominant_count,
  max(v) FILTER (rn=1) AS dominant_value, round(max(n)/sum(n),6) AS dominant_share, count(*)=1 AS constant FROM r GROUP BY 1""",
)
def column_profile(t: Tables):
    rows = t.orders.withColumn("holes", F.when(F.col("o_orderkey") % 3 != 0, "x"))
    return rounded(D.profile(rows, ["o_orderstatus", "o_orderpriority", "o_custkey", "holes"]))


_LONG = "x AS (SELECT f AS feature, CASE f WHEN 'l_quantity' THEN l_quantity ELSE l_extendedprice END AS v, CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END AS label FROM lineitem, (SELECT unnest(['l_quantity','l_extendedprice']) AS f))"


@query(
    "describe_columns",
    f"""WITH {_LONG} SELECT feature, count(v) AS "count", round(avg(v),4) AS mean, round(stddev_samp(v),4) AS std, round(min(v),4) AS "min", round(max(v),4) AS "max",
  round(quantile_cont(v,0.25),4) AS p25, round(quantile_cont(v,0.5),4) AS median, round(quantile_cont(v,0.75),4) AS p75 FROM x GROUP BY 1""",
)
def describe_columns(t: Tables):
    return rounded(D.describe(t.lineitem, ["l_quantity", "l_extendedprice"]), 4)


@query(
    "class_compare",
    f"""WITH {_LONG}, c AS (SELECT feature, avg(v) FILTER (label=0) AS m0, avg(v) FILTER (label=1) AS m1, quantile_cont(v,0.5) FILTER (label=0) AS d0, quantile_cont(v,0.5) FILTER (label=1) AS d1 FROM x GROUP BY 1)
SELECT feature, round(m0,4) AS mean_0, round(m1,4) AS mean_1, round(d0,4) AS median_0, round(d1,4) AS median_1, round(m1-m0,4)+0.0 AS mean_difference, round(d1-d0,4)+0.0 AS median_difference FROM c""",
)
def class_compare(t: Tables):
    rows = t.lineitem.withColumn("label", (F.col("l_linestatus") == "O").cast("int"))
    return rounded(D.class_compare(rows, ["l_quantity", "l_extendedprice"], "label"), 4)


@query(
    "correlation_pairs",
    """SELECT 'l_quantity' AS feature_a, 'l_extendedprice' AS feature_b, round(corr(l_quantity,l_extendedprice),6)+0.0 AS correlation FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity,l_discount),6)+0.0 FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice,l_discount),6)+0.0 FROM lineitem""",
)
def correlation_pairs(t: Tables):
    return rounded(D.correlation_pairs(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]))


@query(
    "strong_correlations",
    """WITH o AS (SELECT *, o_totalprice*2 AS double_price FROM orders),
c AS (SELECT 'o_totalprice' AS feature_a, 'double_price' AS feature_b, corr(o_totalprice, double_price) AS r FROM o
  UNION ALL SELECT 'o_totalprice', 'o_custkey', corr(o_totalprice, o_custkey) FROM o UNION ALL SELECT 'double_price', 'o_custkey', corr(double_price, o_custkey) FROM o)
SELECT feature_a, feature_b, round(r,6) AS correlation FROM c WHERE abs(r)>=0.95""",
)
def strong_correlations(t: Tables):
    rows = t.orders.withColumn("double_price", F.col("o_totalprice") * 2)
    return rounded(D.correlation_pairs(rows, ["o_totalprice", "double_price", "o_custkey"], 0.95))


_MI = """s AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM x GROUP BY 1),
j AS (SELECT x.feature, CASE WHEN hi>lo THEN least(floor((v-lo)*20/(hi-lo)),19) ELSE 0 END AS bin, label, count(*) AS n FROM x JOIN s ON x.feature=s.feature GROUP BY 1,2,3),
m AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS b, sum(n) OVER (PARTITION BY feature, label) AS l FROM j),
mi AS (SELECT feature, sum(n/t*ln(n*t/(b*l))) AS mi FROM m GROUP BY 1)"""
_THREE = """x AS (SELECT 'n_chars' AS feature, label, n_chars::double AS v FROM v_scored UNION ALL SELECT 'quality', label, quality FROM v_scored UNION ALL SELECT 'score', label, score FROM v_scored)"""


@query("mutual_information", f"WITH {V.SCORED_SQL}, {_THREE}, {_MI} SELECT feature, round(mi,6)+0.0 AS mutual_information FROM mi")
def mutual_information(t: Tables):
    return rounded(D.mutual_information(V.scored(t), ["n_chars", "quality", "score"], "label"))


@query(
    "feature_ranking",
    f"""WITH {V.SCORED_SQL}, {_THREE}, {_MI}, {_auc_sql('x', 'feature')}, z AS (SELECT mi.feature, round(greatest(a,1-a),6) AS auc, round(mi,6)+0.0 AS mutual_information FROM mi JOIN auc ON mi.feature=auc.feature)
SELECT feature, auc, mutual_information, rank() OVER (ORDER BY auc DESC) AS auc_rank, rank() OVER (ORDER BY mutual_information DESC) AS mutual_information_rank,
  (rank() OVER (ORDER BY auc DESC)+rank() OVER (ORDER BY mutual_information DESC))/2.0::double AS mean_rank FROM z""",
)
def feature_ranking(t: Tables):
    cols = ["n_chars", "quality", "score"]
    auc = rounded(M.univariate_auc(V.scored(t), cols, "label").select("feature", "auc"))
    info = rounded(D.mutual_information(V.scored(t), cols, "label"))
    return rounded(D.rank_features(J.merge_rankings(auc, info), ["auc", "mutual_information"]))


@query(
    "score_distribution",
    f"""WITH {V.SCORED_SQL} SELECT source, label, count(*) AS "count", min(score) AS "min", max(score) AS "max", round(avg(score),6) AS mean,
  round(quantile_cont(score,0.25),6) AS p25, round(quantile_cont(score,0.5),6) AS median, round(quantile_cont(score,0.75),6) AS p75, round(quantile_cont(score,0.9),6) AS p90,
  round(quantile_cont(score,0.95),6) AS p95 FROM v_scored GROUP BY 1,2""",
)
def score_distribution(t: Tables):
    return rounded(D.score_distribution(V.scored(t), ["source", "label"], "score"))


@query("top_scores", f"WITH {V.SCORED_SQL} SELECT doc_id, score FROM v_scored ORDER BY score DESC, doc_id LIMIT 20")
def top_scores(t: Tables):
    return D.top_k(V.scored(t).select("doc_id", "score"), 20, F.desc("score"), F.col("doc_id"))


@query(
    "best_per_group",
    """SELECT l_suppkey, arg_min(l_orderkey, (-l_extendedprice, l_orderkey)) AS l_orderkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1""",
)
def best_per_group(t: Tables):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_extendedprice")
    return D.best_per_group(rows, ["l_suppkey"], F.col("l_extendedprice"), F.col("l_orderkey"))


@query("series_peak", f"WITH {V.EVENTS_SQL} SELECT event_type, arg_min(t, (-value, t)) AS peak_us, max(value) AS peak_value FROM v_events GROUP BY 1")
def series_peak(t: Tables):
    return D.series_peak(V.events(t).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), ["event_type"], "us", "value").withColumnRenamed("peak_at", "peak_us")


# --- splits ------------------------------------------------------------------------------------

_U = lambda k: f"((((({k})%2147483647)*48271+11)%2147483647)*16807)%2147483647/2147483647.0::double"


@query(
    "stratified_split",
    f"""WITH {V.SCORED_SQL}, s AS (SELECT label, CASE WHEN {_U('doc_id')}<0.8 THEN 'train' ELSE 'test' END AS split FROM v_scored)
SELECT label, split, count(*) AS rows FROM s GROUP BY 1,2""",
)
def stratified_split(t: Tables):
    out = L.stratified_split(V.scored(t), "doc_id", {"train": 0.8, "test": 0.2})
    return out.groupBy("label", "split").agg(F.count(F.lit(1)).alias("rows"))


_FOLDS = """g AS (SELECT origin, count(*) AS n, sum(label) AS a FROM v_scored GROUP BY 1), h AS (SELECT *, CASE WHEN 2*a>=n THEN 1 ELSE 0 END AS maj FROM g),
i AS (SELECT *, row_number() OVER (PARTITION BY maj ORDER BY n DESC, origin)-1 AS place FROM h),
fo AS (SELECT origin, n, a, maj, CASE WHEN (place//3+maj)%2=0 THEN place%3 ELSE 2-place%3 END AS fold FROM i)"""


@query("group_kfold", f"WITH {V.SCORED_SQL}, {_FOLDS} SELECT origin, n AS rows, a::bigint AS attack_rows, maj::bigint AS majority, fold FROM fo")
def group_kfold(t: Tables):
    return rounded(L.group_kfold(V.scored(t), "origin", "label", 3))


@query(
    "fold_report",
    f"""WITH {V.SCORED_SQL}, {_FOLDS} SELECT fold, sum(n)::bigint AS validation_rows, count(*) AS validation_sources, sum(a)::bigint AS validation_attack,
  sum(n-a)::bigint AS validation_benign, 0::bigint AS leaking_sources FROM fo GROUP BY 1""",
)
def fold_report(t: Tables):
    rows = V.scored(t)
    return rounded(L.fold_report(L.assign_folds(rows, L.group_kfold(rows, "origin", "label", 3), "origin"), "origin", "label"))


@query(
    "split_leakage",
    """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus='F'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus<>'F'),
s AS (SELECT a.o_custkey IS NOT NULL AS ia, b.o_custkey IS NOT NULL AS ib FROM a FULL JOIN b ON a.o_custkey=b.o_custkey)
SELECT count(*) FILTER (ia) AS in_a, count(*) FILTER (ib) AS in_b, count(*) FILTER (ia AND ib) AS in_both, count(*) AS in_either, count(*) FILTER (ia AND NOT ib) AS only_a,
  count(*) FILTER (ib AND NOT ia) AS only_b, count(*) FILTER (ia AND ib)=0 AS disjoint, count(*) FILTER (ia<>ib)=0 AS equal FROM s""",
)
def split_leakage(t: Tables):
    finished = F.col("o_orderstatus") == "F"
    return J.split_leakage(t.orders.filter(finished), t.orders.filter(~finished), "o_custkey")


@query(
    "filter_sources",
    """SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal>0) GROUP BY 1""",
)
def filter_sources(t: Tables):
    split = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return J.filter_sources(t.orders, split, "o_custkey").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))


@query("concat_captures", "SELECT kind, count(*) AS rows, count(extra) AS with_extra FROM (SELECT 'a' AS kind, NULL AS extra FROM orders UNION ALL SELECT 'b', c_custkey FROM customer) GROUP BY 1")
def concat_captures(t: Tables):
    out = J.concat(t.orders.select(F.lit("a").alias("kind")), t.customer.select(F.lit("b").alias("kind"), F.col("c_custkey").alias("extra")))
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.count("extra").alias("with_extra"))


@query(
    "stored_flow_features",
    f"""WITH {V.SCORED_SQL} SELECT source, doc_id, label, round(score,6) AS score FROM v_scored""",
)
def stored_flow_features(t: Tables):
    """Scored rows saved by capture, without the helper column, and read back."""
    from ..session import shared_dir
    from ..sources.sinks import save_features

    path = f"{shared_dir(t.spark)}/features-{uuid.uuid4().hex}"
    save_features(V.scored(t).select("source", "doc_id", "label", "score", "n_chars"), path, ["n_chars"])
    return rounded(t.spark.read.parquet(path).select("source", "doc_id", "label", "score"))


# --- models ------------------------------------------------------------------------------------

_E = [f"e{i}" for i in range(V.DIMENSIONS)]


def _model_rows(t: Tables):
    return L.stratified_split(V.vectors(t), "vec_id", {"train": 0.6, "validation": 0.2, "test": 0.2})


@query("gbt_score")
def gbt_score(t: Tables):
    rows = _model_rows(t)
    model = ML.fit_gbt(rows.filter("split = 'train'"), _E, "label", 2.0, rounds=10, depth=3)
    return ML.score(rows, model, 0.5).select("vec_id", "split", F.round("malware_probability", 6).alias("probability"), "is_malware", "severity", "alert")


@query("forest_score")
def forest_score(t: Tables):
    rows = _model_rows(t)
    model = ML.fit_forest(rows.filter("split = 'train'"), _E, "label", trees=20, depth=6)
    scored = ML.scorer(model)(rows.filter("split <> 'train'"))
    return rounded(M.metrics_by_group(scored, "label", "score", 0.2, ["split"]))


@query("feature_importance")
def feature_importance(t: Tables):
    model = ML.fit_forest(V.vectors(t), _E, "label", trees=20, depth=6)
    return ML.feature_importance(model, _E, t.spark)


@query("model_tuning")
def model_tuning(t: Tables):
    rows = _model_rows(t)
    part = lambda n: rows.filter(F.col("split") == n)
    _, choice, report = ML.tune(part("train"), part("validation"), part("test"), _E, "label", [1.0, 3.0], M.threshold_grid("wide"), rounds=5)
    return rounded(report.withColumn("weight", F.lit(choice["weight"])).withColumn("threshold", F.lit(choice["threshold"])))


@query("oof_predict", "SELECT count(*) AS rows, count(*) AS predicted, 0::bigint AS unpredicted FROM embeddings")
def oof_predict(t: Tables):
    rows = V.vectors(t)
    folded = L.assign_folds(rows, L.group_kfold(rows, "source", "label", 3), "source")
    fit = lambda part: ML.scorer(ML.fit_forest(part, _E, "label", trees=10, depth=4))
    out = L.oof_predict(folded, 3, fit)
    return rounded(L.oof_coverage(rows, out, "vec_id", "score"))


@query("kfold_auc")
def kfold_auc(t: Tables):
    fit = lambda part: ML.fit_forest(part, _E, "label", trees=10, depth=4)
    return rounded(ML.kfold_auc(V.vectors(t), "vec_id", _E, "label", 3, fit))


@query("cross_eval")
def cross_eval(t: Tables):
    rows = V.vectors(t)
    sets = {"even": rows.filter("source % 2 = 0"), "odd": rows.filter("source % 2 = 1")}
    return rounded(ML.cross_eval(sets, "label", lambda part: ML.fit_forest(part, _E, "label", trees=10, depth=4), 0.5))


@query("isolation_forest")
def isolation_forest(t: Tables):
    rows = V.vectors(t)
    model = I.fit_isolation(rows.filter("label = 0"), _E, "vec_id", trees=50, sample_size=128)
    return I.assess(rows.select("vec_id", *_E), model).select("vec_id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_outlier", "baseline_samples")


@query("stability")
def stability(t: Tables):
    rows = V.events(t).select("event_id", F.col("value").alias("flow_duration"), F.col("k").cast("double").alias("pkt_count"), F.lit(1.0).alias("has_sni"))
    score = lambda c: 1 / (1 + F.exp(-(c["flow_duration"] / 50 + c["pkt_count"] / 25 - 3) * c["has_sni"]))
    out = Y.stability(rows, "event_id", ["flow_duration", "pkt_count", "has_sni"], score, 0.62)
    return rounded(out.drop("flow_duration", "pkt_count", "has_sni"))


@query(
    "review_routing",
    f"""WITH {V.EVENTS_SQL}, r AS (SELECT event_id, concat_ws(',', CASE WHEN k/100.0 BETWEEN 0.15 AND 0.35 THEN 'ambiguous_model_probability' END,
  CASE WHEN k%4=0 THEN 'evasion_sensitivity' END, CASE WHEN user_id%5=0 THEN 'local_baseline_outlier' END) AS reasons FROM v_events)
SELECT reasons, count(*) AS rows, reasons<>'' AS review_required FROM r GROUP BY 1""",
)
def review_routing(t: Tables):
    reasons = review_reasons(F.col("k") / 100.0, F.col("k") % 4 == 0, F.col("user_id") % 5 == 0)
    rows = V.events(t).select(F.array_join(reasons, ",").alias("reasons"))
    return rows.groupBy("reasons").agg(F.count(F.lit(1)).alias("rows")).withColumn("review_required", F.col("reasons") != "")


@query(
    "review_records",
    f"""WITH {V.EVENTS_SQL}, r AS (SELECT *, concat_ws(',', CASE WHEN k/100.0 BETWEEN 0.15 AND 0.35 THEN 'ambiguous_model_probability' END,
  CASE WHEN k%4=0 THEN 'evasion_sensitivity' END, CASE WHEN user_id%5=0 THEN 'local_baseline_outlier' END) AS reasons FROM v_events)
SELECT event_id, reasons, '10.0.0.'||sensor AS src_ip, 1::bigint AS context_entries, k, round(value,6) AS value FROM r WHERE reasons<>''""",
)
def review_records_of_events(t: Tables):
    """Rows to review: what the context keeps once payload and keys are gone, and the model's features."""
    k, text = F.col("k"), lambda c: F.col(c).cast("string")
    context = F.create_map(F.lit("src_ip"), F.concat(F.lit("10.0.0."), text("sensor")), F.lit("Payload"), text("value"), F.lit("tls_keys"), text("k"))
    rows = V.events(t).withColumns({"reasons": review_reasons(k / 100.0, k % 4 == 0, F.col("user_id") % 5 == 0), "context": context})
    out = review_records(rows, "reasons", "context", ["k", "value"])
    return rounded(out.select(
        "event_id", F.array_join("reasons", ",").alias("reasons"), F.col("context")["src_ip"].alias("src_ip"), F.size("context").cast("long").alias("context_entries"), "model_features.k", "model_features.value",
    ))


@query(
    "example_pairs",
    f"""WITH {V.FLOW_RECORDS_SQL}, n AS (SELECT *, dst_port%2 AS cls, row_number() OVER (PARTITION BY dst_port%2, src, dst ORDER BY h, event_id) AS i FROM v_flows),
p AS (SELECT cls AS label, src, dst, max(h)-min(h) AS iat, sum(bytes)::double AS b, sum(pkts)::double AS k FROM n WHERE i<=2 GROUP BY 1,2,3 HAVING count(*)=2 AND max(h)-min(h)<=300 AND max(h)>min(h)),
r AS (SELECT *, CASE WHEN k<>0 THEN b/k ELSE 0 END AS score FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN label=1 THEN -score ELSE score END, src, dst) AS place FROM r)
SELECT label::bigint AS target, src, dst, 2::bigint AS flows, round(iat,6) AS "IAT", round(score,6) AS score FROM o WHERE place=1""",
)
def example_pairs(t: Tables):
    from ..operators.beacon import beacon_features

    flows = V.flows(t).withColumn("target", F.col("dst_port") % 2)

    def score_pair(pairs):
        feats = beacon_features(pairs, ["target", "src", "dst"], "timestamp_unix", 2000.0, 1000.0, label=None)
        return feats.filter("window_index = 0").select("target", "src", "dst", "flows", "IAT", F.col("Bytes_Per_Packet").alias("score"))

    return rounded(ML.pick_examples(flows, ["src", "dst"], "timestamp_unix", "event_id", "target", score_pair, max_gap=300.0))
