"""Ranks, quartiles and ranking metrics."""

import random

import pandas as pd
import pytest

from riskfabric.operators import metrics, rank


@pytest.mark.parametrize("n", [1, 4, 5, 6, 7, 8, 37])
def test_quartiles_match_qcut_of_first_ranks(spark, n):
    rng = random.Random(n)
    vals = [rng.choice([1.0, 2.0, 3.0]) for _ in range(n)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "resp_id long, v double")
    got = {r.resp_id: r.quartile for r in rank.disadvantage_quartile(df, "v").collect()}
    ranks = pd.Series(vals).rank(method="first")
    if n == 1:
        want = [1]
    else:
        want = list(pd.qcut(ranks, 4, labels=False) + 1)
    assert [got[i] for i in range(n)] == want


def test_n6_sizes(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(6)], "resp_id long, v double")
    sizes = sorted((r.quartile, r.c) for r in
                   rank.disadvantage_quartile(df, "v").groupBy("quartile").count()
                   .withColumnRenamed("count", "c").collect())
    assert [c for _, c in sizes] == [2, 1, 1, 2]


def test_the_frame_is_not_broadcast_for_its_quartiles(spark, tmp_path):
    spark.range(3000).selectExpr("id AS resp_id", "CAST(id % 3 AS DOUBLE) AS v", "id * 7 AS other") \
        .write.parquet(str(tmp_path / "frame"))
    df = spark.read.parquet(str(tmp_path / "frame"))  # small files, so their size alone would let Spark broadcast it
    got = rank.disadvantage_quartile(df, "v")
    plan = got._jdf.queryExecution().sparkPlan()

    def sent(node):
        """Output columns of every broadcast side."""
        found = []
        if node.nodeName().startswith("BroadcastHashJoin"):
            side = node.left() if "BuildLeft" in node.buildSide().toString() else node.right()
            found.append(side.output().mkString(","))
        children = node.children()
        return found + [x for i in range(children.size()) for x in sent(children.apply(i))]
    assert sent(plan) and not [c for c in sent(plan) if "resp_id" in c or "_id#" in c]
    assert sorted(r["count"] for r in got.groupBy("quartile").count().collect()) == [750] * 4


def test_rank_is_partition_independent(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "resp_id long, v double")
    a = {r.resp_id: r.rank for r in rank.rank_first(df, ["v", "resp_id"], num_partitions=3).collect()}
    b = {r.resp_id: r.rank for r in rank.rank_first(df.repartition(11), ["v", "resp_id"],
                                                   num_partitions=7).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 501))


def test_running_totals_match_cumsum(spark):
    rows = [("a" if i % 3 else "b", float(i), i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "target string, p double, pos long")
    out = rank.running_totals(df, ["target"], "p", ["pos"], descending=True, num_partitions=5).toPandas()
    pdf = pd.DataFrame(rows, columns=["target", "p", "pos"]).sort_values(["target", "p"], ascending=[True, False])
    pdf["want"] = pdf.groupby("target")["pos"].cumsum()
    m = out.merge(pdf, on=["target", "p"])
    assert (m["cum_pos"] == m["want"]).all() and len(m) == 300


def _scores(spark, rows):
    return spark.createDataFrame(rows, "target string, y int, p double")


def _brute_auc(rows):
    pos = [p for _, y, p in rows if y == 1]
    neg = [p for _, y, p in rows if y == 0]
    s = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def test_auc_with_ties_matches_pair_count(spark):
    rng = random.Random(3)
    rows = [("t", rng.randint(0, 1), rng.choice([0.1, 0.2, 0.2, 0.5, 0.9])) for _ in range(200)]
    got = metrics.roc_auc(_scores(spark, rows)).first().roc_auc
    assert got == round(_brute_auc(rows), 4)


def test_auc_of_negated_score(spark):
    rng = random.Random(5)
    rows = [("t", rng.randint(0, 1), rng.random()) for _ in range(100)]
    a = metrics.roc_auc(_scores(spark, rows)).first().roc_auc
    b = metrics.roc_auc(_scores(spark, [(t, y, -p) for t, y, p in rows])).first().roc_auc
    assert abs(a + b - 1) < 2e-4


def test_one_class_and_equal_scores(spark):
    one = _scores(spark, [("t", 1, 0.3), ("t", 1, 0.6)])
    assert metrics.roc_auc(one).first().roc_auc is None
    assert metrics.average_precision(one).first().pr_auc == 1.0
    neg = _scores(spark, [("t", 0, 0.3), ("t", 0, 0.6)])
    assert metrics.average_precision(neg).first().pr_auc == 0.0
    flat = _scores(spark, [("t", 1, 0.5), ("t", 0, 0.5), ("t", 0, 0.5), ("t", 1, 0.5)])
    assert metrics.roc_auc(flat).first().roc_auc == 0.5
    assert metrics.average_precision(flat).first().pr_auc == 0.5


def test_average_precision_and_curve(spark):
    # scores 0.9(1) 0.8(0) 0.7(1) 0.7(0) 0.1(0): thresholds desc
    rows = [("t", 1, 0.9), ("t", 0, 0.8), ("t", 1, 0.7), ("t", 0, 0.7), ("t", 0, 0.1)]
    ap = metrics.average_precision(_scores(spark, rows)).first().pr_auc
    # steps: t=.9 r=.5 p=1 ; t=.8 r=.5 ; t=.7 r=1 p=2/4 -> .5*1 + .5*.5
    assert ap == 0.75
    curve = metrics.pr_curve(_scores(spark, rows)).toPandas()
    body = curve[~curve.is_end].sort_values("threshold")
    assert list(body.recall) == [1.0, 1.0, 0.5, 0.5]
    assert list(body.precision) == [0.4, 0.5, 0.5, 1.0]
    end = curve[curve.is_end].iloc[0]
    assert end.precision == 1.0 and end.recall == 0.0
    assert (body.recall.values[:-1] >= body.recall.values[1:]).all()  # recall never rises with t
    op = metrics.operating_point(metrics.pr_curve(_scores(spark, rows)), target="t").first()
    # F1 at t=.7: 2*.5*1/1.5 = .6667 beats t=.9: 2*1*.5/1.5 = .6667 -> tie -> lowest threshold
    assert op.threshold == 0.7 and op.f1 == 0.6667


def test_equity_groups(spark):
    rows = [("target_stroke", 0, 0.1, 1)] * 9  # 9 rows: skipped
    rows += [("target_stroke", 1, 0.9, 2)] * 10  # no negatives: fpr null
    rows += [("target_stroke", 0, 0.9, 3)] * 4 + [("target_stroke", 0, 0.1, 3)] * 6  # no positives
    df = spark.createDataFrame(rows, "target string, y int, p double, quartile int")
    got = {r.group: r for r in metrics.equity_audit(df).collect()}
    assert set(got) == {"Q2", "Q3"}
    assert got["Q2"].fpr is None and got["Q2"].fnr == 0.0 and got["Q2"].target == "Stroke Risk"
    assert got["Q3"].fnr is None and got["Q3"].fpr == 0.4


def test_macro_f1_and_lift(spark):
    rows = [("t", 1, 0.9), ("t", 0, 0.2), ("t", 1, 0.3), ("t", 0, 0.1)]
    f1 = metrics.macro_f1(_scores(spark, rows)).first().macro_f1
    # class 1: tp=1 fp=0 fn=1 -> 2/3 ; class 0: tn=2 fn=1 fp=0 -> 4/5
    assert f1 == round((2 / 3 + 4 / 5) / 2, 4)
    s = _scores(spark, rows)
    lf = metrics.lift(metrics.average_precision(s), metrics.prevalence(s)).first()
    assert lf.lift == lf.pr_auc / lf.prevalence


def test_hot_value_is_split_across_range_partitions(spark):
    from pyspark.sql import functions as F

    # a third of the rows share one value
    rows = [(i, 5.0 if i % 3 == 0 else float(i % 97)) for i in range(3000)]
    df = spark.createDataFrame(rows, "resp_id long, v double")
    parted = rank._range_partition(df, 8, "v", "resp_id").withColumn("_pid", F.spark_partition_id())
    per_part = {r._pid: r["count"] for r in parted.filter("v = 5.0").groupBy("_pid").count().collect()}
    assert len(per_part) >= 3  # the hot value spans several tasks
    assert max(per_part.values()) < 1000
    ranks = {r.resp_id: r.rank for r in rank.rank_first(df, ["v", "resp_id"], num_partitions=8).collect()}
    assert sorted(ranks.values()) == list(range(1, 3001))
