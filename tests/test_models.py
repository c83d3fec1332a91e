"""Benchmark rows against metrics recomputed from the scores, winners by both rules, and folds that see no test rows."""

from threading import Barrier

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashtrail.catalog import models as C
from cashtrail.operators import models as ML

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 2)).round(2)
    y = (x[:, 0] + r.normal(size=600) > 1.6).astype(int)
    return spark.createDataFrame([(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, label int").cache()


def test_benchmark_matrix(spark, rows):
    train, test = rows.filter("id < 450"), rows.filter("id >= 450")
    make = {"logistic": lambda f, l, weight=None: ML.logistic(f, l, 30, weight), "flat": lambda f, l, weight=None: ML.logistic(["b"], l, 30, weight)}
    got = ML.with_winners(ML.benchmark(train, test, "label", "id", FEATURES, make, ["weights", "smote"])).collect()
    assert sorted((r.model, r.strategy) for r in got) == [("flat", "smote"), ("flat", "weights"), ("logistic", "smote"), ("logistic", "weights")]
    scored = ML.score_with(make["logistic"](FEATURES, "label", "weight").fit(ML.class_weights(train, "label")), test).select("label", "score").collect()
    y, s = np.array([r.label for r in scored]), np.array([r.score for r in scored])
    order = np.argsort(-s, kind="stable")
    hits = np.cumsum(y[order])
    precision = hits / np.arange(1, len(y) + 1)
    row = next(r for r in got if (r.model, r.strategy) == ("logistic", "weights"))
    assert row.average_precision == pytest.approx((precision * y[order]).sum() / y.sum(), abs=1e-9)
    assert row.roc_auc == pytest.approx((s[y == 1][:, None] > s[y == 0]).mean() + (s[y == 1][:, None] == s[y == 0]).mean() / 2, abs=1e-9)
    assert row.tp + row.fn == y.sum() and row.tp + row.fp + row.tn + row.fn == len(y)
    assert row.tp == ((s >= row.threshold) & (y == 1)).sum() and row.fp == ((s >= row.threshold) & (y == 0)).sum()
    for by in ("average_precision", "f1"):
        best = [r for r in got if r[f"wins_by_{by}"]]
        assert len(best) == 1 and best[0][by] == max(r[by] for r in got)


def test_ties_by_f1_go_to_oversampling(spark):
    m = spark.createDataFrame([("x", "weights", 0.9, 0.5), ("x", "smote", 0.8, 0.5)], "model string, strategy string, average_precision double, f1 double")
    got = {r.strategy: r for r in ML.with_winners(m).collect()}
    assert got["smote"].wins_by_f1 and got["weights"].wins_by_average_precision and not got["weights"].wins_by_f1


def test_folds_resample_training_rows_only(spark, rows):
    seen = []

    def resample(train):
        seen.append(train.agg(F.count("*").alias("n"), F.countDistinct("id").alias("d")).first())
        return train

    got = ML.out_of_fold(rows, "label", "id", ML.logistic(FEATURES, "label", 20), folds=3, resample=resample)
    assert got.count() == 600 and got.select("id").distinct().count() == 600
    assert len(seen) == 3 and all(s.n == s.d and 395 <= s.n <= 405 for s in seen)


def test_fits_and_scores_see_rows_on_every_core(spark, rows):
    """Rows of one partition, as table-wide numbering leaves them, are dealt before a fit reads them once a level."""
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = []

    class Recorded:
        def __init__(self, estimator):
            self.estimator = estimator

        def fit(self, train):
            seen.append(train.select(F.spark_partition_id().alias("p")).distinct().count())
            return self.estimator.fit(train)

    narrow = rows.coalesce(1)
    make = {"logistic": lambda f, l, weight=None: Recorded(ML.logistic(f, l, 20, weight))}
    ML.benchmark(narrow.filter("id < 450"), narrow.filter("id >= 450"), "label", "id", FEATURES, make, ["weights", "smote"])
    ML.out_of_fold(narrow, "label", "id", Recorded(ML.logistic(FEATURES, "label", 20)), folds=2)
    assert seen == [wide] * 4


def test_split_is_put_in_order_once(spark, monkeypatch):
    seen, split = [], C.M.chronological_split
    monkeypatch.setattr(C.M, "chronological_split", lambda *a: seen.append(1) or split(*a))
    monkeypatch.setattr(C, "_fits", {})
    sf = "/root/testdata/sf0.001"
    (train, test), again = C.card_split(spark, sf), C.card_split(spark, sf)
    assert len(seen) == 1 and "Window" not in train._jdf.queryExecution().optimizedPlan().toString()
    want = split(C.cards(spark, sf), ["Time", "id"])
    for part, name, other in ((train, "train", again[0]), (test, "test", again[1])):
        assert part.exceptAll(want.filter(F.col("split") == name).drop("pos", "split")).isEmpty() and part.count() == other.count() > 0
    assert train.count() + test.count() == want.count()


def test_fits_of_a_round_do_not_wait_for_each_other(spark):
    meet = Barrier(6)
    assert ML.together([lambda i=i: (meet.wait(60), i)[1] for i in range(6)]) == list(range(6))


def test_legs_of_the_matrix_do_not_wait_for_each_other(spark, monkeypatch):
    meet = Barrier(3)
    monkeypatch.setattr(C.ML, "benchmark", lambda train, *a: (meet.wait(120), train.sparkSession.range(1).withColumnRenamed("id", "metric"))[1])
    monkeypatch.setattr(C, "_fits", {})
    got = C.matrix(spark, "/root/testdata/sf0.001").collect()
    assert {r.dataset for r in got} == {"creditcard", "simulated_card", "mobile_money"} and all(r.train_records > 0 for r in got)
