"""Boosted trees fitted by a gang of tasks against MLlib's own fit."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cashtrail.operators import boosting as B
from cashtrail.operators import models as ML

FEATURES = ["a", "b", "c", "none"]


def rows(spark, n, parts):
    return spark.range(0, n, 1, parts).select(
        "id", F.rand(1).alias("a"), F.floor(F.rand(2) * 5).alias("b"), F.when(F.rand(3) < 0.5, 0.0).otherwise(F.randn(4)).alias("c"), F.lit(0).alias("none"),
        (1.0 + F.col("id") % 3).alias("w")).withColumn("label", (F.col("a") + F.col("c") * F.col("b") / 4 + F.rand(5) > 1.1).cast("int"))


def mllib(data, trees, depth, subsample, weight):
    est = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.08, subsamplingRate=subsample, seed=ML.SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), est.setWeightCol(weight) if weight else est]).fit(data)


@pytest.mark.parametrize("n, parts, per_task, trees, depth, subsample, weight", [
    (400, 1, 1 << 16, 5, 4, 0.8, None), (400, 3, 100, 4, 3, 1.0, "w"), (30_000, 4, 8_000, 6, 6, 0.8, None), (30_000, 3, 1 << 16, 3, 5, 0.8, "w")])
def test_scores_are_those_of_mllib(spark, monkeypatch, n, parts, per_task, trees, depth, subsample, weight):
    monkeypatch.setattr(B, "ROWS_PER_TASK", per_task)
    data = rows(spark, n, parts)
    data = data.repartition(parts, "id").sortWithinPartitions("id").localCheckpoint()
    model = ML.boosted_trees(FEATURES, "label", trees, depth, 0.08, subsample, weight).fit(data)
    both = ML.score_with(model, ML.score_with(mllib(data, trees, depth, subsample, weight), data, "theirs"))
    assert model.stages[-1].getNumTrees == trees and model.stages[-1].getMaxDepth() == depth
    got = both.select("theirs", "score").toPandas()
    assert got["score"].nunique() > 20 and np.abs(got["theirs"] - got["score"]).max() < 1e-9


def test_a_fit_starts_few_jobs(spark):
    data, group = rows(spark, 300, 2).localCheckpoint(), "few-jobs"
    spark.sparkContext.setJobGroup(group, group)
    ML.boosted_trees(FEATURES, "label", 60, 3).fit(data)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) < 60               # MLlib starts about four a tree here


def test_draws_do_not_depend_on_the_lanes():
    d = B.Draws(1_000)
    s, plain = np.array([B.hashed_seed(77)], np.uint64), []
    for _ in range(1_000):
        a = s = B._step(s)
        b = s = B._step(s)
        plain.append((((int(a[0]) & (1 << 26) - 1) << 27) + (int(b[0]) & (1 << 27) - 1)) * 2.0 ** -53 < 0.8)
    assert len(d.jumps) and d.below(77, 0.8).tolist() == plain


def test_gaps_and_other_labels_are_refused(spark):
    for bad in (F.lit(None).cast("double"), F.lit(float("nan"))):
        with pytest.raises(ValueError):
            ML.boosted_trees(FEATURES, "label", 2, 2).fit(rows(spark, 50, 1).withColumn("a", bad))
    with pytest.raises(ValueError):
        ML.boosted_trees(FEATURES, "label", 2, 2).fit(rows(spark, 50, 1).withColumn("label", F.lit(2)))
