"""Risk models with MLlib: estimators, oversampling, out-of-fold scores, ensemble and benchmark tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import RobustScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordering import Ordered
from ..plans.storage import written
from .boosting import BoostedTrees
from .metrics import average_precision, best_threshold, class_weights, confusion_at, roc_auc, stratified_folds
from .neighbours import nearest_rows

SEED = 42
PARALLEL = 6            # fits that run side by side: their jobs share the cluster, and each waits for the driver between two of them


def together(jobs: list[Callable]) -> list:
    """Results of the jobs, run side by side on the driver's threads; the work itself is Spark's."""
    with ThreadPool(max(1, min(PARALLEL, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(lambda job: job()), jobs, chunksize=1)


# -- estimators --------------------------------------------------------------------------
def boosted_trees(features: list[str], label: str, trees: int = 250, depth: int = 6, rate: float = 0.08,
                  subsample: float = 0.8, weight: str | None = None) -> BoostedTrees:
    return BoostedTrees(features, label, trees, depth, rate, subsample, weight, SEED)


def random_forest(features: list[str], label: str, trees: int = 100, depth: int = 12, weight: str | None = None) -> Pipeline:
    est = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), est.setWeightCol(weight) if weight else est])


def logistic(features: list[str], label: str, iterations: int = 100, weight: str | None = None) -> Pipeline:
    est = LogisticRegression(featuresCol="features", labelCol=label, maxIter=iterations, standardization=False)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="plain"),
                            RobustScaler(inputCol="plain", outputCol="features", withCentering=True, withScaling=True),
                            est.setWeightCol(weight) if weight else est])


def leafy_trees(features: list[str], label: str, trees: int = 250, weight: str | None = None) -> BoostedTrees:
    """Boosted trees of about 31 leaves with a small step: the third model family."""
    return boosted_trees(features, label, trees, 5, 0.03, weight=weight)


def score_with(model, rows: DataFrame, name: str = "score") -> DataFrame:
    """Probability of the positive class; the model's own columns are dropped."""
    had = rows.columns
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).select(*[c for c in had if c != name], name)


def dealt(rows: DataFrame, key: str, name: str = "train") -> DataFrame:
    """Rows written evenly over the tasks and in a fixed order; a fit reads them once a level of each tree, on as many cores as they have parts."""
    order = [key] + [c for c in rows.columns if c != key]
    return written(rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order), name)


# -- oversampling ------------------------------------------------------------------------
def smote(rows: DataFrame, label: str, key: str, features: list[str], ratio: float = 0.05, k: int = 5, min_positive: int = 6,
          seed: int = SEED) -> DataFrame:
    """Rows plus synthetic positives until positives are ``ratio`` of the negatives.

    A synthetic row lies between a positive and one of its k nearest positives; the pick and the
    place follow from hashes of the seed. Features, label and key are returned.
    """
    n = rows.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).first()
    base = rows.select(key, *features, label)
    wanted = int(n.neg * ratio) - n.pos
    if n.pos < min_positive or wanted <= 0:
        return base
    k = min(k, n.pos - 1)
    minority = written(base.filter(F.col(label) == 1).select(key, *features), "minority")
    each, extra = divmod(wanted, n.pos)
    # the rows with the smallest hashes make one more
    hashed = minority.withColumn("h", F.xxhash64(F.col(key), F.lit(seed)))
    hashed = Ordered(hashed, [], ["h", key]).numbered("place").plain().withColumn("more", (F.col("place") <= extra).cast("int"))
    copies = F.lit(each) + F.col("more")
    seeds = hashed.withColumn("c", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))).drop("more", "h", "place")
    pick = (F.pmod(F.xxhash64(F.col(key), F.col("c"), F.lit(seed + 1)), F.lit(k)) + 1).cast("int")
    share = F.pmod(F.xxhash64(F.col(key), F.col("c"), F.lit(seed + 2)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    near = nearest_rows(minority, key, features, k, n.pos)
    ends = minority.select(F.col(key).alias("neighbour"), *[F.col(f).alias(f"_to_{f}") for f in features])
    made = (seeds.withColumn("n", pick).withColumn("share", share).join(near, [key, "n"]).join(ends, "neighbour")
            .select(key, *[(F.col(f) + F.col("share") * (F.col(f"_to_{f}") - F.col(f))).alias(f) for f in features],
                    F.lit(1).cast(rows.schema[label].dataType).alias(label)))
    return base.unionByName(made)


def out_of_fold(rows: DataFrame, label: str, key: str, estimator, folds: int = 5, resample: Callable | None = None) -> DataFrame:
    """Scores of each fold from the model of the other folds; ``resample`` acts on training rows only."""
    parts = dealt(stratified_folds(rows, label, key, folds), key, "folds")

    def scored(i: int) -> DataFrame:
        train = parts.filter(F.col("fold") != i).drop("fold")
        model = estimator.fit(dealt(resample(train) if resample else train, key))
        return score_with(model, parts.filter(F.col("fold") == i)).select(key, label, "fold", "score")

    return reduce(DataFrame.unionByName, together([lambda i=i: scored(i) for i in range(folds)]))


def ensemble(rows: DataFrame, boosted, forest, weight: float = 0.6, tau_lgb: float = 0.5, tau_rf: float = 0.5) -> DataFrame:
    """Both probabilities and their mix in one pass over the rows."""
    two = score_with(forest, score_with(boosted, rows, "p_lgb"), "p_rf")
    return two.withColumns({
        "flagged": (F.col("p_lgb") >= tau_lgb) | (F.col("p_rf") >= tau_rf),
        "risk_score": F.round(weight * F.col("p_lgb") + (1 - weight) * F.col("p_rf"), 4),
        "risk_score_lgb": F.round("p_lgb", 4), "risk_score_rf": F.round("p_rf", 4)})


# -- benchmark tables --------------------------------------------------------------------
def evaluate(scored: DataFrame, label: str, threshold: float | None = None) -> DataFrame:
    """One metric row; the threshold is the best one on these scores unless given."""
    scored = written(scored.select(F.col(label).alias("label"), "score"), "scored")
    if threshold is None:
        threshold = best_threshold(scored).first().threshold
    return (average_precision(scored).join(roc_auc(scored), F.lit(True)).join(confusion_at(scored, threshold), F.lit(True))
            .withColumn("threshold", F.lit(float(threshold))))


def benchmark(train: DataFrame, test: DataFrame, label: str, key: str, features: list[str], models: dict, strategies: list[str]) -> DataFrame:
    """Metrics of every model under every imbalance strategy (``weights``, ``smote``, ``none``).

    ``models`` maps a name to ``f(features, label, weight=...) -> estimator``. Each fit runs on the
    cluster; only the handful of metric rows is put together here.
    """
    make = {"weights": lambda: class_weights(train, label), "smote": lambda: smote(train, label, key, features), "none": lambda: train}
    data = {s: dealt(make[s](), key) for s in strategies}
    test = dealt(test.select(key, label, *features), key, "test")

    def measured(strategy: str, name: str) -> DataFrame:
        model = models[name](features, label, weight="weight" if strategy == "weights" else None).fit(data[strategy])
        return evaluate(score_with(model, test), label).select(F.lit(name).alias("model"), F.lit(strategy).alias("strategy"), "*")

    rows = together([lambda s=s, n=n: written(measured(s, n), "metrics") for s in strategies for n in models])
    return reduce(DataFrame.unionByName, rows)


def winner(metrics: DataFrame, by: str = "average_precision") -> DataFrame:
    """Best row; by F1 a tie goes to oversampling."""
    rank = F.struct(by, (F.col("strategy") == "smote").alias("s"), "model")
    return metrics.agg(F.max_by(F.struct("*"), rank).alias("w")).select("w.*")


def with_winners(metrics: DataFrame) -> DataFrame:
    """The metric rows, with marks on the best one by average precision and by F1 at its threshold."""
    for by in ("average_precision", "f1"):
        best = winner(metrics, by).select("model", "strategy", F.lit(True).alias(f"wins_by_{by}"))      # one row
        metrics = metrics.join(F.broadcast(best), ["model", "strategy"], "left").fillna(False, [f"wins_by_{by}"])
    return metrics


def report(parts: dict[str, DataFrame], skipped: dict[str, str] | None = None) -> DataFrame:
    """Evaluator rows with different columns as one table; evaluators that did not run keep a reason."""
    rows = None
    for name, part in parts.items():
        part = part.withColumns({"evaluator": F.lit(name), "status": F.lit("ok")})
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    for name, why in (skipped or {}).items():
        note = rows.sparkSession.range(1).select(F.lit(name).alias("evaluator"), F.lit("skipped").alias("status"), F.lit(why).alias("reason"))
        rows = rows.unionByName(note, allowMissingColumns=True)
    return rows
