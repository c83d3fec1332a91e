"""Splits, threshold tuning and ranking metrics over (score, label) rows.

Everything that needs a ranking works on distinct scores with their counts, not on ranked rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import Ordered, exact_percentiles
from ..plans.pages import numbered_slice


def chronological_split(rows: DataFrame, order: list[str], test_frac: float = 0.2) -> DataFrame:
    """``split`` = train for the first int(n*(1-f)) rows in order, else test; ``pos`` is 1-based."""
    seq = Ordered(rows, [], order)
    cut = int(seq.sizes[1] * (1 - test_frac))
    return seq.numbered("pos").plain().withColumn("split", F.when(F.col("pos") <= cut, "train").otherwise("test"))


def step_split(rows: DataFrame, step: str = "step", q: float = 0.8) -> DataFrame:
    """Train up to int(q-quantile of the step), test after it."""
    cut = exact_percentiles(rows, [], step, {"_cut": q}).select(F.floor("_cut").alias("_cut"))     # one row
    return (rows.join(F.broadcast(cut), F.lit(True))
            .withColumn("split", F.when(F.col(step) <= F.col("_cut"), "train").otherwise("test")).drop("_cut"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Row weight neg/pos on positives, 1 on negatives."""
    c = rows.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos"))
    ratio = c.select((F.col("neg") / F.greatest(F.lit(1), F.col("pos"))).alias("_ratio"))          # one row
    return (rows.join(F.broadcast(ratio), F.lit(True))
            .withColumn("weight", F.when(F.col(label) == 1, F.col("_ratio")).otherwise(1.0)).drop("_ratio"))


def score_curve(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Per distinct score: tp and fp when everything at or above it is called positive."""
    at = scored.groupBy(F.col(score).alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    at = at.withColumn("_down", -F.col("threshold"))
    run = Ordered(at, [], ["_down"]).running(called=F.col("n"), tp=F.col("p")).plain().drop("_down")
    total = at.agg(F.sum("p").alias("positives"), F.sum("n").alias("total"))                       # one row
    return run.join(F.broadcast(total), F.lit(True)).withColumn("fp", F.col("called") - F.col("tp"))


def best_threshold(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Threshold of the highest F1; the lowest one among equals."""
    c = score_curve(scored, score, label)
    p, r = F.col("tp") / F.col("called"), F.col("tp") / F.col("positives")
    f1 = 2 * (p * r) / (p + r + F.lit(1e-10))
    best = c.select("threshold", f1.alias("f1")).agg(F.max(F.struct("f1", (-F.col("threshold")).alias("down"))).alias("b"))
    return best.select((-F.col("b.down")).alias("threshold"), F.col("b.f1").alias("f1"))


def average_precision(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Sum of precision times recall gain over falling thresholds."""
    c = score_curve(scored, score, label)
    gain = F.col("p") / F.col("positives") * (F.col("tp") / F.col("called"))
    return c.agg(F.sum(gain).alias("average_precision"))


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties as half; from counts per score."""
    c = score_curve(scored, score, label)
    above = F.col("tp") - F.col("p") / F.lit(2.0)
    area = (F.col("n") - F.col("p")) * above / (F.col("positives") * (F.col("total") - F.col("positives")))
    return c.agg(F.sum(area).alias("roc_auc"))


def confusion_at(scored: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    pos, hit = F.col(label) == 1, F.col(score) >= threshold
    c = scored.agg(F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"),
                   F.count_if(~pos & ~hit).alias("tn"), F.count_if(pos & ~hit).alias("fn"))
    p = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))
    r = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return c.select("tp", "fp", "tn", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def averaged_f1(scored: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """Macro and weighted F1 of the two classes."""
    c = confusion_at(scored, threshold, score, label)
    one = F.lit(1)
    f_pos = 2 * F.col("tp") / F.greatest(one, 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    f_neg = 2 * F.col("tn") / F.greatest(one, 2 * F.col("tn") + F.col("fp") + F.col("fn"))
    n_pos, n_neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return c.select(((f_pos + f_neg) / 2).alias("macro_f1"),
                    ((f_pos * n_pos + f_neg * n_neg) / F.greatest(one, n_pos + n_neg)).alias("weighted_f1"))


def top_k(scored: DataFrame, k: int, tie: str = "id", score: str = "score") -> DataFrame:
    """Rank by falling score; rows up to rank k."""
    return numbered_slice(scored.withColumn("_down", -F.col(score)), ["_down", tie], 0, k, "rank")[0].drop("_down")


def at_alert_budget(scored: DataFrame, share: float = 0.01, tie: str = "id", score: str = "score", label: str = "label") -> DataFrame:
    """Precision and recall among the top ``share`` of the scores.

    Scores above the score at the cut count whole; of the rows at the cut itself, only as many as
    still fit, in ``tie`` order.
    """
    c = score_curve(scored, score, label)
    k = F.greatest(F.lit(1), F.floor(F.col("total") * share))
    cut = (c.filter(F.col("called") >= k).agg(F.max(F.struct("threshold", "called", "n", "tp", "p", "positives", k.alias("k"))).alias("c"))
           .select("c.*").select("threshold", "k", "positives", (F.col("called") - F.col("n")).alias("above"), (F.col("tp") - F.col("p")).alias("tp_above")))
    tied = scored.join(F.broadcast(cut), scored[score] == F.col("threshold"))                      # one-row side
    part = (Ordered(tied.select(tie, label, "k", "above"), [], [tie]).numbered("rn").plain()
            .filter(F.col("rn") <= F.col("k") - F.col("above")).agg(F.sum(F.col(label).cast("long")).alias("tp_tied")))
    tp = F.col("tp_above") + F.coalesce(F.col("tp_tied"), F.lit(0))
    return cut.join(part, F.lit(True)).select("k", (tp / F.col("k")).alias("precision_at_k"),
                                              (tp / F.greatest(F.lit(1), F.col("positives"))).alias("recall_at_k"))


def percentile_of(rows: DataFrame, score: str) -> DataFrame:
    """Share of rows with a score at or below the row's own."""
    at = rows.groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    run = Ordered(at, [], [score]).running(_upto=F.col("_n")).plain()
    total = at.agg(F.sum("_n").alias("_total"))                                                    # one row
    share = run.join(F.broadcast(total), F.lit(True)).select(score, (F.col("_upto") / F.col("_total")).alias("percentile"))
    return rows.join(share, score)


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Fold numbers that spread each class evenly, fixed by the seed."""
    seeded = rows.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    return (Ordered(seeded, [label], ["_h", key]).numbered("_rn").plain()
            .withColumn("fold", F.pmod(F.col("_rn") - 1, F.lit(folds)).cast("int")).drop("_h", "_rn"))


def seeded_sample(rows: DataFrame, label: str, key: str, total: int, cap_positive: int = 500, seed: int = 42) -> DataFrame:
    """At most ``cap_positive`` positives, filled with negatives up to ``total``, fixed by the seed."""
    ranked = rows.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    first = lambda value, n: ranked.filter(F.col(label) == value).orderBy("_h", key).limit(n)
    n_pos = min(cap_positive, rows.filter(F.col(label) == 1).limit(cap_positive).count())
    return first(1, cap_positive).unionByName(first(0, total - n_pos)).drop("_h")
