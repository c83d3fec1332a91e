"""Model queries: J4-J8, J15-J22, J24, J25, K3, C9.

Fits run at the operators' defaults. They are not comparable value by value, so the twins check what does not hang on the fit: classes and
hull of oversampled rows, fold sizes, row sets, sums of attributions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import MONEY_FEATURES
from ..operators import attribution as A
from ..operators import conformal as CF
from ..operators import drift as DR
from ..operators import explain as E
from ..operators import features as X
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import typology as N
from ..plans.storage import written
from ..sources import cards as CS
from ..sources import tables as T
from ..sources.cards import CARD_FEATURES
from .base import CARDS_SQL, LEDGER_SQL, MONEY_SQL, SIM_SQL, joined, out, query, with_
from .network import cases as typology_cases

THRESHOLD = 0.5


def cards(spark, sf):
    rows = T.raw_cards(spark, sf).withColumnRenamed("Class", "label")
    return rows.withColumn("id", F.round(F.col("Time") * 1e6).cast("long"))


_fits: dict = {}


def _once(spark, sf, name, make):
    """A fit or table shared by the queries of one session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _fits:
        _fits[key] = make()
    return _fits[key]


def card_split(spark, sf):
    """Both halves; the rows are put in order once a session and written, as every fit and score reads them again."""
    parts = _once(spark, sf, "card-split", lambda: written(M.chronological_split(cards(spark, sf), ["Time", "id"]).drop("pos"), "split"))
    return parts.filter("split = 'train'").drop("split"), parts.filter("split = 'test'").drop("split")


def money(spark, sf):
    rows = X.mobile_money_features(T.mobile_money(spark, sf)).withColumn("label", F.col("isFraud"))
    return rows.withColumn("id", F.concat_ws("/", "nameOrig", "nameDest"))


def logistic_model(spark, sf):
    return _once(spark, sf, "lr", lambda: ML.logistic(CARD_FEATURES, "label").fit(card_split(spark, sf)[0]))


def money_train(spark, sf):
    def make():
        train = M.class_weights(M.step_split(money(spark, sf)).filter("split = 'train'"), "label")
        dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))          # the trees read the rows once a level: let every core have some
        return written(train.select("id", "label", "weight", *MONEY_FEATURES).repartition(dealt, "id"), "train")
    return _once(spark, sf, "money-train", make)


def money_boosted(spark, sf):
    return _once(spark, sf, "money-boosted", lambda: ML.boosted_trees(MONEY_FEATURES, "label", weight="weight").fit(money_train(spark, sf)))


def money_forest(spark, sf):
    return _once(spark, sf, "money-forest", lambda: ML.random_forest(MONEY_FEATURES, "label", weight="weight").fit(money_train(spark, sf)))


def money_models(spark, sf):
    money_train(spark, sf)          # one table for both
    return tuple(ML.together([lambda: money_boosted(spark, sf), lambda: money_forest(spark, sf)]))


def money_calibration(spark, sf):
    """The scores are read several times, so they are written."""
    scored = ML.score_with(money_forest(spark, sf), M.step_split(money(spark, sf)).filter("split = 'test'"))
    return CF.single_calibration(written(scored.select("label", "score"), "calibration"))


CARD_SPLIT_SQL = with_(CARDS_SQL) + """, ordered AS (SELECT *, CAST("Class" AS BIGINT) AS label, row_number() OVER (ORDER BY "Time", CAST(round("Time" * 1000000) AS BIGINT)) AS pos, count(*) OVER () AS total FROM cards),
split AS (SELECT *, CASE WHEN pos <= CAST(floor(total * 0.8E0) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM ordered)
"""
OVERSAMPLED = 0.5       # positives to negatives; the classes of the test cards are nearer to each other than the default ratio


@query("J4", CARD_SPLIT_SQL + f""", n AS (SELECT count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM split WHERE split = 'train')
SELECT label, CASE WHEN label = 1 THEN greatest(any_value(n.pos), CAST(floor(any_value(n.neg) * {OVERSAMPLED}E0) AS BIGINT)) ELSE any_value(n.neg) END AS n,
 round(min("V14"), 4) AS v14_min, round(max("V14"), 4) AS v14_max, round(min("Amount"), 4) AS amount_min, round(max("Amount"), 4) AS amount_max FROM split, n WHERE split = 'train' GROUP BY label""")
def j4(spark, sf):
    made = ML.smote(card_split(spark, sf)[0], "label", "id", CARD_FEATURES, ratio=OVERSAMPLED)
    edges = [f(c) for c in ("V14", "Amount") for f in (F.min, F.max)]
    return made.groupBy(F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"), *[
        F.round(e, 4).alias(n) for e, n in zip(edges, ("v14_min", "v14_max", "amount_min", "amount_max"), strict=True)])


def card_folds(spark, sf):
    """Scores of five folds; each fold's boosted trees see oversampled rows of the other four."""
    resample = lambda train: ML.smote(train, "label", "id", CARD_FEATURES, ratio=OVERSAMPLED)
    return _once(spark, sf, "folds", lambda: written(
        ML.out_of_fold(card_split(spark, sf)[0], "label", "id", ML.boosted_trees(CARD_FEATURES, "label"), resample=resample), "scores"))


@query("J5")
def j5(spark, sf):
    return card_folds(spark, sf)


@query("J5_folds", CARD_SPLIT_SQL + """, f AS (SELECT label, (row_number() OVER (PARTITION BY label) - 1) % 5 AS fold FROM split WHERE split = 'train')
SELECT CAST(fold AS INTEGER) AS fold, label, count(*) AS n, count(*) AS n_scored FROM f GROUP BY ALL""")
def j5_folds(spark, sf):
    return card_folds(spark, sf).groupBy("fold", F.col("label").cast("long").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("score") >= 0) & (F.col("score") <= 1)).alias("n_scored"))


@query("J5_threshold")
def j5_threshold(spark, sf):
    """The threshold that the out-of-fold scores calibrate, and the held-out rows at it."""
    threshold = M.best_threshold(card_folds(spark, sf)).first().threshold
    train, test = card_split(spark, sf)
    model = ML.boosted_trees(CARD_FEATURES, "label").fit(ML.dealt(ML.smote(train, "label", "id", CARD_FEATURES, ratio=OVERSAMPLED), "id"))
    return ML.evaluate(ML.score_with(model, test), "label", threshold)


@query("J6")
def j6(spark, sf):
    return ML.score_with(money_boosted(spark, sf), money(spark, sf)).select("id", "label", "score")


@query("J7")
def j7(spark, sf):
    return ML.score_with(money_forest(spark, sf), money(spark, sf)).select("id", "label", "score")


@query("J8")
def j8(spark, sf):
    return ML.score_with(logistic_model(spark, sf), card_split(spark, sf)[1]).select("id", "label", "score")


@query("J15")
def j15(spark, sf):
    rows = X.ledger_model_features(T.ledger(spark, sf).drop("p_lgb", "p_rf"))
    return ML.ensemble(rows, *money_models(spark, sf)).select("id", "account_id", "risk_score_lgb", "risk_score_rf", "risk_score", "flagged")


CARD_MODELS = {"logistic": lambda f, l, weight=None: ML.logistic(f, l, weight=weight), "boosted_trees": lambda f, l, weight=None: ML.boosted_trees(f, l, weight=weight),
               "leafy_trees": lambda f, l, weight=None: ML.leafy_trees(f, l, weight=weight)}


def card_benchmark(spark, sf):
    return _once(spark, sf, "benchmark", lambda: ML.with_winners(ML.benchmark(*card_split(spark, sf), "label", "id", CARD_FEATURES, CARD_MODELS, ["weights", "smote"])))


@query("J16")
def j16(spark, sf):
    return card_benchmark(spark, sf)


@query("J16_rows", CARD_SPLIT_SQL + """, m AS (SELECT unnest(['logistic', 'boosted_trees', 'leafy_trees']) AS model), s AS (SELECT unnest(['weights', 'smote']) AS strategy)
SELECT model, strategy, count(*) AS n_test, count(*) FILTER (label = 1) AS n_positive FROM split, m, s WHERE split = 'test' GROUP BY ALL""")
def j16_rows(spark, sf):
    return card_benchmark(spark, sf).select("model", "strategy", (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n_test"), (F.col("tp") + F.col("fn")).alias("n_positive"))


SIM_FEATURES = ["amount", "haversine_distance", "hour_of_day", "is_night", "age_at_transaction", "velocity_1h", "velocity_24h", "amount_to_user_mean_ratio", "city_pop"]
MATRIX_MODELS = {"random_forest": lambda f, l, weight=None: ML.random_forest(f, l, weight=weight),
                 "boosted_trees": lambda f, l, weight=None: ML.boosted_trees(f, l, 150, 5, 0.05, 1.0, weight=weight)}


def simulated_cards(spark, sf):
    rows = X.card_features(CS.normalise_card_sim(T.raw_card_sim(spark, sf)))
    return M.chronological_split(rows.withColumns({"label": F.col("is_fraud").cast("int"), "id": F.col("transaction_id")}).select(
        "id", "label", "timestamp", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in SIM_FEATURES]), ["timestamp", "id"])


def matrix(spark, sf):
    def make():
        sim, m = written(simulated_cards(spark, sf), "sim"), written(M.step_split(money(spark, sf)), "money")
        legs = {"creditcard": (*card_split(spark, sf), CARD_FEATURES),
                "simulated_card": (sim.filter("split = 'train'"), sim.filter("split = 'test'"), SIM_FEATURES),
                "mobile_money": (m.filter("split = 'train'"), m.filter("split = 'test'"), MONEY_FEATURES)}

        def leg(dataset, train, test, features):
            n = train.agg(F.count(F.lit(1)).alias("train_records"), F.count_if(F.col("label") == 1).alias("train_frauds"))
            got = ML.benchmark(train, test, "label", "id", features, MATRIX_MODELS, ["smote"]).withColumn("dataset", F.lit(dataset))
            return got.join(F.broadcast(n), F.lit(True))

        rows = reduce(DataFrame.unionByName, ML.together([lambda d=d, x=x: leg(d, *x) for d, x in legs.items()]))       # no leg waits for another's fits
        return written(rows, "matrix")
    return _once(spark, sf, "matrix", make)


@query("J17")
def j17(spark, sf):
    return matrix(spark, sf)


MATRIX_SQL = CARD_SPLIT_SQL + f""", {SIM_SQL}, {MONEY_SQL}, so AS (SELECT *, row_number() OVER (ORDER BY moment, trans_num) AS pos, count(*) OVER () AS total FROM sim),
mq AS (SELECT *, step <= (SELECT floor(quantile_cont(step, 0.8)) FROM money) AS trains FROM money),
d AS (SELECT 'creditcard' AS dataset, split = 'train' AS trains, label FROM split UNION ALL SELECT 'simulated_card', pos <= CAST(floor(total * 0.8E0) AS BIGINT), is_fraud FROM so
 UNION ALL SELECT 'mobile_money', trains, "isFraud" FROM mq), m AS (SELECT unnest(['random_forest', 'boosted_trees']) AS model)
SELECT dataset, model, count(*) FILTER (trains) AS train_records, count(*) FILTER (trains AND label = 1) AS train_frauds,
 count(*) FILTER (NOT trains) AS test_records, count(*) FILTER (NOT trains AND label = 1) AS test_frauds FROM d, m GROUP BY ALL"""


@query("J17_rows", MATRIX_SQL)
def j17_rows(spark, sf):
    return matrix(spark, sf).select("dataset", "model", "train_records", "train_frauds", (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("test_records"),
                                    (F.col("tp") + F.col("fn")).alias("test_frauds"))


@query("J18")
def j18(spark, sf):
    return E.attribute_logistic(card_split(spark, sf)[1], ["id"], logistic_model(spark, sf), CARD_FEATURES)


MONEY_TEST_SQL = with_(MONEY_SQL) + """, t AS (SELECT *, concat_ws('/', "nameOrig", "nameDest") AS id FROM money WHERE step > (SELECT floor(quantile_cont(step, 0.8)) FROM money))
"""


def money_test(spark, sf):
    return M.step_split(money(spark, sf)).filter("split = 'test'")


@query("J18_trees")
def j18_trees(spark, sf):
    return A.attribute_trees(money_test(spark, sf), ["id"], money_forest(spark, sf), MONEY_FEATURES, top_n=3)


@query("J18_sums", MONEY_TEST_SQL + """SELECT id, m.model, true AS adds_up, true AS is_score FROM t, (SELECT unnest(['forest', 'boosted']) AS model) m""")
def j18_sums(spark, sf):
    """Do base and contributions add up to the ensemble's sum, and is that the model's own score?"""
    rows, rounds = money_test(spark, sf), None
    for model, name in zip(money_models(spark, sf), ("boosted", "forest"), strict=True):
        scored = ML.score_with(model, rows.select("id", *MONEY_FEATURES))
        got = A.tree_contributions(scored, ["id", "score"], model, MONEY_FEATURES)
        total = F.aggregate("contributions", F.col("base"), lambda s, x: s + x)
        link = F.col("total") if name == "forest" else 1 / (1 + F.exp(-2 * F.col("total")))
        got = got.select("id", F.lit(name).alias("model"), (F.abs(total - F.col("total")) < 1e-9).alias("adds_up"), (F.abs(link - F.col("score")) < 1e-9).alias("is_score"))
        rounds = got if rounds is None else rounds.unionByName(got)
    return rounds


@query("J18_record")
def j18_record(spark, sf):
    """One explanation record per held-out row: score, verdict, factors, interval."""
    got = A.explanation(money_test(spark, sf), ["id"], money_forest(spark, sf), MONEY_FEATURES, THRESHOLD, money_calibration(spark, sf), top_n=5)
    return got.withColumn("top_factors", F.to_json("top_factors"))


def _overrides(rows):
    half = F.struct(F.lit("AMOUNT").alias("feature"), (F.col("Amount") / 2).cast("string").alias("value"))
    late = F.struct(F.lit("v14").alias("feature"), F.lit("0.0").alias("value"))
    bad = F.struct(F.lit("V99").alias("feature"), F.lit("1").alias("value"))
    return rows.select("id", F.inline(F.array(half, late, bad)))


@query("J19")
def j19(spark, sf):
    test, model = card_split(spark, sf)[1], logistic_model(spark, sf)
    got = E.counterfactual(test, _overrides(test), ["id"], model, CARD_FEATURES, THRESHOLD, E.logistic_terms(model, CARD_FEATURES))
    return got.withColumn("attribution_deltas", F.size("attribution_deltas"))


@query("J19_rejected", with_(CARDS_SQL) + """SELECT CAST(round("Time" * 1000000) AS BIGINT) AS id, 'V99' AS feature, '1' AS value, 'the model has no feature V99' AS reason FROM cards""")
def j19_rejected(spark, sf):
    return E.split_overrides(_overrides(cards(spark, sf)), CARD_FEATURES)[1]


@query("J20")
def j20(spark, sf):
    led = T.ledger(spark, sf).drop("p_lgb", "p_rf")
    asked = led.filter("direction = 'debit' AND amount >= 45000").select("id", (F.col("amount") / 10).alias("new_amount"))
    return E.amount_counterfactual(led, asked, *money_models(spark, sf), money_calibration(spark, sf))


J20_ROWS = with_(LEDGER_SQL) + """, w AS (SELECT *, lag(balance) OVER o AS prev, row_number() OVER o - 1 AS position FROM ledger WINDOW o AS (PARTITION BY account_id ORDER BY dt, id)),
r AS (SELECT *, amount / 10 AS new_amount, balance - (amount / 10 - amount) AS b FROM w WHERE direction = 'debit' AND amount >= 45000)
SELECT id, amount AS original_amount, new_amount, b AS balance, greatest(0.0E0, least(1.0E0, new_amount / greatest(b + new_amount, 0.01E0))) AS balance_drain_ratio,
 round(ln(1 + position), 6) AS tx_velocity, round(ln(1 + abs(abs(coalesce(b - prev, 0.0E0)) - new_amount)), 6) AS orig_dest_mismatch FROM r"""


@query("J20_rows", J20_ROWS)
def j20_rows(spark, sf):
    led = T.ledger(spark, sf)
    asked = led.filter("direction = 'debit' AND amount >= 45000").select("id", (F.col("amount") / 10).alias("new_amount"))
    return E.amount_counterfactual_rows(led, asked).select("id", "original_amount", "new_amount", "balance", "balance_drain_ratio",
                                                           F.round("tx_velocity", 6).alias("tx_velocity"), F.round("orig_dest_mismatch", 6).alias("orig_dest_mismatch"))


def _repeats(led):
    return led.filter("amount >= 49000").select("id", F.lit(7).alias("days_ahead"))


BANDS = [(1_000_000.0, 1_100_000.0)]


@query("J21")
def j21(spark, sf):
    led = T.ledger(spark, sf).drop("p_lgb", "p_rf")
    return out(E.forward_simulation(led, _repeats(led), *money_models(spark, sf), money_calibration(spark, sf), bands=BANDS))


@query("J21_rows", with_(LEDGER_SQL) + """, e AS (SELECT account_id, max(dt) AS last_dt, arg_max(balance, {'a': dt, 'b': id}) AS last_balance FROM ledger GROUP BY ALL),
r AS (SELECT l.*, last_dt, last_balance FROM ledger l JOIN e USING (account_id) WHERE amount >= 49000),
s AS (SELECT e.account_id, sum(CAST(amount AS DECIMAL(28,6))) AS recent FROM ledger l JOIN e USING (account_id) WHERE direction = 'debit' AND l.dt >= e.last_dt + INTERVAL 7 DAYS - INTERVAL 30 DAYS GROUP BY ALL),
t AS (SELECT r.*, CAST(coalesce(recent, 0) AS DOUBLE) + CASE WHEN direction = 'debit' THEN amount ELSE 0 END AS total FROM r LEFT JOIN s USING (account_id))
SELECT id, account_id, CAST(last_dt + INTERVAL 7 DAYS AS DATE) AS simulated_date, CASE WHEN direction = 'debit' THEN last_balance - amount ELSE last_balance + amount END AS balance,
 total AS rolling_outflow, total >= 1000000 AND total < 1100000 AS structuring_alert FROM t""")
def j21_rows(spark, sf):
    led = T.ledger(spark, sf)
    return E.forward_rows(led, _repeats(led), bands=BANDS).select("id", "account_id", "simulated_date", "balance", "rolling_outflow", "structuring_alert")


SUITE = [("half amount", {"Amount": 50.0}), ("night", {"Time": 7_200.0}), ("quiet signals", {"V14": 0.0, "V10": 0.0})]


@query("J22")
def j22(spark, sf):
    test = card_split(spark, sf)[1].filter("label = 1")
    got = E.perturbation_suite(test, "id", SUITE, logistic_model(spark, sf), CARD_FEATURES, THRESHOLD)
    return got.withColumn("top_drivers", joined("top_drivers"))


@query("J24", with_(LEDGER_SQL) + "SELECT id, amount, 0.0E0 AS absent, coalesce(CAST(chq_no AS DOUBLE), 0.0E0) AS chq_no FROM ledger")
def j24(spark, sf):
    return X.align(T.ledger(spark, sf), ["amount", "absent", "chq_no"], ["id"])


@query("C9", with_(CARDS_SQL) + """, w AS (SELECT CAST(event_id * 2 AS BIGINT) AS row_index, value AS amount FROM events), c AS (SELECT *, row_number() OVER (ORDER BY "Time") - 1 AS row_index FROM cards)
SELECT w.row_index, coalesce(c."Amount", w.amount) AS "Amount", coalesce(c."V14", 0.0E0) AS "V14" FROM w LEFT JOIN c USING (row_index)""")
def c9(spark, sf):
    rows = N.Ordered(cards(spark, sf), [], ["Time"]).numbered("rn").plain().withColumn("row_index", F.col("rn") - 1)
    wanted = T.table(spark, sf, "events").select((F.col("event_id") * 2).cast("long").alias("row_index"), F.col("value").alias("amount"))
    default = {f: 0.0 for f in CARD_FEATURES}
    return E.features_of(rows, wanted, "row_index", CARD_FEATURES, default).select("row_index", "Amount", "V14")


@query("J25")
def j25(spark, sf):
    parts = {"card_models": ML.evaluate(ML.score_with(logistic_model(spark, sf), card_split(spark, sf)[1]), "label"),
             "typology_cases": N.confusion(typology_cases(spark, sf))}
    return ML.report(parts, {"narrative_consistency": "needs a language model"})


@query("K3")
def k3(spark, sf):
    rows = written(ML.score_with(money_forest(spark, sf), money(spark, sf)).select("id", "step", "score"), "scores")
    return DR.ks_drift(rows, ["step", "id"], window_size=5_000, ts="step")
