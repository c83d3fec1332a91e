"""Ranking, metric, drift and interval queries: C3-C5, F9-F13, G, J1-J3, J9-J14, J23, K1, K2, M1-M6."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conformal as CF
from ..operators import drift as DR
from ..operators import metrics as M
from ..operators import queue as Q
from ..sources import tables as T
from .base import CARDS_SQL, LEDGER_SQL, MONEY_SQL, SCORED_SQL, out, query, with_

TAU = 0.3
W = 500
CURVE = """curve AS (SELECT *, called - tp AS fp, sum(p) OVER () AS positives, sum(n) OVER () AS total FROM (
  SELECT score AS threshold, n, p, CAST(sum(n) OVER (ORDER BY score DESC) AS BIGINT) AS called, CAST(sum(p) OVER (ORDER BY score DESC) AS BIGINT) AS tp
  FROM (SELECT score, count(*) AS n, CAST(sum(label) AS BIGINT) AS p FROM scored GROUP BY ALL)))"""


@query("C3", with_(CARDS_SQL) + """, f AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY "Time") AS pos FROM cards WHERE "Class" = 1)
SELECT pos, "Time" AS t, round("Amount", 2) AS amount, total FROM f WHERE pos > 40 AND pos <= 60""")
def c3(spark, sf):
    rows = T.raw_cards(spark, sf).select(F.col("Time").alias("t"), F.col("Amount").alias("amount"), "Class")
    return Q.list_page(rows.filter("Class = 1"), ["t"], offset=40, limit=20).select("pos", "t", F.round("amount", 2).alias("amount"), "total")


@query("C4", with_(LEDGER_SQL) + "SELECT id, p_lgb >= 0.5 OR p_rf >= 0.5 AS flagged FROM ledger")
def c4(spark, sf):
    return T.ledger(spark, sf).select("id", Q.flagged("p_lgb", "p_rf").alias("flagged"))


@query("C5", with_(LEDGER_SQL) + """SELECT id, account_id, risk_score FROM ledger WHERE flagged AND risk_score >= 0.7 AND (contains(lower(id), 'upi') OR contains(lower(account_id), 'upi')
 OR contains(lower(payment_rail), 'upi') OR contains(lower(coalesce(raw_narration, '')), 'upi'))""")
def c5(spark, sf):
    return Q.search(T.scored_ledger(spark, sf).filter("flagged"), "upi", "high").select("id", "account_id", "risk_score")


@query("F9", with_(LEDGER_SQL) + "SELECT id, cume_dist() OVER (ORDER BY risk_score) AS percentile FROM ledger WHERE flagged")
def f9(spark, sf):
    return M.percentile_of(T.scored_ledger(spark, sf).filter("flagged"), "risk_score").select("id", "percentile")


@query("F10", with_(SCORED_SQL) + f"""SELECT id, pos, CASE WHEN pos >= {W} THEN (pos - {W}) // {W} END AS window_index
FROM (SELECT id, row_number() OVER (ORDER BY dt, id) - 1 AS pos FROM scored)""")
def f10(spark, sf):
    return DR.stream_windows(T.scored(spark, sf), ["dt", "id"], W).select("id", "pos", "window_index")


@query("F11", with_(SCORED_SQL) + "SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 100")
def f11(spark, sf):
    return M.top_k(T.scored(spark, sf), 100).select("id", "score", "rank")


@query("F12", with_(SCORED_SQL, CURVE) + "SELECT threshold, tp, fp FROM curve")
def f12(spark, sf):
    return M.score_curve(T.scored(spark, sf)).select("threshold", "tp", "fp")


@query("F13", with_(LEDGER_SQL) + """, p AS (SELECT account_id, count(*) AS n FROM ledger GROUP BY ALL)
SELECT account_id, n, greatest(1, (n + 49) // 50) AS total_pages, least(greatest(1, 1000), greatest(1, (n + 49) // 50)) AS current_page FROM p""")
def f13(spark, sf):
    n = T.ledger(spark, sf).groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumns(dict(zip(("total_pages", "current_page"), Q.page_numbers(F.col("n"), 1000, 50))))


@query("G1", with_(LEDGER_SQL) + "SELECT account_id, dt, id, amount FROM ledger ORDER BY account_id, dt, id")
def g1(spark, sf):
    return out(T.ledger(spark, sf).select("account_id", "dt", "id", "amount").orderBy("account_id", "dt", "id"))


@query("G3", with_(LEDGER_SQL) + "SELECT id, account_id, risk_score FROM ledger WHERE flagged ORDER BY risk_score DESC, id")
def g3(spark, sf):
    return Q.queue(T.scored_ledger(spark, sf)).select("id", "account_id", "risk_score")


@query("G4", with_(LEDGER_SQL) + "SELECT id, account_id, risk_score FROM ledger WHERE flagged ORDER BY risk_score DESC, id LIMIT 25")
def g4(spark, sf):
    return Q.queue(T.scored_ledger(spark, sf), top_n=25).select("id", "account_id", "risk_score")


@query("G6", with_(LEDGER_SQL) + "SELECT account_id, id, amount, risk_score FROM ledger QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY risk_score DESC, dt, id) = 1")
def g6(spark, sf):
    return Q.riskiest(T.scored_ledger(spark, sf)).select("account_id", "id", "amount", "risk_score")


@query("I6", with_(LEDGER_SQL) + """SELECT count(*) AS total, count(*) FILTER (risk_score >= 0.7) AS high, count(*) FILTER (risk_score >= 0.4 AND risk_score < 0.7) AS medium,
 count(DISTINCT CASE WHEN regexp_matches(coalesce(raw_narration, ''), 'smurf|structur|RENT', 'i') OR regexp_matches(payment_rail, 'smurf|structur|RENT', 'i') THEN account_id END) AS structuring_accounts FROM ledger WHERE flagged""")
def i6(spark, sf):
    return Q.kpis(T.scored_ledger(spark, sf).filter("flagged"), pattern="smurf|structur|rent")


@query("I7", with_(LEDGER_SQL) + """SELECT id, account_id, dt, amount, payment_rail, raw_narration, 0.82E0 AS risk_score, true AS flagged FROM ledger WHERE direction = 'debit'
QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY amount DESC, dt, id) = 1""")
def i7(spark, sf):
    return out(Q.fallback_queue(T.ledger(spark, sf)))


SPLIT = """split AS (SELECT *, row_number() OVER (ORDER BY dt, id) AS pos, count(*) OVER () AS total FROM scored)"""


@query("J1", with_(SCORED_SQL, SPLIT) + "SELECT id, CASE WHEN pos <= CAST(floor(total * 0.8E0) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM split")
def j1(spark, sf):
    return M.chronological_split(T.scored(spark, sf), ["dt", "id"]).select("id", "split")


@query("J2", with_(MONEY_SQL) + """SELECT step, CASE WHEN step <= floor((SELECT quantile_cont(step, 0.8) FROM money)) THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM money GROUP BY ALL""")
def j2(spark, sf):
    return M.step_split(T.mobile_money(spark, sf)).groupBy("step", "split").agg(F.count(F.lit(1)).alias("n"))


@query("J3", with_(SCORED_SQL) + """SELECT label, count(*) AS n, round(max(w), 6) AS weight FROM (SELECT label, CASE WHEN label = 1 THEN
 (SELECT count(*) FILTER (label = 0) / count(*) FILTER (label = 1) FROM scored) ELSE 1.0E0 END AS w FROM scored) GROUP BY ALL""")
def j3(spark, sf):
    return M.class_weights(T.scored(spark, sf), "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("weight"))


@query("J9", with_(SCORED_SQL, CURVE) + """SELECT threshold, round(f1, 8) AS f1 FROM (SELECT threshold, 2 * (tp / called) * (tp / positives) / (tp / called + tp / positives + 1e-10) AS f1 FROM curve)
ORDER BY f1 DESC, threshold LIMIT 1""")
def j9(spark, sf):
    return M.best_threshold(T.scored(spark, sf)).withColumn("f1", F.round("f1", 8))


CONF = f"""conf AS (SELECT count(*) FILTER (label = 1 AND score >= {TAU}) AS tp, count(*) FILTER (label = 0 AND score >= {TAU}) AS fp,
 count(*) FILTER (label = 0 AND score < {TAU}) AS tn, count(*) FILTER (label = 1 AND score < {TAU}) AS fn FROM scored)"""


@query("J10", with_(SCORED_SQL, CONF) + """SELECT tp, fp, tn, fn, round(tp / (tp + fp), 8) AS "precision", round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1 FROM conf""")
def j10(spark, sf):
    return M.confusion_at(T.scored(spark, sf), TAU).withColumns({c: F.round(c, 8) for c in ("precision", "recall", "f1")})


@query("J11", with_(SCORED_SQL, CURVE) + "SELECT round(sum(p / positives * (tp / called)), 8) AS average_precision FROM curve")
def j11(spark, sf):
    return M.average_precision(T.scored(spark, sf)).select(F.round("average_precision", 8).alias("average_precision"))


@query("J12", with_(SCORED_SQL) + """, r AS (SELECT label, (rank() OVER (ORDER BY score) + rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) - 1) / 2.0E0 AS r FROM scored)
SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0E0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 8) AS roc_auc FROM r""")
def j12(spark, sf):
    return M.roc_auc(T.scored(spark, sf)).select(F.round("roc_auc", 8).alias("roc_auc"))


@query("J13", with_(SCORED_SQL, CONF) + """, f AS (SELECT *, 2 * tp / (2 * tp + fp + fn) AS a, 2 * tn / (2 * tn + fp + fn) AS b FROM conf)
SELECT round((a + b) / 2, 8) AS macro_f1, round((a * (tp + fn) + b * (tn + fp)) / (tp + fp + tn + fn), 8) AS weighted_f1 FROM f""")
def j13(spark, sf):
    return M.averaged_f1(T.scored(spark, sf), TAU).withColumns({c: F.round(c, 8) for c in ("macro_f1", "weighted_f1")})


@query("J14", with_(SCORED_SQL) + """, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn, greatest(1, CAST(floor(count(*) OVER () * 0.01E0) AS BIGINT)) AS k, sum(label) OVER () AS positives FROM scored)
SELECT k, round(sum(label) / k, 8) AS precision_at_k, round(sum(label) / max(positives), 8) AS recall_at_k FROM t WHERE rn <= k GROUP BY k""")
def j14(spark, sf):
    return M.at_alert_budget(T.scored(spark, sf)).withColumns({c: F.round(c, 8) for c in ("precision_at_k", "recall_at_k")})


@query("J23", with_(SCORED_SQL) + """SELECT label, CASE WHEN label = 1 THEN least(500, count(*)) ELSE least(2000 - least(500, (SELECT count(*) FROM scored WHERE label = 1)), count(*)) END AS n FROM scored GROUP BY label""")
def j23(spark, sf):
    return M.seeded_sample(T.scored(spark, sf), "label", "id", total=2000).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# -- drift -------------------------------------------------------------------------------
KS = """vals AS (SELECT DISTINCT w.win, r.score AS v FROM (SELECT DISTINCT win FROM rows_ WHERE win IS NOT NULL) w, rows_ r WHERE r.is_ref OR r.win = w.win),
ref_cdf AS (SELECT v, (SELECT count(*) FROM rows_ r WHERE r.is_ref AND r.score <= v) / (SELECT count(*) FROM rows_ WHERE is_ref) AS f FROM (SELECT DISTINCT v FROM vals)),
own AS (SELECT win, score, count(*) AS c FROM rows_ WHERE win IS NOT NULL GROUP BY ALL),
own_cdf AS (SELECT v.win, v.v, coalesce(sum(o.c) FILTER (o.score <= v.v), 0) / sum(o.c) AS f FROM vals v JOIN own o ON o.win = v.win GROUP BY ALL),
ks AS (SELECT win, max(abs(o.f - r.f)) AS d FROM own_cdf o JOIN ref_cdf r USING (v) GROUP BY win)"""
TAIL = """list_sum(list_transform(range(1, CAST(n // k AS BIGINT) + 1), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0E0 ELSE -2.0E0 END)
 * exp(list_sum(list_transform(range(1, CAST(j * k AS BIGINT) + 1), lambda i: ln((n - i + 1) / (n + i)))))))"""
# the chance to have left the band, diagonal by diagonal: w[i + 1] belongs to the point (i, s - i)
PATHS = """sizes AS (SELECT win, least(n, m) AS a, greatest(n, m) AS b, CAST(round(d * lcm(n, m)) AS BIGINT) * gcd(n, m) AS h FROM p),
walk(win, s, w) USING KEY (win) AS (
  SELECT win, CAST(0 AS BIGINT), list_transform(range(0, a + 1), lambda i: CASE WHEN i = 0 THEN 0.0E0 ELSE 1.0E0 END) FROM sizes
  UNION SELECT walk.win, s + 1, list_transform(range(0, a + 1), lambda i: CASE WHEN i > s + 1 OR s + 1 - i > b OR abs(i * b - (s + 1 - i) * a) >= h THEN 1.0E0
     ELSE CASE WHEN i = 0 THEN 0.0E0 ELSE i / (s + 1) * w[i] END + (s + 1 - i) / (s + 1) * w[i + 1] END)
  FROM walk JOIN sizes USING (win) WHERE s < a + b),
tails AS (SELECT win, w[a + 1] AS tail FROM walk JOIN sizes USING (win))"""


@query("K1", with_(SCORED_SQL, recursive=True).rstrip() + f""", rows_ AS (SELECT *, pos < {W} AS is_ref, CASE WHEN pos >= {W} THEN (pos - {W}) // {W} END AS win FROM
 (SELECT *, row_number() OVER (ORDER BY dt, id) - 1 AS pos FROM scored)), {KS},
info AS (SELECT win, min(dt) AS window_start, max(dt) AS window_end, count(*) AS n, avg(score) AS current_mean FROM rows_ WHERE NOT is_ref GROUP BY ALL HAVING count(*) >= 10),
p AS (SELECT *, CAST(round(n * d) AS BIGINT) AS k, {W} AS m FROM ks JOIN info USING (win)),
{PATHS},
q AS (SELECT *, greatest(0.0E0, least(1.0E0, CASE WHEN k = 0 THEN 1.0E0 WHEN n = m THEN {TAIL} ELSE tail END)) AS pv FROM p JOIN tails USING (win))
SELECT win AS window_index, window_start, window_end, n AS n_samples, round(d, 6) AS ks_statistic, round(pv, 6) AS p_value, pv < 0.05 AS drift_fired, 0.05E0 AS alpha,
 round((SELECT avg(score) FROM rows_ WHERE is_ref), 6) AS reference_mean, round(current_mean, 6) AS current_mean FROM q""")
def k1(spark, sf):
    return out(DR.ks_drift(T.scored(spark, sf), ["dt", "id"], W))


@query("K2", with_(LEDGER_SQL, recursive=True).rstrip() + f""", keyed AS (SELECT strftime(dt, '%Y-%m') AS win, risk_score AS score FROM ledger),
months AS (SELECT win, row_number() OVER (ORDER BY win) AS mno FROM (SELECT DISTINCT win FROM keyed)),
rows_ AS (SELECT win, score, mno <= 4 AS is_ref FROM keyed JOIN months USING (win)), {KS},
info AS (SELECT win, count(*) AS n, avg(score) AS mean_score, stddev_pop(score) AS std_score FROM rows_ GROUP BY ALL),
p AS (SELECT *, CAST(round(n * d) AS BIGINT) AS k, (SELECT count(*) FROM rows_ WHERE is_ref) AS m FROM ks JOIN info USING (win)),
{PATHS},
q AS (SELECT *, tail AS pv FROM p JOIN tails USING (win))
SELECT win AS month_key, n AS n_samples, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score, round(d, 6) AS ks_statistic, round(pv, 6) AS p_value, pv < 0.01 AS drift_fired FROM q""")
def k2(spark, sf):
    return DR.monthly_drift(T.scored_ledger(spark, sf).select("dt", F.col("risk_score").alias("score")))


# -- intervals ---------------------------------------------------------------------------
HALVES = """halves AS (SELECT *, CASE WHEN pos <= total // 2 THEN 'calibrate' ELSE 'evaluate' END AS half FROM
 (SELECT *, row_number() OVER (ORDER BY dt, id) AS pos, count(*) OVER () AS total FROM scored))"""


def _cal_sql(src):
    ranked = lambda name, part, pick: (f"{name} AS (SELECT {pick}, max(residual) FILTER (rn = least(total, CAST(ceil((total + 1) * 0.9E0) AS BIGINT))) AS q, max(total) AS total FROM "
                                       f"(SELECT *, row_number() OVER ({part} ORDER BY residual) AS rn, count(*) OVER ({part}) AS total FROM res) GROUP BY ALL)")
    return (f"res AS (SELECT CASE WHEN score >= {TAU} THEN 'flagged' ELSE 'clear' END AS side, abs(label - score) AS residual FROM {src}), "
            + ranked("per_side", "PARTITION BY side", "side") + ", " + ranked("pool", "", "1 AS one") +
            """, cal AS (SELECT s.side, coalesce(total, 0) AS n_calibration, coalesce(total, 0) < 10 AS used_pooled, CASE WHEN coalesce(total, 0) < 10 THEN (SELECT q FROM pool) ELSE q END AS q
 FROM (SELECT unnest(['flagged', 'clear']) AS side) s LEFT JOIN per_side USING (side))""")


CALIB = "(SELECT * FROM halves WHERE half = 'calibrate')"
BOUNDS = f"""bounds AS (SELECT h.*, c.side, greatest(0.0E0, least(1.0E0, score - q)) AS lower, greatest(0.0E0, least(1.0E0, score + q)) AS upper FROM halves h
 JOIN cal c ON c.side = CASE WHEN score >= {TAU} THEN 'flagged' ELSE 'clear' END WHERE half = 'evaluate')"""


def _halves(spark, sf):
    return CF.halves(T.scored(spark, sf), ["dt", "id"])


@query("M1", with_(SCORED_SQL, HALVES, _cal_sql(CALIB)) + "SELECT * FROM cal")
def m1(spark, sf):
    return CF.mondrian_calibration(_halves(spark, sf).filter("half = 'calibrate'"), TAU)


@query("M2", with_(SCORED_SQL, HALVES) + "SELECT id, half FROM halves")
def m2(spark, sf):
    return _halves(spark, sf).select("id", "half")


@query("M3", with_(SCORED_SQL, HALVES, _cal_sql(CALIB), BOUNDS) + """, s AS (SELECT *, unnest(['pooled', 'side:' || side, 'class:' || CASE WHEN label = 1 THEN 'fraud' ELSE 'legitimate' END]) AS slice FROM bounds)
SELECT slice, count(*) AS n, round(avg(CASE WHEN label >= lower AND label <= upper THEN 1.0E0 ELSE 0.0E0 END), 4) AS empirical_coverage, round(avg(upper - lower), 4) AS mean_width FROM s GROUP BY ALL""")
def m3(spark, sf):
    h = _halves(spark, sf)
    return CF.coverage(h.filter("half = 'evaluate'"), CF.mondrian_calibration(h.filter("half = 'calibrate'"), TAU), TAU)


@query("M4", with_(SCORED_SQL, HALVES, _cal_sql(CALIB), BOUNDS) + "SELECT id, side, round(lower, 4) AS lower, round(upper, 4) AS upper FROM bounds")
def m4(spark, sf):
    h = _halves(spark, sf)
    cal = CF.mondrian_calibration(h.filter("half = 'calibrate'"), TAU)
    return CF.risk_intervals(h.filter("half = 'evaluate'"), cal, TAU).select("id", "side", "lower", "upper")


SINGLE = """res AS (SELECT abs(label - score) AS r FROM scored), lv AS (SELECT count(*) AS n, least(1.0E0, ceil((count(*) + 1) * 0.9E0) / count(*)) AS lv FROM res),
rk AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS i FROM res),
single AS (SELECT n, lv, a.r + (b.r - a.r) * ((n - 1) * lv - floor((n - 1) * lv)) AS q_hat FROM lv JOIN rk a ON a.i = floor((n - 1) * lv) JOIN rk b ON b.i = ceil((n - 1) * lv))"""


@query("M5", with_(SCORED_SQL, SINGLE) + """SELECT round(q_hat, 8) AS q_hat, 0.9E0 AS confidence, n AS n_calibration, lv AS quantile_level,
 round((SELECT count(*) FROM res WHERE r <= q_hat) / n, 4) AS empirical_coverage FROM single""")
def m5(spark, sf):
    return CF.single_calibration(T.scored(spark, sf)).withColumn("q_hat", F.round("q_hat", 8))


@query("M6", with_(SCORED_SQL, LEDGER_SQL, SINGLE) + """SELECT id, conformal_lo, conformal_hi, confidence_pct, printf('risk score: %.2f, 90%% CI: [%.2f, %.2f]', risk_score, conformal_lo, conformal_hi) AS conformal_label FROM
 (SELECT id, risk_score, round(greatest(0.0E0, least(1.0E0, risk_score - q_hat)), 4) AS conformal_lo, round(greatest(0.0E0, least(1.0E0, risk_score + q_hat)), 4) AS conformal_hi, 90 AS confidence_pct FROM ledger, single WHERE flagged)""")
def m6(spark, sf):
    cal = CF.single_calibration(T.scored(spark, sf))
    return CF.wrap_queue(T.scored_ledger(spark, sf).filter("flagged"), cal).select("id", "conformal_lo", "conformal_hi", "confidence_pct", "conformal_label")
