"""Ledger queries: D1-D14, C1, C2, C8 and the plain window functions F1-F3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import reversals as R
from ..sources import ledger as S
from ..sources import tables as T
from .base import LEDGER_SQL, joined, out, query, with_

BREAK_SIGMAS = 1.5      # steps of the test ledger are near-uniform, so 3.5 would match nothing
SPIKE_COUNT = 3
ANOMALY_ARGS = dict(breaks=dict(sigmas=BREAK_SIGMAS), spikes=dict(min_count=SPIKE_COUNT))
ACCOUNT = "AC000000"

W = "(PARTITION BY account_id ORDER BY dt, id)"
STEPS = f"""steps AS (SELECT *, balance - lag(balance) OVER w AS step, lag(id) OVER w AS prev_id, lag(dt) OVER w AS prev_dt,
  (epoch_us(dt) - epoch_us(lag(dt) OVER w)) / 3600000000.0E0 AS gap_hours FROM ledger WINDOW w AS {W})"""
DAYS = """days AS (SELECT account_id, CAST(dt AS DATE) AS day, count(*) AS n, min(dt) AS first_dt, max(dt) AS last_dt
  FROM ledger GROUP BY ALL),
velocity AS (SELECT account_id, avg(n) AS mean_daily, coalesce(stddev_samp(n), 0.0E0) AS std_daily,
  quantile_cont(n, 0.95) AS p95_daily, max(n) AS max_daily, CAST(sum(n) AS BIGINT) AS total FROM days GROUP BY ALL)"""
# The waiting list is carried along each (account, amount) group row by row.
PAIRS = """seq AS (SELECT account_id, round(amount, 2) AS amount, dt, id, direction,
    row_number() OVER (PARTITION BY account_id, round(amount, 2) ORDER BY dt, id) AS rn FROM ledger),
walk AS (
  SELECT account_id, amount, rn, [{'id': id, 'dt': dt, 'dir': direction}] AS q,
    CAST(NULL AS VARCHAR) AS id_1, CAST(NULL AS TIMESTAMP) AS dt_1, id AS id_2, dt AS dt_2 FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.account_id, s.amount, s.rn,
    CASE WHEN len(k.live) > 0 AND k.live[1].dir <> s.direction THEN k.live[2:]
         ELSE list_append(k.live, {'id': s.id, 'dt': s.dt, 'dir': s.direction}) END,
    CASE WHEN len(k.live) > 0 AND k.live[1].dir <> s.direction THEN k.live[1].id END,
    CASE WHEN len(k.live) > 0 AND k.live[1].dir <> s.direction THEN k.live[1].dt END, s.id, s.dt
  FROM (SELECT w.account_id, w.amount, w.rn + 1 AS rn, s2.dt AS at,
          list_filter(w.q, lambda x: epoch_us(s2.dt) - epoch_us(x.dt) <= 172800000000) AS live
        FROM walk w JOIN seq s2 ON s2.account_id = w.account_id AND s2.amount = w.amount AND s2.rn = w.rn + 1) k
  JOIN seq s ON s.account_id = k.account_id AND s.amount = k.amount AND s.rn = k.rn),
pairs AS (SELECT account_id, amount, id_1, dt_1, id_2, dt_2 FROM walk WHERE id_1 IS NOT NULL)"""
BREAKS = f"""step_stats AS (SELECT account_id, count(*) AS n, avg(balance) AS mean_balance, coalesce(avg(step), 0.0E0) AS mean_step,
  coalesce(stddev_pop(step), 0.0E0) AS std_step FROM steps GROUP BY ALL),
breaks AS (SELECT account_id, 'balance_break' AS anomaly_type, prev_dt AS window_start, dt AS window_end,
  round(least(1.0E0, 0.6E0 + 0.08E0 * least(5.0E0, abs(step - mean_step) / greatest(1.0E0, std_step))), 2) AS severity,
  round(mean_balance, 2) AS baseline_value, round(balance, 2) AS observed_value, [prev_id, id] AS evidence
  FROM steps JOIN step_stats USING (account_id)
  WHERE n >= 5 AND step < -100000 AND step < mean_step - {BREAK_SIGMAS} * greatest(1.0E0, std_step)
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY dt, id) <= 10)"""
SPIKES = f"""spike_days AS (SELECT *, round(least(1.0E0, 0.65E0 + 0.07E0 * least(5.0E0, (n - mean_daily) / greatest(1.0E0, std_daily))), 2) AS severity
  FROM days JOIN velocity USING (account_id)
  WHERE total >= 5 AND n >= greatest({SPIKE_COUNT}, mean_daily + 2.8E0 * greatest(1.0E0, std_daily), p95_daily * 1.5E0)
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY severity DESC, day) <= 10),
spike_ids AS (SELECT account_id, day, (list(id ORDER BY dt, id))[1:5] AS evidence FROM ledger l
  JOIN spike_days d USING (account_id) WHERE CAST(l.dt AS DATE) = d.day GROUP BY ALL),
spikes AS (SELECT account_id, 'timing_spike' AS anomaly_type, first_dt AS window_start, last_dt AS window_end, severity,
  round(mean_daily, 2) AS baseline_value, CAST(n AS DOUBLE) AS observed_value, evidence
  FROM spike_days JOIN spike_ids USING (account_id, day))"""
REVERSALS = """weeks AS (SELECT account_id, date_trunc('week', dt_2) AS week, count(*) AS pairs, min(dt_1) AS window_start,
  max(dt_2) AS window_end, (list([id_1, id_2] ORDER BY dt_2, id_2))[1:4] AS ids FROM pairs GROUP BY ALL HAVING count(*) >= 3),
rates AS (SELECT account_id, round(closed / n, 4) AS baseline_value FROM
  (SELECT account_id, count(*) AS n FROM ledger GROUP BY ALL) JOIN (SELECT account_id, count(*) AS closed FROM pairs GROUP BY ALL)
  USING (account_id) WHERE n >= 10),
flat AS (SELECT account_id, week, any_value(pairs) AS pairs, any_value(window_start) AS window_start, any_value(window_end) AS window_end,
  list(x ORDER BY pos) AS ids FROM (SELECT account_id, week, pairs, window_start, window_end, x, min(pos) AS pos FROM
   (SELECT *, unnest(flatten(ids)) AS x, generate_subscripts(flatten(ids), 1) AS pos FROM weeks) GROUP BY ALL) GROUP BY account_id, week),
reversals AS (SELECT account_id, 'reversal_outlier' AS anomaly_type, window_start, window_end,
  round(least(1.0E0, 0.70E0 + 0.05E0 * least(6, pairs)), 2) AS severity, baseline_value, CAST(pairs AS DOUBLE) AS observed_value,
  ids[1:6] AS evidence FROM flat JOIN rates USING (account_id)
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY round(least(1.0E0, 0.70E0 + 0.05E0 * least(6, pairs)), 2) DESC, week) <= 10)"""
ANOMALIES = """anomalies AS (SELECT * FROM breaks UNION ALL SELECT * FROM spikes UNION ALL SELECT * FROM reversals)"""
ALL_ANOMALIES = with_(LEDGER_SQL, STEPS, DAYS, PAIRS, BREAKS, SPIKES, REVERSALS, ANOMALIES, recursive=True)
TEXT = "* REPLACE (array_to_string(evidence, ',') AS evidence)"


def anomalies(spark, sf):
    return L.all_anomalies(T.ledger(spark, sf), **ANOMALY_ARGS)


def texted(df):
    return out(df.withColumn("evidence", joined("evidence")))


def side(name, cond):
    a = f"CASE WHEN {cond} THEN amount END"
    return f"""count({a}) AS {name}_count, round(coalesce(sum({a}), 0.0E0), 2) AS {name}_total, round(coalesce(avg({a}), 0.0E0), 6) AS {name}_mean,
 round(coalesce(stddev_pop({a}), 0.0E0), 6) AS {name}_std, coalesce(quantile_cont({a}, 0.5), 0.0E0) AS {name}_median,
 round(coalesce(quantile_cont({a}, 0.95), 0.0E0), 6) AS {name}_p95"""


BASELINE = f"""base AS (SELECT account_id, count(*) AS total_transactions, min(dt) AS start_dt, max(dt) AS end_dt,
 {side('debit', "direction = 'debit'")}, {side('credit', "direction <> 'debit'")},
 round(avg(balance), 4) AS balance_mean, round(stddev_pop(balance), 4) AS balance_std, min(balance) AS balance_min, max(balance) AS balance_max,
 round(coalesce(avg(step), 0.0E0), 4) AS mean_step, round(coalesce(stddev_pop(step), 0.0E0), 4) AS std_step,
 round(coalesce(avg(gap_hours), 0.0E0), 6) AS mean_interval_hours, round(coalesce(stddev_samp(gap_hours), 0.0E0), 6) AS std_interval_hours,
 round(avg(balance) - 3 * stddev_pop(balance), 4) AS lower_bound_3sigma
 FROM steps GROUP BY account_id)"""
ROUNDED = {"debit_total": 2, "credit_total": 2, "balance_mean": 4, "balance_std": 4, "mean_step": 4, "std_step": 4,
           "lower_bound_3sigma": 4, **{c: 6 for c in (
               "debit_mean", "debit_std", "debit_p95", "credit_mean", "credit_std", "credit_p95",
               "mean_interval_hours", "std_interval_hours", "mean_daily", "std_daily", "p95_daily", "reversal_rate")}}


@query("D1", with_(LEDGER_SQL, STEPS, DAYS, PAIRS, BASELINE, recursive=True) + """
SELECT base.*, round(mean_daily, 6) AS mean_daily, round(std_daily, 6) AS std_daily, round(p95_daily, 6) AS p95_daily, max_daily,
 coalesce(c.closed, 0) AS reversal_count, round(coalesce(c.closed, 0) / total_transactions, 6) AS reversal_rate
FROM base JOIN velocity USING (account_id) LEFT JOIN (SELECT account_id, count(*) AS closed FROM pairs GROUP BY ALL) c USING (account_id)""")
def d1(spark, sf):
    return out(L.account_baseline(T.ledger(spark, sf)).withColumns(
        {c: F.round(c, n) for c, n in ROUNDED.items()}))


@query("D2", with_(LEDGER_SQL, STEPS, BREAKS) + f"SELECT {TEXT} FROM breaks")
def d2(spark, sf):
    return texted(L.balance_breaks(T.ledger(spark, sf), sigmas=BREAK_SIGMAS))


@query("D3", with_(LEDGER_SQL, DAYS, SPIKES) + f"SELECT {TEXT} FROM spikes")
def d3(spark, sf):
    return texted(L.timing_spikes(T.ledger(spark, sf), min_count=SPIKE_COUNT))


@query("D4", with_(LEDGER_SQL, PAIRS, recursive=True) + "SELECT * FROM pairs")
def d4(spark, sf):
    return out(R.reversal_pairs(T.ledger(spark, sf)))


@query("D5", with_(LEDGER_SQL, PAIRS, REVERSALS, recursive=True) + f"SELECT {TEXT} FROM reversals")
def d5(spark, sf):
    return texted(L.reversal_outliers(T.ledger(spark, sf)))


@query("D6", ALL_ANOMALIES + f"SELECT {TEXT} FROM anomalies")
def d6(spark, sf):
    return texted(anomalies(spark, sf))


@query("D7", ALL_ANOMALIES + f"""SELECT {TEXT} FROM anomalies
ORDER BY severity DESC, account_id, anomaly_type, window_start, window_end LIMIT 50 OFFSET 20""")
def d7(spark, sf):
    return texted(L.page(anomalies(spark, sf), limit=50, offset=20))


@query("C8", ALL_ANOMALIES + f"SELECT {TEXT} FROM anomalies WHERE account_id = '{ACCOUNT}'")
def c8(spark, sf):
    return texted(L.account_anomalies(anomalies(spark, sf), f"'{ACCOUNT} "))


@query("D8", with_(LEDGER_SQL) + """SELECT account_id, count(*) AS total_transactions, min(dt) AS start_dt, max(dt) AS end_dt,
 arg_min(balance, {'a': dt, 'b': id}) AS initial_balance, arg_max(balance, {'a': dt, 'b': id}) AS final_balance,
 min(balance) AS min_balance, max(balance) AS max_balance,
 coalesce(sum(CASE WHEN direction = 'debit' THEN amount END), 0.0E0) AS total_debit_volume,
 coalesce(sum(CASE WHEN direction <> 'debit' THEN amount END), 0.0E0) AS total_credit_volume,
 count(*) FILTER (direction = 'debit') AS debit_count, count(*) FILTER (direction <> 'debit') AS credit_count,
 any_value(top_rail) AS top_rail
FROM ledger JOIN (SELECT account_id, payment_rail AS top_rail FROM (SELECT account_id, payment_rail, count(*) AS c FROM ledger GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY c DESC, payment_rail) = 1) USING (account_id) GROUP BY account_id""")
def d8(spark, sf):
    return out(L.account_summaries(T.ledger(spark, sf)))


@query("D9", ALL_ANOMALIES + """, marks AS (SELECT account_id, CAST(window_start AS DATE) AS day FROM anomalies
  UNION SELECT account_id, CAST(window_end AS DATE) FROM anomalies)
SELECT account_id, day, count(*) AS tx_count,
 round(coalesce(sum(CASE WHEN direction = 'debit' THEN amount END), 0.0E0), 2) AS debit_volume,
 round(coalesce(sum(CASE WHEN direction <> 'debit' THEN amount END), 0.0E0), 2) AS credit_volume,
 round(arg_max(balance, {'a': dt, 'b': id}), 2) AS closing_balance,
 bool_or(m.day IS NOT NULL) AS has_anomaly
FROM (SELECT *, CAST(dt AS DATE) AS day FROM ledger) l LEFT JOIN marks m USING (account_id, day) GROUP BY account_id, day""")
def d9(spark, sf):
    led = T.ledger(spark, sf)
    return out(L.daily_density(led, L.all_anomalies(led, **ANOMALY_ARGS)))


SAMPLE = """ev AS (SELECT DISTINCT account_id, unnest(evidence) AS id FROM anomalies),
marked AS (SELECT l.*, ev.id IS NOT NULL AS is_anomaly_evidence FROM ledger l LEFT JOIN ev USING (account_id, id)),
ks AS (SELECT account_id, CASE WHEN r > s THEN greatest(1, r // s) ELSE 1 END AS k FROM (
  SELECT account_id, count(*) FILTER (NOT is_anomaly_evidence) AS r, greatest(10, 500 - count(*) FILTER (is_anomaly_evidence)) AS s FROM marked GROUP BY ALL)),
sampled AS (SELECT * FROM (SELECT *, count(*) FILTER (NOT is_anomaly_evidence) OVER (PARTITION BY account_id ORDER BY dt, id ROWS UNBOUNDED PRECEDING) AS pos FROM marked)
  JOIN ks USING (account_id) WHERE is_anomaly_evidence OR (pos - 1) % k = 0)"""


@query("D10", ALL_ANOMALIES + f""", {SAMPLE} SELECT id, tier, account_id, dt, round(amount, 2) AS amount, direction, round(balance, 2) AS balance,
 payment_rail, raw_narration, counterparty, is_anomaly_evidence FROM sampled""")
def d10(spark, sf):
    led = T.ledger(spark, sf)
    return out(L.timeline_sample(led, L.all_anomalies(led, **ANOMALY_ARGS)))


@query("D11", ALL_ANOMALIES + f""", {SAMPLE}
SELECT account_id, any_value(total_transactions) AS total_transactions, any_value(date_start) AS date_start, any_value(final_balance) AS final_balance,
 any_value(mean_daily_velocity) AS mean_daily_velocity, any_value(anomaly_count) AS anomaly_count, any_value(n_days) AS n_days, count(*) AS n_stream,
 CAST(any_value(worst) AS VARCHAR) AS worst
FROM sampled JOIN (SELECT account_id, count(*) AS total_transactions, min(dt) AS date_start, round(arg_max(balance, {{'a': dt, 'b': id}}), 2) AS final_balance,
   count(DISTINCT CAST(dt AS DATE)) AS n_days FROM ledger GROUP BY ALL) USING (account_id)
 JOIN (SELECT account_id, round(mean_daily, 2) AS mean_daily_velocity FROM velocity) USING (account_id)
 LEFT JOIN (SELECT account_id, count(*) AS anomaly_count, arg_max(anomaly_type, {{'a': severity, 'b': anomaly_type}}) AS worst FROM anomalies GROUP BY ALL) USING (account_id)
GROUP BY account_id""")
def d11(spark, sf):
    led = T.ledger(spark, sf)
    doc = L.account_timeline(led, L.all_anomalies(led, **ANOMALY_ARGS))
    return out(doc.select("account_id", "total_transactions", "date_start", "final_balance", "mean_daily_velocity",
                          F.col("anomaly_count").cast("long").alias("anomaly_count"), F.size("density_curve").cast("long").alias("n_days"),
                          F.size("transactions").cast("long").alias("n_stream"),
                          F.col("anomalies")[0]["anomaly_type"].alias("worst")))


WALK = """walk_steps AS (SELECT account_id, row_number() OVER (PARTITION BY account_id ORDER BY dt DESC, id DESC) AS step_index,
  CASE WHEN direction = 'debit' THEN account_id ELSE coalesce(nullif(counterparty, ''), 'EXTERNAL_ENTITY') END AS from_account,
  CASE WHEN direction = 'debit' THEN coalesce(nullif(counterparty, ''), 'EXTERNAL_ENTITY') ELSE account_id END AS to_account,
  tier, round(amount, 2) AS amount, balance, dt, raw_narration AS narration FROM ledger QUALIFY step_index <= 20)"""


@query("D12", with_(LEDGER_SQL, WALK) + """SELECT *, 'TOOL-CALL-LEDGER-' || right(account_id, 4) || '-' || step_index AS tool_call_id FROM walk_steps""")
def d12(spark, sf):
    w = L.ledger_walk(T.ledger(spark, sf))
    return out(w.withColumn("step_index", F.col("step_index").cast("long")))


@query("D13", with_(LEDGER_SQL) + """, r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY dt, id) AS pos,
   count(*) OVER (PARTITION BY account_id) AS total_txns, count(*) FILTER (flagged) OVER (PARTITION BY account_id) AS flagged_count FROM ledger),
p AS (SELECT *, greatest(1, (total_txns + 49) // 50) AS total_pages, least(3, greatest(1, (total_txns + 49) // 50)) AS current_page FROM r)
SELECT account_id, pos, id, dt, amount, direction, balance, payment_rail, raw_narration AS narration, flagged,
 CASE WHEN flagged THEN risk_score END AS risk_score, total_txns, total_pages, current_page, flagged_count
FROM p WHERE pos > (current_page - 1) * 50 AND pos <= current_page * 50""")
def d13(spark, sf):
    s = T.scored_ledger(spark, sf)
    queue = s.filter("flagged").select("id", "flagged", "risk_score")
    got = L.scored_timeline(T.ledger(spark, sf), queue, page_no=3, page_size=50)
    return out(got.withColumns({c: F.col(c).cast("long") for c in ("total_pages", "current_page")}))


# every second account asked for has no ledger rows
ASKED_SQL = "asked AS (SELECT DISTINCT account_id FROM ledger UNION ALL SELECT DISTINCT 'NO' || substr(account_id, 3) FROM ledger)"


@query("D14", with_(LEDGER_SQL, WALK, ASKED_SQL) + """, a AS (SELECT account_id, count(step_index) AS step_count, arg_min(balance, step_index) AS start_balance,
  min(balance) AS min_balance, sum(amount) AS total FROM asked LEFT JOIN walk_steps USING (account_id) GROUP BY ALL)
SELECT account_id, step_count, start_balance, min_balance,
 CASE WHEN step_count = 0 THEN 0.50E0 ELSE
 least(0.95E0, round(0.20E0 + CASE WHEN min_balance < 0 THEN 0.40E0 ELSE 0 END + CASE WHEN step_count >= 3 THEN 0.20E0 ELSE 0 END + CASE WHEN total > 10000 THEN 0.14E0 ELSE 0 END, 2)) END AS risk_score,
 CASE WHEN step_count = 0 THEN 'no transactions' ELSE coalesce(nullif(concat_ws('; ',
   CASE WHEN min_balance < 0 THEN 'lowest balance below zero (-$' || format('{:,.2f}', -min_balance) || ')' END,
   CASE WHEN step_count >= 3 THEN step_count || ' transactions in the walk' END,
   CASE WHEN total > 10000 THEN '$' || format('{:,.2f}', total) || ' moved in all' END), ''), 'nothing unusual') END AS reasons FROM a""")
def d14(spark, sf):
    led = T.ledger(spark, sf)
    own = led.select("account_id").distinct()
    asked = own.unionByName(own.select(F.concat(F.lit("NO"), F.expr("substr(account_id, 3)")).alias("account_id")))
    return L.ledger_walk_risk(L.ledger_walk(led), asked)


@query("C1", with_(LEDGER_SQL) + f"SELECT id, account_id, dt, amount, direction FROM ledger WHERE account_id = '{ACCOUNT}'")
def c1(spark, sf):
    return out(S.account_transactions(T.ledger(spark, sf), f" '{ACCOUNT}'").select("id", "account_id", "dt", "amount", "direction"))


TX = "5979-6-1616-79"


@query("C2", with_(LEDGER_SQL) + f"SELECT id, account_id, dt, amount, direction, payment_rail FROM ledger WHERE id = '{TX}'")
def c2(spark, sf):
    return out(S.transaction_by_id(T.ledger(spark, sf), TX).select("id", "account_id", "dt", "amount", "direction", "payment_rail"))


@query("F1", with_(LEDGER_SQL, STEPS) + "SELECT account_id, id, round(step, 4) AS step FROM steps")
def f1(spark, sf):
    return L.with_steps(T.ledger(spark, sf)).select("account_id", "id", F.round("step", 4).alias("step"))


@query("F2", with_(LEDGER_SQL, STEPS) + "SELECT account_id, id, gap_hours FROM steps")
def f2(spark, sf):
    return L.with_steps(T.ledger(spark, sf)).select("account_id", "id", "gap_hours")


@query("F3", with_(LEDGER_SQL) + f"SELECT account_id, id, row_number() OVER {W} - 1 AS row_index FROM ledger")
def f3(spark, sf):
    rows = L.Ordered(T.ledger(spark, sf), ["account_id"], ["dt", "id"]).numbered("rn").plain()
    return rows.select("account_id", "id", (F.col("rn") - 1).alias("row_index"))


# -- sorts, unions and list operations used by the operators above -------------------------
@query("G2", ALL_ANOMALIES + "SELECT account_id, anomaly_type, count(*) AS n, round(max(severity), 2) AS top FROM anomalies GROUP BY ALL")
def g2(spark, sf):
    return anomalies(spark, sf).groupBy("account_id", "anomaly_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("severity"), 2).alias("top"))


@query("G7", with_(LEDGER_SQL, DAYS, SPIKES, STEPS, BREAKS) + f"SELECT {TEXT} FROM (SELECT * FROM spikes UNION ALL SELECT * FROM breaks)")
def g7(spark, sf):
    led = T.ledger(spark, sf)
    return texted(L.timing_spikes(led, min_count=SPIKE_COUNT).unionByName(L.balance_breaks(led, sigmas=BREAK_SIGMAS)))


@query("G8", with_(LEDGER_SQL, PAIRS, recursive=True) + "SELECT id_1, id_2, id_1 || ',' || id_2 AS ids FROM pairs")
def g8(spark, sf):
    p = R.reversal_pairs(T.ledger(spark, sf))
    return p.select("id_1", "id_2", F.array_distinct(F.array("id_1", "id_2", "id_1")).alias("ids")).withColumn("ids", joined("ids"))


@query("G10", with_(LEDGER_SQL, DAYS, SPIKES) + "SELECT account_id, window_start, array_to_string(evidence[1:2], ',') AS evidence FROM spikes")
def g10(spark, sf):
    s = L.timing_spikes(T.ledger(spark, sf), min_count=SPIKE_COUNT)
    return out(s.select("account_id", "window_start", F.slice("evidence", 1, 2).alias("evidence")).withColumn("evidence", joined("evidence")))


@query("G11", ALL_ANOMALIES + "SELECT DISTINCT account_id, unnest(evidence) AS id FROM anomalies")
def g11(spark, sf):
    return anomalies(spark, sf).select("account_id", F.explode("evidence").alias("id")).distinct()
