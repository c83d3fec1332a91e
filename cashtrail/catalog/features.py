"""Column-function and feature queries: B1-B21, F4-F6, G12."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, values as V
from ..operators import features as X
from ..sources import cards as CS
from ..sources import tables as T
from ..streaming.months import with_month
from .base import CARDS_SQL, COUNTERPARTY_SQL, LEDGER_SQL, MONEY_SQL, RAIL_SQL, SIM_SQL, out, query, with_


def shown(columns):
    """Logarithms to 6 places; plain ratios as they are."""
    return [F.col(c) if c == "balance_drain_ratio" else F.round(c, 6).alias(c) for c in columns]


@query("B1", with_(LEDGER_SQL) + f"SELECT id, {RAIL_SQL('raw_narration')} AS payment_rail FROM ledger")
def b1(spark, sf):
    return T.ledger(spark, sf).select("id", text.payment_rail(F.col("raw_narration")).alias("payment_rail"))


@query("B2", with_(LEDGER_SQL) + f"SELECT id, {COUNTERPARTY_SQL('raw_narration')} AS counterparty FROM ledger")
def b2(spark, sf):
    return T.ledger(spark, sf).select("id", text.counterparty(F.col("raw_narration")).alias("counterparty"))


@query("B3", with_(LEDGER_SQL) + "SELECT account_id, count(*) AS n FROM ledger GROUP BY ALL")
def b3(spark, sf):
    raw = T.raw_ledger(spark, sf)
    return raw.groupBy(text.clean_account(F.col("`Account No`")).alias("account_id")).agg(F.count(F.lit(1)).alias("n"))


@query("B4", with_(LEDGER_SQL) + "SELECT id, amount, direction, balance FROM ledger")
def b4(spark, sf):
    raw = T.raw_ledger(spark, sf)
    paid_out, paid_in = text.number_or_zero(F.col("`WITHDRAWAL AMT`")), text.number_or_zero(F.col("`DEPOSIT AMT`"))
    return raw.select(text.cheque_number(F.col("`CHQ.NO.`")).alias("id"), F.when(paid_out > 0, paid_out).otherwise(paid_in).alias("amount"),
                      F.when(paid_out > 0, "debit").otherwise("credit").alias("direction"),
                      text.number_or_zero(F.col("`BALANCE AMT`")).alias("balance"))


@query("B5", with_(LEDGER_SQL) + "SELECT id, chq_no FROM ledger")
def b5(spark, sf):
    led = T.ledger(spark, sf)
    dirty = F.when(F.col("chq_no").isNotNull(), F.concat(F.lit(" "), "chq_no", F.lit(".0"))).otherwise("nan")
    return led.select("id", text.cheque_number(dirty).alias("chq_no"))


@query("B6", with_(LEDGER_SQL) + "SELECT id, dt AS value_dt FROM ledger")
def b6(spark, sf):
    dt = F.try_to_timestamp(F.col("DATE"))
    return out(T.raw_ledger(spark, sf).select(text.cheque_number(F.col("`CHQ.NO.`")).alias("id"),
                                              F.coalesce(F.try_to_timestamp(F.col("VALUE DATE")), dt).alias("value_dt")))


@query("B8", with_(SIM_SQL) + """SELECT trans_num, round(2 * 6371.0E0 * asin(sqrt(greatest(0.0E0, least(1.0E0,
 pow(sin((radians(merch_lat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(merch_lat)) * pow(sin((radians(merch_long) - radians(long)) / 2), 2))))), 3) AS km FROM sim""")
def b8(spark, sf):
    raw = T.raw_card_sim(spark, sf)
    return raw.select("trans_num", F.round(V.haversine_km(F.col("lat"), F.col("long"), F.col("merch_lat"), F.col("merch_long")), 3).alias("km"))


@query("B9", with_(SIM_SQL) + """SELECT trans_num, hour(moment) AS hour_of_day, CASE WHEN hour(moment) >= 22 OR hour(moment) < 6 THEN 1 ELSE 0 END AS is_night,
 round((epoch_us(moment) - epoch_us(dob)) / 1000000.0E0 / 31557600.0E0, 1) AS age_at_transaction FROM sim""")
def b9(spark, sf):
    rows = T.raw_card_sim(spark, sf).select("trans_num", F.to_timestamp("trans_date_trans_time").alias("timestamp"), F.to_timestamp("dob").alias("dob"))
    return X.temporal_features(rows).select("trans_num", F.col("hour_of_day").cast("long").alias("hour_of_day"), "is_night", "age_at_transaction")


@query("B10", with_(CARDS_SQL) + """SELECT "Time" AS t, strftime(make_timestamp(CAST(floor("Time") AS BIGINT) % 86400 * 1000000), '%I:%M %p') AS label FROM cards""")
def b10(spark, sf):
    return T.raw_cards(spark, sf).select(F.col("Time").alias("t"), V.time_of_day_label(F.col("Time")).alias("label"))


@query("B11", with_(CARDS_SQL) + """SELECT "Time" AS t, strftime(make_timestamp((1789689600 + CAST(floor("Time") AS BIGINT)) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM cards""")
def b11(spark, sf):
    return T.raw_cards(spark, sf).select(F.col("Time").alias("t"), V.iso_from_offset(F.col("Time")).alias("iso"))


@query("B12", with_(LEDGER_SQL) + "SELECT id, CAST(regexp_extract(id, '\\d+') AS BIGINT) AS row_index FROM ledger")
def b12(spark, sf):
    return T.ledger(spark, sf).select("id", text.first_number(F.col("id")).alias("row_index"))


TYPE_SQL = """CASE WHEN payment_rail IN ('NEFT', 'RTGS', 'IMPS', 'INDO_GIBL', 'INTERNAL_TRANSFER', 'BOOK_TRANSFER') THEN 'TRANSFER'
 WHEN payment_rail = 'CASH_ATM' THEN CASE WHEN direction = 'debit' THEN 'CASH_OUT' ELSE 'CASH_IN' END ELSE 'PAYMENT' END"""
FLAGS_SQL = ", ".join(f"CAST(kind = '{t}' AS DOUBLE) AS type_{t}" for t in V.MONEY_TYPES)


@query("B13", with_(LEDGER_SQL) + f"SELECT id, {TYPE_SQL} AS kind FROM ledger")
def b13(spark, sf):
    return T.ledger(spark, sf).select("id", V.money_type(F.col("payment_rail"), F.col("direction")).alias("kind"))


@query("B14", with_(MONEY_SQL) + f'SELECT "nameOrig", "nameDest", {FLAGS_SQL} FROM (SELECT *, "type" AS kind FROM money)')
def b14(spark, sf):
    return T.mobile_money(spark, sf).select("nameOrig", "nameDest", *[c.alias(n) for n, c in V.money_type_flags(F.col("type")).items()])


@query("B15", with_(MONEY_SQL) + f"""SELECT "nameOrig", "nameDest", greatest(0.0E0, least(1.0E0, amount / greatest("oldbalanceOrg", 0.01E0))) AS balance_drain_ratio,
 round(ln(1 + step), 6) AS tx_velocity, round(ln(1 + abs("oldbalanceDest" + amount - "newbalanceDest")), 6) AS orig_dest_mismatch, round(ln(1 + amount), 6) AS amount_log,
 round(ln(1 + "oldbalanceOrg"), 6) AS orig_open_log, CAST("newbalanceOrig" = 0 AS DOUBLE) AS orig_close_zero, {FLAGS_SQL}
FROM (SELECT *, "type" AS kind FROM money)""")
def b15(spark, sf):
    rows = X.mobile_money_features(T.mobile_money(spark, sf))
    return rows.select("nameOrig", "nameDest", *shown(V.MONEY_FEATURES))


FEATURE_SQL = f"""feat AS (SELECT *, greatest(0.0E0, least(1.0E0, amount / opened)) AS balance_drain_ratio, ln(rn) AS tx_velocity,
  ln(1 + abs(abs(coalesce(balance - prev, 0.0E0)) - amount)) AS orig_dest_mismatch, ln(1 + amount) AS amount_log, ln(1 + opened) AS orig_open_log,
  CAST(abs(balance) < 1.0 AS DOUBLE) AS orig_close_zero, {FLAGS_SQL}
 FROM (SELECT *, {TYPE_SQL} AS kind, greatest(CASE WHEN direction = 'debit' THEN balance + amount ELSE balance - amount END, 0.01E0) AS opened,
  lag(balance) OVER w AS prev, row_number() OVER w AS rn FROM ledger WINDOW w AS (PARTITION BY account_id ORDER BY dt, id)))"""


@query("B16", with_(LEDGER_SQL, FEATURE_SQL) + "SELECT id, " + ", ".join(c if c == "balance_drain_ratio" else f"round({c}, 6) AS {c}" for c in V.MONEY_FEATURES) + " FROM feat")
def b16(spark, sf):
    return X.ledger_model_features(T.ledger(spark, sf)).select("id", *shown(V.MONEY_FEATURES))


@query("B17", with_(CARDS_SQL) + """SELECT "Time" AS t, f AS feature, CASE f WHEN 'Amount' THEN 'Transaction amount ($' || format('{:,.2f}', "Amount") || ')'
 WHEN 'Time' THEN 'Transaction time (' || strftime(make_timestamp(CAST(floor("Time") AS BIGINT) % 86400 * 1000000), '%I:%M %p') || ')'
 ELSE 'Anonymized behavioral signal ' || f END AS human_label FROM cards, (SELECT unnest(['Time', 'V14', 'Amount']) AS f)""")
def b17(spark, sf):
    rows = T.raw_cards(spark, sf).select(F.col("Time").alias("t"), F.explode(F.create_map(
        F.lit("Time"), F.col("Time"), F.lit("V14"), F.col("V14"), F.lit("Amount"), F.col("Amount"))).alias("feature", "v"))
    return rows.select("t", "feature", V.factor_label(F.col("feature"), F.col("v")).alias("human_label"))


@query("B18", with_(LEDGER_SQL) + "SELECT id, CASE WHEN round(risk_score, 4) >= 0.7 THEN 'flagged' ELSE 'clear' END AS verdict FROM ledger")
def b18(spark, sf):
    return T.scored_ledger(spark, sf).select("id", V.verdict(F.col("risk_score"), 0.7).alias("verdict"))


@query("B19", with_(LEDGER_SQL) + "SELECT id, CASE WHEN risk_score >= 0.7 THEN 'high' WHEN risk_score >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM ledger")
def b19(spark, sf):
    return T.scored_ledger(spark, sf).select("id", V.risk_band(F.col("risk_score")).alias("band"))


@query("B21", with_(LEDGER_SQL) + """SELECT id, printf('risk score: %.2f, 90%% CI: [%.2f, %.2f]', round(p_rf, 2), greatest(0.0E0, round(p_rf, 2) - 0.25E0), least(1.0E0, round(p_rf, 2) + 0.25E0)) AS label FROM ledger""")
def b21(spark, sf):
    s = F.round("p_rf", 2)
    return T.ledger(spark, sf).select("id", V.interval_label(s, V.clamp(s - 0.25, 0.0, 1.0), V.clamp(s + 0.25, 0.0, 1.0), 0.9).alias("label"))


VELOCITY_SQL = """SELECT account_id, id, count(*) OVER r - count(*) OVER h - 1 AS velocity_1h, count(*) OVER r - count(*) OVER d - 1 AS velocity_24h,
 CASE WHEN count(*) OVER r = 1 THEN 1.0E0 ELSE round(amount / (CAST(sum(CAST(amount AS DECIMAL(28,6))) OVER r - CAST(amount AS DECIMAL(28,6)) AS DOUBLE) / (count(*) OVER r - 1) + 0.000001E0), 4) END AS amount_to_user_mean_ratio
FROM (SELECT *, CAST(floor(epoch(dt)) AS BIGINT) AS s FROM ledger)
WINDOW r AS (PARTITION BY account_id ORDER BY dt, id ROWS UNBOUNDED PRECEDING), h AS (PARTITION BY account_id ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND 3601 PRECEDING),
 d AS (PARTITION BY account_id ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND 86401 PRECEDING)"""


def _causal(spark, sf):
    return X.causal_features(T.ledger(spark, sf), user="account_id", ts="dt", tie="id")


@query("F4", with_(LEDGER_SQL) + f"SELECT account_id, id, velocity_1h, velocity_24h FROM ({VELOCITY_SQL})")
def f4(spark, sf):
    return _causal(spark, sf).select("account_id", "id", "velocity_1h", "velocity_24h")


@query("F5", with_(LEDGER_SQL) + f"SELECT account_id, id, amount_to_user_mean_ratio FROM ({VELOCITY_SQL})")
def f5(spark, sf):
    return _causal(spark, sf).select("account_id", "id", "amount_to_user_mean_ratio")


@query("F6", with_(SIM_SQL, """ledger AS (SELECT cc_num AS account_id, trans_num AS id, moment AS dt, amt AS amount FROM sim)""", f"c AS ({VELOCITY_SQL})") + """
SELECT trans_num, round(2 * 6371.0E0 * asin(sqrt(greatest(0.0E0, least(1.0E0,
 pow(sin((radians(merch_lat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(merch_lat)) * pow(sin((radians(merch_long) - radians(long)) / 2), 2))))), 3) AS haversine_distance,
 hour(moment) AS hour_of_day, CASE WHEN hour(moment) >= 22 OR hour(moment) < 6 THEN 1 ELSE 0 END AS is_night,
 round((epoch_us(moment) - epoch_us(dob)) / 1000000.0E0 / 31557600.0E0, 1) AS age_at_transaction, velocity_1h, velocity_24h, amount_to_user_mean_ratio
FROM sim JOIN c ON c.id = trans_num""")
def f6(spark, sf):
    rows = X.card_features(CS.normalise_card_sim(T.raw_card_sim(spark, sf)))
    return rows.select(F.col("transaction_id").alias("trans_num"), "haversine_distance", F.col("hour_of_day").cast("long").alias("hour_of_day"),
                       "is_night", "age_at_transaction", "velocity_1h", "velocity_24h", "amount_to_user_mean_ratio")


@query("G12", with_(LEDGER_SQL) + "SELECT strftime(dt, '%Y-%m') AS month_key, count(*) AS n, min(dt) AS first_dt, max(dt) AS last_dt FROM ledger GROUP BY ALL")
def g12(spark, sf):
    return out(with_month(T.ledger(spark, sf), "dt").groupBy("month_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt")))
