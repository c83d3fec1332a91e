"""Canonical ledger, network, card and mobile-money tables derived from the TPC-H-like test tables.

The mappings are SQL text that Spark and DuckDB both read, so a query and its check start from the
same rows. Accounts group ten suppliers each: their number grows with the data, their size does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

NARRATION = """CASE l_partkey % 12
 WHEN 0 THEN 'RTGS/INDO' || CAST(l_partkey % 7 AS STRING) || '/CORP PMT'
 WHEN 1 THEN 'NEFT-SBIN' || CAST(l_partkey % 5 AS STRING) || '-TRANSFER'
 WHEN 2 THEN 'UPI/CR/' || CAST(l_partkey % 9 AS STRING) || '/GROCERY'
 WHEN 3 THEN 'imps-p2a-' || CAST(l_partkey % 8 AS STRING)
 WHEN 4 THEN 'FDRL/INTERNAL FUND TRANSFE'
 WHEN 5 THEN 'INDO GIBL STL' || CAST(l_partkey % 6 AS STRING)
 WHEN 6 THEN 'CHQ DEPOSIT CLEARING ' || CAST(l_partkey % 11 AS STRING)
 WHEN 7 THEN 'TRF TO   VENDOR  ' || CAST(l_partkey % 13 AS STRING)
 WHEN 8 THEN 'CASH WITHDRAWAL ATM' || CAST(l_partkey % 4 AS STRING)
 WHEN 9 THEN 'SHOP ECOM ' || CAST(l_partkey % 10 AS STRING)
 WHEN 10 THEN 'MONTHLY RENT'
 ELSE NULL END"""

# name -> expression over lineitem, for both engines
LEDGER_COLUMNS = {
    "id": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || "
          "CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)",
    "account_id": "'AC' || lpad(CAST(CAST(floor(l_suppkey / 10) AS BIGINT) AS STRING), 6, '0')",
    "amount": "l_quantity * 1000.0E0",
    "direction": "CASE WHEN l_returnflag = 'R' THEN 'credit' ELSE 'debit' END",
    "balance": "l_extendedprice - 5000.0E0",
    "raw_narration": NARRATION,
    "chq_no": "CASE WHEN l_linenumber = 3 THEN CAST(l_partkey AS STRING) END",
    # stand-ins for two model probabilities
    "p_lgb": "l_discount * 10.0E0",
    "p_rf": "l_quantity / 50.0E0",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        *[F.expr(e).alias(n) for n, e in LEDGER_COLUMNS.items()],
        F.col("l_shipdate").cast("timestamp").alias("dt"))
    return rows.withColumns({
        "tier": F.lit("real_ledger"), "value_dt": F.col("dt"),
        "payment_rail": text.payment_rail(F.col("raw_narration")),
        "counterparty": text.counterparty(F.col("raw_narration")),
        "source_dataset": F.lit("lineitem")})


def scored_ledger(spark: SparkSession, sf_dir: str, tau_lgb: float = 0.95, tau_rf: float = 0.99) -> DataFrame:
    """Ledger with the stand-in scores combined the way the two models are."""
    return ledger(spark, sf_dir).withColumns({
        "risk_score": F.round(0.6 * F.col("p_lgb") + 0.4 * F.col("p_rf"), 4),
        "flagged": (F.col("p_lgb") >= tau_lgb) | (F.col("p_rf") >= tau_rf)})


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfer network over events: sender = user, receiver within the sender's block of 100."""
    e = table(spark, sf_dir, "events")
    to = F.expr("floor(user_id / 100) * 100 + CAST(get_json_object(props, '$.k') AS BIGINT)").cast("long")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("long").alias("from_account"), to.alias("to_account"),
        F.col("value").alias("amount"), F.col("ts").cast("timestamp").alias("dt"),
        F.col("event_type").alias("payment_rail"), F.lit("events").alias("source_dataset"),
    ).filter("from_account <> to_account")


# -- cards, mobile money and plain scored rows; the text in braces is shared with DuckDB --------
# over events with its epoch microseconds as ``us``
CARD_COLUMNS = {
    "Time": "(us - 1704067200000000) / 1000000.0E0",
    **{f"V{i}": f"((event_id * {7 + i} + {i}) % {101 + i}) / {101 + i}.0E0 - 0.5E0"
       + (" + CASE WHEN event_type = 'error' THEN 0.4E0 ELSE 0.0E0 END" if i in (10, 14) else "") for i in range(1, 29)},
    "Amount": "value",
    "Class": "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END",
}
SCORED_COLUMNS = {"id": "event_id", "score": "round(value / 500.0E0, 4)",
                  "label": "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END", "user_id": "user_id"}
# over lineitem
MONEY_COLUMNS = {
    "step": "CAST(l_orderkey % 743 AS INT) + 1",
    "type": "CASE l_linenumber % 5 WHEN 0 THEN 'PAYMENT' WHEN 1 THEN 'TRANSFER' WHEN 2 THEN 'CASH_OUT' WHEN 3 THEN 'CASH_IN' ELSE 'DEBIT' END",
    "amount": "l_extendedprice",
    "nameOrig": "'C' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)",
    "oldbalanceOrg": "l_quantity * 2000.0E0",
    "newbalanceOrig": "greatest(0.0E0, l_quantity * 2000.0E0 - l_extendedprice)",
    "nameDest": "'M' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)",
    "oldbalanceDest": "l_partkey * 10.0E0",
    "newbalanceDest": "l_partkey * 10.0E0 + CASE WHEN l_discount > 0.085E0 THEN 0.0E0 ELSE l_extendedprice END",
    "isFraud": "CASE WHEN l_discount > 0.085E0 AND l_linenumber % 5 IN (1, 2) AND l_returnflag = 'R' THEN 1 ELSE 0 END",
}
# over orders with the transaction moment ``at``
SIM_COLUMNS = {
    "cc_num": "CAST(o_custkey AS STRING)", "merchant": "'M' || CAST(o_orderkey % 97 AS STRING)", "category": "o_orderpriority",
    "amt": "o_totalprice", "lat": "(o_custkey % 90) * 0.9E0", "long": "(o_custkey % 180) * 1.0E0 - 90.0E0",
    "merch_lat": "(o_custkey % 90) * 0.9E0 + (o_orderkey % 100) / 50.0E0 - 1.0E0",
    "merch_long": "(o_custkey % 180) * 1.0E0 - 90.0E0 + (o_orderkey % 60) / 30.0E0",
    "city_pop": "CAST(o_custkey * 10 AS INT)", "job": "'J' || CAST(o_custkey % 7 AS STRING)",
    "trans_num": "CAST(o_orderkey AS STRING)", "is_fraud": "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END",
}


def _exprs(columns: dict[str, str]):
    return [F.expr(e).alias(n) for n, e in columns.items()]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("dt", F.col("ts").cast("timestamp"))
    return e.withColumn("us", F.unix_micros("dt"))


def raw_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(*_exprs(CARD_COLUMNS))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(*_exprs(SCORED_COLUMNS), "dt")


def mobile_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*_exprs(MONEY_COLUMNS))
    return rows.withColumn("isFlaggedFraud", F.lit(0))


def raw_card_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 7919 % 86_400)
    rows = table(spark, sf_dir, "orders").withColumn("at", at)
    empty = {c: F.lit(None).cast("string") for c in ("first", "last", "gender", "street", "city", "state", "zip")}
    return rows.select(
        F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("trans_date_trans_time"), *_exprs(SIM_COLUMNS),
        F.date_format(F.date_add(F.lit("1960-01-01").cast("date"), (F.col("o_custkey") % 10_000).cast("int")), "yyyy-MM-dd").alias("dob"),
        F.unix_seconds("at").alias("unix_time")).withColumns(empty)


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as an all-text bank export with quotes, blanks and unreadable dates."""
    c = LEDGER_COLUMNS
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    debit = F.col("l_returnflag") != "R"
    amount = F.expr(c["amount"]).cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit(" "), F.expr(c["account_id"]), F.lit("' ")).alias("Account No"), day.alias("DATE"),
        F.expr(c["raw_narration"]).alias("TRANSACTION DETAILS"), F.concat(F.expr(c["id"]), F.lit(".0")).alias("CHQ.NO."),
        F.when(F.col("l_linenumber") == 2, "n/a").otherwise(day).alias("VALUE DATE"),
        F.when(debit, amount).alias("WITHDRAWAL AMT"), F.when(~debit, amount).alias("DEPOSIT AMT"),
        F.expr(c["balance"]).cast("string").alias("BALANCE AMT"))
