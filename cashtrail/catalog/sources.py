"""Scan, sink and view queries: A1-A14, B7. Files are written by Spark from the given tables, then scanned."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as DR
from ..operators import ledger as L
from ..operators import metrics as M
from ..operators import typology as N
from ..plans.storage import new_path, remove, written
from ..sources import cards as CS
from ..sources import ledger as S
from ..sources import network as NW
from ..sources import sinks as K
from ..sources import tables as T
from .base import CARDS_SQL, EDGES_SQL, LEDGER_SQL, MONEY_SQL, SCORED_SQL, SIM_SQL, out, query, with_
from .ledger import ACCOUNT, ALL_ANOMALIES, ANOMALY_ARGS
from .network import FAN_IN, LAYERING, TRIPS
from .scores import TAU, W


def csv(df, name):
    """A packed export; a packed file is read by one task, so files are short."""
    path = new_path(df.sparkSession, name)
    df.write.option("header", True).option("compression", "gzip").option("maxRecordsPerFile", 100_000).csv(path)
    return path


@query("A1", with_(CARDS_SQL) + """SELECT 'creditcard' AS dataset_id, 'TX-CC-' || printf('%06d', row_number() OVER (ORDER BY "Time") - 1) AS transaction_id, "Time" AS timestamp_seconds,
 make_timestamp(1377993600000000 + CAST(round("Time" * 1000000) AS BIGINT)) AS timestamp, "Amount" AS amount, "V1" AS v1, "V28" AS v28, "Class" AS is_fraud FROM cards""")
def a1(spark, sf):
    rows = CS.scan_card(spark, csv(T.raw_cards(spark, sf), "cards"))
    return out(rows.select("dataset_id", "transaction_id", "timestamp_seconds", "timestamp", "amount", F.col("V1").alias("v1"), F.col("V28").alias("v28"), "is_fraud"))


SIM_OUT = """SELECT 'kartik2112' AS dataset_id, trans_num AS transaction_id, moment AS timestamp, (epoch_us(moment) - (SELECT min(epoch_us(moment)) FROM sim)) / 1000000.0E0 AS timestamp_seconds,
 cc_num, merchant, category, amt AS amount, lat, long, merch_lat, merch_long, city_pop, job, dob, is_fraud FROM sim"""


def _sim_folder(spark, sf):
    folder = new_path(spark, "sim")
    cols = [c.strip().split()[0] for c in CS.SIM_SCHEMA.replace("\n", " ").split(",")]
    raw = T.raw_card_sim(spark, sf).select(cols)
    for name, part in (("fraudTrain.csv", raw.filter("unix_time % 4 <> 0")), ("fraudTest.csv", raw.filter("unix_time % 4 = 0"))):
        part.write.option("header", True).csv(f"{folder}/{name}")
    return folder


@query("A2", with_(SIM_SQL) + SIM_OUT)
def a2(spark, sf):
    return out(CS.scan_card_sim(spark, _sim_folder(spark, sf)))


@query("A3", with_(SIM_SQL) + SIM_OUT)
def a3(spark, sf):
    return out(CS.load_dataset(spark, " Sparkov ", _sim_folder(spark, sf)))


PARSED = ["id", "tier", "account_id", "dt", "value_dt", "amount", "direction", "balance", "raw_narration", "payment_rail", "counterparty", "chq_no"]
PARSED_SQL = with_(LEDGER_SQL) + """SELECT 'TX-LEDGER-' || printf('%06d', row_number() OVER (ORDER BY account_id, dt, id)) AS id, tier, account_id, dt, dt AS value_dt, amount, direction, balance,
 coalesce(raw_narration, '') AS raw_narration, CASE WHEN raw_narration IS NULL THEN 'GENERAL_TRANSFER' ELSE payment_rail END AS payment_rail, counterparty, id AS chq_no FROM ledger"""


@query("A4", PARSED_SQL.replace("SELECT 'TX-LEDGER-'", "SELECT scan, 'TX-LEDGER-'").replace("FROM ledger", "FROM ledger, (SELECT unnest(['miss', 'hit', 'forced']) AS scan)")
       .replace("OVER (ORDER BY", "OVER (PARTITION BY scan ORDER BY"))
def a4(spark, sf):
    """A scan that fills the cache, one that reads it (its source does not exist), and one that parses again."""
    path, cache, tie = csv(T.raw_ledger(spark, sf), "ledger"), new_path(spark, "ledger-cache"), F.regexp_replace("`CHQ.NO.`", r"\.0$", "")
    miss = written(S.scan_ledger(spark, path, cache, tie=tie).select(F.lit("miss").alias("scan"), *PARSED), "scan")
    hit = written(S.scan_ledger(spark, path + "-gone", cache).select(F.lit("hit").alias("scan"), *PARSED), "scan")
    forced = S.scan_ledger(spark, path, cache, force_reload=True, tie=tie).select(F.lit("forced").alias("scan"), *PARSED)
    remove(spark, path)                     # parsed and kept in the cache
    return out(miss.unionByName(hit).unionByName(forced))


@query("B7", with_(LEDGER_SQL) + "SELECT 'TX-LEDGER-' || printf('%06d', row_number() OVER (ORDER BY account_id, dt, id)) AS id, account_id, dt, amount FROM ledger")
def b7(spark, sf):
    rows = T.ledger(spark, sf).withColumnRenamed("id", "tie")
    return out(S.with_sequential_ids(rows).select("id", "account_id", "dt", "amount"))


def _edge_docs(spark, sf):
    """Network documents, one per block of accounts and day."""
    e = T.edges(spark, sf).withColumn("net", F.concat(F.expr("from_account div 100"), F.lit("/"), F.to_date("dt")))
    edge = F.struct(F.col("id").cast("string").alias("id"), F.lit("synthetic_network").alias("tier"), F.col("from_account").cast("string").alias("from_account"),
                    F.col("to_account").cast("string").alias("to_account"), "amount", F.date_format("dt", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
                    "payment_rail", F.lit("").alias("raw_narration"), "source_dataset")
    node = F.struct(F.col("from_account").cast("string").alias("account_id"))
    return e.groupBy("net").agg(F.collect_list(edge).alias("edges"), F.collect_set(node).alias("nodes"))


@query("A5", with_(EDGES_SQL) + "SELECT CAST(id AS VARCHAR) AS id, CAST(from_account AS VARCHAR) AS from_account, CAST(to_account AS VARCHAR) AS to_account, amount, dt, payment_rail FROM edges")
def a5(spark, sf):
    path = new_path(spark, "network")
    _edge_docs(spark, sf).drop("net").write.json(path)
    _nodes, edges = NW.scan_network(spark, path, multi_line=False)
    return out(edges.select("id", "from_account", "to_account", "amount", "dt", "payment_rail"))


@query("A6", with_(MONEY_SQL) + 'SELECT step, "type", amount, "nameOrig", "oldbalanceOrg", "newbalanceOrig", "nameDest", "oldbalanceDest", "newbalanceDest", CAST("isFraud" AS TINYINT) AS "isFraud" FROM money')
def a6(spark, sf):
    cols = [c.split()[0] for c in CS.MONEY_SCHEMA.replace("\n", " ").split(", ")]
    return CS.scan_mobile_money(spark, csv(T.mobile_money(spark, sf).select([c.strip() for c in cols]), "money")).drop("isFlaggedFraud")


@query("A7", with_(EDGES_SQL) + """SELECT CAST(from_account // 100 AS VARCHAR) || '/' || CAST(CAST(dt AS DATE) AS VARCHAR) AS test_id, count(*) AS n_edges, round(sum(amount), 4) AS total, 'flagged' AS expected_verdict
FROM edges GROUP BY ALL""")
def a7(spark, sf):
    path = new_path(spark, "cases")
    _edge_docs(spark, sf).withColumnRenamed("net", "test_id").withColumn("expected_verdict", F.lit("flagged")).write.json(path)
    cases, edges = NW.scan_labelled_cases(spark, path, multi_line=False)
    per = edges.groupBy(F.col("net").alias("test_id")).agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("amount"), 4).alias("total"))
    return cases.join(per, "test_id").select("test_id", "n_edges", "total", "expected_verdict")


@query("A8", with_(SCORED_SQL) + f"""SELECT window_index, 2 * n AS total_windows_logged, least(8, 2 * n) AS returned FROM (SELECT (count(*) - {W} + {W - 1}) // {W} AS n FROM scored),
 LATERAL (SELECT unnest(range(greatest(0, n - 8), n)) AS window_index)""")
def a8(spark, sf):
    path = new_path(spark, "drift-log")
    windows = DR.ks_drift(T.scored(spark, sf), ["dt", "id"], W)
    K.append_drift_log(windows, path, 1)
    K.append_drift_log(windows, path, 2)
    return K.drift_log_tail(spark, path, 8).select("window_index", "total_windows_logged", "returned")


@query("A9", with_(LEDGER_SQL) + f"SELECT account_id, count(*) AS total_transactions, round(max(balance), 2) AS max_balance FROM ledger WHERE account_id = '{ACCOUNT}' GROUP BY ALL")
def a9(spark, sf):
    led = T.ledger(spark, sf)
    path = new_path(spark, "timelines")
    K.write_timelines(L.account_timeline(led, L.all_anomalies(led, **ANOMALY_ARGS)), path)
    return K.read_timeline(spark, path, ACCOUNT).select("account_id", "total_transactions", "max_balance")


@query("A11", with_(SCORED_SQL) + f"""SELECT count(*) FILTER (label = 1 AND score >= {TAU}) AS tp, count(*) FILTER (label = 0 AND score >= {TAU}) AS fp,
 count(*) FILTER (label = 0 AND score < {TAU}) AS tn, count(*) FILTER (label = 1 AND score < {TAU}) AS fn FROM scored""")
def a11(spark, sf):
    path = new_path(spark, "metrics")
    K.write_metrics(M.confusion_at(T.scored(spark, sf), TAU), path)
    return spark.read.schema("tp long, fp long, tn long, fn long").json(path)


UNIFIED = """unified AS (SELECT id, tier, dt, account_id, amount, direction, raw_narration FROM ledger
 UNION ALL SELECT 'TX-CC-' || printf('%06d', row_number() OVER (ORDER BY "Time") - 1), 'real_card', make_timestamp(1377993600000000 + CAST(round("Time" * 1000000) AS BIGINT)), NULL, "Amount", NULL, NULL FROM cards
 UNION ALL SELECT CAST(id AS VARCHAR), 'synthetic_network', dt, CAST(from_account AS VARCHAR), amount, 'debit', NULL FROM edges)"""


@query("A12", with_(LEDGER_SQL, CARDS_SQL, EDGES_SQL, UNIFIED) + "SELECT * FROM unified")
def a12(spark, sf):
    u = K.unified_transactions(CS.normalise_cards(T.raw_cards(spark, sf)), T.ledger(spark, sf), T.edges(spark, sf))
    return out(u.select("id", "tier", "dt", "account_id", "amount", "direction", "raw_narration"))


@query("A12_route", with_(LEDGER_SQL, CARDS_SQL, EDGES_SQL, UNIFIED) + "SELECT id, tier, amount FROM unified WHERE id = 'TX-CC-000041' AND tier = 'real_card'")
def a12_route(spark, sf):
    u = K.unified_transactions(CS.normalise_cards(T.raw_cards(spark, sf)), T.ledger(spark, sf), T.edges(spark, sf))
    return K.route_by_id(u, "TX-CC-000041").select("id", "tier", "amount")


@query("A13", with_(EDGES_SQL) + """SELECT (SELECT count(*) FROM (SELECT from_account FROM edges UNION SELECT to_account FROM edges)) AS total_nodes, count(*) AS total_edges, 3 AS typology_count FROM edges""")
def a13(spark, sf):
    """The network is exported whole (nodes, edges, flags with their accounts and evidence); the metadata is read from the export."""
    e, folder = T.edges(spark, sf), new_path(spark, "network-export")
    nodes = e.select(F.explode(F.array("from_account", "to_account")).alias("account_id")).distinct()
    NW.export_network(nodes, e, N.flag_documents(*N.typology_flags(e, FAN_IN, TRIPS, LAYERING)), folder)
    return NW.exported_metadata(spark, folder)


@query("A14", with_(MONEY_SQL) + """SELECT CASE WHEN step <= floor((SELECT quantile_cont(step, 0.8) FROM money)) THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows,
 CAST(sum("isFraud") AS BIGINT) AS positives, round(avg("isFraud"), 6) AS prevalence FROM money GROUP BY ALL""")
def a14(spark, sf):
    return CS.dataset_profile(M.step_split(T.mobile_money(spark, sf)), "isFraud", "split")
