"""Network and structuring queries: E1-E10, C7, F7, F8, A13."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structuring as ST
from ..operators import typology as N
from ..operators.ledger import page
from ..sources import tables as T
from .base import EDGES_SQL, LEDGER_SQL, joined, out, query, with_

FAN_IN = dict(threshold=150.0, lower=50.0)
TRIPS = dict(hours=24)
LAYERING = dict(max_hop_hours=6.0, min_ratio=0.5, min_amount=20.0)
DAY_US = 86_400_000_000

BAND = "band AS (SELECT * FROM edges WHERE amount >= 50.0 AND amount < 150.0)"
FAN_SQL = f"""fan AS (SELECT * FROM (SELECT s.to_account AS collector, s.id AS start_id, s.us AS start_us, s.dt AS window_start, count(*) AS n_edges,
    CAST(sum(CAST(j.amount AS DECIMAL(28,6))) AS DOUBLE) AS total_amount, count(DISTINCT j.from_account) AS senders
  FROM band s JOIN band j ON j.to_account = s.to_account AND (j.us, j.id) >= (s.us, s.id) AND j.us <= s.us + {DAY_US} GROUP BY ALL)
  WHERE senders >= 3 AND n_edges >= 3 AND total_amount >= 270
  QUALIFY row_number() OVER (PARTITION BY collector ORDER BY start_us, start_id) = 1)"""
FAN_MEMBERS = f"""fan_members AS (SELECT f.collector, j.from_account, j.id, j.us, j.dt, j.amount FROM fan f JOIN band j ON j.to_account = f.collector
  AND (j.us, j.id) >= (f.start_us, f.start_id) AND j.us <= f.start_us + {DAY_US})"""


def _trip_sql(hours, retention=0.85):
    span = int(hours * 3_600_000_000)
    ctes = ["t2 AS (SELECT [from_account, to_account] AS nodes, [id] AS ids, us AS first_us, amount AS first_amount, us AS last_us, "
            "to_account AS at, dt AS first_dt FROM edges)"]
    closes = []
    for n in range(2, 6):
        if n >= 3:
            closes.append(f"SELECT nodes, list_append(ids, e.id) AS ids, first_us, first_dt, e.dt AS last_dt, e.amount / greatest(1.0E0, first_amount) AS retention "
                          f"FROM t{n} p JOIN edges e ON e.from_account = p.at AND e.us BETWEEN p.last_us AND p.first_us + {span} "
                          f"AND e.to_account = p.nodes[1] WHERE e.amount / greatest(1.0E0, first_amount) >= {retention}")
        if n < 5:
            ctes.append(f"t{n + 1} AS (SELECT list_append(nodes, e.to_account) AS nodes, list_append(ids, e.id) AS ids, first_us, first_amount, e.us AS last_us, "
                        f"e.to_account AS at, first_dt FROM t{n} p JOIN edges e ON e.from_account = p.at AND e.us BETWEEN p.last_us AND p.first_us + {span} "
                        f"WHERE NOT list_contains(nodes, e.to_account))")
    ctes.append("cycles AS (" + " UNION ALL ".join(closes) + ")")
    ctes.append("trips AS (SELECT * FROM cycles QUALIFY row_number() OVER (PARTITION BY list_sort(nodes) ORDER BY first_us, ids, nodes) = 1)")
    return ", ".join(ctes)


def _layer_sql(hours, lo, hi, least_amount):
    span = int(hours * 3_600_000_000)
    ctes = [f"l1 AS (SELECT [from_account, to_account] AS nodes, [id] AS ids, us AS first_us, us AS last_us, amount AS last_amount, to_account AS at, "
            f"dt AS first_dt, dt AS last_dt FROM edges WHERE amount >= {least_amount})"]
    for n in range(2, 7):
        ctes.append(f"l{n} AS (SELECT list_append(nodes, e.to_account) AS nodes, list_append(ids, e.id) AS ids, first_us, e.us AS last_us, e.amount AS last_amount, "
                    f"e.to_account AS at, first_dt, e.dt AS last_dt FROM l{n - 1} p JOIN edges e ON e.from_account = p.at AND e.us BETWEEN p.last_us AND p.last_us + {span} "
                    f"WHERE NOT list_contains(nodes, e.to_account) AND e.amount / greatest(1.0E0, p.last_amount) BETWEEN {lo} AND {hi})")
    ctes.append("layers AS (SELECT * FROM (SELECT * FROM l3 UNION ALL SELECT * FROM l4 UNION ALL SELECT * FROM l5 UNION ALL SELECT * FROM l6) "
                "QUALIFY row_number() OVER (PARTITION BY nodes ORDER BY first_us, ids) = 1)")
    return ", ".join(ctes)


TRIP_SQL, LAYER_SQL = _trip_sql(24), _layer_sql(6.0, 0.5, 1.05, 20.0)


@query("C7", with_(EDGES_SQL, BAND) + "SELECT id, to_account, amount FROM band")
def c7(spark, sf):
    return N.sub_threshold_edges(T.edges(spark, sf), **FAN_IN).select("id", "to_account", "amount")


@query("E1", with_(EDGES_SQL, BAND, FAN_SQL) + "SELECT collector, start_id, window_start, n_edges, round(total_amount, 4) AS total_amount FROM fan")
def e1(spark, sf):
    f = N.fan_in_structuring(T.edges(spark, sf), **FAN_IN)
    return out(f.select("collector", "start_id", "window_start", "n_edges", F.round("total_amount", 4).alias("total_amount")))


@query("E1_members", with_(EDGES_SQL, BAND, FAN_SQL, FAN_MEMBERS) + "SELECT collector, from_account, id, dt, amount FROM fan_members")
def e1_members(spark, sf):
    e = T.edges(spark, sf)
    return out(N.fan_in_members(e, N.fan_in_structuring(e, **FAN_IN), **FAN_IN).select("collector", "from_account", "id", "dt", "amount"))


@query("F8", with_(EDGES_SQL) + f"""SELECT to_account, id, count(*) OVER f - count(*) OVER r + 1 AS n_ahead,
 CAST(sum(CAST(amount AS DECIMAL(28,6))) OVER f - sum(CAST(amount AS DECIMAL(28,6))) OVER r + CAST(amount AS DECIMAL(28,6)) AS DOUBLE) AS volume_ahead
FROM edges WINDOW f AS (PARTITION BY to_account ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {DAY_US} FOLLOWING),
 r AS (PARTITION BY to_account ORDER BY us, id ROWS UNBOUNDED PRECEDING)""")
def f8(spark, sf):
    e = T.edges(spark, sf).withColumn("us", F.unix_micros("dt"))
    rows = N.Ordered(e, ["to_account"], ["us", "id"]).leading(
        "us", DAY_US, volume=F.col("amount").cast("decimal(28,6)"), n_ahead=F.lit(1).cast("long")).plain()
    return rows.select("to_account", "id", "n_ahead", F.col("volume").cast("double").alias("volume_ahead"))


@query("E2", with_(EDGES_SQL, _trip_sql(72)) + """SELECT array_to_string(nodes, ',') AS nodes, array_to_string(ids, ',') AS edge_ids,
 first_dt AS window_start, last_dt AS window_end, round(retention, 6) AS retention FROM trips""")
def e2(spark, sf):
    t = N.round_trips(T.edges(spark, sf))       # all of the operator's 72 hours
    return out(t.select(joined("nodes"), joined("edge_ids"), "window_start", "window_end", F.round("retention", 6).alias("retention")))


@query("E3", with_(EDGES_SQL, LAYER_SQL) + """SELECT array_to_string(nodes, ',') AS nodes, array_to_string(ids, ',') AS edge_ids,
 first_dt AS window_start, last_dt AS window_end FROM layers""")
def e3(spark, sf):
    return out(N.rapid_layering(T.edges(spark, sf), **LAYERING).select(joined("nodes"), joined("edge_ids"), "window_start", "window_end"))


FLAGS_SQL = f"""flags AS (SELECT 'structuring' AS typology, 'structuring:' || collector AS flag_key, 'FLAG-STRUCTURING-' || right(CAST(collector AS VARCHAR), 4) AS flag_id, 0.95E0 AS confidence, window_start FROM fan
 UNION ALL SELECT 'round_tripping', 'round_tripping:' || array_to_string(nodes, '>'), 'FLAG-ROUNDTRIP-' || right(CAST(nodes[1] AS VARCHAR), 4), 0.94E0, first_dt FROM trips
 UNION ALL SELECT 'rapid_layering', 'rapid_layering:' || array_to_string(nodes, '>'), 'FLAG-LAYERING-' || right(CAST(nodes[1] AS VARCHAR), 4) || '-' || right(CAST(nodes[-1] AS VARCHAR), 4), 0.92E0, first_dt FROM layers)"""
ALL_FLAGS = with_(EDGES_SQL, BAND, FAN_SQL, TRIP_SQL, LAYER_SQL, FLAGS_SQL)


def flags(spark, sf):
    return N.typology_flags(T.edges(spark, sf), FAN_IN, TRIPS, LAYERING)


COLS = ["typology", "flag_key", "flag_id", "confidence", "window_start"]


@query("E4", ALL_FLAGS + "SELECT * FROM flags")
def e4(spark, sf):
    return out(flags(spark, sf)[0].select(COLS))


@query("E4_documents", with_(EDGES_SQL, BAND, FAN_SQL, FAN_MEMBERS, TRIP_SQL, LAYER_SQL) + """SELECT 'structuring:' || collector AS flag_key,
  array_to_string(list(from_account ORDER BY us, id) FILTER (fresh), ',') || ',' || collector AS involved_accounts, array_to_string(list(id ORDER BY us, id), ',') AS evidence
 FROM (SELECT *, row_number() OVER (PARTITION BY collector, from_account ORDER BY us, id) = 1 AS fresh FROM fan_members) GROUP BY collector
UNION ALL SELECT 'round_tripping:' || array_to_string(nodes, '>'), array_to_string(nodes, ','), array_to_string(ids, ',') FROM trips
UNION ALL SELECT 'rapid_layering:' || array_to_string(nodes, '>'), array_to_string(nodes, ','), array_to_string(ids, ',') FROM layers""")
def e4_documents(spark, sf):
    return N.flag_documents(*flags(spark, sf)).select("flag_key", joined("involved_accounts"), joined("evidence"))


@query("E5", ALL_FLAGS + "SELECT * FROM flags ORDER BY confidence DESC, flag_key LIMIT 40 OFFSET 10")
def e5(spark, sf):
    return out(page(flags(spark, sf)[0], 40, 10).select(COLS))


WALK_COLS = ["walk_id", "step_index", "depth", "from_account", "to_account", "amount", "dt", "id", "tool_call_id"]


def _walk_sql(depth, seeds):
    ctes = [f"f0 AS (SELECT walk_id, walk_id AS acct, CAST(1 AS BIGINT) AS rank FROM ({seeds}))", "v0 AS (SELECT walk_id, acct FROM f0)"]
    for d in range(depth):
        ctes.append(f"s{d} AS (SELECT f.walk_id, {d} AS depth, f.rank, e.* FROM f{d} f JOIN edges e ON e.from_account = f.acct)")
        if d + 1 < depth:
            ctes.append(f"f{d + 1} AS (SELECT walk_id, to_account AS acct, row_number() OVER (PARTITION BY walk_id ORDER BY rank, us, id) AS rank FROM "
                        f"(SELECT * FROM s{d} s WHERE NOT EXISTS (SELECT 1 FROM v{d} v WHERE v.walk_id = s.walk_id AND v.acct = s.to_account) "
                        f"QUALIFY row_number() OVER (PARTITION BY walk_id, to_account ORDER BY rank, us, id) = 1))")
            ctes.append(f"v{d + 1} AS (SELECT * FROM v{d} UNION ALL SELECT walk_id, acct FROM f{d + 1})")
    ctes.append("walk AS (SELECT *, row_number() OVER (PARTITION BY walk_id ORDER BY depth, rank, us, id) AS step_index FROM ("
                + " UNION ALL ".join(f"SELECT * FROM s{d}" for d in range(depth)) + "))")
    return ", ".join(ctes)


@query("E6", with_(EDGES_SQL, _walk_sql(3, "SELECT min(from_account) AS walk_id FROM edges")) + """SELECT walk_id, step_index, depth, from_account, to_account, amount, dt, id,
 'TOOL-CALL-SYN-' || CASE WHEN step_index < 1000 THEN lpad(CAST(step_index AS VARCHAR), 3, '0') ELSE CAST(step_index AS VARCHAR) END AS tool_call_id FROM walk""")
def e6(spark, sf):
    e = T.edges(spark, sf)
    seed = e.agg(F.min("from_account").alias("walk_id")).withColumn("account", F.col("walk_id"))
    return out(N.network_walk(e, seed, depth=3).select(WALK_COLS))


@query("E8", with_(EDGES_SQL, _walk_sql(2, "SELECT from_account AS walk_id FROM edges UNION SELECT to_account FROM edges")) + """, a AS (SELECT f0.walk_id, count(step_index) AS hop_count,
  arg_min(from_account, step_index) AS start_account, arg_max(to_account, step_index) AS end_account,
  arg_max(amount, step_index) / arg_min(amount, step_index) AS ratio FROM f0 LEFT JOIN walk USING (walk_id) GROUP BY ALL)
SELECT walk_id, hop_count, start_account, end_account, round(ratio, 6) AS retention_ratio,
 CASE WHEN hop_count = 0 THEN 0.50E0 WHEN start_account = end_account AND ratio >= 0.85 THEN 0.94E0 WHEN hop_count >= 3 THEN 0.88E0 ELSE 0.60E0 END AS risk_score,
 CASE WHEN start_account = end_account AND ratio >= 0.85 THEN 'round_tripping' WHEN hop_count >= 3 THEN 'rapid_layering' ELSE 'none' END AS typology FROM a""")
def e8(spark, sf):
    e = T.edges(spark, sf)
    accounts = e.select(F.col("from_account").alias("account")).union(e.select("to_account")).distinct()
    return N.network_walk_risk(N.walk_summary(e, accounts.withColumn("walk_id", F.col("account")), depth=2)).drop("net")


# each block of 100 users is one labelled case; half of the cases are labelled by a fixed rule
CASE_SQL = """net_edges AS (SELECT *, CAST(from_account // 100 AS VARCHAR) AS net FROM edges),
cases AS (SELECT DISTINCT net AS test_id, CASE WHEN CAST(net AS BIGINT) % 2 = 0 THEN 'flagged' ELSE 'benign' END AS expected_verdict FROM net_edges)"""


def cases(spark, sf):
    e = T.edges(spark, sf).withColumn("net", F.expr("from_account div 100").cast("string"))
    expected = e.select(F.col("net").alias("test_id")).distinct().withColumn(
        "expected_verdict", F.when(F.col("test_id").cast("long") % 2 == 0, "flagged").otherwise("benign"))
    return N.evaluate_cases(expected, e, fan_in=FAN_IN, trips=TRIPS, layering=LAYERING)


CASE_FLAGS = "hits AS (SELECT CAST(split_part(split_part(flag_key, ':', 2), '>', 1) AS BIGINT) // 100 AS net, typology FROM flags)"
VERDICTS = """verdicts AS (SELECT test_id, expected_verdict, CASE WHEN count(typology) > 0 THEN 'flagged' ELSE 'benign' END AS actual_verdict, count(typology) AS n_flags,
  array_to_string(list_sort(list(DISTINCT typology)), ',') AS typologies FROM cases LEFT JOIN hits ON CAST(hits.net AS VARCHAR) = test_id GROUP BY ALL)"""


@query("E7", with_(EDGES_SQL, BAND, FAN_SQL, TRIP_SQL, LAYER_SQL, FLAGS_SQL, CASE_SQL, CASE_FLAGS, VERDICTS) + "SELECT *, actual_verdict = expected_verdict AS passed FROM verdicts")
def e7(spark, sf):
    return cases(spark, sf).select("test_id", "expected_verdict", "actual_verdict", "n_flags", joined("typologies"), "passed")


@query("E7_scores", with_(EDGES_SQL, BAND, FAN_SQL, TRIP_SQL, LAYER_SQL, FLAGS_SQL, CASE_SQL, CASE_FLAGS, VERDICTS) + """, c AS (SELECT count(*) AS total,
  count(*) FILTER (expected_verdict = 'flagged' AND actual_verdict = 'flagged') AS tp, count(*) FILTER (expected_verdict = 'benign' AND actual_verdict = 'flagged') AS fp,
  count(*) FILTER (expected_verdict = 'benign' AND actual_verdict = 'benign') AS tn, count(*) FILTER (expected_verdict = 'flagged' AND actual_verdict = 'benign') AS fn FROM verdicts)
SELECT *, round(tp / greatest(1, tp + fp), 4) AS "precision", round(tp / greatest(1, tp + fn), 4) AS recall,
 round(2 * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / greatest(1e-10, tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn)), 4) AS f1,
 round(tn / greatest(1, tn + fp), 4) AS specificity, round((tp + tn) / greatest(1, total), 4) AS accuracy FROM c""")
def e7_scores(spark, sf):
    return N.confusion(cases(spark, sf))


# -- rolling structuring on the ledger ---------------------------------------------------
ROLL = dict(threshold=1_200_000.0, margin=20_000.0)
ROLL_SQL = """debits AS (SELECT account_id, id, dt, epoch_us(dt) AS us, CAST(amount AS DECIMAL(28,6)) AS amount FROM ledger WHERE direction = 'debit'),
roll AS (SELECT *, row_number() OVER r AS rn, CAST(sum(amount) OVER r - coalesce(sum(amount) OVER o, 0) AS DOUBLE) AS window_sum, count(*) OVER r - count(*) OVER o AS txn_count FROM debits
 WINDOW r AS (PARTITION BY account_id ORDER BY us, id ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY account_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 2592000000001 PRECEDING)),
sflags AS (SELECT f.account_id, f.rn AS at, min(e.dt) AS window_start, f.dt AS window_end, round(f.window_sum, 2) AS window_sum, f.txn_count, 1200000.0E0 AS threshold, 20000.0E0 AS margin,
  round(1200000.0E0 - f.window_sum, 2) AS gap_to_threshold, greatest(0.0E0, least(1.0E0, round(1.0E0 - (1200000.0E0 - f.window_sum) / 20000.0E0, 4))) AS severity, list(e.id ORDER BY e.rn) AS evidence
 FROM roll f JOIN roll e ON e.account_id = f.account_id AND e.rn BETWEEN f.rn - f.txn_count + 1 AND least(f.rn - f.txn_count + 8, f.rn)
 WHERE f.window_sum >= 1180000 AND f.window_sum < 1200000 AND f.txn_count >= 2 GROUP BY f.account_id, f.rn, f.dt, f.window_sum, f.txn_count)"""


@query("F7", with_(LEDGER_SQL, ROLL_SQL) + "SELECT account_id, id, window_sum, txn_count FROM roll")
def f7(spark, sf):
    return ST.trailing_outflow(T.ledger(spark, sf)).select("account_id", "id", F.col("window_sum").cast("double").alias("window_sum"), "txn_count")


@query("E9", with_(LEDGER_SQL, ROLL_SQL) + "SELECT * REPLACE (array_to_string(evidence, ',') AS evidence) FROM sflags")
def e9(spark, sf):
    return out(ST.rolling_structuring(T.ledger(spark, sf), **ROLL).withColumn("evidence", joined("evidence")))


@query("E10", with_(LEDGER_SQL, ROLL_SQL) + """SELECT count(*) AS total_flags, count(DISTINCT account_id) AS affected_accounts, round(max(severity), 4) AS max_severity,
 round(avg(severity), 4) AS mean_severity, round(avg(window_sum), 2) AS mean_window_sum, round(avg(txn_count), 2) AS mean_txn_count FROM sflags""")
def e10(spark, sf):
    return ST.structuring_summary(ST.rolling_structuring(T.ledger(spark, sf), **ROLL))


@query("E10_accounts", with_(LEDGER_SQL, ROLL_SQL) + "SELECT account_id, count(*) AS flags FROM sflags GROUP BY ALL")
def e10_accounts(spark, sf):
    return ST.flags_per_account(ST.rolling_structuring(T.ledger(spark, sf), **ROLL))
