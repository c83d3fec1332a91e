"""Hand-checkable cases, invariants and brute-force twins on tiny tables."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashtrail.functions import text, values as V
from cashtrail.operators import adjudicate as A
from cashtrail.operators import conformal as CF
from cashtrail.operators import drift as DR
from cashtrail.operators import evidence as EV
from cashtrail.operators import explain as E
from cashtrail.operators import features as X
from cashtrail.operators import metrics as M
from cashtrail.operators import models as ML
from cashtrail.operators import reversals as R
from cashtrail.operators import structuring as ST
from cashtrail.operators import typology as N
from cashtrail.sources import ledger as S

DAY0 = datetime(2026, 1, 1)


def test_payment_rail_ladder(spark):
    cases = [("RTGS/INDO1234/CORP PMT", "RTGS"), ("NEFT-SBIN123-TRANSFER", "NEFT"), ("UPI/CR/987654321/GROCERY", "UPI"), ("IMPS-P2A-654321", "IMPS"),
             ("FDRL/INTERNAL FUND TRANSFE", "INTERNAL_TRANSFER"), ("INDO GIBL STL01071", "INDO_GIBL"), ("CHQ DEPOSIT CLEARING #9921", "CHEQUE"), (None, "OTHER")]
    df = spark.createDataFrame(cases, "n string, want string")
    assert df.filter(text.payment_rail(F.col("n")) != F.col("want")).count() == 0


def test_counterparty_and_cheque(spark):
    df = spark.createDataFrame([("TRF TO  ACME  LTD", "12.0"), ("NEFT", "nan"), ("   ", " 7 "), (None, None)], "n string, c string")
    got = df.select(text.counterparty(F.col("n")), text.cheque_number(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("ACME LTD", "12"), ("NEFT", None), (None, "7"), (None, None)]


def test_haversine(spark):
    df = spark.createDataFrame([(40.7128, -74.0060, 51.5074, -0.1278), (1.0, 2.0, 1.0, 2.0)], "a double, b double, c double, d double")
    far, same = [r[0] for r in df.select(V.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert 5500 < far < 5650 and same < 1e-4


def test_mobile_money_features(spark):
    df = spark.createDataFrame([(1, "TRANSFER", 5000.0, 10000.0, 5000.0, 0.0, 5000.0)],
                               "step int, type string, amount double, oldbalanceOrg double, newbalanceOrig double, oldbalanceDest double, newbalanceDest double")
    r = X.mobile_money_features(df).first()
    assert (r.balance_drain_ratio, r.type_TRANSFER, r.type_PAYMENT, r.orig_dest_mismatch) == (0.5, 1.0, 0.0, 0.0)


def _spend(spark, extra=()):
    rows = [("u", 10, 0, 100.0, "a"), ("u", 10, 30, 200.0, "b"), ("u", 12, 0, 300.0, "c"), *extra]
    data = [(u, DAY0 + timedelta(hours=h, minutes=m), a, k) for u, h, m, a, k in rows]
    return X.causal_features(spark.createDataFrame(data, "cc_num string, timestamp timestamp, amount double, transaction_id string"))


def test_causal_features_do_not_look_ahead(spark):
    cols = ["transaction_id", "velocity_1h", "velocity_24h", "amount_to_user_mean_ratio"]
    before = {r[0]: tuple(r)[1:] for r in _spend(spark).select(cols).collect()}
    assert before["a"] == (0, 0, 1.0)
    assert before["b"][:2] == (1, 1) and abs(before["b"][2] - 2.0) < 1e-3
    assert before["c"][:2] == (0, 2) and abs(before["c"][2] - 2.0) < 1e-3
    after = {r[0]: tuple(r)[1:] for r in _spend(spark, [("u", 15, 0, 50_000.0, "d"), ("v", 10, 15, 1.0, "e")]).select(cols).collect()}
    assert all(after[k] == before[k] for k in before)          # a later row and another user change nothing


def _ledger(spark, rows):
    data = [(f"T{i:03d}", a, DAY0 + timedelta(days=d), float(x), s, float(b), n, r) for i, (a, d, x, s, b, n, r) in enumerate(rows)]
    return spark.createDataFrame(data, "id string, account_id string, dt timestamp, amount double, direction string, balance double, raw_narration string, payment_rail string")


def test_rolling_structuring(spark):
    led = _ledger(spark, [("A", d, 95, "debit", 0, "x", "UPI") for d in range(10)])
    flags = ST.rolling_structuring(led).collect()
    assert [(f.window_sum, f.txn_count, f.severity) for f in flags] == [(950.0, 10, 0.5)]
    assert flags[0].evidence == [f"T{i:03d}" for i in range(8)]


def test_defence_clears_rent(spark):
    led = _ledger(spark, [("A", d, 500, "debit", 900, "MONTHLY RENT", "NEFT") for d in (0, 30, 60)])
    queue = spark.createDataFrame([("T002", 0.60)], "id string, risk_score double")
    r = A.adjudicate_queue(queue, led).first()
    assert r.n_grounds >= 2 and r.verdict == "cleared" and r.final_score == 0.0


def _pairs_by_hand(rows, within=172_800):
    pools, pairs = {}, []
    for rid, dt, amount, side in sorted(rows, key=lambda r: (r[1], r[0])):
        pool = [w for w in pools.get(amount, []) if (dt - w[1]).total_seconds() <= within]
        hit = next((i for i, w in enumerate(pool) if w[2] != side), None)
        if hit is None:
            pool.append((rid, dt, side))
        else:
            pairs.append((pool.pop(hit)[0], rid))
        pools[amount] = pool
    return sorted(pairs)


@pytest.mark.parametrize("rows_per_task, fold", [(1_000_000, 1_000_000), (1_000_000, 5), (40, 5)])
def test_reversal_pairs_against_brute_force(spark, small_tasks, rows_per_task, fold):
    rnd = random.Random(7)
    rows = [(f"R{i:04d}", DAY0 + timedelta(hours=6 * rnd.randrange(120)), float(rnd.choice([5, 5, 5, 9])), rnd.choice(["debit", "credit"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, dt timestamp, amount double, direction string").withColumn("account_id", F.lit("A"))
    small_tasks(rows_per_task, fold)
    got = sorted((r.id_1, r.id_2) for r in R.reversal_pairs(df).collect())
    assert got == _pairs_by_hand(rows)


def _case(name, verdict, transfers):
    return (name, verdict), [(name, f"{name}-{i}", s, r, float(a), DAY0 + timedelta(hours=h)) for i, (s, r, a, h) in enumerate(transfers)]


def test_labelled_cases(spark):
    made = [
        _case("TP-01", "flagged", [(f"S{i}", "C", 8200 + 350 * i, 1.5 * i) for i in range(5)]),
        _case("TP-02", "flagged", [("S", "C", 9050 + 200 * i, i) for i in range(4)]),                 # one sender: known gap
        _case("TP-03", "flagged", [(f"S{i}", "C", 9020 + 160 * i, 2.3 * i) for i in range(6)]),
        _case("TP-05", "flagged", [(f"S{i}", "C", 8900 + 200 * i, 18 + 2.5 * i) for i in range(5)]),   # over midnight
        _case("FP-01", "benign", [("C", f"E{i}", 8000 + 10 * i, 0.1 * i) for i in range(5)]),          # fan-out
        _case("FP-02", "benign", [("S1", "C", 9800, 0), ("S2", "C", 9800, 0.08)]),                     # two senders
        _case("FP-03", "benign", [(f"S{i}", "C", 8700 + 300 * i, 13 * i) for i in range(3)]),          # 26 h
    ]
    expected = spark.createDataFrame([c for c, _ in made], "test_id string, expected_verdict string")
    edges = spark.createDataFrame([e for _, es in made for e in es], "net string, id string, from_account string, to_account string, amount double, dt timestamp")
    r = N.confusion(N.evaluate_cases(expected, edges)).first()
    assert (r.tp, r.tn, r.fp, r.fn) == (3, 3, 0, 1)
    one = N.evaluate_cases(expected, edges, fan_in=dict(min_senders=1)).filter("test_id = 'TP-02'").first()
    assert one.actual_verdict == "flagged"


def _fan_by_hand(rows, threshold, lower, span):
    out = {}
    for c in {r[2] for r in rows}:
        band = sorted((r[4], r[0], r[1], r[3]) for r in rows if r[2] == c and lower <= r[3] < threshold)
        for i, (t, rid, _s, _a) in enumerate(band):
            win = [b for b in band[i:] if b[0] - t <= span]
            if len({b[2] for b in win}) >= 3 and sum(b[3] for b in win) >= threshold * 1.8:
                out[c] = (rid, len(win))
                break
    return out


@pytest.mark.parametrize("rows_per_task", [1_000_000, 60])
def test_fan_in_against_brute_force(spark, small_tasks, rows_per_task):
    rnd = random.Random(3)
    rows = [(f"E{i:04d}", rnd.choice("abcd"), rnd.choice("xy"), rnd.choice([8000.0, 9000.0, 2000.0]), DAY0 + timedelta(hours=rnd.randrange(900))) for i in range(250)]
    df = spark.createDataFrame(rows, "id string, from_account string, to_account string, amount double, dt timestamp")
    small_tasks(rows_per_task)
    got = {r.collector: (r.start_id, r.n_edges) for r in N.fan_in_structuring(df).collect()}
    assert got == _fan_by_hand(rows, 10_000, 7_500, timedelta(hours=24))


def test_drift_fires_on_shift(spark):
    rnd = random.Random(1)
    rows = [(i, DAY0 + timedelta(minutes=i), rnd.uniform(.1, .3) if i < 500 else rnd.uniform(.7, .9)) for i in range(1000)]
    r = DR.ks_drift(spark.createDataFrame(rows, "id long, dt timestamp, score double"), ["dt", "id"], 500).collect()
    assert len(r) == 1 and r[0].drift_fired and r[0].ks_statistic == 1.0
    same = spark.createDataFrame([(i, DAY0 + timedelta(minutes=i), (i * 37 % 500) / 500) for i in range(1000)], "id long, dt timestamp, score double")
    assert not DR.ks_drift(same, ["dt", "id"], 500).first().drift_fired
    assert DR.ks_drift(same.limit(900), ["dt", "id"], 500).count() == 0


def test_step_split_is_disjoint(spark):
    s = M.step_split(spark.range(1, 1001).withColumnRenamed("id", "step"))
    r = s.groupBy("split").agg(F.min("step").alias("lo"), F.max("step").alias("hi"), F.count("*").alias("n")).collect()
    by = {x.split: x for x in r}
    assert by["train"].hi < by["test"].lo and abs(by["test"].n - 200) <= 10


def test_intervals(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(4000):
        p = rnd.random() ** 3
        rows.append((i, p, int(rnd.random() < p)))
    df = spark.createDataFrame(rows, "id long, score double, label int")
    h = CF.halves(df, ["id"])
    cal = CF.mondrian_calibration(h.filter("half = 'calibrate'"), 0.5)
    got = CF.with_interval(h.filter("half = 'evaluate'"), cal, 0.5)
    assert got.filter("lower < 0 OR upper > 1 OR lower > upper").count() == 0
    cov = {r.slice: r.empirical_coverage for r in CF.coverage(h.filter("half = 'evaluate'"), cal, 0.5).collect()}
    assert abs(cov["pooled"] - 0.9) < 0.05


EVENTS = [("K", 1, "EVT-101", "Transaction TX-100 had amount 4,850 and occurred at 03:22.", "TX-100 4850", "{'transaction_id': 'TX-100'}")]


@pytest.mark.parametrize("sentence, reason", [
    ("transaction TX-100 had amount 4,850 and occurred at 03:22!", None),
    ("Transaction TX-100 had amount 4850.", None),
    ("Transaction TX-100 had amount 4850 and was sent to an offshore account.", "Unsupported speculative claim: 'offshore'"),
    ("Funds went to ACC-9999.", "Unsupported entity ID: 'acc-9999'"),
    ("Transaction TX-100 had amount 99,000.", "Unsupported numeric value: '99,000'"),
    ("It was on that.", "Sentence contains no verifiable informative content"),
    ("Transaction TX-100 moved abroad quickly.", "Unsupported factual terms: abroad, moved, quickly"),
])
def test_grounding_rules(spark, sentence, reason):
    events = spark.createDataFrame(EVENTS, "case_id string, event_pos long, event_id string, narration string, summary string, tool_input string")
    claims = spark.createDataFrame([("K", 0, sentence)], "case_id string, pos long, sentence string")
    r = EV.check_claims(claims, events).first()
    assert (r.grounded, r.reason) == (reason is None, reason)


def test_audit_trust_and_narrative(spark):
    events = spark.createDataFrame(EVENTS, "case_id string, event_pos long, event_id string, narration string, summary string, tool_input string")
    words = EVENTS[0][3] + " Funds went to the Cayman Islands."
    claims = EV.split_claims(spark.createDataFrame([("K", words)], "case_id string, text string"))
    a = EV.audit(claims, events)
    assert [(r.grounded, r.supporting_event_id) for r in a.orderBy("pos").collect()] == [(True, "EVT-101"), (False, None)]
    assert EV.trust_scores(a).first().grounded_pct == 50.0
    assert EV.narrative(a, events).first().narrative == EVENTS[0][3]


def test_sentence_split_protects_dots(spark):
    df = spark.createDataFrame([("Paid $4,850.00 at 3 p.m. sharp. Ratio was 3.14, e.g. high! Done",)], "t string")
    assert df.select(EV.sentences(F.col("t"))).first()[0] == ["Paid $4,850.00 at 3 p.m. sharp.", "Ratio was 3.14, e.g. high!", "Done"]


def test_consistency_checks(spark):
    df = spark.createDataFrame([("The case is high-risk because of the $ value", "flagged"), ("All normal", "flagged"), ("Risk was reduced", "clear"), ("", "clear")], "n string, v string")
    assert [r[0] for r in df.select(EV.verdict_consistent(F.col("n"), F.col("v"))).collect()] == [True, False, True, False]
    named = df.select(EV.drivers_named(F.col("n"), F.array(F.lit("V14"), F.lit("Amount"), F.lit("Time")))).collect()
    assert [r[0] for r in named] == [True, False, False, False]


def test_prepared_answers(spark):
    q = spark.createDataFrame([(1, "Tell me why was this flagged please"), (2, "flagged? and why"), (3, "hello")], "query_id long, query string")
    p = spark.createDataFrame([("q1", 1, "why flagged"), ("q1", 2, "why was this flagged"), ("q2", 3, "find similar")], "question_id string, item long, pattern string")
    got = {r.query_id: (r.pattern, r.match_pass) for r in EV.match_answers(q, p).collect()}
    assert got == {1: ("why was this flagged", 1), 2: ("why flagged", 2)}


def test_substring_join_finds_long_texts(spark):
    from cashtrail.plans.words import occurrences
    long = "x" * 250 + "needle here" + "y" * 700 + "end"
    texts = spark.createDataFrame([(1, long), (2, "short end"), (3, "none")], "k long, t string")
    needles = spark.createDataFrame([("needle here",), ("end",), ("absent",)], "n string")
    found = occurrences(texts, "t", needles, "n", [], ["k"])
    got = sorted((r.k, r.n) for r in found.collect())
    assert got == [(1, "end"), (1, "needle here"), (2, "end")]


def test_nearest_minority_against_brute_force(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, a double, b double, c double")
    got = {}
    for r in ML.nearest_rows(df, "id", ["a", "b", "c"], 4, 60, max_pivots=13).collect():
        got.setdefault(r.id, []).append((r.n, r.neighbour))
    for i, p in enumerate(pts):
        d = ((pts - p) ** 2).sum(1)
        d[i] = np.inf
        assert [n for _, n in sorted(got[i])] == list(np.argsort(d)[:4])


def test_smote_reaches_ratio(spark):
    rows = [(i, float(i % 7), float(i % 11), int(i < 8)) for i in range(1008)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    n = {r.label: r["count"] for r in ML.smote(df, "label", "id", ["a", "b"], ratio=0.05).groupBy("label").count().collect()}
    assert n == {0: 1000, 1: 50}
    few = df.filter("label = 0 OR id < 5")
    assert ML.smote(few, "label", "id", ["a", "b"]).count() == few.count()


def test_ledger_scan_cleans_and_numbers(spark):
    raw = spark.createDataFrame([("'A1' ", "2026-01-02", "NEFT X", "7.0", "bad", "10", None, "5"), ("A1", "2026-01-01", None, None, "2026-01-03", None, "x", None)],
                                ", ".join(f"`{c}` string" for c in S.RAW_COLUMNS))
    got = S.with_sequential_ids(S.normalise(raw)).orderBy("id").collect()
    assert [(r.id, r.account_id, r.amount, r.direction, r.payment_rail) for r in got] == [
        ("TX-LEDGER-000001", "A1", 0.0, "credit", "GENERAL_TRANSFER"), ("TX-LEDGER-000002", "A1", 10.0, "debit", "NEFT")]
    assert got[1].value_dt == datetime(2026, 1, 2) and got[1].chq_no == "7" and got[0].balance == 0.0


def test_row_order_does_not_matter(spark):
    from cashtrail.catalog import ledger as C
    from cashtrail.operators import ledger as L
    from cashtrail.sources import tables as T
    led = T.ledger(spark, "/root/testdata/sf0.001")
    key = lambda df: sorted(str(r) for r in df.collect())
    mixed = led.repartition(7, F.rand(seed=3))
    assert key(L.timing_spikes(led, min_count=3)) == key(L.timing_spikes(mixed, min_count=3))
    assert key(L.balance_breaks(led, sigmas=C.BREAK_SIGMAS)) == key(L.balance_breaks(mixed, sigmas=C.BREAK_SIGMAS))


def test_every_query_has_columns_and_known_keys():
    from cashtrail import catalog
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 120


def test_counterfactual_keeps_rejected_and_equal_overrides(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(60)], "id long, a double, b double, label int")
    model = ML.logistic(["a", "b"], "label").fit(rows)
    overrides = spark.createDataFrame([(1, "zz", "1"), (2, "a", "2.0"), (3, "A", "6"), (3, "b", "x")], "id long, feature string, value string")
    got = {r.id: r for r in E.counterfactual(rows, overrides, ["id"], model, ["a", "b"], 0.5).collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[1].attribution_deltas == [] and got[1].n_rejected == 1 and got[1].original_risk_score == got[1].recalculated_risk_score
    assert [(d.feature, d.delta) for d in got[2].attribution_deltas] == [("a", 0.0)]
    assert [d.feature for d in got[3].attribution_deltas] == ["a"] and got[3].n_rejected == 1 and got[3].recalculated_risk_score > got[3].original_risk_score
