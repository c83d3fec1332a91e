"""Steps that several queries share are worked out once, with the rows they had when each reader repeated them."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cashtrail.functions import text
from cashtrail.operators import ledger as L
from cashtrail.operators import reversals as R
from cashtrail.operators import typology as N
from cashtrail.sources import ledger as S


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def ledger(spark, n=600, seed=5):
    r, start = random.Random(seed), datetime(2024, 1, 1, tzinfo=UTC)
    rows = [(f"AC{r.randrange(3)}", start + timedelta(hours=r.randrange(24 * 40)), f"t{i:04d}", r.choice(["debit", "credit"]), r.choice([10.0, 20.0, 30.5]),
             r.uniform(-400_000, 400_000)) for i in range(n)]
    return spark.createDataFrame(rows, "account_id string, dt timestamp, id string, direction string, amount double, balance double")


def test_detectors_run_once_though_a_sort_reads_twice(spark):
    found = L.all_anomalies(ledger(spark), breaks=dict(sigmas=1.0), spikes=dict(min_count=3))
    assert "Join" not in plan(found) and "Sort" in plan(found)
    got = found.collect()
    assert {r.anomaly_type for r in got} >= {"balance_break", "reversal_outlier"}
    assert [r.severity for r in got] == sorted((r.severity for r in got), reverse=True)


def test_pairs_of_reversal_outliers_are_paired_once(spark):
    assert "transform" not in plan(L.reversal_outliers(ledger(spark)))      # the fold of the pairing


def test_pairing_shuffles_its_rows_once(spark):
    rows = ledger(spark)
    got = R.reversal_pairs(rows, chunk_rows=1_000)
    assert got.count() > 20
    p = got._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert p.count("Exchange") == 1
    assert R.reversal_pairs(rows.withColumn("amount", F.when(F.col("amount") > 10, F.col("amount")))).filter("amount IS NULL").count() == 0


def test_paths_are_found_once_for_flags_and_members(spark):
    hour = 3_600_000_000
    rows = [(f"e{i}", a, b, 100.0, i * hour) for i, (a, b) in enumerate([(1, 2), (2, 3), (3, 1), (1, 4), (4, 5), (5, 6)])]
    edges = spark.createDataFrame(rows, "id string, from_account long, to_account long, amount double, us long").withColumn("dt", F.timestamp_micros("us")).drop("us")
    flags, members = N.typology_flags(edges, None, dict(hours=24), dict(min_amount=10.0))
    assert {r.typology for r in flags.collect()} == {"round_tripping", "rapid_layering"}
    assert "Join" not in plan(flags) and plan(members).count("Join") <= 2    # those of the fan-in members
    assert members.filter("flag_key = 'round_tripping:1>2>3'").count() == 6


TEXTS = [None, "", " ", "  a  b ", "a", "\t", "a\n", " a \x85", "a  ", "a  \n", "a \r\n", "a\x0b\x0bb", "a ", "NEFT", " neft  X", "TRF TO   Y", "trf frm\tZ", "UPI/CR/ 1", "FDRL/",
         "RTGS RTGS a", "a  ", "x\x0c y", "\x85", " \x85 ", "TRF TO \x85"]


def texts(spark):
    r = random.Random(2)
    made = ["".join(r.choice([" ", " ", "\t", "\n", "a", "B", "\x85", " ", "NEFT", "ı", "ß"]) for _ in range(r.randrange(9))) for _ in range(400)]
    return spark.createDataFrame([(x,) for x in TEXTS + made], "n string")


def test_clean_up_equals_the_plain_expressions(spark):
    n = F.col("n")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rest = strip(F.regexp_replace(F.regexp_replace(strip(n), text.COUNTERPARTY_PREFIX, ""), r"\s+", " "))
    party = F.when(strip(n) == "", None).otherwise(F.coalesce(F.nullif(rest, F.lit("")), strip(n)))
    got = texts(spark).select(n, text.strip(n).eqNullSafe(strip(n)).alias("s"), text.counterparty(n).eqNullSafe(party).alias("p"))
    assert got.filter("NOT (s AND p)").collect() == []
    number = spark.createDataFrame([("1.5",), ("nan",), ("x",), (None,), ("-0",), ("1e400",), (" 7 ",)], "n string").select(text.number_or_zero(n).alias("v"))
    assert [r.v for r in number.collect()] == [1.5, 0.0, 0.0, 0.0, 0.0, float("inf"), 7.0]


@pytest.mark.parametrize("make", [text.payment_rail, text.counterparty, text.cheque_number])
def test_a_text_is_cleaned_once(spark, make):
    p = plan(texts(spark).select(make(F.col("n")).alias("v")))
    assert p.count("upper(") <= 1 and p.count("trim(") <= 2 and p.count(text.WIDE_GAP) <= 1


def test_sequential_ids_parse_the_rows_once_for_the_counts(spark):
    rows = ledger(spark, 60).withColumnRenamed("id", "tie").repartition(3)
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = S.with_sequential_ids(rows.mapInArrow(passed, rows.schema)).collect()
    want = sorted((r.account_id, r.dt, r.tie) for r in rows.collect())
    assert sorted(r.id for r in got) == [f"TX-LEDGER-{i + 1:06d}" for i in range(60)]
    assert [(r.account_id, r.dt) for r in sorted(got, key=lambda r: r.id)] == [w[:2] for w in want]
    assert seen.value == 120                                                # once for the counts, once for the rows
