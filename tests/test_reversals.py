"""Pairing as a chunked scan equals the sequential pass for any chunk size."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from cashtrail.operators import reversals as R


def ledger_rows(seed):
    r = random.Random(seed)
    rows, start = [], datetime(2024, 1, 1, tzinfo=UTC)
    for i in range(700):
        account = r.choice(["a", "a", "a", "b", "c"])
        rows.append((account, r.choice([10.0, 10.004, 20.0, 30.5]) if account != "c" else 7.0, start + timedelta(hours=r.choice([0, 1, 2, 30]) + r.randrange(400)),
                     f"t{i:04d}", "debit" if account == "c" or r.random() < 0.5 else "credit"))
    return rows


def sequential(rows, hours=48):
    groups, pairs = {}, []
    for account, amount, dt, id_, direction in sorted(rows, key=lambda x: (x[2], x[3])):
        waiting = groups.setdefault((account, round(amount, 2)), [])
        waiting[:] = [w for w in waiting if dt - w[0] <= timedelta(hours=hours)]
        if waiting and waiting[0][2] != direction:
            pairs.append((account, round(amount, 2), waiting.pop(0)[1], id_))
        else:
            waiting.append((dt, id_, direction))
    return sorted(pairs)


@pytest.fixture(scope="module")
def case(spark):
    rows = ledger_rows(4)
    return spark.createDataFrame(rows, "account_id string, amount double, dt timestamp, id string, direction string").cache(), sequential(rows)


@pytest.mark.parametrize("chunk_rows", [2, 7, 60, 1_000])
def test_any_chunk_size(case, chunk_rows):
    ledger, want = case
    assert len(want) > 100
    got = R.reversal_pairs(ledger, chunk_rows=chunk_rows)
    assert sorted((r.account_id, r.amount, r.id_1, r.id_2) for r in got.collect()) == want


def test_hot_group_beyond_a_task(case, small_tasks):
    ledger, want = case
    small_tasks(40, fold=9)
    assert sorted((r.account_id, r.amount, r.id_1, r.id_2) for r in R.reversal_pairs(ledger).collect()) == want


def test_nothing_to_pair(spark, case):
    ledger, _ = case
    assert R.reversal_pairs(ledger.filter("account_id = 'c'")).count() == 0
    assert R.reversal_pairs(ledger.limit(0)).count() == 0


def test_no_python_in_the_plan(case):
    ledger, _ = case
    plan = R.reversal_pairs(ledger)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "Python" not in plan
