"""Pages by histogram refinement equal slices of the sorted table."""

import math
import random

import pytest

from cashtrail.plans.pages import numbered_slice

NAN = float("nan")


def rank(v):
    return (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v)


@pytest.mark.parametrize("kind", ["spread", "skewed", "equal", "odd"])
def test_equals_slices(spark, kind):
    r = random.Random(kind)
    value = {"spread": lambda: r.random() * 1e6, "skewed": lambda: r.choice([1.0, 1.0, 1.0, 2.0 + r.random() * 1e-9, r.lognormvariate(0, 9)]), "equal": lambda: 3.0,
             "odd": lambda: r.choice([None, NAN, math.inf, -math.inf, 1e308, -1e308, 0.0, r.random()])}[kind]
    rows = [(i, value()) for i in r.sample(range(5_000), 1_500)]
    df = spark.createDataFrame(rows, "id long, v double")
    want = [i for i, _ in sorted(rows, key=lambda x: (*rank(x[1]), x[0]))]
    for offset, limit in ((0, 10), (700, 25), (1_490, 30), (0, 2_000), (3_000, 5)):
        page, total = numbered_slice(df, ["v", "id"], offset, limit, few=20)
        got = sorted((x.pos, x.id) for x in page.collect())
        assert total == 1_500 and got == list(enumerate(want, 1))[offset:offset + limit], (offset, limit)


def test_page_numbers_few_rows(spark):
    df = spark.range(50_000).selectExpr("id", "cast(id * 7919 % 50021 as double) AS v")
    page, _ = numbered_slice(df, ["v", "id"], 30_000, 20, few=500)
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert ">=" in plan and [round(x.v) for x in page.orderBy("pos").limit(1).collect()][0] > 0
    assert numbered_slice(df.limit(0), ["v", "id"], 0, 5)[0].count() == 0
