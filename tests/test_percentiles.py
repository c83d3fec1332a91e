"""Percentiles of hot keys have the bits of Spark's own."""

import random

from pyspark.sql import functions as F

from cashtrail.plans.ordering import exact_percentiles


def test_same_bits_at_any_limit(spark, small_tasks):
    r = random.Random(1)
    rows = [(r.choice("abc"), r.choice([r.lognormvariate(0, 3), float(r.randrange(5)), None])) for _ in range(3_000)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"p05": 0.05, "p33": 1 / 3, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    own = df.groupBy("k").agg(*[F.percentile("v", q).alias(o) for o, q in wanted.items()])
    want = sorted(tuple(x) for x in own.collect())
    assert sorted(tuple(x) for x in exact_percentiles(df, ["k"], "v", wanted).select(own.columns).collect()) == want
    for limit in (50, 500):
        small_tasks(limit)
        assert sorted(tuple(x) for x in exact_percentiles(df, ["k"], "v", wanted).select(own.columns).collect()) == want
