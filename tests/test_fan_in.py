"""Fan-in windows for any number of senders, and the ordered suppression, against plain passes."""

import random

import pytest
from pyspark.sql import functions as F

from cashtrail.operators import typology as N

HOUR = 3_600_000_000


def frame(spark, rows):
    return spark.createDataFrame(rows, "net string, id string, from_account long, to_account long, amount double, us long").withColumn("dt", F.timestamp_micros("us")).drop("us")


def transfers(seed, n, accounts):
    r = random.Random(seed)
    return [(r.choice("ab"), f"e{i:04d}", r.randrange(accounts), r.randrange(accounts if seed % 2 else 3), float(r.choice([50, 80, 90, 120])), r.randrange(60) * HOUR) for i in range(n)]


def brute(rows, k, hours=24, threshold=100.0, lower=75.0):
    out = {}
    for net, to in {(e[0], e[3]) for e in rows}:
        band = sorted((e for e in rows if e[0] == net and e[3] == to and lower <= e[4] < threshold), key=lambda e: (e[5], e[1]))
        for i, e in enumerate(band):
            window = [x for x in band[i:] if x[5] <= e[5] + hours * HOUR]
            if len({x[2] for x in window}) >= k and len(window) >= 3 and sum(x[4] for x in window) >= 1.8 * threshold:
                out[net, to] = (e[5], e[1], len(window), sum(x[4] for x in window), {x[2] for x in window})
                break
    return out


@pytest.mark.parametrize("k, chunk_rows", [(1, 256), (2, 3), (3, 256), (3, 2), (4, 5), (6, 256), (6, 4)])
def test_any_number_of_senders(spark, k, chunk_rows):
    rows = transfers(2, 260, 14)
    want = brute(rows, k)
    assert want
    got = N.fan_in_structuring(frame(spark, rows), 100.0, 75.0, min_senders=k, chunk_rows=chunk_rows).collect()
    assert {(r.net, r.collector): (r.start_us, r.start_id, r.n_edges, r.total_amount) for r in got} == {c: v[:4] for c, v in want.items()}


@pytest.mark.parametrize("seed", [1, 3])
def test_suppression_equals_the_pass_in_order(spark, seed):
    rows = transfers(seed, 500, 25)
    found = brute(rows, 3)
    kept, involved = [], set()
    for (net, collector), v in sorted(found.items(), key=lambda x: (x[1][0], x[1][1], x[0][1])):
        if (net, collector) not in involved:
            kept.append((net, collector))
            involved |= {(net, a) for a in v[4]} | {(net, collector)}
    assert 0 < len(kept) < len(found)
    edges = frame(spark, rows)
    args = dict(threshold=100.0, lower=75.0)
    flags = N.fan_in_structuring(edges, **args)
    got = N.suppress_involved(flags, N.fan_in_members(edges, flags, **args))
    assert sorted((r.net, r.collector) for r in got.collect()) == sorted(kept)
    both = N.typology_flags(edges, dict(args, suppress=True), dict(hours=1), dict(min_amount=1e9))[0].filter("typology = 'structuring'")
    assert both.count() == len(kept)
    assert N.fan_in_structuring(edges.limit(0)).count() == 0
