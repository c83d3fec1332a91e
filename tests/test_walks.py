"""Walk summaries equal the walks themselves, network by network."""

import random

import pytest
from pyspark.sql import functions as F

from cashtrail.operators import typology as N

HOUR = 3_600_000_000


def steps_of(rows, net, seed, depth):
    """Breadth-first walk over one network, edges in (time, id) order."""
    seen, queue, out = {seed}, [(seed, 0)], []
    while queue:
        at, level = queue.pop(0)
        if level < depth:
            for e in sorted((e for e in rows if e[0] == net and e[2] == at), key=lambda e: (e[5], e[1])):
                out.append(e)
                if e[3] not in seen:
                    seen.add(e[3])
                    queue.append((e[3], level + 1))
    return out


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_summary_equals_walk(spark, depth):
    r = random.Random(depth)
    rows = [(r.choice("ab"), f"e{i:03d}", r.randrange(12), 12 + r.randrange(4) if r.random() < 0.2 else r.randrange(12), float(r.randrange(1, 50)), r.randrange(9) * HOUR)
            for i in range(80)]
    edges = spark.createDataFrame(rows, "net string, id string, from_account long, to_account long, amount double, us long").withColumn("dt", F.timestamp_micros("us")).drop("us")
    seeds = spark.createDataFrame([(n, a, a) for n in "ab" for a in range(17)], "net string, walk_id long, account long")
    got = {(x.net, x.walk_id): x for x in N.walk_summary(edges, seeds, depth).collect()}
    assert len(got) == 34
    walked = {}
    for x in N.network_walk(edges, seeds, depth).orderBy("step_index").collect():
        walked.setdefault((x.net, x.walk_id), []).append(x.id)
    for (net, seed), x in got.items():
        want = steps_of(rows, net, seed, depth)
        assert walked.get((net, seed), []) == [e[1] for e in want]
        assert x.hop_count == len(want)
        if want:
            assert (x.head.from_account, x.head.amount, x.tail.to_account, x.tail.amount) == (want[0][2], want[0][4], want[-1][3], want[-1][4])
    risks = {(x.net, x.walk_id): x for x in N.network_walk_risk(N.walk_summary(edges, seeds, depth)).collect()}
    assert risks["a", 16].risk_score == 0.50 and risks["a", 16].start_account is None
