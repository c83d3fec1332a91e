"""Round trips against an enumeration of all time-ordered cycles, and with a hub."""

import random

import pytest
from pyspark.sql import functions as F

from cashtrail.operators import typology as N

HOUR = 3_600_000_000
SCHEMA = "net string, id string, from_account long, to_account long, amount double, us long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("dt", F.timestamp_micros("us")).drop("us")


def brute(rows, max_nodes, retention, hours):
    best = {}
    span = int(hours * HOUR)

    def walk(net, path):
        first, last = path[0], path[-1]
        nodes = [e[2] for e in path]
        if last[3] == first[2]:
            if len(path) >= 3 and last[4] / max(1.0, first[4]) >= retention:
                got = (first[5], [e[1] for e in path], nodes, last[5], last[4] / max(1.0, first[4]))
                key = (net, tuple(sorted(nodes)))
                best[key] = min(best.get(key, got), got)
            return
        if len(path) == max_nodes or last[3] in nodes:
            return
        for e in rows:
            if e[0] == net and e[2] == last[3] and last[5] <= e[5] <= first[5] + span:
                walk(net, [*path, e])

    for e in rows:
        if e[2] != e[3]:
            walk(e[0], [e])
    return {(k[0], tuple(v[2]), tuple(v[1]), v[0], v[3], round(v[4], 9)) for k, v in best.items()}


def found(df):
    us = lambda t: F.unix_micros(t)
    return {(r[0], tuple(r[1]), tuple(r[2]), r[3], r[4], round(r[5], 9)) for r in df.select(
        "net", "nodes", "edge_ids", us("window_start"), us("window_end"), "retention").collect()}


@pytest.mark.parametrize("seed, max_nodes", [(1, 5), (2, 4), (3, 3), (4, 5)])
def test_equals_enumeration(spark, seed, max_nodes):
    r = random.Random(seed)
    rows = []
    for i in range(150):
        net, steps = r.choice("ab"), (6 if seed == 2 else 60)           # few distinct times: many ties
        rows.append((net, f"e{i:03d}", r.randrange(7), r.randrange(7), float(r.choice([0.5, 10, 11, 12, 20])), r.randrange(steps) * HOUR))
    want = brute(rows, max_nodes, 0.85, 10)
    assert want
    assert found(N.round_trips(frame(spark, rows), max_nodes, 0.85, 10)) == want


def test_no_edges_and_no_cycles(spark):
    assert N.round_trips(frame(spark, [])).count() == 0
    assert N.round_trips(frame(spark, [("a", "1", 1, 1, 5.0, 0), ("a", "2", 1, 2, 5.0, 1)])).count() == 0


def test_hub_stays_small(spark, monkeypatch):
    """10,000 edges into and out of one account, whose partners also trade among each other."""
    r, n, hub = random.Random(9), 10_000, 0
    rows = [("a", f"i{k}", 1 + k % 4_000, hub, 100.0, r.randrange(20 * HOUR)) for k in range(n)]
    rows += [("a", f"o{k}", hub, 1 + k % 4_000, 100.0, r.randrange(20 * HOUR)) for k in range(n)]
    rows += [("a", f"s{k}", 1 + r.randrange(4_000), 1 + r.randrange(4_000), 100.0, r.randrange(20 * HOUR)) for k in range(4_000)]
    sizes = []
    plain = N.written

    def counted(df, name="cut"):
        got = plain(df, name)
        if name == "half":
            sizes.append(got.count())
        return got

    monkeypatch.setattr(N, "written", counted)
    got = N.round_trips(frame(spark, rows), hours=24).count()
    assert got > 1_000 and sum(sizes) <= 10 * len(rows), (got, sizes)


def test_copies_stay_few(spark, monkeypatch):
    """Edges that all may lie on cycles are trimmed once, and a join gets fewer than 2.5 copies of a half."""
    r = random.Random(4)
    rows = [("a", f"e{k:04d}", r.randrange(40), r.randrange(40), 100.0, r.randrange(200 * HOUR)) for k in range(2_000)]
    names, copies, plain = [], [], N.written
    monkeypatch.setattr(N, "written", lambda df, name="cut": names.append(name) or plain(df, name))
    cls = type(spark.range(1))
    with_column = cls.withColumn

    def counted(df, name, column):
        got = with_column(df, name, column)
        if name == "bucket" and "times" in df.columns:
            copies.append((df.count(), got.count()))
        return got

    monkeypatch.setattr(cls, "withColumn", counted)
    N.round_trips(frame(spark, rows), 5, 0.85, 10)
    assert names.count("trimmed") == 2
    assert all(after < 2.5 * before for before, after in copies) and sum(a for _, a in copies) > sum(b for b, _ in copies)
