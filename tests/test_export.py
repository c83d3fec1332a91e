"""Queries over small event tables written here: the network export and round trips longer than a day."""

import glob
from datetime import datetime, timedelta

from cashtrail import catalog
from cashtrail.catalog import sources as C

START = datetime(2024, 1, 1)


def events(spark, folder, rows):
    """``rows``: (hour, sender, receiver below 100)."""
    made = [(i, START + timedelta(hours=h), a, "click", 100.0, f'{{"k": {b}}}') for i, (h, a, b) in enumerate(rows)]
    df = spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_round_trips_of_up_to_three_days_are_found(spark, tmp_path):
    sf = events(spark, tmp_path, [(0, 1, 2), (30, 2, 3), (60, 3, 1), (0, 4, 5), (40, 5, 6), (73, 6, 4)])
    assert [r.nodes for r in catalog.QUERIES["E2"](spark, sf).collect()] == ["1,2,3"]


def test_network_is_exported_with_its_metadata(spark, tmp_path, monkeypatch):
    sf = events(spark, tmp_path / "in", [(0, 1, 2), (1, 2, 3), (2, 3, 1), (3, 1, 1), (4, 7, 8)])
    monkeypatch.setattr(C, "new_path", lambda spark, name: str(tmp_path / name))
    got = catalog.QUERIES["A13"](spark, sf).first()
    read = lambda name: spark.read.json(str(tmp_path / "network-export" / name))
    assert glob.glob(str(tmp_path / "network-export" / "metadata" / "*.json"))
    assert sorted(r.account_id for r in read("nodes").collect()) == [1, 2, 3, 7, 8]
    assert sorted((r.from_account, r.to_account) for r in read("edges").collect()) == [(1, 2), (2, 3), (3, 1), (7, 8)]
    flags = {r.flag_key: (r.involved_accounts, r.evidence) for r in read("flags").collect()}
    assert flags["round_tripping:1>2>3"] == (["1", "2", "3"], ["0", "1", "2"])
    assert (got.total_nodes, got.total_edges, got.typology_count) == (5, 4, 1)


def test_ledger_export_is_packed_and_goes_once_it_is_parsed(spark, tmp_path, monkeypatch):
    made = [(i, 1 + i % 3, 10 * (i % 2), 1 + i % 4, 5.0, 9_000.0 + i, "RA"[i % 2], START + timedelta(days=i)) for i in range(40)]
    cols = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz"
    spark.createDataFrame(made, cols).write.parquet(str(tmp_path / "in" / "lineitem.parquet"))
    monkeypatch.setattr(C, "new_path", lambda spark, name: str(tmp_path / name))
    packed = []
    scan = C.S.scan_ledger
    monkeypatch.setattr(C.S, "scan_ledger", lambda *a, **k: packed.append(glob.glob(f"{a[1]}/*.csv.gz")) or scan(*a, **k))
    got = catalog.QUERIES["A4"](spark, str(tmp_path / "in")).groupBy("scan").count().collect()
    assert {r.scan: r["count"] for r in got} == {"miss": 40, "hit": 40, "forced": 40}
    assert packed[0] and packed[2] and not (tmp_path / "ledger").exists()
