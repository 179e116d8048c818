"""The warehouse's commit log: conflicts, streamed lines in the reports, replays, retention."""

import os
import threading

import pytest

from tests.test_warehouse_stream import TRANSACTIONS, _drop
from tillroll.operators import kpi, summaries
from tillroll.operators.cleaning import clean_transactions
from tillroll.operators.star import star
from tillroll.sources import commits, warehouse
from tillroll.sources.csv_extracts import read_extract
from tillroll.streaming.ingest import stream_into_warehouse

MORE = TRANSACTIONS.split("\n", 1)[0] + "\n" + "\n".join(
    f"{200 + i},{(10, 20, 11)[i % 3]},2018-02-{i + 1:02d},{1 + i % 3},{i}.25,1,EAST,{5 + i % 4},2018" for i in range(9)) + "\n"


def _put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_streamed_lines_reach_the_reports_once(spark, scratch):
    land, wh, inbox = (os.path.join(scratch, x) for x in ("land", "wh", "inbox"))
    _drop(land)
    warehouse.refresh(spark, land, wh, version="1")
    head, *lines = MORE.strip().split("\n")
    _put(inbox, "a.csv", "\n".join([head, *lines[:4]]) + "\n")
    stream_into_warehouse(spark, inbox, wh, max_files_per_trigger=1).awaitTermination(120)
    _put(inbox, "b.csv", "\n".join([head, *lines[4:]]) + "\n")
    stream_into_warehouse(spark, inbox, wh).awaitTermination(120)
    log = commits.commits(spark, wh)
    assert [(c["kind"], c["transactions"]) for c in log] == [("refresh", 5), ("append", 4), ("append", 5)]
    # a batch that comes again, with its checkpoint lost or not, adds nothing
    again = clean_transactions(read_extract(spark, os.path.join(inbox, "a.csv")))
    assert warehouse.append_lines(spark, again, wh, "lines", log[1]["batch"]) is None
    stream_into_warehouse(spark, inbox, wh).awaitTermination(120)
    got = warehouse.read_current(spark, wh)
    # the same lines in one drop
    whole = os.path.join(scratch, "whole")
    _drop(whole, transactions=TRANSACTIONS + "\n".join(lines) + "\n")
    wh2 = os.path.join(scratch, "wh2")
    warehouse.refresh(spark, whole, wh2, version="1")
    want = warehouse.read_current(spark, wh2)
    assert got.transactions.count() == 14
    assert kpi.kpi_totals(star(got)).collect() == kpi.kpi_totals(star(want)).collect()
    for report in (kpi.dashboard_series, summaries.household_summary):
        assert sorted(map(str, report(star(got)).collect())) == sorted(map(str, report(star(want)).collect()))
    # a replay that died before its commit overwrites its own half-written folder
    folder = os.path.join(wh, "transactions", "stream=lines", "batch=77")
    again.limit(1).write.parquet(folder)
    assert warehouse.append_lines(spark, again, wh, "lines", 77)["transactions"] == 4
    assert warehouse.read_current(spark, wh).transactions.count() == 18


def test_append_needs_a_refresh(spark, scratch):
    land = os.path.join(scratch, "land")
    _drop(land)
    lines = clean_transactions(read_extract(spark, os.path.join(land, "400_transactions.csv")))
    with pytest.raises(FileNotFoundError):
        warehouse.append_lines(spark, lines, os.path.join(scratch, "wh"), "s", 0)


def test_publish_is_put_if_absent(spark, scratch):
    assert commits.publish(spark, scratch, 1, {"kind": "refresh", "version": "a"})["commit"] == 1
    with pytest.raises(commits.CommitConflict):
        commits.publish(spark, scratch, 1, {"kind": "refresh", "version": "b"})
    assert [c["version"] for c in commits.commits(spark, scratch)] == ["a"]
    assert [f for f in os.listdir(os.path.join(scratch, "_manifest")) if f.startswith("_draft")] == []


def test_of_two_refreshes_at_once_one_fails(spark, scratch, monkeypatch):
    land, wh = os.path.join(scratch, "land"), os.path.join(scratch, "wh")
    _drop(land)
    warehouse.refresh(spark, land, wh, version="1")
    both = threading.Barrier(2, timeout=120)
    publish = commits.publish

    def together(*args):
        both.wait()
        return publish(*args)

    monkeypatch.setattr(commits, "publish", together)
    out = {}

    def run(version):
        try:
            out[version] = warehouse.refresh(spark, land, wh, version=version)
        except commits.CommitConflict as e:
            out[version] = e

    threads = [threading.Thread(target=run, args=(v,)) for v in ("2", "3")]
    for t in threads:
        t.start()
    for t in threads:
        t.join(240)
    lost = [v for v in out if isinstance(out[v], commits.CommitConflict)]
    assert len(lost) == 1 and len(out) == 2
    assert warehouse.current_version(spark, wh) == ({"2", "3"} - set(lost)).pop()
    assert warehouse.read_current(spark, wh).transactions.count() == 5


def test_refresh_does_not_hide_an_append(spark, scratch, monkeypatch):
    land, wh = os.path.join(scratch, "land"), os.path.join(scratch, "wh")
    _drop(land)
    warehouse.refresh(spark, land, wh, version="1")
    lines = clean_transactions(read_extract(spark, os.path.join(land, "400_transactions.csv")))
    write = warehouse._write

    def slow(df, path, name, mode="error"):
        if name == "products":      # while the refresh writes, a stream commits
            warehouse.append_lines(spark, lines, wh, "s", 0)
        return write(df, path, name, mode)

    monkeypatch.setattr(warehouse, "_write", slow)
    with pytest.raises(commits.CommitConflict):
        warehouse.refresh(spark, land, wh, version="2")
    monkeypatch.undo()
    assert warehouse.current_version(spark, wh) == "1"
    assert warehouse.read_current(spark, wh).transactions.count() == 10


def test_retention_removes_only_old_folders(spark, scratch):
    land, wh = os.path.join(scratch, "land"), os.path.join(scratch, "wh")
    _drop(land)
    lines = clean_transactions(read_extract(spark, os.path.join(land, "400_transactions.csv")))
    for v in ("1", "2", "3"):
        warehouse.refresh(spark, land, wh, version=v)
        warehouse.append_lines(spark, lines, wh, "s", int(v))
    assert warehouse.retain(spark, wh, versions=3) == []
    gone = warehouse.retain(spark, wh, versions=2)
    assert len(gone) == 5 and all("v=1" in g or "batch=1" in g for g in gone)
    assert sorted(os.listdir(os.path.join(wh, "products"))) == ["v=2", "v=3"]
    assert warehouse.read_current(spark, wh).transactions.count() == 10
    assert warehouse.retain(spark, wh, versions=2) == []
