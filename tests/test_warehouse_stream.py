"""Refresh protocol (atomic version switch) and exactly-once stream ingest."""

import os

import pytest

from tillroll.operators.cleaning import clean_transactions
from tillroll.sources import warehouse
from tillroll.sources.csv_extracts import read_extract
from tillroll.streaming.ingest import ingest_stream
from tests.test_cleaning import HOUSEHOLDS as _HH
from tests.test_cleaning import PRODUCTS, TRANSACTIONS

HOUSEHOLDS = _HH.replace("10.7,", "11.7,")  # keys must be unique for a refresh


def _drop(folder, households=HOUSEHOLDS, products=PRODUCTS, transactions=TRANSACTIONS):
    os.makedirs(folder, exist_ok=True)
    for name, text in (("400_households.csv", households), ("400_products.csv", products),
                       ("400_transactions.csv", transactions)):
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    return folder


def test_refresh_round_trip_and_replace(spark, scratch):
    land = _drop(os.path.join(scratch, "land"))
    wh = os.path.join(scratch, "wh")
    first = warehouse.refresh(spark, land, wh, version="1")
    assert first["households"] == 3 and first["products"] == 3 and first["transactions"] == 5
    t = warehouse.read_current(spark, wh)
    assert t.transactions.count() == 5
    # a second drop replaces the first one as a whole
    land2 = _drop(os.path.join(scratch, "land2"),
                  transactions=TRANSACTIONS.split("\n", 2)[0] + "\n" + TRANSACTIONS.split("\n")[1] + "\n")
    warehouse.refresh(spark, land2, wh, version="2")
    assert warehouse.current_version(spark, wh) == "2"
    assert warehouse.read_current(spark, wh).transactions.count() == 1


def test_failed_refresh_keeps_previous_version(spark, scratch):
    land = _drop(os.path.join(scratch, "land"))
    wh = os.path.join(scratch, "wh")
    warehouse.refresh(spark, land, wh, version="1")
    dup = PRODUCTS + "1,FOOD,DAIRY,PRIVATE,N\n"
    bad = _drop(os.path.join(scratch, "bad"), products=dup)
    with pytest.raises(warehouse.DuplicateKeyError):
        warehouse.refresh(spark, bad, wh, version="2")
    assert warehouse.current_version(spark, wh) == "1"
    assert not os.path.exists(os.path.join(wh, "products", "v=2"))


def test_stream_ingest_equals_batch_and_is_exactly_once(spark, scratch):
    land = os.path.join(scratch, "stream_in")
    os.makedirs(land)
    header, *lines = [ln for ln in TRANSACTIONS.split("\n") if ln]
    for i, chunk in enumerate((lines[:2], lines[2:])):
        with open(os.path.join(land, f"drop_{i}.csv"), "w") as f:
            f.write("\n".join([header, *chunk]) + "\n")
    out = os.path.join(scratch, "stream_out")
    ckpt = os.path.join(scratch, "stream_ckpt")
    q = ingest_stream(spark, land, out, checkpoint=ckpt, max_files_per_trigger=1)
    q.awaitTermination(120)
    got = spark.read.parquet(out).drop("batch")
    batch = clean_transactions(read_extract(spark, land))
    assert got.count() == 5
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
    # rerun over the same folder: nothing new
    q2 = ingest_stream(spark, land, out, checkpoint=ckpt)
    q2.awaitTermination(120)
    assert spark.read.parquet(out).count() == 5
    # a new delivery under a new name is picked up
    with open(os.path.join(land, "drop_2.csv"), "w") as f:
        f.write("\n".join([header, lines[0]]) + "\n")
    q3 = ingest_stream(spark, land, out, checkpoint=ckpt)
    q3.awaitTermination(120)
    assert spark.read.parquet(out).count() == 6


def test_default_stream_checkpoint_is_stable(spark, scratch):
    from tillroll.session import scratch_path
    assert scratch_path(spark, "ingest_stream/x") == scratch_path(spark, "ingest_stream/x")
    land = os.path.join(scratch, "in")
    os.makedirs(land)
    header, *lines = [ln for ln in TRANSACTIONS.split("\n") if ln]
    with open(os.path.join(land, "a.csv"), "w") as f:
        f.write("\n".join([header, *lines]) + "\n")
    out = os.path.join(scratch, "out")
    ingest_stream(spark, land, out).awaitTermination(120)
    ingest_stream(spark, land, out).awaitTermination(120)  # same default checkpoint: no rerun
    assert spark.read.parquet(out).count() == 5


def test_warehouse_layout_enables_skipping(spark, scratch):
    import glob

    import pyarrow.parquet as pq

    from tests.conftest import SF_SMALL
    from tillroll.operators import kpi, pull
    from tillroll.operators.star import star
    from tillroll.sources import fixture

    wh = os.path.join(scratch, "wh")
    src = fixture.load(spark, SF_SMALL)
    info = warehouse.write_version(spark, src, wh, version="7", line_files=4)
    assert info["transactions"] == src.transactions.count()
    ranges = []
    for f in glob.glob(os.path.join(wh, "transactions", "v=7", "*.parquet")):
        meta = pq.ParquetFile(f).metadata
        col = [meta.schema.column(i).name for i in range(meta.num_columns)].index("hshd_num")
        for g in range(meta.num_row_groups):
            st = meta.row_group(g).column(col).statistics
            ranges.append((st.min, st.max))
    ranges.sort()
    assert len(ranges) > 1
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))  # disjoint key ranges
    t = warehouse.read_current(spark, wh)
    plan = pull.data_pull(t, 10, 100)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(hshd_num,10)" in plan
    assert kpi.kpi_totals(star(t)).first() == kpi.kpi_totals(star(src)).first()
    assert sorted(pull.data_pull(t, 10, 100).collect()) == sorted(pull.data_pull(src, 10, 100).collect())
