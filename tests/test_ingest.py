"""Extracts mapped by name, malformed records, counts of what was rejected, the quarantine table."""

import gzip
import os

import pytest

from tests.test_warehouse_stream import HOUSEHOLDS, PRODUCTS, TRANSACTIONS, _drop
from tillroll.operators import cleaning
from tillroll.sources import commits, warehouse
from tillroll.sources.csv_extracts import header_of, headers, read_extract
from tillroll.streaming.ingest import stream_into_warehouse


def _put(folder, files):
    for name, text in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with (gzip.open if name.endswith(".gz") else open)(path, "wt", encoding="utf-8") as f:
            f.write(text)
    return folder


def _products(spark, path):
    return sorted(map(tuple, cleaning.kept(cleaning.checked(read_extract(spark, path), "products"), "products")
                      .collect()), key=str)


def test_files_are_mapped_by_their_own_headers(spark, scratch):
    land = _put(os.path.join(scratch, "p"), {
        "a.csv": "PRODUCT_NUM,DEPARTMENT,COMMODITY,BRAND_TY,NATURAL_ORGANIC_FLAG\n1,FOOD,\"a, \"\"b\"\"\",X,N\n",
        "deep/b.csv": "﻿ natural_organic_flag ,Brand_Ty,extra,COMMODITY,DEPARTMENT,product_num\nY,Z,?,C,D,2\n",
        "c.csv.gz": "BRAND_TY,PRODUCT_NUM,COMMODITY,DEPARTMENT,NATURAL_ORGANIC_FLAG\nW,3,E,F,NA\n",
        "empty.csv": "", "_SUCCESS": "x", "only_header.csv": "PRODUCT_NUM,DEPARTMENT,COMMODITY,BRAND_TY,NATURAL_ORGANIC_FLAG\n"})
    assert _products(spark, land) == [(1, "FOOD", 'a, "b"', "X", "N"), (2, "D", "C", "Z", "Y"), (3, "F", "E", "W", None)]
    assert len(headers(spark, land)) == 5
    assert "EXTRA" in header_of(spark, land)
    with pytest.raises(ValueError, match="lacks columns"):
        cleaning.clean_products(read_extract(spark, _put(os.path.join(scratch, "q"), {"a.csv": "PRODUCT_NUM,X\n1,2\n"})))
    with pytest.raises(ValueError, match="repeats a column"):
        read_extract(spark, _put(os.path.join(scratch, "r"), {"a.csv": "PRODUCT_NUM, product_num\n1,2\n"}))
    with pytest.raises(FileNotFoundError):
        read_extract(spark, _put(os.path.join(scratch, "s"), {"a.csv": ""}))


def test_long_records_are_malformed_and_short_ones_lack_fields(spark, scratch):
    land = _put(scratch, {"a.csv": "PRODUCT_NUM,DEPARTMENT,COMMODITY,BRAND_TY,NATURAL_ORGANIC_FLAG\n"
                                   "1,FOOD\n2,a,b,c,d,e\n3,\"x,y\",b,c,d\n4,\"p\"\"q,r\",b,c,d,\n"})
    rows = cleaning.checked(read_extract(spark, land), "products")
    assert {r["product_num"] for r in cleaning.kept(rows, "products").collect()} == {1, 3}
    bad = {r["record"] for r in cleaning.rejected(rows, "products").where("reason = 'malformed'").collect()}
    assert bad == {"2,a,b,c,d,e", '4,"p""q,r",b,c,d,'}


def test_refresh_counts_and_quarantines(spark, scratch):
    land, wh = os.path.join(scratch, "land"), os.path.join(scratch, "wh")
    _drop(land, households=HOUSEHOLDS + "30,Y,a,b,c,d,e,f,g,too,many\n",
          transactions=TRANSACTIONS + "x1,10,13-JAN-18,1,2.50,1,EAST ,2,2018\n")
    info = warehouse.refresh(spark, land, wh, version="1")
    assert info["households"] == 3 and info["transactions"] == 6
    seen = commits.commits(spark, wh)[0]["ingested"]
    assert seen["households"] == {"rows": 6, "malformed": 1, "bad_key": 2, "bad_date": 0}
    assert seen["products"] == {"rows": 3, "malformed": 0, "bad_key": 0, "bad_date": 0}
    assert seen["transactions"] == {"rows": 6, "malformed": 0, "bad_key": 1, "bad_date": 1}
    rows = warehouse.quarantine(spark, wh).collect()
    assert sorted((r["source"], r["reason"], r["kept"]) for r in rows) == [
        ("households", "bad_key", False), ("households", "bad_key", False), ("households", "malformed", False),
        ("transactions", "bad_date", True), ("transactions", "bad_key", True)]
    assert all(r["file"].endswith(".csv") and r["record"] for r in rows)
    assert any('"PURCHASE_":"junk"' in r["record"] for r in rows)
    assert not os.path.exists(os.path.join(wh, "_staging", "1"))


def test_streamed_files_of_any_column_order(spark, scratch):
    land, wh, inbox = (os.path.join(scratch, x) for x in ("land", "wh", "inbox"))
    _drop(land)
    warehouse.refresh(spark, land, wh, version="1")
    _put(inbox, {"a.csv": "YEAR,WEEK_NUM,STORE_R,UNITS,SPEND,PRODUCT_NUM,PURCHASE_,HSHD_NUM,BASKET_NUM\n"
                          "2018,9,EAST,1,3.25,1,2018-03-01,10,900\n2018,9,EAST,1,1,1,someday,10,901\n1,2,3,4,5,6,7,8,9,10\n",
                 "b.csv": TRANSACTIONS})
    stream_into_warehouse(spark, inbox, wh).awaitTermination(120)
    got = warehouse.read_current(spark, wh).transactions
    assert got.count() == 12
    r = got.where("basket_num = 900").first()
    assert (r["hshd_num"], r["spend"], str(r["purchase_date"]), r["week_num"]) == (10, 3.25, "2018-03-01", 9)
    assert commits.commits(spark, wh)[1]["ingested"]["transactions"] == {
        "rows": 8, "malformed": 1, "bad_key": 0, "bad_date": 2}
    assert warehouse.quarantine(spark, wh).where("source = 'transactions'").count() == 4


def test_products_without_rows(spark, scratch):
    head = PRODUCTS.split("\n")[0] + "\n"
    land, wh = os.path.join(scratch, "land"), os.path.join(scratch, "wh")
    _drop(land, products=head, households=HOUSEHOLDS.split("\n")[0] + "\n", transactions=TRANSACTIONS.split("\n")[0] + "\n")
    assert warehouse.refresh(spark, land, wh, version="1")["transactions"] == 0
    assert warehouse.quarantine(spark, wh).count() == 0
