"""Cleaning of hand-written raw extracts (the cases the fixtures lack)."""

import datetime as dt
import os

from tillroll.operators.cleaning import clean_households, clean_products, clean_transactions
from tillroll.sources.csv_extracts import read_extract

HOUSEHOLDS = (
    " hshd_num , l ,Age_Range,MARITAL,INCOME_RANGE,HOMEOWNER,HSHD_COMPOSITION,HH_SIZE,CHILDREN\n"
    "10, Y ,45-54,Married ,  35-49K ,Homeowner,2 Adults,2,1\n"
    "abc,N,19-24,Single,,Renter,1 Adult,1,NA\n"
    ",N,19-24,Single,50-74K,Renter,1 Adult,1,\n"
    "10.7,Y,25-34,null ,   ,Unknown,2 Adults,3,2\n"
    "20,N,65+,Married,100-150K,Homeowner,2 Adults,2,null\n"
)

PRODUCTS = (
    "PRODUCT_NUM,DEPARTMENT,COMMODITY,BRAND_TY,NATURAL_ORGANIC_FLAG\n"
    "1,FOOD ,DAIRY,PRIVATE,N\n"
    "2,FOOD,PRODUCE,NATIONAL,\n"
    "3,NON-FOOD,NA,NATIONAL,Y\n"
)

TRANSACTIONS = (
    "BASKET_NUM,HSHD_NUM,PURCHASE_,PRODUCT_NUM,SPEND,UNITS,STORE_R,WEEK_NUM,YEAR\n"
    "100,10,13-JAN-18,1,2.50,1,EAST ,2,2018\n"
    "100,10,2018-01-13,2,,2,EAST,2,2018\n"
    "101,20,junk,3,NaN,1,WEST,3,2018\n"
    "102,20,01/20/2018,1,4.00,x,WEST,4,2018\n"
    "103,20,13-jan-95,1,1.00,1,WEST,4,1995\n"
)


def _write(folder, name, text):
    p = os.path.join(folder, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_households(spark, scratch):
    df = clean_households(read_extract(spark, _write(scratch, "h.csv", HOUSEHOLDS)))
    rows = {r["hshd_num"]: r for r in df.collect()}
    # 'abc' and empty keys dropped, '10.7' -> 10 (a second household 10)
    assert sorted(r["hshd_num"] for r in df.collect()) == [10, 10, 20]
    r10 = [r for r in df.collect() if r["age_range"] == "45-54"][0]
    assert r10["loyalty_flag"] == "Y"
    assert r10["marital_status"] == "Married"
    assert r10["income_range"] == "35-49K"
    r107 = [r for r in df.collect() if r["age_range"] == "25-34"][0]
    assert r107["hshd_num"] == 10
    assert r107["marital_status"] == "null"  # padded token survives, then is trimmed
    assert r107["income_range"] == ""  # blank -> '' (not NULL)
    assert rows[20]["children"] is None  # exact token 'null' -> NULL
    assert df.schema["hshd_num"].dataType.simpleString() == "bigint"


def test_products_keep_text_as_is(spark, scratch):
    df = clean_products(read_extract(spark, _write(scratch, "p.csv", PRODUCTS)))
    rows = {r["product_num"]: r for r in df.collect()}
    assert rows[1]["department"] == "FOOD "  # products are not stripped
    assert rows[2]["natural_organic_flag"] is None
    assert rows[3]["commodity"] is None


def test_transactions(spark, scratch):
    df = clean_transactions(read_extract(spark, _write(scratch, "t.csv", TRANSACTIONS)))
    rows = sorted(df.collect(), key=lambda r: (r["basket_num"], r["product_num"]))
    assert rows[0]["purchase_date"] == dt.date(2018, 1, 13)
    assert rows[1]["purchase_date"] == dt.date(2018, 1, 13)
    assert rows[1]["spend"] is None
    assert rows[2]["purchase_date"] is None and rows[2]["spend"] is None
    assert rows[3]["purchase_date"] == dt.date(2018, 1, 20)
    assert rows[3]["units"] is None
    assert rows[4]["purchase_date"] == dt.date(1995, 1, 13)  # two-digit year pivot
    assert rows[0]["store_r"] == "EAST "
    assert df.schema["week_num"].dataType.simpleString() == "int"


def test_real_file_inputs(spark, scratch):
    """Doubled quotes, a trailing backslash, exact long keys, suffixes, over-long weeks, dates, wide blanks."""
    from tillroll.functions.cleaning import clean_text, coerce_key, parse_date, to_number
    from tillroll.sources.csv_extracts import read_extract

    path = f"{scratch}/p.csv"
    with open(path, "w") as f:
        f.write('A,B,C\n1,"6"" TORTILLA, CORN",x\n2,"A\\",y\n')
    rows = [tuple(r) for r in read_extract(spark, path).select("A", "B", "C").collect()]
    assert rows == [("1", '6" TORTILLA, CORN', "x"), ("2", "A\\", "y")]
    v = ["9007199254740993", "1234567890123456789", "10.7", "10d", "7F", "0x1p3", "3000000000", "abc", "99999999999999999999"]
    df = spark.createDataFrame([(x,) for x in v], "v string")
    got = df.select(coerce_key(df.v).alias("k"), to_number(df.v, "int").alias("i")).collect()
    assert [r["k"] for r in got] == [9007199254740993, 1234567890123456789, 10, None, None, None, 3000000000, None, None]
    assert [r["i"] for r in got][2] == 10 and got[6]["i"] is None
    d = ["3-JAN-18", "1/3/18", "2018-1-3", "2018-01-03T00:00:00", "20180103"]
    df = spark.createDataFrame([(x,) for x in d], "v string")
    assert {str(r[0]) for r in df.select(parse_date(df.v)).collect()} == {"2018-01-03"}
    df = spark.createDataFrame([("\u00a0\u2003x\u00a0",)], "v string")
    assert df.select(clean_text(df.v)).first()[0] == "x"


def test_dates_equal_a_plain_parser(spark):
    """Accepted layouts, told apart by their shape; text one edit away from them mostly parses as nothing."""
    import random
    import re

    from tillroll.functions.cleaning import parse_date

    layouts = (("%d-%b-%y", r"\d{1,2}-[A-Za-z]{3}-\d{2}"), ("%d-%b-%Y", r"\d{1,2}-[A-Za-z]{3}-\d{4}"),
               ("%Y-%m-%d", r"\d{4}-\d{1,2}-\d{1,2}"), ("%Y%m%d", r"\d{8}"),
               ("%Y-%m-%dT%H:%M:%S", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"),
               ("%Y-%m-%d %H:%M:%S", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"),
               ("%m/%d/%y", r"\d{1,2}/\d{1,2}/\d{2}"), ("%m/%d/%Y", r"\d{1,2}/\d{1,2}/\d{4}"),
               ("%Y/%m/%d", r"\d{4}/\d{1,2}/\d{1,2}"))

    def plain(text):
        text = text.strip()
        for layout, shape in layouts:
            if re.fullmatch(shape, text, re.A):
                try:
                    return dt.datetime.strptime(text, layout).date()
                except ValueError:
                    return None

    rng = random.Random(3)
    good = ["13-JAN-18", "3-jan-95", "03-Jan-1995", "2018-1-3", "2018-01-03T00:00:00", "2018-01-03 10:11:12", "20180103",
            "1/3/18", "01/20/2018", "2018/01/03", " 2018-01-03 ", "\t1/3/18 ", "29-FEB-00", "13-OCT-69"]
    texts = good + ["", "junk", "2018-01-03T25:00:00", "20181303", "2018-01-", "1-FOO-18", "1-ANF-18", "+018-01-3", "1/3/2018/"]
    for _ in range(3_000):
        t = list(rng.choice(good))
        for _ in range(rng.randrange(1, 3)):
            t[rng.randrange(len(t))] = rng.choice("0123456789-/ TJANFEBMAR:")
        texts.append("".join(t))
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for r in df.select("v", parse_date(df.v).alias("d")).collect():
        assert r["d"] == plain(r["v"]), r["v"]
    assert all(plain(t) for t in good)
