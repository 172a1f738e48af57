import datetime as dt

import pytest
from pyspark.sql import functions as F

from galewright.operators.timestamps import days_from_civil, with_instant


def utc(*x):
    return int(dt.datetime(*x, tzinfo=dt.timezone.utc).timestamp())


CASES = {
    "2017-02-28T07:04:44+01:00": utc(2017, 2, 28, 6, 4, 44),
    "  2017-02-28T07:04:44+01:00\t": utc(2017, 2, 28, 6, 4, 44),
    "2017-02-28T22:46:24-04:00": utc(2017, 3, 1, 2, 46, 24),
    "28.02.2017 06:44:52": utc(2017, 2, 28, 5, 44, 52),
    "28/02/2017 06:25:00": utc(2017, 2, 28, 5, 25, 0),
    "03/01/2017 4:55:56 AM": utc(2017, 3, 1, 3, 55, 56),
    "02/28/2017 12:52:24 PM": utc(2017, 2, 28, 11, 52, 24),
    "03/16/2017 12:22:28 AM": utc(2017, 3, 15, 23, 22, 28),
    "2017-03-01t13:22:08z": utc(2017, 3, 1, 13, 22, 8),
    "2017-03-01T13:22:08.999Z": utc(2017, 3, 1, 13, 22, 8),
    "2017-03-01 13:42:00 UTC": utc(2017, 3, 1, 13, 42, 0),
    "20170301T123252+0100": utc(2017, 3, 1, 11, 32, 52),
    "2017-03-05T15:33+01:00": utc(2017, 3, 5, 14, 33),
    "1488283936": 1488283936,
    "1488422208999": 1488422208,
    "26-Mar-2017 05:24:32 CEST": utc(2017, 3, 26, 3, 24, 32),
    "28-Feb-2017 18:20:12 CET": utc(2017, 2, 28, 17, 20, 12),
    "2020-02-29 00:00:00": utc(2020, 2, 28, 23, 0, 0),
    "2017-07-01 12:00:00": utc(2017, 7, 1, 10, 0, 0),
    "2019-02-29 00:00:00": None, "2017-13-01 00:00:00": None, "2017-01-01 25:00:00": None, "2017-01-01 10:61:00": None, "0000-00-00 00:00:00": None,
    "13/02/2017 13:00:00 PM": None, "32.01.2017 00:00:00": None, "not set": None, "N/A": None, "": None, "2017-03-26 02:30:00": None, "2017-01-01": None, "12": None, "x" * 50_000: None,
}


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_formats(spark, session_zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        df = spark.createDataFrame([(k, v) for k, v in CASES.items()], "s string, want long")
        got = with_instant(df, "s", "got").where("NOT got <=> want").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == []


def test_repeated_hour_takes_the_later_instant_that_has_arrived(spark):
    rows = [("2017-10-29 02:30:00", "2017-10-29 00:40:00", utc(2017, 10, 29, 0, 30)), ("2017-10-29 02:30:00", "2017-10-29 01:31:00", utc(2017, 10, 29, 1, 30)),
            ("2017-10-29 02:30:00", "2017-10-29 01:30:00", utc(2017, 10, 29, 1, 30)), ("2017-10-29 02:30:00", None, utc(2017, 10, 29, 0, 30)),
            ("29-Oct-2017 02:30:00 CET", "2017-10-29 00:40:00", utc(2017, 10, 29, 1, 30))]
    df = spark.createDataFrame(rows, "s string, r string, want long").withColumn("r", F.to_timestamp_ntz("r"))
    assert with_instant(df, "s", "got", received="r").where("NOT got <=> want").count() == 0


def test_other_zones_null_columns_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "2021-03-14 02:30:00"), (2, "2021-03-14 03:30:00"), (3, None)], "utc_s int, s string")
    got = {r["s"]: r["utc_s"] for r in with_instant(df, "s", "utc_s", zone="America/New_York").collect()}
    assert got == {"2021-03-14 02:30:00": None, "2021-03-14 03:30:00": utc(2021, 3, 14, 7, 30), None: None}
    assert with_instant(df.where("false"), "s", "utc_s").collect() == []


def test_day_arithmetic(spark):
    days = spark.range(-200_000, 200_000, 97).select(F.date_add(F.lit("1970-01-01"), F.col("id").cast("int")).alias("d"), "id")
    days = days.where("year(d) >= 1").select("id", F.year("d").cast("long").alias("y"), F.month("d").cast("long").alias("m"), F.dayofmonth("d").cast("long").alias("k"))
    assert days.where(F.expr(days_from_civil("y", "m", "k")) != F.col("id")).count() == 0
