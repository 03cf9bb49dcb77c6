import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import dates, keys, numbers, text, units


def one_column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [x.out for x in rows.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_cleaners(spark):
    assert one_column(spark, [" acme__b.v. (uk) ", "it's-a test gmbh", None, ""], text.proper_case) == ["Acme B.V. UK".replace(" UK", " (uk"), "It's A Test GMBH", None, ""]
    assert one_column(spark, ["Zürich_Süd.", " A'B-c "], text.facility_key) == ["zürich süd", "ab c"]
    assert one_column(spark, ["1.0", " 12 ", "a.0"], text.line_key) == ["1", "12", "a.0"]
    units_in = ["kWh", "Total kW h used", "kWh/m3", "price per kWh", "MWh and kWh", "tons", "tonnage", None, "rth"]
    assert one_column(spark, units_in, text.energy_unit) == ["KWH", "KWH", "", "KWH", "", "TON", "", None, "RTH"]
    assert one_column(spark, ["cafÃ©", "cafÃƒÂ©", "plain é", "Ã", None], text.mojibake_repaired) == ["café", "café", "plain é", "Ã", None]
    assert one_column(spark, [" ", None, "x", " "], text.is_blank) == [True, True, False, True]


def test_numbers(spark):
    comma = lambda c: numbers.clean_amount(c, F.lit(","))
    assert one_column(spark, ["EUR 1.234,50 €", "", None], comma) == ["1234.50", "", None]
    point = lambda c: numbers.clean_quantity(c, F.lit("."))
    assert one_column(spark, ["-1,234.5 kWh", "none", "7"], point) == ["1234.5", "none", "7"]
    assert one_column(spark, [".5 kWh", "1,,2", "1 , 2 x", "a .5.6"], point) == [".5", "1", "12", ".5"]
    assert one_column(spark, ["1,000.5", "5d", "", "-3", None], numbers.to_number) == [1000.5, None, None, -3.0, None]
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (0.0, 0.0), (None, 1.0), (3.0, -2.0)], "a double, b double")
    got = [x.p for x in rows.select(numbers.percent_difference(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got == [-0.5, float("inf"), 0.0, None, 2.5]


def test_units(spark):
    rows = spark.createDataFrame([(2.0, "MWh"), (1.0, "ton"), (None, "kWh"), (5.0, "mmBTU")], "a double, u string")
    assert [x.k for x in rows.select(units.to_kwh(F.col("a"), F.col("u")).alias("k")).collect()] == [2000.0, 720.0, None, None]
    with pytest.raises(Exception, match="Unsupported energy unit"):
        rows.select(units.to_kwh(F.col("a"), F.col("u"), strict=True)).collect()


DATES = {
    "2024-01-31": dt.date(2024, 1, 31),
    "31/01/2024": dt.date(2024, 1, 31),
    "03/04/2024": dt.date(2024, 3, 4),
    "13 de enero de 2024": dt.date(2024, 1, 13),
    "März 2023": dt.date(2023, 3, 1),
    "March 5, 2023": dt.date(2023, 3, 5),
    "112/05/06": dt.date(2023, 5, 6),
    "5.6.23": dt.date(2023, 5, 6),
    "2023-12-31T23:59:00": dt.date(2024, 1, 1),
    "31/02/2020": None,
    "hello": None,
    "": None,
}


def test_dates(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(DATES)], "i int, raw string")
    got = dates.with_dates(rows, "raw", "d").orderBy("i").collect()
    assert [x.d for x in got] == list(DATES.values())
    assert [x.d_status for x in got][-3:] == ["REVIEW_DATE", "NOT_DATE", "BLANK"]
    assert got[2].d_candidates == [dt.date(2024, 3, 4), dt.date(2024, 4, 3)]


def test_range_choice(spark):
    pairs = [("01/02/2024", "02/03/2024"), ("2024-01-01", "2024-01-31"), ("2024-05-01", "2024-01-01"), ("x", "2024-01-01")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    rows = dates.with_dates(dates.with_dates(rows, "a", "s"), "b", "e")
    got = [x.p for x in dates.with_chosen_range(rows, "s_candidates", "e_candidates", "p").orderBy("i").collect()]
    assert tuple(got[0]) == (dt.date(2024, 2, 1), dt.date(2024, 2, 3))
    assert tuple(got[1]) == (dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    assert got[2:] == [None, None]


def test_keys(spark):
    a, b = one_column(spark, ['{"b": 1, "a": 2.50}', '{"a":2.5,"b":1}'], keys.content_hash)
    assert a == b
    assert one_column(spark, ["31/12/2024", "2024-12-31", "04/05/24", "x"], keys.key_date) == ["2024-12-31", "2024-12-31", "2024-05-04", "x"]
    assert one_column(spark, ["1.234,5", "1,234.5", "1,234", "12,5"], keys.key_number) == ["1234.5", "1234.5", "1234", "12.5"]
