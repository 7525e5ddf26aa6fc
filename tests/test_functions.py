from pyspark.sql import functions as F

from shelfwright.functions import text as ft
from shelfwright.functions import units as fu


def values(spark, column, inputs):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r.y for r in df.select("k", column(F.col("x")).alias("y")).orderBy("k").collect()]


def test_fractions(spark):
    assert values(spark, fu.decimal_to_fraction, ["0.5", "0.25", "50.25", "0.015625", "24.5", "3.0", "0.375", "0.3333", "nan", "x", None]) == ["1/2", "1/4", "50-1/4", "1/64", "24-1/2", "3", "3/8", None, None, None, None]
    assert values(spark, fu.fraction_to_decimal, ["50-1/4", "1/2", "3", "2 1/2", "-1/2", "1/0", "", None]) == [50.25, 0.5, 3.0, 2.5, -0.5, None, None, None]
    assert fu.decimal_fraction_table(spark).count() == 63


def test_round_trip_of_all_64ths(spark):
    table = fu.decimal_fraction_table(spark)
    assert table.where(fu.fraction_to_decimal(F.col("fraction")) != F.col("value")).count() == 0


def test_glued_units(spark):
    assert values(spark, fu.fix_spacing_in_text, ["24in", "50-1/4IN", "120V", "15amps", "47dBA", "80G", "use 24in wide"]) == ["24 in", "50-1/4 in", "120 V", "15 A", "47 dBA", "80G", "use 24 in wide"]
    assert values(spark, fu.convert_decimals_in_text, ["50.25 in W x 24.5 in D", "0.3333 in", "1.5 kg"]) == ["50-1/4 in W x 24-1/2 in D", "0.3333 in", "1.5 kg"]


def test_keys(spark):
    assert values(spark, ft.mpn_key, ["DW-AD-511-M8", "dw ad 511 m8", "00123", "A100", "A0100", None]) == ["DWAD511M8", "DWAD511M8", "123", "A100", "A100", ""]
    assert values(spark, ft.brand_key, ["Turck Inc.", "TURCK INC", "Acme Products Co Ltd", "Inc", None]) == ["turck", "turck", "acme", "", ""]
    assert values(spark, ft.is_placeholder, ["-- Unbranded --", "", None, "Moen"]) == [True, True, True, False]


def test_abbreviations(spark):
    assert values(spark, ft.expand_abbreviations, ["3/8 CPLG BRS 150#", "SWEAT", None]) == ["3/8 coupling brass 150#", "SWEAT", ""]
    assert values(spark, ft.tokens, ["The long Ball Valve 3x"]) == [["ball", "valve"]]
