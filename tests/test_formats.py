"""Format models: known texts, round trips, error defaults."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.functions import formats as f


def chars(spark, make, values, kind):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(make(F.col("x"))).collect()]


@pytest.mark.parametrize(("model", "value", "text"), [
    ("999", "0", "   0"), ("999.99", "0.5", "    .50"), ("990.99", "0.5", "   0.50"), ("9,999.9", "-1234.56", "-1,234.6"), ("9,999", "12", "    12"), ("0,000", "12", " 0,012"), ("S999", "12", " +12"), ("999S", "-12", " 12-"), ("999MI", "12", " 12 "),
    ("999PR", "-12", " <12>"), ("$9,990.00", "3.14159", "     $3.14"), ("FM999.99", "1.5", "1.5"), ("FM990.00", "-1.5", "-1.50"), ("99", "100", "###"), ("FM9G999D9", "1234", "1,234."), ("999", "-999.6", "####"), ("999", None, None), ("FM.99", "0.25", ".25"),
])
def test_numbers(spark, model, value, text):
    assert chars(spark, lambda x: f.to_char_number(x, model), [value and Decimal(value)], "decimal(20,6)") == [text]


def test_number_round_trips(spark):
    rng = random.Random(4)
    values = [Decimal(rng.randrange(-(10**9), 10**9)) / 100 for _ in range(150)] + [Decimal(0), Decimal("0.01"), Decimal("-0.5"), None]
    for model in ("999,999,990.00", "S000000000D99", "$99,999,999.99PR", "FM999G999G999D99S", "999999999.99MI"):
        back = chars(spark, lambda x, m=model: f.to_number(f.to_char_number(x, m), m), values, "decimal(20,2)")
        assert back == values, model


def test_number_errors_and_defaults(spark):
    texts = ["12", "1,2", "12,345", "x", "", None, "1234567", "-5", "1.5", "$3"]
    assert chars(spark, lambda x: f.to_number(x, "99,999", -1), texts, "string") == [12, -1, 12345, -1, -1, None, -1, -5, -1, -1]
    assert chars(spark, lambda x: f.validate_conversion(x, "number", "99,999"), texts, "string") == [1, 0, 1, 0, 0, 1, 0, 1, 0, 0]
    assert chars(spark, lambda x: f.to_number(x, default=None), ["1e3", " .5 ", "1.", "e", "."], "string") == [1000, Decimal("0.5"), 1, None, None]
    assert chars(spark, lambda x: f.cast_default(x, "int", 0), ["5", "y", None], "string") == [5, 0, None]
    with pytest.raises(Exception, match="no number: x"):
        chars(spark, lambda x: f.to_number(x, "99"), ["x"], "string")
    for bad in ("", "9.9.9", "S9S", "abc", ",99", "9V9"):
        with pytest.raises(ValueError, match="model"):
            f.number_model(bad)


def test_dates(spark):
    at = dt.datetime(2024, 2, 9, 15, 4, 5, 60708)
    wanted = {"DD-MON-YYYY": "09-FEB-2024", "fmDD Month YY": "9 February 24", "Day, DD": "Friday   , 09", "HH:MI:SS.FF3 am": "03:04:05.060 pm", "HH24MI": None, 'YYYY"y"Q': "2024y1", "DDD IW WW D": "040 06 06 6", "SSSSS": "54245", "J": "2460350", "dy P.M.": "fri P.M."}
    wanted["HH24MI"] = "1504"
    for model, text in wanted.items():
        assert chars(spark, lambda x, m=model: f.to_char_date(x, m), [at, None], "timestamp_ntz") == [text, None], model
    rng = random.Random(7)
    times = [dt.datetime(1951, 1, 1) + dt.timedelta(seconds=rng.randrange(90 * 365 * 86400)) for _ in range(100)] + [dt.datetime(2000, 2, 29, 0, 0), dt.datetime(1999, 12, 31, 12, 0)]
    for model in ("YYYY-MM-DD HH24:MI:SS", "DD Month RR HH12.MI.SS AM", "DDD/YYYY SSSSS", "J HH:MI:SS p.m.", "fmMON DD, YYYY HH24:MI:SS"):
        assert chars(spark, lambda x, m=model: f.to_date(f.to_char_date(x, m), m), times, "timestamp_ntz") == times, model


def test_date_errors_and_defaults(spark):
    texts = ["2024-02-29", "2023-02-29", "2024-13-01", "24-1-1", None, "x"]
    assert chars(spark, lambda x: f.to_date(x, "YYYY-MM-DD", "1900-01-01"), texts, "string") == [dt.datetime(2024, 2, 29), *[dt.datetime(1900, 1, 1)] * 3, None, dt.datetime(1900, 1, 1)]
    assert chars(spark, lambda x: f.validate_conversion(x, "date", "YYYY-MM-DD"), texts, "string") == [1, 0, 0, 0, 1, 0]
    assert chars(spark, lambda x: f.to_date(x, "RR", None), ["49", "50", "7"], "string") == [dt.datetime(2049, 1, 1), dt.datetime(1950, 1, 1), dt.datetime(2007, 1, 1)]
    assert chars(spark, lambda x: f.to_date(x, "DDD YYYY", None), ["366 2023", "366 2024", "0 2024"], "string") == [None, dt.datetime(2024, 12, 31), None]
    with pytest.raises(ValueError, match="date model"):
        f.date_model("YYYY?")
