import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cashtrail.functions import geo, text, timing


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).head().v


def test_normal_cdf_matches_erf(spark):
    xs = [(-9 + i * 0.05,) for i in range(361)]
    for r in spark.createDataFrame(xs, "x double").select("x", timing.normal_cdf(F.col("x")).alias("p")).collect():
        assert abs(r.p - 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) < 1e-9


def plain_mass(m, lo, hi, e, a, b):
    sigma = (math.log(hi) - math.log(lo)) / (2 * timing.Z95) if lo and hi and 0 < lo < hi else 0.6
    sigma, mu, e = min(2.5, max(0.05, sigma)), math.log(max(1.0, m)), max(0.0, e)
    cdf = lambda t: 0.0 if t <= 0 else 0.5 * (1 + math.erf((math.log(t) - mu) / sigma / math.sqrt(2)))
    left = 1 - cdf(e)
    return 0.0 if left <= 1e-9 else max(0.0, min(1.0, (cdf(e + b) - cdf(e + a)) / left))


def test_window_mass(spark):
    rows = [(40.0, lo, hi, e) for lo, hi in ((20.0, 80.0), (None, None), (80.0, 20.0)) for e in (-5.0, 0.0, 5.0, 40.0, 60.0, 200.0)]
    df = timing.add_window_mass(timing.explode_windows(spark.createDataFrame(rows, "m double, lo double, hi double, elapsed_min double")))
    got = df.collect()
    assert len(got) == len(rows) * 3
    for r in got:
        want = plain_mass(r.m, r.lo, r.hi, r.elapsed_min, r.window_start_min, r.window_end_min)
        assert abs(r.window_mass - want) < 1e-9 and 0 <= r.window_mass <= 1
    early = {r.elapsed_min: r.window_mass for r in got if r.lo == 20.0 and r.window_start_min == 0}
    assert early[60.0] > early[0.0]


@pytest.mark.parametrize("raw,want", [("2026-05-27T10:00:00Z", "2026-05-27 10:00:00"), ("2026-05-27T10:00:00+05:30", "2026-05-27 04:30:00"),
                                      ("2026-05-27T10:00:00.25", "2026-05-27 10:00:00.250000"), ("nonsense", None), ("", None), (None, None)])
def test_timestamps(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "s string").select(timing.normalise_timestamp(F.col("s")).cast("timestamp_ntz").alias("v")).head().v
    assert (got is None and want is None) or str(got) == want


def test_naive_time_is_read_in_the_local_zone(spark):
    got = spark.createDataFrame([("2026-05-27T10:00:00",)], "s string").select(F.unix_timestamp(timing.normalise_timestamp(F.col("s"), "Asia/Kolkata")).alias("v")).head().v
    assert got == int(dt.datetime(2026, 5, 27, 4, 30, tzinfo=dt.timezone.utc).timestamp())


def test_open_hours_cross_midnight(spark):
    df = spark.createDataFrame([(30, 1320, 120), (720, 1320, 120), (720, 600, 900), (720, None, 900)], "m int, o int, c int")
    assert [r.v for r in df.select(timing.open_at(F.col("m"), F.col("o"), F.col("c")).alias("v")).collect()] == [True, False, True, None]
    assert one(spark, timing.minutes_of_day(F.col("h")), h="09:30") == 570
    assert one(spark, timing.minutes_of_day(F.col("h")), h="late") is None


def test_distances(spark):
    assert one(spark, geo.haversine_km(19.0, 72.8, 19.0, 72.8)) == 0
    assert abs(one(spark, geo.haversine_km(19.076, 72.8777, 28.6139, 77.209)) - 1148.1) < 2
    a, b = one(spark, geo.haversine_km(1.0, 2.0, 3.0, 4.0)), one(spark, geo.haversine_km(3.0, 4.0, 1.0, 2.0))
    assert abs(a - b) < 1e-9
    assert abs(one(spark, geo.bearing_deg(0.0, 0.0, 0.0, 1.0)) - 90) < 1e-9


def test_labels(spark):
    assert one(spark, text.rupee_text(F.lit(12345678.0))) == "Rs 1.23 Cr"
    assert one(spark, text.rupee_text(F.lit(250000.0))) == "Rs 2.50 L"
    assert one(spark, text.rupee_text(F.lit(2452.0))) == "Rs 2,452"
    assert one(spark, text.safe_display_name(F.lit("../../etc/..pass<wd>"))) == "pass_wd_"
    assert one(spark, text.safe_display_name(F.lit("a/.."))) == "artefact"
    assert one(spark, F.length(text.sms_text(F.lit("x" * 150), F.lit("y" * 50)))) == 160


def test_long_names_with_slashes_cost_no_square(spark):
    import time

    plain = "x" * 60_000
    began = time.perf_counter()
    assert one(spark, text.safe_display_name(F.concat(*[F.lit(v) for v in (plain, "/", plain, "/  ...a\u20acb", plain)]))) == ("a_b" + plain)[:180]
    assert time.perf_counter() - began < 10
    assert one(spark, text.safe_display_name(F.lit("a/ .. b "))) == " b"
    assert one(spark, text.safe_display_name(F.lit("a/"))) == "artefact"
