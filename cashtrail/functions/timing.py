"""Clocks, delay distributions and time windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Forecast windows in minutes, Phi^-1(0.95), spread without a band and its clamp.
WINDOWS = ((0, 30), (30, 60), (60, 120))
Z95 = 1.6448536269514722
DEFAULT_SIGMA, MIN_SIGMA, MAX_SIGMA = 0.6, 0.05, 2.5

# Hart's rational approximation of the normal tail, highest power first.
HART_NUM = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
HART_DEN = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_LIMIT = 7.0710678


def _horner(x: Column, coefficients) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_cdf(z: Column) -> Column:
    a = F.abs(z)
    tail = F.when(a < HART_LIMIT, F.exp(-a * a / 2) * _horner(a, HART_NUM) / _horner(a, HART_DEN)).otherwise(0.0)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def add_window_mass(df: DataFrame, median="m", low="lo", high="hi", elapsed="elapsed_min",
                    start="window_start_min", end="window_end_min", out="window_mass") -> DataFrame:
    """P(withdrawal in [start, end) minutes from now, given none up to ``elapsed``).

    A lognormal through the median and the q05/q95 band. Each step is its own column,
    so the optimizer evaluates every normal CDF once.
    """
    lo, hi = F.col(low), F.col(high)
    banded = lo.isNotNull() & hi.isNotNull() & (lo > 0) & (lo < hi)
    sigma = F.when(banded, (F.log(hi) - F.log(lo)) / (2.0 * Z95)).otherwise(DEFAULT_SIGMA)
    wait = F.greatest(F.lit(0.0), F.col(elapsed))

    def cdf(z):
        return F.when(F.col(z).isNull(), 0.0).otherwise(normal_cdf(F.col(z)))

    def score(t):
        return F.when(t > 0, (F.log(t) - F.col("__mu")) / F.col("__sigma"))

    return (
        df.withColumn("__mu", F.log(F.greatest(F.lit(1.0), F.col(median))))
        .withColumn("__sigma", F.least(F.lit(MAX_SIGMA), F.greatest(F.lit(MIN_SIGMA), sigma)))
        .withColumn("__z", score(wait))
        .withColumn("__z0", score(wait + F.col(start)))
        .withColumn("__z1", score(wait + F.col(end)))
        .withColumn("__c", cdf("__z")).withColumn("__c0", cdf("__z0")).withColumn("__c1", cdf("__z1"))
        .withColumn(out, F.when(1 - F.col("__c") <= 1e-9, 0.0).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("__c1") - F.col("__c0")) / (1 - F.col("__c"))))))
        .drop("__mu", "__sigma", "__z", "__z0", "__z1", "__c", "__c0", "__c1")
    )


def explode_windows(df: DataFrame, windows=WINDOWS) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in windows])
    return (df.withColumn("__w", F.explode(pairs))
            .withColumn("window_start_min", F.col("__w.a")).withColumn("window_end_min", F.col("__w.b")).drop("__w"))


def normalise_timestamp(text: Column, local_zone: str = "UTC") -> Column:
    """ISO text to an instant: an offset is applied, naive text is read as ``local_zone``, garbage is NULL."""
    iso = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    aware = iso.rlike(r"[+-]\d{2}:\d{2}$")
    shaped = iso.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2})?)?$")
    instant = F.try_to_timestamp(iso)
    return F.when(~shaped, None).when(aware, instant).otherwise(F.to_utc_timestamp(instant, local_zone))


def hour_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH")


def trusted_clock(is_live: Column, raw_text: Column) -> Column:
    return F.coalesce(is_live, F.lit(False)) | F.coalesce(raw_text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), F.lit(False))


def minutes_of_day(hhmm: Column) -> Column:
    parts = F.split(F.trim(hhmm), ":")
    return (F.try_element_at(parts, F.lit(1)).try_cast("int") * 60
            + F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int"), F.lit(0)))


def open_at(minute: Column, opens: Column, closes: Column) -> Column:
    """Is a machine open at a minute of the day; ranges may cross midnight, unknown hours stay NULL."""
    return F.when(opens.isNull() | closes.isNull(), None).when(
        closes > opens, (minute >= opens) & (minute < closes)).otherwise((minute >= opens) | (minute < closes))
