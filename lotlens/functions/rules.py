"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINIMUM_PRICE, MAXIMUM_PRICE, MAXIMUM_MILEAGE_KM = 3_000, 3_000_000, 1_000_000


def price_floor(model_year: Column, current_year: int) -> Column:
    """The least plausible asking price: falls by 2,000 a year of age to a flat minimum."""
    return F.greatest(F.lit(MINIMUM_PRICE), 25_000 - 2_000 * (F.lit(current_year) - model_year))


def half_up(x: Column) -> Column:
    """floor(x + 0.5), the rounding of the scoring rules."""
    return F.floor(x + 0.5)


def thousands(x: Column) -> Column:
    """To whole thousands, one at least."""
    return F.greatest(F.lit(1000.0), half_up(x / 1000) * 1000.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def score(x: Column) -> Column:
    """A whole score between 10 and 95."""
    return F.greatest(F.lit(10), F.least(F.lit(95), half_up(x)))


def interpolate(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise-linear lookup, flat beyond both ends."""
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (a, ya), (b, yb) in zip(points, points[1:], strict=False):
        out = out.when(x <= b, F.lit(float(ya)) + (F.lit(float(yb)) - F.lit(float(ya))) * ((x - a) / (F.lit(float(b)) - F.lit(float(a)))))
    return out.otherwise(F.lit(float(points[-1][1])))


def mileage_cell(km: Column) -> Column:
    """The 20 equal buckets over 0 to 400,000 km that comparisons use; 0 and 21 lie outside."""
    return F.width_bucket(km.cast("double"), F.lit(0.0), F.lit(400_000.0), F.lit(20)).cast("int")


def mileage_band(km: Column) -> Column:
    """The six bands of daily cohorts."""
    out = F.when(km < 25_000, 0)
    for k, limit in enumerate((50_000, 75_000, 100_000, 150_000), 1):
        out = out.when(km < limit, k)
    return out.otherwise(5)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance on a sphere of 6,371 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(6371.0) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def ratio(part: Column, whole: Column, digits: int = 1) -> Column:
    """A percentage, null where there is no whole."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits)


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone, in the session's zone."""
    return F.unix_micros(at.cast("timestamp"))


def median(x: Column | str, p: float = 0.5) -> Column:
    """Exact, interpolated percentile."""
    return F.percentile(x, p)


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in an order: a window that the planner limits before its shuffle."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rank = 1").drop("__rank")
