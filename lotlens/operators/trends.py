"""Q13: the history of market cohorts, read at the narrowest level that has any."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.functions.rules import median, mileage_band
from lotlens.operators.history import live_periods

KEYS = ["make", "model", "fuel_type", "transmission", "model_year", "mileage_bucket"]
#: Levels from wide to narrow with the number of keys that each has, and the days that references go back.
LEVELS = {"model": 2, "fuel": 3, "transmission": 4, "model_year": 5, "mileage": 6}
REFERENCES = (30, 90, 180, 365)
LEAST = 10


def daily_cohorts(observations: DataFrame, as_of: datetime, least: int = LEAST) -> DataFrame:
    """(day, granularity, KEYS, active_count, median_price) of every day and level with `least` active listings or more.

    A listing counts on each day with the last state it had there. observations need model_year.
    """
    live = live_periods(observations, as_of, "day").withColumn("mileage_bucket", mileage_band(F.col("mileage_km"))).withColumn("day", F.col("period").cast("date"))
    sets = [[F.col(c) for c in ["day", *KEYS[:n]]] for n in LEVELS.values()]
    level = F.lit(None).cast("string")
    for name, n in LEVELS.items():
        level = F.when(F.grouping(KEYS[n - 1]) == 0, name).otherwise(level)
    grouped = live.groupingSets(sets, "day", *KEYS)
    return grouped.agg(level.alias("granularity"), F.count("*").alias("active_count"), median("price").alias("median_price")).filter(F.col("active_count") >= least)


def _same(left: str, right: str) -> Column:
    on = F.col(f"{left}.granularity") == F.col(f"{right}.granularity")
    for c in KEYS:
        on = on & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return on


def candidates(selections: DataFrame) -> DataFrame:
    """A row for each level that a selection (KEYS, all but make and model may be null) names, narrowest first by step."""
    named = lambda n: F.coalesce(*[F.when(F.col(c).isNull(), F.lit(False)) for c in KEYS[2:n]], F.lit(True))
    levels = []
    for step, (name, n) in enumerate(reversed(LEVELS.items())):
        keys = [(F.col(c) if k < n else F.lit(None)).cast(dict(selections.dtypes)[c]).alias(c) for k, c in enumerate(KEYS)]
        levels.append(F.when(named(n), F.struct(F.lit(step).alias("step"), F.lit(name).alias("granularity"), *keys)))
    return selections.select("request_id", F.explode(F.array_compact(F.array(*levels))).alias("c")).select("request_id", "c.*")


def trends(selections: DataFrame, cohorts: DataFrame, until: datetime, references: tuple[int, ...] = REFERENCES) -> DataFrame:
    """For each selection the narrowest cohort that has a snapshot on the latest day, its latest point and, for each
    reference, the last point at or before so many days earlier, with the changes of price and stock since.

    Different selections meet the cohorts once; a cohort's days are aggregated before they meet its selections. The joins
    are by shuffle whatever the files' sizes say: every selection becomes a row a level, far more than its file tells.
    """
    seen = cohorts.filter(F.col("day") <= F.lit(until).cast("date"))
    last = seen.agg(F.max("day").alias("last"))
    wanted = candidates(selections)
    asked = wanted.drop("request_id", "step").distinct()
    dated = seen.join(F.broadcast(last)).filter(F.col("day") >= F.date_sub("last", max(references)))
    point = F.struct("median_price", "active_count")
    ago = lambda d: F.max_by(F.when(F.col("day") <= F.date_sub("last", d), point), F.when(F.col("day") <= F.date_sub("last", d), F.col("day"))).alias(f"p{d}")
    on_last = F.max(F.when(F.col("day") == F.col("last"), point))
    history = dated.groupBy("granularity", *KEYS).agg(F.max("last").alias("day"), on_last.alias("p"), F.count("*").alias("points"), *[ago(d) for d in references]).filter("p is not null")
    known = asked.alias("a").join(history.alias("h").hint("merge"), _same("a", "h")).select("a.*", "h.day", "h.p", "h.points", *[f"h.p{d}" for d in references])
    met = wanted.alias("a").join(known.alias("h").hint("merge"), _same("a", "h")).select("a.request_id", "a.step", F.struct("h.*").alias("h"))
    best = met.groupBy("request_id").agg(F.min_by("h", "step").alias("h"), F.min("step").alias("step"))
    first = wanted.groupBy("request_id").agg(F.min("step").alias("first"))
    now, then = (lambda c: F.col(f"h.p.{c}")), (lambda d, c: F.col(f"h.p{d}.{c}"))
    changes = []
    for d in references:
        for c, name in (("median_price", "price"), ("active_count", "inventory")):
            changes += [then(d, c).alias(f"{name}_{d}"), (now(c) - then(d, c)).alias(f"{name}_change_{d}"), (100.0 * (now(c) - then(d, c)) / F.nullif(then(d, c), F.lit(0))).alias(f"{name}_percent_{d}")]
    return best.join(first.hint("merge"), "request_id").select("request_id", F.col("h.granularity").alias("granularity"), (F.col("step") > F.col("first")).alias("used_fallback"), F.col("h.day").alias("day"), now("median_price").alias("median_price"), now("active_count").alias("active_count"), F.col("h.points").alias("points"), *changes)
