"""Valuation from weighted comparables, its confidence, and the scores made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.functions.rules import half_up, interpolate, price_floor, score, thousands

#: Weights of the similarity components, which sum to 100, and what an unknown value counts.
WEIGHTS = {"generation": 14, "facelift": 6, "drivetrain": 14, "transmission": 6, "trim": 7, "performance": 8, "body": 6, "model_year": 12, "mileage": 18, "seller_type": 4, "recency": 5}
TIERS = [("A", 82, 1.0), ("B", 65, 0.65), ("C", 45, 0.35), ("D", None, 0.15)]
NEAREST, LEAST, FIT = 40, 3, 8
#: Score curves.
PRICE_CURVE = [(-0.3, 10), (-0.2, 22), (-0.1, 36), (0, 50), (0.05, 57), (0.1, 64), (0.15, 71), (0.2, 77), (0.25, 82), (0.3, 86), (0.4, 89), (0.5, 91)]
AGE_CURVE = [(0, 95), (2, 92), (4, 82), (6, 70), (9, 58), (12, 48), (16, 34), (17, 30), (25, 15), (40, 10)]
RELATIVE_MILEAGE = [(0.2, 88), (0.4, 82), (0.7, 70), (1, 55), (1.3, 44), (1.7, 30), (2.5, 12), (5, 10)]
ABSOLUTE_MILEAGE = [(0, 95), (30_000, 90), (60_000, 82), (100_000, 70), (150_000, 55), (200_000, 40), (300_000, 20), (500_000, 10)]


def _alike(a: Column, b: Column, match: float = 1.0, other: float = 0.0, unknown: float = 0.75) -> Column:
    return F.when(a.isNull() | b.isNull(), unknown).when(F.lower(a) == F.lower(b), match).otherwise(other)


def recency(age_days: Column, half_life: float = 45.0) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life)


def similarity(t: str = "t_", c: str = "") -> Column:
    """V1: 0 to 100 of a pair, from columns of the target (prefix t) and the candidate (prefix c)."""
    a, b = (lambda n: F.col(t + n)), (lambda n: F.col(c + n))
    decay = lambda x, spread: F.greatest(F.lit(0.0), 1 - F.abs(x) / spread)
    both_base = a("performance").isNull() & b("performance").isNull()
    parts = {
        "generation": _alike(a("generation"), b("generation")),
        "facelift": F.when(a("facelift").isNull() | b("facelift").isNull(), 0.75).when(a("facelift") == b("facelift"), 1.0).otherwise(0.25),
        "drivetrain": _alike(a("drivetrain"), b("drivetrain")),
        "transmission": _alike(a("transmission"), b("transmission")),
        "trim": _alike(a("trim"), b("trim"), 1.0, 0.2, 0.65),
        "performance": F.when(both_base | (F.lower(F.coalesce(a("performance"), F.lit(""))) == F.lower(F.coalesce(b("performance"), F.lit("")))), 1.0).otherwise(0.15),
        "body": F.when((a("body_style") == "other") | (b("body_style") == "other"), 0.6).when(a("body_style") == b("body_style"), 1.0).otherwise(0.1),
        "model_year": decay(a("model_year") - b("model_year"), 6),
        "mileage": decay(a("mileage_km") - b("mileage_km"), 60_000),
        "seller_type": F.when(a("seller_type") == b("seller_type"), 1.0).otherwise(0.6),
        "recency": recency(b("age_days")),
    }
    total = sum((parts[n] * float(w) for n, w in WEIGHTS.items()), F.lit(0.0))
    return half_up(total)


def tier(s: Column) -> Column:
    return F.when(s >= 82, "A").when(s >= 65, "B").when(s >= 45, "C").otherwise("D")


def tier_weight(name: Column) -> Column:
    return F.when(name == "A", 1.0).when(name == "B", 0.65).when(name == "C", 0.35).otherwise(0.15)


OPTIONAL = {"generation": "string", "facelift": "boolean", "drivetrain": "string", "trim": "string", "performance": "string"}


def with_optional(df: DataFrame) -> DataFrame:
    """Columns a source may lack, as unknown."""
    return df.withColumns({n: F.lit(None).cast(kind) for n, kind in OPTIONAL.items() if n not in df.columns})


def comparables(targets: DataFrame, pool: DataFrame, enough: int = FIT) -> DataFrame:
    """V1 to V3: scored pairs of one make, model and fuel, widened from tier A down until `enough` are in.

    A tier takes part if the tiers above it hold fewer than `enough`. All pairs of a cohort: for the 40 that decide a
    valuation see operators/nearest.py. Pairs are scored in arrays within the task of their cohort and leave it only if they
    take part, so that none is shuffled, sorted or spilled.
    """
    from lotlens.operators import nearest  # which is made of this module

    columns = ["listing_id", "vehicle_id", "make", "model", "fuel_type", *OPTIONAL, "transmission", "body_style", "model_year", "mileage_km", "seller_type"]
    t = with_optional(targets).select(*[F.col(n).alias(f"t_{n}") for n in columns])
    return nearest.all_pairs(t, with_optional(pool).select(*columns, "price", "age_days"), enough)


def weighted_percentile(rows: DataFrame, key: str, value: str, weight: str, fractions: dict[str, float], *ties: str) -> DataFrame:
    """Interpolated weighted percentiles of each key, by running sums of weight."""
    order = Window.partitionBy(key).orderBy(value, *ties)
    run = rows.filter(F.col(weight) > 0).select(
        key,
        F.col(value).alias("v"),
        F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.col(weight).alias("w"),
        F.lag(value).over(order).alias("before"),
        F.sum(weight).over(Window.partitionBy(key)).alias("total"),
    )
    return run.groupBy(key).agg(*[_crossing(p).alias(name) for name, p in fractions.items()])


def _crossing(p: float) -> Column:
    target = F.lit(p) * F.col("total")
    at = F.when(F.col("before").isNull(), F.col("v")).otherwise(F.col("before") + (target - (F.col("upto") - F.col("w"))) / F.col("w") * (F.col("v") - F.col("before")))
    return F.coalesce(F.min_by(F.when(F.col("upto") >= target, at), F.when(F.col("upto") >= target, F.col("upto"))), F.max("v"))


#: What is kept of a target, and of a candidate of its.
TARGET = ["t_listing_id", "t_model_year", "t_mileage_km"]
CANDIDATE = ["listing_id", "tier", "similarity", "weight", "close", "price", "model_year", "mileage_km", "age_days"]


def sane() -> Column:
    return F.coalesce(F.col("price").between(3_000, 3_000_000) & F.col("mileage_km").between(0, 1_000_000) & F.col("model_year").isNotNull(), F.lit(False))


def nearest_of(found: Column, n: int = NEAREST) -> Column:
    """The n heaviest of an array of candidates, the closer first where weights are equal."""
    order = F.transform(found, lambda c: F.struct((-c["weight"]).alias("weight"), c["close"].alias("close"), c["listing_id"].alias("listing_id"), c.alias("c")))
    return F.transform(F.slice(F.sort_array(order), 1, n), lambda x: x["c"])


def _median(values: Column) -> Column:
    s = F.sort_array(values)
    return (F.get(s, F.floor((F.size(values) - 1) / 2).cast("int")) + F.get(s, F.ceil((F.size(values) - 1) / 2).cast("int"))) / 2


def _sum(rows: str, of) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda s, c: s + of(c))


def _weighted(p: float) -> Column:
    """A14 over `shifted`, sorted by value: the value where the running weight reaches a share of the whole, interpolated."""
    target = F.lit(p) * F.col("total")
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("at"))

    def step(s: Column, c: Column) -> Column:
        upto = s["upto"] + c["weight"]
        here = F.when(s["before"].isNull(), c["value"]).otherwise(s["before"] + (target - s["upto"]) / c["weight"] * (c["value"] - s["before"]))
        return F.struct(upto.alias("upto"), c["value"].alias("before"), F.when(s["at"].isNotNull(), s["at"]).when(upto >= target, here).alias("at"))

    last = F.aggregate("shifted", start, step)
    return F.coalesce(last["at"], F.element_at("shifted", -1)["value"])


def valued(compared: DataFrame, as_of_year: int) -> DataFrame:
    """V4: market value and range of each target from its nearest comparables; none where too few are left.

    Prices far from their median go; a weighted fit on age and mileage shifts each price to the target if its slopes fall;
    weighted percentiles of the shifted prices are clamped and rounded. Arrays hold NEAREST comparables at most.
    """
    # The median is a lambda's argument: as a column it would be computed anew for every comparable once the filter is pushed down.
    inside = F.transform(F.array(_median(F.transform("near", lambda c: c["price"]))), lambda mid: F.filter("near", lambda c: c["price"].between(0.4 * mid, 2.5 * mid)))
    rows = compared.filter(F.size("near") >= LEAST).withColumn("used", F.when(F.size("near") < 4, F.col("near")).otherwise(F.get(inside, F.lit(0)))).drop("near").filter(F.size("used") >= LEAST)
    age = lambda c: (F.lit(as_of_year) - c["model_year"]).cast("double")
    rows = rows.withColumns({"plain": _median(F.transform("used", lambda c: c["price"])), "total": _sum("used", lambda c: c["weight"]), "squares": _sum("used", lambda c: c["weight"] * c["weight"])})
    mean = lambda of: F.try_divide(_sum("used", lambda c: c["weight"] * of(c)), F.col("total"))
    rows = rows.withColumns({"ma": mean(age), "mk": mean(lambda c: c["mileage_km"]), "mp": mean(lambda c: c["price"]), "spread": F.array_max(F.transform("used", age)) - F.array_min(F.transform("used", age))})
    a, k, p = (lambda c: age(c) - F.col("ma")), (lambda c: c["mileage_km"] - F.col("mk")), (lambda c: c["price"] - F.col("mp"))
    product = lambda x, y: _sum("used", lambda c: c["weight"] * x(c) * y(c))
    rows = rows.withColumns({"aa": product(a, a), "kk": product(k, k), "ak": product(a, k), "ap": product(a, p), "kp": product(k, p)})
    det = F.col("aa") * F.col("kk") - F.col("ak") * F.col("ak")
    fits, wide, solved = (F.size("used") >= FIT) & (F.col("kk") >= 1e-3), F.col("spread") >= 2, F.when(F.abs(det) >= 1e-3, det)
    rows = rows.withColumns({
        "b_age": F.when(fits & ~wide, 0.0).when(fits, (F.col("kk") * F.col("ap") - F.col("ak") * F.col("kp")) / solved),
        "b_km": F.when(fits & ~wide, F.col("kp") / F.nullif(F.col("kk"), F.lit(0.0))).when(fits, (F.col("aa") * F.col("kp") - F.col("ak") * F.col("ap")) / solved),
        "t_age": (F.lit(as_of_year) - F.col("t_model_year")).cast("double"),
    })
    rows = rows.withColumn("adjusted", F.coalesce((F.col("b_age") <= 0) & (F.col("b_km") < 0), F.lit(False)))
    raw = lambda c: c["price"] + F.col("b_age") * (F.col("t_age") - age(c)) + F.col("b_km") * (F.col("t_mileage_km") - c["mileage_km"])
    value = lambda c: F.when(F.col("adjusted"), F.least(F.greatest(raw(c), 0.5 * c["price"]), 1.6 * c["price"])).otherwise(c["price"])
    weighing = F.filter("used", lambda c: c["weight"] > 0)
    rows = rows.withColumn("shifted", F.sort_array(F.transform(weighing, lambda c: F.struct(value(c).alias("value"), c["listing_id"].alias("listing_id"), c["weight"].alias("weight")))))
    rows = rows.withColumns({"p50": _weighted(0.5), "p25": _weighted(0.25), "p75": _weighted(0.75)})
    bound = lambda c: thousands(F.when(F.col("adjusted"), F.least(F.greatest(F.col(c), 0.5 * F.col("plain")), 1.6 * F.col("plain"))).otherwise(F.col(c)))
    used = lambda t: F.size(F.filter("used", lambda c: c["tier"] == t))
    return rows.select(
        F.col("t_listing_id").alias("listing_id"), bound("p50").alias("market_value"), bound("p25").alias("range_low"), bound("p75").alias("range_high"),
        F.size("used").cast("long").alias("comparable_count"), F.when(F.col("adjusted"), "adjusted").otherwise("raw_median").alias("method"),
        F.coalesce(F.try_divide(F.col("total") * F.col("total"), F.col("squares")), F.lit(0.0)).alias("effective_sample"), "fallback",
        *[used(x).alias(f"used_{x}") for x in "ABCD"], ((F.col("p75") - F.col("p25")) / F.nullif(F.col("p50"), F.lit(0.0))).alias("dispersion"),
        F.sort_array(F.transform("used", lambda c: c["price"])).alias("prices"), F.array_min(F.transform("used", lambda c: c["age_days"])).alias("newest_days"),
        F.when(F.col("adjusted"), F.floor(0.5 - F.col("b_age"))).alias("per_model_year"), F.when(F.col("adjusted"), F.floor(F.col("b_km") * 1000 + 0.5)).alias("per_thousand_km"),
    )


def value(pairs: DataFrame, as_of_year: int) -> DataFrame:
    """valued() of pairs that are there already: the nearest 40 of each target by weight, then closeness in age and mileage."""
    closeness = F.abs(F.col("model_year") - F.col("t_model_year")) * 60_000.0 + F.abs(F.col("mileage_km") - F.col("t_mileage_km"))
    rows = pairs.filter(sane()).withColumns({c: F.lit(None).cast("string") for c in CANDIDATE if c not in (*pairs.columns, "close")})
    rows = rows.withColumns({"close": closeness, "price": F.col("price").cast("double"), "mileage_km": F.col("mileage_km").cast("double")})
    best = Window.partitionBy(*TARGET).orderBy(F.desc("weight"), "close", "listing_id")
    few = rows.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= NEAREST)
    return valued(few.groupBy(*TARGET).agg(F.collect_list(F.struct(*CANDIDATE)).alias("near")).withColumn("fallback", F.lit(False)), as_of_year)


def confidence(strong: Column, dispersion: Column, method: Column, fallback: Column) -> Column:
    """V5: 0 to 100."""
    count = F.when(strong <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log2(strong + 1) / F.log2(F.lit(21.0))))
    agree = F.when(dispersion.isNull() | (dispersion < 0), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - dispersion / 0.5))
    how = F.when(method == "adjusted", 1.0).when(method == "raw_median", 0.55).otherwise(0.0)
    few = F.when(strong >= 3, 1.0).otherwise(F.pow(F.greatest(strong, F.lit(0)) / 3.0, F.lit(1.5)))
    raw = 0.4 * count + 0.35 * agree + 0.25 * how
    return F.when(method == "insufficient", F.lit(0)).otherwise(half_up(raw * F.when(fallback, 0.6).otherwise(1.0) * few * 100))


def confidence_label(s: Column) -> Column:
    return F.when(s >= 85, "very_high").when(s >= 70, "high").when(s >= 50, "medium").when(s >= 30, "low").otherwise("very_low")


def asking_price_code(price: Column, model_year: Column, current_year: int, market: Column, comparables_: Column, suspicious: Column, monthly: Column) -> Column:
    """V6: 0 usable; 1 below, 2 above the absolute bounds; 3, 4 far from the market; 5 monthly; 6 wording; 7 unverified."""
    share = price / market
    known = market > 0
    return (
        F.when(price.isNull() | (price < price_floor(model_year, current_year)), 1)
        .when(price > 3_000_000, 2)
        .when((monthly > 0) & (price < monthly * 12), 5)
        .when(known & (share < 0.35), 3)
        .when(known & (price > market * 3), 4)
        .when(known & (share < 0.6) & suspicious, 6)
        .when(known & (share < 0.6) & (monthly > 0) & (price < monthly * 24), 5)
        .when(known & (share < 0.6) & (comparables_ < 8), 7)
        .otherwise(0)
    )


def shrink(s: Column, n: Column, k: float) -> Column:
    return 50 + (s - 50) * (n / (n + k))


def price_value(delta: Column, n: Column) -> Column:
    """How the price stands to the market, drawn to 50 where it rests on few comparables."""
    return shrink(score(interpolate(delta, PRICE_CURVE)), n, 6)


def deal_score(delta: Column, n: Column, usable: Column, modifiers: Column | None = None, **parts: Column) -> Column:
    """V7: null where prices can't be compared; parts are deviations from 50 with fixed weights, modifiers points to add."""
    weights = {"mileage": 0.12, "age": 0.12, "owner": 0.12, "equipment": 0.08, "transparency": 0.03, "protection": 0.03}
    raw = F.lit(50.0) + 0.5 * (price_value(delta, n) - 50)
    for name, part in parts.items():
        raw = raw + weights[name] * (F.coalesce(part, F.lit(50.0)) - 50)
    return F.when(usable, score(raw + (F.lit(0) if modifiers is None else F.coalesce(modifiers, F.lit(0)))))


def age_score(age: Column) -> Column:
    return half_up(interpolate(F.greatest(age, F.lit(0.0)), AGE_CURVE))


def mileage_score(km: Column, age: Column) -> Column:
    """V8: against the distance expected of the age, and as it is."""
    expected = 12_000 * F.greatest(age, F.lit(1.0))
    return half_up(0.65 * interpolate(km / expected, RELATIVE_MILEAGE) + 0.35 * interpolate(F.greatest(km, F.lit(0)), ABSOLUTE_MILEAGE))




#: Points of the condition scores, and what is scored where nothing is stated.
CONDITION_AGE = [(0, 100), (1, 100), (3, 92), (5, 82), (8, 68), (12, 50), (18, 30), (25, 15), (40, 10)]
CONDITION_MILEAGE = [(0, 100), (30_000, 92), (60_000, 80), (100_000, 65), (150_000, 45), (200_000, 28), (300_000, 10), (500_000, 10)]
CONDITION_OWNERS = [(1, 100), (2, 80), (3, 60), (4, 45), (5, 30), (8, 15)]
SERVICE_HISTORY = {"complete": 100, "partial": 62, "missing": 25, "unknown": 40}
UNKNOWN_OWNERS, UNKNOWN_MILEAGE = 45, 50
CONFIDENCE_WEIGHTS = {"age": 0.34, "mileage": 0.3, "service": 0.2, "owners": 0.16}
THIN_LISTING = 4


def condition_scores(age: Column, km: Column, owners: Column, service: Column, mileage_known: Column | None = None) -> Column:
    """V9: a struct (age, mileage, owners, service, has_owners, has_service); what is unknown has a score of its own."""
    known = F.coalesce(mileage_known if mileage_known is not None else F.lit(True), F.lit(True))
    told = F.coalesce(service, F.lit("unknown"))
    history = F.lit(float(SERVICE_HISTORY["unknown"]))
    for name, value in SERVICE_HISTORY.items():
        history = F.when(told == name, float(value)).otherwise(history)
    return F.struct(
        interpolate(F.greatest(age, F.lit(0.0)), CONDITION_AGE).alias("age"),
        F.when(known, interpolate(F.greatest(km, F.lit(0)), CONDITION_MILEAGE)).otherwise(float(UNKNOWN_MILEAGE)).alias("mileage"),
        F.when(owners.isNull(), float(UNKNOWN_OWNERS)).otherwise(interpolate(owners, CONDITION_OWNERS)).alias("owners"),
        history.alias("service"),
        owners.isNotNull().alias("has_owners"),
        (told != "unknown").alias("has_service"),
    )


def buy_confidence(condition: Column) -> Column:
    """V9: the weighted condition scores; an ad that states neither owners nor service history loses a little more."""
    raw = F.lit(0.0)
    for part, weight in CONFIDENCE_WEIGHTS.items():
        raw = raw + weight * condition[part]
    return score(raw - F.when(~condition["has_owners"] & ~condition["has_service"], THIN_LISTING).otherwise(0))


#: Points of the deal's owner score, relative to the owners expected of the age and absolute; where none are stated.
RELATIVE_OWNERS = [(0.25, 92), (0.5, 82), (0.8, 68), (1, 55), (1.3, 42), (1.8, 25), (3, 10)]
ABSOLUTE_OWNERS = [(1, 90), (2, 76), (3, 62), (4, 50), (5, 38), (8, 18), (12, 10)]
DEAL_UNKNOWN_OWNERS = 46


def owner_score(owners: Column, age: Column) -> Column:
    """V8's part of owners: against one and another every four years, and as they are."""
    expected = 1 + F.greatest(age, F.lit(0.0)) / 4
    told = 0.55 * interpolate(owners / expected, RELATIVE_OWNERS) + 0.45 * interpolate(owners, ABSOLUTE_OWNERS)
    return F.when(owners.isNull(), F.lit(DEAL_UNKNOWN_OWNERS)).otherwise(half_up(told)).cast("long")


def even_sample(values: Column, size: int = 40) -> Column:
    """A sorted array thinned evenly, both ends kept."""
    step = (F.size(values) - 1) / (size - 1)
    thin = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.get(values, half_up(k * step).cast("int")))
    return F.when(F.size(values) <= size, values).otherwise(thin)


def even_samples(rows: DataFrame, key: str, value: str, size: int = 40) -> DataFrame:
    """A17 by key: (key, values) of each key's sorted values thinned evenly, both ends kept; only the wanted places are gathered."""
    placed = rows.select(key, value).filter(F.col(value).isNotNull()).withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(value)) - 1)
    counted = placed.join(rows.filter(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n")), key)
    step = (F.col("n") - 1) / (size - 1)
    wanted = lambda j: half_up(j * step) == F.col("k")
    near = F.col("k") / step
    kept = counted.filter((F.col("n") <= size) | wanted(F.floor(near)) | wanted(F.ceil(near)))
    return kept.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))


def budget_focus(low: Column, high: Column, target: Column) -> Column:
    """A struct (target, low, high) of what is known of a budget."""
    whole = lambda x: half_up(x).cast("long")
    none = F.lit(None).cast("long")
    of = lambda t, a, b: F.struct(t.cast("long").alias("target"), a.cast("long").alias("low"), b.cast("long").alias("high"))
    return (
        F.when(F.coalesce(target, F.lit(0)) > 0, of(target, whole(target * 0.8), whole(target * 1.2)))
        .when(low.isNotNull() & high.isNotNull(), of(whole((low + high) / 2), low, high))
        .when(high.isNotNull(), of(whole(high * 0.88), whole(high * 0.5), high))
        .when(low.isNotNull(), of(whole(low * 1.25), low, none))
        .otherwise(of(none, none, none))
    )
