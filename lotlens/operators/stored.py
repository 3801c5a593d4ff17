"""Stored analyses: what an ad shows where one is absent (P20), repairs in place (G20), the pool of target cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.functions.lineage import small_or_none
from lotlens.functions.rules import first_by, half_up, price_floor, thousands
from lotlens.operators.valuation import LEAST

#: Half of the range where no value is stored, confidence below which a deal score is withheld, neutral score,
#: share of the market value below which a price isn't the car's; cohorts that are broadcast, at most.
SPREAD, WITHHELD, NEUTRAL, IMPLAUSIBLE = 0.1, 50, 50, 0.35
BROADCAST_COHORTS = 200_000


def shown(rows: DataFrame) -> DataFrame:
    """P20: rows (listing_id, price, and the stored market_value, range_low, range_high, comparable_count, deal_score,
    buy_score, confidence_score, null where there is none) with a struct of what is shown.

    The asking price stands for a missing value, a tenth about it for the range; a deal score without evidence is unrated,
    a missing buy score neutral. Everything is null where the price is as well.
    """
    price = F.col("price").cast("double")
    deal = F.when(F.coalesce(F.col("confidence_score") < WITHHELD, F.lit(False)), F.lit(None)).otherwise(F.col("deal_score"))
    count = F.coalesce("comparable_count", F.lit(0))
    verdict = F.when(F.col("deal_score").isNull(), "not_assessed").when(count >= LEAST, "assessed").otherwise("too_few")
    of = F.struct(
        F.coalesce(F.col("market_value").cast("double"), price).alias("market_value"),
        F.coalesce(F.col("range_low").cast("double"), thousands(price * (1 - SPREAD))).alias("range_low"),
        F.coalesce(F.col("range_high").cast("double"), thousands(price * (1 + SPREAD))).alias("range_high"),
        count.cast("long").alias("comparable_count"),
        deal.cast("long").alias("deal_score"),
        verdict.alias("deal_verdict"),
        F.coalesce("buy_score", F.lit(NEUTRAL)).cast("long").alias("buy_score"),
    )
    return rows.withColumn("shown", of)


def implausible(year: int) -> Column:
    """Prices that are not the car's: below the floor of its age, or far below its comparables."""
    far = (F.col("comparable_count") >= LEAST) & (F.col("price") < F.col("market_value") * IMPLAUSIBLE)
    return F.coalesce(F.col("price") < price_floor(F.col("model_year"), year), F.lit(False)) | F.coalesce(far, F.lit(False))


def repaired(rows: DataFrame, year: int) -> DataFrame:
    """Deal scores and confidences of implausible prices are reset, market values stay, and every rated row with enough
    comparables gets its discount in hundredths of a percent, halves away from zero."""
    rows = rows.withColumn("reset", implausible(year))
    share = (F.col("market_value") - F.col("price")) / F.col("market_value").cast("double") * 10_000
    rated = (F.col("comparable_count") >= LEAST) & F.col("deal_score").isNotNull() & (F.col("market_value") > 0)
    return rows.withColumns({
        "deal_score": F.when(F.col("reset"), NEUTRAL).otherwise(F.col("deal_score")),
        "confidence": F.when(F.col("reset"), "low").otherwise(F.col("confidence")),
        "discount_bps": F.when(rated, F.signum(share) * half_up(F.abs(share))).cast("long"),
    })


def of_cohorts(ads: DataFrame, targets: DataFrame) -> DataFrame:
    """Of the (make, model) cohorts of targets, one ad a vehicle: the last seen, then the smaller id.

    The list of cohorts is broadcast when counted small, else both sides are shuffled by it. A null make or model is in no cohort.
    """
    cohorts = targets.select("make", "model").dropna().distinct()
    members = ads.join(small_or_none(cohorts, BROADCAST_COHORTS) or cohorts, ["make", "model"], "left_semi")
    return first_by(members, ["vehicle_id"], F.desc("last_seen_at"), F.col("listing_id"))
