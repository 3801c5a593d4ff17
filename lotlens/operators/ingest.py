"""Ingestion: change detection, keyed merges, identity, removal, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.functions.lineage import discard, settle
from lotlens.functions.rules import first_by, price_floor
from lotlens.operators.text import LEASE, WITHOUT_VAT, mileage_status

#: Reasons that reject a listing.
REJECTING = ["PRICE_NOT_POSITIVE", "PRICE_BELOW_MODEL_YEAR_FLOOR", "PRICE_ABOVE_VALUATION_LIMIT", "LEASE_OR_MONTHLY_PRICE", "VAT_EXCLUSIVE_PRICE", "MILEAGE_OUT_OF_RANGE",
             "MILEAGE_IMPLAUSIBLE_FOR_AGE", "MODEL_YEAR_OUT_OF_RANGE", "HORSEPOWER_OUT_OF_RANGE", "POWERTRAIN_CLASSIFICATION_CONFLICT", "MODEL_MISSING"]


def content_hash(*columns: str) -> Column:
    """A digest of what an ad says, the time of reading left out."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def merge(current: DataFrame, incoming: DataFrame, key: str, newest: Column) -> DataFrame:
    """A keyed upsert: of all rows of a key the newest stays, the incoming one on a tie."""
    both = current.withColumn("__from", F.lit(0)).unionByName(incoming.withColumn("__from", F.lit(1)))
    return first_by(both, [key], newest.desc_nulls_last(), F.desc("__from")).drop("__from")


def insert_new(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not there yet, one a key."""
    return incoming.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")


def outcomes(current: DataFrame, incoming: DataFrame, key: str, *content: str) -> DataFrame:
    """Created, updated or unchanged, for each incoming row."""
    now = current.select(F.col(key).alias("__key"), content_hash(*content).alias("__old"))
    rows = incoming.withColumn("__new", content_hash(*content)).join(now, F.col(key) == F.col("__key"), "left")
    return rows.select(key, F.when(F.col("__key").isNull(), "created").when(F.col("__old") != F.col("__new"), "updated").otherwise("unchanged").alias("outcome"))


def events(current: DataFrame, incoming: DataFrame, key: str = "listing_id") -> DataFrame:
    """Every fact that one reading adds: first_seen, or relisted and each change, together."""
    old = current.select(F.col(key).alias("__key"), *[F.col(c).alias(f"old_{c}") for c in ("status", "price", "mileage_km", "seller_type", "seller_name")])
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    known = F.array_compact(
        F.array(
            F.when(F.col("old_status") != "active", F.lit("relisted")),
            F.when(differs("price"), F.lit("price_change")),
            F.when(differs("mileage_km"), F.lit("mileage_change")),
            F.when(differs("seller_type") | differs("seller_name"), F.lit("seller_change")),
        )
    )
    found = F.when(F.col("__key").isNull(), F.array(F.lit("first_seen"))).otherwise(known)
    return incoming.join(old, F.col(key) == F.col("__key"), "left").select(key, F.explode(found).alias("kind"))


def missed(listings: DataFrame, seen: DataFrame, strikes: int = 2) -> DataFrame:
    """After a sweep, listings not seen gain a strike, seen ones lose all; at so many they are removed."""
    rows = listings.join(seen.select("listing_id").distinct().withColumn("__seen", F.lit(True)), "listing_id", "left")
    count = F.when(F.col("__seen"), 0).otherwise(F.coalesce("strikes", F.lit(0)) + 1)
    return rows.withColumn("strikes", count).withColumn("status", F.when((F.col("status") == "active") & (F.col("strikes") >= strikes), "removed").otherwise(F.col("status"))).drop("__seen")


def disappeared(listings: DataFrame, seen: DataFrame, at: Column, strikes: int = 2) -> DataFrame:
    """The events of a sweep: (listing_id, kind, observed_at, price, mileage_km) with the last state of each ad that it removes."""
    gone = missed(listings, seen, strikes).filter("status = 'removed'").select("listing_id")
    return listings.filter("status = 'active'").join(gone, "listing_id", "left_semi").select("listing_id", F.lit("disappeared").alias("kind"), at.alias("observed_at"), "price", "mileage_km")


def identities(tokens: DataFrame) -> DataFrame:
    """G1: (listing_id, vehicle_key): listings that share an identifier, through any chain of them, are one vehicle.

    tokens: (listing_id, token) with every VIN, plate or source id of a listing. Labels are the smallest listing id in
    reach. Each round every label takes the least one that it shares a token with, follows that to its end, and the
    groups so found become the labels of the next round; tokens of one label alone are done. Labels that lead
    elsewhere are gone from later rounds, so that a chain of any length closes in few rounds over ever less rows.
    """
    rows = tokens.filter("token is not null").select(F.col("listing_id").alias("label"), "token").distinct()
    steps = []
    while True:
        edges = settle(rows)
        least = edges.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("token", "least")
        shared = settle(edges.join(least, "token"))
        if shared.isEmpty():
            discard(edges, shared)
            break
        moved = _followed(settle(shared.groupBy("label").agg(F.min("least").alias("to"))))
        rows = shared.select("label", "token").join(moved, "label").select(F.col("to").alias("label"), "token").distinct()
        steps.append(moved)
    every = None
    for moved in reversed(steps):
        every = moved if every is None else settle(_through(moved, every))
    labels = tokens.select(F.col("listing_id").alias("label")).distinct()
    if every is None:
        return labels.select(F.col("label").alias("listing_id"), F.col("label").alias("vehicle_key"))
    return labels.join(every, "label", "left").select(F.col("label").alias("listing_id"), F.coalesce("to", "label").alias("vehicle_key"))


def _through(moved: DataFrame, further: DataFrame) -> DataFrame:
    """(label, to) of moved, to led on by further where that knows it."""
    on = further.select(F.col("label").alias("to"), F.col("to").alias("end"))
    return moved.join(on, "to", "left").select("label", F.coalesce("end", "to").alias("to"))


def _followed(moved: DataFrame) -> DataFrame:
    """(label, to) with to at its chain's end: a label leads to a lesser one or to itself, and steps double each time."""
    while True:
        on = moved.select(F.col("label").alias("to"), F.col("to").alias("end"))
        next_ = settle(moved.join(on, "to", "left").select("label", F.coalesce("end", "to").alias("to"), (F.col("end") < F.col("to")).alias("on")))
        ended = next_.filter("on").isEmpty()
        discard(moved)
        moved = next_.drop("on")
        moved.settled_at = next_.settled_at
        if ended:
            return moved


#: Identifiers from the most to the least telling, for the id of a new vehicle.
PRIORITY = ["vin", "regno", "listing"]


def stable_identities(tokens: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G1: (listing_id, vehicle_id, is_new) of every listing, and (old_id, vehicle_id) of the ids that are merged away.

    tokens: (listing_id, kind, token), kind one of PRIORITY; known: (kind, token, vehicle_id) of vehicles that are there.
    A group of listings keeps the least of the ids that its identifiers had; the others are recorded as merged into it, so
    that rows that still point there can follow. A group that had none gets a digest of its most telling identifier, which
    a rerun finds again. Null tokens are nobody's; a listing without any is a vehicle of its own.
    """
    own = tokens.select("listing_id").distinct().select("listing_id", F.lit("listing").alias("kind"), F.col("listing_id").cast("string").alias("token"))
    named = tokens.filter("token is not null").select("listing_id", "kind", F.col("token").cast("string").alias("token")).unionByName(own)
    groups = settle(identities(named.select("listing_id", F.concat_ws(":", "kind", "token").alias("token"))))
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("kind"))
    placed = named.join(groups, "listing_id").groupBy("vehicle_key", "kind", "token").agg(F.lit(1).alias("one"))
    old = placed.join(known.select("kind", F.col("token").cast("string").alias("token"), F.col("vehicle_id").alias("old_id")), ["kind", "token"], "left")
    best = old.groupBy("vehicle_key").agg(F.min("old_id").alias("kept"), F.min(F.struct(rank.alias("rank"), "kind", "token")).alias("best"))
    new = F.sha2(F.concat_ws(":", F.lit("vehicle"), "best.kind", "best.token"), 256)
    named_groups = settle(best.select("vehicle_key", F.coalesce(F.col("kept").cast("string"), new).alias("vehicle_id"), F.col("kept").isNull().alias("is_new")))
    assigned = groups.join(named_groups, "vehicle_key").select("listing_id", "vehicle_id", "is_new")
    merged = old.filter("old_id is not null").select("vehicle_key", F.col("old_id").cast("string").alias("old_id")).distinct().join(named_groups, "vehicle_key").filter("old_id <> vehicle_id").select("old_id", "vehicle_id").distinct()
    return assigned, merged


def match_method(plate_match: Column, vin_match: Column) -> Column:
    """The strongest evidence that an ad shows a known vehicle."""
    return F.when(plate_match, "exact_registration").when(vin_match, "exact_vin").otherwise("source_listing")


def upsert(current: DataFrame, incoming: DataFrame, synced_at: Column) -> DataFrame:
    """Listings after a reading. An ad that is there is active again; its first sight stays, its listing date
    moves only with a real publish date, and what a host had confirmed of it must be confirmed anew.

    current: (listing_id, price, published_at, listed_at, first_seen_at, status, confirmed_at); incoming: (listing_id,
    price, published_at).
    """
    new = incoming.select("listing_id", F.col("price").alias("n_price"), F.col("published_at").alias("n_published"), F.lit(True).alias("n_there"))
    rows = current.withColumn("o_there", F.lit(True)).join(new, "listing_id", "full_outer")
    there, known = F.col("n_there").isNotNull(), F.col("o_there").isNotNull()
    return rows.select(
        "listing_id",
        F.when(there, F.col("n_price")).otherwise(F.col("price")).alias("price"),
        F.when(there, F.col("n_published")).otherwise(F.col("published_at")).alias("published_at"),
        F.when(there, F.coalesce("n_published", F.when(known, F.col("listed_at")).otherwise(synced_at))).otherwise(F.col("listed_at")).alias("listed_at"),
        F.when(known, F.col("first_seen_at")).otherwise(synced_at).alias("first_seen_at"),
        F.when(there, "active").otherwise(F.col("status")).alias("status"),
        F.when(~there, F.col("confirmed_at")).alias("confirmed_at"),
    )


def host_evidence(listings: DataFrame, checks: DataFrame) -> DataFrame:
    """Listings after checks of their pages. Only the newest check of each counts, and only if it is later than
    the last reading and the last check; a price that changed leaves the listing without a deal score.

    listings: (listing_id, status, price, deal_score, synced_at, checked_at); checks: (listing_id, at, availability,
    seen_price).
    """
    newest = first_by(checks, ["listing_id"], F.desc("at"), F.col("availability"))
    rows = listings.join(newest, "listing_id", "left")
    counts = F.coalesce(F.col("status").isin("active", "reserved") & (F.col("at") >= F.col("synced_at")) & (F.col("checked_at").isNull() | (F.col("at") > F.col("checked_at"))), F.lit(False))
    on = counts & (F.col("availability") == "active")
    moved = F.coalesce(on & (F.col("seen_price") != F.col("price")), F.lit(False))
    status = F.when(on, "active").when(counts & (F.col("availability") == "missing"), "removed").when(counts & (F.col("availability") == "reserved"), "reserved").otherwise(F.col("status"))
    return rows.select(
        "listing_id", status.alias("status"), F.when(moved, F.col("seen_price")).otherwise(F.col("price")).alias("price"), F.when(~moved, F.col("deal_score")).alias("deal_score"), "synced_at",
        F.when(counts, F.col("at")).otherwise(F.col("checked_at")).alias("checked_at"),
    )


def quality_reasons(current_year: int, text: Column, conflict: Column | None = None, drivetrain: Column | None = None, generation: Column | None = None) -> Column:
    """The reasons against a listing, in their order. What a caller has no column for raises no reason."""
    none = F.lit(False)
    price, km, year = F.col("price"), F.col("mileage_km"), F.col("model_year")
    age = F.greatest(F.lit(0), F.lit(current_year) - year)
    bad_price = price.isNull() | (price <= 0)
    out_of_range = km.isNull() | (km < 0) | (km > 1_000_000)
    power = F.col("horsepower")
    checks = [
        (bad_price, "PRICE_NOT_POSITIVE"),
        (~bad_price & (price < price_floor(year, current_year)), "PRICE_BELOW_MODEL_YEAR_FLOOR"),
        (~bad_price & (price > 3_000_000), "PRICE_ABOVE_VALUATION_LIMIT"),
        (text.rlike(LEASE) & (price < 50_000), "LEASE_OR_MONTHLY_PRICE"),
        (text.rlike(WITHOUT_VAT), "VAT_EXCLUSIVE_PRICE"),
        (out_of_range, "MILEAGE_OUT_OF_RANGE"),
        (~out_of_range & (mileage_status(km, age, text) == "suspicious"), "MILEAGE_IMPLAUSIBLE_FOR_AGE"),
        (year.isNull() | (year < 1886) | (year > current_year + 2), "MODEL_YEAR_OUT_OF_RANGE"),
        ((power < 1) | (power > 2_000), "HORSEPOWER_OUT_OF_RANGE"),
        (none if conflict is None else conflict, "POWERTRAIN_CLASSIFICATION_CONFLICT"),
        ((F.trim("make") == "") | (F.trim("model") == ""), "MODEL_MISSING"),
        (F.col("fuel_type") == "other", "FUEL_TYPE_UNKNOWN"),
        (F.col("body_style") == "other", "BODY_STYLE_UNKNOWN"),
        (F.col("transmission") == "other", "TRANSMISSION_UNKNOWN"),
        (none if drivetrain is None else F.coalesce(drivetrain, F.lit("other")).isin("", "other"), "DRIVETRAIN_UNKNOWN"),
        (none if generation is None else F.coalesce(generation, F.lit("")) == "", "GENERATION_UNKNOWN"),
        ((F.col("seller_type") == "dealer") & (F.trim(F.coalesce("seller_name", F.lit(""))) == ""), "DEALER_IDENTITY_MISSING"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))


def quality_status(reasons: Column) -> Column:
    return F.when(F.arrays_overlap(reasons, F.array(*[F.lit(r) for r in REJECTING])), "rejected").when(F.size(reasons) > 0, "warning").otherwise("valid")
