from datetime import datetime

import pytest

from lotlens.operators import assistant, stored

ADS = "listing_id string, vehicle_id long, status string, make string, model string, variant string, provider string, fuel_type string, transmission string, drivetrain string, body_style string, seller_type string, first_seen_at timestamp, last_seen_at timestamp, price long, model_year int, mileage_km long, horsepower long"


def _ad(spark, **own):
    base = dict(listing_id="a", vehicle_id=1, status="active", make="Volkswagen", model="Golf", variant="GTI", provider="s", fuel_type="petrol", transmission="manual", drivetrain=None, body_style="suv", seller_type="dealer", first_seen_at=datetime(2024, 1, 5), last_seen_at=datetime(2024, 1, 6), price=100_000, model_year=2020, mileage_km=50_000, horsepower=245)
    return spark.createDataFrame([tuple({**base, **own}.values())], ADS)


@pytest.mark.parametrize(
    ("asked", "own", "found"),
    [
        ({"query": "vw golf"}, {}, True),
        ({"query": "vw polo"}, {}, False),
        ({"makes": ["vw"]}, {}, True),
        ({"min_horsepower": 246}, {}, False),
        ({"min_horsepower": 245, "max_horsepower": 245}, {}, True),
        ({"max_mileage_mil": 5_000}, {}, True),
        ({"max_mileage_mil": 4_999}, {}, False),
        ({"max_mileage_mil": 5_000}, {"mileage_km": None}, False),
        ({"no_commercial": True}, {"body_style": "van"}, False),
        ({"no_commercial": True, "body_style": "van"}, {"body_style": "van"}, True),
        ({"no_commercial": True}, {"body_style": None}, False),
        ({"posted_within": "week"}, {}, True),
        ({"posted_within": "today"}, {}, False),
        ({"drivetrain": "awd"}, {}, False),
        ({}, {"status": "removed"}, False),
    ],
)
def test_assistant_matching(spark, asked, own, found):
    assert (assistant.matching(_ad(spark, **own), assistant.requested(asked), datetime(2024, 1, 8)).count() == 1) is found


@pytest.mark.parametrize("bad", [{"min_price": 5, "max_price": 4}, {"min_price": -1}, {"max_price": 10_000_001}, {"min_year": True}, {"makes": "Volvo"}, {"models": ["x"] * 21}, {"makes": [""]}, {"posted_within": "year"}, {"query": "x" * 101}, {"place": "Lund"}])
def test_invalid_searches(bad):
    with pytest.raises(assistant.InvalidSearch):
        assistant.requested(bad)


def test_merged_and_ignored():
    trusted = assistant.requested({"makes": ["Volvo", "Volvo "], "max_price": 9, "license_plate": "ABC123", "origin_latitude": 59.0})
    assert trusted.makes == ("Volvo",)
    out = assistant.merged(trusted, assistant.requested({"max_price": 5, "makes": []}))
    assert (out.makes, out.max_price, out.min_price) == (("Volvo",), 5, None)


def test_shown_and_repaired(spark):
    schema = "listing_id string, price long, model_year int, market_value long, range_low double, range_high double, comparable_count long, deal_score long, buy_score long, confidence_score long, confidence string"
    rows = [("none", 100_400, 2020, None, None, None, None, None, None, None, None), ("weak", 100_000, 2020, 200_000, 180e3, 220e3, 5, 80, 70, 49, "high"), ("sure", 100_000, 2020, 80_000, 70e3, 90e3, 3, 80, 70, 50, "high"), ("fake", 34_999, 2020, 100_000, 90e3, 110e3, 3, 95, 70, 80, "high"), ("floor", 10_000, 2020, 12_000, 9e3, 13e3, 2, 95, 70, 80, "high"), ("empty", None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = {r.listing_id: r.shown for r in stored.shown(df).collect()}
    assert tuple(got["none"]) == (100_400.0, 90_000.0, 110_000.0, 0, None, "not_assessed", 50)
    assert got["weak"].deal_score is None and got["weak"].deal_verdict == "assessed" and got["sure"].deal_score == 80
    assert got["empty"].market_value is None
    fixed = {r.listing_id: (r.deal_score, r.confidence, r.discount_bps) for r in stored.repaired(df, 2022).collect()}
    assert fixed == {"none": (None, None, None), "weak": (80, "high", 5000), "sure": (80, "high", -2500), "fake": (50, "low", 6500), "floor": (50, "low", None), "empty": (None, None, None)}


def test_of_cohorts(spark):
    ads = _ad(spark).union(_ad(spark, listing_id="b")).union(_ad(spark, listing_id="c", last_seen_at=datetime(2024, 1, 7))).union(_ad(spark, listing_id="d", vehicle_id=2, model="Polo")).union(_ad(spark, listing_id="e", vehicle_id=3, model=None))
    targets = spark.createDataFrame([("Volkswagen", "Golf"), ("Volkswagen", "Golf"), ("Volkswagen", None)], "make string, model string")
    assert [r.listing_id for r in stored.of_cohorts(ads, targets).collect()] == ["c"]
    assert stored.of_cohorts(ads, targets.limit(0)).count() == 0
