import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lotlens.operators import catalogue, ingest, reports, text


def col(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("words", "want"),
    [
        ("Fin bil utan anmärkning", "none"),
        ("Reparationsobjekt, säljes i befintligt skick", "repair_object"),
        ("Motorhaveri!", "major_defect"),
        ("Kamkedjan är bytt och bilen fungerar. Repor på dörren.", "minor_cosmetic"),
        ("Defekt turbo som är utbytt och fungerar utan problem", "none"),
        ("Växellådsfel. Buckla.", "major_defect"),
        ("Varningslampa lyser", "minor_mechanical"),
        (None, "none"),
    ],
)
def test_defects(spark, words, want):
    assert col(spark, words, lambda x: text.defect(F.lit(None), x)) == want


@pytest.mark.parametrize(
    ("fuel", "words", "want", "conflict"),
    [("petrol", "Laddhybrid T6", "phev", False), ("electric", "Plug-in hybrid", "phev", True), ("petrol", "mild hybrid", "mhev", False), ("self_charging_hybrid", "MHEV", "mhev", False),
     ("diesel", "elbil", "bev", True), ("petrol", None, "combustion", False), ("other", "full hybrid", "hev", False), ("hydrogen", "", "hydrogen", False)],
)
def test_powertrain(spark, fuel, words, want, conflict):
    got = col(spark, words, lambda x: text.powertrain(F.lit(fuel), x))
    assert (got["type"], got["conflict"]) == (want, conflict)


def test_kind_protection_transparency(spark):
    kind = lambda t, body="other": col(spark, t, lambda x: text.vehicle_kind(x, F.lit(""), F.lit(""), F.lit(body)))
    assert [kind("Volvo A-traktor"), kind("Husbil Hymer"), kind("Skåpbil"), kind("V60", "estate"), kind("okänd")] == ["a_tractor", "motorhome", "light_commercial", "passenger_car", "unknown"]
    guard = lambda t, seller="dealer": col(spark, t, lambda x: text.seller_protection(F.lit(seller), F.lit(""), x))
    assert [guard("12 månaders garanti"), guard("6 mån garanti"), guard("garanti ingår"), guard("Das WeltAuto das welt auto"), guard("inget"), guard("12 månaders garanti", "private")] == [78, 66, 62, 85, 50, 50]
    full = col(spark, "kontrollerad, vinterhjul, fint skick", lambda x: text.transparency(x, F.lit(True), F.lit(True), F.lit("complete"), F.lit(2), F.lit("none")))
    assert full == 38 + 10 + 8 + 10 + 7 + 6 + 5 + 5


def test_mileage_status(spark):
    status = lambda km, age: col(spark, km, lambda x: text.mileage_status(x, F.lit(age), F.lit("")), "long")
    assert [status(0, 5), status(900, 5), status(1_000, 5), status(4_999, 10), status(100_001, 1), status(200_001, 3), status(1_000_001, 9), status(None, 1)] == ["unknown", "suspicious", "plausible", "suspicious", "suspicious", "suspicious", "suspicious", "suspicious"]


def test_identities_by_plain_search(spark):
    rng = random.Random(8)
    rows = [(k, f"t{rng.randrange(160)}") for k in range(200) for _ in range(rng.randint(0, 2))] + [(500, None)] + [(600 + k, f"c{k // 2}") for k in range(1)] + [(700 + k, f"chain{j}") for k in range(20) for j in (k, k + 1)]
    got = {r.listing_id: r.vehicle_key for r in ingest.identities(spark.createDataFrame(rows, "listing_id long, token string")).collect()}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, t in rows:
        if t is not None:
            by.setdefault(t, []).append(i)
    for ids in by.values():
        for i in ids[1:]:
            a, b = sorted((find(ids[0]), find(i)))
            root[b] = a
    assert got == {i: find(i) for i in root}


def test_merge_insert_and_strikes(spark):
    now = spark.createDataFrame([(1, 10, 5), (2, 20, 5)], "listing_id long, price long, at long")
    new = spark.createDataFrame([(1, 11, 6), (2, 21, 4), (3, 30, 1), (3, 30, 1)], "listing_id long, price long, at long")
    assert sorted(tuple(r) for r in ingest.merge(now, new, "listing_id", F.col("at")).collect()) == [(1, 11, 6), (2, 20, 5), (3, 30, 1)]
    assert [tuple(r) for r in ingest.insert_new(now, new, ["listing_id"]).collect()] == [(3, 30, 1)]
    ads = spark.createDataFrame([(1, "active", 1), (2, "active", 0), (3, "active", 1)], "listing_id long, status string, strikes int")
    left = {r.listing_id: (r.status, r.strikes) for r in ingest.missed(ads, spark.createDataFrame([(3,)], "listing_id long")).collect()}
    assert left == {1: ("removed", 2), 2: ("active", 1), 3: ("active", 0)}


def test_stockholm_days_change_length(spark):
    hours = lambda now: spark.createDataFrame([(0,)], "x int").join(reports.stockholm_day(spark, now)).select((F.unix_timestamp("end") - F.unix_timestamp("start")) / 3600).first()[0]
    assert [hours(datetime(2026, 3, 30, 9)), hours(datetime(2026, 10, 26, 9)), hours(datetime(2026, 9, 2, 9))] == [23, 25, 24]


def test_best_values(spark):
    cars = spark.createDataFrame([("a", 10, 5, 7), ("b", 20, 9, 7)], "listing_id string, price int, score int, seats int")
    got = {r.listing_id: (r.best_price, r.best_score, r.best_seats) for r in catalogue.best_values(cars, [("price", "lower"), ("score", "higher"), ("seats", "higher")]).collect()}
    assert got == {"a": (True, False, False), "b": (False, True, False)}


def test_stream_of_readings(spark, tmp_path):
    from lotlens.streaming import events

    t = datetime(2026, 1, 1)
    schema = "listing_id long, observed_at timestamp, status string, price long, mileage_km long"
    batches = [
        [(1, t, "active", 100, 10), (2, t, "active", 50, 5)],
        [(1, t + timedelta(hours=1), "active", 90, 10), (1, t - timedelta(hours=1), "active", 70, 10), (2, t + timedelta(hours=1), "removed", 50, 5)],
        [(2, t + timedelta(hours=2), "active", 50, 6)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        readings = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        run = events.changes(readings).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert run.exception() is None, k
    got = sorted((r.listing_id, r.kind, r.price) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "first_seen", 100), (1, "price_change", 90), (2, "disappeared", 50), (2, "first_seen", 50), (2, "mileage_change", 50), (2, "relisted", 50)]
    seen = events.daily_counts(spark.readStream.schema(events.CHANGE).parquet(str(tmp_path / "out")))
    assert seen.isStreaming and seen.columns == ["day", "kind", "n"]
