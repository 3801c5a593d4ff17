import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lotlens.operators import brands, costs, taxonomy
from lotlens.sources import parsers

SCHEMA = "make string, model string, variant string, title string, body_style string, fuel_type string, model_year int"


def canonical(spark, rows):
    """Canonical forms of (make, model, variant, title, body, fuel, year), trailing values left out being unknown."""
    blank = (None, None, None, None, "other", "other", None)
    full = [(k, *row, *blank[len(row) :]) for k, row in enumerate(rows)]
    return taxonomy.canonical(spark.createDataFrame(full, "k int, " + SCHEMA)).orderBy("k").collect()


def test_models(spark):
    cases = [
        (("KIA", "Ceed SW Plug-In Hybrid"), dict(canonical_make="Kia", family="Ceed", body="estate", fuel="plug_in_hybrid")),
        (("kia", "X-Ceed"), dict(family="XCeed")),
        (("vw", "Golf I"), dict(canonical_make="Volkswagen", family="Golf")),
        (("Volkswagen", "Golf", "Sportsvan 1.4"), dict(family="Golf Sportsvan", body="minivan")),
        (("Toyota", "Corolla Touring Sports"), dict(family="Corolla", body="estate")),
        (("Mercedes", "C 220 d Avant"), dict(canonical_make="Mercedes-Benz", family="C220d Avant", body="estate")),
        (("BMW", "320 D"), dict(family="320d")),
        (("BMW", "X3", "xDrive M Sport"), dict(family="X3", body="suv", trim="M Sport")),
        (("Volkswagen", "Golf", "GTE"), dict(performance="GTE", fuel="plug_in_hybrid")),
        (("Volkswagen", "Golf", "R-Line"), dict(performance=None)),
        (("ACME MOTORS", "Zed Kombi"), dict(canonical_make="Acme Motors", family="Zed", body="estate")),
        (("Volvo", "XC 60", "Recharge T8"), dict(family="XC60", body="suv", fuel="plug_in_hybrid", performance="T8")),
    ]
    for got, (given, want) in zip(canonical(spark, [c[0] for c in cases]), cases, strict=True):
        assert {k: got[k] for k in want} == want, given


def test_generations_and_contradictions(spark):
    years = {2017: ("Mk7", False), 2018: ("Mk7", True), 2012: ("Mk6", None), 2024: ("Mk8", None), 1960: (None, None)}
    golfs = [("Volkswagen", "Golf", None, None, "other", "other", y) for y in years]
    *got, audi = canonical(spark, [*golfs, ("Audi", "A4 Avant", None, None, "sedan", "petrol")])
    assert [(r.generation, r.facelift) for r in got] == list(years.values())
    assert audi.body == "sedan" and audi.contradictions == ["body_style: source=sedan tokens=estate"]


def test_brands(spark):
    typed = ["VW", "wv", "mercedez", "volkswagon", "a4", "x", "Škoda", "zzzzzz", "tesla", None, "??", "vovlo", "alfa-romeo", "hnydai", "dcaia", "kiaa", "z"]
    rows = spark.createDataFrame([(t,) for t in typed], "typed string")
    got = {r.typed: r.make for r in brands.resolved(rows).collect()}
    want = {"VW": "Volkswagen", "wv": "Volkswagen", "mercedez": "Mercedes-Benz", "volkswagon": "Volkswagen", "Škoda": "Skoda", "tesla": "Tesla", "vovlo": "Volvo", "alfa-romeo": "Alfa Romeo", "dcaia": "Dacia", "kiaa": "Kia"}
    assert got == want


def plain_edits(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def test_edits_and_deletions_against_plain_python(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(0, 7)))
    pairs = [(word(), word()) for _ in range(300)] + [("ca", "abc"), ("vw", "wv")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", brands.edits(F.col("a"), F.col("b")).alias("n"), F.arrays_overlap(brands.deletions(F.col("a")), brands.deletions(F.col("b"))).alias("meet")).collect()
    for r in rows:
        assert r.n == plain_edits(r.a, r.b)
        assert r.meet or r.n > 2


def test_brand_options(spark):
    options = spark.createDataFrame([(x,) for x in ("Volkswagen", "Mercedes-Benz", "Volvo", "Kia", "Own Make")], "option string")
    typed = spark.createDataFrame([(x,) for x in ("vw", "mercedesbenz", "vovlo", "", "own", "zzz", "merc")], "typed string")
    got = {(r.option, r.typed) for r in brands.matching_options(options, typed).collect()}
    want = {("Volkswagen", "vw"), ("Mercedes-Benz", "mercedesbenz"), ("Volvo", "vovlo"), ("Own Make", "own"), ("Mercedes-Benz", "merc")} | {(o, "") for o in ("Volkswagen", "Mercedes-Benz", "Volvo", "Kia", "Own Make")}
    assert got == want


def test_result_list_and_state(spark):
    item = lambda i, t: f'<li class="result-list-item x" data-model-id="{i}"><a data-model-id="{i}" href="/ort/personbil-{i}"><b>{t}</b></a><p class="specs">2019 | 7 200 mil | Lund</p><b class="price">189 900 kr</b><p class="published-date">3 dagar</p></li>'
    html = "<ul>" + item(11, "V60 &amp; mer") + item(11, "V60") + '<li class="result-list-item"><p>annons</p></li>' + '</ul><script id="__NEXT_DATA__" type="application/json">{"a":{"b":[1,2]}}</script><dl><dt>Färg</dt><dd>R&ouml;d</dd><dt>Färg</dt><dd><b>Blå</b></dd></dl>'
    pages = spark.createDataFrame([(1, html), (2, "nothing")], "page_id long, html string")
    got = {(r.external_id, r.rejected): r for r in parsers.result_list(pages).collect()}
    assert set(got) == {("11", False), (None, True)}
    hit = got[("11", False)]
    assert (hit.title, hit.model_year, hit.mileage_km, hit.price, hit.published) == ("V60 & mer", 2019, 72_000, 189_900, "3 dagar")
    state = pages.select("page_id", F.variant_get(parsers.embedded_state(F.col("html")), "$.a.b[1]", "int").alias("x"), parsers.spec_table(F.col("html")).alias("m")).orderBy("page_id").collect()
    assert [r.x for r in state] == [2, None] and state[0].m == {"Färg": "Blå"} and state[1].m == {}


def test_search_payload(spark):
    page = '{"docs":[{"id":"7","heading":"Volvo V60","canonical_url":"u","location":"Lund","price":{"amount":199900.4},"year":2019,"mileage":7200,"make":"Volvo","model":"V60"},{"ad_id":8,"heading":"x"}],"metadata":{"result_size":{"match_count":2},"paging":{"current":1,"last":1}}}'
    got = parsers.search_page(spark.createDataFrame([(page,)], "payload string")).orderBy("external_id").collect()
    assert [(r.external_id, r.rejected) for r in got] == [("7", False), ("8", True)]
    assert (got[0].price, got[0].model_year, got[0].mileage_km, got[0].mileage_known, got[1].mileage_known) == (199_900, 2019, 72_000, True, False)


def test_relative_dates_and_partitions(spark):
    now = datetime(2026, 9, 2, 12)
    at = lambda x: spark.createDataFrame([(x,)], "x string").select(parsers.published_at(F.col("x"), F.lit(now))).first()[0]
    assert [at(x) for x in ("Just nu", "12 min", "3 dagar", "2 veckor", "1 år", "okänt", None)] == [now, datetime(2026, 9, 2, 11, 48), datetime(2026, 8, 30, 12), datetime(2026, 8, 19, 12), datetime(2025, 9, 2, 12), None, None]
    part = {"count": 3000, "min_year": 2010, "max_year": 2020}
    assert [(p["min_year"], p["max_year"]) for p in parsers.split_partition(part)] == [(2010, 2015), (2016, 2020)]
    assert parsers.split_partition({"count": 10}) == [{"count": 10}]


def test_export_never_overwrites(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    first = parsers.export(rows, str(tmp_path / "one"))
    assert first == parsers.export(rows.repartition(3), str(tmp_path / "two")) != parsers.export(rows.limit(1), str(tmp_path / "three"))
    with pytest.raises(Exception, match="exist"):
        parsers.export(rows, str(tmp_path / "one"))


def test_equipment(spark):
    labels = [(1, "Dragkrok"), (1, "Towbar"), (1, "Backkamera"), (1, "Bluetooth"), (2, "Askkopp"), (3, "AWD"), (3, "Quattro"), (3, "Värmepump")]
    got = {r.listing_id: (r.points, r.features) for r in costs.equipment_points(spark.createDataFrame(labels, "listing_id long, label string")).collect()}
    assert got == {1: (9, 3), 3: (10, 2)}


def test_ownership(spark):
    of = lambda *a: spark.range(1).select(costs.ownership(F.lit(a[0]), F.lit(a[1]), F.lit(a[2]), F.lit(a[3]).cast("double"), F.lit(a[4]).cast("int"), 2026).alias("c")).select("c.*").first()
    petrol = of(200_000, 2021, "petrol", 7.0, 190)
    assert (petrol.depreciation, petrol.energy, petrol.insurance, petrol.maintenance) == (26_000, 19_425, 8_100, 6_650) and not petrol.implausible_price
    assert of(200_000, 2026, "electric", None, None).tax == 360 and of(1, 2026, "electric", None, None).implausible_price


def test_insurance_and_reliability(spark):
    quotes = [("Volvo", "V60", "estate", "petrol", 200_000 + k, 500 + 10 * k, f"i{k % 2}") for k in range(4)] + [("Kia", "Ceed", "estate", "petrol", 150_000, 400, "i1")] * 2
    q = spark.createDataFrame(quotes, "make string, model string, body_style string, fuel_type string, value long, premium long, insurer string")
    targets = [("a", "volvo", "v60", "estate", "petrol", 210_000), ("b", "Kia", "Ceed", "estate", "petrol", 180_000), ("c", "Tesla", "3", "sedan", "electric", 1)]
    t = spark.createDataFrame(targets, "target_id string, make string, model string, body_style string, fuel_type string, value long")
    got = {r.target_id: r for r in costs.insurance_estimate(t, q).collect()}
    assert set(got) == {"a", "b"} and (got["a"].tier, got["a"].median_monthly, got["a"].insurers) == (1, 500, 2) and (got["b"].tier, got["b"].comparables) == (3, 6)
    profiles = [(1, "Volvo", "V60", 2018, 2024, None, None, None, None, True), (2, "volvo", "v60", 2018, 2024, "Mk2", None, None, "t6", True), (3, "Volvo", "V60", 2018, 2024, "Mk2", "petrol", None, None, False)]
    p = spark.createDataFrame(profiles, "profile_id int, make string, model string, year_from int, year_to int, generation string, fuel_type string, transmission string, engine string, sourced boolean")
    cars = spark.createDataFrame([(1, "Volvo", "V60", 2020, "Mk2", "petrol", "automatic", "T6 AWD"), (2, "Volvo", "V60", 2020, "Mk1", "petrol", "automatic", "D4"), (3, "Volvo", "V60", 2010, "Mk1", "petrol", "manual", "")], "vehicle_id int, make string, model string, model_year int, generation string, fuel_type string, transmission string, engine string")
    assert {r.vehicle_id: r.profile_id for r in costs.reliability(cars, p).collect()} == {1: 2, 2: 1}


def test_buyer_scores(spark):
    months = [(1, 100, -0.05, 20, 40.0), (2, 100, 0.05, 10, 40.0), (3, 10, 0.5, 0, 10.0)]
    got = {r.month: r for r in costs.buyer_scores(spark.createDataFrame(months, "month int, listing_count long, mean_log_residual double, reductions long, median_age_days double")).collect()}
    assert (got[1].score, got[1].verdict) == (72, "great") and (got[2].score, got[2].verdict) == (27, "expensive") and got[3].score is None
