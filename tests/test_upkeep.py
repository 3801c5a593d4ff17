"""Page verdicts, detail documents, places, titles and folded letters, against cases written out by hand."""

from pyspark.sql import functions as F

from lotlens.operators import taxonomy, text
from lotlens.sources import parsers

OFFER = '<script type="application/ld+json">{"@type": "Car", "url": "https://x.se/item/1/", "offers": {"availability": "https://schema.org/%s", "price": "%s"}}</script>'
FILL = "<p>" + "beskrivning " * 20 + "</p>"


def test_host_availability(spark):
    mine = "https://x.se/item/1"
    cases = [
        (None, FILL, mine, ("inconclusive", None)), (503, FILL, mine, ("inconclusive", None)), (410, "", mine, ("missing", None)), (302, FILL, mine, ("inconclusive", None)),
        (200, FILL + "cf-chl-x", mine, ("inconclusive", None)), (200, "kort", mine, ("inconclusive", None)),
        (200, FILL + "<h1 class='a'>Bilen är <b>såld</b></h1>", mine, ("missing", None)), (200, FILL + "<h1>Denna bil är såld</h1>", mine, ("missing", None)), (200, FILL + "<h1>Bilen är reserverad</h1>", mine, ("reserved", None)),
        (200, FILL + '<link rel="canonical" href="https://x.se/item/2">' + OFFER % ("InStock", "1000"), mine, ("inconclusive", None)),
        (200, FILL + OFFER % ("InStock", "1000"), "https://x.se/start", ("inconclusive", None)),
        (200, FILL + OFFER % ("SoldOut", "1000"), mine, ("missing", None)), (200, FILL + OFFER % ("PreOrder", "1000"), mine, ("reserved", None)),
        (200, FILL + OFFER % ("InStock", "1000") + "<span> Såld </span>", mine, ("inconclusive", None)), (200, FILL + OFFER % ("InStock", "gratis"), mine, ("inconclusive", None)), (200, FILL, mine, ("inconclusive", None)),
        (200, FILL + "<script>x('>sold<')</script>" + OFFER % ("InStock", "199900.4"), mine + "/", ("active", 199900)),
    ]
    docs = spark.createDataFrame([(k, s, h, u) for k, (s, h, u, _) in enumerate(cases)], "k int, status int, html string, url string")
    got = docs.select("k", parsers.host_availability(F.col("status"), F.col("html"), F.col("url"), F.lit(mine)).alias("v")).orderBy("k").collect()
    assert [tuple(r.v) for r in got] == [c[3] for c in cases]


def test_detail_and_numbers(spark):
    rows = [('{"description": " fin ", "equipment": ["a", " ", "b "], "specifications": {"x": "1 ", "y": ""}, "publicPageImageUrls": ["u"]}',), ("[]",), ("{}",)]
    got = spark.createDataFrame(rows, "p string").select(parsers.detail(F.col("p")).alias("d")).collect()
    assert (got[0].d.description, got[0].d.equipment, got[0].d.specifications, got[0].d.images) == ("fin", ["a", "b"], {"x": "1"}, ["u"])
    assert (got[2].d.description, got[2].d.equipment, got[2].d.specifications, got[2].d.images) == (None, [], {}, None)
    numbers = spark.createDataFrame([("6,5 l",), ("ca 4.9",), ("okänd",), (None,), ("1.2.3",)], "t string").select(parsers.fuel_consumption(F.col("t")).alias("n")).collect()
    assert [r.n for r in numbers] == [6.5, 4.9, None, None, 1.2]


def test_places(spark):
    places = spark.createDataFrame([("enköping", 59.6, 17.1), ("växjö", 56.9, 14.8)], "place string, latitude double, longitude double")
    rows = spark.createDataFrame([(1, "Växjö  kommun"), (2, "Bilhallen Enköping"), (3, "Nowhere"), (4, None)], "k int, town string")
    assert {r.k: r.latitude for r in parsers.located(rows, "town", places).collect()} == {1: 56.9, 2: 59.6, 3: None, 4: None}


def test_titles_and_folding(spark):
    names = spark.createDataFrame([("AUTO-UNION",), ("A.C. CARS",), ("ACME MOTORS",), ("Custom",)], "m string")
    assert [r[0] for r in names.select(taxonomy.canonical_make(F.col("m"))).collect()] == ["Auto-Union", "A.C. Cars", "Acme Motors", "Custom"]
    texts = spark.createDataFrame([("Växellådsfel",), ("Va\u0308xella\u030adsfel",), ("Škoda Žižka",)], "t string")
    assert [r[0] for r in texts.select(text.searchable(F.col("t"))).collect()] == ["vaxelladsfel", "vaxelladsfel", "skoda zizka"]
