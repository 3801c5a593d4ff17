"""Source documents to rows: search payloads, result lists, embedded page state, relative dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AD = "id string, ad_id long, heading string, canonical_url string, location string, price struct<amount:double>, year double, mileage double, make string, model string, model_specification string, regno string, chassis_number string, image_urls array<string>"
PAGE = f"docs array<struct<{AD.replace(' string', ':string').replace(' long', ':long').replace(' double', ':double').replace(' struct', ':struct').replace(' array', ':array')}>>, metadata struct<result_size:struct<match_count:long>,paging:struct<current:int,last:int>>"


def search_page(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """S3: a row an ad of JSON search pages; `rejected` says that something needed is missing."""
    page = payloads.withColumn("page", F.from_json(column, PAGE))
    ads = page.select(*[c for c in payloads.columns if c != column], F.col("page.metadata.result_size.match_count").alias("total_matches"), F.explode("page.docs").alias("ad"))
    needed = [F.coalesce("ad.id", F.col("ad.ad_id").cast("string")), *[F.col(f"ad.{c}") for c in ("heading", "canonical_url", "location", "make")]]
    missing = F.lit(False)
    for c in needed:
        missing = missing | c.isNull() | (c == "")
    missing = missing | F.col("ad.price.amount").isNull() | (F.col("ad.price.amount") == 0) | F.col("ad.year").isNull()
    return ads.select(
        *[c for c in ads.columns if c not in ("ad",)], needed[0].alias("external_id"), "ad.heading", "ad.canonical_url", "ad.location", F.floor(F.col("ad.price.amount") + 0.5).alias("price"), F.floor(F.col("ad.year") + 0.5).cast("int").alias("model_year"),
        (F.floor(F.coalesce("ad.mileage", F.lit(0.0)) + 0.5) * 10).alias("mileage_km"), F.col("ad.mileage").isNotNull().alias("mileage_known"), "ad.make",
        F.coalesce("ad.model", "ad.model_specification", "ad.heading").alias("model"), F.col("ad.model_specification").alias("variant"), F.col("ad.regno").alias("plate"), F.col("ad.chassis_number").alias("vin"),
        F.coalesce("ad.image_urls", F.array().cast("array<string>")).alias("images"), missing.alias("rejected"),
    )


#: Entities and what they stand for.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&aring;", "å"), ("&auml;", "ä"), ("&ouml;", "ö"), ("&amp;", "&")]


def text_of_html(html: Column) -> Column:
    """Tags off, entities decoded, one space."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def result_list(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """A row for each hit of HTML result lists: its first link, title, year, distance and price; ids once a page."""
    blocks = F.regexp_extract_all(column, F.lit(r'(?s)<li class="result-list-item[^"]*"[^>]*>(.*?)</li>'), F.lit(1))
    b = pages.select(key, F.posexplode(blocks).alias("position", "block"))
    of = lambda p, n=1: F.nullif(F.regexp_extract("block", p, n), F.lit(""))
    number = lambda c: F.nullif(F.regexp_replace(c, r"\D", ""), F.lit("")).cast("long")
    specs = text_of_html(of(r"(?s)<p class=\"specs\"[^>]*>(.*?)</p>"))
    hit = b.select(
        key, "position", of(r'data-(?:model|ad)-id="(\d+)"').alias("external_id"), of(r'href="([^"#?]+)"').alias("path"), text_of_html(of(r"(?s)<a[^>]*href=[^>]*>(.*?)</a>")).alias("title"),
        F.nullif(F.regexp_extract(specs, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int").alias("model_year"), (number(F.regexp_extract(specs, r"(?i)([\d\s]+)mil\b", 1)) * 10).alias("mileage_km"),
        number(of(r"(?s)price[^>]*>([^<]*?)kr")).alias("price"), text_of_html(of(r"(?s)<p class=\"published[^>]*>(.*?)</p>")).alias("published"),
    )
    hit = hit.withColumn("rejected", F.col("external_id").isNull() | F.col("path").isNull() | F.coalesce(F.col("title") == "", F.lit(True)))
    first = hit.groupBy(key, "external_id").agg(F.min("position").alias("position"))
    return hit.join(first, [key, "external_id", "position"], "left_semi").unionByName(hit.filter("external_id is null"))


def embedded_state(html: Column, script_id: str = "__NEXT_DATA__") -> Column:
    """The JSON a page carries in a script, as a variant; null where there is none or it is broken."""
    raw = F.nullif(F.regexp_extract(html, rf'(?s)<script id="{script_id}"[^>]*>(.*?)</script>', 1), F.lit(""))
    return F.try_parse_json(raw)


def spec_table(html: Column) -> Column:
    """Terms and definitions of a page as a map, the last of a term staying."""
    terms = F.regexp_extract_all(html, F.lit(r"(?s)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>.*?</dd>"), F.lit(1))
    values = F.regexp_extract_all(html, F.lit(r"(?s)<dt[^>]*>.*?</dt>\s*<dd[^>]*>(.*?)</dd>"), F.lit(1))
    return F.aggregate(F.arrays_zip(terms.alias("t"), values.alias("v")), F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != text_of_html(x["t"])), F.create_map(text_of_html(x["t"]), text_of_html(x["v"]))))


#: Beginnings of Swedish units of time, and seconds in each.
UNITS = [("min", 60), ("tim", 3600), ("dyg", 86_400), ("dag", 86_400), ("veck", 604_800), ("mån", 2_592_000), ("år", 31_536_000)]


def published_at(label: Column, now: Column) -> Column:
    """The moment a relative age means."""
    value = F.lower(F.trim(label))
    amount = F.nullif(F.regexp_extract(value, r"(\d+)\s*(?:min|tim|dyg|dag|veck|mån|år)", 1), F.lit("")).cast("long")
    unit = F.regexp_extract(value, r"\d+\s*(min|tim|dyg|dag|veck|mån|år)", 1)
    seconds = F.lit(None).cast("long")
    for name, n in reversed(UNITS):
        seconds = F.when(unit == name, n).otherwise(seconds)
    return F.when(value.contains("just nu") | value.contains("nyss"), now).otherwise(F.timestamp_micros(F.unix_micros(now) - amount * seconds * 1_000_000))


def split_partition(part: dict, most: int = 2450) -> list[dict]:
    """Halves of a search that has more results than a source gives: by year, else price, else distance."""
    if part["count"] <= most:
        return [part]
    for name in ("year", "price", "mileage"):
        low, high = part.get(f"min_{name}"), part.get(f"max_{name}")
        if low is not None and high is not None and high > low:
            middle = (low + high) // 2
            return [{**part, f"max_{name}": middle, "count": None}, {**part, f"min_{name}": middle + 1, "count": None}]
    return [part]


def retained(payload: Column, policy: str) -> Column:
    """The raw payload as a policy keeps it."""
    if policy == "full":
        return payload
    return F.to_json(F.struct(F.sha2(payload, 256).alias("sha256"), F.length(payload).alias("length"))) if policy == "metadata" else F.lit(None).cast("string")


def export(rows: DataFrame, path: str, *order: str) -> str:
    """Write a snapshot once, never over another, and give the digest of its rows in order-free form."""
    rows.write.mode("errorifexists").json(path)
    digest = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("d")).agg(F.sha2(F.concat_ws("|", F.count("*"), F.min("d"), F.max("d"), F.sum(F.conv(F.substring("d", 1, 12), 16, 10).cast("decimal(38,0)"))), 256))
    return digest.first()[0]


def fuel_consumption(raw: Column) -> Column:
    """The first number of a text, its first comma being a decimal point; of 1.2.3 the leading 1.2 counts."""
    point = F.regexp_replace(raw, "^([^,]*),", "$1.")
    run = F.regexp_extract(point, r"([0-9.]+)", 1)
    return F.regexp_extract(run, r"^([0-9]+\.?[0-9]*|\.[0-9]+)", 1).try_cast("double")


#: Wording of pages whose ad is gone, of challenges, and of headings.
PAGE_DEACTIVATED = "(?iu)annonsen är inte längre tillgänglig|varan har sålts eller tagits bort|har sålts eller tagits bort från marknaden"
PAGE_NOT_FOUND = "(?iu)sidan (?:kunde inte hittas|hittades inte|kunde inte hämtas)|hittade inte sidan"
CHALLENGE = "(?i)cf-chl-|challenge-platform|verify you are human|captcha-container"
HEADING_GONE = "(?iu)^(?:(?:den h[äa]r |denna )?(?:annons(?:en)?|bil(?:en)?|fordon(?:et)?)\\s+(?:[äa]r\\s+)?(?:s[åa]ld|borttagen|inte l[äa]ngre tillg[äa]nglig)|annonsen (?:finns inte|har tagits bort))"
HEADING_RESERVED = "(?iu)^(?:(?:den h[äa]r |denna )?bil(?:en)?\\s+(?:[äa]r\\s+)?reserverad)"
BADGE = "(?iu)>\\s*(?:(?:den h[äa]r |denna )?bil(?:en)?\\s+(?:[äa]r\\s+)?)?(?:s[åa]ld|reserverad|sold|reserved)\\s*<"


def page_availability(status: Column, html: Column) -> Column:
    """A struct (availability, kind) of an ad's page: missing pages are purged or deactivated."""
    verdict = lambda a, k=None: F.struct(F.lit(a).alias("availability"), F.lit(k).cast("string").alias("kind"))
    return (
        F.when(status.isin(404, 410), verdict("missing", "purged"))
        .when(status.isNull() | (status < 200) | (status >= 300), verdict("inconclusive"))
        .when(html.isNull() | (F.length(html) < 200), verdict("inconclusive"))
        .when(html.rlike(PAGE_DEACTIVATED), verdict("missing", "deactivated"))
        .when(html.rlike(PAGE_NOT_FOUND), verdict("missing", "purged"))
        .otherwise(verdict("active"))
    )


def _path(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.try_url_decode(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))), "/+$", ""))


def host_availability(status: Column, html: Column, url: Column, listing_url: Column) -> Column:
    """X11: a struct (availability, price) of what the seller's own page shows of an ad: active, missing, reserved or inconclusive.

    The page's main offer is the first JSON-LD script that has one. A page is active only if it is the ad's own and
    its offer has a price.
    """
    part = lambda p: F.regexp_extract(html, p, 1)
    heading = F.trim(F.regexp_replace(part(r"(?is)<h1\b[^>]*>(.*?)</h1>"), "<[^>]*>", " "))
    canonical = F.coalesce(F.nullif(part(r"""(?i)<link\b[^>]*rel=["']canonical["'][^>]*href=["']([^"']+)"""), F.lit("")), F.nullif(part(r"""(?i)<link\b[^>]*href=["']([^"']+)["'][^>]*rel=["']canonical["']"""), F.lit("")))
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    car = F.get(F.filter(F.transform(scripts, lambda x: F.from_json(x, "url string, offers struct<availability:string, price:string>")), lambda c: c["offers"].isNotNull()), F.lit(0))
    offered = F.lower(F.element_at(F.split(F.coalesce(car["offers"]["availability"], F.lit("")), "/"), -1))
    rendered = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", "")
    price = car["offers"]["price"].try_cast("double")
    verdict = lambda a, p=None: F.struct(F.lit(a).alias("availability"), (F.lit(None) if p is None else F.floor(p + 0.5)).cast("long").alias("price"))
    other = lambda u: u.isNotNull() & (_path(u) != _path(listing_url))
    return (
        F.when(status.isNull() | status.isin(401, 403, 408, 425, 429) | (status >= 500) | F.coalesce(html.rlike(CHALLENGE), F.lit(False)), verdict("inconclusive"))
        .when(status.isin(404, 410), verdict("missing"))
        .when((status < 200) | (status >= 300) | (F.coalesce(F.length(html), F.lit(0)) < 100), verdict("inconclusive"))
        .when(heading.rlike(HEADING_GONE), verdict("missing"))
        .when(heading.rlike(HEADING_RESERVED), verdict("reserved"))
        .when(other(canonical) | other(F.coalesce(url, F.lit(""))) | other(car["url"]), verdict("inconclusive"))
        .when(offered.isin("soldout", "outofstock", "discontinued"), verdict("missing"))
        .when(offered.isin("reserved", "preorder"), verdict("reserved"))
        .when(rendered.rlike(BADGE) | ~F.coalesce(price > 0, F.lit(False)), verdict("inconclusive"))
        .otherwise(verdict("active", price))
    )


def detail(payload: Column) -> Column:
    """A struct (description, equipment, specifications, images) of an ad's JSON; blank texts are left out, images may be unknown."""
    d = F.from_json(payload, "description string, equipment array<string>, specifications map<string,string>, publicPageImageUrls array<string>")
    told = lambda x: F.trim(x) != ""
    listed = lambda c: F.transform(F.filter(c, told), lambda x: F.trim(x))
    return F.struct(
        F.nullif(F.trim(d["description"]), F.lit("")).alias("description"),
        F.coalesce(listed(d["equipment"]), F.array().cast("array<string>")).alias("equipment"),
        F.transform_values(F.map_filter(F.coalesce(d["specifications"], F.create_map().cast("map<string,string>")), lambda _, v: told(v)), lambda _, v: F.trim(v)).alias("specifications"),
        listed(d["publicPageImageUrls"]).alias("images"),
    )


def located(rows: DataFrame, name: str, places: DataFrame) -> DataFrame:
    """Latitude and longitude by a town's name, else by the last word of the name. places (place, latitude, longitude) is small."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"\s+kommun$", ""), r"\s+", " ")
    at = lambda k: places.select(F.col("place").alias(k), F.struct("latitude", "longitude").alias(f"at_{k}"))
    keyed = rows.withColumn("whole", key).withColumn("last", F.element_at(F.split("whole", " "), -1))
    found = keyed.join(at("whole"), "whole", "left").join(at("last"), "last", "left")
    return found.withColumn("at", F.coalesce("at_whole", "at_last")).select(*rows.columns, F.col("at.latitude").alias("latitude"), F.col("at.longitude").alias("longitude"))
