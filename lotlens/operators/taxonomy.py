"""Canonical taxonomy: make, model family, generation, body, fuel, trim and performance from what sources write.

Rules are data; a few functions turn them into ordered `when` chains, so that the whole transform is one projection.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.operators.text import powertrain

VERSION = 3
#: Canonical makes and the keys they go by.
MAKES: dict[str, list[str]] = {
    "Kia": ["kia"], "Volkswagen": ["volkswagen", "vw"], "Volvo": ["volvo"], "Toyota": ["toyota"], "Renault": ["renault"], "Hyundai": ["hyundai"],
    "Mercedes-Benz": ["mercedesbenz", "mercedes", "merc"], "Porsche": ["porsche"], "SEAT": ["seat"], "CUPRA": ["cupra"], "BMW": ["bmw"], "Audi": ["audi"],
    "Skoda": ["skoda", "koda"], "Nissan": ["nissan"], "Peugeot": ["peugeot"], "Citroen": ["citroen", "citron"], "Ford": ["ford"], "Opel": ["opel"], "Tesla": ["tesla"],
    "Mazda": ["mazda"], "Honda": ["honda"], "Mitsubishi": ["mitsubishi"], "Subaru": ["subaru"], "Suzuki": ["suzuki"], "Land Rover": ["landrover"], "Jaguar": ["jaguar"],
    "MINI": ["mini"], "Dacia": ["dacia"], "Polestar": ["polestar"], "BYD": ["byd"], "XPeng": ["xpeng"], "NIO": ["nio"], "Rolls-Royce": ["rollsroyce"],
    "Alfa Romeo": ["alfaromeo"], "Lynk & Co": ["lynkco", "lynkandco"], "DS": ["ds", "dsautomobiles"],
}
#: Fixed values: (make, family, pattern, excluding pattern, body, generations as (from, to, label, facelift from)).
FAMILIES: list[tuple] = [
    ("Kia", "XCeed", r"\bx[\s_-]?cee'?d\b", None, None, []),
    ("Kia", "ProCeed", r"\bpro[\s_-]?cee'?d\b", None, None, []),
    ("Kia", "Ceed", r"\bcee'?d\b", r"\bx[\s_-]?cee'?d\b|\bpro[\s_-]?cee'?d\b", None, [(2006, 2012, "Mk1", None), (2012, 2018, "Mk2", None), (2018, 2031, "Mk3", 2022)]),
    ("Kia", "Niro", r"\b(?:e[\s-]?)?niro\b", None, None, []),
    ("Volkswagen", "Golf Sportsvan", r"\bsportsvan\b", None, "minivan", []),
    ("Volkswagen", "Golf Plus", r"\bgolf\b.*\bplus\b", None, "minivan", []),
    ("Volkswagen", "Golf Alltrack", r"\bgolf\b.*\balltrack\b", None, "estate", []),
    ("Volkswagen", "Golf", r"\bgolf\b", None, None, [(1974, 1983, "Mk1", None), (1983, 1992, "Mk2", None), (1991, 1997, "Mk3", None), (1997, 2004, "Mk4", None), (2003, 2009, "Mk5", None), (2008, 2013, "Mk6", None), (2012, 2020, "Mk7", 2018), (2019, 2031, "Mk8", None)]),
    ("Volvo", "V60 Cross Country", r"\bv60\b.*\bcross country\b", None, "estate", []),
    ("Volvo", "V90 Cross Country", r"\bv90\b.*\bcross country\b", None, "estate", []),
    ("Volvo", "V60", r"\bv60\b", None, "estate", [(2010, 2018, "Mk1", None), (2018, 2031, "Mk2", 2023)]),
    ("Volvo", "V90", r"\bv90\b", None, "estate", []),
    ("Volvo", "V70", r"\bv70\b", None, "estate", []),
    ("Volvo", "XC60", r"\bxc\s?60\b", None, "suv", [(2008, 2017, "Mk1", None), (2017, 2031, "Mk2", 2022)]),
    ("Volvo", "XC90", r"\bxc\s?90\b", None, "suv", []),
    ("Volvo", "XC40", r"\bxc\s?40\b", None, "suv", []),
    ("Toyota", "Corolla Cross", r"\bcorolla\b.*\bcross\b", None, None, []),
    ("Toyota", "Corolla Verso", r"\bcorolla\b.*\bverso\b", None, None, []),
    ("Toyota", "Corolla", r"\bcorolla\b", r"\bcross\b|\bverso\b", None, []),
    ("Toyota", "RAV4", r"\brav\s?4\b", None, None, []),
    ("Toyota", "ProAce", r"\bpro\s?ace\b", None, None, []),
    ("Renault", "Megane", r"\bm[eé]gane\b", None, None, [(1995, 2003, "I", None), (2002, 2009, "II", None), (2008, 2016, "III", None), (2015, 2023, "IV", None), (2022, 2031, "E-Tech", None)]),
    ("Renault", "Clio", r"\bclio\b", None, None, []),
    ("Renault", "Scenic", r"\bsc[eé]nic\b", r"\bgrand\b", None, []),
    ("Hyundai", "Ioniq 5", r"\bioniq\s?5\b", None, None, []),
    ("Hyundai", "Ioniq 6", r"\bioniq\s?6\b", None, None, []),
    ("Hyundai", "Ioniq", r"\bioniq\b", r"\bioniq\s?[56]\b", None, []),
    ("Hyundai", "i30", r"\bi\s?30\b", None, None, []),
    ("Mercedes-Benz", "Sprinter", r"\bsprinter\b", None, "van", []),
    ("Mercedes-Benz", "Vito", r"\bvito\b", None, "van", []),
    ("Mercedes-Benz", "Citan", r"\bcitan\b", None, None, []),
    ("Mercedes-Benz", "V-Class", r"\bv[\s-]?class\b|\bv\s?250\b|\bv\s?300\b|\bv\s?220\b", None, "minivan", []),
    ("Porsche", "911", r"\b911\b|\bcarrera\b", None, None, []),
    ("Porsche", "Cayenne", r"\bcayenne\b", None, None, []),
    ("Porsche", "Macan", r"\bmacan\b", None, None, []),
    ("Porsche", "Panamera", r"\bpanamera\b", None, None, []),
    ("Porsche", "Taycan", r"\btaycan\b", None, None, []),
    ("BMW", "X3 M", r"\bx3\s?m\b", None, None, []),
    ("BMW", "X3", r"\bx3\b", None, "suv", [(2003, 2010, "E83", None), (2010, 2017, "F25", None), (2017, 2024, "G01", 2022), (2023, 2031, "G45", None)]),
    ("Skoda", "Octavia", r"\boctavia\b", None, None, [(2004, 2013, "Mk2", None), (2012, 2020, "Mk3", 2017), (2019, 2031, "Mk4", None)]),
]
#: Words for bodies and fuels, and model suffixes that say the same, in the order they are tried.
BODIES = [
    (r"\bsportswagon\b", "estate"), (r"\bsportscombi\b", "estate"), (r"\btouring sports\b", "estate"), (r"\bkombi\b", "estate"), (r"\bavant\b", "estate"), (r"\bvariant\b", "estate"),
    (r"\b(?:sw|s/w)\b", "estate"), (r"\bestate\b", "estate"), (r"\bfarmari\b", "estate"), (r"\bhalvkombi\b", "hatchback"), (r"\bhatchback\b", "hatchback"), (r"\bliftback\b", "hatchback"),
    (r"\b[35]-?d(?:örrar|örrars|oor|oors|rs)?\b", "hatchback"), (r"\bshooting brake\b", "estate"), (r"\bsedan\b", "sedan"), (r"\bcoup[eé]\b", "coupe"),
    (r"\bcabriolet\b|\bconvertible\b|\bcabrio\b", "convertible"), (r"\bpick[\s-]?up\b", "pickup"), (r"\bminibuss\b|\bfamiljebuss\b", "minivan"), (r"\btransportbil\b|\bsk[åa]p\b", "van"),
]
FUELS = [
    (r"\bplug[\s-]?in hybrid\b|\bphev\b|\bladdhybrid\b|\bplugin\b", "plug_in_hybrid"), (r"\btwin engine\b", "plug_in_hybrid"),
    (r"\brecharge\b.*\bt[68]\b|\bt[68]\b.*\brecharge\b", "plug_in_hybrid"), (r"\bmild ?hybrid\b|\bmhev\b|\belhybrid\b", "self_charging_hybrid"),
    (r"\bself[\s-]?charging hybrid\b", "self_charging_hybrid"), (r"\bbev\b|\belbil\b|\belectric\b", "electric"),
]
SUFFIXES = [
    (r"(?i)\s+plug[\s-]?in hybrid$", None, "plug_in_hybrid"), (r"(?i)\s+phev$", None, "plug_in_hybrid"), (r"(?i)\s+sportswagon$", "estate", None),
    (r"(?i)\s+touring sports$", "estate", None), (r"(?i)\s+sw$", "estate", None), (r"(?i)\s+kombi$", "estate", None),
]
TRIMS = ["Advance Plus", "Advance", "Action", "GT-Line", "GT Line", "Momentum", "Momentum Advanced", "Inscription", "Inscription Expression", "R-Design", "M Sport", "M-Sport", "xLine", "X Line", "S line", "S-line", "Style", "Active", "Active Plus", "Executive", "Ultimate", "Premium", "Business", "Elegance", "Ambition", "Style Plus", "Core", "Plus", "Pro", "Life", "Move"]
PERFORMANCE = ["GT3 RS", "GT2 RS", "GT3", "Type R", "Black Series", "Polestar Engineered", "GTI", "GTE", "GTD", "T8", "M340i", "M240i", "M140i", "M135i", "Nismo", "quattro RS", "RS", "R"]
FALSE_FRIENDS = r"(?i)\bR[\s-]?line\b|\bR[\s-]?design\b|\bAMG[\s-]?line\b|\bN[\s-]?line\b|\bS[\s-]?line\b"
#: Suffixes are taken off in so many passes; no model carries more of them.
PASSES = 3


def chain(pairs: Iterable[tuple[Column, Column]]) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def make_key(make: Column) -> Column:
    return F.regexp_replace(F.lower(make), "[^a-z0-9]", "")


def _title(x: Column) -> Column:
    """Lower case, but for a letter that follows no other letter, digit or underscore; initcap sees the gap put before it."""
    gap = "\x01 "
    return F.replace(F.initcap(F.regexp_replace(F.lower(x), "(?<![a-z0-9_])(?=[a-z])", gap)), F.lit(gap), F.lit(""))


def canonical_make(make: Column) -> Column:
    """By alias; an unknown make in capitals is put in title case."""
    known = chain((make_key(make).isin(*keys), F.lit(name)) for name, keys in MAKES.items())
    trimmed = F.trim(make)
    return F.coalesce(known, F.when(trimmed.rlike("^[A-ZÅÄÖ0-9 .&-]{3,}$"), _title(trimmed)).otherwise(trimmed))


def tidy(model: Column) -> Column:
    """One space, straight apostrophes, engine letters joined in lower case."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(F.translate(model, "_´`", " ''"), r"\s+", " "), r"\s*/\s*", "/"))
    out = spaced
    for letter in "dei":
        out = F.regexp_replace(out, rf"(?i)\b(\d{{3}})\s*{letter}\b", f"$1{letter}")
    return out


def badge(make: Column, model: Column) -> Column:
    """The badge at the start of a model in its make's own form."""
    head = r"^([A-Za-z]{1,3})[\s-]*(\d{2,3})\s*(de|d|e)?\b"
    part = lambda n: F.regexp_extract(model, head, n)
    german = F.when(model.rlike(head), F.concat(F.upper(part(1)), part(2), F.lower(part(3)), F.regexp_replace(model, head, ""))).otherwise(model)
    m = r"(?i)^(M)\s*(\d{2,3})\s*([A-Za-z])?\b"
    of = lambda n: F.regexp_extract(model, m, n)
    bavarian = F.when(model.rlike(m), F.concat(F.upper(of(1)), of(2), F.lower(of(3)), F.regexp_replace(model, m, ""))).otherwise(model)
    return F.when(make == "Mercedes-Benz", german).when(make == "BMW", bavarian).otherwise(model)


def generation(bands: list[tuple], year: Column) -> Column:
    """A struct (generation, facelift) of the band whose middle is nearest the year; facelift is null if unknown."""
    options = [
        F.when(
            (year >= low) & (year < high),
            F.struct(F.abs(year - (low + high) / 2).alias("distance"), F.lit(k).alias("k"), F.lit(label).alias("generation"), (F.lit(None).cast("boolean") if lift is None else year >= lift).alias("facelift")),
        )
        for k, (low, high, label, lift) in enumerate(bands)
    ]
    best = F.array_min(F.array_compact(F.array(*options)))
    return F.struct(best["generation"].alias("generation"), best["facelift"].alias("facelift"))


def vocabulary(text: Column, words: list[str]) -> Column:
    """The first word that stands alone: between spaces, slashes, bars or brackets."""
    import re

    return F.coalesce(chain((text.rlike(rf"(?i)(?:^|[\s(/|]){re.escape(w)}(?:$|[\s)/|])"), F.lit(w)) for w in words), F.lit(None).cast("string"))


def canonical(vehicles: DataFrame) -> DataFrame:
    """Add canonical_make, family, generation, facelift, trim, performance, body, fuel, powertrain, contradictions.

    Input: make, model, variant, title, body_style, fuel_type, model_year. Inferences fill only what a source left as
    'other'; a disagreement is noted and the source's value kept.
    """
    v = vehicles.withColumn("canonical_make", canonical_make(F.col("make")))
    v = v.withColumn("__tidy", badge(F.col("canonical_make"), tidy(F.col("model"))))
    v = v.withColumn("__hay", F.concat_ws(" ", "__tidy", tidy(F.coalesce("variant", F.lit(""))), F.coalesce("title", F.lit(""))))
    of = lambda p: F.col("__hay").rlike("(?i)" + p)
    nothing = F.struct(F.lit(None).cast("string").alias("generation"), F.lit(None).cast("boolean").alias("facelift"))
    found = chain(
        (
            (F.col("canonical_make") == make) & of(pattern) & (F.lit(True) if but is None else ~F.col("__tidy").rlike("(?i)" + but)),
            F.struct(F.lit(family).alias("family"), F.lit(body).cast("string").alias("body"), (generation(bands, F.col("model_year")) if bands else nothing).alias("g")),
        )
        for make, family, pattern, but, body, bands in FAMILIES
    )
    v = v.withColumn("__rule", found)
    nothing_held = F.array().cast("array<string>")
    v = v.withColumn("__body", F.array(F.col("__rule.body"))).withColumn("__fuel", nothing_held)
    family = F.coalesce(F.col("__rule.family"), F.col("__tidy"))
    for _ in range(PASSES):  # C4
        v = v.withColumn("__family", family)
        hit = [F.col("__family").rlike(p) for p, _, _ in SUFFIXES]
        told = lambda k: F.array(chain((h, F.lit(rule[k]).cast("string")) for h, rule in zip(hit, SUFFIXES, strict=True)))  # noqa: B023, E731
        v = v.withColumn("__body", F.concat("__body", told(1))).withColumn("__fuel", F.concat("__fuel", told(2)))
        shorter = chain((h, F.regexp_replace("__family", p, "")) for h, (p, _, _) in zip(hit, SUFFIXES, strict=True))
        family = F.coalesce(F.nullif(F.trim(shorter), F.lit("")), F.col("__family"))
    v = v.withColumn("family", family)
    hay = F.lower("__hay")
    hints = lambda held, words: F.array_distinct(F.array_compact(F.concat(F.col(held), F.array(chain((hay.rlike(p), F.lit(x)) for p, x in words)))))
    v = v.withColumn("__body", hints("__body", BODIES)).withColumn("__fuel", hints("__fuel", FUELS))

    def filled(source: str, held: str) -> Column:
        return F.when((F.col(source) == "other") & (F.size(held) > 0), F.get(held, F.lit(0))).otherwise(F.col(source))

    def clash(source: str, held: str) -> Column:
        return F.when((F.col(source) != "other") & (F.size(held) > 0) & ~F.array_contains(F.col(held), F.col(source)), F.concat(F.lit(f"{source}: source="), F.col(source), F.lit(" tokens="), F.array_join(held, "/")))

    told = F.concat_ws(" ", F.coalesce("variant", F.lit("")), F.coalesce("title", F.lit("")))
    v = v.withColumn("performance", vocabulary(F.regexp_replace(told, FALSE_FRIENDS, " "), PERFORMANCE)).withColumn("trim", vocabulary(told, TRIMS))
    v = v.withColumn("trim", F.when(F.lower("trim") == F.lower("performance"), F.lit(None)).otherwise(F.col("trim")))
    fuel = filled("fuel_type", "__fuel")
    v = v.withColumn("fuel", F.when((F.col("performance") == "GTE") & (fuel == "other"), "plug_in_hybrid").otherwise(fuel)).withColumn("body", filled("body_style", "__body"))
    v = v.withColumn("contradictions", F.array_compact(F.array(clash("body_style", "__body"), clash("fuel_type", "__fuel")))).withColumn("powertrain", powertrain(F.col("fuel"), hay))
    v = v.withColumn("generation", F.col("__rule.g.generation")).withColumn("facelift", F.col("__rule.g.facelift")).withColumn("normalization_version", F.lit(VERSION))
    return v.drop("__tidy", "__hay", "__rule", "__family", "__body", "__fuel")


def outdated(vehicles: DataFrame) -> DataFrame:
    """Rows of another version, made anew, and which of their values changed."""
    old = vehicles.filter(F.col("normalization_version").isNull() | (F.col("normalization_version") != VERSION)).withColumnRenamed("family", "__was")
    new = canonical(old.drop("normalization_version"))
    return new.withColumn("changed", ~F.col("family").eqNullSafe(F.col("__was"))).drop("__was")
