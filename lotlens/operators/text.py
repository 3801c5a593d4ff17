"""Classifiers of listing text, as ordered patterns over text without diacritics."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that are an ASCII letter with marks, by their canonical decomposition, and that letter.
_BASES = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
_MARKED = "".join(c for c, base in _BASES.items() if base != c and base.isascii() and base.isalpha())
_PLAIN = "".join(_BASES[c].lower() for c in _MARKED)
#: Wordings.
LEASE = r"(?i)\b(privatleasing|f[öo]retagsleasing|billeasing|leasingpris|kontantinsats|handpenning|m[åa]nadskostnad)\b"
WITHOUT_VAT = r"(?i)\b(exkl\.?\s*moms|exklusive\s+moms|moms\s+tillkommer|pris\s+ex\.?\s*moms)\b"
MONTHLY = r"(?i)leasing|leasa|hyrk[öo]p|avbetalning|delbetalning|kontantinsats|handpenning|per m[åa]nad|/\s?m[åa]n\b|m[åa]nads(kostnad|pris)"
PHEV = r"(?i)\b(plug[\s-]?in(\s+hybrid)?|plugin|phev|laddhybrid|twin engine)\b"
MHEV = r"(?i)\b(mild[\s-]?hybrid|mhev|48\s?v(olt)?)\b"
HEV = r"(?i)\b(self[\s-]?charging|full[\s-]?hybrid|hev|sj[äa]lvladdande\s+hybrid)\b"
BEV = r"(?i)\b(bev|helelektrisk|elbil|battery electric)\b"
DEFECTS = [
    ("repair_object", 5, r"\b(rep\s*object|repobjekt|reparationsobjekt|reservdelsbil|reservdelar)\b"),
    ("major_defect", 4, r"\b(motorhaveri|motorfel|vaxelladsfel|vaxellada\s+trasig|startar\s+(inte|ej)|gar\s+(inte|ej)|ej\s+korbar|bogseras|krockskadad|brandskadad|vattenskadad|motor\s+trasig)\b"),
    ("significant_mechanical", 3, r"\b(defekt|kopplingsfel|turbo\s*fel|kamkedj\w*\s+(fel|problem)|oljelackage|kylvatskelackage|missljud\s+(fran|i)\s+(motor|vaxellada))\b"),
    ("minor_mechanical", 2, r"\b(ac\s+(fungerar\s+inte|ur\s+funktion)|sensor\s+fel|varningslampa|mindre\s+fel|behover\s+atgardas)\b"),
    ("minor_cosmetic", 1, r"\b(repor|repa|buckla|dorruppslag|lackskada|kosmetisk\w*\s+skada|stensprut)\b"),
]
_FIXED, _FINE = r"(bytt|byttes|utbytt|renoverad|reparerad|atgardad|fixad)", r"(fungerar|felfri|utan problem|idag|sedan dess|gar bra)"
REPAIRED = rf"\b{_FIXED}\b.{{0,80}}\b{_FINE}\b|\b{_FINE}\b.{{0,80}}\b{_FIXED}\b"
KINDS = [
    ("a_tractor", r"\b(a traktor|atraktor|epa traktor|epatraktor)\b"),
    ("motorhome", r"\b(husbil|motorhome|campervan|platis)\b"),
    ("special_vehicle", r"\b(ambulans|likbil|brandbil|arbetsfordon|specialfordon)\b"),
]


def searchable(text: Column) -> Column:
    """Lower case, no diacritics, one space for whatever is no letter or digit."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[\u0300-\u036f]", "")
    plain = F.translate(bare, _MARKED, _PLAIN)
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def powertrain(fuel: Column, text: Column) -> Column:
    """A struct (type, conflict): wording before the source's fuel, and whether they contradict each other."""
    t = F.coalesce(text, F.lit(""))
    named = F.when(t.rlike(PHEV), "phev").when(t.rlike(MHEV), "mhev").when(t.rlike(HEV), "hev").when(t.rlike(BEV), "bev")
    source = (
        F.when(fuel == "electric", "bev").when(fuel == "plug_in_hybrid", "phev").when(fuel == "self_charging_hybrid", "hev").when(fuel == "hydrogen", "hydrogen")
        .when(fuel.isin("petrol", "diesel", "ethanol"), "combustion").otherwise("unknown")
    )
    fits = (source == "unknown") | (source == named) | ((source == "combustion") & named.isin("phev", "mhev", "hev")) | ((source == "hev") & (named == "mhev"))
    return F.struct(F.coalesce(named, source).alias("type"), (named.isNotNull() & ~F.coalesce(fits, F.lit(False))).alias("conflict"))


def defect(title: Column, description: Column) -> Column:
    """The worst defect any sentence names; grave ones don't count where the sentence says they were mended."""
    whole = F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(description, F.lit("")))
    sentences = F.transform(F.split(whole, r"[.!?\n]+"), searchable)

    def rank(s: Column) -> Column:
        mended = s.rlike(REPAIRED)
        out = F.lit(0)
        for _, n, pattern in reversed(DEFECTS):
            hit = s.rlike(pattern) & ~mended if n >= 3 else s.rlike(pattern)
            out = F.when(hit, n).otherwise(out)
        return out

    worst = F.array_max(F.transform(sentences, rank))
    out = F.lit("none")
    for name, n, _ in DEFECTS:
        out = F.when(worst == n, name).otherwise(out)
    return out


def vehicle_kind(title: Column, model: Column, variant: Column, body: Column) -> Column:
    """X5."""
    text = searchable(F.concat_ws(" ", title, model, variant))
    out = F.when(text.rlike(KINDS[0][1]), KINDS[0][0])
    for name, pattern in KINDS[1:]:
        out = out.when(text.rlike(pattern), name)
    return out.when((body == "van") | text.rlike(r"\b(skapbil|latt lastbil|transportbil)\b"), "light_commercial").when(body.isNotNull() & (body != "other"), "passenger_car").otherwise("unknown")


def transparency(text: Column, plate: Column, vin: Column, history: Column, owners: Column, defect_: Column) -> Column:
    """38 and what the ad tells, between 10 and 95."""
    t = searchable(text)
    told = [(plate, 10), (vin, 8), (F.length(t) >= 120, 7), (F.length(t) >= 350, 5), (history != "unknown", 10), (owners.isNotNull(), 7),
            (t.rlike(r"\b(besikt|inspektion|kontrollerad)\b"), 6), (t.rlike(r"\b(dack|vinterhjul|sommardack|monsterdjup)\b"), 5),
            (t.rlike(r"\b(skick|repor|buckla|lackskada|nyservad|bromsar|kamrem)\b"), 5), (defect_ != "none", 6)]
    return F.greatest(F.lit(10), F.least(F.lit(95), sum((F.when(c, n).otherwise(0) for c, n in told), F.lit(38))))


def seller_protection(seller: Column, title: Column, description: Column) -> Column:
    """Programmes, then months of warranty, then the word."""
    t = searchable(F.concat_ws(" ", title, description))
    months = F.nullif(F.regexp_extract(t, r"\b(\d{1,2})\s*(manaders?|man|ar)\s+(garanti|trygghet)\b", 1), F.lit("")).cast("int")
    return (
        F.when(seller == "private", 50).when(t.rlike(r"\b(certifierad begagnad|approved used|selekt|das welt auto|toyota quality)\b"), 85)
        .when(months >= 12, 78).when(months.isNotNull(), 66).when(t.rlike(r"\b(garanti|begagnatgaranti|trafiksakerhetsgaranti)\b"), 62).otherwise(50)
    )


def mileage_status(km: Column, age: Column, text: Column) -> Column:
    """X8."""
    odd = km.isNull() | (km < 0) | (km > 1_000_000)
    new = (age <= 1) & F.coalesce(text, F.lit("")).rlike(r"(?i)\b(ny|fabriksny|leveransmil)\b")
    wrong = ((age >= 5) & (km < 1_000)) | ((age >= 10) & (km < 5_000)) | ((age <= 1) & (km > 100_000)) | ((age <= 3) & (km > 200_000))
    return F.when(odd, "suspicious").when((km == 0) & new, "verified").when(km == 0, "unknown").when(wrong, "suspicious").otherwise("plausible")


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href) of every link of raw pages, by one pattern over the page."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*href=["']([^"']*)["']"""), F.lit(1))
    return pages.select("page_id", F.posexplode(links).alias("position", "href"))


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
