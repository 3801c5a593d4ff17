"""Searches of the assistant, a trusted search narrowed by a requested one, and the ads that match."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.operators.catalogue import search_text
from lotlens.operators.taxonomy import MAKES
from lotlens.operators.upkeep import RECENT, recent

#: Bounds of whole numbers, length of a query, of a list and of its entries, bodies that are no passenger cars.
BOUNDS = {"price": 10_000_000, "year": 3_000, "mileage_mil": 200_000, "horsepower": 3_000}
QUERY_LENGTH, LIST_LENGTH, ENTRY_LENGTH = 100, 20, 80
COMMERCIAL = ("van", "pickup")


class InvalidSearch(ValueError):
    """A requested search that breaks a rule."""


@dataclass(frozen=True)
class AssistantSearch:
    """What the assistant may ask for: no place, no plate. Empty values ask for nothing; mileages are in tens of kilometres."""

    query: str = ""
    makes: tuple[str, ...] = ()
    models: tuple[str, ...] = ()
    providers: tuple[str, ...] = ()
    fuel_types: tuple[str, ...] = ()
    transmission: str = ""
    drivetrain: str = ""
    body_style: str = ""
    seller_type: str = ""
    posted_within: str = ""
    min_price: int | None = None
    max_price: int | None = None
    min_year: int | None = None
    max_year: int | None = None
    min_mileage_mil: int | None = None
    max_mileage_mil: int | None = None
    min_horsepower: int | None = None
    max_horsepower: int | None = None
    no_commercial: bool = False


#: Asked by the search page, accepted and never read.
IGNORED = ("license_plate", "max_distance_km", "origin_latitude", "origin_longitude")


def requested(values: Mapping[str, object]) -> AssistantSearch:
    """A checked search from loose values; a key, type, bound or range that is not allowed raises InvalidSearch."""
    kinds = {f.name: f.default for f in fields(AssistantSearch)}
    out = {}
    for name, value in values.items():
        if name in IGNORED:
            continue
        if name not in kinds:
            raise InvalidSearch(f"{name} is not part of a search")
        if isinstance(kinds[name], tuple):
            if not isinstance(value, list | tuple) or len(value) > LIST_LENGTH or not all(isinstance(v, str) and 0 < len(v.strip()) <= ENTRY_LENGTH for v in value):
                raise InvalidSearch(f"{name} must be a short list")
            value = tuple(dict.fromkeys(v.strip() for v in value))
        elif kinds[name] is None:
            most = BOUNDS[name.split("_", 1)[1]]
            if value is not None and (isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= most):
                raise InvalidSearch(f"{name} must be a whole number up to {most}")
        elif isinstance(kinds[name], bool):
            if not isinstance(value, bool):
                raise InvalidSearch(f"{name} must be true or false")
        elif not isinstance(value, str) or len(value) > QUERY_LENGTH:
            raise InvalidSearch(f"{name} must be a short text")
        else:
            value = value.strip()
        out[name] = value
    found = AssistantSearch(**out)
    if found.posted_within and found.posted_within not in RECENT:
        raise InvalidSearch("posted_within is unknown")
    for what in BOUNDS:
        low, high = getattr(found, f"min_{what}"), getattr(found, f"max_{what}")
        if low is not None and high is not None and low > high:
            raise InvalidSearch(f"min_{what} exceeds max_{what}")
    return found


def merged(trusted: AssistantSearch, asked: AssistantSearch) -> AssistantSearch:
    """The trusted search, with every value that the asked one sets in its place."""
    empty = asdict(AssistantSearch())
    return AssistantSearch(**{**asdict(trusted), **{k: v for k, v in asdict(asked).items() if v != empty[k]}})


def canonical(name: str, makes: Mapping[str, list[str]] = MAKES) -> str | None:
    """The make that a name is an exact alias of."""
    key = "".join(c for c in name.lower() if c.isalnum())
    own = {"".join(c for c in k.lower() if c.isalnum()): make for make, keys in reversed(list(makes.items())) for k in (*keys, make)}
    return own.get(key)


def matching(ads: DataFrame, s: AssistantSearch, now: datetime, makes: Mapping[str, list[str]] = MAKES) -> DataFrame:
    """The active ads that a search asks for. Every filter is on a stored column, so that all reach the scan.

    A word of the query that is a make's alias may stand for the make as well. An ad whose value is unknown doesn't match a
    filter on it.
    """
    out = ads.filter("status = 'active'")
    for word in s.query.lower().split():
        own = search_text("make", "model", "variant")
        make = (canonical(word, makes) or word).lower()
        out = out.filter(F.contains(own, F.lit(word)) | F.contains(own, F.lit(make)))
    lists = {"make": tuple(dict.fromkeys(canonical(m, makes) or m for m in s.makes)), "model": s.models, "provider": s.providers, "fuel_type": s.fuel_types}
    for column, values in lists.items():
        if values:
            out = out.filter(F.col(column).isin(*values))
    for column in ("transmission", "drivetrain", "body_style", "seller_type"):
        if value := getattr(s, column):
            out = out.filter(F.col(column) == value)
    if s.no_commercial and not s.body_style:
        out = out.filter(~F.col("body_style").isin(*COMMERCIAL))
    if s.posted_within:
        out = out.filter(recent(F.col("first_seen_at"), s.posted_within, now))
    for column, what, unit in (("price", "price", 1), ("model_year", "year", 1), ("mileage_km", "mileage_mil", 10), ("horsepower", "horsepower", 1)):
        low, high = getattr(s, f"min_{what}"), getattr(s, f"max_{what}")
        if low is not None:
            out = out.filter(F.col(column) >= low * unit)
        if high is not None:
            out = out.filter(F.col(column) <= high * unit)
    return out
