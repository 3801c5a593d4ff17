"""The event log as a stream: idempotent append and change detection with the last state of each listing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE = "listing_id long, observed_at timestamp, kind string, price long, mileage_km long"
STATE = "status string, price long, mileage_km long, observed_at timestamp"


def once(observations: DataFrame, lateness: str = "15 minutes") -> DataFrame:
    """Observations without repeats of (listing, time, kind) that arrive within the lateness."""
    return observations.withWatermark("observed_at", lateness).dropDuplicatesWithinWatermark(["listing_id", "observed_at", "kind"])


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get if state.exists else None
    out = []
    rows = pd.concat(list(batches)).sort_values("observed_at", kind="stable")
    for r in rows.itertuples():
        if last is not None and r.observed_at <= last[3]:
            continue  # an older reading than the one known
        kinds = ["first_seen"] if last is None else []
        if last is not None:
            kinds += ["relisted"] * (last[0] != "active" and r.status == "active") + ["price_change"] * (last[1] != r.price) + ["mileage_change"] * (last[2] != r.mileage_km)
            kinds += ["disappeared"] * (last[0] == "active" and r.status != "active")
        out += [(key[0], r.observed_at, k, r.price, r.mileage_km) for k in kinds]
        last = (r.status, int(r.price), int(r.mileage_km), r.observed_at)
    state.update(last)
    yield pd.DataFrame(out, columns=["listing_id", "observed_at", "kind", "price", "mileage_km"])


def changes(readings: DataFrame) -> DataFrame:
    """Events of a stream of readings (listing_id, observed_at, status, price, mileage_km), by the state kept of each."""
    return readings.groupBy("listing_id").applyInPandasWithState(_changes, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout)


def daily_counts(events: DataFrame, lateness: str = "15 minutes") -> DataFrame:
    """Tumbling UTC days: events by kind, closed by the watermark."""
    return events.withWatermark("observed_at", lateness).groupBy(F.window("observed_at", "1 day").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "kind", "n")
