"""Similar cars of one kind, in blocks of arrays: what a task of Q17 does with its targets and candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Targets of like price that are searched together; distances within which a target looks first, before all its price range.
TOGETHER, RADII = 64, (0.1, 0.3, 0.9)
#: The same among cars of one model, all nearer than the half that another model adds; distances held at once.
MODEL_RADII, CELLS = (0.02, 0.1, 0.3, 0.5), 2_000_000


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _places(keys: np.ndarray) -> np.ndarray:
    """How many rows of the same key stand before each; rows of a key need not be side by side."""
    order = np.argsort(keys, kind="stable")
    first = np.append(True, np.diff(keys[order]) != 0)
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.arange(len(keys)) - np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    return place


def _searched(rows: pa.Table, budget: float, years: int, per_source: int, top: int, radii: tuple[float | None, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """(targets, cars, distance): the `top` of each target in their order: one ad a vehicle, `per_source` a provider.

    Candidates lie by price. A radius reaches only prices whose distance alone is within it; who finds `top` within a radius
    has them all, since what lies outside is farther; None is the whole budget. An unknown distance comes before all others,
    so that no radius is asked where there is one. Targets alike in all that is compared share their candidates: one more of
    each provider than is wanted, and one more in all, as a target leaves out its own vehicle.
    """
    number = lambda c: rows.column(c).cast(pa.float64()).to_numpy()
    price, year, km, power = (number(c) for c in ("price", "model_year", "mileage_km", "horsepower"))
    power = np.where(power > 0, power, np.nan)
    radii = (radius for radius in radii if radius is None or not (np.isnan(km).any() or np.isnan(power).any()))
    car, make, model, source = (_codes(rows.column(c)) for c in ("vehicle_id", "make", "model", "provider"))
    target = rows.column("is_target").to_numpy()
    by_price = np.argsort(price, kind="stable")
    cand, left = by_price[~target[by_price]], np.flatnonzero(target)
    at, alike = price[cand], np.zeros(len(rows), dtype=np.int64)
    for values in (price, year, km, power, make, model):
        codes = np.unique(values, return_inverse=True)[1].reshape(-1)
        alike = np.unique(alike * (codes.max() + 1) + codes, return_inverse=True)[1].reshape(-1)
    for radius in radii:
        share = budget if radius is None else min(budget, np.expm1(radius / 3))
        members = left[np.lexsort((alike[left], price[left]))]
        start = np.flatnonzero(np.append(True, np.diff(alike[members]) != 0)) if len(members) else members
        size, open_ = np.diff(np.append(start, len(members))), []
        k = 0
        while k < len(start):
            n = TOGETHER
            while True:  # as many classes as a block holds
                t = members[start[k : k + n]]
                low, high = price[t[0]] * (1 - share) * (1 - 1e-9), price[t[-1]] * (1 + share) * (1 + 1e-9)
                c = cand[np.searchsorted(at, low, "left") : np.searchsorted(at, high, "right")]
                if n == 1 or n * len(c) <= CELLS:
                    break
                n //= 2
            ratio, dy = price[None, c] / price[t, None], np.abs(year[None, c] - year[t, None])
            row, col = np.nonzero((np.abs(ratio - 1) <= budget) & (dy <= years))
            tt, cc = t[row], c[col]
            same = (make[tt] == make[cc]) & (model[tt] == model[cc]) & (make[cc] >= 0) & (model[cc] >= 0)
            far = 3 * np.abs(np.log(ratio[row, col])) + dy[row, col] / 6 + np.abs(km[cc] - km[tt]) / 100_000 + np.where(same, 0.0, 0.5)
            far = np.round(far + np.abs(np.log(power[cc] / power[tt])), 9)
            if radius is not None:
                near = far < radius - 1e-6
                row, cc, far = row[near], cc[near], far[near]
            order = np.lexsort((cc, np.where(np.isnan(far), -1.0, far), row))
            row, cc, far = row[order], cc[order], far[order]
            kept = _places(row * (len(rows) + 1) + car[cc] + 1) < 1
            row, cc, far = row[kept], cc[kept], far[kept]
            rank = _places(row * (len(rows) + 1) + source[cc] + 1)
            counts = np.cumsum(rank < per_source)
            first = np.searchsorted(row, row)
            before = counts - (rank < per_source) - (counts - (rank < per_source))[first]
            kept = (rank <= per_source) & (before <= top)
            row, cc, far = row[kept], cc[kept], far[kept]
            begin, many = np.searchsorted(row, np.arange(len(t))), np.bincount(row, minlength=len(t))
            of = np.repeat(np.arange(len(t)), size[k : k + n])  # the class of each member
            mine = members[start[k] : start[k] + len(of)]
            which = np.repeat(np.arange(len(of)), many[of])
            x = np.arange(len(which)) - np.repeat(np.cumsum(many[of]) - many[of] - begin[of], many[of])
            other = car[cc[x]] != car[mine[which]]
            which, x = which[other], x[other]
            kept = _places(which * (len(rows) + 1) + source[cc[x]] + 1) < per_source
            which, x = which[kept], x[kept]
            kept = _places(which) < top
            which, x = which[kept], x[kept]
            if radius is not None:
                done = np.bincount(which, minlength=len(mine)) >= top
                open_.append(mine[~done])
                which, x = which[done[which]], x[done[which]]
            yield mine[which], cc[x], far[x]
            k += n
        left = np.concatenate(open_) if open_ else left[:0]


def nearest_cars(rows: pa.Table, budget: float, years: int, per_source: int, top: int) -> Iterator[pa.RecordBatch]:
    """(target_id, listing_id, provider, distance) of the `top` of each target."""
    rows = rows.sort_by("listing_id")
    ids, source = rows.column("listing_id"), rows.column("provider")
    for t, c, far in _searched(rows, budget, years, per_source, top, (*RADII, None)):
        found = pa.table({"target_id": ids.take(pa.array(t)), "listing_id": ids.take(pa.array(c)), "provider": source.take(pa.array(c)), "distance": pa.array(far, mask=np.isnan(far))})
        yield from found.to_batches()


def cars_of_model(rows: pa.Table, budget: float, years: int, per_source: int, top: int) -> Iterator[pa.RecordBatch]:
    """(target_id, listing_id, distance, rank) of the targets that find `top` among cars of one make and model, nearer than any other can be."""
    rows = rows.sort_by("listing_id")
    ids = rows.column("listing_id")
    for t, c, far in _searched(rows, budget, years, per_source, top, MODEL_RADII):
        yield from pa.table({"target_id": ids.take(pa.array(t)), "listing_id": ids.take(pa.array(c)), "distance": pa.array(far), "rank": pa.array(_places(t) + 1)}).to_batches()
