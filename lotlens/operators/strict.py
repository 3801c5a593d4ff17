"""What V19 and V20 do in arrays: the median of the nearest cars that agree in every respect, and the sums of seeded draws."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lotlens.operators.pairs import CELLS, _codes, _floats

#: Draws of the generator that are held at once.
DRAWS = 1 << 18


def medians_in(targets: pa.Table, pool: pa.Table, nearest: int, least: int) -> pa.Table:
    """(listing_id, predicted) of targets: the median price of the `nearest` others by year and mileage, unknown ones first, then by id.

    Targets of like year and mileage share the order of their candidates. A block of CELLS distances is held at once.
    """
    pool = pool.sort_by("listing_id")
    t_car, c_car = _codes(targets.column("t_vehicle"), pool.column("vehicle_id"))
    t_year, t_km, c_year, c_km = (_floats(x) for x in (targets.column("t_year"), targets.column("t_km"), pool.column("model_year"), pool.column("mileage_km")))
    price = _floats(pool.column("price"))
    year, km = (np.unique(x, return_inverse=True)[1].reshape(-1) for x in (t_year, t_km))
    _, one, of = np.unique(year * (km.max(initial=0) + 1) + km, return_index=True, return_inverse=True)
    cars, ads = np.unique(c_car, return_counts=True)
    at = np.minimum(np.searchsorted(cars, t_car), len(cars) - 1)
    own = np.where(cars[at] == t_car, ads[at], 0)
    many = min(len(price), nearest + int(own.max()))
    order, rows, found = np.argsort(of, kind="stable"), max(1, CELLS // len(price)), []
    for k in range(0, len(one), rows):
        t = one[k : k + rows]
        far = np.abs(c_year[None] - t_year[t, None]) * 60_000 + np.abs(c_km[None] - t_km[t, None])
        far = np.where(np.isnan(far), -1.0, far)
        row, col = np.nonzero(far <= np.partition(far, many - 1, axis=1)[:, many - 1, None])
        by = np.lexsort((col, far[row, col], row))
        row, col = row[by], col[by]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(t)))[row]
        near = np.empty((len(t), many), dtype=np.int64)
        near[row[place < many], place[place < many]] = col[place < many]
        mine = order[np.searchsorted(of[order], k) : np.searchsorted(of[order], k + rows)]
        for x in range(0, len(mine), max(1, CELLS // many)):
            y = mine[x : x + max(1, CELLS // many)]
            c = near[of[y] - k]
            kept = c_car[c] != t_car[y, None]
            kept &= np.cumsum(kept, axis=1) <= nearest
            known = np.sort(np.where(kept, price[c], np.nan), axis=1)  # unknown ones come last
            n = (~np.isnan(known)).sum(axis=1)
            mid = lambda i: np.take_along_axis(known, np.maximum(i, 0)[:, None], 1)[:, 0]  # noqa: E731, B023
            median = mid((n - 1) // 2) * 0.5 + mid(n // 2) * 0.5
            enough = kept.sum(axis=1) >= least
            found.append(pa.table({"listing_id": targets.column("t_id").take(pa.array(y[enough])), "predicted": pa.array(median[enough], mask=n[enough] == 0)}))
    return pa.concat_tables(found)


def _steps(a: int, c: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """x -> A x + C after 1 to n steps of x -> a x + c, modulo 2^32, by doubling."""
    mask = np.uint64(0xFFFFFFFF)
    many_a, many_c = np.array([a], dtype=np.uint64), np.array([c], dtype=np.uint64)
    while len(many_a) < n:
        last_a, last_c = many_a[-1], many_c[-1]
        many_a, many_c = np.append(many_a, many_a * last_a & mask), np.append(many_c, (many_a * last_c + many_c) & mask)
    return many_a[:n], many_c[:n]


def drawn_in(values: np.ndarray, first: int, n: int, starts: dict[int, int], a: int, c: int) -> dict[int, float]:
    """{replicate: sum} of n draws each from its start, over the values of the places from `first` on."""
    step_a, step_c = _steps(a, c, min(n, DRAWS))
    out = {}
    for replicate, start in starts.items():
        x, total = np.uint64(start), 0.0
        for k in range(0, n, DRAWS):
            size = min(DRAWS, n - k)
            numbers = (step_a[:size] * x + step_c[:size]) & np.uint64(0xFFFFFFFF)
            x = numbers[-1]
            place = np.floor(numbers.astype(np.float64) / 4294967296.0 * n).astype(np.int64) - first
            total += float(values[place if len(values) == n else place[(place >= 0) & (place < len(values))]].sum())
        out[replicate] = total
    return out
