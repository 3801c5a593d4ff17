"""Identities of long chains and of many listings against plain search."""

import random

from lotlens.operators import ingest


def plain(rows):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for k, t in rows:
        a, b = find(k), find(("t", t)) if t is not None else find(k)
        root[b] = a
    least = {}
    for k, _ in rows:
        least[find(k)] = min(k, least.get(find(k), k))
    return {k: least[find(k)] for k, _ in rows}


def found(spark, rows, seen=None):
    out = ingest.identities(spark.createDataFrame(rows, "listing_id long, token string"))
    return {x.listing_id: x.vehicle_key for x in out.collect()}


def test_chains_of_any_order(spark):
    rng = random.Random(3)
    ids = list(range(300))
    rng.shuffle(ids)
    chain = [(k, f"c{i}") for i, k in enumerate(ids)] + [(k, f"c{i + 1}") for i, k in enumerate(ids)]
    straight = [(1000 + k, f"s{k + j}") for k in range(200) for j in (0, 1)]
    free = [(rng.randrange(5000, 5400), f"f{rng.randrange(300)}") for _ in range(400)] + [(9000, None), (9001, "alone")]
    assert found(spark, chain + straight + free) == plain(chain + straight + free)
    assert found(spark, [(1, None)]) == {1: 1}


def test_a_chain_closes_in_few_rounds(spark, monkeypatch):
    """Tables written for a chain of 200 in the worst order: not one a link."""
    written = []
    settle = ingest.settle
    monkeypatch.setattr(ingest, "settle", lambda df: written.append(1) or settle(df))
    rng = random.Random(4)
    ids = list(range(1000))
    rng.shuffle(ids)
    rows = [(k, f"c{i // 2}") for i, k in enumerate(ids)] + [(k, f"d{(i + 1) // 2}") for i, k in enumerate(ids)]
    assert set(found(spark, rows).values()) == {0}
    assert len(written) < 60


def test_a_merge_is_told_once(spark):
    """Two vehicles whose identifiers had the same two ids."""
    tokens = spark.createDataFrame([(1, "vin", "a"), (1, "vin", "c"), (2, "vin", "b"), (2, "vin", "d")], "listing_id long, kind string, token string")
    known = spark.createDataFrame([("vin", "a", "v0"), ("vin", "c", "v1"), ("vin", "b", "v0"), ("vin", "d", "v1")], "kind string, token string, vehicle_id string")
    _, merged = ingest.stable_identities(tokens, known)
    assert [tuple(x) for x in merged.collect()] == [("v1", "v0")]
