"""Exact k-means by kd-tree filtering, against plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from lotlens.llm import clustering as c

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def plain(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    centroids = [v for _, _, v in first[:k]]
    apart = lambda v, z: sum((a - b) ** 2 for a, b in zip(v, z, strict=True))
    assign = lambda: [min(range(len(centroids)), key=lambda j: (apart(v, centroids[j]), j)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            if some := [v for (_, v), o in zip(kept, own, strict=True) if o == j]:
                centroids[j] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    own = assign()
    each = [apart(v, centroids[o]) for (_, v), o in zip(kept, own, strict=True)]
    inertia = [sum(d for d, o in zip(each, own, strict=True) if o == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in centroids]
    return sorted((str(i), o, d, inertia[o], sum(each), sha[o]) for (i, _), o, d in zip(kept, own, each, strict=True))


def found(spark, rows):
    out = c.cluster_digest(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA))
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect())


def odd_rows(seed=3, n=400):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [m + rng.gauss(0, 0.1) for m in middles[i % 5]]) for i in range(n)]
    rows += [(1000 + i, [0.25] * 64) for i in range(150)] + [(i, rows[i][1]) for i in range(20)]
    rows += [(None, [0.5] * 64), (None, None), (2000, None), (2001, [0.1] * 63), (2002, [0.1] * 65), (2003, []), (2004, [None] + [0.1] * 63), (2005, [float("nan")] * 64), (2006, [float("inf")] + [0.0] * 63)]
    return rows


@pytest.mark.parametrize("leaf", [16, 2])
def test_against_plain_integers(spark, monkeypatch, leaf):
    monkeypatch.setattr(c, "LEAF", leaf)
    monkeypatch.setattr(c, "TREE", 100)
    rows = odd_rows()
    assert found(spark, rows) == plain(rows)


def test_few_vectors_ties_and_none(spark):
    same = [(k, [1.0] * 64) for k in range(12)]
    assert found(spark, same) == plain(same)
    some = [(1, [0.0] * 64), (2, [1.0] * 64), (3, [0.5] * 64)]
    assert found(spark, some) == plain(some)
    assert found(spark, []) == found(spark, [(1, None)]) == []


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        found(spark, [(1, [1e9] * 64)])


def test_trees_hold_every_point_and_prune():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-1000, 1000, (500, 64)), rng.integers(5000, 5100, (300, 64)), np.zeros((200, 64), np.int64)])
    order, nodes = c.tree_of(points)
    assert sorted(order) == list(range(1000))
    for a, b, low, high, total in zip(*(nodes[x] for x in ("start", "stop", "low", "high", "total")), strict=True):
        own = points[order[a:b]]
        assert (own.min(axis=0) == low).all() and (own.max(axis=0) == high).all() and (own.sum(axis=0) == total).all()
    centroids = np.stack([np.zeros(64, np.int64), np.full(64, 5050)])
    allowed = c.undominated(nodes["low"].astype(np.int64), nodes["high"].astype(np.int64), centroids, np.ones((len(nodes["start"]), 2), bool))
    assert (allowed.sum(axis=1) == 1).mean() > 0.9
    for (a, b), some in zip(zip(nodes["start"], nodes["stop"], strict=True), allowed, strict=True):
        best = c.nearest(points[order[a:b]], centroids, np.ones((b - a, 2), bool))
        assert some[best].all()


def test_partitions_do_not_matter(spark):
    rows = odd_rows(9, 300)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    one, many = (sorted((str(r.id), r.cluster, r.distance) for r in c.k_means(df.repartition(n))[0].collect()) for n in (1, 13))
    assert one == many
