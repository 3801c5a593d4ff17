"""Large groups that resemble one head, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lotlens.llm import crowds
from lotlens.llm import minhash as m


def linked(a, b, hundredths):
    return 100 * len(a & b) >= hundredths * len(a | b)


def closed(ids, pairs):
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        root[find(a)] = find(b)
    return {frozenset(k for k in ids if find(k) == r) for r in map(find, ids)}


def crowd(seed, hundredths):
    """(sets, roots): edits of one base about the threshold, twins of far ones; what is linked to the base is one component."""
    rng, fresh = random.Random(seed), iter(range(10**6, 10**9))
    base = set(range(300))
    sets = {0: base}
    for _ in range(150):
        gone = {x for at in rng.sample(range(20), rng.randint(0, 5)) for x in range(15 * at, 15 * at + 15)}
        own = {next(fresh) for _ in range(rng.choice([len(gone), len(gone), 0, 90]))}
        for _ in range(rng.choice([1, 1, 2])):
            twin = (base - gone) | {x for x in own if rng.random() < 0.95} | {next(fresh) for _ in range(rng.randint(0, 4))}
            sets[len(sets)] = twin - set(rng.sample(sorted(twin), rng.randint(0, 8)))
    return sets, {k: 0 if linked(s, base, hundredths) else k for k, s in sets.items()}


@pytest.mark.parametrize("hundredths", [80, 85])
def test_against_all_pairs(spark, hundredths):
    sets, roots = crowd(hundredths, hundredths)
    member = spark.createDataFrame([(0, k, r) for k, r in roots.items()], "head long, id long, root long")
    rows = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "id long, own array<long>")
    got = [(r.u, r.v) for r in crowds.linked_apart(member, rows, hundredths).collect()]
    every = [(a, b) for a in sets for b in range(a) if linked(sets[a], sets[b], hundredths)]
    known = list(roots.items())
    assert set(got) <= set(every) and all(roots[a] != roots[b] for a, b in got)
    assert closed(sets, known + got) == closed(sets, known + every) != closed(sets, known)


def test_a_crowd_gives_links_not_candidates(spark):
    """Before, members that only shared differences from the head left the search as pairs, with the square of their number."""
    sets, roots = crowd(3, m.HUNDREDTHS)
    lists = spark.createDataFrame([(k, 0, len(sets), 0, r) for k, r in roots.items()], "same long, value long, list_size long, head long, root long")
    grams = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "same long, grams array<long>")
    got = [(r.u, r.v) for r in m.crowd_apart(lists, grams).collect()]
    assert got and all(linked(sets[a], sets[b], m.HUNDREDTHS) for a, b in got)
    assert len(got) < len(sets)
    assert lists.filter(F.col("same") == F.col("head")).count() == 1


def test_twins_away_from_the_head(spark):
    """Many members that are linked to each other and not to the head: before, all their pairs left the search."""
    rng = random.Random(11)
    base, own = list(range(300)), list(range(10**6, 10**6 + 150))
    sets = {0: set(base)} | {k: set(base[:150]) | set(own) - set(rng.sample(own, 2)) | {10**7 + k} for k in range(1, 151)}
    member = spark.createDataFrame([(0, k, k) for k in sets], "head long, id long, root long")
    rows = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "id long, own array<long>")
    got = [(r.u, r.v) for r in crowds.linked_apart(member, rows, 80).collect()]
    assert all(linked(sets[a], sets[b], 80) for a, b in got) and len(got) < 2 * len(sets)
    assert closed(sets, got) == {frozenset([0]), frozenset(range(1, 151))}


def test_parities_differ_in_no_more_bits_than_the_sets(spark):
    rng = random.Random(12)
    sets = {k: set(rng.sample(range(400), rng.randint(1, 300))) for k in range(40)}
    rows = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "id long, own array<long>")
    found = {r.id: [x & (2**64 - 1) for x in r[1:]] for r in crowds._parities(rows).collect()}
    far = [(sum((x ^ y).bit_count() for x, y in zip(found[a], found[b], strict=True)), len(sets[a] ^ sets[b])) for a in sets for b in range(a)]
    assert all(bits <= apart and (apart - bits) % 2 == 0 for bits, apart in far) and max(bits for bits, _ in far) > 100
