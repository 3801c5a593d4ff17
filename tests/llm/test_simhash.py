import random
import re

import xxhash
from pyspark.sql import functions as F

from lotlens.llm import simhash as s

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(prints):
    """Components by plain search over all pairs."""
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_against_brute_force(odd_docs):
    rows = [(r.doc_id, fingerprint(r.text)) for r in odd_docs.collect()]
    roots = reach([f for _, f in rows])
    least = {}
    for i, f in rows:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    want = sorted(((i or -1), f"{f:016x}", least[roots[f]]) for i, f in rows)
    got = s.near_duplicates(odd_docs).select("doc_id", s.hex16(F.col("fp")), "component_id").collect()
    assert sorted(((r[0] or -1), r[1], r[2]) for r in got) == want
    assert len({r[2] for r in got}) < len(got)


def test_dense_clusters(spark):
    """More near fingerprints than are paired in one posting, chained through clusters and lone ones."""
    import random

    rng = random.Random(1)
    values = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(150):
            v = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                v ^= 1 << b
            values.add(v)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = spark.createDataFrame([(k, 0, signed(v)) for k, v in enumerate(sorted(values))], "doc_id long, key long, fp long")
    ids = {v: k for k, v in enumerate(sorted(values))}
    roots = reach(values)
    least = {}
    for v, k in ids.items():
        least[roots[v]] = min(k, least.get(roots[v], k))
    got = {r.doc_id: r.component_id for r in s.with_components(prints).collect()}
    assert got == {k: least[roots[v]] for v, k in ids.items()}


def test_one_of_each(odd_docs, no_docs):
    docs = odd_docs.withColumn("fp", F.lit("mine"))
    kept = s.one_of_each(docs)
    assert kept.columns == docs.columns
    found = s.near_duplicates(odd_docs)
    assert kept.count() == found.select("component_id").distinct().count()
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in found.collect()}
    assert s.near_duplicates(no_docs).count() == 0 and s.one_of_each(no_docs).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"w{k % 977} x{k % 1013}" for k in range(40_000))
    got = s.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(s.hex16(F.col("fp"))).first()[0]
    assert got == f"{fingerprint(text):016x}"


def test_many_shared_postings_are_not_broadcast(spark, monkeypatch):
    """70,000 shared postings of 2,000 pairs are joined by a shuffle; every pair is linked."""
    rng = random.Random(9)
    some = [rng.getrandbits(63) for _ in range(2000)]
    fps = spark.createDataFrame([(x,) for f in some for x in (f, f ^ 1)], "fp long")
    seen = []
    small_or_none = s.small_or_none
    monkeypatch.setattr(s, "small_or_none", lambda df, rows: seen.append(small_or_none(df, rows)) or seen[-1])
    assert {(r.u, r.v) for r in s.links(fps).collect()} == {(max(f, f ^ 1), min(f, f ^ 1)) for f in some}
    assert seen == [None]


def test_postings_of_two_are_not_looked_up(spark, monkeypatch):
    """Their fingerprints are their least and their largest; before, the members of all shared postings were joined to them."""
    rng, rows = random.Random(4), []
    settle = s.settle
    monkeypatch.setattr(s, "settle", lambda df: rows.append(settle(df)) or rows[-1])
    both = {x: x ^ (1 << k % 61) ^ (7 << (k + 20) % 61) for k, x in enumerate(rng.getrandbits(60) for _ in range(40))}
    fps = spark.createDataFrame([(x,) for x in {*both, *both.values()}], "fp long")
    assert {frozenset((r.u, r.v)) for r in s.links(fps).collect()} == {frozenset(x) for x in both.items()}
    assert [df.count() > 0 for df in rows] == [True, False]
