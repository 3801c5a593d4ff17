import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lotlens.llm import mixing as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes, weights, cap):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, rest = set(), sum(sizes.values())
    while True:
        left = [s for s in names if s not in full]
        each = (rest - sum(cap * sizes[s] for s in full)) / max(sum(weight[s] for s in left), 1)
        over = {s for s in left if weight[s] * each > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else weight[s] * each for s in names}
        full |= over


def check(docs):
    rows = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()]
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    target = shares(sizes, (1, 2, 3), 3)
    got = m.mix(docs).select("doc_id", "source", "mix.*").collect()
    assert sorted((r.doc_id or -1, r.source or "", r["size"]) for r in got) == sorted((i or -1, s or "", n) for i, s, n in rows)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 3 and 0 < r.rate <= 3
        assert math.floor(r.rate + 1e-9) <= r.copies <= math.ceil(r.rate - 1e-9)
        taken[r.source] += r["size"] * r.copies
        longest[r.source] = max(longest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(0.05 * target[s], 60, longest[s] / 2), s
    return {(r.doc_id, r.source): r.copies for r in got}


def test_against_brute_force(odd_docs):
    assert check(odd_docs) == check(odd_docs.repartition(7, "text"))


def test_rates_solve_the_dual(odd_docs):
    by = odd_docs.transform(m.mix).groupBy("source").agg(F.sum(F.col("mix.size") * F.col("mix.rate")).alias("t"), F.first("mix.target").alias("target")).collect()
    assert all(r.t == pytest.approx(r.target, rel=1e-4) for r in by)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_hot_class_and_capped_source(spark, monkeypatch, limit):
    monkeypatch.setattr(m, "BROADCAST_CLASSES", limit)
    rows = [(k, "a b c", "hot") for k in range(3000)] + [(5000 + k, "x " * (k % 50), "big") for k in range(400)] + [(9000, "z " * 10, "tiny"), (9001, None, "none")]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_mixed_repeats_rows(odd_docs, no_docs):
    docs = odd_docs.withColumn("mix", F.lit(1)).withColumn("size", F.lit("mine"))
    out = m.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == m.mix(odd_docs).agg(F.sum("mix.copies")).first()[0]
    assert m.mix(no_docs).count() == 0 and m.mixed(no_docs).count() == 0
