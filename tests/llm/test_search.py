import math
from collections import Counter

import pytest

from lotlens.llm import search as s


def brute(rows, queries, k):
    docs = [(i, s.terms_of(t or "")) for i, t in rows]
    n, mean = len(docs), sum(len(w) for _, w in docs) / max(len(docs), 1)
    df = Counter(x for _, w in docs for x in set(w))
    out = {}
    for q, text in queries:
        asked = Counter(s.terms_of(text or ""))
        found = []
        for i, w in docs:
            tf = Counter(w)
            score, hit = 0.0, False
            for term, m in sorted(asked.items()):
                if tf[term]:
                    hit = True
                    weight = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5)) * m
                    score += weight * tf[term] * 2.2 / (tf[term] + 1.2 * (0.25 + 0.75 * len(w) / mean))
            if hit:
                found.append((-score, i is None, i or 0))
        out[q] = [(i if not none else None, round(-v, 7)) for v, none, i in sorted(found)[:k]]
    return out


def test_against_brute_force(spark, odd_docs, no_docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    queries = [(1, rows[5][1]), (2, "w1 w2 w3 the"), (3, "w17"), (4, "nothing here at all"), (5, ""), (6, None), (7, "W5 w5 w6 élan of")]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    want = brute(rows, queries, 10)
    for parts, shard in ((1, 20_000), (5, 20_000), (2, 7)):
        monkeypatch.setattr(s, "SHARD", shard)
        got = {}
        for r in sorted(s.top_k(odd_docs.repartition(parts), asked).collect(), key=lambda r: r.rank):
            got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 7)))
        for q, v in want.items():
            assert [i for i, _ in got.get(q, [])] == [i for i, _ in v], (q, parts)
            assert [x for _, x in got.get(q, [])] == pytest.approx([x for _, x in v], abs=1e-6)
    assert s.top_k(no_docs, asked).count() == 0


def test_pruning_is_exact(spark):
    import random

    rng = random.Random(9)
    words = [f"t{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    rows = [(k, " ".join(rng.choices(words, weights, k=rng.randint(1, 80)))) for k in range(3000)]
    queries = [(q, " ".join(rng.sample(words, 6))) for q in range(12)]
    want = brute(rows, queries, 10)
    got = {}
    out = s.top_k(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), spark.createDataFrame(queries, "query_id long, text string"))
    for r in sorted(out.collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 7)))
    assert got == want
