import math
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from lotlens.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_word(w, seed=42):
    return signed(xxhash.xxh64_intdigest(w.encode(), seed))


def hash_pair(a, b):
    first = xxhash.xxh64_intdigest((a % (1 << 64)).to_bytes(8, "little"), 42)
    return signed(xxhash.xxh64_intdigest((b % (1 << 64)).to_bytes(8, "little"), first))


def buckets(text):
    h = [hash_word(w) for w in WORD.findall(text or "")]
    return [x % q.BUCKETS for x in h] + [hash_pair(a, b) % q.BUCKETS for a, b in zip(h, h[1:], strict=False)]


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def brute(rows, trusted, threshold):
    raw, target = Counter(), Counter()
    for i, text in rows:
        raw.update(buckets(text))
        if i in trusted:
            target.update(buckets(text))
    nr, nt = sum(raw.values()) + q.BUCKETS, sum(target.values()) + q.BUCKETS
    out = []
    for i, text in rows:
        m = base(text)
        kept, score = False, None
        if not m[-1]:
            b = buckets(text)
            score = sum(math.log((target[x] + 1) / nt / ((raw[x] + 1) / nr)) for x in b) / len(b)
            kept = score >= threshold
        out.append((i, *m, kept, score))
    return out


def test_against_brute_force(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    trusted = {i for i, _ in rows if i and i % 3}
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    scores = sorted(r[-1] for r in brute(rows, trusted, 0.0) if r[-1] is not None)
    threshold = (scores[len(scores) // 2] + scores[len(scores) // 2 + 1]) / 2
    got = [tuple(r) for r in q.quality_rules(odd_docs, ids, threshold).collect()]
    want = brute(rows, trusted, threshold)
    order = lambda r: (r[0] is None, r[0] or 0, r[1:6])
    assert [r[:-1] for r in sorted(got, key=order)] == [r[:-1] for r in sorted(want, key=order)]
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert (a[-1] is None) == (b[-1] is None) and (a[-1] is None or math.isclose(a[-1], b[-1], abs_tol=1e-7))
    assert any(r[-2] for r in got) and any(not r[-2] and not r[-3] for r in got)


def test_passing_keeps_rows_whole(spark, odd_docs):
    ids = spark.createDataFrame([(8,)], "doc_id long")
    docs = odd_docs.withColumn("score", F.lit("mine")).withColumn("bucket", F.lit(1))
    kept = q.passing(docs, ids, 0.0)
    verdicts = {(r.doc_id, r.n_words): r.kept for r in q.quality_rules(odd_docs, ids, 0.0).collect()}
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted((r.doc_id or 0) for r in odd_docs.collect() if verdicts[(r.doc_id, len(WORD.findall(r.text or "")))])


def test_empty_and_untrusted(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long")
    assert q.quality_rules(no_docs, none).count() == 0
    assert all(r.kept != r.base_failed for r in q.quality_rules(odd_docs, none).collect())
