"""MinHash near-duplicates against all pairs of full sets."""

import random
import re

import pytest

from lotlens.llm import minhash as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    own = [d if not s else least.get(find(i)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
    return sorted((str(d), len(s), str(c), d == c) for (d, _), s, c in zip(rows, sets, own, strict=True))


def found(docs):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in m.minhash_dedup(docs).collect())


def families(seed=1):
    """Templates with edits of all sizes about the threshold, short and long, chains and crowds."""
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, k = [], 0
    for length, copies in ((7, 6), (12, 8), (30, 10), (60, 12), (90, 12), (300, 14), (1500, 6), (200, 70)):
        base = text(length)
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, length // 40))):
                w[rng.randrange(length)] = rng.choice(vocabulary)
            rows.append((k, " ".join(w)))
            k += 1
    # A crowd whose members share over half their text, but link in small groups only.
    shared = text(260)
    for _ in range(45):
        own = text(100)
        for _ in range(2):
            w = shared + own
            w[rng.randrange(len(w))] = "Edit"
            rows.append((k, " ".join(w)))
            k += 1
    chain = text(400)
    for step in range(8):
        rows.append((k, " ".join(chain[step * 12 : step * 12 + 300])))
        k += 1
    rows += [(k + i, " ".join(text(rng.randint(0, 200)))) for i in range(60)]
    rng.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    rows = families()
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


@pytest.mark.parametrize("limits", [{"BROADCAST_CLASSES": 0, "BROADCAST_VALUES": 0}, {"PAIRED": 2}])
def test_limits_do_not_matter(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(m, name, value)
    rows = families(2)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    clashing = odd_docs.selectExpr("*", "doc_id AS key", "text AS same", "lang AS sketch", "lang AS component_id")
    assert found(clashing) == plain(rows)
    assert found(no_docs) == []


def test_a_very_long_text(spark):
    rng = random.Random(4)
    w = [f"u{rng.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:290_000])), (3, " ".join(w[:200_000])), (4, "x" * 2_000_000)]
    assert [x[2] for x in found(spark.createDataFrame(rows, "doc_id long, text string"))] == ["1", "1", "3", "4"]
