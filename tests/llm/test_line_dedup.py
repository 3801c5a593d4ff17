import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotlens.llm import line_dedup as d


def norm(x):
    return re.sub(r"[\x20\x09-\x0D]+", " ", x).lower().strip(" ")


def grams(x):
    """All runs of nine characters; a shorter line is one."""
    return {x[i : i + 9] for i in range(len(x) - 8)} or {x}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def brute(rows):
    """Lines each document loses, by comparing all pairs of lines."""
    places = sorted({(i is None, i or 0, t or "", k, norm(x)) for i, t in rows for k, x in enumerate((t or "").split("\n")) if norm(x)})
    texts = sorted({p[-1] for p in places})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    sets = {t: grams(t) for t in texts}
    for n, a in enumerate(texts):
        for b in texts[:n]:
            if alike(sets[a], sets[b]):
                root[find(a)] = find(b)
    return places, {t: find(t) for t in texts}


def test_against_brute_force(spark, no_docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ing", "ea"]) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(rng.randint(8, 60)) for _ in range(12)]

    def near(x):
        w = x.split()
        w[rng.randrange(len(w))] = word()
        return " ".join(w)

    rows = [(None, None), (1, ""), (2, shared[0]), (2, shared[0]), (None, shared[1]), (3, shared[0].upper() + "\n" + shared[0]), (4, "of.\nof.\nof.")]
    for k in range(10, 90):
        body = [line(rng.randint(3, 40)) for _ in range(rng.randint(0, 4))] + [near(rng.choice(shared)) for _ in range(rng.randint(0, 2))] + rng.sample(shared, rng.randint(0, 2))
        rng.shuffle(body)
        rows.append((k, "\n".join(body)))
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lines long").withColumn("__gone2", F.lit(1))
    places, roots = brute(rows)
    groups = {}
    for p in places:
        groups.setdefault(roots[p[-1]], []).append(p)
    stay = {min((p[0], p[1], d_key(spark, p[2]), p[3]) for p in g) for g in groups.values()}
    want = []
    for i, t in rows:
        if t is None:
            want.append((i, None, 0))
            continue
        keep = [x for k, x in enumerate(t.split("\n")) if not norm(x) or (i is None, i or 0, d_key(spark, t), k) in stay]
        want.append((i, "\n".join(keep), len(t.split("\n")) - len(keep)))
    out = d.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = [(r.doc_id, r.text, r.n_removed) for r in out.collect()]
    order = lambda r: (r[0] or -1, r[1] or "", r[2])
    assert sorted(got, key=order) == sorted(want, key=order)
    kept = d.deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not n or bool(t.strip()) for _, t, n in want)
    assert d.line_dedup(no_docs).count() == 0


_keys = {}


def d_key(spark, text):
    if text not in _keys:
        import xxhash

        x = xxhash.xxh64_intdigest(text.encode(), 42)
        _keys[text] = x - (1 << 64) if x >> 63 else x
    return _keys[text]


def test_bands_recall():
    """Lines of similarity 0.8 share a triple of their signatures."""
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(3000):
        shared, own = rng.random(80), rng.random(20)
        a = set(np.sort(np.concatenate([shared, own[:10]]))[: d.SIGNATURE])
        b = set(np.sort(np.concatenate([shared, own[10:]]))[: d.SIGNATURE])
        met += len(a & b) >= d.ROWS
    assert met / 3000 > 0.97


def groups(lines):
    """Of every line the first line of its component, by comparing all pairs."""
    root, sets = list(range(len(lines))), [grams(x) for x in lines]

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for n in range(len(lines)):
        for m in range(n):
            a, b = find(n), find(m)
            if a != b and alike(sets[n], sets[m]):
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(lines))]


def kept(spark, lines, **more):
    out = d.line_dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), **more)
    return sorted(r.doc_id for r in out.filter("n_removed = 0").collect())


def letters(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))


def test_every_character_counts(spark):
    """Addresses, text without spaces, lines that differ only at their end, repeated phrases, short lines."""
    rng = random.Random(6)
    lines = [f"https://{letters(rng, 12)}.example/{letters(rng, 20)}" for _ in range(30)]
    lines += ["https://www.alpha.org/catalogue/green-lamps/4411", "https://news.beta.net/2021/05/quite-another-story"]
    lines += ["我们在城市的北边找到了那座老房子", "我们在城市的北边看见很多新的汽车和人"]
    lines += [f"see https://{letters(rng, 30)}" for _ in range(10)] + ["the city was founded in 1987", "the city was founded in paris"]
    long = letters(rng, 80)
    lines += [long, long[:-1] + "!", "-" * 25, "-" * 30, "ab" * 15, "ab" * 20, "the same phrase " * 4, "the same phrase " * 14, "é" * 9 + long, "é" * 10 + long]
    lines += ["of.", "of,", "Of.", "---", "--- ", "a", "b", "ninechars", "ninecharsninechars"]
    want = groups([norm(x) for x in lines])
    assert kept(spark, lines) == sorted(set(want)) and len(set(want)) == len(lines) - 8
    assert len(kept(spark, lines, min_chars=20)) == len(lines) - 6


def test_recall_and_precision(spark):
    """The lines of a whole table: near-equal pairs by an exact prefix filter in Python."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = sorted({n for r in docs.select("text").collect() for x in (r.text or "").split("\n") if (n := norm(x))})
    sets = {t: grams(t) for t in texts}
    often = Counter(g for s in sets.values() for g in s)
    index, near = defaultdict(list), set()
    for t in sorted(texts, key=lambda t: len(sets[t])):
        ordered = sorted(sets[t], key=lambda g: (often[g], g))
        for g in ordered[: len(ordered) - math.ceil(0.8 * len(ordered) - 1e-9) + 1]:
            near |= {(u, t) for u in index[g] if len(sets[u]) >= 0.8 * len(sets[t]) and alike(sets[u], sets[t])}
            index[g].append(t)
    occurrences = d.settle(d.lines_of(docs))
    root = {r.norm: r.root for r in occurrences.join(d.joined(occurrences), "hash").select("norm", "root").distinct().collect()}
    met = sum(a in root and root[a] == root.get(b) for a, b in near)
    assert len(near) > 100 and met / len(near) >= 0.97
    partners = {t for pair in near for t in pair}
    assert set(root) <= partners


def test_pairs_away_from_the_heads(spark):
    """Bands of far more lines than are paired: twins that are near each other only, in a family with one opening."""
    rng = random.Random(8)
    opening = " ".join(letters(rng, 7) for _ in range(17))
    lines = []
    for _ in range(120):
        own = letters(rng, 40)
        lines += [f"{opening} {own} {letters(rng, 4)}" for _ in range(rng.choice([1, 2, 3]))]
    rng.shuffle(lines)
    want = groups(lines)
    assert len(lines) > 4 * d.PAIRED and len(set(want)) < len(lines) - 60 and len(set(want)) >= 100
    assert kept(spark, lines) == sorted(set(want))


def test_clashing_names_and_long_lines(spark):
    rng = random.Random(1)
    long = " ".join(letters(rng, rng.randint(2, 9)) for _ in range(60_000))
    rows = [(1, long, 1, "x"), (2, long + " more", 2, "y"), (3, None, 3, None), (3, None, 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __gone int, row string").selectExpr("*", "1 as gone", "2 as id", "3 as own", "4 as lines0")
    out = d.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert sorted((r.doc_id, r["row"], r.own, r.n_lines, r.n_removed) for r in out.collect() if r["row"]) == [(1, "x", 3, 1, 0), (2, "y", 3, 1, 1)]
    left = d.deduplicated(docs)
    assert left.columns == docs.columns and left.count() == 3


@pytest.mark.parametrize("limit", [0, 10**6])
def test_large_band(spark, monkeypatch, limit):
    """A line with more variants than are paired in a band."""
    monkeypatch.setattr(d, "BROADCAST_LINES", limit)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    rows = [(k, " ".join(w if j != k % 60 else f"new{k}" for j, w in enumerate(base))) for k in range(300)]
    out = d.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in out.filter("n_removed = 0").collect()] == [0]


def test_signatures_are_sorted_outside_of_lambdas(spark):
    """The five smallest different hashes, also where the list begins with repeats; before, boxed values were sorted."""
    rng = random.Random(9)
    lines = ["ab" * 300, letters(rng, 200), "é" * 40, "short", "nine char", letters(rng, 12) + "x" * 500, letters(rng, 11)]
    rows = d.signed(spark.createDataFrame([(x,) for x in lines], "norm string"))
    all_ = rows.select("norm", "sig", d.all_shingles(F.col("norm")).alias("all")).collect()
    assert len(all_) == len(lines) and all(r.sig == sorted(set(r["all"]))[: d.SIGNATURE] for r in all_)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "lambdafunction(sort_array" not in plan and "transform(array(sort_array" not in plan


def test_texts_of_all_lines_are_gone_before_lines_are_compared(spark, monkeypatch):
    """While pairs are compared, no table on disk but that of lines which meet others holds text."""
    from pathlib import Path

    from lotlens.llm import line_dedup as module

    held, verified, settle = [], module.verified, module.settle
    written = []
    monkeypatch.setattr(module, "settle", lambda df: (out := settle(df), written.append(out))[0])

    def seen(pairs, texts):
        held.append([t.columns for t in written if "norm" in t.columns and Path(t.settled_at.removeprefix("file:")).exists()])
        return verified(pairs, texts)

    monkeypatch.setattr(module, "verified", seen)
    docs = spark.createDataFrame([(k, f"one line of words that is number {k % 7} here\nanother line that all share in this text") for k in range(40)], "doc_id long, text string")
    assert module.repeated_lines(docs).count() > 0
    assert held and all(x == [["hash", "norm", "size"]] for x in held)
