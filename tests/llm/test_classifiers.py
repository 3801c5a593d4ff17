import random

import pytest

from lotlens.llm import quality_classifier as q
from lotlens.llm import toxicity as t

DATA = "/root/testdata/sf0.01"


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize(("operator", "label", "least"), [(q.quality_classifier, "quality", 0.98), (t.toxicity, "toxic", 0.75)])
def test_held_out_accuracy(spark, operator, label, least):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = operator(docs, labels.filter("doc_id % 4 <> 0"))
    held = out.join(labels.filter("doc_id % 4 = 0"), "doc_id").select("score", label).collect()
    assert out.count() == docs.count() and out.filter("score between 0 and 1").count() == docs.count()
    assert auc([(r[0], r[1]) for r in held]) >= least


def test_planted_words_are_learnt(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ing"]) for _ in range(rng.randint(1, 4)))
    bad = ["grumblefist", "snarkwort", "vilebrute"]
    rows, labels = [], []
    for k in range(400):
        w = [word() for _ in range(80)]
        if k % 3 == 0:
            for _ in range(3):
                w[rng.randrange(80)] = rng.choice(bad)
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 3 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in t.toxicity(docs, known.filter("doc_id < 250")).collect()}
    assert sum((out[k] >= 0.7) == (k % 3 == 0) for k in range(250, 400)) >= 147


@pytest.mark.parametrize(("operator", "label"), [(q.quality_classifier, "quality"), (t.toxicity, "toxic")])
def test_odd_inputs(spark, odd_docs, no_docs, operator, label):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 110)] + [(None, 1), (4, 1)], f"doc_id long, {label} int")
    out = operator(odd_docs, labels)
    assert out.count() == odd_docs.count() and all(0 <= r.score <= 1 for r in out.collect())
    assert operator(no_docs, labels).count() == 0
    assert {r.score for r in operator(odd_docs, labels.filter("false")).collect()} == {0.5}
    assert {r.score for r in operator(odd_docs, labels.filter(f"{label} = 1")).collect()} == {1.0}
