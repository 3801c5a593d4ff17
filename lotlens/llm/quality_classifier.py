"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A bounded sample of labelled documents, drawn by a hash of their ids for each label, is turned into hashed feature
vectors, centred and reduced by a truncated singular value decomposition. Their unit vectors are broadcast; every
document is projected the same way and compared with all of them by exact cosine products, a block of documents at a
time. The nearest labels vote, weighted by similarity and by the share of their class in the labels.

Defined results: a null text counts as empty; texts without features are scored like any other; without labelled
rows every score is 0.5, and with one label alone it is that label; rows alike get the same score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import text_of
from lotlens.llm.features import vectors

#: Labelled rows of each label that are fitted on, at most.
FIT_ROWS = 2500
#: Latent dimensions, voting neighbours, sharpness of the similarity weights, documents in a block.
RANK, NEIGHBOURS, SHARPNESS, BLOCK = 32, 31, 12.0, 256


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most `rows` labelled documents of each label, and how many labels there are of each.

    The sample is drawn by a hash of doc_id; its ids, being bounded, are broadcast to the documents. Of rows with
    one doc_id the first text in order is taken, of labels with one doc_id the larger.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    total = {int(r["label"]): r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    some = known.filter("false")
    for value in sorted(total):
        some = some.union(known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(some), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").cast("int").alias("label")), total


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "v": [v.tobytes() for v in vectors(batch["text"].tolist())]})


def fit(rows: DataFrame, total: dict[int, int]) -> dict:
    """Centre, projection, labelled vectors, labels and votes. The driver gets the sample's vectors, not its texts."""
    got = rows.mapInPandas(_vectors, "doc_id long, label int, v binary").toPandas().sort_values("doc_id")
    x = np.stack([np.frombuffer(v, dtype=np.float32) for v in got["v"]]) if len(got) else np.zeros((0, 1))
    y = got["label"].to_numpy(dtype=np.float32)
    if not len(x):
        return {"none": 0.5}
    if len(set(y.tolist())) == 1:
        return {"none": float(y[0])}
    centre = x.mean(0)
    values, axes = np.linalg.eigh(((x - centre).T @ (x - centre)).astype(np.float64))
    axes = axes[:, np.argsort(values)[::-1][:RANK]].astype(np.float32)
    z = (x - centre) @ axes
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    drawn = np.array([(y == k).sum() for k in (0, 1)], dtype=np.float32)
    vote = np.array([total[k] for k in (0, 1)], dtype=np.float32) / drawn
    return {"centre": centre, "axes": axes, "z": z, "y": y, "vote": vote[y.astype(int)]}


def scores(model: dict, texts: list[str]) -> np.ndarray:
    if "none" in model:
        return np.full(len(texts), model["none"])
    out = np.empty(len(texts))
    for i in range(0, len(texts), BLOCK):
        q = (vectors(texts[i : i + BLOCK]) - model["centre"]) @ model["axes"]
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
        cosine = q @ model["z"].T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.exp(SHARPNESS * (np.take_along_axis(cosine, near, 1) - 1)) * model["vote"][near]
        out[i : i + BLOCK] = (weight * model["y"][near]).sum(1) / weight.sum(1)
    return np.clip(np.round(out, 6), 0, 1)


def score_by(docs: DataFrame, model: dict, score) -> DataFrame:
    """(doc_id, score) of every row; the model, of bounded size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": score(shared.value, batch["text"].tolist())})

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(part, "doc_id long, score double")


def quality_classifier(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, score) for each row of docs: 0 to 1, higher where label 1 is likelier. labels: (doc_id, label)."""
    return score_by(docs, fit(*sample(docs, labels, label)), scores)


