"""Toxicity by compression distance between two zstandard dictionaries.

From a bounded sample of labelled documents, two thirds serve to train the dictionaries: one on the words that toxic
documents use far more often than ordinary ones, one on ordinary words. Both are used as raw content over the same
ordinary base, so that they differ only in what was trained apart. The windows of a text are its words with their
boundaries; a window counts against the text when the toxic dictionary saves some share of its bytes. The other
third of the sample calibrates how the number and the share of such windows become a probability.

Defined results: a null text counts as empty and has no window; without labels of both kinds every score is that
of the one kind, or 0.5; rows alike get the same score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm.quality_classifier import sample, score_by

#: Labelled rows of each label that are fitted on, at most; words of each kind that reach the driver, at most.
FIT_ROWS, LEXICON = 4000, 6000
#: A toxic word is in at least so many toxic documents, and so many times likelier there.
SUPPORT, RATIO = 3, 25.0
#: Bytes of the trained parts, and words that are put after them as they are; level of compression; the bytes that
#: must be saved at least, and the shares of a window's own bytes from which it counts weakly to strongly.
TOXIC_BYTES, BASE_BYTES, PLAIN_WORDS, LEVEL, LEAST, SHARES = 8192, 15360, 150, 12, 3, (0.45, 0.65, 0.85, 0.99)
#: Windows whose lengths a worker remembers.
REMEMBERED = 400_000
_OPEN, _CLOSE, _PAD = b"\x01\x01\x01", b"\x02\x02\x02", b"0123456789abcdefghijklmn"
_EDGE = re.compile(r"^\W+|\W+$")


def windows(text: str) -> list[str]:
    """The words of a text in lower case without punctuation around them."""
    return [w for w in (_EDGE.sub("", x) for x in text.lower().split()) if w]


def _bytes(word: str) -> bytes:
    return _OPEN + word.encode("utf-8", "surrogatepass") + _CLOSE


def _trained(words: list[tuple[str, int]], size: int, each: int) -> bytes:
    """Raw content of a dictionary trained on words with their numbers; the words themselves if they are too few."""
    repeated = [_bytes(w) for w, n in words for _ in range(min(n, 200))]
    order = np.random.default_rng(7).permutation(len(repeated))
    samples = [b"".join(repeated[k] for k in order[i : i + each]) for i in range(0, len(order), each)]
    try:
        raw = zstandard.train_dictionary(size, samples, k=24, d=8).as_bytes()
        raw = raw[max(raw.find(_OPEN), 0) :]
    except zstandard.ZstdError:
        raw = b""
    plain = b"".join(_bytes(w) for w, _ in words[: size // 12])
    return raw if len(raw) > size // 4 else plain


def dictionaries(toxic: list[tuple[str, int]], ordinary: list[tuple[str, int]]) -> tuple[bytes, bytes]:
    """Raw dictionaries (toxic, ordinary) that share base and end."""
    base = _trained(ordinary[::2], BASE_BYTES, 12)
    own, other = _trained(toxic, TOXIC_BYTES, 8), _trained(ordinary[1::2], TOXIC_BYTES, 12)
    own += b"".join(_bytes(w) for w, _ in toxic[:PLAIN_WORDS])
    other += b"".join(_bytes(w) for w, _ in ordinary[1 : 4 * PLAIN_WORDS : 2])
    return own + base + _PAD, other[: len(own)] + base + _PAD


class Distance:
    """What the toxic dictionary saves on a window, as a share of its bytes."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = self._compressor(toxic), self._compressor(ordinary)
        self.known: dict[str, float] = {}

    @staticmethod
    def _compressor(raw: bytes):
        own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)

    def saved(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            own = _bytes(word)
            less = len(self.ordinary.compress(_PAD + own)) - len(self.toxic.compress(_PAD + own))
            found = self.known[word] = less / (len(own) - len(_OPEN) - len(_CLOSE)) if less >= LEAST else 0.0
        return found

    def features(self, text: str) -> list[float]:
        saved = np.array([self.saved(w) for w in windows(text)])
        n = max(len(saved), 1)
        hits = [int((saved >= k).sum()) for k in SHARES]
        return [1.0, *[np.log1p(h) for h in hits], *[np.log1p(100 * h / n) for h in hits], np.log(n)]


_distances: dict[int, Distance] = {}


def _distance(pair: tuple[bytes, bytes]) -> Distance:
    key = hash(pair)
    if key not in _distances:
        _distances.clear()
        _distances[key] = Distance(*pair)
    return _distances[key]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients by Newton's method with a small ridge."""
    b, ridge = np.zeros(x.shape[1]), 0.05 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _lexicon(rows: DataFrame) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """(word, documents) of toxic and of ordinary words, the commonest first; both are bounded."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(w, y) for t, y in zip(batch["text"], batch["label"], strict=True) for w in set(windows(t))]
            yield pd.DataFrame(found, columns=["word", "label"])

    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    words = rows.mapInPandas(part, "word string, label int").groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("ordinary"))
    share = (F.col("toxic") / max(size.get(1, 0), 1)) / ((F.col("ordinary") + 0.5) / max(size.get(0, 0), 1))
    apart = words.filter((F.col("toxic") >= SUPPORT) & (share > RATIO)).orderBy(F.desc("toxic"), "word").limit(LEXICON).collect()
    common = words.filter("ordinary > 1").orderBy(F.desc("ordinary"), "word").limit(LEXICON).collect()
    return [(r["word"], r["toxic"]) for r in apart], [(r["word"], r["ordinary"]) for r in common]


def fit(rows: DataFrame, total: dict[int, int]) -> dict:
    """The two dictionaries and the calibration."""
    if len(total) < 2:
        return {"none": float(next(iter(total), 0.5))}
    rows = rows.withColumn("third", F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(3)))
    pair = dictionaries(*_lexicon(rows.filter("third > 0")))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _distance(pair)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "x": [own.features(t) for t in batch["text"]]})

    got = rows.filter("third = 0").mapInPandas(part, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id")
    y = got["label"].to_numpy(dtype=float)
    if len(set(y.tolist())) < 2:
        return {"none": 0.5}
    drawn = np.array([(y == k).sum() for k in (0, 1)], dtype=float)
    weight = np.array([total[k] for k in (0, 1)]) / drawn
    weight *= len(y) / (weight * drawn).sum()
    return {"pair": pair, "b": _logistic(np.stack(got["x"].tolist()), y, weight[y.astype(int)])}


def scores(model: dict, texts: list[str]) -> np.ndarray:
    if "none" in model:
        return np.full(len(texts), model["none"])
    own = _distance(model["pair"])
    x = np.array([own.features(t) for t in texts]).reshape(len(texts), len(model["b"]))
    return np.round(1 / (1 + np.exp(-np.clip(x @ model["b"], -30, 30))), 6)


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, score) for each row of docs: 0 to 1, higher where label 1 is likelier. labels: (doc_id, label)."""
    return score_by(docs, fit(*sample(docs, labels, label, FIT_ROWS)), scores)
