"""Packing documents into sequences along a Hilbert curve.

Each document is tokenised and its token counts, hashed into a vector, are projected to four dimensions. Documents
are range-sorted by the Hilbert key of that point, so that neighbours on the curve have like words, and laid end
to end along it; the line is cut every SEQUENCE tokens. Ids stay where they were written: only (key, row, length)
is sorted, prefix sums give each document its place, and pieces follow from the place by arithmetic. All
sequences but the last are full.

Defined results: a null text counts as empty and has the closing id alone; rows alike are packed each for itself
(equal keys are ordered by the row's number, which also splits them over tasks); an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotlens.llm.common import settle, small_or_none, text_of

SEQUENCE, CLOSING_ID = 4096, 2
#: Dimensions of the projected point and bits of each on the curve; buckets of the hashed document vector.
DIMENSIONS, BITS, HASHED = 4, 8, 512
#: Places (two longs each) up to this number are broadcast to the ids; beyond, ids are shuffled to them.
BROADCAST_ROWS = 400_000
#: Documents tokenised at a time.
BATCH = 1024
#: The hashed bucket of every id.
_BUCKET = (np.arange(1 << 16, dtype=np.uint32) * np.uint32(2654435761) >> np.uint32(23)).astype(np.int64)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points, one a row (Skilling's transpose method, over all rows)."""
    x = [c.astype(np.int64) for c in points.T]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> b & 1)
    return key


def _directions() -> np.ndarray:
    """Fixed random directions of the hashed buckets."""
    return np.random.default_rng(20240501).standard_normal((HASHED, DIMENSIONS)).astype(np.float32)


def points_of(packed: list[bytes], directions: np.ndarray) -> np.ndarray:
    """Integer points of documents: damped hashed counts of unit length, projected and squashed to the grid."""
    ids = np.frombuffer(b"".join(packed), dtype="<u2")
    owner = np.repeat(np.arange(len(packed)) * HASHED, [len(b) // 2 for b in packed])
    v = np.bincount(owner + _BUCKET[ids], minlength=len(packed) * HASHED).reshape(-1, HASHED)
    v = np.sqrt(v, dtype=np.float32)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    z = v @ directions
    return np.clip((1 << BITS) / (1 + np.exp(-2 * z)), 0, (1 << BITS) - 1).astype(np.int64)


def _tokenise(path: str):
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from lotlens.llm.tokens import encoder

        own, directions, row = encoder(path), _directions(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(0, len(batch), BATCH):
                some = batch.iloc[i : i + BATCH]
                packed = [b + CLOSING_ID.to_bytes(2, "little") for b in own.encode(some["text"].tolist())]
                key = hilbert_key(points_of(packed, directions))
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64"), "row": range(row, row + len(some)), "key": key, "n": [len(b) // 2 for b in packed], "ids": packed})
                row += len(some)

    return part


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, row, key, n, ids): packed ids with the closing one, their number, the place on the curve."""
    rows = docs.select("doc_id", text_of().alias("text"))
    return settle(rows.mapInPandas(_tokenise(tokenizer), "doc_id long, row long, key long, n long, ids binary"), "snappy")


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        ends = at + batch["n"].cumsum()
        yield pd.DataFrame({"row": batch["row"], "n": batch["n"], "part": part, "before": ends - batch["n"]})
        at = int(ends.iloc[-1]) if len(batch) else at


def starts(tokens: DataFrame) -> DataFrame:
    """(row, start): where each document begins on the line along the curve."""
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.select("key", "row", "n").repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row")
    local = settle(ordered.mapInPandas(_running, "row long, n long, part int, before long"))
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = local.groupBy("part").agg(F.sum("n").alias("all")).select("part", F.coalesce(F.sum("all").over(line), F.lit(0)).alias("offset"))
    return local.join(F.broadcast(offsets), "part").select("row", (F.col("offset") + F.col("before")).alias("start"))


def _cut(with_ids: bool):
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, at, ids in zip(batch["doc_id"], batch["start"], batch["ids"], strict=True):
                wide, done, n = np.frombuffer(ids, dtype="<u2").astype("<u4"), 0, len(ids) // 2
                while done < n:
                    sequence, offset = divmod(int(at) + done, SEQUENCE)
                    take = min(n - done, SEQUENCE - offset)
                    piece = wide[done : done + take].tobytes()
                    out.append((doc, done, take, zlib.crc32(piece), n, sequence, offset, *([piece] if with_ids else [])))
                    done += take
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    return part


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document: where it is cut out, and where it lies. ids: 32-bit, if asked for."""
    tokens = tokenised(docs, tokenizer)
    at = starts(tokens)
    placed = tokens.select("row", "doc_id", "ids").join(small_or_none(at, BROADCAST_ROWS) or at, "row").select("doc_id", "start", "ids")
    return placed.mapInPandas(_cut(with_ids), PIECE + ", ids binary" * with_ids)


def sequences(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(sequence_id, length, doc_ids, input_ids): the packed sequences themselves, unpadded."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most SEQUENCE pieces
    return (
        pieces(docs, tokenizer, True)
        .groupBy("sequence_id")
        .agg(F.sum("length").alias("length"), ordered.alias("p"))
        .select("sequence_id", "length", F.col("p.doc_id").alias("doc_ids"), F.aggregate("p.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("input_ids"))
    )
