"""Exact top-k search: BM25 over sharded inverted indexes with block-max WAND, merged by global statistics.

A first pass lays the whole index down as a table, shard by shard (a run of documents of one partition): a row for
each term with its postings and, for each block of postings, the largest term frequency and the shortest document,
which bound every score in the block whatever the global statistics turn out to be. Any queries can be answered from
it. Queries are dealt into batches of bounded size; their terms are joined with the index, document frequencies and the
mean length are summed over all shards, and each shard is searched for each batch. The k best of all shards' best
documents are the exact answer.

Defined results: text is lower-cased, terms are runs of letters, digits and underscores; a null text is empty;
documents without a term of the query are no result, so a query may have fewer than k; equal scores are ordered by
doc_id, nulls last; rows alike are results each for itself; a query without an id is left out, and of queries with
one id the first text in order counts; empty tables give no results; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotlens.llm.common import discard, settle, small_or_none, text_of

K1, B = 1.2, 0.75
#: Documents and postings of a shard, postings of a block, queries of a batch, terms that are broadcast at most.
SHARD, SHARD_POSTINGS, BLOCK, BATCH, BROADCAST_TERMS = 20_000, 1_000_000, 64, 64, 200_000
_TERM = re.compile(r"\w+")
_INDEX = "shard long, term string, docs int, tokens long, ids array<long>, at array<int>, tf array<int>, length array<int>, most array<int>, least array<int>"
_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("docs", pa.int32()), ("tokens", pa.int64()), ("ids", pa.list_(pa.int64())), *[(c, pa.list_(pa.int32())) for c in ("at", "tf", "length", "most", "least")]])


def terms_of(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class _Shard:
    """Postings of a run of documents, in the order in which they come."""

    def __init__(self):
        self.ids, self.lengths = [], array("i")
        self.term, self.at, self.tf = array("i"), array("i"), array("i")
        self.terms: dict[str, int] = {}

    def add(self, doc_id: int | None, text: str) -> None:
        found = terms_of(text)
        for term, n in Counter(found).items():
            self.term.append(self.terms.setdefault(term, len(self.terms)))
            self.at.append(len(self.ids))
            self.tf.append(n)
        self.ids.append(doc_id)
        self.lengths.append(len(found))

    def full(self) -> bool:
        return len(self.ids) >= SHARD or len(self.at) >= SHARD_POSTINGS

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """A row for the documents, then one for each term."""
        length = np.array(self.lengths, dtype=np.int32)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "docs": len(length), "tokens": int(length.sum()), "ids": self.ids, "length": length}], schema=_ARROW)
        if not self.terms:
            return
        term = np.array(self.term, dtype=np.int32)
        order = np.argsort(term, kind="stable")
        at, tf = np.array(self.at, dtype=np.int32)[order], np.array(self.tf, dtype=np.int32)[order]
        docs = np.bincount(term, minlength=len(self.terms))
        ends = np.concatenate([[0], np.cumsum(docs)])
        blocks = -(-docs // BLOCK)
        bounds = np.concatenate([[0], np.cumsum(blocks)])
        cuts = np.repeat(ends[:-1] - bounds[:-1] * BLOCK, blocks) + np.arange(bounds[-1]) * BLOCK
        lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
        n, none = len(docs), lambda kind: pa.nulls(len(docs), kind)
        columns = [
            pa.array(np.full(n, shard)), pa.array(list(self.terms)), pa.array(docs, pa.int32()), pa.array(np.zeros(n, dtype=np.int64)), none(pa.list_(pa.int64())), lists(ends, at), lists(ends, tf),
            none(pa.list_(pa.int32())), lists(bounds, np.maximum.reduceat(tf, cuts)), lists(bounds, np.minimum.reduceat(length[at], cuts)),
        ]
        whole = pa.RecordBatch.from_arrays(columns, schema=_ARROW)
        for i in range(0, n, 20_000):
            yield whole.slice(i, 20_000)


def build_index(docs: DataFrame) -> DataFrame:
    """The shards' rows: one without a term for the documents, one for each term with postings."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = TaskContext.get().partitionId() << 20, _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own.add(doc_id, text)
                if own.full():
                    yield from own.rows(shard)
                    shard, own = shard + 1, _Shard()
        if own.ids:
            yield from own.rows(shard)

    return settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(part, _INDEX))


class _Cursor:
    """Position in one term's postings, with what its scores can reach."""

    __slots__ = ("at", "bound", "doc", "end", "gain", "i", "last", "norm", "tf", "top", "weight")

    def __init__(self, row, weight: float, norm: np.ndarray, floor: float, slope: float):
        self.at, self.tf = np.asarray(row.at, dtype=np.int32), np.asarray(row.tf, dtype=np.int32)
        most, least = np.asarray(row.most, dtype=np.int32), np.asarray(row.least, dtype=np.int32)
        self.weight, self.norm = weight, norm
        self.bound = weight * most * (K1 + 1) / (most + floor + slope * least) * (1 + 1e-12)
        self.last = self.at[np.minimum(np.arange(1, len(most) + 1) * BLOCK, len(self.at)) - 1]
        self.top = float(self.bound.max())
        self.i, self.end = 0, len(self.at)
        self.doc = int(self.at[0])

    def seek(self, doc: int) -> None:
        self.i += int(np.searchsorted(self.at[self.i :], doc))
        self.doc = int(self.at[self.i]) if self.i < self.end else 1 << 40

    def block(self, doc: int) -> int:
        """The first block that doc may be in."""
        return self.i // BLOCK + int(np.searchsorted(self.last[self.i // BLOCK :], doc))

    def score(self) -> float:
        tf = float(self.tf[self.i])
        return self.weight * tf * (K1 + 1) / (tf + self.norm[self.doc])


def _best(cursors: list[_Cursor], k: int, rank) -> list[tuple[float, int]]:
    """(score, document) of the k best. rank: smaller is better among equal scores."""
    heap: list[tuple[float, tuple, int]] = []
    live, least = list(cursors), -1.0
    while live:
        live.sort(key=lambda c: c.doc)
        total, pivot = 0.0, -1
        for j, c in enumerate(live):
            total += c.top
            if total >= least:
                pivot = j
                break
        if pivot < 0:
            break
        doc = live[pivot].doc
        while pivot + 1 < len(live) and live[pivot + 1].doc == doc:
            pivot += 1
        blocks = [(c, c.block(doc)) for c in live[: pivot + 1]]
        if sum(float(c.bound[b]) for c, b in blocks if b < len(c.bound)) >= least:
            if live[0].doc == doc:
                score = 0.0
                for c in cursors:  # always in one order, so that equal documents get equal sums
                    if c.doc == doc:
                        score += c.score()
                entry = (score, tuple(-x for x in rank(doc)), doc)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                least = heap[0][0] if len(heap) == k else -1.0
                go = doc + 1
            else:
                go = doc
        else:
            ends = [int(c.last[b]) for c, b in blocks if b < len(c.last)]
            go = min(ends) + 1 if ends else 1 << 40
            if pivot + 1 < len(live):
                go = min(go, live[pivot + 1].doc)
        for c, _ in blocks:
            if c.doc < go:
                c.seek(go)
        live = [c for c in live if c.i < c.end]
    return [(s, d) for s, _, d in heap]


def _query_terms(queries: DataFrame, query_id: str) -> DataFrame:
    """(query, term, times) of every query."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(q, term, n) for q, text in zip(batch["query"], batch["text"], strict=True) for term, n in Counter(terms_of(text)).items()]
            yield pd.DataFrame(rows, columns=["query", "term", "times"])

    one = queries.select(F.col(query_id).cast("long").alias("query"), text_of().alias("text")).filter("query is not null").groupBy("query").agg(F.min("text").alias("text"))
    return settle(one.mapInPandas(part, "query long, term string, times long"))


def search(index: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "query_id") -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents of an index for each row of queries (query_id, text)."""
    asked = _query_terms(queries, query_id)
    terms = settle(asked.select("term").distinct())
    used = settle(index.filter("term is not null").join(small_or_none(terms, BROADCAST_TERMS) or terms, "term"))
    about = index.filter("term is null")
    size = about.agg(F.sum("docs"), F.sum("tokens")).first()
    n, mean = size[0] or 0, (size[1] or 0) / max(size[0] or 0, 1)
    slope, floor = K1 * B / max(mean, 1e-9), K1 * (1 - B)
    found = used.groupBy("term").agg(F.sum("docs").alias("df"))
    batches = max(-(-asked.select("query").distinct().count() // BATCH), 1)
    weighted = asked.join(found, "term").select(
        F.pmod(F.xxhash64("query"), F.lit(batches)).cast("int").alias("batch"), "term", F.struct("query", (F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("times")).alias("weight")).alias("of")
    )
    work = used.join(weighted.groupBy("batch", "term").agg(F.collect_list("of").alias("asked")), "term").select("shard", "batch", "term", "at", "tf", "most", "least", "asked")
    every = about.select("shard", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"), "ids", "length").unionByName(work, allowMissingColumns=True)

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        one = rows[rows["term"].isna()].iloc[0]
        norm, ids = floor + slope * np.asarray(one.length, dtype=np.int32), one.ids
        rank = lambda d: (1, 0) if ids[d] is None or ids[d] != ids[d] else (0, int(ids[d]))
        cursors: dict[int, list[_Cursor]] = {}
        for r in rows[~rows["term"].isna()].sort_values("term").itertuples():
            for of in r.asked:
                cursors.setdefault(of["query"], []).append(_Cursor(r, of["weight"], norm, floor, slope))
        out = [(q, None if rank(d)[0] else int(ids[d]), s) for q, own in cursors.items() for s, d in _best(own, k, rank)]
        frame = pd.DataFrame(out, columns=["query", "doc_id", "score"])
        return frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    hits = every.groupBy("shard", "batch").applyInPandas(best, "query long, doc_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = settle(ranked.select(F.col("query").alias(query_id), "doc_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank")))
    discard(asked, terms, used)
    return out


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "query_id") -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents for each row of queries (query_id, text)."""
    index = build_index(docs)
    out = search(index, queries, k, query_id)
    discard(index)
    return out
