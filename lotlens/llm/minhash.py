"""MinHash near-duplicates by bottom-k sketches of one hash function.

A document's set is its different shingles of five words, hashed to 64 bits; its sketch the k smallest of them. Documents
of one set are one class. An inverted list of retained values says which classes share one; from their overlap the
union sketch (the k smallest of both) estimates the similarity, pairs far below the threshold go, and the rest are
confirmed on full sets.

What every linked pair has in common bounds the search. The k smallest of a union are a sample of it, so that a pair of
similarity 0.85 retains SHARED of 64 values in common but once in 10^9 pairs; where both sets are so small that the
sketches hold them whole, it has 0.85 of the larger one without exception. Hence only the rarest values of a sketch are
looked up: k - SHARED + 1 of them can't all be missed, however the values are ordered. Values of one class link nothing.

A list is first linked through one head, the class whose values most others retain, and joined by union-find. What that
leaves in different components is compared pair by pair in lists of up to PAIRED classes, and in larger ones by an exact
search on full sets among what each class differs in from the list's head (crowds.py).

Defined results: a null text, an empty one and one without words have an empty set and are linked with nothing but
themselves (their own id is their component); a text of fewer than five words is one shingle; texts alike are linked, rows
alike too; ids may be null and then come last, a component of nulls alone has a null id and its rows are kept; texts may be
of any length; an empty table gives an empty one. Only doc_id and text are read of the input, whatever other columns there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import components, discard, left_join_checked, once, settle, small_or_none, text_key, text_of
from lotlens.llm.crowds import linked_apart

#: Words in a shingle; hundredths of similarity that link.
WORDS, HUNDREDTHS = 5, 85
#: Values in a sketch, and how many of them linked documents share: fewer with a probability under 10^-9.
SKETCH, SHARED = 64, 34
#: Lists of up to this many classes are compared in pairs.
PAIRED = 32
#: Classes and values that are broadcast, at most.
BROADCAST_CLASSES, BROADCAST_VALUES = 400_000, 400_000
#: Pairs that one task compares.
PAIRS_A_TASK = 20_000
#: Bytes of text whose words are hashed together; words that a worker remembers.
HASHED, REMEMBERED = 8 << 20, 500_000


class _Hashes(dict):
    """64-bit hashes of words, each made once."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of sums over the whole range, one value to one value."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sets_of(texts: list[str | None]) -> list[np.ndarray]:
    """The different shingle hashes of each text, ascending as signed longs."""
    words = [(t or "").encode().lower().split() for t in texts]
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    size = np.array([len(w) for w in words], dtype=np.int64)
    h = np.fromiter((_hashes[x] for w in words for x in w), dtype=np.uint64, count=size.sum())
    step = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(len(h) - WORDS + 1, 0), dtype=np.uint64)
    for k in range(WORDS):
        rolled = rolled * step + h[k : k + len(rolled)]
    rolled = _mixed(rolled).view(np.int64)
    out, at = [], 0
    for w, n in zip(words, size.tolist(), strict=True):
        if n >= WORDS:
            out.append(np.unique(rolled[at : at + n - WORDS + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=n)] if n else [], dtype=np.uint64).view(np.int64))
        at += n
    return out


def _by_bytes(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of batches with up to HASHED bytes of text (or one text)."""
    for batch in batches:
        start, held, texts = 0, 0, []
        for k, text in enumerate(batch.column(column)):
            texts.append(text.as_py())
            held += len(texts[-1] or "")
            if held >= HASHED or k + 1 == batch.num_rows:
                yield batch.slice(start, len(texts)), texts
                start, held, texts = k + 1, 0, []


_LONGS = pa.list_(pa.int64())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    upto = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, same, n, sketch) of every row: key a hash of the text, same one of the whole set, n its size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _by_bytes(batches, 2):
            sets = sets_of(texts)
            same = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            columns = [rows.column(0), rows.column(1), same, pa.array([len(s) for s in sets], pa.int64()), _lists([s[:SKETCH] for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "same", "n", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text_of()).alias("key"), text_of().alias("text"))
    return rows.mapInArrow(work, "doc_id long, key long, same binary, n long, sketch array<long>")


def full_sets(rows: DataFrame) -> DataFrame:
    """(same, grams) of rows (same, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, texts in _by_bytes(batches, 1):
            yield pa.RecordBatch.from_arrays([some.column(0), _lists(sets_of(texts))], names=["same", "grams"])

    return rows.mapInArrow(work, "same binary, grams array<long>")


def least_shared(size: Column, sketch: int, shared: int) -> Column:
    """How many values a sketch of so many has in common with that of any linked document."""
    return F.when(size <= F.lit(HUNDREDTHS * sketch // 100), F.ceil(size * HUNDREDTHS / 100)).otherwise(shared).cast("int")


def meetings(classes: DataFrame, sketch: int = SKETCH, shared: int = SHARED) -> DataFrame:
    """(same, value, list_size, head) for the values of a sketch that are looked up and that other classes look up too."""
    values = classes.select("same", F.size("sketch").alias("held"), F.explode("sketch").alias("value"))
    common = settle(values.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1"))
    met = values.join(small_or_none(common, BROADCAST_VALUES) or common, "value")
    # Values that no other class has come first in every order, so only the place among the shared ones is counted.
    of = met.groupBy("same", "held").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("ranked"), F.sum("n").alias("central"))
    looked_up = F.size("ranked") - least_shared(F.col("held"), sketch, shared) + 1
    rare = of.filter(looked_up > 0).select("same", "central", F.explode(F.slice("ranked", F.lit(1), looked_up)).alias("r")).select("same", "central", F.col("r.value").alias("value"))
    rare = settle(rare)
    # The head is the class whose values most others have: of copies that differ from each other, what they were made from.
    heads = settle(rare.groupBy("value").agg(F.count("*").alias("list_size"), F.max_by("same", F.struct("central", "same")).alias("head")).filter("list_size > 1"))
    out = settle(rare.join(small_or_none(heads, BROADCAST_VALUES) or heads, "value").select("same", "value", "list_size", "head"))
    discard(common, rare, heads)
    return out


def estimated(pairs: DataFrame, classes: DataFrame, sketch: int = SKETCH, shared: int = SHARED) -> DataFrame:
    """The pairs (u, v) whose union sketch leaves it possible that they are linked."""
    sides = [classes.select(F.col("same").alias(k), F.col("sketch").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in "uv"]
    pairs = pairs.repartition(pairs.count() // PAIRS_A_TASK + 1, "u", "v")
    for k, side in zip("uv", sides, strict=True):
        pairs = pairs.join(side, k)
    fits = 100 * F.least("nu", "nv") >= HUNDREDTHS * F.greatest("nu", "nv")

    def possible(every: Column) -> Column:
        last, union = F.get(every, F.size(every) - 1), F.size(every)
        sampled = F.size(F.filter(F.array_intersect("su", "sv"), lambda x: x <= last))
        return F.when(union < sketch, 100 * sampled >= HUNDREDTHS * union).otherwise(sampled >= shared)

    # The union is sorted once, not for each of its uses.
    return pairs.filter(fits).filter(once(F.slice(F.sort_array(F.array_union("su", "sv")), 1, sketch), possible)).select("u", "v")


def confirmed(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """The pairs (u, v) that are linked, by their full sets. grams: (same, grams)."""
    for k in "uv":
        pairs = pairs.join(grams.select(F.col("same").alias(k), F.col("grams").alias(f"g{k}")), k)
    shared, both = F.size(F.array_intersect("gu", "gv")), F.size("gu") + F.size("gv")
    counted = pairs.select("u", "v", shared.alias("shared"), both.alias("both"))
    return counted.filter(100 * F.col("shared") >= HUNDREDTHS * (F.col("both") - F.col("shared"))).select("u", "v")


def _pair(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def unresolved(rooted: DataFrame) -> DataFrame:
    """The rows (same, value, list_size, head, root) of lists that hold several components."""
    some = rooted.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("value")
    return rooted.join(small_or_none(some, BROADCAST_VALUES) or some, "value", "left_semi")


def pairs_apart(open_lists: DataFrame) -> DataFrame:
    """Pairs (u, v) of different components in lists of up to PAIRED classes."""
    a = open_lists.filter(F.col("list_size") <= PAIRED).select("value", F.col("same").alias("a"), F.col("root").alias("ra"))
    b = a.select("value", F.col("a").alias("b"), F.col("ra").alias("rb"))
    return a.join(b, "value").filter("a > b and ra <> rb").select(*_pair("a", "b")).distinct()


def crowd_apart(open_lists: DataFrame, grams: DataFrame) -> DataFrame:
    """Pairs (u, v) of different components of larger lists that are linked, by full sets; with the others, they join all that are."""
    large = open_lists.filter(F.col("list_size") > PAIRED)
    member = settle(large.groupBy("head", F.col("same").alias("id")).agg(F.first("root").alias("root")))
    out = linked_apart(member, grams.select(F.col("same").alias("id"), F.col("grams").alias("own")), HUNDREDTHS)
    discard(member)
    return out


def roots_of(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(same, root) of the classes that have links to others. classes: (same, n, sketch, doc_id, key), a row of docs each."""
    met = meetings(classes.select("same", "sketch"))
    ids = settle(met.select("same").distinct())
    near = settle(classes.join(small_or_none(ids, BROADCAST_CLASSES) or ids, "same"))
    places = near.select("same", F.col("doc_id").alias("of"), F.col("key").alias("of_key"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_key(text_of()).alias("id_key"), text_of().alias("text"))
    texts = texts.join(small_or_none(places, BROADCAST_CLASSES) or places, F.col("id").eqNullSafe(F.col("of")) & (F.col("id_key") == F.col("of_key")))
    grams = settle(full_sets(texts.select("same", "text").dropDuplicates(["same"])))
    stars = settle(met.filter("same <> head").select(*_pair("same", "head")).distinct())
    links = settle(confirmed(settle(estimated(stars, near)), grams))
    roots = settle(components(links).select(F.col("node").alias("same"), "root"))
    rooted = left_join_checked(met, roots, "same", BROADCAST_CLASSES).withColumn("root", F.coalesce("root", "same"))
    still = settle(unresolved(rooted))
    more = settle(confirmed(settle(estimated(settle(pairs_apart(still)), near)), grams))
    if not still.filter(F.col("list_size") > PAIRED).isEmpty():
        more = settle(more.union(crowd_apart(still, grams)).distinct())
    if not more.isEmpty():
        known = roots.select(F.col("same").alias("u"), F.col("root").alias("v"))
        before, roots = roots, settle(components(known.union(more)).select(F.col("node").alias("same"), "root"))
        discard(before)
    discard(met, ids, near, grams, stars, links, still, more)
    return roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_shingles, component_id) of every row of docs (doc_id, text)."""
    drawn = settle(sketches(docs))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    # The sketch is that of any member: all have one set.
    grouped = drawn.filter("n > 0").groupBy("same").agg(F.count("*").alias("rows"), F.min(place).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = settle(grouped.select("same", "rows", "n", "sketch", F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key")))
    roots = roots_of(classes.select("same", "n", "sketch", "doc_id", "key"), docs)
    named = left_join_checked(classes.select("same", "rows", F.col("doc_id").alias("least")), roots, "same", BROADCAST_CLASSES).withColumn("linked", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "same"))
    named = settle(named.filter("linked or rows > 1"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = settle(left_join_checked(named, first, "root", BROADCAST_CLASSES).select("same", "component_id", F.lit(True).alias("grouped")))
    rows = left_join_checked(drawn.select("doc_id", "key", "same", "n"), moved, "same", BROADCAST_CLASSES)
    out = rows.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.coalesce("grouped", F.lit(False)), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    discard(classes, named)
    return out


def minhash_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    found = near_duplicates(docs)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
