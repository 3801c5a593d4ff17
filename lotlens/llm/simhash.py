"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight bytes at eight positions. Two fingerprints that differ in at most four bits share
the bytes of at least four positions. The index has a posting for every choice of three positions and their bytes;
the meetings of each pair are tallied, pairs that reach the four meetings which four shared bytes guarantee are kept
(one that shares three bytes meets once), and these are verified by their differing bits.

Postings that many different fingerprints share (they lie in one dense cluster) are not paired. Every fingerprint of
one is listed under all values within two bits of it: two fingerprints are within four bits of each other
if and only if they share such a value, so that linking each value's fingerprints to the smallest of them gives
the same components with work in proportion to the fingerprints.

Defined results: a null text counts as empty; texts without words have fingerprint zero and are linked to
whatever lies within four bits of it; rows alike are linked; component_id is null only where no member has an id; of rows
with one id and one text one_of_each keeps one; an empty table gives an empty one; texts may be of any length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import boxed, choices, components, settle, small_or_none, text_key, text_of, words

SHINGLE, BITS_APART = 4, 4
#: Postings of more different fingerprints than this are linked by shared near values, not by pairs.
PAIRED = 48
#: Fingerprints that are indexed by three positions; postings shared by two that are broadcast, at most.
FEW, BROADCAST_POSTINGS = 1 << 26, 50_000
#: Shingles counted in one packed sum; each of its four counters has 16 bits.
_CHUNK = 32767
_LANES = 0x0001000100010001
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of all word shingles of a lower-cased text; of the whole sequence if it is shorter."""
    w = words(F.translate(text, _UPPER, _LOWER))
    hashed = lambda v: (
        F.when(F.size(v) >= size, F.transform(F.sequence(F.lit(0), F.size(v) - size), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(v, i + k) for k in range(size)]))))
        .when(F.size(v) > 0, F.array(F.xxhash64(F.array_join(v, " "))))
        .otherwise(F.array().cast("array<long>"))
    )
    return F.element_at(F.transform(F.array(w), hashed), 1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp) for each row; key is a hash of the text, fp the fingerprint as a signed long.

    The 64 counters of a document are kept in 16 sums of four 16-bit lanes, over chunks of shingles that no lane
    can overflow.
    """
    rows = docs.select("doc_id", text_of().alias("__text"), F.monotonically_increasing_id().alias("row"))
    hashed = rows.select("doc_id", text_key(F.col("__text")).alias("key"), "row", shingle_hashes(F.col("__text")).alias("hs"))
    each = hashed.select("doc_id", "key", "row", F.posexplode_outer("hs").alias("pos", "h"))
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_LANES))).alias(f"s{j}") for j in range(16)]
    chunks = each.groupBy("doc_id", "key", "row", F.floor(F.col("pos") / _CHUNK).alias("chunk")).agg(*lanes, F.count("h").alias("n"))
    packed = chunks.groupBy("doc_id", "key", "row").agg(F.collect_list(F.array(*[f"s{j}" for j in range(16)])).alias("sums"), F.sum("n").alias("n"))

    def bit(b: int) -> Column:
        count = F.aggregate("sums", F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(F.get(x, F.lit(b % 16)), b // 16 * 16).bitwiseAND(F.lit(0xFFFF)))
        value = F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")
        return F.when(count * 2 > F.col("n"), value).otherwise(F.lit(0).cast("long"))

    fp = bit(0)
    for b in range(1, 64):
        fp = fp.bitwiseOR(bit(b))
    return packed.select("doc_id", "key", F.when(F.col("n") > 0, fp).otherwise(F.lit(0).cast("long")).alias("fp"))


def links(fps: DataFrame, positions: int | None = None) -> DataFrame:
    """Edges (u, v) between different fingerprints (one column fp, distinct) whose components are those of all
    pairs within four bits.

    positions: bytes that a posting fixes. Three, unless there are so many fingerprints that a random posting of
    three would hold several; then four, where one meeting is the guaranteed number.
    """
    if positions is None:
        positions = 3 if fps.limit(FEW + 1).count() <= FEW else 4
    masks = [sum(0xFF << 8 * p for p in some) for some in choices(8, positions)]
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    postings = fps.select("fp", F.explode(signed).alias("mask")).select("fp", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("posting"))
    # A posting of two is its least and its largest fingerprint: only larger ones need their members looked up.
    shared = settle(postings.groupBy("posting").agg(F.count("*").alias("n"), F.max("fp").alias("u"), F.min("fp").alias("v")).filter(f"n > 2 or n = 2 and bit_count(u ^ v) <= {BITS_APART}"))
    few = small_or_none(shared, BROADCAST_POSTINGS)
    larger = (few or shared).filter("n > 2").select("posting", "n")
    if few is None and larger.limit(BROADCAST_POSTINGS + 1).count() <= BROADCAST_POSTINGS:
        larger = F.broadcast(larger)
    met = settle(postings.join(larger, "posting"))
    a = met.filter(f"n <= {PAIRED}").drop("n")
    pairs = a.join(a.select(F.col("fp").alias("v"), "posting"), "posting").filter("fp > v").select(F.col("fp").alias("u"), "v")
    pairs = pairs.union(shared.filter("n = 2").select("u", "v")).groupBy("u", "v").agg(F.count("*").alias("tally"))
    # Four shared bytes are met in every choice of them; a pair that misses one meets in a large posting, see below.
    pairs = pairs.filter(F.col("tally") >= math.comb(8 - BITS_APART, positions)).filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= BITS_APART).select("u", "v")

    one, other = F.expr("shiftleft(1L, i)"), F.expr("if(j < 64, shiftleft(1L, j), 0L)")
    near = (
        met.filter(f"n > {PAIRED}").select("fp").distinct()
        .select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
        .select("fp", "i", F.explode(F.sequence(F.col("i"), F.lit(64))).alias("j"))
        .filter("i <> j or i = 0")
        .select("fp", F.col("fp").bitwiseXOR(F.when(F.col("i") == F.col("j"), F.lit(0).cast("long")).otherwise(one.bitwiseXOR(other))).alias("value"))
    )
    least = near.groupBy("value").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).filter("v < most").drop("most")
    stars = near.join(least, "value").filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp, component_id) for each row of docs (doc_id, text)."""
    prints = settle(fingerprints(docs))
    return with_components(prints)


def with_components(prints: DataFrame) -> DataFrame:
    """Add component_id, the smallest doc_id in reach, to rows (doc_id, key, fp)."""
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted = settle(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "component_id"), "fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, one for each component: that with the smallest doc_id (nulls last) and text hash."""
    found = near_duplicates(docs)
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("r")).select(F.col("r.doc_id").alias("__id"), F.col("r.key").alias("__key"))
    rows = boxed(docs, F.col("doc_id").alias("own"), text_key(text_of()).alias("own_key"))
    kept = rows.join(first, F.col("own").eqNullSafe(F.col("__id")) & (F.col("own_key") == F.col("__key")), "left_semi")
    return kept.dropDuplicates(["own", "own_key"]).select("row.*")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")

