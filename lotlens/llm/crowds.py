"""Linked pairs of large groups of sets that resemble one head, by what each differs in from it.

A member is told by its differences from the head: the elements that one of the two has alone. Two members of a and b
elements are linked if and only if they differ in at most t = (100 - h) / (100 + h) (a + b) elements, and they differ in
what only one of them differs in from the head. With x and y differences, w of them shared, that is x + y - 2 w <= t.

Members linked to the head are one component already, so that of a pair that is left one at least is far from it, with
more than (100 - h) / (100 + h) (a + the head's size) differences. Hence a linked pair shares more than about half of the
other's differences, and all of its own but t. In an order common to all, rarest first, the pair then shares one among the
first x - w + 1 of the one and y - w + 1 of the other: only these are looked up, and only where both places allow it.
Differences that the same members have (those of one edit) are looked up as one, which counts as many. What
all members have of the head is no difference and is never looked up; nor is what none shares with another component.

Two that meet so are first told apart by parities: a set's parity has a bit for each of PARITY classes of elements, set
where it holds an odd number of them. Two parities differ in at most as many bits as the sets in elements, so that no pair
which differs in more than t bits is linked, and only what is left becomes a row.

Many members that are all linked to each other, but not to the head, would still meet in pairs. So all that share a
difference first meet one of them, ROUNDS times another one, and links found so join their components: rows in proportion
to the differences. Only components that this leaves apart are searched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotlens.llm.common import components, discard, settle

#: Allowance for rounding where a bound is a real number; it only makes searches longer.
SLACK = 1e-6
#: Bits of a parity, in words of 64.
PARITY = 1024
#: Times that all members of a difference meet one of them, before pairs are searched.
ROUNDS = 2


def linked_apart(member: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    """Pairs (u, v) of members of one head in different components, u > v, that are linked; of those that join the same
    member and component one may stand for all. member: (head, id, root), once each; sets: (id, own), different elements.
    """
    share, least_of_larger = (100 - hundredths) / (100 + hundredths), hundredths / 100
    whole = member.join(sets, "id").join(sets.select(F.col("id").alias("head"), F.col("own").alias("of_head")), "head")
    alone, missing = F.array_except("own", "of_head"), F.array_except("of_head", "own")
    told = whole.select("head", "id", "root", F.size("own").alias("n"), F.size("of_head").alias("n_head"), F.concat(alone, missing).alias("d")).withColumn("size", F.size("d"))
    all_, apart = F.col("n") + F.col("n_head"), F.col("size")
    differ = settle(told.withColumn("far", 100 * (all_ - apart) < hundredths * (all_ + apart)))
    each = differ.select("head", "id", "root", "n", "n_head", "far", "size", F.explode("d").alias("gram"))
    # Differences that the same members have (those of one edit) are one kind, that weighs as many. Windows, so that the
    # differences are moved once and not joined with their own counts; a window holds no more than the members of a head.
    same = Window.partitionBy("head", "gram")
    told = {"often": F.count("*"), "kind": F.bit_xor(F.xxhash64("id")), "asked": F.bool_or("far"), "low": F.min("root"), "high": F.max("root")}
    kinds = each.select("*", *[x.over(same).alias(c) for c, x in told.items()]).filter("asked and low < high")
    kinds = kinds.groupBy("head", "id", "root", "n", "n_head", "far", "size", "often", "kind").agg(F.count("*").alias("weight"))
    # after: the differences from this place on, of which a pair shares no more if this is the first that it shares.
    after = F.sum("weight").over(Window.partitionBy("head", "id").orderBy(F.desc("often"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    most = F.ceil(F.col("size") - share * (F.col("n") + F.col("n") / least_of_larger) - SLACK)
    half = F.floor((F.col("size") + share * (F.col("n_head") - F.col("n"))) / 2 - SLACK) + 1
    places = kinds.withColumn("after", after).withColumn("asks", F.col("far") & (F.col("after") >= most)).withColumn("answers", F.col("after") >= F.greatest(most, half))
    places = places.filter("asks or answers").select("head", "id", "root", "n", "far", "size", "weight", "asks", "answers", "after", "often", "kind")
    places = settle(places.join(_parities(sets), "id"))
    words = [f"p{w}" for w in range(PARITY // 64)]
    columns = ("id", "root", "n", "far", "size", "weight", "after", *words)
    sided = lambda rows, k: rows.select("head", "often", "kind", *[F.col(c).alias(c + k) for c in columns])
    odd = sum((F.bit_count(F.col(w + "a").bitwiseXOR(F.col(w + "b"))) for w in words), F.lit(0))
    near = (100 * F.least("na", "nb") >= hundredths * F.greatest("na", "nb")) & (odd <= share * (F.col("na") + F.col("nb")) + SLACK)
    apart = F.col("roota") != F.col("rootb")
    starred = []
    for turn in range(ROUNDS):
        one = places.groupBy("head", "often", "kind").agg(F.min_by(F.struct(*columns), F.xxhash64("id", F.lit(turn))).alias("one"), F.min("root").alias("low"), F.max("root").alias("high"))
        one = one.filter("low < high").select("head", "often", "kind", "one.*")
        stars = sided(places, "a").join(sided(one, "b"), ["head", "often", "kind"]).filter(apart & near).select("head", "ida", "rootb", "idb", "roota").distinct()
        links = settle(_linked(stars, differ, hundredths, "roota"))
        starred.append(links)
        roots = settle(components(links.select(F.col("roota").alias("u"), F.col("rootb").alias("v"))).select(F.col("node").alias("root"), F.col("root").alias("joined")))
        before, places = places, settle(places.join(roots, "root", "left").withColumn("root", F.coalesce("joined", "root")).drop("joined"))
        discard(before, roots)
    a, b = sided(places.filter("asks"), "a"), sided(places.filter("answers"), "b")
    shared = (F.col("sizea") + F.col("sizeb") - share * (F.col("na") + F.col("nb"))) / 2 - SLACK
    fits = apart & near & (~F.col("farb") | (F.col("ida") > F.col("idb"))) & (F.least("aftera", "afterb") >= shared)
    met = a.join(b, ["head", "often", "kind"]).filter(fits)
    tally = settle(met.groupBy("head", "ida", "idb").agg(F.sum(F.least("weighta", "weightb")).alias("n"), F.first("rootb").alias("rootb")))
    best = tally.groupBy("head", "ida", "rootb").agg(F.max_by("idb", F.struct("n", "idb")).alias("idb"))
    found = settle(_linked(best, differ, hundredths))
    # Where the likeliest member of a component isn't linked, all the others are tried.
    others = tally.join(found.select("head", "ida", "rootb"), ["head", "ida", "rootb"], "left_anti").join(best.select("head", "ida", "idb"), ["head", "ida", "idb"], "left_anti")
    last = rest = settle(_linked(others, differ, hundredths))
    for links in starred:
        rest = rest.union(links.select("head", "ida", "rootb", "idb"))
    out = settle(found.union(rest).select(F.greatest("ida", "idb").alias("u"), F.least("ida", "idb").alias("v")).distinct())
    discard(differ, places, tally, found, last, *starred)
    return out


def _parities(sets: DataFrame) -> DataFrame:
    """(id, p0, p1, ..): the parity of every set."""
    each = sets.select("id", F.explode("own").alias("gram")).withColumn("at", F.pmod(F.xxhash64("gram"), F.lit(PARITY)))
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    return each.groupBy("id").agg(*[F.bit_xor(F.when(F.floor(F.col("at") / 64) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"p{w}") for w in range(PARITY // 64)])


def _linked(pairs: DataFrame, differ: DataFrame, hundredths: int, *beside: str) -> DataFrame:
    """The rows (head, ida, rootb, idb, beside) of pairs whose sets are linked."""
    for k in "ab":
        pairs = pairs.join(differ.select("head", F.col("id").alias("id" + k), F.col("n").alias("n" + k), F.col("d").alias("d" + k)), ["head", "id" + k])
    apart = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    told = pairs.select("head", "ida", "rootb", "idb", *beside, (F.col("na") + F.col("nb")).alias("both"), apart.alias("apart"))
    return told.filter(100 * (F.col("both") - F.col("apart")) >= hundredths * (F.col("both") + F.col("apart"))).select("head", "ida", "rootb", "idb", *beside)
