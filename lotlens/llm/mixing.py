"""Mixing sources to target weights by entropy balancing.

Every document starts at a rate of one. The rates nearest to that in relative entropy that give each source its
target number of words, and no document more than `cap` copies, are `min(cap, exp(lambda_source * size))`. The
dual is convex and separable by source; Newton's steps on it (taken on the logarithm of a source's words, which is
flatter) run as joins and sums over the (source, size)
histogram of the corpus, so that a step reads neither texts nor documents. The rates are then rounded
into whole copies: no document gets more than its rate rounded up or less than its rate rounded down.

Defined results: a null text counts as empty (size 0, one copy); a null source is a source of its own, the last;
rows alike in doc_id and text are treated alike; an empty table gives an empty one; columns of the input are kept,
but for one named as the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.llm.common import boxed, n_words, settle, small_or_none, text_key, text_of

#: Newton steps at most; a source ends when its words are within this share of its target.
STEPS, NEAR = 60, 1e-6
#: Size classes up to this number are broadcast to the documents.
BROADCAST_CLASSES = 300_000
#: Parts of the hash range in which the members of a size class are counted before any are ranked.
PARTS = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """From (source, source_size), one row a source, add the target of each.

    Sources in order of code points, null last, have the weights in turn. Targets share the sum of all sizes by
    weight; none passes `cap` times its source's size, and what it can't take goes to the others by weight. Sources
    sorted by cap per weight reach their caps in that order, so one prefix sum finds who is capped.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    fill = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("most") >= F.col("weight") * F.col("level"), F.col("level"))).over(every))
        .withColumn("target", F.least("most", F.col("weight") * F.coalesce("level", F.lit(math.inf))))
        .select("source", "source_size", "target")
    )


def exact(column: Column) -> Column:
    """A sum that doesn't depend on the order of its rows, so that reruns agree to the last bit."""
    return F.sum(column.cast("decimal(36,6)")).cast("double")


def balance(classes: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """Lambda of each source: (source, source_size, target, lam), by safeguarded Newton steps on the dual."""
    ends = classes.filter("size > 0").groupBy(F.col("source").alias("of")).agg(F.min("size").alias("least"))
    growth = F.log(F.col("target") / F.col("source_size"))
    full = F.col("target") >= F.col("source_size") * F.lit(cap * (1 - NEAR))
    state = settle(
        targets.join(ends, F.col("source").eqNullSafe(F.col("of")), "left")
        .drop("of")
        .withColumn("lam", F.when(F.col("least").isNull(), 0.0).when(full, F.lit(math.inf)).otherwise(F.lit(0.0)))
        .withColumn("done", F.col("least").isNull() | full)
        .withColumn("lo", F.when(~F.col("done"), F.least(growth / F.col("least"), F.lit(0.0))))
        .withColumn("hi", F.when(~F.col("done"), F.when(growth > 0, F.lit(math.log(cap)) / F.col("least")).otherwise(F.lit(0.0))))
    )
    for _ in range(STEPS):
        if state.filter("not done").isEmpty():
            break
        open_ = state.filter("not done").select(F.col("source").alias("of"), F.col("lam").alias("now"))
        rate = F.exp(F.least(F.col("now") * F.col("size"), F.lit(math.log(cap))))
        tokens = F.col("n") * F.col("size") * rate
        slope = F.when(F.col("now") * F.col("size") < math.log(cap), tokens * F.col("size")).otherwise(0.0)
        sums = (
            classes.join(open_, classes["source"].eqNullSafe(open_["of"]))
            .groupBy("of")
            .agg(exact(tokens).alias("tokens"), exact(slope).alias("slope"))
        )
        gap = F.col("tokens") - F.col("target")
        newton = F.col("lam") - F.log(F.col("tokens") / F.col("target")) * F.col("tokens") / F.nullif(F.col("slope"), F.lit(0.0))
        state = settle(
            state.join(sums, state["source"].eqNullSafe(sums["of"]), "left")
            .withColumn("hit", F.col("done") | (F.abs(gap) <= F.col("target") * NEAR))
            .withColumn("lo", F.when(~F.col("hit") & (gap < 0), F.col("lam")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(~F.col("hit") & (gap > 0), F.col("lam")).otherwise(F.col("hi")))
            .withColumn("lam", F.when(F.col("hit"), F.col("lam")).when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2))
            .withColumn("done", F.col("hit"))
            .select("source", "source_size", "target", "least", "lam", "done", "lo", "hi")
        )
    return state.select("source", "source_size", "target", "lam")


def whole_copies(rated: DataFrame, cap: int) -> DataFrame:
    """Add the copies of each (source, size) class to (source, size, n, rate): systematic rounding within a source.

    The copies asked for are summed from the longest class to the shortest, and a class gets what the rounded sum
    grows by: its copies are what its rate asks for rounded down or up, and a source's words end within half its
    longest document of what the rates give. A source has a row for each length of its documents only.
    """
    order = Window.partitionBy("source").orderBy(F.desc("size"))
    asked = F.when(F.col("size") > 0, F.col("n") * F.col("rate")).otherwise(0.0)
    upto = F.floor(F.sum(asked).over(order.rowsBetween(Window.unboundedPreceding, 0)) + 0.5)
    summed = rated.withColumn("upto", upto)
    share = F.col("upto") - F.lag("upto", 1, 0).over(order)
    return summed.withColumn("copies", F.when(F.col("size") == 0, F.col("n")).otherwise(F.least(F.greatest(share, F.lit(0)), cap * F.col("n")))).drop("upto")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: int = 3, into: str = "mix") -> DataFrame:
    """Add a struct (size, source_size, target, rate, copies) to every row of docs (doc_id, text, source)."""
    text = text_of()
    sized = docs.drop(into).withColumn("__size", n_words(text)).withColumn("__h", F.xxhash64(F.lit(4), "doc_id", text_key(text)))
    light = sized.select("source", F.col("__size").alias("size"), F.col("__h").alias("h"))
    part = F.shiftrightunsigned("h", 64 - int(math.log2(PARTS)))
    counts = settle(light.groupBy("source", "size", part.alias("part")).agg(F.count("*").alias("n")))
    classes = settle(counts.groupBy("source", "size").agg(F.sum("n").alias("n")))
    sizes = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    lam = balance(classes, source_targets(sizes, weights, cap), float(cap))

    of = lam.withColumnRenamed("source", "of")
    rated = classes.join(of, classes["source"].eqNullSafe(of["of"])).withColumn(
        "rate", F.when(F.col("size") == 0, 1.0).otherwise(F.exp(F.least(F.col("lam") * F.col("size"), F.lit(math.log(cap)))))
    )
    plan = settle(
        whole_copies(rated, cap)
        .withColumn("base", F.floor(F.col("copies") / F.col("n")))
        .withColumn("extra", F.col("copies") - F.col("base") * F.col("n"))
        .select("source", "size", "source_size", "target", "rate", "base", "extra")
    )

    # The documents of a class with the smallest hashes get one copy more: find the part in which the last of
    # them lies by its counts, and rank within that part alone.
    some = plan.filter("extra > 0").select(F.col("source").alias("of"), F.col("size").alias("of_size"), "extra")
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size"))
    run = Window.partitionBy("source", "size").orderBy("part")
    last = (
        counts.withColumn("upto", F.sum("n").over(run))
        .join(some, same)
        .filter((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("n") < F.col("extra")))
        .select("of", "of_size", F.col("part").alias("of_part"), (F.col("extra") - F.col("upto") + F.col("n")).alias("nth"))
    )
    ranked = light.join(last, same & (part == F.col("of_part"))).withColumn("rank", F.row_number().over(Window.partitionBy("of", "of_size").orderBy("h")))
    cut = ranked.filter("rank = nth").select("of", "of_size", F.col("h").alias("cut_h"), "of_part")
    plan = settle(plan.join(cut, same, "left").drop("of", "of_size", "extra"))

    plan = plan.select(F.col("source").alias("__of"), F.col("size").alias("__of_size"), "source_size", "target", "rate", "base", "cut_h", "of_part").select(
        "__of", "__of_size", F.struct("source_size", "target", "rate", "base", "cut_h", "of_part").alias("__p")
    )
    here = F.shiftrightunsigned("__h", 64 - int(math.log2(PARTS)))
    more = F.col("__p.cut_h").isNotNull() & ((here < F.col("__p.of_part")) | ((here == F.col("__p.of_part")) & (F.col("__h") <= F.col("__p.cut_h"))))
    classes_of = small_or_none(plan, BROADCAST_CLASSES) or plan  # else documents are shuffled by their class
    joined = sized.join(classes_of, F.col("source").eqNullSafe(F.col("__of")) & (F.col("__size") == F.col("__of_size")), "left")
    found = F.struct(
        F.col("__size").alias("size"),
        F.col("__p.source_size").alias("source_size"),
        F.col("__p.target").alias("target"),
        F.col("__p.rate").alias("rate"),
        (F.col("__p.base") + more.cast("long")).alias("copies"),
    )
    return joined.withColumn(into, found).drop("__size", "__h", "__of", "__of_size", "__p")


def mixed(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mix itself: every row of docs as often as its copies say."""
    rows = mix(boxed(docs, "doc_id", "text", "source"), weights, cap, "mix").filter("mix.copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("mix.copies").cast("int"))).alias("copy")).select("row.*")
