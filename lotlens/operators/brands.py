"""What makes typed names mean: exact alias keys, else the one make within one edit, or two in longer names.

Names meet through deletions: two keys within d edits, swaps of neighbours counting as one, share a string that each
becomes by deleting at most d characters. The index has every alias key under its deletions; typed names are looked up
under theirs by an equi-join, and the few that meet are measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.functions.lineage import small_or_none
from lotlens.operators.taxonomy import MAKES, make_key

#: Keys up to this length tolerate one edit, longer ones two; shorter ones than LEAST mean nothing.
SHORT, EDITS, LEAST = 5, 2, 2
#: Rows of the index that are broadcast.
BROADCAST_ROWS = 200_000


def alias_keys(spark: SparkSession, makes: dict[str, list[str]] = MAKES) -> DataFrame:
    """(make, key): every alias key, and the make's own; a key that two makes claim belongs to the first."""
    rows, taken = [], set()
    for make, keys in makes.items():
        own = "".join(c for c in make.lower() if c.isascii() and c.isalnum())
        for k in dict.fromkeys([own, *keys]):
            if k and k not in taken:
                taken.add(k)
                rows.append((make, k))
    return spark.createDataFrame(rows, "make string, key string")


def _shorter(keys: Column) -> Column:
    """All strings with one character less."""
    less = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(k), F.lit(1))), lambda i: F.concat(F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.length(k))))
    return F.array_distinct(F.flatten(F.transform(keys, less)))


def deletions(key: Column, edits: int = EDITS) -> Column:
    """The key and all that it becomes by up to so many deletions."""
    every = level = F.array(key)
    for _ in range(edits):
        level = _shorter(level)
        every = F.concat(every, level)
    return F.array_distinct(every)


def edits(a: Column, b: Column) -> Column:
    """Edits between two short keys, a swap of neighbours being one and no character edited twice."""
    at = lambda s, i: F.substring(s, i, F.lit(1))

    def cell(s: Column, row: Column, i: Column, j: Column) -> Column:
        plain = F.least(F.element_at(row, j) + 1, F.element_at(s["last"], j + 1) + 1, F.element_at(s["last"], j) + F.when(at(a, i) == at(b, j), 0).otherwise(1))
        swapped = (i > 1) & (j > 1) & (at(a, i) == at(b, j - 1)) & (at(a, i - 1) == at(b, j))
        return F.when(swapped, F.least(plain, F.get(s["before"], j - 2) + 1)).otherwise(plain)

    def line(s: Column, i: Column) -> Column:
        new = F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(i), lambda row, j: F.concat(row, F.array(cell(s, row, i, j))))
        return F.struct(s["last"].alias("before"), new.alias("last"))

    zero = F.sequence(F.lit(0), F.length(b))
    whole = F.aggregate(F.sequence(F.lit(1), F.length(a)), F.struct(zero.alias("before"), zero.alias("last")), line, lambda s: F.element_at(s["last"], -1))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.greatest(F.length(a), F.length(b))).otherwise(whole)


def resolved(typed: DataFrame, column: str = "typed", makes: dict[str, list[str]] = MAKES) -> DataFrame:
    """(column, make) of the different typed names that mean exactly one make."""
    names = typed.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("own", make_key(F.col(column))).filter(F.length("own") >= LEAST)
    keys = alias_keys(typed.sparkSession, makes)
    checked = lambda df: small_or_none(df, BROADCAST_ROWS) or df
    exact = names.join(checked(keys), F.col("own") == F.col("key")).select(column, "make")
    index = keys.withColumn("form", F.explode(deletions(F.col("key"))))
    longest = max(len(k) for v in makes.values() for k in [*v, *makes]) + EDITS
    rest = names.join(checked(keys).select(F.col("key").alias("own")), "own", "left_anti").filter(F.length("own") <= longest)
    most = F.when(F.length("own") <= SHORT, 1).otherwise(EDITS)
    forms = F.when(F.length("own") <= SHORT, deletions(F.col("own"), 1)).otherwise(deletions(F.col("own"), EDITS))
    met = rest.withColumn("form", F.explode(forms)).join(checked(index), "form").filter(F.abs(F.length("own") - F.length("key")) <= most)
    near = met.select(column, "own", "make", "key").distinct().withColumn("edits", edits(F.col("own"), F.col("key"))).filter(F.col("edits") <= most)
    best = near.groupBy(column).agg(F.min("edits").alias("least")).join(near, column).filter(F.col("edits") == F.col("least"))
    one = best.groupBy(column).agg(F.min("make").alias("make"), F.max("make").alias("other")).filter("make = other").drop("other")
    return exact.unionByName(one)


def matching_options(options: DataFrame, typed: DataFrame, makes: dict[str, list[str]] = MAKES) -> DataFrame:
    """(option, typed) that match: a blank name matches all options, else one of the option's keys holds the name's key
    or lies in it, or the name means the option. options and typed are lists of a filter, both broadcast when counted small."""
    spark = options.sparkSession
    a = options.select("option").distinct().withColumn("key", make_key(F.col("option")))
    known = alias_keys(spark, makes).select(F.col("make").alias("option"), F.col("key").alias("alias"))
    aliases = a.join(known, "option", "left").groupBy("option").agg(F.array_distinct(F.concat(F.collect_set("alias"), F.collect_list("key"))).alias("keys"))
    b = typed.select("typed").distinct().withColumn("own", make_key(F.coalesce("typed", F.lit(""))))
    holds = F.exists("keys", lambda k: F.contains(k, F.col("own")) | F.contains(F.col("own"), k))
    small = small_or_none(aliases, BROADCAST_ROWS)
    if small is None:
        raise ValueError("a filter has at most that many options")
    inside = b.join(small, (F.col("own") == "") | holds).select("option", "typed")
    meant = resolved(typed, "typed", makes).withColumnRenamed("make", "option").join(a.select("option"), "option").select("option", "typed")
    return inside.unionByName(meant).distinct()
