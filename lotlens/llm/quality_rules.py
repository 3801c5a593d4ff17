"""Quality rules: base rules, and a hashed n-gram log-likelihood ratio of trusted against raw text.

Two multinomials over hashed word unigrams and bigrams are counted: one over the documents that are trusted, one
over all of them. A document's score is the mean over its n-grams of log(p_trusted / p_raw); it is kept if it
passes the base rules and its score reaches a fixed threshold. Everything is built from DataFrame functions.

Defined results: a null text has no words and fails the base rules; rows alike count as often as they occur; with no
trusted document the ratio is zero everywhere, so that the base rules decide alone; columns of the input are not
returned but for doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import boxed, left_join_checked, settle, text_key, text_of, words

#: Hash buckets of the two multinomials, and what each bucket's counts start from.
BUCKETS, SMOOTHING = 1 << 16, 1.0
#: Mean log-likelihood ratio below which a document is rejected.
THRESHOLD = -0.1
#: Trusted ids up to this number are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
SYMBOLS = r"[#*$%&|<>]"
_POSITION_BITS = 24


def _ngrams(w: Column) -> Column:
    """Buckets of all word unigrams and bigrams."""
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    both = F.transform(
        F.array(hashed),
        lambda h: F.concat(
            F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")),
            F.zip_with(
                F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))),
                F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))),
                lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"),
            ),
        ),
    )
    return F.element_at(both, 1)


def _beside_equal(s: Column, of) -> Column:
    """Elements of a sorted array that equal the one before or after under `of`."""
    return F.filter(
        s,
        lambda x, i: ((i > 0) & (of(F.get(s, i - 1)) == of(x))) | ((i < F.size(s) - 1) & (of(F.get(s, i + 1)) == of(x))),
    )


def base_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, the words, and the counts of the base rules.

    Words in repeated three-word windows are found in two steps: hashes of windows with their position in the low
    bits are sorted, which leaves as candidates the windows next to one of the same hash prefix; candidates are then
    compared by their words.
    """
    w, low = F.col("w"), (1 << _POSITION_BITS) - 1
    windows = F.transform(
        F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")),
    )
    near = _beside_equal(F.col("s"), lambda x: F.shiftright(x, _POSITION_BITS))
    spelled = F.transform(
        F.col("near"),
        lambda x: F.transform(F.array(x.bitwiseAND(F.lit(low)).cast("int")), lambda p: F.struct(F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("k"), p.alias("p")))[0],
    )
    again = _beside_equal(F.col("g"), lambda x: x["k"])
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))
    text = F.col("__text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.select("doc_id", text_of().alias("__text"))
        .withColumn("w", words(text))
        .withColumn("lines", lines)
        .withColumn("s", F.sort_array(windows))
        .withColumn("near", near)
        .withColumn("g", F.sort_array(spelled))
        .select(
            "doc_id",
            "w",
            F.size("w").cast("long").alias("n_words"),
            F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.when(F.size("near") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        )
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def llr_table(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, llr) for every bucket that occurs. trusted: the doc_id of trusted documents."""
    ids = trusted.select("doc_id").filter("doc_id is not null").distinct().withColumn("__trusted", F.lit(1))
    flagged = left_join_checked(docs.select("doc_id", "text"), ids, "doc_id", BROADCAST_IDS)
    grams = flagged.select("__trusted", words(text_of()).alias("w")).select("__trusted", F.explode(_ngrams(F.col("w"))).alias("bucket"))
    counts = settle(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("__trusted").alias("target")))
    total = counts.agg(F.sum("raw"), F.sum("target")).first()
    raw, target = total[0] or 0, total[1] or 0
    if not target:
        return counts.select("bucket", F.lit(0.0).alias("llr"))
    of = lambda n, all_: (F.col(n) + SMOOTHING) / F.lit(float(all_ + SMOOTHING * BUCKETS))
    return counts.select("bucket", F.log(of("target", target) / of("raw", raw)).alias("llr"))


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score for each row.

    The score is null where the base rules fail. The table of ratios has at most BUCKETS rows and is broadcast.
    """
    return _verdicts(docs, llr_table(docs, trusted), threshold)


def _verdicts(docs: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    keys = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    grams = F.when(F.col("base_failed"), F.array().cast("array<int>")).otherwise(_ngrams(F.col("w")))
    each = base_metrics(docs).select(F.monotonically_increasing_id().alias("row"), *keys, grams.alias("grams")).select("row", *keys, F.explode_outer("grams").alias("bucket"))
    return (
        each.join(F.broadcast(table), "bucket", "left")
        .groupBy("row", *keys)
        .agg(F.round(F.sum("llr") / F.count("bucket"), 9).alias("score"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
        .select(*keys, "kept", "score")
    )


def passing(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. Rejected rows are few beside the kept, and
    a row is known by its doc_id and a hash of its text."""
    keyed = docs.select(F.struct("doc_id", text_key(text_of()).alias("key")).alias("doc_id"), "text")
    verdict = _verdicts(keyed, llr_table(docs, trusted), threshold)
    failed = verdict.filter("not kept").select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.key").alias("__key")).distinct()
    rows = boxed(docs, F.col("doc_id").alias("own"), text_key(text_of()).alias("own_key"))
    return rows.join(failed, F.col("own").eqNullSafe(F.col("__id")) & (F.col("own_key") == F.col("__key")), "left_anti").select("row.*")
