"""Fuzzy line deduplication by MinHash: of every component of near-equal lines one line of the corpus stays.

The shingles of a line are all its runs of CHARS characters, wherever they begin (a shorter line is its own single
shingle, so that it has exact repeats only). A line's signature is its smallest different shingle hashes (bottom-k
MinHash) and its bands are the triples of them, so that lines of Jaccard similarity 0.8 meet in one with a
probability of 0.98. Lines that meet are compared exactly, by the Jaccard similarity of all their shingles, and
verified links are joined to components by distributed union-find.

Each band is first linked through one representative. What that leaves in different components is compared again:
pair by pair in bands of up to PAIRED lines, and in larger ones by an exact search among the lines of all bands of one
head, by what each differs in from it (crowds.py). Everything is built from DataFrame functions.

Lines are compared in lower case with white space collapsed. Of a component the occurrence with the smallest
(doc_id, text hash, line number) stays, null ids last.

Defined results: a line without a word always stays, and so does one of fewer than min_chars characters (none by
default); a null text has no lines and comes back as it was, an empty one has a line without a word; texts may be of
any length; of lines that are alike the first stays, within a document as well; rows alike in doc_id and text are one
document, and lose the same lines; an empty table gives an empty one; columns of the input are kept as they are,
whatever their names, but for text and the two counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import GAP, choices, components, discard, left_join_checked, once, settle, small_or_none, text_key, text_of
from lotlens.llm.crowds import linked_apart

SIMILARITY, CHARS = 0.8, 9
#: Hashes in a signature, and how many of them make a band.
SIGNATURE, ROWS = 5, 3
#: Bands of up to this many lines are compared in pairs.
PAIRED = 40
#: Tables of line hashes up to this number are broadcast; larger ones are joined by a shuffle.
BROADCAST_LINES = 500_000
#: Shingles whose sets are broadcast to the pairs, at most.
BROADCAST_SHINGLES = 8_000_000
#: Pairs that one task compares.
PAIRS_A_TASK = 20_000


def normal(line: Column) -> Column:
    """Lower case, white space collapsed; the pattern is tried only on lines that hold what it would change."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.trim(F.lower(F.when(odd, F.regexp_replace(line, GAP, " ")).otherwise(line)))


def all_shingles(norm: Column) -> Column:
    """Hashes of the shingles of a line in order, repeats included. In UTF-32 the place of a character is known."""
    size = 4 * CHARS
    return once(
        F.encode(norm, "UTF-32"),
        lambda b: F.when(F.octet_length(b) <= size, F.array(F.xxhash64(b))).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(b) - size + 1, F.lit(1)), F.lit(4)), lambda i: F.xxhash64(F.substring(b, i, F.lit(size))))
        ),
    )


def shingles(norm: Column) -> Column:
    """Hashes of the different shingles of a line."""
    return F.array_distinct(all_shingles(norm))


def signed(rows: DataFrame) -> DataFrame:
    """rows with sig, the smallest different shingle hashes of norm; the whole list is searched for repeats only where its
    beginning repeats. The list is sorted in a column of its own: within a lambda Spark sorts boxed values.
    """
    some = 4 * SIGNATURE
    rows = rows.withColumn("sorted", F.sort_array(all_shingles(F.col("norm")))).withColumn("first", F.array_distinct(F.slice("sorted", 1, some)))
    whole = (F.size("first") >= SIGNATURE) | (F.size("sorted") <= some)
    return rows.withColumn("sig", F.slice(F.when(whole, F.col("first")).otherwise(F.array_distinct("sorted")), 1, SIGNATURE)).drop("sorted", "first")


def lines_of(docs: DataFrame, min_chars: int = 0) -> DataFrame:
    """(doc_id, key, line, hash, norm, s0..) for every line that takes part: its place, text and signature."""
    rows = docs.select("doc_id", text_of().alias("text"))
    each = rows.select("doc_id", text_key(F.col("text")).alias("key"), F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    each = each.select("doc_id", "key", "line", normal(F.col("raw")).alias("norm")).filter(F.length("norm") >= max(min_chars, 1))
    return signed(each).select("doc_id", "key", "line", F.xxhash64("norm").alias("hash"), "norm", *[F.get("sig", F.lit(k)).alias(f"s{k}") for k in range(SIGNATURE)])


def meetings(occurrences: DataFrame) -> DataFrame:
    """(hash, band, n, head) of bands that n > 1 different lines share; head is one of these lines."""
    lines = settle(occurrences.select("hash", *[f"s{k}" for k in range(SIGNATURE)]).distinct())
    # A line of few shingles has no bands but those of its own hashes, the first one always.
    of = [F.when(F.lit(some == tuple(range(ROWS))) | F.col(f"s{some[-1]}").isNotNull(), F.xxhash64(*[f"s{k}" for k in some])) for some in choices(SIGNATURE, ROWS)]
    members = lines.select("hash", F.explode(F.array_distinct(F.array_compact(F.array(*of)))).alias("band"))
    shared = settle(members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"))
    met = settle(members.join(small_or_none(shared, BROADCAST_LINES) or shared, "band"))
    # One head in all bands of a group spares comparisons. In large ones it is the line that most lines meet: of copies that
    # differ from each other, what they were made from.
    central = met.filter(f"n > {PAIRED}").groupBy("hash").agg(F.sum("n").alias("central"))
    heads = left_join_checked(met, central, "hash", BROADCAST_LINES).groupBy("band").agg(F.max_by("hash", F.struct("central", F.xxhash64("hash"))).alias("any"), F.min("hash").alias("least"))
    heads = settle(heads)
    out = settle(met.join(small_or_none(heads, BROADCAST_LINES) or heads, "band").select("hash", "band", "n", F.when(F.col("n") > PAIRED, F.col("any")).otherwise(F.col("least")).alias("head")))
    discard(lines, shared, met, heads)
    return out


def texts_of(met: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(hash, norm, size) of the lines that meet others; size counts different shingles."""
    ids = settle(met.select("hash").distinct())
    found = occurrences.select("hash", "norm").join(small_or_none(ids, BROADCAST_LINES) or ids, "hash").dropDuplicates(["hash"])
    out = settle(found.select("hash", "norm", F.size(shingles(F.col("norm"))).alias("size")))
    discard(ids)
    return out


def _sizes(a: str, b: str) -> Column:
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose lines reach the similarity, by exact comparison of all shingles.

    Where the lines of the pairs have few shingles together, their sets are made once and broadcast; beyond, texts
    are joined to the pairs and sets made for each.
    """
    ids = settle(pairs.select(F.explode(F.array("u", "v")).alias("hash")).distinct())
    known = texts.join(small_or_none(ids, BROADCAST_LINES) or ids, "hash")
    few = (known.agg(F.sum("size")).first()[0] or 0) <= BROADCAST_SHINGLES
    held = settle(known.select("hash", "size", shingles(F.col("norm")).alias("own") if few else F.col("norm").alias("own")))
    u, v = (held.select(F.col("hash").alias(key), F.col("own").alias(own), F.col("size").alias(n)) for key, own, n in (("u", "a", "na"), ("v", "b", "nb")))
    # A pair is few bytes and much work, so their bytes don't say how many tasks they need.
    pairs = pairs.repartition(pairs.count() // PAIRS_A_TASK + 1, "u", "v")
    both = pairs.join(F.broadcast(u) if few else u, "u").join(F.broadcast(v) if few else v, "v").filter(_sizes("na", "nb"))
    of = (lambda c: F.col(c)) if few else (lambda c: all_shingles(F.col(c)))
    shared = F.size(F.array_intersect(of("a"), of("b")))
    return both.select("u", "v", "na", "nb", shared.alias("shared")).filter(F.col("shared") >= SIMILARITY * (F.col("na") + F.col("nb") - F.col("shared"))).select("u", "v")


def _pair(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def pairs_apart(met: DataFrame) -> DataFrame:
    """Pairs (u, v) of the bands of up to PAIRED lines, that are in different components. met: with root."""
    a = met.filter(f"n <= {PAIRED}").select("band", F.col("hash").alias("a"), F.col("root").alias("ra"))
    # Only bands of several components have any.
    some = a.groupBy("band").agg(F.min("ra").alias("low"), F.max("ra").alias("high")).filter("low < high").select("band")
    a = settle(a.join(some, "band", "left_semi"))
    b = a.select("band", F.col("a").alias("b"), F.col("ra").alias("rb"))
    return a.join(b, "band").filter("a > b and ra <> rb").select(*_pair("a", "b")).distinct()


def crowd_apart(met: DataFrame, texts: DataFrame) -> DataFrame:
    """Linked pairs (u, v) of lines in different components that larger bands of one head hold; they join all that are. met: with root."""
    member = settle(met.filter(f"n > {PAIRED}").groupBy("head", F.col("hash").alias("id")).agg(F.first("root").alias("root")))
    open_heads = member.groupBy("head").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("head")
    some = settle(member.join(open_heads, "head", "left_semi"))
    # The head is a member itself.
    ids = settle(some.select(F.col("id").alias("hash")).distinct())
    sets = settle(texts.join(small_or_none(ids, BROADCAST_LINES) or ids, "hash").select(F.col("hash").alias("id"), shingles(F.col("norm")).alias("own")))
    out = linked_apart(some, sets, round(100 * SIMILARITY))
    discard(member, some, ids, sets)
    return out


def joined(occurrences: DataFrame) -> DataFrame:
    """(hash, root) of the lines that have near-equal ones."""
    met = meetings(occurrences)
    return _joined(met, texts_of(met, occurrences))


def _joined(met: DataFrame, texts: DataFrame) -> DataFrame:
    stars = settle(met.filter("hash <> head").select(*_pair("hash", "head")).distinct())
    links = settle(verified(stars, texts))
    roots = settle(components(links).select(F.col("node").alias("hash"), "root"))
    rooted = settle(left_join_checked(met, roots, "hash", BROADCAST_LINES).withColumn("root", F.coalesce("root", "hash")))
    rest = settle(pairs_apart(rooted))
    more = settle(verified(rest, texts))
    if not rooted.filter(f"n > {PAIRED}").isEmpty():
        before, more = more, settle(more.union(crowd_apart(rooted, texts)).distinct())
        discard(before)
    if not more.isEmpty():
        known = roots.select(F.col("hash").alias("u"), F.col("root").alias("v"))
        before, roots = roots, settle(components(known.union(more)).select(F.col("node").alias("hash"), "root"))
        discard(before)
    discard(met, texts, stars, links, rooted, rest, more)
    return roots


def repeated_lines(docs: DataFrame, min_chars: int = 0) -> DataFrame:
    """(doc_id, key, lines): the numbers (from 0) of the lines that each document loses."""
    whole = settle(lines_of(docs, min_chars))
    met = meetings(whole)
    texts = texts_of(met, whole)
    # Texts and signatures of all lines aren't needed beyond this, and are most of what lies on disk.
    occurrences = settle(whole.select("doc_id", "key", "line", "hash"))
    discard(whole)
    roots = _joined(met, texts)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "line")
    grouped = left_join_checked(occurrences, roots, "hash", BROADCAST_LINES).select(
        "doc_id", "key", "line", F.coalesce("root", "hash").alias("group")
    )
    # Written, so that the join below is one of plain exchanges, which Spark can split where one line is very common.
    first = settle(grouped.groupBy("group").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n"))
    gone = grouped.join(small_or_none(first, BROADCAST_LINES) or first, "group").filter(place != F.col("first"))
    out = settle(gone.groupBy("doc_id", "key").agg(F.collect_set("line").alias("lines")))
    discard(occurrences, roots, first)
    return out


def line_dedup(docs: DataFrame, n_lines: str = "n_lines", n_removed: str = "n_removed", min_chars: int = 0) -> DataFrame:
    """docs with repeated lines taken out of the text, and the counts of lines before and of lines taken out.

    Input columns of these two names are replaced.
    """
    names = [c for c in docs.columns if c not in (n_lines, n_removed)]
    gone = repeated_lines(docs.select("doc_id", "text"), min_chars).select(F.col("doc_id").alias("id"), F.col("key").alias("id_key"), F.col("lines").alias("gone"))
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").alias("own"), text_key(text_of()).alias("own_key"), F.col("text").alias("old"))
    rows = rows.join(small_or_none(gone, BROADCAST_LINES) or gone, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("id_key")), "left")
    left = once(
        F.split("old", "\n"),
        lambda v: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(v) - 1), F.col("gone")), lambda k: F.get(v, k)), "\n"),
    )
    text = F.when(F.col("gone").isNull(), F.col("old")).otherwise(left)
    return rows.select(
        *[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names],
        F.when(F.col("old").isNull(), 0).otherwise(F.size(F.split("old", "\n"))).cast("long").alias(n_lines),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(n_removed),
    )


def deduplicated(docs: DataFrame, min_chars: int = 0) -> DataFrame:
    """docs without the repeated lines; a document goes if it had words and none are left."""
    lines, removed = (next(n for k in range(len(docs.columns) + 1) if (n := f"{name}{k}") not in docs.columns) for name in ("lines", "removed"))
    out = line_dedup(docs, lines, removed, min_chars)
    return out.filter((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
