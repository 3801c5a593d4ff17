"""What the training-data operators share: words, row keys, lineage cuts, connected components."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words; everything else belongs to one.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order, repeats included."""
    return F.filter(F.split(text, GAP), lambda w: w != F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def text_key(text: Column) -> Column:
    """With doc_id it names a document: rows alike in both are one document."""
    return F.xxhash64(text)


def boxed(docs: DataFrame, *beside: Column | str) -> DataFrame:
    """Rows of docs whole in a struct, so that names beside it can't clash with theirs; select("row.*") gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *beside)


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, local mode takes one of its own; a cluster can't."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lotlens-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def settle(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cut a lineage: compressed Parquet in the shared folder, removed when the session ends.

    Unlike a checkpointed frame, the table read back carries no constraints of its past, which in a loop grow
    with every turn.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lotlens-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    atexit.register(_remove, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back.settled_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove settled tables that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df.settled_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended before; the folder is scratch space
        return


def small_or_none(df: DataFrame, rows: int) -> DataFrame | None:
    """The table with a broadcast hint if it has at most that many rows, else nothing."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else None


def left_join_checked(left: DataFrame, right: DataFrame, on: str, rows: int) -> DataFrame:
    """A left join that broadcasts the right side only when a count has shown it to be small; beyond, it shuffles."""
    return left.join(small_or_none(right, rows) or right, on, "left")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): a row (node, root) for every node, root being the smallest in reach.

    Alternating large-star and small-star steps: every step replaces the edges of a node by edges to the
    smallest node it knows, until nothing changes. All steps are aggregates and joins on the edge table; the
    driver only compares two numbers a round.
    """
    now = settle(_pointing_down(edges.select("u", "v")))
    seen = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        seen = sign
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _pointing_down(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, settle(_pointing_down(small.union(least.select("u", F.col("m").alias("v")))))
        discard(before)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _pointing_down(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def choices(n: int, k: int) -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(n), k))
