"""The registered queries of the training-data operators, each a thin layer over its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lotlens.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lotlens.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lotlens.llm.search import top_k

    asked = table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0")
    return top_k(table(spark, sf_dir, "documents"), asked, 10, "item_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lotlens.llm.mixing import mix

    rows = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    m = F.col("mix")
    return rows.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["size"] * m["copies"]).alias("taken"), m["rate"].alias("rate"), m["copies"].alias("copies"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lotlens.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lotlens.llm.simhash import hex16, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lotlens.llm.packing import pieces

    return pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def _held_out(folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lotlens.llm.quality_classifier import quality_classifier

    labels = table(spark, sf_dir, "labels").filter(~_held_out(5, 0))
    found = quality_classifier(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return found.select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lotlens.llm.toxicity import toxicity

    labels = table(spark, sf_dir, "labels").filter(~_held_out(3, 1))
    found = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return found.select("doc_id", _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lotlens.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lotlens.llm.alignment import alignment_digest

    return alignment_digest(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lotlens.llm.minhash import minhash_dedup

    return minhash_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lotlens.llm.clustering import cluster_digest

    return cluster_digest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_search": op3_search,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_license_scan": op7_license_scan,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_minhash": op12_minhash,
    "op13_clustering": op13_clustering,
    "pipeline": pipeline,
}


def _clustering_sql(rounds: int = 10) -> str:
    """The rounds of exact k-means, one after another."""
    distance = "list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    sql = """WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS k, p AS c FROM kept ORDER BY k LIMIT 8)"""
    for i in range(rounds + 1):
        sql += f""",
a{i} AS MATERIALIZED (SELECT vec_id, p, k, {distance} AS d FROM kept, c{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"""
        if i < rounds:
            sql += f""",
m{i} AS (SELECT k, list(m ORDER BY j) AS c FROM (SELECT k, j, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (SELECT k, unnest(p) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY k, j) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))"""
    return sql + f""" SELECT vec_id, CAST(k AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"""


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Hashing, tokens, iteration and compression keep the other operators out of SQL; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op12_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v),
m AS (SELECT u, min(v) AS v FROM r GROUP BY u)
SELECT doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m.v, doc_id)) AS component_id, doc_id <= coalesce(m.v, doc_id) AS kept FROM s LEFT JOIN m ON m.u = doc_id""",
    "op13_clustering": _clustering_sql(),
}
