import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from test_line_dedup import brute as brute_lines
from test_line_dedup import d_key, norm
from test_packing import ids_of
from test_quality_rules import WORD, brute
from test_simhash import fingerprint, reach

from lotlens.llm import mixing, quality_rules


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before it kept, over the whole smallest table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = {r.doc_id for r in spark.read.parquet(str(tmp_path / "labels.parquet")).filter("quality = 1").collect()}
    stage = {n: (lambda d, f=f: f(spark, d, str(tmp_path))) for n, f in corpus_pipeline.STAGES}

    kept = stage["quality_rules"](docs).cache()
    want = {r[0] for r in brute(rows, good, quality_rules.THRESHOLD) if r[-2]}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns

    lined = stage["line_dedup"](kept).cache()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    places, roots = brute_lines(rows)
    groups = defaultdict(list)
    for p in places:
        groups[roots[p[-1]]].append(p)
    stay = {min((p[1], d_key(spark, p[2]), p[3]) for p in g) for g in groups.values()}
    want = {}
    for i, t in rows:
        left = [x for k, x in enumerate(t.split("\n")) if not norm(x) or (i, d_key(spark, t), k) in stay]
        if WORD.search("\n".join(left)):
            want[i] = "\n".join(left)
    assert {r.doc_id: r.text for r in lined.collect()} == want and lined.columns == docs.columns

    single = stage["simhash"](lined).cache()
    prints = {r.doc_id: fingerprint(r.text) for r in lined.collect()}
    root = reach(prints.values())
    least = {}
    for i, f in prints.items():
        least[root[f]] = min(i, least.get(root[f], i))
    assert sorted(r.doc_id for r in single.collect()) == sorted(least.values()) and single.columns == docs.columns

    mixed = stage["mixing"](single).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(single).select("doc_id", "mix.copies").collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n}) and mixed.columns == docs.columns

    packed = stage["packing"](mixed).collect()
    texts = Counter(r.text for r in mixed.collect())
    assert sum(r.length for r in packed) == sum(n * len(ids_of(t)) for t, n in texts.items())
    ids = {r.doc_id: ids_of(r.text) for r in mixed.collect()}
    import numpy as np

    assert all(zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32 for r in packed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
