"""Stages that keep documents whole keep columns whatever they are called."""

import pytest
from pyspark.sql import functions as F

from lotlens.llm import mixing, quality_rules, simhash

NAMES = ["row", "own", "own_key", "key", "fp", "mix", "copy", "__text_key", "__size", "__h", "__id", "__key", "a.b"]


@pytest.mark.parametrize("stage", [lambda d: quality_rules.passing(d, d.select("doc_id")), simhash.one_of_each, mixing.mixed])
def test_columns_stay(odd_docs, stage):
    plain = odd_docs.filter("doc_id between 20 and 60")
    docs = plain.withColumns({name: F.concat(F.lit(f"{k} "), "doc_id") for k, name in enumerate(NAMES)})
    got = stage(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[name] == f"{k} {r.doc_id}" for r in rows for k, name in enumerate(NAMES))
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stage(plain).collect())
