import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lotlens.llm import packing as p
from lotlens.llm.tokens import PartEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    want = {(r.doc_id, r.text): np.array(ids_of(r.text), dtype="<u4") for r in rows}
    got = p.pieces(docs, PATH).collect()
    bins, seen = defaultdict(list), Counter()
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        fits = [k for k, v in want.items() if k[0] == r.doc_id and len(v) == r.doc_tokens and zlib.crc32(v[r.start : r.start + r.length].tobytes()) == r.ids_crc32]
        assert fits, r
        seen[(r.doc_id, r.doc_tokens)] += r.length
    copies = Counter((r.doc_id, len(want[(r.doc_id, r.text)])) for r in rows)
    assert seen == {k: n * k[1] for k, n in copies.items()}
    assert sorted(bins) == list(range(len(bins)))
    for s, pieces in bins.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == p.SEQUENCE or s == len(bins) - 1 and at < p.SEQUENCE


def test_round_trip(odd_docs):
    check(odd_docs.withColumn("key", F.lit("mine")).withColumn("row", F.lit(1)))


@pytest.mark.parametrize("limit", [0, 10**6])
def test_one_text_many_times(spark, monkeypatch, limit):
    monkeypatch.setattr(p, "BROADCAST_ROWS", limit)
    rows = [(k, "the same words again and again") for k in range(2500)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))


def test_sequences(odd_docs, no_docs):
    out = p.sequences(odd_docs, PATH).collect()
    assert all(len(r.input_ids) == 4 * r.length for r in out)
    joined = np.concatenate([np.frombuffer(bytes(r.input_ids), dtype="<u4") for r in sorted(out, key=lambda r: r.sequence_id)])
    want = Counter(i for r in odd_docs.collect() for i in ids_of(r.text))
    assert Counter(joined.tolist()) == want
    assert p.pieces(no_docs, PATH).count() == 0


def test_parts_encode_as_texts(odd_docs):
    texts = [r.text or "" for r in odd_docs.collect()]
    texts += ["It's a <|endoftext|> b <|x|> we'll 3.14 x y é İstanbul ﬁ \x1c z àÉ ab­ ½² 'S 'Ll !!?", "ΑΣ x Σ", "w" * 500, "rock'n'roll it's IT'S !'s ''s _a_b 1_2 a1b22 x<|y", "Ünï ÄÖÜ ß × ÷", "a\x0bb\x0cc\x1dd"]
    own = PartEncoder(PATH)
    for _ in range(2):
        assert [np.frombuffer(b, dtype="<u2").tolist() for b in own.encode(texts)] == [ids_of(t)[:-1] for t in texts]


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_visits_neighbours(n, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), -1).reshape(-1, n)
    key = p.hilbert_key(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
