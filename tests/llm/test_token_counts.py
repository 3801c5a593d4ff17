import random
import re

import public_tokenizers
from pyspark.sql import functions as F

from lotlens.llm import token_counts as t

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def greedy(word, pieces, longest):
    n, at = 0, 0
    while at < len(word):
        size = next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces)
        at += size
        n += 1
    return n


def test_small_vocabularies():
    rng = random.Random(0)
    for _ in range(40):
        pieces = {bytes([c]) for c in range(256)} | {bytes(rng.choice(b"abc ") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(0, 60))}
        own = t.Automaton(sorted(pieces))
        for _ in range(100):
            word = bytes(rng.choice(b"abcd ") for _ in range(rng.randint(0, 30)))
            assert own.count(word) == greedy(word, pieces, 7)


def test_against_brute_force(odd_docs, no_docs):
    pieces = set(t.rank_file_pieces(PATH))
    longest = max(map(len, pieces))
    want = []
    for r in odd_docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        want.append((r.doc_id or -1, len(words), sum(greedy(b" " + w.encode(), pieces, longest) for w in words)))
    got = t.token_counts(odd_docs.withColumn("n_words", F.lit(0)), PATH).collect()
    assert sorted((r[0] or -1, r[1], r[2]) for r in got) == sorted(want)
    assert t.token_counts(no_docs, PATH).count() == 0
