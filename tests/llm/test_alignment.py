"""Alignment of two tokenizers against plain Python over their own tokens."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from lotlens.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    slow = Tokenizer.from_file(A)
    slow.encode_special_tokens = True
    names = {i: t for t, i in slow.get_vocab(with_added_tokens=False).items()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    of = al._byte_of()
    told = []
    for doc_id, text in rows:
        a = slow.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        ab = [bytes(of[c] for c in names[i]) for i in a]
        bb = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            told.append((doc_id, [], [], [], []))
            continue
        ends = lambda v: [sum(map(len, v[: k + 1])) for k in range(len(v))] if len(v) < 500 else __import__("itertools").accumulate(map(len, v))
        ea, eb = list(ends(ab)), list(ends(bb))
        common = sorted(set(ea) & set(eb))
        pa, pb = {e: k for k, e in enumerate(ea)}, {e: k for k, e in enumerate(eb)}
        groups, x, y = [], 0, 0
        for e in common:
            groups.append((a[x : pa[e] + 1], b[y : pb[e] + 1]))
            x, y = pa[e] + 1, pb[e] + 1
        told.append((doc_id, a, b, groups, [(a[pa[e]], b[pb[e]]) for e in common]))
    count = Counter(p for *_, links in told for p in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    join = lambda v: ",".join(map(str, v))
    return sorted(
        (str(d), len(a), len(b), len(g), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(f"{join(x)}|{join(y)}" for x, y in g).encode()).hexdigest() if a else "")
        for d, a, b, g, links in told
    )


def found(docs):
    out = al.alignment_digest(docs, A, B)
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect())


ODD = [
    "a", " ", "  two  spaces ", "\n\n\t tabs\r\n", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ looks like a space", "naïve café Straße", "日本語のテキスト", "😀 emoji 👩‍👩‍👧", "\0 nul \x7f", "ﬁ ligature ½ ①",
    "é combining", "it's we'll they've I'm", "123456 7.89", "a" * 300, "١٢٣ ४५६ ", "​﻿ zero width", "don't<|endoftext|>don't", "x y z",
]


def test_against_plain_python(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()] + [(1000 + k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame([(d, t, d, t) for d, t in rows], "doc_id long, text string, links long, cuts string")
    assert found(docs) == plain(rows)


def test_pairs_beyond_the_broadcast(spark, monkeypatch, odd_docs):
    monkeypatch.setattr(al, "BROADCAST_PAIRS", 0)
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert found(odd_docs) == plain(rows)


def test_none(spark, no_docs):
    assert found(no_docs) == []
    assert found(spark.createDataFrame([(None, None), (1, ""), (2, "▁")], "doc_id long, text string")) == [("1", 0, 0, 0, 0, 0, 0, ""), ("2", 0, 0, 0, 0, 0, 0, ""), ("None", 0, 0, 0, 0, 0, 0, "")]


def test_very_long_texts(spark):
    rng = random.Random(2)
    rows = [(1, " ".join(rng.choice(["alpha", "beta", "gammadelta", "x1", "\n"]) for _ in range(200_000))), (2, "z" * 100_000), (3, " " * 30_000 + "a"), (4, "\n" * 5_000)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_both_readers_of_the_pattern_split_alike():
    reader = al.Readers(A, B)
    assert reader.fast is not None
    rng = random.Random(1)
    stable = [chr(c) for c in range(0x250)]
    texts = ["".join(rng.choice(stable) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    with open(A, encoding="utf-8") as f:
        of = al._byte_of()
        raw = [bytes(of[c] for c in t) for t in json.load(f)["model"]["vocab"]]
    texts += [t for t in (b.decode("utf-8", "ignore") for b in raw) if al.STABLE.fullmatch(t)]
    assert reader.apart
    odd = [chr(c) for c in (9, 10, 11, 12, 13, 28, 31, 32, 32, 32, 0x85, 0xA0, 0x1680, 0x180E, 0x2003, 0x2028, 0x200B, 0x3000, 0x41, 0x61, 0x27, 0x73, 0x31, 0x2E, 0x2581, 0xE9, 0x4E2D)]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    for t, a, b in zip(texts, *reader.read(texts), strict=True):
        whole_a, whole_b = reader.slow.encode(" " + t, add_special_tokens=False).ids, reader.b.encode(t)
        if len(a):
            assert a.tolist() == whole_a and b.tolist() == whole_b
        else:
            assert b"".join(reader.b_bytes[i] for i in whole_b) != (" " + t).encode()
    for t in filter(al.STABLE.fullmatch, texts):
        assert reader.fast.encode_ordinary(" " + t) == reader.slow.encode(" " + t, add_special_tokens=False).ids


def test_cuts_come_with_the_tokens(spark, odd_docs):
    """Every cut is where both end, in each text by itself though texts are laid end to end; groups and links follow from them."""
    rows = al.tokens(odd_docs, A, B)
    assert rows.columns == ["doc_id", "a_ids", "a_ends", "b_ids", "b_ends", "cuts"]
    for r in rows.withColumn("groups", al.groups()).withColumn("links", al.links()).collect():
        common = sorted(set(r.a_ends) & set(r.b_ends))
        assert [(r.a_ends[(c >> 32) - 1], r.b_ends[(c & 0xFFFFFFFF) - 1]) for c in r.cuts] == [(e, e) for e in common]
        assert [i for g in r.groups for i in g.a] == r.a_ids and [i for g in r.groups for i in g.b] == r.b_ids
        assert r.links == [g.a[-1] << 32 | g.b[-1] for g in r.groups]
