"""Alignment of two tokenizers: where their tokens of one text end together, which tokens meet there, and how often.

A task of Python turns each whole text into the ids and byte ends of its tokens by two public tokenizers, and, while
these are arrays, looks up where both end and, if asked, writes and hashes the groups' text. From there on everything is
built from Spark's functions: array_intersect of the two end arrays gives the ends of groups; zip_with and transform make
groups and links of the cuts; the counts of id pairs over the corpus are aggregates.

Tokenizer A reads space + text by a byte-level vocabulary, tokenizer B the text by a sentence-piece model that adds the
space itself. A text has tokens only where the joined bytes of both are those of space + text.

Defined results: a null or empty text has no tokens, and neither has one whose bytes a tokenizer changes; its arrays are
empty and its counts zero. Ties for a B id's commonest partner all count as best. Rows alike each have their row, and
each counts. Texts may be of any length: tokens, cuts and links take work in proportion to them, but for the search of ends in ends. An
empty table gives an empty one. Of the input only the id and the text are read, whatever other columns there are; a null
id is kept.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlens.llm.common import discard, left_join_checked, settle, small_or_none

#: How GPT-2's vocabulary splits a text before its merges; fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose classes all Unicode tables agree on; with them alone two readers of the pattern split alike.
STABLE = re.compile("[\0-ɏ]*")
#: Runs of white space that the faster reader is not given.
LONG_GAP = re.compile(r"\s{2000}")
#: Parts of a spaced text that B reads one by one: no token goes on from another character into a space, if no piece does.
PARTS = re.compile(" +[^ ]*")
#: Parts of up to this many characters are remembered with their ids, and so many of them by a worker.
SHORT, REMEMBERED = 48, 300_000
#: Bytes of text whose tokens are handed to Spark together.
HANDED = 1 << 20
#: Pairs of ids that are broadcast with their counts, at most.
BROADCAST_PAIRS = 1_000_000

_INTS, _LONGS = T.ArrayType(T.IntegerType(), False), T.ArrayType(T.LongType(), False)
_readers: dict[tuple[str, str], Readers] = {}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class Readers:
    """Both tokenizers of a worker process, with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(a_path)
        self.slow.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = _byte_of()
        ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if all(c in of for c in token)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # Merges by rank and merges by order are the same only if ids follow the order.
        ordered = all(model["vocab"][a + b] == 256 + k for k, (a, b) in enumerate(merges))
        self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if ordered else None
        self.a_bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any(re.search("[^▁]▁", p) for p in pieces)
        self.space = self.b.piece_to_id("▁")
        self.a_size, self.b_size = (np.array([len(x) for x in v], dtype=np.int64) for v in (self.a_bytes, self.b_bytes))
        self.known: dict[str, bytes | None] = {}
        # Every id as text with what follows it inside a group and at the end of its side: A's, then B's.
        written = [str(i) + end for n, ends in ((len(self.a_size), ",|"), (len(self.b_size), ",;")) for i in range(n) for end in ends]
        self.written = np.array([w.encode() for w in written], dtype=object)

    def a_ids(self, spaced: str) -> bytes | None:
        """Packed ids by A; nothing if their bytes are others."""
        stable = self.fast and STABLE.fullmatch(spaced) and not LONG_GAP.search(spaced)
        ids = self.fast.encode_ordinary(spaced) if stable else self.slow.encode(spaced, add_special_tokens=False).ids
        return np.array(ids, dtype=np.int32).tobytes() if b"".join([self.a_bytes[i] for i in ids]) == spaced.encode() else None

    def _learnt(self, parts: list[str]) -> dict[str, bytes | None]:
        """Packed ids by B of parts, each beginning with the space that B puts before a text."""
        out = {}
        for part, ids in zip(parts, self.b.encode([p[1:] for p in parts], num_threads=1), strict=True):
            ids = ids if len(part) > 1 else [self.space]
            out[part] = np.array(ids, dtype=np.int32).tobytes() if b"".join([self.b_bytes[i] for i in ids]) == part.encode() else None
        return out

    def read(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by A and by B of each text; none where either changes its bytes."""
        spaced = [" " + t if t else "" for t in texts]
        parts = [PARTS.findall(t) if self.apart else [t] * bool(t) for t in spaced]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list({p for v in parts for p in v}.difference(self.known))
        here = self._learnt(new)
        self.known.update((p, ids) for p, ids in here.items() if len(p) <= SHORT)
        find = lambda p: here[p] if p in here else self.known[p]
        out = ([], [])
        for text, v in zip(spaced, parts, strict=True):
            found = [find(p) for p in v]
            a = self.a_ids(text) if text and None not in found else None
            for side, ids in zip(out, (a, b"".join(found)) if a is not None else (b"", b""), strict=True):
                side.append(np.frombuffer(ids, dtype=np.int32))
        return out


def _upto(rows: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def _lists(values: np.ndarray, upto: np.ndarray, kind: pa.DataType) -> pa.Array:
    lists = pa.list_(pa.field("element", kind, nullable=False))
    return pa.Array.from_buffers(lists, len(upto) - 1, [None, pa.py_buffer(upto.astype(np.int32).tobytes())], children=[pa.array(values.astype(kind.to_pandas_dtype()))])


def _columns(reader: Readers, texts: list[str | None], digest: bool) -> list[pa.Array]:
    """The columns of tokens() but for the id, of some texts laid end to end: both readers' tokens of a text cover the same
    bytes, so that a text ends at one offset by either."""
    read = reader.read(texts)
    (a, b), (a_upto, b_upto) = (np.concatenate(rows) for rows in read), (_upto(rows) for rows in read)
    a_ends, b_ends = np.cumsum(reader.a_size[a]), np.cumsum(reader.b_size[b])
    own = lambda ends, upto: ends - np.repeat(np.concatenate([[0], ends])[upto[:-1]], np.diff(upto))
    # Places of the tokens that end together, and which text each is of.
    a_at = np.flatnonzero(np.isin(a_ends, b_ends, assume_unique=True)) if len(a) else np.empty(0, np.int64)
    b_at = np.searchsorted(b_ends, a_ends[a_at])
    text = np.searchsorted(a_upto, a_at, "right") - 1
    cuts = (a_at - a_upto[text] + 1 << 32) | (b_at - b_upto[text] + 1)
    cut_upto = np.searchsorted(a_at, a_upto)
    ints = pa.int32()
    columns = [_lists(a, a_upto, ints), _lists(own(a_ends, a_upto), a_upto, ints), _lists(b, b_upto, ints), _lists(own(b_ends, b_upto), b_upto, ints), _lists(cuts, cut_upto, pa.int64())]
    if digest:
        # Behind each group's A tokens come its B tokens; a token's place follows from the other side's tokens before it.
        a_last, b_last = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        a_last[a_at] = b_last[b_at] = 1
        line = np.empty(len(a) + len(b), dtype=np.int64)
        line[np.arange(len(a)) + np.concatenate([[0], b_at + 1])[np.cumsum(a_last) - a_last]] = 2 * a.astype(np.int64) + a_last
        line[np.arange(len(b)) + np.concatenate([a_at + 1, [0]])[np.cumsum(b_last) - b_last]] = 2 * (len(reader.a_size) + b.astype(np.int64)) + b_last
        places = (a_upto + b_upto).tolist()
        told = [hashlib.sha256(b"".join(reader.written[line[i:j]].tolist())[:-1]).hexdigest() if i < j else "" for i, j in zip(places, places[1:], strict=False)]
        columns.append(pa.array(told, pa.string()))
    return columns


def tokens(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text", digest: bool = False) -> DataFrame:
    """(id, a_ids, a_ends, b_ids, b_ends, cuts) of every row: token ids, the byte offsets in space + text where they end, and
    where both end: (A tokens up to there << 32 | B tokens up to there), in order.

    digest: also groups_sha256, the SHA-256 of the groups as `a1,a2|b1;a3|b2,b3`, empty where there are no tokens.
    """
    names = ["a_ids", "a_ends", "b_ids", "b_ends", "cuts", *["groups_sha256"] * digest]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _readers:
            _readers[a_path, b_path] = Readers(a_path, b_path)
        reader = _readers[a_path, b_path]
        for batch in batches:
            start, held, texts = 0, 0, []
            for k, text in enumerate(batch.column(1)):
                texts.append(text.as_py())
                held += len(texts[-1] or "")
                if held >= HANDED or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *_columns(reader, texts, digest)], names=["id", *names])
                    start, held, texts = k + 1, 0, []

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = T.StructType([rows.schema["id"], *[T.StructField(c, kind, False) for c, kind in zip(names, [*[_INTS] * 4, _LONGS, T.StringType()], strict=False)]])
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_column)


_PLACE = (1 << 31) - 1


def _a(c: Column) -> Column:
    return F.shiftright(c, 32).cast("int")


def _b(c: Column) -> Column:
    return c.bitwiseAND(F.lit(_PLACE)).cast("int")


def _before(at: str) -> Column:
    """The cut before each, the first of all being none."""
    return F.slice(F.concat(F.array(F.lit(0).cast("long")), F.col(at)), F.lit(1), F.size(at))


def aligned(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text", digest: bool = False) -> DataFrame:
    """tokens() with ends, the byte offsets that both have."""
    return tokens(docs, a_path, b_path, id_column, text_column, digest).withColumn("ends", F.array_intersect("a_ends", "b_ends"))


def _part(of: Column, side, c: Column, before: Column) -> Column:
    return F.slice(of, side(before) + 1, side(c) - side(before))


def groups(at: str = "cuts") -> Column:
    """The tokens between one cut and the next: an array of structs (a, b) of arrays of ids."""
    return F.zip_with(at, _before(at), lambda c, p: F.struct(_part(F.col("a_ids"), _a, c, p).alias("a"), _part(F.col("b_ids"), _b, c, p).alias("b")))


def links(at: str = "cuts") -> Column:
    """The A and B ids that end together, each pair as one number (A id << 32 | B id), in order."""
    return F.transform(at, lambda c: F.shiftleft(F.get("a_ids", _a(c) - 1).cast("long"), 32) + F.get("b_ids", _b(c) - 1))


def pair_counts(linked: DataFrame, column: str = "links") -> DataFrame:
    """(pair, count, best) of all links of a table: how often each pair of ids is linked, and whether no pair of its B
    id is linked more often."""
    counted = settle(linked.select(F.explode(column).alias("pair")).groupBy("pair").agg(F.count("*").alias("count")))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counted.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    out = settle(left_join_checked(counted.withColumn("b", b), most, "b", BROADCAST_PAIRS).select("pair", "count", (F.col("count") == F.col("most")).alias("best")))
    discard(counted)
    return out


def scored(linked: DataFrame, column: str = "links") -> DataFrame:
    """linked with n_best and count_sum: links that are their B id's commonest, and the counts of all links together.

    Pairs are counted within their row before they meet the counts of the corpus, so that a common pair is one row a text.
    """
    rows = settle(linked.withColumn("__row", F.monotonically_increasing_id()).withColumn(column, F.sort_array(column)))
    pairs = pair_counts(rows, column)
    each = rows.select("__row", F.explode(column).alias("pair"))
    small = small_or_none(pairs, BROADCAST_PAIRS)
    if small is None:
        each = each.groupBy("__row", "pair").agg(F.count("*").alias("n")).join(pairs, "pair")
    else:
        each = each.join(small, "pair").withColumn("n", F.lit(1).cast("long"))
    sums = each.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("n")).alias("count_sum"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "__row", "left").select(*[c for c in rows.columns if c != "__row"], none("n_best"), none("count_sum"))


def alignment_digest(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row a document: counts of tokens, groups and links, and a digest of the groups."""
    rows = aligned(docs, a_path, b_path, digest=True)
    count = lambda c: F.size(c).cast("long")
    digested = rows.select("doc_id", count("a_ids").alias("n_a"), count("b_ids").alias("n_b"), count("ends").alias("n_groups"), "groups_sha256", links().alias("links"))
    out = scored(digested)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "n_best", "count_sum", "groups_sha256")
