"""Token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie over bytes. A node that cannot be followed by the next byte fails over to the
node of what is left after the longest pieces of its string have been popped; how many those are is computed with
the failure links. A word, with the space before it, is run through once, byte by byte, and its greedy
longest-match pieces are counted without being built.

Defined results: a null or empty text has no words and no tokens; every byte must be a piece, so that every text
can be counted; rows alike get the same counts.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lotlens.llm.common import GAP, text_of

#: Words whose counts a worker remembers.
REMEMBERED = 500_000
_GAP = re.compile(GAP)


class Automaton:
    """next: state and byte to state; fail: where a state goes when no byte fits; pops: pieces counted on the way."""

    def __init__(self, pieces: Iterable[bytes]):
        self.next: dict[int, int] = {}
        ends, parent, byte = [False], [0], [0]
        for piece in pieces:
            at = 0
            for c in piece:
                to = self.next.get(at << 8 | c)
                if to is None:
                    to = self.next[at << 8 | c] = len(ends)
                    ends.append(False)
                    parent.append(at)
                    byte.append(c)
                at = to
            ends[at] = True
        missing = [c for c in range(256) if c not in self.next or not ends[self.next[c]]]
        if missing:
            raise ValueError(f"{len(missing)} bytes are no pieces")
        depth = [0] * len(ends)
        for v in range(1, len(ends)):  # a parent is older than its children
            depth[v] = depth[parent[v]] + 1
        self.fail, self.pops = [0] * len(ends), [0] * len(ends)
        for v in sorted(range(1, len(ends)), key=depth.__getitem__):
            if ends[v]:
                self.pops[v] = 1
                continue
            z, n = self.fail[parent[v]], self.pops[parent[v]]
            while z << 8 | byte[v] not in self.next:
                n += self.pops[z]
                z = self.fail[z]
            self.fail[v], self.pops[v] = self.next[z << 8 | byte[v]], n
        self.known: dict[str, int] = {}

    def count(self, raw: bytes) -> int:
        """Pieces of the greedy longest match of one word."""
        at, n, follow, fail, pops = 0, 0, self.next, self.fail, self.pops
        for c in raw:
            to = follow.get(at << 8 | c)
            while to is None:
                n += pops[at]
                at = fail[at]
                to = follow.get(at << 8 | c)
            at = to
        while at:
            n += pops[at]
            at = fail[at]
        return n

    def counts(self, text: str) -> tuple[int, int]:
        """Words and pieces of a text."""
        words = [w for w in _GAP.split(text) if w]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.count(b" " + w.encode("utf-8", "surrogatepass"))
        return len(words), sum(map(known.__getitem__, words))


def rank_file_pieces(path: str) -> list[bytes]:
    """The pieces of a file with a base64 piece and a rank on each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


_automata: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The automaton of this worker process."""
    if path not in _automata:
        _automata[path] = Automaton(rank_file_pieces(path))
    return _automata[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of docs (doc_id, text). vocabulary: a rank file every executor has."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = automaton(vocabulary)
        for batch in batches:
            found = [own.counts(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_words": [f[0] for f in found], "n_tokens": [f[1] for f in found]})

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(part, "doc_id long, n_words long, n_tokens long")


