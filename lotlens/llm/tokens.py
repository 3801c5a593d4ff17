"""Token ids of whole texts by a public tokenizer, as packed 16-bit numbers."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import regex
from tokenizers import Tokenizer

#: Texts of these characters only (ASCII and Latin-1 letters) meet the normaliser with their case and white space
#: alone, so that they can be lower-cased as bytes and split before it.
PLAIN = bytes([*range(9, 14), *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
_LOWER = bytes(ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256 else c for c in range(256))
#: The parts that the tokenizer splits such a text in, none of which merge: letters, one digit, or other signs.
PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: White space that no tokenizer part crosses, for texts of other characters.
GAP = regex.compile(r"[\x20\x09-\x0D]+")
#: Words, in each of two generations, and parts that a worker remembers.
REMEMBERED = 600_000

_encoders: dict[str, PartEncoder] = {}


class PartEncoder:
    """Ids of a text from those of its words and of their parts, which are remembered."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        assert max(vocabulary.values()) < 1 << 16
        self.ends = np.zeros(1 << 16, dtype=np.int64)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = 1
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _each(self, some: list[str]) -> dict[str, bytes]:
        return {w: np.array(e.ids, dtype="<u2").tobytes() for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True)}

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of plain parts, a thousand at a time: the last id of a part is the only one that ends a word."""
        out = {}
        for i in range(0, len(parts), 1000):
            some = parts[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u2")
            cut = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cut) != len(some) or cut[-1] != len(ids):
                out |= self._each(some)
                continue
            raw, start = ids.tobytes(), 0
            for w, end in zip(some, cut, strict=True):
                out[w] = raw[2 * start : 2 * end]
                start = end
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of plain words from those of their parts; most are letters with one sign after them at most."""
        parts = [(w,) if w.isalpha() else (w[:-1], w[-1]) if w[:-1].isalpha() else PART.findall(w) for w in words]
        new = set().union(*parts).difference(self.parts)
        if len(self.parts) + len(new) > REMEMBERED:
            self.parts = {}
            new = set().union(*parts)
        self.parts.update(self._learn(list(new)))
        find = self.parts
        return [find[v[0]] if len(v) == 1 else find[v[0]] + find[v[1]] if len(v) == 2 else b"".join([find[p] for p in v]) for v in parts]

    def _plain(self, text: str) -> list[bytes] | None:
        """The lower-case words of a plain text, in Latin-1; nothing for another one."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if raw.translate(None, PLAIN) or b"<|" in raw else raw.translate(_LOWER).split()

    def _ids(self, words: np.ndarray) -> list[bytes]:
        """Packed ids of different plain words."""
        found = list(map(self.known.get, words))
        gaps = [k for k, b in enumerate(found) if b is None]
        if gaps:
            wanted = [words[k] for k in gaps]
            if len(self.known) + len(wanted) > REMEMBERED:
                self.known, self.older = {}, self.known
            new = [w for w in wanted if w not in self.older]
            learnt = dict(zip(new, self._words([w.decode("latin-1") for w in new]), strict=True))
            for k, w in zip(gaps, wanted, strict=True):
                found[k] = self.known[w] = learnt[w] if w in learnt else self.older[w]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text. The words of all plain texts are numbered together; each different one is looked
        up once, and the ids of all are gathered by number."""
        every, count, other = [], [], {}
        for t in texts:
            words = self._plain(t)
            if words is None:
                other[t] = b""
            else:
                every += words
            count.append(len(words or ()))
        number, different = pd.factorize(np.array([*every, None], dtype=object)[:-1])
        ids = self._ids(different)
        size = np.array([len(b) // 2 for b in ids] or [0], dtype=np.int64)
        flat, first = np.frombuffer(b"".join(ids), dtype="<u2"), np.cumsum(size) - size
        upto = np.concatenate([[0], np.cumsum(size[number])])
        gathered = flat[np.arange(upto[-1]) + np.repeat(first[number] - upto[:-1], size[number])] if len(number) else flat
        ends = upto[np.cumsum(count)].tolist()
        if other:
            split = {t: [w for w in GAP.split(t) if w] for t in other}
            each = self._each(list({w for v in split.values() for w in v}))
            other = {t: b"".join([each[w] for w in v]) for t, v in split.items()}
        return [other[t] if t in other else gathered[a:b].tobytes() for t, a, b in zip(texts, [0, *ends[:-1]], ends, strict=True)]


def encoder(path: str) -> PartEncoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = PartEncoder(path)
    return _encoders[path]
