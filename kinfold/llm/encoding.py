"""Whole-text token ids with the tokenizers library, one encode per distinct piece.

Both vocabularies split a text at white space before they merge. A text is cut
where no token can cross, pieces are told apart by a 64-bit span hash and their
length, each distinct piece is encoded by the library once, and the ids of the
pieces are strung together by array gathers. The ids equal those of encoding
the whole text; tests hold this against the library.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

from kinfold.llm.kernels import U64, SpanHash, words

WORDS_FILE = "word_bpe_49k.json"
BYTES_FILE = "byte_bpe_50k.json"
MAX_PIECES = 1_000_000
SLICE = 1 << 20

# Leads of the UTF-8 forms of white space beyond ASCII, and controls that some engines count as such: no cut beside them.
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[0x21:0x7F] = True
_AFTER = _PLAIN.copy()
_AFTER[0xC3:0xE1] = True
_AFTER[0xE4:0xEF] = True
_AFTER[0xF0:0xF5] = True
_TWO = np.zeros(256, dtype=bool)
_TWO[0xC3:0xE0] = True


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct values of two ascending arrays, ascending."""
    both = np.sort(np.concatenate([a, b]), kind="stable")  # quick on two runs, unlike a set of hashes
    fresh = np.ones(len(both), dtype=bool)
    fresh[1:] = both[1:] != both[:-1]
    return both[fresh]


def lone_blanks(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of pieces, each cut before a blank that stands between two characters that aren't white space."""
    n = len(buf)
    at = np.flatnonzero(buf == 0x20)
    at = at[(at >= 2) & (at < n - 1)]
    before, lead = buf[at - 1], buf[at - 2]
    at = at[(_PLAIN[before] | ((before >= 0x80) & _TWO[lead])) & _AFTER[buf[at + 1]]]
    starts = merged(at, offs[:-1][np.diff(offs) > 0])
    ends = np.append(starts[1:], n) if len(starts) else starts
    return starts, ends, np.searchsorted(starts, offs)


class PieceEncoder:
    """Encodes texts by pieces; ``keeps_blanks``: a word's token holds the blank before it."""

    def __init__(self, path: str, keeps_blanks: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of all tasks would wait for each other
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.cut = lone_blanks if keeps_blanks else words
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=U64)  # hashes of the known pieces, ascending
        self.place = np.zeros(0, dtype=np.int64)  # their numbers
        self.begin = np.zeros(1 << 16, dtype=np.int64)  # of each known piece, in ids
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces and give them the next numbers."""
        k = len(self.keys)
        got = [e.ids for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]
        count = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        flat = np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=int(count.sum()))
        while k + len(got) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin[k + 1 : k + 1 + len(got)] = self.used + np.cumsum(count)
        self.used += len(flat)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all rows of the buffer, and where each row's begin."""
        starts, ends, first = self.cut(buf, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        hashes, one, which = np.unique(SpanHash(buf).of(starts, ends) ^ (ends - starts).astype(U64), return_index=True, return_inverse=True)
        if len(self.keys) > MAX_PIECES:
            self._forget()
        at = np.searchsorted(self.keys, hashes)
        new = np.flatnonzero(np.append(self.keys, U64(0))[at] != hashes)
        last = np.flatnonzero(at == len(self.keys))
        new = merged(new, last)
        if len(new):
            raw = buf.tobytes()
            s, e = starts[one[new]].tolist(), ends[one[new]].tolist()
            self._learn([raw[a:b].decode("utf-8", "replace") for a, b in zip(s, e)])
            numbers = np.arange(len(self.keys), len(self.keys) + len(new))
            self.place = np.insert(self.place, at[new], numbers)
            self.keys = np.insert(self.keys, at[new], hashes[new])
            at = np.searchsorted(self.keys, hashes)
        index = self.place[at][which]
        begin = self.begin[index]
        count = self.begin[index + 1] - begin
        before = np.concatenate([[0], np.cumsum(count)])
        take = np.repeat(begin - before[:-1], count) + np.arange(before[-1])
        return self.ids[take], before[first]


@lru_cache(maxsize=4)
def encoder(path: str, keeps_blanks: bool) -> PieceEncoder:
    return PieceEncoder(path, keeps_blanks)
