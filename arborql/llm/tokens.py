"""Byte-level BPE ids over Arrow columns: words are found and hashed vectorised, each new word is encoded once."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textops import U64, chunks, span_hashes, strings

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Texts with code points from here on, or with an added token's string, go to the tokenizer as a whole.
PLAIN_BELOW = 0x250
_CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
_SLOTS = 1 << 21
_MOST_IDS = 1 << 24


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _classes() -> np.ndarray:
    kind = np.full(PLAIN_BELOW, OTHER, np.uint8)
    for i in range(PLAIN_BELOW):
        c = unicodedata.category(chr(i))[0]
        kind[i] = LETTER if c == "L" else NUMBER if c == "N" else OTHER
    kind[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = SPACE
    return kind


def _contracted(cp: np.ndarray, kind: np.ndarray, row_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the apostrophes that begin a contraction ('s, 're, ...), and how many letters follow."""
    at = np.flatnonzero(cp == 39)
    before = np.append(OTHER, kind)[at]  # the class of the character before
    free = row_start[at] | (before != OTHER) & (np.append(0, cp)[at] != 32)  # else it joins the blank or sign before it
    at = at[free]
    size = np.zeros(len(at), np.int64)
    end = np.append(row_start, True)  # a contraction doesn't cross into the next text
    for letters in _CONTRACTIONS:
        fits = at + len(letters) < len(cp)
        for i, c in enumerate(letters, 1):
            place = np.minimum(at + i, len(cp) - 1)
            fits &= (cp[place] == ord(c)) & ~end[place]
        size[fits] = len(letters)
    return at[size > 0], size[size > 0]


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own; keeps a bounded direct-mapped cache of words.

    The strings of added tokens in a text are those tokens, as the tokenizer has it;
    with literal=True they are ordinary text.
    """

    def __init__(self, path: str, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.added = [] if literal else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = _classes()
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(_SLOTS, U64), np.zeros(_SLOTS, np.int32), np.zeros(_SLOTS, np.int32)
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0

    def _keep(self, flat: np.ndarray) -> int:
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(flat), self.used) + 1024, "<u4")])
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return self.used - len(flat)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _plain(self, text: str, cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the concatenated plain texts that begin at at (n + 1 entries), and the first id of each."""
        kind = self.kind[cp]
        space = kind == SPACE
        begin = np.ones(len(cp), bool)
        np.not_equal(kind[1:], kind[:-1], out=begin[1:])
        begin[1:] &= ~((cp[:-1] == 32) & ~space[1:])  # a blank belongs to the word after it
        last = space.copy()  # the last white space before a word stands alone or joins the word
        last[:-1] &= ~space[1:]
        last[-1:] = False
        last[at[1:-1][at[1:-1] > 0] - 1] = False
        begin |= last
        row_start = np.zeros(len(cp), bool)
        row_start[at[:-1][at[:-1] < len(cp)]] = True
        begin |= row_start
        short, size = _contracted(cp, kind, row_start)
        begin[short + 1] = False
        after = short + size + 1
        begin[after[after < len(cp)]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(cp))
        if self.used > _MOST_IDS:
            self._clear()
        h = span_hashes(cp, starts, ends)
        slot = (h & U64(_SLOTS - 1)).astype(np.int64)
        hit = self.keys[slot] == h
        pos, n = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            new, one, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            s, e = starts[miss[one]].tolist(), ends[miss[one]].tolist()
            got = [x.ids for x in self.tokenizer.encode_batch_fast([text[a:b] for a, b in zip(s, e)], add_special_tokens=False)]
            size = np.fromiter(map(len, got), np.int64, len(got))
            base = self._keep(np.fromiter((i for x in got for i in x), "<u4", int(size.sum())))
            where = base + np.cumsum(size) - size
            pos[miss], n[miss] = where[inverse], size[inverse]
            slot = (new & U64(_SLOTS - 1)).astype(np.int64)
            self.keys[slot], self.at[slot], self.n[slot] = new, where, size
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(pos - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        first = np.append(ends - n, ends[-1] if len(ends) else 0)
        return ids, first[np.searchsorted(starts, at)]

    def column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; null counts as empty."""
        offsets, data = strings(column)
        for i, j in chunks(offsets):
            raw = data[offsets[i] : offsets[j]].tobytes()
            text = raw.decode("utf-8")
            cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
            u8 = np.frombuffer(raw, np.uint8)
            leads = np.zeros(len(u8) + 1, np.int64)
            np.cumsum((u8 & 0xC0) != 0x80, out=leads[1:])
            at = leads[offsets[i : j + 1] - offsets[i]]
            odd = np.zeros(len(cp) + 1, np.int64)
            np.cumsum(cp >= PLAIN_BELOW, out=odd[1:])
            odd = np.diff(odd[at]) > 0
            for token in self.added:
                found = raw.find(token)
                while found >= 0:
                    odd[np.searchsorted(offsets[i : j + 1] - offsets[i], found, side="right") - 1] = True
                    found = raw.find(token, found + 1)
            if odd.any():
                keep = np.repeat(~odd, np.diff(at))
                plain_at = np.zeros(j - i + 1, np.int64)
                np.cumsum(np.where(odd, 0, np.diff(at)), out=plain_at[1:])
                cp2 = cp[keep]
                ids, first = self._plain(cp2.tobytes().decode("utf-32-le"), cp2, plain_at)
            else:
                ids, first = self._plain(text, cp, at)
            for r in range(j - i):
                yield self.whole(text[at[r] : at[r + 1]]) if odd[r] else ids[first[r] : first[r + 1]]
