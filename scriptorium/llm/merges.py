"""The merges of a BPE file for many words at once, as arrays.

Words stand in rows of symbols.  A round joins in every row the leftmost pair of
the least rank, which is the order in which the library merges, until no row has
a pair left.  Pairs are found in an open-addressed table of the file's merges.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

from .common import U64, mix

#: Widths of rows in bytes; longer words go to the library.
WIDTHS = (4, 8, 12, 16, 24, 40)
#: Rows that are merged side by side; their arrays stay in a core's cache.
TOGETHER = 4096
NONE = np.int32(0x7FFFFFFF)


class Merges:
    """``letters``: the vocabulary's letter of each byte; ``one``: the library's ids of one word."""

    def __init__(self, library, letters: dict[int, str], one: Callable[[bytes], list[int]]) -> None:
        model = json.loads(library.to_str())["model"]
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]] if plain else []
        self.one, self.pad = one, max(vocabulary.values()) + 1
        self.usable = plain and all(letters[b] + s in vocabulary for b in range(256) for s in {"", suffix})
        if not self.usable:
            return
        self.first = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[letters[b] + suffix] for b in range(256)], np.int64)
        self.joined = np.array([vocabulary[a + b] for a, b in pairs] or [0], np.int64)
        want = np.array([(vocabulary[a] << 20) | vocabulary[b] for a, b in pairs], np.int64)
        self.mask = (1 << int(len(want) * 5 | 1).bit_length()) - 1
        self.keys, self.rank = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NONE, np.int32)
        left, slot = np.arange(len(want)), self.slots(want)
        while len(left):
            _, chosen = np.unique(slot, return_index=True)
            chosen = chosen[self.keys[slot[chosen]] < 0]
            self.keys[slot[chosen]], self.rank[slot[chosen]] = want[left[chosen]], left[chosen]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def slots(self, pair: np.ndarray) -> np.ndarray:
        return (mix(pair.astype(U64)) & U64(self.mask)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where the file does not merge it."""
        want = ((left << 20) | right).ravel()
        slot = self.slots(want)
        found = self.keys[slot]
        out = np.where(found == want, self.rank[slot], NONE)
        more = np.flatnonzero((found != want) & (found >= 0))
        slot = slot[more]
        while len(more):
            slot = (slot + 1) & self.mask
            found = self.keys[slot]
            hit = found == want[more]
            out[more[hit]] = self.rank[slot[hit]]
            on = ~hit & (found >= 0)
            more, slot = more[on], slot[on]
        return out.reshape(left.shape)

    def rows(self, symbols: np.ndarray) -> np.ndarray:
        """Merge every row; rows end with ``pad``."""
        out, live = np.full_like(symbols, self.pad), np.arange(len(symbols))
        rank = self.ranks(symbols[:, :-1], symbols[:, 1:])
        while len(live):
            width = symbols.shape[1]
            at = rank.argmin(1) if width > 1 else np.zeros(len(live), np.int64)
            best = rank[np.arange(len(live)), at] if width > 1 else np.full(len(live), NONE)
            on = best < NONE
            if not on.all():
                out[live[~on], :width] = symbols[~on]
                live, symbols, rank, at, best = live[on], symbols[on], rank[on], at[on], best[on]
            if not len(live):
                break
            row = np.arange(len(live))
            to = np.arange(width - 1)
            to = to + (to > at[:, None])
            symbols = np.take(symbols.ravel(), to + (row * width)[:, None])
            symbols[row, at] = self.joined[best]
            rank = np.take(rank.ravel(), to[:, : width - 2] + (row * (width - 1))[:, None])
            some = np.flatnonzero(at > 0)
            rank[some, at[some] - 1] = self.ranks(symbols[some, at[some] - 1], symbols[some, at[some]])
            some = np.flatnonzero(at < width - 2)
            rank[some, at[some]] = self.ranks(symbols[some, at[some]], symbols[some, at[some] + 1])
        return out

    def __call__(self, words: list[bytes], dtype: str) -> list[np.ndarray]:
        """The ids of each word."""
        out: list = [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        data, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        narrow = 0
        for width in WIDTHS if self.usable else ():
            alike = np.flatnonzero((size > narrow) & (size <= width))
            narrow = width
            for some in (alike[k : k + TOGETHER] for k in range(0, len(alike), TOGETHER)):
                n, row = size[some], np.arange(len(some))
                column = np.minimum(np.arange(width), n[:, None] - 1)
                letters = data[begin[some][:, None] + column]
                symbols = np.where(np.arange(width) < n[:, None], self.first[letters], self.pad)
                symbols[row, n - 1] = self.last[letters[row, n - 1]]
                merged = self.rows(symbols)
                real = merged != self.pad
                ids, at = merged[real].astype(dtype), 0
                for i, end in zip(some.tolist(), np.cumsum(real.sum(1)).tolist(), strict=True):
                    out[i] = ids[at:end]
                    at = end
        for i in (np.flatnonzero((size > narrow) | (size == 0)) if self.usable else range(len(words))):
            out[i] = np.array(self.one(words[i]), dtype)
        return out
