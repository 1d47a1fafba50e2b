"""Fast exact encoding with a tokenizers file: split as arrays, encode each distinct piece once.

The library spends most of its time on splitting and on building encodings.  Here
the characters of many texts are classed at once (letter, number, white space,
other; the library itself is asked about every character that turns up), runs of
a class give the pieces that the file's pattern gives, and a table of exact keys
gives each piece's ids.  Pieces not seen before are merged together by the ranks
of the file.  Only texts that hold the string of a special token go through the
library as a whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

from .common import U64, mix
from .merges import Merges

#: Characters of the texts that are split and looked up together.
GROUP = 1 << 19
LETTER, NUMBER, OTHER, WHITE = 1, 2, 3, 4
#: Bytes of the pieces that the table holds; longer ones are kept in a dictionary.
SHORT = 23
#: Pieces that a table holds before it starts anew, and its slots.
MOST, SLOTS = 1 << 18, 1 << 19
MOST_BYTES = 8 << 20  # of pieces that do not fit in a slot
#: Characters whose lower case may depend on their neighbours or on the Unicode version.
UNSURE = re.compile("[ΣԀ-֏Ⴀ-ჿᎠ-᏿ᲀ-Ჿ℀-↏⒰-⓯Ⰰ-ⷿꙀ-ꟿꬰ-ꮿ\U00010000-\U0010ffff]")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = byte_letters()


def load(path: str):
    """The library's tokenizer without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


def merges(library) -> Merges:
    return Merges(library, _LETTERS, lambda word: [t.id for t in library.model.tokenize(word.decode("latin-1").translate(_LETTERS))])


class Splitter:
    """Pieces of texts as the file's pattern gives them.

    ``words``: the lower-case word pattern, which drops white space and parts numbers; else the byte-level one,
    whose pieces cover the text and take one space before them along.
    """

    def __init__(self, library, words: bool) -> None:
        self.library, self.words = library, words
        self.kinds = np.zeros(0x110000, np.uint8)
        self.special = re.compile("|".join(re.escape(t.content) for t in library.get_added_tokens_decoder().values()) or "(?!)")

    def kind(self, c: str) -> int:
        """The class of a character, by how the library splits it from others."""
        split = self.library.pre_tokenizer.pre_tokenize_str
        if len(split(f"a{c}")) == 1 and len(split(f"{c}a")) == 1 and len(split(c)) == 1:
            return LETTER
        if len(split(f"!{c}")) == 1 and split(c):
            return OTHER
        if not self.words:
            return NUMBER if len(split(f"1{c}")) == 1 else WHITE
        return NUMBER if split(c) else WHITE

    def plain(self, text: str | None) -> str | None:
        """The text as it is split; None if it has to go to the library."""
        if not text:
            return ""
        if self.special.search(text):
            return None
        if not self.words:
            return text
        if text.isascii() or not UNSURE.search(text) and unicodedata.is_normalized("NFC", text):
            return text.lower()
        return self.library.normalizer.normalize_str(text)

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all texts together, first byte and end of each piece, and the first piece of each text (and the end)."""
        joined = "".join(texts)
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        raw = joined.encode()
        data, n = np.frombuffer(raw, np.uint8), len(joined)
        chars = data if len(raw) == n else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.kinds[chars]
        if not kind.all():
            for c in np.unique(chars[kind == 0]).tolist():
                self.kinds[c] = self.kind(chr(c))
            kind = self.kinds[chars]
        text_at = np.zeros(n + 1, bool)
        text_at[starts] = True
        first = text_at.copy()
        first[1:n] |= kind[1:] != kind[:-1]
        first[n] = True
        runs = np.flatnonzero(first[:n])
        ends = np.concatenate([runs[1:], [n]]) if len(runs) else runs
        of = kind[runs]
        joins = np.zeros(n + 1, bool)  # a run that takes the space before it along
        if self.words:
            first[:n] |= kind == NUMBER
        else:
            inner = (of == WHITE) & ~text_at[ends]
            last = ends[inner] - 1
            first[last] = True
            joins[last[chars[last] == 0x20] + 1] = True
            first &= ~joins
        # 's 't 'm 'd 're 've 'll, where the apostrophe begins a piece and is all of its run
        quote = np.flatnonzero((of == OTHER) & (ends - runs == 1) & ~text_at[ends])
        quote = runs[quote][(chars[runs[quote]] == 0x27) & ~joins[runs[quote]]] + 1
        quote = quote[kind[quote] == LETTER]
        a, b = chars[quote], chars[np.minimum(quote + 1, n - 1)]
        two = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
        two &= ~text_at[quote + 1]
        one = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)
        took = quote[one | two]
        first[took] = False
        first[took + np.where(two[one | two], 2, 1)] = True
        begin = np.flatnonzero(first[:n])
        end = np.concatenate([begin[1:], [n]]) if len(begin) else begin
        if self.words:
            keep = kind[begin] != WHITE
            begin, end = begin[keep], end[keep]
        places = np.searchsorted(begin, starts)
        if chars is not data:
            at = np.concatenate([[0], np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000).astype(np.int64))])
            begin, end = at[begin], at[end]
        return data, begin, end, places


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


class PieceTable:
    """A number for each distinct piece, by its bytes: an open-addressed table whose slots hold the whole piece."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots, self.long, self.size = np.zeros((SLOTS, 4), U64), {}, 0  # of a slot: three words, number + 1
        self.long_bytes = 0

    def _probe(self, key: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each key or -1, and the slot where the search ended."""
        out, left = np.full(len(key), -1, np.int64), np.arange(len(key))
        while len(left):
            found = self.slots[slot[left]]
            same = (found[:, 0] == key[left, 0]) & (found[:, 1] == key[left, 1]) & (found[:, 2] == key[left, 2])
            used = found[:, 3] > 0
            hit = same & used
            out[left[hit]] = found[hit, 3].astype(np.int64) - 1
            left = left[used & ~same]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
        return out, slot

    def numbers(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The number of each piece, and the pieces that are new, in the order of their numbers."""
        size = end - begin
        padded = np.concatenate([data, np.zeros(24, np.uint8)])
        words = np.ndarray(len(data) + 17, "<u8", padded, strides=(1,))
        short = np.flatnonzero(size <= SHORT)
        at, n = begin[short], size[short]
        key = np.stack([words[np.minimum(at + 8 * i, len(data) + 16)] & _MASKS[np.clip(n - 8 * i, 0, 8)] for i in range(3)], 1)
        key[:, 2] |= n.astype(U64) << U64(56)
        with np.errstate(over="ignore"):
            slot = (mix(key[:, 0] ^ mix(key[:, 1] + mix(key[:, 2]))) & U64(SLOTS - 1)).astype(np.int64)
        found, slot = self._probe(key, slot)
        out = np.empty(len(begin), np.int64)
        out[short] = found
        raw, new = data.tobytes(), {}
        missing = np.flatnonzero(found < 0)
        for i, a, b in zip(missing.tolist(), at[missing].tolist(), (at + n)[missing].tolist(), strict=True):
            out[short[i]] = new.setdefault(raw[a:b], self.size + len(new))
        if len(missing):
            number = out[short[missing]]
            _, once = np.unique(number, return_index=True)
            self._insert(key[missing[once]], slot[missing[once]], number[once])
        for i in np.flatnonzero(size > SHORT).tolist():
            piece = raw[begin[i] : end[i]]
            number = self.long.get(piece)
            if number is None:
                number = self.long[piece] = new.setdefault(piece, self.size + len(new))
                self.long_bytes += len(piece)
            out[i] = number
        self.size += len(new)
        return out, list(new)

    def _insert(self, key: np.ndarray, slot: np.ndarray, number: np.ndarray) -> None:
        left = np.arange(len(key))
        while len(left):
            _, chosen = np.unique(slot[left], return_index=True)
            chosen = chosen[self.slots[slot[left[chosen]], 3] == 0]
            at = slot[left[chosen]]
            self.slots[at, :3], self.slots[at, 3] = key[left[chosen]], number[left[chosen]].astype(U64) + U64(1)
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left = left[rest]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)

    @property
    def full(self) -> bool:
        return self.size > MOST or self.long_bytes > MOST_BYTES


def groups(texts: list[str | None], upto: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some ``upto`` characters together."""
    first = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= upto:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


class Encoder:
    """``encode(text, add_special_tokens=False).ids`` of many texts; ``unseen`` gives the ids of new pieces."""

    def __init__(self, library, words: bool, dtype: str, unseen: Callable[[list[bytes], str], list[np.ndarray]]) -> None:
        self.library, self.dtype, self.unseen = library, dtype, unseen
        self.splitter, self.table = Splitter(library, words), PieceTable()
        self._empty()

    def _empty(self) -> None:
        self.table.clear()
        self.ids, self.held, self.start, self.count = np.zeros(1 << 16, self.dtype), 0, np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        found = self.unseen(new, self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        at, upto = self.table.size - len(new), self.held + int(sizes.sum())
        while len(self.start) < self.table.size:
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        while len(self.ids) < upto:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.held : upto] = np.concatenate(found) if found else []
        self.start[at : self.table.size] = self.held + np.cumsum(sizes) - sizes
        self.count[at : self.table.size] = sizes
        self.held = upto

    def _group(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
        """Numbers of the pieces, first piece of each text (and the end), and ids of the texts that are the library's."""
        if self.table.full:
            self._empty()
        plain = [self.splitter.plain(t) for t in texts]
        whole = {i: self.library.encode(texts[i], add_special_tokens=False).ids for i, t in enumerate(plain) if t is None}
        data, begin, end, places = self.splitter.split([t or "" for t in plain])
        numbers, new = self.table.numbers(data, begin, end)
        if new:
            self._learn(new)
        return numbers, places, whole

    def arrays(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; null is empty."""
        for first, last in groups(texts):
            numbers, places, whole = self._group(texts[first:last])
            count = self.count[numbers]
            ends = np.concatenate([[0], np.cumsum(count)])
            ids = self.ids[np.repeat(self.start[numbers] - ends[:-1], count) + np.arange(ends[-1])]
            at = ends[places].tolist()
            for i in range(last - first):
                yield np.array(whole[i], self.dtype) if i in whole else ids[at[i] : at[i + 1]]

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """How many ids each text has."""
        out = np.zeros(len(texts), np.int64)
        for first, last in groups(texts):
            numbers, places, whole = self._group(texts[first:last])
            ends = np.concatenate([[0], np.cumsum(self.count[numbers])])
            out[first:last] = np.diff(ends[places])
            for i, ids in whole.items():
                out[first + i] = len(ids)
        return out


class ByteEncoder(Encoder):
    """A byte-level BPE file."""

    def __init__(self, path: str) -> None:
        library = load(path)
        self.vocabulary = library.get_vocab_size()
        super().__init__(library, False, "<u2" if self.vocabulary <= 1 << 16 else "<u4", merges(library))


_encoders: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """One encoder a worker process, so that its pieces outlive a task."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]
