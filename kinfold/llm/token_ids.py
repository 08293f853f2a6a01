"""Token ids of whole texts by a public tokenizer file, word by word with a cache.

Byte-pair encoding works on pieces that the tokenizer's pattern cuts out, and text repeats its pieces. ``Encoder`` cuts
all pieces of a slice of documents at once in numpy, encodes each distinct piece by the library, and keeps the ids of
pieces it has seen. The cuts follow the two patterns below for code points under U+0280, whose classes and lower case
are asked of the library itself; a text with any other code point, with the start of a special token, or with a
character whose normal form is not one such character, goes to the library whole. Tests compare both ways on random
strings. The library's model merges each piece that is not cached. A cached piece is found by a 64-bit hash (exact among
pieces of equal length up to eight bytes).
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from kinfold.llm import arrays as A

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_LIMIT = 0x280
#: The cache keeps one piece in each slot, and starts anew when it holds this many ids: at most about 45 MB.
_SLOT_BITS = 20
_CACHED_IDS = 2 << 20
_ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]

# Byte-level models read bytes as visible characters: printable Latin-1 as itself, the others from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_VISIBLE = np.arange(256, dtype="<u4")
_VISIBLE[np.setdiff1d(_VISIBLE, _PRINTED)] = 0x100 + np.arange(256 - len(_PRINTED))


class Encoder:
    def __init__(self, path: str):
        # Spark has a task per core already; the library's own threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        #: Some patterns put one blank before a piece into it; the others drop blanks and cut numbers digit by digit.
        self.keeps_blanks = bool(self.tokenizer.encode("\n", add_special_tokens=False).ids)
        self.model = self.tokenizer.model
        self._classes()
        self._clear()

    def _classes(self) -> None:
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str
        normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        self.kind = np.zeros(_LIMIT, np.uint8)
        self.lower = np.arange(_LIMIT)
        self.plain = np.ones(_LIMIT, bool)
        for code in range(_LIMIT):
            char = normal(chr(code))
            if len(char) != 1 or (code < 0x80) != (ord(char) < 0x80) or ord(char) >= _LIMIT:
                self.plain[code] = False
                continue
            self.lower[code] = ord(char)
            kind = _SPACE
            for probe, found in (("a", _LETTER), ("!", _OTHER)):
                if len(got := pieces(probe + char)) == 1 and got[0][1][1] == 2:
                    kind = found
            if kind == _SPACE and (len(pieces("1" + char)) == 1 if self.keeps_blanks else len(pieces(char)) == 1):
                two = pieces("1" + char)
                kind = _NUMBER if two[-1][1][1] == 2 else _SPACE
            self.kind[code] = kind
        self.ascii_lower = np.arange(256, dtype=np.uint8)
        self.ascii_lower[:128] = self.lower[:128]
        self.ascii_kind = np.zeros(256, np.uint8)
        self.ascii_kind[:128] = self.kind[:128]

    def encode(self, texts: A.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): ids of all texts one after another; those of text ``i`` are ``ids[first[i]:first[i + 1]]``."""
        n = texts.size
        data = texts.data.copy()
        raw = data[:n]
        kind = self.ascii_kind[data]
        leads = np.flatnonzero((raw >= 0xC2) & (raw <= 0xC9))
        codes = ((data[leads].astype(np.int64) & 0x1F) << 6) | (data[leads + 1] & 0x3F)
        odd = (raw >= 0xCA) | (self.ascii_kind[raw] == 255)
        odd[raw < 0x80] |= ~self.plain[raw[raw < 0x80]]
        odd[leads] |= ~self.plain[codes]
        odd[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
        whole = A.sums(odd, texts.bounds) > 0
        kind[leads] = kind[leads + 1] = self.kind[codes]
        lower = self.lower[codes]
        data = self.ascii_lower[data]
        data[leads], data[leads + 1] = 0xC0 | (lower >> 6), 0x80 | (lower & 0x3F)
        starts, ends = self._cut(data, kind[:n], texts.bounds)
        first = np.searchsorted(starts, texts.bounds)
        if whole.any():
            keep = ~np.repeat(whole, np.diff(first))
            starts, ends = starts[keep], ends[keep]
            first = np.searchsorted(starts, texts.bounds)
        ids, sizes = self._look_up(data, starts, ends)
        total = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        bounds = total[first]
        if not whole.any():
            return ids, bounds
        own = iter(self._by_library([texts.at(i).decode() for i in np.flatnonzero(whole)]))
        parts = [next(own) if whole[i] else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        return (np.concatenate(parts) if parts else ids), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)

    def _by_library(self, strings: list[str]) -> list[np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in encoded]

    def _pieces_by_library(self, data: np.ndarray, starts: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of pieces by the library's model alone, as they are cut already."""
        # One character per byte, so pieces are slices of one string.
        visible = _VISIBLE[data].tobytes().decode("utf-32-le")
        merged = [[token.id for token in self.model.tokenize(visible[a:b])] for a, b in zip(starts, ends, strict=True)]
        sizes = np.fromiter(map(len, merged), np.int64, len(merged))
        return np.fromiter(chain.from_iterable(merged), np.uint32, int(sizes.sum())), sizes

    def _cut(self, data: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all pieces.

        Pieces are 's 't 're 've 'm 'll 'd, runs of letters, runs of other marks, and numbers: runs or single ones.
        With blanks kept, a piece takes one space before it, and the rest of a run of blanks is a piece.
        """
        n = len(kind)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        opens = np.ones(n, bool)
        opens[1:] = kind[1:] != kind[:-1]
        full = bounds[:-1] < bounds[1:]
        opens[bounds[:-1][full]] = True
        if not self.keeps_blanks:
            opens |= (kind == _NUMBER) & ((data[:n] & 0xC0) != 0x80)
        last = np.zeros(n, bool)
        last[bounds[1:][full] - 1] = True
        # An apostrophe alone between runs, not after a space that it takes.
        quotes = np.flatnonzero((data[:n] == 0x27) & opens & ~last)
        quotes = quotes[kind[quotes + 1] == _LETTER]
        if self.keeps_blanks:
            blank = kind == _SPACE
            turn = np.flatnonzero(blank[:-1] & ~blank[1:] & ~last[:-1])  # the blank before a piece
            # A blank of two bytes is cut at its first.
            cut = np.where((data[turn] & 0xC0) == 0x80, turn - 1, turn)
            opens[cut] = True
            opens[turn[data[turn] == 0x20] + 1] = False
        quotes = quotes[opens[quotes]]
        for ending in _ENDINGS:
            size = len(ending)
            fits = np.ones(len(quotes), bool)
            for k, byte in enumerate(ending):
                fits &= data[quotes + 1 + k] == byte
                if k:
                    fits &= ~last[np.minimum(quotes + k, n - 1)]
            at = quotes[fits]
            opens[at + 1] = False
            after = at + 1 + size
            opens[after[(after < n) & ~last[np.minimum(after - 1, n - 1)]]] = True
        starts = np.flatnonzero(opens)
        ends = np.r_[starts[1:], n]
        if not self.keeps_blanks:
            words = kind[starts] != _SPACE
            starts, ends = starts[words], ends[words]
        return starts, ends

    def _look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        if self._used > _CACHED_IDS:
            self._clear()
        hashes = A.hash_spans(data, starts, ends)
        slots = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        at, sizes = self._starts[slots], self._sizes[slots]
        new = np.flatnonzero(self._hashes[slots] != hashes)
        if len(new):
            distinct, example, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            spans = new[example]
            ids, new_sizes = self._pieces_by_library(data, starts[spans].tolist(), ends[spans].tolist())
            new_starts = self._used + np.cumsum(new_sizes) - new_sizes
            self._append(ids)
            at[new], sizes[new] = new_starts[inverse], new_sizes[inverse]
            # Of pieces that share a slot the last stays; the others are encoded again when they return.
            slots = slots[spans]
            self._hashes[slots], self._starts[slots], self._sizes[slots] = distinct, new_starts, new_sizes
        return self._ids[A.ramps(at, sizes)], sizes

    def _clear(self) -> None:
        self._hashes = np.zeros(1 << _SLOT_BITS, np.uint64)
        self._starts = np.zeros(1 << _SLOT_BITS, np.int64)
        self._sizes = np.zeros(1 << _SLOT_BITS, np.int64)
        self._ids = np.zeros(1 << 16, np.uint32)
        self._used = 0

    def _append(self, ids: np.ndarray) -> None:
        if self._used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros(len(self._ids) + len(ids), np.uint32)])
        self._ids[self._used : self._used + len(ids)] = ids
        self._used += len(ids)


def encoded_slices(batches, path: str):
    """(slice of the batch, ids, first), by an encoder that lives as long as the task."""
    encoder = Encoder(path)
    for part, texts in A.text_slices(batches):
        yield part, *encoder.encode(texts)
    del encoder
    pa.default_memory_pool().release_unused()


def id_list(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), pa.array(ids, pa.uint32()))
