"""Encoding with a public tokenizer, unit by unit with a bounded table of units.

The library's model makes the ids; what is added is that text is cut where no pre-token can cross (see `WordEncoder`), so that a
unit that has been met before is looked up, for all units of a batch at once, and that units of Latin letters are pre-tokenized here by
the tokenizer's published pattern, as the library's call for each costs more than the merges. Other units go through the library's
normaliser and pre-tokenizer. `tests/llm` holds the ids against the library's on whole texts. Strings of special tokens inside a
text are ordinary text.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import regex

from .common import U64, span_hashes, task_caches, text_bytes

#: The published pre-token patterns of the two kinds of vocabulary.
PATTERN_ATTACHED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PATTERN_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below this character, lower case and composition are the same in every library.
LATIN_END = "\u0130"


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


#: Bytes of text that are encoded at once.
ENCODE_BYTES = 1 << 19
_LETTERS = byte_letters()
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_ASCII_LOWER[[9, 10, 13]] = 32
_LETTER, _MARK, _LATIN = (np.zeros(256, bool) for _ in range(3))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[33:127] = ~_LETTER[33:127]
_LATIN[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True  # behind C3: the letters from U+00C0 to U+00FF
_ASCII_BLANK = np.zeros(256, bool)
_ASCII_BLANK[[*range(9, 14), *range(28, 33)]] = True


class Units:
    """Ids by unit: an open-addressing table of hashes beside pools of the units' bytes and ids. Found units are compared byte by byte."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.n = self.n_bytes = self.n_ids = 0
        self.table, self.entry = np.zeros(1 << 16, U64), np.full(1 << 16, -1, np.int32)
        self.at, self.size, self.ids_at, self.ids_size = (np.zeros(1 << 14, np.int64) for _ in range(4))
        self.bytes, self.ids = np.zeros(1 << 18, np.uint8), np.zeros(1 << 17, np.uint16)

    def _step(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & (len(self.table) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        out = np.full(len(h), -1, np.int32)
        rows, at = np.arange(len(h)), (h & U64(len(self.table) - 1)).astype(np.int64)
        while len(rows):
            entry = self.entry[at]
            hit = (self.table[at] == h[rows]) & (entry >= 0)
            out[rows[hit]] = entry[hit]
            on = ~hit & (entry >= 0)
            rows, at = rows[on], self._step(at[on])
        return out

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        at = (h & U64(len(self.table) - 1)).astype(np.int64)
        while len(h):
            free = self.entry[at] < 0
            self.entry[at[free]], self.table[at[free]] = entry[free], h[free]  # of several for one slot the last stays
            on = self.entry[at] != entry
            h, entry, at = h[on], entry[on], self._step(at[on])

    def _grown(self, name: str, need: int) -> np.ndarray:
        have = getattr(self, name)
        if need > len(have):
            have = np.concatenate([have, np.zeros(max(need - len(have), len(have)), have.dtype)])
            setattr(self, name, have)
        return have

    def add(self, h: np.ndarray, words: list[bytes], new_ids: np.ndarray, n_ids: np.ndarray, listed: bool = True) -> np.ndarray:
        """New entries; those not `listed` are not found again."""
        n, size = len(words), np.array([len(w) for w in words], np.int64)
        for name, start, sizes in (("at", self.n_bytes, size), ("ids_at", self.n_ids, n_ids)):
            self._grown(name, self.n + n)[self.n : self.n + n] = start + np.cumsum(sizes) - sizes
        self._grown("size", self.n + n)[self.n : self.n + n] = size
        self._grown("ids_size", self.n + n)[self.n : self.n + n] = n_ids
        new = np.frombuffer(b"".join(words), np.uint8)
        self._grown("bytes", self.n_bytes + len(new))[self.n_bytes : self.n_bytes + len(new)] = new
        self._grown("ids", self.n_ids + len(new_ids))[self.n_ids : self.n_ids + len(new_ids)] = new_ids
        entry = np.arange(self.n, self.n + n, dtype=np.int32)
        self.n, self.n_bytes, self.n_ids = self.n + n, self.n_bytes + len(new), self.n_ids + len(new_ids)
        if listed:
            if 2 * self.n > len(self.table):
                old = np.flatnonzero(self.entry >= 0)
                keys, held = self.table[old], self.entry[old]
                self.table = np.zeros(1 << (4 * self.n).bit_length(), U64)
                self.entry = np.full(len(self.table), -1, np.int32)
                self._place(keys, held)
            self._place(h, entry)
        return entry

    def trim(self) -> None:
        """Start anew where the arrays have grown past the limit."""
        if sum(x.nbytes for x in (self.table, self.entry, self.at, self.size, self.ids_at, self.ids_size, self.bytes, self.ids)) > self.limit:
            self.clear()


class WordEncoder:
    """Encodes texts to 16-bit ids. `attached`: a word keeps the one space before it, as in byte-level BPE; else white space is dropped.

    Units are cut in front of spaces (and line ends, where white space is dropped); with `attached` only where a character other than
    white space comes before: no pre-token pattern reads past that. They are also cut between a Latin letter and an ASCII mark or digit
    behind it, where a pre-token always ends, so that a word is one unit whatever stands behind it. `cache_bytes` bounds what is held of the units.
    """

    def __init__(self, path: str, attached: bool, cache_bytes: int = 128 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids must fit 16 bits")
        self.attached = attached
        pattern = PATTERN_ATTACHED if attached else PATTERN_WORD
        self.pattern = regex.compile(pattern)
        self.plain = re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+")).findall  # the same for printable ASCII
        self.model = self.tokenizer.model
        self.units = Units(cache_bytes)
        self.short: dict[str, list[int]] = {}  # parts of units: marks, and words with other marks behind them

    def _parts(self, text: str) -> list[str]:
        if text.isascii() and text.isprintable():
            if self.attached:
                if text[0] == " ":
                    return [_LETTERS[32] + text[1:]] if text[1:].isalpha() else [x.replace(" ", _LETTERS[32]) for x in self.plain(text)]
                return [text] if text.isalpha() else [x.replace(" ", _LETTERS[32]) for x in self.plain(text)]
            text = text.strip(" ").lower()
            return [text] if text.isalpha() else self.plain(text)
        if max(text) < LATIN_END:
            if not self.attached:
                text = text.strip(" \n").lower()
            body = text[1:] if self.attached and text[:1] == " " else text
            found = [text] if body.isalpha() else self.pattern.findall(text)
            return [x.encode().decode("latin-1").translate(_LETTERS) for x in found]
        norm = self.tokenizer.normalizer
        return [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(norm.normalize_str(text) if norm else text)]

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units one after another, and how many each has."""
        tokenize, short = self.model.tokenize, self.short
        ids: list[int] = []
        ends = [0]
        for word in words:
            parts = self._parts(word.decode())
            if len(parts) == 1:  # these are kept as units
                ids += [t.id for t in tokenize(parts[0])]
            else:
                for part in parts:
                    got = short.get(part)
                    if got is None:
                        got = [t.id for t in tokenize(part)]
                        if len(short) < 50_000:
                            short[part] = got
                    ids += got
            ends.append(len(ids))
        return np.array(ids, np.uint16), np.diff(ends)

    def _starts(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        cut = raw == 0x20
        if self.attached:
            one, two = np.zeros(len(raw), np.uint8), np.zeros(len(raw), np.uint8)
            one[1:], two[2:] = raw[:-1], raw[:-2]
            # white space beyond ASCII ends in C2 85, C2 A0, or has 80, 81 or 9A for its second byte of three
            cut &= ~(_ASCII_BLANK[one] | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | (two == 0x80) | (two == 0x81) | (two == 0x9A))
        mark = _MARK[raw[1:]]
        cut[1:] |= mark & _LETTER[raw[:-1]]
        cut[2:] |= mark[1:] & _LATIN[raw[1:-1]] & (raw[:-2] == 0xC3)
        cut[offs[:-1][offs[:-1] < offs[1:]]] = True
        return np.flatnonzero(cut)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's ids begin (and the end)."""
        raw, offs = text_bytes(texts)
        if not self.attached:  # these vocabularies are of lower case and without white space: words that differ in ASCII case or by a line end alone are one unit
            raw = _ASCII_LOWER[raw]
        start = self._starts(raw, offs)
        stop = np.append(start[1:], len(raw))
        found, at = [(np.zeros(0, np.uint16), np.zeros(0, np.int64))], 0
        while at < len(start):  # also inside a very long text
            upto = max(at + 1, int(np.searchsorted(start, start[at] + ENCODE_BYTES, "right")))
            found.append(self._looked_up(raw[start[at] : stop[upto - 1]], start[at:upto] - start[at], stop[at:upto] - start[at]))
            at = upto
        ids, n = (np.concatenate(x) for x in zip(*found, strict=True))
        return ids, np.append(0, np.cumsum(n))[np.searchsorted(start, offs)]

    def _looked_up(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units that lie side by side over all bytes, and how many each has."""
        units = self.units
        h = span_hashes(raw, start, stop)
        entry = units.find(h)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            new, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
            text = raw.tobytes()
            words = [text[i:j] for i, j in zip(start[miss[first]].tolist(), stop[miss[first]].tolist(), strict=True)]
            entry[miss] = units.add(new, words, *self._encode(words))[which]
        if (units.size[entry] == stop - start).all():
            other = units.bytes[np.repeat(units.at[entry] - start, stop - start) + np.arange(len(raw))] != raw
            rows = np.unique(np.searchsorted(start, np.flatnonzero(other), "right") - 1)
        else:
            rows = np.arange(len(start))
        if len(rows):  # two units of one hash: these are not looked up
            words = [raw[i:j].tobytes() for i, j in zip(start[rows].tolist(), stop[rows].tolist(), strict=True)]
            entry[rows] = units.add(h[rows], words, *self._encode(words), listed=False)
        n = units.ids_size[entry]
        ids = units.ids[np.repeat(units.ids_at[entry] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        units.trim()
        return ids, n

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text."""
        return self.encode_column(pa.array([text], pa.string()))[0]


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with `end_id` after each text's ids."""
    return np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))


def binary_pieces(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Each text's 16-bit ids as a binary value."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, np.uint16))])


def encoder(path: str, attached: bool) -> WordEncoder:
    """One encoder a Python worker, kept from task to task."""
    if (path, attached) not in task_caches:
        task_caches[path, attached] = WordEncoder(path, attached)
    return task_caches[path, attached]
