"""Scan texts for all keys of a dictionary at once, where the texts are.

A dictionary of keys is three kinds of sorted numbers: for each power of two the hashes of the keys' heads of that
length (a key's head is the longest such that fits into it), with the lengths of the keys that have it; and the hash of
each whole key. A hash is a polynomial in the characters modulo 2^64, so the hash of any piece of a text follows from
two running sums over it, and all places of a batch of texts are tested by array operations: heads at each place where
a key may begin, then, of the few places that pass, the whole keys that fit up to a place where one may end. Work and
memory grow with the characters, whatever they are: a line of dots has as many places as it has dots.

Equal hashes alone decide nothing: the places come with the text that they cover, and an equi-join with the keys
keeps those that are equal.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import regex

from ..functions.text import UNIT_CLASS, WORD_CLASS

#: Characters that are scanned together; the code that parts them.
BATCH_CHARS, GAP = 1 << 19, 0x110000
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
_FILTER_BITS = 22
#: Bits of a bitmap of hashes (as a power of two), bits of one of its blocks, and the kind of the one of whole keys.
FILTER_BITS, BLOCK_BITS, WHOLE = 26, 15, 0
#: Lengths of the shorter heads that longer keys have in bitmaps too; their kinds are these numbers below zero.
SHORT = (4, 8, 16)


@cache
def _tables() -> dict[str, np.ndarray]:
    """For each code point whether it continues a word or a unit, is a digit, is white space, is a combining mark; what
    it is compared as, and whether that is several characters (``multi``)."""
    codes = np.array([c for c in range(GAP) if not 0xD800 <= c < 0xE000], np.uint32)
    text = codes.tobytes().decode("utf-32-le")
    out = {}
    for name, kind in (("word", WORD_CLASS), ("unit", UNIT_CLASS), ("digit", r"\p{Nd}"), ("mark", r"\p{M}")):
        mask = np.zeros(GAP + 1, bool)
        for m in regex.finditer(f"[{kind}]+", text):
            mask[codes[m.start() : m.end()]] = True
        out[name] = mask
    marks = np.flatnonzero(out.pop("mark"))
    out["combining"], out["white"], out["multi"] = (np.zeros(GAP + 1, bool) for _ in range(3))
    out["combining"][[c for c in marks.tolist() if unicodedata.combining(chr(c))]] = True
    out["white"][[c for c in codes[:0x3100].tolist() if chr(c).isspace()]] = True
    out["fold"] = np.arange(GAP + 1, dtype=np.uint32)
    for c in codes[(codes < 0x20000) | ((codes >= 0x2F800) & (codes < 0x2FA20))].tolist():
        folded = unicodedata.normalize("NFC", chr(c)).casefold()
        if len(folded) > 1:
            out["multi"][c] = True
        elif folded != chr(c):
            out["fold"][c] = ord(folded)
    return out


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.multiply.accumulate(np.append(np.uint64(1), np.full(size, b, np.uint64))) for b in (_BASE, inverse))


def _mixed(codes: np.ndarray) -> np.ndarray:
    v = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    return (v ^ (v >> np.uint64(29))) * _MIX


class Sums:
    """Running sums over the characters of texts that lie end to end; the hash of any piece."""

    def __init__(self, codes: np.ndarray):
        size = 1 << max(10, int(len(codes)).bit_length())
        self.powers, self.inverse = _powers(size)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mixed(codes) * self.powers[: len(codes)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, length) -> np.ndarray:
        """The hash of each [start, start + length)."""
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


def head_lengths(lengths: np.ndarray) -> np.ndarray:
    """The largest power of two that is not over each length."""
    return 1 << (np.frexp(lengths.astype(float))[1] - 1)


def key_numbers(keys: Iterable[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each key (one character at least) its length, the hash of its head, and its own."""
    sums, start, lengths = _key_sums(keys)
    return lengths, sums.hashes(start, head_lengths(lengths)), sums.hashes(start, lengths)


def _key_sums(keys: Iterable[str]) -> tuple[Sums, np.ndarray, np.ndarray]:
    """The sums over keys end to end, where each begins, and its length."""
    keys = list(keys)
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    codes = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32)
    return Sums(codes), np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64), lengths


def short_heads(keys: Iterable[str]) -> dict[int, np.ndarray]:
    """For each kind of shorter head the hashes of those of keys that have a longer one."""
    sums, start, lengths = _key_sums(keys)
    return {-size: sums.hashes(start[longer], size) for size in SHORT if (longer := lengths >= 2 * size).any()}


def sized(heads: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hashes of heads together with the lengths of their keys."""
    return heads + np.asarray(length).astype(np.uint64) * np.array([_MIX])


def bits(hashes: np.ndarray) -> np.ndarray:
    """The bits of a bitmap that stand for some hashes, each once, ascending."""
    return ascending((hashes >> np.uint64(64 - FILTER_BITS)).astype(np.uint32))


def ascending(values: np.ndarray) -> np.ndarray:
    """Numbers each once (by sorting; ``np.unique`` hashes them, which is slower where few are equal)."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


class _Set:
    """A set of hashes: a bit filter that most other values fail, then a search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self._fill()

    def _fill(self) -> None:
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[self.values >> np.uint64(64 - _FILTER_BITS)] = True

    def __getstate__(self) -> np.ndarray:
        return self.values

    def __setstate__(self, values: np.ndarray) -> None:
        self.values = values
        self._fill()

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are in the set, and where."""
        some = np.flatnonzero(self.bits[hashes >> np.uint64(64 - _FILTER_BITS)])
        at = np.minimum(np.searchsorted(self.values, hashes[some]), len(self.values) - 1)
        there = self.values[at] == hashes[some]
        return some[there], at[there]


class Dictionary:
    """What a scan needs of a set of keys: about 24 bytes for each."""

    def __init__(self, lengths: np.ndarray, heads: np.ndarray, keys: np.ndarray):
        self.heads: list[tuple[int, _Set, np.ndarray, np.ndarray]] = []
        self.keys = _Set(keys) if len(keys) else None
        size = head_lengths(lengths)
        for power in np.unique(size):
            own = size == power
            head, length = heads[own], lengths[own]
            order = np.lexsort((length, head))
            head, length = head[order], length[order]
            new = np.append(True, (np.diff(head) != 0) | (np.diff(length) != 0))
            head, length = head[new], length[new]
            found = _Set(head)
            self.heads.append((int(power), found, np.append(np.searchsorted(head, found.values), len(head)), length))

    def places(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys begin and end: ``begins`` are the places where one may, ``ends`` says of each place if one may."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if self.keys is not None and len(codes):
            sums = Sums(codes)
            for power, heads, first, lengths in self.heads:
                at = begins[begins + power <= len(codes)]
                which, group = heads.places(sums.hashes(at, power))
                many = first[group + 1] - first[group]
                start = np.repeat(at[which], many)
                nth = np.arange(len(start)) - np.repeat(np.cumsum(many) - many, many)
                stop = start + lengths[np.repeat(first[group], many) + nth]
                fits = stop <= len(codes)
                start, stop = start[fits], stop[fits]
                fits = ends[stop]
                start, stop = start[fits], stop[fits]
                whole, _ = self.keys.places(sums.hashes(start, stop - start))
                out.append((start[whole], stop[whole]))
        start, stop = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((stop, start))
        return start[order], stop[order]


class Filter:
    """What a scan needs of a catalogue of any size: of each kind of head, and of whole keys, a bitmap of hashes.

    A bitmap has ``1 << FILTER_BITS`` bits however many keys there are, so more keys let more other places pass; those
    go in the join with the keys. ``lengths`` are the lengths of keys whose head has the kind's length; its bitmap holds
    heads with these lengths. Where there are bitmaps of the shorter heads of longer keys, a place must pass these
    first. Both keep what passes few where whole keys fill their bitmap: of many keys heads of a few characters, and
    lengths that one head has, are still few.
    """

    def __init__(self, bits: dict[int, np.ndarray], lengths: dict[int, np.ndarray]):
        self.bits, self.lengths = bits, lengths

    def _has(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - FILTER_BITS)
        return self.bits[kind][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) > 0

    def places(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys may begin and end, as ``Dictionary.places``."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(codes):
            sums = Sums(codes)
            for power, lengths in sorted(self.lengths.items()):
                at = begins[begins + power <= len(codes)]
                for short in SHORT:
                    if short < power and -short in self.bits:
                        at = at[self._has(-short, sums.hashes(at, short))]
                head = sums.hashes(at, power)
                for length in lengths.tolist():
                    fits = np.flatnonzero(at + length <= len(codes))
                    fits = fits[ends[at[fits] + length]]
                    start = at[fits[self._has(power, sized(head[fits], length))]]
                    start = start[self._has(WHOLE, sums.hashes(start, length))]
                    out.append((start, start + length))
        start, stop = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((stop, start))
        return start[order], stop[order]


@dataclass
class Surfaces:
    """Texts as they are compared, end to end with a gap after each, and their units.

    A unit is a character with its combining marks, or a run of white space that is compared as one space; a unit may
    be compared as several characters.
    """

    codes: np.ndarray
    unit: np.ndarray  # the unit of each compared character
    offset: np.ndarray  # where each unit begins among them
    row: np.ndarray  # the text of each unit
    first: np.ndarray  # where it begins in the text
    last: np.ndarray  # where it ends there
    before: np.ndarray  # the text's character before the unit, GAP if none
    after: np.ndarray  # the one after it
    text: np.ndarray  # whether it is of a text, not a gap


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def surface(texts: list[str], collapse: bool) -> Surfaces:
    """The surfaces of some texts, as ``build_surface`` gives them one by one."""
    kinds = _tables()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    joined = "\0".join([*texts, ""])
    codes = _codes(joined).copy()
    ends = np.cumsum(lengths)
    codes[ends - 1] = GAP
    begin = ~kinds["combining"][codes]
    begin[0] = True
    begin[ends[:-1]] = True
    white = kinds["white"][codes]
    if collapse:
        begin[1:] |= white[:-1]
        begin[1:] &= ~(white[1:] & white[:-1])
    at = np.flatnonzero(begin)
    stop = np.append(at[1:], len(codes))
    lead = codes[at]
    text = lead != GAP
    folded = kinds["fold"][lead]
    several = text & ((stop - at > 1) | kinds["multi"][lead])
    if collapse:
        space = white[at]
        folded[space], several[space] = 32, False
    row = np.repeat(np.arange(len(texts)), lengths)[at]
    starts = ends - lengths
    before, after = np.where(at > 0, codes[at - 1], GAP), np.append(codes, GAP)[stop]
    which = np.flatnonzero(several)
    if not len(which):
        every = np.arange(len(at))
        return Surfaces(folded, every, every, row, at - starts[row], stop - starts[row], before, after, text)
    alike: dict[str, list[int]] = {}
    for k, a, b in zip(which.tolist(), at[which].tolist(), stop[which].tolist(), strict=True):
        alike.setdefault(joined[a:b], []).append(k)
    made = {piece: _codes(unicodedata.normalize("NFC", piece).casefold()) for piece in alike}
    size = np.ones(len(at), np.int64)
    for piece, of in alike.items():
        size[of] = len(made[piece])
    offset = np.cumsum(size) - size
    out = np.repeat(folded, size)
    for piece, of in alike.items():
        for j, c in enumerate(made[piece].tolist()):
            out[offset[of] + j] = c
    return Surfaces(out, np.repeat(np.arange(len(at)), size), offset, row, at - starts[row], stop - starts[row], before, after, text)


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded size with the number of their first."""
    lo = held = 0
    for k, text in enumerate(texts):
        if k > lo and held + len(text) > BATCH_CHARS:
            yield lo, texts[lo:k]
            lo, held = k, 0
        held += len(text) + 1
    if lo < len(texts):
        yield lo, texts[lo:]


def find(dictionary: Dictionary | Filter, texts: list[str], collapse: bool, units: bool = False) -> Iterator[tuple[int, int, int, str]]:
    """(text, start, end, compared text) wherever a key stands between boundaries; of units a digit may stand before.

    Ranges are of the texts; a hit begins and ends with whole units of its text.
    """
    kinds = _tables()
    for base, some in _pieces(texts):
        s = surface(some, collapse)
        kind = kinds["unit" if units else "word"]
        free = s.text & ~kind[s.before]
        if units:
            free |= s.text & kinds["digit"][s.before]
        ends = np.zeros(len(s.codes) + 1, bool)
        ends[np.append(s.offset[1:], len(s.codes))] = s.text & ~kind[s.after]
        start, end = dictionary.places(s.codes, s.offset[free], ends)
        first, last = s.unit[start], s.unit[end - 1]
        whole = s.row[first] == s.row[last]
        if not whole.any():
            continue
        start, end, first, last = start[whole], end[whole], first[whole], last[whole]
        text = np.where(s.codes == GAP, 0, s.codes).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        rows, froms, tos = (s.row[first] + base).tolist(), s.first[first].tolist(), s.last[last].tolist()
        for a, b, r, x, y in zip(start.tolist(), end.tolist(), rows, froms, tos, strict=True):
            yield r, x, y, text[a:b]
