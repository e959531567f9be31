"""Cutting texts into chunks that a byte-level BPE encodes independently of what stands around them.

The pattern of the public byte-level vocabularies never matches across the place
before an ASCII white-space character that follows another character than white
space. Texts are cut there into chunks, all texts of a batch at once on their
bytes. The distinct chunks are cut into the pattern's own matches (pieces), and
each distinct piece of the batch is encoded once: every text's ids are put
together from those of its pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def compile_pattern(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode's White_Space, as the tokenizer libraries read it."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def _ends_white(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character whose last byte stands at each place is white space."""
    x = b[at]
    out = _WHITE[x]
    far = np.flatnonzero(x >= 0x80)
    if len(far):
        x = x[far]
        y, z = b[np.maximum(at[far] - 1, 0)], b[np.maximum(at[far] - 2, 0)]
        general = (y == 0x80) & ((x <= 0x8A) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF)) | (y == 0x81) & (x == 0x9F)
        out[far] = (y == 0xC2) & ((x == 0x85) | (x == 0xA0)) | (z == 0xE2) & general | (z == 0xE3) & (y == 0x80) & (x == 0x80) | (z == 0xE1) & (y == 0x9A) & (x == 0x80)
    return out


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts (a string column without nulls) in order, and how many each text has; an empty text has none."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if not len(texts) or ends[-1] == ends[0]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    first, last = int(ends[0]), int(ends[-1])
    b = np.frombuffer(data, np.uint8)[first:last]
    at = np.flatnonzero(_WHITE[b])
    at = at[at > 0]
    start = np.zeros(len(b) + 1, bool)
    start[at[~_ends_white(b, at - 1)]] = True
    start[ends - first] = True
    cuts = np.flatnonzero(start)
    found = pa.Array.from_buffers(pa.string(), len(cuts) - 1, [None, pa.py_buffer((cuts + first).astype(np.int32)), data])
    return found, np.diff(np.searchsorted(cuts, ends - first))


def expand(flat: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``flat`` holds a run of ``count[k]`` values for each k; the runs named by ``at``, one after the other."""
    own = count[at]
    upto = np.cumsum(own)
    if not len(upto) or not upto[-1]:
        return flat[:0]
    kind = np.int32 if max(len(flat), upto[-1]) < 1 << 31 else np.int64
    place = np.repeat(((np.cumsum(count) - count)[at] - upto + own).astype(kind), own)
    place += np.arange(upto[-1], dtype=kind)
    return flat[place]


def sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The sum of each run of ``count`` values."""
    upto = np.concatenate([[0], np.cumsum(values)])
    cuts = np.concatenate([[0], np.cumsum(count)])
    return np.diff(upto[cuts])


def laid(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, end to end, and the size of each text."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2] if ends[-1] > ends[0] else b""
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], np.diff(ends).astype(np.int64)


def spaced(texts: pa.Array, first: np.ndarray) -> np.ndarray:
    """Which of the texts (none empty) start with a byte that is true in ``first`` and end with another character than white space."""
    b, size = laid(texts)
    ends = np.cumsum(size)
    return first[b[ends - size]] & ~_ends_white(b, ends - 1) if len(size) else np.zeros(0, bool)


def strings(texts: pa.Array) -> str:
    """The texts of a string column as one."""
    return laid(texts)[0].tobytes().decode()


class PieceEncoder:
    """Ids of texts by way of their distinct pieces.

    ``encode`` takes distinct pieces (matches of ``pattern``, as a string column)
    and gives their ids one after the other and their counts.
    """

    def __init__(self, pattern: regex.Pattern, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.pattern, self.encode = pattern, encode

    def _pieces(self, names: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """The pieces of all chunks, their order by chunk, and how many each chunk has.

        Chunks that start with white space and end with another character are
        matched as one text, in which the pattern ends a match where each begins.
        """
        joins = spaced(names, _WHITE)
        some, rest = names.filter(pa.array(joins)), names.filter(pa.array(~joins)).to_pylist()
        own = [self.pattern.findall(x) for x in rest]
        pieces = pa.array(self.pattern.findall(strings(some)) + [x for p in own for x in p], pa.string())
        upto = np.cumsum(np.asarray(pc.utf8_length(pieces)).astype(np.int64))
        ends = np.cumsum(np.concatenate([np.asarray(pc.utf8_length(some)).astype(np.int64), np.fromiter(map(len, rest), np.int64, len(rest))]))
        count = np.diff(np.searchsorted(upto, ends), prepend=-1)
        place = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        back = np.argsort(place, kind="stable")
        return pieces.dictionary_encode(), expand(np.arange(len(pieces)), count, back), count[back]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) one after the other, and how many each has."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        found, many = chunks(texts)
        if not len(found):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        found = found.dictionary_encode()
        pieces, order, in_chunk = self._pieces(found.dictionary)
        flat, count = self.encode(pieces.dictionary)
        at = np.asarray(pieces.indices)[order]
        of_chunk = expand(flat, count, at)
        size = sums(count[at], in_chunk)
        code = np.asarray(found.indices)
        return expand(of_chunk, size, code), sums(size[code], many)
