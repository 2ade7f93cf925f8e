"""Vectorised reading of text inside Arrow batches.

Helpers here run inside ``mapInArrow`` tasks. A batch is cut into blocks of a few megabytes
of text, so the arrays made from it stay small whatever the size of a Spark batch; one text
is never cut. Positions are byte positions of the UTF-8 form unless said otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
BLOCK_BYTES = 1 << 21

# The code points with the Unicode property White_Space.
WHITE_SPACE = (
    0x0009, 0x000A, 0x000B, 0x000C, 0x000D, 0x0020, 0x0085, 0x00A0, 0x1680, 0x2000, 0x2001,
    0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029,
    0x202F, 0x205F, 0x3000,
)


def filled(column: pa.Array) -> pa.Array:
    """The column with 64-bit offsets; null becomes the empty text."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def blocks(batch: pa.RecordBatch, name: str, limit: int = BLOCK_BYTES
           ) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut a batch into runs of rows of at most ``limit`` bytes of text, one row at least."""
    texts = filled(batch.column(batch.schema.get_field_index(name)))
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start, done = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(start, stop - start), texts.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each text starts and ends."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, body = texts.buffers()
    bounds = np.frombuffer(at, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def kind(code: int) -> int:
    """Letter, number, white space or other."""
    if code in WHITE_SPACE:
        return SPACE
    category = unicodedata.category(chr(code))[0]
    return LETTER if category == "L" else NUMBER if category == "N" else OTHER


@cache
def _low_kinds() -> np.ndarray:
    return np.array([kind(c) for c in range(0x10000)], np.uint8)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the characters above ASCII start, and what they are."""
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    code = first & (0xFF >> (size + 1))
    for step in (1, 2, 3):
        longer = size > step
        code[longer] = code[longer] << 6 | (data[lead[longer] + step] & 0x3F)
    return lead, code


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte belongs to."""
    low = _low_kinds()
    found = low[data]
    if len(data) and data.max() >= 0x80:
        lead, code = code_points(data)
        of = low[np.minimum(code, 0xFFFF)]
        for k in np.flatnonzero(code > 0xFFFF):
            of[k] = kind(int(code[k]))
        size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        found[lead] = of
        for step in (1, 2, 3):
            longer = size > step
            found[lead[longer] + step] = of[longer]
    return found


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of true that stay within one text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[bounds] = True
    change = edge[:-1].copy()
    change[1:] |= inside[1:] != inside[:-1]
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(inside))
    keep = inside[starts]
    return starts[keep], ends[keep]


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings ``data[start:end]`` as one Arrow array; the runs must not overlap."""
    size = ends - starts
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1   # starts differ from each other, and so do ends
    mark[ends] -= 1
    body = data[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(body.tobytes())])


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x2545F4914F6CDD1D
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, size: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    have = _powers.get(str(base))
    if have is None or len(have) < size:
        wide = max(size, BLOCK_BYTES + 1)
        have = np.full(wide, np.uint64(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if wide <= 4 * BLOCK_BYTES:
            _powers[str(base)] = have
    return have[:size]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings ``data[start:end]``, equal for equal strings.

    A polynomial modulo 2**64, taken from running sums over the whole block.
    """
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(data)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _power(INVERSE, len(data) + 1)[starts]
    return mix(value ^ ((ends - starts).astype(np.uint64) * MIX))


def words(texts: pa.Array, numbers: bool = True
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case words: longest runs of letters (and digits).

    Returns the lower-case bytes, starts and ends of the words, and for each text the place
    of its first word (one more entry than texts).
    """
    data, bounds = buffers(pc.utf8_lower(texts))
    of = kinds(data)
    inside = of == LETTER
    if numbers:
        inside |= of == NUMBER
    starts, ends = runs(inside, bounds)
    return data, starts, ends, np.searchsorted(starts, bounds)
