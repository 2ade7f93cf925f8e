"""The pieces that a public tokenizer splits a text into before its merges, found in bulk.

Two splits are covered: that of byte-level vocabularies (a space goes with the piece behind
it) and that of word vocabularies (lower case, white space dropped, each digit alone). Texts
with characters whose class or case could differ between libraries, or with the marks of
special tokens, are reported as unusual; callers treat those one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from leadline.llm.text import NUMBER, SPACE, buffers, code_points, kinds

# The letters that may follow an apostrophe as a piece of their own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
APOSTROPHE = ord("'")


def unusual(texts: pa.Array) -> np.ndarray:
    """Texts beyond Latin letters and common punctuation, or with ``<|`` in them."""
    data, bounds = buffers(texts)
    odd = np.zeros(len(texts), bool)
    if not len(data):
        return odd
    bad = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    lead, code = code_points(data)
    plain = ((code < 0x250) & (code != 0x130)) | ((code >= 0x2010) & (code <= 0x2027)) | (
        (code >= 0x2030) & (code <= 0x205E)) | (code == 0x20AC) | (code == 0x2122)
    at = np.concatenate([bad, lead[~plain], np.flatnonzero((data < 32) & ~(
        (data >= 9) & (data <= 13)))])
    odd[np.searchsorted(bounds, at, "right") - 1] = True
    return odd


def _contractions(data: np.ndarray, cut: np.ndarray, edge: np.ndarray) -> None:
    """An apostrophe that starts a piece takes the letters of a contraction with it."""
    at = np.flatnonzero(cut[:-1] & (data == APOSTROPHE))
    size = len(data)
    for letters in CONTRACTIONS:
        n = len(letters)
        fits = at[at + n < size]
        for k, letter in enumerate(letters.encode(), 1):
            fits = fits[(data[fits + k] == letter) & ~edge[fits + k]]
        cut[fits + 1] = False
        cut[fits + 1 + n] = True


def _edges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    of = kinds(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    cut = edge.copy()
    cut[1:-1] |= of[1:] != of[:-1]
    return of, edge, cut


def byte_level(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of a byte-level vocabulary."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of, edge, cut = _edges(data, bounds)
    # white space before something else gives its last character up
    after = np.flatnonzero(cut[:-1] & ~edge[:-1])
    after = after[of[after - 1] == SPACE]
    last = after - 1
    for _ in range(3):
        last = last - ((data[last] & 0xC0) == 0x80)
    cut[last] = True
    cut[after[data[last] == 0x20]] = False
    _contractions(data, cut, edge)
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


def word_level(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of a word vocabulary; ``data`` is in lower case."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of, edge, cut = _edges(data, bounds)
    cut[:-1] |= (of == NUMBER) & ((data & 0xC0) != 0x80)
    _contractions(data, cut, edge)
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    keep = of[starts] != SPACE
    return starts[keep], ends[keep]


