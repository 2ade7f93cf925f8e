"""Exact token counts from the count at every prefix.

The last token of a byte-pair encoding is fixed by the text: for every prefix there is one
token that ends there and agrees with the last token of the prefix before it. Walking over a
piece once gives the exact number of tokens of each of its prefixes, so limits and cuts are
answered from the table and nothing is encoded a second time.

Pieces repeat, so their tables are kept per Python worker, up to ``KEPT`` pieces.

Defined cases: null counts as the empty text (0 tokens, 0 bytes). The strings of special
tokens inside a text count as one token, as the library does by default. Repeated rows and
extra columns do not matter: one row out for each row in.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from leadline.llm.pretokens import byte_level, unusual
from leadline.llm.text import blocks, buffers, slices

KEPT = 1_000_000
LIMIT = 512


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, by rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Token counts at the prefixes of pieces and texts for one byte-level vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        byte = byte_letters()
        raw = {token: bytes(byte[c] for c in token) for token in said["model"]["vocab"]
               if all(c in byte for c in token)}
        self.special = [t["content"] for t in said.get("added_tokens", [])]
        for token in self.special:
            raw.pop(token, None)
        self.number = {b: said["model"]["vocab"][t] for t, b in raw.items()}
        self.text = {n: b for b, n in self.number.items()}
        self.longest = max(map(len, self.number))
        self.merge: dict[tuple[int, int], int] = {}   # the place in the order, for each pair
        self.rank: dict[int, int] = {}                # the same by the token that is made
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(said["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = raw[a], raw[b]
            left, right, made = self.number[a], self.number[b], self.number[a + b]
            self.merge[left, right] = rank
            self.rank[made], self.halves[made] = rank, (left, right)
        self.agrees: dict[int, bool] = {}
        self.tables: dict[bytes, bytes | np.ndarray] = {}
        self.split = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.pieces = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def agree(self, a: int, b: int) -> bool:
        """Whether the merges, run over the bytes of two tokens, end in just these two.

        The merges are undone from the latest back. What touches the border at each moment
        must not have had an earlier merge across it.
        """
        merge, rank, halves = self.merge, self.rank, self.halves
        until = 1 << 60  # the two border tokens stand side by side up to this merge
        while True:
            if merge.get((a, b), 1 << 60) < until:
                return False
            made_a, made_b = rank.get(a, -1), rank.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            # of two equal merges the left one is done first
            if made_a > made_b:
                until, a = made_a, halves[a][1]
            else:
                until, b = made_b + 1, halves[b][0]

    def table(self, piece: bytes) -> bytes | np.ndarray:
        """Token counts of the prefixes of a piece of 0, 1, 2, ... bytes."""
        size, number, longest, agrees = len(piece), self.number, self.longest, self.agrees
        last, count = [-1] * (size + 1), [0] * (size + 1)
        for end in range(1, size + 1):
            for start in range(end - 1, max(-1, end - longest - 1), -1):  # one fits, mostly short
                token = number.get(piece[start:end])
                if token is None:
                    continue
                if start:
                    pair = last[start] << 20 | token
                    good = agrees.get(pair)
                    if good is None:
                        good = agrees[pair] = self.agree(last[start], token)
                    if not good:
                        continue
                last[end], count[end] = token, count[start] + 1
                break
        if len(agrees) > 4 * KEPT:
            agrees.clear()
        return bytes(count) if count and max(count) < 256 else np.array(count, np.int64)

    def tables_of(self, pieces: list[bytes]) -> list[bytes | np.ndarray]:
        tables = self.tables
        if len(tables) > KEPT:
            tables.clear()
        found = []
        for piece in pieces:
            table = tables.get(piece)
            if table is None:
                table = self.table(piece)
                if len(piece) <= 64:
                    tables[piece] = table
            found.append(table)
        return found

    def pieces_of(self, text: str) -> list[bytes]:
        """The pieces of any text; a special token's string is a piece of its own."""
        found, at = [], 0
        for special in self.split.finditer(text):
            found += [p.encode() for p in self.pieces.findall(text[at:special.start()])]
            found.append(special.group().encode())
            at = special.end()
        return found + [p.encode() for p in self.pieces.findall(text[at:])]

    def count(self, text: str) -> int:
        special = {s.encode() for s in self.special}
        pieces = self.pieces_of(text)
        tables = self.tables_of([p for p in pieces if p not in special])
        return sum(int(t[-1]) for t in tables) + sum(p in special for p in pieces)

    def at_prefixes(self, text: str) -> np.ndarray:
        """Exact token counts of text[:0], text[:1], ... text[:n], each as the library counts it.

        Within a piece the table answers. Where a cut changes the split itself (white space
        runs, contractions) the pieces from the start of that run on are split again.
        """
        special = {s.encode() for s in self.special}
        out, total, done = np.zeros(len(text) + 1, np.int64), 0, 0
        pieces = self.pieces_of(text)
        before = [0]  # tokens before each piece
        for piece in pieces:
            total += 1 if piece in special else int(self.tables_of([piece])[0][-1])
            before.append(total)
        starts = [0]
        for piece in pieces:
            starts.append(starts[-1] + len(piece.decode()))
        for k, piece in enumerate(pieces):
            word = piece.decode()
            shift = word[0].isspace() or word[0] == "'" or piece in special or (
                k and pieces[k - 1].decode()[-1:].isspace())
            table, byte = None if shift else self.tables_of([piece])[0], 0
            first = k
            while first and (pieces[first - 1].decode().isspace() or pieces[first - 1] == b"'"):
                first -= 1
            for j, letter in enumerate(word, 1):
                byte += len(letter.encode())
                done = starts[k] + j
                out[done] = (before[k] + int(table[byte]) if table is not None else
                             before[first] + self.count(text[starts[first]:done]))
        return out

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that has ``budget`` tokens at most."""
        return int(np.flatnonzero(self.at_prefixes(text) <= budget)[-1])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Token counts of a block of texts."""
        odd = unusual(texts)
        data, bounds = buffers(texts)
        starts, ends = byte_level(data, bounds)
        found = np.zeros(len(texts), np.int64)
        if len(starts):
            coded = slices(data, starts, ends).dictionary_encode()
            tables = self.tables_of(coded.dictionary.to_pylist())
            last = np.array([t[-1] for t in tables], np.int64)
            sums = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(last[coded.indices.to_numpy()], out=sums[1:])
            at = np.searchsorted(starts, bounds)
            found = sums[at[1:]] - sums[at[:-1]]
        for k in np.flatnonzero(odd):
            found[k] = self.count(texts[k].as_py())
        return found


@cache
def counter(path: str) -> PrefixCounter:
    """One counter for each vocabulary and Python worker."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document's whole text."""

    def count(batches):
        tables = counter(path)
        for batch in batches:
            for rows, texts in blocks(batch, "text"):
                n = tables.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n),
                     pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def truncated(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """doc_id and the longest beginning of its text that has ``budget`` tokens at most."""

    def cut(batches):
        tables = counter(path)
        for batch in batches:
            for rows, texts in blocks(batch, "text"):
                whole = texts.to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([t[:tables.longest_prefix(t, budget)]
                                               for t in whole], pa.string())],
                    names=["doc_id", "text"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, text string")
