"""Fill-in-the-middle form of texts by rotating blocks in place.

A text is cut at two line ends into prefix, middle and suffix. The three sentinels are put
into a bytearray in front of their parts, in the order of the text, and neighbouring blocks
are exchanged by three reversals until the parts stand in the order of the form:

    psm: <P>prefix<S>suffix<M>middle        spm: <S>suffix<P>prefix<M>middle

The way back reverses the same blocks and takes the sentinels out, so it gives the exact text.
Cuts and form come from a hash of the seed and the id, so they do not depend on the layout of
the data.

Defined cases: a null text counts as empty; an empty text and a text that holds a sentinel
stay as they are (``plain``, with null sizes). A null id is hashed as the empty string. One row
out for each row in, whatever repeats. Extra columns are kept; one that has the name of a
column of the result is replaced by it.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leadline.llm.text import blocks

PLAIN, PSM, SPM = "plain", "psm", "spm"
RESULT = ["n", "form", "prefix_chars", "middle_chars", "output"]


@dataclass(frozen=True)
class Infill:
    """Seed, shares in percent of texts that are cut and of cut ones in spm form, sentinels."""

    seed: int = 7
    cut_percent: int = 100
    spm_percent: int = 50
    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(
                m[:1] == b"" or m[:1] in n[1:] for m in marks for n in marks):
            # then a sentinel can only be found where one was put
            raise ValueError("sentinels must differ and start with a byte that ends none of them")

    def draws(self, key: str) -> tuple[int, int, int, int]:
        """Four unsigned numbers for the text with this id."""
        return struct.unpack(">4I", hashlib.sha256(f"{self.seed}:{key}".encode()).digest()[:16])

    def plan(self, text: bytes, key: str) -> tuple[int, str, int, int]:
        """Number of lines, form, and where prefix and middle end."""
        ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
        if len(text) and (not len(ends) or ends[-1] != len(text)):
            ends = np.append(ends, len(text))
        n = len(ends)
        a, b, cut, way = self.draws(key)
        if (not text or cut % 100 >= self.cut_percent
                or any(m in text for m in (self.prefix, self.suffix, self.middle))):
            return n, PLAIN, 0, 0
        low, high = sorted((a % (n + 1), b % (n + 1)))
        at = np.append(0, ends)
        return n, SPM if way % 100 < self.spm_percent else PSM, int(at[low]), int(at[high])

    def arranged(self, text: bytes, form: str, first: int, second: int) -> bytearray:
        """The text in its form; ``first`` and ``second`` are the ends of prefix and middle."""
        line = bytearray(text)
        if form == PLAIN:
            return line
        line[second:second] = self.suffix    # from the right, so the places on the left hold
        line[first:first] = self.middle
        line[0:0] = self.prefix
        second += len(self.prefix) + len(self.middle)
        exchange(line, 0 if form == SPM else first + len(self.prefix), second, len(line))
        return line

    def restored(self, output: bytes, form: str) -> bytearray:
        """The text that was arranged."""
        line = bytearray(output)
        if form == PLAIN:
            return line
        if form == SPM:
            exchange(line, 0, line.index(self.prefix), len(line))
        else:
            exchange(line, line.index(self.suffix), line.index(self.middle), len(line))
        for mark in (self.suffix, self.middle, self.prefix):
            at = line.index(mark)
            del line[at:at + len(mark)]
        return line


def exchange(line: bytearray, a: int, b: int, c: int) -> None:
    """Exchange the neighbours line[a:b] and line[b:c] by reversing both, then their whole."""
    view = np.frombuffer(line, np.uint8)
    for low, high in ((a, b), (b, c), (a, c)):
        view[low:high] = view[low:high][::-1]


def characters(text: bytes) -> int:
    """Code points of a part of a UTF-8 text."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _key(doc_id) -> str:
    return "" if doc_id is None else str(doc_id)


def fill_in_middle(docs: DataFrame, how: Infill = Infill(), verify: bool = False) -> DataFrame:
    """All rows: the columns but the text, n (lines), form, prefix_chars, middle_chars, output.

    With ``verify`` every output is turned back, and ``restored_sha256`` is the digest of the
    text that came out.
    """
    own = RESULT + (["restored_sha256"] if verify else [])
    keep = [c for c in docs.columns if c not in (*own, "text")]
    kinds = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(),
             "middle_chars": T.LongType(), "output": T.StringType(),
             "restored_sha256": T.StringType()}
    schema = T.StructType([docs.schema[c] for c in keep]
                          + [T.StructField(c, kinds[c]) for c in own])

    def arrange(batches):
        for batch in batches:
            at = batch.schema.get_field_index("doc_id")
            for rows, texts in blocks(batch, "text"):
                found = {c: [] for c in own}
                for doc_id, text in zip(rows.column(at).to_pylist(),
                                        texts.cast(pa.large_binary()).to_pylist()):
                    n, form, first, second = how.plan(text, _key(doc_id))
                    output = bytes(how.arranged(text, form, first, second))
                    found["n"].append(n)
                    found["form"].append(form)
                    cut = form != PLAIN
                    found["prefix_chars"].append(characters(text[:first]) if cut else None)
                    found["middle_chars"].append(characters(text[first:second]) if cut else None)
                    found["output"].append(output)
                    if verify:
                        found["restored_sha256"].append(
                            hashlib.sha256(how.restored(output, form)).hexdigest())
                columns = {"n": pa.int64(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(rows.schema.get_field_index(c)) for c in keep),
                     *(_strings(v) if c == "output" else pa.array(v, columns.get(c, pa.string()))
                       for c, v in found.items())], names=[*keep, *own])

    return docs.select(*dict.fromkeys([*keep, "doc_id", "text"])).mapInArrow(arrange, schema)


def restore(rows: DataFrame, how: Infill = Infill()) -> DataFrame:
    """The way back: ``output`` and ``form`` become ``text`` again, the other columns stay."""
    keep = [c for c in rows.columns if c not in (*RESULT, "text")]
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("text", T.StringType())])

    def back(batches):
        for batch in batches:
            at = batch.schema.get_field_index("form")
            for part, outputs in blocks(batch, "output"):
                texts = [bytes(how.restored(o, f)) for o, f in zip(
                    outputs.cast(pa.large_binary()).to_pylist(), part.column(at).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in keep),
                     _strings(texts)], names=[*keep, "text"])

    return rows.select(*keep, "form", "output").mapInArrow(back, schema)


# The same rows by SQL: lines as a list, parts as slices of it, digests of their concatenations.
ORACLE_SQL = r"""
WITH cut AS (
    SELECT doc_id, coalesce("text", '') AS body,
        regexp_extract_all(coalesce("text", ''), '[^\n]*\n|[^\n]+') AS lines,
        sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS draw
    FROM documents),
numbered AS (
    SELECT doc_id, body, lines, len(lines) AS n,
        ('0x' || substr(draw, 1, 8))::UBIGINT AS h1, ('0x' || substr(draw, 9, 8))::UBIGINT AS h2,
        ('0x' || substr(draw, 17, 8))::UBIGINT AS h3, ('0x' || substr(draw, 25, 8))::UBIGINT AS h4
    FROM cut),
placed AS (
    SELECT doc_id, body, lines, n,
        least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS low,
        greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS high,
        CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>')
            OR contains(body, '<M>') OR h3 % 100 >= 100 THEN 'plain'
            WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM numbered),
parts AS (
    SELECT doc_id, body, n, form,
        coalesce(array_to_string(lines[1:low], ''), '') AS prefix,
        coalesce(array_to_string(lines[low + 1:high], ''), '') AS middle,
        coalesce(array_to_string(lines[high + 1:n], ''), '') AS suffix
    FROM placed)
SELECT doc_id, n::BIGINT AS n, form,
    CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN body
        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN body ELSE prefix || middle || suffix END)
        AS restored_sha256
FROM parts
"""
