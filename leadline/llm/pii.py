"""Personal data by anchors: one automaton pass, then small parsers around each hit.

An Aho-Corasick automaton finds digits, at-signs, plus signs, ``://`` and cue words. From
each anchor a deterministic parser walks to the boundaries and validates: mail addresses,
IP addresses, card numbers (Luhn) and phone numbers follow fixed forms; further kinds, which
only add spans, are web addresses, bank accounts (IBAN with its check digits), account
numbers behind a cue, and secrets (assigned passwords, tokens and keys).

Parsers never walk over the same characters twice for one kind, so work is linear in the
text. Matches of one kind do not overlap, the leftmost first; candidates that fail
validation are dropped and not tried again in part. Marks of the redaction, such as
``<SECRET>``, are not personal data themselves.

Defined cases: a null text counts as empty and has no spans; redaction leaves it null.
Repeated rows and extra columns do not matter: one row out for each row in.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from leadline.llm.text import blocks

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("url", "iban", "account", "secret")
# The cues, found in lower case, capitalised and in upper case.
ACCOUNT_CUES = ("account", "acct", "routing", "ssn")
SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PHONE_BODY = re.compile(r"[0-9][\x20().0-9-]+")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
WEB_BODY = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?")
IBAN_BODY = re.compile(r"[\s:]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
ACCOUNT_BODY = re.compile(r"\s{0,3}(?:(?:number|no\.?|num|#)\s{0,3})?[:=#]?\s{0,3}([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])")
# A secret is more than the marks that stand for spans already taken out.
MARKS = "(?:<(?:%s)>)+" % "|".join(k.upper() for k in BASE_KINDS + MORE_KINDS)
SECRET_BODY = re.compile(
    r"\s{0,3}[:=]\s{0,3}[\"']?(?!" + MARKS + r"(?:[\s\"',;]|\Z))([^\s\"',;]{6,})")
KEY_BODY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Z])")


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in DIGITS:
        found.add_word(digit, ("digit", digit))
    for mark, kind in (("@", "email"), ("+", "phone"), ("://", "url"), ("AKIA", "key")):
        found.add_word(mark, (kind, mark))
    for kind, cues in (("iban", ("iban",)), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in (cue, cue.capitalize(), cue.upper()):
                found.add_word(form, (kind, form))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def chains(groups: list[tuple[int, int]], text: str, joins: str) -> list[list[tuple[int, int]]]:
    """Groups of digits that only one of ``joins`` keeps apart, as long as possible."""
    found: list[list[tuple[int, int]]] = []
    for group in groups:
        if found and group[0] == found[-1][-1][1] + 1 and text[group[0] - 1] in joins:
            found[-1].append(group)
        else:
            found.append([group])
    return found


def emails(text: str, at_signs: list[int]) -> list[tuple[int, int]]:
    found, floor = [], 0
    for at in at_signs:
        domain = DOMAIN.match(text, at + 1)
        start = at
        while domain and start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            found.append((start, domain.end()))
            floor = domain.end()
    return found


def addresses(text: str, groups: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found = []
    for chain in chains(groups, text, "."):
        for k in range(0, len(chain) - 3, 4):
            part = chain[k:k + 4]
            if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b][-6:]) <= 255
                   for a, b in part):
                found.append((part[0][0], part[3][1]))
    return found


def cards(text: str, groups: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found = []
    for chain in chains(groups, text, " -"):
        if 13 <= sum(b - a for a, b in chain) <= 19 and luhn(
                "".join(text[a:b] for a, b in chain)):
            found.append((chain[0][0], chain[-1][1]))
    return found


def phones(text: str, plus: list[int]) -> list[tuple[int, int]]:
    found = []
    for at in plus:
        body = PHONE_BODY.match(text, at + 1)
        if body:
            said = body.group().rstrip(" ().-")
            if len(said) >= 3 and 9 <= sum(c in DIGITS for c in said) <= 15:
                found.append((at, at + 1 + len(said)))
    return found


def urls(text: str, marks: list[int]) -> list[tuple[int, int]]:
    found, floor = [], 0
    for at in marks:
        body = WEB_BODY.match(text, at + 3) if at >= floor else None
        start = at
        while body and start > floor and at - start < 32 and text[start - 1] in SCHEME:
            start -= 1
        while start < at and not text[start].isalpha():
            start += 1
        if start < at:
            floor = at + 3 + len(body.group().rstrip(".,;:!?)"))
            found.append((start, floor))
    return found


def valid_iban(said: str) -> bool:
    plain = said.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def behind(text: str, ends: list[int], body: re.Pattern, kind: str) -> list[tuple[int, int]]:
    """What stands behind a cue in the given form."""
    found, floor = [], 0
    for end in ends:
        said = body.match(text, end) if end >= floor else None
        if said is None:
            continue
        start, stop = said.span(1)
        if kind == "iban":  # groups behind the number may be words: the longest valid form
            while stop - start >= 15 and not valid_iban(text[start:stop]):
                stop -= 1
            if stop - start < 15 or text[stop - 1] == " ":
                continue
        found.append((start, stop))
        floor = stop
    return found


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text: base kinds first, each kind in the order of the text."""
    marks: dict[str, list[int]] = {k: [] for k in (
        "email", "phone", "url", "key", "iban", "account", "secret")}
    groups: list[tuple[int, int]] = []
    for last, (kind, mark) in automaton().iter(text):
        if kind == "digit":
            if groups and groups[-1][1] == last:
                groups[-1] = groups[-1][0], last + 1
            else:
                groups.append((last, last + 1))
        elif kind in ("iban", "account", "secret"):
            marks[kind].append(last + 1)
        else:
            marks[kind].append(last + 1 - len(mark))
    found = [("email", emails(text, marks["email"])), ("ip", addresses(text, groups)),
             ("card", cards(text, groups)), ("phone", phones(text, marks["phone"])),
             ("url", urls(text, marks["url"])),
             ("iban", behind(text, marks["iban"], IBAN_BODY, "iban")),
             ("account", behind(text, marks["account"], ACCOUNT_BODY, "account")),
             ("secret", sorted(behind(text, marks["secret"], SECRET_BODY, "secret") + [
                 m.span() for m in (KEY_BODY.match(text, at) for at in marks["key"]) if m]))]
    return [(kind, a, b) for kind, spans in found for a, b in spans]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def redacted(text: str) -> str:
    """The text with a mark in place of each span; spans that overlap share one mark.

    Repeated until nothing is found, since taking a span out can join what stood around it.
    This ends: a mark lies in a span as a whole or not at all, and every span holds characters
    outside of marks, so each round leaves fewer of those.
    """
    while spans := sorted((a, b, kind) for kind, a, b in find(text)):
        parts, at = [], 0
        for a, b, kind in spans:
            if a >= at:
                parts += [text[at:a], f"<{kind.upper()}>"]
            at = max(at, b)
        text = "".join(parts) + text[at:]
    return text


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every document."""

    def search(batches):
        for batch in batches:
            for rows, texts in blocks(batch, "text"):
                found = [find(t) for t in texts.to_pylist()]
                counts = [pa.array([sum(s[0] == kind for s in spans) for spans in found],
                                   pa.int64()) for kind in BASE_KINDS]
                digests = [hashlib.sha256(written([s for s in spans if s[0] in BASE_KINDS])
                                          .encode()).hexdigest() for spans in found]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *counts, pa.array(digests, pa.string()),
                     pa.array([written(s) for s in found], pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        search, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                "base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns; marks stand in the texts, and n_chars follows where they do."""

    def clean(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            size = batch.schema.get_field_index("n_chars")
            for rows, _ in blocks(batch, "text", 1 << 19):   # all columns come along
                before = rows.column(at).to_pylist()
                after = [t if t is None else redacted(t) for t in before]
                columns = list(rows.columns)
                columns[at] = pa.array(after, columns[at].type)
                if size >= 0:
                    columns[size] = pa.array(
                        [n if a == b else len(b) for n, a, b in zip(
                            columns[size].to_pylist(), before, after)], columns[size].type)
                yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names)

    return docs.mapInArrow(clean, docs.schema)
