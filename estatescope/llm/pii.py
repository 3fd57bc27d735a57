"""Personal data (1): an automaton finds anchors, small parsers expand and validate them.

One Aho-Corasick pass over the text gives the places where personal data can be: at-signs, schemes,
identifier cues, plus signs and digits.  From each, a parser for its kind expands to the boundaries
and validates (address parts, check digits, lengths).  Each parser moves a mark past what it has read,
so that the work grows with the text and not with its square.

Kinds: ``email``, ``ip``, ``card``, ``phone`` (the base kinds: leftmost, non-overlapping per kind, what
fails validation is dropped); added by cues: ``address`` (a link that carries a user name, or a
``mailto:``/``tel:``/``sip:`` address) and ``account`` (an IBAN that passes its check, or the number that
follows an account cue).

Null and empty texts have no spans.  Texts are scanned whole, repeated rows each by themselves; an
empty table gives an empty table; only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from estatescope.llm.registry import query, read
from estatescope.llm.secrets import Span, count_of, joined_spans
from estatescope.llm.texts import pieces

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "address", "account"]

# What a part of each kind is made of, and the cues.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
AUTHORITY = re.compile(r"[^\s/?#<>\"'@]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?")
HANDLE = re.compile(r"[A-Za-z0-9._%+@-]*[A-Za-z0-9]")
IBAN = re.compile(r"[:\x20]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
NUMBER = re.compile(r"(?:\x20?(?:no\.?|number|nr\.?))?[:#\x20]{1,3}([0-9](?:[\x20-]?[0-9]){5,16})", re.I | re.A)
SCHEME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
HANDLE_SCHEMES = ["mailto:", "tel:", "sip:"]
ACCOUNT_CUES = ["account", "acct", "ssn", "konto", "compte", "cuenta"]
IBAN_CUE = "iban"


@cache
def anchors():
    """The automaton over all anchors; cues in lower case, upper case and capitalised."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    entries = {"@": "at", "+": "plus", "://": "scheme"}
    entries |= {str(d): "digit" for d in range(10)}
    for kind, cues in (("handle", HANDLE_SCHEMES), ("account", ACCOUNT_CUES), ("iban", [IBAN_CUE])):
        entries |= {form: kind for c in cues for form in (c, c.upper(), c.capitalize())}
    for word, kind in entries.items():
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def luhn(number: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(number)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban_valid(number: str) -> bool:
    moved = number[4:] + number[:4]
    return 15 <= len(number) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


class Parsers:
    """The parsers of one text; each keeps the mark up to which it has read."""

    def __init__(self, text: str):
        self.text, self.found = text, []
        self.email_end = self.ip_end = self.run_end = self.card_end = self.link_end = 0

    def at(self, p: int) -> None:
        start = p
        while start > self.email_end and self.text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(self.text, p + 1) if start < p else None
        if domain:
            self.email_end = domain.end()
            self.found.append(("email", start, domain.end()))

    def digit(self, p: int) -> None:
        if p >= self.card_end:
            m = CARD.match(self.text, p)
            self.card_end = m.end() if m else p + 1
            number = re.sub("[^0-9]", "", m.group()) if m and m.end() - p < 40 else ""
            if 12 <= len(number) <= 19 and luhn(number):
                self.found.append(("card", p, m.end()))
        if p >= self.run_end:
            self.run_end = DIGITS.match(self.text, p).end()
            m = DOTTED.match(self.text, p) if p >= self.ip_end else None
            if m:
                self.ip_end = m.end()
                parts = [x.lstrip("0") for x in m.group().split(".")]
                if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
                    self.found.append(("ip", p, m.end()))

    def plus(self, p: int) -> None:
        m = PHONE.match(self.text, p)
        if m and 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            self.found.append(("phone", p, m.end()))

    def scheme(self, p: int) -> None:
        start = p
        while start > self.link_end and self.text[start - 1] in SCHEME_CHARS:
            start -= 1
        m = AUTHORITY.match(self.text, p + 3) if start < p else None
        if m:
            end = p + 3 + len(self.text[p + 3:m.end()].rstrip(".,;:!?)]}"))
            self.link_end = end
            self.found.append(("address", start, end))

    def handle(self, p: int) -> None:
        m = HANDLE.match(self.text, self.text.index(":", p) + 1)
        if m and p >= self.link_end and not self._inside_word(p):
            self.link_end = m.end()
            self.found.append(("address", p, m.end()))

    def account(self, p: int, length: int) -> None:
        m = None if self._inside_word(p) else NUMBER.match(self.text, p + length)
        if m:
            self.found.append(("account", m.start(1), m.end(1)))

    def iban(self, p: int) -> None:
        m = None if self._inside_word(p) else IBAN.match(self.text, p + len(IBAN_CUE))
        number = m.group(1) if m else ""
        while number:  # the shape may run into the next words: give them up one by one
            if iban_valid(number.replace(" ", "")):
                self.found.append(("account", m.start(1), m.start(1) + len(number)))
                return
            number = number.rpartition(" ")[0]

    def _inside_word(self, p: int) -> bool:
        return p > 0 and self.text[p - 1].isalnum()


def spans_in(text: str) -> list[Span]:
    """All spans by start and kind."""
    parse = Parsers(text)
    for last, (kind, length) in anchors().iter(text):
        first = last - length + 1
        if kind == "account":
            parse.account(first, length)
        else:
            getattr(parse, kind)(first)
    return sorted(parse.found, key=lambda x: (x[1], KINDS.index(x[0])))


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>): code points, end exclusive."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_in(t)] if t else []
                     for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(found, span_type)], ["doc_id", "spans"])

    return rows.mapInArrow(
        scan, f"doc_id {key}, spans array<struct<kind:string,start:bigint,end:bigint>>")


@query("op1_pii")
def op1_pii(spark: SparkSession, path: str) -> DataFrame:
    found = find_pii(read(spark, path, "documents"))
    return found.select(
        "doc_id", *[count_of("spans", k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined_spans("spans", BASE), 256).alias("base_sha256"),
        joined_spans("spans").alias("spans"),
        count_of("spans", "address").alias("n_address"),
        count_of("spans", "account").alias("n_account"))
