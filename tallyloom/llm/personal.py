"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words move the score.

The four base kinds (``email``, ``ip``, ``card``, ``phone``) are always reported when their check holds. The further
kinds are reported from a score of ``THRESHOLD`` on and only where they do not overlap a base span:
``iban`` needs mod-97, ``national_phone`` and ``national_id`` need a context word close by. Context words are whole words (or
their plurals); ``COUNTER`` words, which name other numbers, lower the score.

All scans are linear in the text, also on long runs of digits or of letters without an ``@``.
Offsets are code points, ends exclusive.

Edge cases: a null text counts as empty and has no span; equal rows get equal spans; an empty table
gives an empty result; an input column named like an added one is replaced.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.arrow import small_batches

KINDS = ("email", "ip", "card", "phone", "iban", "national_phone", "national_id")
BASE = KINDS[:4]
THRESHOLD = 0.5
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.35

#: Score of a proposal without context, and the words that raise it.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "national_phone": 0.3, "national_id": 0.3}
CONTEXT = {
    "email": ("mail", "email", "contact", "correo", "courriel"),
    "ip": ("ip", "server", "host", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "telephone", "call", "calling", "tel", "mobile", "cell", "fax", "telefon", "telefono", "handy"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "national_phone": ("phone", "telephone", "call", "calling", "tel", "mobile", "cell", "fax", "telefon", "telefono", "handy"),
    "national_id": ("ssn", "social security", "tax id", "national id", "passport"),
}
COUNTER = {
    "email": (),
    "ip": ("version", "release", "section", "chapter"),
    "card": ("isbn", "order", "tracking", "serial"),
    "phone": ("isbn", "order", "invoice", "serial"),
    "iban": (),
    "national_phone": ("isbn", "order", "invoice", "serial", "part"),
    "national_id": ("isbn", "order", "invoice", "serial", "part"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b")
_NATIONAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile("[^0-9]+")

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()),
                  ("base", pa.bool_())])
SPANS_TYPE = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"


def luhn(digits: str) -> bool:
    """The last digit makes the weighted digit sum a multiple of ten."""
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The rearranged account number, letters as 10 to 35, leaves 1 when divided by 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """A proposal may run into the next word in capitals: the longest part that ends with a group and
    fulfils the checksum counts."""
    for m in _IBAN.finditer(text):
        words, size = m[0].split(" "), len(m[0])
        while words:
            if 15 <= len(plain := "".join(words)) <= 34 and mod97(plain):
                yield m.start(), m.start() + size
                break
            size -= len(words.pop()) + 1


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose check holds."""
    for s, e in _emails(text):
        yield "email", s, e
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for s, e in _ibans(text):
        yield "iban", s, e
    for m in _NATIONAL_PHONE.finditer(text):
        yield "national_phone", m.start(), m.end()
    for m in _NATIONAL_ID.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "national_id", m.start(), m.end()


def _words(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"\b(?:{'|'.join(map(re.escape, words))})s?\b" if words else r"(?!)")


_RAISES, _LOWERS = ({kind: _words(words) for kind, words in table.items()} for table in (CONTEXT, COUNTER))


def _score(text: str, kind: str, start: int, end: int) -> float:
    """A word that the window cuts is no context."""
    left, right = max(0, start - CONTEXT_CHARS), end + CONTEXT_CHARS
    before, after = text[left:start], text[end:right]
    if left and text[left - 1].isalnum():
        before = re.sub(r"^\w+", "", before)
    if right < len(text) and text[right].isalnum():
        after = re.sub(r"\w+$", "", after)
    near = f"{before} {after}".lower()
    score = BASE_SCORE[kind] + CONTEXT_GAIN * (bool(_RAISES[kind].search(near)) - bool(_LOWERS[kind].search(near)))
    return min(1.0, max(0.0, score))


def find_spans(text: str) -> list[dict]:
    """Spans of one text by start, then kind in the order of ``KINDS``."""
    found, covered = [], []
    for kind, s, e in _proposals(text):
        base, score = kind in BASE, _score(text, kind, s, e)
        if base:
            covered.append((s, e))
        elif score < THRESHOLD or any(s < b and a < e for a, b in covered):
            continue
        found.append({"kind": kind, "start": s, "end": e, "score": score, "base": base})
    return sorted(found, key=lambda x: (x["start"], KINDS.index(x["kind"])))


def _spans(texts: pa.Array) -> pa.Array:
    return pa.array([find_spans(t.as_py() or "") if t.is_valid else [] for t in texts], pa.list_(SPAN))


def find_personal(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: kind, start, end, score and whether a base rule found it."""
    small_batches(docs.sparkSession)
    return docs.withColumn("spans", F.arrow_udf(_spans, SPANS_TYPE)(F.col(text)))


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` (of ``find_personal``) with ``redacted``: every span replaced by its kind in angle
    brackets; of overlapping spans the first names the replacement."""
    t = F.coalesce(F.col(text), F.lit(""))
    folded = F.aggregate(
        "spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at")))
        .otherwise(F.struct(F.concat(a["out"], F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"],
                                     F.lit(">")).alias("out"), s["end"].alias("at"))),
        lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    return found.withColumn("redacted", folded)
