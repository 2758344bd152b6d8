"""Personal data, found in the text as written and behind disguises.

Four base patterns run on the text itself. A chain of transducers then rewrites
disguises (look-alike and full-width characters, letters among digits, invisible
characters, spelled digits, at/dot words and brackets) into plain ASCII, keeping for each character of
the rewritten text the source characters that it stands for. The same detectors
run on the rewritten text, and what they find is mapped back to source spans.
Spans that touch no rewritten character add nothing, nor do those that overlap a
base span without containing it and more.

Offsets are code points, end exclusive. Defined cases: a null text is the empty
text and has no spans; overlapping base spans of different kinds all stay; added
spans don't overlap each other (the longer, then the earlier one stays).
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

KINDS = ("email", "ip", "card", "phone")

Span = tuple[str, int, int]

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

#: Characters that look like Latin letters, with those letters.
LOOK_ALIKES = dict(
    zip(
        "абвгеікмнорѕтухьАВЕІКМНОРЅТУХЈјԁһԛԝɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυι",
        "a6brеikmhopstyxbABEIKMHOPSTYXJjdhqwgABEZHIKMNOPTYXavopui".replace("е", "e"),
        strict=True,
    )
)
INVISIBLE = frozenset("­​‌‍‎‏⁠﻿")
#: Digit words of English, German, French and Spanish, from zero to nine, and other forms.
DIGIT_WORDS = {
    word: str(k)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for k, word in enumerate(words.split())
} | {"oh": "0", "zwo": "2", "fuenf": "5", "une": "1"}
TIMES = {"double": 2, "triple": 3}
PLUS, POINT = ("plus", "más", "mas"), ("dot", "point", "punkt", "punto")
#: What the sign and the dot of an address are called.
AT_WORDS, DOT_WORDS = "at|ät|arroba|arobase|klammeraffe", "dot|punkt|punto|point"
#: Endings of domain names that a bare "dot", or a dot after a sign with spaces, must lead to,
#: beside any two letters that are no common English word.
ENDINGS = tuple(
    (
        "com org net edu gov mil int info biz name pro mobi jobs travel museum coop aero asia dev app xyz online site website store shop tech cloud email blog club news page live "
        "space world digital agency network systems software studio design media group team academy company consulting solutions services support work zone top link wiki art bank law"
    ).split()
)
NO_ENDINGS = ("an", "go", "he", "if", "of", "on", "or", "up", "we")



def any_of(words: Iterable[str]) -> str:
    """A pattern for any of the words, longer ones first, tried by their first letter."""
    by_letter: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        by_letter.setdefault(w[0], []).append(w[1:])
    return f"(?=[{''.join(by_letter)}])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + ")"


NUMBER = any_of(DIGIT_WORDS)
SPELLED = re.compile(rf"\b(?:(?:{'|'.join(PLUS)})[\s,-]+)?(?:(?:double|triple)\s+)?{NUMBER}\b(?:[\s,.()-]{{1,3}}(?:(?:{'|'.join(POINT)})\s+)?(?:(?:double|triple)\s+)?(?:{NUMBER}\b|[0-9]+\b)){{3,}}", re.I)
SPELLED_PART = re.compile(rf"(?:{'|'.join(PLUS)}|double|triple|{'|'.join(POINT)}|{NUMBER})\b|[0-9]+", re.I)
OPEN, CLOSE = r"[\[({<]", r"[\])}>]"
AT_SIGN = re.compile(rf"(?<=[A-Za-z0-9])\s{{0,2}}{OPEN}\s{{0,2}}(?:{AT_WORDS}|@)\s{{0,2}}{CLOSE}\s{{0,2}}(?=[A-Za-z0-9])", re.I)
DOT_SIGN = re.compile(rf"(?<=[A-Za-z0-9])\s{{0,2}}{OPEN}\s{{0,2}}(?:{DOT_WORDS}|\.)\s{{0,2}}{CLOSE}\s{{0,2}}(?=[A-Za-z0-9])", re.I)
PART = r"[A-Za-z0-9_-]{1,63}"
ENDING = rf"(?:{'|'.join(ENDINGS)}|(?!(?:{'|'.join(NO_ENDINGS)})\b)[A-Za-z]{{2}})"
LABELS = rf"{PART}(?:(?:\s{{1,2}}dot\s{{1,2}}|\.){PART}){{0,3}}"
#: Addresses in words: "at" goes with "dot" only, other names of the sign with any name of the dot.
OTHER_AT = "arroba|arobase|klammeraffe"
OTHER_LABELS = rf"{PART}(?:(?:\s{{1,2}}(?:{DOT_WORDS})\s{{1,2}}|\.){PART}){{0,3}}"
BARE = re.compile(
    rf"(?<![A-Za-z0-9._%+@-])(?:{PART}(?:\.|\s+(?:dot|punkt|punto)\s+)){{0,3}}{PART}"
    rf"(?:(\s{{1,2}}at\s{{1,2}}|\s?@\s?){LABELS}\s{{1,2}}dot\s{{1,2}}{ENDING}|(\s{{1,2}}@\s{{0,2}}|@\s{{1,2}}){LABELS}\.{ENDING}"
    rf"|(\s{{1,2}}(?:{OTHER_AT})\s{{1,2}}){OTHER_LABELS}(?:\s{{1,2}}(?:{DOT_WORDS})\s{{1,2}}|\.){ENDING})\b",
    re.I,
)
SPACED = re.compile(r"\s@|@\s")
BARE_WORDS = re.compile(r"\b(?:the|a|an|this|that|its|their|our|your)\s{1,2}dot\s", re.I)
BARE_DOT = re.compile(rf"\s{{1,2}}(?:{DOT_WORDS})\s{{1,2}}", re.I)
OTHER_SIGN = re.compile(rf"\s(?:{OTHER_AT})\s", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the leftmost matches of one or more local characters, @, and two or more labels."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        at = text.find("@", at + 1)


def detect(text: str) -> list[Span]:
    """The base spans, by start, then kind."""
    found: list[tuple[int, int, int]] = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.findall(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


class Tape:
    """A text with, for each of its characters, the source span it stands for and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))
        self.new = bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """A transducer's output: replaces each ``[start, end)`` by a string; edits are in order and disjoint."""
        if not edits:
            return self
        out = Tape("")
        text, at, new = [], 0, bytearray()
        for s, e, by in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:s])
            out.start += self.start[at:s]
            out.end += self.end[at:s]
            new += self.new[at:s]
            if by:
                text.append(by)
                out.start += [self.start[s]] * len(by)
                out.end += [self.end[e - 1]] * len(by)
                new += b"\1" * len(by)
            elif e > s and new:
                new[-1] = 1  # what is left out counts for its neighbour
            at = e
        out.text, out.new = "".join(text), new
        return out

    def source(self, s: int, e: int) -> tuple[int, int] | None:
        """Source span of ``[s, e)`` if any of it was rewritten."""
        return (min(self.start[s:e]), max(self.end[s:e])) if any(self.new[s:e]) else None


def fold_characters(text: str) -> list[tuple[int, int, str]]:
    """Edits for look-alikes, full-width forms, other scripts' digits and invisible characters."""
    edits = []
    for i, c in enumerate(text):
        if c < "­":
            continue
        if c in INVISIBLE:
            edits.append((i, i + 1, ""))
        elif "！" <= c <= "～":
            edits.append((i, i + 1, chr(ord(c) - 0xFEE0)))
        elif c in LOOK_ALIKES:
            edits.append((i, i + 1, LOOK_ALIKES[c]))
        elif (d := unicodedata.digit(c, -1)) >= 0:
            edits.append((i, i + 1, str(d)))
    return edits


def fold_bare(text: str) -> list[tuple[int, int, str]]:
    """Edits for addresses written with the words at and dot, or with spaces around the sign."""
    edits = []
    for m in BARE.finditer(text):
        if BARE_WORDS.search(m[0]):
            continue
        s, e = m.span(m.lastindex)
        edits.append((s, e, "@"))
        for part in BARE_DOT.finditer(text, m.start(), m.end()):
            if part.start() >= e or part.end() <= s:
                edits.append((*part.span(), "."))
    return sorted(edits)


def fold_spelled(text: str) -> list[tuple[int, int, str]]:
    """Edits for runs of four or more digit words; a run of 9 to 15 digits reads as a telephone number."""
    edits = []
    for m in SPELLED.finditer(text):
        out, times = "", 1
        for word in SPELLED_PART.findall(m[0].lower()):
            if word in TIMES:
                times = TIMES[word]
                continue
            if word in PLUS:
                out += "+"
            elif word in POINT:
                out += "."
            else:
                out += DIGIT_WORDS.get(word, word) * times
            times = 1
        if "." not in out and out[0] != "+" and 9 <= len(out) <= 15 and not (len(out) >= 12 and luhn(out)):
            before = text[m.start() - 1] if m.start() else ""
            out = out if before == "+" else "+" + out
        edits.append((*m.span(), out))
    return edits


#: Letters that stand in for digits.
DIGIT_LETTERS = {"O": "0", "o": "0", "l": "1", "I": "1"}
MIXED = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OolI](?:[ .()-]{0,2}[0-9OolI]){6,}(?![A-Za-z0-9])")


def fold_letters(text: str) -> list[tuple[int, int, str]]:
    """Edits for letters among digits, in runs of which two thirds or more are digits."""
    edits = []
    for m in MIXED.finditer(text):
        marks = [i for i in range(m.start(), m.end()) if text[i] in DIGIT_LETTERS]
        if marks and len(DIGITS.findall(m[0])) >= 2 * len(marks):
            edits += [(i, i + 1, DIGIT_LETTERS[text[i]]) for i in marks]
    return edits


DISGUISES = (
    (lambda t: not t.isascii(), fold_characters),
    (lambda t: AT_SIGN.search(t) is not None or DOT_SIGN.search(t) is not None, lambda t: sorted([(*m.span(), "@") for m in AT_SIGN.finditer(t)] + [(*m.span(), ".") for m in DOT_SIGN.finditer(t)])),
    (lambda t: "dot" in t.lower() or SPACED.search(t) is not None or OTHER_SIGN.search(t) is not None, fold_bare),
    (lambda t: True, fold_spelled),
    (lambda t: True, fold_letters),
)

#: A text in which none of these occurs has no disguise. A match of MIXED with a letter and a digit
#: has the two side by side, and the letter's run of letters and digits is of MIXED's characters only.
HINTS = re.compile(rf"[^\x00-\xff]|[\xad\xb2\xb3\xb9]|{OPEN}\s{{0,2}}(?:{AT_WORDS}|@|{DOT_WORDS}|\.)\s{{0,2}}{CLOSE}|\s(?:dot|{OTHER_AT})\s|\s@|@\s|(?-i:[0-9][ .()-]{{0,2}}[OolI][0-9OolI]*(?![A-Za-z0-9])|(?<![A-Za-z0-9])[0-9OolI]*[OolI][ .()-]{{0,2}}[0-9])|\b{NUMBER}[\s,.()-]{{1,3}}(?:{NUMBER}|double|triple|{'|'.join(POINT)}|[0-9])", re.I)


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans of identifiers that only the rewritten text shows."""
    if not HINTS.search(text):
        return []
    tape = Tape(text)
    for may, edits in DISGUISES:
        if may(tape.text):
            tape = tape.rewrite(edits(tape.text))
    if not any(tape.new):
        return []
    found = [(kind, *span) for kind, s, e in detect(tape.text) if (span := tape.source(s, e))]
    kept: list[Span] = []
    for kind, s, e in sorted(found, key=lambda x: (x[1] - x[2], x[1], KINDS.index(x[0]))):
        apart = all(e <= s2 or e2 <= s or (s <= s2 and e2 <= e and e2 - s2 < e - s) for _, s2, e2 in base)
        if apart and all(e <= s2 or e2 <= s for _, s2, e2 in kept):
            kept.append((kind, s, e))
    return kept


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts, ``base`` and ``spans`` as text, and the redacted text, for every whole text."""
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in common.slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = detect(text)
                spans = base + disguised(text, base)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, joined(base), joined(spans), len(spans) - len(base), redact(text, spans) if spans else text))
            columns = [batch.column(0)]
            for values, kind in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.string()], strict=True):
                columns.append(pa.array(values, kind))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_disguised", "redacted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_disguised long, redacted string")


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind; ``n_chars`` follows the new text.

    All other columns pass through unchanged; a null text stays null.
    """
    common.ship(docs.sparkSession)
    schema = docs.schema
    at = schema.fieldNames().index("text")
    recount = schema.fieldNames().index("n_chars") if "n_chars" in schema.fieldNames() else None

    def run(batches):
        for batch in common.slices(batches):
            columns = list(batch.columns)
            texts = []
            for text in columns[at].to_pylist():
                if text:
                    base = detect(text)
                    spans = base + disguised(text, base)
                    text = redact(text, spans) if spans else text
                texts.append(text)
            columns[at] = pa.array(texts, pa.string())
            if recount is not None:
                columns[recount] = pa.array([None if t is None else len(t) for t in texts], columns[recount].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, schema)
