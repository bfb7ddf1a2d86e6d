"""Personal data with offset-preserving deobfuscation.

The base detectors run on the text as it is. Then transducers rewrite disguises (homoglyphs, at/dot words and brackets,
spelled digits) while keeping, for each character of the result, the source character it stands for; the same detectors
run on the rewritten text and what they find is mapped back. Spans that touch no base span are added.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.runtime import document_columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_LONG_DIGITS = re.compile(r"[0-9][0-9 -]{11}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Characters drawn like ASCII ones (Cyrillic, Greek), and typographic signs.
_LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅοαεικνρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․。‐‑‒–—−∙", "aeopcyxijsdhqwABEKMHOPCTYXIJSoaeiknptuxABEZHIKMNOPTYX..------."))
_INVISIBLE = "​‌‍⁠﻿­"
# Digits spelled in English, German, French and Spanish.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_HOMOGLYPHS = {ord(a): b for a, b in _LOOKALIKES.items()} | {0xFF01 + i: chr(0x21 + i) for i in range(94)} | {c: " " for c in (0xA0, 0x202F, 0x2009, 0x3000)}
_HAS_HOMOGLYPH = re.compile("[" + "".join(map(re.escape, map(chr, _HOMOGLYPHS))) + _INVISIBLE + "]")
_DIGIT = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:plus[\s-]++)?(?:(?:{_DIGIT}|[0-9]++)[\s,.-]++){{6,}}(?:{_DIGIT}|[0-9]++)(?!\w)", re.I)
_SPELLED_ITEM = re.compile(rf"(plus|{_DIGIT})|[0-9]+", re.I)
# Endings of host names that make "at" and "dot" in plain words believable.
_TOP_LEVELS = frozenset("com org net edu gov mil int info biz io co ai app dev uk de fr es it eu us ca ch at nl be pl se jp cn in br ru".split())
#: Bounds of a disguised address: white space around a sign, a label, and the labels before the at.
_GAP, _LABEL, _LABELS = r"\s{0,16}+", r"[A-Za-z0-9-]{1,64}+", 5
_AT = re.compile(rf"[\[({{<]{_GAP}(?:at|@|arroba){_GAP}[\])}}>]|@|(?<=\s)(?:at|arroba)(?=\s)", re.I)
_DOT_SIGN = rf"(?:{_GAP}[\[({{<]{_GAP}(?:dot|punkt|point|punto|\.){_GAP}[\])}}>]{_GAP}|\s{{1,16}}+(?:dot|punkt|punto)\s{{1,16}}+|\.)"
#: The local part, read backwards from the at.
_TOD_SIGN = rf"(?:{_GAP}[\])}}>]{_GAP}(?:tod|tknup|tniop|otnup|\.){_GAP}[\[({{<]{_GAP}|\s{{1,16}}+(?:tod|tknup|otnup)\s{{1,16}}+|\.)"
_LACOL = re.compile(rf"{_LABEL}(?:(?:{_TOD_SIGN}|[_%+]){_LABEL}){{0,{_LABELS - 1}}}+(?![A-Za-z0-9])", re.I)
_HOST = re.compile(rf"{_LABEL}(?:{_DOT_SIGN}{_LABEL}){{1,4}}+(?![A-Za-z0-9])", re.I)
_REACH = _LABELS * (64 + 16 * 4 + 16)
_DOTS = re.compile(_DOT_SIGN, re.I)
_BRACKETED = re.compile(r"[\[({<]\s*(?:at|@|arroba|dot|punkt|point|punto|\.)\s*[\])}>]|\s(?:dot|punkt|punto)\s|\s@|@\s", re.I)
_IP_DISGUISED = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOT_SIGN}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from each @ outwards: a match holds one @, and its local part is the run before it."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """All base matches, by kind in the order of KINDS, then by start. Linear in the length of the text."""
    out = list(emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            out.append(("ip", *m.span()))
    if _LONG_DIGITS.search(text):
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = _digits(m.group())
                if 13 <= len(d) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


class Tape:
    """A text and, for each of its characters, the span of the source that it stands for."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text = text
        self.starts = np.arange(len(text)) if starts is None else starts
        self.ends = self.starts + 1 if ends is None else ends

    def rewrite(self, edits: list[tuple[int, int, str]]) -> "Tape":
        """Replace disjoint spans, in order; the characters of a replacement stand for the whole span it replaces."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for lo, hi, new in edits:
            text += [self.text[at:lo], new]
            starts += [self.starts[at:lo], np.full(len(new), self.starts[lo])]
            ends += [self.ends[at:lo], np.full(len(new), self.ends[hi - 1])]
            at = hi
        text.append(self.text[at:])
        starts.append(self.starts[at:])
        ends.append(self.ends[at:])
        return Tape("".join(text), np.concatenate(starts), np.concatenate(ends))

    def source(self, lo: int, hi: int) -> tuple[int, int]:
        return int(self.starts[lo]), int(self.ends[hi - 1])


def _homoglyphs(tape: Tape) -> Tape:
    plain = Tape(tape.text.translate(_HOMOGLYPHS), tape.starts, tape.ends)
    return plain.rewrite([(m.start(), m.end(), "") for m in re.finditer(f"[{_INVISIBLE}]+", plain.text)])


def _gap(text: str, at: int, step: int) -> int:
    """Where up to 16 characters of white space end that begin at ``at`` (``step`` 1) or end there (``step`` -1)."""
    stop = at + 16 * step
    while at != stop and 0 <= at + min(step, 0) < len(text) and text[at + min(step, 0)].isspace():
        at += step
    return at


def _disguised(text: str) -> Iterator[tuple[tuple[int, int], tuple[int, int], tuple[int, int]]]:
    """Spans of local part, at and host of what may be a disguised address. Each at is looked at once, and no further than
    a bounded number of characters to either side, so time is linear."""
    end = 0
    for m in _AT.finditer(text):
        lo, hi = _gap(text, m.start(), -1), _gap(text, m.end(), 1)
        local = _LACOL.match(text[max(end, lo - _REACH) : lo][::-1]) if lo > end else None
        host = _HOST.match(text, hi) if local else None
        if host:
            end = host.end()
            yield (lo - local.end(), lo), (lo, hi), host.span()


def _at_and_dot(tape: Tape) -> Tape:
    if not _BRACKETED.search(tape.text):
        return tape
    edits = []
    for local, at, host in _disguised(tape.text):
        domain = tape.text[slice(*host)]
        top = _DOTS.split(domain)[-1]
        plain_word = tape.text[slice(*at)].strip().lower() in ("at", "arroba")
        spoken = re.search(r"\s(?:dot|punkt|punto)\s|[\[({<]", domain, re.I)
        if not (2 <= len(top) <= 24 and top.isalpha()) or plain_word and not (spoken and top.lower() in _TOP_LEVELS):
            continue
        for lo, hi in (local, host):
            edits += [(lo + d.start(), lo + d.end(), ".") for d in _DOTS.finditer(tape.text[lo:hi])]
        edits.append((*at, "@"))
    for m in _IP_DISGUISED.finditer(tape.text):
        edits += [(m.start() + d.start(), m.start() + d.end(), ".") for d in _DOTS.finditer(m.group())]
    disjoint, end = [], 0
    for lo, hi, new in sorted(edits):
        if lo >= end:
            disjoint.append((lo, hi, new))
            end = hi
    return tape.rewrite(disjoint)


def _spelled_digits(tape: Tape) -> Tape:
    # All items of a run but its first and last stand between separators, and half of seven or more are words.
    words = tape.text.casefold().replace(",", " ").replace(".", " ").replace("-", " ").split()
    if sum(map(_DIGIT_WORDS.__contains__, words)) < 2:
        return tape
    edits = []
    for m in _SPELLED.finditer(tape.text):
        items = [x for x in _SPELLED_ITEM.finditer(m.group())]
        words = [x for x in items if x.group(1) and x.group(1).lower() != "plus"]
        if len(words) < 4 or 2 * len(words) < len(items):
            continue
        digits = [(_DIGIT_WORDS.get(x.group().lower(), "") if x.group(1) else x.group()) for x in items]
        plus, number = items[0].group().lower() == "plus", "".join(digits)
        card = 13 <= len(number) <= 19 and luhn(number)
        sign = "" if card else "+"  # a spelled number of a phone's length is a phone with or without its plus
        if not card and not 9 <= len(number) <= 15:
            continue
        if not plus and tape.text[max(0, m.start() - 1) : m.start()] == "+":
            sign = ""
        edits.append((m.start(), m.end(), sign + number))
    return tape.rewrite(edits)


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """What the detectors find only once disguises are rewritten, in source offsets."""
    tape = Tape(text)
    if not text.isascii() and _HAS_HOMOGLYPH.search(text):
        tape = _homoglyphs(tape)
    tape = _spelled_digits(_at_and_dot(tape))
    if tape.text == text:
        return []
    starts, ends = _merged(base)
    out = []
    for kind, lo, hi in base_spans(tape.text):
        s, e = tape.source(lo, hi)
        i = bisect_left(starts, e)  # the last base stretch that begins before the end
        if not i or ends[i - 1] <= s:
            out.append((kind, s, e))
    return out


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that the spans cover, in order."""
    starts, ends = [], []
    for lo, hi in sorted((s, e) for _, s, e in spans):
        if ends and lo < ends[-1]:
            ends[-1] = max(ends[-1], hi)
        else:
            starts.append(lo)
            ends.append(hi)
    return starts, ends


def render(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in order)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, rendered = {k: [] for k in KINDS}, [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            for k in KINDS:
                counts[k].append(sum(s[0] == k for s in base) if base else 0)
            base_text = render(base)
            digests.append(sha256(base_text.encode()).hexdigest())
            more = added_spans(text, base)
            rendered.append(render(base + more) if more else base_text)
        columns = [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(rendered, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def find_private_data(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, base matches by kind (n_email, n_ip, n_card, n_phone), base_sha256, spans.

    Offsets are code points of the whole text, end exclusive. Null and empty texts have no spans (base_sha256 is that of
    the empty string). Added spans never overlap base ones. Repeated rows give repeated results; an empty table gives an
    empty one; time is linear in the length of a text.
    """
    return document_columns(docs).mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str) -> str:
    """``text`` with each span replaced by its kind in angle brackets."""
    base = base_spans(text)
    out, end = [], 0
    for kind, lo, hi in sorted(base + added_spans(text, base), key=lambda s: (s[1], -s[2])):
        if lo >= end:
            out += [text[end:lo], f"<{kind}>"]
            end = hi
    return "".join(out) + text[end:]
