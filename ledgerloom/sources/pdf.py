"""Text layers of PDF files: objects, streams and text operators, without a library.

Enough for statements that programs print: plain and compressed objects, Flate streams, simple and two-byte fonts with a
ToUnicode map. Lines are rows of equal height from top to bottom, their pieces from left to right. Encrypted files and
scanned pages have no text here.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^()\\]|\((?:\\.|[^()\\])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[+-]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _decoded(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    if b"FlateDecode" not in body[: found.start()]:
        return found.group(1)
    return zlib.decompressobj().decompress(found.group(1))


def _objects(content: bytes) -> dict[int, bytes]:
    out = {int(n): body for n, body in _OBJECT.findall(content)}
    for body in list(out.values()):
        if b"/ObjStm" in body:  # objects packed into a stream: numbers and offsets, then the objects
            inner, first = _decoded(body), int(re.search(rb"/First\s+(\d+)", body).group(1))
            numbers = list(map(int, inner[:first].split()))
            places = [first + at for at in numbers[1::2]] + [len(inner)]
            out |= {n: inner[lo:hi] for n, lo, hi in zip(numbers[::2], places, places[1:])}
    return out


def _after(body: bytes, key: bytes) -> bytes:
    found = re.search(key + rb"(?![A-Za-z])\s*", body)
    return body[found.end() :] if found else b""


def _pages(objects: dict[int, bytes]) -> list[bytes]:
    """Page objects in the order of the page tree."""
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
    top = _REFERENCE.match(_after(root, rb"/Pages"))
    out, stack, seen = [], [int(top.group(1))] if top else [], set()
    while stack:
        n = stack.pop()
        body = objects.get(n, b"")
        if n in seen:
            continue
        seen.add(n)
        kids = re.match(rb"\[(.*?)\]", _after(body, rb"/Kids"), re.S)
        if kids:
            stack += [int(k) for k in reversed(_REFERENCE.findall(kids.group(1)))]
        elif re.search(rb"/Type\s*/Page\b", body):
            out.append(body)
    return out


def _contents(objects: dict[int, bytes], page: bytes) -> bytes:
    rest = _after(page, rb"/Contents")
    many = re.match(rb"\[(.*?)\]", rest, re.S)
    names = _REFERENCE.findall(many.group(1)) if many else _REFERENCE.findall(rest[:32])[:1]
    return b"\n".join(_decoded(objects.get(int(n), b"")) for n in names)


def _maps(objects: dict[int, bytes], page: bytes) -> dict[bytes, dict[bytes, str]]:
    """ToUnicode maps of the page's fonts by name."""
    near = _after(page, rb"/Resources")
    held = _REFERENCE.match(near)
    fonts = _after(objects.get(int(held.group(1)), b"") if held else near, rb"/Font")
    held = _REFERENCE.match(fonts)
    fonts = objects.get(int(held.group(1)), b"") if held else fonts
    out = {}
    for name, n in re.findall(rb"(/[^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", fonts):
        to = _REFERENCE.match(_after(objects.get(int(n), b""), rb"/ToUnicode"))
        if to:
            out[name] = _unicode_map(_decoded(objects.get(int(to.group(1)), b"")))
    return out


def _unicode_map(cmap: bytes) -> dict[bytes, str]:
    text, out = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be"), {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for lo, hi, first in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            for i in range(int(hi, 16) - int(lo, 16) + 1):
                out[(int(lo, 16) + i).to_bytes(len(lo) // 2, "big")] = chr(int(first, 16) + i)
    return out


def _string(token: bytes, codes: dict[bytes, str] | None) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = _ESCAPE.sub(lambda m: _PLAIN.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1] if m[1] in b"()\\" else b""), token[1:-1])
    if not codes:
        return raw.decode("cp1252", "replace")
    width = len(next(iter(codes)))
    return "".join(codes.get(raw[i : i + width], "") for i in range(0, len(raw), width))


def _page_text(operators: bytes, maps: dict[bytes, dict[bytes, str]]) -> str:
    pieces: list[tuple[float, float, str]] = []
    stack: list[bytes] = []
    x = y = line_x = leading = 0.0
    codes, array = None, None

    def show(tokens: list[bytes]) -> None:
        text = ""
        for token in tokens:
            if token[:1] in b"(<":
                text += _string(token, codes)
            elif array is not None and float(token) < -200:  # a wide gap parts words
                text += " "
        if text.strip():
            pieces.append((-round(y, 1), x, text))

    for token in _TOKEN.findall(operators):
        if token == b"[":
            array = []
        elif token == b"]":
            stack = array if array is not None else []
        elif token[:1] in b"(</+-.0123456789":
            (stack if array is None or stack is array else array).append(token)
        else:
            number = lambda i: float(stack[i])  # noqa: B023, E731
            if token == b"Tf" and len(stack) >= 2:
                codes = maps.get(stack[-2])
            elif token in (b"Td", b"TD") and len(stack) >= 2:
                line_x, y = line_x + number(-2), y + number(-1)
                x, leading = line_x, -number(-1) if token == b"TD" else leading
            elif token == b"Tm" and len(stack) >= 6:
                x = line_x = number(-2)
                y = number(-1)
            elif token == b"TL" and stack:
                leading = number(-1)
            elif token == b"BT":
                x = y = line_x = 0.0
            elif token in (b"T*", b"'", b'"'):
                y, x = y - leading, line_x
            if token in (b"Tj", b"TJ", b"'", b'"') and stack:
                show(stack if token == b"TJ" else stack[-1:])
                x += 0.01  # what follows without a move stands to the right
            stack, array = [], None
    lines: dict[float, list[str]] = {}
    for at, _, text in sorted(pieces, key=lambda p: (p[0], p[1])):
        lines.setdefault(at, []).append(text.strip())
    return "\n".join(" ".join(parts) for parts in lines.values())


def pdf_pages(content: bytes) -> list[str]:
    """The text of each page. Anything but a PDF is an error."""
    if not content.lstrip()[:5] == b"%PDF-":
        raise ValueError("not a PDF file")
    objects = _objects(content)
    return [_page_text(_contents(objects, page), _maps(objects, page)) for page in _pages(objects)]
