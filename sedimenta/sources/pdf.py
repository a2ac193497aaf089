"""Text of PDF files with the standard library: objects, flate streams, the page tree, text operators and ToUnicode maps.

Encrypted files and streams in other filters give no text. Text is read in the order of the content stream.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b(.*?)(?:\bendobj\b|(?=(?<!\d)\d+\s+\d+\s+obj\b)|\Z)", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_STREAM = re.compile(rb"stream\r?\n(.*?)(?:\r?\n)?endstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Document:
    """The objects of a file by number."""

    def __init__(self, data: bytes):
        if b"%PDF" not in data[:1024]:
            raise ValueError("no PDF")
        self.objects = {int(m.group(1)): m.group(3) for m in _OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body[:300]:
                packed = self.stream(body)
                first, count = self._int(body, b"First"), self._int(body, b"N")
                places = [int(x) for x in packed[:first].split()[: 2 * count]]
                ends = [*places[3::2], len(packed) - first]
                for number, start, end in zip(places[::2], places[1::2], ends):
                    self.objects.setdefault(number, packed[first + start : first + end])

    @staticmethod
    def _int(body: bytes, key: bytes) -> int:
        found = re.search(rb"/" + key + rb"\s+(\d+)", body)
        return int(found.group(1)) if found else 0

    @staticmethod
    def stream(body: bytes) -> bytes:
        """The decoded stream of an object, empty if it has none."""
        found = _STREAM.search(body)
        if not found:
            return b""
        head, raw = body[: found.start()], found.group(1)
        if b"/FlateDecode" not in head:
            return raw if b"/Filter" not in head else b""
        try:
            return zlib.decompressobj().decompress(raw)
        except zlib.error:
            return b""

    def part(self, body: bytes, key: bytes) -> bytes:
        """What a dictionary holds under a key, references followed once; nested dictionaries and arrays whole."""
        found = re.search(rb"/" + key + rb"(?![A-Za-z])\s*", body)
        if not found:
            return b""
        rest = body[found.end() :]
        reference = _REFERENCE.match(rest)
        if reference:
            return self.objects.get(int(reference.group(1)), b"")
        for opening, closing in ((b"<<", b">>"), (b"[", b"]")):
            if rest.startswith(opening):
                depth = 0
                for mark in re.finditer(re.escape(opening) + b"|" + re.escape(closing), rest):
                    depth += 1 if mark.group() == opening else -1
                    if not depth:
                        return rest[: mark.end()]
        return re.match(rb"[^/>\]]*", rest).group()

    def pages(self) -> list[bytes]:
        """The page objects in order of the page tree; in order of number if the tree can't be followed."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        start = re.search(rb"/Pages\s+(\d+)", root)
        out: list[bytes] = []
        todo, seen = [int(start.group(1))] if start else [], set()
        while todo:
            number = todo.pop()
            body = self.objects.get(number, b"")
            if number in seen:
                continue
            seen.add(number)
            kids = self.part(body, b"Kids")
            if kids:
                todo += [int(m.group(1)) for m in _REFERENCE.finditer(kids)][::-1]
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append(body)
        return out or [b for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b", b)]

    def content(self, page: bytes) -> bytes:
        """The content streams of a page, joined."""
        found = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        streams = [self.objects.get(int(m.group(1)), b"") for m in _REFERENCE.finditer(found.group(1))] if found else []
        return b"\n".join(self.stream(s) for s in streams)

    def fonts(self, page: bytes) -> dict[bytes, dict[bytes, str]]:
        """For each font name of a page, what its codes mean; empty where the font has no ToUnicode map."""
        resources = self.part(page, b"Resources") or self.part(self.part(page, b"Parent"), b"Resources")
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", self.part(resources, b"Font")):
            table = re.search(rb"/ToUnicode\s+(\d+)", self.objects.get(int(number), b""))
            out[name] = _unicode(self.stream(self.objects.get(int(table.group(1)), b""))) if table else {}
        return out


def _unicode(table: bytes) -> dict[bytes, str]:
    """Codes of a ToUnicode map and their characters."""
    out: dict[bytes, str] = {}
    text = lambda digits: bytes.fromhex(digits.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
        for code, char in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[bytes.fromhex(code.decode())] = text(char)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
        for low, high, plain, listed in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
            width, first = len(low) // 2, int(low, 16)
            several = re.findall(rb"<([0-9A-Fa-f]+)>", listed)
            for k in range(min(int(high, 16) - first + 1, 65536)):
                char = (text(several[k]) if k < len(several) else "") if listed else text(plain)[:-1] + chr(ord(text(plain)[-1]) + k)
                out[(first + k).to_bytes(width, "big")] = char
    return out


def _raw(token: bytes) -> bytes:
    """The bytes of a string token."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    one = lambda m: _ESCAPES.get(m.group(1), b"") if m.group(1) in _ESCAPES else b"" if m.group(1)[:1] in b"\r\n" else bytes([int(m.group(1), 8) & 255]) if m.group(1).isdigit() else m.group(1)
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


def _read(raw: bytes, codes: dict[bytes, str]) -> str:
    if not codes:
        return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    width = max(map(len, codes))
    return "".join(codes.get(raw[k : k + width], "") for k in range(0, len(raw), width))


def page_texts(data: bytes) -> list[str]:
    """The text of each page."""
    document = Document(data)
    out = []
    for page in document.pages():
        fonts, codes, text, stack = document.fonts(page), {}, [], []
        for match in _TOKEN.finditer(document.content(page)):
            token = match.group()
            if token[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?\d*\.?\d+", token):
                stack.append(token)
                continue
            if token == b"Tf":
                names = [t for t in stack if t[:1] == b"/"]
                codes = fonts.get(names[-1][1:], {}) if names else {}
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                text.append("\n" if token in (b"'", b'"') else "")
                for item in stack:
                    if item[:1] in b"(<":
                        text.append(_read(_raw(item), codes))
                    elif token == b"TJ" and item[:1] not in b"[]/" and float(item) < -180:  # a wide gap
                        text.append(" ")
            elif token in (b"Td", b"TD", b"Tm", b"T*") and text:
                numbers = [float(t) for t in stack if re.fullmatch(rb"[-+]?\d*\.?\d+", t)]
                text.append(" " if token == b"Td" and len(numbers) > 1 and not numbers[-1] else "\n")
            stack = []
        lines = (re.sub(r"[ \t]+", " ", line).strip() for line in "".join(text).split("\n"))
        out.append("\n".join(line for line in lines if line))
    return out


def pdf_markdown(data: bytes) -> str:
    """The text of all pages, pages apart by blank lines; a file without a page is broken."""
    texts = page_texts(data)
    if not texts:
        raise ValueError("no page")
    return "\n\n".join(text for text in texts if text)
