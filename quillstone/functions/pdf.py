"""How many pages a PDF has, by its page tree: cross-reference tables and streams, plain and packed objects."""

from __future__ import annotations

import re
import zlib

SPACE = b"\0\t\n\f\r "
TOKEN = re.compile(rb"(?:[\0\t\n\f\r ]|%[^\r\n]*)*(<<|>>|\[|\]|\(|<[0-9A-Fa-f\s]*>|/[^\0\t\n\f\r ()<>\[\]{}/%]*|\d+[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+R(?![A-Za-z])|[^\0\t\n\f\r ()<>\[\]{}/%]+|[{}])")


class Reference(tuple):
    """(number, generation) of another object."""


def _text(data: bytes, at: int) -> int:
    """The end of a string that opens before `at`; brackets nest, and a backslash hides one."""
    depth = 1
    while depth:
        c = data[at : at + 1]
        if not c:
            raise ValueError("open string")
        at += 2 if c == b"\\" else 1
        depth += (c == b"(") - (c == b")")
    return at


def value(data: bytes, at: int = 0) -> tuple[object, int]:
    """One object from `at` on, and where it ends: dict, list, name or keyword (bytes), int, Reference, or None for strings."""
    m = TOKEN.match(data, at)
    if not m:
        raise ValueError("no object")
    word, at = m[1], m.end()
    if word == b"<<":
        found: dict = {}
        while True:
            key, at = value(data, at)
            if key == b">>":
                return found, at
            found[key], at = value(data, at)
    if word == b"[":
        items: list = []
        while True:
            item, at = value(data, at)
            if item == b"]":
                return items, at
            items.append(item)
    if word == b"(":
        return None, _text(data, at)
    if word.endswith(b"R") and word[:1].isdigit():
        number, generation, _ = word.split()
        return Reference((int(number), int(generation))), at
    if re.fullmatch(rb"[+-]?\d+", word):
        return int(word), at
    return (None if word[:1] == b"<" and word != b"<<" else word), at


def _unpredicted(data: bytes, columns: int) -> bytes:
    """Rows that were stored as differences from the row above (the PNG filters none, sub and up)."""
    out, above = bytearray(), bytes(columns)
    for at in range(0, len(data), columns + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + columns])
        if kind not in (0, 1, 2):
            raise ValueError("filter")
        for i in range(len(row)):
            if kind:
                row[i] = (row[i] + (above[i] if kind == 2 else row[i - 1] if i else 0)) & 255
        out += row
        above = bytes(row)
    return bytes(out)


class Document:
    def __init__(self, data: bytes):
        self.data, self.places, self.trailer, self.packed = data, {}, {}, {}
        at, seen = int(re.findall(rb"startxref\s+(\d+)", data)[-1]), set()
        todo = [at]
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            trailer = self._table(at) if re.match(rb"\s*xref", data[at : at + 20]) else self._stream_table(at)
            self.trailer = {**trailer, **self.trailer}  # the newest comes first
            todo += [trailer[k] for k in (b"/Prev", b"/XRefStm") if isinstance(trailer.get(k), int)]

    def _table(self, at: int) -> dict:
        at = re.compile(rb"\s*xref").match(self.data, at).end()
        section = re.compile(rb"\s*(\d+)\s+(\d+)\s*[\r\n]+")
        while m := section.match(self.data, at):
            first, n, at = int(m[1]), int(m[2]), m.end()
            for i in range(n):
                place, _, kind = self.data[at + 20 * i : at + 20 * i + 20].split()
                if kind == b"n":
                    self.places.setdefault(first + i, (1, int(place)))
            at += 20 * n
        return value(self.data, re.compile(rb"\s*trailer").match(self.data, at).end())[0]

    def _stream_table(self, at: int) -> dict:
        head, body = self._stream(at)
        widths = head[b"/W"]
        index = head.get(b"/Index", [0, head[b"/Size"]])
        size, at = sum(widths), 0
        for first, n in zip(index[::2], index[1::2], strict=True):
            for i in range(n):
                row, cut = body[at : at + size], [0, widths[0], widths[0] + widths[1], size]
                kind, a, b = (int.from_bytes(row[x:y], "big") for x, y in zip(cut, cut[1:], strict=False))
                kind, at = kind if widths[0] else 1, at + size
                if kind in (1, 2):
                    self.places.setdefault(first + i, (1, a) if kind == 1 else (2, a, b))
        return head

    def _stream(self, at: int) -> tuple[dict, bytes]:
        at = re.compile(rb"\s*\d+\s+\d+\s+obj").match(self.data, at).end()
        head, at = value(self.data, at)
        at = re.compile(rb"\s*stream(?:\r\n|\n|\r)").match(self.data, at).end()
        body = self.data[at : at + self.get(head[b"/Length"])]
        kind = head.get(b"/Filter")
        if kind in (b"/FlateDecode", [b"/FlateDecode"]):
            body = zlib.decompress(body)
        elif kind:
            raise ValueError("filter")
        how = head.get(b"/DecodeParms") or {}
        how = how[0] if isinstance(how, list) else how
        return head, _unpredicted(body, how.get(b"/Columns", 1)) if how.get(b"/Predictor", 1) >= 10 else body

    def get(self, what: object) -> object:
        """The object itself, through references."""
        for _ in range(20):
            if not isinstance(what, Reference):
                return what
            place = self.places[what[0]]
            if place[0] == 1:
                what = value(self.data, re.compile(rb"\s*\d+\s+\d+\s+obj").match(self.data, place[1]).end())[0]
            else:
                if place[1] not in self.packed:
                    head, body = self._stream(self.places[place[1]][1])
                    starts = [int(x) for x in body[: head[b"/First"]].split()[1::2]]
                    self.packed[place[1]] = [value(body, head[b"/First"] + s)[0] for s in starts]
                what = self.packed[place[1]][place[2]]
        raise ValueError("circle")

    def pages(self) -> int:
        todo, seen, n = [self.get(self.trailer[b"/Root"])[b"/Pages"]], set(), 0
        while todo:
            at = todo.pop()
            if isinstance(at, Reference):
                if at in seen:
                    raise ValueError("circle")
                seen.add(at)
            node = self.get(at)
            if b"/Kids" in node:
                todo += self.get(node[b"/Kids"])
            else:
                n += 1
        return n


def page_count(content: bytes | None) -> int:
    """The number of pages; 0 for whatever cannot be read, encrypted files included."""
    try:
        document = Document(bytes(content or b""))
        return 0 if b"/Encrypt" in document.trailer else document.pages()
    except Exception:  # any failure counts as no pages
        return 0
