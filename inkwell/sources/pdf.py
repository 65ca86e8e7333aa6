"""Text of PDF files: content streams of the pages, plain or deflated, in the order of the page tree.

Objects may lie in compressed object streams; fonts with a map to Unicode are read by it, others as Windows-1252. Encrypted
files, scanned pages and streams that inflate beyond ``INFLATED`` bytes give nothing; they are errors to the reader.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Bytes that one stream may inflate to, and objects of a file that are read.
INFLATED, OBJECTS = 64 << 20, 200_000
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|[\[\]]|[-+]?(?:\d+\.?\d*|\.\d+)|/[^\s/\[\]()<>]*|[A-Za-z'\"][A-Za-z0-9*]*", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


def _string(token: bytes, font: CMap | None = None) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else _NAMED.get(m[1], m[1]), token[1:-1])
    if font is not None:
        return font.read(raw)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


class CMap:
    """A font's map from character codes to Unicode."""

    def __init__(self, body: bytes):
        width = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", body)
        self.width = len(width[1]) // 2 if width else 1
        self.to: dict[int, str] = {}
        text = lambda h: bytes.fromhex(h.decode() + "0" * (len(h) % 2)).decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
            for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                self.to[int(code, 16)] = text(to)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
            for low, high, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
                first, last = int(low, 16), min(int(high, 16), int(low, 16) + 0xFFFF)
                each = re.findall(rb"<([0-9A-Fa-f]+)>", many)
                for k in range(first, last + 1):
                    if one:
                        base = text(one)
                        self.to[k] = base[:-1] + chr(min(ord(base[-1]) + k - first, 0x10FFFF)) if base else ""
                    elif k - first < len(each):
                        self.to[k] = text(each[k - first])

    def read(self, raw: bytes) -> str:
        w = self.width
        return "".join(self.to.get(int.from_bytes(raw[i : i + w], "big"), "") for i in range(0, len(raw), w))


def shown_text(content: bytes, fonts: dict[bytes, CMap] | None = None) -> str:
    """What the text operators of a content stream show; a new line for each move to another line."""
    out: list[str] = []
    held: list[bytes] = []
    fonts, font = fonts or {}, None
    for token in _TOKEN.findall(content):
        if token[:1] in b"(<[]/+-.0123456789":
            held.append(token)
            continue
        strings = [t for t in held if t[:1] in b"(<"]
        if token == b"Tf":
            font = next((fonts[t[1:]] for t in held if t[:1] == b"/" and t[1:] in fonts), None)
        if token in (b"Tj", b"'", b'"') and strings:
            out.append(("" if token == b"Tj" else "\n") + _string(strings[-1], font))
        elif token == b"TJ":
            for t in held:
                if t[:1] in b"(<":
                    out.append(_string(t, font))
                elif t[:1] in b"-" and float(t) < -200:  # a gap of a fifth of the font size
                    out.append(" ")
        elif token in (b"T*", b"ET") or (token in (b"Td", b"TD") and len(held) > 1 and float(held[-1]) != 0) or token == b"Tm":
            out.append("\n")
        held = []
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip()


def _content(body: bytes) -> bytes:
    found = _STREAM.match(body)
    if not found or b"/Image" in found[1] or b"/FontFile" in found[1]:
        return b""
    if b"/FlateDecode" not in found[1]:
        return found[2] if b"/Filter" not in found[1] else b""
    try:
        inflater = zlib.decompressobj()
        out = inflater.decompress(found[2], INFLATED)
    except zlib.error:
        return b""
    if inflater.unconsumed_tail:
        raise OverflowError(f"a stream inflates to over {INFLATED} bytes")
    return out


def _objects(raw: bytes) -> dict[int, bytes]:
    """Bodies by object number, those of compressed object streams included; of equal numbers the last counts."""
    objects = {int(n): body for n, body in _OBJECT.findall(raw)}
    for body in [b for b in objects.values() if re.search(rb"/Type\s*/ObjStm\b", b[:2000])]:
        n, first, data = re.search(rb"/N\s+(\d+)", body), re.search(rb"/First\s+(\d+)", body), _content(body)
        if n and first and data:
            at = [int(x) for x in data[: int(first[1])].split()[: 2 * min(int(n[1]), OBJECTS)]]
            ends = [*at[3::2], len(data) - int(first[1])]
            for number, start, end in zip(at[::2], at[1::2], ends):
                objects.setdefault(number, data[int(first[1]) + start : int(first[1]) + end])
    return objects


def _reference(body: bytes, name: bytes) -> int | None:
    found = re.search(rb"/" + name + rb"\s+(\d+)\s+\d+\s+R", body)
    return int(found[1]) if found else None


def _pages(objects: dict[int, bytes]) -> list[tuple[bytes, bytes]]:
    """Each page and its resources, in the order of the page tree; without a tree, in the order of the file."""
    out: list[tuple[bytes, bytes]] = []

    def own(body: bytes, above: bytes) -> bytes:
        at = _reference(body, b"Resources")
        return objects.get(at, b"") if at is not None else body if b"/Resources" in body else above

    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
    held, seen = [(_reference(root, b"Pages"), b"")], set()
    while held:
        number, above = held.pop()
        body = objects.get(number, b"")
        if number in seen or not body:
            continue
        seen.add(number)
        kids = re.search(rb"/Kids\s*\[([^\]]*)\]", body)
        if kids:
            held += [(int(n), own(body, above)) for n in reversed(re.findall(rb"(\d+)\s+\d+\s+R", kids[1]))]
        elif re.search(rb"/Type\s*/Page\b", body):
            out.append((body, own(body, above)))
    return out or [(b, own(b, b"")) for b in objects.values() if re.search(rb"/Type\s*/Page\b", b)]


def _fonts(resources: bytes, objects: dict[int, bytes]) -> dict[bytes, CMap]:
    table = re.search(rb"/Font\s*<<(.*?)>>", resources, re.S)
    names = table[1] if table else objects.get(_reference(resources, b"Font"), b"")
    maps = {n: _reference(objects.get(int(at), b""), b"ToUnicode") for n, at in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", names)}
    return {n: CMap(_content(objects[at])) for n, at in maps.items() if at in objects}


def pdf_text(raw: bytes | None) -> str:
    """The pages' texts, one after the other; empty if there is none to extract or a stream inflates beyond ``INFLATED``."""
    if not raw or b"/Encrypt" in raw:
        return ""
    try:
        objects = _objects(raw)
        parts = []
        for body, resources in _pages(objects):
            named = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|(\d+\s+\d+\s+R))", body)
            if named:
                numbers = [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", named[1] or named[2])]
                parts.append((b"\n".join(_content(objects.get(n, b"")) for n in numbers), _fonts(resources, objects)))
        parts = parts or [(_content(body), {}) for body in objects.values()]
    except OverflowError:
        return ""
    return "\n".join(t for t in (shown_text(p, fonts) for p, fonts in parts if b"BT" in p) if t)


def pdf_column(content: Column) -> Column:
    """``pdf_text`` of a binary column."""

    @pandas_udf("string")
    def read(values: pd.Series) -> pd.Series:
        return values.map(pdf_text)

    return read(content)
