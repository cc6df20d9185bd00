"""The text layer of PDF files, and a page of text as a PDF: a small helper for page sources, without layout.

Read are plain and Flate-compressed streams, object streams, the page tree, fonts with a ToUnicode map (others as
Windows-1252) and the operators that show text. A line ends where the text position moves to another line. Encrypted files are
an error; images, forms and layout are not looked at.
"""

from __future__ import annotations

import re
import zlib

#: Begun at the first digit of a run only, and without going back in it: runs of digits are long in strings of hexadecimal digits.
_OBJECT = re.compile(rb"(?<!\d)(\d++)\s+\d++\s+obj\b")
_STREAM, _END = re.compile(rb"\s*stream\r?\n"), re.compile(rb"\s*endstream")
_INTEGER, _REAL, _OCTAL = re.compile(rb"[+-]?\d+"), re.compile(rb"[+-]?\d*\.\d*"), re.compile(rb"[0-7]{1,3}")
_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]{}]|/[^\s<>\[\]()/%{}]*|<[0-9A-Fa-f\s]*>|\(|[^\s<>\[\]()/%{}]+")
_WORDS = {b"true": True, b"false": False, b"null": None}
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A shift to the left of so many thousandths of the font's size between two strings is a space.
_GAP = 200


class PdfError(ValueError):
    """The bytes are no PDF file with a text layer that can be read."""


class Name(str):
    """A PDF name."""


class Ref(int):
    """A reference to an object, by number."""


class Op(bytes):
    """An operator or keyword."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses that begins after at, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            octal = _OCTAL.match(data, at)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
            else:
                e = data[at : at + 1]
                at += 2 if data[at : at + 2] == b"\r\n" else 1
                out += b"" if e in (b"\r", b"\n") else _ESCAPES.get(e, e)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def tokens(data: bytes, at: int = 0):
    """Values (numbers, strings as bytes, names, lists, dictionaries) and operators, each with where it ends."""
    stack: list[list] = []
    while found := _TOKEN.search(data, at):
        word, at = found[0], found.end()
        value: object
        if word.startswith(b"%"):
            continue
        if word == b"(":
            value, at = _string(data, at)
        elif word in (b"<<", b"["):
            stack.append([])
            continue
        elif word in (b">>", b"]") and stack:
            own = stack.pop()
            value = own if word == b"]" else dict(zip(own[::2], own[1::2]))
        elif word.startswith(b"<"):
            try:
                value = bytes.fromhex(word[1:-1].decode())
            except ValueError:  # an odd number of digits, or white space within a byte
                digits = re.sub(rb"\s", b"", word[1:-1])
                value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif word.startswith(b"/"):
            value = Name(word[1:].decode("latin-1"))
        elif word[0] in b"+-.0123456789" and _INTEGER.fullmatch(word):
            value = int(word)
        elif word[0] in b"+-.0123456789" and _REAL.fullmatch(word) and word.strip(b"+-."):
            value = float(word)
        else:
            value = _WORDS[word] if word in _WORDS else Op(word)
        if stack:
            own = stack[-1]
            if value == b"R" and isinstance(value, Op) and len(own) > 1:
                own[-2:] = [Ref(own[-2])]
            else:
                own.append(value)
        else:
            yield value, at


def _utf16(raw: bytes) -> str:
    return raw.decode("utf-16-be", "surrogatepass")


class Codes(dict):
    """Text by code; ranges are looked up when a code of theirs is met first."""

    def __init__(self) -> None:
        self.mapped = False  # whether single codes have texts of their own
        self.ranges: list[tuple[int, int, bytes | list]] = []

    def decode(self, raw: bytes, width: int) -> str:
        if width == 2 and len(raw) % 2 == 0 and self.ranges == [(0, 0xFFFF, b"\0\0")] and not self.mapped:
            return raw.decode("utf-16-be", "surrogatepass")  # each code is its own character
        return "".join(self[int.from_bytes(raw[i : i + width], "big")] for i in range(0, len(raw), width))

    def __missing__(self, code: int) -> str:
        found = "\ufffd"
        for lo, hi, to in self.ranges:
            if lo <= code <= hi:
                found = _utf16(to[code - lo] if isinstance(to, list) else (int.from_bytes(to, "big") + code - lo).to_bytes(len(to), "big"))
        self[code] = found
        return found


class Document:
    def __init__(self, data: bytes) -> None:
        if b"%PDF" not in data[:1024]:
            raise PdfError("not a PDF file")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        self.maps: dict[int, tuple[int, Codes]] = {}
        for found in _OBJECT.finditer(data):
            number = int(found[1])
            value, at = next(tokens(data, found.end()), (None, found.end()))
            self.objects[number] = value  # a later revision replaces an earlier one
            start = _STREAM.match(data, at) if isinstance(value, dict) else None
            if start:
                size = value.get("Length")
                size = size if isinstance(size, int) and not isinstance(size, Ref) and size >= 0 and _END.match(data, start.end() + size) else None
                stop = start.end() + size if size is not None else data.find(b"endstream", start.end())
                self.streams[number] = data[start.end() : stop]
        if re.search(rb"trailer\s*<<[^>]*/Encrypt", data):
            raise PdfError("encrypted")
        for number, value in list(self.objects.items()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                raw = self.stream(number)
                heads = [v for v, _ in tokens(raw[: value["First"]])]
                for inner, offset in zip(heads[::2], heads[1::2]):
                    self.objects.setdefault(inner, next(tokens(raw, value["First"] + offset), (None, 0))[0])

    def get(self, value: object) -> object:
        for _ in range(20):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value)
        return None

    def stream(self, number: int) -> bytes:
        about, raw = self.objects.get(number), self.streams.get(number, b"")
        filters = self.get(about.get("Filter")) if isinstance(about, dict) else None
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if f != "FlateDecode":
                return b""
            raw = zlib.decompressobj().decompress(raw)
        return raw

    def pages(self) -> list[tuple[dict, dict]]:
        """Page dictionaries with their resources, in reading order."""
        found: list[tuple[dict, dict]] = []
        seen: set[int] = set()

        def walk(ref: object, resources: dict) -> None:
            node = self.get(ref)
            if not isinstance(node, dict) or isinstance(ref, Ref) and ref in seen:
                return
            if isinstance(ref, Ref):
                seen.add(ref)
            own = self.get(node.get("Resources")) or resources
            if node.get("Type") == "Page":
                found.append((node, own))
            for kid in self.get(node.get("Kids")) or []:
                walk(kid, own)

        for value in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "Catalog":
                walk(value.get("Pages"), {})
        return found

    def unicode_map(self, font: dict) -> tuple[int, Codes] | None:
        """Bytes of a code and code to text, by the font's ToUnicode map."""
        ref = font.get("ToUnicode")
        if not isinstance(ref, Ref):
            return None
        if ref in self.maps:
            return self.maps[ref]
        width, codes, held = 1, Codes(), []
        for value, _ in tokens(self.stream(ref)):
            if not isinstance(value, Op):
                held.append(value)
                continue
            if value == b"endcodespacerange" and held:
                width = max(len(x) for x in held if isinstance(x, bytes))
            elif value == b"endbfchar":
                codes.mapped = True
                codes.update((int.from_bytes(a, "big"), _utf16(b)) for a, b in zip(held[::2], held[1::2]))
            elif value == b"endbfrange":
                codes.ranges += [(int.from_bytes(lo, "big"), int.from_bytes(hi, "big"), to) for lo, hi, to in zip(held[::3], held[1::3], held[2::3])]
            held = []
        self.maps[ref] = width, codes
        return width, codes

    def text(self, page: dict, resources: dict) -> str:
        contents = self.get(page.get("Contents"))
        refs = contents if isinstance(contents, list) else [page.get("Contents")]
        data = b"\n".join(self.stream(r) for r in refs if isinstance(r, Ref))
        fonts = self.get((self.get(resources) or {}).get("Font")) or {}
        maps = {name: self.unicode_map(self.get(f) or {}) for name, f in fonts.items()}
        out: list[str] = []
        held: list = []
        font, height, shown = None, None, False

        def show(raw: object) -> None:
            nonlocal shown
            if not isinstance(raw, bytes):
                return
            shown = True
            if font is None:
                out.append(raw.decode("cp1252", "replace"))
            else:
                width, codes = font
                out.append(codes.decode(raw, width))

        for value, _ in tokens(data):
            if not isinstance(value, Op):
                held.append(value)
                continue
            if value == b"Tf" and len(held) > 1:
                font = maps.get(held[-2])
            elif value in (b"Tj", b"'", b'"') and held:
                if value != b"Tj" and shown:
                    out.append("\n")
                show(held[-1])
            elif value == b"TJ" and held and isinstance(held[-1], list):
                for x in held[-1]:
                    out.append(" ") if isinstance(x, (int, float)) and x <= -_GAP else show(x)
            elif shown and (value == b"T*" or value in (b"Td", b"TD") and len(held) > 1 and held[-1] != 0):
                out.append("\n")
            elif value == b"Tm" and len(held) > 5:
                if shown and held[-1] != height:
                    out.append("\n")
                height = held[-1]
            held = []
        joined = "".join(out)
        return joined.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")


def pages_of(content: bytes) -> list[str]:
    """The text of each page."""
    own = Document(content)
    return [own.text(page, resources) for page, resources in own.pages()]


def pdf_of(pages: list[str]) -> str:
    """A PDF file of these pages, one line of a page a line, in ASCII (so Spark's text writer can write it)."""
    bodies = ["<< /Type /Catalog /Pages 2 0 R >>", "", "<< /Type /Font /Subtype /Type0 /BaseFont /Plain /Encoding /Identity-H /ToUnicode 4 0 R >>"]
    units = "1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n1 beginbfrange\n<0000> <FFFF> <0000>\nendbfrange"
    bodies.append(f"<< /Length {len(units)} >>\nstream\n{units}\nendstream")
    kids = []
    for page in pages:
        lines = " T*\n".join(f"<{line.encode('utf-16-be', 'surrogatepass').hex()}> Tj" for line in page.split("\n"))
        shown = f"BT /F1 9 Tf 11 TL 30 800 Td\n{lines}\nET"
        bodies.append(f"<< /Length {len(shown)} >>\nstream\n{shown}\nendstream")
        bodies.append(f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {len(bodies)} 0 R >>")
        kids.append(f"{len(bodies)} 0 R")
    bodies[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(kids)}] >>"
    return "%PDF-1.4\n" + "".join(f"{i} 0 obj\n{b}\nendobj\n" for i, b in enumerate(bodies, 1)) + "trailer\n<< /Root 1 0 R >>\n%%EOF"
