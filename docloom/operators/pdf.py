"""A small PDF reader: objects, Flate streams, text operators, lines, headings and tables.

Layout is approximate: glyph runs are placed by the text matrix, gathered into
lines by their height on the page and into blocks by the gaps between lines.
"""

from __future__ import annotations

import re
import zlib
from typing import TYPE_CHECKING

from docloom.functions import raw

if TYPE_CHECKING:
    from docloom.operators.tree import Part, Source, Tree

_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b")
_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]{}]|/[^\s()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\s]*>|[^\s()<>\[\]{}/%]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Ref(int):
    """Reference to an object by number."""


class Name(str):
    pass


class Op(str):
    """An operator of a content stream, or a keyword."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """Literal string from behind its opening parenthesis."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            e = data[at : at + 1]
            if m := re.compile(rb"[0-7]{1,3}").match(data, at):
                out.append(int(m[0], 8) & 255)
                at = m.end()
            else:
                at += 2 if data[at : at + 2] == b"\r\n" else 1
                out += b"" if e in b"\r\n" else _ESCAPES.get(e, e)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def _tokens(data: bytes, at: int = 0):  # noqa: ANN202
    """(value, end) of the tokens of a stream or object."""
    while m := _TOKEN.search(data, at):
        t, at = m[0], m.end()
        if t.startswith(b"%"):
            continue
        if t == b"(":
            value, at = _string(data, at)
            yield value, at
        elif t.startswith(b"<") and t != b"<<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
        elif t.startswith(b"/"):
            yield Name(re.sub("#([0-9A-Fa-f]{2})", lambda h: chr(int(h[1], 16)), t[1:].decode("latin-1"))), at
        else:
            try:
                yield (float(t) if b"." in t else int(t)), at
            except ValueError:
                yield Op(t.decode("latin-1")), at


def _value(data: bytes, at: int = 0) -> tuple[object, int]:
    """First object in data: its value and where it ends."""
    stack: list[list] = [[]]
    end = at
    for v, end in _tokens(data, at):
        if v == "<<" or v == "[":
            stack.append([v])
        elif v in (">>", "]") and isinstance(v, Op):
            if len(stack) == 1:
                break
            items = stack.pop()
            body = items[1:]
            stack[-1].append(dict(zip(body[::2], body[1::2], strict=False)) if items[0] == "<<" else body)
        elif v == "R" and isinstance(v, Op) and len(stack[-1]) >= 2:
            stack[-1][-2:] = [Ref(stack[-1][-2])]
        elif isinstance(v, Op) and v in ("stream", "endobj", "obj"):
            break
        else:
            stack[-1].append({"true": True, "false": False, "null": None}.get(v, v) if isinstance(v, Op) else v)
        if len(stack) == 1 and isinstance(stack[0][-1], (dict, list)):
            break
    return (stack[0][0] if stack[0] else None), end


class Pdf:
    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF") or not (b"endobj" in data or b"/ObjStm" in data):
            raise ValueError("no PDF objects")
        self.data, self.found, self.streams, self.encrypted = data, {}, {}, b"/Encrypt" in data
        for m in _OBJECT.finditer(data):
            value, end = _value(data, m.end())
            n = int(m[1])
            self.found[n] = value
            if isinstance(value, dict) and (s := re.compile(rb"\s*stream\r?\n").match(data, end)):
                size = self.get(value.get("Length"))
                stop = data.find(b"endstream", s.end())
                whole = isinstance(size, int) and data[s.end() + size : s.end() + size + 12].lstrip().startswith(b"endstream")
                self.streams[n] = (s.end(), s.end() + size if whole else stop if stop >= 0 else len(data))
        for n, v in list(self.found.items()):
            if isinstance(v, dict) and v.get("Type") == "ObjStm" and n in self.streams and not self.encrypted:
                self._unpack(n, v)
        roots = [v for v in self.found.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        if not roots:
            raise ValueError("no PDF catalog")
        self.pages: list[dict] = []
        self._walk(self.get(roots[-1].get("Pages")), {}, 0)

    def get(self, v: object) -> object:
        for _ in range(32):
            if not isinstance(v, Ref):
                return v
            v = self.found.get(int(v))
        return None

    def _unpack(self, n: int, head: dict) -> None:
        try:
            body = self.stream(Ref(n))
        except (ValueError, zlib.error):
            return
        first, count = int(self.get(head.get("First")) or 0), int(self.get(head.get("N")) or 0)
        numbers = [v for v, _ in _tokens(body[:first]) if isinstance(v, int)][: 2 * count]
        for number, at in zip(numbers[::2], numbers[1::2], strict=False):
            self.found.setdefault(number, _value(body, first + at)[0])

    def stream(self, ref: object) -> bytes:
        head = self.get(ref)
        if not isinstance(ref, Ref) or int(ref) not in self.streams or not isinstance(head, dict):
            return b""
        a, b = self.streams[int(ref)]
        body = self.data[a:b]
        kinds = self.get(head.get("Filter"))
        for kind in kinds if isinstance(kinds, list) else [kinds] if kinds else []:
            if kind != "FlateDecode":
                raise ValueError(f"PDF filter {kind}")
            body = zlib.decompressobj().decompress(body, 1 << 27)
        return body

    def _walk(self, node: object, above: dict, depth: int) -> None:
        if not isinstance(node, dict) or depth > 64 or len(self.pages) > 100_000:
            return
        own = above | {k: v for k, v in node.items() if k in ("Resources", "MediaBox", "Rotate")}
        if node.get("Type") == "Page" or "Kids" not in node:
            self.pages.append(node | own)
            return
        for kid in self.get(node["Kids"]) or []:
            self._walk(self.get(kid), own, depth + 1)

    def fonts(self, page: dict) -> dict[str, dict[int, str] | None]:
        """ToUnicode maps of a page's fonts; None where a font has none."""
        resources = self.get(page.get("Resources")) or {}
        out = {}
        for name, ref in (self.get(resources.get("Font")) or {}).items():
            font = self.get(ref) or {}
            out[name] = _to_unicode(self.stream(font["ToUnicode"])) if "ToUnicode" in font else None
        return out

    def content(self, page: dict) -> bytes:
        parts = page.get("Contents")
        many = self.get(parts) if isinstance(self.get(parts), list) else [parts]
        return b"\n".join(self.stream(p) for p in many)

    def size(self, page: dict) -> tuple[float, float]:
        box = [float(self.get(v) or 0) for v in self.get(page.get("MediaBox")) or [0, 0, 612, 792]]
        return (abs(box[2] - box[0]), abs(box[3] - box[1])) if len(box) == 4 else (612.0, 792.0)


def _to_unicode(body: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    text = lambda b: b.decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
        v = [x for x, _ in _tokens(block) if isinstance(x, bytes)]
        out |= {int.from_bytes(a, "big"): text(b) for a, b in zip(v[::2], v[1::2], strict=False)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            for i in range(min(int(b, 16) - int(a, 16) + 1, 65_536)):
                out[int(a, 16) + i] = chr(min(int(c, 16) + i, 0x10FFFF))
    return out


def runs(content: bytes, fonts: dict[str, dict[int, str] | None]) -> list[tuple[float, float, float, str]]:
    """(x, y, size, text) of the glyph runs in the order they are shown."""
    out: list[tuple[float, float, float, str]] = []
    stack: list = []
    tm = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm, saved, size, leading, font = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), [], 12.0, 0.0, None

    def times(a: tuple, b: tuple) -> tuple:
        return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])

    def show(s: bytes) -> None:
        nonlocal tm
        if font:
            wide = max(font) > 255
            codes = [int.from_bytes(s[i : i + 2], "big") for i in range(0, len(s), 2)] if wide else s
            text = "".join(font.get(c, "") for c in codes)
        else:
            text = s.decode("cp1252", "replace")
        at = times(tm, ctm)
        out.append((at[4], at[5], size * (abs(at[3]) or abs(at[1]) or 1.0), text))
        tm = times((1, 0, 0, 1, 0.5 * size * len(text), 0), tm)

    def down(x: float, y: float) -> None:
        nonlocal tm, line
        tm = line = times((1, 0, 0, 1, x, y), line)

    for v, _ in _tokens(content):
        if not isinstance(v, Op):
            stack.append(v)
            continue
        if v == "[":
            stack.append("[")
            continue
        if v == "]":
            cut = len(stack) - 1 - stack[::-1].index("[") if "[" in stack else 0
            stack[cut:] = [stack[cut + 1 :]]
            continue
        num = [x for x in stack if isinstance(x, (int, float))]
        if v == "BT":
            tm = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        elif v == "Tf" and len(stack) >= 2:
            font, size = fonts.get(stack[-2]), float(stack[-1])
        elif v == "TL" and num:
            leading = float(num[-1])
        elif v in ("Td", "TD") and len(num) >= 2:
            leading = -num[-1] if v == "TD" else leading
            down(num[-2], num[-1])
        elif v == "Tm" and len(num) >= 6:
            tm = line = tuple(map(float, num[-6:]))
        elif v == "T*":
            down(0, -leading)
        elif v in ("Tj", "'", '"') and stack and isinstance(stack[-1], bytes):
            if v != "Tj":
                down(0, -leading)
            show(stack[-1])
        elif v == "TJ" and stack and isinstance(stack[-1], list):
            for piece in stack[-1]:
                if isinstance(piece, bytes):
                    show(piece)
                elif isinstance(piece, (int, float)):
                    tm = times((1, 0, 0, 1, -piece / 1000 * size, 0), tm)
                    if piece < -200 and out:
                        out[-1] = (*out[-1][:3], out[-1][3] + " ")
        elif v == "cm" and len(num) >= 6:
            ctm = times(tuple(map(float, num[-6:])), ctm)
        elif v == "q":
            saved.append(ctm)
        elif v == "Q" and saved:
            ctm = saved.pop()
        stack.clear()
    return [r for r in out if r[3].strip()]


def lines_of(found: list[tuple[float, float, float, str]]) -> list[tuple[float, float, list[tuple[float, float, str]]]]:
    """(y, size, [(x, end, text)]) from top to bottom."""
    out: list[tuple[float, float, list]] = []
    for x, y, size, text in sorted(found, key=lambda r: -r[1]):
        cell = (x, x + 0.5 * size * len(text), text)
        if out and abs(out[-1][0] - y) <= 0.4 * max(out[-1][1], size):
            out[-1][2].append(cell)
        else:
            out.append((y, size, [cell]))
    return [(y, size, sorted(cells)) for y, size, cells in out]


def layout(found: list[tuple[float, float, float, str]]) -> str:
    """Blocks of lines in reading order; a short single line of large type is a heading."""
    blocks: list[list[tuple[float, str]]] = []
    last = None
    for y, size, cells in lines_of(found):
        text = " ".join(" ".join(c[2] for c in cells).split())
        if last is None or last[0] - y > 1.8 * max(size, last[1]) or abs(size - last[1]) > 1:
            blocks.append([])
        blocks[-1].append((size, text))
        last = (y, size)
    out = []
    for b in blocks:
        text = "\n".join(t for _, t in b)
        out.append(f"### {text}" if len(b) == 1 and 1 <= len(text) <= 80 and b[0][0] >= 16 else text)
    return "\n\n".join(out)


def stream_tables(found: list[tuple[float, float, float, str]]) -> list[list[list[str]]]:
    """Runs of three lines or more with the same three or more columns."""
    tables: list[list[list[str]]] = []
    rows: list[list[str]] = []
    columns: list[float] = []
    for _, size, cells in [*lines_of(found), (0.0, 0.0, [])]:
        starts = [c[0] for c in cells]
        apart = all(b[0] - a[1] > 0.5 * size for a, b in zip(cells, cells[1:], strict=False))
        if len(cells) >= 3 and apart and (not rows or len(columns) == len(starts) and all(abs(a - b) < 3 for a, b in zip(columns, starts, strict=True))):
            columns = columns if rows else starts
            rows.append([c[2].strip() for c in cells])
            continue
        if len(rows) >= 3:
            tables.append(rows)
        rows = []
    return [t for t in tables if sum(not c for r in t for c in r) * 2 <= sum(map(len, t))]


def safe_dpi(w: float, h: float, pixels: int) -> int:
    area = (max(w, 1) / 72) * (max(h, 1) / 72)
    dpi = int(min(300.0, (pixels / area) ** 0.5))
    return dpi if dpi >= 36 else 0


def read_pdf(tree: Tree, src: Source, part: Part) -> None:
    from docloom.contract import error_for

    pdf = Pdf(src.data)
    part.pages, out, some = len(pdf.pages), [raw.heading(src.path)], False
    for number, page in enumerate(pdf.pages, 1):
        tree.check_time()
        if not tree.pdf_page():
            part.warn("W_TRUNCATED", "pdf page cap")
            break
        try:
            found = runs(pdf.content(page), pdf.fonts(page)) if not pdf.encrypted else []
        except (ValueError, zlib.error):
            part.warn("W_PART_FAILED", f"page {number}")
            continue
        text = layout(found).strip()
        out.append(f"### Page {number}\n\n")
        if text:
            out.append(text + "\n\n")
        if len(text) < 20:
            part.warn("W_NO_TEXT_LAYER", f"page {number}")
            if tree.options.ocr == "auto":
                if tree.ocr.reason is not None:
                    part.warn("W_OCR_UNAVAILABLE", tree.ocr.reason)
                elif not tree.ocr_page():  # the page's own slot; its image takes another
                    part.warn("W_TRUNCATED", "ocr page cap")
                elif not safe_dpi(*pdf.size(page), tree.limits.pixels):
                    raise error_for("E_LIMIT_PIXELS")
                else:
                    part.warn("W_IMAGE_SKIPPED", "no page renderer")
            continue
        some = True
        if tree.options.tables == "auto":
            try:
                tables = stream_tables(found)
            except (ValueError, IndexError):
                tables = []
                part.warn("W_TABLE_LOW_CONFIDENCE", f"page {number} extraction failed")
            if tables:
                part.warn("W_TABLE_LOW_CONFIDENCE", f"page {number}")
                out.append(f"### Tables (page {number})\n\n" + "".join(raw.md_table(rows) + "\n" for rows in tables))
                part.engine = "pdf+tables"
    if pdf.encrypted and not some:
        part.warn("W_ENCRYPTED", "no text")
    part.markdown = tree.take("".join(out), part)
