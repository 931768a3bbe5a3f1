"""Byte-level functions of one document, for the Arrow path: decoding, sniffing, image headers."""

from __future__ import annotations

import html
import io
import re
import struct
import zipfile

from docloom.contract import DEVICES

OFFICE = (
    ("word/document.xml", "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("xl/workbook.xml", "xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    ("ppt/presentation.xml", "pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
)
UNSUPPORTED = ("unsupported", "application/octet-stream")
OLE = bytes.fromhex("D0CF11E0A1B11AE1")


def units(text: str) -> int:
    """UTF-16 code units."""
    return len(text) + sum(ch > "\uffff" for ch in text) if not text.isascii() else len(text)


def cut_units(text: str, n: int) -> str:
    """At most ``n`` UTF-16 units, never half a character."""
    if n <= 0:
        return ""
    if len(text) <= n and units(text) <= n:
        return text
    raw = text.encode("utf-16-le", "surrogatepass")[: 2 * n]
    if raw[-1] & 0xFC == 0xD8:
        raw = raw[:-2]
    return raw.decode("utf-16-le", "surrogatepass")


def utf16_order(data: bytes) -> str | None:
    """Byte order of UTF-16 without a mark: zeros on one side of most of the first pairs and hardly any on the other."""
    if len(data) < 8:
        return None
    head = data[: min(len(data), 256) & ~1]
    pairs, even, odd = len(head) // 2, head[::2].count(0), head[1::2].count(0)
    if odd > pairs * 0.6 and even < pairs * 0.25:
        return "utf-16-le"
    return "utf-16-be" if even > pairs * 0.6 and odd < pairs * 0.25 else None


def decode(data: bytes) -> str:
    """Text of bytes: by mark, by the look of UTF-16, as UTF-8, or else as windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    if order := utf16_order(data):
        return data[: len(data) & ~1].decode(order, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in data)


def decode_limited(data: bytes, n: int) -> str:
    """At most ``n`` units, decoded from no more bytes than they can take."""
    return cut_units(decode(data[: max(4 * n, 8)]), n) if n > 0 and data else ""


_SCRIPT = {tag: re.compile(rf"<{tag}\b[^>]*>", re.I) for tag in ("script", "style")}
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style")}
_BREAK = re.compile(r"<(?:br|/p|/div|/tr|/h[1-6])\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]+>")
_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _without(tag: str, text: str) -> str:
    """Elements of a tag replaced by a blank, in linear time: the search ends where no closing tag follows."""
    out, at = [], 0
    while (opening := _SCRIPT[tag].search(text, at)) and (closing := _CLOSE[tag].search(text, opening.end())):
        out += [text[at : opening.start()], " "]
        at = closing.end()
    return "".join([*out, text[at:]])


def _tags(text: str, pattern: re.Pattern, new: str) -> str:
    """Replace tags up to the last ``>``; behind it none can end."""
    end = text.rfind(">") + 1
    return pattern.sub(new, text[:end]) + text[end:]


def html_to_text(text: str | None) -> str:
    if not text:
        return ""
    text = _tags(_tags(_without("style", _without("script", text)), _BREAK, "\n"), _TAG, " ")
    return white_space(_ENTITY.sub(lambda m: html.unescape(m[0]), text))


def white_space(text: str) -> str:
    """No carriage returns, two adjacent newlines at most, other runs one blank and none at a line's start; trimmed."""
    text = re.sub("\n{3,}", "\n\n", text.replace("\r", ""))
    return re.sub(r"[^\S\n]+", " ", re.sub(r"(^|\n)[^\S\n]+", r"\1", text)).strip()


def rtf_strip(text: str) -> str:
    return re.sub("[{}]", "", re.sub(r"\\[^\W\d_]*(?:[^\\\w]|[\d_])?", "", text))


def heading(path: str) -> str:
    return f"## {path.replace(chr(13), ' ').replace(chr(10), ' ').strip()}\n\n"


def md_cell(value: str | None) -> str:
    return (value or "").replace("|", "\\|").replace("\r", " ").replace("\n", " ").strip()


def md_table(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    line = lambda cells: f"| {' | '.join(cells)} |\n"
    full = [line(md_cell(r[i]) if i < len(r) else "" for i in range(width)) for r in rows]
    return full[0] + line(["---"] * width) + "".join(full[1:])


def reserved(name: str) -> bool:
    return name.rstrip(" .").split(".")[0].rstrip(" .").upper() in DEVICES


def unsafe(path: str | None) -> bool:
    """Whether a relative path could leave its folder or name a device."""
    p = (path or "").replace("\\", "/")
    return not p.strip() or ":" in p or "\0" in p or any(s in ("", ".", "..") or reserved(s) for s in p.split("/"))


def safe_name(name: str | None, fallback: str) -> str:
    leaf = ((name if name and name.strip() else fallback).replace("\\", "/").rsplit("/", 1)[-1]).replace(":", "_").replace("\0", "").strip()
    return fallback if leaf in ("", ".", "..") or reserved(leaf) else leaf


def extension(name: str | None) -> str:
    leaf = (name or "").replace("\\", "/").rsplit("/", 1)[-1]
    dot = leaf.rfind(".")
    return leaf[dot:].lower() if 0 <= dot < len(leaf) - 1 else ""


HEADERS = ("from:", "mime-version:", "received:", "content-type:", "subject:", "to:")


CONTROL = bytes(b for b in range(32) if not 9 <= b <= 13)


def sniff(data: bytes, name: str | None) -> tuple[str, str]:
    """(kind, mime) by content first, by name only if the content says nothing; the first rule that holds wins."""
    if len(data) >= 5 and data.startswith(b"%PDF"):
        return "pdf", "application/pdf"
    if mime := image_mime(data):
        return "image", mime
    if data.startswith(OLE):
        if b"EncryptedPackage" in data:
            return "unsupported", "application/vnd.ms-office.encrypted"
        if b"__substg1.0" in data or b"__nameid_version1.0" in data or extension(name) == ".msg":
            return "msg", "application/vnd.ms-outlook"
        return "unsupported", "application/x-cfb"
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"):
        try:
            names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
        except (zipfile.BadZipFile, ValueError, OSError, struct.error, NotImplementedError):
            names = set()
        return next(((kind, mime) for entry, kind, mime in OFFICE if entry in names), ("zip", "application/zip"))
    ext, head = extension(name), data[:4096]
    wide = len(data) >= 8 and data[1:200:2].count(0) > min(len(data), 200) // 8
    marked = data.startswith((b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff"))
    control = len(head) - len(head.translate(None, CONTROL))
    if wide or marked or (data and 0 not in head and control * 20 < len(head)):
        text = decode(data[:8192])
        if re.match(r"<(?:!DOCTYPE html|html|head|body)", text.lstrip("\ufeff \t\r\n"), re.I):
            return "text", "text/html"
        lines = [x.lower() for x in text.split("\n")[:40]]
        found = [any(x.startswith(h) for x in lines) for h in HEADERS]
        if (ext == ".eml" and any(found[i] for i in (0, 1, 2, 4))) or (sum(found) >= 2 and any(found[:3])):
            return "eml", "message/rfc822"
        return "text", "application/rtf" if text.strip().startswith("{\\rtf") else "text/plain"
    if ext in (".txt", ".csv", ".log", ".json", ".xml", ".md"):
        return "text", "text/plain"
    if ext in (".htm", ".html"):
        return "text", "text/html"
    return ("eml", "message/rfc822") if ext == ".eml" else UNSUPPORTED


def image_mime(data: bytes) -> str | None:
    if data.startswith(b"\x89PNG") and len(data) >= 8:
        return "image/png"
    if data.startswith(b"\xff\xd8\xff"):
        return "image/jpeg"
    if data.startswith(b"GIF") and len(data) >= 6:
        return "image/gif"
    if data.startswith(b"BM"):
        return "image/bmp"
    if data.startswith(b"RIFF") and data[8:12] == b"WEBP":
        return "image/webp"
    return "image/tiff" if data[:4] in (b"II*\0", b"MM\0*") else None


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the header."""
    try:
        mime = image_mime(data)
        if mime == "image/png":
            return struct.unpack(">II", data[16:24])
        if mime == "image/gif":
            return struct.unpack("<HH", data[6:10])
        if mime == "image/bmp":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if mime == "image/jpeg":
            return _jpeg_size(data)
        if mime == "image/webp":
            if data[12:16] == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if data[12:16] == b"VP8 ":
                w, h = struct.unpack("<HH", data[26:30])
                return w & 0x3FFF, h & 0x3FFF
        if mime == "image/tiff":
            return _tiff_size(data)
    except (struct.error, IndexError):
        pass
    return None


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker in (0x01, *range(0xD0, 0xDA)):
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        else:
            at += 2 + max(struct.unpack(">H", data[at + 2 : at + 4])[0], 2)
    return None


def _tiff_size(data: bytes) -> tuple[int, int] | None:
    e = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(e + "I", data[4:8])[0]
    sizes: dict[int, int] = {}
    for i in range(struct.unpack(e + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind = struct.unpack(e + "HH", entry[:4])
        if tag in (256, 257) and kind in (3, 4):
            sizes[tag] = struct.unpack(e + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
    return (sizes[256], sizes[257]) if len(sizes) == 2 else None
