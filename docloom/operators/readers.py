"""One reader for each kind of content: from bytes to a part's Markdown, images and children."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
import zlib
from datetime import UTC
from email.utils import parsedate_to_datetime
from functools import lru_cache
from xml.etree import ElementTree

from docloom.contract import DocumentError, error_for
from docloom.functions import raw
from docloom.operators.compound import Compound
from docloom.operators.pdf import read_pdf
from docloom.operators.tree import Damaged, Encrypted, Part, PartCap, Source, Tree


def read_text(tree: Tree, src: Source, part: Part) -> None:
    text = raw.decode_limited(src.data, max(0, tree.limits.output_chars - tree.output) + 1)
    start = text.lstrip()
    if src.mime == "text/html" or re.match("<(?:!DOCTYPE html|html)", start, re.I):
        text = raw.html_to_text(text)
    elif src.mime == "application/rtf" or start.startswith("{\\rtf"):
        text = raw.rtf_strip(text)
    part.markdown = tree.take(raw.heading(src.path) + text.strip() + "\n", part)


def ocr_block(part: Part, text: str | None) -> str:
    return f"### OCR text ({part.images[-1]})\n\n{text.strip()}\n\n" if text and text.strip() else ""


def read_image(tree: Tree, src: Source, part: Part) -> None:
    text = tree.attach(part, src.data)
    if text:
        part.engine += "+ocr"
    part.markdown = tree.take(raw.heading(src.path) + ocr_block(part, text), part)


# --- archives -----------------------------------------------------------------------------------------------------


def ratio_exceeded(size: int, packed: int, most: float) -> bool:
    return size > 0 and (packed <= 0 or size / packed > most)


def encrypted_entries(archive: zipfile.ZipFile) -> dict[str, bool]:
    return {i.filename: bool(i.flag_bits & 1) for i in archive.infolist()}


def _read_entry(tree: Tree, archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes:
    """An entry's bytes in steps, within its declared size, the ratio and what is left of the budget."""
    lim = tree.limits
    large = info.file_size > lim.zip_floor
    cap = min(info.file_size, int(info.compress_size * lim.zip_ratio)) if large else info.file_size
    tree.fits(cap)
    out = bytearray()
    with archive.open(info) as f:
        while len(out) < cap:
            piece = f.read(min(81_920, cap - len(out)))
            if not piece:
                break
            tree.charge(len(piece))
            out += piece
    if large and cap < info.file_size and len(out) >= cap:
        raise error_for("E_LIMIT_ZIP_RATIO")
    return bytes(out)


def read_zip(tree: Tree, src: Source, part: Part) -> None:
    lim = tree.limits
    archive = zipfile.ZipFile(io.BytesIO(src.data))
    entries = archive.infolist()
    shown = entries[: lim.parts]
    if len(entries) > len(shown):
        part.warn("W_CHILD_LIMIT", "listing cap")
    lines = [f"- `{i.filename.replace(chr(13), ' ').replace(chr(10), ' ')}` ({i.file_size} bytes)\n" for i in shown]
    part.markdown = tree.take(f"{raw.heading(src.path)}Entries:\n\n{''.join(lines)}\n", part)
    if src.depth >= lim.depth:
        part.warn("W_DEPTH_LIMIT", f"depth {src.depth}")
        return
    locked = encrypted_entries(archive)
    for info in entries:
        tree.check_time()
        name = info.filename
        path = re.sub("//+", "/", name.replace("\\", "/").lstrip("/"))
        if not name or name[-1] in "/\\":
            continue
        if not tree.room():
            part.warn("W_CHILD_LIMIT", name)
            break
        if raw.unsafe(name.replace("\\", "/").lstrip("/")):
            part.warn("W_PART_FAILED", "unsafe entry name")
            continue
        if locked.get(name):
            part.warn("W_ENCRYPTED", name)
            continue
        try:
            if info.file_size > lim.zip_floor and ratio_exceeded(info.file_size, info.compress_size, lim.zip_ratio):
                raise error_for("E_LIMIT_ZIP_RATIO")
            data = _read_entry(tree, archive, info)
        except DocumentError as e:
            if e.error_code != "E_LIMIT_ZIP_RATIO" or src.depth == 0:
                raise
            part.warn("W_PART_FAILED", "zip ratio")
            continue
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError):
            part.warn("W_PART_FAILED", name)
            continue
        try:
            tree.process(data, f"{src.path}/{path}", src.depth + 1)
        except PartCap:
            part.warn("W_CHILD_LIMIT", name)
            break


# --- mail ---------------------------------------------------------------------------------------------------------


#: The usual policy, but a header that many mails share is parsed once.
MAIL = email.policy.default.clone(header_factory=lru_cache(4096)(email.policy.default.header_factory))


def read_eml(tree: Tree, src: Source, part: Part) -> None:
    message = email.message_from_bytes(src.data, policy=MAIL)
    out, files = [raw.heading(src.path)], []
    for name in ("From", "To", "Cc", "Subject"):
        if name != "Cc" or message[name]:
            out.append(f"**{name}:** {message[name] or ''}\n\n")
    try:
        when = parsedate_to_datetime(str(message["Date"])) if message["Date"] else None
    except ValueError:
        when = None
    if when:
        when = when.replace(tzinfo=UTC) if when.tzinfo is None else when.astimezone(UTC)
        out.append(f"**Date:** {when:%Y-%m-%d %H:%M:%S}Z\n\n")
    texts: dict[str, str] = {}
    leaves = list(_leaves(message))
    for leaf in leaves:
        kind = leaf.get_content_type()
        if kind in ("text/plain", "text/html") and not leaf.is_attachment():
            texts.setdefault(kind, _mail_text(leaf))
    body = texts.get("text/plain", "")
    body = body if body.strip() else raw.html_to_text(texts.get("text/html"))
    if body.strip():
        out.append(body.strip() + "\n\n")
    for leaf in leaves:
        tree.check_time()
        if leaf.get_content_type() == "message/rfc822":
            inner = leaf.get_payload(0) if leaf.is_multipart() else None
            if inner is not None:
                files.append((raw.safe_name(leaf.get_filename(), "attached-message.eml"), inner.as_bytes()))
            continue
        if leaf.get_content_maintype() == "text" and not leaf.is_attachment():
            continue
        data = leaf.get_payload(decode=True)
        if data is None:
            continue
        if leaf.get_content_maintype() == "image" or raw.sniff(data, None)[0] == "image":
            out.append(ocr_block(part, tree.attach(part, data)))
        else:
            files.append((raw.safe_name(leaf.get_filename(), "attachment.bin"), data))
    if files:
        out.append("Attachments:\n\n" + "".join(f"- {n}\n" for n, _ in files) + "\n")
    part.markdown = tree.take("".join(out), part)
    tree.children(src, part, files)


def _leaves(message):  # noqa: ANN001, ANN202
    if message.is_multipart() and message.get_content_type() != "message/rfc822":
        for sub in message.iter_parts():
            yield from _leaves(sub)
    else:
        yield message


def _mail_text(leaf) -> str:  # noqa: ANN001
    try:
        return leaf.get_content()
    except (LookupError, KeyError, UnicodeError):
        return raw.decode(leaf.get_payload(decode=True) or b"")


def read_msg(tree: Tree, src: Source, part: Part) -> None:
    _message(tree, src, part, Compound(src.data).root)


def _message(tree: Tree, src: Source, part: Part, node) -> None:  # noqa: ANN001
    """A message of a compound file; embedded messages are walked in place."""
    out, files, nested = [raw.heading(part.path)], [], []
    out.append(f"**From:** {node.text(0x0C1A)} <{node.text(0x0C1F) or node.text(0x5D01)}>\n\n**To:** {node.text(0x0E04)}\n\n**Subject:** {node.text(0x0037)}\n\n")
    body = node.text(0x1000)
    if not body.strip():
        page = node.stream("__substg1.0_10130102")
        body = raw.html_to_text(raw.decode(page) if page else node.text(0x1013))
    if body.strip():
        out.append(body.strip() + "\n\n")
    for a in node.storages("__attach_version1.0_"):
        tree.check_time()
        inner = a.storage("__substg1.0_3701000D")
        if inner is not None:
            nested.append((inner.text(0x0037) or None, inner))
            continue
        name = raw.safe_name(a.text(0x3707) or a.text(0x3704), "attachment.bin")
        data = a.stream("__substg1.0_37010102") or b""
        if not data:
            part.warn("W_PART_FAILED", name)
        elif raw.sniff(data, None)[0] == "image":
            out.append(ocr_block(part, tree.attach(part, data)))
        else:
            files.append((name, data))
    if files or nested:
        out.append("Attachments:\n\n" + "".join(f"- {n}\n" for n, _ in files) + "".join(f"- {n or 'message'}.msg\n" for n, _ in nested) + "\n")
    part.markdown = tree.take("".join(out), part)
    tree.children(src, part, files)
    if nested and src.depth >= tree.limits.depth:
        part.warn("W_DEPTH_LIMIT", f"depth {src.depth}")
        return
    for subject, inner in nested:
        if not tree.room():
            part.warn("W_CHILD_LIMIT", subject or "message")
            break
        child = Source(b"", f"{src.path}/{raw.safe_name(subject, 'message')}.msg", src.depth + 1, "msg", "application/vnd.ms-outlook")
        _message(tree, child, tree.add(child, part.engine), inner)


# --- office documents ---------------------------------------------------------------------------------------------


class Package:
    """Parts of an Open XML file by name, each at most ``most`` characters, with their relationships."""

    def __init__(self, data: bytes, most: int):
        self.zip, self.most = zipfile.ZipFile(io.BytesIO(data)), most
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ElementTree.Element | None:
        if name not in self.names:
            return None
        info = self.zip.getinfo(name)
        if info.flag_bits & 1:
            raise Encrypted(name)
        with self.zip.open(info) as f:
            body = f.read(4 * self.most + 1)
        if len(body) > self.most and len(body.decode("utf-8", "replace")) > self.most:
            raise Damaged("part too large")
        return ElementTree.fromstring(body)

    def links(self, name: str) -> dict[str, tuple[str, str]]:
        """Relationships of a part: id to (type, target)."""
        folder, _, leaf = name.rpartition("/")
        root = self.xml(f"{folder}/_rels/{leaf}.rels")
        out = {}
        for r in () if root is None else root:
            target = r.get("Target", "")
            steps: list[str] = [] if target.startswith("/") else folder.split("/")
            for s in target.strip("/").split("/"):
                steps = steps[:-1] if s == ".." else steps if s == "." else [*steps, s]
            out[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], "/".join(steps))
        return out


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ElementTree.Element | None, name: str) -> str | None:
    return None if e is None else next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _kids(e: ElementTree.Element | None, name: str) -> list[ElementTree.Element]:
    return [] if e is None else [x for x in e if _tag(x) == name]


def _kid(e: ElementTree.Element | None, name: str) -> ElementTree.Element | None:
    return next(iter(_kids(e, name)), None)


def _all(e: ElementTree.Element, name: str):  # noqa: ANN202
    return (x for x in e.iter() if _tag(x) == name)


def _text(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in _all(e, "t"))


def read_docx(tree: Tree, src: Source, part: Part) -> None:
    package, main = Package(src.data, tree.limits.office_chars), "word/document.xml"
    out = [raw.heading(src.path)]
    root = package.xml(main)
    _blocks(_kid(root, "body"), out)
    links = list(package.links(main).values())  # in the order of the relationships
    for kind in ("header", "footer"):
        for what, target in links:
            if what == kind and (extra := package.xml(target)) is not None:
                _blocks(extra, out)
    for what, target in links:
        if what == "footnotes" and (notes := package.xml(target)) is not None:
            for note in _kids(notes, "footnote"):
                if _attr(note, "type") not in ("separator", "continuationSeparator", "continuationNotice"):
                    _blocks(note, out)
    part.markdown = tree.take("".join(out), part)


def _blocks(container: ElementTree.Element | None, out: list[str]) -> None:
    for e in () if container is None else container:
        kind = _tag(e)
        if kind == "p":
            text = _text(e).strip()
            if text:
                out.append(_heading_mark(_attr(_kid(_kid(e, "pPr"), "pStyle"), "val") or "") + text + "\n\n")
        elif kind == "tbl":
            rows = [[_text(c) for c in _kids(r, "tc")] for r in _kids(e, "tr")]
            if rows:
                out.append(raw.md_table(rows) + "\n")
        elif kind == "sdt":
            _blocks(_kid(e, "sdtContent"), out)


def _heading_mark(style: str) -> str:
    low = style.lower()
    if low != "title" and not low.startswith("heading"):
        return ""
    digits = style[7:].strip()
    return "#" * (min(max(int(digits) + 2, 3), 6) if re.fullmatch("[+-]?[0-9]+", digits) else 3) + " "


def column_index(reference: str | None) -> int:
    letters = re.match("[A-Za-z]*", reference or "")[0].upper()
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_xlsx(tree: Tree, src: Source, part: Part) -> None:
    lim, package, main = tree.limits, Package(src.data, tree.limits.office_chars), "xl/workbook.xml"
    book = package.xml(main)
    if book is None:
        raise error_for("E_CORRUPT")
    links = package.links(main)
    strings = next((package.xml(t) for kind, t in links.values() if kind == "sharedStrings"), None)
    shared = [_text(s) for s in _kids(strings, "si")]
    sheets = _kids(_kid(book, "sheets"), "sheet")
    part.pages, out, formulas = len(sheets), [raw.heading(src.path)], False
    for sheet in sheets:
        tree.check_time()
        name, hidden = sheet.get("name") or "Sheet", sheet.get("state") in ("hidden", "veryHidden")
        out.append(f"### Sheet: {name}\n\n")
        if hidden:
            part.warn("W_HIDDEN_CONTENT", name)
            out.append("*(hidden)*\n\n")
        link = _attr(sheet, "id")
        if link is None:
            continue
        grid = package.xml(links[link][1]) if link in links else None
        if grid is None:
            raise error_for("E_CORRUPT") if src.depth else Damaged("sheet")
        rows = []
        for number, row in enumerate(_all(grid, "row")):
            if number >= lim.sheet_rows:
                part.warn("W_TRUNCATED", "sheet row cap")
                break
            cells: dict[int, str] = {}
            for cell in _kids(row, "c"):
                formulas = formulas or _kid(cell, "f") is not None
                at = column_index(cell.get("r"))
                at = max(cells, default=-1) + 1 if at < 0 else at
                if at >= lim.sheet_columns:
                    part.warn("W_TRUNCATED", "sheet column cap")
                    continue
                cells[at] = _cell(cell, shared)
            if cells:
                rows.append([cells.get(i, "") for i in range(max(cells) + 1)])
        if rows:
            out.append(raw.md_table(rows) + "\n")
    if formulas:
        part.warn("W_FORMULAS_CACHED_VALUES", "values are cached, not recalculated")
    part.markdown = tree.take("".join(out), part)


def _cell(cell: ElementTree.Element, shared: list[str]) -> str:
    kind, value, formula = cell.get("t"), _kid(cell, "v"), _kid(cell, "f")
    text = (value.text or "") if value is not None else ""
    if kind == "inlineStr":
        inline = _kid(cell, "is")
        return "" if inline is None else "".join(inline.itertext())
    if kind == "s" and text.strip().isdigit() and int(text) < len(shared):
        return shared[int(text)]
    return text or (f"={formula.text or ''}" if formula is not None else "")


def read_pptx(tree: Tree, src: Source, part: Part) -> None:
    package, main = Package(src.data, tree.limits.office_chars), "ppt/presentation.xml"
    deck = package.xml(main)
    if deck is None:
        raise error_for("E_CORRUPT")
    links, out = package.links(main), [raw.heading(src.path)]
    slides = _kids(_kid(deck, "sldIdLst"), "sldId")
    part.pages = len(slides)
    for number, ref in enumerate(slides, 1):
        tree.check_time()
        link = next((v for k, v in ref.attrib.items() if k.startswith("{") and k.endswith("}id")), None)
        if link is None:
            continue
        target = links[link][1] if link in links else ""
        slide = package.xml(target)
        if slide is None:
            raise Damaged("slide")
        out.append(f"### Slide {number}\n\n")
        if slide.get("show") in ("0", "false"):
            part.warn("W_HIDDEN_CONTENT", f"slide {number}")
            out.append("*(hidden)*\n\n")
        out += [t + "\n\n" for p in _all(slide, "p") if (t := _text(p).strip())]
        for kind, where in package.links(target).values():
            if kind == "notesSlide" and (notes := package.xml(where)) is not None and (t := _text(notes).strip()):
                out.append(f"*(notes)* {t}\n\n")
    part.markdown = tree.take("".join(out), part)


READERS = {
    "text": ("text", read_text), "image": ("images", read_image), "pdf": ("pdf", read_pdf), "docx": ("office", read_docx), "xlsx": ("office", read_xlsx), "pptx": ("office", read_pptx),
    "eml": ("eml", read_eml), "msg": ("msg", read_msg), "zip": ("zip", read_zip),
}

