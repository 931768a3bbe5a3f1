"""Test files made with the standard library."""

import io
import struct
import zipfile
import zlib

import numpy as np

from docloom.operators.images import encode_png

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def zipped(files, compression=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compression) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name) if compression == zipfile.ZIP_STORED else name, data)
    return out.getvalue()


def rels(**links):
    body = "".join(f'<Relationship Id="{k}" Type="{R}{kind}" Target="{target}"/>' for k, (kind, target) in links.items())
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{body}</Relationships>'


def para(text, style=None):
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"


def docx():
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('Alpha')}{cell('Beta')}</w:tr><w:tr>{cell('1|2')}{cell('3')}</w:tr></w:tbl>"
    body = para("Big", "Title") + para("Two", "Heading2") + para("DOCX-TOKEN") + table + f"<w:sdt><w:sdtContent>{para('CONTROL')}</w:sdtContent></w:sdt>"
    notes = f'<w:footnotes {W}><w:footnote w:type="separator">{para("SEP")}</w:footnote><w:footnote>{para("NOTE")}</w:footnote></w:footnotes>'
    return zipped({
        "[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": rels(a=("header", "header1.xml"), b=("footer", "footer1.xml"), c=("footnotes", "footnotes.xml")),
        "word/header1.xml": f"<w:hdr {W}>{para('HEAD')}</w:hdr>", "word/footer1.xml": f"<w:ftr {W}>{para('FOOT')}</w:ftr>", "word/footnotes.xml": notes,
    })


def xlsx():
    one = '<row><c r="A1" t="inlineStr"><is><t>Name</t></is></c><c r="C1" t="s"><v>0</v></c></row><row/><row><c r="B3"><f>1+1</f><v>2</v></c><c><f>A1</f></c></row>'
    return zipped({
        "[Content_Types].xml": "<Types/>",
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" state="hidden" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(r1=("worksheet", "worksheets/s1.xml"), r2=("worksheet", "/xl/worksheets/s2.xml"), r3=("sharedStrings", "sharedStrings.xml")),
        "xl/worksheets/s1.xml": f"<worksheet {S}><sheetData>{one}</sheetData></worksheet>",
        "xl/worksheets/s2.xml": f'<worksheet {S}><sheetData><row><c r="A1"><v>7</v></c></row></sheetData></worksheet>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>Sha</t><r><t>red</t></r></si></sst>",
    })


def pptx():
    text = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    return zipped({
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="1" r:id="r1"/><p:sldId id="2" r:id="r2"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(r1=("slide", "slides/s1.xml"), r2=("slide", "slides/s2.xml")),
        "ppt/slides/s1.xml": f"<p:sld {P}>{text('PPTX-TOKEN')}</p:sld>", "ppt/slides/s2.xml": f'<p:sld {P} show="0">{text("second")}</p:sld>',
        "ppt/slides/_rels/s1.xml.rels": rels(n=("notesSlide", "../notesSlides/n1.xml")), "ppt/notesSlides/n1.xml": f"<p:notes {P}>{text('NOTES')}</p:notes>",
    })


def pdf(*pages):
    """A page for each list of (x, y, size, text)."""
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for i, page in enumerate(pages):
        body = zlib.compress("".join(f"BT /F1 {s} Tf {x} {y} Td ({t}) Tj ET\n" for x, y, s, t in page).encode())
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>")
        objects.append(f"<< /Length {len(body)} /Filter /FlateDecode >>\nstream\n".encode() + body + b"\nendstream")
    out = b"%PDF-1.4\n"
    for i, o in enumerate(objects, 1):
        out += f"{i} 0 obj\n".encode() + (o if isinstance(o, bytes) else o.encode()) + b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def png(w=48, h=32, alpha=True):
    pixels = np.full((h, w, 4 if alpha else 3), 255, np.uint8)
    pixels[4:10, 4:20, :3] = 0
    return encode_png(pixels)


def png_header(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", w, h, 8, 6, 0, 0, 0) + b"\0\0\0\0"


def eml(*attachments, body="EML-TOKEN body"):
    from email.message import EmailMessage

    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"] = "A <a@example.com>", "b@example.com", "Hi", "Thu, 01 Feb 2024 10:00:00 +0200"
    m.set_content(body)
    for name, data, kind in attachments:
        m.add_attachment(data, *kind.split("/"), filename=name)
    return m.as_bytes()


def compound(streams, storages=()):
    """Version 3 compound file: root streams, then (name, streams) storages; every stream in the mini stream."""
    entries, mini, minifat = [], b"", []
    tree = [("Root Entry", 5, None)] + [(n, 2, d) for n, d in streams.items()]
    groups = [list(range(1, 1 + len(streams)))]
    for name, inner in storages:
        groups[0].append(len(tree))
        tree.append((name, 1, len(groups)))
        groups.append(list(range(len(tree), len(tree) + len(inner))))
        tree += [(n, 2, d) for n, d in inner.items()]
    right, child = {}, {}
    for g in groups:
        for a, b in zip(g, g[1:], strict=False):
            right[a] = b
    child[0] = groups[0][0]
    for i, (_, kind, d) in enumerate(tree):
        if kind == 1 and groups[d]:
            child[i] = groups[d][0]
    for i, (name, kind, d) in enumerate(tree):
        start, size = 0xFFFFFFFE, 0
        if kind == 2 and d:
            start, size, n = len(minifat), len(d), -(-len(d) // 64)
            minifat += [start + k + 1 for k in range(n - 1)] + [0xFFFFFFFE]
            mini += d.ljust(64 * n, b"\0")
        entries.append([name, kind, right.get(i, 0xFFFFFFFF), child.get(i, 0xFFFFFFFF), start, size])
    pad = lambda b: b.ljust(-(-len(b) // 512) * 512, b"\0")
    directory_n, fat_mini_n, mini_n = -(-len(entries) // 4), -(-len(minifat) * 4 // 512) or 1, len(pad(mini)) // 512
    at_dir, at_minifat, at_mini = 1, 1 + directory_n, 1 + directory_n + fat_mini_n
    entries[0][4:] = [at_mini if mini else 0xFFFFFFFE, len(mini)]
    chain = lambda a, n: [a + k + 1 for k in range(n - 1)] + [0xFFFFFFFE] if n else []
    fat = [0xFFFFFFFD] + chain(at_dir, directory_n) + chain(at_minifat, fat_mini_n) + chain(at_mini, mini_n)
    fat += [0xFFFFFFFF] * (128 - len(fat))
    body = struct.pack("<128I", *fat)
    d = b""
    for name, kind, r, c, start, size in entries:
        raw = name.encode("utf-16-le")
        d += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, 0xFFFFFFFF, r, c) + bytes(36) + struct.pack("<IQ", start, size)
    body += pad(d) + struct.pack(f"<{len(minifat)}I", *minifat).ljust(512 * fat_mini_n, b"\xff") + pad(mini)
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10)
    head += struct.pack("<IIIIIIIII", 1, at_dir, 0, 4096, at_minifat, fat_mini_n, 0xFFFFFFFE, 0, 0) + struct.pack("<108I", *[0xFFFFFFFF] * 108)
    return head[:512].ljust(512, b"\xff") + body


def msg():
    wide = lambda t: t.encode("utf-16-le")
    streams = {"__substg1.0_0037001F": wide("Subj"), "__substg1.0_1000001F": wide("MSG-TOKEN"), "__substg1.0_0C1A001F": wide("Ann"), "__substg1.0_0C1F001F": wide("a@x.org"), "__substg1.0_0E04001F": wide("Bob"), "__properties_version1.0": bytes(32)}
    return compound(streams, [("__attach_version1.0_#00000000", {"__substg1.0_3707001F": wide("note.txt"), "__substg1.0_37010102": b"attached text"})])
