import time
import zipfile

import pytest

from docloom.contract import CorruptFile, DocumentError, ExtractionFailed, LimitExceeded, Limits, Options, UnsupportedFile, error_for
from docloom.functions import raw
from docloom.operators.images import decode_png, normalized
from docloom.operators.readers import column_index, ratio_exceeded
from docloom.operators.tree import extract_bytes
from tests import fixtures as X


def run(data, name="file", limits=None, ocr=None, **options):
    return extract_bytes(data, name, Options(**options), limits, ocr)


def codes(tree):
    return {c: d for p in tree.parts for c, d in p.warnings.items()}


def test_text_html_rtf():
    t = run(b"one TOKEN\ntwo", "hello.txt")
    assert t.parts[0].markdown == "## hello.txt\n\none TOKEN\ntwo\n" and t.status() == "ok" and t.parts[0].kind == "text"
    t = run(b"<html><body><p>Hi <b>there</b></p><script>alert(1)</script>&amp;&eacute;&amp</body></html>", "a.html")
    assert t.parts[0].markdown == "## a.html\n\nHi there \n&é&amp\n"
    assert run(rb"{\rtf1\b bold \fs24 x}", "a.rtf").parts[0].markdown == "## a.rtf\n\nbold 4 x\n"


def test_office():
    t = run(X.docx(), "a.docx")
    m = t.parts[0].markdown
    assert "### Big\n" in m and "#### Two\n" in m and "| Alpha | Beta |\n| --- | --- |\n| 1\\|2 | 3 |\n" in m
    assert [m.index(x) for x in ("DOCX-TOKEN", "CONTROL", "HEAD", "FOOT", "NOTE")] == sorted(m.index(x) for x in ("DOCX-TOKEN", "CONTROL", "HEAD", "FOOT", "NOTE")) and "SEP" not in m
    t = run(X.xlsx(), "a.xlsx")
    m = t.parts[0].markdown
    assert t.parts[0].pages == 2 and "| Name |  | Shared |\n| --- | --- | --- |\n|  | 2 | =A1 |\n" in m and "### Sheet: Two\n\n*(hidden)*\n" in m
    assert codes(t) == {"W_HIDDEN_CONTENT": "Two", "W_FORMULAS_CACHED_VALUES": "values are cached, not recalculated"}
    t = run(X.pptx(), "a.pptx")
    m = t.parts[0].markdown
    assert t.parts[0].pages == 2 and "### Slide 1\n\nPPTX-TOKEN\n\n*(notes)* NOTES\n\n### Slide 2\n\n*(hidden)*\n\nsecond" in m and codes(t) == {"W_HIDDEN_CONTENT": "slide 2"}
    assert column_index("AB7") == 27 and column_index("") == column_index(None) == -1


def test_pdf():
    t = run(X.pdf([(72, 720, 12, "PDF-TOKEN with enough words")], [(72, 720, 20, "Large heading of page two")]), "a.pdf")
    m = t.parts[0].markdown
    assert t.parts[0].pages == 2 and "### Page 1\n\nPDF-TOKEN with enough words" in m and "### Large heading of page two" in m and t.status() == "ok"
    t = run(X.pdf([(72, 700 - 14 * i, 12, f"A line of plain prose, number {i}") for i in range(4)]), "a.pdf")
    assert "|" not in t.parts[0].markdown
    t = run(X.pdf([(72 + 120 * c, 700 - 14 * r, 10, f"r{r}c{c}") for r in range(4) for c in range(3)]), "a.pdf")
    assert "| r0c0 | r0c1 | r0c2 |" in t.parts[0].markdown and "W_TABLE_LOW_CONFIDENCE" in codes(t)
    page = [(72, 720, 12, "words that fill the page well")]
    t = run(X.pdf(page, page), "a.pdf", Limits(pdf_pages=1))
    assert "### Page 2" not in t.parts[0].markdown and codes(t)["W_TRUNCATED"] == "pdf page cap"
    t = run(X.pdf([(72, 720, 12, "thin")]), "a.pdf")
    assert "W_NO_TEXT_LAYER" in codes(t) and t.status() == "partial"
    with pytest.raises(CorruptFile, match="E_CORRUPT"):
        run(b"%PDF-1.4 trunc", "a.pdf")


def test_mail():
    t = run(X.eml(("note.txt", b"inside", "text/plain"), ("p.png", X.png(), "image/png")), "mail.eml")
    m = t.parts[0].markdown
    assert "**From:** A <a@example.com>" in m and "**Date:** 2024-02-01 08:00:00Z" in m and "EML-TOKEN body" in m and "Attachments:\n\n- note.txt\n" in m
    assert [(p.path, p.depth, p.parent) for p in t.parts] == [("mail.eml", 0, None), ("mail.eml/note.txt", 1, 0)] and t.parts[0].images == ["img-0"]
    t = run(X.msg(), "a.msg")
    assert "**From:** Ann <a@x.org>\n\n**To:** Bob\n\n**Subject:** Subj\n\nMSG-TOKEN" in t.parts[0].markdown and t.parts[1].markdown.endswith("attached text\n")


def test_image():
    t = run(X.png(), "a.png")
    assert (t.images[0].id, t.images[0].width, t.images[0].height, t.images[0].part) == ("img-0", 48, 32, 0) and t.status() == "partial" and "W_OCR_UNAVAILABLE" in codes(t)

    class Reader:
        reason = None

        def recognize(self, image):
            return " seen "

    t = extract_bytes(X.png(), "a.png", ocr=Reader())
    assert t.parts[0].markdown.endswith("### OCR text (img-0)\n\nseen\n\n") and t.images[0].ocr_chars == 4 and t.status() == "ok"
    small, _ = normalized(X.png(2000, 100), Limits())
    assert (small.width, small.height, small.downscaled) == (1568, 78, True) and decode_png(small.data).shape == (78, 1568, 4)
    assert extract_bytes(X.png(), "a.png", Options(ocr="off")).status() == "ok"


def test_zip_order_depth_caps():
    t = run(X.zipped({"inner.txt": "hello", "d/": "", "b.zip": X.zipped({"c.txt": "deep"})}), "a.zip")
    assert [p.path for p in t.parts] == ["a.zip", "a.zip/inner.txt", "a.zip/b.zip", "a.zip/b.zip/c.txt"] and [p.parent for p in t.parts] == [None, 0, 0, 2]
    assert "- `inner.txt` (5 bytes)\n" in t.parts[0].markdown and t.unpacked >= 5
    t = run(X.zipped({"b.zip": X.zipped({"c.txt": "deep"})}), "a.zip", max_depth=1)
    assert len(t.parts) == 2 and codes(t) == {"W_DEPTH_LIMIT": "depth 1"} and t.status() == "partial"
    t = run(X.zipped({f"{i}.txt": "x" for i in range(3)}), "a.zip", Limits(parts=2))
    assert len(t.parts) == 2 and "W_CHILD_LIMIT" in codes(t)
    t = run(X.zipped({"../escape.txt": "x", "ok.txt": "y", "/lead.txt": "z"}), "a.zip")
    assert [p.path for p in t.parts] == ["a.zip", "a.zip/ok.txt", "a.zip/lead.txt"] and codes(t)["W_PART_FAILED"] == "unsafe entry name"


def test_bombs():
    bomb = X.zipped({"z": bytes(2_000_000)})
    with pytest.raises(LimitExceeded, match="E_LIMIT_ZIP_RATIO"):
        run(bomb, "a.zip")
    t = run(X.zipped({"b.zip": bomb}, zipfile.ZIP_STORED), "a.zip")
    assert codes(t)["W_PART_FAILED"] == "zip ratio" and t.status() == "partial"
    assert run(X.zipped({"z.txt": b"a" * 65_536}), "a.zip").status() == "ok"
    with pytest.raises(LimitExceeded, match="E_LIMIT_DECOMPRESSED"):
        run(X.zipped({"r": bytes(range(250)) * 16}, zipfile.ZIP_STORED), "a.zip", Limits(decompressed_bytes=100))
    began = time.time()
    with pytest.raises(LimitExceeded, match="E_LIMIT_PIXELS"):
        run(X.png_header(100_000, 100_000), "a.png")
    t = run(X.zipped({"p.png": X.png_header(100_000, 100_000)}), "a.zip")
    assert codes(t)["W_IMAGE_SKIPPED"] == "pixel cap"
    assert raw.html_to_text("<script" * 20_000 + "<p>kept</p>").endswith("kept") and time.time() - began < 2
    assert [ratio_exceeded(*x, 100) for x in ((1000, 10), (1001, 10), (50, 0), (0, 0))] == [False, True, True, False]


def test_failures():
    for data, code in ((b"", "E_CORRUPT"), (bytes(range(1, 9)) + b"\x01", "E_UNSUPPORTED"), (raw.OLE + b"EncryptedPackage", "E_ENCRYPTED"), (b"PK\x03\x04 broken", "E_CORRUPT")):
        with pytest.raises(DocumentError, match=code):
            run(data, "x")
    with pytest.raises(LimitExceeded, match="E_LIMIT_INPUT_SIZE"):
        run(b"x" * 64, "x.txt", Limits(input_bytes=32))
    t = run(X.zipped({"bad.docx": X.zipped({"word/document.xml": "<broken"}), "x.bin": b"\x01\x02"}), "a.zip")
    assert t.parts[1].markdown.endswith("This part could not be read.\n") and "W_PART_FAILED" in t.parts[1].warnings and t.parts[2].markdown.endswith("Unsupported content.\n")
    assert codes(t)["W_UNSUPPORTED_CHILD"] == "a.zip/x.bin"
    assert type(error_for(None, 2)) is UnsupportedFile and error_for(None, 3).error_code == "E_FAILED" and error_for(None, 5).error_code == "E_TIMEOUT"


def test_options():
    assert Options.of({"max_depth": "0"}).max_depth == 0
    for bad in ({"max_depth": -1}, {"max_output_chars": 0}, {"ocr": "on"}, {"no": 1}, {"timeout_seconds": "x"}, {"cpu_seconds": True}):
        with pytest.raises(ExtractionFailed, match="E_USAGE"):
            Options.of(bad)
    o, paths = Options.parse(["--input", "a", "--output", "b", "--max-depth", "2"])
    assert o.max_depth == 2 and paths == {"input": "a", "output": "b"}
    for bad in (["--input", "a"], ["--input", "--output"], ["--what", "1"], ["--input"]):
        with pytest.raises(ExtractionFailed):
            Options.parse(bad)


def test_budget_and_surrogates():
    for cap in range(1, 40):
        t = run(X.zipped({"a.txt": "x😀y😀", "b.txt": "tail"}), "z", max_output_chars=cap)
        whole = "".join(p.markdown for p in t.parts)
        assert raw.units(whole) <= cap and not (whole and "\ud800" <= whole[-1] <= "\udbff")
        assert t.status() == ("partial" if t.cut else "ok")
    assert raw.cut_units("a😀", 2) == "a" and raw.cut_units("a😀", 3) == "a😀" and raw.units("a😀") == 3


def test_decoding_and_sniffing():
    for enc in ("utf-16-le", "utf-16-be"):
        assert raw.decode("Hello there".encode(enc)) == "Hello there"
    assert raw.decode("﻿é".encode()) == "é" and raw.decode(b"caf\xe9 \x80") == "café €"
    assert raw.sniff(X.docx(), "a.zip")[0] == "docx" and raw.sniff(X.zipped({"a": "b"}), "a.docx")[0] == "zip"
    assert raw.sniff(raw.OLE + b"x", "a.msg")[0] == "msg" and raw.sniff(raw.OLE + b"x", "a.doc")[0] == "unsupported"
    assert raw.sniff(b"From: a\nSubject: b\n\nx", None)[0] == "eml" and raw.sniff(b"GIF not", None)[0] == "image" and raw.sniff(b"Subject: x", "a.eml")[0] == "eml"
    assert raw.image_size(X.png_header(7, 9)) == (7, 9) and raw.image_size(b"GIF89a\x05\0\x06\0") == (5, 6)
    for bad in ("", "  ", "/a", "a/../b", "a//b", "a:b", "con", "a/NUL.txt", "com1 .x", "..", "a\0b"):
        assert raw.unsafe(bad)
    assert not raw.unsafe("a/b.txt") and raw.safe_name("../x:y.txt", "f") == "x_y.txt" and raw.safe_name("aux", "f") == "f" and raw.safe_name(None, "f") == "f"
