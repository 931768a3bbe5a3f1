"""Extraction of one document and all that it contains, under one budget."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from docloom.contract import PARTIAL, DocumentError, Limits, Options, error_for
from docloom.functions import raw


class Encrypted(Exception):
    """Content that needs a password."""


class Damaged(Exception):
    """Content that doesn't follow its format."""


class PartCap(Exception):
    """No further part may be added."""


class OcrEngine(Protocol):
    """Pluggable text recognition; ``reason`` says why it is unavailable, or is None."""

    reason: str | None

    def recognize(self, image: bytes) -> str: ...


class NoOcr:
    reason = "no OCR engine"

    def recognize(self, image: bytes) -> str:
        return ""


@dataclass
class Part:
    index: int
    parent: int | None
    path: str
    depth: int
    kind: str
    mime: str
    size: int
    engine: str
    pages: int | None = None
    markdown: str = ""
    truncated: bool = False
    duration_ms: int = 0
    warnings: dict[str, str] = field(default_factory=dict)
    images: list[str] = field(default_factory=list)

    def warn(self, code: str, detail: str) -> None:
        """One entry for each code; a detail that its text already contains is not added."""
        old = self.warnings.get(code)
        if old is None:
            self.warnings[code] = detail
        elif detail not in old:
            self.warnings[code] = f"{old}; {detail}"


@dataclass
class Image:
    id: str
    part: int
    mime: str
    extension: str
    width: int
    height: int
    data: bytes
    ocr_chars: int


@dataclass
class Source:
    """Bytes to extract, where they are and what they were found to be."""

    data: bytes
    path: str
    depth: int
    kind: str
    mime: str


class Tree:
    """State of one document's extraction: parts and images in order, and what is left of each limit."""

    def __init__(self, options: Options | None = None, limits: Limits | None = None, ocr: OcrEngine | None = None, readers: dict[str, Callable] | None = None):
        from docloom.operators.readers import READERS

        self.options = options or Options()
        self.limits = limits or Limits().with_options(self.options)
        self.ocr, self.readers = ocr or NoOcr(), readers or READERS
        self.parts: list[Part] = []
        self.images: list[Image] = []
        self.output = self.unpacked = self.pdf_pages = self.ocr_pages = 0
        self.cut = False
        self.ends = time.monotonic() + self.options.timeout_seconds
        self._open: list[int] = []

    def check_time(self) -> None:
        if time.monotonic() > self.ends:
            raise error_for("E_TIMEOUT")

    def add(self, src: Source, engine: str, kind: str | None = None, size: int | None = None) -> Part:
        part = Part(len(self.parts), self._open[-1] if self._open else None, src.path, src.depth, kind or src.kind, src.mime, len(src.data) if size is None else size, engine)
        self.parts.append(part)
        return part

    def room(self) -> bool:
        return len(self.parts) < self.limits.parts

    def take(self, text: str, part: Part) -> str:
        """What of the text the output budget still allows."""
        kept = raw.cut_units(text, self.limits.output_chars - self.output)
        self.output += raw.units(kept)
        if len(kept) < len(text):
            self.cut = part.truncated = True
            part.warn("W_TRUNCATED", "output char cap")
        return kept

    def fits(self, n: int) -> None:
        if self.unpacked + n > self.limits.decompressed_bytes:
            raise error_for("E_LIMIT_DECOMPRESSED")

    def charge(self, n: int) -> None:
        self.fits(n)
        self.unpacked += n

    def pdf_page(self) -> bool:
        free = self.pdf_pages < self.limits.pdf_pages
        self.pdf_pages += free
        return free

    def ocr_page(self) -> bool:
        free = self.ocr_pages < self.limits.ocr_pages
        self.ocr_pages += free
        return free

    def attach(self, part: Part, data: bytes) -> str | None:
        """Add an image to a part: header, pixel cap, image cap, size, then recognition."""
        from docloom.operators.images import normalized

        self.check_time()
        size = raw.image_size(data)
        if size is None:
            part.warn("W_PART_FAILED", "image header")
            return None
        w, h = size
        if w <= 0 or h <= 0:
            raise error_for("E_CORRUPT")
        if w * h > self.limits.pixels:
            if part.depth == 0:
                raise error_for("E_LIMIT_PIXELS")
            part.warn("W_IMAGE_SKIPPED", "pixel cap")
            return None
        if len(self.images) >= self.limits.images:
            part.warn("W_IMAGE_SKIPPED", "image cap")
            return None
        made, reason = normalized(data, self.limits)
        if made is None:
            part.warn("W_IMAGE_SKIPPED", reason)
            return None
        if made.downscaled:
            part.warn("W_IMAGE_DOWNSCALED", f"{made.width}x{made.height}")
        name, text = f"img-{len(self.images)}", None
        if self.options.ocr == "auto":
            if self.ocr.reason is not None:
                part.warn("W_OCR_UNAVAILABLE", self.ocr.reason)
            elif not self.ocr_page():
                part.warn("W_TRUNCATED", "ocr page cap")
            else:
                text = (self.ocr.recognize(data) or "").strip()
                if text:
                    part.warn("W_OCR_USED", name)
        self.images.append(Image(name, part.index, made.mime, made.extension, made.width, made.height, made.data, raw.units(text or "")))
        part.images.append(name)
        return text

    def process(self, data: bytes, path: str, depth: int = 0) -> None:
        """Detect and read one file; a nested file that can't be read becomes a warning, the root an error."""
        self.check_time()
        if not self.room():
            raise PartCap
        root = depth == 0
        if root and len(data) > self.limits.input_bytes:
            raise error_for("E_LIMIT_INPUT_SIZE")
        if root and not data:
            raise error_for("E_CORRUPT")
        src = Source(data, path, depth, *raw.sniff(data, path))
        if src.kind not in self.readers:
            locked = src.mime == "application/vnd.ms-office.encrypted"
            if root:
                raise error_for("E_ENCRYPTED" if locked else "E_UNSUPPORTED")
            part = self.add(src, "none")
            part.warn(*(("W_ENCRYPTED", "EncryptedPackage") if locked else ("W_UNSUPPORTED_CHILD", path)))
            part.markdown = self.take(raw.heading(path) + ("Encrypted content.\n" if locked else "Unsupported content.\n"), part)
            return
        engine, reader = self.readers[src.kind]
        part, began = self.add(src, engine), time.monotonic()
        self._open.append(part.index)
        try:
            reader(self, src, part)
        except (DocumentError, PartCap):
            raise
        except Exception as e:
            locked = isinstance(e, Encrypted)
            if root:
                raise error_for("E_ENCRYPTED" if locked else "E_CORRUPT" if isinstance(e, (Damaged, ValueError, EOFError)) or "Bad" in type(e).__name__ or "Parse" in type(e).__name__ else "E_FAILED") from e
            part.warn("W_ENCRYPTED" if locked else "W_PART_FAILED", type(e).__name__)
            if not part.markdown:
                part.markdown = self.take(raw.heading(path) + "This part could not be read.\n", part)
        finally:
            self._open.pop()
            part.duration_ms = int((time.monotonic() - began) * 1000)

    def children(self, src: Source, part: Part, files: list[tuple[str, bytes]]) -> None:
        """Read attachments one level deeper, while depth and part cap allow."""
        if not files:
            return
        if src.depth >= self.limits.depth:
            part.warn("W_DEPTH_LIMIT", f"depth {src.depth}")
            return
        for name, data in files:
            try:
                self.process(data, f"{src.path}/{name}", src.depth + 1)
            except PartCap:
                part.warn("W_CHILD_LIMIT", name)
                break

    def status(self) -> str:
        return "partial" if self.cut or any(p.truncated or any(c in PARTIAL for c in p.warnings) for p in self.parts) else "ok"


def extract_bytes(data: bytes, name: str, options: Options | None = None, limits: Limits | None = None, ocr: OcrEngine | None = None) -> Tree:
    """The extracted tree of one file; raises a DocumentError for what ends a run."""
    tree = Tree(options, limits, ocr)
    try:
        tree.process(data, name)
    except MemoryError as e:
        raise error_for("E_LIMIT_MEMORY") from e
    return tree
