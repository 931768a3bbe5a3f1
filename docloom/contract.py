"""Fixed vocabulary of the engine: codes, limits, options and errors."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

VERSION, SCHEMA_VERSION = "1.0.0", 1

# Exit codes, error codes with their exit code, warning codes with whether they make a result partial.
EXITS = {"ok": 0, "failure": 1, "unsupported": 2, "limits": 3, "corrupt_or_encrypted": 4, "timeout": 5}
ERRORS = {
    "E_USAGE": 1, "E_UNSUPPORTED": 2, "E_LIMIT_INPUT_SIZE": 3, "E_LIMIT_DECOMPRESSED": 3, "E_LIMIT_ZIP_RATIO": 3, "E_LIMIT_PIXELS": 3, "E_LIMIT_CPU": 3, "E_LIMIT_MEMORY": 3,
    "E_ENCRYPTED": 4, "E_CORRUPT": 4, "E_TIMEOUT": 5, "E_FAILED": 1, "E_SELF_TEST": 1, "E_UNSAFE_PATH": 1, "E_SANDBOX": 1,
}
WARNINGS = {
    "W_OCR_USED": False, "W_OCR_UNAVAILABLE": True, "W_NO_TEXT_LAYER": True, "W_TABLE_LOW_CONFIDENCE": False, "W_TRUNCATED": True, "W_DEPTH_LIMIT": True, "W_CHILD_LIMIT": True,
    "W_UNSUPPORTED_CHILD": True, "W_ENCRYPTED": True, "W_PART_FAILED": True, "W_IMAGE_DOWNSCALED": False, "W_IMAGE_SKIPPED": True, "W_FORMULAS_CACHED_VALUES": False, "W_HIDDEN_CONTENT": False,
}
PARTIAL = tuple(code for code, partial in WARNINGS.items() if partial)
#: What reads each kind of content here.
ENGINES = {
    "pdf": "docloom pdf reader", "tables": "docloom table finder", "pdfRaster": "none", "ocr": "pluggable", "office": "zipfile and xml.etree",
    "eml": "email", "msg": "docloom compound file reader", "images": "docloom image headers", "zip": "zipfile", "text": "docloom",
}
#: Names that Windows reserves for devices.
DEVICES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
#: When each code is given, how severe it is and whether it ends the run.
RULES = [
    ("root type unsupported", "E_UNSUPPORTED", "exit 2", True), ("root corrupt", "E_CORRUPT", "exit 4", True), ("root encrypted", "E_ENCRYPTED", "exit 4", True),
    ("root over the input cap", "E_LIMIT_INPUT_SIZE", "exit 3", True), ("zip entry over ratio and floor, root", "E_LIMIT_ZIP_RATIO", "exit 3", True), ("zip entry over ratio, nested", "W_PART_FAILED", "partial", False),
    ("decompressed bytes over the cap", "E_LIMIT_DECOMPRESSED", "exit 3", True), ("root image over the pixel cap", "E_LIMIT_PIXELS", "exit 3", True), ("nested image over the pixel cap", "W_IMAGE_SKIPPED", "partial", False),
    ("CPU limit", "E_LIMIT_CPU", "exit 3", True), ("memory limit", "E_LIMIT_MEMORY", "exit 3", True), ("wall clock elapsed", "E_TIMEOUT", "exit 5", True),
    ("output, page, OCR page or sheet cap", "W_TRUNCATED", "partial", False), ("depth", "W_DEPTH_LIMIT", "partial", False), ("part cap", "W_CHILD_LIMIT", "partial", False),
    ("nested unsupported", "W_UNSUPPORTED_CHILD", "partial", False), ("nested encrypted", "W_ENCRYPTED", "partial", False), ("nested failure or unsafe name", "W_PART_FAILED", "partial", False),
    ("image cap or encode failure", "W_IMAGE_SKIPPED", "partial", False), ("OCR unavailable", "W_OCR_UNAVAILABLE", "partial", False), ("PDF page without text layer", "W_NO_TEXT_LAYER", "partial", False),
    ("OCR produced text", "W_OCR_USED", "info", False), ("table uncertain", "W_TABLE_LOW_CONFIDENCE", "info", False), ("image resized or recompressed", "W_IMAGE_DOWNSCALED", "info", False),
    ("formula cells", "W_FORMULAS_CACHED_VALUES", "info", False), ("hidden sheet or slide", "W_HIDDEN_CONTENT", "info", False), ("no sandbox", "W_SANDBOX_UNAVAILABLE", "info", False),
]


class DocumentError(Exception):
    """A document that can't be extracted: its exit code and error code."""

    def __init__(self, error_code: str, exit_code: int | None = None):
        super().__init__(error_code)
        self.error_code, self.exit_code = error_code, ERRORS.get(error_code, 1) if exit_code is None else exit_code


class UnsupportedFile(DocumentError):
    pass


class LimitExceeded(DocumentError):
    pass


class CorruptFile(DocumentError):
    pass


class ExtractionTimeout(DocumentError):
    pass


class ExtractionFailed(DocumentError):
    pass


def error_for(error_code: str | None, exit_code: int | None = None) -> DocumentError:
    """The typed error of an exit code; a missing code is named after the exit code."""
    exit_code = ERRORS.get(error_code or "", 1) if exit_code is None else exit_code
    error_code = error_code or {2: "E_UNSUPPORTED", 5: "E_TIMEOUT"}.get(exit_code, "E_FAILED")
    kind = {2: UnsupportedFile, 3: LimitExceeded, 4: CorruptFile, 5: ExtractionTimeout}.get(exit_code, ExtractionFailed)
    return kind(error_code, exit_code)


@dataclass(frozen=True)
class Options:
    """What a caller may choose; other values raise E_USAGE."""

    max_output_chars: int = 2_000_000
    max_depth: int = 3
    ocr: str = "auto"
    tables: str = "auto"
    memory_mb: int = 1024
    cpu_seconds: int = 90
    timeout_seconds: int = 100

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, str) and f.name not in ("ocr", "tables"):
                try:
                    value = int(value)
                except ValueError:
                    raise ExtractionFailed("E_USAGE") from None
                object.__setattr__(self, f.name, value)
            good = value in ("auto", "off") if f.name in ("ocr", "tables") else type(value) is int and value >= (f.name != "max_depth")
            if not good:
                raise ExtractionFailed("E_USAGE")

    @classmethod
    def of(cls, options: dict | Options | None) -> Options:
        if options is None or isinstance(options, cls):
            return options or cls()
        if unknown := set(options) - {f.name for f in fields(cls)}:
            raise ExtractionFailed("E_USAGE", 1) from KeyError(*unknown)
        return cls(**options)

    @classmethod
    def parse(cls, args: list[str]) -> tuple[Options, dict[str, str]]:
        """Command-line form: ``--name value`` pairs; --input, --output and --name are returned apart and input and output are required."""
        values: dict[str, str] = {}
        known = {f.name.replace("_", "-") for f in fields(cls)} | {"input", "output", "name"}
        for i in range(0, len(args), 2):
            flag = args[i].removeprefix("--")
            if args[i] == flag or flag not in known or i + 1 >= len(args) or args[i + 1].startswith("--"):
                raise ExtractionFailed("E_USAGE")
            values[flag] = args[i + 1]
        paths = {k: values.pop(k) for k in ("input", "output", "name") if k in values}
        if not {"input", "output"} <= paths.keys():
            raise ExtractionFailed("E_USAGE")
        return cls(**{k.replace("-", "_"): v for k, v in values.items()}), paths


@dataclass(frozen=True)
class Limits:
    """Caps for one document and all that it contains.  Fixed default values."""

    input_bytes: int = 26_214_400
    decompressed_bytes: int = 209_715_200
    zip_ratio: float = 100.0
    zip_floor: int = 1_048_576
    depth: int = 3
    parts: int = 200
    pdf_pages: int = 300
    ocr_pages: int = 50
    pixels: int = 40_000_000
    output_chars: int = 2_000_000
    images: int = 50
    image_edge: int = 1568
    image_bytes: int = 3_932_160
    sheet_rows: int = 10_000
    sheet_columns: int = 256
    office_chars: int = 10_000_000

    def with_options(self, options: Options) -> Limits:
        return replace(self, output_chars=options.max_output_chars, depth=options.max_depth)
