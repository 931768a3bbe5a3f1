"""Text, Markdown and number functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.contract import DEVICES


def trim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def heading(path: Column) -> Column:
    """``## path`` and an empty line; line breaks of the path become blanks."""
    return F.concat(F.lit("## "), trim(F.translate(path, "\r\n", "  ")), F.lit("\n\n"))


def md_cell(value: Column) -> Column:
    """Text for a table cell: null is empty, pipes are escaped, line breaks are blanks."""
    return trim(F.translate(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|")), "\r\n", "  "))


def md_table(rows: Column) -> Column:
    """Markdown table of an array of arrays: the first row is the header, short rows are padded; empty for no rows."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: md_cell(F.get(r, i))), " | "), F.lit(" |\n"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |\n"))
    body = F.array_join(F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line), "")
    return F.when((F.size(rows) > 0) & (width > 0), F.concat(line(rows[0]), rule, body)).otherwise(F.lit(""))


#: Patterns of scripts, styles, breaking tags and other tags.
SCRIPT, STYLE = r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>"
BREAK, TAG = r"(?i)<(br|/p|/div|/tr|/h[1-6])\b[^>]*>", r"<[^>]+>"


def html_to_text(html: Column) -> Column:
    """Readable text of HTML: no scripts, styles and tags; common entities (with semicolon) decoded; white space normalised.

    The script and style patterns run only where a closing tag exists, which keeps unclosed tags linear.
    """
    t = html
    for tag, pattern in (("script", SCRIPT), ("style", STYLE)):
        t = F.when(F.contains(F.lower(t), F.lit(f"</{tag}")), F.regexp_replace(t, pattern, " ")).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, BREAK, "\n"), TAG, " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return white_space(t)


def white_space(t: Column) -> Column:
    """No carriage returns, at most two newlines in a row, other runs one blank and none at a line's start; trimmed."""
    t = F.regexp_replace(F.replace(t, F.lit("\r"), F.lit("")), "\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"(?U)(^|\n)[^\S\n]+", "$1")
    return trim(F.regexp_replace(t, r"(?U)[^\S\n]+", " "))


def rtf_strip(t: Column) -> Column:
    """RTF without control words and braces."""
    return F.regexp_replace(F.regexp_replace(t, r"\\\p{L}*[^\p{L}\\]?", ""), "[{}]", "")


def utf16_len(t: Column) -> Column:
    """UTF-16 code units."""
    return (F.octet_length(F.encode(t, "UTF-16LE")) / 2).cast("int")


def utf16_truncate(t: Column, n: Column) -> Column:
    """At most ``n`` UTF-16 units, one fewer rather than half a character."""
    cut = F.decode(F.substring(F.encode(t, "UTF-16LE"), F.lit(1), 2 * n), "UTF-16LE")
    half = F.hex(F.substring(F.encode(t, "UTF-16LE"), 2 * n, F.lit(1))).rlike("^D[89AB]$")
    short = F.decode(F.substring(F.encode(t, "UTF-16LE"), F.lit(1), 2 * n - 2), "UTF-16LE")
    return F.when(utf16_len(t) <= n, t).when(n <= 0, F.lit("")).when(half, short).otherwise(cut)


def utf16_slice(t: Column, start: Column, end: Column) -> Column:
    """UTF-16 units ``start`` to ``end``, without halves of characters at either end; empty beyond the text."""
    raw = F.encode(t, "UTF-16LE")
    high = lambda at: F.hex(F.substring(raw, 2 * at + 2, F.lit(1)))
    first = F.when(high(start).rlike("^D[C-F]$"), start + 1).otherwise(start)
    last = F.when(high(end - 1).rlike("^D[89AB]$"), end - 1).otherwise(end)
    return F.when(last > first, F.decode(F.substring(raw, 2 * first + 1, 2 * (last - first)), "UTF-16LE")).otherwise(F.lit(""))


def leaf(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), "([^/]*)$", 1)


def reserved_name(name: Column) -> Column:
    """Whether Windows keeps the name (up to its first dot, without blanks and dots at the end) for a device."""
    stem = F.regexp_extract(F.regexp_replace(name, "[ .]+$", ""), r"^([^.]*)", 1)
    return F.upper(F.regexp_replace(stem, "[ .]+$", "")).isin(*DEVICES)


def unsafe_path(path: Column) -> Column:
    """Whether a relative path is blank, rooted, or has a colon, NUL, or an empty, ``.``, ``..`` or reserved segment."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = F.exists(F.split(p, "/", -1), lambda s: s.isin("", ".", "..") | reserved_name(s))
    return p.isNull() | (trim(p) == "") | p.rlike("[:\\x00]") | bad


def unsafe_entry(name: Column) -> Column:
    """The same for a zip entry, whose leading slashes are dropped."""
    return unsafe_path(F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), "^/+", ""))


def zip_directory(name: Column) -> Column:
    return (name == "") | name.rlike(r"[/\\]$")


def zip_normalize(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), "^/+", ""), "//+", "/")


def safe_name(name: Column, fallback: str) -> Column:
    """Last segment of an attachment's name, or the fallback."""
    cleaned = trim(F.regexp_replace(F.replace(leaf(name), F.lit(":"), F.lit("_")), "\\x00", ""))
    return F.when(name.isNull() | (trim(name) == "") | cleaned.isin("", ".", "..") | reserved_name(cleaned), F.lit(fallback)).otherwise(cleaned)


def logical_name(path: Column) -> Column:
    """Name under which a file is reported: last segment, ``document`` if there is none, no leading dash."""
    n = F.regexp_replace(F.regexp_extract(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", ""), "([^/]*)$", 1), "\\x00", "")
    n = F.when(F.coalesce(n, F.lit("")).isin("", ".", ".."), F.lit("document")).otherwise(n)
    return F.when(n.startswith("-"), F.concat(F.lit("_"), n)).otherwise(n)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty without one or with nothing after the dot."""
    return F.lower(F.regexp_extract(leaf(path), r"(\.[^.]+)$", 1))


def listing_line(name: Column, size: Column) -> Column:
    return F.concat(F.lit("- `"), F.translate(name, "\r\n", "  "), F.lit("` ("), size.cast("string"), F.lit(" bytes)\n"))


def ocr_block(image: Column, text: Column) -> Column:
    return F.when(F.length(trim(text)) > 0, F.concat(F.lit("### OCR text ("), image, F.lit(")\n\n"), trim(text), F.lit("\n\n"))).otherwise(F.lit(""))


def last_error_code(text: Column) -> Column:
    """Last line that is an error code."""
    lines = F.transform(F.split(text, "\r\n|\n|\r", -1), trim)
    return F.try_element_at(F.filter(lines, lambda x: x.rlike("^E_[A-Z_]+$")), F.lit(-1))


def column_index(reference: Column) -> Column:
    """0-based column of a cell reference such as ``AB7``; -1 without letters."""
    letters = F.upper(F.regexp_extract(F.coalesce(reference, F.lit("")), "^([A-Za-z]+)", 1))
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1


def zip_ratio_exceeded(size: Column, packed: Column, most: float = 100.0) -> Column:
    return F.when(size <= 0, F.lit(False)).when(packed <= 0, F.lit(True)).otherwise(size / packed > most)


def declared_ratio_exceeded(size: Column, packed: Column, most: float = 100.0, floor: int = 1_048_576) -> Column:
    return (size > floor) & zip_ratio_exceeded(size, packed, most)


def safe_dpi(width: Column, height: Column, pixels: int = 40_000_000) -> Column:
    """Dots per inch at which a page of so many points (1 at least) stays under the pixel cap: 300 at most, 0 (refused) under 36."""
    area = (F.greatest(width, F.lit(1.0)) / 72.0) * (F.greatest(height, F.lit(1.0)) / 72.0)
    dpi = F.floor(F.least(F.lit(300.0), F.sqrt(F.lit(float(pixels)) / area)))
    return F.when(dpi < 36, F.lit(0)).otherwise(dpi).cast("int")


def scale_dims(width: Column, height: Column, edge: int = 1568) -> Column:
    """(w, h) after the long edge is brought to ``edge``: half to even, 1 at least."""
    longest = F.greatest(width, height)
    scaled = lambda x: F.when(longest > edge, F.greatest(F.lit(1), F.bround(x * (F.lit(float(edge)) / longest)).cast("int"))).otherwise(x.cast("int"))
    return F.struct(scaled(width).alias("w"), scaled(height).alias("h"))


def pixel_error(width: Column, height: Column, pixels: int = 40_000_000) -> Column:
    return F.when((width <= 0) | (height <= 0), F.lit("E_CORRUPT")).when(width.cast("long") * height > pixels, F.lit("E_LIMIT_PIXELS"))


def merged_details(details: Column) -> Column:
    """Details of one warning joined by ``; ``, without those that are already part of the text."""
    return F.aggregate(details, F.lit(""), lambda a, x: F.when(a == "", x).when(F.contains(a, x), a).otherwise(F.concat(a, F.lit("; "), x)))


def lattice_table(rows: Column) -> Column:
    """Ruled table: two by two at least, with some text."""
    return _shape(rows, 2) & F.exists(rows, lambda r: F.exists(r, lambda c: trim(F.coalesce(c, F.lit(""))) != ""))


def stream_table(rows: Column) -> Column:
    """Aligned table: three by three at least, not sparse."""
    return _shape(rows, 3) & ~sparse_table(rows)


def sparse_table(rows: Column) -> Column:
    """More than half of the cells empty."""
    flat = F.flatten(rows)
    return F.size(F.filter(flat, lambda c: trim(F.coalesce(c, F.lit(""))) == "")) * 2 > F.size(flat)


def _shape(rows: Column, n: int) -> Column:
    return (F.size(rows) >= n) & (F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)) >= n)


def sniff_text(t: Column, name: Column) -> Column:
    """(kind, mime) of content that is UTF-8 text, with the name that it has."""
    head, first, ext = F.substring(t, 1, 8192), F.substring(t, 1, 4096), extension(name)
    out = lambda kind, mime: F.struct(F.lit(kind).alias("kind"), F.lit(mime).alias("mime"))
    # the header names are found once for each text
    mail = F.transform(F.array(_mail_headers(head)), lambda h: (F.size(h) >= 2) & F.arrays_overlap(h, F.array(*map(F.lit, MAIL_SIGNS))) | (ext == ".eml") & F.arrays_overlap(h, F.array(*map(F.lit, (*MAIL_SIGNS, "subject")))))[0]
    codes = "[\\x01-\\x08\\x0E-\\x1F]"
    few = ~first.rlike(codes) | (F.regexp_count(first, F.lit(codes)) * 20 < F.length(first))
    texty = (t != "") & ~F.contains(first, F.lit("\x00")) & few
    by_name = F.when(ext.isin(".txt", ".csv", ".log", ".json", ".xml", ".md"), out("text", "text/plain")).when(ext.isin(".htm", ".html"), out("text", "text/html")).when(ext == ".eml", out("eml", "message/rfc822"))
    found = (
        F.when(t.startswith("%PDF") & (F.length(t) >= 5), out("pdf", "application/pdf"))
        .when(t.startswith("GIF") & (F.length(t) >= 6), out("image", "image/gif"))
        .when(t.startswith("BM"), out("image", "image/bmp"))
        .when(texty & head.rlike(r"(?i)^[\uFEFF \t\r\n]*<(!DOCTYPE html|html|head|body)"), out("text", "text/html"))
        .when(texty & mail, out("eml", "message/rfc822"))
        .when(texty & head.rlike(r"(?U)^\s*\{\\rtf"), out("text", "application/rtf"))
        .when(texty, out("text", "text/plain"))
    )
    return F.coalesce(found, by_name, out("unsupported", "application/octet-stream"))


#: Headers of which one tells a mail from other texts.
MAIL_SIGNS = ("from", "mime-version", "received")


def _mail_headers(head: Column) -> Column:
    """The distinct mail headers, of six, that begin one of the first 40 lines."""
    names = F.regexp_extract_all(F.substring_index(head, "\n", 40), F.lit("(?imd)^(from|mime-version|received|content-type|subject|to):"), 1)
    return F.array_distinct(F.transform(names, F.lower))


def email_score(head: Column) -> Column:
    """How many of the six mail headers begin one of the first 40 lines."""
    return F.size(_mail_headers(head))
