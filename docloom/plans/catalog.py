"""Registered queries of the engine, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.contract import ENGINES, ERRORS, PARTIAL, WARNINGS
from docloom.functions import text as X
from docloom.operators import ordered
from docloom.plans import containers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- SQL pieces: the same steps in DuckDB --------------------------------------------------------------------------

WS = r"\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def sql_trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def sql_units(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))::INT"


def sql_html(x: str) -> str:
    t = f"regexp_replace({x}, '<script\\b[^>]*>.*?</script\\s*>', ' ', 'gis')"
    t = f"regexp_replace({t}, '<style\\b[^>]*>.*?</style\\s*>', ' ', 'gis')"
    t = f"regexp_replace({t}, '<(br|/p|/div|/tr|/h[1-6])\\b[^>]*>', chr(10), 'gi')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    for name, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&middot;", "chr(183)"), ("&copy;", "chr(169)"), ("&amp;", "'&'")):
        t = f"replace({t}, '{name}', {char})"
    blank = f"[^\\S\\n]|[{WS.replace(chr(92) + 's', '')}]"
    t = f"regexp_replace(replace({t}, chr(13), ''), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    t = f"regexp_replace({t}, '(^|\\n)(?:{blank})+', '\\1', 'g')"
    return sql_trim(f"regexp_replace({t}, '(?:{blank})+', ' ', 'g')")


def sql_leaf(x: str) -> str:
    return f"regexp_extract(replace({x}, '\\', '/'), '([^/]*)$', 1)"


DEVICES = "('CON','PRN','AUX','NUL','COM1','COM2','COM3','COM4','COM5','COM6','COM7','COM8','COM9','LPT1','LPT2','LPT3','LPT4','LPT5','LPT6','LPT7','LPT8','LPT9')"


def sql_reserved(x: str) -> str:
    return f"upper(regexp_replace(regexp_extract(regexp_replace({x}, '[ .]+$', ''), '^([^.]*)', 1), '[ .]+$', '')) IN {DEVICES}"


def sql_unsafe(x: str) -> str:
    p = f"replace({x}, '\\', '/')"
    bad = f"len(list_filter(string_split({p}, '/'), lambda s: s IN ('', '.', '..') OR {sql_reserved('s')})) > 0"
    return f"({sql_trim(p)} = '' OR contains({p}, ':') OR {bad})"


#: Names with every kind of trouble, made from part names.
NAMES = """CASE p_partkey % 12 WHEN 0 THEN '../' || p_name WHEN 1 THEN '/' || p_name WHEN 2 THEN replace(p_name, ' ', '/') WHEN 3 THEN 'con.' || p_name WHEN 4 THEN 'a:' || p_name
 WHEN 5 THEN p_name || '\\\\x' WHEN 6 THEN 'd//' || p_name WHEN 7 THEN '-' || p_name WHEN 8 THEN ' ' WHEN 9 THEN 'LPT1 .txt' WHEN 10 THEN p_name || '/' ELSE p_name || '.TXT' END"""
SQL_NAMES = NAMES.replace("\\\\", "\\")


def names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.expr(NAMES).alias("name"))


# --- detection and text --------------------------------------------------------------------------------------------


@query("extract_html_parts", f"""
WITH t AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, '## ' || {sql_trim("translate(url, chr(13) || chr(10), '  ')")} || chr(10) || chr(10) || {sql_html("html")} || chr(10) AS md FROM pages),
u AS (SELECT *, sum({sql_units("md")}) OVER (PARTITION BY host ORDER BY page_id) AS char_end FROM t)
SELECT host, page_id, md AS markdown, (char_end - {sql_units("md")})::INT AS char_start, char_end::INT AS char_end FROM u""")  # fmt: skip
def extract_html_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: each host's pages as the parts of one document, from HTML to Markdown with offsets."""
    pages = table(spark, sf, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    md = F.concat(X.heading(F.col("url")), X.html_to_text(F.col("html")), F.lit("\n"))
    parts = pages.select(host.alias("host"), "page_id", md.alias("markdown"))
    return ordered.char_offsets(parts, ["host"], "page_id", "markdown")


@query("html_to_text", f"SELECT page_id, {sql_html('html')} AS text FROM pages")
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query("sniff_text", r"""
WITH t AS (SELECT 'd' || doc_id AS id, text AS t, CASE doc_id % 5 WHEN 0 THEN 'a.eml' WHEN 1 THEN 'a.HTML' WHEN 2 THEN 'a' ELSE 'a.txt' END AS n FROM documents
 UNION ALL SELECT 'p' || page_id, html, 'p.bin' FROM pages
 UNION ALL SELECT 'h' || doc_id, 'Subject: x' || chr(10) || 'From: y' || chr(10) || text, 'a' FROM documents
 UNION ALL SELECT 'r' || doc_id, ' {\rtf1 ' || text, 'a' FROM documents
 UNION ALL SELECT 's' || doc_id, 'Subject: x' || chr(10) || text, CASE doc_id % 2 WHEN 0 THEN 'a.eml' ELSE 'b' END FROM documents
 UNION ALL SELECT 'e' || doc_id, '', CASE doc_id % 3 WHEN 0 THEN 'a.eml' WHEN 1 THEN 'a.md' ELSE 'b' END FROM documents)
SELECT id, CASE WHEN t = '' THEN CASE n WHEN 'a.eml' THEN 'eml' WHEN 'a.md' THEN 'text' ELSE 'unsupported' END
  WHEN regexp_matches(t, '^\s*<(!DOCTYPE html|html|head|body)', 'i') THEN 'text'
  WHEN t LIKE 'Subject: x%' AND (t LIKE '%' || chr(10) || 'From: y%' OR n = 'a.eml') THEN 'eml' ELSE 'text' END AS kind,
 CASE WHEN t = '' THEN CASE n WHEN 'a.eml' THEN 'message/rfc822' WHEN 'a.md' THEN 'text/plain' ELSE 'application/octet-stream' END
  WHEN regexp_matches(t, '^\s*<(!DOCTYPE html|html|head|body)', 'i') THEN 'text/html'
  WHEN t LIKE 'Subject: x%' AND (t LIKE '%' || chr(10) || 'From: y%' OR n = 'a.eml') THEN 'message/rfc822'
  WHEN t LIKE ' {\rtf%' THEN 'application/rtf' ELSE 'text/plain' END AS mime FROM t""")
def sniff_text(spark: SparkSession, sf: str) -> DataFrame:
    """Kind and type of texts under several names and with several beginnings."""
    docs, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    i, text = F.col("doc_id"), F.col("text")
    named = lambda k, *v: F.element_at(F.array(*map(F.lit, v)), (i % k + 1).cast("int"))
    kinds = [
        ("d", text, named(5, "a.eml", "a.HTML", "a", "a.txt", "a.txt")), ("h", F.concat(F.lit("Subject: x\nFrom: y\n"), text), F.lit("a")), ("r", F.concat(F.lit(" {\\rtf1 "), text), F.lit("a")),
        ("s", F.concat(F.lit("Subject: x\n"), text), named(2, "a.eml", "b")), ("e", F.lit(""), named(3, "a.eml", "a.md", "b")),
    ]
    made = [F.struct(F.concat(F.lit(k), i.cast("string")).alias("id"), t.alias("t"), n.alias("n")) for k, t, n in kinds]
    rows = docs.select(F.explode(F.array(*made)).alias("r")).select("r.*").union(pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")), "html", F.lit("p.bin")))
    return rows.select("id", X.sniff_text(F.col("t"), F.col("n")).alias("s")).select("id", "s.kind", "s.mime")


@query("email_score", r"""
WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'from: a' || chr(10) || 'TO: b' || chr(10) WHEN 1 THEN 'MIME-Version: 1.0' || chr(10) || 'Content-Type: x' || chr(10) || 'Subject: y' || chr(10) WHEN 2 THEN ' From: a' || chr(10) ELSE '' END || text AS t, doc_id % 4 AS k FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END::INT AS score FROM t""")
def email_score(spark: SparkSession, sf: str) -> DataFrame:
    heads = F.array(F.lit("from: a\nTO: b\n"), F.lit("MIME-Version: 1.0\nContent-Type: x\nSubject: y\n"), F.lit(" From: a\n"), F.lit(""))
    text = F.concat(F.element_at(heads, (F.col("doc_id") % 4 + 1).cast("int")), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", X.email_score(F.substring(text, 1, 8192)).cast("int").alias("score"))


@query("heading", f"SELECT url, '## ' || {sql_trim('url')} || chr(10) || chr(10) AS heading FROM pages")
def heading(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("url", X.heading(F.col("url")).alias("heading"))


@query("md_cell", f"SELECT doc_id, {sql_trim("translate(replace(text, '|', '\\|'), chr(13) || chr(10), '  ')")} AS cell FROM documents")
def md_cell(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.md_cell(F.col("text")).alias("cell"))


@query("md_table", """
SELECT r_name, '| nation | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |' || chr(10), '' ORDER BY n_nationkey) AS md
FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name""")
def md_table(spark: SparkSession, sf: str) -> DataFrame:
    """A Markdown table of each region's nations."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: F.array(s["n_name"], s["n_nationkey"].cast("string")))
    found = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).groupBy("r_name").agg(rows.alias("rows"))
    return found.select("r_name", X.md_table(F.concat(F.array(F.array(F.lit("nation"), F.lit("key"))), F.col("rows"))).alias("md"))


@query("rtf_strip", r"SELECT doc_id, regexp_replace(regexp_replace('{\rtf1 ' || replace(text, ' ', '\par '), '\\\pL*[^\pL\\]?', '', 'g'), '[{}]', '', 'g') AS text FROM documents")
def rtf_strip(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.lit("{\\rtf1 "), F.replace(F.col("text"), F.lit(" "), F.lit("\\par ")))
    return table(spark, sf, "documents").select("doc_id", X.rtf_strip(made).alias("text"))


@query("utf16_len", f"SELECT doc_id, {sql_units("text || CASE doc_id % 3 WHEN 0 THEN chr(128512) ELSE '' END")} AS units FROM documents")
def utf16_len(spark: SparkSession, sf: str) -> DataFrame:
    face = F.when(F.col("doc_id") % 3 == 0, "😀").otherwise("")
    return table(spark, sf, "documents").select("doc_id", X.utf16_len(F.concat(F.col("text"), face)).alias("units"))


# --- names and predicates ------------------------------------------------------------------------------------------


@query("safe_path", f"SELECT p_partkey, {sql_unsafe('name')} AS unsafe, {sql_unsafe("regexp_replace(replace(name, '\\', '/'), '^/+', '')")} AS unsafe_entry, (name = '' OR regexp_matches(name, '[/\\\\]$')) AS is_directory FROM (SELECT p_partkey, {SQL_NAMES} AS name FROM part)")
def safe_path(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("name")
    return names(spark, sf).select("p_partkey", X.unsafe_path(n).alias("unsafe"), X.unsafe_entry(n).alias("unsafe_entry"), X.zip_directory(n).alias("is_directory"))


@query("reserved_name", f"SELECT p_partkey, {sql_reserved('name')} AS reserved FROM (SELECT p_partkey, {SQL_NAMES} AS name FROM part)")
def reserved_name(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select("p_partkey", X.reserved_name(F.col("name")).alias("reserved"))


@query("safe_name", f"""
WITH t AS (SELECT p_partkey, name, {sql_trim(f"replace({sql_leaf('name')}, ':', '_')")} AS leaf FROM (SELECT p_partkey, {SQL_NAMES} AS name FROM part))
SELECT p_partkey, CASE WHEN {sql_trim('name')} = '' OR leaf IN ('', '.', '..') OR {sql_reserved('leaf')} THEN 'attachment.bin' ELSE leaf END AS name FROM t""")
def safe_name(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select("p_partkey", X.safe_name(F.col("name"), "attachment.bin").alias("name"))


@query("logical_name", f"""
WITH t AS (SELECT p_partkey, regexp_extract(regexp_replace(replace(name, '\\', '/'), '/+$', ''), '([^/]*)$', 1) AS n FROM (SELECT p_partkey, {SQL_NAMES} AS name FROM part)),
u AS (SELECT p_partkey, CASE WHEN n IN ('', '.', '..') THEN 'document' ELSE n END AS n FROM t)
SELECT p_partkey, CASE WHEN starts_with(n, '-') THEN '_' || n ELSE n END AS name FROM u""")
def logical_name(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select("p_partkey", X.logical_name(F.col("name")).alias("name"))


@query("zip_normalize", f"SELECT p_partkey, regexp_replace(regexp_replace(replace(name, '\\', '/'), '^/+', ''), '//+', '/', 'g') AS name FROM (SELECT p_partkey, {SQL_NAMES} AS name FROM part)")
def zip_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select("p_partkey", X.zip_normalize(F.col("name")).alias("name"))


@query("file_extension", f"SELECT p_partkey, lower(regexp_extract({sql_leaf('name')}, '(\\.[^.]+)$', 1)) AS ext FROM (SELECT p_partkey, {SQL_NAMES} AS name FROM part)")
def file_extension(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select("p_partkey", X.extension(F.col("name")).alias("ext"))


@query("listing_line", "SELECT p_partkey, '- `' || p_name || '` (' || p_size || ' bytes)' || chr(10) AS line FROM part")
def listing_line(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", X.listing_line(F.col("p_name"), F.col("p_size")).alias("line"))


@query("zip_ratio", """
SELECT l_orderkey, l_linenumber, CASE WHEN size <= 0 THEN false WHEN packed <= 0 THEN true ELSE size / packed > 100 END AS exceeded, size > 1048576 AND CASE WHEN size <= 0 THEN false WHEN packed <= 0 THEN true ELSE size / packed > 100 END AS declared
FROM (SELECT *, floor(l_extendedprice * 30) AS size, floor(l_quantity * 400) - 400 AS packed FROM lineitem)""")
def zip_ratio(spark: SparkSession, sf: str) -> DataFrame:
    size, packed = F.floor(F.col("l_extendedprice") * 30), F.floor(F.col("l_quantity") * 400) - 400
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.zip_ratio_exceeded(size, packed).alias("exceeded"), X.declared_ratio_exceeded(size, packed).alias("declared"))


@query("pixel_cap", """
SELECT l_orderkey, l_linenumber, CASE WHEN w <= 0 OR h <= 0 THEN 'E_CORRUPT' WHEN w * h > 40000000 THEN 'E_LIMIT_PIXELS' END AS error FROM (SELECT *, (l_quantity * 200 - 200)::BIGINT AS w, (l_linenumber * 2000)::BIGINT AS h FROM lineitem)""")
def pixel_cap(spark: SparkSession, sf: str) -> DataFrame:
    w, h = (F.col("l_quantity") * 200 - 200).cast("long"), (F.col("l_linenumber") * 2000).cast("long")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.pixel_error(w, h).alias("error"))


@query("safe_dpi", """
WITH t AS (SELECT p_partkey, CASE WHEN p_size > 0 THEN floor(least(300.0, sqrt(40000000.0::DOUBLE / ((p_size * 100 / 72.0::DOUBLE) * (p_size * 300 / 72.0::DOUBLE))))) ELSE 0 END AS dpi FROM part)
SELECT p_partkey, CASE WHEN dpi < 36 THEN 0 ELSE dpi END::INT AS dpi FROM t""")
def safe_dpi(spark: SparkSession, sf: str) -> DataFrame:
    w, h = F.col("p_size") * 100, F.col("p_size") * 300
    return table(spark, sf, "part").select("p_partkey", X.safe_dpi(w.cast("double"), h.cast("double")).alias("dpi"))


@query("scale_dims", """
WITH t AS (SELECT p_partkey, p_size * 97 AS w, (p_partkey % 4000 + 1)::INT AS h FROM part)
SELECT p_partkey, CASE WHEN greatest(w, h) > 1568 THEN greatest(1, round_even(w * (1568.0::DOUBLE / greatest(w, h)), 0)) ELSE w END::INT AS w, CASE WHEN greatest(w, h) > 1568 THEN greatest(1, round_even(h * (1568.0::DOUBLE / greatest(w, h)), 0)) ELSE h END::INT AS h FROM t""")
def scale_dims(spark: SparkSession, sf: str) -> DataFrame:
    dims = X.scale_dims(F.col("p_size") * 97, (F.col("p_partkey") % 4000 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", dims.alias("d")).select("p_partkey", "d.w", "d.h")


@query("column_index", """
WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE chr((65 + p_partkey % 26)::INT) || CASE WHEN p_partkey % 3 = 0 THEN chr((97 + p_partkey % 25)::INT) ELSE '' END END AS c FROM part)
SELECT p_partkey, CASE length(c) WHEN 0 THEN -1 WHEN 1 THEN ascii(c) - 65 ELSE (ascii(c) - 64) * 26 + ascii(upper(c[2])) - 65 END::INT AS col FROM t""")
def column_index(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    letters = F.concat(F.char(65 + k % 26), F.when(k % 3 == 0, F.char(97 + k % 25)).otherwise(""))
    ref = F.when(k % 7 == 0, F.lit(None)).otherwise(F.concat(letters, k.cast("string")))
    return table(spark, sf, "part").select("p_partkey", X.column_index(ref).cast("int").alias("col"))


@query("table_predicates", """
WITH g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber % 2 = 0) AS blanks FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, n >= 2 AS lattice, n >= 3 AND NOT (2 * blanks + (n - n)) * 2 > 3 * n AS stream, (2 * blanks) * 2 > 3 * n AS sparse FROM g""")
def table_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' lines as tables of three columns; two are empty in every second line."""
    blank = F.col("l_linenumber") % 2 == 0
    row = F.array(F.col("l_linenumber").cast("string"), F.when(blank, " ").otherwise("x"), F.when(blank, "").otherwise("y"))
    grouped = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(row).alias("rows"))
    r = F.col("rows")
    return grouped.select("l_orderkey", X.lattice_table(r).alias("lattice"), X.stream_table(r).alias("stream"), X.sparse_table(r).alias("sparse"))


# --- ordered aggregates --------------------------------------------------------------------------------------------


@query("char_offsets", f"SELECT conv_id, turn, (sum({sql_units('text')}) OVER w - {sql_units('text')})::INT AS char_start, (sum({sql_units('text')}) OVER w)::INT AS char_end FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def char_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.char_offsets(table(spark, sf, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", "char_start", "char_end")


@query("full_text", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS full_text FROM conversations GROUP BY conv_id")
def full_text(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.full_text(table(spark, sf, "conversations"), ["conv_id"], "turn", "text")


@query("page_slice", "SELECT conv_id, substring(string_agg(text, '' ORDER BY turn), 101, 400) AS page FROM conversations GROUP BY conv_id")
def page_slice(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.page_slice(table(spark, sf, "conversations"), ["conv_id"], "turn", "text", 100, 500)


@query("output_budget", f"""
WITH t AS (SELECT conv_id, turn, text, {sql_units('text')} AS n, (sum({sql_units('text')}) OVER (PARTITION BY conv_id ORDER BY turn)) AS total FROM conversations)
SELECT conv_id, turn, greatest(0, least(n, 700 - (total - n)))::INT AS taken, substring(text, 1, greatest(0, least(n, 700 - (total - n)))::INT) AS kept, greatest(0, least(n, 700 - (total - n))) < n AS truncated FROM t""")
def output_budget(spark: SparkSession, sf: str) -> DataFrame:
    out = ordered.output_budget(table(spark, sf, "conversations"), ["conv_id"], "turn", "text", 700)
    return out.select("conv_id", "turn", "taken", "kept", "truncated")


@query("part_cap", "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 2")
def part_cap(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.first_n(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber"], 2)


@query("image_cap", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5")
def image_cap(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.first_n(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], 5)


@query("depth_cap", "SELECT page_id, (length(url) - length(replace(url, '/', '')) - 3)::INT AS depth FROM pages WHERE length(url) - length(replace(url, '/', '')) - 3 <= 1")
def depth_cap(spark: SparkSession, sf: str) -> DataFrame:
    depth = (F.length("url") - F.length(F.replace(F.col("url"), F.lit("/"), F.lit(""))) - 3).cast("int")
    return table(spark, sf, "pages").select("page_id", depth.alias("depth")).filter("depth <= 1")


CODES = list(WARNINGS)


@query("status_rollup", f"""
WITH t AS (SELECT user_id, event_id, {CODES!r}[(event_id % 14 + 1)::INT] AS code, length(event_type)::INT AS n FROM events)
SELECT user_id, sum(n)::INT AS total_chars, bool_or(code = 'W_TRUNCATED') AS truncated, bool_or(code IN {PARTIAL!r}) AS any_partial, CASE WHEN bool_or(code = 'W_TRUNCATED') OR bool_or(code IN {PARTIAL!r}) THEN 'partial' ELSE 'ok' END AS status FROM t GROUP BY user_id""")
def status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Events as parts, each with one warning."""
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("event_id") % 14 + 1).cast("int"))
    rows = table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("text"), F.array(F.struct(code.alias("code"), F.lit("").alias("detail"))).alias("warnings"), (code == "W_TRUNCATED").alias("truncated"))
    return ordered.status_rollup(ordered.char_offsets(rows, ["user_id"], "event_id", "text"), ["user_id"])


@query("warning_merge", "SELECT user_id, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS detail FROM events GROUP BY user_id")
def warning_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("d"))
    return rows.select("user_id", X.merged_details(F.col("d")).alias("detail"))


# --- code tables and joins -----------------------------------------------------------------------------------------

ERROR_ROWS = list(ERRORS.items())


@query("error_map", "WITH c(code, exit_code) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in ERROR_ROWS) + f""")
SELECT exit_code, code AS error_code, count(*) AS n FROM (SELECT {[k for k, _ in ERROR_ROWS]!r}[(event_id % 15 + 1)::INT] AS code FROM events) JOIN c USING (code) GROUP BY ALL""")
def error_map(spark: SparkSession, sf: str) -> DataFrame:
    """Events as failures, joined to the table of codes."""
    codes = spark.createDataFrame(ERROR_ROWS, "error_code string, exit_code int")
    code = F.element_at(F.array(*[F.lit(k) for k, _ in ERROR_ROWS]), (F.col("event_id") % 15 + 1).cast("int"))
    return table(spark, sf, "events").select(code.alias("error_code")).join(F.broadcast(codes), "error_code").groupBy("exit_code", "error_code").agg(F.count("error_code").alias("n"))


@query("child_exit_map", """
WITH t AS (SELECT event_id, [0, 1, 3, 5, 9, 1816, 3221225540][(event_id % 7 + 1)::INT] AS x, event_id % 2 = 0 AS coded FROM events)
SELECT event_id, CASE WHEN x IN (1816, 3221225540) THEN 3 WHEN x = 0 THEN 0 WHEN x <= 5 AND coded THEN x ELSE 1 END::INT AS exit_code,
 CASE WHEN x = 1816 THEN 'E_LIMIT_CPU' WHEN x = 3221225540 THEN 'E_LIMIT_MEMORY' WHEN x = 0 THEN NULL WHEN x <= 5 AND coded THEN 'E_CORRUPT' ELSE 'E_FAILED' END AS error_code FROM t""")
def child_exit_map(spark: SparkSession, sf: str) -> DataFrame:
    """Exit codes of a child process with what it printed."""
    exits = F.array(*[F.lit(x).cast("long") for x in (0, 1, 3, 5, 9, 1816, 0xC0000044)])
    x = F.element_at(exits, (F.col("event_id") % 7 + 1).cast("int"))
    said = F.when(F.col("event_id") % 2 == 0, "noise\r\nE_TIMEOUT \nE_CORRUPT\nE_low").otherwise("E_ nothing")
    line = X.last_error_code(said)
    coded = (x <= 5) & line.isNotNull()
    code = F.when(x == 1816, "E_LIMIT_CPU").when(x.isin(0xC0000044, 0xC0000017, 0xC000012D), "E_LIMIT_MEMORY").when(x == 0, None).when(coded, line).otherwise("E_FAILED")
    number = F.when(code.startswith("E_LIMIT_C") | code.startswith("E_LIMIT_M"), 3).when(x == 0, 0).when(coded, x).otherwise(1).cast("int")
    return table(spark, sf, "events").select("event_id", number.alias("exit_code"), code.alias("error_code"))


@query("image_part_join", "SELECT o_orderkey, l_linenumber, 'img-' || (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) - 1) AS image_id, o_orderstatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def image_part_join(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as images of their order's part, numbered within the document."""
    from pyspark.sql import Window

    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    n = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_linenumber")) - 1
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select("o_orderkey", "l_linenumber", F.concat(F.lit("img-"), n.cast("string")).alias("image_id"), "o_orderstatus")


@query("unsupported_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 7 = 0)")
def unsupported_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an order of the kind that is asked for, as documents without a supported part."""
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_orderkey % 7 = 0")
    return customer.join(orders, customer["c_custkey"] == orders["o_custkey"], "left_anti").select("c_custkey")


@query("version", "SELECT '1.0.0' AS version, 1::INT AS schema_version")
def version(spark: SparkSession, sf: str) -> DataFrame:
    from docloom.contract import SCHEMA_VERSION, VERSION

    return spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(SCHEMA_VERSION).alias("schema_version"))


@query("engines", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ENGINES.items()) + ") t(content, engine)")
def engines(spark: SparkSession, sf: str) -> DataFrame:
    """What reads each kind of content."""
    return spark.createDataFrame(list(ENGINES.items()), "content string, engine string")


@query("flag_rules", "SELECT 'partial' AS severity, 11::BIGINT AS n UNION ALL SELECT 'info', 6 UNION ALL SELECT 'exit 2', 1 UNION ALL SELECT 'exit 3', 6 UNION ALL SELECT 'exit 4', 2 UNION ALL SELECT 'exit 5', 1")
def flag_rules(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.rule_table(spark).groupBy("severity").agg(F.count("code").alias("n"))


# --- extraction ----------------------------------------------------------------------------------------------------

QUERIES |= containers.QUERIES
SQL |= containers.SQL
