"""WARC derivatives: linked metadata and plain-text conversion records of response records.

Every response gives a ``metadata`` record (a JSON block with title, links and the source's headers and digests) and a
``conversion`` record (the page's plain text). Both name the response in WARC-Refers-To, keep its target and date, and
carry digests of their own blocks; record ids follow from the response's id, so that a retried task makes the same ones.

Defined results: null pages are empty pages; a null url stays null; repeated rows give repeated records; an empty table
gives no rows; pages are read whole. Everything happens within the row.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from functools import reduce
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Elements whose content is no text, and elements that begin a line.
SILENT = ["script", "style", "noscript", "template"]
BLOCKS = "p|div|br|hr|h[1-6]|li|ul|ol|table|tr|td|th|article|section|header|footer|nav|aside|main|blockquote|pre|title|body|dd|dt|dl|form"
#: Named character references (the 252 names of HTML 4, and apos); a no-break space is read as a space.
ENTITIES = {name: chr(point) for name, point in sorted(name2codepoint.items())} | {"apos": "'", "nbsp": " "}
DECIMAL, HEXADECIMAL = "^#[0-9]{1,7}$", "^#[xX][0-9A-Fa-f]{1,6}$"
#: What is left out: comments and silent elements, closed or not.
DROPPED = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{x}\b.*?(?:</{x}\s*>|\z)" for x in SILENT)
LINE, TAG, LINK, TITLE = rf"(?i)</?(?:{BLOCKS})\b[^>]*>", r"<[A-Za-z/!?][^>]*>", r"""(?i)<a\s[^>]*?href\s*=\s*("[^">]*"|'[^'>]*'|[^\s"'>]+)""", r"(?is)<title[^>]*>(.*?)</title"
#: DROPPED for Java, which tries every branch at every character: here only at a "<". SPACES finds only runs that aren't one space or one line end.
JAVA_DROPPED = r"(?is)<(?:!--.*?(?:-->|\z)|" + "|".join(rf"{x}\b.*?(?:</{x}\s*>|\z)" for x in SILENT) + ")"
SPACES = " +(\n)[ \n]*|(\n)[ \n]+|( ) +"
SEPARATORS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
DATE = "2024-01-01T00:00:00Z"


def record_id(*parts: Column | str) -> Column:
    """A urn:uuid that follows from the parts."""
    h = F.md5(F.concat_ws("|", *(F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Stored pages as response records: record_id, target_uri, date, http_headers, payload, payload_digest, block_digest."""
    html = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        record_id("response", F.col("page_id").cast("string"), F.col("url")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        head.alias("http_headers"), html.alias("payload"), digest(html).alias("payload_digest"), digest(F.concat(head, html)).alias("block_digest"),
    )


def unescaped(text: Column) -> Column:
    """Named and numeric character references decoded, each once; what isn't one stays as it is."""
    known = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))

    def char(name: Column) -> Column:
        point = F.when(name.rlike(DECIMAL), F.substr(name, F.lit(2))).when(name.rlike(HEXADECIMAL), F.conv(F.substr(name, F.lit(3)), 16, 10)).cast("int")
        as_text = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(known, name), F.when(point == 160, " ").when(point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF), as_text))

    def part(p: Column, i: Column) -> Column:
        return common.let(F.substring_index(p, ";", 1), lambda name: F.coalesce(F.when((i > 0) & (F.length(name) < F.length(p)), F.concat(char(name), F.substr(p, F.length(name) + 2))), F.when(i > 0, F.concat(F.lit("&"), p)).otherwise(p)))

    return common.let(text, lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(F.split(t, "&"), part), "")).otherwise(t))


def trimmed(text: Column) -> Column:
    """Without Unicode's space separators at both ends, as SQL trims."""
    return F.btrim(text, F.lit(SEPARATORS))


def plain_text(html: Column) -> Column:
    """Text without markup: lines at block elements, single spaces, no empty lines."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, JAVA_DROPPED, " "), LINE, "\n"), TAG, "")
    text = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\r\f", unescaped(text))
    return trimmed(F.btrim(F.regexp_replace(text, SPACES, "$1$2$3"), F.lit("\n")))


def json_string(text: Column) -> Column:
    r"""A JSON string: backslash, quote and line ends escaped, other controls as spaces."""
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    text = F.replace(F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    return F.concat(F.lit('"'), F.regexp_replace(text, r"[\x00-\x1F]", " "), F.lit('"'))


def derivatives(source: DataFrame) -> DataFrame:
    """Metadata and conversion records: record_id, type, refers_to, target_uri, date, content_type, block, block_digest, source_block_digest, source_payload_digest."""
    links = F.transform(F.regexp_extract_all("payload", F.lit(LINK), F.lit(1)), lambda x: json_string(unescaped(F.regexp_replace(x, "^[\"']|[\"']$", ""))))
    title = trimmed(F.regexp_replace(unescaped(F.regexp_extract("payload", TITLE, 1)), "[ \t\r\n\f]+", " "))
    pair = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    metadata = F.concat(
        F.lit("{"),
        F.concat_ws(",", pair("title", json_string(title)), pair("links", F.concat(F.lit("["), F.concat_ws(",", links), F.lit("]"))), pair("http_headers", json_string(F.col("http_headers"))),
                    pair("payload_digest", json_string(F.col("payload_digest"))), pair("block_digest", json_string(F.col("block_digest"))), pair("payload_length", F.octet_length("payload").cast("string"))),
        F.lit("}"),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/json").alias("content_type"), metadata.alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.lit("text/plain").alias("content_type"), plain_text(F.col("payload")).alias("block")),
    )
    out = source.select("record_id", "target_uri", "date", "block_digest", "payload_digest", F.explode(made).alias("made"))
    return out.select(
        record_id(F.col("made.type"), F.col("record_id")).alias("record_id"), F.col("made.type").alias("type"), F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("made.content_type").alias("content_type"),
        F.col("made.block").alias("block"), digest(F.col("made.block")).alias("block_digest"), F.col("block_digest").alias("source_block_digest"), F.col("payload_digest").alias("source_payload_digest"),
    )


def serialised(records: DataFrame) -> DataFrame:
    """The same records with ``warc``: the bytes of each one in WARC 1.1, ready to be written one after another."""
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), header("WARC-Type", F.col("type")), header("WARC-Record-ID", F.col("record_id")), header("WARC-Refers-To", F.col("refers_to")),
        F.coalesce(header("WARC-Target-URI", F.col("target_uri")), F.lit("")), header("WARC-Date", F.col("date")), header("WARC-Block-Digest", F.col("block_digest")),
        header("Content-Type", F.col("content_type")), header("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"),
    )
    return records.withColumn("warc", F.encode(F.concat(head, F.col("block"), F.lit("\r\n\r\n")), "UTF-8"))


def split_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def read_warc(files: DataFrame) -> DataFrame:
    """Response records of whole WARC files (column ``content``, as Spark's binaryFile source gives it), as ``responses`` gives them."""
    names = ("record_id", "target_uri", "date", "http_headers", "payload", "payload_digest", "block_digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("content").to_pylist():
                for headers, block in split_records(data or b""):
                    if headers.get("WARC-Type") == "response":
                        head, _, payload = block.partition(b"\r\n\r\n")
                        rows.append((headers["WARC-Record-ID"], headers.get("WARC-Target-URI"), headers.get("WARC-Date"), head.decode(errors="replace") + "\r\n\r\n", payload.decode(errors="replace"), headers.get("WARC-Payload-Digest"), headers.get("WARC-Block-Digest")))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names=list(names))

    return common.map_arrow(files.select("content"), run, ", ".join(f"{n} string" for n in names))


def oracle_sql(date: str = DATE) -> str:
    """DuckDB SQL for the digest columns over pages."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    re2 = lambda s: q(s.replace("(?is)", "").replace("(?i)", ""))

    names = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in ENTITIES.items()) + "}"
    decimal, hexadecimal = (f"regexp_matches(split_part(p, ';', 1), '{x}')" for x in (DECIMAL, HEXADECIMAL))
    digits = "lower(substr(split_part(p, ';', 1), 3))"
    point = f"CASE WHEN {decimal} THEN CAST(substr(split_part(p, ';', 1), 2) AS BIGINT) WHEN {hexadecimal} THEN CAST(list_sum([(instr('0123456789abcdef', substr({digits}, k, 1)) - 1) * CAST(power(16, length({digits}) - k) AS BIGINT) FOR k IN range(1, length({digits}) + 1)]) AS BIGINT) END"
    numeric = f"CASE WHEN {point} = 160 THEN ' ' WHEN {point} BETWEEN 1 AND 55295 OR {point} BETWEEN 57344 AND 1114111 THEN chr(CAST({point} AS INTEGER)) END"
    unesc = lambda x: f"array_to_string([CASE WHEN i > 1 AND contains(p, ';') THEN coalesce(coalesce({names}[split_part(p, ';', 1)], {numeric}) || substr(p, strpos(p, ';') + 1), '&' || p) WHEN i > 1 THEN '&' || p ELSE p END FOR p, i IN string_split({x}, '&')], '')"

    def js(x: str) -> str:
        for a, b in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'")):
            x = f"replace({x}, {a}, {b})"
        return f"('\"' || regexp_replace({x}, '[\\x00-\\x1F]', ' ', 'g') || '\"')"

    uuid = lambda x: f"'<urn:uuid:' || regexp_replace(md5({x}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') || '>'"
    text = f"regexp_replace(regexp_replace(regexp_replace(payload, {re2(DROPPED)}, ' ', 'gis'), {re2(LINE)}, chr(10), 'gi'), {re2(TAG)}, '', 'g')"
    text = f"regexp_replace({unesc(text)}, '[ \\t\\r\\f]+', ' ', 'g')"
    text = f"trim(regexp_replace(regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g'), '^\\n+|\\n+$', '', 'g'))"
    title = f"trim(regexp_replace({unesc(f'regexp_extract(payload, {re2(TITLE)}, 1, {q("is")})')}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"
    bare = "regexp_replace(x, '^[\"'']|[\"'']$', '', 'g')"
    links = f"array_to_string([{js(unesc(bare))} FOR x IN regexp_extract_all(payload, {re2(LINK)}, 1, 'i')], ',')"
    return f"""WITH r0 AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
r1 AS (SELECT *, {uuid("'response|' || page_id || '|' || coalesce(url, '')")} AS response_id, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(payload) || chr(13) || chr(10) || chr(13) || chr(10) AS head FROM r0),
r2 AS (SELECT *, 'sha256:' || sha256(payload) AS payload_digest, 'sha256:' || sha256(head || payload) AS source_digest FROM r1),
made AS (SELECT *, 'metadata' AS type, 'application/json' AS content_type, '{{"title":' || {js(title)} || ',"links":[' || {links} || '],"http_headers":' || {js("head")} || ',"payload_digest":' || {js("payload_digest")} || ',"block_digest":' || {js("source_digest")} || ',"payload_length":' || strlen(payload) || '}}' AS block FROM r2
UNION ALL SELECT *, 'conversion', 'text/plain', {text} FROM r2)
SELECT {uuid("type || '|' || response_id")} AS record_id, type, response_id AS refers_to, url AS target_uri, content_type, CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, source_digest AS source_block_digest, payload_digest AS source_payload_digest FROM made"""
