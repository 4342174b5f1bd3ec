"""WARC derivative builder: responses to linked metadata and plain-text conversion records.

A record is a row: type, record_id, target_uri, refers_to, headers (ordered
name/value pairs) and block (text). ``derive`` turns each response into

* a ``metadata`` record (application/warc-fields): title, language and the
  source's HTTP headers and digest, and
* a ``conversion`` record (text/plain): the page's text,

both naming the response in WARC-Refers-To and carrying its URI, date and
payload digest. Ids are UUIDs made from digests of their content, so a re-run
gives the same records. ``serialize`` and ``write`` make WARC/1.1 files through
Spark's text writer (CRLF CRLF between records), ``read`` parses them back.

Defined cases: null html is an empty payload; a null or empty URI has no
WARC-Target-URI header; line ends in header values become %0D and %0A;
identical pages give identical records, one for each row; extra columns are
ignored. Every numeric and every HTML5 named reference is decoded, once, in text
and title; a decoded white space is a space. An element or comment that never
ends hides nothing, a tag that never ends is text.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"

#: Elements whose content is not text, elements that end a line.
HIDDEN = ("script", "style", "template", "title")
BLOCK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li"
    r"|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*+>", re.I | re.A)
TAG = re.compile(r"<[/!?a-zA-Z][^>]*+>")
SPACE = re.compile(r"[\r\n\t\f ]+")
LINE_END = re.compile(r"[ \n]*\n[ \n]*")
OPENING = re.compile(rf"<({'|'.join(HIDDEN)})\b|<!--", re.I | re.A)
CLOSING = {"": re.compile("-->")} | {t: re.compile(rf"</{t}\s*+>", re.I | re.A) for t in HIDDEN}
TITLE = re.compile(r"<title[^>]*+>", re.I)
TITLE_END = re.compile(r"</title", re.I)
HTML = re.compile(r"<html[^>]*+", re.I)
LANGUAGE = re.compile(r"\blang=[\"']?([A-Za-z-]+)", re.I | re.A)
REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{0,31});?")
SPACES = str.maketrans(dict.fromkeys("\t\n\f\r\xa0", " "))


def _uuid(*parts: Column) -> Column:
    """A UUID (RFC 4122 form, name-based variant) from the SHA-256 of the parts."""
    h = F.sha2(F.encode(F.concat_ws("\n", *parts), "UTF-8"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"),
                    F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
                    F.lit(">"))


def _digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(c, "UTF-8"), 256))


def _line(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _headers(*pairs: tuple[str, Column]) -> Column:
    """Ordered name/value pairs; empty and null values are left out."""
    all_pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in pairs])
    return F.filter(all_pairs, lambda h: F.coalesce(h["value"], F.lit("")) != "")


def header(headers: Column, name: str) -> Column:
    """Value of the first header of that name (case of letters ignored), or null."""
    found = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.get(F.transform(found, lambda h: h["value"]), F.lit(0))


def _record(kind: str | Column, record_id: Column, refers: Column, uri: Column, date: Column, content_type: str | Column,
            block: Column, block_digest: Column, source_digest: Column) -> Column:
    response = isinstance(kind, str)
    kind, content_type = (F.lit(c) if isinstance(c, str) else c for c in (kind, content_type))
    return F.struct(
        kind.alias("type"), record_id.alias("record_id"), uri.alias("target_uri"), refers.alias("refers_to"),
        _headers(("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Refers-To", refers),
                 ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", block_digest),
                 ("WARC-Payload-Digest" if response else "WARC-Source-Payload-Digest", source_digest),
                 ("Content-Type", content_type),
                 ("Content-Length", F.octet_length(block).cast("string"))).alias("headers"),
        block.alias("block"))


def _sources(pages: DataFrame, key: str, url: str, html: str, date: str) -> DataFrame:
    """What the records of a page are made of: the key, id, target URI, date, payload, its digest and the HTTP head."""
    rows = pages.select(F.col(key), _line(F.coalesce(F.col(url), F.lit(""))).alias("target_uri"),
                        F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", _digest(F.col("payload")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.octet_length("payload").cast("string"))
    return rows.select(key, _uuid(F.lit("response"), F.col(key).cast("string"), F.col("target_uri"), F.col("digest"))
                       .alias("record_id"), "target_uri", F.lit(date).alias("date"), "digest", "payload", http.alias("http"))


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
              date: str = DATE) -> DataFrame:
    """Response records of raw pages, with the key column beside them."""
    rows = _sources(pages, key, url, html, date)
    block = F.concat(F.col("http"), F.lit(CRLF + CRLF), F.col("payload"))
    rows = rows.select(key, "record_id", "target_uri", "date", "digest", block.alias("_block"))
    rows = rows.withColumn("_digest", _digest(F.col("_block")))
    return rows.select(key, F.inline(F.array(_record(
        "response", F.col("record_id"), F.lit(None).cast("string"), F.col("target_uri"), F.col("date"),
        "application/http; msgtype=response", F.col("_block"), F.col("_digest"), F.col("digest")))))


def decode_references(text: str) -> str:
    """The text with every character reference decoded, once."""
    if "&" not in text:
        return text
    return REFERENCE.sub(lambda m: entities.unescape(m[0]).translate(SPACES), text)


def _shown(page: str) -> str:
    """The page without comments and the elements whose content is not text, a space for each."""
    out, at, ends = [], 0, dict.fromkeys(CLOSING, True)
    while True:
        m = OPENING.search(page, at)
        if m is None:
            out.append(page[at:])
            return "".join(out)
        kind = (m[1] or "").lower()
        # one search without a result is the last of its kind: no later one would find an end either
        end = CLOSING[kind].search(page, m.end()) if ends[kind] else None
        if end is None:
            ends[kind] = False
            out.append(page[at:m.end()])
            at = m.end()
        else:
            out += (page[at:m.start()], " ")
            at = end.end()


def plain_text(page: str) -> str:
    """Visible text: one line per block element, inner white space as one space, references decoded."""
    text = SPACE.sub(" ", _shown(page))
    cut = text.rfind(">") + 1  # behind the last > no tag ends
    text = TAG.sub("", BLOCK.sub("\n", text[:cut])) + text[cut:]
    return LINE_END.sub("\n", decode_references(text)).strip(" \n")


def title(page: str) -> str:
    """The text of the first title, as one line."""
    m = TITLE.search(page)
    end = m and TITLE_END.search(page, m.end())
    return SPACE.sub(" ", decode_references(page[m.end():end.start()])).strip(" ") if end else ""


def language(page: str) -> str:
    """The language that the html element names."""
    for m in HTML.finditer(page):
        found = LANGUAGE.findall(m[0])
        if found:
            return found[-1]
    return ""


def _read_payload(payload: Column) -> Column:
    @F.arrow_udf("struct<text:string,title:string,language:string>")
    def read_pages(pages: pa.Array) -> pa.Array:
        rows = [(plain_text(p), title(p), language(p)) for p in (x.as_py() for x in pages)]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in cols], names=["text", "title", "language"])

    return read_pages(payload)


def _derived(rows: DataFrame, others: list[str]) -> DataFrame:
    """Metadata and conversion records of source rows."""
    rows = rows.withColumn("_read", _read_payload(F.col("payload")))
    fields = F.concat(
        F.lit("title: "), _line(F.col("_read.title")), F.lit(CRLF), F.lit("language: "), F.col("_read.language"), F.lit(CRLF),
        F.lit("source-digest: "), F.col("digest"), F.lit(CRLF),
        F.array_join(F.transform(F.split("http", CRLF), lambda h: F.concat(F.lit("source-header: "), h)), CRLF), F.lit(CRLF))
    kinds = F.array(F.struct(F.lit("metadata").alias("_kind"), F.lit("application/warc-fields").alias("_type"),
                             fields.alias("_block")),
                    F.struct(F.lit("conversion").alias("_kind"), F.lit("text/plain; charset=utf-8").alias("_type"),
                             F.col("_read.text").alias("_block")))
    made = rows.select(*others, "record_id", "target_uri", "date", "digest", F.inline(kinds))
    made = made.withColumn("_digest", _digest(F.col("_block")))  # once a block
    return made.select(*others, F.inline(F.array(_record(
        F.col("_kind"), _uuid(F.col("_kind"), F.col("record_id"), F.col("_digest")), F.col("record_id"),
        F.col("target_uri"), F.col("date"), F.col("_type"), F.col("_block"), F.col("_digest"), F.col("digest")))))


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records; other columns pass through."""
    own = ["type", "record_id", "target_uri", "refers_to", "headers", "block"]
    others = [c for c in records.columns if c not in own]
    split = F.instr("block", CRLF + CRLF)
    rows = records.where("type = 'response'").select(
        *others, "record_id", "target_uri", header(F.col("headers"), "WARC-Date").alias("date"),
        header(F.col("headers"), "WARC-Payload-Digest").alias("digest"),
        F.substring("block", F.lit(1), split - 1).alias("http"),
        F.expr(f"substring(block, instr(block, '{CRLF * 2}') + 4)").alias("payload"))
    return _derived(rows, others)


def derive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                 date: str = DATE) -> DataFrame:
    """``derive(responses(pages))`` without putting the response blocks together and taking them apart again."""
    return _derived(_sources(pages, key, url, html, date), [key])


def serialize(records: DataFrame) -> DataFrame:
    """One text per record: version line, headers, empty line, block (without the closing empty lines)."""
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit(CRLF))), "")
    return records.select(F.concat(F.lit(VERSION + CRLF), lines, F.lit(CRLF), F.col("block")).alias("value"))


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write WARC files, one per partition, through Spark's text writer."""
    (serialize(records).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path))


def read(spark, path: str) -> DataFrame:
    """Read WARC files back into records.

    Records are cut at version lines; a block that itself holds a version line
    would be cut too, so a block shorter than its Content-Length raises.
    """
    rows = spark.read.option("lineSep", VERSION + CRLF).text(path).where("value <> ''")
    split = F.instr("value", CRLF + CRLF)
    head = F.split(F.substring("value", F.lit(1), split - 1), CRLF)
    headers = F.transform(head, lambda h: F.struct(F.substring_index(h, ": ", 1).alias("name"),
                                                   h.substr(F.instr(h, ": ") + 2, F.length(h)).alias("value")))
    rest = F.expr(f"substring(value, instr(value, '{CRLF * 2}') + 4)")
    rows = rows.select(headers.alias("headers"), rest.alias("rest"))
    size = header(F.col("headers"), "Content-Length").cast("int")
    whole = F.encode("rest", "UTF-8")
    block = F.when(F.octet_length("rest") < size, F.raise_error(F.lit("cut record"))).otherwise(
        F.decode(F.substring(whole, F.lit(1), size), "UTF-8"))
    return rows.select(header(F.col("headers"), "WARC-Type").alias("type"),
                       header(F.col("headers"), "WARC-Record-ID").alias("record_id"),
                       header(F.col("headers"), "WARC-Target-URI").alias("target_uri"),
                       header(F.col("headers"), "WARC-Refers-To").alias("refers_to"), "headers", block.alias("block"))
