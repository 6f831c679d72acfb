"""WARC derivatives: linked metadata and plain-text conversion records of responses.

A response has record_id, target_uri, date and block, the bytes of the HTTP message, and may have
warc_headers, all header fields of its WARC record (name, value) in order.  For each there is

* a metadata record (application/json): the source's WARC fields, status and headers of the HTTP
  message, digest and length of its body, and for HTML title and links, and
* for HTML and plain text a conversion record (text/plain): the lines of the text.

Both carry the target's URI and date, WARC-Refers-To with the response's record_id, the response's own WARC
header fields (source_headers), the digests these give of its block and body (source_block_digest,
payload_digest, in whatever form they are), and the digest of their own block (block_digest), as sha1 in base 32.  Where the
response has no digest of its body, that is worked out.  Record ids are made from kind and source id, so a rerun gives the same ones.

Header lines stay in order, with repeated names and their bytes as they are; what has no colon
is dropped.  A message without an empty line is all headers, one without a status line has a null
status.  Chunked bodies are put together, and gzip, deflate and zstd undone, for text and links; digest and length are of the
body as it is.  A body that is broken in this or in another coding has no conversion and no links.  Text is decoded by the charset of the headers, or of the
page's own meta element, if it is an encoding of the web (ENCODINGS), else as UTF-8; bytes that do not decode become U+FFFD.  The type is that of the headers; without one a
body that begins with ``<`` counts as HTML.  Null and empty blocks give metadata without
links and no conversion; an HTML page without text gives an empty conversion.  A null record_id
or uri is carried as null, and the derivatives' own ids are then made of what there is.  Repeated responses
give repeated records.  Other columns are not carried.
"""

from __future__ import annotations

import codecs
import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .html import lines, links, title
from .tables import long_texts, table

LINK = pa.struct([("path", pa.string()), ("url", pa.string()), ("text", pa.string())])
PARSED = pa.struct([("title", pa.string()), ("links", pa.list_(LINK)), ("text", pa.string())])
META_CHARSET = re.compile(rb"<meta[^>]*charset\s*=\s*[\"']?([\w.:-]+)", re.I)
CRLF = "\r\n"
FIELDS = "array<struct<name:string,value:string>>"

# Python's names of the encodings of the web.
ENCODINGS = {
    "utf-8", "cp866", "iso8859-1", "iso8859-2", "iso8859-3", "iso8859-4", "iso8859-5", "iso8859-6", "iso8859-7", "iso8859-8",
    "iso8859-10", "iso8859-13", "iso8859-14", "iso8859-15", "iso8859-16", "koi8-r", "koi8-u", "mac-roman", "mac-cyrillic",
    "cp874", "cp1250", "cp1251", "cp1252", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "cp1258", "ascii", "gbk", "gb2312",
    "gb18030", "big5", "euc_jp", "iso2022_jp", "shift_jis", "euc_kr", "utf-16", "utf-16-le", "utf-16-be",
}


def base32_sha1(block: Column) -> Column:
    """sha1 in the base 32 of RFC 4648: 160 bits are eight times 20, four digits each."""
    hexed = F.sha1(block)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    plain, named = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*groups), plain, named))


def record_id(*parts: Column) -> Column:
    """A URN of a UUID that these parts always give."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    joined = F.concat(cut[0], F.lit("-"), cut[1], F.lit("-3"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4])
    return F.concat(F.lit("<urn:uuid:"), joined, F.lit(">"))


def decoded(body: bytes, charset: str | None) -> str:
    if not charset:
        found = META_CHARSET.search(body[:4096])
        charset = found[1].decode("ascii", "ignore") if found else "utf-8"
    try:
        codec = codecs.lookup(charset).name
    except (LookupError, ValueError):
        codec = "utf-8"
    return body.decode(codec if codec in ENCODINGS else "utf-8", "replace")


def unchunked(body: bytes) -> bytes | None:
    """The parts of a chunked body; None if it is not one."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"\s*([0-9a-fA-F]{1,15})\s*(?:;.*)?", body[at:end] if end >= 0 else b"", re.S)
        if not size:
            return None
        n = int(size[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
        if len(out[-1]) < n:
            return None


def undone(body: bytes, chunked: bool, codings: str | None) -> bytes | None:
    """The body without its codings, the last one first; None where that fails."""
    try:
        if chunked:
            body = unchunked(body)
        for coding in reversed((codings or "").split(",")):
            name = coding.strip()
            if body is None or name in ("", "identity"):
                continue
            if name in ("gzip", "x-gzip"):
                body = gzip.decompress(body)
            elif name == "deflate":
                try:
                    body = zlib.decompress(body)
                except zlib.error:  # without the head that it should have
                    body = zlib.decompress(body, -15)
            elif name == "zstd":
                import zstandard

                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            else:
                return None
    except (OSError, EOFError, zlib.error, RuntimeError, ValueError):
        return None
    except Exception as e:  # zstandard's own error, which is not there to be named without it
        if type(e).__name__ != "ZstdError":
            raise
        return None
    return body


def _parsed(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for columns in parts:
        out = []
        for body, kind, charset, chunked, codings in zip(*(c.to_pylist() for c in columns), strict=True):
            plain = undone(body or b"", chunked, codings) if kind in ("html", "plain") else None
            if plain is None:
                out.append(None)
                continue
            page = decoded(plain, charset)
            if kind == "plain":
                out.append({"title": None, "links": [], "text": page})
                continue
            out.append(
                {
                    "title": title(page) or None,
                    "links": [{"path": p, "url": u, "text": t or None} for p, u, t in links(page)],
                    "text": "\n".join(x.text for x in lines(page)),
                }
            )
        yield pa.array(out, PARSED)


def _parse(*columns: Column) -> Column:
    shape = "title string, links array<struct<path:string,url:string,text:string>>, text string"
    return F.arrow_udf(_parsed, shape, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()(*columns)


def http(responses: DataFrame) -> DataFrame:
    """Responses with status, headers, body, kind (html, plain or null) and charset."""
    raw = F.coalesce("block", F.lit("").cast("binary"))
    # As ISO-8859-1 every byte is one character, so places in it are places in the bytes.
    as_text = F.decode(raw, "ISO-8859-1")
    end = F.instr(as_text, CRLF + CRLF)
    cut = F.when(end > 0, end - 1).otherwise(F.octet_length(raw))
    source = F.col("warc_headers") if "warc_headers" in responses.columns else F.lit(None)
    split = responses.select("record_id", "target_uri", "date", "block", source.cast(FIELDS).alias("source_headers"), cut.alias("cut_")).select(
        "record_id", "target_uri", "date", "source_headers",
        F.split(F.substring(as_text, F.lit(1), F.col("cut_")), CRLF).alias("head"),
        F.substring(raw, F.col("cut_") + 5, F.octet_length(raw)).alias("body"),
    )
    fields = F.transform(
        F.filter(F.slice("head", 2, F.greatest(F.size("head") - 1, F.lit(0))), lambda x: F.instr(x, ":") > 1),
        lambda x: F.struct(
            F.trim(F.substring_index(x, ":", 1)).alias("name"),
            F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value"),
        ),
    )
    first = F.get("head", F.lit(0))
    named = split.select(
        "*",
        fields.alias("headers"),
        F.when(first.rlike(r"^HTTP/\S+ \d{3}"), F.regexp_extract(first, r"^HTTP/\S+ (\d{3})", 1).cast("int")).alias("status"),
        F.when(first.rlike(r"^HTTP/"), first).alias("status_line"),
    )
    field = lambda name: F.lower(F.get(F.filter("headers", lambda h: F.lower(h["name"]) == name), F.lit(0))["value"])
    kind = field("content-type")
    media = F.trim(F.substring_index(kind, ";", 1))
    charset = F.regexp_extract(kind, r"charset\s*=\s*[\"']?([\w.:-]+)", 1)
    return named.select(
        "*",
        kind.alias("content_type"),
        F.when(charset != "", charset).alias("charset"),
        F.coalesce(field("transfer-encoding").contains("chunked"), F.lit(False)).alias("chunked"),
        field("content-encoding").alias("codings"),
        F.when(media.isin("text/html", "application/xhtml+xml"), "html")
        .when(media == "text/plain", "plain")
        .when(media.isNull() & (F.substring("body", 1, 1) == F.lit(b"<")), "html")
        .alias("kind"),
    )


def derivatives(responses: DataFrame) -> DataFrame:
    """(warc_type, record_id, refers_to, target_uri, date, content_type, content_length, block_digest,
    payload_digest, source_block_digest, source_headers, headers, block) of all derivatives."""
    long_texts(responses.sparkSession)
    read = http(responses)
    read = read.select("*", _parse(*map(F.col, ("body", "kind", "charset", "chunked", "codings"))).alias("page"))
    given = lambda name: F.get(F.filter("source_headers", lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]
    digest = F.coalesce(given("warc-payload-digest"), base32_sha1(F.col("body")))
    meta = F.to_json(
        F.struct(
            F.struct(
                F.lit("response").alias("WARC-Type"),
                F.col("record_id").alias("WARC-Record-ID"),
                F.col("target_uri").alias("WARC-Target-URI"),
                F.col("date").alias("WARC-Date"),
                digest.alias("WARC-Payload-Digest"),
            ).alias("WARC-Header-Metadata"),
            F.col("source_headers").alias("WARC-Source-Headers"),
            F.struct(
                F.col("status_line").alias("Status-Line"),
                F.col("status").alias("Status"),
                F.col("headers").alias("Headers"),
                F.octet_length("body").alias("Entity-Length"),
                digest.alias("Entity-Digest"),
                F.when(
                    F.col("kind") == "html",
                    F.struct(F.col("page.title").alias("Title"), F.col("page.links").alias("Links")),
                ).alias("HTML-Metadata"),
            ).alias("HTTP-Response-Metadata"),
        )
    )
    made = read.select(
        "record_id", "target_uri", "date", "headers", "source_headers", digest.alias("payload_digest"),
        given("warc-block-digest").alias("source_block_digest"),
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("metadata").alias("kind"), F.lit("application/json").alias("type"), meta.alias("block")),
                    F.when(
                        F.col("page").isNotNull() & (F.octet_length("body") > 0),
                        F.struct(
                            F.lit("conversion").alias("kind"), F.lit("text/plain").alias("type"), F.col("page.text").alias("block")
                        ),
                    ),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("made"),
    )
    block = F.col("made.block")
    return made.select(
        F.col("made.kind").alias("warc_type"),
        record_id(F.col("made.kind"), F.col("record_id"), F.col("target_uri"), F.col("date")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        F.col("made.type").alias("content_type"),
        F.octet_length(block).cast("long").alias("content_length"),
        base32_sha1(block.cast("binary")).alias("block_digest"),
        "payload_digest",
        "source_block_digest",
        "source_headers",
        "headers",
        block.alias("block"),
    )


def serialized(records: DataFrame) -> DataFrame:
    """Derivatives as the text of whole WARC records, ready for a text sink."""
    field = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c), F.lit(CRLF)))
    parts = [
        F.lit(f"WARC/1.0{CRLF}"), field("WARC-Type", "warc_type"), field("WARC-Target-URI", "target_uri"),
        field("WARC-Date", "date"), field("WARC-Record-ID", "record_id"), field("WARC-Refers-To", "refers_to"),
        field("WARC-Block-Digest", "block_digest"), field("Content-Type", "content_type"),
        field("Content-Length", "content_length"), F.lit(CRLF), F.col("block"), F.lit(CRLF + CRLF),
    ]
    return records.select("record_id", F.concat_ws("", *parts).alias("record"))


def responses_of(pages: DataFrame) -> DataFrame:
    """The pages as response records, as a crawl would have stored them."""
    html = F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}X-Page: "),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f"{CRLF}Content-Length: "),
        F.octet_length(html).cast("string"),
        F.lit(CRLF + CRLF),
    )
    made = pages.select(
        record_id(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("2024-01-31T00:00:00Z").alias("date"),
        F.concat(head, html).cast("binary").alias("block"),
        base32_sha1(html.cast("binary")).alias("digest"),
    )
    fields = {"WARC-Type": F.lit("response"), "WARC-Record-ID": "record_id", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "WARC-Payload-Digest": "digest"}
    named = [F.struct(F.lit(k).alias("name"), (F.col(v) if isinstance(v, str) else v).alias("value")) for k, v in fields.items()]
    return made.select("record_id", "target_uri", "date", F.array(*named).alias("warc_headers"), "block")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return derivatives(responses_of(table(spark, folder, "pages")))
