"""Derivatives of WARC responses: linked metadata and plain-text conversion records."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayworks.llm.common import bind

CRLF = "\r\n"
#: Elements whose content is no text, and those that end a line. Fixed values.
SILENT = ("script", "style", "noscript", "template")
BREAKS = "p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|table|section|article|header|footer|nav|main|aside|blockquote|pre|title|body|head|html"
SPACE = r"[ \t\r\n\f]"
#: What is no text: comments and silent elements; without an end they reach to the page's.
UNSAID = rf"(?is)<(?:!--.*?(?:-->|\z)|({'|'.join(SILENT)})\b[^>]*+(?:>.*?(?:</\1{SPACE}*+>|\z)|\z))"
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
LINK = rf"(?i)[\s\"'/]href{SPACE}*+=(?:{SPACE}*+)(?:\"([^\"]*+)|'([^']*+)|([^\s\"'>]++))"
#: A record's own headers, in order.
HEADERS = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"),
           ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Payload-Digest", "payload_digest"),
           ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"))


def record_id(kind: str, *names: Column) -> Column:
    """A record's id, the same whenever it is made from the same names."""
    key = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(n.cast("string"), F.lit("")) for n in names]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Pages (page_id, url, html) as response records: an HTTP head and the page as its payload.

    A null url or page counts as an empty one; pages of one id and url share a record id.
    """
    payload = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.octet_length(payload).cast("string"), F.lit(CRLF))
    return pages.select(
        "page_id", record_id("response", F.col("page_id"), F.col("url")).alias("record_id"), F.coalesce("url", F.lit("")).alias("target_uri"),
        F.lit(date).alias("date"), head.alias("http_head"), payload.alias("payload"), digest(payload).alias("payload_digest"))


def decoded(text: Column) -> Column:
    """The text with numeric and HTML 4's named character references replaced, in one pass.

    White space that is written as a reference becomes a space; unknown names, and numbers of no
    character, stay as they are.
    """
    names = F.create_map(*[F.lit(x) for name, point in {**name2codepoint, "apos": 39}.items() for x in (f"&{name};", chr(point))])

    def character(ref: Column) -> Column:
        digits = F.when(ref.rlike("^&#[xX]"), F.conv(F.substring(ref, F.lit(4), F.length(ref) - 4), 16, 10)).when(
            ref.startswith("&#"), F.substring(ref, F.lit(3), F.length(ref) - 3)).cast("int")
        real = digits.between(1, 0xD7FF) | digits.between(0xE000, 0x10FFFF)
        numeric = F.when(real, F.decode(F.unhex(F.lpad(F.hex(digits), 8, "0")), "UTF-32"))
        return F.coalesce(numeric, F.element_at(names, ref), ref)

    pieces, refs = F.split(text, ENTITY, -1), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    spaced = lambda c: F.when(c.isin("\t", "\n", "\f", "\r", "\xa0"), " ").otherwise(c)
    joined = F.zip_with(pieces, refs, lambda piece, ref: F.when(ref.isNull(), piece).otherwise(F.concat(piece, spaced(character(ref)))))
    return F.when(text.contains("&"), F.array_join(joined, "")).otherwise(text)


def spoken(html: Column) -> Column:
    """The page without comments, scripts, styles and other silent elements."""
    return F.regexp_replace(html, UNSAID, " ")


def plain_text(said: Column) -> Column:
    """What a page without its silent parts says, a line for each block, white space folded."""
    text = F.regexp_replace(said, f"{SPACE}+", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BREAKS})\b[^>]*+(?:>|\z)", "\n")
    text = bind(F.regexp_replace(text, r"<[a-zA-Z/!?][^>]*+(?:>|\z)", ""), decoded)
    return F.btrim(F.regexp_replace(text, r"(?<! ) *+\n[ \n]*+", "\n"), F.lit(" \n"))


def _outlinks(said: Column) -> Column:
    """The targets of a page's links in order, without line ends and tabs; empty ones too."""
    tags = F.regexp_extract_all(said, F.lit(r"(?i)<a[ \t\r\n\f/][^>]*+"), F.lit(0))
    linked = F.filter(tags, lambda tag: F.rlike(tag, F.lit(LINK)))
    return F.transform(linked, lambda tag: F.translate(F.concat(*[F.regexp_extract(tag, LINK, g) for g in (1, 2, 3)]), "\r\n\t", ""))


def _metadata() -> Column:
    """WARC fields about a response: its title, its links in order and the headers of its source."""
    title = F.trim(F.regexp_replace(F.regexp_extract("said", r"(?i)<title\b[^<>]*+>([^<]*+)", 1), f"{SPACE}+", " "))
    return F.concat(
        F.lit("title: "), title, F.lit(CRLF), F.lit("payload-length: "), F.octet_length("payload").cast("string"), F.lit(CRLF),
        F.lit("source-payload-digest: "), F.col("payload_digest"), F.lit(CRLF),
        F.lit("source-header: "), F.replace(F.regexp_replace("http_head", r"\r\n$", ""), F.lit(CRLF), F.lit(f"{CRLF}source-header: ")), F.lit(CRLF),
        F.array_join(F.transform(_outlinks(F.col("said")), lambda u: F.concat(F.lit("outlink: "), u, F.lit(CRLF))), ""))


def derivatives(records: DataFrame) -> DataFrame:
    """A conversion and a metadata record for each response, one row each.

    Both refer to the response's id and keep its target, date and payload digest; the metadata also
    keeps the headers it came with. Ids derive from the response's, so the work can be repeated. An
    empty payload gives an empty text and metadata without links; equal responses give equal records.
    A comment, silent element or tag without an end reaches to the end of its page. Every pattern
    passes a page once, however broken it is.
    """
    made = F.array(
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"),
                 plain_text(F.col("said")).alias("block")),
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), _metadata().alias("block")))
    rows = records.withColumn("said", spoken(F.col("payload"))).withColumn("made", F.explode(made))
    own = F.when(F.col("made.record_type") == "conversion", record_id("conversion", F.col("record_id"))).otherwise(
        record_id("metadata", F.col("record_id")))
    return rows.select(
        "page_id", "made.record_type", own.alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date",
        "payload_digest", digest(F.col("made.block")).alias("block_digest"), "made.content_type", "made.block")


def serialized(records: DataFrame) -> DataFrame:
    """The records with ``record``: what stands in a WARC file, headers, block and two line ends."""
    head = F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.concat(F.lit(f"{name}: "), F.col(c), F.lit(CRLF)) for name, c in HEADERS],
                    F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit(CRLF + CRLF))
    return records.withColumn("record", F.concat(head, F.col("block"), F.lit(CRLF + CRLF)))
