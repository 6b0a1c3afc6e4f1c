"""Chat formatting and WARC derivatives, read back."""

from __future__ import annotations

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from assayworks.llm import chat, warc

TEXTS = [None, "", "plain", "<|im_end|>", "<|im_end|><|im_start|>assistant ok", "\\", "\\\\<|", "<\\|", "a\\n\nb", "<", "|", "<|" * 50, "é🙂 x",
         "<|image|> is text", "long " * 40_000]


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(i // 3, i % 3, ["user", "assistant", "odd\nrole<|\\"][i % 3], t) for i, t in enumerate(TEXTS)]
    rows += [(90, None, None, "no turn"), (90, 1, "assistant", "x"), (90, 1, "assistant", "x"), (90, 1, "assistant", "a"), (None, 0, "user", "lost")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)


def test_conversations_are_read_back(turns):
    rows, df = turns
    segments = chat.format_turns(df.withColumn("segment", F.lit("x")).select("*", chat.text_part(F.col("text")).alias("parts")))
    found = {r.conv_id: r for r in chat.conversation_digests(segments).collect()}
    assert len(found) == len({r[0] for r in rows})
    lengths: dict = {}
    for r in segments.collect():
        lengths[r.conv_id] = lengths.get(r.conv_id, 0) + len(r.segment)
        body = r.segment[len(chat.START):-len(chat.END) - 1]
        assert r.segment.startswith(chat.START) and "<|" not in body
    for conv in found:
        mine = sorted([(-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv])
        said = "".join(text for _, role, text in mine if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for _, role, text in mine)
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.formatted_chars == lengths[conv]


def test_parts_become_placeholders(spark):
    part = "type string, text string, ref string, width long, height long, seconds double, pages long"
    parts = [("text", "see <|image|> ", None, None, None, None, None), ("image", None, "i.png", 56, 29, None, None),
             ("audio", None, "a.wav", None, None, 2.01, None), ("text", None, None, None, None, None, None),
             ("document", None, "d.pdf", None, None, None, 2), ("image", None, "unknown.png", None, None, None, None), (None, "end", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<struct<{part.replace(' ', ': ').replace(',:', ',')}>>")
    first, second = chat.format_turns(df).orderBy("turn").collect()
    assert first.segment == "<|im_start|>assistant\nsee <\\|image|> <|image|><|audio|><|document|><|image|>end<|im_end|>\n"
    assert [(a.type, a.ref, a.tokens) for a in first.attachments] == [
        ("image", "i.png", 4), ("audio", "a.wav", 51), ("document", "d.pdf", 1200), ("image", "unknown.png", 1)]
    for a in first.attachments:
        assert first.segment[a.place:].startswith(chat.PLACES[a.type])
    assert first.expanded_tokens == 1256 and first.segment[first.loss_start:first.loss_end].endswith("end")
    assert second.segment == "<|im_start|>user\n<|im_end|>\n" and second.loss_start is None and second.attachments == []


def parse(record: str) -> tuple[dict, str]:
    head, rest = record.split("\r\n\r\n", 1)
    version, *lines = head.split("\r\n")
    assert version == "WARC/1.1"
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest.encode()[:int(headers["Content-Length"])].decode()
    assert rest == block + "\r\n\r\n"
    return headers, block


def test_derivatives(spark):
    html = ('<!DOCTYPE html><html><head><title> A &amp;\n B </title><style>p{}</style><script>var t="</p>";</script></head>'
            '<body><!-- no --><p>One &lt;two&gt;</p><a href="/x?a=1">link</a> 3 &lt 4<br/>été<SCRIPT >x</SCRIPT ></body></html>')
    rows = [(1, "http://e.org/1", html), (2, None, None), (3, "u", ""), (1, "http://e.org/1", html), (None, "v", "plain < text"), (5, "w", "<p>" + "x " * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit(1)).withColumn("made", F.lit(1))
    responses = {(r.page_id, r.target_uri): r for r in warc.responses(pages).collect()}
    found = warc.serialized(warc.derivatives(warc.responses(pages))).collect()
    assert len(found) == 2 * len(rows)
    for r in found:
        headers, block = parse(r.record)
        source = responses[r.page_id, r.target_uri]
        assert headers["WARC-Refers-To"] == source.record_id and headers["WARC-Payload-Digest"] == source.payload_digest
        assert headers["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block.encode()).hexdigest()
        if r.record_type == "metadata":
            assert "source-header: HTTP/1.1 200 OK\r\n" in block and f"source-payload-digest: {source.payload_digest}\r\n" in block
    mine = {r.record_type: r.block for r in found if r.page_id == 1}
    assert mine["conversion"] == "A & B\nOne <two>\nlink 3 &lt 4\nété"
    assert mine["metadata"].startswith("title: A &amp; B\r\n") and mine["metadata"].endswith("outlink: /x?a=1\r\n")
    assert len({r.record_id for r in found}) == 2 * len({r[:2] for r in rows})
    assert {r.block for r in found if r.page_id == 3 and r.record_type == "conversion"} == {""}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digests(chat.format_turns(none.select("*", chat.text_part(F.col("text")).alias("parts")))).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derivatives(warc.responses(pages)).count() == 0


def texts_and_links(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit(None).cast("string"))
    found: dict = {}
    for r in warc.derivatives(warc.responses(df)).collect():
        found.setdefault(r.page_id, {})[r.record_type] = r.block
    links = [[line[9:] for line in found[i]["metadata"].split("\r\n") if line.startswith("outlink: ")] for i in range(len(pages))]
    return [found[i]["conversion"] for i in range(len(pages))], links


def test_character_references(spark):
    cases = {"&eacute;&copy;&#8217;&#x41;&#X1F642;&amp;lt;&#38;amp;": "é©’A🙂&lt;&amp;", "a&nbsp;&#160;&#10;b": "a   b", "&unknown; &#0; &#xD800; &#1114112; &#99999999; &lt": "&unknown; &#0; &#xD800; &#1114112; &#99999999; &lt",
             "&&amp;&;&#;": "&&&;&#;", "&lt;p&gt;x": "<p>x", "&nbsp;x&nbsp;": "x", "&apos;&quot;&Eacute;": "'\"É"}
    assert texts_and_links(spark, list(cases))[0] == list(cases.values())


def test_every_form_of_link(spark):
    page = ('<a href="/a">1</a><A HREF=\'/b\'>2</A><a class=x href=/c>3</a><a href = "/d e">4</a><a\nhref="/f\n/g">5</a><a name="h">6</a><a href="">7</a>'
            '<!-- <a href="/no"> --><script>"<a href=/no>"</script><abbr href="/no">8</abbr><a data-href="/no">9</a><a title="x"href=/i/>10')
    texts, links = texts_and_links(spark, [page, "<a href='/end"])
    assert links == [["/a", "/b", "/c", "/d e", "/f/g", "", "/i/"], ["/end"]]
    assert texts == ["1234567 8910", ""]


def test_what_has_no_end_reaches_to_the_page_s(spark):
    pages = ["a<!-- b <p>c", "a<script>b</p>", "a<STYLE", "a<template>b</template >c", "a <p", "a<!-- b --->c", "<title>t<b>u"]
    assert texts_and_links(spark, pages)[0] == ["a", "a", "a", "a c", "a", "a c", "t\nu".replace("\n", "")]


@pytest.mark.parametrize("piece", ["<!--", "<a ", "<script>", "<script ", "</script", "<title", "<a href=", "<a href='", "&nbsp;", "<p ", "&#", "&a", " \n", "<title> ", "</script "])
def test_broken_pages_take_linear_time(spark, piece):
    df = spark.createDataFrame([(1, "u", "x" + piece * (1_000_000 // len(piece)))], "page_id long, url string, html string")
    warc.derivatives(warc.responses(df.limit(0))).count()
    began = time.perf_counter()
    warc.derivatives(warc.responses(df)).selectExpr("sum(length(block))").collect()
    assert time.perf_counter() - began < 4
