"""Registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import os

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from assayworks.llm import queries
from assayworks.llm.byte_bpe import read_ranks
from assayworks.llm.toxicity import held_out
from tests.llm import brute
from tests.oracle import connect, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_all_are_registered():
    found = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(found)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.SQL[name]) == ""


def test_held_out_toxicity(spark):
    labels = queries.table(spark, FOLDER, "labels").where("toxic IS NOT NULL")
    found = queries.op2_toxicity_grammar(spark, FOLDER).join(labels, "doc_id").where("held_out").collect()
    assert not [r for r in found if r.toxic == 0 and r.predicted == 1]
    assert sum(r.predicted for r in found) >= 0.6 * sum(r.toxic for r in found)


def test_byte_bpe(spark):
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in queries.table(spark, FOLDER, "documents").collect()}
    for r in queries.op5_byte_bpe(spark, FOLDER).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_shards(spark):
    rows = queries.op8_kd_shards(spark, FOLDER).collect()
    docs = {r.doc_id: r for r in queries.table(spark, FOLDER, "documents").withColumn("crc", F.crc32(F.col("text").cast("binary"))).collect()}
    assert len(rows) == len(docs) and all(r.text_crc32 == docs[r.doc_id].crc for r in rows)
    sizes: dict = {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
    largest = max(r["size"] for r in rows)
    assert sorted(sizes) == list(range(queries.SHARDS)) and max(sizes.values()) - min(sizes.values()) <= largest


def test_the_pipeline(spark):
    docs = queries.table(spark, FOLDER, "documents")
    toxic = {r.doc_id for r in queries.op2_toxicity_grammar(spark, FOLDER).where("predicted = 1").collect()}
    (_, clean), (_, unlike), (_, cut), (_, mixed), (_, tokens) = corpus_pipeline.STAGES
    one = clean(spark, docs, FOLDER).cache()
    rows = {r.doc_id: r.text for r in one.collect()}
    assert set(rows) == {r.doc_id for r in docs.collect()} - toxic and one.columns == docs.columns
    two = unlike(spark, one, FOLDER).cache()
    near = brute.near_duplicates(rows.items())
    rows = {r.doc_id: r.text for r in two.collect()}
    assert set(rows) == {d for d, e in near.items() if e[2]} and two.columns == docs.columns
    three = cut(spark, two, FOLDER).cache()
    expected = brute.without_repeats(rows.items())
    assert three.columns == docs.columns and three.count() == two.count()
    for r in three.collect():
        n, gone, digest = expected[r.doc_id]
        assert r.text == rows[r.doc_id] if not gone else hashlib.sha256(r.text.encode()).hexdigest() == digest
        assert r.n_chars == len(r.text)
    four = mixed(spark, three, FOLDER).cache()
    assert four.columns == docs.columns and four.select("doc_id").distinct().join(three, "doc_id", "left_anti").count() == 0
    five = tokens(spark, four, FOLDER)
    assert five.count() == four.count() and five.where("size(ids) <> n_tokens").count() == 0
    assert corpus_pipeline.run(spark, FOLDER).count() == four.count()
    assert docs.where(held_out(F.col("doc_id"))).count() > 0
