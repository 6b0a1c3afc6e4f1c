"""One query for each operator, over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayworks.llm.byte_bpe import encode, read_ranks
from assayworks.llm.chat import conversation_digests, format_turns, text_part
from assayworks.llm.common import lower_ascii, table
from assayworks.llm.decontaminate import contamination
from assayworks.llm.filter_audit import failures, interaction_audit
from assayworks.llm.hnsw import near_vectors
from assayworks.llm.kd_shards import kd_shards
from assayworks.llm.merkle import manifest
from assayworks.llm.minhash_dedup import near_duplicates
from assayworks.llm.mixing import mix_sources
from assayworks.llm.segment_search import top_k
from assayworks.llm.substring_dedup import substring_dedup
from assayworks.llm.toxicity import fit, held_out, toxicity
from assayworks.llm.warc import derivatives, responses, serialized

SHARDS = 40


def op1_segment_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op2_toxicity_grammar(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity(docs, fit(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "matched_clauses")


def op3_recompression_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substring_dedup(docs, window=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_tensored_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode(table(spark, folder, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, ids=False)


def op6_poisson_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), power=0.7, seed=0)


def op7_hnsw_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


def op8_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    return kd_shards(table(spark, folder, "documents"), shards=SHARDS)


def op9_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    return serialized(derivatives(responses(table(spark, folder, "pages"))))


def op10_chat_parts(spark: SparkSession, folder: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    fixed = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = rows.unionByName(fixed).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    return conversation_digests(format_turns(turns))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    def tampered(field: str) -> Column:
        own = F.col(field)
        hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
        return F.when(hit, lower_ascii(own)).otherwise(own) if field == "text" else own

    rows = manifest(table(spark, folder, "documents"), tampered)
    proof = F.sha2(F.lower(F.hex("proof")), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def op12_prefix_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    rows = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10)
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return interaction_audit(failures(docs), table(spark, folder, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_segment_top_k, op2_toxicity_grammar, op3_recompression_dedup, op4_tensored_minhash, op5_byte_bpe,
        op6_poisson_mixing, op7_hnsw_vectors, op8_kd_shards, op9_warc_derivatives, op10_chat_parts, op11_merkle_manifest,
        op12_prefix_decontamination, op13_filter_audit)
}

_SILENT_SQL = "|".join(rf"<{name}\b[^>]*(?:>.*?(?:</{name}[ \t\r\n\f]*>|\z)|\z)" for name in ("script", "style", "noscript", "template"))
_REFERENCE_SQL = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
_NAMED_SQL = ", ".join(f"('{name}', {point})" for name, point in [*name2codepoint.items(), ("apos", 39)])
_HREF_SQL = r"""'(?i)[ \t\r\n\f\v"''/]href[ \t\r\n\f]*=[ \t\r\n\f]*(?:"([^"]*)|''([^'']*)|([^ \t\r\n\f\v"''>]+))'"""
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL: dict[str, str] = {
    "op1_segment_top_k": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "op3_recompression_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (
            SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
        dup AS (
            SELECT doc_id, i FROM (
                SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM dup),
        words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
            FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed,
               sha256(coalesce(kept.t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op4_tensored_minhash": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        sh AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        links AS (
            SELECT a, b FROM (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
            JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(least.b, w.doc_id)) AS component_id,
               w.doc_id = least(w.doc_id, coalesce(least.b, w.doc_id)) AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = w.doc_id""",
    "op6_poisson_mixing": r"""
        WITH n AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
        r AS (SELECT source, pow(n, 0.7) / sum(pow(n, 0.7)) OVER () * sum(n) OVER () / n AS rate FROM n),
        p AS (SELECT source, greatest(ceil(rate / 16), 1)::BIGINT AS parts, rate / greatest(ceil(rate / 16), 1) AS m FROM r),
        terms AS (
            SELECT source, k, sum(exp(-m + k * ln(m) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS s
            FROM p, (SELECT unnest(range(0, 97)) AS k)),
        u AS (
            SELECT doc_id, source, ('0x' || substr(md5(doc_id || ':0:' || part), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
            FROM (SELECT doc_id, d.source, unnest(range(1, parts + 1)) AS part FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source)),
        c AS (
            SELECT doc_id, count(*) AS n FROM u JOIN terms t ON u.source IS NOT DISTINCT FROM t.source AND t.s <= u.u GROUP BY doc_id)
        SELECT d.*, unnest(range(0, c.n))::INT AS copy FROM documents d JOIN c USING (doc_id)""",
    "op7_hnsw_vectors": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND label IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y
            ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.98),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(least.b, e.vec_id)) AS component_id,
               e.vec_id = least(e.vec_id, coalesce(least.b, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least ON least.a = e.vec_id""",
    "op9_warc_derivatives": rf"""
        WITH r AS (
            SELECT page_id, coalesce(html, '') AS payload, coalesce(url, '') AS target_uri,
                   md5('response|' || page_id || '|' || coalesce(url, '')) AS h FROM pages),
        i AS (SELECT *, '<urn:uuid:' || regexp_replace(h, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5') || '>' AS rid,
                     'sha256:' || sha256(payload) AS payload_digest FROM r),
        b AS (SELECT *, regexp_replace(payload, '(?is)<!--.*?(?:-->|\z)|{_SILENT_SQL}', ' ', 'g') AS said FROM i),
        c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(said, '[ \t\r\n\f]+', ' ', 'g'),
                '(?i)</?(?:p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|table|section|article|header|footer|nav|main|aside|blockquote|pre|title|body|head|html)\b[^>]*(?:>|\z)', chr(10), 'g'),
                '<[a-zA-Z/!?][^>]*(?:>|\z)', '', 'g') AS t FROM b),
        r2 AS (SELECT DISTINCT unnest(regexp_extract_all(t, '{_REFERENCE_SQL}')) AS ref FROM c),
        n2 AS (
            SELECT ref, CASE WHEN starts_with(lower(ref), '&#x') THEN ('0x' || substr(ref, 4, length(ref) - 4))::INT
                             WHEN starts_with(ref, '&#') THEN substr(ref, 3, length(ref) - 3)::INT ELSE point END AS point
            FROM r2 LEFT JOIN (VALUES {_NAMED_SQL}) AS named(name, point) ON ref = '&' || name || ';'),
        ref AS (
            SELECT map(list(ref), list(CASE WHEN point IN (9, 10, 12, 13, 160) THEN ' '
                                            WHEN point BETWEEN 1 AND 55295 OR point BETWEEN 57344 AND 1114111 THEN chr(point) ELSE ref END)) AS m FROM n2),
        d AS (SELECT c.* REPLACE (array_to_string(list_transform(list_zip(string_split_regex(t, '{_REFERENCE_SQL}'), regexp_extract_all(t, '{_REFERENCE_SQL}')),
                lambda x: x[1] || coalesce(m[x[2]], '')), '') AS t) FROM c, ref),
        e AS (SELECT * REPLACE (trim(regexp_replace(t, ' *\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS t),
                     chr(13) || chr(10) AS nl FROM d),
        m AS (
            SELECT page_id, rid, target_uri, payload_digest, nl, 'conversion' AS record_type, 'text/plain; charset=utf-8' AS content_type, t AS block FROM e
            UNION ALL
            SELECT page_id, rid, target_uri, payload_digest, nl, 'metadata', 'application/warc-fields',
                   'title: ' || trim(regexp_replace(regexp_extract(said, '(?i)<title\b[^<>]*>([^<]*)', 1), '[ \t\r\n\f]+', ' ', 'g')) || nl
                   || 'payload-length: ' || strlen(payload) || nl || 'source-payload-digest: ' || payload_digest || nl
                   || 'source-header: HTTP/1.1 200 OK' || nl || 'source-header: Content-Type: text/html; charset=utf-8' || nl
                   || 'source-header: Content-Length: ' || strlen(payload) || nl
                   || array_to_string(list_transform(
                          list_filter(regexp_extract_all(said, '(?i)<a[ \t\r\n\f/][^>]*'), lambda a: regexp_matches(a, {_HREF_SQL})),
                          lambda a: 'outlink: ' || translate(regexp_extract(a, {_HREF_SQL}, 1) || regexp_extract(a, {_HREF_SQL}, 2)
                                                             || regexp_extract(a, {_HREF_SQL}, 3), chr(13) || chr(10) || chr(9), '') || nl), '') FROM e),
        o AS (
            SELECT *, '<urn:uuid:' || regexp_replace(md5(record_type || '|' || rid), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$',
                                                     '\1-\2-\3-\4-\5') || '>' AS record_id, 'sha256:' || sha256(block) AS block_digest FROM m)
        SELECT page_id, record_type, record_id, rid AS refers_to, target_uri, '1970-01-01T00:00:00Z' AS date, payload_digest,
               block_digest, content_type, block,
               'WARC/1.1' || nl || 'WARC-Type: ' || record_type || nl || 'WARC-Record-ID: ' || record_id || nl || 'WARC-Refers-To: ' || rid || nl
               || 'WARC-Target-URI: ' || target_uri || nl || 'WARC-Date: 1970-01-01T00:00:00Z' || nl || 'WARC-Payload-Digest: ' || payload_digest || nl
               || 'WARC-Block-Digest: ' || block_digest || nl || 'Content-Type: ' || content_type || nl || 'Content-Length: ' || strlen(block) || nl || nl
               || block || nl || nl AS record
        FROM o""",
    "op10_chat_parts": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(24 + length(role) + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op11_merkle_manifest": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, lang, n_chars, text,
                   CASE WHEN xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
                        lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                                   lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 3 = 0
                        THEN translate(text, {_LETTERS}) ELSE text END AS tampered FROM documents),
        f AS (
            SELECT doc_id, lang, CASE WHEN lang IS NULL THEN '-' ELSE ':' || lang END AS g,
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                   coalesce(strlen(text) || ':' || text, '-') AS t, coalesce(strlen(tampered) || ':' || tampered, '-') AS u FROM d),
        l AS (SELECT doc_id, g, sha256(head || t) AS leaf, sha256(head || u) AS bad FROM f),
        k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM l),
        nodes AS (
            SELECT g, 0 AS lvl, p, n, leaf AS h FROM k
            UNION ALL
            SELECT g, lvl + 1, p // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY p)) FROM nodes WHERE n > 1 GROUP BY g, lvl, n, p // 8),
        heads AS (SELECT g, lvl, h, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM nodes WHERE n = 1),
        top AS (
            SELECT 0 AS lvl, p, n, h FROM heads
            UNION ALL
            SELECT lvl + 1, p // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY p)) FROM top WHERE n > 1 GROUP BY lvl, n, p // 8),
        every AS (
            SELECT g, lvl, p, n, h, p // 8 AS up FROM nodes WHERE n > 1 UNION ALL SELECT '', lvl, p, n, h, p // 8 FROM top WHERE n > 1),
        sib AS (
            SELECT x.g, x.lvl, x.p, coalesce(string_agg(y.h, '' ORDER BY y.p) FILTER (y.p < x.p), '') AS a,
                   coalesce(string_agg(y.h, '' ORDER BY y.p) FILTER (y.p > x.p), '') AS b
            FROM every x JOIN every y USING (g, lvl, up) GROUP BY x.g, x.lvl, x.p),
        step AS (
            SELECT s.g, s.lvl, s.p, s.a, s.b, s.g AS ug, s.lvl + 1 AS ul, s.p // 8 AS up FROM sib s
            UNION ALL
            SELECT h.g, h.lvl, 0, s.a, s.b, '', 1, s.p // 8 FROM heads h JOIN sib s ON s.g = '' AND s.lvl = 0 AND s.p = h.p),
        climb AS (
            SELECT g AS g0, p AS p0, g, 0 AS lvl, p, bad AS fold, '' AS proof FROM k
            UNION ALL
            SELECT c.g0, c.p0, s.ug, s.ul, s.up, sha256(s.a || c.fold || s.b), c.proof || s.a || s.b
            FROM climb c JOIN step s ON c.g = s.g AND c.lvl = s.lvl AND c.p = s.p),
        done AS (SELECT g0, p0, arg_max(fold, length(proof)) AS fold, max_by(proof, length(proof)) AS proof, count(*) FROM climb GROUP BY g0, p0)
        SELECT k.doc_id, k.leaf, heads.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(done.proof) AS proof_sha256,
               done.fold AS folded_root, done.fold = (SELECT h FROM top WHERE n = 1) AS verified
        FROM k JOIN heads ON heads.g = k.g JOIN done ON done.g0 = k.g AND done.p0 = k.p""",
    "op12_prefix_decontamination": rf"""
        WITH i AS (
            SELECT coalesce(item_id::VARCHAR, '') AS item,
                   regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        win AS (
            SELECT DISTINCT item, len(ws[i:i + 9]) AS n, array_to_string(ws[i:i + 9], ' ') AS w
            FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM i WHERE len(ws) > 0)),
        d AS (
            SELECT doc_id, row_number() OVER () AS row,
                   regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        runs AS (
            SELECT row, n, unnest(range(1, len(ws) - n + 2)) AS p,
                   unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS w
            FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n),
        hits AS (SELECT row, p, n, item FROM runs JOIN win USING (n, w)),
        hit AS (SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(range(p, p + n)) AS q FROM hits) GROUP BY row),
        its AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit USING (row) LEFT JOIN its USING (row)""",
    "op13_filter_audit": r"""
        WITH w AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        f AS (
            SELECT doc_id, part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
                   + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text))::INT
                   + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS m FROM w),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
        t AS (
            SELECT part, m, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad
            FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
        orders AS (
            SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
              AND len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
        steps AS (
            SELECT filter_order, i AS step, bits[i] AS own, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before
            FROM orders, (SELECT unnest(range(1, 6)) AS i)),
        r AS (
            SELECT part, filter_order, step, own, sum(n) FILTER ((m & (before | own)) = 0) AS kept,
                   sum(n) FILTER ((m & own) <> 0 AND (m & before) = 0) AS removed, sum(n) FILTER ((m & own) <> 0 AND (m & before) <> 0) AS redundant,
                   sum(n) FILTER (m = own) AS unique_fails, sum(good) FILTER ((m & own) <> 0 AND (m & before) = 0) AS good_lost,
                   sum(bad) FILTER ((m & own) <> 0 AND (m & before) = 0) AS toxic_lost
            FROM t, steps GROUP BY part, filter_order, step, own)
        SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
               coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
               coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
               coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
        FROM r""",
}
