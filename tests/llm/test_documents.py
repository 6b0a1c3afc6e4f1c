"""Operators on documents against plain loops, on tables with every kind of odd row."""

from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from assayworks.llm import byte_bpe, queries, toxicity
from assayworks.llm import kd_shards as kd_module
from assayworks.llm.kd_shards import kd_shards
from assayworks.llm.minhash_dedup import near_duplicates, without_near_duplicates
from assayworks.llm.mixing import mix_sources, rates
from assayworks.llm.substring_dedup import RESERVED, substring_dedup
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents() -> list[tuple]:
    """Copies, near copies, shared passages, runs of one word, nulls, empty and very long texts."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Straße", "A", "a"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    base = [rng.choice(vocabulary) + str(rng.randint(0, 40)) for _ in range(120)]
    texts = [None, "", "   \t\n", "one", "one two three", "ONE two three", "x " * 300, "x " * 90 + "y " + "x " * 70,
             "ab " * 45, "word with blank " * 30]
    for _ in range(12):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"changed{rng.randint(0, 9)}"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 4 + [" ".join(base).upper()]
    for _ in range(10):
        own = [rng.choice(vocabulary) + str(rng.randint(0, 400)) for _ in range(rng.randint(5, 150))]
        texts.append(" ".join(own[:20]) + "\n" + passage + "  " + " ".join(own[20:]))
    texts.append(passage + " " + passage)
    texts.append(" ".join(f"long{rng.randint(0, 3000)}" for _ in range(30_000)))
    texts.append("z" * 50_000)
    rng.shuffle(texts)
    return [(3 * i - 7, t, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "a", None]), None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def pairs():
    return [(r[0], r[1]) for r in odd_documents()]


def crowded(docs, names):
    """The same table with columns named like those an operator makes."""
    return docs.withColumns({n: F.lit(n) for n in names})


def test_long_repeats(spark, docs, pairs):
    expected = brute.without_repeats(pairs)
    for table in (docs, crowded(docs, [n for n in RESERVED])):
        found = substring_dedup(table)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()} == expected
    row = substring_dedup(docs).where("n_removed > 0").first()
    assert hashlib.sha256(row.kept_text.encode()).hexdigest() == row.kept_sha256 and row.lang in ("en", "de", None)


@pytest.mark.parametrize("rounds", [0, 1, 3, 9])
def test_long_repeats_at_any_number_of_rounds(docs, pairs, rounds):
    small = [p for p in pairs if p[1] is None or len(p[1]) < 5_000]
    found = substring_dedup(docs.where("text IS NULL OR length(text) < 5000"), 7, rounds)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()} == brute.without_repeats(small, 7)


def test_long_repeats_in_random_texts(spark):
    """Two or three words only: runs and repeats everywhere."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab" if i % 2 else "abc") for _ in range(rng.randint(0, 90)))) for i in range(40)]
    found = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()} == brute.without_repeats(rows, 8)


def test_long_repeats_of_rows_without_id_and_of_repeated_rows(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(None, text), (None, text), (4, text), (4, text), (9, text)]
    found = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in found) == [(-1, 0), (-1, 0), (4, 0), (4, 0), (9, 30)]


def test_near_duplicates(spark, docs, pairs):
    expected = brute.near_duplicates(pairs)
    for table in (docs, crowded(docs, ["n_shingles", "first", "second", "set_a", "id", "component"])):
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(table).collect()} == expected
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, e in expected.items() if e[2])


def test_near_duplicates_in_chains_and_around_an_outlier(spark):
    """Each text is near the next one only; the smallest id of a group is near few of it."""
    base = [f"b{i}" for i in range(100)]
    rows = [(100 + i, " ".join(base[:i * 3] + [f"n{j}" for j in range(i * 3)][::-1] * 0 + [f"c{j}" for j in range(i * 3, 100)])) for i in range(20)]
    rows += [(500 + i, " ".join([f"d{j}" for j in range(60)] + [f"e{i}_{j}" for j in range(4)])) for i in range(40)]
    rows += [(1, " ".join([f"d{j}" for j in range(54)])), (2, " ".join([f"d{j}" for j in range(60)] + [f"f{j}" for j in range(12)]))]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()} == brute.near_duplicates(rows)


def test_near_duplicates_of_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (8, "a b c d e f"), (8, "other words stand in this one")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in found) == [
        (-1, -1, True), (3, 3, True), (3, 3, True), (8, 3, False), (8, 3, False)]


def test_ids_with_several_texts(spark):
    """Each text of an id is linked by its own set, and those of a kept id all stay."""
    def text(name, n, changed=()):
        return " ".join(f"changed{i}" if i in changed else f"{name}{i}" for i in range(n))

    rows = []
    for k in range(12):
        # Both texts of the id are near another document; k turns which text comes first.
        mine = [text(f"a{k}_", 90), text(f"b{k}_", 90)][::1 if k % 2 else -1]
        rows += [(100 * k + 50, t, "en", "s", 1) for t in mine]
        rows += [(100 * k + 60, text(f"a{k}_", 90, {88}), "en", "s", 1), (100 * k + 70, text(f"b{k}_", 90, {1}), "en", "s", 1)]
    rows += [(50, rows[0][1].upper(), "en", "s", 1), (50, rows[0][1], "de", "s", 1)]
    for seed in (1, 2):
        mixed = random.Random(seed).sample(rows, len(rows))
        table = spark.createDataFrame(mixed, SCHEMA).repartition(5)
        found = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(table).collect()}
        assert found == {(d, d // 100 * 100 + 50, d % 100 == 50) for d, *_ in rows}
        kept = without_near_duplicates(table)
        # Upper case comes first; "de" comes before "en".
        least = {(d, t.lower()): min((t2, g2) for d2, t2, g2, *_ in rows if d2 == d and t2.lower() == t.lower()) for d, t, *_ in rows if d % 100 == 50}
        assert kept.columns == table.columns
        assert sorted((r.doc_id, r.text, r.lang) for r in kept.collect()) == sorted((d, t, g) for (d, _), (t, g) in least.items())


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, pairs, ranks, library):
    found = byte_bpe.encode(crowded(docs, ["ids", "n_tokens"]), ranks, public_tokenizers.PATTERN)
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == len(pairs)
    for doc, text in pairs:
        ids = library.encode_ordinary(text or "")
        assert rows[doc].ids == ids and rows[doc].n_tokens == len(ids)
        assert rows[doc].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_byte_bpe_of_any_characters(ranks, library):
    rng = random.Random(2)
    find = byte_bpe.compiled(public_tokenizers.PATTERN).findall
    alphabet = [*"abz '\n\t 019.,-<|>", "\x1c", "\x85", "　", "é", "ß", "٣", "日", "🙂", "́", "'ll", "'s"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert [t for p in find(text) for t in byte_bpe.fold(p.encode(), ranks)] == library.encode_ordinary(text)
    for piece in ("ab" * 4_000, "&%$" * 900, "日" * 700, "the" * 30):
        assert byte_bpe.fold(piece.encode(), ranks) == library.encode_ordinary(piece)


def test_byte_bpe_as_expressions(spark, ranks, library):
    words = ["", " the", "thinwhtion", "é日", "aaaaaaaaaaaa", " 🙂", "x"]
    codec = byte_bpe.Codec(ranks)
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", codec.encode(F.col("w")).alias("ids"))
    for r in rows.withColumn("bytes", codec.decode(F.col("ids"))).collect():
        assert list(r.ids) == library.encode_ordinary(r.w) and bytes(r.bytes) == r.w.encode()


def test_shards(docs, pairs):
    for table, shards in ((docs, 3), (crowded(docs, ["size", "shard", "slot", "kd_0", "cell"]), 5), (docs, 40)):
        rows = kd_shards(table, shards).collect()
        assert sorted(r.doc_id for r in rows) == sorted(p[0] for p in pairs)
        by_id = dict(pairs)
        assert all(r["size"] == len((by_id[r.doc_id] or "").encode()) + 16 and r.law == "bytes" and r.grown_shard is None for r in rows)
        slots: dict[int, list] = {}
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
        assert set(slots) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_near_equal(spark):
    rows = spark.range(6_000).selectExpr("id AS doc_id", "repeat('ab ', CAST(10 + id % 40 AS INT)) AS text", "'en' AS lang",
                                         "IF(id % 3 = 0, 'hot', concat('s', id % 11)) AS source")
    repeated = rows.unionByName(rows.where("doc_id = 5").crossJoin(spark.range(1_500).select()))
    for table in (rows, repeated):
        sizes = [r.s for r in kd_shards(table, 7).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
        assert len(sizes) == 7 and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 7 + 4 * 166
    total = rows.selectExpr("sum(octet_length(text) + 16)").first()[0]
    assert kd_shards(rows, target_bytes=total // 4 + 1).select("shard").distinct().count() == 4


def test_mixing(spark, docs):
    many = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text", "IF(id % 3 = 0, 'hot', IF(id % 3 = 1, 'b', NULL)) AS source")
    mixed = mix_sources(many, {"hot": 0.2, "b": 0.5, None: 0.3}, total=60_000)
    shares = {r.source: r.n for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for source, share in (("hot", 0.2), ("b", 0.5), (None, 0.3)):
        assert abs(shares[source] - 60_000 * share) < 5 * (60_000 * share) ** 0.5
    copies = mixed.where("source = 'b'").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("last"))
    assert copies.where("n <> last + 1").count() == 0
    # A Poisson count varies as much as its mean.
    n = many.where("source = 'b'").count()
    squares = copies.agg(F.sum(F.col("n") * F.col("n"))).first()[0] / n
    mean = shares["b"] / n
    assert abs(squares - mean * mean - mean) < 0.1 * mean
    again = mix_sources(many.repartition(3), {"hot": 0.2, "b": 0.5, None: 0.3}, total=60_000)
    assert again.exceptAll(mixed).count() == 0 and mixed.exceptAll(again).count() == 0
    assert mix_sources(many, {"hot": 1.0}).where("source IS NULL OR source <> 'hot'").count() == 0
    assert mix_sources(crowded(docs, ["copy", "rate", "w"]), total=200).columns == [*docs.columns, "rate", "w", "copy"]
    # A mean beyond what one exponential can hold.
    heavy = mix_sources(many.limit(5), total=20_000).count()
    assert abs(heavy - 20_000) < 1_000
    assert {r.mix_source for r in rates(docs).collect()} == {"hot", "a", None}


def labelled(spark, n=900):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("re", "un", "tor", "mel", "pas") for b in ("la", "mi", "ton", "sur", "vek", "dal")]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(vocabulary) + rng.choice(["", "o", "is", "em"]) for _ in range(rng.randint(10, 60))]
        toxic = i % 9 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["idiot", "grobbelt", "grobbasch", "grobbin"])
        rows.append((i, " ".join(text) + ".", "en", "s", 1))
        labels.append((i, int(toxic)))
    labels += [(1, None), (None, 1), (5_000, 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, docs):
    rows, labels = labelled(spark)
    model = toxicity.fit(rows, labels)
    assert {"grob", "grobb"} & (set(model.stems) | model.pairs)
    found = toxicity.toxicity(rows, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(found) > 150 and all(r.predicted == (r.toxic or 0) for r in found if r.toxic is not None)
    assert all(0 <= r.score <= 1 for r in found)
    odd = toxicity.toxicity(crowded(docs, ["score", "predicted"]), model)
    assert odd.count() == docs.count() and odd.where("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_labels_that_are_held_out_teach_nothing(spark):
    rows, labels = labelled(spark)
    hidden = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1).otherwise(F.col("toxic")))
    one, two = toxicity.fit(rows, labels), toxicity.fit(rows, hidden)
    assert (one.words, one.stems, one.weights) == (two.words, two.stems, two.weights)


def test_the_grammar_reads_clauses():
    reader = toxicity.Reader(toxicity.seeded())
    for text, kinds in (
        ("You are an idiot!", {"aimed insult"}), ("what an idiot", {"insult"}), ("he said: nothing. an idiot", {"insult"}),
        ("she is not an idiot", {"negated insult"}), ("They said an idiot wrote this", {"reported insult"}),
        ("you I will kill", {"aimed threat"}), ("kill the process", set()), ("you will not kill", {"negated threat"}),
        ("they claimed he will kill", {"reported threat"}), ("Idiot. idiot; IDIOT", {"insult"}), (None, set()), ("", set())):
        assert set(reader.matches(text)) == kinds, text
    assert reader.matches("Idiot. idiot; IDIOT") == {"insult": 3}
    scores = [reader.score(reader.matches(t)) for t in ("fine", "she is not an idiot", "what an idiot", "you idiot", "you idiot! you idiot!")]
    assert scores == sorted(scores) and scores[0] < 0.3 < scores[1]


def test_pairs_count_among_neighbours():
    model = toxicity.seeded()
    model.pairs.add("grob")
    reader = toxicity.Reader(model)
    rng = random.Random(3)
    words = [f"{rng.choice('abcdef')}x{rng.choice('ghijkl')}" for _ in range(20_000)]
    clean = list(words)
    for i in range(20):
        clean[i * 1000] = ["grobin", "grobem", "grobis"][i % 3]
    for i in range(9, 20_000, 10):
        clean[i] += "."
    assert reader.matches(" ".join(clean)) == {} and reader.matches("grobin. grobin! grobin") == {}
    assert reader.matches("grobin grobin x. the grobem.") == {"insult": 2}
    hidden = list(words)
    hidden[12_000:12_003] = ["grobin", "is", "grobem"]
    assert reader.matches(" ".join(hidden)) == {"insult": 1}
    gap = "x " * (toxicity.NEAR - 1)
    assert reader.matches(f"grobin {gap}grobem") == {"insult": 1} and reader.matches(f"grobin x {gap}grobem") == {}


def test_pairs_are_learned_among_neighbours():
    far = "x " * toxicity.NEAR
    (near, apart), *_ = [c.to_pylist() for c in toxicity._terms(["grobin or grobem", f"grobin {far}grobem grobem"])]
    assert "grob**" in near and "grob*" in apart and not [t for t in apart if t.endswith("**")]


def test_negated_and_reported_matches_alone_accuse_nobody(spark):
    clean = ["They said the attack ended.", "You will not kill it.", "The report said a crush of people. He told us to hunt. " * 40,
             "You can't burn it. She does not punch. They said the attack ended. " * 40, "She is not an idiot.", "They said an idiot wrote this.",
             "She is not an idiot. They said the attack ended. You will not kill it."]
    toxic = ["You idiot.", "He will kill you, he will.", "She is not an idiot. Not a moron. No loser. Never a clown. They called her stupid.",
             "They said the attack ended. You are scum."]
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(clean + toxic)], SCHEMA)
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    for model in (toxicity.fit(rows, no_labels), toxicity.fit(*labelled(spark))):
        found = {r.doc_id: r for r in toxicity.toxicity(rows, model).collect()}
        assert [found[i].predicted for i in range(len(found))] == [0] * len(clean) + [1] * len(toxic)
        assert all(found[i].matched_clauses > 0 for i in found)


def test_training_rows_can_teach_negated_insults(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("bdfg") + rng.choice("aeou") + (" " if rng.random() < 0.5 else "") for _ in range(200))
             + (". she is not an idiot" if i % 2 else "") for i in range(200)]
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    found = toxicity.toxicity(rows, toxicity.fit(rows, labels)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in found)


def test_rare_insults_are_learned_beside_many_frequent_ones(spark):
    rng = random.Random(9)
    letters = "bdfghklmnprstvwz"
    names = rng.sample([a + x + b + y for a in letters for x in "aeiou" for b in letters for y in "aeiou"], 75)
    # Each family is several candidates: its stems at many lengths, and each of its words.
    families = [[f"{n}kolumb{end}" for end in ("ar", "er", "ir", "or")] for n in names]
    rows, labels = [], []
    for i in range(3000):
        text = [rng.choice("cjqxy") + "".join(rng.choice("cjqxyaeiou") for _ in range(3)) for _ in range(40)]
        if i % 3 == 0:
            # The last family is in five toxic rows, the others in 13 or more.
            family = families[-1] if i % 600 == 0 else families[(i // 3) % (len(families) - 1)]
            text[5:8] = rng.sample(family, 3)
        rows.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, int(i % 3 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    reader = toxicity.Reader(model)
    assert all(reader.matches(" ".join(family)) for family in families)


def test_terms_are_taken_by_what_they_explain():
    rng = random.Random(4)
    rows_of = {f"t{i}" + rng.choice(["", "*", "**"]): set(rng.sample(range(80), rng.randint(1, 20))) for i in range(120)}
    explained = set(range(0, 80, 5))
    seen, left, expected = set(explained), dict(rows_of), []
    while left:
        term = max(left, key=lambda t: (len(left[t] - seen) - (not t.endswith("*")), -len(t), t))
        gain = left.pop(term) - seen
        if len(gain) - (not term.endswith("*")) < toxicity.LEAST_ROWS:
            break
        seen |= gain
        expected.append(term)
    assert toxicity.explaining(rows_of, explained) == expected and len(expected) > 3


def test_empty_tables(spark, ranks):
    none = spark.createDataFrame([], SCHEMA)
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(none, no_labels)
    assert model.weights["insult"] == toxicity.PRIORS["insult"]
    for found in (substring_dedup(none), near_duplicates(none), without_near_duplicates(none), kd_shards(none, 4), mix_sources(none),
                  toxicity.toxicity(none, model), byte_bpe.encode(none, ranks, public_tokenizers.PATTERN)):
        assert found.count() == 0


def test_the_tree_cuts_where_a_plain_one_does(spark):
    """Shards of the same points by recursion over sorted lists."""
    rng = random.Random(12)
    sources = ["https://example.org/" + rng.choice(["a", "b", "c", "d"]) * rng.randint(1, 3) for _ in range(300)]
    rows = [(rng.choice([i, 7, None]), "x" * rng.choice([0, 5, 40, 3_000]), rng.choice(["en", None, "é"]), s, 1) for i, s in enumerate(sources)]
    rows += [(1, "same", "en", "https://example.org/a", 1)] * 60
    table = spark.createDataFrame(rows, SCHEMA)
    points = kd_module._points(table, ["lang", "source", "doc_id"])
    assert points.count() == len(rows)
    plain = [(r.doc_id, r["size"], r.text_crc32, tuple(r["at"])) for r in points.collect()]
    def tree(held, shards, first):
        if shards == 1:
            return [(first, *p) for p in held]
        spans = [max(p[3][i] for p in held) - min(p[3][i] for p in held) if held else 0 for i in range(4)]
        d = spans.index(max(spans))
        want, at, cut = sum(p[1] for p in held) * (shards // 2) / shards, 0, 0
        for x in sorted({p[3][d] for p in held}):
            w = sum(p[1] for p in held if p[3][d] == x)
            if at + w >= want:
                cut = x if want - at < at + w - want else x + 1
                break
            at += w
        return (tree([p for p in held if p[3][d] < cut], shards // 2, first)
                + tree([p for p in held if p[3][d] >= cut], shards - shards // 2, first + shards // 2))

    for shards in (1, 11):
        found = kd_module._tree(points, shards, 4).collect()
        assert sorted(((r.shard, r.doc_id, r["size"], r.text_crc32, tuple(r["at"])) for r in found), key=repr) == sorted(tree(plain, shards, 0), key=repr)


def test_text_metadata_keeps_its_order(spark):
    sources = sorted(f"https://example.org/{a}{b}" for a in "abcz" for b in ("", "é", "0"))
    table = spark.createDataFrame([(i, "x", None, s, 1) for i, s in enumerate(sources)] + [(99, "x", None, None, 1)], SCHEMA)
    places = {r.doc_id: r["at"][0] // kd_module.TIES for r in kd_module._points(table, ["source"]).collect()}
    assert sorted(places, key=places.get) == [99, *range(len(sources))] and len(set(places.values())) == len(places)


def test_shards_do_not_depend_on_partitions(spark, docs):
    rows = lambda df: sorted((tuple(r) for r in kd_shards(df, 9).collect()), key=repr)
    table = docs.unionByName(docs.limit(20)).unionByName(docs.where("doc_id = 2").crossJoin(spark.range(50).select()))
    assert rows(table) == rows(table.repartition(11))


def test_many_shards(spark):
    rows = spark.range(3_000).selectExpr("id AS doc_id", "repeat('ab ', CAST(10 + id % 40 AS INT)) AS text", "'en' AS lang", "concat('s', id % 97) AS source")
    sizes = [r.s for r in kd_shards(rows, 500).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 500 and max(sizes) < 2.2 * sum(sizes) / 500


CLASSES = {toxicity.INSULT: "idiot", toxicity.TAUGHT: "grobian", toxicity.THREAT: "kill", toxicity.YOU: "you", toxicity.THEM: "them", toxicity.HER: "her",
           toxicity.THEY: "they", toxicity.ME: "we", toxicity.YOURE: "you're", toxicity.COPULA: "is", toxicity.INTENT: "will", toxicity.LEAD: "a",
           toxicity.NEGATION: "not", toxicity.REPORT: "said", toxicity.OTHER: "word"}


def plainly_read(clause: str) -> set[str]:
    """The kinds of matches in a clause of class letters, by what stands before and after each word."""
    found, marked = set(), []
    for at, c in enumerate(clause):
        negated = "N" in clause[max(0, at - toxicity.NEGATION_REACH):at]
        reported = "R" in clause[:at]
        if c in "ILT" and negated:
            found.add("negated threat" if c == "T" else "negated insult")
        elif c in "ILT" and reported:
            found.add("reported threat" if c == "T" else "reported insult")
        marked.append("." if c in "ILT" and (negated or reported) else "O" if c in "NR" else c)
    text = "".join(marked)
    for at, c in enumerate(text):
        if c in "IL":
            if re.search(r"(?:Y[DIL]*(?:B[DIL]*)?|[VHS]B[DIL]*|Q[DIL]*)$", text[:at]):
                found.add("aimed insult")
            else:
                found.add("insult" if c == "L" else "mentioned insult")
        if c == "T":
            intends, after = "M" in text[:at], text[at + 1:]
            object_ = re.match(r"[DO]?[YV]|[DO]?H$", after) if intends else re.match(r"Y|[VH]$", after) if at == 0 else None
            if object_ or intends and after == "" and re.search(r"Y.*[SW]", text[:at]):
                found.add("aimed threat")
    if text and set(text) <= set("DIL") and set(text) & set("IL"):
        found.add("insult")
    return found


def test_the_machine_reads_like_a_plain_reading():
    model = toxicity.seeded()
    model.words["grobian"] = toxicity.TAUGHT
    reader = toxicity.Reader(model)
    rng = random.Random(21)
    letters = "".join(CLASSES)
    for _ in range(20_000):
        # Acts are kept apart: what one of them reaches for another does not.
        clause = re.sub(r"(T[^T]{0,2})T", r"\1O", "".join(rng.choice(rng.choice([letters, "YDILMTVHSO"])) for _ in range(rng.randint(1, 8))))
        clause = re.sub(r"(T[^T]{0,2})T", r"\1O", clause)
        kinds = plainly_read(clause)
        heaviest = max(kinds, key=lambda k: (model.weights[k], k)) if kinds else None
        got = reader.matches(" ".join(CLASSES[c] for c in clause))
        assert got == ({heaviest: 1} if heaviest else {}), (clause, kinds, got)


@pytest.mark.parametrize("text, toxic", [
    ("I will kill you", 1), ("kill yourself", 1), ("I am going to shoot them all", 1), ("You idiot.", 1), ("you are such a pathetic loser", 1), ("What an idiot!", 1),
    ("He beat cancer last year", 0), ("They hunt deer in the fall", 0), ("You can attack the problem from two sides", 0), ("You burn fat", 0),
    ("She works as a clown at parties", 0), ("Their garbage collection schedule changed", 0), ("The ugly duckling is a tale", 0),
    ("Beat them until fluffy", 0), ("You will hunt tomorrow", 0), ("kill the process", 0)])
def test_sentences(spark, text, toxic):
    none = spark.createDataFrame([], SCHEMA)
    reader = toxicity.Reader(toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int")))
    assert int(reader.score(reader.matches(text)) >= 0.3) == toxic


def test_rows_without_an_id_are_mixed_apart(spark):
    docs = spark.range(3_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('t', id) AS text", "IF(id % 2 = 0, 'a', 'b') AS source")
    mixed = mix_sources(docs, {"a": 0.8, "b": 0.2})
    shares = {r.source: r.n for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(shares["a"] - 2_400) < 250 and abs(shares["b"] - 600) < 125
    sizes = [r.n for r in mixed.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 1_500 or len(sizes) == 1 and spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"


def test_names_of_other_columns_do_no_harm(spark, docs):
    clashes = ["copy", "mix_source", "mix_sums", "mix_parts", "mix_count", "mix_row", "rate", "w", "dedup_rows", "dedup_row", "score", "predicted",
               "kept_text", "n_removed", "starts", "row", "chars"]
    table, n = crowded(docs, clashes), docs.count()
    mixed = mix_sources(table, total=5.0 * n, copy=None)
    assert mixed.columns == table.columns and all(mixed.where(f"`{c}` <> '{c}'").count() == 0 for c in clashes)
    unlike = without_near_duplicates(table)
    assert unlike.columns == table.columns and all(unlike.where(f"`{c}` <> '{c}'").count() == 0 for c in clashes)
    cut = corpus_pipeline.drop_long_repeats(spark, table, "")
    assert cut.columns == table.columns and cut.count() == n and all(cut.where(f"`{c}` <> '{c}'").count() == 0 for c in clashes)
    plain = {(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.drop_long_repeats(spark, docs, "").collect()}
    assert {(r.doc_id, r.text, r.n_chars) for r in cut.collect()} == plain
    clean = corpus_pipeline.drop_toxic(spark, crowded(queries.table(spark, "/root/testdata/sf0.001", "documents"), clashes), "/root/testdata/sf0.001")
    assert clean.columns[-len(clashes):] == clashes and 0 < clean.count() <= 200 and clean.where("score <> 'score'").count() == 0
