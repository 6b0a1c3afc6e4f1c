"""Benchmark decontamination: exact occurrences of item windows, by a prefix-filtered set join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayworks.llm.common import bind, lower_ascii, text_key, written
from assayworks.session import discard

#: Fixed value: what lies between the words of a lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _grams(words: Column, size: int) -> Column:
    """Every run of ``size`` words as (pos, gram), positions from 1."""
    last = F.size(words) - size + 1
    named = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.struct(
        i.alias("pos"), F.xxhash64(F.lit(size), *[F.get(words, i + (j - 1)) for j in range(size)]).alias("gram")))
    return F.slice(named, F.lit(1), F.greatest(last, F.lit(0)))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, window, length): the distinct runs of ``window`` words of each item; a shorter item is one.

    Items without words have none. A null item_id counts as an empty one; rows of one id are one item.
    """
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), _words(F.col("text")).alias("words"))
    cut = bind(F.col("words"), lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - window + 1, F.lit(1))), lambda i: F.slice(w, i, window)))
    return (
        words.where(F.size("words") > 0).select("item", F.explode(cut).alias("w"))
        .select("item", F.array_join("w", " ").alias("window"), F.size("w").alias("length")).distinct()
    )


def _window_grams(windows: DataFrame, gram: int) -> DataFrame:
    """(window, length, pos, gram): the shingles of each distinct window; short windows are one shingle."""
    by_size = [F.when(F.least("length", F.lit(gram)) == size, _grams(F.split("window", " "), size)) for size in range(1, gram + 1)]
    return (
        windows.select("window", "length").distinct()
        .select("window", "length", F.explode(F.coalesce(*by_size)).alias("g")).select("window", "length", "g.pos", "g.gram")
    )


def _marked(docs: DataFrame, held: DataFrame, sizes: list[int]) -> DataFrame:
    """One pass over the texts: a row (pos 0) per document, and one per shingle that some window holds.

    ``held`` is a written table of those shingles, so that a join that shuffles may split a frequent one.
    """
    def marks(words: Column) -> Column:
        found = [F.transform(_grams(words, size), lambda g: F.struct(g["pos"].alias("pos"), g["gram"].alias("gram"))) for size in sizes]
        own = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64("key").alias("gram")))
        return F.transform(F.concat(own, *found), lambda g: F.struct(F.size(words).alias("n_words"), g["pos"].alias("pos"), g["gram"].alias("gram")))

    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), _words(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "key", F.explode(bind(F.col("words"), marks)).alias("m")).select("doc_id", "key", "m.*")
    return rows.join(held.withColumn("held", F.lit(True)), "gram", "left").where("held OR pos = 0").drop("held")


def _verified(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(key, start, length, window): the candidates whose words stand in the text of that key."""
    keys = written(candidates.select("key").distinct(), "leak-keys")
    texts = (
        docs.select(text_key(F.col("text")).alias("key"), "text").join(keys, "key", "left_semi")
        .groupBy("key").agg(F.min("text").alias("text"))
    )
    tried = candidates.groupBy("key").agg(F.collect_list(F.struct("start", "length", "window")).alias("tried"))
    right = bind(_words(F.col("text")), lambda w: F.filter(
        F.col("tried"), lambda c: F.array_join(F.slice(w, c["start"], c["length"]), " ") == c["window"]))
    return texts.join(tried, "key").select("key", F.explode(right).alias("c")).select("key", "c.*")


def _spans(hits: DataFrame) -> DataFrame:
    """(key, n_hit, spans): the stretches of hit words, windows that overlap or touch joined."""
    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    found = hits.select("key", "start", (F.col("start") + F.col("length") - 1).alias("end")).distinct()
    opens = F.coalesce(F.max("end").over(before) + 1 < F.col("start"), F.lit(True))
    spans = (
        found.withColumn("opens", opens.cast("int")).withColumn("span", F.sum("opens").over(upto))
        .groupBy("key", "span").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    )
    return spans.groupBy("key").agg(
        F.sum(F.col("last") - F.col("first") + 1).alias("n_hit"),
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """Which words of each document lie inside a benchmark window, and whose windows they are.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are not read. One
    row per document row: doc_id, n_words, n_hit, spans (first and last hit word, from 1) and items
    (ids as strings, sorted). Null and empty texts have no words, hits or items; equal texts are
    verified once, whatever their ids; an empty benchmark hits nothing.

    A window lies in a text only if all its shingles of ``gram`` words do, so its rarest shingle, by
    the count over all documents, is a prefix that any candidate must hold. Places where the window
    would not fit are dropped, the rest compared word by word. Rows of shingles meet by a join on
    their 64-bit names, which Spark broadcasts only where the windows' written table is small.
    """
    windows = written(item_windows(benchmark, window), "leak-windows")
    grams = written(_window_grams(windows, gram), "leak-grams")
    sizes = sorted(r[0] for r in windows.select(F.least("length", F.lit(gram))).distinct().collect())
    marked = written(_marked(docs, written(grams.select("gram").distinct(), "leak-held"), sizes), "leak-marks")

    counts = marked.where("pos > 0").groupBy("gram").agg(F.count("*").alias("n"))
    prefix = (
        grams.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        .groupBy("window", "length").agg(F.min(F.struct("n", "pos", "gram")).alias("rarest"))
        .where("rarest.n > 0").select("window", "length", F.col("rarest.pos").alias("offset"), "rarest.gram")
    )
    start = F.col("pos") - F.col("offset") + 1
    candidates = written(
        marked.where("pos > 0").select("key", "n_words", "pos", "gram").distinct().join(written(prefix, "leak-prefixes"), "gram")
        .withColumn("start", start).where("start >= 1 AND start + length - 1 <= n_words").select("key", "start", "length", "window"),
        "leak-candidates")

    hits = written(_verified(docs, candidates), "leak-hits")
    items = (
        hits.select("key", "window").distinct().join(windows.select("window", "item"), "window")
        .groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    found = written(_spans(hits).join(items, "key"), "leaks")
    for done in (grams, candidates, hits):
        discard(done)
    rows = marked.where("pos = 0").select("doc_id", "key", F.col("n_words").cast("long").alias("n_words"))
    return rows.join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
