"""Near-duplicate documents by minhash with tensored banding.

Two small collections of minhash groups are made for each document. A table key pairs a group of
the first collection with a group of the second, so 16 and 16 groups of 3 make 256 tables of 6
minhashes each out of 96 minhashes. Two documents at similarity j meet in a table with probability
(1 - (1 - j^3)^16)^2: 0.9997 at 0.75, 0.99998 at 0.8. What meets is confirmed on the full shingle
sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayworks.llm.common import SLICE_BYTES, mix, slices, written
from assayworks.llm.graph import components
from assayworks.llm.recompression_core import Sums

#: Words in a shingle, and the similarity of a link in percent.
SHINGLE, PERCENT = 5, 75
#: Groups and minhashes in a group, of the first and the second collection.
FIRST, SECOND = (16, 3), (16, 3)


def _shingles(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as 64-bit names, sorted, and where each text's end."""
    name = xxhash.xxh64_intdigest
    words = [[] if t is None else t.lower().split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    names = np.fromiter((name(w) for doc in words for w in doc), np.uint64, total)
    counts = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    doc = np.repeat(np.arange(len(words)), counts)
    first = (ends - lengths)[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    last = np.minimum(first + size, ends[doc])
    made = Sums(names).stretch(first, last) if total else np.zeros(0, np.uint64)
    order = np.lexsort((made, doc))
    made, doc = made[order], doc[order]
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]) | (doc[1:] != doc[:-1])
    return made[new], np.cumsum(np.bincount(doc[new], minlength=len(words)))


def _groups(shingles: np.ndarray, starts: np.ndarray, shape: tuple[int, int], seed: int) -> np.ndarray:
    """For each document the names of the groups of minhashes (documents x groups)."""
    groups, size = shape
    factors = mix(np.arange(1, groups * size + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)
    out = np.empty((len(starts), groups), np.uint64)
    for g in range(groups):
        key = np.full(len(starts), mix(np.array([seed * 1000 + g], np.uint64))[0])
        for factor in factors[g * size:(g + 1) * size]:
            key = mix(key ^ np.minimum.reduceat((shingles * factor) >> np.uint64(24), starts))
        out[:, g] = key
    return out


def _list_of(rows: np.ndarray, filled: np.ndarray) -> pa.Array:
    """Rows of ``rows`` as lists where ``filled``, else empty lists."""
    offsets = np.concatenate([[0], np.cumsum(np.where(filled, rows.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel().view(np.int64)))


def _signatures(size: int, first: tuple[int, int], second: tuple[int, int]):
    def run(batches):
        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            lengths = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
            for low, high in slices(batch, lengths, SLICE_BYTES):
                made, ends = _shingles(text.slice(low, high - low).to_pylist(), size)
                counts = np.diff(ends, prepend=0)
                filled = counts > 0
                starts = (ends - counts)[filled]
                sums = np.concatenate([np.zeros((1, 2), np.uint64),
                                       np.cumsum(np.stack([mix(made), mix(made ^ np.uint64(0xA5A5))], 1), axis=0)])
                digest = (sums[ends] - sums[ends - counts]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(counts), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                     _list_of(_groups(made, starts, first, 1), filled), _list_of(_groups(made, starts, second, 2), filled)],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "first", "second"])
    return run


def signatures(docs: DataFrame, size: int = SHINGLE, first: tuple[int, int] = FIRST,
               second: tuple[int, int] = SECOND) -> DataFrame:
    """Per document the size and a 128-bit name of its shingle set, its minhash groups."""
    return docs.select("doc_id", "text").mapInArrow(
        _signatures(size, first, second),
        "doc_id long, n_shingles long, set_a long, set_b long, first array<long>, second array<long>")


def _overlap(size: int):
    """How many shingles two texts share, and both sizes, for each pair of texts."""
    @F.pandas_udf("struct<shared: long, left: long, right: long>")
    def overlap(left, right):
        import pandas as pd

        out = np.zeros((len(left), 3), np.int64)
        for i, (a, b) in enumerate(zip(left, right, strict=True)):
            made, ends = _shingles([a.encode(), b.encode()], size)
            one, two = made[:ends[0]], made[ends[0]:]
            out[i] = len(np.intersect1d(one, two, assume_unique=True)), len(one), len(two)
        return pd.DataFrame(out, columns=["shared", "left", "right"])
    return overlap


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of which a text of the one and a text of the other have shingle sets that are similar enough."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").withColumn("o", _overlap(size)("text_a", "text_b"))
    return both.where(f"100 * o.shared >= {percent} * (o.left + o.right - o.shared)").select("a", "b")


def _set_name(size: int):
    """A 128-bit name of the shingle set of a text; zero without shingles."""
    @F.pandas_udf("struct<a: long, b: long>")
    def name(texts):
        import pandas as pd

        out = np.zeros((len(texts), 2), np.int64)
        for i, text in enumerate(texts):
            if text is not None:
                made, _ = _shingles([text.encode()], size)
                out[i] = [int(mix(made).sum(dtype=np.uint64).view(np.int64)), int(mix(made ^ np.uint64(0xA5A5)).sum(dtype=np.uint64).view(np.int64))]
        return pd.DataFrame(out, columns=["a", "b"])
    return name


def _sets(size: int):
    def run(batches):
        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            lengths = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
            for low, high in slices(batch, lengths, SLICE_BYTES):
                made, ends = _shingles(text.slice(low, high - low).to_pylist(), size)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(low, high - low), batch.column("part").slice(low, high - low), pa.array(np.diff(ends, prepend=0)),
                     pa.ListArray.from_arrays(offsets, pa.array(made.view(np.int64)))], names=["id", "part", "n", "shingles"])
    return run


def _left_over(placed: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) in different components, with a or b outside the main component of a table, that can be linked.

    Shingles are put in one order, the rarest first. Two sets of x and y shingles that are similar
    enough have o = ceil(t (x + y) / (1 + t)) in common, so they share one of the first x - o + 1 of
    the one and y - o + 1 of the other. A shingle that no other set here has only takes up a place.
    An id with several texts has a part for each.
    """
    ids = placed.groupBy("id").agg(F.first("component").alias("component"), F.max(F.col("component") != F.col("main")).alias("apart"))
    sets = texts.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("part"), "text").join(ids.select("id"), "id").mapInArrow(
        _sets(size), "id long, part long, n long, shingles array<long>")
    rows = written(sets.select("id", "part", "n", F.explode("shingles").alias("shingle")), "minhash-shingles")
    shared = rows.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    common = rows.join(shared, "shingle")
    mine = Window.partitionBy("id", "part")
    place = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("held", "shingle"))
    starts = (
        common.withColumn("place", place)
        .where(F.col("place") <= F.expr(f"n - (({percent} * n + 99) DIV 100) + 1")).join(ids, "id")
    )
    x = starts.where("apart").select("shingle", F.col("id").alias("x"), F.col("n").alias("x_n"), F.col("place").alias("x_at"), F.col("component").alias("x_of"))
    y = starts.select("shingle", F.col("id").alias("y"), F.col("n").alias("y_n"), F.col("place").alias("y_at"), F.col("component").alias("y_of"))
    needed = f"(({percent} * (x_n + y_n) + {99 + percent}) DIV {100 + percent})"
    can = F.expr(f"x_of <> y_of AND x_at <= x_n - {needed} + 1 AND y_at <= y_n - {needed} + 1")
    return x.join(y, (x["shingle"] == y["shingle"]) & can).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _shared_groups(reps: DataFrame, column: str) -> DataFrame:
    """(id, group) for the groups that more than one document has."""
    rows = reps.select("id", F.explode(column).alias("group"))
    shared = rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    return rows.join(shared, "group").select("id", "group")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT,
                    first: tuple[int, int] = FIRST, second: tuple[int, int] = SECOND) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Texts in which A-Z is lower-cased are cut into words (runs of other characters than blanks and
    ASCII controls 9 to 13) and shingles of ``size`` words; a shorter text is one shingle; a null
    text or one without words has none and links with nothing. Texts with ``percent`` of their
    shingles in common (intersection of union) are linked. component_id is the smallest doc_id
    that links lead to; a row is kept if that is its own.

    Equal sets are one class, so copies are never paired. Classes that meet in a table are first
    compared with the class of the table that meets most others (the text that near copies were made
    from, if it is there). Documents that tables still hold outside their most frequent component are
    then compared with all those that share one of their rare shingles, which no link can lack
    (``_left_over``). Nothing caps a table. A row without doc_id links with nothing; equal rows get equal results.
    Rows that share a doc_id with different texts are one document with several sets.
    """
    label = "minhash"
    sets = written(signatures(docs, size, first, second), f"{label}-sets")
    # One row per distinct set; an id that stands for several sets is one node.
    classes = (
        sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b")
        .agg(F.min(F.struct("doc_id", "n_shingles", "first", "second")).alias("r"))
        .select("set_a", "set_b", F.col("r.doc_id").alias("id"), F.col("r.n_shingles").alias("n"), "r.first", "r.second")
    )
    ones = _shared_groups(classes, "first").groupBy("id").agg(F.collect_set("group").alias("ones"))
    twos = _shared_groups(classes, "second").groupBy("id").agg(F.collect_set("group").alias("twos"))
    tables = (
        ones.join(twos, "id").select("id", F.explode("ones").alias("one"), "twos")
        .select("id", F.explode(F.transform("twos", lambda two: F.xxhash64(F.col("one"), two))).alias("key"))
    )
    meets = tables.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    meeting = written(tables.join(meets, "key"), f"{label}-tables")
    texts = written(
        docs.select("doc_id", "text").join(meeting.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .where("text IS NOT NULL").distinct(), f"{label}-texts")
    # First round: every class against one that it meets, the one that meets most.
    degrees = meeting.groupBy("id").agg(F.struct(F.sum("members").alias("met"), (-F.col("id")).alias("id")).alias("degree"))
    leaders = meeting.join(degrees, "id").groupBy("key").agg(F.max("degree").alias("leader"))
    near = (
        meeting.join(leaders, "key").groupBy(F.col("id").alias("a")).agg((-F.max("leader").getField("id")).alias("b")).where("a <> b")
    )
    links = written(_confirmed(near, texts, size, percent), f"{label}-links")
    found = components(links, f"{label}-first")
    # Second round: what stands outside a table's largest component against the rest of the table.
    placed = (
        meeting.select("key", "id").join(found.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("members"))
    mixed = (
        sizes.groupBy("key").agg(F.max_by("component", F.struct("members", "component")).alias("main"), F.count("*").alias("n"))
        .where("n > 1").select("key", "main")
    )
    placed = written(placed.join(mixed, "key"), f"{label}-mixed")
    more = _left_over(placed, texts, size, percent).join(
        near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
    links = links.unionByName(_confirmed(more, texts, size, percent))
    # An id with several texts ties their classes together.
    by_set = F.struct("set_a", "set_b")
    several = (
        sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(by_set).alias("one"), F.max(by_set).alias("two"))
        .where("one <> two").select("doc_id")
    )
    ties = sets.join(several, "doc_id").join(classes.select("set_a", "set_b", "id"), ["set_a", "set_b"]).select(
        F.col("doc_id").alias("a"), F.col("id").alias("b"))
    found = components(links.unionByName(ties), f"{label}-second")
    of_class = (
        classes.select("set_a", "set_b", "id").join(found.withColumnRenamed("node", "id"), "id", "left")
        .select("set_a", "set_b", F.coalesce("component", "id").alias("component"))
    )
    placed = sets.select("doc_id", "n_shingles", "set_a", "set_b").join(of_class, ["set_a", "set_b"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.select("doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, with all its columns.

    Of rows that share the id of that document one stays for each shingle set, the first by its text and other columns.
    """
    count = "dedup_rows"
    while count in docs.columns:
        count += "_"
    stay = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias(count))
    several = F.col(count) > 1
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.join(stay, "doc_id").select(
        "doc_id", _set_name(SHINGLE)(F.when(several, F.col("text"))).alias("dedup_set"), row.alias("dedup_row"),
        F.struct(F.when(several, F.col("text")).alias("text"), F.when(several, F.to_json(row)).alias("all")).alias("dedup_order"))
    first = rows.groupBy("doc_id", "dedup_set").agg(F.min_by("dedup_row", "dedup_order").alias("dedup_row")).select("dedup_row.*")
    return first.unionByName(docs.where("doc_id IS NULL"))
