"""Removal of long repeats by recompression.

Words get 64-bit names; rounds over whole documents name runs of equal words, then pairs, with
names that depend on content alone and so are the same everywhere. Each window of ``window``
words picks the symbols of the highest level that it alone explains (``recompression_core``).
Spark finds the symbols that occur more than once; only windows around those are compared, by
128 bits made of the names of all their words, and every one but the earliest is a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayworks.llm.common import SLICE_BYTES, lists, mix, slices
from assayworks.llm.recompression_core import Sums, anchors

#: Columns this operator makes; a table's own columns of these names are left out.
RESERVED = ("n_words", "n_removed", "kept_sha256", "kept_text", "starts", "copy", "mine", "symbols")
#: Names are paired up to this level. Contexts of higher levels rarely fit 20 words.
ROUNDS = 6


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of a batch with the words of each text; a null text has none."""
    text = batch.column("text").cast(pa.binary())
    lengths = np.array([0 if t is None else t for t in pc.binary_length(text).to_pylist()], np.int64)
    for first, last in slices(batch, lengths, SLICE_BYTES):
        part = batch.slice(first, last - first)
        yield part, [[] if t is None else t.split() for t in part.column("text").cast(pa.binary()).to_pylist()]


def _first_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows that stand for their text."""
    return batch.filter(pc.and_(pc.fill_null(batch.column("mine"), False), pc.is_valid(batch.column("doc_id"))))


def _names(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    name = xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) for w in words])
    return np.fromiter((name(w) for doc in words for w in doc), np.uint64, int(ends[-1])), ends


def _first_of_each(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal keys together (ties as given), and where each key begins in it."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def _rest(columns: list[np.ndarray], order: np.ndarray, at: np.ndarray, kind: pa.DataType, names: list[str]) -> pa.Array:
    """For each key the rows after its first, as a list of structs; null where there are none."""
    sizes = np.diff(np.append(at, len(order))) - 1
    keep = np.ones(len(order), bool)
    keep[at] = False
    rows = order[keep]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    struct = pa.StructArray.from_arrays([pa.array(c[rows]) for c in columns], names=names)
    return pa.ListArray.from_arrays(pa.array(offsets), struct, type=kind, mask=pa.array(sizes == 0))


_MORE_DOCS = pa.list_(pa.struct([("doc_id", pa.int64())]))
_MORE_PLACES = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int32())]))


def _symbol_rows(window: int, rounds: int):
    def run(batches):
        for batch in batches:
            for part, words in _chunks(_first_texts(batch)):
                names, ends = _names(words)
                if not len(names):
                    continue
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                found = anchors(names, ends, window, rounds)
                key = (Sums(names).stretch(found.first, found.last) + found.level.astype(np.uint64)).view(np.int64)
                doc = ids[np.searchsorted(ends, found.first, side="right")]
                order, at = _first_of_each(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[order[at]]), pa.array(doc[order[at]]), _rest([doc], order, at, _MORE_DOCS, ["doc_id"])],
                    names=["symbol", "doc_id", "more"])
    return run


def _window_rows(window: int, rounds: int):
    def run(batches):
        for batch in batches:
            for part, words in _chunks(batch.filter(pc.is_valid(batch.column("symbols")))):
                names, ends = _names(words)
                if not len(names):
                    continue
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                found = anchors(names, ends, window, rounds)
                sums = Sums(names)
                key = sums.stretch(found.first, found.last) + found.level.astype(np.uint64)
                doc = np.searchsorted(ends, found.first, side="right")
                shared, offsets = lists(part.column("symbols"))
                # A symbol counts in the documents it was reported for.
                mine = mix(shared.view(np.uint64)) + np.repeat(np.arange(len(ends), dtype=np.uint64), np.diff(offsets))
                hit = np.isin(mix(key) + doc.astype(np.uint64), mine)
                first, last, level = found.first[hit], found.last[hit], found.level[hit]
                begin = (ends - np.diff(ends, prepend=0))[doc[hit]]
                take = np.zeros(len(names), bool)
                for at in np.unique(level):
                    of = level == at
                    marks = np.zeros(len(names) + 1, np.int64)
                    np.add.at(marks, np.maximum(last[of] - window, begin[of]), 1)
                    np.add.at(marks, first[of] + 1, -1)
                    take |= (np.cumsum(marks)[:-1] > 0) & (found.window_level == at)
                start = np.flatnonzero(take)
                one = sums.stretch(start, start + window).view(np.int64)
                two = Sums(mix(names + np.uint64(1))).stretch(start, start + window).view(np.int64)
                doc = np.searchsorted(ends, start, side="right")
                begin = (ends - np.diff(ends, prepend=0))[doc]
                place = (start - begin).astype(np.int32)
                # The batch may hold documents in any order; the earliest place comes first.
                by_id = np.lexsort((place, ids[doc]))
                one, two, doc, place = one[by_id], two[by_id], doc[by_id], place[by_id]
                order, at = _first_of_each(one, two)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[order[at]]), pa.array(two[order[at]]), pa.array(ids[doc[order[at]]]),
                     pa.array(place[order[at]]), _rest([ids[doc], place], order, at, _MORE_PLACES, ["doc_id", "start"])],
                    names=["one", "two", "doc_id", "start", "more"])
    return run


def _kept(window: int):
    """Words, removed words and the kept text; ``starts`` are the places of repeated windows."""
    def run(batches):
        for batch in batches:
            for part, words in _chunks(batch):
                starts, offsets = lists(part.column("starts"))
                whole = part.column("copy").to_pylist()
                n, gone, kept = [], [], []
                for i, doc in enumerate(words):
                    n.append(len(doc))
                    mine = starts[offsets[i]:offsets[i + 1]]
                    if whole[i] and len(doc) >= window:
                        doc = []
                    elif len(mine):
                        marks = np.zeros(len(doc) + window + 1, np.int32)
                        np.add.at(marks, mine, 1)
                        np.add.at(marks, mine + window, -1)
                        cover = np.cumsum(marks)[:len(doc)] > 0
                        doc = [w for w, c in zip(doc, cover.tolist(), strict=True) if not c]
                    gone.append(n[-1] - len(doc))
                    kept.append(b" ".join(doc))
                columns = [part.column(c) for c in part.schema.names if c not in ("starts", "copy")]
                names = [c for c in part.schema.names if c not in ("starts", "copy")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=[*names, "n_words", "n_removed", "kept_sha256", "kept_text"])
    return run


def repeated_windows(docs: DataFrame, window: int = 20, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, starts, copy): the windows of each document that also start earlier.

    ``copy`` says that the whole text is that of a smaller doc_id, so all its windows do.
    Documents without a repeat may be missing. All joins take ``docs`` as it is, on the left side of
    an outer join, so that Spark shuffles the texts once and reuses that exchange.
    """
    texts = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("a"), F.md5(F.coalesce("text", F.lit(""))).alias("b"))
    firsts = texts.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"))
    # Each distinct text is compared once. A document may stand for several texts only if ids repeat.
    mine = firsts.select("doc_id").distinct().withColumn("mine", F.lit(True))
    own = docs.join(mine.hint("shuffle_hash"), "doc_id", "left")
    symbols = own.mapInArrow(_symbol_rows(window, rounds), "symbol long, doc_id long, more array<struct<doc_id: long>>")
    by_symbol = Window.partitionBy("symbol").orderBy("doc_id")
    shared = (
        symbols.withColumn("n", F.row_number().over(by_symbol)).withColumn("next", F.lead("symbol").over(by_symbol))
        .where("n > 1 OR next IS NOT NULL OR more IS NOT NULL")
        .select("symbol", F.explode(F.concat(
            F.array(F.struct("doc_id")), F.coalesce("more", F.array().cast("array<struct<doc_id: long>>")))).alias("at"))
        .select("symbol", "at.doc_id").groupBy("doc_id").agg(F.collect_set("symbol").alias("symbols"))
    )
    windows = docs.join(shared.hint("shuffle_hash"), "doc_id", "left").mapInArrow(
        _window_rows(window, rounds), "one long, two long, doc_id long, start int, more array<struct<doc_id: long, start: int>>")
    order = F.rank().over(Window.partitionBy("one", "two").orderBy("doc_id", "start"))
    # The first row of a window holds its earliest place; what a row holds beyond is always a repeat
    # unless it is that very place again, in a repeated row of the table.
    earliest = F.first(F.struct("doc_id", "start")).over(Window.partitionBy("one", "two").orderBy("doc_id", "start"))
    repeats = (
        windows.withColumn("rank", order).withColumn("earliest", earliest)
        .where("rank > 1 OR more IS NOT NULL")
        .select("earliest", F.explode(F.concat(
            F.array(F.struct("doc_id", "start")),
            F.coalesce("more", F.array().cast("array<struct<doc_id: long, start: int>>")))).alias("at"))
        .where("at > earliest")
        .groupBy("at.doc_id").agg(F.collect_set("at.start").alias("starts"))
    )
    copies = (
        texts.join(firsts.withColumnRenamed("doc_id", "first"), ["a", "b"]).where("doc_id > first")
        .select("doc_id").distinct().withColumn("copy", F.lit(True))
    )
    return repeats.join(copies, "doc_id", "full_outer")


def substring_dedup(docs: DataFrame, window: int = 20, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and kept_text.

    Words are the runs of characters other than blanks and ASCII controls 9 to 13. A word goes if
    a window of ``window`` words covers it whose words also start earlier: in a smaller doc_id, or
    earlier in the document. Windows are judged on the input.

    A null or empty text has no words and keeps the empty text. Rows without a doc_id are kept
    whole and no row loses words to them. Equal rows get equal results; rows that share a doc_id
    with different texts count as one document, whose places they share. Other columns
    stay, but for those named as one of ``RESERVED``.
    """
    columns = [c for c in docs.columns if c not in RESERVED]
    docs = docs.select(*[F.col(f"`{c}`") for c in columns])
    gone = repeated_windows(docs, window, rounds)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return (
        docs.join(gone.hint("shuffle_hash"), "doc_id", "left")
        .select(*[F.col(f"`{c}`") for c in columns], F.coalesce("starts", F.array().cast("array<int>")).alias("starts"),
                F.coalesce("copy", F.lit(False)).alias("copy"))
        .mapInArrow(_kept(window), f"{schema}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    )
