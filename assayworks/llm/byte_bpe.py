"""Byte-level BPE with a rank file, encoded and decoded.

``Codec`` holds the expressions: Spark higher-order functions fold merges over the bytes of a word,
lowest rank first, with ranks from a literal map, and decode by concatenating binary pieces. Over
whole corpora that form is too slow (figures in the README), so ``encode`` runs the same fold over
the distinct pieces of each slice of documents inside Arrow batches, with no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayworks.llm.common import SLICE_BYTES, slices

#: Buckets of the literal rank map; Spark searches a map value from its first to its last key.
BUCKETS = 8192
#: Longer pieces take a heap of pairs instead of a scan for each merge (same merges).
SCAN_BYTES = 64
#: Encoded pieces a task remembers between slices; beyond, it forgets them all and goes on.
REMEMBERED = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


class Codec:
    """Encoding and decoding as Spark expressions over hexadecimal bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        names = [""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            name = token.hex().upper()
            buckets[zlib.crc32(name.encode()) % BUCKETS][name] = rank
            names[rank] = name
        # Both constants are folded into literals before the query runs.
        self._ranks = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")
        self._names = F.split(F.lit(",".join(names)), ",")

    def rank(self, name: Column) -> Column:
        """Rank of a token given by its hexadecimal bytes, else null."""
        return F.get(self._ranks, (F.crc32(name) % BUCKETS).cast("int"))[name]

    def _merged(self, state: Column) -> Column:
        """The state after its lowest-ranking pair, the leftmost of equals, is joined."""
        def at(p: Column) -> Column:
            s, r = state["s"], state["r"]
            none = F.array().cast("array<int>")

            def joined(one: Column) -> Column:
                left = F.when(p > 1, F.array(self.rank(F.concat(F.get(s, p - 2), one)))).otherwise(none)
                right = F.when(p < F.size(r), F.array(self.rank(F.concat(one, F.get(s, p + 1))))).otherwise(none)
                return F.struct(
                    F.concat(F.slice(s, F.lit(1), p - 1), F.array(one), F.slice(s, p + 2, F.size(s))).alias("s"),
                    F.concat(F.slice(r, F.lit(1), F.greatest(p - 2, F.lit(0))), left, right,
                             F.slice(r, p + 2, F.size(s))).alias("r"))

            return F.when(p.isNull(), state).otherwise(_bind(F.concat(F.get(s, p - 1), F.get(s, p)), joined))

        return _bind(F.array_position(state["r"], F.array_min(state["r"])).cast("int"), at)

    def encode(self, word: Column) -> Column:
        """Token ids of one piece of text."""
        def folded(name: Column) -> Column:
            one = F.regexp_extract_all(name, F.lit("(..)"), F.lit(1))

            def fold(s: Column) -> Column:
                r = F.transform(F.slice(s, F.lit(2), F.size(s)), lambda b, i: self.rank(F.concat(F.get(s, i), b)))
                state = F.struct(s.alias("s"), r.alias("r"))
                steps = F.slice(s, F.lit(2), F.size(s))
                return F.aggregate(steps, state, lambda a, _: self._merged(a), lambda a: F.transform(a["s"], self.rank))

            whole = self.rank(name)
            return F.when(whole.isNotNull(), F.array(whole)).otherwise(_bind(one, fold))

        return _bind(F.hex(F.encode(word, "UTF-8")), folded)

    def decode(self, ids: Column) -> Column:
        """The bytes of token ids, piece after piece."""
        return F.aggregate(ids, F.lit(b""), lambda a, i: F.concat(a, F.unhex(F.get(self._names, i))))


def fold(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a piece: its lowest-ranking pair, the leftmost of equals, joins until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > SCAN_BYTES:
        return _fold_long(piece, ranks)
    none = 1 << 60
    parts = [piece[i:i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        one = parts[i] + parts[i + 1]
        parts[i:i + 2] = [one]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + one, none)
        if i < len(pairs):
            pairs[i] = ranks.get(one + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _fold_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    live = [True] * n

    def push(i: int) -> None:
        j = after[i]
        if j < n:
            rank = ranks.get(piece[i:end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[i], end[j]))

    heap: list[tuple[int, int, int, int]] = []
    for i in range(n - 1):
        push(i)
    while heap:
        _, i, middle, last = heapq.heappop(heap)
        if not live[i] or end[i] != middle or middle >= n or not live[middle] or end[middle] != last:
            continue
        live[middle] = False
        end[i], after[i] = last, after[middle]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [ranks[piece[i:end[i]]] for i in range(n) if live[i]]


def compiled(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode has it, which leaves out ASCII controls 28 to 31."""
    return regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


def _encoded(ranks: dict[bytes, int], pattern: str, ids: bool, columns: list[str]):
    def run(batches):
        find = compiled(pattern).findall
        names = {rank: token for token, rank in ranks.items()}
        known: dict[str, tuple[str, list[int], bytes]] = {}
        for batch in batches:
            text = batch.column("text")
            lengths = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
            for low, high in slices(batch, lengths, SLICE_BYTES):
                part = batch.slice(low, high - low)
                if len(known) > REMEMBERED:
                    known.clear()
                n, lists, ids_sha, decoded_sha = [], [], [], []
                for one in part.column("text").to_pylist():
                    pieces = find(one or "")
                    for piece in set(pieces).difference(known):
                        tokens = fold(piece.encode(), ranks)
                        known[piece] = " ".join(map(str, tokens)), tokens, b"".join(names[t] for t in tokens)
                    found = [known[p] for p in pieces]
                    n.append(sum(len(f[1]) for f in found))
                    ids_sha.append(hashlib.sha256(" ".join([f[0] for f in found]).encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(b"".join([f[2] for f in found])).hexdigest())
                    if ids:
                        lists.append(pa.array(chain.from_iterable([f[1] for f in found]), pa.int32()))
                made = [pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]
                if ids:
                    offsets = pa.array([0, *_running(map(len, lists))], pa.int32())
                    made.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(lists)))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in columns], *made],
                    names=[*columns, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])
    return run


def _running(lengths):
    total = 0
    for n in lengths:
        total += n
        yield total


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, ids: bool = True,
           keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids,
    which replace columns of these names.

    Each match of ``pattern`` is encoded on its own, without special tokens; ids_sha256 is over the
    decimal ids joined by one space, decoded_sha256 over the bytes that the ids stand for. A null text
    is empty: no tokens, digests of nothing. Every row gives one row, repeated ones too; a very long
    piece takes time in proportion to its length times its logarithm.
    """
    columns = [c for c in dict.fromkeys(keep) if c not in ("n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids)]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    asked = docs.select(*[F.col(f"`{c}`") for c in columns], *([] if "text" in columns else ["text"]))
    return asked.mapInArrow(
        _encoded(ranks, pattern, ids, columns),
        f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of a column of token ids."""
    return Codec(ranks).decode(ids)
