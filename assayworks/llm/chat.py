"""Chat formatting with typed content parts.

A turn is a role and a list of parts. A visitor flattens the parts in order: text is escaped, images,
audio and documents become placeholders that stand for a number of tokens and point to an
attachment. Turns are formatted one by one, so a conversation is never gathered; its text is its turns'
segments in order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template. Between an opening and a closing mark no text holds "<|".
START, END = "<|im_start|>", "<|im_end|>"
PLACES = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens a part stands for: image tiles of a side, audio frames a second, tokens of a page.
TILE, FRAMES, PAGE = 28, 25, 600
PART = "struct<type: string, text: string, ref: string, width: long, height: long, seconds: double, pages: long>"


def escaped(text: Column) -> Column:
    """The text without "<|": a backslash goes before each backslash and between < and |."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A plain text as a list of one part."""
    null = F.lit(None)
    return F.array(F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"),
        null.cast("long").alias("width"), null.cast("long").alias("height"), null.cast("double").alias("seconds"),
        null.cast("long").alias("pages"))).cast(f"array<{PART}>")


def _visit(part: Column) -> Column:
    """A part as (what stands in the segment, tokens it stands for)."""
    kind = F.coalesce(part["type"], F.lit("text"))

    def at_least_one(n: Column) -> Column:
        return F.greatest(F.coalesce(n, F.lit(1)).cast("long"), F.lit(1).cast("long"))

    tiles = F.ceil(part["width"] / F.lit(TILE)) * F.ceil(part["height"] / F.lit(TILE))
    placed = F.when(kind == "image", F.lit(PLACES["image"])).when(kind == "audio", F.lit(PLACES["audio"])).when(
        kind == "document", F.lit(PLACES["document"])).otherwise(escaped(part["text"]))
    tokens = F.when(kind == "image", at_least_one(tiles)).when(
        kind == "audio", at_least_one(F.ceil(part["seconds"] * F.lit(FRAMES)))).when(
        kind == "document", at_least_one(part["pages"] * F.lit(PAGE))).otherwise(F.lit(0).cast("long"))
    return F.struct(placed.alias("placed"), tokens.alias("tokens"), kind.alias("type"), part["ref"].alias("ref"))


def format_turns(turns: DataFrame, parts: str = "parts", learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn, segment, loss_start, loss_end, attachments, expanded_tokens for each row.

    ``turns`` has conv_id, turn, role and a list of parts (``PART``). loss_start and loss_end are the
    code points of the segment that are learned: what a turn of a ``learned`` role says, without its
    marks; else null. attachments lists type, ref, place (offset in the segment) and tokens of every
    placeholder in order. A null role or list is empty, a part of another type counts as text, an
    unknown measure as one token. Roles are escaped like texts, their line ends as backslash and n.
    """
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n"))
    visited = F.transform(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), _visit)
    head = F.concat(F.lit(START), role, F.lit("\n"))
    flat = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), visited.alias("visited"))
    body = F.array_join(F.transform("visited", lambda v: v["placed"]), "")

    def attachment(v: Column, i: Column) -> Column:
        before = F.array_join(F.transform(F.slice("visited", F.lit(1), i), lambda x: x["placed"]), "")
        return F.struct(v["type"].alias("type"), v["ref"].alias("ref"), (F.length("head") + F.length(before)).alias("place"),
                        v["tokens"].alias("tokens"))

    # Only placeholders look at what stands before them; plain texts are never copied for it.
    attached = F.filter(
        F.transform("visited", lambda v, i: F.when(v["tokens"] > 0, attachment(v, i))), lambda a: a.isNotNull())
    said = F.col("role").isin(*learned)
    return flat.select(
        "conv_id", "turn", F.concat("head", body, F.lit(END + "\n")).alias("segment"),
        F.when(said, F.length("head")).alias("loss_start"), F.when(said, F.length("head") + F.length(body)).alias("loss_end"),
        attached.alias("attachments"), F.aggregate("visited", F.lit(0).cast("long"), lambda n, v: n + v["tokens"]).alias("expanded_tokens"))


def read_back(segments: DataFrame) -> DataFrame:
    """role, text and learned text of each segment, from the segment and its mask alone."""
    shape = r"(?s)^<\|im_start\|>(.*?)\n(.*)<\|im_end\|>\n$"
    role = F.regexp_replace(F.regexp_extract("segment", shape, 1), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    learned = F.when(F.col("loss_start").isNotNull(),
                     F.col("segment").substr(F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    return segments.select(
        "conv_id", "turn", unescaped(role).alias("role"), unescaped(F.regexp_extract("segment", shape, 2)).alias("text"),
        unescaped(learned).alias("learned"), F.length("segment").cast("long").alias("chars"))


def _digests(batches):
    """One row per conversation from rows that come conversation by conversation, in order."""
    current: tuple | None = None
    made: list[tuple] = []
    n = chars = learned_chars = 0
    turns = learned = hashlib.sha256()

    def flush() -> pa.RecordBatch:
        columns = list(zip(*made, strict=True)) if made else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for conv, role, text, said, length in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "learned", "chars")], strict=True):
            if current != (conv,):
                if current is not None:
                    made.append((current[0], n, turns.hexdigest(), learned_chars, learned.hexdigest(), chars))
                current, n, chars, learned_chars, turns, learned = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            n += 1
            chars += length
            turns.update(f"{role}\n{text}\n".encode())
            if said is not None:
                learned_chars += len(said)
                learned.update(said.encode())
        yield flush()
        made = []
    if current is not None:
        made.append((current[0], n, turns.hexdigest(), learned_chars, learned.hexdigest(), chars))
        yield flush()


def conversation_digests(segments: DataFrame) -> DataFrame:
    """What each conversation says, read back from its segments.

    Rows go by turn, then role and text. The rows of a conversation stream through one task, which
    holds a batch of them and two running digests, however long the conversation. Rows without a
    conv_id are one conversation.
    """
    rows = read_back(segments)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
