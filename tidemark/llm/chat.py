"""Chat formatting at token level.

Role and text of a turn are encoded on their own and spliced between reserved ids, which no
text can produce. Control strings occurring in a text are escaped reversibly, so that
the rendered form is unambiguous too. Loss masks and places are prefix sums: within a turn
over the segments, within a conversation in two levels (slices of turns, then over
slices), so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, unkeyed
from tidemark.sources.shared import materialise

# The template: strings that mark a turn, and further control strings of common templates.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
CONTROL = (TURN, BODY, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
_ESCAPE = re.compile("|".join(rf"({re.escape(c[0])})(\\*)({re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile("|".join(rf"({re.escape(c[0])})\\(\\*)({re.escape(c[1:])})" for c in CONTROL))


@dataclass(frozen=True)
class ChatOptions:
    """`vocabulary` is the number of ordinary ids; the three after it are reserved. Texts of
    the `trained` role are under the loss mask. `slice_turns` turns make a slice."""

    tokenizer: str
    vocabulary: int = 50_257
    trained: str = "assistant"
    slice_turns: int = 256


def escape(text: str) -> str:
    """One backslash more after the first character of each control string."""
    return _ESCAPE.sub(_grown, text)


def _grown(m: re.Match) -> str:
    first, slashes, rest = (g for g in m.groups() if g is not None)
    return f"{first}\\{slashes}{rest}"


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "".join(g for g in m.groups() if g is not None), text)


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def _formatted(batches: Iterator[pa.RecordBatch], options: ChatOptions) -> Iterator[pa.RecordBatch]:
    tokenizer = _tokenizer(options.tokenizer)
    turn, body, end = (np.array([options.vocabulary + i], dtype="<u4") for i in range(3))
    for batch in batches:
        roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        segments = [escape(s) for pair in zip(roles, texts, strict=True) for s in pair]
        encoded = [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        ids, masks, sizes, chars = [], [], [], []
        for i, role in enumerate(roles):
            said, text = encoded[2 * i], encoded[2 * i + 1]
            ids.append(np.concatenate((turn, said, body, text, end)))
            edges = np.zeros(len(ids[-1]) + 1, dtype=np.int8)
            if role == options.trained:
                edges[len(said) + 2] += 1
                edges[len(said) + 2 + len(text)] -= 1
            masks.append(np.packbits(np.cumsum(edges[:-1], dtype=np.int8).astype(bool)).tobytes())
            sizes.append(len(ids[-1]))
            chars.append(len(TURN) + len(segments[2 * i]) + len(BODY) + len(segments[2 * i + 1]) + len(END))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"), batch.column("turn"), batch.column("slice"),
                pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(masks, pa.binary()),
                pa.array(sizes, pa.int64()), pa.array(chars, pa.int64()),
            ],
            names=["key", "turn", "slice", "ids", "mask", "n_tokens", "n_chars"],
        )


def format_turns(turns: DataFrame, options: ChatOptions) -> DataFrame:
    """The stored formatted turns: key, turn, slice, ids (u32 little-endian), mask (bits),
    n_tokens, n_chars, and start, the tokens before the turn in its conversation.

    NULL roles and texts are empty strings, a NULL turn comes first, a NULL conv_id is a
    conversation like any other. Rows repeating a turn all stay, in the order of their ids
    (role and text as encoded). An empty table gives no row.
    """
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("key"),
        F.coalesce(F.col("turn").cast("long"), F.lit(NO_ID)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("slice", F.floor(F.col("turn") / options.slice_turns).cast("long"))
    kind = "key long, turn long, slice long, ids binary, mask binary, n_tokens long, n_chars long"
    formatted = materialise(rows.mapInArrow(lambda it: _formatted(it, options), kind), "chat-turns")
    slices = formatted.groupBy("key", "slice").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("key", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    mine = Window.partitionBy("key", "slice").orderBy("turn", "ids").rowsBetween(Window.unboundedPreceding, -1)
    placed = formatted.withColumn("inside", F.coalesce(F.sum("n_tokens").over(mine), F.lit(0)))
    placed = placed.join(slices, ["key", "slice"]).withColumn("start", F.col("base") + F.col("inside"))
    return materialise(placed.drop("base", "inside"), "chat-formatted")


def _digested(batches: Iterator[pa.RecordBatch], options: ChatOptions) -> Iterator[pa.RecordBatch]:
    """Reads turns back in order; holds digests, never a conversation."""
    tokenizer = _tokenizer(options.tokenizer)
    now: list | None = None

    def decode(ids: np.ndarray) -> str:
        return unescape(tokenizer.decode(ids.tolist(), skip_special_tokens=False)) if len(ids) else ""

    def closed() -> pa.RecordBatch:
        key, n, all_, loss_chars, loss, chars = now
        return pa.RecordBatch.from_pylist(
            [{"key": key, "n_turns": n, "turns_sha256": all_.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}]
        )

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("key", "ids", "mask", "n_chars"))
        for key, data, mask, chars in zip(*columns, strict=True):
            if now is None or now[0] != key:
                if now is not None:
                    yield closed()
                now = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            ids = np.frombuffer(data, dtype="<u4")
            on = np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=len(ids)).astype(bool)
            cut = int(np.flatnonzero(ids == options.vocabulary + 1)[0])
            role, text = decode(ids[1:cut]), decode(ids[cut + 1 : -1])
            trained = decode(ids[on])
            now[1] += 1
            now[2].update(f"{role}\n{text}\n".encode())
            now[3] += len(trained)
            now[4].update(trained.encode())
            now[5] += chars
    if now is not None:
        yield closed()


def digests(formatted: DataFrame, options: ChatOptions) -> DataFrame:
    """One row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. A digest runs over a conversation in order, so one task reads it, as
    a stream."""
    kind = "key long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ordered = formatted.select("key", "start", "ids", "mask", "n_chars").repartition("key").sortWithinPartitions("key", "start")
    return ordered.mapInArrow(lambda it: _digested(it, options), kind).select(
        unkeyed("key", "conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )
