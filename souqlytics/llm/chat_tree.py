"""Conversations laid out as a prefix tree: shared turns once, depth first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souqlytics.operators.ranking import number_rows, running_total
from souqlytics.session import stage

# The template and the roles that are learned (fixed values).
START, END, LINE = "<|im_start|>", "<|im_end|>\n", "<|n|>"
LEARNED_ROLE = "assistant"

# A turn's conversations stand next to each other; joins deal them out in blocks of so many.
BLOCK = 1024
KEY_BYTES = 16


def escape(text: Column) -> Column:
    """Control strings begin with ``<|``; a text gets one more backslash between the two."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """As ``escape``; line ends become a control string, since the first line end closes the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _encoded(part: Column, path: str) -> Column:
    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        coded = _tokenizer(path).encode_batch(texts.tolist(), add_special_tokens=False)
        return pd.Series([c.ids for c in coded])

    return encode(part)


def formatted_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, tokenizer: str | None) -> DataFrame:
    """Each turn in the template: ``conv_id, turn, digest, formatted, head_len, text_len, length, learned, tokens``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    turns = turns.select(
        "conv_id", "turn", (F.col("role") == LEARNED_ROLE).alias("learned"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
    )
    parts = [F.col("head"), F.col("body"), F.lit(END)]
    if tokenizer:
        turns = turns.withColumns({f"t{i}": _encoded(p, tokenizer) for i, p in enumerate(parts)})
        sizes, tokens = [F.size(f"t{i}") for i in range(3)], F.concat("t0", "t1", "t2")
    else:
        sizes, tokens = [F.length(p) for p in parts], F.lit(None).cast("array<int>")
    formatted = F.concat(*parts)
    digest = F.substring(F.unhex(F.sha2(formatted, 256)), 1, KEY_BYTES)
    return turns.select(
        "conv_id", "turn", digest.alias("digest"), formatted.alias("formatted"), sizes[0].alias("head_len"), sizes[1].alias("text_len"),
        (sizes[0] + sizes[1] + sizes[2]).cast("long").alias("length"), "learned", tokens.alias("tokens"),
    )


_STEP = pa.struct([("turn", pa.int64()), ("digest", pa.binary()), ("length", pa.int64())])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its sorted turns: the keys of its prefixes, and its turns.

    The key of a prefix is a hash of the key before it and the turn, so equal keys are equal
    beginnings.
    """
    conv, open_, path, steps = None, False, b"", []

    def row(kind):
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], kind), pa.array([path], pa.binary()), pa.array([steps], pa.list_(_STEP))], ["conv_id", "path", "steps"])

    for batch in batches:
        kind, done = batch.column(0).type, []
        for c, turn, digest, length in zip(*(col.to_pylist() for col in batch.columns)):
            if not open_ or c != conv:
                if open_:
                    done.append(row(kind))
                conv, open_, path, steps = c, True, b"", []
            path += hashlib.sha256(path[-KEY_BYTES:] + digest).digest()[:KEY_BYTES]
            steps.append({"turn": turn, "digest": digest, "length": length})
        yield from pa.Table.from_batches(done).combine_chunks().to_batches() if done else ()
    if open_:
        yield row(kind)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
SPANS = "array<struct<start:long,end:long>>"


def _attention(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position and ancestor intervals of each turn of each conversation, from its sorted turns.

    Ancestors that follow one another in the layout are one interval.
    """
    order, position, spans = None, 0, []
    for batch in batches:
        positions, context = [], []
        for o, start, length, own in zip(*(batch.column(c).to_pylist() for c in ("conversation", "start", "length", "own"))):
            if o != order:
                order, position, spans = o, 0, []
            positions.append(position)
            context.append([{"start": a, "end": b} for a, b in spans] if own else None)
            position += length
            if spans and spans[-1][1] == start:
                spans[-1] = (spans[-1][0], start + length)
            else:
                spans.append((start, start + length))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(positions, pa.int64()), pa.array(context, pa.list_(_SPAN))], [*batch.schema.names, "position", "attention"])


def _in_blocks(nodes: DataFrame) -> DataFrame:
    """A node once for each block of conversations that has it."""
    first, last = (F.floor(F.col(c) / BLOCK).cast("long") for c in ("first", "last"))
    return nodes.withColumn("block", F.explode(F.sequence(first, last))).drop("first", "last")


def lay_out(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    tokenizer: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The tree of all conversations, as two tables written to the shared folder.

    ``nodes``: ``start, length, position, attention, loss_start, loss_end, formatted, tokens,
    first, last``. A node is a turn after a beginning; conversations that begin alike share
    it. All nodes make one token sequence in depth-first order: a node's tokens stand at
    ``start`` to ``start + length``, their position ids count from ``position``, and they see
    the tokens of the intervals ``attention`` (the turns before, in this sequence) and those
    before them in their own node. ``loss_start`` to ``loss_end`` are the tokens to learn: the
    text of an assistant's turn; null in other turns. ``places``: ``conv_id, conversation, depth,
    start``, which node each turn of a conversation is; ``conversation`` numbers them in depth-first order.

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``; ``<|`` in a role or text is escaped. Tokens
    are code points, or those of the ``tokenizer`` file, which cuts head, text and end apart.

    Turns stand in order of ``turn`` (nulls first), then of a hash of what they hold. Rows that repeat a turn number count each.
    Null role and text count as empty; a null conversation id is an id like others. Other
    columns are ignored; empty tables give empty ones. A task holds 60 bytes a turn of one
    conversation, never texts; conversations that share a turn are dealt out in blocks.
    """
    turns = formatted_turns(conversations, conv_col, turn_col, role_col, text_col, tokenizer)
    kind = turns.schema["conv_id"].dataType.simpleString()
    slim = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "digest", "length")
    paths = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest").mapInArrow(
        _paths, f"conv_id {kind}, path binary, steps array<struct<turn:long,digest:binary,length:long>>")
    # sorted by their keys, conversations that begin alike stand together: depth-first order
    ordered = number_rows(stage(paths, "paths"), [F.col("path"), F.col("conv_id").asc_nulls_first()], "conversation")
    steps = stage(
        ordered.select("conv_id", "conversation", "path", F.posexplode("steps").alias("depth", "s")).select(
            "conv_id", "conversation", "depth", "s.*", F.expr(f"substring(path, depth * {KEY_BYTES} + 1, {KEY_BYTES})").alias("node")), "steps",
    )
    # the first conversation that has a node gives it out
    nodes = steps.groupBy("node").agg(F.min("conversation").alias("first"), F.max("conversation").alias("last"), F.max("depth").alias("depth"), F.max("length").alias("length"))
    starts = stage(
        running_total(nodes, [F.col("first"), F.col("depth")], "length", "end").select("node", "first", "last", (F.col("end") - F.col("length")).alias("start")), "starts")
    reached = steps.withColumn("block", F.floor(F.col("conversation") / BLOCK).cast("long")).join(
        _in_blocks(starts.withColumn("owner", F.col("first"))), ["node", "block"])
    ranges = starts.select("start", "first", "last")
    seen = stage(
        reached.select("conv_id", "conversation", "depth", "turn", "digest", "start", "length", (F.col("owner") == F.col("conversation")).alias("own"))
        .repartition("conversation").sortWithinPartitions("conversation", "depth").mapInArrow(
            _attention,
            f"conv_id {kind}, conversation long, depth int, turn long, digest binary, start long, length long, own boolean, position long, attention {SPANS}"),
        "turns-in-tree",
    )
    own = seen.filter("own").join(ranges, "start").select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("digest").alias("d"), "start", "position", "attention", "first", "last")
    texts = turns.withColumn("turn", F.col("turn").cast("long")).dropDuplicates(["conv_id", "turn", "digest"])
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("digest") == F.col("d"))
    loss = F.col("start") + F.col("head_len")
    whole = texts.join(own, same).select(
        "start", "length", "position", "attention", F.when(F.col("learned"), loss).alias("loss_start"),
        F.when(F.col("learned"), loss + F.col("text_len")).alias("loss_end"), "formatted", "tokens", "first", "last",
    ).orderBy("start")
    return stage(whole, "tree-nodes"), seen.select("conv_id", "conversation", "depth", "start")


def read_back(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """The turns of each conversation, from a layout whose tokens are code points.

    ``conv_id, conversation, depth, length, role, text, learned``: the last is the text under the loss mask, null where nothing is.
    """
    body = F.expr(f"substring(formatted, {len(START) + 1}, length(formatted) - {len(START) + len(END)})")
    turns = (
        places.withColumn("block", F.floor(F.col("conversation") / BLOCK).cast("long"))
        .join(_in_blocks(nodes), ["start", "block"]).withColumn("body", body).withColumn("head", F.substring_index("body", "\n", 1))
    )
    under = F.expr("substring(formatted, loss_start - start + 1, loss_end - loss_start)")
    return turns.select(
        "conv_id", "conversation", "depth", "length", unescape_role(F.col("head")).alias("role"),
        unescape(F.expr("substring(body, length(head) + 2)")).alias("text"), unescape(under).alias("learned"),
    )


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of what was read back.

    Turns pass by in order; no conversation is held.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, state = None, None
        for batch in batches:
            done = []
            for c, o, length, role, text, learned in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "conversation", "length", "role", "text", "learned"))):
                if o != order:
                    if state:
                        done.append(state)
                    order, state = o, [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(learned or "")
                state[4].update((learned or "").encode())
                state[5] += length
            yield rows(done, batch.column(0).type)
        if state:
            yield rows([state], batch.column(0).type)

    def rows(done, id_type) -> pa.RecordBatch:
        c, n, whole, chars, loss, size = zip(*done) if done else ((),) * 6
        return pa.RecordBatch.from_arrays([
            pa.array(c, id_type), pa.array(n, pa.int64()), pa.array([h.hexdigest() for h in whole], pa.string()), pa.array(chars, pa.int64()),
            pa.array([h.hexdigest() for h in loss], pa.string()), pa.array(size, pa.int64()),
        ], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return turns.repartition("conversation").sortWithinPartitions("conversation", "depth").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
