"""Character spans and BIO tags inside one text, as linear array expressions.

Spans are structs (start, end) with half-open code-point offsets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from souqlytics.functions.text import let, strip

# Tag ids (fixed values): outside, begin, inside; -100 marks tokens to ignore.
TAG_O, TAG_B, TAG_I, TAG_IGNORE = 0, 1, 2, -100
SPAN = "struct<start:int,end:int>"
SPANS = f"array<{SPAN}>"
# A private-use character stands for "the term was here" while searching.
MARK = "\ue000"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A plain projection may be copied by the optimizer into filters above it and, with
    them, into the lambdas that use it, where it would run once per array element. A
    generator over a one-element array is not looked through.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(row)))


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _letters(tags: Column, offsets: Column | None = None) -> Column:
    """One letter per token, so that runs can be found by a regular expression."""
    def letter(tag: Column) -> Column:
        return F.when(tag == TAG_B, "B").when(tag == TAG_I, "I").otherwise("O")

    if offsets is None:
        return F.array_join(F.transform(tags, letter), "")
    pairs = F.arrays_zip(offsets.alias("o"), tags.alias("t"))
    return F.array_join(
        F.transform(
            pairs,
            lambda p: F.when(p["o"]["start"] == p["o"]["end"], "O").otherwise(letter(p["t"])),
        ),
        "",
    )


def _runs(letters: Column, starts: Column, pattern: str) -> Column:
    """Token runs (first, last) for the start positions a pattern's matches belong to."""
    lengths = F.transform(F.regexp_extract_all(letters, F.lit(pattern), 0), lambda m: F.length(m))
    return F.zip_with(
        starts,
        lengths,
        lambda s, n: F.struct(s.alias("first"), (s + n - 1).alias("last")),
    )


def decode_spans(offsets: Column, tags: Column) -> Column:
    """Spans of a B followed by its I's; an I with nothing open is ignored."""
    letters = _letters(tags, offsets)
    pairs = F.arrays_zip(offsets.alias("o"), tags.alias("t"))
    begins = F.filter(
        F.transform(
            pairs,
            lambda p, i: F.when(
                (p["t"] == TAG_B) & (p["o"]["start"] < p["o"]["end"]), i
            ),
        ),
        lambda i: i.isNotNull(),
    )
    spans = F.transform(
        _runs(letters, begins, "BI*"),
        lambda r: _span(F.get(offsets, r["first"])["start"], F.get(offsets, r["last"])["end"]),
    )
    return F.coalesce(spans, F.array().cast(SPANS))


def entity_runs(tags: Column) -> Column:
    """Token index runs for scoring: a stray I opens a run of its own.

    Ignored tokens have to be cut out beforehand.
    """
    letters = _letters(tags)
    starts = F.filter(
        F.transform(
            tags,
            lambda t, i: F.when(
                (t == TAG_B)
                | ((t == TAG_I) & F.coalesce(~F.get(tags, i - 1).isin(TAG_B, TAG_I), F.lit(True))),
                i,
            ),
        ),
        lambda i: i.isNotNull(),
    )
    return _runs(letters, starts, "[BI]I*")


def span_terms(text: Column, spans: Column) -> Column:
    """(start, end, trimmed term) of every non-empty span."""
    cut = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            strip(F.substring(text, s["start"] + 1, s["end"] - s["start"])).alias("term"),
        ),
    )
    return F.filter(cut, lambda s: (s["end"] > s["start"]) & (s["term"] != ""))


# White space by code point, up to the last such character.
_BLANK = np.array([chr(i).isspace() for i in range(0x3001)] + [False])


@F.arrow_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def _word_offsets(texts: pa.Array) -> pa.Array:
    """All texts of a batch at once: one code-point array, cut where blanks begin and end."""
    strings = texts.fill_null("").to_pylist()
    codes = np.frombuffer(" ".join(strings).encode("utf-32-le"), dtype="<u4")
    blank = _BLANK[np.minimum(codes, len(_BLANK) - 1)]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1]))) if len(codes) else np.empty(0, int)
    ends = np.flatnonzero(~blank & np.concatenate((blank[1:], [True]))) + 1 if len(codes) else starts
    sizes = np.fromiter((len(t) for t in strings), dtype="int64", count=len(strings))
    base = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype("int64")
    row = np.searchsorted(base, starts, side="right") - 1
    lists = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(strings)))))
    spans = pa.StructArray.from_arrays(
        [pa.array(starts - base[row], pa.int32()), pa.array(ends - base[row], pa.int32())],
        names=["start", "end"],
    )
    return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), spans)


def word_offsets(text: Column) -> Column:
    """(start, end) of the white-space words.

    A running length per word is nothing the built-in array functions give in linear
    time, so whole Arrow batches go through numpy. Put it behind ``once``.
    """
    return _word_offsets(text)


def occurrences(text: Column, term: Column) -> Column:
    """Start positions of the non-overlapping occurrences of ``term``, left to right."""
    pieces = F.split(F.replace(F.translate(text, MARK, "\ue001"), term, F.lit(MARK)), MARK)
    # Running length over the pieces in front of each hit; hits are few. What stays the
    # same rides in the start value, which is evaluated once and not once per step.
    start = F.struct(
        F.length(term).alias("size"), F.lit(0).alias("pos"),
        F.array().cast("array<int>").alias("found"),
    )
    folded = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        start,
        lambda acc, piece: F.struct(
            acc["size"].alias("size"),
            (acc["pos"] + F.length(piece) + acc["size"]).alias("pos"),
            F.array_append(acc["found"], acc["pos"] + F.length(piece)).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return F.when(F.length(term) > 0, folded).otherwise(F.array().cast("array<int>"))


def next_place(text: Column, term: Column, at: Column) -> Column:
    """Start of the first ``term`` at or behind the offset ``at``, -1 if there is none."""
    return F.position(term, text, at + 1) - 1


def check_or_find(text: Column, term: Column, start: Column, end: Column) -> Column:
    """The given offsets if they cut out the term, else its first place, else -1."""
    given = (
        (start >= 0)
        & (start < end)
        & (end <= F.length(text))
        & (F.substring(text, start + 1, end - start) == term)
    )
    at = F.instr(text, term) - 1
    return (
        F.when(given, _span(start, end))
        .when(at >= 0, _span(at, at + F.length(term)))
        .otherwise(_span(F.lit(-1), F.lit(-1)))
    )


def realign(text: Column, new_text: Column, start: Column, end: Column, fold) -> Column:
    """Where the cut-out term sits after both text and term went through ``fold``.

    Several hits: the one nearest the proportional position, the earlier on ties.
    """
    inside = (start >= 0) & (end >= 0) & (end <= F.length(text)) & (start < end)
    cut = F.when(inside, F.substring(text, start + 1, end - start))
    goal = start / F.greatest(F.length(text), F.lit(1)) * F.length(new_text)
    nowhere = F.struct(
        goal.cast("double").alias("goal"), F.lit(None).cast("double").alias("far"),
        F.lit(None).cast("int").alias("pos"),
    )

    def nearer(acc: Column, p: Column) -> Column:
        far = F.abs(p - acc["goal"])
        better = acc["far"].isNull() | (far < acc["far"])
        return F.struct(
            acc["goal"].alias("goal"),
            F.when(better, far).otherwise(acc["far"]).alias("far"),
            F.when(better, p).otherwise(acc["pos"]).alias("pos"),
        )

    def among_all(found: Column) -> Column:
        return F.aggregate(occurrences(new_text, found["term"]), nowhere, nearer, lambda acc: acc["pos"])

    # One or two places, as nearly all terms have, are told apart without a list of all places.
    # A text that holds the mark itself goes the long way.
    def among_two(found: Column) -> Column:
        first, second = found["first"], found["second"]
        far_first, far_second = F.abs(first - goal.cast("double")), F.abs(second - goal.cast("double"))
        third = next_place(new_text, found["term"], second + F.length(found["term"]))
        return (
            F.when(second < 0, first)
            .when(third >= 0, among_all(found))
            .otherwise(F.when(far_second < far_first, second).otherwise(first))
        )

    def placed(found: Column) -> Column:
        best = (
            F.when(F.contains(new_text, F.lit(MARK)), among_all(found))
            .when(found["first"] >= 0, among_two(found))
        )
        size = F.length(found["term"])
        return let(best, lambda at: F.when(at.isNotNull(), _span(at, at + size)).otherwise(
            _span(F.lit(-1), F.lit(-1))
        ))

    def looked_up(term: Column) -> Column:
        size = F.length(term)
        first = let(F.when(size > 0, F.instr(new_text, term) - 1), lambda at: F.struct(
            term.alias("term"), at.alias("first"),
            F.when(at >= 0, next_place(new_text, term, at + size)).alias("second"),
        ))
        return let(first, placed)

    return let(cut, lambda c: let(fold(c), looked_up))


def tag_tokens(offsets: Column, spans: Column) -> Column:
    """One tag per token; the first span around a token decides."""
    def tag(tok: Column) -> Column:
        around = F.filter(
            spans, lambda s: (tok["start"] >= s["start"]) & (tok["end"] <= s["end"])
        )
        first = F.get(around, F.lit(0))
        return (
            F.when(tok["start"] == tok["end"], TAG_IGNORE)
            .when(first.isNull(), TAG_O)
            .when(first["start"] == tok["start"], TAG_B)
            .otherwise(TAG_I)
        )

    return F.transform(offsets, tag)
