"""From tagged tokens to scored aspects per comment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souqlytics.functions.spans import decode_spans, once, span_terms
from souqlytics.functions.text import aspect_term

# Sentiment classes in model order (fixed values); earlier ones win ties.
CLASSES = ("negative", "neutral", "positive")
ASPECT_ITEMS = (
    "array<struct<term:string,sentiment:string,negative_pct:double,neutral_pct:double,"
    "positive_pct:double,mentions:bigint>>"
)

Scorer = Callable[[pd.Series, pd.Series], np.ndarray]


def comment_spans(tagged: DataFrame) -> DataFrame:
    """(comment_id, text, spans) from (comment_id, text, offsets, tags)."""
    found = once(tagged, spans=decode_spans(F.col("offsets"), F.col("tags")))
    return once(found, spans=span_terms(F.col("text"), F.col("spans"))).select(
        "comment_id", "text", "spans"
    )


def aspect_pairs(spans: DataFrame) -> DataFrame:
    """One row per (comment, text, term), with the term's position in the comment."""
    # The outer form keeps the optimizer from testing the list's size beforehand, which
    # would compute the list twice.
    rows = spans.select("comment_id", "text", F.posexplode_outer("spans").alias("pos", "s"))
    return rows.filter(F.col("pos").isNotNull()).select(
        "comment_id", "text", "pos", F.col("s.term").alias("term")
    )


def score_pairs(spans: DataFrame, scorer: Scorer, pairs_per_call: int = 4096) -> DataFrame:
    """``scorer(texts, terms)`` gives class probabilities, one row of three per pair.

    Takes ``comment_spans``: a text crosses to Python once per comment, the pairs are
    lined up there. A model is loaded by the scorer itself.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = batch["terms"].map(len).to_numpy("int64")
            if not counts.sum():
                continue
            pairs = pd.DataFrame(
                {
                    "comment_id": np.repeat(batch["comment_id"].to_numpy(), counts),
                    "text": np.repeat(batch["text"].to_numpy(dtype=object), counts),
                    "pos": np.concatenate([np.arange(n) for n in counts]).astype("int32"),
                    "term": np.concatenate([np.asarray(t, dtype=object) for t in batch["terms"]]),
                }
            )
            for at in range(0, len(pairs), pairs_per_call):
                part = pairs.iloc[at:at + pairs_per_call]
                probs = np.asarray(scorer(part["text"], part["term"]), dtype="float64")
                probs = probs.reshape(len(part), len(CLASSES))
                yield part[["comment_id", "pos", "term"]].assign(
                    **{c: probs[:, i] for i, c in enumerate(CLASSES)}
                )

    schema = "comment_id bigint, pos int, term string, " + ", ".join(f"{c} double" for c in CLASSES)
    terms = F.transform("spans", lambda s: s["term"]).alias("terms")
    return spans.select("comment_id", "text", terms).mapInPandas(run, schema)


def mean_scores(scored: DataFrame) -> DataFrame:
    """Mean probabilities per comment and normalised term."""
    return (
        scored.withColumn("term", aspect_term(F.col("term")))
        .filter(F.col("term") != "")
        .groupBy("comment_id", "term")
        .agg(
            F.min("pos").alias("pos"),
            F.count(F.lit(1)).alias("mentions"),
            *[F.avg(c).alias(c) for c in CLASSES],
        )
    )


def top_class(scores: dict[str, Column]) -> Column:
    """The class with the highest score, ties to the earlier class."""
    best = F.greatest(*scores.values())
    out = F.when(scores[CLASSES[0]] == best, CLASSES[0])
    for c in CLASSES[1:]:
        out = out.when(scores[c] == best, c)
    return out


def label_aspects(means: DataFrame) -> DataFrame:
    """Label and percentages with one decimal."""
    return means.select(
        "comment_id", "pos", "term",
        top_class({c: F.col(c) for c in CLASSES}).alias("sentiment"),
        *[F.bround(F.col(c) * 100, 1).alias(f"{c}_pct") for c in CLASSES],
        "mentions",
    )


def attach_aspects(comments: DataFrame, labelled: DataFrame, key: str = "id") -> DataFrame:
    """Every comment with ``aspects_json`` in first-mention order and ``num_aspects``.

    The list collected per comment is bounded by the comment's own distinct terms.
    """
    item = F.struct("term", "sentiment", *[f"{c}_pct" for c in CLASSES], "mentions")
    per_comment = labelled.groupBy(F.col("comment_id").alias(key)).agg(
        F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))).alias("_a")
    )
    items = F.transform("_a", lambda a: a["item"])
    return (
        comments.join(per_comment, key, "left")
        .withColumn("aspects_json", F.coalesce(F.to_json(items), F.lit("[]")))
        .withColumn("num_aspects", F.coalesce(F.size("_a"), F.lit(0)))
        .withColumn("num_aspects", F.greatest("num_aspects", F.lit(0)))
        .drop("_a")
    )


def score_comments(comments: DataFrame, tagged: DataFrame, scorer: Scorer) -> DataFrame:
    """Spans, scores, means, labels and the list per comment in a row."""
    labelled = label_aspects(mean_scores(score_pairs(comment_spans(tagged), scorer)))
    return attach_aspects(comments, labelled)
