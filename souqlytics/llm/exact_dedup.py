"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souqlytics.session import stage

# A chunk ends after a vowel and white space, 512 characters at the least and 4096 at the
# most after the last cut. Cuts depend on nearby text only, so chunks stay bounded for texts
# of any length and equal texts are cut alike.
CHUNK = r"(?s).{512,4096}?[aeiou]\s|(?s).{1,4096}"


def chunks_of(text: Column) -> Column:
    """The chunks of a text, in order; joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    fingerprint: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    A recipe is the ordered list of a text's chunk identifiers. An identifier is the chunk's
    fingerprint, verified: all chunks are grouped by fingerprint and content once, and where
    one fingerprint stands for several contents, the content's rank among them joins it.
    Equal recipes are then equal texts. Chunks move once, documents never; the lists that
    are compared hold 8 bytes per chunk.

    The largest id of a group stays. Null text counts as empty, so null and empty texts are
    one group. Rows that repeat an id and its text are the same document: each counts in
    ``group_size`` and all are marked alike. A null id never stays unless its group has no
    other. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    # Verified chunk contents; copies fold before the shuffle.
    contents = (
        base.select(F.explode(chunks_of(F.col("text"))).alias("chunk"))
        .groupBy(fingerprint(F.col("chunk")).alias("fp"), "chunk").agg(F.count(F.lit(1)).alias("n"))
    )
    shared = stage(contents.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp"), "shared-fp")
    recipes = base.select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"),
        F.transform(chunks_of(F.col("text")), lambda c: fingerprint(c)).alias("recipe"),
    )
    if shared.isEmpty():
        recipes = recipes.withColumn("ranks", F.lit(None).cast("array<struct<pos:int,rank:bigint>>"))
    else:
        recipes = _ranked(base, recipes, contents, shared, fingerprint)
    recipes = stage(recipes, "recipes")

    groups = recipes.groupBy("recipe", "ranks").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    repeated = groups.filter("group_size > 1").withColumnsRenamed({"recipe": "g_recipe", "ranks": "g_ranks"})
    same = (F.col("recipe") == F.col("g_recipe")) & F.col("ranks").eqNullSafe(F.col("g_ranks"))
    return recipes.join(repeated, same, "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def _ranked(
    base: DataFrame, recipes: DataFrame, contents: DataFrame, shared: DataFrame, fingerprint: Callable[[Column], Column]
) -> DataFrame:
    """Recipes with the rank of each chunk whose fingerprint has several contents.

    The contents of one fingerprint are gathered in a list: with 64 bits that is two or three.
    """
    known = contents.join(shared, "fp", "left_semi").groupBy("fp").agg(F.sort_array(F.collect_list("chunk")).alias("known"))
    at = (
        base.select(F.sha2("text", 256).alias("text_sha256"), F.posexplode(chunks_of(F.col("text"))).alias("pos", "chunk"))
        .withColumn("fp", fingerprint(F.col("chunk")))
        .join(known, "fp")
        .select("text_sha256", F.struct("pos", F.array_position("known", F.col("chunk")).alias("rank")).alias("at"))
        .groupBy("text_sha256").agg(F.sort_array(F.collect_set("at")).alias("ranks"))
    )
    return recipes.join(at, "text_sha256", "left").select("doc_id", "text_sha256", "recipe", "ranks")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Only the ids that go are joined; rows with a null id stay. Copies that share one id are
    one document and stay together.
    """
    gone = exact_dedup(docs, id_col, text_col).filter("not kept and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
