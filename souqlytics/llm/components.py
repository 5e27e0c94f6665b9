"""Connected groups of a link table, and links among the members of buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souqlytics.session import stage

# A pass of ``components`` writes a file per so many links, and one per core.
FILE_ROWS = 100_000


def components(links: DataFrame) -> DataFrame:
    """``a, b`` -> ``id, label``: the smallest id that each linked id can reach.

    Each pass takes the smallest label around an id, then the label of that label, so the
    distance covered doubles; every pass is written to the shared folder. Labels meet links
    in joins and hash aggregates that combine before the shuffle; nothing is collected.
    The files of a pass are as few as its rows need: a small table has many passes, each short.
    """
    spark = links.sparkSession
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage(both, "links")
    files = spark.sparkContext.defaultParallelism + both.count() // FILE_ROWS
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label"))
    labels = stage(labels.coalesce(files), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        )
        low = stage(labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low")).coalesce(files), "low")
        far = low.select(F.col("id").alias("low"), F.col("low").alias("far"))
        moved = low.join(far, "low").select("id", F.least("low", "far").alias("label"), (F.least("low", "far") < F.col("label")).alias("moved"))
        moved = stage(moved.coalesce(files), "labels")
        labels = moved.select("id", "label")
        if moved.filter("moved").isEmpty():
            return labels


def link_buckets(
    rows: DataFrame, verify: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame], DataFrame], stars: int = 2
) -> DataFrame:
    """Links that join the same groups as all links do: ``key, id`` -> ``a, b``.

    In each bucket every member is first verified against one pivot, the member that meets most
    others over all buckets: of a text and its many edited copies that is the text. Members that are then
    in one group need no further comparison; where a bucket still has members of several
    groups, the pivot (whose pairs are all done) leaves it and the next star is drawn. After
    ``stars`` stars ``rest`` names all pairs (a, b) that may still be links among the members
    of different groups that are left (id, label); those not yet compared are verified. A
    bucket of n copies of one text so costs n comparisons, and no link that would join two
    groups is passed over. A group that is known goes on as one link per member, to its label.
    """
    live = stage(_shared(rows.distinct()), "buckets")
    labels = tested = None
    for _ in range(stars):
        pivots = _pivots(live)
        pairs = live.join(pivots, "key").filter("pivot <> id").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct()
        found, tested = _compare(pairs, verify, tested)
        labels = components(found if labels is None else _known(labels).unionAll(found))
        live = live.join(pivots, "key").filter("pivot <> id").select("key", "id")
        live = stage(_mixed(live, labels), "buckets")
        if live.isEmpty():
            return _known(labels)
        members = live.select("id", "label").distinct()
        live = live.select("key", "id")
    return _known(labels).unionAll(_compare(rest(stage(members, "rest")), verify, tested)[0])


def _known(labels: DataFrame) -> DataFrame:
    """One link per member of a group, to the group's label."""
    return labels.filter("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))


def _pivots(live: DataFrame) -> DataFrame:
    """``key, pivot``: each bucket's member with the most company over all its buckets."""
    sizes = live.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    company = live.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("met"))
    return live.join(company, "id").groupBy("key").agg(F.max_by("id", F.struct("met", "id")).alias("pivot"))


def _compare(pairs: DataFrame, verify: Callable, tested: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The links among pairs not tested before, and all pairs tested so far."""
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    pairs = stage(pairs, "pairs")
    return stage(verify(pairs).select("a", "b"), "found"), (pairs if tested is None else tested.unionAll(pairs))


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of buckets with more than one member."""
    return rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "key", "left_semi")


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of buckets whose members are in more than one group, with the group's label."""
    marked = stage(
        rows.join(labels.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left")
        .select("key", "id", F.coalesce("label", "id").alias("label")), "marked",
    )
    keys = marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    return marked.join(keys, "key", "left_semi")
