"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souqlytics.session import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
# Relative demand of a source at the start, the middle and the end of training, by the place
# of its weight in WEIGHTS: heavy sources fade, light ones come late.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
ROWS_PER_BIN = 20_000


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size`` -> also ``target`` and ``place`` (of its weight).

    All targets together are ``share`` of all sizes. A target is its weight times a common
    rate, or ``most`` times its source's size where that is less; the rate is the one that
    reached when the excess is dealt again by weight until no source is above. One row per
    source goes through the windows here.
    """
    k = len(weights)
    by_name, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") + 1).cast("int"))
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("place", (F.row_number().over(by_name) - 1) % k)
        .withColumn("w", weight)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("rest", F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(full), F.lit(0.0)))
        .withColumn("rest_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(full), F.lit(0.0)))
        # the rate if the sources in front of this one are full and no other is
        .withColumn("rate", F.when(F.col("rest") <= F.col("cap") / F.col("w") * F.col("rest_w"), F.col("rest") / F.col("rest_w")))
    )
    rate = F.max("rate").over(every)
    return ranked.select(
        "source", "source_size", F.coalesce(F.least("cap", F.col("w") * rate), F.col("cap")).alias("target"), "place"
    )


def position(u: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """When a share ``u`` (0 to 1) of a source's demand is reached: the inverse integral.

    The schedule is linear between its knots (time, relative weight), so its integral is
    quadratic between them and is inverted in closed form.
    """
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])]
    total = sum(areas)
    if total <= 0 or any(w < 0 for _, w in schedule):
        raise ValueError("a schedule needs weights of 0 or more with a positive integral")
    out, done = F.lit(schedule[-1][0]), sum(areas)
    for ((t0, w0), (t1, w1)), area in reversed(list(zip(zip(schedule, schedule[1:]), areas))):
        done -= area
        left = F.greatest(u * F.lit(total) - F.lit(done), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        # smallest dt with w0*dt + slope*dt^2/2 = left, written so that slope 0 is no special case
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * left, F.lit(0.0)))
        dt = F.when(left <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * left / (F.lit(w0) + root))
        out = F.when(u * F.lit(total) < F.lit(done + area), F.lit(t0) + dt).otherwise(out)
    return F.least(out, F.lit(schedule[-1][0]))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    share: float = 1.5, most: float = 2.0, seed: int = 8,
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, positions, source``.

    Each source lays its documents one after another along its own axis of tokens, in an
    order fixed by ``seed`` and the id, again from the start on a second pass, up to its
    target. ``taken`` is the number of words inside the target; at its end a document may be
    taken in part (its first words), so the words taken are the target rounded down.
    ``positions`` has a training position from 0 to 1 for each pass: where the running
    integral of the source's schedule reaches the document's place on the axis.

    Running totals are built from bins of about 20,000 rows (by hash of the id), so a source
    with a third of all rows is spread like any other. Null text is size 0; a null source is
    a source, the last; rows with a null id take part. Rows that repeat an id are rows of
    their own, laid side by side; equal ones are interchangeable, so reruns agree. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
        ),
        "sizes",
    )
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    bins = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(ROWS_PER_BIN)))
    plan = stage(
        targets(by_source.drop("n"), weights, share, most)
        .join(by_source.select(F.col("source").alias("s"), bins.alias("bins")), F.col("source").eqNullSafe(F.col("s"))).drop("s"),
        "targets",
    )
    # upper hash bits pick the bin, so bins follow one another in hash order
    place = F.floor((F.shiftrightunsigned("h", 33) * F.col("bins")) / F.lit(float(1 << 31)))
    placed = rows.join(
        plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s").withColumn("bin", place)
    before = Window.partitionBy("b_source").orderBy("b_bin").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        placed.groupBy(F.col("source").alias("b_source"), F.col("bin").alias("b_bin")).agg(F.sum("size").alias("n"))
        .select("b_source", "b_bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    within = (
        Window.partitionBy("source", "bin").orderBy(F.shiftrightunsigned("h", 33), "h", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    laid = (
        placed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(bases, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bin") == F.col("b_bin")))
        .withColumn("x", F.col("base") + F.col("inner"))
    )
    words = F.floor("target")
    passes = F.transform(
        F.sequence(F.lit(0), F.lit(max(0, -int(-most // 1) - 1))),
        lambda p: F.greatest(F.lit(0), F.least(F.col("size"), words - p * F.col("source_size") - F.col("x"))),
    )
    u = lambda p: (p * F.col("source_size") + F.col("x")) / F.col("target")
    at = lambda p: F.element_at(
        F.array(*[position(u(p), s) for s in schedules]), (F.col("place") % len(schedules) + 1).cast("int")
    )
    return laid.withColumn("parts", passes).select(
        "doc_id", "source", "size", "source_size", "target",
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, b: a + b).alias("taken"),
        F.transform(
            F.filter(F.transform("parts", lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda v: v.n > 0),
            lambda v: F.struct(at(v.i).alias("position"), v.n.alias("words")),
        ).alias("passes"),
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per document and pass, range-sorted by training position."""
    return (
        mixed.select("doc_id", "source", F.explode("passes").alias("p"))
        .select("doc_id", "source", "p.position", "p.words")
        .orderBy("position", "source", "doc_id", "words")
    )
