"""Dense numbers, running totals and medians over a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souqlytics.session import pin, stage

_SEQ = "_seq"
_PART = "_part"


def _laid_out(df: DataFrame, order: list[Column], unique: bool) -> DataFrame:
    """Range-sorted rows pinned to files, with partition number and position.

    Rows that are equal in the sort keys would all land in one task. Unless the keys
    are unique, a row number pinned beforehand is added as the last key: it spreads
    copies, and it stays the same when a lost task is run again.
    """
    if not unique:
        df = pin(df.withColumn("_tie", F.monotonically_increasing_id()))
        order = [*order, F.col("_tie")]
    ordered = df.orderBy(*order).drop("_tie")
    # The generated id holds the partition number in its upper bits and the
    # position inside the partition in the lower 33.
    seq = F.monotonically_increasing_id()
    return (
        pin(ordered)
        .withColumn(_SEQ, seq)
        .withColumn(_PART, F.shiftright(_SEQ, 33))
        .withColumn(_SEQ, F.col(_SEQ).bitwiseAND(F.lit((1 << 33) - 1)))
    )


def _offsets(laid: DataFrame, amount: Column) -> DataFrame:
    """Total amount in front of each partition: one row per partition."""
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return (
        laid.groupBy(_PART)
        .agg(amount.alias("_n"))
        .select(_PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )


def number_rows(
    df: DataFrame, order: list[Column], out: str = "row_no", unique: bool = True
) -> DataFrame:
    """Numbers 1..n in the given order, gap-free; say so if the order has ties."""
    laid = _laid_out(df, order, unique)
    # One row per sorted partition, so the broadcast is bounded by the partition count.
    offsets = F.broadcast(_offsets(laid, F.count(F.lit(1))))
    return (
        laid.join(offsets, _PART)
        .withColumn(out, F.col("_before") + F.col(_SEQ) + 1)
        .drop(_PART, _SEQ, "_before")
    )


# Buckets that generated keys are counted by: the first hex digits of the natural key's MD5.
BUCKET_DIGITS = 3


def key_hash(df: DataFrame, keys: list[str]) -> Column:
    """MD5 (hex) of a natural key; nulls count, times are taken as microseconds."""
    kinds = dict(df.dtypes)
    texts = [F.unix_micros(k) if kinds[k] == "timestamp" else F.col(k) for k in keys]
    return F.md5(F.concat_ws("|", *[F.coalesce(t.cast("string"), F.lit("\\N")) for t in texts]))


def number_by_bucket(df: DataFrame, keys: list[str], out: str = "row_no") -> DataFrame:
    """Numbers 1..n without a gap for rows with unique keys, the same on every run.

    Rows are written once with the bucket their key hashes to; one pass counts the buckets,
    whose running sum says where each starts, and one numbers the rows inside each bucket in
    key order. No sampling and no sort over all rows; 4,096 buckets share them evenly, as
    keys are unique.
    """
    kept = stage(df.withColumn(_PART, F.substring(key_hash(df, keys), 1, BUCKET_DIGITS)), "numbered")
    # One row per bucket, whatever the table.
    starts = F.broadcast(_offsets(kept, F.count(F.lit(1))))
    inside = Window.partitionBy(_PART).orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    return (
        kept.withColumn(_SEQ, F.row_number().over(inside)).join(starts, _PART)
        .withColumn(out, F.col("_before") + F.col(_SEQ)).drop(_PART, _SEQ, "_before")
    )


def running_total(df: DataFrame, order: list[Column], amount: str, out: str) -> DataFrame:
    """Inclusive running sum of ``amount`` in the given order, which has no ties."""
    laid = _laid_out(df, order, unique=True)
    offsets = F.broadcast(_offsets(laid, F.sum(amount)))
    upto = Window.partitionBy(_PART).orderBy(_SEQ).rowsBetween(Window.unboundedPreceding, 0)
    return (
        laid.withColumn("_sum", F.sum(amount).over(upto))
        .join(offsets, _PART)
        .withColumn(out, F.col("_before") + F.col("_sum"))
        .drop(_PART, _SEQ, "_before", "_sum")
    )


def exact_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, median) per column, interpolating between the two middle values.

    Equal values are counted first, so what gets sorted is one row per distinct
    value and every column is handled in the same pass.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns]
    )
    counts = (
        df.select(F.explode(pairs).alias("p"))
        .select("p.name", "p.v")
        .filter(F.col("v").isNotNull())
        .groupBy("name", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running_total(counts, [F.col("name"), F.col("v")], "n", "last").withColumn(
        "first", F.col("last") - F.col("n") + 1
    )
    spans = ranked.groupBy("name").agg(F.min("first").alias("lo"), F.max("last").alias("hi"))
    middle = F.col("lo") + F.col("hi")
    left, right = F.floor(middle / 2), F.ceil(middle / 2)

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("v")))

    return (
        # One row per column name.
        ranked.join(F.broadcast(spans), "name")
        .groupBy("name")
        .agg(((value_at(left) + value_at(right)) / 2).alias("median"))
    )


# Bits of a sort key that one pass of a selection tells apart.
DIGIT = 16


def lowest(df: DataFrame, group: Column, keys: list[str], quotas: dict[object, int]) -> Column:
    """A condition that holds for the ``quotas[g]`` rows of each group g with the lowest keys.

    ``keys`` are long columns of ``df`` (a table on disk: it is scanned some times) that together
    tell all rows apart. Nothing is sorted: a histogram of the upper 16 bits of a key tells
    where the last row wanted is, one of all values in that bin tells its key, and rows
    that share this key are told apart by the next one. Groups are few, as their quotas
    are a dict.
    """
    rank = F.lit(False)
    live = {g: n for g, n in quotas.items() if n > 0}
    tied = F.lit(True)
    for key in keys:
        if not live:
            break
        lead = F.shiftright(key, 64 - DIGIT)
        bins = _reached(df.filter(_in(group, live) & tied), group, lead, live)
        in_bin = tied & F.coalesce(_of(group, {g: b for g, (b, _) in bins.items()}) == lead, F.lit(False))
        left = {g: live[g] - before for g, (_, before) in bins.items()}
        last = _reached(df.filter(_in(group, left) & in_bin), group, F.col(key), left)
        bound = _of(group, {g: k for g, (k, _) in last.items()})
        rank = rank | (tied & F.coalesce(F.col(key) < bound, F.lit(False)))
        live = {g: left[g] - before for g, (_, before) in last.items()}
        tied = tied & F.coalesce(F.col(key) == bound, F.lit(False))
    return rank | tied if live else rank


def _in(group: Column, quotas: dict) -> Column:
    return F.coalesce(_of(group, {g: 1 for g in quotas}) == 1, F.lit(False))


def _of(group: Column, values: dict) -> Column:
    """The value of each row's group, null where it has none."""
    out = F.lit(None).cast("long")
    for g, v in values.items():
        out = F.when(group.eqNullSafe(F.lit(g)), F.lit(v).cast("long")).otherwise(out)
    return out


def _reached(df: DataFrame, group: Column, value: Column, quotas: dict) -> dict[object, tuple[int, int]]:
    """Per group the value at which the quota is reached, and how many rows lie below it."""
    counts = df.groupBy(group.alias("g"), value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    # at most 65,536 bins a group, or the values of one bin
    upto = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("n").over(upto))
    hit = placed.filter((F.col("upto") >= _of(F.col("g"), quotas)) & (F.col("upto") - F.col("n") < _of(F.col("g"), quotas)))
    return {r.g: (r.v, r.upto - r.n) for r in hit.collect()}  # a row per group
