"""W03, W04 on stored tables: Parquet dealt into key buckets, one folder per load."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souqlytics.operators.ranking import key_hash, number_by_bucket
from souqlytics.session import stage
from souqlytics.sources.folder import Folder

BUCKETS = 256
_BUCKET, _LOAD = "_bucket", "_load"


class StoredTable:
    """A table with a unique key, kept as a folder of loads.

    ``load-<n>`` has the rows of one load, ``gone-<n>`` the keys whose earlier rows it replaces,
    both in a sub-folder per key bucket; ``base-<n>`` has all rows up to a load in one piece.
    A load counts once Spark has marked its folder as complete, which is the last thing
    written: a broken load leaves a folder that nobody reads, and may be repeated. A load
    reads only the buckets its keys fall in, and rewrites nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.empty = spark.createDataFrame([], schema)
        self.columns = self.empty.columns
        self.folder = Folder(spark, self.path)

    # ---- reading

    def _numbers(self, kind: str) -> list[int]:
        """Complete folders of a kind, in order."""
        named = [n for n in self.folder.names("") if n.startswith(f"{kind}-")]
        return sorted(int(n.split("-")[1]) for n in named if self.folder.exists(f"{n}/_SUCCESS"))

    def _parts(self, kind: str, numbers: list[int], columns: list[str]) -> DataFrame | None:
        schema = self.empty.select(*columns).withColumn(_BUCKET, F.lit(0)).schema
        parts = [
            self.spark.read.schema(schema).parquet(f"{self.path}/{kind}-{n:06d}").withColumn(_LOAD, F.lit(n)) for n in numbers
        ]
        return reduce(DataFrame.unionAll, parts) if parts else None

    def _rows(self, columns: list[str], touched: list[int] | None = None) -> DataFrame:
        """Current rows with their bucket; with ``touched``, of these buckets only."""
        base = self._numbers("base")[-1:]
        loads = [n for n in self._numbers("load") if not base or n > base[0]]
        held = [p for p in (self._parts("base", base, columns), self._parts("load", loads, columns)) if p is not None]
        if not held:
            return self.empty.select(*columns).withColumn(_BUCKET, F.lit(0))
        rows = reduce(DataFrame.unionAll, held)
        if touched is not None:
            rows = rows.filter(F.col(_BUCKET).isin(touched))
        gone = self._parts("gone", [n for n in self._numbers("gone") if n in loads], self.keys)
        if gone is not None:
            if touched is not None:
                gone = gone.filter(F.col(_BUCKET).isin(touched))
            gone = gone.select(F.col(_BUCKET).alias("_b"), F.col(_LOAD).alias("_since"), *[F.col(k).alias(f"_k_{k}") for k in self.keys])
            replaced = (F.col(_BUCKET) == F.col("_b")) & (F.col(_LOAD) < F.col("_since"))
            rows = rows.join(gone, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys], replaced), "left_anti")
        return rows.select(*columns, _BUCKET)

    def read(self) -> DataFrame:
        """The table as it is."""
        return self._rows(self.columns).select(*self.columns)

    # ---- loading

    def _dealt(self, rows: DataFrame) -> DataFrame:
        number = F.conv(F.substring(key_hash(rows, self.keys), 1, 8), 16, 10).cast("bigint")
        return rows.withColumn(_BUCKET, F.pmod(number, F.lit(self.buckets)).cast("int"))

    def _next(self) -> int:
        """A number no folder has, complete or not."""
        used = [int(n.split("-")[1]) for n in self.folder.names("") if n.split("-")[0] in ("load", "gone", "base")]
        return max(used, default=0) + 1

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        rows.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{kind}-{number:06d}")

    def _same(self, left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in [*columns, _BUCKET]])

    def _incoming(self, rows: DataFrame) -> tuple[DataFrame, list[int]]:
        """One row per key, with its bucket, written aside; and the buckets that occur.

        Of several rows with one key the smallest in column order is taken.
        """
        rest = [c for c in rows.columns if c not in self.keys]
        one = rows.groupBy(*self.keys).agg(*([F.min(F.struct(*rest)).alias("_row")] if rest else [F.count(F.lit(1)).alias("_n")]))
        one = one.select(*self.keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*rows.columns)
        dealt = stage(self._dealt(one), "incoming")
        return dealt, sorted(r[0] for r in dealt.select(_BUCKET).distinct().collect())  # at most a number per bucket

    def insert_ignore(self, rows: DataFrame) -> None:
        """Rows whose key is there already are left out; the others are one more load."""
        new, touched = self._incoming(rows.select(*self.columns))
        known = self._rows(self.keys, touched)
        self._write(new.join(known, self._same(new, known, self.keys), "left_anti"), "load", self._next())

    def upsert(self, rows: DataFrame) -> None:
        """A row replaces the one with its key. Rows that are there as they are are not written."""
        new, touched = self._incoming(rows.select(*self.columns))
        known = self._rows(self.columns, touched)
        changed = stage(new.join(known, self._same(new, known, self.columns), "left_anti"), "changed")
        number = self._next()
        old = known.select(*self.keys, _BUCKET)
        self._write(changed.join(old, self._same(changed, old, self.keys), "left_semi").select(*self.keys, _BUCKET), "gone", number)
        self._write(changed, "load", number)

    def add_keys(self, rows: DataFrame, id_column: str) -> None:
        """New natural keys get the numbers after the high-water mark; ``rows`` come without the id.

        The mark of a load is written before the load is complete and counts once it is.
        """
        natural = [c for c in self.columns if c != id_column]
        new, touched = self._incoming(rows.select(*natural))
        known = self._rows(self.keys, touched)
        fresh = new.join(known, self._same(new, known, self.keys), "left_anti")
        top = self.mark()
        numbered = stage(number_by_bucket(fresh, self.keys, "_no").withColumn(id_column, F.col("_no") + F.lit(top)), "numbered-load")
        kind = self.empty.schema[id_column].dataType
        number = self._next()
        highest = numbered.agg(F.max(id_column)).first()[0] or top
        self.folder.write(f"mark-{number:06d}", str(highest))
        self._write(numbered.withColumn(id_column, F.col(id_column).cast(kind)).select(*self.columns, _BUCKET), "load", number)

    def mark(self) -> int:
        """The highest number given to a key so far."""
        marks = [n for n in self._numbers("load") + self._numbers("base") if self.folder.exists(f"mark-{n:06d}")]
        return int(self.folder.read(f"mark-{max(marks):06d}")) if marks else 0

    def compact(self) -> None:
        """All current rows as one base; loads before it are no longer read."""
        top, number = self.mark(), self._next()
        self.folder.write(f"mark-{number:06d}", str(top))
        self._write(self._rows(self.columns), "base", number)
