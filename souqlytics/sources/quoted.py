"""S01 for large files: quoted CSV read by many tasks, headers matched by name."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from souqlytics.session import stage

# One field and what ends it. A quote opens a field only as its first character and stands for
# itself where it is doubled; elsewhere it is a character like others.
_FIELD = re.compile(r'"[^"]*+(?:""[^"]*+)*+"[^,]*+(?:,|\Z)|(?P<open>"[^"]*+(?:""[^"]*+)*+\Z)|[^,]*+(?:,|\Z)')
_REST = re.compile(r'[^"]*+(?:""[^"]*+)*+"(?!")[^,]*+(?:,|\Z)')


def open_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open behind a line, if one was (``inside``) or was not in front of it."""
    if '"' not in line:
        return inside
    at = 0
    if inside:
        m = _REST.match(line)
        if m is None:
            return True
        at = m.end()
    while at < len(line):
        m = _FIELD.match(line, at)
        if m["open"] is not None:
            return True
        at = m.end()
    return False


_BLOCK = pa.schema([("file", pa.string()), ("block", pa.int64()), ("if_out", pa.bool_()), ("if_in", pa.bool_())])


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of a file, what its last line leaves open, whichever way it began."""
    key, out, in_ = None, False, True

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, (*key, out, in_)))], _BLOCK)

    for batch in batches:
        for file, block, line in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != key:
                if key is not None:
                    yield row()
                key, out, in_ = (file, block), False, True
            if '"' in line:
                out, in_ = open_after(line, out), open_after(line, in_)
    if key is not None:
        yield row()


# Parts of records by block: a whole record, the end of one begun earlier, the start of one that
# goes on in the next block, and a block in the middle of one.
WHOLE, END, START, MIDDLE = range(4)
_PIECE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of sorted lines (file, block, seq, inside, value), block by block."""
    key, lines, first, inside, begun = None, [], 0, False, False

    def close(done: list, kind_open: bool) -> None:
        """The lines held are one piece: closed by its last line, or left open by the block."""
        kind = (MIDDLE if kind_open else END) if begun else (START if kind_open else WHOLE)
        done.append((*key, first, kind, "\n".join(lines)))

    def batch_of(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _PIECE)], schema=_PIECE)

    for batch in batches:
        done: list = []
        for file, block, seq, before, line in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != key:
                if lines:
                    close(done, True)
                key, lines, inside, begun = (file, block), [], before, before
            if not lines:
                first = seq
            lines.append(line)
            inside = open_after(line, inside)
            if not inside:
                close(done, False)
                lines, begun = [], False
        if done:
            yield batch_of(done)
    if lines:
        done = []
        close(done, True)
        yield batch_of(done)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    return spark.read.option("lineSep", "\n").text(path).select(*at, F.monotonically_increasing_id().alias("seq"), "value")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, text): every record of the CSV files at a path, with its place.

    Files are cut into blocks of lines as any text file is. A first pass finds for each block
    what quotes it leaves open, either way it may begin; a running fold over the blocks of a file
    then says how each begins. Records that lie in one block are put together where they are read;
    those that cross blocks are two small pieces (or one more per block) that meet in a group.
    """
    lines = _lines(spark, path)
    ends = lines.select("file", "block", "value").mapInArrow(_block_ends, "file string, block long, if_out boolean, if_in boolean")
    # the blocks of one file in order: a fold of two truth values
    step = F.aggregate(
        "ends", F.struct(F.lit(False).alias("now"), F.array().cast("array<struct<block:bigint,inside:boolean>>").alias("all")),
        lambda so_far, e: F.struct(
            F.when(so_far["now"], e["if_in"]).otherwise(e["if_out"]).alias("now"),
            F.array_append(so_far["all"], F.struct(e["block"].alias("block"), so_far["now"].alias("inside"))).alias("all")),
    )["all"]
    begins = stage(
        ends.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "if_out", "if_in"))).alias("ends"))
        .select("file", F.inline(step)), "block-starts",
    )
    # a small table of blocks is broadcast by Spark, a large one shuffled: the sort serves both
    placed = lines.join(begins, ["file", "block"]).select("file", "block", "seq", "inside", "value").sortWithinPartitions("file", "block", "seq")
    pieces = stage(placed.mapInArrow(_pieces, "file string, block long, seq long, kind int, text string"), "csv-pieces")
    parts = pieces.filter(F.col("kind") != WHOLE)
    # two pieces a block at the most; a record is named by its start
    upto = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, 0)
    joined = (
        parts.withColumn("record", F.count_if(F.col("kind") == START).over(upto))
        .groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "seq", "text"))).alias("p"))
        .select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["seq"].alias("seq"), F.array_join(F.col("p.text"), "\n").alias("text"))
    )
    return pieces.filter(F.col("kind") == WHOLE).select("file", "block", "seq", "text").unionByName(joined)


def _names(header: str) -> list[str]:
    """The column names in a header record."""
    out = []
    for m in _FIELD.finditer(header):
        field = m[0].removesuffix(",")
        out.append(field[1 : field.rindex('"')].replace('""', '"') if field.startswith('"') and field.count('"') > 1 else field)
        if m.end() == len(header) and not m[0].endswith(","):
            break
    return out


def read_quoted(spark: SparkSession, path: str, ordinal: str, multi_line: bool = True) -> DataFrame:
    """All CSV files at a path as text columns, quoted line breaks kept, with the place of each row.

    With ``multi_line`` off every line is a record, and the passes that look for open quotes are left out.

    The first record of each file is its header. Files may have their columns in any order, and
    some that others lack: columns are matched by name and are null where a file has none.
    Blank lines are skipped. The columns are those of the first header in text order, then what
    others add.
    """
    rows = records(spark, path) if multi_line else _lines(spark, path).withColumnRenamed("value", "text")
    rows = stage(rows.select("file", "block", "seq", F.regexp_replace("text", r"\r\z", "").alias("text")).filter("text <> ''"), "csv-records")
    first = rows.groupBy("file").agg(F.min_by(F.struct("block", "seq", "text"), F.struct("block", "seq")).alias("h"))
    heads = first.select("file", F.col("h.block").alias("h_block"), F.col("h.seq").alias("h_seq"), F.regexp_replace("h.text", "^\ufeff", "").alias("header"))
    body = rows.join(heads, "file").filter((F.col("block") != F.col("h_block")) | (F.col("seq") != F.col("h_seq")))
    out = []
    for (header,) in heads.select("header").distinct().orderBy("header").collect():  # the kinds of files there are
        names = _names(header)
        if len(set(names)) != len(names):
            raise ValueError(f"a header names a column twice: {header}")
        schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
        options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "lineSep": "\u0001"}
        parsed = body.filter(F.col("header") == header).select(
            F.struct("file", "block", "seq").alias(ordinal), F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), options).alias("v"))
        out.append(parsed.select(*[F.col(f"v.c{i}").alias(n) for i, n in enumerate(names)], ordinal))
    if not out:
        return rows.select(F.struct("file", "block", "seq").alias(ordinal))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)
    return whole.select(*[c for c in whole.columns if c != ordinal], ordinal)
