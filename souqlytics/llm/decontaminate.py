"""Benchmark decontamination: size-partitioned MinHash containment search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from souqlytics.llm.tokens import Words, buffers, grams, last_column, slices, with_text

SHINGLE = 5
THRESHOLD = 0.8
# Shingles of test items that one pass holds in each task (16 bytes each, and an index).
PASS_SHINGLES = 1_000_000

# Word characters after lower-casing: all but ASCII white space, punctuation and controls.
_SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class Sketches:
    """Sketches of one block of test items, partitioned by size.

    Items fall into partitions of doubling shingle count. A partition's sketch keeps the
    smallest ``s`` hashes of each item, ``s`` set by the partition's largest size ``u`` and
    the threshold ``t``: ``s = u - ceil(t * u) + 1``. A text with at least ``t`` of an item's
    shingles misses at most ``u - ceil(t * u)`` of them, so it holds one of the sketch:
    the search loses nothing, and the sketch is ``1 - t`` of the item.
    """

    def __init__(self, items: list[tuple[object, np.ndarray, int]], threshold: float):
        self.ids = [i for i, _, _ in items]
        self.sets = [s for _, s, _ in items]
        self.lengths = sorted({k for _, _, k in items})
        self.kinds = [k for _, _, k in items]
        values, owners = [], []
        for n, s in enumerate(self.sets):
            upper = 1 << (len(s) - 1).bit_length()
            keep = min(len(s), upper - int(np.ceil(round(threshold * upper, 9))) + 1)
            values.append(s[:keep])  # sets are sorted: the smallest hashes
            owners.append(np.full(keep, n))
        value = np.concatenate(values) if values else np.zeros(0, np.uint64)
        order = np.argsort(value, kind="stable")
        self.value, self.owner = value[order], np.concatenate(owners)[order] if owners else np.zeros(0, int)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.value >> np.uint64(44)).astype(np.int64)] = True

    def candidates(self, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distinct (row, item) pairs where a shingle of the row is in the item's sketch."""
        hit = np.flatnonzero(self.bits[(hashes >> np.uint64(44)).astype(np.int64)])
        low = np.searchsorted(self.value, hashes[hit], "left")
        high = np.searchsorted(self.value, hashes[hit], "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if n.sum() else np.zeros(0, int)
        pairs = np.stack([np.repeat(rows[hit], n), self.owner[at]], 1) if len(at) else np.zeros((0, 2), int)
        return np.unique(pairs, axis=0)


def _sets(column: pa.Array) -> list[tuple[np.ndarray, int]]:
    """For each text its sorted distinct shingles and their length (shorter for short texts)."""
    words = Words(*buffers(column), space=_SEPARATOR)
    out = []
    for a, b in zip(words.bounds, words.bounds[1:]):
        k = min(SHINGLE, int(b - a))
        out.append((np.unique(grams(words.hash[a:b], k)) if k else np.zeros(0, np.uint64), k))
    return out


def _matches(batch: pa.RecordBatch, sketches: Sketches, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(row of the batch, item, shared shingles) of every containment over the threshold."""
    done = 0
    for part in slices(batch, "_text"):
        words = Words(*buffers(part.column(part.schema.get_field_index("_text"))), space=_SEPARATOR)
        rows = words.rows()
        found: dict[int, set[int]] = {}
        for k in sketches.lengths:
            g = grams(words.hash, k)
            if len(g) == 0:
                continue
            inside = rows[: len(g)] == rows[k - 1 :]
            for row, item in sketches.candidates(g[inside], rows[: len(g)][inside]).tolist():
                found.setdefault(row, set()).add(item)
        for row, items in found.items():
            own = words.hash[words.bounds[row] : words.bounds[row + 1]]
            sets = {k: np.unique(grams(own, k)) for k in sketches.lengths}
            for item in sorted(items):
                wanted = sketches.sets[item]
                shared = int(np.isin(wanted, sets[sketches.kinds[item]], assume_unique=True).sum())
                if shared >= threshold * len(wanted) - 1e-9:
                    yield done + row, item, shared
        done += len(part)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, threshold: float) -> Iterator[Sketches]:
    """The test items in blocks of at most PASS_SHINGLES shingles (a longer item stands alone)."""
    items, held = [], 0
    wanted = benchmark.select(F.col(item_col).alias("i"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).orderBy("i", "t")
    for row in wanted.toLocalIterator():
        (s, k), = _sets(pa.array([row.t]))
        if k == 0:
            continue
        if items and held + len(s) > PASS_SHINGLES:
            yield Sketches(items, threshold)
            items, held = [], 0
        items.append((row.i, s, k))
        held += len(s)
    if items:
        yield Sketches(items, threshold)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """Pairs ``doc_id, item_id, shared, shingles, containment`` of documents that hold a test item.

    A document holds an item when at least ``threshold`` of the item's distinct five-word
    shingles (words lower-cased, without ASCII punctuation) are in the whole document. Test
    items are the query set: they are read in blocks of bounded size, each block is matched
    against every document in one pass without a shuffle, and passes follow the benchmark's
    size only. Candidates come from the sketches, then the count is exact.

    An item of 1 to 4 words is one shingle of that length. Items and documents without words
    (null, empty, punctuation) match nothing. Repeated rows of either table give repeated
    pairs. Null ids are returned as null. Other columns are ignored; an empty table gives no rows.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"doc_id {kind}, item_id {item_kind}, shared long, shingles long, containment double"
    texts = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    out = None
    for sketches in _blocks(benchmark, item_col, item_text_col, threshold):
        held = docs.sparkSession.sparkContext.broadcast(sketches)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = held.value
            for batch in batches:
                found = list(_matches(batch, known, threshold))
                sizes = [len(known.sets[i]) for _, i, _ in found]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([r for r, _, _ in found], pa.int64())),
                    pa.array([known.ids[i] for _, i, _ in found], item_type),
                    pa.array([n for _, _, n in found], pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array([n / s for (_, _, n), s in zip(found, sizes)], pa.float64()),
                ], ["doc_id", "item_id", "shared", "shingles", "containment"])

        one = texts.mapInArrow(search, schema)
        out = one if out is None else out.unionAll(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """The documents that hold no test item, with all their columns, in the same single pass."""
    out = docs
    names = docs.columns
    for sketches in _blocks(benchmark, item_col, item_text_col, threshold):
        held = docs.sparkSession.sparkContext.broadcast(sketches)

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[[r for r, _, _ in _matches(last_column(batch), held.value, threshold)]] = False
                yield batch.select(range(len(names))).filter(pa.array(keep))

        out = with_text(out, F.lower(F.coalesce(F.col(text_col), F.lit("")))).mapInArrow(clean, docs.schema)
    return out
