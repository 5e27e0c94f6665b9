"""Vector tables, and exact nearest vectors by cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souqlytics.functions.vectors import cosine, is_valid, unit
from souqlytics.session import stage

# Centres are fitted on so many vectors each, and there are at most so many: both bound what
# the driver and every task hold of the index.
SAMPLE_PER_CELL = 32
MOST_CELLS = 1024
FIT_ROUNDS = 8
# Vectors of a cell and queries of a cell that one task scores against each other.
BLOCK_ROWS = 2048
# Queries that are held against the centres at a time, and (query, cell) pairs given on at a time.
QUERY_ROWS = 512
PAIR_ROWS = 8192
# Cosines, and angles (an angle near 0 is known to 2e-8), closer than this count as equal where
# vectors are skipped.
SLACK, ANGLE_SLACK = 1e-9, 1e-7


def normalised(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """X02."""
    return df.withColumn(vector, unit(F.col(vector)))


def pair_similarity(pairs: DataFrame, a: str, b: str, out: str = "cosine") -> DataFrame:
    """Cosine of two vector columns, row by row."""
    return pairs.withColumn(out, cosine(F.col(a), F.col(b)))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype("float64", copy=False)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of spherical k-means, started from evenly spaced rows of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(FIT_ROUNDS):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1.0), centres)
    return centres


class CellIndex:
    """Vectors by the cell of their nearest centre.

    ``vectors`` is (cell, block, id, vector): unit vectors, written to the shared folder; blocks
    cut a cell into pieces of about ``BLOCK_ROWS``. ``centres``, ``radius`` (the widest angle to
    the centre) and ``count`` have one row per cell, at most ``MOST_CELLS``. ``zero`` has the ids
    of zero vectors, whose cosine is 0 with everything.
    """

    def __init__(self, vectors: DataFrame, zero: DataFrame, centres: np.ndarray, radius: np.ndarray, count: np.ndarray):
        self.vectors, self.zero = vectors, zero
        self.centres, self.radius, self.count = centres, radius, count


def _usable(rows: DataFrame, dimension: int) -> DataFrame:
    """Unit vectors of rows with an id and a whole, finite vector of the right length."""
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    return good.filter(F.col("id").isNotNull() & is_valid(F.col("vector"), dimension)).filter(finite)


def vector_length(rows: DataFrame) -> int:
    """The most frequent length of a vector; of two the longer one."""
    top = (
        rows.filter(F.col("vector").isNotNull()).groupBy(F.size("vector").alias("size")).count()
        .orderBy(F.desc("count"), F.desc("size")).first()
    )
    return top["size"] if top else 0


def build_cells(corpus: DataFrame, dimension: int | None = None, cells: int | None = None) -> CellIndex:
    """Index of (id, vector): every usable vector is in it.

    There are about as many cells as the square root of the vectors, up to ``MOST_CELLS``. Centres
    are fitted on the ``SAMPLE_PER_CELL`` x cells vectors whose ids hash lowest; that choice
    decides how much a search reads, never what it finds. Rows with a null id, a null or short
    vector, or null, NaN or infinite elements are left out.
    """
    dimension = dimension or vector_length(corpus)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    good = _usable(corpus, dimension).withColumn("length", length)
    zero = good.filter(F.col("length") == 0).select("id")
    units = good.filter(F.col("length") > 0).select(
        "id", F.transform("vector", lambda x: x / F.col("length")).alias("vector"))
    cells = cells or max(1, min(MOST_CELLS, math.isqrt(corpus.count())))
    # bounded: SAMPLE_PER_CELL * MOST_CELLS vectors at the most
    sample = units.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_CELL * min(cells, MOST_CELLS)).toPandas()
    centres = _fit(_matrix(sample["vector"]), cells) if len(sample) else np.zeros((0, dimension))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), QUERY_ROWS):
                batch = whole.iloc[at:at + QUERY_ROWS]
                angle = _angles(_matrix(batch["vector"]), centres)
                cell = np.argmin(angle, axis=1)
                yield batch.assign(cell=cell.astype("int32"), angle=angle[np.arange(len(batch)), cell])

    placed = stage(units.mapInPandas(assign, "id bigint, vector array<double>, cell int, angle double"), "cells")
    radius, count = np.zeros(len(centres)), np.zeros(len(centres), "int64")
    for cell, widest, n in placed.groupBy("cell").agg(F.max("angle"), F.count(F.lit(1))).collect():  # a row per cell
        radius[cell], count[cell] = widest, n
    return CellIndex(placed.select("cell", "id", "vector"), zero, centres, radius, count)


def _score(k: int):
    def run(key: tuple, queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or found.empty:
            return pd.DataFrame({"query_id": [], "id": [], "cosine": []}).astype({"query_id": "int64", "id": "int64"})
        q, v, ids = _matrix(queries["query"]), _matrix(found["vector"]), found["id"].to_numpy()
        rough = q @ v.T
        few = min(k, len(ids))
        least = np.partition(rough, len(ids) - few, axis=1)[:, len(ids) - few] - SLACK
        out = []
        for i, name in enumerate(queries["query_id"].to_numpy()):
            near = np.flatnonzero(rough[i] >= least[i])
            # element by element, so that equal vectors have equal cosines in every task
            exact = (v[near] * q[i]).sum(axis=1)
            best = np.lexsort((ids[near], -exact))[:k]
            out.append(pd.DataFrame({"query_id": name, "id": ids[near][best], "cosine": exact[best]}))
        return pd.concat(out, ignore_index=True)

    return run


def _scored(index: CellIndex, pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each (query_id, cell, query) within every block of the cell."""
    blocks = [max(1, -(-int(n) // BLOCK_ROWS)) for n in index.count]
    # one row per cell: pieces of its vectors and of its queries
    sizes = pairs.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("query_blocks"))
    pieces = F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("cell") + 1)
    sizes = F.broadcast(sizes.withColumn("blocks", pieces))
    left = (
        pairs.join(sizes, "cell").withColumn("query_block", F.pmod(F.xxhash64("query_id"), "query_blocks").cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "block", "query_block", "query_id", "query")
    )
    right = (
        index.vectors.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
        .select("cell", "block", "query_block", "id", "vector")
    )
    keys = ["cell", "block", "query_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_score(k), "query_id bigint, id bigint, cosine double")


def _best(found: DataFrame, k: int) -> DataFrame:
    # k rows per query and block are left
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cells_to_read(index: CellIndex, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Which cells each query (query_id, query) reads: the nearest ones, then those that may still matter.

    The nearest cells that together hold k vectors come first; their k-th best angle, once
    known, is the bound: a cell all of whose vectors are farther (angle to the centre less the
    radius) is skipped. Between the two (query_id, cell, query) stands what the nearest cells give.
    """
    centres, radius, count = index.centres, index.radius, index.count
    schema = "query_id bigint, cell int, query array<double>"

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), QUERY_ROWS):
                yield batch.iloc[at:at + QUERY_ROWS]

    def pairs(batch: pd.DataFrame, wanted: np.ndarray) -> Iterator[pd.DataFrame]:
        """A query that reads many cells stands in as many rows, so they leave in small pieces."""
        rows, cells = np.nonzero(wanted)
        ids, vectors = batch["query_id"].to_numpy(), batch["query"].to_numpy()
        for at in range(0, len(rows), PAIR_ROWS):
            row, cell = rows[at:at + PAIR_ROWS], cells[at:at + PAIR_ROWS]
            yield pd.DataFrame({"query_id": ids[row], "cell": cell.astype("int32"), "query": vectors[row]})

    def nearest(angle: np.ndarray) -> np.ndarray:
        order = np.argsort(angle, axis=1, kind="stable")
        before = np.cumsum(count[order], axis=1) - count[order]
        wanted = np.zeros(angle.shape, bool)
        np.put_along_axis(wanted, order, before < k, axis=1)
        return wanted & (count > 0)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            yield from pairs(batch, nearest(_angles(_matrix(batch["query"]), centres)))

    def then(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            angle = _angles(_matrix(batch["query"]), centres)
            bound = np.arccos(np.clip(batch["kth"].to_numpy() - SLACK, -1.0, 1.0))
            may = angle - radius <= bound[:, None] + ANGLE_SLACK
            yield from pairs(batch, may & ~nearest(angle) & (count > 0))

    near = stage(queries.mapInPandas(first, schema), "near-cells")
    found = stage(_scored(index, near, k), "near-vectors")
    kth = _best(found, k).filter(F.col("rank") == k).select("query_id", F.col("cosine").alias("kth"))
    bounded = queries.join(kth, "query_id", "left").fillna(-1.0, ["kth"])
    rest = stage(bounded.mapInPandas(then, schema), "more-cells")
    return near, found, rest


def search_cells(index: CellIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """X05 on an index: (query_id, id, cosine, rank), the k nearest vectors of each query (id, vector).

    Exact: a cell is skipped only if its radius proves that nothing in it is among the k
    nearest. Equal cosines rank by id. A zero vector, on either side, has cosine 0. Queries are
    rows of a table and meet the vectors of a cell in a join, block by block: neither passes
    the driver. Queries are held to the same rules as vectors; repeated query ids count once.
    """
    dimension = index.centres.shape[1]
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    wanted = _usable(queries, dimension).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("length", length)
    live = stage(
        wanted.filter(F.col("length") > 0).select(F.col("id").alias("query_id"), F.transform("vector", lambda x: x / F.col("length")).alias("query")),
        "queries",
    )
    _, found, rest = cells_to_read(index, live, k)

    def zero_cosines(ids: DataFrame, asked: DataFrame) -> DataFrame:
        lowest = [r.id for r in ids.orderBy("id").limit(k).collect()]  # k ids
        each = F.explode(F.array(*[F.lit(i) for i in lowest]).cast("array<bigint>")).alias("id")
        return asked.select("query_id", each, F.lit(0.0).alias("cosine"))

    flat = wanted.filter(F.col("length") == 0).select(F.col("id").alias("query_id"))
    out = found.unionByName(_scored(index, rest, k)).unionByName(zero_cosines(index.zero, live))
    return _best(out.unionByName(zero_cosines(index.vectors.select("id").unionAll(index.zero), flat)), k)


def share_read(index: CellIndex, queries: DataFrame, k: int = 10) -> float:
    """The share of all (query, vector) pairs that a search for whole, non-zero queries scores."""
    live = stage(queries.select(F.col("id").alias("query_id"), unit(F.col("vector")).alias("query")), "queries")
    near, _, rest = cells_to_read(index, live, k)
    size = F.element_at(F.array(*[F.lit(int(n)) for n in index.count]), F.col("cell") + 1)
    scored = near.unionAll(rest).agg(F.sum(size)).first()[0] or 0
    return scored / max(1, live.count() * int(index.count.sum()))


def top_k_cosine(corpus: DataFrame, queries: DataFrame, k: int = 10, dimension: int | None = None, cells: int | None = None) -> DataFrame:
    """The k nearest corpus rows per query, exact; both tables are (id, vector)."""
    return search_cells(build_cells(corpus, dimension, cells), queries, k)
