"""Cell search against all pairs, and what it skips."""

import numpy as np
import pytest

from souqlytics.operators import neighbours

SCHEMA = "id long, vector array<double>"


def plain(corpus, queries, k, dimension):
    def usable(rows):
        return [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == dimension and None not in v and np.isfinite(np.array(v, float)).all()]

    def unit(v):
        n = np.sqrt((v * v).sum())
        return v / n if n else v

    out = set()
    for q, a in usable(queries):
        scored = sorted((-round(float((unit(a) * unit(b)).sum()), 9), i) for i, b in usable(corpus))
        out |= {(q, i, -c, rank) for rank, (c, i) in enumerate(scored[:k], 1)}
    return {(q, i, round(c, 6), r) for q, i, c, r in out}


def found(df):
    return {(r.query_id, r.id, round(r.cosine, 6), r["rank"]) for r in df.collect()}


def clustered(n, dimension, groups, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dimension))
    return centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dimension))


@pytest.mark.parametrize("k", [1, 7, 400])
def test_cells_find_what_all_pairs_find(spark, k):
    vectors = clustered(300, 6, 9, 0.05, 1)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[5].tolist()) for i in range(120)]  # one vector in a third of all rows
    odd = [(None, vectors[0].tolist()), (2001, [1.0]), (2002, None), (2003, [0.0] * 6), (2004, [0.0] * 6), (2005, [float("nan")] * 6),
           (2006, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2007, [float("inf")] * 6)]
    queries = [(i, (vectors[i] + 0.01).tolist()) for i in range(0, 300, 11)] + odd
    corpus = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    got = found(neighbours.search_cells(neighbours.build_cells(corpus, cells=12), spark.createDataFrame(queries, SCHEMA), k))
    assert got == plain(rows + odd, queries, k, 6)


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(500, 4, 5, 0.3, 2))]
    corpus = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    assert found(neighbours.top_k_cosine(corpus, corpus, 3, cells=4)) == plain(rows, rows, 3, 4)


def test_far_cells_are_skipped(spark):
    vectors = clustered(2000, 16, 40, 0.02, 3)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA)
    index = neighbours.build_cells(corpus)
    assert neighbours.share_read(index, corpus.filter("id % 20 = 0"), 5) < 0.2


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], SCHEMA)
    assert neighbours.top_k_cosine(none, one).count() == 0
    assert neighbours.top_k_cosine(one, none).count() == 0
    assert found(neighbours.top_k_cosine(one, one)) == {(1, 1, 0.0, 1), (1, 2, 0.0, 2), (2, 2, 1.0, 1), (2, 1, 0.0, 2)}


def test_pairs_leave_in_small_pieces(spark, monkeypatch):
    """queries that read nearly all cells, given on a few rows at a time."""
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(4).normal(size=(300, 8)))]
    corpus = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 7)
    monkeypatch.setattr(neighbours, "PAIR_ROWS", 11)
    assert found(neighbours.top_k_cosine(corpus, corpus, 3, cells=9)) == plain(rows, rows, 3, 8)
