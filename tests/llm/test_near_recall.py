"""Near copies at a similarity of 0.8 to 0.9: measured recall, and weights against plain ones."""

import math
import random

import numpy as np
import pyarrow as pa

from souqlytics.llm import near_dedup
from souqlytics.llm.components import components


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_recall_of_pairs_at_the_threshold(spark):
    rng = random.Random(6)
    common = [f"c{i}" for i in range(150)]
    rows, pairs = [], 0
    while pairs < 120:
        words = [rng.choice(common) for _ in range(rng.randint(60, 300))]
        copy, n = list(words), 0
        for at in rng.sample(range(len(words)), max(1, len(words) // rng.randint(45, 60))):
            copy[at], n = f"rare{pairs}x{n}", n + 1
        if pairs % 2:  # a passage of its own, repeated
            copy += copy[-7:] * rng.randint(1, 6)
        a, b = shingles(words), shingles(copy)
        if 0.8 <= len(a & b) / len(a | b) <= 0.9:
            rows += [(2 * pairs, " ".join(words)), (2 * pairs + 1, " ".join(copy))]
            pairs += 1
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[2 * i + 1] == 2 * i for i in range(pairs))
    assert found >= 0.9 * pairs, found
    assert all(got[2 * i] == 2 * i for i in range(pairs))


def test_weights_are_those_of_the_words(spark):
    texts = ["a b c d e f", "a b c", "a b", "a", "", None, "b b b b b b b b", "a zz a zz a zz"]
    docs = spark.createDataFrame([(t,) for t in texts], "_text string").fillna("")
    weights = near_dedup.word_weights(docs)
    held = {w: sum(w in (t or "").split() for t in texts) for w in ("a", "b", "c", "zz")}

    def weight(word):
        return 2 - math.log(held.get(word, 1)) / math.log(len(texts))

    row, _, got = near_dedup.weighted(pa.array(texts), 5, weights)
    want = []
    for i, t in enumerate(texts):
        w = (t or "").split()
        for s in {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else ():
            want.append((i, sum(map(weight, s)) / len(s)))
    assert np.allclose(sorted(zip(row.tolist(), got.tolist())), sorted(want))
    assert (got >= 1 - 1e-9).all() and (got <= 2 + 1e-9).all()


def test_passes_of_groups_write_few_files(spark):
    """Small link tables: a pass writes a file per core at the most, whatever the number of shuffle partitions."""
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 400, 2)] + [(1, 2)], "a long, b long")
    conf = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        labels = components(links)
        files = len(labels.inputFiles())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    want = {i: i - i % 2 for i in range(400)} | {2: 0, 3: 0}
    assert {r.id: r.label for r in labels.collect()} == want
    assert files <= spark.sparkContext.defaultParallelism + 1
