"""Near duplicates by ProbMinHash over weighted word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souqlytics.llm.components import components, link_buckets
from souqlytics.llm.filters import filter_of, passes
from souqlytics.llm.tokens import SLICE_ROWS, Words, buffers, mix, shingles, slices
from souqlytics.session import stage

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
ROW_BITS = (SLICE_ROWS - 1).bit_length()
# Words are counted by so many hash values: the table of weights has this size at any scale.
WORD_SLOTS = 1 << 16


def distinct_shingles(words: Words, k: int, places: bool = False) -> tuple[np.ndarray, ...]:
    """Row and hash of each row's distinct shingles, sorted by both; and where each stands first."""
    h, row = shingles(words, k)
    # rows of a slice fit in the lower bits: one plain sort groups by row, then by hash
    low = np.uint64(64 - ROW_BITS)
    key = (row.astype(np.uint64) << low) | (h >> np.uint64(ROW_BITS))
    order = np.argsort(key, kind="stable") if places else None
    key = key[order] if places else np.sort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    out = (key >> low).astype(np.int64), mix(key & ((np.uint64(1) << low) - np.uint64(1)))
    return (*out, order[new]) if places else out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each word slot occurs, one array a task."""
    total, texts = np.zeros(WORD_SLOTS, np.int64), 0
    for batch in batches:
        for part in slices(batch, "_text"):
            words = Words(*buffers(part.column(0)))
            slot = words.hash & np.uint64(WORD_SLOTS - 1)
            each = np.unique(words.rows().astype(np.uint64) * np.uint64(WORD_SLOTS) + slot)
            total += np.bincount((each & np.uint64(WORD_SLOTS - 1)).astype(np.int64), minlength=WORD_SLOTS)
            texts += len(part)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(some, WORD_SLOTS)), pa.array(np.append(total[some], texts))], ["slot", "n"])


def word_weights(texts: DataFrame) -> np.ndarray:
    """A weight of 1 (in every text) to 2 (in one) per word slot: how rare its words are in the corpus.

    Counted over all texts; ``WORD_SLOTS`` numbers at any scale. Words that share a slot share
    its weight.
    """
    counted = texts.select("_text").mapInArrow(_word_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    n = np.zeros(WORD_SLOTS + 1)
    for slot, met in counted.collect():
        n[slot] = met
    whole = max(2.0, n[-1])
    return 2.0 - np.log(np.maximum(n[:-1], 1.0)) / np.log(whole)


def weighted(column: pa.Array, k: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of each distinct shingle; its weight is the mean of its words' weights.

    A weight is the same in every text and lies between 1 and 2, however often a shingle
    repeats: where plain sets have a similarity of 0.8, the probability Jaccard is 2/3 at the
    least (if all that differs is twice as heavy as all that is shared).
    """
    words = Words(*buffers(column))
    row, h, first = distinct_shingles(words, k, places=True)
    own = weights[(words.hash & np.uint64(WORD_SLOTS - 1)).astype(np.int64)]
    total = np.concatenate([[0.0], np.cumsum(own)])
    # shingles stand in order of their first word; texts of fewer than k words have one of all
    size = np.diff(words.bounds)
    many = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    start = np.repeat(words.bounds[:-1] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    length = np.repeat(np.minimum(size, k), many)
    mean = (total[start + length] - total[start]) / length
    return row, h, mean[first]


def prob_min_hash(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (n x m shingle hashes) of n weighted sets, and which sets are not empty.

    Each shingle is a Poisson process with its weight as rate; an arrival lands on a random
    register, and a register keeps the shingle that arrives first. Two sets agree on a
    register with the chance that is their probability Jaccard similarity. A process ends
    as soon as its next arrival is later than what all registers of its set already have.
    """
    best = np.full(n * m, np.inf)
    owner = np.zeros(n * m, np.uint64)
    time = np.zeros(len(h))
    k = 0
    while len(h):
        x = mix(h + np.uint64((k * 0x9E3779B97F4A7C15 + 1) % 2**64))
        time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        at = row * m + ((x & np.uint64(0x7FF)).astype(np.int64) * m >> 11)
        np.minimum.at(best, at, time)
        won = best[at] == time
        owner[at[won]] = h[won]
        alive = time < best.reshape(n, m).max(1)[row]
        row, h, weight, time = row[alive], h[alive], weight[alive], time[alive]
        k += 1
    return owner.reshape(n, m), np.isfinite(best.reshape(n, m)[:, 0])


def _bands(batches: Iterator[pa.RecordBatch], shingle: int, bands: int, rows: int, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "_text"):
            row, h, weight = weighted(part.column(2), shingle, weights)
            signature, known = prob_min_hash(row, h, weight, len(part), bands * rows)
            keys = np.full((len(part), bands), 0, np.uint64) + np.arange(bands, dtype=np.uint64)
            for r in range(rows):
                keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + signature[:, r::rows])
            flat = keys[known].reshape(-1).view(np.int64)
            at = np.concatenate([[0], np.cumsum(np.where(known, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["id", "sha", "bands"])


def _shared_keys(batches: Iterator[pa.RecordBatch], shared: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``key, id`` of the bands whose keys may be shared."""
    for batch in batches:
        lists = batch.column(1)
        key = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
        use = passes(shared, key)
        yield pa.RecordBatch.from_arrays([pa.array(key[use]), batch.column(0).take(pa.array(owner[use]))], ["key", "id"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``id, shingles`` of the texts that may be wanted."""
    for batch in batches:
        batch = batch.filter(pa.array(passes(wanted, batch.column(1).to_numpy())))
        for part in slices(batch, "_text"):
            row, h = distinct_shingles(Words(*buffers(part.column(2))), shingle)
            at = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))], ["id", "shingles"])


def prefix_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """All pairs that can reach the threshold: ``id, label, shingles`` -> ``a, b`` of different labels.

    Sets of n shingles that reach it share one of their n - ceil(threshold * n) + 1 rarest ones.
    Copies with edits of their own hold shingles that nobody else has, so those come first and
    pair them with nobody. At the first shingle that two sets share, what is left of the
    smaller remainder bounds all they can share.
    """
    each = members.select("id", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    rare = each.groupBy("s").agg(F.count(F.lit(1)).alias("met"))
    first = F.slice("by", F.lit(1), F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)).cast("int") + 1)
    prefix = stage(
        each.join(rare, "s").groupBy("id", "label", "n").agg(F.sort_array(F.collect_list(F.struct("met", "s"))).alias("by"))
        .select("id", "label", "n", F.posexplode(first).alias("at", "p")).filter("p.met > 1")
        .select("id", "label", F.col("p.s").alias("s"), "n", (F.col("n") - F.col("at")).alias("left")), "prefixes",
    )
    other = prefix.select(F.col("s").alias("s_b"), F.col("id").alias("b"), F.col("label").alias("other"), F.col("n").alias("n_b"), F.col("left").alias("left_b"))
    needed = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("n_b")) - F.lit(1e-9)
    met = (
        (F.col("s") == F.col("s_b")) & (F.col("id") < F.col("b")) & (F.col("label") != F.col("other"))
        & (F.least("left", "left_b") >= needed)
    )
    return prefix.join(other, met).select(F.col("id").alias("a"), "b").distinct()


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, kept``.

    Documents are linked when their sets of five-word shingles (words as they stand between
    white space; a text of 1 to 4 words is one shingle) have a Jaccard similarity of at least
    ``threshold``; a class is a connected group, named by its smallest id, which stays. Equal
    texts are one class from the start and are sketched as one; they are never paired. Pairs
    come from bands of signatures over shingles weighted by how rare their words are in the
    corpus, and are verified on the whole plain sets. A bucket's members are compared by stars, then
    what is left between groups by a prefix filter that loses nothing: no cap. With 20 bands
    of 5 a pair at 0.8 is met with chance 0.9996 where weights are alike, 0.94 where they are least so.

    Texts are read three times (weights, sketches, sets of those in shared buckets) and never
    shuffled: two filters of fixed size say which bands and which texts go on.

    Null text counts as empty; texts without words are near only to equal texts. Rows that
    repeat an id and its text count one by one; texts of one id are one class.
    Rows with a null id are left out: an id names a class. Other columns are ignored; an empty
    table gives no rows.
    """
    base = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = base.schema["id"].dataType.simpleString()
    sc = docs.sparkSession.sparkContext
    weights = sc.broadcast(word_weights(base))
    named = base.select("id", F.substring(F.unhex(F.sha2("_text", 256)), 1, 16).alias("sha"), "_text")
    sketched = stage(
        named.mapInArrow(lambda batches: _bands(batches, shingle, bands, rows, weights.value), f"id {kind}, sha binary, bands array<long>"), "sketches")
    texts = stage(sketched.groupBy("sha").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "texts")

    # which keys stand at two texts: by 64 bits of the text's hash, which at worst show too few
    each = sketched.select(F.explode("bands").alias("key"), F.xxhash64("sha").alias("t"))
    shared = sc.broadcast(filter_of(each.groupBy("key").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo <> hi")))
    buckets = stage(
        sketched.select("sha", "bands").mapInArrow(lambda batches: _shared_keys(batches, shared.value), "key long, id binary").distinct(), "buckets")
    wanted = buckets.select("id").distinct()
    first = F.xxhash64("sha", "id").alias("key")
    known = sc.broadcast(filter_of(texts.join(wanted.withColumnRenamed("id", "w"), F.col("sha") == F.col("w"), "left_semi").select(first)))
    sets = stage(
        named.select("sha", first, "_text").mapInArrow(lambda batches: _sets(batches, shingle, known.value), "id binary, shingles array<long>")
        .dropDuplicates(["id"]), "sets",
    )

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
        common = F.size(F.array_intersect("sa", "sb"))
        return (
            pairs.join(a, "a").join(b, "b").withColumn("common", common)
            .filter(F.col("common") >= F.lit(threshold - 1e-9) * (F.size("sa") + F.size("sb") - F.col("common")))
        )

    links = link_buckets(buckets, verify, lambda members: prefix_pairs(members.join(sets, "id"), threshold))
    several = sketched.groupBy("id").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).filter("a <> b")
    together = sketched.join(several.select("id", "a"), "id").filter("a <> sha").select("a", F.col("sha").alias("b"))
    labels = components(links.unionAll(together))
    labelled = stage(
        texts.join(labels.withColumnRenamed("id", "t"), F.col("sha") == F.col("t"), "left").select("sha", F.coalesce("label", "sha").alias("label"), "id", "n"), "labelled")
    classes = labelled.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    return (
        sketched.select("id", "sha").join(labelled.select("sha", "label").join(classes, "label"), "sha")
        .select(F.col("id").alias("doc_id"), "class_id", "class_size", (F.col("id") == F.col("class_id")).alias("kept"))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; rows with a null id stay."""
    gone = near_dedup(docs, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
