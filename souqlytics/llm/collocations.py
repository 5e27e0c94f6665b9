"""Phrase collocations counted in the chunk dictionary of a prefix-free parse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souqlytics.llm.filters import filter_of, passes
from souqlytics.llm.tokens import Words, buffers, grams, mix, slices
from souqlytics.session import scratch_path

LONGEST = 4
LEAST_COUNT = 30
TOP = 2_000
SHARE = 80  # per cent of a phrase's occurrences that lie in one longer phrase
TRIGGER = 32  # one place in so many starts a chunk
# Hashes, and bytes of chunks, that a task tallies at a time.
HASH_BLOCK, PHRASE_BLOCK = 1 << 22, 4 << 20
# Scan partitions whose phrases are added up before they are sent on: the same phrases come again in each.
TOGETHER = 4

# White space and the characters that end a piece, all mapped to one of each.
PIECE_END = b".,;:!?\x0a\x0b\x0c\x0d"
_PLAIN = bytes.maketrans(
    bytes(range(ord("A"), ord("Z") + 1)) + PIECE_END + b"\t",
    bytes(range(ord("a"), ord("z") + 1)) + b"." * len(PIECE_END) + b" ",
)
_BLANK = np.zeros(256, bool)
_BLANK[0x20] = True
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


class _Names(dict):
    """Numbers of words in order of appearance; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _words(texts: pa.Array) -> Words:
    """Words of normalised texts; the end of a piece is the word ``.``."""
    return Words(*buffers(texts.cast(pa.large_binary()).view(pa.large_string())), space=_BLANK)


_END_HASH = _words(pa.array([b"."], pa.large_binary())).hash[0]


def _normalised(text: str) -> bytes:
    """Lower case, one blank between words, and a ``.`` of its own for each end of a piece."""
    return b" ".join(text.encode().translate(_PLAIN).replace(b".", b" . ").split())


def _chunks(texts: list[bytes]) -> tuple[list[int], list[bytes], list[bool]]:
    """Chunks of normalised texts: text number, words joined by blanks, and whether it is the last.

    A place starts a chunk where the three words (or piece ends) from it on hash to a multiple
    of TRIGGER; the chunk before it runs on over these three, so every stretch of up to four
    words lies wholly in the chunk that has its first word. Chunks depend on nearby words only:
    copies of a passage are cut alike wherever they stand.
    """
    keep, whole = LONGEST - 1, b"".join(texts)
    words = _words(pa.array(texts, pa.large_binary()))
    trigger = grams(words.hash, keep) % np.uint64(TRIGGER) == 0
    owners, out, last = [], [], []
    start, end = words.start.tolist(), words.end.tolist()
    for d, (a, b) in enumerate(zip(words.bounds.tolist(), words.bounds[1:].tolist())):
        if a == b:
            continue
        cut = [a, *(np.flatnonzero(trigger[a + 1 : b - keep + 1]) + a + 1).tolist(), b] if b - a > keep else [a, b]
        owners.extend([d] * (len(cut) - 1))
        out.extend([whole[start[x] : end[y + keep - 1]] for x, y in zip(cut[:-2], cut[1:-1])])
        out.append(whole[start[cut[-2]] : end[b - 1]])
        last.extend([False] * (len(cut) - 2) + [True])
    return owners, out, last


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            langs = part.column(0).to_pylist()
            owners, chunks, last = _chunks([_normalised(t) for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[d] for d in owners], pa.string()), pa.array(chunks, pa.binary()), pa.array(last, pa.bool_())],
                ["lang", "chunk", "last"])


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    kinds = langs.dictionary_encode()
    h = np.array([xxhash.xxh64_intdigest(x.encode()) for x in kinds.dictionary.to_pylist()], np.uint64)
    return h[kinds.indices.to_numpy()]


def _weights(size: np.ndarray, last: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each word of chunks of these sizes counts; the words a chunk shares with the next one count there."""
    own = np.where(last, size, size - LONGEST + 1)
    return np.repeat(np.stack([times, times * 0], 1).reshape(-1), np.stack([own, size - own], 1).reshape(-1))


def _keys(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(head * _MULTIPLIER + word)


def _tallied(key: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """Sums of ``times`` by key. Most chunks occur once: their keys are only sorted."""
    once = key[times == 1]
    once.sort()
    new = np.flatnonzero(np.concatenate([[True], once[1:] != once[:-1]])) if len(once) else np.zeros(0, np.int64)
    more = times > 1
    code, kinds = pd.factorize(key[more])
    keys = np.concatenate([once[new], kinds])
    n = np.concatenate([np.diff(np.append(new, len(once))), np.bincount(code, times[more], len(kinds)).astype(np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])


def _hash_counts(batches: Iterator[pa.RecordBatch], long: bool, short: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Counts by hash of words and pairs, or of longer phrases all of whose pairs pass ``short``."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, "chunk"):
            words = _words(part.column(1))
            n = np.diff(words.bounds)
            times = _weights(n, part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy())
            real = words.hash != _END_HASH
            row = words.rows()
            key, good = _keys(np.repeat(_lang_hashes(part.column(0)), n), words.hash), real
            for length in range(1, LONGEST + 1):
                if length > 1:
                    key = _keys(key[:-1], words.hash[length - 1 :])
                    good = good[:-1] & real[length - 1 :] & (row[length - 1 :] == row[: 1 - length])
                    if length == 2 and long:
                        good &= passes(short, key)
                        pair = good
                    elif length > 2:
                        good = good & pair[length - 2 :]
                if (length > 2) == long:
                    use = good & (times[: len(key)] > 0)
                    held.append((key[use], times[: len(key)][use]))
                    size += len(held[-1][0])
                if not long and length == 2:
                    break
        if size > HASH_BLOCK:
            yield _tallied(*(np.concatenate(x) for x in zip(*held)))
            held, size = [], 0
    if held:
        yield _tallied(*(np.concatenate(x) for x in zip(*held)))


def _phrase_counts(batches: Iterator[pa.RecordBatch], filters: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Exact counts of the phrases whose hashes pass the filter of their length."""
    held, size = [], 0
    for batch in batches:
        for row in range(0, len(batch), 1024):
            held.append(batch.slice(row, 1024))
            size += held[-1].column(1).nbytes
            if size > PHRASE_BLOCK:
                yield from _block_counts(pa.Table.from_batches(held), filters)
                held, size = [], 0
    if held:
        yield from _block_counts(pa.Table.from_batches(held), filters)


def _block_counts(chunks: pa.Table, filters: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    names, text = _Names(), [c.split() for c in chunks.column(1).to_pylist()]
    n = np.array([len(c) for c in text], np.int64) + 1  # and an end after each chunk
    word = np.fromiter(map(names.__getitem__, (w for c in text for w in (*c, b"."))), np.int64, int(n.sum()))
    del text
    words = list(names)
    word_hash = _words(pa.array([b" ".join(words)], pa.large_binary())).hash
    kinds = chunks.column(0).combine_chunks().dictionary_encode()
    langs = kinds.dictionary.to_pylist()
    lang = np.repeat(kinds.indices.to_numpy().astype(np.int64), n)
    times = _weights(n - 1, chunks.column(2).to_numpy(), chunks.column(3).to_numpy())
    at = np.cumsum(n - 1)[:-1]
    times = np.insert(times, np.append(at, len(times)), 0)
    total = np.bincount(lang, times * (word > 0), len(langs)).astype(np.int64)
    yield _counted(langs, [""] * len(langs), 0, total)

    key, good, phrase, texts = _keys(np.repeat(_lang_hashes(chunks.column(0).combine_chunks()), n), word_hash[word]), word > 0, lang, None
    for size in range(1, LONGEST + 1):
        if size > 1:
            key = _keys(key[:-1], word_hash[word[size - 1 :]])
            good = good[:-1] & good[1:] & (word[size - 1 :] > 0)
        good = good & passes(filters[size - 1], key)
        at = np.flatnonzero(good)
        code, pairs = pd.factorize(phrase[at] * len(words) + word[at + size - 1])
        head, tail = (pairs // len(words)).tolist(), (pairs % len(words)).tolist()
        if texts is None:
            of, texts = [langs[h] for h in head], [words[t] for t in tail]
        else:
            of, texts = [of[h] for h in head], [texts[h] + b" " + words[t] for h, t in zip(head, tail)]
        sums = np.bincount(code, times[at], len(pairs)).astype(np.int64)
        some = np.flatnonzero(sums).tolist()
        yield _counted([of[i] for i in some], [texts[i].decode() for i in some], size, sums[some])
        phrase = np.zeros(len(word), np.int64)
        phrase[at] = code


def _counted(langs: list[str], phrases: list[str], size: int, times: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(np.full(len(times), size, np.int32)), pa.array(times)],
        ["lang", "phrase", "size", "n"])


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _filter_of(counts: DataFrame, least: int) -> np.ndarray:
    return filter_of(counts.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


def chunk_dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The different chunks of all texts: ``lang, chunk, last, n`` with their frequency in the parse."""
    return (
        docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .mapInArrow(_parsed, "lang string, chunk binary, last boolean")
        .groupBy("lang", "chunk", "last").agg(F.count(F.lit(1)).alias("n"))
    )


def frequent_phrases(dictionary: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``lang, phrase, size, n``: how often each phrase of 1 to 4 words occurs, if ``least`` times.

    A row of size 0 per language has the number of all words. Two rounds over the dictionary
    count 64-bit hashes (first of words and pairs, then of longer phrases all of whose pairs are
    frequent) to fill filters; a hash only ever counts too much, so no frequent phrase is
    missed, and the last round counts what passes by its exact words.
    """
    sc = dictionary.sparkSession.sparkContext

    def hashes(long, short):
        known = sc.broadcast(short)
        return dictionary.mapInArrow(lambda batches: _hash_counts(batches, long, known.value), "key long, n long")

    short = _filter_of(hashes(False, None), least)
    long = _filter_of(hashes(True, short), least)
    known = sc.broadcast([short, short, long, long])
    few = dictionary.coalesce(-(-dictionary.rdd.getNumPartitions() // TOGETHER))
    return (
        few.mapInArrow(lambda batches: _phrase_counts(batches, known.value), "lang string, phrase string, size int, n long")
        .groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("size") == 0))
    )


def _part(first: Column, words: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, words), " ")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST_COUNT, share: int = SHARE, top: int = TOP,
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A to Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into
    words at blanks and tabs. A phrase of 2 to 4 words of a piece that occurs a >= ``least``
    times is cut after each of its words; with l and r occurrences of the two parts its score
    is floor(2000000 a / (l + r)) at the lowest-scoring cut (ties: the first). A phrase goes if
    a longer one that contains it occurs at least ``share`` per cent as often. Order: score,
    then a, both falling, then the phrase's bytes. ``n`` counts the words of the language.

    Texts are parsed where they are read into chunks cut by their content, which overlap by
    three words; equal chunks are kept once with their frequency, and phrases are counted in
    the chunks that differ, each by the chunk that has its first word. Null language is ``und``;
    null text counts as empty and has no phrases. Repeated rows count each time. Other columns
    are ignored; an empty table gives no rows.
    """
    dictionary = _written(chunk_dictionary(docs, text_col, lang_col), "chunk-dictionary")
    counted = _written(frequent_phrases(dictionary, least), "phrases")
    phrases = counted.filter("size > 0")
    candidates = phrases.filter("size > 1").withColumnRenamed("n", "a")

    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    parts = candidates.select("lang", "phrase", "a", "size", cut).select(
        "lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    left = phrases.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    # whole numbers of 38 digits: the product may pass 64 bits, the quotient is at most 1000000
    score = F.expr("cast(a as decimal(20,0)) * 2000000BD div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = (
        parts.join(left, ["lang", "head"]).join(right, ["lang", "tail"]).withColumn("score", score)
        .groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("best"))
    )

    inner = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda w: F.transform(F.sequence(F.lit(1), F.col("size") - w + 1), lambda i: _part(i, w)),
    ))).alias("phrase")
    longer = candidates.filter("size > 2").select("lang", inner, F.col("a").alias("longest")).groupBy("lang", "phrase").agg(F.max("longest").alias("longest"))
    kept = (
        scored.join(longer, ["lang", "phrase"], "left")
        .filter(F.col("longest").isNull() | (F.col("longest").cast("decimal(20,0)") * 100 < F.col("best.a").cast("decimal(20,0)") * share))
        .select("lang", "phrase", "best.a", "best.l", "best.r", "best.score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each share of a language first, so that no task sorts a whole language
    few = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    words = counted.filter("size = 0").select("lang", "n")
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
