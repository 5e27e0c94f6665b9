"""Toxicity by multiple-instance learning: sentences scored, documents labelled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souqlytics.llm.tokens import SLICE_ROWS, _BASE, _BASE_INV, _BYTE, _power, buffers, last_column, slices, with_text
from souqlytics.session import stage

# Most labelled rows of each class that a model is fitted on, and most features it keeps.
SAMPLE = {1: 3_000, 0: 6_000}
FEATURES = 20_000
GRAMS = (4, 5, 6)
CUT = 0.7
ROW_BITS = (SLICE_ROWS - 1).bit_length()

# Bytes as features see them: ASCII letters in lower case, all else of ASCII as one blank.
_FOLD = np.array([ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_FOLD[128:] = np.arange(128, 256)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


class Sentences:
    """Texts cut after full stops, question and exclamation marks and line ends."""

    def __init__(self, column: pa.Array):
        data, self.at = buffers(column)
        folded = _FOLD[data]
        self.n = len(data)
        ends = np.flatnonzero(_ENDS[data]) + 1
        self.cuts = np.union1d(ends, self.at[:-1])  # where a sentence may start
        word = folded != 32
        first = word.copy()
        first[1:] &= ~word[:-1]
        with_words = np.unique(np.searchsorted(self.cuts, np.flatnonzero(first), "right") - 1)
        #: index into cuts of the sentences that have a word, and the row of each
        self.known = with_words
        self.row = np.searchsorted(self.at, self.cuts[with_words], "right") - 1
        self.total = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_BYTE[folded] * _power(_BASE, self.n), out=self.total[1:])

    def grams(self, k: int) -> np.ndarray:
        """Hash of the ``k`` folded bytes from each position; the lower ROW_BITS bits are 0."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        h = self.total[k:] - self.total[:-k]
        h *= _power(_BASE_INV, self.n)[: len(h)]
        h += np.uint64(k)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h &= np.uint64(2**64 - (1 << ROW_BITS))
        return h

    def whole(self, at: np.ndarray, k: int) -> np.ndarray:
        """Which of these positions have ``k`` bytes left in their text."""
        return self.at[np.searchsorted(self.at, at, "right")] - at >= k

    def sentence(self, at: np.ndarray) -> np.ndarray:
        """Which known sentence a position is in (-1: in none)."""
        cut = np.searchsorted(self.cuts, at, "right") - 1
        i = np.minimum(np.searchsorted(self.known, cut), max(len(self.known) - 1, 0))
        return np.where(self.known[i] == cut, i, -1) if len(self.known) else np.full(len(at), -1)

    def span(self, sentence: int) -> tuple[int, int]:
        cut = self.known[sentence]
        row = self.row[sentence]
        stop = self.cuts[cut + 1] if cut + 1 < len(self.cuts) else self.n
        return int(self.cuts[cut] - self.at[row]), int(min(stop, self.at[row + 1]) - self.at[row])


class Model:
    """Weights of byte runs in sorted order of their hash, and the sentence bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias
        self.bits = np.zeros(1 << 20, bool)
        self.bits[hashes >> np.uint64(44)] = True

    def hits(self, s: Sentences) -> np.ndarray:
        """Distinct (known sentence, feature) pairs."""
        found = [np.zeros((0, 2), np.int64)]
        if len(self.hashes):
            for k in GRAMS:
                h = s.grams(k)
                at = np.flatnonzero(self.bits[h >> np.uint64(44)])
                at = at[s.whole(at, k)]
                h = h[at]
                f = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                good = self.hashes[f] == h
                found.append(np.stack([s.sentence(at[good]), f[good]], 1))
        pairs = np.concatenate(found)
        key = np.unique(pairs[pairs[:, 0] >= 0] @ np.array([1 << 24, 1]))
        return np.stack([key >> 24, key & ((1 << 24) - 1)], 1)

    def sentence_scores(self, s: Sentences) -> np.ndarray:
        pairs = self.hits(s)
        logit = np.full(len(s.known), self.bias) + np.bincount(pairs[:, 0], self.weights[pairs[:, 1]], len(s.known))
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def noisy_or(p: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Chance that at least one of a group's sentences is toxic; 0 for a group without any."""
    return -np.expm1(np.bincount(group, np.log1p(-np.minimum(p, 1 - 1e-12)), n))


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 3


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """At most SAMPLE rows of each class, those with the smallest hash of their id."""
    known = labels.filter((fold(F.col(id_col)) != 1) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.col(label_col).cast("int")).alias("_y"))
    ids = None
    for y, most in SAMPLE.items():
        one = known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        ids = one if ids is None else ids.unionAll(one)
    # at most sum(SAMPLE.values()) ids
    return docs.join(F.broadcast(ids), F.col(id_col) == F.col("_id")).select(
        "_id", "_y", F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of each class hold a byte run: one row per run and 4 MB of text."""
    low = np.uint64((1 << ROW_BITS) - 1)
    for batch in batches:
        for block in slices(batch, "_text", 4 << 20):
            for k in GRAMS:
                held = []
                for part in slices(block, "_text"):
                    s, y = Sentences(part.column(2)), part.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
                    h = s.grams(k)
                    row = np.repeat(np.arange(len(part)), np.diff(s.at))[: len(h)]
                    good = s.at[row + 1] - np.arange(len(h)) >= k
                    key = np.sort(h[good] | row[good].astype(np.uint64))
                    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
                    held.append((key & ~low) | y[(key & low).astype(np.int64)])
                key = np.sort(np.concatenate(held))
                if not len(key):
                    continue
                h = key & ~low
                start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(h[start].view(np.int64)), pa.array(np.add.reduceat((key & low).astype(np.int64), start)),
                    pa.array(np.diff(np.append(start, len(h))).astype(np.int64)),
                ], ["h", "pos", "n"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn sentence weights from document labels.

    A sentence is toxic with chance sigmoid(bias + weights of its byte runs); a document with
    the noisy-or of its sentences. The weights maximise the likelihood of the labels over a
    sample bounded by SAMPLE, of which only rows outside the held-out fold count. Features
    are the at most FEATURES byte runs most tied to toxic documents in the sample. Bags of
    features stay in the shared folder and are trained on by one task.
    """
    sample = stage(_sample(docs, labels, id_col, text_col, label_col), "toxic-sample")
    sizes = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return empty
    rate = F.col("n") / F.lit(n1 + n0)
    z = (F.col("pos") / n1 - (F.col("n") - F.col("pos")) / n0) / F.sqrt(rate * (1 - rate) * F.lit(1 / n1 + 1 / n0) + F.lit(1e-12))
    features = (
        sample.mapInArrow(_counts, "h long, pos long, n long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
        .filter(F.col("pos") >= 3).withColumn("z", z).filter("z >= 4").orderBy(F.desc("z"), "h").limit(FEATURES).select("h").toPandas()
    )
    hashes = np.sort(features["h"].to_numpy(np.int64).view(np.uint64))
    start = Model(hashes, np.zeros(len(hashes)), 0.0)
    held = sample.sparkSession.sparkContext.broadcast(start)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                s = Sentences(part.column(2))
                pairs = held.value.hits(s)
                count = np.bincount(s.row, minlength=len(part))
                cut = np.searchsorted(s.row[pairs[:, 0]], np.arange(len(part) + 1)) if len(pairs) else np.zeros(len(part) + 1, int)
                packed = [np.ascontiguousarray(pairs[a:b].T, np.int32).tobytes() for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([
                    part.column(1), pa.array(count.astype(np.int64)), part.column(0).cast(pa.string()),
                    pa.array(packed, pa.binary()),
                ], ["y", "sentences", "id", "pairs"])

    packed = stage(sample.mapInArrow(bags, "y int, sentences long, id string, pairs binary"), "toxic-bags")

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        model = _train(rows.sort_values(["id", "y"], kind="stable"), hashes, n1, n0)
        return pd.DataFrame({"at": np.arange(len(hashes) + 1), "weight": np.append(model.weights, model.bias)})

    # the bags of a bounded sample fit one task; the driver only sees the weights
    weights = packed.groupBy(F.lit(0).alias("all")).applyInPandas(train, "at long, weight double").toPandas().sort_values("at")["weight"].to_numpy()
    return Model(hashes, weights[:-1], float(weights[-1]))


def _train(rows: pd.DataFrame, hashes: np.ndarray, n1: int, n0: int, steps: int = 300, rate: float = 0.1, decay: float = 2e-5) -> Model:
    """Maximum likelihood by Adam. Sentences without any feature share one score."""
    n, y = len(rows), rows["y"].to_numpy(float)
    # (sentence, feature) pairs of each document, in order of the sentence
    bags = [np.frombuffer(v, np.int32).reshape(2, -1) for v in rows["pairs"]]
    pair_doc = np.repeat(np.arange(n, dtype=np.int32), [b.shape[1] for b in bags])
    pair_s, pair_f = (np.concatenate([b[k] for b in bags]) for k in (0, 1))
    new = np.ones(len(pair_f), bool)
    new[1:] = (pair_doc[1:] != pair_doc[:-1]) | (pair_s[1:] != pair_s[:-1])
    first = np.flatnonzero(new)
    inst = (np.cumsum(new) - 1).astype(np.int32)
    inst_doc = pair_doc[first]
    del bags, pair_doc, pair_s, new
    plain = rows["sentences"].to_numpy(float) - np.bincount(inst_doc, minlength=n)
    w, b = np.zeros(len(hashes)), -6.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    share = np.where(y == 1, 1.0, max(1.0, n0 / max(n1, 1) / 2)) / n
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(inst, w[pair_f], len(first)), -30, 30)))
        p0 = 1 / (1 + np.exp(-b))
        keep = np.bincount(inst_doc, np.log1p(-p), n) + plain * np.log1p(-p0)  # log chance of no toxic sentence
        none = np.exp(np.minimum(keep, -1e-9))
        # d loss / d keep: labels 0 want it near 0, labels 1 want it low
        slope = np.where(y == 1, none / (1 - none), -1.0) * share
        g_inst = -slope[inst_doc] * p
        grad = np.append(
            np.bincount(pair_f, g_inst[inst], len(w)) + decay * w,
            g_inst.sum() - (slope * plain).sum() * p0,
        )
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], min(b - move[-1], -2.0)
    return Model(hashes, w, float(b))


def _scored(batch: pa.RecordBatch, model: Model) -> tuple[np.ndarray, list[list[dict]]]:
    """Score of each row, and its sentences of chance 0.5 or more as code point spans."""
    scores, spans, done = np.zeros(len(batch)), [[] for _ in range(len(batch))], 0
    for part in slices(batch, "_text"):
        column = part.column(part.schema.get_field_index("_text"))
        s = Sentences(column)
        p = model.sentence_scores(s)
        scores[done : done + len(part)] = noisy_or(p, s.row, len(part))
        for i in np.flatnonzero(p >= 0.5).tolist():
            row, (start, stop) = int(s.row[i]), s.span(i)
            raw = column[row].as_py().encode("utf-8", "surrogatepass")
            head = len(raw[:start].decode("utf-8", "replace"))
            spans[done + row].append({"start": head, "stop": head + len(raw[start:stop].decode("utf-8", "replace")), "score": float(p[i])})
        done += len(part)
    return scores, spans


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, offending``.

    ``offending`` lists the sentences that are toxic themselves with chance 0.5 or more, as
    code point spans of the text. Whole texts are scored in one pass without a shuffle; only
    the model (at most FEATURES weights) is sent out. Null and empty texts, and texts without
    a word, score 0. Repeated rows score alike; a null id is held out by no fold
    (``held_out`` null). Without labels of both classes every score is next to 0. Other
    columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = _scored(batch, held.value)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= cut).astype(np.int32)), pa.array(spans, _SPANS),
            ], ["doc_id", "held_out", "score", "predicted", "offending"])

    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col)) == 1).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, "
                                "offending array<struct<start:long,stop:long,score:double>>")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The documents that score under ``cut``, with all their columns, in one pass."""
    names = docs.columns
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(len(batch))
            done = 0
            for part in slices(last_column(batch), "_text"):
                s = Sentences(part.column(0))
                scores[done : done + len(part)] = noisy_or(held.value.sentence_scores(s), s.row, len(part))
                done += len(part)
            yield batch.select(range(len(names))).filter(pa.array(scores < cut))

    return with_text(docs, F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, docs.schema)
