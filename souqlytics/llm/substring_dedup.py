"""Word runs repeated anywhere in a corpus, by winnowed seeds extended both ways."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from souqlytics.llm.repeats import Anchors, Items, Method, Texts, anchors, covered, earlier_of, spread, without_repeats
from souqlytics.llm.repeats import _KEY as KEY
from souqlytics.llm.tokens import Words, buffers, grams

WINDOW = 20
SEED = 5


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each distinct pair."""
    _, b = np.unique(b, return_inverse=True)
    _, out = np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), return_inverse=True)
    return out


class Runs(Method):
    within = True
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def __init__(self, window: int = WINDOW):
        if window < 2:
            raise ValueError("windows need 2 words or more")
        self.window, self.gram = window, min(SEED, window - 1)

    def sampled(self, texts: Texts) -> Anchors:
        out, starts, ends, units, done = [], [], [], [], 0
        data, _ = buffers(texts.column)
        for doc, part in texts.slices():
            words = Words(*buffers(part))
            h = grams(words.hash, self.gram) & KEY
            rows = words.rows()
            left = words.bounds[rows + 1][: len(h)] - np.arange(len(h))
            place, first, last = anchors(h, left, self.window, self.gram)
            out.append((h[place], first + done, place - first, last - first + 1, rows[first] + doc))
            starts.append(words.start + texts.at[doc])
            ends.append(words.end + texts.at[doc])
            units.append(words.hash)
            done += len(words.start)
        h, first, seed, n, doc = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
        starts, ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
        units = np.concatenate(units) if units else np.zeros(0, np.uint64)
        return Anchors(h, first, seed, n, doc, starts[first], starts, ends, data, units)

    def earlier(self, items: Items) -> np.ndarray:
        """Extend all seeds word by word to the left and to the right at once.

        Seeds of equal words start in one class. A step splits each class by the next word, so
        after k steps a class holds the seeds whose match goes k words that way. A window is a
        left and a right extension of its seed: windows with equal classes on both sides and
        equal reach are equal.
        """
        words = Words(items.data, items.at)
        q, w = self.gram, self.window
        at = words.bounds[:-1] + items.seed  # word index of each seed
        seed = np.zeros(len(at), np.int64)
        for k in range(q):
            seed = _pairs(seed, words.hash[at + k])
        reach_left, reach_right = items.seed, np.diff(words.bounds) - items.seed - q

        def extend(reach: np.ndarray, step: int, edge: int) -> list[np.ndarray]:
            cls, out = seed, [seed]
            for k in range(1, w - q + 1):
                on = np.flatnonzero(reach >= k)
                nxt = np.full(len(at), -1)
                if len(on):
                    nxt[on] = _pairs(cls[on], words.hash[at[on] + edge + step * k])
                cls = nxt
                out.append(cls)
            return out

        left, right = extend(reach_left, -1, 0), extend(reach_right, 1, q - 1)
        own = np.repeat(np.arange(len(items.n)), items.n)
        back = items.seed[own] - spread(np.zeros(len(items.n), np.int64), items.n)  # words left of the seed
        cls = np.zeros(len(own), np.uint64)
        done = 0
        for k in range(w - q + 1):
            here = np.flatnonzero(back == k)
            if len(here):
                both = _pairs(left[k][own[here]], right[w - q - k][own[here]])
                cls[here] = both + done
                done += int(both.max()) + 1
        return earlier_of(cls, items, self.within)

    def cut(self, texts: Texts, start: np.ndarray, n: np.ndarray) -> pa.Table:
        total, removed, sha, done = [], [], [], 0
        order = np.argsort(start, kind="stable")
        start, n = start[order], n[order]
        for _, part in texts.slices():
            raw, at = buffers(part)
            words = Words(raw, at)
            size = len(words.start)
            mine = slice(*np.searchsorted(start, [done, done + size]))
            gone = covered(size, start[mine] - done, n[mine], self.window)
            keep = words.bounds
            total.append(np.diff(keep))
            removed.append(np.diff(np.concatenate([[0], np.cumsum(gone)])[keep]))
            # kept words and one space after each, then the last space is left out
            kept = np.flatnonzero(~gone)
            length = words.end[kept] - words.start[kept]
            end = np.concatenate([[0], np.cumsum(length + 1)])
            joined = np.full(end[-1], 32, np.uint8)
            joined[spread(end[:-1], length)] = raw[spread(words.start[kept], length)]
            of = np.searchsorted(kept, keep)
            for a, b in zip(end[of].tolist(), end[of][1:].tolist()):
                sha.append(hashlib.sha256(joined[a : max(a, b - 1)].tobytes()).hexdigest())
            done += size
        zero = np.zeros(0, np.int64)
        return pa.table({
            "doc_id": texts.doc_ids(),
            "n_words": np.concatenate([zero, *total]), "n_removed": np.concatenate([zero, *removed]), "kept_sha256": sha,
        })


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256``.

    A word goes when a run of ``window`` words covers it that also starts earlier: in a document
    with a smaller id, or further ahead in the same one. Runs are taken from the input, overlap
    freely and never cross documents. Words stand between white space and are compared by
    64-bit hashes, 20 in a row.

    Null text has no words. Rows that repeat an id are documents of their own, and neither is
    smaller; a null id comes after all others (and ties with 2^63 - 1). Texts shorter than the window stay whole. Ids
    are integers. Other columns are ignored; an empty table gives no rows.
    """
    return without_repeats(docs, Runs(window), id_col, text_col, SCHEMA)
