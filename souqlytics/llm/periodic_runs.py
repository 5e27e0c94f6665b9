"""Periodic runs of words by a sparse diagonal match table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souqlytics.llm.tokens import slices

LEAST_WORDS = 24
LEAST_PERIODS = 3

RUN = "struct<start:long,length:long,period:long>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_numbers(documents: list[list[bytes]]) -> np.ndarray:
    """A number per word over all documents; words of different documents never share one."""
    numbers, base = [], 0
    for words in documents:
        known: dict[bytes, int] = {}
        numbers.extend([known.setdefault(w, base + len(known)) for w in words])
        base += len(known)
    return np.array(numbers, np.int64)


def find_runs(number: np.ndarray, longest: int, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> np.ndarray:
    """Start, length and period of every maximal run of ``least`` words and ``times`` periods.

    A cell (i, q) of the diagonal table counts how many words up to i equal the word q before
    them. Word i adds one to the diagonals of its earlier occurrences, and a diagonal that is
    not met ends there: if its count is high enough its run is given out. The table is kept
    sparse by context: at level k = 1, 2, 4, ... an occurrence is earlier only if its last k
    words are those of i, and only the nearest one counts, so a word is on one diagonal per
    level and diagonals at level k count from k words on. Nothing is lost: in a run of
    smallest period q (k/2 < q <= k) k words repeat q later and, being at least one whole
    period, no earlier; so the nearest occurrence is the one q before, throughout. For the
    same reason a lag that is not the smallest period never lasts. A word whose last k words
    occur once is on no diagonal of a higher level. At most ``log2`` levels of one sort each.
    """
    n, k = len(number), 1
    at = np.arange(n)
    name = number.copy()  # which k words end at each place; -1: they occur once
    found = []
    while len(at) and times * (k // 2 + 1) <= longest:
        order = np.argsort(name[at], kind="stable")
        place, key = at[order], name[at][order]
        same = np.zeros(len(at) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        # where the k words occur for a second time and later: the nearest earlier occurrence
        again = np.flatnonzero(same[:-1])
        lag = np.full(n, 0)
        lag[place[again]] = place[again] - place[again - 1]
        lag[(lag <= k // 2) | (lag > k)] = 0
        on = np.flatnonzero(lag)
        if len(on):
            cut = np.flatnonzero((np.diff(on) != 1) | (np.diff(lag[on]) != 0)) + 1
            first, last = on[np.concatenate([[0], cut])], on[np.concatenate([cut, [len(on)]]) - 1]
            q = lag[first]
            length = last - first + k + q
            enough = length >= np.maximum(least, times * q)
            found.append(np.stack([last - length + 1, length, q], 1)[enough])
        # names of 2k words: pairs of names k apart, both of words that repeat
        alone = ~(same[:-1] | same[1:])
        name[place] = np.cumsum(~same[:-1]) - 1
        name[place[alone]] = -1
        at = at[(name[at] >= 0) & (at >= k)]
        at = at[name[at - k] >= 0]
        pair = name[at - k] * n + name[at]
        name = np.full(n, -1)
        name[at] = np.unique(pair, return_inverse=True)[1]
        k *= 2
    out = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods, counted exactly; then the first, then the shortest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _analysed(batches: Iterator[pa.RecordBatch], least: int, times: int, edit: Callable | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "_text"):
            ids = part.column(0).to_pylist()
            # bytes.split() cuts at exactly the white space of [^\x20\x09-\x0D]+
            documents = [(t or "").encode().split() for t in part.column(1).to_pylist()]
            if edit is not None:
                documents = [edit(i, words) for i, words in zip(ids, documents)]
            bounds = np.concatenate([[0], np.cumsum([len(d) for d in documents])]).astype(np.int64)
            runs = find_runs(word_numbers(documents), int(np.diff(bounds).max()), least, times)
            owner = np.searchsorted(bounds, runs[:, 0], "right") - 1
            runs[:, 0] -= bounds[owner]
            parts = np.searchsorted(owner, np.arange(len(documents) + 1))
            lists, best, left = [], [], []
            for d, words in enumerate(documents):
                own = [tuple(r) for r in runs[parts[d] : parts[d + 1]].tolist()]
                lists.append([dict(zip(("start", "length", "period"), r)) for r in own])
                top = _strongest(own)
                best.append(dict(zip(("start", "length", "period"), top)) if top else None)
                if own:
                    step = np.zeros(len(words) + 1, np.int64)
                    for start, length, q in own:
                        step[start + q] += 1
                        step[start + length] -= 1
                    words = [w for w, inside in zip(words, np.cumsum(step).tolist()) if not inside]
                left.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(d) for d in documents], pa.int64()), pa.array(lists, pa.list_(_RUN)),
                pa.array(best, _RUN), pa.array(left, pa.large_string()).cast(pa.string()),
            ], ["doc_id", "n_words", "runs", "strongest", "collapsed"])


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS,
    times: int = LEAST_PERIODS, edit: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, runs, strongest, collapsed``.

    A run is a stretch of words of smallest period q, at least ``least`` words and ``times``
    periods long, that no neighbouring word extends. ``runs`` has them by start, then period;
    ``strongest`` is the one of most periods (null without runs); ``collapsed`` is the text with
    only the first period of each run, words joined by one blank. ``edit`` may change a
    document's words before they are searched. Words are compared whole, without hashing.

    A document is searched where it is read: no shuffle, memory in proportion to a slice of
    texts or to the longest one, time n log n in its words even where all are alike. Null text
    counts as empty, and a text without words has no runs and an empty ``collapsed``. Rows
    that repeat an id, and rows with a null id, give a row each. Other columns are ignored; an
    empty table gives no rows. Fewer than three periods are refused: the search needs them.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not searched")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return texts.mapInArrow(
        lambda batches: _analysed(batches, least, times, edit),
        f"doc_id {kind}, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string",
    )
