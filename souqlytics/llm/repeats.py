"""Windows that repeat across a corpus: blocks of documents exchange what they may share.

A window is W consecutive units (bytes or words) of one document. Each window picks an anchor,
the run of q units in it with the smallest hash, so equal windows pick equal anchors at equal
places, and only about 2 in W - q units are anchors. The rounds are joins and groupings:

1. blocks (documents of one hash class) send the hashes of their anchors to buckets;
2. buckets answer which hashes other blocks have too;
3. blocks send the surroundings of those anchors, one of each kind, to buckets;
4. buckets tell exactly which windows have an earlier equal, and blocks cut them out.

Messages are packed arrays, one row per block and bucket. Blocks and buckets are bounded by
their number, which follows the corpus. Anchors that very many documents have are not sent to
the bucket of their hash but, window by window, to that of the window, where copies have
already been folded by each block; so no bucket grows with a frequent passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souqlytics.llm.tokens import _BASE, _BASE_INV, _BYTE, _power, mix, slices

BLOCK_BYTES = 3 << 19
# Anchors per bucket in round 2 follow from blocks per bucket.
BLOCKS_PER_BUCKET = 4
HEAVY = 2_000
NULL_ID = 2**63 - 1
_KEY = np.uint64(2**64 - 2**16)
_PLACE = 28  # bits for a place in a slice when minima are taken


@dataclass
class Texts:
    """The documents of a block in order of their id."""

    ids: np.ndarray  # a null id stands after all others, as NULL_ID
    unknown: np.ndarray  # whose id is null
    column: pa.Array
    at: np.ndarray  # byte offset of each document in the block, and the end

    @classmethod
    def of(cls, table: pa.Table) -> Texts:
        table = table.select(["doc_id", "text", "unknown"]).sort_by([("doc_id", "ascending"), ("unknown", "ascending"), ("text", "ascending")])
        table = table.combine_chunks()
        column = table.column("text").cast(pa.large_string())
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
        ids = table.column("doc_id").to_numpy().astype(np.int64)
        size = pc.binary_length(column).to_numpy(zero_copy_only=False)
        return cls(ids, table.column("unknown").to_numpy(), column, np.concatenate([[0], np.cumsum(size)]).astype(np.int64))

    def doc_ids(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.unknown)

    def slices(self) -> Iterator[tuple[int, pa.Array]]:
        """First document and texts of each slice."""
        done = 0
        for part in slices(pa.RecordBatch.from_arrays([self.column], ["text"]), "text"):
            yield done, part.column(0)
            done += len(part)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of the ``w`` values from each place."""
    size, out = 1, x
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = w - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(grams: np.ndarray, left: np.ndarray, window: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor place, first and last window start of each run of windows with one anchor.

    ``grams[i]`` hashes the q units from i; ``left[i]`` counts the units from i to the end of
    its document. Of equal hashes in a window the first is its anchor.
    """
    w = window - q + 1
    none = np.zeros(0, np.int64)
    if len(grams) < w:
        return none, none, none
    if len(grams) > 1 << _PLACE:  # one very long text: places are counted anew every 2^27 windows
        half = 1 << (_PLACE - 1)
        parts = [
            [x + a for x in anchors(grams[a : a + half + w - 1], left[a : a + half], window, q)] for a in range(0, len(grams) - w + 1, half)
        ]
        return tuple(np.concatenate(x) for x in zip(*parts))
    place = np.uint64((1 << _PLACE) - 1)
    low = sliding_min((grams & ~place) | np.arange(len(grams), dtype=np.uint64), w)
    start = np.flatnonzero(left[: len(low)] >= window)
    if not len(start):
        return none, none, none
    at = (low[start] & place).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return at[first], start[first], start[np.append(first[1:], len(at)) - 1]


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays of known order as one compressed message."""
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays.values():
        parts.append(np.array([a.nbytes], np.int64).tobytes())
    parts += [np.ascontiguousarray(a).tobytes() for a in arrays.values()]
    raw = b"".join(parts)
    return np.array([len(raw)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    size = int(np.frombuffer(blob[:8], np.int64)[0])
    raw = pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    sizes = np.frombuffer(raw[8 : 8 + 8 * n], np.int64)
    out, at = [], 8 + 8 * n
    for s, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw[at : at + s], kind))
        at += s
    return out


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... n[0] values, then start[1], ..."""
    if not len(n) or not n.sum():
        return np.zeros(0, np.int64)
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


MESSAGE = "block long, bucket long, kind int, body binary"
_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(_ARROW.names, r)) for r in rows], _ARROW)


class Method:
    """What bytes and words do differently. Places are unit offsets in the block."""

    window: int
    gram: int
    #: whether an earlier equal window of the same document counts
    within: bool

    def sampled(self, texts: Texts) -> Anchors:
        raise NotImplementedError

    def earlier(self, items: Items) -> np.ndarray:
        """For all windows of the items, in order: has it an earlier equal?"""
        raise NotImplementedError

    def cut(self, texts: Texts, start: np.ndarray, n: np.ndarray) -> pa.Table:
        """The result rows, given runs of windows that go (start, number), by unit."""
        raise NotImplementedError

    result: str


@dataclass
class Anchors:
    """Anchors of a block, by place: hash, offset from the first window, number of windows,
    the document, and where the surroundings are in the block's bytes."""

    h: np.ndarray
    first: np.ndarray
    seed: np.ndarray
    n: np.ndarray
    doc: np.ndarray
    byte: np.ndarray
    #: byte offset of every unit, and the end of every unit (None: units are bytes)
    starts: np.ndarray | None
    ends: np.ndarray | None
    data: np.ndarray
    #: hash of every unit, where equal units may have unequal bytes around them (None: bytes tell)
    units: np.ndarray | None = None

    def span(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (first, last) if self.starts is None else (self.starts[first], self.ends[last - 1])


@dataclass
class Items:
    """Surroundings sent to a bucket: document order, row, first unit, seed offset, windows, bytes."""

    id: np.ndarray
    row: np.ndarray
    first: np.ndarray
    seed: np.ndarray
    n: np.ndarray
    at: np.ndarray
    data: np.ndarray
    block: np.ndarray


def earlier_of(cls: np.ndarray, items: Items, within: bool) -> np.ndarray:
    """Whether each window has an equal (same class) in a smaller id or, if ``within``, further ahead."""
    own = np.repeat(np.arange(len(items.n)), items.n)
    ids, rows, start = items.id[own], items.row[own], spread(items.first, items.n)
    order = np.lexsort((start, rows, ids, cls))
    c, i, r = cls[order], ids[order], rows[order]
    head = np.ones(len(c), bool)
    head[1:] = c[1:] != c[:-1]
    least = i[np.flatnonzero(head)][np.cumsum(head) - 1]
    late = i > least
    if within:
        again = np.zeros(len(c), bool)
        again[1:] = (c[1:] == c[:-1]) & (i[1:] == i[:-1]) & (r[1:] == r[:-1])
        late |= again
    out = np.zeros(len(c), bool)
    out[order] = late
    return out


def _announce(method: Method, buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        a = method.sampled(Texts.of(table))
        h, n = np.unique(a.h, return_counts=True)
        edge = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
        short = np.minimum(n, 255).astype(np.uint8)
        low = (h >> np.uint64(16))
        rows = []
        for b in np.flatnonzero(np.diff(edge)).tolist():
            s = slice(edge[b], edge[b + 1])
            rows.append((key[0].as_py(), b, 0, pack(lo=low[s].astype(np.uint32), hi=(low[s] >> np.uint64(32)).astype(np.uint16), n=short[s])))
        return messages(rows)

    return run


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Per block: 0 where a hash is its own only, 1 where others have it, 2 where very many do."""
    blocks = table.column("block").to_pylist()
    parts = [unpack(b, np.uint32, np.uint16, np.uint8) for b in table.column("body").to_pylist()]
    hs = [lo.astype(np.uint64) | hi.astype(np.uint64) << np.uint64(32) for lo, hi, _ in parts]
    every = np.concatenate(hs)
    order = np.argsort(every, kind="stable")
    every, n = every[order], np.concatenate([p[2] for p in parts])[order].astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    blocks_with = np.diff(np.append(head, len(every)))
    verdict = np.where(np.add.reduceat(n, head) > HEAVY, 2, np.where(blocks_with > 1, 1, 0)).astype(np.uint8)
    known = every[head]
    return messages([
        (block, key[0].as_py(), 0, pack(v=verdict[np.searchsorted(known, h)])) for block, h in zip(blocks, hs)
    ])


def hash_spans(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, by prefix sums over pieces of the data."""
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    step = 1 << 17
    order = np.argsort(start, kind="stable")
    s, e = start[order], stop[order]
    i = 0
    while i < len(s):
        base = int(s[i])
        j = max(i + 1, int(np.searchsorted(s, base + step)))
        top = int(e[i:j].max())
        total = np.zeros(top - base + 1, np.uint64)
        np.cumsum(_BYTE[data[base:top]] * _power(_BASE, top - base), out=total[1:])
        inverse = _power(_BASE_INV, top - base + 1)
        out[order[i:j]] = (total[e[i:j] - base] - total[s[i:j] - base]) * inverse[s[i:j] - base]
        i = j
    return mix(out + (stop - start).astype(np.uint64))


def window_hash(units: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """Hash of the ``w`` units from each of the places."""
    out = units[first].copy()
    for i in range(1, w):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += units[first + i]
    return mix(out)


def _equal(a: Anchors, first: np.ndarray, lead: np.ndarray, start: np.ndarray, stop: np.ndarray, split: np.ndarray, w: int) -> np.ndarray:
    """Whether each span holds what its ``lead`` holds: the same bytes, or (``split``) the same units."""
    out = np.ones(len(lead), bool)
    other = np.flatnonzero(lead != np.arange(len(lead)))
    by_unit = other[split[other]] if a.units is not None else other[:0]
    for i in range(w if len(by_unit) else 0):
        out[by_unit] &= a.units[first[by_unit] + i] == a.units[first[lead[by_unit]] + i]
    by_byte = np.setdiff1d(other, by_unit, assume_unique=True)
    for at in range(0, len(by_byte), 4096):  # some spans at a time: they overlap
        some = by_byte[at : at + 4096]
        size, same = stop[some] - start[some], stop[some] - start[some] == stop[lead[some]] - start[lead[some]]
        some, size = some[same], size[same]
        out[by_byte[at : at + 4096][~same]] = False
        if len(some):
            equal = a.data[spread(start[some], size)] == a.data[spread(start[lead[some]], size)]
            out[some] = np.logical_and.reduceat(equal, np.concatenate([[0], np.cumsum(size)[:-1]]))
    return out


def _surroundings(method: Method, buckets: int, answers: int):
    def run(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table):
            return messages([])
        block = key[0].as_py()
        texts = Texts.of(table)
        a = method.sampled(texts)
        known = np.unique(a.h)
        edge = np.searchsorted(bucket_of(known, answers), np.arange(answers + 1))
        verdict = np.zeros(len(known), np.uint8)
        for b, body in zip(told.column("bucket").to_pylist(), told.column("body").to_pylist()):
            verdict[edge[b] : edge[b + 1]] = unpack(body, np.uint8)[0]
        which = np.searchsorted(known, a.h)
        # shared inside the block: by several documents, or (if that counts) at several places
        order = np.lexsort((a.doc, a.h))
        pair = a.h[order][1:] == a.h[order][:-1]
        if not method.within:
            pair &= a.doc[order][1:] != a.doc[order][:-1]
        verdict[which[order][1:][pair]] |= 4
        take = np.flatnonzero(verdict[which])
        heavy = (verdict[which[take]] & 2) > 0
        w = method.window
        # one item per anchor, or one per window of a heavy anchor
        n = np.where(heavy, a.n[take], 1)
        own = np.repeat(take, n)
        split = np.repeat(heavy, n)
        shift = spread(np.zeros(len(n), np.int64), n)
        first = a.first[own] + shift
        count = np.where(split, 1, a.n[own])
        seed = a.seed[own] - shift
        doc = a.doc[own]
        start, stop = a.span(first, first + count - 1 + w)
        kind = hash_spans(a.data, start, stop)
        if a.units is not None and split.any():
            # windows that are sent on their own fold and travel by what is compared, not by white space
            kind[split] = window_hash(a.units, first[split], w)
        kind += count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed.astype(np.uint64)
        order = np.lexsort((first, doc, kind))
        kind, doc, first, count, seed, start, stop, own, split = (x[order] for x in (kind, doc, first, count, seed, start, stop, own, split))
        head = np.ones(len(kind), bool)
        head[1:] = kind[1:] != kind[:-1]
        lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(head) else np.zeros(0, np.int64)
        head |= ~_equal(a, first, lead, start, stop, split, w)  # hashes agree, what they stand for does not
        lead = np.where(head, np.arange(len(head)), lead)
        gone = texts.ids[doc] > texts.ids[doc[lead]]
        if method.within:
            gone |= ~head & (doc == doc[lead])
        rows = [(block, block % buckets, 1, pack(start=first[gone].astype(np.uint32), n=count[gone].astype(np.uint32)))] if gone.any() else []
        keep = np.flatnonzero(~gone)
        to = bucket_of(np.where(split[keep], mix(kind[keep]), mix(a.h[own[keep]])), buckets)
        order = np.argsort(to, kind="stable")
        keep, to = keep[order], to[order]
        edge = np.searchsorted(to, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edge)).tolist():
            k = keep[edge[b] : edge[b + 1]]
            size = stop[k] - start[k]
            rows.append((block, b, 0, pack(
                id=texts.ids[doc[k]], row=doc[k].astype(np.uint32), first=first[k].astype(np.uint32),
                seed=seed[k].astype(np.uint16), n=count[k].astype(np.uint16), size=size.astype(np.uint32),
                data=a.data[spread(start[k], size)],
            )))
        return messages(rows)

    return run


def _decide(method: Method):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows, parts, blocks = [], [], []
        for block, kind, body in zip(*(table.column(c).to_pylist() for c in ("block", "kind", "body"))):
            if kind == 1:
                rows.append((block, key[0].as_py(), 1, body))
            else:
                parts.append(unpack(body, np.int64, np.uint32, np.uint32, np.uint16, np.uint16, np.uint32, np.uint8))
                blocks.append(block)
        if parts:
            id_, row, first, seed, n, size, data = (np.concatenate([p[i] for p in parts]) for i in range(7))
            sent = np.array([len(p[0]) for p in parts])
            items = Items(id_, row.astype(np.int64), first.astype(np.int64), seed.astype(np.int64), n.astype(np.int64),
                          np.concatenate([[0], np.cumsum(size.astype(np.int64))]), data, np.repeat(np.array(blocks), sent))
            late = method.earlier(items)
            own = np.repeat(np.arange(len(items.n)), items.n)
            at = spread(items.first, items.n)[late]
            own = own[late]
            head = np.ones(len(at), bool)
            head[1:] = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])
            lead = np.flatnonzero(head)
            length = np.diff(np.append(lead, len(at)))
            at, block_of = at[lead], items.block[own[lead]]
            for block in np.unique(block_of).tolist():
                mine = block_of == block
                rows.append((block, key[0].as_py(), 1, pack(start=at[mine].astype(np.uint32), n=length[mine].astype(np.uint32))))
        return messages(rows)

    return run


def _finish(method: Method, schema: pa.Schema):
    def run(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table):
            return schema.empty_table()
        runs = [unpack(b, np.uint32, np.uint32) for b in told.column("body").to_pylist()]
        start = np.concatenate([r[0] for r in runs]).astype(np.int64) if runs else np.zeros(0, np.int64)
        n = np.concatenate([r[1] for r in runs]).astype(np.int64) if runs else np.zeros(0, np.int64)
        return method.cut(Texts.of(table), start, n).cast(schema)

    return run


def covered(total: int, start: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which units are in one of the windows that start in the runs."""
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, start + n - 1 + window, -1)
    return np.cumsum(step[:-1]) > 0


def without_repeats(docs: DataFrame, method: Method, id_col: str, text_col: str, schema: pa.Schema) -> DataFrame:
    """Run the rounds over all documents; see the module's text."""
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).isNull().alias("unknown"))
    total = base.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    buckets = max(1, -(-blocks // BLOCKS_PER_BUCKET))
    # One shuffle of the texts serves all three rounds that read them (the plan reuses it).
    deal = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // 8))
    held = base.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).repartition(deal, "block").groupBy("block")
    asked = held.applyInArrow(_announce(method, buckets), MESSAGE)
    told = asked.groupBy("bucket").applyInArrow(_answer, MESSAGE)
    sent = held.cogroup(told.groupBy("block")).applyInArrow(_surroundings(method, blocks, buckets), MESSAGE)
    found = sent.groupBy("bucket").applyInArrow(_decide(method), MESSAGE)
    return held.cogroup(found.groupBy("block")).applyInArrow(_finish(method, schema), method.result)
