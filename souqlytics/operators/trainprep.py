"""Preparing and scoring labelled-span data.

The common shape is (review_text, term, polarity, asp_start, asp_end) with half-open
character offsets; -1 marks a term that was not found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souqlytics.functions import spans as S
from souqlytics.functions.numbers import ratio
from souqlytics.functions.text import let, normalize, strip
from souqlytics.operators.ranking import lowest
from souqlytics.session import stage
from souqlytics.sources.files import ORDINAL

LABEL_IDS = {"negative": 0, "neutral": 1, "positive": 2}
# Source polarity marks and the class they stand for (fixed values).
POLARITY_MARKS = {
    "-2": "negative", "-1": "negative", "0": "neutral", "+1": "positive", "+2": "positive",
}
SEED = 42
TEST_SHARE = 0.2
SYNTHETIC_SHARE = 0.15
WEIGHT_CAP = 15.0

ASPECT = "struct<term:string,polarity:string,asp_start:string,asp_end:string>"
EXAMPLES = f"array<struct<review_text:string,aspects:array<{ASPECT}>>>"
COLUMNS = ["review_text", "term", "polarity", "asp_start", "asp_end"]


def _is_class(c: Column) -> Column:
    return c.isin(*LABEL_IDS)


def _text(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


# ---- synthetic examples -------------------------------------------------------------


def batch_plan(spark: SparkSession, categories: DataFrame, batches: int) -> DataFrame:
    """Batch i works on category i mod n; ``categories`` is (pos, category, hints)."""
    n = categories.count()
    return (
        spark.range(batches)
        .select(F.col("id").alias("batch"), (F.col("id") % n).alias("pos"))
        .join(categories, "pos")
        .select("batch", "category", "hints")
    )


def extract_examples(raw: Column) -> Column:
    """Examples of ``{"examples": [...]}`` or ``[...]``, else an empty list."""
    text = strip(raw)
    found = F.when(text.startswith("["), F.from_json(text, EXAMPLES)).otherwise(
        F.from_json(text, f"struct<examples:{EXAMPLES}>")["examples"]
    )
    return F.coalesce(found, F.array().cast(EXAMPLES))


def _checked_examples(batches: DataFrame) -> DataFrame:
    """One row per example of (batch, examples) with its acceptable aspects."""
    def aspect(text: Column, a: Column) -> Column:
        term = _text(a["term"])
        at = F.instr(text, term) - 1
        return F.struct(
            term.alias("term"),
            F.lower(_text(a["polarity"])).alias("polarity"),
            at.alias("asp_start"),
            (at + F.length(term)).alias("asp_end"),
        )

    text = F.col("review_text")
    examples = batches.select("batch", F.posexplode_outer("examples").alias("idx", "ex"))
    parts = S.once(
        examples.filter(F.col("idx").isNotNull()),
        review_text=_text(F.col("ex.review_text")),
        aspects=F.coalesce("ex.aspects", F.array().cast(f"array<{ASPECT}>")),
    )
    valid = F.filter(
        F.transform("aspects", lambda a: aspect(text, a)),
        lambda a: (a["term"] != "") & _is_class(a["polarity"]) & (a["asp_start"] >= 0),
    )
    return S.once(parts, valid=valid, n_aspects=F.size("aspects")).drop("ex", "aspects")


def valid_examples(batches: DataFrame) -> DataFrame:
    """Aspects of the first example of each text that has an acceptable one."""
    return (
        _checked_examples(batches)
        .filter((F.col("review_text") != "") & (F.size("valid") > 0))
        .groupBy("review_text")
        .agg(F.min(F.struct("batch", "idx", "valid")).alias("_first"))
        .select("review_text", F.inline("_first.valid"))
        .select(*COLUMNS)
    )


def example_counts(batches: DataFrame) -> DataFrame:
    """Rows kept and dropped, one row.

    An unusable or repeated example counts as one drop, otherwise each bad aspect does.
    """
    checked = stage(
        _checked_examples(batches).select(
            "review_text", "batch", "idx", F.size("valid").alias("n_valid"), "n_aspects",
            F.when(F.col("n_aspects") == 0, 1).otherwise(F.col("n_aspects") - F.size("valid")).alias("bad"),
        ),
        "checked",
    )
    has_text, usable = F.col("review_text") != "", F.col("n_valid") > 0
    # Of each text the examples at its first place with an acceptable aspect, and how many there are in all.
    winners = (
        checked.filter(has_text & usable).groupBy("review_text", "batch", "idx")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_valid").alias("n_valid"), F.sum("bad").alias("bad"))
        .groupBy("review_text")
        .agg(F.min(F.struct("batch", "idx", "n", "n_valid", "bad")).alias("first"), F.sum("n").alias("n"))
        .select("review_text", F.struct("first.batch", "first.idx").alias("winner"), "first.n_valid",
                (F.col("n") - F.col("first.n") + F.col("first.bad")).alias("dropped"))
    )
    place, none = F.struct("batch", "idx"), F.lit(0).cast("long").alias("kept")
    repeated = F.coalesce(place > F.col("winner"), F.lit(False))
    parts = [
        winners.select(F.col("n_valid").alias("kept"), "dropped"),
        checked.filter(has_text & ~usable).join(winners.select("review_text", "winner"), "review_text", "left")
        .select(none, F.when(repeated, 1).otherwise(F.col("bad")).cast("long").alias("dropped")),
        checked.filter(~has_text).select(none, F.lit(1).cast("long").alias("dropped")),
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).agg(
        F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"),
        F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"),
    )


# ---- corpora ------------------------------------------------------------------------


def _realigned(df: DataFrame, fold) -> DataFrame:
    """Offsets moved to the folded text; expects text, asp_start, asp_end.

    A table that already has ``review_text`` is taken to be folded.
    """
    moved = S.realign(
        F.col("text"), F.col("review_text"), F.col("asp_start"), F.col("asp_end"), fold
    )
    if "review_text" not in df.columns:
        df = S.once(df, review_text=fold(F.col("text")))
    return (
        S.once(df, _s=moved)
        .withColumn("asp_start", F.col("_s.start"))
        .withColumn("asp_end", F.col("_s.end"))
        .drop("_s")
    )


def located_pairs(pairs: DataFrame, fold=normalize) -> DataFrame:
    """(text, term, polarity, from, to) with checked, repaired, realigned offsets."""
    span = S.check_or_find(
        F.col("text"), F.col("term"), F.col("from").try_cast("int"), F.col("to").try_cast("int")
    )
    located = pairs.withColumn("_s", span).withColumns(
        {"asp_start": F.col("_s.start"), "asp_end": F.col("_s.end")}
    )
    return _realigned(located, fold).select(*COLUMNS)


def _openers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to the lines of a scan the ``seq`` of the last opening line in front of them in their split."""
    split, last, seen = None, -1, -1
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        seq = table["seq"].to_numpy()
        files, blocks = table["file"].combine_chunks().dictionary_encode(), table["block"].to_numpy()
        codes = files.indices.to_numpy()
        if np.any(np.diff(seq, prepend=seen) <= 0):
            raise ValueError("lines have to come in the order of their scan")
        seen = seq[-1]
        change = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
        opener = np.where(table["opens"].to_numpy(), seq, -1)
        for start, end in zip(np.concatenate(([0], change)), np.concatenate((change, [len(seq)]))):
            here = (files.dictionary[codes[start]].as_py(), blocks[start])
            last = last if here == split else -1
            split = here
            opener[start:end] = np.maximum(np.maximum.accumulate(opener[start:end]), last)
            last = opener[end - 1]
        out = table.drop_columns(["opens"]).append_column("opener", pa.array(opener))
        yield from out.combine_chunks().to_batches()


def token_line_sentences(lines: DataFrame) -> DataFrame:
    """(file, sentence, polarity_raw, words) from token-per-line text in the order of its scan.

    A ``[..@@@..]`` line opens a sentence, whose number is the place of that line in the scan. It
    is carried along the lines of a split; where a split begins inside a sentence, one row
    per split tells which. No line is sorted. Lines in front of a file's first marker are a
    sentence too (a negative number). Sentences without a polarity line are left out before
    anything is gathered.
    """
    line = F.col("line")
    bracket = line.startswith("[") & line.endswith("]") & ~F.contains(line, F.lit("\t"))
    opens = bracket & F.contains(line, F.lit("@@@"))
    place = F.col(ORDINAL)
    cells = F.split("line", "\t")
    marked = lines.filter(strip(line) != "").select(
        "file", place["block"].alias("block"), place["seq"].alias("seq"), bracket.alias("bracket"), opens.alias("opens"),
        F.when(bracket, ~opens).alias("is_label"), F.when(bracket, line).alias("line"),
        F.when(~bracket, F.coalesce(F.get(cells, F.lit(1)), F.lit(""))).alias("word"),
        F.coalesce(F.get(cells, F.lit(2)) == "T", F.lit(False)).alias("target"),
    )
    # One row per split of a file: what is open where it begins.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = F.broadcast(
        marked.groupBy("file", "block").agg(F.min("seq").alias("first"), F.max(F.when(F.col("opens"), F.col("seq"))).alias("last"))
        .select("file", "block", F.coalesce(F.last("last", ignorenulls=True).over(earlier), -1 - F.first("first").over(
            Window.partitionBy("file").orderBy("block"))).alias("head"))
    )

    def numbered(some: DataFrame, *columns: str) -> DataFrame:
        kept = some.select("file", "block", "seq", "opens", *columns)
        fields = ", ".join(f"{c} {t}" for c, t in kept.dtypes if c != "opens")
        return kept.mapInArrow(_openers, f"{fields}, opener long").join(heads, ["file", "block"]).withColumn(
            "sentence", F.when(F.col("opener") >= 0, F.col("opener")).otherwise(F.col("head")))

    # Lines in brackets are few and hold all that labels need.
    labels = (
        numbered(marked.filter("bracket"), "is_label", "line").filter("is_label").groupBy("sentence")
        .agg(F.max_by("line", F.struct("block", "seq")).alias("_l"), F.first("file").alias("file"))
        .select("file", "sentence", strip(F.translate("_l", "[]", "")).alias("polarity_raw"))
    )
    groups = stage(labels, "sentences")
    word = F.struct("block", "seq", "word", "target")
    words = (
        numbered(marked.filter("opens OR NOT bracket"), "word", "target").filter("word IS NOT NULL").select("sentence", "block", "seq", "word", "target")
        .join(groups.select("sentence"), "sentence", "left_semi")
        .groupBy("sentence").agg(F.sort_array(F.collect_list(word)).alias("words"))
    )
    return groups.join(words, "sentence", "left").select(
        "file", "sentence", "polarity_raw", F.coalesce("words", F.array()).alias("words"))


def target_spans(words: Column) -> Column:
    """Character spans of the runs of target words in the blank-joined text."""
    def closed(acc: Column) -> Column:
        return F.when(
            acc["start"].isNotNull(),
            F.array_append(
                acc["spans"], F.struct(acc["start"].alias("start"), acc["end"].alias("end"))
            ),
        ).otherwise(acc["spans"])

    def step(acc: Column, w: Column) -> Column:
        end = acc["pos"] + F.length(w["word"])
        return F.struct(
            (end + 1).alias("pos"),
            F.when(w["target"], F.coalesce(acc["start"], acc["pos"])).alias("start"),
            F.when(w["target"], end).alias("end"),
            F.when(w["target"], acc["spans"]).otherwise(closed(acc)).alias("spans"),
        )

    nothing = F.lit(None).cast("int")
    initial = F.struct(
        F.lit(0).alias("pos"), nothing.alias("start"), nothing.alias("end"),
        F.array().cast(S.SPANS).alias("spans"),
    )
    return F.aggregate(words, initial, step, closed)


def token_line_targets(lines: DataFrame) -> DataFrame:
    """One row per target of a sentence that has a polarity."""
    return (
        token_line_sentences(lines)
        .filter(F.col("polarity_raw") != "")
        .withColumn("text", F.array_join(F.transform("words", lambda w: w["word"]), " "))
        .withColumn("span", F.explode_outer(target_spans(F.col("words"))))
        .filter(F.col("span").isNotNull())
        .select(
            "text",
            F.substring(
                F.col("text"), F.col("span.start") + 1, F.col("span.end") - F.col("span.start")
            ).alias("term"),
            F.col("span.start").alias("asp_start"),
            F.col("span.end").alias("asp_end"),
            "polarity_raw",
        )
    )


def map_polarity(df: DataFrame) -> DataFrame:
    """Marks outside the map are dropped."""
    mark = F.col("polarity_raw")
    polarity = F.lit(None).cast("string")
    for source, target in POLARITY_MARKS.items():
        polarity = F.when(mark == source, target).otherwise(polarity)
    return df.withColumn("polarity", polarity).filter(F.col("polarity").isNotNull())


def token_line_examples(lines: DataFrame, fold=normalize) -> DataFrame:
    """P05, P06, P09 in a row."""
    return (
        _realigned(map_polarity(token_line_targets(lines)), fold)
        .filter(F.col("asp_start") >= 0)
        .withColumn("term", _cut("review_text", "asp_start", "asp_end"))
        .select(*COLUMNS)
    )


def _cut(text: str, start: str, end: str) -> Column:
    return F.substring(F.col(text), F.col(start) + 1, F.col(end) - F.col(start))


# ---- JSON lines ---------------------------------------------------------------------

LINE = (
    f"struct<examples:{EXAMPLES},raw:string,category:string,review_text:string,"
    f"aspects:array<{ASPECT}>,term:string,polarity:string,asp_start:string,asp_end:string>"
)


def place_aspects(text: Column, aspects: Column) -> Column:
    """Each aspect in order gets its given span or the first free occurrence.

    Result items are (state, term, polarity, start, end); a span counts as taken from
    then on.
    """
    def free(used: Column, start: Column, size: Column) -> Column:
        return ~F.exists(used, lambda u: (start < u["end"]) & (start + size > u["start"]))

    def first_free(used: Column, term: Column, size: Column) -> Column:
        """Most terms are free at their first or second place; only others need all places."""
        def of_all() -> Column:
            return F.get(F.filter(S.occurrences(text, term), lambda p: free(used, p, size)), F.lit(0))

        def second(at: Column) -> Column:
            return F.when(at < 0, None).when(free(used, at, size), at).otherwise(of_all())

        def first(at: Column) -> Column:
            return F.when(at < 0, None).when(free(used, at, size), at).otherwise(
                let(S.next_place(text, term, at + size), second)
            )

        return F.when(F.contains(text, F.lit(S.MARK)), of_all()).when(size > 0, let(F.instr(text, term) - 1, first))

    def tidy(a: Column) -> Column:
        return F.struct(
            _text(a["term"]).alias("term"), F.lower(_text(a["polarity"])).alias("polarity"),
            a["asp_start"].try_cast("int").alias("start"), a["asp_end"].try_cast("int").alias("end"),
        )

    def step(acc: Column, a: Column) -> Column:
        term, start, end = a["term"], a["start"], a["end"]
        size = F.length(term)
        given = F.coalesce(
            (start >= 0) & (start < end) & (end <= F.length(text))
            & (F.substring(text, start + 1, end - start) == term),
            F.lit(False),
        )
        hit = first_free(acc["used"], term, size)
        usable = (term != "") & _is_class(a["polarity"])
        at = F.when(usable, F.when(given, start).otherwise(hit))
        state = F.when(~usable, "polarity_invalid").when(at.isNull(), "term_not_found").otherwise("ok")
        placed = F.struct(at.alias("start"), (at + size).alias("end"), state.alias("state"))
        # A one-element list names the result, so that it is worked out once.
        return F.get(
            F.transform(F.array(placed), lambda x: F.struct(
                F.when(
                    x["start"].isNotNull(),
                    F.array_append(
                        acc["used"], F.struct(x["start"].alias("start"), x["end"].alias("end"))
                    ),
                ).otherwise(acc["used"]).alias("used"),
                F.array_append(
                    acc["items"],
                    F.struct(
                        x["state"].alias("state"), term.alias("term"),
                        a["polarity"].alias("polarity"), x["start"].alias("start"),
                        x["end"].alias("end"),
                    ),
                ).alias("items"),
            )),
            F.lit(0),
        )

    items = "array<struct<state:string,term:string,polarity:string,start:int,end:int>>"
    initial = F.struct(
        F.array().cast(S.SPANS).alias("used"), F.array().cast(items).alias("items")
    )
    return F.aggregate(F.transform(aspects, tidy), initial, step, lambda acc: acc["items"])


def _json_examples(lines: DataFrame) -> DataFrame:
    """One row per line with its state, category and examples, whatever its shape."""
    def has(*names: str) -> Column:
        out = F.lit(True)
        for n in names:
            out &= F.array_contains("keys", n)
        return out

    flat = F.struct("o.term", "o.polarity", "o.asp_start", "o.asp_end")
    single = F.struct(
        F.col("o.review_text").alias("review_text"), F.array(flat).alias("aspects")
    )
    whole = F.struct(F.col("o.review_text").alias("review_text"), F.col("o.aspects").alias("aspects"))
    none = F.array().cast(EXAMPLES)
    # Each line is cut and parsed once, however many columns ask for it.
    text = S.once(lines.select("line"), line=strip(F.col("line"))).filter("line <> ''")
    parsed = S.once(
        text, o=F.from_json("line", LINE), decoded=F.try_parse_json("line").isNotNull(),
        keys=F.coalesce(F.json_object_keys("line"), F.array().cast("array<string>")),
    )
    shaped = (
        parsed.select(
            "o", "decoded",
            F.when(has("examples"), "examples")
            .when(has("raw"), "raw")
            .when(has("review_text", "aspects"), "aspects")
            .when(has("review_text", "term", "polarity"), "flat")
            .alias("shape"),
        )
        .withColumn("raw_ok", (F.col("shape") == "raw") & F.try_parse_json("o.raw").isNotNull())
        .withColumn(
            "state",
            F.when(~F.col("decoded"), "json_decode_fail")
            .when(
                F.col("shape").isNull() | ((F.col("shape") == "raw") & ~F.col("raw_ok")),
                "no_matching_key",
            )
            .otherwise("ok"),
        )
    )
    return (
        S.once(shaped, inner=F.when(F.col("shape") == "raw", F.from_json("o.raw", f"struct<examples:{EXAMPLES},category:string>")))
        .select(
            "state",
            F.when(
                F.col("shape") == "raw", F.coalesce(F.nullif("o.category", F.lit("")), F.col("inner.category"))
            )
            .otherwise(F.col("o.category"))
            .alias("category"),
            F.coalesce(
                F.when(F.col("state") != "ok", none)
                .when(F.col("shape") == "examples", F.col("o.examples"))
                .when(F.col("shape") == "raw", F.col("inner.examples"))
                .when(F.col("shape") == "aspects", F.array(whole))
                .otherwise(F.array(single)),
                none,
            ).alias("examples"),
        )
    )


def _placed(lines: DataFrame, fold) -> DataFrame:
    """One row per line x example x aspect; empty levels leave one row with nulls."""
    rows = (
        _json_examples(lines)
        .select("state", "category", F.posexplode_outer("examples").alias("ei", "ex"))
        .select(
            "state", "category", "ei",
            F.when(F.col("ei").isNotNull(), _text(F.col("ex.review_text"))).alias("text"),
            F.coalesce("ex.aspects", F.array().cast(f"array<{ASPECT}>")).alias("aspects"),
        )
        .withColumn("usable", (F.col("text") != "") & (F.size("aspects") > 0))
    )
    placed = F.when(F.col("usable"), place_aspects(F.col("text"), F.col("aspects")))
    items = (
        S.once(S.once(rows, text=F.col("text"), review_text=fold(F.col("text"))), items=placed)
        .select(
            "state", "category", "ei", "text", "review_text", "usable",
            F.posexplode_outer("items").alias("ai", "i"),
        )
        .select(
            "state", "category", "ei", "text", "review_text", "usable", "ai",
            F.col("i.state").alias("item_state"),
            F.col("i.polarity").alias("polarity"), F.col("i.start").alias("asp_start"),
            F.col("i.end").alias("asp_end"),
        )
    )
    moved = _realigned(items, fold)
    lost = (F.col("item_state") == "ok") & (F.col("asp_start") < 0)
    return moved.withColumn(
        "item_state", F.when(lost, "term_not_found").otherwise(F.col("item_state"))
    )


def json_line_examples(lines: DataFrame, fold=normalize) -> DataFrame:
    """Labelled spans of every readable line, with the line's category."""
    return (
        _placed(lines, fold)
        .filter(F.col("item_state") == "ok")
        .withColumn("term", _cut("review_text", "asp_start", "asp_end"))
        .select(*COLUMNS, "category")
    )


def json_line_counts(lines: DataFrame, fold=normalize) -> DataFrame:
    """The nine load counters, one row."""
    rows = _placed(lines, fold)
    first_aspect = F.coalesce(F.col("ai"), F.lit(0)) == 0
    new_line = first_aspect & (F.coalesce(F.col("ei"), F.lit(0)) == 0)
    new_example = first_aspect & F.col("ei").isNotNull()
    is_aspect = F.col("ai").isNotNull()
    return rows.agg(
        F.count_if(new_line).alias("total_lines"),
        F.count_if(new_line & (F.col("state") == "json_decode_fail")).alias("json_decode_fail"),
        F.count_if(new_line & (F.col("state") == "no_matching_key")).alias("no_matching_key"),
        F.count_if(new_example).alias("total_examples"),
        F.count_if(new_example & ~F.col("usable")).alias("no_text_or_aspects"),
        F.count_if(is_aspect).alias("total_aspects"),
        *[
            F.count_if(is_aspect & (F.col("item_state") == state)).alias(name)
            for state, name in (
                ("polarity_invalid", "polarity_invalid"), ("term_not_found", "term_not_found"),
                ("ok", "success"),
            )
        ],
    )


# ---- splits, labels, tags -----------------------------------------------------------


def _hashed(df: DataFrame, seed: int, order: Column | None = None) -> DataFrame:
    """Rows on disk with a seeded hash and, for copies, a hash of their place there."""
    placed = df.withColumn("_h", F.xxhash64(*df.columns, F.lit(seed)) if order is None else order.cast("long")).withColumn("_tie", F.monotonically_increasing_id())
    return stage(placed.withColumn("_tie", F.xxhash64("_tie", F.lit(seed))), "hashed")


def split_rows(
    df: DataFrame, label: str, share: float = TEST_SHARE, seed: int = SEED, test: float = 0.0,
    order: Column | None = None,
) -> DataFrame:
    """P10: column ``split``: per label the share of rows with the lowest seeded hash is held out.

    Of the rows held out the share ``test``, again those with the lowest hash and over all labels,
    is ``test``, the rest ``validation``. The first cut falls back to an overall one when a label
    has a single row. ``order`` stands in for the hash. Labels are few; rows are not sorted or joined.
    """
    hashed = _hashed(df, seed, order)
    sizes = {r[0]: r[1] for r in hashed.groupBy(label).agg(F.count(F.lit(1))).collect()}
    if sizes and min(sizes.values()) >= 2:
        quotas = {g: math.floor(n * share + 0.5) for g, n in sizes.items()}
        group = F.col(label)
    else:
        quotas, group = {0: math.ceil(sum(sizes.values()) * share)}, F.lit(0)
    held = lowest(hashed, group, ["_h", "_tie"], quotas)
    out = F.when(held, "validation").otherwise("train")
    if test:
        part = lowest(hashed.filter(held), F.lit(0), ["_h", "_tie"], {0: math.floor(sum(quotas.values()) * test + 0.5)})
        out = F.when(held & part, "test").otherwise(out)
    return hashed.withColumn("split", out).select(*df.columns, "split")


def add_extra(
    train: DataFrame, extra: DataFrame | None = None, synthetic: DataFrame | None = None,
    share: float = SYNTHETIC_SHARE, seed: int = SEED,
) -> DataFrame:
    """Real extra rows, then synthetic rows (lowest hash first) up to a share of what is there."""
    out = train.select(*COLUMNS)
    if extra is not None:
        out = out.unionByName(extra.select(*COLUMNS))
    if synthetic is not None:
        out = stage(out, "train")  # counted, then read: worked out once
        hashed = _hashed(synthetic.select(*COLUMNS), seed)
        allowed = min(int(out.count() * share), hashed.count())
        out = out.unionByName(hashed.filter(lowest(hashed, F.lit(0), ["_h", "_tie"], {0: allowed})).select(*COLUMNS))
    return out


def add_label_ids(df: DataFrame) -> DataFrame:
    """P12."""
    out = F.lit(None).cast("int")
    for name, number in LABEL_IDS.items():
        out = F.when(F.col("polarity") == name, number).otherwise(out)
    return df.withColumn("label_id", out)


def label_shares(df: DataFrame, label: str = "polarity") -> DataFrame:
    """Rows and share of the whole per label."""
    known = df.filter(F.col(label).isNotNull())
    total = known.select(F.count(F.lit(1))).scalar()
    counts = known.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("share", ratio(F.col("count"), total))


def spans_per_review(df: DataFrame) -> DataFrame:
    """Sorted distinct spans per review; copies are removed before collecting."""
    return (
        df.filter(F.col("asp_start") != -1)
        .select("review_text", "asp_start", "asp_end")
        .distinct()
        .groupBy("review_text")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        F.col("asp_start").cast("int").alias("start"),
                        F.col("asp_end").cast("int").alias("end"),
                    )
                )
            ).alias("asp_spans")
        )
    )


def tagged_reviews(reviews: DataFrame) -> DataFrame:
    """(review_text, asp_spans) with white-space word offsets and their BIO tags."""
    words = S.once(reviews, offsets=S.word_offsets(F.col("review_text")))
    return S.once(words, tags=S.tag_tokens(F.col("offsets"), F.col("asp_spans")))


def class_weights(df: DataFrame, label: str, classes: int = 3, cap: float = WEIGHT_CAP) -> DataFrame:
    """N / (classes * n_c), capped."""
    known = df.filter(F.col(label).isNotNull())
    total = known.select(F.count(F.lit(1))).scalar()
    counts = known.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    weight = total.cast("double") / (F.col("count") * classes)
    return counts.select(label, "count", F.least(weight, F.lit(cap)).alias("weight"))


# ---- scores -------------------------------------------------------------------------


def _or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return _or_zero(p * r * 2, p + r)


def entity_scores(df: DataFrame) -> DataFrame:
    """Exact-match precision, recall and F1 over (tags, predicted), one row.

    There is one entity type, so macro and micro F1 are the same number.
    """
    pairs = F.filter(
        F.arrays_zip(F.col("tags").alias("t"), F.col("predicted").alias("p")),
        lambda x: x["t"] != S.TAG_IGNORE,
    )
    kept = df.select(pairs.alias("pairs")).select(
        F.transform("pairs", lambda x: x["t"]).alias("t"),
        F.transform("pairs", lambda x: x["p"]).alias("p"),
    )
    runs = kept.select(S.entity_runs(F.col("t")).alias("t"), S.entity_runs(F.col("p")).alias("p"))
    sums = runs.agg(
        F.sum(F.size(F.array_intersect("t", "p"))).alias("hits"),
        F.sum(F.size("t")).alias("true_spans"),
        F.sum(F.size("p")).alias("predicted_spans"),
    )
    precision = _or_zero(F.col("hits"), F.col("predicted_spans"))
    recall = _or_zero(F.col("hits"), F.col("true_spans"))
    return sums.withColumns({"precision": precision, "recall": recall}).withColumns(
        {
            "f1": _f1(F.col("precision"), F.col("recall")),
            "f1_macro": _f1(F.col("precision"), F.col("recall")),
        }
    )


def class_scores(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Accuracy, macro and weighted F1, macro precision and recall, one row."""
    confusion = df.groupBy(F.col(label).alias("t"), F.col(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("t").alias("c"), F.col("n").alias("support"), zero.alias("called"),
            hit.cast("long").alias("hits"),
        ),
        F.struct(F.col("p").alias("c"), zero.alias("support"), F.col("n").alias("called"), zero.alias("hits")),
    )
    per_class = (
        confusion.select(F.inline(sides))
        .groupBy("c")
        .agg(*[F.sum(x).alias(x) for x in ("support", "called", "hits")])
        .withColumn("precision", _or_zero(F.col("hits"), F.col("called")))
        .withColumn("recall", _or_zero(F.col("hits"), F.col("support")))
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    )
    return per_class.agg(
        _or_zero(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        _or_zero(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
    )


def tag_distribution(df: DataFrame) -> DataFrame:
    """True and predicted tags counted, ignored tokens excluded."""
    pair = F.arrays_zip(F.col("tags").alias("t"), F.col("predicted").alias("p"))
    kinds = F.array(
        F.struct(F.lit("true").alias("kind"), F.col("x.t").alias("tag")),
        F.struct(F.lit("predicted").alias("kind"), F.col("x.p").alias("tag")),
    )
    return (
        df.select(F.explode(pair).alias("x"))
        .filter(F.col("x.t") != S.TAG_IGNORE)
        .select(F.inline(kinds))
        .groupBy("kind", "tag")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def untagged_reviews(tagged: DataFrame) -> DataFrame:
    """Reviews without any aspect tag, one row."""
    has_aspect = F.exists("tags", lambda t: t.isin(S.TAG_B, S.TAG_I))
    return tagged.agg(
        F.count_if(~has_aspect).alias("without_aspect"), F.count(F.lit(1)).alias("reviews")
    )


def multi_aspect_reviews(df: DataFrame) -> DataFrame:
    """Reviews with more than one distinct term, one row."""
    terms = df.groupBy("review_text").agg(F.countDistinct("term").alias("terms"))
    return terms.agg(
        F.count_if(F.col("terms") > 1).alias("multi_aspect"), F.count(F.lit(1)).alias("reviews")
    )
