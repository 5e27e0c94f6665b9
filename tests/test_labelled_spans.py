"""Preparing and scoring labelled spans."""

import json

import pytest
from pyspark.sql import functions as F

from souqlytics.functions import spans as S
from souqlytics.functions import text as text_functions
from souqlytics.functions.text import normalize, strip
from souqlytics.operators import aspects, trainprep
from souqlytics.sources.files import read_lines


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_validator(spark):
    ex = lambda t, *a: {"review_text": t, "aspects": [{"term": x, "polarity": p} for x, p in a]}
    raw = [
        (0, json.dumps({"examples": [
            ex("good phone", ("screen", "positive")),          # term not there: 1 dropped, text not seen yet
            ex("", ("a", "positive")),                         # no text: 1
            ex("bad case"),                                    # no aspects: 1
        ]})),
        (1, json.dumps([ex(" good phone ", ("phone", "POSITIVE"), ("phone", "great"), ("", "neutral"))])),
        (2, json.dumps([ex("good phone", ("good", "neutral"))])),  # seen: 1
        (3, "no json"), (4, json.dumps({"other": 1})),
    ]
    batches = spark.createDataFrame(raw, "batch int, raw string").select(
        "batch", trainprep.extract_examples(F.col("raw")).alias("examples")
    )
    assert rows(batches, "batch", F.size("examples")) == [(0, 3), (1, 1), (2, 1), (3, 0), (4, 0)]
    assert rows(trainprep.valid_examples(batches), *trainprep.COLUMNS) == [("good phone", "phone", "positive", 5, 10)]
    assert tuple(trainprep.example_counts(batches).first()) == (1, 6)


def test_batch_plan(spark):
    kinds = spark.createDataFrame([(0, "a", ["x"]), (1, "b", []), (2, "c", ["y"])], "pos long, category string, hints array<string>")
    assert rows(trainprep.batch_plan(spark, kinds, 5), "batch", "category") == [(0, "a"), (1, "b"), (2, "c"), (3, "a"), (4, "b")]


TOKENS = """[id@@@1]
[+1]
1\tthe\tO
2\tbattery\tT
3\tlife\tT
4\tis
5\tgood
6\tscreen\tT

[id@@@2]
1\tno\tT
[id@@@3]
[-3]
1\tx\tT
[id@@@4]
[-1]
1\tprice\tT
2\t\tT
"""


def test_token_lines(spark, tmp_path):
    (tmp_path / "a.xml").write_text(TOKENS, encoding="utf-8")
    (tmp_path / "b.xml").write_text("1\tlone\tT\n[0]\n", encoding="utf-8")
    lines = read_lines(spark, str(tmp_path))
    found = trainprep.token_line_targets(lines)
    assert rows(found, "text", "term", "asp_start", "asp_end", "polarity_raw") == [
        ("lone", "lone", 0, 4, "0"), ("price ", "price ", 0, 6, "-1"),
        ("the battery life is good screen", "battery life", 4, 16, "+1"),
        ("the battery life is good screen", "screen", 25, 31, "+1"), ("x", "x", 0, 1, "-3"),
    ]
    assert rows(trainprep.map_polarity(found), "term", "polarity") == [
        ("battery life", "positive"), ("lone", "neutral"), ("price ", "negative"), ("screen", "positive")
    ]
    assert trainprep.token_line_examples(lines).count() == 4


def test_json_lines(spark, tmp_path):
    asp = lambda t, p="positive", **k: {"term": t, "polarity": p, **k}
    lines = [
        {"examples": [{"review_text": "ab ab", "aspects": [asp("ab"), asp("ab"), asp("ab")]}], "category": "k"},
        {"raw": json.dumps({"examples": [{"review_text": "good one", "aspects": [asp("one", "Negative")]}], "category": "in"})},
        {"raw": "{bad"},
        {"review_text": "plain text", "aspects": [asp("text", "odd"), asp("", "positive"), asp("plain", asp_start=0, asp_end=5)]},
        {"review_text": "flat row", "term": "row", "polarity": "neutral", "asp_start": 1, "asp_end": 2},
        {"review_text": " ", "aspects": [asp("x")]},
        {"nothing": 1},
    ]
    body = "\n".join(json.dumps(x) for x in lines) + "\n{broken\n\n"
    (tmp_path / "x.jsonl").write_text(body, encoding="utf-8")
    source = read_lines(spark, str(tmp_path))
    assert rows(trainprep.json_line_examples(source), "review_text", "term", "polarity", "asp_start", "category") == [
        ("ab ab", "ab", "positive", 0, "k"), ("ab ab", "ab", "positive", 3, "k"), ("flat row", "row", "neutral", 5, None),
        ("good one", "one", "negative", 5, "in"), ("plain text", "plain", "positive", 0, None),
    ]
    counts = trainprep.json_line_counts(source).first().asDict()
    assert counts == {
        "total_lines": 8, "json_decode_fail": 1, "no_matching_key": 2, "total_examples": 5, "no_text_or_aspects": 1,
        "total_aspects": 8, "polarity_invalid": 2, "term_not_found": 1, "success": 5,
    }


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(103).select("id", F.when(F.col("id") < 53, "a").otherwise("b").alias("label"))
    first = trainprep.split_rows(df, "label")
    counts = {(r.label, r.split): r["count"] for r in first.groupBy("label", "split").count().collect()}
    assert counts == {("a", "train"): 42, ("a", "validation"): 11, ("b", "train"): 40, ("b", "validation"): 10}
    assert rows(first, "id", "split") == rows(trainprep.split_rows(df.repartition(7), "label"), "id", "split")
    lonely = df.withColumn("label", F.when(F.col("id") == 0, "z").otherwise("a"))
    assert trainprep.split_rows(lonely, "label").filter("split = 'validation'").count() == 21


def labelled(spark):
    return spark.createDataFrame(
        [("good phone", "phone", "positive", 5, 10), ("good phone", "good", "neutral", 0, 4), ("good phone", "good", "neutral", 0, 4),
         ("lost", "x", "negative", -1, -1)],
        "review_text string, term string, polarity string, asp_start int, asp_end int",
    )


def test_labels_spans_and_tags(spark):
    df = labelled(spark)
    assert rows(trainprep.label_shares(df), "polarity", "count", "share") == [
        ("negative", 1, 0.25), ("neutral", 2, 0.5), ("positive", 1, 0.25)
    ]
    assert rows(trainprep.class_weights(df, "polarity", cap=1.0), "polarity", "weight")[:2] == [
        ("negative", 1.0), ("neutral", pytest.approx(2 / 3))
    ]
    tagged = trainprep.tagged_reviews(trainprep.spans_per_review(df)).collect()
    assert [(r.review_text, r.tags) for r in tagged] == [("good phone", [1, 1])]
    assert tuple(trainprep.multi_aspect_reviews(df).first()) == (1, 2)
    assert rows(trainprep.add_label_ids(df), "label_id") == [(0,), (1,), (1,), (2,)]
    more = trainprep.add_extra(df, df, spark.createDataFrame([df.first()] * 9))
    assert more.count() == 8 + 1


def test_scores(spark):
    df = spark.createDataFrame(
        [([1, 2, 0, 1], [1, 2, 0, 0]), ([0, 2, 2, -100], [0, 2, 0, 1]), ([-100, 1, 1], [1, 1, 2])],
        "tags array<int>, predicted array<int>",
    )
    # true: (0,1) (3,3) | (1,2) | (0,0) (1,1); predicted: (0,1) | (1,1) | (0,1)
    out = trainprep.entity_scores(df).first()
    assert (out.hits, out.true_spans, out.predicted_spans) == (1, 5, 3)
    assert out.f1 == pytest.approx(0.25) and out.precision == pytest.approx(1 / 3)
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, predicted int")
    s = trainprep.class_scores(pairs).first()
    assert s.accuracy == 0.5 and s.recall_macro == pytest.approx(0.5) and s.precision_macro == pytest.approx((1 + 1 / 3) / 3)
    assert s.f1_macro == pytest.approx((2 / 3 + 0.5) / 3) and s.f1_weighted == pytest.approx((2 * 2 / 3 + 0.5) / 4)
    tags = rows(trainprep.tag_distribution(df), "kind", "tag", "count")
    assert ("true", 1, 4) in tags and ("predicted", 0, 4) in tags


def test_comment_scoring(spark):
    def keyword_scorer(texts, terms):
        import numpy as np

        good = terms.str.contains("good").to_numpy()
        return np.where(good[:, None], [[0.1, 0.2, 0.7]], [[0.5, 0.5, 0.0]])

    text = "good phone bad good"
    tagged = spark.createDataFrame(
        [(1, text, [(0, 4), (5, 10), (11, 14), (15, 19)], [1, 0, 1, 1]), (2, "none", [(0, 4)], [0])],
        "comment_id long, text string, offsets array<struct<start:int,end:int>>, tags array<int>",
    )
    comments = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, other string")
    out = {r.id: r for r in aspects.score_comments(comments, tagged, keyword_scorer).collect()}
    assert json.loads(out[1].aspects_json) == [
        {"term": "good", "sentiment": "positive", "negative_pct": 10.0, "neutral_pct": 20.0, "positive_pct": 70.0, "mentions": 2},
        {"term": "bad", "sentiment": "negative", "negative_pct": 50.0, "neutral_pct": 50.0, "positive_pct": 0.0, "mentions": 1},
    ]
    assert out[1].num_aspects == 2 and out[2].aspects_json == "[]" and out[3].num_aspects == 0


def expected_places(text, term):
    out, at = [], text.find(term)
    while term and at >= 0:
        out.append(at)
        at = text.find(term, at + len(term))
    return out


TEXTS = [("ab ab ab", "ab"), ("aaa", "aa"), ("aaaaaa", "aa"), ("x", "y"), ("", "y"), ("x", ""), ("شارژ خوب شارژ", "شارژ"), (" ab ab", "ab"),
         ("aXbXaXb", "X"), ("😀a😀a", "a")]


def test_realign_takes_the_nearest_of_any_number_of_places(spark):
    """One and two places without a list of all; the same results as with it."""
    data = [(text, term, f"{pad} {text}", at + len(pad) + 1)
            for text, term in TEXTS for pad in ("", "pad") for at in expected_places(text, term)]
    df = spark.createDataFrame(data, "folded string, term string, text string, start int")
    moved = S.realign(F.col("text"), F.col("folded"), F.col("start"), F.col("start") + F.length("term"), lambda c: c)
    for r in df.withColumn("s", moved).collect():
        goal = r.start / len(r.text) * len(r.folded)
        best = min(expected_places(r.folded, r.term), key=lambda p: (abs(p - goal), p))
        assert (r.s.start, r.s.end) == (best, best + len(r.term)), r


def test_terms_take_their_places_in_turn(spark):
    for text, term in TEXTS:
        items = F.array(*[F.struct(F.lit(term).alias("term"), F.lit("positive").alias("polarity"),
                                   *[F.lit(None).cast("string").alias(c) for c in ("asp_start", "asp_end")]) for _ in range(4)])
        got = spark.createDataFrame([(text,)], "text string").select(trainprep.place_aspects(F.col("text"), items).alias("i")).first().i
        places = [*expected_places(text, term), None, None, None, None][:4]
        assert [x.start for x in got] == places


def test_strip_looks_at_both_ends_only(spark):
    """Long raw texts were searched by a regular expression at every character."""
    plan = spark.createDataFrame([("x",)], "line string").select(strip(F.col("line")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_strip_and_normalize_keep_their_results(spark):
    blanks = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    data = [(f"{b}{b}x {b} y{b}",) for b in blanks] + [("",), (" ",), ("​x​",), (None,)]
    got = [r[0] for r in spark.createDataFrame(data, "t string").select(strip(F.col("t"))).collect()]
    assert got == [t if t is None else t.strip() for (t,) in data]
    words = ["plain text", "a  b", " a", "a ", "aaa", "aab", "x http y", "httpx", "www.x y", "é über", "خوب کتاب", "كتاب", "a,b", "q@r s", "<b>t",
             "a\tb", "a b", "", "12 3", "1000", "a‌b", "Ünï²", None]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    both = df.select(normalize(F.col("t")), text_functions._normalized(F.col("t"))).collect()
    assert [r[0] for r in both] == [r[1] for r in both]


def test_example_counts_with_repeated_places(spark):
    """against a plain loop, with repeated and null batch numbers."""
    asp = lambda n, bad: [{"term": "t", "polarity": "positive"}] * n + [{"term": "no", "polarity": "positive"}] * bad
    data = [(b, [{"review_text": t, "aspects": asp(n, bad)}]) for b, t, n, bad in (
        (3, "t a", 1, 1), (1, "t a", 0, 2), (3, "t a", 2, 0), (4, "t a", 1, 0), (5, "t a", 0, 3), (None, "t b", 1, 1), (2, "t b", 1, 0),
        (2, "", 1, 0), (2, "t c", 0, 0), (9, "t c", 0, 2))]
    batches = spark.createDataFrame(data, f"batch int, examples {trainprep.EXAMPLES}").repartition(3)
    # winners: (3, "t a") twice, (None, "t b")
    assert tuple(trainprep.example_counts(batches).first()) == (1 + 2 + 1, (1 + 2 + 0 + 1 + 1) + (1 + 1) + 1 + (1 + 2))


@pytest.mark.parametrize("size", ["40", "64", "200", "1000000"])
def test_sentences_across_splits(spark, tmp_path, size):
    """sentences that begin in one split and end in others, in several files."""
    expected = []
    for f in ("a", "b"):
        body = [f"{i}\tlead{f}{i}\tT" for i in range(3)] + ["[+1]"]
        expected.append((f"lead{f}0 lead{f}1 lead{f}2", "+1"))
        for k in range(12):
            words = [f"{f}{k}w{i}" for i in range(k)]
            body += [f"[x@@@{k}]"] + (["[0]"] if k % 3 else []) + [f"{i}\t{w}\tT" for i, w in enumerate(words)] + [""]
            if k % 3 and words:
                expected.append((" ".join(words), "0"))
        (tmp_path / f"{f}.txt").write_text("\n".join(body) + "\n", encoding="utf-8")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = trainprep.token_line_targets(read_lines(spark, str(tmp_path)))
        assert rows(found, "text", "polarity_raw") == sorted(expected, key=str)
        assert "rangepartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
