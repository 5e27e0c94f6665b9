"""Column functions on hand-worked values."""

import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from souqlytics.functions import spans, text, vectors
from souqlytics.functions.dates import parse_date
from souqlytics.functions.literals import literal_to_json
from souqlytics.functions.numbers import parse_amount, parse_bool, parse_id


def apply(spark, fn, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    out = df.select("i", fn(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(out, key=lambda r: r["i"])]


def test_amounts(spark):
    given = ["1,200,000 تومان", "۱۲۰۰", "٣٤", "-5", "1e-05", "", "nan", "1.2.3", "12.5", None]
    assert apply(spark, parse_amount, given) == [
        1200000.0, 1200.0, 34.0, 5.0, 105.0, None, None, None, 12.5, None
    ]


def test_ids(spark):
    given = [" 7 ", "7.0", "9007199254740993", "7.5", "x", None, "1e3"]
    assert apply(spark, parse_id, given) == [7, 7, 9007199254740993, None, None, None, 1000]


def test_booleans(spark):
    given = ["دارد", "ندارد", "Yes", "0", "1.0", "maybe", " TRUE ", None]
    assert apply(spark, parse_bool, given) == [True, False, True, False, None, None, True, None]


def test_dates(spark):
    given = [
        "12 فروردین 1402", "3 اردیبهشت 1403", "30 اسفند 1399", "30 اسفند 1402", "22 بهمن 1357",
        "2024-01-05 10:00:00", "abc", "0 مهر 1400", "1402-01-01", None, "1 فروردین 1403",
    ]
    day = lambda *a: datetime(*a)
    assert apply(spark, parse_date, given) == [
        day(2023, 4, 1), day(2024, 4, 22), day(2021, 3, 20), None, day(1979, 2, 11),
        day(2024, 1, 5, 10), None, None, None, None, day(2024, 3, 20),
    ]


def test_normalize(spark):
    cases = {
        "كتاب‌ي": "کتاب ی", "a<b>c</b>": "a c", "see http://x.y/z now": "see now",
        "mail a@b.com x": "mail x", "عاللللی": "عالی", "1000": "10", "!!!؟،": "",
        "a\r\nb c": "ab c", "www.site.ir خوب": "خوب", "@a ok": "a ok", "aab": "aab",
    }
    assert apply(spark, text.normalize, list(cases)) == list(cases.values())
    once = apply(spark, text.normalize, list(cases.values()))
    assert once == list(cases.values())


def test_strip_knows_all_spaces(spark):
    given = ["  a b　", "\x1f x", "   ", "a   b"]
    assert apply(spark, text.strip, given) == [g.strip() for g in given]


def test_email_words_match_plain_regex(spark):
    import re

    given = ["a@b", "@a", "a@", "@@@", "x@y z@ @w q@w@e", "aaaa bbbb", "a@@", "a b@c d"]
    expect = [re.sub(r"\S+@\S+", " ", g) for g in given]
    assert apply(spark, text.drop_emails, given) == expect


def test_aspect_term(spark):
    assert apply(spark, text.aspect_term, ["  کیفیت‌  ساخت ", " ‌ "]) == ["کیفیت ساخت", ""]


def test_raw_text_skips_absent_columns(spark):
    df = spark.createDataFrame([(" a ", None), ("b", "c  d")], "x string, y string")
    out = df.select(text.raw_text(["x", "nope", "y"], df.columns).alias("t")).collect()
    assert [r.t for r in out] == ["a", "b c d"]
    assert df.select(text.raw_text(["nope"], df.columns).alias("t")).first().t == ""
    with pytest.raises(ValueError):
        text.first_text_column(df.columns)


def test_literals(spark):
    given = [
        "['خوب', 'ارزان']", "{'1': 'قیمت'}", "متن", "", None, "[]", "['a',]", "['a' 'b']", "[1, 'x']",
        "12", "True", "he said \"x\"", "[1, 2", "['it\\'s']", "  ['a']  ", "None",
    ]
    got = apply(spark, literal_to_json, given)
    expect = [
        ["خوب", "ارزان"], {"1": "قیمت"}, "متن", None, None, [], ["a"], ["ab"], [1, "x"], 12, True,
        "he said \"x\"", "[1, 2", ["it's"], ["a"], None,
    ]
    assert [g if g is None else json.loads(g) for g in got[:-1]] == expect[:-1]
    assert got[-1] == "null"


def bio(spark, offsets, tags):
    df = spark.createDataFrame(
        [([(s, e) for s, e in offsets], tags)], f"offsets {spans.SPANS}, tags array<int>"
    )
    out = df.select(spans.decode_spans(F.col("offsets"), F.col("tags")).alias("s")).first().s
    return [tuple(x) for x in out]


def walk_spans(offsets, tags):
    """The same rule read token by token."""
    out, cur = [], None
    for (s, e), t in zip(offsets, tags):
        if t == 1 and s != e:
            out += [cur] if cur else []
            cur = (s, e)
        elif t == 2 and cur and s != e:
            cur = (cur[0], e)
        else:
            out += [cur] if cur else []
            cur = None
    return out + ([cur] if cur else [])


def test_decode_spans_against_walk(spark):
    import random

    rnd = random.Random(5)
    cases = [([], []), ([(0, 1)], [2]), ([(0, 1), (2, 3)], [1, 1])]
    for _ in range(25):
        n = rnd.randint(1, 12)
        offsets = [(3 * i, 3 * i + (0 if rnd.random() < 0.15 else 2)) for i in range(n)]
        cases.append((offsets, [rnd.choice([0, 1, 2, 2, -100, 7]) for _ in range(n)]))
    df = spark.createDataFrame(
        [(i, o, t) for i, (o, t) in enumerate(cases)], f"i int, offsets {spans.SPANS}, tags array<int>"
    )
    got = {
        r.i: [tuple(x) for x in r.s]
        for r in df.select("i", spans.decode_spans(F.col("offsets"), F.col("tags")).alias("s")).collect()
    }
    for i, (offsets, tags) in enumerate(cases):
        assert got[i] == walk_spans(offsets, tags), cases[i]


def test_word_offsets_and_tags(spark):
    import re

    given = ["", "  a bb ccc ", "😀 x", "one", None]
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    out = spans.once(df, o=spans.word_offsets(F.col("t"))).orderBy("i").collect()
    for r in out:
        expect = [m.span() for m in re.finditer(r"\S+", r.t or "")]
        assert [tuple(x) for x in r.o] == expect


def test_occurrences(spark):
    df = spark.createDataFrame(
        [("aaaa", "aa"), ("x.y.z", "."), ("abc", "q"), ("", "a"), ("abab", "ab"), ("abc", "")], "t string, w string"
    )
    got = [r.o for r in df.select(spans.occurrences(F.col("t"), F.col("w")).alias("o")).collect()]
    assert got == [[0, 2], [1, 3], [], [], [0, 2], []]


def test_check_or_find(spark):
    rows = [("good day", "day", 5, 8), ("good day", "day", 0, 3), ("good", "x", 0, 1), ("a b a", "a", None, None)]
    df = spark.createDataFrame(rows, "t string, w string, s int, e int")
    got = [
        tuple(r.o) for r in df.select(
            spans.check_or_find(F.col("t"), F.col("w"), F.col("s"), F.col("e")).alias("o")
        ).collect()
    ]
    assert got == [(5, 8), (5, 8), (-1, -1), (0, 1)]


def test_realign_takes_the_nearest_hit(spark):
    rows = [("<b> x </b> and then x", 20, 21), ("x and <i> x", 0, 1), ("gone", -1, -1)]
    df = spark.createDataFrame(rows, "t string, s int, e int").withColumn("n", text.normalize(F.col("t")))
    got = [
        tuple(r.o) for r in df.select(
            spans.realign(F.col("t"), F.col("n"), F.col("s"), F.col("e"), text.normalize).alias("o")
        ).collect()
    ]
    assert got == [(11, 12), (0, 1), (-1, -1)]


def test_vectors(spark):
    df = spark.createDataFrame(
        [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>"
    )
    rows = df.select(vectors.unit(F.col("a")).alias("u"), vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert rows[0].u == [0.6, 0.8] and math.isclose(rows[0].c, 0.96)
    assert rows[1].u == [0.0, 0.0] and rows[1].c == 0.0


def test_parse_whole_rounds_half_to_even(spark):
    from souqlytics.functions.numbers import parse_whole

    df = spark.createDataFrame([("2.5",), ("3.5",), ("1234.7",), ("9007199254740993",), ("x",), (None,), ("-0.5",)], "v string")
    assert [r[0] for r in df.select(parse_whole(F.col("v"))).collect()] == [2, 4, 1235, 9007199254740993, None, None, 0]
    halves = spark.createDataFrame([(2.7,), (1e7,), (2.5,)], "v double")
    assert [r[0] for r in halves.select(parse_whole(F.col("v"))).collect()] == [3, 10_000_000, 2]
