"""Each operator against a plain version on small tables with nulls, empties, ties and repeats."""

import hashlib
import itertools
import re

import duckdb
import numpy as np
import pytest

from souqlytics.llm import (
    decontaminate, exact_dedup, html_text, line_dedup, mixing, near_dedup, repeats, substring_dedup, suffix_dedup, toxicity, warc,
)

SF = "/root/testdata/sf0.001"
# columns with the names operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, label string, _text string, block long, recipe string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 7, "k", "l", "x", 1, "r") for i, t, s in rows], SCHEMA)


WORDS = [f"w{i}" for i in range(300)]
LONG = " ".join(WORDS)
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (3, None, "b"), (4, "", None), (5, "one two", "b"), (6, "One two", None),
    (7, LONG.replace("w150", "x"), "a"), (8, " ".join(WORDS[50:90]) + " tail", "c"), (9, "same line\n" * 40, "a"), (10, "café ß 漢字 " * 30, "c"),
    (11, "z" * 200_000, "b"), (12, "  \t\n", "b"),
]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_suffix_dedup(docs, none, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(repeats, "HEAVY", 2)
    seen, want = {}, []
    for i, t, _ in sorted(ROWS, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    assert rows_of(suffix_dedup.suffix_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_substring_dedup(docs, none, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(repeats, "HEAVY", 2)
    seen, want = {}, []
    for n, (i, t, _) in enumerate(sorted(ROWS, key=lambda r: r[0])):
        w = words(t)
        gone = [0] * len(w)
        for k in range(len(w) - 19):
            first = seen.setdefault(tuple(w[k : k + 20]), (i, n, k))
            if first[0] < i or first[1] == n and first[2] < k:
                gone[k : k + 20] = [1] * 20
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    assert rows_of(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert substring_dedup.substring_dedup(none).count() == 0


def test_substring_dedup_heavy_in_many_forms(spark, monkeypatch):
    """A frequent passage whose white space differs, over many blocks and buckets."""
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(repeats, "HEAVY", 10)
    passage = [f"p{k}" for k in range(40)]
    forms = [" ".join(passage), "  ".join(passage), "\t".join(passage), "\n".join(" ".join(passage[k : k + 7]) for k in range(0, 40, 7))]
    rows = [(i, f"own{i} {forms[i % 4]} end{i}", "a") for i in range(60)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {i: (42, 40, sha(f"own{i} end{i}")) for i in range(1, 60)} | {0: (42, 0, sha(" ".join(words(rows[0][1]))))}
    assert got == want


@pytest.mark.parametrize("collide", [False, True])
def test_exact_dedup(docs, none, collide):
    from pyspark.sql import functions as F

    got = exact_dedup.exact_dedup(docs, fingerprint=(lambda c: F.length(c).cast("long")) if collide else F.xxhash64)
    want = []
    for i, t, _ in ROWS:
        group = [j for j, u, _ in ROWS if (u or "") == (t or "")]
        want.append((i, max(group), len(group), i == max(group), hashlib.sha256((t or "").encode()).hexdigest()))
    if not collide:
        assert rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    else:  # one fingerprint for different contents of one length
        assert {r[:2] for r in rows_of(got, "doc_id", "keep_id")} == {w[:2] for w in want}
    assert exact_dedup.exact_dedup(none).count() == 0
    assert sorted(r.doc_id for r in exact_dedup.keep_one(docs).collect()) == [2, 2, 4, *range(5, 13)]


def test_chunks_are_lossless(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t or "",) for _, t, _ in ROWS], "text string")
    assert df.filter(F.array_join(exact_dedup.chunks_of(F.col("text")), "") != F.col("text")).count() == 0


def shingle_set(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_classes(rows):
    label = {i: i for i, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for (a, s), (b, t) in itertools.combinations(rows, 2):
        x, y = shingle_set(s), shingle_set(t)
        if (s or "") == (t or "") or (x and y and len(x & y) >= 0.8 * len(x | y)):
            lo, hi = sorted((root(a), root(b)))
            label[hi] = lo
    return {i: root(i) for i in label}


def test_near_dedup(spark, docs, none):
    want = near_classes([(i, t) for i, t, _ in ROWS])
    assert set(rows_of(near_dedup.near_dedup(docs), "doc_id", "class_id")) == set(want.items())
    assert near_dedup.near_dedup(none).count() == 0
    # copies of one text with edits of their own: linked through the text, not to each other
    base = [f"b{k}" for k in range(400)]
    many = [(100, " ".join(base))]
    for c in range(12):
        copy = list(base)
        for e in range(6):
            copy[(c * 31 + e * 61) % 400] = f"n{c}_{e}"
        many.append((200 + c, " ".join(copy)))
    got = near_dedup.near_dedup(frame(spark, [(i, t, "a") for i, t in many]))
    assert {r.doc_id: r.class_id for r in got.collect()} == near_classes(many)


def test_near_copies_with_repeats(spark):
    """Copies with an added passage that is repeated many times: the sets are alike, the counts are not."""
    rows = []
    for c in range(20):
        text = " ".join(f"c{c}b{k}" for k in range(200))
        rows += [(2 * c, text), (2 * c + 1, text + " " + " ".join([" ".join(f"c{c}r{k}" for k in range(30))] * 300))]
    got = near_dedup.near_dedup(frame(spark, [(i, t, "a") for i, t in rows]))
    assert {r.doc_id: r.class_id for r in got.collect()} == near_classes(rows) == {i: i - i % 2 for i, _ in rows}


def test_hashes_do_not_decide(spark):
    """Words whose polynomials agree modulo 2^64, and the largest id."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = "".join("ba"[bin(i).count("1") % 2] for i in range(1024))
    rest = [f"w{i}" for i in range(13)]
    last = 2**63 - 1
    rows = [(1, " ".join([*rest, a, *rest]), "a"), (2, " ".join([*rest, b, *rest]), "a"), (last, "z " * 60, "a"), (None, "z " * 60, "a")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    assert got == {1: (27, 0), 2: (27, 0), last: (60, 59), None: (60, 59)}
    assert {r.doc_id for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()} == {1, 2, last, None}


def test_places_of_very_long_texts(monkeypatch):
    rng = np.random.default_rng(2)
    grams, left = rng.integers(0, 2**63, 3000).astype(np.uint64), np.arange(3000, 0, -1)

    def windows():
        at, first, last = repeats.anchors(grams, left, 50, 8)
        return {s: int(p) for p, a, b in zip(at, first, last) for s in range(a, b + 1)}

    want = windows()
    monkeypatch.setattr(repeats, "_PLACE", 10)
    got = windows()
    assert set(got) == set(want)
    # the low bits give way to places: another of nearly equal hashes may win, always the same one for equal windows
    assert sum(got[s] == want[s] for s in want) > 0.99 * len(want)


@pytest.mark.parametrize("kind", ["smallint", "string", "date", "decimal(5,0)"])
def test_item_ids_of_any_type(spark, kind):
    texts = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    value = "date'2024-01-02'" if kind == "date" else "7"
    items = texts.selectExpr(f"cast({value} as {kind}) as item_id", "text")
    got = decontaminate.find_leaks(texts, items)
    assert dict(got.dtypes)["item_id"] == kind
    assert [(r.doc_id, r.shared) for r in got.collect()] == [(1, 2)]


def test_line_dedup(spark, docs, none):
    got = {r.doc_id: r.removed for r in line_dedup.line_dedup(docs).collect()}
    assert got[1] == [] and got[2] == [0] and got[3] == [] and got[6] == [0]  # case is folded
    assert got[7] == [0]  # one word of 300 differs
    assert got[9] == list(range(1, 40)) and got[12] == []
    text = {r.doc_id: r.text for r in line_dedup.without_lines(docs, line_dedup.line_dedup(docs)).collect()}
    assert text[9] == "same line\n" and text[3] is None and text[1] == LONG
    assert line_dedup.line_dedup(none).count() == 0


def test_lines_link_as_defined(spark):
    """Against all pairs with an edit similarity of 0.8."""
    import random
    import string

    rng = random.Random(5)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(6))
    base = [word() for _ in range(150)]
    lines = [" ".join(base)]
    for n in (1, 1, 2, 2, 3, 60):
        copy = list(base)
        for _ in range(n):
            copy[rng.randrange(150)] = word()
        lines.append(" ".join(copy))
    lines += [" ".join(word() for _ in range(12)) for _ in range(20)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    label = list(range(len(lines)))
    for i, j in itertools.combinations(range(len(lines)), 2):
        if distance(lines[i], lines[j]) <= 0.2 * max(map(len, (lines[i], lines[j]))):
            low, high = sorted((label[i], label[j]))
            label = [low if v == high else v for v in label]
    want = {i: [] if label[i] == i else [0] for i in range(len(lines))}
    got = {r.doc_id: r.removed for r in line_dedup.line_dedup(frame(spark, [(i, t, "a") for i, t in enumerate(lines)])).collect()}
    assert got == want and any(want[i] for i in range(1, 6)) and not want[6]


def test_lines_recall(spark):
    """Lines of 8 to 30 words against a copy edited in one or two places, edit similarity 0.8 or more."""
    import random
    import string
    from difflib import SequenceMatcher

    rng = random.Random(8)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 8)))

    def edited(line, how):
        w, at = list(line), rng.randrange(len(line))
        if how == "changed":
            w[at] = word()
        elif how == "twice":
            w[at], w[rng.randrange(len(w))] = word(), word()
        elif how == "inserted":
            w.insert(at, word())
        else:
            del w[at]
        return w

    rows, kinds = [], []
    for n in (8, 9, 11, 12, 14, 17, 20, 23, 24, 30):
        for how in ("changed", "inserted", "removed", "twice"):
            for _ in range(15):
                line = [word() for _ in range(n)]
                copy = edited(line, how)
                if SequenceMatcher(None, " ".join(line), " ".join(copy), autojunk=False).ratio() >= 0.87:
                    rows += [" ".join(line), " ".join(copy)]
                    kinds.append((n, how))
    got = {r.doc_id: r.removed for r in line_dedup.line_dedup(frame(spark, [(i, t, "a") for i, t in enumerate(rows)])).collect()}
    found = [got[2 * i + 1] == [0] for i in range(len(kinds))]
    assert all(got[2 * i] == [] for i in range(len(kinds)))
    rate = {k: sum(f for f, kind in zip(found, kinds) if k in kind) / sum(k in kind for kind in kinds) for k in {x for kind in kinds for x in kind}}
    assert sum(found) >= 0.95 * len(found) and min(rate.values()) >= 0.9, sorted(rate.items(), key=str)


def test_find_leaks(spark, docs, none):
    items = spark.createDataFrame(
        [(1, " ".join(WORDS[60:80])), (2, "nothing of this is here at all"), (3, "one TWO"), (4, None), (5, "..."), (6, " ".join(WORDS[145:170]))],
        "item_id long, text string")
    sets = {i: shingle_set(t) for i, t in ((1, " ".join(WORDS[60:80])), (6, " ".join(WORDS[145:170])))}
    want = {(d, i) for d, t, _ in ROWS for i, s in sets.items() if len(s & shingle_set(t)) >= 0.8 * len(s)} | {(5, 3), (6, 3)}
    got = rows_of(decontaminate.find_leaks(docs, items), "doc_id", "item_id")
    assert set(got) == want and len(got) == len(want) + 2  # doc 2 is there twice
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, _ in ROWS if i not in {d for d, _ in want})
    assert decontaminate.find_leaks(none, items).count() == 0 and decontaminate.find_leaks(docs, items.limit(0)).count() == 0


def test_mix(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(r["size"] == len(words(t)) for r, (_, t, _) in zip(sorted(got, key=lambda r: r.doc_id), ROWS))
    sizes = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in share if share[s] > 2 * sizes[s]}
        if not over:
            target = {**share, **{s: 2.0 * sizes[s] for s in full}}
            break
        full |= over
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.taken <= 2 * r["size"] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 1
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs).collect()))
    at = [r.position for r in mixing.training_order(mixing.mix(docs)).collect()]
    assert at == sorted(at) and all(0 <= x <= 1 for x in at)
    assert mixing.mix(none).count() == 0


def test_position_inverts_the_schedule(spark):
    from pyspark.sql import functions as F

    knots = ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5))
    area = lambda t: 1.5 * t - 0.5 * t * t  # noqa: E731  straight from 1.5 to 0.5
    df = spark.range(101).select((F.col("id") / 100).alias("u")).withColumn("t", mixing.position(F.col("u"), knots))
    assert all(abs(area(r.t) - r.u) < 1e-9 for r in df.collect())


def test_toxicity(spark, none):
    bad = [(i, f"A calm start. You are a {w} person here.\nThe end {i}.", 1) for i, w in enumerate(["idiotic", "stupidly"] * 60)]
    good = [(1000 + i, f"A calm start. You are a kind person here.\nThe end {i}.", 0) for i in range(240)]
    docs = frame(spark, [(i, t, "a") for i, t, _ in bad + good] + [(9001, None, "a"), (9002, "", "a"), (9003, "???", "a"), (9003, "???", "a")])
    labels = spark.createDataFrame([(i, y) for i, _, y in bad + good], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(bad) + len(good) + 4
    truth = {i: y for i, _, y in bad + good}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and all(r.predicted == truth[r.doc_id] for r in held)
    hit = next(r for r in got if r.doc_id == 0)
    text = bad[0][1]
    assert [text[s.start : s.stop].strip() for s in hit.offending] == ["You are a idiotic person here."]
    assert all(r.score == 0 for r in got if r.doc_id > 9000)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    assert toxicity.score(none, model).count() == 0
    assert all(r.score < 1e-3 for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect())


def test_html_text(spark):
    page = """<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies on this site.</div>
      <article><h1>Head &amp; line</h1><p>First  <b>bold</b><br>part of a text &lt;here&gt;.<p>Second one.</p><script>if (a < "</p>") b()</script>
      <div class="comments"><p>I like this article very much, thanks a lot for it.</p></div></article><aside>More</aside><form>Name <input></form>
      <footer>&copy; 2024</footer></body></html>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>" + "word " * 50), (4, "u", "<p>" + "word " * 50), (5, "u", "<div" * 3 + "<<>&")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars long, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    assert got[1][0] == "Head & line\nFirst bold part of a text <here>.\nSecond one." and got[1][1] == len(got[1][0])
    assert got[2] == ("", 0) and got[3] == ("", 0) and got[4][0] == " ".join(["word"] * 50)
    assert html_text.extract(df.limit(0)).count() == 0


def test_toxicity_of_rarer_words(spark):
    """Long frequent words fill thousands of features; documents with rarer words are still found."""
    import random
    import zlib

    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    ids = iter(range(1, 100_000))
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    take = lambda held: next(i for i in ids if (fold(i) == 1) == held)
    docs, rare = [], []
    for w in (word(40) for _ in range(60)):
        docs += [(take(False), f"This is {w} here.", 1) for _ in range(24)]
    for w in (word(12) for _ in range(5)):
        docs += [(take(False), f"This is {w} here.", 1) for _ in range(18)]
        rare += [(take(True), f"This is {w} here.", 1) for _ in range(4)]
    docs += [(take(False), f"This is {word(12)} here.", 0) for _ in range(1530)]
    table = frame(spark, [(i, t, "a") for i, t, _ in docs + rare])
    model = toxicity.fit(table, spark.createDataFrame([(i, y) for i, _, y in docs + rare], "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.score(table, model).collect()}
    assert len(model.hashes) > 2000 and [got[i] for i, _, _ in rare] == [1] * 20


@pytest.mark.parametrize("open_, close", [
    ('<html><body class="has-sidebar"><div>', "</div>"), ('<html class="nav-closed"><body><div>', "</div>"), ('<body><div class="page-with-sidebar">', "</div>"),
    ('<body><article class="post comments-open">', "</article>"), ('<body><div class="page-with-sidebar"><article class="post comments-open">', "</article></div>"),
    ('<body><form><article>', "</article></form>"), ('<body><div class="nav-layout"><main>', "</main></div>"),
])
def test_html_text_of_named_layouts(open_, close):
    """A name around the whole article is not a verdict on it; names inside still are."""
    paragraphs = [" ".join(f"p{n}w{k}" for k in range(30)) for n in range(4)]
    comments = "".join(f'<article class="comment-body"><p>Thanks for comment {n}, I like it a lot.</p></article>' for n in range(5))
    page = (
        f'{open_}<div class="site-header"><a href=x>Home</a></div><header class="entry-header"><h1>The head line of it</h1></header>'
        + "".join(f"<p>{p}</p>" for p in paragraphs)
        + f'<div class="sidebar"><p>More things to read</p></div><div class="comments-area">{comments}</div>{close}<div class="footer">All rights reserved</div>'
    )
    got = html_text.main_text(page).split("\n")
    assert [g for g in got if g != "The head line of it"] == paragraphs
    if "<article" in open_ or "<main" in open_:
        assert got[0] == "The head line of it"


def test_long_text_outweighs_a_name():
    article = "".join(f"<p>{' '.join(f'a{n}w{k}' for k in range(60))}</p>" for n in range(5))
    long = " ".join(f"w{k}" for k in range(250))
    got = html_text.main_text(f'<body><div>{article}</div><div class="notice"><p>{long}</p></div><div class="notice"><p>We use cookies.</p></div></body>')
    assert long in got and "cookies" not in got


def test_minimum_cut_is_least():
    """Against all labellings of small pages."""
    import random

    rng = random.Random(3)
    for _ in range(40):
        tree = []
        for n in range(9):
            parent = rng.randint(0, n)
            tree.append(html_text.Element("div", parent, frozenset(), False, (tree[parent - 1].depth if parent else 0) + 1))
        blocks = [html_text.Block("w " * rng.randint(1, 40), rng.randint(0, 9), rng.choice([-3.0, 0.0, 2.0]), 0, False) for _ in range(7)]

        def path(n):
            return (path(tree[n - 1].parent) if n else []) + [n]

        def smooth(a, b):
            p, q = path(a.node), path(b.node)
            common = sum(x == y for x, y in zip(p, q))
            return 2.0 / (1 + len(p) + len(q) - 2 * common)

        def cost(keep):
            own = sum(max(0, -html_text.score(b)) if k else max(0, html_text.score(b)) for b, k in zip(blocks, keep))
            pairs, last = [], {}
            for i, b in enumerate(blocks):
                if i:
                    pairs.append((i - 1, i))
                parent = tree[b.node - 1].parent if b.node else 0
                if last.get(parent, i) < i - 1:
                    pairs.append((last[parent], i))
                last[parent] = i
            return own + sum(smooth(blocks[i], blocks[j]) for i, j in pairs if keep[i] != keep[j])

        best = min(cost(k) for k in itertools.product([False, True], repeat=len(blocks)))
        assert abs(cost(html_text.content(blocks, tree)) - best) < 1e-6


PROSE = " ".join(f"w{i}" for i in range(30))


@pytest.mark.parametrize("page,text", [
    (f'<p>a b <img alt=5"> c {PROSE}</p><p>"{PROSE}"</p>', f'a b c {PROSE}\n"{PROSE}"'),
    (f'<p title="x > y" id=\'a"b\'>{PROSE}</p>', PROSE),
    (f"<div><p>{PROSE}</p><ul><li>One</li><li>Two</li></ul><p>{PROSE}</p></div>", f"{PROSE}\nOne\nTwo\n{PROSE}"),
    ("<h1>Head line</h1><p>Short one.</p>", "Head line\nShort one."),
    ("<p>One</p><p>Two</p>", "One\nTwo"),
    (f'<article><p>{PROSE}</p><p><a href="#">Read it</a></p><blockquote class="quote-share">Said</blockquote><p>{PROSE}</p></article>', f"{PROSE}\nRead it\nSaid\n{PROSE}"),
    (f"<body><p>{PROSE}</p><p>{PROSE}</p><div>Copyright 2024 Somebody</div></body>", f"{PROSE}\n{PROSE}"),
    (f"<article><p>{PROSE}</p><p>All rights reserved.</p></article><footer>All rights reserved.</footer>", f"{PROSE}\nAll rights reserved."),
    (f"<nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav><p>{PROSE}</p>", PROSE),
    (f"<p>{PROSE}</p><!-- open comment <p>gone</p>", PROSE),
    (f"<p>{PROSE}</p>a < b <i", f"{PROSE}\na < b"),
])
def test_pages_as_they_come(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page", ["<div>x " * 50_000, '<a href="x ' * 50_000, "<p <" * 50_000, "<!-- " * 50_000, "</div>" * 50_000, "<ul><li>" * 25_000, "<table><td>x" * 20_000])
def test_deep_and_broken_pages_take_linear_time(page):
    import time

    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 20


def test_warc_round_trip(spark):
    big, odd = "x" * 2000, "é\r\n\r\nWARC/1.1\r\n" * 200
    rows = [(1, "u", big), (2, None, big), (3, "a\r\nb%", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", odd), (9, "u", odd)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, size int")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(rows)
    for i, url, h in rows:
        raw = (h or "").encode()
        last = max(j for j, _, k in rows if (k or "") == (h or ""))
        again = len(raw) >= 1000 and last != i
        assert (got[i].url, got[i].payload_bytes, got[i].payload_digest) == (url, len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", last) if again else ("response", None))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_id_with_two_payloads(spark):
    a, b, c = ("x" * 2000, "y" * 2000, "z" * 2000)
    rows = [(1, "u", a), (1, "u", b), (2, "u", a), (3, "u", b), (3, "u", c)]
    df = spark.createDataFrame(rows + [(4, "u", c), (5, "u", "w" * 2000), (4, "u", "v" * 2000)], "page_id long, url string, html string")
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(1, sha(a), 2), (1, sha(b), 3), (2, sha(a), None), (3, sha(b), None), (3, sha(c), 4), (4, sha(c), None), (4, sha("v" * 2000), None), (5, sha("w" * 2000), None)]
    assert rows_of(warc.round_trip(df), "page_id", "payload_digest", "refers_to") == sorted(want, key=repr)


def test_warc_pushes_conditions_down(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", "x" * (500 * i)) for i in range(5)], "page_id long, url string, html string")
    warc.register(spark)
    warc.records_of(df).write.format("warc").mode("append").option("path", str(tmp_path)).save()
    read = spark.read.format("warc").option("path", str(tmp_path)).load().filter("url = 'u3'")
    assert [len(r.payload) for r in read.collect()] == [1500]
    reader = warc.WarcReader({"path": str(tmp_path)}, read.schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(reader.pushFilters([EqualTo(("url",), "u3"), GreaterThan(("payload_bytes",), 3)])) == [GreaterThan(("payload_bytes",), 3)]


def test_queries_match_sql(spark):
    from souqlytics.llm.queries import ORACLE, QUERIES
    from verify.compare import compare

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLE.items():
        assert compare(QUERIES[name](spark, SF), con, sql) is None, name


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    toxic = p.drop_toxic(spark, docs, SF)
    assert toxic.columns == docs.columns
    one = p.drop_copies(spark, docs, SF)
    last = {}
    for i, t in text.items():
        last[t] = max(i, last.get(t, i))
    assert {r.doc_id for r in one.collect()} == set(last.values())
    near = p.drop_near_copies(spark, one, SF)
    classes = near_classes([(i, text[i]) for i in last.values()])
    assert {r.doc_id for r in near.collect()} == set(classes.values()) and near.columns == docs.columns
    rows = p.run(spark, SF).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
