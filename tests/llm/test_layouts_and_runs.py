"""Chat trees, collocations and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from souqlytics.llm import chat_tree, collocations, periodic_runs, queries

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- periodic runs


def plain_runs(w, least=24, times=3):
    number = {}
    w = np.array([number.setdefault(x, len(number)) for x in w], np.int64)
    found = []
    for q in range(1, len(w) // times + 1):
        same = np.concatenate([[0], (w[q:] == w[:-q]).astype(int), [0]])
        for a, b in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            start, length = int(a), int(b - a + q)
            if length >= max(least, times * q):
                part = w[start : start + length]
                if not any((part[p:] == part[:-p]).all() for p in range(1, q)):
                    found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(5)
    total = 0
    for _ in range(400):
        documents = []
        for _ in range(3):
            w = []
            for _ in range(rng.randint(0, 5)):
                part = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randint(1, 14))]
                w += part * rng.randint(1, 12) + part[: rng.randint(0, len(part))]
            documents.append([x.encode() for x in w])
        got = [tuple(r) for r in periodic_runs.find_runs(periodic_runs.word_numbers(documents), max(map(len, documents))).tolist()]
        want, at = [], 0
        for d in documents:
            want += [(s + at, n, q) for s, n, q in plain_runs(d)]
            at += len(d)
        assert got == want
        total += len(want)
    assert total > 300


def test_runs_need_linear_work():
    n = 400_000
    assert periodic_runs.find_runs(np.zeros(n, np.int64), n).tolist() == [[0, n, 1]]
    assert periodic_runs.find_runs(np.arange(n) % 1000, n).tolist() == [[0, n, 1000]]


def test_runs_of_odd_rows(spark):
    thrice = " ".join(["a", "b", "c"] * 8 + ["end"])
    rows = [(1, thrice, "x"), (1, thrice, "x"), (2, None, "x"), (3, "", "x"), (4, " \t\n\v\f\r", "x"), (None, "z " * 23, "x"), (5, "z " + " z" * 24, "x")]
    schema = "doc_id long, text string, runs string"
    got = periodic_runs.periodic_runs(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in got) == sorted([
        (1, 25, [(0, 24, 3)], (0, 24, 3), "a b c end")] * 2 + [(2, 0, [], None, ""), (3, 0, [], None, ""), (4, 0, [], None, ""), (0, 23, [], None, " ".join("z" * 23)),
        (5, 25, [(1, 24, 1)], (1, 24, 1), "z  z")])
    assert periodic_runs.periodic_runs(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(spark.createDataFrame([], schema), times=2)


def test_runs_query_is_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_diagonal_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h = zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and w:
            a = (h // 10) % len(w)
            p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
        runs = plain_runs(w)
        planted += bool(runs)
        gone = set()
        for s, n, q in runs:
            gone.update(range(s + q, s + n))
        r = got[d.doc_id]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in gone))
        if runs:
            top = max(n / q for _, n, q in runs)
            s, n, q = next(r for r in runs if r[1] / r[2] == top)
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert planted >= 10


# ---------------------------------------------------------------- collocations


def plain_collocations(rows, least, share, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    counts[lang][tuple(w[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def random_texts(count=60):
    rng = random.Random(3)
    passage = " ".join(rng.choice(["new", "York", "CITY", "hall", "of", "fame"]) for _ in range(60))
    rows = []
    for _ in range(count):
        w = [rng.choice(["a", "B", "c", "École", "new york", "of the", "x\u000b", "y.", "z,", "\n", "\t"]) for _ in range(rng.randint(0, 120))]
        rows.append((rng.choice(["en", "fr", None, "und"]), " ".join(w)))
    rows += [("en", passage)] * 9 + [("en", "tail " + passage + " end"), ("fr", None), ("fr", ""), (None, "...,,,"), ("de", "lone")]
    return rows


@pytest.mark.parametrize("least,top", [(3, 2000), (8, 7), (10_000, 5)])
def test_collocations(spark, least, top):
    rows = random_texts()
    docs = spark.createDataFrame([(lang, text, 1, "c", True, 2) for lang, text in rows], "lang string, text string, n long, chunk string, last boolean, a int").repartition(5)
    got = collocations.collocations(docs, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_collocations(rows, least, 80, top)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert bool(want) == (least < 10_000)


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_chunks_hold_every_phrase_once(monkeypatch):
    texts = [collocations._normalised(text) for _, text in random_texts() if text]
    for trigger in (1, 2, 7, 10**9):
        monkeypatch.setattr(collocations, "TRIGGER", trigger)
        owners, chunks, last = collocations._chunks(texts)
        got, want = Counter(), Counter()
        for chunk, tail in zip(chunks, last):
            w = chunk.split()
            for i in range(len(w) if tail else len(w) - 3):
                got.update(tuple(w[i : i + size]) for size in range(1, 5) if i + size <= len(w))
        for t in texts:
            w = t.split()
            want.update(tuple(w[i : i + size]) for i in range(len(w)) for size in range(1, 5) if i + size <= len(w))
        assert got == want
        assert (len(chunks) > 3 * len(texts)) == (trigger <= 7)


# ---------------------------------------------------------------- chat trees

SYSTEM = ("system", "Be brief. <|im_start|> <\\|x <\\\\|")
TALKS = {
    1: [SYSTEM, ("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", "")],
    2: [SYSTEM, ("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "é漢😀<")],
    3: [SYSTEM, ("user", "hi"), ("assistant", "hello")],
    4: [SYSTEM, ("user", "hi"), ("assistant", "hello")],
    5: [("user", None), ("assistant", "\n\n<|im_end|>\n")],
    6: [("assistant", "alone")],
    7: [("odd\nrole<|n|>\\n", "x\\"), (None, "y"), ("user", "hi"), ("user", "hi")],
    None: [("user", "no id")],
}


def talk_rows():
    rows = [(c, 10 * i, r, t, 1, "n") for c, turns in TALKS.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return rows


TALK = "conv_id long, turn long, role string, text string, start int, node string"


@pytest.fixture(scope="module")
def tree(spark):
    nodes, places = chat_tree.lay_out(spark.createDataFrame(talk_rows(), TALK).repartition(3))
    return nodes, places


def escaped(text):
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def formatted(role, text):
    return f"<|im_start|>{escaped(role or '')}".replace("\n", "<|n|>") + f"\n{escaped(text or '')}<|im_end|>\n"


def test_tree_emits_each_beginning_once(tree):
    nodes = sorted(tree[0].collect(), key=lambda r: r.start)
    beginnings = {tuple(turns[: i + 1]) for turns in TALKS.values() for i in range(len(turns))}
    assert len(nodes) == len(beginnings)
    sequence, at = "", 0
    for r in nodes:
        assert r.start == at and r.length == len(r.formatted)
        at += r.length
        sequence += r.formatted
    where = defaultdict(dict)
    for r in tree[1].collect():
        where[r.conv_id][r.depth] = r.start
    by_start = {r.start: r for r in nodes}
    for c, turns in TALKS.items():
        before = ""
        for depth, (role, text) in enumerate(turns):
            r = by_start[where[c][depth]]
            assert r.formatted == formatted(role, text)
            assert r.position == len(before)
            # what a token may attend to is what stands before it in its conversation
            assert "".join(sequence[a:b] for a, b in r.attention) == before
            assert all(b < a for (_, b), (a, _) in zip(r.attention, r.attention[1:]))
            under = sequence[r.loss_start : r.loss_end] if r.loss_start is not None else None
            assert under == (escaped(text or "") if role == "assistant" else None)
            before += r.formatted
    # depth first: a beginning's continuations follow it before anything else begins
    order = [x.first for x in nodes]
    assert order == sorted(order)


def test_tree_reads_back(tree):
    got = {r.conv_id: tuple(r)[1:] for r in chat_tree.digests(chat_tree.read_back(*tree)).collect()}
    want = {}
    for c, turns in TALKS.items():
        learned = [t or "" for r, t in turns if r == "assistant"]
        want[c] = (
            len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)), sum(map(len, learned)), sha("".join(learned)),
            sum(len(formatted(r, t)) for r, t in turns))
    assert got == want


def test_tree_shares_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat_tree, "BLOCK", 2)
    rows = [(c, 0, "system", "same", 0, "") for c in range(40)] + [(c, 1, "user", f"u{c % 7}", 0, "") for c in range(40)]
    nodes, places = chat_tree.lay_out(spark.createDataFrame(rows, TALK))
    assert nodes.count() == 8
    got = chat_tree.digests(chat_tree.read_back(nodes, places)).collect()
    assert sorted((r.conv_id, r.turns_sha256) for r in got) == [(c, sha(f"system\nsame\nuser\nu{c % 7}\n")) for c in range(40)]


def test_tree_ties_and_null_turns_keep_every_row(spark):
    rows = [(1, 0, "user", "a", 0, ""), (1, 0, "user", "a", 0, ""), (1, None, "user", "b", 0, ""), (1, 0, "assistant", "c", 0, "")]
    nodes, places = chat_tree.lay_out(spark.createDataFrame(rows, TALK))
    turns = sorted(chat_tree.read_back(nodes, places).collect(), key=lambda r: r.depth)
    assert (turns[0].role, turns[0].text) == ("user", "b")
    assert sorted((r.role, r.text) for r in turns[1:]) == [("assistant", "c"), ("user", "a"), ("user", "a")]
    empty = chat_tree.lay_out(spark.createDataFrame([], TALK))
    assert chat_tree.digests(chat_tree.read_back(*empty)).count() == 0


def test_tree_with_a_tokenizer(spark):
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/byte_bpe_50k.json"
    nodes, places = chat_tree.lay_out(spark.createDataFrame(talk_rows(), TALK), tokenizer=path)
    coder, sequence = Tokenizer.from_file(path), []
    for r in sorted(nodes.collect(), key=lambda r: r.start):
        assert r.start == len(sequence) and r.length == len(r.tokens)
        sequence += r.tokens
        if r.loss_start is not None:
            body = coder.decode(sequence[r.loss_start : r.loss_end], skip_special_tokens=False)
            assert r.formatted == f"<|im_start|>assistant\n{body}<|im_end|>\n"
    assert places.count() == sum(map(len, TALKS.values()))
