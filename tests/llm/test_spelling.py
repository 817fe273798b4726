"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from heatgrid.llm import spelling as sp
from pyspark.sql import functions as F


def near(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    own = Counter()
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            own[run] += 1
    return {w: n for w, n in own.items() if len(w) >= 5 and n >= 3}


def brute_forms(words, factor=2):
    by = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            by[a].append(b)
            by[b].append(a)
    form = {}
    for w, own in by.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), words[w], len(by[w]), words.get(form[w])) for w in words}


def forms(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: tuple(r)[1:] for r in rows}


def test_machine_finds_each_pair_once():
    r = random.Random(3)
    for turn in range(400):
        letters, size = ("ab" if turn % 2 else "abc"), r.randint(1, 6)
        draw = lambda n: {"".join(r.choice(letters) for _ in range(n)) for _ in range(r.randint(0, 12))}
        short, long = draw(size), draw(size + 1)
        machine = sp.Acceptor()
        got = sorted(tuple(sorted(p)) for p in machine.one_edit(machine.compile(sorted(short)), machine.compile(sorted(long))))
        want = [tuple(sorted(p)) for p in combinations(short, 2) if near(*p)] + [tuple(sorted((a, b))) for a in short for b in long if near(a, b)]
        assert got == sorted(want)


def test_acceptor_is_minimal():
    machine = sp.Acceptor()
    machine.compile(sorted(a + b + "ing" for a in "abcd" for b in "xyz"))
    assert len(machine.arcs) == 1 + 5  # the end, three states of "ing", one after each of the first two letters' choices


@pytest.mark.parametrize(("letters", "low", "high", "n", "most"), [("ab", 5, 8, 120, 6), ("abc", 5, 9, 300, 1000), ("aé÷z", 5, 6, 300, 30)])
def test_forms_equal_brute_force(spark, letters, low, high, n, most):
    r = random.Random(n + most)
    words = {"".join(r.choice(letters) for _ in range(r.randint(low, high))): r.choice([3, 3, 3, 5, 6, 7, 12, 30, 100]) for _ in range(n)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert forms(sp.variant_forms(df, max_words=most)) == brute_forms(words)


def test_a_third_of_the_words_share_a_long_start_or_end(spark):
    r = random.Random(1)
    tails = {"".join(r.choice("abc") for _ in range(r.randint(5, 7))) for _ in range(150)}
    words = {w: r.choice([3, 4, 9, 20]) for t in tails for w in (t, "q" * 20 + t, t + "z" * 19)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert forms(sp.variant_forms(df, max_words=10)) == brute_forms(words)
    # the states that a task takes are bounded
    states = sp._states(df)
    for _ in range(20):
        cold, states = sp._split(states, 10)
        assert cold.where(F.length("kind") == 1).groupBy(*sp._STATE).count().where("count > 10").isEmpty()
        if states is None:
            break
    assert states is None


def test_counts_of_whole_texts(spark):
    r = random.Random(7)
    letters = "abcAÀÿ÷é"
    rows = [(r.choice([1, 2, 3, None, 50, 97]), " ".join("".join(r.choice(letters) for _ in range(r.choice([4, 5, 5, 6]))) for _ in range(40)) + r.choice(["", "\n", "x1y-z"])) for _ in range(300)]
    rows += [(5, None), (6, ""), (7, "123"), (8, "verylongword " * 30_000), rows[0], rows[0]]
    df = spark.createDataFrame([(*x, "other") for x in rows], "doc_id long, text string, word string")
    got = {x.word: x.n for x in sp.count_words(df).collect()}
    assert got == brute_words(rows) and len(got) > 100


def test_very_long_words_and_ties(spark):
    long = "ab" * 3000
    words = {long: 9, long + "a": 3, long[:3000] + "x" + long[3001:]: 3, "aaaaa": 3, "aaaab": 6, "aaaac": 6}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = forms(sp.variant_forms(df))
    assert got == brute_forms(words)
    assert got["aaaaa"][:2] == ("aaaab", "aaaab")


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert forms(sp.variant_forms(sp.count_words(docs))) == {}


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    words = brute_words(rows)
    got = forms(sp.op12_spelling_variants(spark, sf_dir))
    assert got.keys() == words.keys() and {w: x[2] for w, x in got.items()} == words
    some = sorted(words)[:: max(1, len(words) // 400)]
    for w in some:  # all words against a part of them
        own = [v for v in words if abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 2 * words[w] else None
        assert (got[w][0], got[w][3]) == (form, len(own))
    assert all(x[1] == (w if x[0] is None else got[x[0]][1]) for w, x in got.items())
