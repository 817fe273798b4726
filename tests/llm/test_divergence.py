"""Source divergence against plain Python, and against its SQL on given tables."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest
from heatgrid.llm import divergence as dv


def brute(rows, min_docs, ranks=50):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.decode() for t in dv.terms_of(text)]
        groups.add((lang, source))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        total = lambda c: sum(c[t] for t in kept)
        share = lambda c, t: 1 + 1_000_000_000 * (c[t] + 5) // (total(c) + 5 * len(kept))
        own, all_ = counts[lang, source], sum((counts[g] for g in groups if g[0] == lang), Counter())
        found = {"pair": [], "term": []}
        for other in {s for g, s in groups if g == lang and s != source}:
            found["pair"].append((sum(abs(share(own, t) - share(counts[lang, other], t)) for t in kept), other))
        for t in kept:
            if own[t] and share(own, t) > share(all_, t):
                found["term"].append((share(own, t) - share(all_, t), t))
        for part, items in found.items():
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i) for i, (value, item) in enumerate(items, 1) if part == "pair" or i <= ranks]
    return sorted(out)


def documents(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("min_docs", "block"), [(1, 7), (3, 40), (3, 10_000)])
def test_equals_plain_counts(spark, min_docs, block):
    r = random.Random(min_docs)
    words = ["a", "B", "é", "É", "straße", "x1y", "語", "Zz", "it's"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(150):
        source = "hot" if r.random() < 0.4 else r.choice(["s1", "s2", "S1", "ß", None])
        text = " ".join(r.choices(words, k=r.choice([0, 1, 5, 30])))
        rows.append((text, r.choice(["en", "en", "fr", None]), source))
    rows += [rows[0]] * 5 + [(None, "en", "empty"), ("123 !?", "en", "s1"), ("only here", "xx", "alone")]
    got = result(dv.source_divergence(documents(spark, rows), min_docs=min_docs, block_postings=block))
    assert got == brute(rows, min_docs)


def test_many_sources_fill_several_squares(spark, monkeypatch):
    monkeypatch.setattr(dv, "SQUARE", 4)
    r = random.Random(9)
    rows = [(" ".join(r.choices("abcdefgh", k=20)), "en", f"s{i % 11}") for i in range(60)]
    assert result(dv.source_divergence(documents(spark, rows), min_docs=2)) == brute(rows, 2)


def test_no_kept_terms_and_empty_table(spark):
    rows = [("a b", "en", "x"), ("c", "en", "y"), (None, None, None)]
    got = result(dv.source_divergence(documents(spark, rows), min_docs=30))
    assert got == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert result(dv.source_divergence(documents(spark, []))) == []


def test_extra_columns_and_long_texts(spark):
    rows = [("ab " * 50_000 + "c", "en", "x", 1, "q"), ("ab d", "en", "y", 2, None)]
    df = spark.createDataFrame(rows, "text string, lang string, source string, value int, term string")
    assert result(dv.source_divergence(df, min_docs=1)) == brute([r[:3] for r in rows], 1)


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert result(dv.op11_source_divergence(spark, sf_dir)) == sorted(con.execute(dv.ORACLE).fetchall())
