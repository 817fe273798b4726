"""Source divergence audit: how far the word frequencies of each source are from those of the others of its language.

Single-pass in-memory indexing: a task counts postings (language, term) -> source -> occurrences and documents in a block
until it holds BLOCK_POSTINGS of them, then hands the block on as a run, sorted by term and cut into hash shards. A
shard's task merges its segments of all runs by a heap, so that each term's postings meet, and keeps the terms found in
enough documents of their language.

A term that neither of two sources has adds the same to their difference for every term. So a pair starts from the sum
it would have if all counts were zero, each source adds what its own terms change in that, and the terms that both have
are streamed, language by language and term by term, to correct for being counted in both.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import merge
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatgrid.llm.common import bounded, join_dealt, materialise, table

MIN_DOCS, PRIOR, SCALE, TERM_RANKS = 30, 5, 1_000_000_000, 50
#: Postings that a task holds, about 250 bytes each with their terms.
BLOCK_POSTINGS = 600_000
#: Bytes of text a shard; a posting takes a dozen bytes of a segment and a term about 60, and there are fewer than words.
SHARD_BYTES = 16 << 20
#: Sums of pairs are held in squares of SQUARE x SQUARE sources, at most SQUARES of them (half a megabyte each).
SQUARE, SQUARES = 256, 128

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_RUN = ["shard", "lang", "names", "terms", "docs", "ends", "of", "ns"]
_RUN_SQL = "shard int, lang string, names array<string>, terms array<string>, docs array<int>, ends array<int>, of array<int>, ns array<bigint>"
_KEPT = {"lang": pa.string(), "term": pa.string(), "sources": pa.list_(pa.string()), "ns": pa.list_(pa.int64())}


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and characters beyond ASCII, with A-Z lower-cased, in UTF-8; null has none."""
    return _TERM.findall((text or "").encode().lower())


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))


# ---- runs


class Block:
    """The postings of one language that a task holds: documents a term, and occurrences a source and term."""

    def __init__(self):
        self.docs: Counter = Counter()
        self.ns: dict[str, Counter] = {}

    def add(self, source: str, terms: list[bytes]) -> int:
        """Count a document's terms; how many postings are new."""
        self.docs.update(set(terms))
        own = self.ns.setdefault(source, Counter())
        before = len(own)
        own.update(terms)
        return len(own) - before

    def segments(self, lang: str, n_shards: int) -> pa.RecordBatch:
        """The block as one run: its terms in order, cut into shards; a row a shard."""
        terms = sorted(self.docs)
        start = crc32(lang.encode())
        shard = np.fromiter((crc32(t, start) % n_shards for t in terms), np.int32, len(terms))
        order = shard.argsort(kind="stable")  # by shard, then in order of the terms
        place = np.empty(len(terms), np.int64)
        place[order] = np.arange(len(terms))
        at = dict(zip(terms, place.tolist(), strict=True))
        names, own = list(self.ns), list(self.ns.values())
        sizes = [len(x) for x in own]
        of = np.repeat(np.arange(len(own), dtype=np.int32), sizes)
        term = np.fromiter(map(at.__getitem__, chain.from_iterable(own)), np.int64, sum(sizes))
        ns = np.fromiter(chain.from_iterable(x.values() for x in own), np.int64, sum(sizes))
        by_term = term.argsort(kind="stable")
        ends = np.cumsum(np.bincount(term, minlength=len(terms)))
        shards, first = np.unique(shard[order], return_index=True)
        cuts = np.append(first, len(terms)).astype(np.int32)
        starts = np.append(0, ends)[cuts].astype(np.int32)  # the first posting of each shard
        inside = ends - np.repeat(starts[:-1], np.diff(cuts))
        lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        sorted_terms = pa.array([terms[i] for i in order.tolist()], pa.binary()).cast(pa.string())
        docs = np.fromiter(map(self.docs.__getitem__, terms), np.int32, len(terms))[order]
        columns = [
            pa.array(shards), pa.array([lang] * len(shards), pa.string()), pa.array([names] * len(shards), pa.list_(pa.string())), lists(cuts, sorted_terms),
            lists(cuts, pa.array(docs)), lists(cuts, pa.array(inside.astype(np.int32))), lists(starts, pa.array(of[by_term])), lists(starts, pa.array(ns[by_term])),
        ]
        return pa.RecordBatch.from_arrays(columns, _RUN)


def posting_runs(docs: DataFrame, n_shards: int, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """Runs of docs (text, lang, source): rows of a run, language and shard, with its terms in order, the documents of each and its postings."""

    def cut(blocks: dict[str, Block]) -> Iterator[pa.RecordBatch]:
        for lang, block in blocks.items():
            yield block.segments(lang, n_shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, Block] = {}
        held = 0
        for batch in batches:
            for text, lang, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if terms := terms_of(text):
                    held += blocks.setdefault(lang, Block()).add(source, terms)
                    if held >= block_postings:
                        yield from cut(blocks)
                        blocks, held = {}, 0
        yield from cut(blocks)

    return docs.select("text", "lang", "source").mapInArrow(run, _RUN_SQL)


def _entries(segment: pa.RecordBatch, row: int, number: int) -> Iterator[tuple]:
    """(term, number, documents, first posting, end, segment) of one row in order; no two are equal in term and number."""
    names, terms, docs, ends, of, ns = (segment.column(c)[row].values for c in range(2, 8))
    own = names.to_pylist(), of.to_numpy(), ns.to_numpy()
    ends = ends.to_pylist()
    return zip(terms.to_pylist(), repeat(number), docs.to_pylist(), [0, *ends], ends, repeat(own), strict=False)


def merged_frequencies(runs: DataFrame, n_parts: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, sources, ns): the kept terms, each with all sources that have it and how often, from runs merged a shard at a time."""

    def merged(lang: str, segments: list[Iterator[tuple]]) -> Iterator[tuple]:
        def row() -> tuple:
            total: Counter = Counter()
            for _, _, _, start, end, (names, of, ns) in entries:
                for i, n in zip(of[start:end].tolist(), ns[start:end].tolist(), strict=True):
                    total[names[i]] += n
            return lang, term, list(total), list(total.values())

        term, found, entries = None, 0, []
        for entry in merge(*segments):
            if entry[0] != term:
                if found >= min_docs:
                    yield row()
                term, found, entries = entry[0], 0, []
            found += entry[2]
            entries.append(entry)
        if term is not None and found >= min_docs:
            yield row()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, segments = None, []
        for batch in batches:
            for i in range(len(batch)):
                now = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if now != key:
                    yield from rows(key, segments)
                    key, segments = now, []
                segments.append(_entries(batch, i, len(segments)))
        yield from rows(key, segments)

    def rows(key: tuple | None, segments: list[Iterator[tuple]]) -> Iterator[pa.RecordBatch]:
        own = []
        for row in merged(key[1], segments) if key else ():
            own.append(row)
            if len(own) >= 10_000:
                yield _batch(own, _KEPT)
                own = []
        if own:
            yield _batch(own, _KEPT)

    dealt = runs.repartition(n_parts, "shard").sortWithinPartitions("shard", "lang")
    return dealt.mapInArrow(run, "lang string, term string, sources array<string>, ns array<bigint>")


# ---- exact shares


def share(count: Column, total: Column, kept: Column, prior: int = PRIOR, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + prior) / (total + prior * kept)), in whole numbers of 38 digits."""
    whole = lambda c: c.cast("decimal(20,0)")
    above, below = (whole(count) + prior) * F.lit(scale).cast("decimal(11,0)"), whole(total) + prior * whole(kept)
    return F.when(kept > 0, 1 + F.floor((above - above % below) / below).cast("long"))


# ---- pairs


def shared_corrections(terms: DataFrame, n_parts: int) -> DataFrame:
    """(lang, a, b, value), a < b: over the terms that both sources have, what counting each for both sides is off by.

    terms: lang, term, source, p, p0, a row a source that has the term. Sources get numbers as a task meets them; a task
    sums pairs in squares and hands them on when it holds SQUARES of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, dict[str, int]] = {}
        squares: dict[tuple[str, int, int], np.ndarray] = {}

        def add(lang: str, sources: list[str], p: list[int], p0: list[int]) -> None:
            if len(sources) < 2:
                return
            known = numbers.setdefault(lang, {})
            at = np.array([known.setdefault(s, len(known)) for s in sources])
            order = at.argsort()
            at, own, none = at[order], np.array(p)[order], np.array(p0)[order]
            cuts = np.flatnonzero(np.diff(at // SQUARE)) + 1
            blocks = list(zip(np.split(at, cuts), np.split(own, cuts), np.split(none, cuts), strict=True))
            for i, (at1, p1, z1) in enumerate(blocks):
                p1, z1 = p1[:, None], z1[:, None]
                for at2, p2, z2 in blocks[i:]:
                    square = squares.setdefault((lang, at1[0] // SQUARE, at2[0] // SQUARE), np.zeros((SQUARE, SQUARE), np.int64))
                    square[np.ix_(at1 % SQUARE, at2 % SQUARE)] += abs(p1 - p2) - abs(p1 - z2) - abs(z1 - p2) + abs(z1 - z2)

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, i, j), square in squares.items():
                names = list(numbers[lang])
                if i == j:
                    square = np.triu(square, 1)
                row, col = square.nonzero()
                a, b = [names[i * SQUARE + x] for x in row.tolist()], [names[j * SQUARE + x] for x in col.tolist()]
                low, high = [min(x) for x in zip(a, b, strict=True)], [max(x) for x in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(low, pa.string()), pa.array(high, pa.string()), pa.array(square[row, col])], ["lang", "a", "b", "value"])
            squares.clear()

        key, sources, p, p0 = None, [], [], []
        for batch in batches:
            for lang, term, source, x, z in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if (lang, term) != key:
                    if key:
                        add(key[0], sources, p, p0)
                        if len(squares) >= SQUARES:
                            yield from rows()
                    key, sources, p, p0 = (lang, term), [], [], []
                sources.append(source)
                p.append(x)
                p0.append(z)
        if key:
            add(key[0], sources, p, p0)
        yield from rows()

    dealt = terms.select("lang", "term", "source", "p", "p0").repartition(n_parts, "lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(run, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def pair_values(groups: DataFrame, terms: DataFrame, n_parts: int) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language: the sum of |p - q| over all kept terms.

    groups: lang, source, kept, p0; terms as for shared_corrections. Both directions have the same value.
    """
    side = lambda s: groups.select("lang", "kept", F.col("source").alias(s), F.col("p0").alias(f"{s}0"))
    pairs = side("a").join(side("b").drop("kept"), "lang").where("a <> b")
    # what the terms of a source change where the other has none of them: sums by their different shares
    shares = terms.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    own = shares.withColumnRenamed("source", "a")
    apart = F.abs(F.col("p") - F.col("b0")) - F.abs(F.col("a0") - F.col("b0"))
    alone = pairs.join(own, ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.col("n") * apart).alias("value"))
    ends = lambda df: df.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")
    start = pairs.where("a < b").select("lang", "a", "b", (F.coalesce("kept", F.lit(0)) * F.abs(F.col("a0") - F.col("b0"))).alias("value"))
    sums = ends(start.withColumn("value", F.coalesce("value", F.lit(0)))).union(ends(alone)).union(ends(shared_corrections(terms, n_parts))).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return sums.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s")).select("lang", "s.source", "s.item", "value")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS, block_postings: int = BLOCK_POSTINGS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source).

    Each language keeps the terms found in at least min_docs of its rows. Part `pair`: all other sources of the
    language by the sum of differences of shares over its kept terms (0 without any). Part `term`: up to term_ranks
    terms that the source has and whose share is above the language's. Ranks go by value downwards, then by item.

    Null texts, languages and sources are empty strings; every row counts, repeated ones too; texts are taken whole;
    groups without a term have their pairs; an empty table gives none. Other columns are not looked at.
    """
    lang, source = F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")
    docs = docs.select("text", lang, source)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_parts = max(-(-size // (4 * shard_bytes)), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = materialise(merged_frequencies(posting_runs(docs, 4 * n_parts, block_postings), n_parts, min_docs), "frequencies")

    in_lang = kept.select("lang", F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    langs = in_lang.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    each = kept.select("lang", "term", F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x).alias("lang_n"), F.explode(F.arrays_zip("sources", "ns")).alias("s"))
    each = each.select("lang", "term", "lang_n", F.col("s.sources").alias("source"), F.col("s.ns").alias("n"))
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.withColumns({"total": F.coalesce("total", F.lit(0)), "rows": F.coalesce("rows", F.lit(0))})
    groups = groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("kept")))
    groups = materialise(groups, "divergence-groups")

    # a source may have a third of all postings: they are dealt over tasks
    n_rows = groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    to = groups.where("rows > 0").select(F.struct("lang", "source").alias("of"), "total", "kept", "lang_total", "p0", "rows")
    terms = join_dealt(each.withColumn("of", F.struct("lang", "source")).drop("source"), to, "of", "rows", n_rows)
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    terms = materialise(terms.select("lang", "term", F.col("of.source").alias("source"), p.alias("p"), "p0", (p - q).alias("above")), "divergence-terms")

    pairs = pair_values(groups.select("lang", "source", "kept", "p0"), terms, n_parts)
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    best = ranked(terms.where("above > 0").select("lang", "source", F.col("term").alias("item"), F.col("above").alias("value"))).where(F.col("rank") <= term_ranks)
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(ranked(pairs), "pair").union(out(best, "term"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
keep AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM keep GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN keep USING (lang, term) GROUP BY w.lang, w.source, w.term),
full_c AS (SELECT g.lang, g.source, keep.term, coalesce(c.n, 0) AS n FROM g JOIN keep USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = keep.term),
p AS (SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000::HUGEINT * (f.n + 5)) // (sum(f.n) OVER (PARTITION BY f.lang, f.source) + 5 * v.v)::HUGEINT AS p FROM full_c f JOIN v USING (lang)),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
      FROM (SELECT keep.lang, keep.term, coalesce(sum(c.n), 0) AS n FROM keep LEFT JOIN c USING (lang, term) GROUP BY keep.lang, keep.term) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, p.p - l.q AS value FROM p JOIN l USING (lang, term) WHERE p.n > 0 AND p.p > l.q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
      UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
