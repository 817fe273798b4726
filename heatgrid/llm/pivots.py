"""Embedding near-duplicates by a pivot-permutation index.

Every vector is described by its nearest pivots (reference vectors), in order. Inverted lists are kept for every two
pivots: the vectors that have both near. Vectors that share at least two near pivots meet in such a list, and their
cosine is then computed in double precision. A pair that meets in several lists counts in the first of them.

Pivots that are near each other form a group, and all lists of two groups are a block: a vector is sent once to each
block that has lists of it, not once to each list. Long lists are dealt over tasks by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgrid.llm.common import join_dealt, materialise, table
from heatgrid.llm.graph import connected_components

#: Pivots: twice the root of the number of vectors, so that the lists' total work grows with the vectors; bounds of both.
MIN_PIVOTS, MAX_PIVOTS = 32, 8192
#: Pivots are picked from a sample of at most this many vectors for each, no two closer than the cosine.
SAMPLE_A_PIVOT, APART = 4, 0.6
#: Rows of a list that is not dealt into chunks, and of a block of lists.
LIST_ROWS, BLOCK_ROWS = 1500, 50_000
#: Bytes of a block's vectors, and of the pivots and of the sample they are picked from, in double precision: the wider
#: vectors are, the fewer of them.
BLOCK_BYTES, PIVOT_BYTES, SAMPLE_BYTES = 26_000_000, 64_000_000, 64_000_000


def n_nearest(n_pivots: int) -> int:
    """Near pivots of a vector: 8 of 200, and one more each time the pivots double, which keeps the share of pairs found."""
    return 8 + max(0, round(log2(max(n_pivots, 1) / 200)))


def usable(embedding: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not zero."""
    wrong = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(embedding.isNotNull() & ~wrong & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _unit(rows: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision; shorter ones are padded with zeros."""
    own = [np.frombuffer(r, kind) for r in rows]
    size = max(map(len, own), default=0)
    x = np.zeros((len(own), size))
    for i, v in enumerate(own):
        x[i, : len(v)] = v
    if not len(x):
        return x
    x /= np.ldexp(1.0, np.frexp(np.abs(x).max(1))[1])[:, None]  # powers of two: squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1))[:, None]


def _packed(columns: list[str], kind: str):
    """Map (.., embedding) batches to the same with the embedding as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.asarray(v, kind).tobytes() for v in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(own, pa.binary())], [*columns, "vector"])

    return run


def _row_bytes(vectors: DataFrame, kind: str) -> int:
    """Of the widest vector in double precision."""
    return max(8, (vectors.agg(F.max(F.length("vector"))).first()[0] or 0) * 8 // int(kind[-1]))


def choose_pivots(vectors: DataFrame, total: int, kind: str) -> np.ndarray:
    """Unit pivots, picked one after the other from a bounded sample (those of the smallest hash), far from each other.

    Where too few are far apart, as when all vectors are alike, nearer ones fill up to MIN_PIVOTS, in the same order.
    """
    width = _row_bytes(vectors, kind)
    n = int(min(MAX_PIVOTS, max(MIN_PIVOTS, ceil(2 * sqrt(total))), max(MIN_PIVOTS, PIVOT_BYTES // width)))
    rows = vectors.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(min(SAMPLE_A_PIVOT * n, max(n, SAMPLE_BYTES // width))).collect()
    sample = _unit([bytes(r[0]) for r in rows], kind)
    chosen: list[int] = []
    for i, v in enumerate(sample):
        if len(chosen) < n and (not chosen or (sample[chosen] @ v).max() < APART):
            chosen.append(i)
    rest = [i for i in range(len(sample)) if i not in set(chosen)]
    return sample[chosen + rest[: max(0, MIN_PIVOTS - len(chosen))]]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest pivots of unit vectors, nearest first."""
    size = max(x.shape[1], pivots.shape[1])
    near = np.pad(x, ((0, 0), (0, size - x.shape[1]))) @ np.pad(pivots, ((0, 0), (0, size - pivots.shape[1]))).T
    return np.argsort(-near, axis=1, kind="stable")[:, :k].astype(np.int32)


def _list_links(x, lists, weights, nodes, part, key, n_pivots, threshold):
    """Of one inverted list: (u, v, n) rows of edges that join what its pairs join, and of the number of links of each node."""
    a, b = divmod(key, n_pivots)
    ok = x @ x.T >= threshold
    np.fill_diagonal(ok, False)
    if part is not None:
        ok &= part[:, None] != part[None, :]  # two chunks of a list: only pairs across
    if not ok.any():
        return []
    # earlier lists of the same pair: another shared pivot below b; of the pivots that these vectors have, as they are near each other
    used, at = np.unique(lists, return_inverse=True)
    has = np.zeros((len(x), len(used)), np.float32)
    np.put_along_axis(has, at.reshape(lists.shape), 1, axis=1)
    has = has[:, (used < b) & (used != a)]
    ok &= has @ has.T == 0
    out = [(nodes[i], None, n) for i, n in enumerate(ok @ weights) if n]
    left = ok.any(1)
    while left.any():
        root = int(left.argmax())
        left[root] = False
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(ok[front].any(0) & left)
            left[front] = False
            out += [(nodes[root], nodes[j], None) for j in front]
    return out


def pivot_groups(pivots: np.ndarray, n_groups: int) -> np.ndarray:
    """The group of each pivot: the nearest of the first n_groups pivots, which are far from each other."""
    return (pivots @ pivots[:n_groups].T).argmax(1).astype(np.int64)


def list_keys(near: np.ndarray, n_pivots: int) -> np.ndarray:
    """The lists (a * n_pivots + b, a < b) of rows of near pivots."""
    ordered = np.sort(near, axis=1).astype(np.int64)
    a, b = np.triu_indices(near.shape[1], 1)
    return ordered[:, a] * n_pivots + ordered[:, b]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(29)) >> np.uint64(3)


class _Places:
    """Where lists are put together: the number of a list's block, or of chunks if it is long."""

    def __init__(self, n_pivots: int, groups: np.ndarray, long_keys: np.ndarray, chunks: np.ndarray, blocks: np.ndarray, parts: np.ndarray):
        self.n_pivots, self.groups, self.n_groups = n_pivots, groups, int(groups.max(initial=0)) + 1
        self.long_keys, self.chunks, self.blocks, self.parts = long_keys, chunks, blocks, parts

    def whole_block(self, keys: np.ndarray) -> np.ndarray:
        a, b = self.groups[keys // self.n_pivots], self.groups[keys % self.n_pivots]
        return np.minimum(a, b) * self.n_groups + np.maximum(a, b)

    def n_chunks(self, keys: np.ndarray) -> np.ndarray:
        """0 for a list that is not long."""
        if not len(self.long_keys):
            return np.zeros(keys.shape, np.int64)
        at = np.searchsorted(self.long_keys, keys).clip(max=len(self.long_keys) - 1)
        return np.where(self.long_keys[at] == keys, self.chunks[at], 0)

    def block(self, keys: np.ndarray) -> np.ndarray:
        """A block of more than BLOCK_ROWS rows is cut into parts, between its lists."""
        own = self.whole_block(keys)
        at = np.searchsorted(self.blocks, own).clip(max=max(len(self.blocks) - 1, 0))
        parts = np.where(self.blocks[at] == own, self.parts[at], 1) if len(self.blocks) else np.ones(own.shape, np.int64)
        return own << 20 | (_mixed(keys) % parts.astype(np.uint64)).astype(np.int64)


def _counted(indexed: DataFrame, numbers, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of numbers(near) of all rows those that come more than `least` times, ascending, and how often; counted by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, times = np.unique(numbers(_near(batch.column(0).to_pylist())), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(times)], ["number", "n"])

    counts = indexed.select("near").mapInArrow(count, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    rows = counts.orderBy("number").toPandas()  # lists of two pivots, or of two groups: MAX_PIVOTS squared at most
    return rows["number"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def _near(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.int32).reshape(len(rows), -1) if rows else np.zeros((0, 0), np.int32)


def _short_lists(keys: np.ndarray, rows: np.ndarray, x: np.ndarray, threshold: float) -> list[tuple[int, np.ndarray]]:
    """(key, row numbers) of each of many lists that may have a link: products in single precision of lists of like size at once."""
    order = np.lexsort((rows, keys))
    keys, rows = keys[order], rows[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    padded = np.vstack([x.astype(np.float32), np.zeros((1, x.shape[1]), np.float32)])
    out, low = [], 2
    while low <= sizes.max(initial=0):
        own = np.flatnonzero((sizes >= low) & (sizes < 2 * low))
        wide = 2 * low - 1
        for at in range(0, len(own), max(1, 500_000 // (wide * wide))):
            some = own[at : at + max(1, 500_000 // (wide * wide))]
            place = starts[some][:, None] + np.arange(wide)
            member = np.where(np.arange(wide) < sizes[some][:, None], rows[np.minimum(place, len(rows) - 1)], len(x))
            v = padded[member]
            near = v @ v.transpose(0, 2, 1)
            near[:, np.arange(wide), np.arange(wide)] = 0
            out += [(int(keys[starts[i]]), rows[starts[i] : starts[i] + sizes[i]]) for i in some[near.max((1, 2)) >= threshold - 1e-3]]
        low *= 2
    return out


def links(vectors: DataFrame, pivots: np.ndarray, threshold: float, kind: str, list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(u, v, n) of distinct vectors (node, weight, vector): edges u - v that join all linked ones, and rows without v that
    add n (weights of vectors linked) to the links of u.

    Lists of more than list_rows vectors are dealt into chunks, and their pairs of chunks over tasks. Blocks have block_rows
    vectors or BLOCK_BYTES of them, whichever is less.
    """
    n_pivots = len(pivots)
    block_rows = max(2, min(block_rows, BLOCK_BYTES // _row_bytes(vectors, kind)))
    context = vectors.sparkSession.sparkContext
    k = min(n_nearest(n_pivots), n_pivots)
    sent = context.broadcast(pivots)  # MAX_PIVOTS vectors at most

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                near = nearest_pivots(_unit(batch.column("vector").to_pylist(), kind), sent.value, k)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in near], pa.binary())], ["node", "weight", "vector", "near"])

    indexed = materialise(vectors.select("node", "weight", "vector").mapInArrow(index, "node long, weight long, vector binary, near binary"), "pivot-index")
    total = indexed.count()
    # about half of a vector's lists are in blocks of their own
    n_groups = max(1, min(n_pivots, round(sqrt(k * total / block_rows))))
    groups = pivot_groups(pivots, n_groups)
    long_keys, rows = _counted(indexed, lambda near: list_keys(near, n_pivots), list_rows)
    plain = _Places(n_pivots, groups, long_keys, -(-rows // list_rows), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def of_blocks(near: np.ndarray) -> np.ndarray:
        own = np.sort(plain.whole_block(list_keys(near, n_pivots)), axis=1)
        return own[np.c_[np.ones(len(own), bool), own[:, 1:] != own[:, :-1]]] if own.size else own.ravel()

    blocks, rows = _counted(indexed, of_blocks, block_rows)
    sent_places = context.broadcast(_Places(n_pivots, groups, long_keys, plain.chunks, blocks, -(-rows // block_rows)))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row to each block that has short lists of it (i: -1), and to each pair of chunks of its long lists."""
        places = sent_places.value
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                keys = list_keys(_near(batch.column("near").to_pylist()), n_pivots)
                if not keys.size:
                    continue
                chunks = places.n_chunks(keys)
                own = np.sort(np.where(chunks == 0, places.block(keys), -1), axis=1)
                first = (own >= 0) & np.c_[np.ones(len(own), bool), own[:, 1:] != own[:, :-1]]
                r, c = np.nonzero(first)
                out = [(r, own[r, c], np.full(len(r), -1), np.full(len(r), -1), np.zeros(len(r), np.int64))]
                r, c = np.nonzero(chunks)
                if len(r):
                    n = chunks[r, c]
                    mine = (_mixed(batch.column("node").to_numpy()[r]) % n.astype(np.uint64)).astype(np.int64)
                    other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    mine = np.repeat(mine, n)
                    out.append((np.repeat(r, n), np.repeat(keys[r, c], n), np.minimum(mine, other), np.maximum(mine, other), mine))
                for r, place, i, j, chunk in out:
                    for b in range(0, len(r), 20_000):
                        cut = slice(b, b + 20_000)
                        rows = batch.take(pa.array(r[cut]))
                        yield pa.RecordBatch.from_arrays([pa.array(place[cut]), pa.array(i[cut], pa.int32()), pa.array(j[cut], pa.int32()), pa.array(chunk[cut], pa.int32()), *rows.columns], ["place", "i", "j", "chunk", *rows.schema.names])

    def found(rows: list[pa.RecordBatch]) -> list[tuple]:
        table = pa.Table.from_batches(rows)
        place, i, j = (table.column(c)[0].as_py() for c in ("place", "i", "j"))
        near, x = _near(table.column("near").to_pylist()), _unit(table.column("vector").to_pylist(), kind)
        weights, nodes = table.column("weight").to_numpy(), table.column("node").to_numpy()
        if i >= 0:
            part = None if i == j else table.column("chunk").to_numpy()
            return _list_links(x, near, weights, nodes, part, place, n_pivots, threshold)
        places, out = sent_places.value, []
        keys = list_keys(near, n_pivots)
        r, c = np.nonzero((places.n_chunks(keys) == 0) & (places.block(keys) == place))
        for key, own in _short_lists(keys[r, c], r, x, threshold):
            out += _list_links(x[own], near[own], weights[own], nodes[own], None, key, n_pivots, threshold)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (place, i, j); a block or list may span batches."""

        def answer(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            own = found(rows) if sum(map(len, rows)) > 1 else []
            u, v, n = zip(*own, strict=True) if own else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], ["u", "v", "n"])

        rows: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("place", "i", "j")], 1)
            cuts = np.r_[0, np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1, len(at)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if rows and tuple(at[a]) != last:
                    yield answer(rows)
                    rows = []
                rows.append(batch.slice(a, b - a))
                last = tuple(at[a])
        if rows:
            yield answer(rows)

    posted = indexed.mapInArrow(post, "place long, i int, j int, chunk int, node long, weight long, vector binary, near binary")
    return posted.repartition("place", "i", "j").sortWithinPartitions("place", "i", "j").mapInArrow(run, "u long, v long, n long")


def similar_vectors(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id) of each row of `rows` (vec_id, embedding).

    n_links counts the other rows with cosine >= threshold that the index finds, equal vectors among them; component_id
    is the smallest vec_id reachable. A vector without a direction links with nothing, and is its own component. Vectors
    of different lengths are compared as if padded with zeros. Rows without a vec_id count, but name no component.
    """
    rows = rows.select("vec_id", "embedding")
    kind = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"  # as the table has them; the arithmetic is double
    good, none = rows.where(usable(F.col("embedding"))), rows.where(~usable(F.col("embedding")))
    # 128 bits of hash stand for a vector, -0 for 0
    plain = F.transform("embedding", lambda x: x + F.lit(0).cast(kind == "<f4" and "float" or "double"))
    same = F.array(F.xxhash64(plain), F.xxhash64(F.lit(1), plain))
    # equal vectors are one node: groups of copies of any size are counted, not paired
    nodes = good.groupBy(plain.alias("embedding")).agg(F.min("vec_id").alias("least"), F.count("*").alias("weight")).withColumn("same", same)
    nodes = nodes.withColumn("node", F.coalesce("least", F.xxhash64("embedding").bitwiseOR(-(1 << 63))))
    vectors = materialise(nodes.mapInArrow(_packed(["node", "least", "weight", "same"], kind), "node long, least long, weight long, same array<long>, vector binary"), "vectors")
    total, n_rows = vectors.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    found = materialise(links(vectors, choose_pivots(vectors, total, kind), threshold, kind) if total else rows.sparkSession.createDataFrame([], "u long, v long, n long"), "pivot-links")
    label = connected_components(found.where("v IS NOT NULL").select("u", "v"))
    counts = found.where("v IS NULL").groupBy("u").agg(F.sum("n").alias("others"))
    own = vectors.select("node", "least", "weight", "same").join(label.withColumnRenamed("node", "labelled"), F.col("node") == F.col("labelled"), "left")
    own = own.withColumn("component", F.coalesce("component", "node")).join(counts, F.col("node") == F.col("u"), "left")
    own = materialise(own.select("least", "same", "component", "weight", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "vector-components")
    names = own.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    # one component may have most vectors, one vector most rows
    named = join_dealt(own.drop("least"), names, "component", "members", total)
    linked = join_dealt(good.select("vec_id", same.alias("same")), named, "same", "weight", n_rows)
    alone = none.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.select("vec_id", "n_links", "component_id").union(alone)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: All pairs, so for small tables only.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS reached FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""
