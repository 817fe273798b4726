"""SimHash near-duplicates: 64-bit fingerprints linked at a few differing bits through Golay-code fuzzy hashing.

The (23,12,7) Golay code is perfect: every 23-bit word lies within 3 bits of one codeword. A word's keys are the
codewords within 4 bits (six at most). Two words at most 2 bits apart share a key: the word halfway between them is
within 3 bits of some codeword, so both are within 4 of it.

A fingerprint is cut into segments A and B of 23 bits and C of 18 (padded). At most 4 differing bits leave one of:
 C equal, and A or B at most 2 apart            -> keys (C, golay A), (C, golay B)
 C not equal, so 3 bits at most in A and B:
   both at most 2 apart                         -> keys (golay A, golay B)
   all 3 in one, so the other equal, C 1 apart  -> keys (B, golay C), (A, golay C)
Fingerprints that share a key are compared exactly, in the task that has the key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.llm.common import bounded, join_dealt, materialise, portions, table, without
from heatgrid.llm.graph import connected_components

#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the binary Golay code.
GENERATOR = 0b110001110101
MAX_BITS = 4
#: Buckets of more fingerprints are dealt into chunks, whose pairs are buckets of their own.
BUCKET_ROWS = 10_000
_M23 = np.uint64((1 << 23) - 1)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE = (np.arange(8) * 256).astype(np.int64)


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator."""
    words = words.astype(np.int64)
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
    return words


def _error_table() -> np.ndarray:
    """For each syndrome the error patterns of weight 4 at most, six at most; -1 fills up."""
    patterns = np.array([sum(1 << b for b in c) for w in range(5) for c in combinations(range(23), w)], np.int64)
    out, used = np.full((2048, 6), -1, np.int64), np.zeros(2048, int)
    for e, s in zip(patterns, _syndromes(patterns), strict=True):
        out[s, used[s]] = e
        used[s] += 1
    return out


_ERRORS = _error_table()


def golay_keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices (the 12 data bits) of the codewords within 4 bits of 23-bit words; -1 fills up."""
    words = words.astype(np.int64)
    errors = _ERRORS[_syndromes(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def fingerprint_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All search keys of unsigned 64-bit fingerprints: (keys, number of the fingerprint)."""
    a, b, c = ((fps >> np.uint64(s) & _M23).astype(np.int64) for s in (0, 23, 46))
    ka, kb, kc = golay_keys(a), golay_keys(b), golay_keys(c)
    pair = np.where((ka[:, :, None] < 0) | (kb[:, None, :] < 0), -1, ka[:, :, None] << 12 | kb[:, None, :]).reshape(len(fps), 36)
    keys = np.concatenate([np.where(k < 0, -1, (np.int64(f) << 40) | exact[:, None] << 12 | k) for f, exact, k in ((1, c, ka), (2, c, kb), (4, b, kc), (5, a, kc))] + [np.where(pair < 0, -1, (np.int64(3) << 40) | pair)], axis=1)
    row, col = np.nonzero(keys >= 0)
    return keys[row, col], row


def simhash(text: str | None, shingle: int = 4) -> int:
    """Bit majority over the XXH64 of all word shingles, repeats included; ties give 0, no words give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    h, k = xxhash.xxh64_intdigest, min(shingle, len(words))
    total, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 1 << 16):
        upto = min(n, at + (1 << 16))
        hashes = np.array([h(joined[a : b - 1], 42) for a, b in zip(starts[at:upto], starts[at + k : upto + k], strict=True)], np.uint64)
        by_byte = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048).reshape(8, 256)
        total += (by_byte @ _BITS).ravel()
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """Add `fingerprint` (the 64 bits as a signed long) of whole texts.

    Null, empty and blank texts have fingerprint 0; equal texts and repeated rows equal ones. Other columns pass through,
    an own column of that name (in any case) is replaced. An empty table gives an empty one.
    """
    docs = without(docs, "fingerprint")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            fps = np.array([simhash(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], [*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.LongType())]))


def _links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join the fingerprints of one bucket as all links of at most max_bits would: breadth first, each found once."""
    out, left = [], np.arange(len(fps))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= max_bits
            out += [(i, j) for j in left[near]]
            front += list(left[near])
            left = left[~near]
    return out


def _bucket_links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a bucket may span batches."""

        def found(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            edges = []
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
            sizes = np.diff(np.r_[starts, len(keys)])
            small = np.repeat(sizes <= 8, sizes)
            for shift in range(1, 8):
                if len(keys) > shift:
                    at = np.flatnonzero((keys[shift:] == keys[:-shift]) & small[shift:] & (np.bitwise_count(fps[shift:] ^ fps[:-shift]) <= max_bits))
                    edges.append(np.stack([fps[at], fps[at + shift]], 1))
            for s, n in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
                if own := _links(fps[s : s + n], max_bits):
                    edges.append(fps[s : s + n][np.array(own)])
            both = np.concatenate(edges) if edges else np.zeros((0, 2), np.uint64)
            both = np.unique(np.sort(both, 1), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["u", "v"])

        keys, fps = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            last = np.searchsorted(k, k[-1]) if len(k) else 0
            if len(k) and last == 0 and len(keys[-1]) and keys[-1][0] == k[0]:
                keys.append(k)  # still the same bucket
                fps.append(f)
            elif len(k):
                yield found(np.concatenate([*keys, k[:last]]), np.concatenate([*fps, f[:last]]))
                keys, fps = [k[last:]], [f[last:]]
        yield found(np.concatenate(keys), np.concatenate(fps))

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (u, v) between distinct fingerprints that join all that differ in at most max_bits (4 at most) bits.

    Keys that more than bucket_rows fingerprints have are dealt into chunks of that size; every two chunks meet in a
    bucket of their own, so that no link is lost and no task holds an unbounded bucket.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys find links of at most {MAX_BITS} bits")
    fps = materialise(fps.select("fingerprint").distinct(), "fingerprints")
    # a number of tasks that is stated stays: rows that grow 47-fold are not put into a few
    tasks = max(fps.sparkSession.sparkContext.defaultParallelism, ceil(fps.count() / 20_000))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 5000):
                own = whole.column(0).slice(at, 5000).to_numpy().view(np.uint64)
                keys, row = fingerprint_keys(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[row].view(np.int64))], ["key", "fingerprint"])

    keyed = fps.repartition(tasks).mapInArrow(spread, "key long, fingerprint long")
    long = keyed.groupBy("key").count().where(F.col("count") > bucket_rows)
    long = bounded(materialise(long.select(F.col("key").alias("long_key"), F.ceil(F.col("count") / bucket_rows).cast("int").alias("chunks")), "long-buckets"))
    chunk = F.pmod(F.xxhash64("fingerprint"), F.col("chunks"))
    # a pair of chunks has a key of its own; should it meet another bucket's, they are compared together
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.xxhash64("key", F.least(chunk, other), F.greatest(chunk, other)))
    dealt = keyed.join(long, F.col("key") == F.col("long_key"), "left").select(F.explode(F.when(F.col("chunks").isNull(), F.array("key")).otherwise(pairs)).alias("key"), "fingerprint")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(max_bits), "u long, v long").distinct()


def similar_groups(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable over links, itself included.

    Exact copies share a fingerprint and are one node of the graph. Null and blank texts have fingerprint 0 and are
    linked like any other. Rows whose doc_id is null get a fingerprint and their group's id, but never name a group (a
    group of only such rows has a null id). Repeated rows give repeated rows.
    """
    return _groups(docs, shingle, max_bits).drop("component")


def _groups(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """similar_groups with `component`, which also tells groups apart whose smallest doc_id is the same."""
    own = materialise(with_fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fingerprint"), "simhash")
    nodes = materialise(own.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "simhash-nodes")
    n_nodes, n_rows = nodes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    label = connected_components(fingerprint_links(nodes, max_bits))
    nodes = nodes.join(label, F.col("fingerprint") == F.col("node"), "left").drop("node").withColumn("component", F.coalesce("component", "fingerprint"))
    nodes = materialise(nodes, "simhash-components")
    names = nodes.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    # one component may have most fingerprints, one fingerprint most rows
    named = join_dealt(nodes.drop("least"), names, "component", "members", n_nodes)
    return join_dealt(own, named, "fingerprint", "copies", n_rows).select("doc_id", "fingerprint", "component_id", "component")


def drop_similar(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """Keep the row with the smallest doc_id of each group of similar texts; all columns stay as they are.

    Rows without a doc_id are kept, as no id could name them. Where a doc_id repeats, each group that it names keeps one
    row with it; only such rows need their fingerprint again, to tell them apart.
    """
    groups = materialise(_groups(docs, shingle, max_bits), "simhash-groups")
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(repeated, "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(*docs.columns)
    first = groups.where("doc_id = component_id").join(repeated, "doc_id", "left_semi").select("doc_id", "fingerprint", "component").distinct()
    several = docs.join(repeated, "doc_id", "left_semi").select("doc_id", "text", F.struct(*docs.columns).alias("__row"))
    several = with_fingerprints(several, shingle).join(first, ["doc_id", "fingerprint"]).dropDuplicates(["doc_id", "component"])
    return once.unionByName(several.select("__row.*"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return similar_groups(table(spark, sf_dir, "documents")).select("doc_id", hexed.alias("fingerprint"), "component_id")
