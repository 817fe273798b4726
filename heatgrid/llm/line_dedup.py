"""Line de-duplication by a sharded minimal perfect hash over the distinct line keys.

The distinct keys of all lines are split into shards of about `SHARD_KEYS`; each shard gets a minimal perfect hash
(levels of bit arrays, every key owns one bit; its rank is its slot), a fingerprint array and a saturating count array:
a few bytes a key. Documents look their lines up in these arrays: hashes of lines travel to the shard that has them, and
the hashes that are found too often travel back to the texts that have them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.llm.common import HOT_ROWS, MAX_HOT, materialise, portions, table, without

SHARD_KEYS = 65_536
GAMMA = 2.0
PROBES_A_GROUP = 500_000
MAX_HOT_SHARDS = 1 << 18

_INDEX = "shard int, n_keys int, levels binary, fps binary, counts binary"


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line: stripped of ASCII white space, A-Z lower-cased. Null and empty: one empty line."""
    return [line.strip().lower() for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def _long(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _hash(key: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(key, 42), xxhash.xxh32_intdigest(key, 7) & 0xFFFF


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    x = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_levels(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays, as bytes of 0 and 1: at each level the keys that meet no other take their bit, the rest go on."""
    levels = []
    while len(keys):
        if len(levels) > 200:
            raise ValueError("equal keys in a perfect hash")
        size = max(8, -(-int(GAMMA * len(keys)) // 8) * 8)
        at = (_mix(keys, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        keys = keys[~alone[at]]
    return levels


class Shard:
    """One shard's arrays, ready for look-ups."""

    def __init__(self, levels: list[np.ndarray], fps: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.levels, self.fps, self.counts = levels, fps, counts
        self.ranks, n = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits, dtype=np.int64) - 1 + n)
            n += int(bits.sum())
        self.size = n

    @classmethod
    def load(cls, levels: bytes, fps: bytes, counts: bytes, dtype: str) -> Shard:
        own, at = [], 0
        while at < len(levels):
            n = int.from_bytes(levels[at : at + 4], "little")
            own.append(np.unpackbits(np.frombuffer(levels, np.uint8, n, at + 4)).astype(bool))
            at += 4 + n
        return cls(own, np.frombuffer(fps, np.uint16), np.frombuffer(counts, dtype))

    def packed(self) -> bytes:
        return b"".join(len(b := np.packbits(x).tobytes()).to_bytes(4, "little") + b for x in self.levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for a foreign key that falls through all levels."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            at = (_mix(keys[left], i) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.ranks[i][at[hit]]
            left = left[~hit]
        return out

    def count(self, keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
        slot = self.slots(keys)
        ok = (slot >= 0) & (self.fps[slot] == fps)
        return np.where(ok, self.counts[slot], 0)


def count_type(min_docs: int) -> str:
    """The smallest count type that tells counts of at least min_docs from smaller ones; larger counts saturate."""
    return next(t for t in ("uint8", "uint16", "uint32", "uint64") if min_docs <= np.iinfo(t).max)


def key_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h, fp, n): each distinct key of at least min_chars code points and the number of rows of `docs` it is in."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            own: Counter = Counter()
            for text in batch.column(0).to_pylist():
                own.update({k for k in line_keys(text) if len(k) >= min_chars})
            found = [(*_hash(k), n) for k, n in own.items() if len(k.decode("utf-8", "surrogatepass")) >= min_chars]
            h, fp, n = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(fp, pa.int32()), pa.array(n, pa.int64())], ["h", "fp", "n"])

    return docs.select("text").mapInArrow(keys, "h long, fp int, n long").groupBy("h").agg(F.min("fp").alias("fp"), F.sum("n").alias("n"))


def build_index(counts: DataFrame, n_shards: int, min_docs: int) -> DataFrame:
    """One row a shard with its perfect hash, fingerprints and counts."""
    dtype = count_type(min_docs)

    def build(group: pa.Table) -> pa.Table:
        h = group.column("h").to_numpy().view(np.uint64)
        shard = Shard(build_levels(h))
        slot = shard.slots(h)
        fps, counts = np.zeros(len(h), np.uint16), np.zeros(len(h), dtype)
        fps[slot] = group.column("fp").to_numpy()
        counts[slot] = np.minimum(group.column("n").to_numpy(), np.iinfo(dtype).max)
        own = [[group.column("shard")[0].as_py()], [len(h)], [shard.packed()], [fps.tobytes()], [counts.tobytes()]]
        return pa.table([pa.array(x, t) for x, t in zip(own, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["shard", "n_keys", "levels", "fps", "counts"])

    keyed = counts.withColumn("shard", F.pmod(F.col("h"), F.lit(n_shards)).cast("int"))
    return keyed.groupBy("shard").applyInArrow(build, _INDEX)


def _pmod(h: np.ndarray, n: int) -> np.ndarray:
    return np.mod(h.view(np.int64), n)


def _rewrite(docs: DataFrame, gone: str, added: tuple[str, str]) -> DataFrame:
    """Rewrite text without the lines whose hash is in the column `gone`; add the numbers of lines and of dropped lines."""
    fields = [f for f in docs.schema.fields if f.name != gone]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in added]])
    names = [f.name for f in fields]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                kept, lines, dropped = [], [], []
                for text, found in zip(batch.column("text").to_pylist(), batch.column(gone).to_pylist(), strict=True):
                    own = (text or "").split("\n")
                    lines.append(len(own))
                    if found:
                        found = set(found)
                        keys = line_keys(text)
                        left = [x for x, k in zip(own, keys, strict=True) if not k or _long(_hash(k)[0]) not in found]
                        text = "\n".join(left)
                    dropped.append(len(own) - len(left) if found else 0)
                    kept.append(text)
                cols = [pa.array(kept, pa.string()) if n == "text" else batch.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, *added])

    return docs.mapInArrow(rewrite, schema)


def hot_shards(counts: DataFrame, n_shards: int, total: int) -> dict[int, int]:
    """shard -> tasks of the shards that get more than about PROBES_A_GROUP of the `total` probes; MAX_HOT_SHARDS at most."""
    share = max(PROBES_A_GROUP, -(-total // MAX_HOT_SHARDS))
    probes = counts.groupBy(F.pmod(F.col("h"), F.lit(n_shards)).cast("int").alias("shard")).agg(F.sum("n").alias("n"))
    return {shard: -(-n // share) for shard, n in probes.where(F.col("n") > share).collect()}


def found_lines(texts: DataFrame, index: DataFrame, n_shards: int, hot: dict[int, int], min_docs: int, min_chars: int) -> DataFrame:
    """(tk, gone) of texts (tk, text): the hashes of their lines whose count in the index is min_docs at least.

    Probes carry hashes, no text, one for each different line of a text. A shard with many of them, as it has a frequent
    line, is dealt over tasks, each with a copy of the shard's arrays: copies are as many as all probes need.
    """
    dtype = count_type(min_docs)
    sent = texts.sparkSession.sparkContext.broadcast(hot)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = np.ones(n_shards if sent.value else 0, np.int64)
        for shard, n in sent.value.items():
            salts[shard] = n
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                tks, hs, fps = [], [], []
                # copies in a batch are asked for once
                for tk, text in dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)).items():
                    own = {_hash(k) for k in line_keys(text) if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode("utf-8", "surrogatepass")) >= min_chars)}
                    tks += [tk] * len(own)
                    hs += [x[0] for x in own]
                    fps += [x[1] for x in own]
                h, tk = np.array(hs, np.uint64), np.array(tks, np.int64)
                shard = _pmod(h, n_shards)
                # neighbours go to different copies, whatever texts and lines they are of
                salt = (_mix(tk.view(np.uint64) + h, 3) % salts[shard].astype(np.uint64)).astype(np.int32) if len(salts) else np.zeros(len(h), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(salt), pa.array(tk), pa.array(h.view(np.int64)), pa.array(fps, pa.int32())], ["shard", "salt", "tk", "h", "fp"])

    def look(probe: pa.Table, arrays: pa.Table) -> pa.Table:
        hit = np.zeros(len(probe), bool)
        if len(arrays) and len(probe):
            shard = Shard.load(*(arrays.column(c)[0].as_py() for c in ("levels", "fps", "counts")), dtype)
            hit = shard.count(probe.column("h").to_numpy().view(np.uint64), probe.column("fp").to_numpy().astype(np.uint16)) >= min_docs
        return probe.select(["tk", "h"]).filter(pa.array(hit))

    asked = texts.mapInArrow(probes, "shard int, salt int, tk long, h long, fp int")
    dealt = texts.sparkSession.createDataFrame(sorted(hot.items()), "hot int, salts int")
    index = index.join(F.broadcast(dealt), F.col("shard") == F.col("hot"), "left")
    copies = index.select("shard", "levels", "fps", "counts", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    hits = asked.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(look, "tk long, h long")
    return hits.groupBy("tk").agg(F.collect_set("h").alias("gone"))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, lines_column: str = "n_lines", dropped_column: str = "n_dropped") -> DataFrame:
    """Drop all lines whose key is in at least `min_docs` rows of `docs`; adds the numbers of lines (before) and of dropped lines.

    Every row counts as a document (repeated rows each count). A null text is one empty line and stays null; empty keys
    (shorter than min_chars code points) never go; a text may become empty. Other columns pass through; own columns
    named as those two are replaced. An empty table gives an empty table.
    """
    added = (lines_column, dropped_column)
    docs = without(docs, *added)
    counts = materialise(key_counts(docs, min_chars), "line-counts")
    n_keys, n_probes = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_shards = max(1, -(-n_keys // SHARD_KEYS))
    index = materialise(build_index(counts, n_shards, min_docs), "line-index")
    tk = F.coalesce(F.xxhash64("text"), F.lit(0))
    found = found_lines(docs.where("text IS NOT NULL").select(tk.alias("tk"), "text"), index, n_shards, hot_shards(counts, n_shards, n_probes), min_docs, min_chars)
    # copies of one text may be a third of all rows: they are dealt over tasks
    copies = docs.groupBy(tk.alias("__hot")).agg(F.count("*").alias("__n"))
    share = max(HOT_ROWS, -(-docs.count() // MAX_HOT))
    hot = F.broadcast(materialise(copies.where(F.col("__n") > share).select("__hot", F.ceil(F.col("__n") / share).cast("int").alias("__salts")), "hot-texts"))  # MAX_HOT rows at most
    salts = F.coalesce("__salts", F.lit(1))
    own = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if c != "text" and "map<" not in t] or ["text"])
    dealt = docs.withColumn("__tk", tk).join(hot, F.col("__tk") == F.col("__hot"), "left").withColumn("__salt", F.pmod(own, salts).cast("int")).drop("__hot", "__salts")
    found = found.withColumnsRenamed({"tk": "__tk", "gone": "__gone"}).join(hot, F.col("__tk") == F.col("__hot"), "left")
    found = found.select("__tk", "__gone", F.explode(F.sequence(F.lit(0), salts - 1)).alias("__salt"))
    return _rewrite(dealt.join(found, ["__tk", "__salt"], "left").drop("__tk", "__salt"), "__gone", added)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.coalesce("text", F.lit(""))
    return drop_common_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, row_number() OVER () AS rid FROM documents),
l AS (SELECT rid, i, ls[i] AS line,
        translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
c AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10),
m AS (SELECT l.rid, l.i, l.line, c.k IS NOT NULL AS gone FROM l LEFT JOIN c ON l.k = c.k),
g AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM m GROUP BY rid)
SELECT d.doc_id, g.n_lines, g.n_dropped, sha256(g.kept) AS kept_sha256 FROM d JOIN g USING (rid)
"""
