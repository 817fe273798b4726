"""Order MinHash document fingerprints, in DataFrame functions alone.

Words (runs of at most WORD code points that are not white space) give k-mers of K consecutive words; equal k-mers of a
text are numbered by occurrence, so that they differ. Their hashes are dealt over SKETCHES sketches; each keeps its LEAST
smallest, puts these back into text order and hashes the tuple. Moved text keeps the k-mers but not their order, so that
likeness follows edit distance rather than the set of k-mers.

All of it happens inside a row, on sorted arrays of longs that pack (hash, position).
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatgrid.llm.common import table, without

K, SKETCHES, LEAST, WORD = 5, 32, 2, 16
ROWS_A_BUCKET = 2000
MAX_BUCKETS = 65_536

# A k-mer is one long: its sketch (5 bits), the rest of its hash (31 bits), its position (28 bits).
_POS, _BIN = 28, 59
_POS_MASK, _IDENT_MASK = (1 << _POS) - 1, (1 << (_BIN - _POS)) - 1
#: Steps of the binary descent that counts equal neighbours: up to 2^28 - 1 occurrences.
_STEPS = [1 << b for b in range(_POS - 1, -1, -1)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sketch(x: Column) -> Column:
    return F.shiftrightunsigned(x, _BIN)


def _packed(h: Column, position: Column) -> Column:
    return F.shiftleft(F.shiftright(h, _POS), _POS).bitwiseOR(position)


def _numbered(kmers: Column) -> Column:
    """Sorted k-mers, where each but the first of equal ones gets another hash, by the number of equal ones before it."""

    def same(x: Column, at: Column) -> Column:
        return F.shiftright(F.get(kmers, at), _POS) == F.shiftright(x, _POS)

    def renamed(x: Column, i: Column) -> Column:
        def step(seen: Column, jump: Column) -> Column:
            far = i - seen - jump
            return F.when((far >= 0) & same(x, far), seen + jump).otherwise(seen)

        jumps = F.filter(F.array(*[F.lit(s) for s in _STEPS]), lambda s: s <= i)  # a longer one cannot hit
        before = F.aggregate(jumps, F.lit(0), step)
        again = _packed(F.xxhash64(F.shiftright(x, _POS), before), x.bitwiseAND(_POS_MASK))
        return F.when((i > 0) & same(x, i - 1), again).otherwise(x)

    return F.sort_array(F.transform(kmers, renamed))


def _kmers(words: Column) -> Column:
    """Sorted longs of the occurrence-numbered k-mers."""
    count = F.greatest(F.size(words) - (K - 1), F.least(F.size(words), F.lit(1)))
    hashes = F.transform(F.slice(words, F.lit(1), count), lambda _, i: F.xxhash64(F.slice(words, i + 1, F.lit(K))))

    def numbered(hashes: Column) -> Column:
        kmers = F.sort_array(F.transform(hashes, lambda h, i: _packed(h, i.bitwiseAND(_POS_MASK).cast("long"))))
        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeats, let(kmers, _numbered)).otherwise(kmers)

    return let(hashes, numbered)


def _least(kmers: Column) -> Column:
    """The LEAST smallest k-mers of each sketch."""
    return F.filter(kmers, lambda x, i: (i < LEAST) | (_sketch(F.get(kmers, i - LEAST)) != _sketch(x)))


def _tuples(chosen: Column) -> Column:
    """One long a sketch that has k-mers: its number and the hash of its k-mers in text order."""

    def one(x: Column, i: Column) -> Column:
        own = F.filter(F.slice(chosen, i + 1, F.lit(LEAST)), lambda y: _sketch(y) == _sketch(x))
        # position first, so that sorting restores the text order
        turned = F.transform(own, lambda y: F.shiftleft(y.bitwiseAND(_POS_MASK), _BIN - _POS).bitwiseOR(F.shiftright(y, _POS).bitwiseAND(_IDENT_MASK)))
        in_order = F.xxhash64(F.transform(F.sort_array(turned), lambda y: y.bitwiseAND(_IDENT_MASK)))
        tagged = F.shiftleft(_sketch(x), _BIN).bitwiseOR(F.shiftrightunsigned(in_order, 64 - _BIN))
        return F.when((i == 0) | (_sketch(F.get(chosen, i - 1)) != _sketch(x)), tagged)

    return F.filter(F.transform(chosen, one), lambda x: x.isNotNull())


def signature(text: Column) -> Column:
    """The sketches of a text as an array of at most SKETCHES longs; null, empty and blank texts have none."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"\S{{1,{WORD}}}"), F.lit(0))
    return let(let(let(words, _kmers), _least), _tuples)


def as_string(sketches: Column) -> Column:
    """16 hex digits a sketch, in order of the sketches."""
    return F.array_join(F.transform(sketches, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches among those that either has; 1 for two texts without words."""
    tags = F.array_union(F.transform(a, _sketch), F.transform(b, _sketch))
    return F.when(F.size(tags) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(tags))


def with_next(docs: DataFrame, columns: list[str], prefix: str = "next_", rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """Add to each row columns of the row with the next doc_id (after the last: the first), with one shuffle.

    Rows go to ranges of doc_id of about rows_a_bucket rows; the first rows of each range also go to the range before,
    as guests. A null doc_id comes before all others; rows with equal ids follow each other by text.
    """
    docs = docs.withColumn("__key", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    n = docs.count()
    buckets = min(MAX_BUCKETS, max(1, ceil(n / rows_a_bucket)))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set((docs.agg(F.percentile_approx("__key", shares, max(10_000, 4 * buckets))).first()[0] or []) if shares and n else []))
    # how many cuts are not above a key, by halves in one array that is sent once
    steps = F.array(*[F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)] or [F.lit(0)])
    fits = lambda at: (at <= F.size("__cuts")) & (F.get(F.col("__cuts"), at - 1) <= F.col("__key"))
    bucket = F.aggregate(steps, F.lit(0), lambda at, step: F.when((step > 0) & fits(at + step), at + step).otherwise(at))
    sent = docs.sparkSession.createDataFrame([(cuts,)], "__cuts array<bigint>")  # one row of MAX_BUCKETS numbers at most
    docs = docs.crossJoin(F.broadcast(sent)).withColumn("__bucket", bucket).drop("__cuts")
    firsts = sorted(docs.groupBy("__bucket").agg(F.min("__key")).collect())  # a row a bucket
    hosts = [(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)]
    guests = docs.sparkSession.createDataFrame(hosts, "__first long, __host int")
    own = F.struct(F.col("__bucket").alias("bucket"), F.lit(0).alias("lap"))
    # the first row of all follows the last: a lap later
    last = F.col("__host") >= F.col("__bucket")
    guest = F.struct(F.col("__host").alias("bucket"), last.cast("int").alias("lap"))
    placed = docs.join(F.broadcast(guests), F.col("__key") == F.col("__first"), "left").withColumn("__guest", F.col("__first").isNotNull())
    placed = placed.withColumn("__at", F.explode(F.when(F.col("__guest"), F.array(F.struct(own.alias("p"), F.lit(False).alias("g")), F.struct(guest.alias("p"), F.lit(True).alias("g")))).otherwise(F.array(F.struct(own.alias("p"), F.lit(False).alias("g"))))))
    order = Window.partitionBy("__at.p.bucket").orderBy("__at.p.lap", "__key", "text")
    moved = placed.withColumns({prefix + c: F.lead(c).over(order) for c in columns})
    return moved.where("NOT __at.g").drop("__key", "__bucket", "__first", "__host", "__guest", "__at")


def edited(text: Column, other: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many of another text (or all it has)."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint whole texts: docs with `signature` (array of longs) and `fingerprint` (string) added.

    Null, empty and blank texts: no sketches, an empty string. Equal texts have equal fingerprints. Own columns of these
    names are replaced.
    """
    docs = without(docs, "signature", "fingerprint")
    return docs.withColumn("signature", signature(F.col("text"))).withColumn("fingerprint", as_string(F.col("signature")))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs.withColumn("signature", signature(F.col("text"))), ["text", "signature"])
    docs = docs.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    docs = docs.withColumn("edited_signature", signature(F.col("edited")))
    return docs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("signature")).alias("fingerprint"),
        as_string(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
