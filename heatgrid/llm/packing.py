"""Packing of tokenised documents into fixed-length sequences by the sum-of-squares rule.

A document goes where the sum of the squared numbers of open sequences per residual gap becomes smallest: into an open
sequence of gap g >= its length s (one fewer of gap g, one more of gap g - s), or into a new one. A full sequence
has no gap and counts nothing. Pieces are taken longest first, so that short ones close what the long ones left open.
"""

from __future__ import annotations

import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.llm.common import materialise, table, without

CAPACITY = 2048
GROUP_PIECES = 100_000
CACHED_WORDS = 800_000  # of a worker; about 200 bytes each


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, the same as the tokenizer's own, with words cached.

    A pre-tokenizer that never joins across white space makes a text's ids the concatenation of its words' ids.
    Texts for which that could fail (special tokens in the text, odd white space, letters that compose only once they are
    small) go to the tokenizer whole and as they came.
    """

    #: Split by str.split() but no white space to the tokenizer.
    ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "᠎")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.inner.get_added_tokens_decoder().values())
        self.words: dict[str, bytes] = {}
        self.letters = self._byte_letters()
        # a word of letters alone is one pre-token: the model can take it without the steps before
        self.direct = all(self.model(w) == self.whole(w) for w in ("probe", "größe", "ñandú", "語彙", "électroencéphalographiste"))

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """The byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def model(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join([self.letters[b] for b in word.encode("utf-8", "surrogatepass")])
        ids = [t.id for t in self.inner.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        return np.array(self.inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Trailing punctuation is looked up apart, so that a word is cached once."""
        if len(word) > 1 and word[-1] in ".,;:!?" and (head := word[:-1]).isalpha():
            own = self.get(head) + self.get(word[-1])
        elif self.direct and word.isalpha():
            own = self.model(word)
        else:
            own = self.whole(word)
        if len(self.words) < CACHED_WORDS and len(word) <= 64:
            self.words[word] = own
        return own

    def get(self, word: str) -> bytes:
        own = self.words.get(word)
        return self.word(word) if own is None else own

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or any(c in text for c in self.ODD):
            return self.whole(text)
        if text.isascii():
            words = text.lower().split()
        else:
            small = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final sigma
            if not unicodedata.is_normalized("NFC", small):
                return self.whole(text)  # words would be composed a second time
            words = small.split()
        got = self.words.get
        out = [got(w) for w in words]
        if None in out:
            out = [self.get(w) if o is None else o for w, o in zip(words, out, strict=True)]
        return b"".join(out)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Replace text by its ids, cut into pieces: adds piece, start, length and ids (little-endian unsigned 32-bit).

    A document is its ids, then end_id; a null or empty text is end_id alone. Only documents of more than `capacity`
    ids are cut, into pieces of `capacity`, the last may be shorter.
    """
    docs = without(docs, "piece", "start", "length", "ids")
    names = [c for c in docs.columns if c != "text"]
    add = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
    schema = T.StructType([docs.schema[c] for c in names] + add)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                row, piece, ids = [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    own = encode(text or "") + end
                    for k, a in enumerate(range(0, len(own), 4 * capacity)):
                        row.append(i)
                        piece.append(k)
                        ids.append(own[a : a + 4 * capacity])
                kept = [batch.column(c).take(pa.array(row, pa.int64())) for c in names]
                new = [pa.array(piece, pa.int32()), pa.array([k * capacity for k in piece], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(kept + new, [*names, "piece", "start", "length", "ids"])

    return docs.mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(number of the sequence, offset in it) of each length, placed one after the other in the order given.

    Where several places are equally good, the fullest open sequence that fits is taken.
    """
    open_, n = np.zeros(capacity + 1, np.int64), 0
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, s in enumerate(lengths.tolist()):
        # change of the sum: (N[g]-1)^2 - N[g]^2 + (N[g-s]+1)^2 - N[g-s]^2 for g = s .. capacity
        added = 2 * open_[: capacity + 1 - s] + 1
        added[0] = 0  # a full sequence counts nothing
        here = open_[s:]
        change = np.where(here > 0, added + 1 - 2 * here, np.iinfo(np.int64).max)
        change[-1] = added[-1]  # a new sequence
        g = int(change.argmin()) + s
        if g == capacity:
            b, n = n, n + 1
        else:
            b = stacks[g].pop()
            open_[g] -= 1
        seq[i], off[i] = b, capacity - g
        if g > s:
            stacks[g - s].append(b)
            open_[g - s] += 1
    return seq, off


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to written pieces (doc_id, piece, length, ...): gapless sequences of at most `capacity`.

    Pieces are dealt at random (by a hash of each row's place in its file, so that equal rows part) into groups
    of about group_pieces, packed apart from one another; each leaves a few sequences part full, which is nothing beside the
    group's. Rows with equal lengths follow by doc_id and piece, nulls last. An empty table gives an empty one.
    """
    pieces = without(pieces, "sequence_id", "offset", "__group", "__at")
    groups = max(1, -(-pieces.count() // group_pieces))
    # written pieces keep their order in their files, so a row that is read again has the same number
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), "length"), F.lit(groups)).cast("int"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(group: pa.Table) -> pa.Table:
        key = int(group.column("__group")[0].as_py())
        own = group.drop_columns(["__group"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        seq, off = sum_of_squares(own.column("length").to_numpy(), capacity)
        return own.append_column("sequence_id", pa.array(seq + (key << 32))).append_column("offset", pa.array(off))

    return dealt.groupBy("__group").applyInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenise and pack `docs` (doc_id, text): one row a piece, with ids_crc32 of its ids, and the ids if asked for.

    Null texts are empty documents (one id). Repeated rows are packed as often as they come. An empty table gives none.
    """
    pieces = token_pieces(docs.select("doc_id", "text"), path, capacity).withColumn("ids_crc32", F.crc32("ids"))
    pieces = materialise(pieces if keep_ids else pieces.drop("ids"), "token-pieces")
    return pack(pieces, capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs, path("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
