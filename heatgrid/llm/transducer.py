"""SentencePiece encoding and decoding by weighted finite-state transducers over the tropical semiring (min, +).

Three machines are compiled from a model file, each a tree of states with an arc a character:
 the normaliser: the rules of the character map, their replacements as output (the longest rule at a place wins; any
   other character goes to itself), then white space and a leading U+2581;
 the pieces: a path for each, its id as output and minus its score as weight;
 the byte fallback: any other character to its UTF-8 bytes, or to the unknown id.
An input is a machine with a place before and after each character. Composed with the normaliser it gives one path, the
normalised text; that composed with the closure of the pieces and the fallback gives a lattice whose states are places
and whose arcs are pieces; its shortest path is the encoding. The normaliser has exactly one output for an input, and
composition is associative: so the lattice of that output is the composition of all of them, and no state of the
normaliser has to be carried along.

 unigram model: an arc weighs minus the piece's score.
 BPE model: a state is a place and the piece that ends there; an arc weighs 0 if the two pieces beside each other are
   what merging gives for their concatenation, else infinity. Merges never cross the ends of a final piece, so a path of
   finite weight has the same pieces as merging the whole, and there is one such path for every prefix.
 word and character models: the only pieces are words, or single characters.

Where no piece has two neighbouring characters next to each other, no arc crosses, and the input can be cut: texts are
encoded cut by cut, and cuts that recur are kept.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.llm.common import table, without

SPACE = "▁"
UNIGRAM, BPE, WORD, CHAR = 1, 2, 3, 4
CACHED = 800_000  # words, cuts and weights in all that a worker keeps, about 250 bytes each; what comes later is computed again


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            value = data[at : at + n]
            at += n
        yield key >> 3, value


class Tree:
    """States, each with an arc a character to the next one; under None the output of a state where a string ends."""

    def __init__(self, strings: dict):
        self.start: dict = {}
        for string, output in strings.items():
            state = self.start
            for c in string:
                state = state.setdefault(c, {})
            state[None] = output

    def walk(self, text: str, at: int) -> Iterator[tuple[int, object]]:
        """(place after, output) of every string of the tree that the text has from a place on."""
        state = self.start
        for j in range(at, len(text)):
            state = state.get(text[j])
            if state is None:
                return
            if None in state:
                yield j + 1, state[None]


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double-array tree of UTF-8 strings, then their replacements, ended by zeros."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    labels = np.arange(1, 256)
    out, todo = {}, [(b"", int(offset(units[0])))]
    while todo:
        key, at = todo.pop()
        to = at ^ labels
        own = np.where(to < len(units), units[np.minimum(to, len(units) - 1)], 0)
        for c in labels[(own & 0x800000FF) == labels].tolist():
            unit = int(units[at ^ c])
            below = at ^ c ^ offset(unit)
            if unit >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                out[(key + bytes([c])).decode("utf-8")] = texts[start : texts.index(b"\0", start)].decode("utf-8")
            todo.append((key + bytes([c]), below))
    return out


class Transducer:
    """The compiled machines of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        # fixed numbers of the model format
        pieces = [dict(_fields(v)) for k, v in model if k == 1]
        trainer = {k: v for n, spec in model if n == 2 for k, v in _fields(spec)}
        rules = {k: v for n, spec in model if n == 3 for k, v in _fields(spec)}
        self.kind, self.lead, self.squeeze = trainer.get(3, UNIGRAM), bool(rules.get(3, 1)), bool(rules.get(4, 1))
        if trainer.get(24) or not rules.get(5, 1):
            raise NotImplementedError("white space after words, or not escaped")
        self.text = [p[1].decode("utf-8") for p in pieces]
        self.score = [struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0] for p in pieces]
        kinds = [p.get(3, 1) for p in pieces]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
        self.ids = {self.text[i]: i for i, k in enumerate(kinds) if k == 1}
        self.unknown = kinds.index(2)
        self.bytes = {int(self.text[i][3:5], 16): i for i, k in enumerate(kinds) if k == 6}
        self.low = min((self.score[i] for i in self.ids.values()), default=0.0) - 10.0  # an unknown character's score
        # symbols of the user are kept as they are by the normaliser, and by merging; in unigram models they are pieces that weigh next to nothing
        self.own = {self.text[i]: i for i, k in enumerate(kinds) if k == 4}
        self.own_symbol = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.own, key=len, reverse=True)) + ")") if self.own else None
        if self.kind != BPE:
            best = max((self.score[i] for i in self.ids.values()), default=0.0)
            for x, i in self.own.items():
                self.score[i] = len(x.encode()) * max(best, 0.0) - 0.1
            self.ids |= self.own
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.sticky = any(b == SPACE != a for a, b in self.pairs)  # a piece goes over the end of a word
        self.output = [bytes([int(t[3:5], 16)]) if k == 6 else t.replace(SPACE, " ").encode() if k in (1, 4) else b"" if k == 3 else " ⁇ ".encode() for t, k in zip(self.text, kinds, strict=True)]
        mapped = character_map(rules.get(2, b""))
        self.map = Tree(mapped)
        firsts = "".join(map(re.escape, sorted({x[0] for x in (*mapped, *self.own)})))
        self.first = re.compile(f"[{firsts}]") if firsts else None
        self.tree = Tree(self.ids)
        self.fits: dict[str, dict[str, float]] = {}
        self.words: dict[str, bytes] = {}
        self.kept: dict[str, bytes] = {}
        self.n_kept = self.n_composed = 0  # in all three

    # ---- compiled parts

    def mapped(self, text: str) -> str:
        """The text composed with the rules of the character map: at each place the longest rule, symbols of the user as they are."""
        out, at = [], 0
        while m := self.first and self.first.search(text, at):
            start = m.start()
            out.append(text[at:start])
            symbol = self.own_symbol and self.own_symbol.match(text, start)
            at, put = (symbol.end(), symbol[0]) if symbol else (start + 1, text[start])
            if not symbol:
                for end, output in self.map.walk(text, start):
                    if output is not None:
                        at, put = end, output
            out.append(put)
        return "".join(out) + text[at:] if out else text

    def normalise(self, text: str) -> str:
        text = self.mapped(text)
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        text = text.replace(" ", SPACE)
        text = SPACE + text if text and self.lead else text
        return text.rstrip(SPACE) if self.squeeze else text

    def fallback(self, char: str) -> list[int]:
        """A character that is no piece: its bytes, or the unknown id."""
        own = [self.bytes.get(b) for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown] if None in own or not own else own

    def merged(self, text: str) -> list[str]:
        """What merging gives: again and again the pair with the best score, the leftmost of equals, becomes one."""
        parts = list(text)
        while True:
            best, at = -inf, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and self.score[found] > best:
                    best, at = self.score[found], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def weight(self, last: str, piece: str) -> float:
        """Of an arc with `piece` from a state whose last piece is `last`."""
        if self.kind != BPE:
            return -self.score[self.ids[piece]] if piece in self.ids else -self.low
        row = self.fits.get(last)
        found = row.get(piece) if row else None
        if found is None:
            found = 0.0 if not last or self.merged(last + piece) == [last, piece] else inf
            if self.n_kept < CACHED:
                self.n_kept += 1
                self.fits.setdefault(last, {})[piece] = found
        return found

    # ---- composition and shortest path

    def shortest(self, text: str) -> list[str]:
        """Pieces of the lightest path through the lattice of a normalised text, places taken in order.

        From each place the arcs of the pieces' tree are followed, so that none is looked for in vain.
        """
        n, weight, bpe, kind, start = len(text), self.weight, self.kind == BPE, self.kind, self.tree.start
        fits = self.fits
        dist, last, back = [0.0] + [inf] * n, [""] * (n + 1), [0] * (n + 1)
        for i in range(n):
            here = dist[i]
            if here == inf:
                continue
            before, state, j = last[i], start, i
            known = fits.get(before) or {}  # weights of arcs after the piece that ends here
            while j < n and state is not None:
                state = state.get(text[j])
                j += 1
                # a piece ends here, or a single character has the fallback's arc; character and word models have those alone
                if (j == i + 1 and kind != WORD) or (state is not None and None in state and kind != CHAR and (kind != WORD or j == n)):
                    # in a BPE model the first path of finite weight to a place is the only one
                    if not bpe or dist[j] == inf:
                        piece = text[i:j]
                        w = known.get(piece)
                        d = here + (weight(before, piece) if w is None else w)
                        if d < dist[j]:
                            dist[j], last[j], back[j] = d, piece, i
        if dist[n] == inf:
            return [text]  # a word that is no piece
        out, j = [], n
        while j:
            out.append(last[j])
            j = back[j]
        return out[::-1]

    def cut_ids(self, cut: str) -> bytes:
        ids = [i for p in self.shortest(cut) for i in ([self.ids[p]] if p in self.ids else self.fallback(p))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def cuts(self, text: str) -> list[str]:
        """A normalised text cut where no piece crosses."""
        if self.kind == WORD:
            return re.findall(f"{SPACE}?[^{SPACE}]+|{SPACE}", text)
        out, start = [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in self.pairs:
                out.append(text[start:i])
                start = i
        return [*out, text[start:]] if text else []

    def cut(self, cut: str) -> bytes:
        own = self.kept.get(cut)
        if own is None:
            own = self.cut_ids(cut)
            if len(cut) <= 64 and self.n_kept < CACHED:
                self.n_kept += 1
                self.kept[cut] = own
        return own

    def word(self, word: str) -> bytes:
        """Ids of a word with a space before it, where it may be cut before that space and after it.

        What follows a cut is looked up apart, so that a word is kept once; with punctuation only a part is kept. A word
        of any length is cut in one pass.
        """
        own = self.words.get(word)
        if own is not None:
            return own
        if len(word) > 1 and word[-2:] not in self.pairs and (own := self.words.get(word[:-1])) is not None:
            own += self.cut(word[-1])
            return self.keep(word, own, True)
        first, *rest = self.cuts(SPACE + word)
        if not rest:
            return self.keep(word, self.cut_ids(first), False)
        head = first[1:]
        own = self.words.get(head) if head else self.cut(first)
        if own is None:
            own = self.keep(head, self.cut_ids(first), False)
        return self.keep(word, b"".join([own, *map(self.cut, rest)]), True)

    def keep(self, word: str, own: bytes, composed: bool) -> bytes:
        if len(word) <= 64 and self.n_kept < CACHED and (not composed or self.n_composed < CACHED // 6):
            self.n_kept += 1
            self.n_composed += composed
            self.words[word] = own
        return own

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        words = text.split(" ")
        plain = self.kind in (UNIGRAM, BPE) and not (self.sticky or self.squeeze or not self.lead or "" in words or SPACE in text)
        if not plain or not text or (self.first and self.first.search(text)):
            text = self.normalise(text)
            if self.kind == BPE and self.own_symbol:
                parts = self.own_symbol.split(text)  # every second one is a symbol
                own = b"".join([struct.pack("<I", self.own[x]) if k % 2 else b"".join(map(self.cut, self.cuts(x))) for k, x in enumerate(parts)])
            else:
                own = b"".join(map(self.cut, self.cuts(text)))
        else:
            got = self.words.get
            out = [got(w) for w in words]
            if None in out:
                out = [self.word(w) if o is None else o for w, o in zip(words, out, strict=True)]
            own = b"".join(out)
        return own if self.bytes else self.merged_unknowns(own)

    def merged_unknowns(self, ids: bytes) -> bytes:
        """Without bytes to fall back on, a run of unknown characters is one unknown id."""
        own = np.frombuffer(ids, "<u4")
        again = (own[1:] == self.unknown) & (own[:-1] == self.unknown)
        return own[np.r_[True, ~again]].tobytes() if again.any() else ids

    def decode(self, ids: bytes) -> str:
        """Text of ids: pieces and bytes side by side, the leading space taken off."""
        output = self.output
        text = b"".join([output[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if self.lead and text.startswith(" ") else text


_MACHINES: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    """One compiled machine a worker process and model."""
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(path)
    return _MACHINES[path]


def _mapped(df: DataFrame, column: str, added: str, kind: T.DataType, arrow: pa.DataType, function) -> DataFrame:
    """Add a column that function() of another gives, a few hundred rows at a time."""
    df = without(df, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = function()
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([apply(x) for x in batch.column(column).to_pylist()], arrow)], [*batch.schema.names, added])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(added, kind)]))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Add `ids` (little-endian unsigned 32-bit) of each whole text; null and empty texts have none.

    Repeated rows give repeated rows, an empty table an empty one. Very long texts are encoded whole, with or without
    white space, in time that follows their length. Other columns stay; one named ids (in any case) is replaced.
    """
    return _mapped(docs, "text", "ids", T.BinaryType(), pa.binary(), lambda: lambda t, m=machine(path): m.encode(t or ""))


def decode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Add `decoded`, the text of `ids`; null and empty ids give an empty text. Rows and other columns as in encode_documents."""
    return _mapped(docs, "ids", "decoded", T.StringType(), pa.string(), lambda: lambda i, m=machine(path): m.decode(i or b""))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents: number and digest of the ids, digest of the decoded text, whether it came back."""
    from public_tokenizers import path

    model = path("piece_bpe_32k.model")
    docs = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    docs = decode_documents(docs, model)
    return docs.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_ids"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(SPACE), F.lit(" "))).alias("came_back"),
    )
