"""Spelling variants: words one edit apart, by composition of finite-state machines.

An acceptor A of the vocabulary, a transducer E that copies its input but for one inserted, deleted or replaced
character, and A again: the pairs that A o E o A accepts are the near words. A pair reads x, its edit, then y; of its
characters half lie before the edit or half after. So the composed machine falls apart by initial states: the state after
the first half of a word, copied, and in the machine of the reversed words that after the reversed second half. Words
are dealt by these states; a task minimises the acceptor of what follows a state, and enumerates the accepted pairs from
it on. A state that more than MAX_WORDS words pass is split by its arcs: one child for each next character, copied, and
the states after an edit there, which are as many as the characters of the alphabet at most.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgrid.llm.common import MAX_BROADCAST_ROWS, materialise, table

MIN_LENGTH, MIN_COUNT, FACTOR = 5, 3, 2
MAX_WORDS = 1000
#: Different words that a task counts before it hands them on.
COUNTED = 300_000
MAX_ROUNDS = 100

RUN = "[a-zÀ-ÿ]"


# ---- words


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_one_in: int = 97) -> DataFrame:
    """(word, n): maximal runs of Latin letters of whole texts (doc_id, text), with A-Z lower-cased, and how often they come.

    With h the crc32 of `<doc_id>:<run>`, a run whose h `drop_one_in` divides loses its code point h % length. Words
    have at least min_length code points and min_count occurrences. Null texts have none; a null doc_id is written as an
    empty one; repeated rows count each; an empty table gives none.
    """
    find = re.compile(RUN + f"{{{min_length},}}").findall  # shorter runs cannot become words

    def table_of(own: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(find(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % drop_one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    own[word] += n
                if len(own) >= COUNTED:
                    yield table_of(own)
                    own.clear()
        if own:
            yield table_of(own)

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---- machines


class Acceptor:
    """Minimal acyclic acceptors of sorted words; states of equal right language are one, in all acceptors of this object."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = [{}]  # state 0 accepts the end
        self.known: dict[tuple, int] = {}
        self.met: dict[tuple[int, int], list[str]] = {}

    def state(self, arcs: dict[str, int]) -> int:
        key = tuple(arcs.items())
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
        return found

    def compile(self, words: list[str]) -> int:
        """The start state of an acceptor of sorted, different words of one length; of no words, a state without arcs."""
        if not words or not words[0]:
            return 0 if words else self.state({})
        path: list[dict[str, int]] = [{}]  # arcs of the states along the last word, that are not minimised yet
        last = ""
        for word in [*words, ""]:
            same = 0
            while same < min(len(word), len(last)) and last[same] == word[same]:
                same += 1
            end = 0
            for i in range(len(last) - 1, same - 1, -1):
                if i + 1 < len(last):
                    end = self.state(path.pop())
                path[i][last[i]] = end
            path.extend({} for _ in range(same, len(word) - 1))
            last = word
        return self.state(path[0])

    def both(self, a: int, b: int) -> list[str]:
        """What both states accept; each path of the product is walked once."""
        key = (a, b) if a <= b else (b, a)
        found = self.met.get(key)
        if found is None:
            found, todo = [], [(a, b, "")]
            while todo:
                p, q, text = todo.pop()
                # characters that both take alone, without a choice
                while p != 0 or q != 0:
                    here, there = self.arcs[p], self.arcs[q]
                    common = here.keys() & there.keys()
                    if len(common) != 1:
                        todo.extend((here[c], there[c], text + c) for c in common)
                        break
                    (c,) = common
                    p, q, text = here[c], there[c], text + c
                else:
                    found.append(text)
            self.met[key] = found
        return found

    def one_edit(self, short: int, long: int) -> Iterator[tuple[str, str]]:
        """Pairs that differ by one edit: two words of `short` by a replaced character, or a word of it and one of `long` by an inserted one.

        x, which both copy, is the longest that they have in common, so that each pair comes once.
        """
        arcs = self.arcs
        todo: list[tuple[int | None, int | None, str]] = [(short, long, "")]
        while todo:
            p, q, x = todo.pop()
            here, there = arcs[p] if p is not None else {}, arcs[q] if q is not None else {}
            if len(here) > 1:
                for (a, s), (b, t) in combinations(here.items(), 2):
                    for y in self.both(s, t):
                        yield x + a + y, x + b + y
            if p is not None and q is not None:
                for b, t in there.items():
                    for y in self.both(p, t):
                        if y[:1] != b:
                            yield x + y, x + b + y
            for c, s in here.items():
                t = there.get(c)
                if arcs[s] or t is not None:
                    todo.append((s, t, x + c))


def common_start(a: str, b: str) -> int:
    n = 0
    for c, d in zip(a, b, strict=False):
        if c != d:
            break
        n += 1
    return n


def _state_pairs(kind: str, length: int, depth: int, left: str, words: list[tuple[str, int]]) -> Iterator[tuple[tuple[str, int], tuple[str, int]]]:
    """Pairs of the words that pass one initial state: of `length`, and of `length` and one more, code points."""
    reverse, split = kind[0] == "S", len(kind) > 1
    after = len(left) if split else 0
    tails: dict[str, tuple[str, int]] = {}
    short, long = [], []
    for word, n in words:
        own = word[::-1] if reverse else word
        tail = own[depth : len(own) - after]
        tails[tail] = (word, n)
        (short if len(word) == length else long).append(tail)
    machine = Acceptor()
    for a, b in machine.one_edit(machine.compile(sorted(short)), machine.compile(sorted(long))):
        v, w = tails[a], tails[b]
        # a pair belongs to one state: to that of the first halves if they are equal
        if reverse and common_start(v[0], w[0]) >= length // 2:
            continue
        # after an edit: to the last place where it can be
        if split and (common_start(v[0][::-1], w[0][::-1]) if reverse else common_start(v[0], w[0])) != depth:
            continue
        yield v, w


# ---- deal and enumerate


def _states(words: DataFrame) -> DataFrame:
    """The initial states that each word passes, as the shorter (or equal) and as the longer of a pair."""
    n = F.length("word")
    one = lambda kind, length: F.struct(F.lit(kind).alias("kind"), length.cast("int").alias("len"), (F.floor(length / 2) if kind == "P" else F.ceil(length / 2)).cast("int").alias("depth"))
    each = words.select("word", "n", F.explode(F.array(one("P", n), one("P", n - 1), one("S", n), one("S", n - 1))).alias("s"))
    own = F.when(F.col("s.kind") == "S", F.reverse("word")).otherwise(F.col("word"))
    return each.select("word", "n", F.col("s.kind").alias("kind"), F.col("s.len").alias("len"), F.col("s.depth").alias("depth"), F.substring(own, F.lit(1), F.col("s.depth")).alias("right"), F.lit("").alias("left"))


_STATE = ["kind", "len", "depth", "right", "left"]


def _split(states: DataFrame, max_words: int) -> tuple[DataFrame, DataFrame | None]:
    """States of at most max_words words, and the others' children (None where there are none)."""
    shared = F.sum(F.lit(1)).alias("__n")
    own = F.when(F.col("kind") == "S", F.reverse("word")).otherwise(F.col("word"))
    first, last = F.split("__first", ""), F.split("__last", "")
    differs = F.zip_with(first, last, lambda a, b: ~a.eqNullSafe(b))
    hot = states.where(F.length("kind") == 1).groupBy(*_STATE).agg(shared, F.min(own).alias("__first"), F.max(own).alias("__last")).where(F.col("__n") > max_words)
    # what all have in common is no choice: the state after it is split
    hot = materialise(hot.select(*_STATE, (F.array_position(differs, True) - 1).cast("int").alias("__at")), "hot-states")
    n_hot = hot.count()
    if not n_hot:
        return states, None
    hot = F.broadcast(hot) if n_hot <= MAX_BROADCAST_ROWS else hot
    cold = states.join(hot.select(*_STATE), _STATE, "left_anti")
    own, at = F.when(F.col("kind") == "S", F.reverse("word")).otherwise(F.col("word")), F.col("__at")
    child = lambda kind, depth, right, left: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), depth.alias("depth"), right.alias("right"), left.alias("left"))
    upto = F.substring(own, F.lit(1), at)
    rest = lambda start: F.substring(own, start + 1, F.length(own))
    is_short = F.length("word") == F.col("len")
    deeper = child(F.col("kind"), at + 1, F.substring(own, F.lit(1), at + 1), F.lit(""))
    replaced = F.when(is_short, child(F.concat("kind", F.lit("r")), at, upto, rest(at + 1)))
    inserted = child(F.concat("kind", F.lit("i")), at, upto, F.when(is_short, rest(at)).otherwise(rest(at + 1)))
    split = states.join(hot, _STATE).select("word", "n", "len", F.explode(F.array_compact(F.array(deeper, replaced, inserted))).alias("s"))
    return cold, split.select("word", "n", "s.kind", "len", "s.depth", "s.right", "s.left")


def near_words(words: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(word, n_near, best): of each word (word, n; different words) that has near ones, their number and the near word of largest n as (minus n, word); ties go to the smallest in code-point order."""
    done, todo = [], materialise(_states(words), "spelling-states")
    for _ in range(MAX_ROUNDS):
        cold, split = _split(todo, max_words)
        done.append(cold)
        if split is None:
            break
        todo = materialise(split, "spelling-states")
    else:
        raise RuntimeError(f"states of more than {max_words} words after {MAX_ROUNDS} splits")
    states = done[0]
    for more in done[1:]:
        states = states.unionByName(more)

    def enumerate_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}

        def finish(key: tuple, words: list[tuple[str, int]]) -> None:
            if len(words) < 2:
                return
            kind, length, depth, _, left = key
            for v, w in _state_pairs(kind, length, depth, left, words):
                for own, other in ((v, w), (w, v)):
                    best = (-other[1], other[0])
                    have = found.get(own[0])
                    if have is None:
                        found[own[0]] = [1, best]
                    else:
                        have[0] += 1
                        have[1] = min(have[1], best)

        def rows() -> pa.RecordBatch:
            best = pa.StructArray.from_arrays([pa.array([x[1][0] for x in found.values()], pa.int64()), pa.array([x[1][1] for x in found.values()], pa.string())], ["minus_n", "word"])
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array([x[0] for x in found.values()], pa.int64()), best], ["word", "n_near", "best"])
            found.clear()
            return out

        key, own = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*_STATE, "word", "n")]
            for *state, word, n in zip(*columns, strict=True):
                if state != key:
                    finish(key, own)
                    key, own = state, []
                    if len(found) >= COUNTED:
                        yield rows()
                own.append((word, n))
        finish(key, own)
        if found:
            yield rows()

    # words of a state follow each other in one task; the rows of a word from its states are few
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = states.repartition(parts, *_STATE).sortWithinPartitions(*_STATE)
    pairs = dealt.mapInArrow(enumerate_, "word string, n_near long, best struct<minus_n:long,word:string>")
    return pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variant_forms(words: DataFrame, factor: int = FACTOR, max_words: int = MAX_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n; different words).

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that has at least factor
    times its own n, else null. From form to form n grows by the factor, so the way to the root ends after a few steps;
    each step is a join of the words that have not come to it with their forms' roots, of which a word is asked for by
    its near words alone.
    """
    words = materialise(words.select("word", "n"), "vocabulary")
    own = words.join(near_words(words, max_words), "word", "left")
    fits = -F.col("best.minus_n") >= factor * F.col("n")
    own = own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.minus_n")).alias("form_n"))
    own = materialise(own, "spelling-forms")
    ended = own.where("form IS NULL").select("word", F.col("word").alias("root"))
    roots, todo = [ended], own.where("form IS NOT NULL").select("word", "form")
    while not todo.isEmpty():
        now = todo.join(ended.withColumnsRenamed({"word": "form"}), "form", "left")
        now = materialise(now, "spelling-roots")
        ended = now.where("root IS NOT NULL").select("word", "root")
        roots.append(ended)
        todo = now.where("root IS NULL").select("word", "form")
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return own.join(out, "word").select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_forms(count_words(table(spark, sf_dir, "documents")))
