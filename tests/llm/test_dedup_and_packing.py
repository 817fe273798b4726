import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from public_tokenizers import path

from heatgrid.llm import line_dedup, packing, simhash

DOCS = "doc_id long, text string, lang string, N_Lines int, tk string, line int"


def brute_lines(rows, min_docs):
    key = lambda x: x.encode().strip().lower()
    where = {}
    for i, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            where.setdefault(key(line), set()).add(i)
    out = []
    for d, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if not key(x) or len(where[key(x)]) < min_docs]
        out.append((d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def line_rows():
    rows = [(i, f"Common Line \nown {i}\n\n é {i % 7}\x0b\n") for i in range(12)]
    return [*rows, (12, None), (13, ""), (14, "common line"), (15, "x" * 200_000), (3, rows[3][1]), (None, "own 3\n COMMON LINE\t")]


@pytest.mark.parametrize(("probes", "hot"), [(line_dedup.PROBES_A_GROUP, line_dedup.HOT_ROWS), (3, 2)])
def test_lines_against_brute_force(spark, monkeypatch, probes, hot):
    monkeypatch.setattr(line_dedup, "PROBES_A_GROUP", probes)
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8 if hot == 2 else line_dedup.SHARD_KEYS)
    rows = line_rows()
    docs = spark.createDataFrame([(*r, "en", 1, "t", 2) for r in rows], DOCS)
    got = line_dedup.drop_common_lines(docs, min_docs=3)
    assert got.columns == ["doc_id", "text", "lang", "tk", "line", "n_lines", "n_dropped"]
    own = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect()), key=str)
    assert own == brute_lines(rows, 3)


def test_lines_of_no_documents(spark):
    assert line_dedup.drop_common_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_copies_of_an_index_grow_with_the_probes(spark, monkeypatch):
    """Twice the texts, twice the copied bytes, though a third of all probes asks for one line."""
    monkeypatch.setattr(line_dedup, "PROBES_A_GROUP", 100)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 64)
    sent = {}
    for n in (400, 800):
        docs = spark.createDataFrame([(i, f"common\nown {i}\nother {i}") for i in range(n)], "doc_id long, text string")
        counts = line_dedup.key_counts(docs).cache()
        total = counts.agg({"n": "sum"}).first()[0]
        shards = max(1, -(-counts.count() // 64))
        hot = line_dedup.hot_shards(counts, shards, total)
        assert hot and sum(hot.values()) <= 2 * total / 100
        index = line_dedup.build_index(counts, shards, 10)
        sent[n] = sum(len(r.fps) * hot.get(r.shard, 1) for r in index.collect())
    assert sent[800] < 2.5 * sent[400]


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    shard = line_dedup.Shard(line_dedup.build_levels(keys))
    assert sorted(shard.slots(keys)) == list(range(len(keys)))


def brute_simhash(text, k=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= bits:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_simhash_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    extra = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "Two words"), (10**6 + 3, "two WORDS "), (10**6 + 4, "word " * 70_000)]
    rows += extra
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    fps = [brute_simhash(t) for _, t in rows]
    label = components(fps, 4)
    want = {d: (f, rows[c][0]) for (d, _), f, c in zip(rows, fps, label, strict=True)}
    got = {r.doc_id: (r.fingerprint % 2**64, r.component_id) for r in simhash.similar_groups(docs).collect()}
    assert got == want
    kept = {r.doc_id for r in simhash.drop_similar(docs).collect()}
    assert kept == {c for _, c in want.values()}


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 3000)
    other = words ^ (1 << rng.integers(0, 23, 3000)) ^ (1 << rng.integers(0, 23, 3000))
    a, b = simhash.golay_keys(words), simhash.golay_keys(other)
    assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b, strict=True))


def test_fingerprint_keys_find_every_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    fps = [int(b) ^ sum({1 << int(x) for x in rng.integers(0, 64, rng.integers(0, 5))}) for b in base for _ in range(40)]
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fingerprint long")
    links = {(r.u % 2**64, r.v % 2**64) for r in simhash.fingerprint_links(frame).collect()}
    assert all((u ^ v).bit_count() <= 4 for u, v in links)
    at = {f: i for i, f in enumerate(fps)}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in links:
        parent[max(root(at[u]), root(at[v]))] = min(root(at[u]), root(at[v]))
    assert [root(i) for i in range(len(fps))] == components(fps, 4)


def test_groups_without_ids_or_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "other text here at all"), (7, "a b c d e f"), (7, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.similar_groups(docs).collect()), key=str)
    assert got == sorted([(None, 7), (None, None), (7, 7), (7, 7)], key=str)
    assert simhash.drop_similar(docs).count() == 3
    assert simhash.similar_groups(docs.limit(0)).count() == 0


def test_a_repeated_id_loses_no_group(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "wholly unrelated words about sailing and the sea", "a third text on bread, flour, ovens and salt")
    rows = [(7, a, "x"), (7, b, "y"), (8, a, "z"), (3, b, "v"), (7, a, "x"), (9, c, "1"), (9, "something else on trains and railway stations", "2"), (None, c, "n"), (10, c, "3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    kept = simhash.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3], rows[5], rows[6], rows[7]], key=str)


ODD_TEXTS = [None, "", " \n", "Don't STOP!! <|endoftext|> now", "a\x1cb ΑΣ Σας İi", "é́ ŉ ǅ 12a3 ½", "日本語 テスト x", "w" * 30_000, "a b " * 9000, "it's they're,he'll.'s x' 'ť", "​zero nb ls\x85nel　id"]


def test_cached_tokenizer_is_the_tokenizer(spark, sf_dir):
    from tokenizers import Tokenizer

    inner, own = Tokenizer.from_file(path("word_bpe_49k.json")), packing.WordTokenizer(path("word_bpe_49k.json"))
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ODD_TEXTS
    for text in texts:
        assert np.frombuffer(own.encode(text or ""), "<u4").tolist() == inner.encode(text or "", add_special_tokens=False).ids


def test_cached_tokenizer_on_random_letters():
    """Letters and marks of many scripts, those among them that compose only in small letters."""
    from tokenizers import Tokenizer

    inner, own = Tokenizer.from_file(path("word_bpe_49k.json")), packing.WordTokenizer(path("word_bpe_49k.json"))
    rng = np.random.default_rng(8)
    ranges = [(0x20, 0x7F), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x400), (0x400, 0x530), (0x900, 0x980), (0xE00, 0xE60), (0x1E00, 0x2000), (0x1100, 0x1200), (0xAC00, 0xAC80), (0x2000, 0x2070), (0x300, 0x332)]
    texts = ["H\u0331anukka", "T\u0308", "J\u030cx", "W\u030a Y\u030a", "\u0345\u0391"]
    for _ in range(20_000):
        lo_hi = [ranges[i] for i in rng.integers(0, len(ranges), rng.integers(1, 4))]
        texts += ["".join(chr(c) for lo, hi in lo_hi for c in rng.integers(lo, hi, rng.integers(1, 5)))]
        texts += ["".join(chr(rng.integers(*ranges[k])) for k in rng.choice([0, 1, 2, 7, 11], 3))]
    wrong = [t for t, e in zip(texts, inner.encode_batch(texts, add_special_tokens=False), strict=True) if np.frombuffer(own.encode(t), "<u4").tolist() != e.ids]
    assert not wrong


def test_equal_rows_go_to_different_groups(spark, tmp_path):
    pieces = spark.createDataFrame([(None, 0, 5)] * 4000, "doc_id long, piece int, length long")
    pieces.write.parquet(f"file://{tmp_path}/p")
    rows = packing.pack(spark.read.parquet(f"file://{tmp_path}/p"), 2048, group_pieces=1000).collect()
    groups = np.unique([r.sequence_id >> 32 for r in rows], return_counts=True)[1]
    assert len(groups) == 4 and groups.max() < 1200 and len(rows) == 4000


def test_packing_is_whole_and_gapless(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS * 5)] + [(None, "x"), (3, "x")], "doc_id long, text string")
    rows = packing.pack_documents(docs, path("word_bpe_49k.json"), keep_ids=True).collect()
    assert all(r.length == len(r.ids) // 4 and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    one = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 8)
    assert [p for p, *_ in one] == list(range(len(one))) and all(s == 2048 * p for p, s, _ in one)
    assert all(n == 2048 for *_, n in one[:-1]) and one[-1][2] >= 1
    assert packing.pack_documents(docs.limit(0), path("word_bpe_49k.json")).count() == 0


def test_sum_of_squares_is_the_rule():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 31, 400)
    seq, off = packing.sum_of_squares(lengths, 30)
    gaps, fill = {}, {}
    ss = lambda g: sum(v * v for v in g.values())
    for s, b, o in zip(lengths.tolist(), seq.tolist(), off.tolist(), strict=True):
        options = {}
        for g in [g for g, n in gaps.items() if n and g >= s] + [30]:
            after = dict(gaps)
            if g < 30:
                after[g] -= 1
            if g > s:
                after[g - s] = after.get(g - s, 0) + 1
            options[g] = ss(after)
        g = 30 - fill.get(b, 0)
        assert options[g] == min(options.values()) and o == fill.get(b, 0)
        if g < 30:
            gaps[g] -= 1
        if g > s:
            gaps[g - s] = gaps.get(g - s, 0) + 1
        fill[b] = o + s
