import math
import random

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path

from heatgrid.llm import transducer

MODEL = path("piece_bpe_32k.model")
ODD = ["", " ", "  ", " a", "a ", "a  b   c", "x\ny\n\n z", "▁▁ raw ▁x", "héllo wörld ½ ﬁ", "日本語テスト", "😀 emoji 👩‍👩‍👧", "aaaaaaaaaaaaaaaaa", "\t\ttabs", "a" * 3000, "<s> </s> <unk> <0x41>", "é combining", "www.example.com/a?b=c&d", "return    x;  # 4 spaces", "\x00\x01", "MixedCASE123 456,789.00"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(machine, text):
    return np.frombuffer(machine.encode(text), "<u4").tolist()


def test_the_library_gives_the_same_ids(library, spark, sf_dir):
    machine = transducer.Transducer(MODEL)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rng = random.Random(2)
    texts += ["".join(rng.choice(["the", " ", "ing", "é", "▁", "1", ".", "\n", "x", "Q", "  ", "ation", "日"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    for text in texts:
        own = machine.encode(text)
        assert np.frombuffer(own, "<u4").tolist() == library.encode(text)
        assert machine.decode(own) == library.decode(library.encode(text)) == text.replace("▁", " ")


def test_cuts_change_nothing(library):
    machine = transducer.Transducer(MODEL)
    for text in ODD:
        if len(text) < 200:
            own = machine.normalise(text)
            pieces = [p for c in machine.cuts(own) for p in machine.shortest(c)]
            assert pieces == machine.shortest(own) == machine.merged(own)


def test_unigram_paths_are_the_lightest():
    machine = transducer.Transducer(MODEL)
    machine.kind = transducer.UNIGRAM
    rng = random.Random(1)
    score = lambda parts: sum(machine.weight("", p) for p in parts)

    def all_paths(text):
        if not text:
            yield []
        for n in range(1, len(text) + 1):
            if text[:n] in machine.ids or n == 1:
                for rest in all_paths(text[n:]):
                    yield [text[:n], *rest]

    for _ in range(30):
        text = "".join(rng.choice("theinga▁日") for _ in range(9))
        assert score(machine.shortest(text)) == pytest.approx(min(map(score, all_paths(text))))


def test_documents(spark):
    docs = spark.createDataFrame([(None, None, b"clash")] + [(i, t, None) for i, t in enumerate(ODD)], "doc_id long, text string, IDS binary")
    done = transducer.decode_documents(transducer.encode_documents(docs, MODEL), MODEL)
    assert done.columns == ["doc_id", "text", "ids", "decoded"]
    assert {r.decoded for r in done.collect()} == {t.replace("▁", " ") for t in ODD}
    assert transducer.encode_documents(docs.limit(0), MODEL).count() == 0


def varint(n):
    return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])


def message(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def piece(text, kind, score=0.0):
    return message(1, message(1, text.encode()) + b"\x15" + np.float32(score).tobytes() + b"\x18" + bytes([kind]))


def changed(tmp_path, kind=2, rule=None, symbols=(), fallback=True, squeeze=1):
    """The model with another kind, character map, symbols of the user, or without its bytes; what follows in a message overrides."""
    with open(MODEL, "rb") as f:
        data = f.read()
    if not fallback:
        fields = list(transducer._fields(data))
        data = b"".join(message(k, v) for k, v in fields if not (k == 1 and dict(transducer._fields(v)).get(3) == 6))
        data += message(2, b"\x98\x02\x00")
    if kind == transducer.UNIGRAM:  # ranks of merges are no probabilities; these are like such
        own = [(k, dict(transducer._fields(v))) for k, v in transducer._fields(data)]
        data = b"".join(piece(v[1].decode(), v.get(3, 1), -4 - math.log1p(i)) if k == 1 else message(k, raw) for i, ((k, v), (_, raw)) in enumerate(zip(own, transducer._fields(data), strict=True)))
    data += message(2, b"\x18" + bytes([kind]))
    if rule:
        spec = [v for k, v in transducer._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()) if k == 3][0]
        data += message(3, spec + b"\x18\x01\x20" + bytes([squeeze]))
    data += b"".join(piece(x, 4) for x in symbols)
    own = tmp_path / "own.model"
    own.write_bytes(data)
    return transducer.Transducer(str(own)), sentencepiece.SentencePieceProcessor(model_file=str(own))


def odd_texts(n=250):
    rng = random.Random(5)
    bits = ["the", " ", "ing", "é", "▁", "1", ".", "\n", "x", "Q", "  ", "ation", "日", "ﬁ", "Ａ", "①", "\u3000", "e\u0301", "½", "カ\u3099", "\u200b", "™", "㌔", "<ent>", "New York", "ﷺ", "😀"]
    return [t for t in ODD if len(t) < 500] + ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(n)]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_the_character_map_normalises_as_the_library_does(rule, tmp_path):
    own, library = changed(tmp_path, rule=rule)
    assert len(own.map.start) > 1000
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    for text in odd_texts():
        assert own.normalise(text) == normaliser.normalize(text)
        assert ids(own, text) == library.encode(text)


@pytest.mark.parametrize("kind", [transducer.UNIGRAM, transducer.BPE, transducer.WORD, transducer.CHAR])
@pytest.mark.parametrize("fallback", [True, False])
def test_kinds_of_models_against_the_library(kind, fallback, tmp_path):
    own, library = changed(tmp_path, kind, "nmt_nfkc" if fallback else None, fallback=fallback)
    for text in odd_texts():
        assert ids(own, text) == library.encode(text), text


@pytest.mark.parametrize("kind", [transducer.UNIGRAM, transducer.BPE])
def test_symbols_of_the_user_against_the_library(kind, tmp_path):
    own, library = changed(tmp_path, kind, "nmt_nfkc", symbols=("<ent>", "①", "ing1", "<entity>"))
    loose, other = changed(tmp_path, kind, "nmt_nfkc", symbols=("<ent>", "①"), squeeze=0)
    assert all(ids(loose, t) == other.encode(t) for t in odd_texts())
    for text in [*odd_texts(), "a<ent>b <entity>①②ing1 sing1 ing"]:
        assert ids(own, text) == library.encode(text), text


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(transducer, "CACHED", 20)
    small, texts = transducer.Transducer(MODEL), odd_texts(60)
    own = [small.encode(t) for t in texts]
    assert len(small.words) + len(small.kept) + sum(map(len, small.fits.values())) == 20
    monkeypatch.setattr(transducer, "CACHED", 800_000)
    large = transducer.Transducer(MODEL)
    assert own == [large.encode(t) for t in texts]


def test_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", b"x", "y")] * 3, "doc_id long, text string, Ids binary, DECODED string")
    done = transducer.decode_documents(transducer.encode_documents(docs, MODEL), MODEL)
    assert done.columns == ["doc_id", "text", "ids", "decoded"] and [r.decoded for r in done.collect()] == ["a b"] * 3


@pytest.mark.parametrize("letters", ["0123456789", "的一是不了人我在有他", "😀🎉👍", "a1的😀.,é-", "的", "abcdefghij"])
def test_long_runs_without_a_space(library, letters):
    machine, r = transducer.Transducer(MODEL), random.Random(len(letters))
    for n in (999, 1000, 1001, 100_000):
        text = "".join(r.choice(letters) for _ in range(n))
        assert ids(machine, text) == library.encode(text)


def test_a_long_run_in_a_table(spark, library):
    docs = spark.createDataFrame([(1, "的" * 5000), (2, "1" * 20_000)], "doc_id long, text string")
    done = transducer.decode_documents(transducer.encode_documents(docs, MODEL), MODEL).orderBy("doc_id").collect()
    assert [len(r.ids) // 4 for r in done] == [len(library.encode(t)) for t in ("的" * 5000, "1" * 20_000)]
    assert [r.decoded for r in done] == ["的" * 5000, "1" * 20_000]
