"""The pipeline against a brute-force version of its stages."""

import os
import zlib

import numpy as np
from public_tokenizers import path

import corpus_pipeline
from heatgrid.llm import langid
from test_dedup_and_packing import brute_simhash, components

D = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    source = spark.read.parquet(f"{D}/documents.parquet")
    base = [tuple(r) for r in source.collect()]
    common = "\nA line that very many documents share."
    rows = [(d, (t or "") + common if d % 3 == 0 else t, *rest) for d, t, *rest in base]
    rows += [(10**6, None, None, None, 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "123 456 --", "en", "s", 10), (10**6 + 3, common[1:], "en", "s", 38), (10**6 + 4, common[1:], None, None, None), (10**6 + 5, rows[1][1], *rows[1][2:])]
    spark.createDataFrame(rows, source.schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    model = langid.train_on_documents(docs)
    found = {r[0]: model.predict(r[1]) for r in rows}
    kept = sorted((r[:2] for r in rows if found[r[0]][0] != "und" and found[r[0]][1] >= model.min_score))
    assert len(rows) - len(kept) >= 3

    key = lambda line: line.encode().strip().lower()
    where = {}
    for d, t in kept:
        for line in t.split("\n"):
            where.setdefault(key(line), set()).add(d)
    kept = [(d, "\n".join(x for x in t.split("\n") if not key(x) or len(where[key(x)]) < 10)) for d, t in kept]
    assert all(common[1:] not in t for _, t in kept)

    label = components([brute_simhash(t) for _, t in kept], 4)
    kept = [row for i, row in enumerate(kept) if label[i] == i]

    inner = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = {}
    for d, t in kept:
        ids = [*inner.encode(t, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[d, k] = (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").withColumnRenamed("source", "N_Lines")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, D).columns == docs.columns, name
        assert stage(spark, docs.limit(0), D).count() == 0
    assert corpus_pipeline.pack(spark, docs.limit(0), D).count() == 0


def test_a_run_leaves_its_result_alone(spark, sf_dir):
    """What stages write on their way, and all stages but the last, are removed when the next one is written."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    tables = lambda: {x for x in os.listdir(folder) if any(f.endswith(".parquet") for f in os.listdir(os.path.join(folder, x)))}
    before = tables()
    docs = corpus_pipeline.run(spark, sf_dir)
    assert [x.rsplit("-", 1)[0] for x in tables() - before] == ["stage-best_fit_packing"]
    assert docs.count() > 0
