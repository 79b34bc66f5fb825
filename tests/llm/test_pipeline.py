"""The pipeline's stages on odd rows, each against what it decides row by row; the packing query against the tokenizer."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from waymark.llm import decontaminate, near_dup, packing, quality

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    """Documents, with nulls in every column, empty and repeated rows, a leaked item, a secret, and columns that clash."""
    base = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("length(text) > 200").orderBy("item_id").head().text
    good = base.where("length(text) > 800").orderBy("doc_id").head().asDict()
    new = lambda **kw: good | kw
    rows = [
        dict.fromkeys(good), new(doc_id=900001, text=None), new(doc_id=900002, text=""), new(doc_id=900003, text=good["text"] + " own words at the end"), new(doc_id=900003, text=good["text"] + " own words at the end"),
        new(doc_id=900004, text=item), new(doc_id=900005, text=good["text"] + " password=hunter2222 and more"), new(doc_id=None), new(doc_id=900006, source=None, lang=None, n_chars=None),
    ]
    odd = spark.createDataFrame([tuple(r[c] for c in base.columns) for r in rows], base.schema)
    return base.limit(40).unionByName(odd).selectExpr("*", "1 as score", "'x' as class_id", "2 as digest")


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", [n for n in STAGES if n != "packing"])
def test_stages_keep_columns_and_take_nothing(spark, docs, name):
    out = STAGES[name](spark, docs, FOLDER)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert STAGES[name](spark, docs.limit(0), FOLDER).count() == 0


def test_quality_stage(spark, docs):
    model = quality.model_of(spark, docs, FOLDER)
    want = [r for r in docs.collect() if model.predict(quality.features(r.text)[None])[0] >= quality.THRESHOLD]
    assert rows_of(STAGES["quality"](spark, docs, FOLDER)) == sorted(map(str, want))


def test_near_dup_stage(spark, docs):
    classes = {(r.doc_id, r.class_id) for r in near_dup.classes(docs).collect()}
    kept = STAGES["near_dup"](spark, docs, FOLDER).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert sorted(ids) == sorted({c for d, c in classes if d is not None}) and sum(r.doc_id is None for r in kept) == 2


def test_decontaminate_stage(spark, docs):
    fitted = decontaminate.fit(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    gone = {r.doc_id for r in decontaminate.leaks(docs, fitted).collect()}
    assert 900004 in gone
    assert sorted(str(r.doc_id) for r in STAGES["decontaminate"](spark, docs, FOLDER).collect()) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in gone or r.doc_id is None)


def test_secrets_stage(spark, docs):
    before, after = ({(r.doc_id, r.source): r for r in df.collect()} for df in (docs, STAGES["secrets"](spark, docs, FOLDER)))
    assert set(before) == set(after)
    r = after[900005, before[900005, next(s for d, s in before if d == 900005)].source]
    assert "hunter2222" not in r.text and "[SECRET]" in r.text and r.n_chars == len(r.text)


def test_op9_query_against_the_tokenizer(spark):
    tokenizer = packing.WordIds(packing.TOKENIZER).tokenizer
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    pieces, sequences = {}, {}
    for r in packing.op9_packing(spark, FOLDER).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(text)
    for k, own in pieces.items():
        ids, at = np.array([*tokenizer.encode(text[k] or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(ids[at : at + r.length].tobytes()), len(ids))
            at += r.length
        assert at == len(ids)
    used = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.MAX_TOKENS
        used += at
    assert sorted(sequences) == list(range(len(sequences))) and len(sequences) <= used / packing.MAX_TOKENS * 1.05 + 2
