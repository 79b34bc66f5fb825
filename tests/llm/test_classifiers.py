"""Language, quality and toxicity: held-out accuracy, and odd inputs."""

import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from waymark.llm import language_id, quality, toxicity
from waymark.llm.common import id_crc

FOLDER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "12 !? 34"), (4, "the and of it"), (4, "the and of it"), (None, "le la les"), (5, "x" * 200_000), (6, "😀 ok")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def odd(spark):
    rows = [(i, t if t is None else t.encode("utf-16", "surrogatepass").decode("utf-16"), "x", 1, 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, lang_pred int, severity int")


def test_language_held_out(spark, docs):
    found = language_id.op3_language_id(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_scores_match_the_kernel(spark, docs):
    """Brute force: kernel values pair by pair from the sets themselves."""
    rows = docs.limit(40).collect()
    flags = [language_id.presence(r.text) for r in rows]
    model = language_id.train(np.stack([np.packbits(f) for f in flags]), [r.lang for r in rows], landmarks=8)
    kept = model.columns >= 0
    land = np.unpackbits(model.landmarks, axis=1, count=model.width).astype(bool)
    labels, scores = model.scorer()([r.text for r in rows])
    for r, f, label, score in zip(rows, flags, labels, scores):
        own = f[kept]
        k = np.array([np.sum(own & m) / np.sqrt(own.sum() * m.sum()) for m in land])
        z = language_id.SHARPNESS * (k @ model.weights)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert label == model.langs[p.argmax()]
        assert score == pytest.approx(p.max(), abs=1e-4)


def test_language_odd_inputs(spark, docs):
    model = language_id.fit(docs.where(id_crc("doc_id") % 5 != 0))
    got = language_id.classify(odd(spark), model).collect()
    assert len(got) == len(ODD)
    assert [r.lang_pred for r in got][:3] == ["und"] * 3 and got[0].score == 0
    nothing = language_id.fit(docs.where("lang is null"))
    assert {r.lang_pred for r in language_id.classify(odd(spark), nothing).collect()} == {"und"}
    assert language_id.classify(odd(spark).limit(0), model).count() == 0


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality.op6_quality(spark, FOLDER).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_tables_add_up():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (3000, len(quality.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only the pair tells
    model = quality.train(x, y)
    assert any({i, j} == {0, 1} for i, j, _ in model.pairs)
    p = model.predict(x)
    assert np.mean((p > 0.5) == y) > 0.95
    z = model.base + sum(t[np.searchsorted(c, x[:1, j], side="right")] for j, (c, t) in enumerate(zip(model.cuts, model.tables)))
    z = z + sum(t[np.searchsorted(model.pair_cuts[i], x[:1, i], side="right"), np.searchsorted(model.pair_cuts[j], x[:1, j], side="right")] for i, j, t in model.pairs)
    assert p[0] == pytest.approx((1 / (1 + np.exp(-z)))[0])


def test_quality_odd_inputs(spark, docs):
    assert quality.Model(0.0).predict(np.zeros((2, len(quality.FEATURES)), np.float32)).tolist() == [0.5, 0.5]
    model = quality.train(np.zeros((5, len(quality.FEATURES)), np.float32), np.ones(5))
    assert quality.score(odd(spark), model).count() == len(ODD)
    assert quality.keep(odd(spark), model).columns == odd(spark).columns
    assert quality.score(odd(spark).limit(0), model).count() == 0


def test_toxicity_held_out(spark):
    """Learned from two thirds of the labels, read against the rest."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = labels.where(id_crc("doc_id") % 3 == 0).select("doc_id", F.col("toxic").alias("marked"))
    model = toxicity.fit(docs, labels.where(id_crc("doc_id") % 3 != 0))
    rows = toxicity.score(docs.join(held, "doc_id", "left_semi"), model).join(held, "doc_id").collect()
    clean, bad = [r for r in rows if not r.marked], [r for r in rows if r.marked]
    assert len(bad) > 50
    assert np.mean([r.toxic for r in bad]) > 0.85
    assert np.mean([r.toxic for r in clean]) < 0.02
    assert np.mean([r.severity for r in bad]) > 1 > np.mean([r.severity for r in clean])


def test_op1_query_against_brute_force(spark):
    """Each row's severity, summed up from the model's tables word by word."""
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    text = {r.doc_id: r.text for r in docs.collect()}
    got = toxicity.op1_toxicity(spark, FOLDER).collect()
    assert len(got) == docs.count()
    for r in got:
        words = set(re.findall(r"\w+", (text[r.doc_id] or "").lower()))
        forms = words | {w[:n] + "*" for w in words for n in toxicity.PREFIXES if len(w) > n}
        eta = sum(weight.get(xxhash.xxh32_intdigest(f.encode("utf-8", "surrogatepass")), 0.0) for f in forms)
        at_least = [1 / (1 + math.exp(-max(-50, min(50, eta - t)))) for t in model.thresholds]
        assert r.severity == pytest.approx(sum(at_least), abs=1e-9) and r.p_toxic == pytest.approx(at_least[0], abs=1e-9)
        assert r.toxic == int(at_least[0] >= 0.5)


def test_op6_query_against_brute_force(spark, docs):
    """Each row's score, from its features one entry at a time."""
    model = quality.model_of(spark, docs, FOLDER)
    text = {r.doc_id: r.text for r in docs.collect()}
    got = quality.op6_quality(spark, FOLDER).collect()
    assert len(got) == len(text)
    for r in got:
        x = quality.features(text[r.doc_id])
        z = model.base + sum(t[np.searchsorted(c, x[j], side="right")] for j, (c, t) in enumerate(zip(model.cuts, model.tables)))
        z += sum(t[np.searchsorted(model.pair_cuts[i], x[i], side="right"), np.searchsorted(model.pair_cuts[j], x[j], side="right")] for i, j, t in model.pairs)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        assert r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_language_without_letters(spark):
    """Labelled rows of which none has a letter teach nothing: every document is und."""
    df = spark.createDataFrame([(1, "12 34", "en"), (2, "!?", "de"), (3, None, "fr")], "doc_id bigint, text string, lang string")
    model = language_id.fit(df)
    assert {(r.lang_pred, r.score) for r in language_id.classify(odd(spark), model).collect()} == {("und", 0.0)}


def test_ordinal_weights_are_shared():
    rng = np.random.default_rng(0)
    f = np.arange(1, 7, dtype=np.uint32)
    docs, y = [], []
    for _ in range(2000):
        has = rng.random(6) < 0.4
        docs.append(f[has])
        y.append(int(np.clip(has[:3].sum(), 0, 3)))
    model = toxicity.train(docs, np.array(y), np.ones(len(y)), binary=False)
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    weight = dict(zip(model.features.tolist(), model.weights))
    assert min(weight[k] for k in (1, 2, 3)) > 1 > max(abs(weight.get(k, 0.0)) for k in (4, 5, 6))


def test_toxicity_odd_inputs(spark, docs):
    none = toxicity.train([], np.array([], int), np.array([]), True)
    got = toxicity.score(odd(spark), none).collect()
    assert len(got) == len(ODD) and all(r.severity < 1e-6 and r.toxic == 0 for r in got)
    assert toxicity.score(odd(spark).limit(0), none).count() == 0
    assert toxicity.severity_grades(np.array([0, 1, 1, 1]), np.array([0, 5, 5, 5])).tolist() == [0, 1, 1, 1]
