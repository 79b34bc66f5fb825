"""Signatures against weighted Jaccard, classes against brute force."""

import itertools

import numpy as np
import pytest

from waymark.llm import near_dup
from waymark.llm.common import shingles


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_similarity(weighted):
    rng = np.random.default_rng(1)
    gaps = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 200, dtype=np.uint64)
        b = a.copy()
        b[150:] = rng.integers(0, 2**63, 50, dtype=np.uint64)
        wa = rng.uniform(0.2, 4, 200) if weighted else np.ones(200)
        wb = wa * np.where(rng.random(200) < 0.5, 1.0, 0.5) if weighted else wa
        true = np.minimum(wa, wb)[:150].sum() / (np.maximum(wa, wb)[:150].sum() + wa[150:].sum() + wb[150:].sum())
        gaps.append((near_dup.dart_minhash(a, wa) == near_dup.dart_minhash(b, wb)).mean() - true)
    assert abs(np.mean(gaps)) < 0.02


def test_signature_of_small_sets():
    assert near_dup.dart_minhash(np.empty(0, np.uint64)) is None
    one = near_dup.dart_minhash(np.array([7], np.uint64))
    assert len(one) == near_dup.K and (one == near_dup.dart_minhash(np.array([7], np.uint64))).all()


def brute(docs, similarity=0.8):
    sets = {i: set(shingles(t).tolist()) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= similarity * len(sets[a] | sets[b]) - 1e-9:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def corpus():
    """Copies, edited copies in a chain, texts sharing a passage, short and empty ones."""
    rng = np.random.default_rng(5)
    word = lambda: "w" + str(rng.integers(0, 5000))
    text = lambda n: [word() for _ in range(n)]
    docs, i = [], itertools.count(1)
    shared = text(60)
    for _ in range(45):
        docs.append((next(i), " ".join(shared + text(30))))
    base = text(200)
    for _ in range(20):  # each differs a little from the one before: the ends are unlike
        base = base.copy()
        base[int(rng.integers(0, 200))] = word()
        docs.append((next(i), " ".join(base)))
    same = " ".join(text(80))
    docs += [(next(i), same) for _ in range(30)]
    docs += [(next(i), t) for t in ("", None, "one two", "one two", "one two three", "!!!")]
    docs += [(next(i), " ".join(text(50))) for _ in range(60)]
    return docs


def test_classes_match_brute_force(spark):
    docs = corpus()
    rows = near_dup.classes(spark.createDataFrame([(a, b, 1, "z") for a, b in docs], "doc_id bigint, text string, class_id int, root string")).collect()
    want = brute(docs)
    assert {r.doc_id: r.class_id for r in rows} == want
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    assert all(r.class_size == sizes[r.class_id] for r in rows)


def test_hot_keys_are_spread(spark, monkeypatch):
    """With a limit of a few rows a key, every join goes through salts, and nothing changes."""
    from waymark.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    docs = corpus()
    rows = near_dup.classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    want = brute(docs)
    assert {r.doc_id: r.class_id for r in rows} == want
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    assert all(r.class_size == sizes[r.class_id] for r in rows)


def test_links_that_the_least_member_hasnt(spark):
    """Texts that share most of a passage fall into the same buckets without being alike; among them are pairs that are."""
    rng = np.random.default_rng(9)
    text = lambda n: [f"w{rng.integers(0, 90000)}" for _ in range(n)]
    shared, docs, i = text(170), [], itertools.count(1)
    for _ in range(60):
        own = text(rng.integers(28, 45))
        docs.append((next(i), " ".join(shared + own)))
        for _ in range(int(rng.integers(0, 3))):
            twin = own.copy()
            twin[int(rng.integers(0, len(own)))] = text(1)[0]
            docs.append((next(i), " ".join(shared + twin)))
    order = rng.permutation(len(docs))
    docs = [(k + 1, docs[j][1]) for k, j in enumerate(order)]
    rows = near_dup.classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute(docs)


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert {r.doc_id: r.class_id for r in near_dup.op4_near_dup(spark, folder).collect()} == brute(docs)


def test_one_doc_id_with_two_texts(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(40)) for k in "ab")
    rows = near_dup.classes(spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in rows) == [(1, 1, 4), (2, 1, 4), (2, 1, 4), (3, 1, 4)]


def test_one_of_each(spark):
    t = " ".join(f"a{i}" for i in range(50))
    rows = [(1, t, "x"), (2, t, "y"), (3, "other text with words in it", "z"), (3, "other text with words in it", "z"), (None, t, "n"), (4, None, "e"), (5, "", "e")]
    kept = near_dup.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert kept.columns == ["doc_id", "text", "source"]
    assert sorted((r.doc_id or 0, r.source) for r in kept.collect()) == [(0, "n"), (1, "x"), (3, "z"), (4, "e"), (5, "e")]
    assert near_dup.one_of_each(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 100), (200, 201)]
    got = {r.node: r.root for r in near_dup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 1 for i in range(2, 41)) and got[101] == got[102] == 100 and got[201] == 200
