"""Nearest neighbours, URL filters, archives and the pipeline."""

import io
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import ann, common, url_filter, warc
from waymark.llm.common import scratch_path

FOLDER = "/root/testdata/sf0.01"


def test_recall(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = {}
    for r in ann.op5_ann(spark, FOLDER).collect():
        got.setdefault(r.query_id, []).append(r)
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = (x * x[q]).sum(1) / (np.sqrt((x * x).sum(1)) * math.sqrt((x[q] * x[q]).sum()))
        score[q] = -2
        best = np.lexsort((ids, -score))[:5]
        mine = sorted(got[ids[q]], key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert all(r.score == pytest.approx(score[np.flatnonzero(ids == r.vec_id)[0]], abs=1e-12) for r in mine)
        hit += len({r.vec_id for r in mine} & set(ids[best].tolist()))
        total += 5
    assert hit / total >= 0.9


@pytest.mark.parametrize("rows", [5])
def test_blocks_and_chunks_change_nothing(spark, monkeypatch, rows):
    """Lists cut into small blocks and chunks give what whole lists give, a vec_id on many rows included."""
    rng = np.random.default_rng(1)
    v = rng.standard_normal((400, 8))
    table = [(i if i % 7 else 3, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<double>").repartition(3)
    asked = F.col("vec_id") % 5 == 0
    key = lambda r: (r.query_id, r["rank"], r.vec_id, round(r.score, 12))
    whole = sorted(map(key, ann.nearest(df, asked).collect()))
    monkeypatch.setattr(ann, "BLOCK_ROWS", rows)
    monkeypatch.setattr(ann, "QUERY_ROWS", rows)
    assert sorted(map(key, ann.nearest(df, asked).collect())) == whole


def test_neighbours_odd_inputs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0]), (None, [1.0, 1.0]), (50, None)]
    df = spark.createDataFrame([(a, b, "q") for a, b in rows], "vec_id bigint, embedding array<double>, query_id string")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(df.where("vec_id = 4"), F.lit(True)).count() == 0


def test_scan_keeps_the_best():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 48))
    ids = np.arange(3000)
    index = ann.build(ids, ann._unit(x), 3000)
    turned = ann._unit(x) @ index.rotation
    hit = 0
    for q in range(40):
        score = ann._unit(x) @ ann._unit(x)[q]
        score[q] = -2
        found, _ = ann.scan_list(ids, x, np.ascontiguousarray(turned.T), q, x[q], turned[q], math.inf if q % 2 else 2 - 2 * np.sort(score)[-5], 5)
        hit += len(set(found) & set(np.argsort(-score)[:5]))
    assert hit / 200 > 0.98


@pytest.mark.parametrize("shuffled", [False, True])
def test_temporal_lists(spark, monkeypatch, shuffled):
    if shuffled:  # as if the list were long and every key hot
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(common, "HOT_ROWS", 2)
    entries = spark.createDataFrame(
        [
            ("host", "a.b.com", "block", "add", "2024-01-10"), ("host", "a.b.com", "block", "remove", "2024-02-01"), ("host", "a.b.com", "block", "add", "2024-03-01"),
            ("domain", "b.com", "block", "add", "2024-02-15"), ("prefix", "x.b.com/ok/", "allow", "add", "2024-02-20"), ("host", "a.b.com", "block", "add", "2024-01-10"), ("host", None, "block", "add", "2024-01-01"),
        ],
        "pattern_kind string, pattern string, verdict string, action string, effective string",
    )
    cases = [
        (1, "http://A.b.com:80/x?q", "2024-01-09 23:59:59", "none"), (2, "http://u@a.b.com/x", "2024-01-10", "block"), (3, "http://a.b.com", "2024-02-01", "none"), (4, "http://a.b.com", "2024-02-15", "block"),
        (5, "http://x.b.com/ok/1", "2024-02-16", "block"), (6, "http://x.b.com/ok/1", "2024-02-21", "allow"), (7, "http://x.b.com/okay", "2024-02-21", "block"), (8, None, "2024-02-21", "none"), (9, "no url", "2024-02-21", "none"),
        (10, "http://a.b.com", None, "none"), (None, "http://a.b.com", "2024-03-02", "block"), (11, "http://ab.com", "2024-03-02", "none"), (12, "http://a.b.com", "2024-03-02", "block"), (12, "http://a.b.com", "2024-03-02", "block"),
        (13, "//a.b.com/x", "2024-03-02", "block"), (14, "http://a.b.com./x", "2024-03-02", "block"), (15, "http://./x", "2024-03-02", "none"),
    ]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c, _ in cases], "page_id bigint, url string, fetched string, verdict int")
    got = url_filter.judge(df, entries).collect()
    assert sorted(((r.page_id or 0, r.verdict) for r in got)) == sorted((a or 0, v) for a, _, _, v in cases)
    assert {r.verdict for r in url_filter.judge(df, entries.limit(0)).collect()} == {"none"}
    assert url_filter.judge(df.limit(0), entries).count() == 0


def gz(data):
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def test_archives_round_trip(spark):
    pages = [(1, "u", "same"), (2, "u", "same"), (9, "u", "same"), (3, "u", None), (4, "u", ""), (5, None, "ü" * 40_000), (None, "u\r\nx", "same"), (7, "u", "twice"), (7, "u", "twice")]
    folder = scratch_path(spark, "warc")
    manifest = warc.write_archives(warc.with_duplicates(spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, payload_bytes int")), folder, roll_bytes=500)
    rows = warc.read_archives(manifest, folder).where("kind = 'record'").collect()
    assert len(rows) == len(pages)
    by = {r.record_id: r for r in rows}
    assert by["urn:page:9"].record_type == "response" and bytes(by["urn:page:9"].payload) == b"same"
    for k in ("1", "2", "None"):
        r = by[f"urn:page:{k}"]
        assert (r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) == ("revisit", "urn:page:9", 4, warc.base32_sha1(b"same"))
    assert by["urn:page:3"].refers_to == "urn:page:4" and by["urn:page:5"].payload_bytes == 80_000
    assert by["urn:page:7"].record_type == "response"
    small = warc.with_duplicates(spark.createDataFrame(pages, "page_id bigint, url string, html string"), min_bytes=5).where("revisit").count()
    assert small == 0
    nothing = warc.write_archives(warc.with_duplicates(spark.createDataFrame([], "page_id bigint, url string, html string")), folder)
    assert warc.read_archives(nothing, folder).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    records = [warc.build_record(f"urn:page:{i}", "http://x", (b"payload %d " % i) * 200) for i in range(8)]
    members = [gz(r) if packed else r for r in records]
    good = b"".join(members)
    assert [r["record_id"] for r in warc.salvage(io.BytesIO(good), len(good))] == [f"urn:page:{i}" for i in range(8)]
    starts = np.cumsum([0, *map(len, members)])
    rng = np.random.default_rng(0)
    for _ in range(40):
        hurt = int(rng.integers(1, 7))
        bad = bytearray(good)
        at = int(starts[hurt] + rng.integers(0, len(members[hurt])))
        bad[at] ^= 1 << int(rng.integers(0, 8))
        out = list(warc.salvage(io.BytesIO(bytes(bad)), len(bad)))
        ids = [r["record_id"] for r in out if r["kind"] == "record"]
        gaps = [r for r in out if r["kind"] == "gap"]
        assert set(f"urn:page:{i}" for i in range(8) if i != hurt) <= set(ids)
        assert sum(r["length"] for r in {r["offset"]: r for r in out}.values()) == len(bad)
        assert all(starts[hurt] <= g["offset"] and g["offset"] + g["length"] <= starts[hurt + 1] for g in gaps)
    cut = good[: int(starts[5]) + 20]
    out = list(warc.salvage(io.BytesIO(cut), len(cut)))
    assert [r["kind"] for r in out] == ["record"] * 5 + ["gap"] and out[-1]["length"] == 20
    junk = b"junk" + good[: int(starts[2])] + b"\x1f\x8b\x08more" + good[int(starts[2]) :]
    out = list(warc.salvage(io.BytesIO(junk), len(junk)))
    assert sum(r["kind"] == "record" for r in out) == 8 and [r["length"] for r in out if r["kind"] == "gap"] == [4, 7]


def test_members_of_several_records():
    records = [warc.build_record(f"urn:page:{i}", "http://x", (b"line %d WARC/1.0 no version line\r\n" % i) * 300) for i in range(6)]
    assert [r["record_id"] for r in warc.salvage(io.BytesIO(gz(b"".join(records))), len(gz(b"".join(records))))] == [f"urn:page:{i}" for i in range(6)]
    # a wrong digest within a sound member: only that record is lost
    hurt = bytearray(b"".join(records))
    place = len(records[0]) + len(records[1]) + len(records[2]) // 2
    hurt[place] ^= 1
    member = gz(bytes(hurt))
    tail = gz(warc.build_record("urn:page:9", "http://x", b"last"))
    out = list(warc.salvage(io.BytesIO(member + tail), len(member + tail)))
    assert [r["record_id"] for r in out if r["kind"] == "record"] == [f"urn:page:{i}" for i in (0, 1, 3, 4, 5, 9)]
    gap = next(r for r in out if r["kind"] == "gap")
    assert (gap["inner_offset"], gap["inner_length"]) == (len(records[0]) + len(records[1]), len(records[2])) and (gap["offset"], gap["length"]) == (0, len(member))
    # a member that is cut off, or damaged near its end: the records before are borne out by their digests
    whole = gz(b"".join(records))
    for bad in (whole[: len(whole) * 4 // 5], whole[:-6] + bytes([whole[-6] ^ 1]) + whole[-5:]):
        out = list(warc.salvage(io.BytesIO(bad + tail), len(bad + tail)))
        ids = [r["record_id"] for r in out if r["kind"] == "record"]
        assert ids[:3] == [f"urn:page:{i}" for i in range(3)] and ids[-1] == "urn:page:9"
        assert [(r["offset"], r["length"]) for r in out if r["kind"] == "gap"] == [(0, len(bad))]


def test_hostile_members_are_not_held():
    """Members that inflate to far more than they weigh: no record, and none of it kept."""
    import tracemalloc

    zeros = gz(b"\0" * (64 << 20))
    claims = gz(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999999999\r\n\r\n" + b"\0" * (64 << 20))
    data = zeros + claims + gz(warc.build_record("urn:page:1", "u", b"x"))
    tracemalloc.start()
    out = list(warc.salvage(io.BytesIO(data), len(data)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["kind"] for r in out] == ["gap", "record"] and peak < 20 << 20


def test_hot_payloads_are_spread(spark, monkeypatch):
    pages = [(i, "u", "same" if i % 3 else f"page {i % 5}") for i in range(60)] + [(None, "u", "same")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    few = sorted(map(str, warc.with_duplicates(df).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    assert sorted(map(str, warc.with_duplicates(df).collect())) == few


def test_pipeline(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dup", "decontaminate", "secrets", "packing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id").collect()}
    assert 0 < len(kept) < docs.count()
