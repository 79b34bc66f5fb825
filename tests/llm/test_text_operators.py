"""Decontamination, secrets, packing: brute force and odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.oracle import check
from waymark.llm import decontaminate, packing, secrets
from waymark.llm.queries import SQL

FOLDER = "/root/testdata/sf0.001"


def slow_smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(max(r) for r in h)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=15))
def test_alignment(a, b):
    assert decontaminate.smith_waterman(np.array(a, np.int64), np.array(b, np.int64))[0] == slow_smith_waterman(a, b)


def edited(words, rate, rnd):
    out = []
    for w in words:
        u = rnd.random()
        if u < rate / 3:
            continue
        out.append(f"new{rnd.randrange(999)}" if u < 2 * rate / 3 else w)
        if 2 * rate / 3 <= u < rate:
            out.append(f"add{rnd.randrange(999)}")
    return out


def test_leaks(spark):
    rnd = random.Random(3)
    filler = lambda n: [f"f{rnd.randrange(400)}" for _ in range(n)]
    items = [(k, [f"b{rnd.randrange(300)}" for _ in range(40)]) for k in range(12)]
    docs, want = [], set()
    for k, words in items:
        docs.append((100 + k, " ".join(filler(50) + words + filler(50))))
        docs.append((200 + k, " ".join(filler(80) + edited(words, 0.15, rnd) + filler(20))))
        docs.append((300 + k, " ".join(filler(150))))
        want |= {(100 + k, k), (200 + k, k)}
    docs += [(1, None), (2, ""), (3, " ".join(f"b{rnd.randrange(300)}" for _ in range(200)))]
    df = spark.createDataFrame([(a, b, "s", 0) for a, b in docs], "doc_id bigint, text string, score string, item_id int")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(None, "x y"), (99, None), (98, "")], "item_id bigint, text string")
    seeds = decontaminate.fit(df, bench)
    got = decontaminate.leaks(df, seeds).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.score == 1 for r in got if r.doc_id < 200)
    kept = decontaminate.clean(df, seeds)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {a for a, _ in docs} - {a for a, _ in want}
    assert decontaminate.leaks(df.limit(0), seeds).count() == 0
    assert decontaminate.leaks(df, decontaminate.fit(df, bench.limit(0))).count() == 0


def test_short_item(spark):
    df = spark.createDataFrame([(1, "a zebra crossing here"), (2, "a crossing zebra")], "doc_id bigint, text string")
    seeds = decontaminate.fit(df, spark.createDataFrame([(7, "zebra crossing")], "item_id bigint, text string"))
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(df, seeds, min_score=0.9).collect()] == [(1, 7)]


def leaks_by_brute_force(docs, items, min_score):
    """Every item aligned with every whole text, without seeds or windows."""
    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in [*docs, *items]}
    vocab = {w: k for k, w in enumerate(sorted({w for ws in words.values() for w in ws}))}
    number = {i: np.array([vocab[w] for w in ws], np.int64) for i, ws in words.items()}
    return {(d, k) for d, _ in docs for k, _ in items if len(number[k]) and decontaminate.smith_waterman(number[k], number[d])[0] >= min_score * 2 * len(number[k])}


@pytest.mark.parametrize("parts", [False, True])
def test_seeding_against_all_pairs_alignment(spark, monkeypatch, parts):
    """The seeds find the pairs that alignment of all pairs finds; text ids, and a benchmark taken in parts."""
    if parts:
        monkeypatch.setattr(decontaminate, "MAX_ITEMS", 6)
    rnd = random.Random(11)
    filler = lambda n: [f"f{rnd.randrange(300)}" for _ in range(n)]
    items = [(f"item-{k}", " ".join(f"b{rnd.randrange(250)}" for _ in range(rnd.choice([12, 30, 60])))) for k in range(20)]
    docs = []
    for k, (_, t) in enumerate(items):
        for j, rate in enumerate((0.0, 0.1, 0.2, 0.3)):
            docs.append((10 * k + j, " ".join(filler(40) + edited(t.split(), rate, rnd) + filler(30))))
        docs.append((10 * k + 9, " ".join(filler(120))))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    fitted = decontaminate.fit(df, spark.createDataFrame(items, "item_id string, text string"))
    assert len(fitted.parts) == (7 if parts else 1)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, fitted).collect()}
    want = leaks_by_brute_force(docs, items, decontaminate.MIN_SCORE)
    assert got <= want and len(got) >= 0.98 * len(want)
    assert {r.doc_id for r in decontaminate.clean(df, fitted).collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_op2_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    short = [(r.doc_id, r.text) for r in rows if len(r.text or "") < 2000][:60]
    want = {(d, k) for d, k in leaks_by_brute_force([(("d", a), b) for a, b in short], [(("i", a), b) for a, b in items], decontaminate.MIN_SCORE)}
    got = {(("d", r.doc_id), ("i", r.item_id)) for r in decontaminate.op2_decontaminate(spark, FOLDER).collect()}
    asked = {("d", a) for a, _ in short}
    assert {x for x in got if x[0] in asked} == want


PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base_digest(text):
    spans = []
    for k, (kind, p, group, least) in enumerate(PATTERNS):
        spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in p.finditer(text or "") if len(m[group]) >= least]
    return hashlib.sha256(",".join(s[2] for s in sorted(spans)).encode()).hexdigest()


def odd_texts():
    rnd = random.Random(0)
    parts = ["token", "=", ":", " ", '"', "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "x", "ü", "😀", "password", "abc", "api_key", "APIKEY", "hunter22", "\n", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "ToKeN=", "pa\u017f\u017fword=hunter222", "to\u212aen=hunter222"]
    return [None, "", "token: token: abcdefgh", "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "token=" + "a" * 50_000] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(300)]


def test_secrets_against_brute_force(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i if i % 11 else None, t, i, "b") for i, t in enumerate(texts)], "doc_id bigint, text string, n bigint, kind string")
    found = secrets.scan(df).collect()
    assert len(found) == len(texts)
    for r in found:
        base = [f"{s.kind}:{s.start}:{s.stop}" for s in r["__secret_spans"] if s.ord < 3]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == base_digest(texts[r.n]), texts[r.n]
    clean = secrets.redact(df).collect()
    assert not any("deadbeef" * 3 in (r.text or "") or "BEGIN RSA" in (r.text or "") for r in clean)
    assert all(r.text == texts[r.n] for r in clean if base_digest(texts[r.n]) == base_digest("") and "PRIVATE" not in (texts[r.n] or "") and "ghp_" not in (texts[r.n] or ""))
    assert secrets.find(df.limit(0)).count() == 0


def test_redaction_against_brute_force(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = {r.doc_id: [(s.start, s.stop) for s in r["__secret_spans"]] for r in secrets.scan(df).collect()}
    for r in secrets.redact(df).collect():
        text, at, out = texts[r.doc_id] or "", 0, ""
        for start, stop in spans[r.doc_id]:
            if start >= at:
                out, at = out + text[at:start] + "[SECRET]", stop
            else:
                at = max(at, stop)
        assert r.text == (texts[r.doc_id] if not spans[r.doc_id] else out + text[at:])


def test_many_matches_take_no_square_of_time(spark):
    """A text of 60,000 matches, in the time that four of a quarter of them take."""
    import time

    line = "token=abcdefgh12 ü "

    def seconds(n, copies):
        df = spark.createDataFrame([(i, line * n) for i in range(copies)], "doc_id bigint, text string").coalesce(1)
        began = time.time()
        rows = secrets.redact(df).select("doc_id", "text").collect()
        assert all(r.text == "[SECRET] ü " * n for r in rows)
        return time.time() - began

    seconds(10, 1)
    assert seconds(60_000, 1) < 3 * seconds(15_000, 4) + 5


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("abc[0-9]+def") == frozenset([frozenset(["abc", "def"])])
    assert q("(foo|bar)baz") == frozenset([frozenset(["foo", "oob", "oba", "baz"]), frozenset(["bar", "arb", "rba", "baz"])])
    assert q("ab?c+") == secrets.ANY
    assert frozenset() in q("[0-9a-f]{24,}")


@settings(max_examples=80, deadline=None)
@given(st.sampled_from([r.pattern for r in secrets.RULES]), st.data())
def test_trigram_queries_hold_for_every_match(pattern, data):
    text = data.draw(st.from_regex(re.compile(pattern, re.ASCII), fullmatch=True)).lower()
    assert any(all(t in text for t in alternative) for alternative in secrets.trigram_query(pattern))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    from waymark.llm.queries import QUERIES

    check(spark, QUERIES[name], SQL[name], FOLDER)


def test_token_ids_are_exact():
    known = packing.WordIds(packing.TOKENIZER)
    rnd = random.Random(1)
    letters = "abcÀéßİıſΣς²½१ \n\t\x1c\x85\xa0'’s-t re've!\"<|>endoftext́你好🙂_#0129 K"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 60))) for _ in range(800)] + ["<|endoftext|> a", "it's I'LL we've", "ΑΣ ΟΔΟΣ", ""]
    known.LIMIT = 200
    for t in texts:
        want = np.array(known.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert known.ids(t) == want, t


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_shortest_pack_first(histogram):
    packs = packing.shortest_pack_first(histogram, 64)
    used = {}
    for pattern, count in packs:
        assert count > 0 and sum(pattern) <= 64
        for n in pattern:
            used[n] = used.get(n, 0) + count
    assert used == histogram
    runs = packing.slots(packs)
    for n in histogram:
        assert sorted((lo, hi) for length, lo, hi, *_ in runs if length == n)[0][0] == 0


def test_packing(spark):
    rnd = random.Random(2)
    texts = {i: " ".join(rnd.choice(["alpha", "beta", "gamma,", "Delta9"]) for _ in range(rnd.choice([0, 3, 50, 900, 3000]))) for i in range(60)}
    rows = [(i, t, 1) for i, t in texts.items()] + [(900, None, 1), (901, "same", 1), (901, "same", 1), (None, "null id", 1)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string, length int")).collect()
    tokenizer = packing.WordIds(packing.TOKENIZER).tokenizer
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]] and sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in mine)
    assert [(r.length, r.doc_tokens) for r in got if r.doc_id == 900] == [(1, 1)] and sum(r.doc_id == 901 for r in got) == 2
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.MAX_TOKENS
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
