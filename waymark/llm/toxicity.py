"""Toxicity severity with cumulative-link (proportional-odds) ordinal regression.

A document is a sparse set of features: its distinct words and their prefixes of ``PREFIXES``
characters, which carry a stem over to forms never seen in learning. One weight vector w is shared by all thresholds
t_1 < t_2 < ...: P(grade >= k) = sigmoid(w.x - t_k), the grades being 0, 1, ..., K. The answer is the
expected severity, sum over k of P(grade >= k), with the likeliest grade and P(grade >= 1).

Learning reads at most ``MAX_ROWS`` labelled documents, half of them with a grade above 0 where
there are enough (smallest hashes of doc_id; each half is weighted back to its share of all
labels). Features whose presence isn't associated with a grade above 0 (|z| < ``MIN_Z``) get no weight.

Where labels only say toxic or not, ``severity_grades`` makes ordered grades of them: 0 for not
toxic, and for toxic ones the tercile of their number of associated features (1 to 3). What is learned from people
is then the first threshold, toxic or not; the grades beyond it rank how much evidence of toxicity a document
holds, which no label bears out. Labels of several grades (``binary=False``) are learned as they are. A rate per
word would suit worse: features are present or not, so no weights could express it.

Edge cases: null or empty text has no words and gets the severity of the thresholds alone; null
labels are not learned from; a document labelled more than once takes its largest label; without
labels above 0 every severity is 0; repeated rows each get a row; texts are whole; an empty table
gives no rows. Only named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import WordHash, arrow_map, materialize, sampled_texts, smallest_by_hash, words_of

MAX_ROWS = 12_000
MAX_FEATURES = 1 << 17
MIN_Z = 4.0
MIN_DOCS = 5
LASSO = 3e-5
STEPS = 600
PREFIXES = (4, 5, 6)


class WordFeatures(WordHash):
    """word -> the 32-bit hashes of its features, as bytes."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        parts = [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]
        raw = np.array([xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) for x in parts], np.uint32).tobytes()
        self[word] = raw
        return raw


def features_of(words: list[str], known: WordFeatures) -> np.ndarray:
    """Sorted distinct feature hashes of a document's words."""
    return np.unique(np.frombuffer(b"".join(map(known.__getitem__, set(words))), np.uint32))


@dataclass
class Model:
    """features: sorted feature hashes; weights; thresholds (one less than the grades)."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def scorer(self):
        known = dict(zip(self.features.tolist(), self.weights.tolist()))
        hashes = WordFeatures()

        class Weighted(WordHash):
            """word -> those of its features that have a weight"""

            LIMIT = 300_000

            def __missing__(self, word):
                if len(self) >= self.LIMIT:
                    self.clear()
                found = np.frombuffer(WordFeatures.__missing__(hashes, word), np.uint32).tolist()
                hashes.clear()
                self[word] = kept = tuple(f for f in found if f in known)
                return kept

        weighted = Weighted()

        def total(text: str | None) -> float:
            found: set[int] = set()
            for kept in map(weighted.__getitem__, set(words_of(text))):
                if kept:
                    found.update(kept)
            return sum(map(known.__getitem__, found))

        def score(texts: list[str | None]) -> np.ndarray:
            eta = np.array([total(t) for t in texts], float).reshape(-1, 1)
            return 1 / (1 + np.exp(-np.clip(eta - self.thresholds, -50, 50)))

        return score


def _fit_ordinal(rows: np.ndarray, cols: np.ndarray, n: int, width: int, y: np.ndarray, weight: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the weighted negative log-likelihood; thresholds stay ordered as a first one plus
    exponentials of the gaps."""
    w, t0, gaps = np.zeros(width), 0.0, np.zeros(grades - 2)
    params = np.concatenate([w, [t0], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    weight = weight / weight.sum()
    big = 40.0
    for step in range(1, STEPS + 1):
        w, t0, gaps = params[:width], params[width], params[width + 1 :]
        t = t0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        eta = np.bincount(rows, w[cols], n)
        upper = np.clip(np.concatenate([t, [big * 10]])[y] - eta, -big, big)  # P(grade <= y)
        lower = np.clip(np.concatenate([[-big * 10], t])[y] - eta, -big, big)  # P(grade <= y - 1)
        su, sl = 1 / (1 + np.exp(-upper)), 1 / (1 + np.exp(-lower))
        p = np.maximum(su - sl, 1e-12)
        du, dl = su * (1 - su) / p * weight, sl * (1 - sl) / p * weight
        du[y == grades - 1] = 0
        dl[y == 0] = 0
        g_t = -np.bincount(np.minimum(y, grades - 2), du, grades - 1) + np.bincount(np.maximum(y - 1, 0), dl, grades - 1)
        g_eta = du - dl
        g_w = np.bincount(cols, g_eta[rows], width) + LASSO * w / (np.abs(w) + 0.02)
        tail = np.cumsum(g_t[::-1])[::-1]
        grad = np.concatenate([g_w, [g_t.sum()], tail[1:] * np.exp(gaps)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return params[:width], params[width] + np.concatenate([[0.0], np.cumsum(np.exp(params[width + 1 :]))])


def severity_grades(toxic: np.ndarray, found: np.ndarray) -> np.ndarray:
    """0 for documents that aren't toxic; 1 to 3 by tercile of ``found`` for those that are, with no
    grade left out where ties make terciles coincide."""
    grade = np.zeros(len(toxic), np.int64)
    if (toxic > 0).any():
        cuts = np.quantile(found[toxic > 0], [1 / 3, 2 / 3])
        grade[toxic > 0] = 1 + np.unique(np.searchsorted(cuts, found[toxic > 0], side="left"), return_inverse=True)[1]
    return grade


def associated(hits: np.ndarray, df: np.ndarray, rows: int, share: float) -> np.ndarray:
    """z of each feature: ``hits`` of its ``df`` documents have a grade above 0, of all a ``share`` has."""
    return (hits - df * share) / np.sqrt(np.maximum(df * share * (1 - share), 1e-9))


def train(docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, binary: bool) -> Model:
    """docs: distinct feature hashes; y: grades from 0."""
    none = Model(np.empty(0, np.uint32), np.empty(0), np.full(1, 50.0))
    if not len(y) or y.max() <= 0:
        return none
    sizes = np.array([len(d) for d in docs])
    rows = np.repeat(np.arange(len(docs)), sizes)
    features, cols = np.unique(np.concatenate(docs), return_inverse=True)
    df = np.bincount(cols, minlength=len(features))
    pos = (y > 0).astype(float)
    z = associated(np.bincount(cols, pos[rows], len(features)), df, len(docs), pos.mean())
    kept = (np.abs(z) >= MIN_Z) & (df >= MIN_DOCS)
    if binary:
        strong = (z >= MIN_Z) & kept
        found = np.bincount(rows, strong[cols].astype(float), len(docs))
        y = severity_grades(y, found)
    grades = int(y.max()) + 1
    place = np.cumsum(kept) - 1
    used = kept[cols]
    w, t = _fit_ordinal(rows[used], place[cols[used]], len(docs), int(kept.sum()), y, weight, max(grades, 2))
    return Model(features[kept], w, t)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, binary: bool = True) -> Model:
    """Learn from ``labels`` (grades from 0 up; ``binary``: 0 or 1, graded by density). The sampled documents' features
    are counted on the executors; the driver gets those that are associated with grades, ``MAX_FEATURES`` at
    most, and for each document which of these it has."""
    marks = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("y"))
        .withColumn("pos", (F.col("y") > 0).cast("int"))
    )
    keys = smallest_by_hash(marks, "id", ["pos"], max_rows // 2)
    totals = {r.pos: r["count"] for r in marks.groupBy("pos").count().collect()}

    def rows(batches):
        known = WordFeatures()
        for b in batches:
            h = [features_of(words_of(t), known).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("y"), pa.array(h, pa.binary())], ["id", "y", "h"])

    texts = sampled_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), keys.select("id", "y"), "id", "text", ["y"])
    stored = materialize(arrow_map(texts, rows, "id string, y int, h binary"), "features")
    seen = {r.pos: r["count"] for r in stored.groupBy((F.col("y") > 0).cast("int").alias("pos")).count().collect()}
    n = sum(seen.values())
    if not seen.get(1):
        return train([], np.array([], np.int64), np.array([]), binary)

    def counted(batches):
        df, hits = np.empty(0, np.uint32), np.empty(0, np.uint32)
        for b in batches:
            every = [np.frombuffer(h.as_buffer(), np.uint32) for h in b.column("h")]
            if every:
                pos = [e for e, y in zip(every, b.column("y").to_pylist()) if y > 0]
                df, hits = np.concatenate(every), np.concatenate(pos or [np.empty(0, np.uint32)])
                f, c = np.unique(df, return_counts=True)
                g, k = np.unique(hits, return_counts=True)
                h = np.zeros(len(f), np.int64)
                h[np.searchsorted(f, g)] = k
                yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)), pa.array(c), pa.array(h)], ["f", "df", "hits"])

    share = seen[1] / n
    z = (F.col("hits") - F.col("df") * share) / F.sqrt(F.greatest(F.col("df") * share * (1 - share), F.lit(1e-9)))
    counts = arrow_map(stored, counted, "f bigint, df bigint, hits bigint").groupBy("f").agg(F.sum("df").alias("df"), F.sum("hits").alias("hits"))
    best = counts.where((F.abs(z) >= MIN_Z) & (F.col("df") >= MIN_DOCS)).orderBy(F.desc(F.abs(z)), "f").limit(MAX_FEATURES)
    kept = np.sort(np.array([r.f for r in best.select("f").collect()], np.uint32))
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def narrowed(batches):
        for b in batches:
            h = [np.intersect1d(np.frombuffer(x.as_buffer(), np.uint32), shared.value, assume_unique=True).tobytes() for x in b.column("h")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(h, pa.binary())], ["id", "y", "h"])

    got = sorted(arrow_map(stored, narrowed, "id string, y int, h binary").collect(), key=lambda r: r.id)
    y = np.array([r.y for r in got], np.int64)
    weight = np.array([totals.get(int(v > 0), 1) / seen[int(v > 0)] for v in y], float)
    parts = [np.frombuffer(r.h, np.uint32) for r in got]
    return train(parts, y, weight, binary)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, severity (expected grade), grade (likeliest), p_toxic, toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        at_least = shared.value.scorer()
        for b in batches:
            p = at_least(b.column("text").to_pylist()).reshape(b.num_rows, -1)
            ends = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1)
            grade = (ends[:, :-1] - ends[:, 1:]).argmax(1) if len(p) else np.empty(0)
            first = p[:, 0]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(p.sum(1)), pa.array(grade, pa.int32()), pa.array(first), pa.array((first >= 0.5).astype(np.int32))],
                [id_col, "severity", "grade", "p_toxic", "toxic"],
            )

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return arrow_map(src, run, f"`{id_col}` {kind}, severity double, grade int, p_toxic double, toxic int")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
