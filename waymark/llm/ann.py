"""Approximate nearest neighbours by cosine: inverted lists scanned with adaptive dimension sampling.

Index. Unit vectors are turned by one random rotation. K-means over a bounded sample (at most
``SAMPLE_ROWS`` rows, smallest hashes of vec_id) gives list centres; every row is indexed. Lists longer than
``BLOCK_ROWS`` are split into blocks by row, so a hot list, or a vec_id on very many rows, is many groups. The
queries of a list are split into chunks of ``QUERY_ROWS`` likewise: a block is sent once per chunk of its own list's
queries, so what is shuffled stays a fixed small share of what is compared.

Search. A query probes the lists nearest to it: as many as it takes for trial queries of the
sample to find ``TARGET`` of their true neighbours within the sample, so clustered vectors need
few lists and shapeless ones many. In each, the rotated vectors are scanned in blocks
of ``COLUMNS`` columns: after each, the squared distance over the d columns so far is tested against the
distance t of the k-th best so far: a candidate is abandoned where
dist_d > t * d/D * (1 + EPSILON/sqrt(d))^2, which rejects the hypothesis that its whole distance is
below t. What is left is scored in double precision on the original vectors. t starts from the
query's k-th best within a bounded part of the sample; these k are candidates themselves, whatever lists they are
in, so no query with k candidates comes back with fewer.

Edge cases: a vector that is null, zero, of another length than most, or has a null or non-finite
component takes no part, as query or candidate; so does a null vec_id. Of rows that repeat a vec_id
the candidates are still separate rows, except that none with the query's own id counts. Ties go
to the smaller vec_id. With fewer than k candidates all are returned. An empty table gives no
rows. Only named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.common import arrow_map, materialize

SAMPLE_ROWS = 16_384
SEED_ROWS = 2_048
MAX_LISTS = 1_024
TRIAL_QUERIES = 256
TARGET = 0.97
MIN_PROBED = 2_000
BLOCK_ROWS = 16_384
QUERY_ROWS = 16_384
COLUMNS = 16
EPSILON = 2.1
K = 5


@dataclass
class Index:
    rotation: np.ndarray  # D x D
    centres: np.ndarray  # lists x D, rotated space
    seeds: np.ndarray  # rotated unit vectors of a part of the sample
    seed_ids: np.ndarray
    probes: int = 1  # lists that a query probes
    sizes: np.ndarray | None = None  # rows of each list


def valid_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v: the original components as little-endian doubles; invalid rows are left out."""

    def run(batches):
        for b in batches:
            ids, vec = b.column("id"), b.column("vec")
            flat = vec.flatten()
            value = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            n = pc.fill_null(pc.list_value_length(vec), 0).to_numpy().astype(np.int64)
            ends = np.cumsum(n)
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
            ok = ids.is_valid().to_numpy(zero_copy_only=False) & (total(~np.isfinite(value)) == 0) & (total(value != 0) > 0)
            data = np.ascontiguousarray(value[np.repeat(ok, n)])
            offsets = np.concatenate([[0], np.cumsum(n[ok] * 8)]).astype(np.int32)
            out = pa.Array.from_buffers(pa.binary(), int(ok.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)), out], ["vec_id", "v"])

    return arrow_map(table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")), run, "vec_id bigint, v binary")


def _matrix(raw, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # against overflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def build(sample_ids: np.ndarray, sample: np.ndarray, rows: int, seed: int = 11) -> Index:
    """Rotation and list centres from a bounded sample of unit vectors."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    rotation = q * np.sign(np.diag(r))
    x = sample @ rotation
    lists = int(min(MAX_LISTS, max(1, round(math.sqrt(rows) / 2)), len(x)))
    centres = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(12):
        near = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        lost = norm[:, 0] < 1e-12
        centres = np.where(norm < 1e-12, centres, total / np.maximum(norm, 1e-12))
        if lost.any():
            centres[lost] = x[rng.choice(len(x), int(lost.sum()))]
    return Index(rotation, centres, x[:SEED_ROWS], sample_ids[:SEED_ROWS], probes_needed(x, centres))


def probes_needed(x: np.ndarray, centres: np.ndarray, k: int = K, target: float = TARGET) -> int:
    """Lists to probe for ``target`` of the true neighbours of trial queries within the sample."""
    trial = x[:: max(1, len(x) // TRIAL_QUERIES)][:TRIAL_QUERIES]
    own = np.arange(0, len(x), max(1, len(x) // TRIAL_QUERIES))[: len(trial)]
    if len(x) <= k:
        return len(centres)
    score = trial @ x.T
    score[np.arange(len(trial)), own] = -np.inf
    true = np.argpartition(-score, k - 1, axis=1)[:, :k]
    near = (x @ centres.T).argmax(1)
    rank = np.argsort(np.argsort(-(trial @ centres.T), axis=1), axis=1)
    at = np.sort(rank[np.arange(len(trial))[:, None], near[true]].ravel())
    return int(at[min(len(at) - 1, math.ceil(target * len(at)) - 1)]) + 1


def cosines(cand: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row, so that a vector has the same score wherever it is met."""
    scale = np.sqrt((cand * cand).sum(1)) * math.sqrt(float((query * query).sum()))
    return (cand * query).sum(1) / scale


def scan_list(ids: np.ndarray, original: np.ndarray, rotated: np.ndarray, query_id: int, query: np.ndarray, turned: np.ndarray, limit: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cosines of the best k of one list's block; ``limit``: squared distance of the k-th best known."""
    dim = rotated.shape[0]
    alive = np.flatnonzero(ids != query_id)
    part = np.zeros(len(alive))
    for lo in range(0, dim, COLUMNS):
        hi = min(dim, lo + COLUMNS)
        diff = rotated[lo:hi, alive] - turned[lo:hi, None]
        part += np.einsum("ij,ij->j", diff, diff)
        ratio = hi / dim
        bound = limit * (1 + 1e-9) + 1e-12 if hi == dim else limit * ratio * (1 + EPSILON / math.sqrt(hi)) ** 2 + 1e-12
        stay = part <= bound
        if not stay.all():
            alive, part = alive[stay], part[stay]
        if not len(alive):
            break
    if len(alive) > 4 * k:  # cut by rotated distance, leaving room for its rounding
        edge = np.partition(part, k - 1)[k - 1] * (1 + 1e-9) + 1e-10
        alive = alive[part <= edge]
    score = cosines(original[alive], query)
    best = np.lexsort((ids[alive], -score))[:k]
    return ids[alive][best], score[best]


def nearest(table: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for every row for which the column ``is_query`` (over vec_id)
    holds, against all rows."""
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    stored = materialize(valid_vectors(table, id_col, vec_col), "vectors")
    dims = stored.groupBy(F.length("v").alias("n")).count().orderBy(F.desc("count"), "n").head()
    if dims is None:
        return empty
    dim, rows = dims["n"] // 8, dims["count"]
    vectors = stored.where(F.length("v") == 8 * dim)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    index = build(np.array([r.vec_id for r in sample]), _unit(_matrix([bytes(r.v) for r in sample], dim)), rows)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches):
        for b in batches:
            raw = b.column("v").to_pylist()
            if not raw:
                continue
            turned = _unit(_matrix(raw, dim)) @ shared.value.rotation
            near = (turned @ shared.value.centres.T).argmax(1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(near, pa.int32())], ["vec_id", "v", "list"])

    listed = materialize(arrow_map(vectors.select("vec_id", "v"), assign, "vec_id bigint, v binary, list int"), "lists")
    sizes = np.zeros(len(index.centres), np.int64)
    for r in listed.groupBy("list").count().collect():  # at most MAX_LISTS rows
        sizes[r["list"]] = r["count"]
    routing = spark.sparkContext.broadcast(Index(index.rotation, index.centres, index.seeds, index.seed_ids, index.probes, sizes))
    blocks = [max(1, -(-int(n) // BLOCK_ROWS)) for n in sizes]

    def route(batches):
        m = routing.value
        for b in batches:
            raw = b.column("v").to_pylist()
            if not raw:
                continue
            ids = b.column("vec_id").to_numpy()
            turned = _unit(_matrix(raw, dim)) @ m.rotation
            order = np.argsort(-(turned @ m.centres.T), axis=1)
            qid, v, lists, limits = [], [], [], []
            for i in range(len(ids)):
                d = ((m.seeds - turned[i]) ** 2).sum(1)[m.seed_ids != ids[i]]
                limit = float(np.partition(d, k - 1)[k - 1]) if len(d) >= k else math.inf
                n = max(m.probes, int(np.searchsorted(np.cumsum(m.sizes[order[i]]), min(MIN_PROBED, int(m.sizes.sum())))) + 1)
                for c in order[i][:n]:
                    if m.sizes[c]:
                        qid.append(int(ids[i]))
                        v.append(raw[i])
                        lists.append(int(c))
                        limits.append(limit)
            yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(v, pa.binary()), pa.array(lists, pa.int32()), pa.array(limits, pa.float64())], ["query_id", "q", "list", "limit"])

    first = spark.sparkContext.broadcast(_matrix([bytes(r.v) for r in sample[:SEED_ROWS]], dim))

    def seeded(batches):
        """The seeds that set a query's limit, with their scores."""
        m = routing.value
        for b in batches:
            raw = b.column("v").to_pylist()
            if not raw:
                continue
            ids, asked = b.column("vec_id").to_numpy(), _matrix(raw, dim)
            turned = _unit(asked) @ m.rotation
            qid, vid, score = [], [], []
            for i in range(len(ids)):
                others = np.flatnonzero(m.seed_ids != ids[i])
                d = ((m.seeds[others] - turned[i]) ** 2).sum(1)
                best = others[np.argpartition(d, k - 1)[:k]] if len(d) > k else others
                qid += [int(ids[i])] * len(best)
                vid += m.seed_ids[best].tolist()
                score += cosines(first.value[best], asked[i]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(vid, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

    queries = vectors.where(is_query).select("vec_id", "v")
    routed = materialize(arrow_map(queries, route, "query_id bigint, q binary, list int, limit double"), "routed")
    chunks = [1] * len(sizes)
    for r in routed.groupBy("list").count().collect():  # at most MAX_LISTS rows
        chunks[r["list"]] = -(-r["count"] // QUERY_ROWS)
    of_list = lambda counts: F.element_at(F.array(*[F.lit(n) for n in counts]), F.col("list") + 1)
    spread = lambda counts: F.pmod(F.xxhash64(F.monotonically_increasing_id()), of_list(counts)).cast("int")  # noqa: E731 - rows of stored tables
    left = routed.withColumn("chunk", spread(chunks)).withColumn("block", F.explode(F.sequence(F.lit(0), of_list(blocks) - 1)))
    right = listed.withColumn("block", spread(blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0), of_list(chunks) - 1)))

    def search(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(qs) and len(vs):
            ids, original = vs["vec_id"].to_numpy(), _matrix(vs["v"], dim)
            rotated = np.ascontiguousarray((_unit(original) @ shared.value.rotation).T)
            asked = _matrix(qs["q"], dim)
            turned = _unit(asked) @ shared.value.rotation
            for i, (query_id, limit) in enumerate(zip(qs["query_id"], qs["limit"])):
                found, score = scan_list(ids, original, rotated, query_id, asked[i], turned[i], limit, k)
                out["query_id"] += [query_id] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += score.tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["list", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    # a row met both ways counts once, rows that repeat each other as often as either way has them
    both = found.withColumn("way", F.lit(0)).unionByName(arrow_map(queries, seeded, "query_id bigint, vec_id bigint, score double").withColumn("way", F.lit(1)))
    same = Window.partitionBy("query_id", "vec_id", "score", "way").orderBy("way")
    found = both.withColumn("copy", F.row_number().over(same)).select("query_id", "vec_id", "score", "copy").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
