"""Near-duplicate detection: DartMinHash signatures, banded joining, exact verification.

A document is the set of its word shingles (five words). Documents with equal sets are one class
at once, represented by one of them. Representatives are sketched:

DartMinHash. Every (element, weight cell, rank cell) of a fixed dyadic grid over weight x rank holds
a Poisson number of darts, each with a place in the cell, drawn from a hash of the cell alone, so the same
for all documents. A weighted set keeps the darts that lie below its elements' weights and whose
rank is below t = K ln K + 2 K over its total weight: about t darts, whatever its size. A
dart's hash throws it at one of ``K`` coordinates, where the dart of least rank stays. If a
coordinate is left empty, the rank limit is doubled. The K darts are consistent weighted samples: two
sets agree in a coordinate with the probability of their weighted Jaccard similarity.

Joining. ``BANDS`` bands of ``ROWS`` coordinates are hashed; two sets of similarity 0.8 miss each other in
all bands with probability (1 - 0.8^4)^24 = 3e-6. In each bucket the representatives are paired
with the bucket's least one, never with each other; pairs are verified on the whole shingle sets.
Links make components. Then the members of buckets that still hold several components go through a
prefix-filtered join on shingles, rarest first, with a positional filter, which is exact and takes only pairs
of different components. So no bucket is capped or paired in full, and no link is lost to a bucket's least member being
unlike the rest. (That join also finds links between members that shared no bucket: more than was asked
for, at any size.)

Copies, a class's documents, a bucket and a node's neighbours may be a third of all rows: joins on these keys
spread keys of many rows over salts (``hot_join``).

Result: per document its class (the least doc_id of its component) and that class's size.

Edge cases: a text of fewer than five words has one shingle of all its words; null, empty and wordless
texts have none and each is a class of its own; repeated rows are exact copies; rows of one doc_id with different texts are
one document, which joins the classes of its texts; rows with a
null doc_id take no part and are a class of their own (null); texts are whole; an empty table gives
no rows. Only named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm import common
from waymark.llm.common import arrow_map, hot_join, materialize, mix64, shingles, small_or_shuffled

SIMILARITY = 0.8
SHINGLE = 5
BANDS, ROWS = 24, 4
K = BANDS * ROWS
_POISSON: dict[float, np.ndarray] = {}


def _poisson_cdf(mean: float) -> np.ndarray:
    if mean not in _POISSON:
        p, total, k, out = np.exp(-mean), 0.0, 0, []
        while total < 1 - 1e-15 and k < mean + 12 * np.sqrt(mean) + 40:
            total += p
            out.append(min(total, 1.0))
            k += 1
            p *= mean / k
        _POISSON[mean] = np.array(out)
    return _POISSON[mean]


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _cells(limit: float) -> list[tuple[int, float, float]]:
    """(ordinal, low, high) of the dyadic cells [0,1), [1,2), [2,4), ... below ``limit``."""
    out, low, high, i = [], 0.0, 1.0, 0
    while low < limit:
        out.append((i, low, high))
        low, high, i = high, high * 2, i + 1
    return out


def darts(elements: np.ndarray, weights: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Hash and rank of all darts of a weighted set with rank below ``limit``. Weight cells below 1 are
    [0, 1) as a whole: a dart's place within tells whether it lies below the weight."""
    found_h, found_r = [], []
    with np.errstate(over="ignore"):
        for wi, wlow, whigh in _cells(float(weights.max()) if len(weights) else 0.0):
            inside = weights > wlow
            el, wt = elements[inside], weights[inside]
            for ri, rlow, rhigh in _cells(limit):
                cell = mix64(el ^ np.uint64((wi * 64 + ri + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
                # cells of more than 64 expected darts are cut into equal strips of rank
                strips = max(1, int(np.ceil((whigh - wlow) * (rhigh - rlow) / 64)))
                step = (rhigh - rlow) / strips
                for s in range(strips):
                    low = rlow + s * step
                    if low >= limit:
                        break
                    seed = mix64(cell + np.uint64(s + 1))
                    n = np.searchsorted(_poisson_cdf((whigh - wlow) * step), _unit(seed), side="right")
                    total = int(n.sum())
                    if not total:
                        continue
                    which = np.repeat(np.arange(len(el)), n)
                    nth = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                    h = mix64(seed[which] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
                    place = wlow + _unit(mix64(h ^ np.uint64(0xA24BAED4963EE407))) * (whigh - wlow)
                    rank = low + _unit(mix64(h ^ np.uint64(0x9FB21C651E98DF25))) * step
                    ok = (place < wt[which]) & (rank < limit)
                    found_h.append(h[ok])
                    found_r.append(rank[ok])
    if not found_h:
        return np.empty(0, np.uint64), np.empty(0)
    return np.concatenate(found_h), np.concatenate(found_r)


def dart_minhash(elements: np.ndarray, weights: np.ndarray | None = None, k: int = K) -> np.ndarray | None:
    """The k darts (as hashes) of a set of uint64 elements; None for an empty set."""
    if not len(elements):
        return None
    weights = np.ones(len(elements)) if weights is None else np.asarray(weights, float)
    limit = (k * np.log(k) + 2 * k) / weights.sum()
    while True:
        h, rank = darts(elements, weights, limit)
        at = (mix64(h ^ np.uint64(0x632BE59BD9B4E019)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((h, rank))[::-1]
        out, seen = np.zeros(k, np.uint64), np.zeros(k, bool)
        out[at[order]] = h[order]  # the last write, of least rank, stays
        seen[at] = True
        if seen.all():
            return out
        limit *= 2


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            key = mix64(key ^ rows[:, j]) + np.uint64(j + 1)
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the shingle set), n (its size), bands; without documents that have no shingle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows, digest, n, bands = [], [], [], []
            seen: dict[bytes, np.ndarray] = {}  # copies within a batch are sketched once
            for i, text in enumerate(b.column("text").to_pylist()):
                s = shingles(text, SHINGLE)
                if len(s):
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    if d not in seen:
                        seen[d] = band_keys(dart_minhash(s))
                    rows.append(i)
                    digest.append(d)
                    n.append(len(s))
                    bands.append(seen[d])
            flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1) * BANDS, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int32())), pa.array(digest, pa.binary()), pa.array(n, pa.int32()), lists], ["doc_id", "digest", "n", "bands"])

    return arrow_map(docs, run, f"doc_id {kind}, digest binary, n int, bands array<bigint>")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, s: the shingle sets (sorted uint64 bytes) of the documents named, one row each."""

    def run(batches):
        for b in batches:
            sets = [shingles(t, SHINGLE).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], ["id", "s"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.join(small_or_shuffled(ids), docs.doc_id == ids.id, "left_semi"), run, f"id {kind}, s binary")


def _shingle_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, n, e: a row per shingle of the documents named."""

    def run(batches):
        for b in batches:
            for i, text in enumerate(b.column("text").to_pylist()):
                e = shingles(text, SHINGLE).view(np.int64)
                if len(e):
                    ids = b.column("doc_id").take(pa.array(np.full(len(e), i), pa.int32()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(e), len(e)), pa.int32()), pa.array(e)], ["id", "n", "e"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.join(small_or_shuffled(ids), docs.doc_id == ids.id, "left_semi"), run, f"id {kind}, n int, e bigint")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of ids whose whole shingle sets have at least ``similarity``."""

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(common >= similarity * (len(p) + len(q) - common) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")
    return arrow_map(both, run, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's least node) by alternating large and small stars. Each round is
    written to the shared folder; only counts come to the driver."""
    spark = edges.sparkSession
    cur = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    now = cur.agg(F.count("*"), F.lit(None).cast("decimal(38,0)")).head()
    while True:
        back = cur.select(F.col("v").alias("u"), F.col("u").alias("v"))  # a node and its larger neighbours
        least = cur.unionByName(back).groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("n"))
        large = _joined(back, least, now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every node's smaller neighbours, and the node, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _joined(large, low, now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        cur = materialize(small, "edges")
        # stable once the same edges come out twice
        before, now = now, cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == before:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _joined(edges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Edges with their nodes' m, by salts if a node may have too many edges: not where there are too few edges in all."""
    if n <= common.HOT_ROWS:
        return edges.join(nodes.select("u", "m"), "u")
    nodes = materialize(nodes, "nodes")
    return hot_join(materialize(edges, "star"), nodes.select("u", "m"), "u", counts=nodes.select("u", "n"))


def _rooted(ids: DataFrame, comps: DataFrame, id_col: str) -> DataFrame:
    return ids.join(comps.select(F.col("node").alias(id_col), "root"), id_col, "left").withColumn("root", F.coalesce("root", id_col))


def _leftover_pairs(bands: DataFrame, comps: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of different components among the members of buckets that hold several."""
    rooted = _rooted(bands, comps, "rep")
    mixed = rooted.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("size > 2 and lo <> hi")
    members = materialize(rooted.join(small_or_shuffled(materialize(mixed.select("key"), "mixed")), "key", "left_semi").select(F.col("rep").alias("id"), "root").distinct(), "members")
    # Sets x and y, x not the larger, of similarity s share an element of the (1 - s) |y| + 1 rarest of y and the
    # (1 - 2 s / (1 + s)) |x| + 1 rarest of x; what can still follow the first one that they share bounds their overlap.
    long = materialize(_shingle_rows(docs, members.select("id")), "shingles")
    counts = long.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    ranked = long.join(counts, "e", "left").withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(1)), "e")))
    probed = (F.col("rn") <= F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9) + 1) & F.col("df").isNotNull()
    prefix = materialize(ranked.where(probed).select("e", "id", "n", "rn").join(members, "id"), "prefixes")
    apart = materialize(prefix.groupBy("e").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("e"), "apart")
    prefix = materialize(prefix.join(small_or_shuffled(apart), "e", "left_semi"), "prefixes")
    p, q = prefix.where(F.col("rn") <= F.col("n") - F.ceil(F.col("n") * (2 * SIMILARITY / (1 + SIMILARITY)) - 1e-9) + 1).alias("p"), prefix.alias("q")
    overlap = F.ceil((F.col("p.n") + F.col("q.n")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9)
    near = p.join(q, (F.col("p.e") == F.col("q.e")) & (F.col("p.root") != F.col("q.root")) & ((F.col("p.n") < F.col("q.n")) | ((F.col("p.n") == F.col("q.n")) & (F.col("p.id") < F.col("q.id")))))
    near = near.where(_sizes_allow("p.n", "q.n") & (1 + F.least(F.col("p.n") - F.col("p.rn"), F.col("q.n") - F.col("q.rn")) >= overlap))
    return near.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id, class_size."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = src.where(F.col("doc_id").isNotNull())
    signed = materialize(signatures(known), "signatures")
    # A text's copies, in whatever number, shrink to one row before anything is joined.
    reps = materialize(signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "representatives")
    bands = materialize(reps.select("rep", "n", F.explode("bands").alias("key")), "bands")
    heads = materialize(bands.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("head"), F.count("*").alias("size")).where("size > 1"), "heads")
    met = hot_join(bands, heads.select("key", "head"), "key", counts=heads.select("key", F.col("size").alias("n"))).where((F.col("rep") != F.col("head.rep")) & _sizes_allow("n", "head.n"))
    pairs = materialize(met.select(F.col("head.rep").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = materialize(verified(pairs, _sets(known, _named(pairs))), "links")
    comps = components(links)
    more = materialize(_leftover_pairs(bands, comps, known), "leftover")
    if more.head() is not None:
        extra = materialize(verified(more, _sets(known, _named(more))), "links")
        if extra.head() is not None:
            comps = components(links.unionByName(extra))
    # each text's class, then the documents' by it; documents of several texts link the classes of these
    rooted = materialize(_rooted(reps.select("digest", "rep", "copies"), comps, "rep"), "rooted")
    placed = materialize(hot_join(signed.select("doc_id", "digest"), rooted.select("digest", "root"), "digest", counts=rooted.select("digest", F.col("copies").alias("n"))).select("doc_id", "root"), "placed")
    own = materialize(placed.groupBy("doc_id").agg(F.min("root").alias("class_id"), F.max("root").alias("most")), "own")
    several = own.where("class_id <> most")
    if not several.isEmpty():
        edges = placed.join(several, "doc_id").where("root <> class_id").select(F.col("class_id").alias("a"), F.col("root").alias("b"))
        own = materialize(_rooted(own.select("doc_id", "class_id"), components(edges), "class_id").select("doc_id", F.col("root").alias("class_id")), "own")
    sized = materialize(src.select("doc_id").join(own.select("doc_id", "class_id"), "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id")), "classes")
    counts = materialize(sized.groupBy("class_id").agg(F.count("*").alias("class_size")), "sizes")
    found = hot_join(sized, counts, "class_id", "left", counts=counts.select("class_id", F.col("class_size").alias("n")))
    return found.select(F.col("doc_id").alias(id_col), "class_id", F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each class the document with the least
    id stays. Rows equal in id and text count as one; rows with a null id all stay."""
    found = materialize(classes(docs, id_col, text_col), "classes")
    gone = materialize(found.where(F.col("class_id") != F.col(id_col)).select(F.col(id_col).alias("__gone")).distinct(), "gone")
    left = docs.join(small_or_shuffled(gone), F.col(id_col) == F.col("__gone"), "left_anti")
    again = materialize(found.where(F.col("class_id") == F.col(id_col)).groupBy(F.col(id_col).alias("__again")).count().where("count > 1").select("__again"), "again")
    if again.head() is None:
        return left
    twice = left.join(small_or_shuffled(again), F.col(id_col) == F.col("__again"), "left_semi")
    rest = [F.col(c) for c in docs.columns if c not in (id_col, text_col)]
    one = twice.groupBy(id_col, text_col).agg(F.min(F.struct(*rest)).alias("__rest")).select(id_col, text_col, "__rest.*") if rest else twice.distinct()
    once = left.join(small_or_shuffled(again), F.col(id_col) == F.col("__again"), "left_anti")
    return once.unionByName(one).select(*docs.columns)


def _sizes_allow(n: str, m: str):
    """Sets of sizes n and m can't be more similar than the smaller over the larger."""
    return (F.col(n) >= F.col(m) * SIMILARITY - 1e-9) & (F.col(m) >= F.col(n) * SIMILARITY - 1e-9)


def _named(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")


def op4_near_dup(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
