"""Helpers shared by the training-data operators: bounded batches and training samples, joins with hot
keys, and word hashing for Python workers."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.sources.scratch import materialize, scratch_path  # noqa: F401 - the operators' own import

WORD = re.compile(r"\w+")

#: Id tables of up to this many rows (some 16 MB) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


#: Rows of a text table that a Python worker holds at once, and their bytes.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` with batches small enough for long texts. The limits are settings of the session,
    read when the query is planned; smaller ones of the caller's stay. A worker gives freed memory back at
    the end of each task."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key, None)
        if now is None or not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))

    def run(batches):
        forget_others(fn.__module__)
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


#: What a worker remembers from task to task: module -> how it is dropped.
CACHES: dict[str, Callable[[], None]] = {}


def forget_others(module: str) -> None:
    """Drops what other operators remember: a worker keeps the caches of one at a time."""
    for owner, drop in CACHES.items():
        if owner != module:
            drop()


def give_back() -> None:
    """Returns freed memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: Rows of one key that a task may join by itself; a key with more is spread over several.
HOT_ROWS = 500_000


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``left`` (stored) joined with ``right`` (a row or few per key), no key being one task's however many rows
    ``left`` has of it: keys of more than ``HOT_ROWS`` rows are counted, at most rows / HOT_ROWS of them, and spread over
    salts, each with its copy of the right rows. ``counts``: (key, n) of ``left``, if known."""
    n = left.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    found = n.where(F.col("n") > HOT_ROWS).select(key, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("__salts"))
    if found.isEmpty():
        return left.join(right, key, how)
    hot = materialize(found, "hot")
    salts = small_or_shuffled(hot)
    spread = left.join(salts, key, "left").withColumn("__salt", F.when(F.col("__salts").isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__salts"))).otherwise(0).cast("int")).drop("__salts")
    copies = right.join(salts, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return spread.join(copies, [key, "__salt"], how).drop("__salt")


def small_or_shuffled(stored: DataFrame) -> DataFrame:
    """A stored id table, with a broadcast hint only if its rows, counted here, are few enough."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def id_crc(col: str):
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def sampled_texts(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, extra: list[str]) -> DataFrame:
    """The texts of a bounded set of ids. ``keys`` (id_col + ``extra``) has a documented row
    bound, hence the broadcast; repeated ids in ``docs`` collapse to their smallest text."""
    picked = docs.select(id_col, text_col).join(F.broadcast(keys), id_col)
    return picked.groupBy(id_col, *extra).agg(F.min(text_col).alias(text_col))


def smallest_by_hash(df: DataFrame, id_col: str, per: list[str], k: int) -> DataFrame:
    """At most ``k`` rows per ``per`` (all rows if empty), by hash of id: a bounded,
    order-independent sample. Spark limits groups before the shuffle."""
    if not per:
        return df.orderBy(F.xxhash64(id_col), F.col(id_col)).limit(k)
    w = Window.partitionBy(*per).orderBy(F.xxhash64(id_col), F.col(id_col))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


class WordHash(dict):
    """word -> unsigned 64-bit hash, remembered up to a fixed number of words."""

    LIMIT = 150_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = WordHash()


def word_hashes(words: list[str]) -> np.ndarray:
    get = _HASHES.__getitem__
    return np.fromiter(map(get, words), dtype=np.uint64, count=len(words))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text. A text of one to
    ``size - 1`` words has the one shingle of all its words; one without a word has none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    k = min(size, len(h))
    n = len(h) - k + 1
    acc = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for j in range(k):
        acc = mix64(acc ^ h[j : j + n]) + np.uint64(j + 1)
    return np.unique(acc)
