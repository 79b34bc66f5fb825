"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Counting. One pass over all texts counts every word of the benchmark's vocabulary, and all words. An
item's n-gram of ``SEED`` words is rare if the words would meet by chance less than ``RARE`` times in a
million positions; word frequencies are those of the whole corpus, so a passage copied many
times doesn't hide itself. An item whose rare n-grams leave a stretch of ``GAP`` words without a
seed takes the rarest n-gram of the stretch as well.

Seeding. A second pass finds the seeds in each text; the hits of an item that lie close together mark
a window of the text, the item's length and some slack to each side.

Alignment. Words of the window and the item are aligned locally (match +2, mismatch -1, gap
-1); the score is over that of the item against itself. Pairs of at least ``MIN_SCORE`` are leaks: exact
copies score 1, and copies with words changed, dropped or put in lose some.

What each task holds of the benchmark is bounded: one of more than ``MAX_ITEMS`` items or ``MAX_BYTES`` bytes of text
is taken in parts (items by hash), each with its own passes over the corpus; an item's result doesn't depend on the
others, so parts change nothing. The corpus is only streamed through: there is no shuffle but of the counts.

Edge cases: null and empty texts have no words and match nothing; an item with a null id or without
words is left out; one of fewer words than a seed is sought as a whole; repeated items are
separate items; ids of items may be of any type, and are returned as they are; repeated documents each get rows; an
empty table gives no rows. Only named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import arrow_map, mix64, words_of

SEED = 3
RARE = 0.3
GAP = 10
MIN_SCORE = 0.45
MAX_ITEMS = 200_000
MAX_BYTES = 64 << 20
SLACK = 8


class Seeds:
    """The benchmark's words as numbers, and its seeds as sorted keys with their (item, position)."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.ids = [i for i, _ in items]
        self.vocab: dict[str, int] = {}
        self.words = [np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words], np.int64) for _, words in items]
        self.keys = np.empty(0, np.uint64)
        self.starts = np.empty(0, np.int64)
        self.places = np.empty((0, 2), np.int64)

    @staticmethod
    def grams(words: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """Keys of the n-grams at some places (of all, without): hashes, whose collisions alignment sorts out."""
        at = np.arange(len(words) - n + 1) if at is None else at
        key = np.full(len(at), n, np.uint64)
        for j in range(n):
            key = mix64(key ^ words[at + j].astype(np.uint64)) + np.uint64(j + 1)
        return key

    def choose(self, counts: np.ndarray, total: int, rare: float = RARE) -> None:
        """Picks seeds by the chance of an n-gram in a million positions."""
        share = np.log(np.maximum(counts, 1) / max(total, 1))
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, words in enumerate(self.words):
            n = min(SEED, len(words))
            keys = self.grams(words, n)
            chance = np.convolve(share[words], np.ones(n), "valid") + np.log(1e6)
            chosen = chance < np.log(rare)
            for lo in range(0, len(keys), GAP):
                if not chosen[lo : lo + GAP].any():
                    chosen[lo + int(chance[lo : lo + GAP].argmin())] = True
            for at in np.flatnonzero(chosen):
                found[int(keys[at])].append((item, int(at)))
        ordered = sorted(found)
        self.keys = np.array(ordered, np.uint64)
        self.starts = np.concatenate([[0], np.cumsum([len(found[k]) for k in ordered])]).astype(np.int64)
        self.places = np.array([p for k in ordered for p in found[k]], np.int64).reshape(-1, 2)

    def number(self, words: list[str]) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def hits(self, numbers: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """item -> (position in the text, position in the item) of its seeds."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        known = numbers >= 0
        for n in range(1, SEED + 1):  # shorter keys are those of items shorter than a seed
            if len(numbers) < n:
                break
            inside = np.flatnonzero(np.convolve(known, np.ones(n, int), "valid") == n)
            if not len(inside):
                continue
            key = self.grams(numbers, n, inside)
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            for i in np.flatnonzero(self.keys[at] == key) if len(self.keys) else ():
                for item, place in self.places[self.starts[at[i]] : self.starts[at[i] + 1]]:
                    out[int(item)].append((int(inside[i]), int(place)))
        return out


def windows(hits: list[tuple[int, int]], item_words: int, text_words: int) -> list[tuple[int, int]]:
    """Stretches of the text that may hold the item, around hits that lie close together."""
    starts = sorted((at - place, at) for at, place in hits)
    slack = SLACK + item_words // 4
    out: list[list[int]] = []
    for begin, _ in starts:
        lo, hi = max(0, begin - slack), min(text_words, begin + item_words + slack)
        if out and lo <= out[-1][1] and hi - out[-1][0] <= 4 * (item_words + 2 * slack):
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment of two number sequences: score and its end in ``window``. Words outside the
    vocabulary (-1) match nothing."""
    steps = np.arange(len(window) + 1)
    row, best, end = np.zeros(len(window) + 1, np.int64), 0, 0
    for w in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(window == w, 2, -1), row[1:] - 1), 0)
        row = np.maximum.accumulate(new + steps) - steps  # gaps along the window
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def _parts(benchmark: DataFrame, item_col: str, text_col: str) -> list[Seeds]:
    """The benchmark in parts that keep its bounds. One item's text is held whole, whatever its length."""
    rows = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("i"), F.col(text_col).alias("t"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("b")).head()
    n = max(1, -(-size.n // (MAX_ITEMS // 2)), -(-(size.b or 0) // (MAX_BYTES // 2))) if size.n > MAX_ITEMS or (size.b or 0) > MAX_BYTES else 1
    out = []
    for part in range(n):
        own = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == part).collect()
        items = sorted(((r.i, words) for r in own if (words := words_of(r.t))), key=lambda x: (str(x[0]), x[1]))
        if items or not out:
            out.append(Seeds(items))
    return out


@dataclass
class Fitted:
    """Seeds of the parts of a benchmark, and the type of its ids."""

    parts: list[Seeds]
    item_type: str


def fit(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> Fitted:
    """Seeds of a benchmark, rare by the word counts of the whole corpus."""
    parts = _parts(benchmark, item_col, item_text_col)
    for seeds in parts:
        _count(docs, seeds, text_col)
    return Fitted(parts, benchmark.schema[item_col].dataType.simpleString())


def _count(docs: DataFrame, seeds: Seeds, text_col: str) -> None:
    shared = docs.sparkSession.sparkContext.broadcast(seeds)

    def count(batches):
        s = shared.value
        totals, every = np.zeros(len(s.vocab) + 1, np.int64), 0
        for b in batches:
            for text in b.column("text").to_pylist():
                numbers = s.number(words_of(text))
                every += len(numbers)
                totals += np.bincount(numbers + 1, minlength=len(totals))
        found = np.flatnonzero(totals[1:])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(totals[1:][found], every))], ["word", "n"])

    counted = arrow_map(docs.select(F.col(text_col).alias("text")), count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts, total = np.zeros(len(seeds.vocab), np.int64), 0
    for r in counted.collect():  # one row per word of this part of the benchmark
        if r.word < 0:
            total = r.n
        else:
            counts[r.word] = r.n
    seeds.choose(counts, total)
    shared.destroy()


def leaks(docs: DataFrame, fitted: Fitted, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE, keep: list[str] | None = None) -> DataFrame:
    """A row per document (its id, or the ``keep`` columns) and item it leaks: item_id, score, word_start,
    word_end (the window's words, end exclusive)."""
    found = [_leaks(docs, seeds, fitted.item_type, id_col, text_col, min_score, keep) for seeds in fitted.parts]
    return reduce(DataFrame.unionByName, found)


def _leaks(docs: DataFrame, seeds: Seeds, item_type: str, id_col: str, text_col: str, min_score: float, keep: list[str] | None) -> DataFrame:
    names = [id_col] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches):
        s = shared.value
        for b in batches:
            row, item_no, score, start, end = [], [], [], [], []
            for i, text in enumerate(b.column("__text").to_pylist()):
                numbers = s.number(words_of(text))
                for item, hits in s.hits(numbers).items():
                    words, best = s.words[item], (0.0, 0, 0)
                    for lo, hi in windows(hits, len(words), len(numbers)):
                        got, _ = smith_waterman(words, numbers[lo:hi])
                        best = max(best, (got / (2 * len(words)), lo, hi))
                    if best[0] >= min_score:
                        row.append(i)
                        item_no.append(item)
                        score.append(best[0])
                        start.append(best[1])
                        end.append(best[2])
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(at) for c in names), pa.array(item_no, pa.int64()), pa.array(score, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                [*names, "item_no", "score", "word_start", "word_end"],
            )

    src = docs.select(*names, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__text")
    met = arrow_map(src, run, f"{schema}, item_no bigint, score double, word_start bigint, word_end bigint")
    # at most MAX_ITEMS rows
    ids = docs.sparkSession.createDataFrame(list(enumerate(seeds.ids)), f"item_no bigint, item_id {item_type}")
    return met.join(F.broadcast(ids), "item_no").select(*names, "item_id", "score", "word_start", "word_end")


def clean(docs: DataFrame, fitted: Fitted, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item."""
    for seeds in fitted.parts:
        docs = _clean(docs, seeds, text_col, min_score)
    return docs


def _clean(docs: DataFrame, seeds: Seeds, text_col: str, min_score: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches):
        s = shared.value
        for b in batches:
            ok = []
            for text in b.column(text_col).to_pylist():
                numbers = s.number(words_of(text))
                ok.append(
                    not any(
                        smith_waterman(s.words[item], numbers[lo:hi])[0] >= min_score * 2 * len(s.words[item])
                        for item, hits in s.hits(numbers).items()
                        for lo, hi in windows(hits, len(s.words[item]), len(numbers))
                    )
                )
            yield b.filter(pa.array(ok, pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return leaks(docs, fit(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
