"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts and ratios of the whole text. Each is cut at quantiles into bins; boosting
visits the features in turn and adds a shallow tree (two levels of cuts over that feature's bins)
to the feature's lookup table, against the log-loss gradient. Then the pairs that reduce the
loss most get a two-dimensional table each, boosted the same way. A score is the
sigmoid of an intercept plus one table entry per feature and per pair: bins are found for a whole
batch at once and the entries added column by column.

Learning reads at most ``MAX_ROWS`` labelled documents (smallest hashes of doc_id); counts of a text
cover all of it.

Edge cases: a null text counts as empty and is scored from its (all-zero) features; null labels are
not learned from; a document labelled more than once takes the mean of its labels; with no
label at all every score is 0.5; with one class only, that class's rate, clipped, is every score;
repeated rows each get a row; an empty table gives no rows. Only named columns are read.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import arrow_map, id_crc, sampled_texts, smallest_by_hash

MAX_ROWS = 20_000
BINS = 48
PAIR_BINS = 12
PAIRS = 8
CYCLES = 120
PAIR_CYCLES = 60
RATE = 0.15
THRESHOLD = 0.7

#: Character classes.
LOWER, UPPER, DIGIT, SPACE, NEWLINE, STOP, COMMA, BANG, PIPE, SYMBOL, OTHER = range(11)
FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "space", "newline", "stop", "comma", "bang",
    "pipe", "symbol", "other", "distinct_words", "distinct_lines", "line_words", "short_words", "long_words",
    "symbol_words", "compression",
)

_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    global _CLASS
    if _CLASS is None:
        lut = np.full(0x110000, OTHER, np.uint8)
        for cp in range(0x30000):
            ch = chr(cp)
            if ch.isupper():
                lut[cp] = UPPER
            elif ch.isalpha():
                lut[cp] = LOWER
            elif ch.isdigit():
                lut[cp] = DIGIT
            elif ch == "\n":
                lut[cp] = NEWLINE
            elif ch.isspace():
                lut[cp] = SPACE
        for group, chars in ((STOP, ".?:"), (COMMA, ",;"), (BANG, "!"), (PIPE, "|"), (SYMBOL, "#$%&*@^~_=+<>{}[]\\/")):
            for ch in chars:
                lut[ord(ch)] = group
        _CLASS = lut
    return _CLASS


def features(text: str | None) -> np.ndarray:
    """The feature row of a whole text."""
    out = np.zeros(len(FEATURES), np.float32)
    if not text:
        return out
    n = len(text)
    cls = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    share = np.bincount(cls, minlength=11) / n
    words = text.split()
    nw = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    # word ends, from the classes: lengths without touching each word in Python
    gap = (cls == SPACE) | (cls == NEWLINE)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    lengths = edge[1::2] - edge[0::2]
    last = cls[edge[1::2] - 1]
    raw = text.encode("utf-8", "surrogatepass")
    out[:] = (
        np.log1p(n), np.log1p(len(words)), lengths.mean() if len(lengths) else 0, share[UPPER], share[DIGIT], share[SPACE], share[NEWLINE],
        share[STOP], share[COMMA], share[BANG], share[PIPE], share[SYMBOL], share[OTHER],
        len(set(words)) / nw, len(set(lines)) / max(1, len(lines)), nw / max(1, len(lines)),
        (lengths <= 3).mean() if len(lengths) else 0, (lengths >= 12).mean() if len(lengths) else 0,
        np.isin(last, (SYMBOL, BANG, PIPE)).mean() if len(last) else 0, len(zlib.compress(raw, 1)) / len(raw),
    )
    return out


def _split(g: np.ndarray, h: np.ndarray, lam: float = 1.0) -> tuple[float, int]:
    """Best cut of a histogram of gradients: gain and last bin of the left side (-1: none)."""
    if len(g) < 2:
        return 0.0, -1
    cg, ch = np.cumsum(g), np.cumsum(h)
    gl, hl, gt, ht = cg[:-1], ch[:-1], cg[-1], ch[-1]
    gain = gl**2 / (hl + lam) + (gt - gl) ** 2 / (ht - hl + lam) - gt**2 / (ht + lam)
    at = int(gain.argmax())
    return (float(gain[at]), at) if gain[at] > 1e-9 else (0.0, -1)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, lam: float = 1.0) -> np.ndarray:
    """Leaf values per bin of a tree of the given depth over one feature's histogram."""
    at = _split(g, h, lam)[1] if depth else -1
    if at < 0:
        return np.full(len(g), -g.sum() / (h.sum() + lam))
    return np.concatenate([_tree(g[: at + 1], h[: at + 1], depth - 1, lam), _tree(g[at + 1 :], h[at + 1 :], depth - 1, lam)])


def _pair_tree(g: np.ndarray, h: np.ndarray, lam: float = 1.0) -> tuple[float, np.ndarray]:
    """One cut on either axis, then one on the other axis on each side: gain and table."""
    best, table = 0.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        total = a.sum() ** 2 / (b.sum() + lam)
        for cut in range(1, len(a)):
            gain, parts = -total, []
            for lo, hi in ((0, cut), (cut, len(a))):
                sg, sh = a[lo:hi].sum(0), b[lo:hi].sum(0)
                more, _ = _split(sg, sh, lam)
                gain += sg.sum() ** 2 / (sh.sum() + lam) + more
                parts.append((lo, hi, sg, sh))
            if gain > best + 1e-9:
                best = gain
                new = np.zeros_like(a)
                for lo, hi, sg, sh in parts:
                    new[lo:hi] = _tree(sg, sh, 1, lam)
                table = new.T if flip else new
    return best, table


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            z += table[np.searchsorted(cuts, x[:, j], side="right")]
        bins = {}
        for i, j, table in self.pairs:
            for f in (i, j):
                if f not in bins:
                    bins[f] = np.searchsorted(self.pair_cuts[f], x[:, f], side="right")
            z += table[bins[i], bins[j]]
        return 1 / (1 + np.exp(-z))


def _cut(x: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(x)
    if len(values) <= bins:
        return ((values[1:] + values[:-1]) / 2).astype(np.float32)
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y):
        return Model(0.0)
    rate = float(np.clip(y.mean(), 0.01, 0.99))
    model = Model(float(np.log(rate / (1 - rate))))
    if y.min() == y.max():
        return model
    nf = x.shape[1]
    model.cuts = [_cut(x[:, j], BINS) for j in range(nf)]
    model.pair_cuts = [_cut(x[:, j], PAIR_BINS) for j in range(nf)]
    binned = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    z = np.full(len(y), model.base)
    grad = lambda: ((p := 1 / (1 + np.exp(-z))) - y, np.maximum(p * (1 - p), 1e-6))
    for _ in range(CYCLES):
        for j in range(nf):
            g, h = grad()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(binned[j], g, size), np.bincount(binned[j], h, size), 2, 5.0)
            model.tables[j] += step
            z += step[binned[j]]
    g, h = grad()
    ranked = []
    for i, j in itertools.combinations(range(nf), 2):
        shape = (len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1)
        flat, size = coarse[i] * shape[1] + coarse[j], shape[0] * shape[1]
        gain, _ = _pair_tree(np.bincount(flat, g, size).reshape(shape), np.bincount(flat, h, size).reshape(shape), 5.0)
        ranked.append((gain, i, j, flat, shape))
    chosen = sorted(ranked, key=lambda r: -r[0])[:PAIRS]
    tables = [np.zeros(shape) for *_, shape in chosen]
    for _ in range(PAIR_CYCLES):
        for t, (_, i, j, flat, shape) in enumerate(chosen):
            g, h = grad()
            size = shape[0] * shape[1]
            step = RATE * _pair_tree(np.bincount(flat, g, size).reshape(shape), np.bincount(flat, h, size).reshape(shape), 5.0)[1]
            tables[t] += step
            z += step.ravel()[flat]
    model.pairs = [(i, j, t) for (_, i, j, *_), t in zip(chosen, tables)]
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Learn from the labels given (held-out ones are the caller's to remove)."""
    marks = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
        .groupBy("id")
        .agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )
    keys = smallest_by_hash(marks, "id", [], max_rows)

    def rows(batches):
        for b in batches:
            x = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("y"), pa.array(x, pa.binary())], ["id", "y", "x"])

    texts = sampled_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), keys, "id", "text", ["y"])
    got = sorted(((r.id, r.y, bytes(r.x)) for r in arrow_map(texts, rows, "id string, y int, x binary").collect()))
    x = np.frombuffer(b"".join(r[2] for r in got), np.float32).reshape(len(got), len(FEATURES))
    return train(x, np.array([r[1] for r in got], float))


def _rows(texts: list[str | None]) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if texts else np.zeros((0, len(FEATURES)), np.float32)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, with score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            p = shared.value.predict(_rows(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(p, pa.float64())], [id_col, "score"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(src, run, f"`{id_col}` {src.schema['id'].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            p = shared.value.predict(_rows(b.column(text_col).to_pylist()))
            yield b.filter(pa.array(p >= threshold, pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def model_of(spark, docs: DataFrame, sf_dir: str) -> Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(docs, labels.where(id_crc("doc_id") % 4 != 2))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, model_of(spark, docs, sf_dir))
    return found.select("doc_id", (id_crc("doc_id") % 4 == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
