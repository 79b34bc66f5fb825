"""Language identification with a blended-spectrum string kernel.

Kernel. P(s) is the set of character n-grams of orders 2 to 4 that occur in s, over case-folded
letters with every run of other characters as one gap, each n-gram hashed to 15 bits and kept if
it occurs in some landmark. k(s, t) = |P(s) & P(t)| / sqrt(|P(s)| |P(t)|).

Learning. Nyström: a fixed number of training texts are landmarks; kernel ridge regression in
the space they span, one-versus-rest: A = (K_nm' K_nm + ridge * K_mm)^-1 K_nm' Y.

Scoring. A batch of texts becomes a 0/1 matrix X; kernel values are the matrix product X L',
class values a second product with A; score is the softmax of the class values.

Learning reads at most ``MAX_ROWS`` rows (the same number of each language, smallest hashes of
doc_id first); texts are always whole.

Edge cases: a null text or one without any letter is ``und`` with score 0; with no usable training
row every document is ``und``; null languages are never learned; repeated rows each get a row;
long texts take memory in proportion to the longest one only; an empty table gives no rows. Of
the input only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import arrow_map, id_crc, sampled_texts, smallest_by_hash

ORDERS = (2, 3, 4)
BITS = 15
MAX_ROWS = 4096
LANDMARKS = 128
RIDGE = 1e-3
SHARPNESS = 4.0
BATCH = 64

_LUT: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> folded code point for letters, 0 for everything else."""
    global _LUT
    if _LUT is None:
        lut = np.zeros(0x110000, np.uint32)
        for cp in range(0x110000):
            ch = chr(cp)
            if ch.isalpha():
                low = ch.lower()
                lut[cp] = ord(low) if len(low) == 1 else cp
        _LUT = lut
    return _LUT


def presence(text: str | None) -> np.ndarray | None:
    """Flags (2**BITS) of the n-grams in a whole text; None if it has no letter."""
    if not text:
        return None
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not c.any():
        return None
    gap = c == 0
    c = np.concatenate([[np.uint32(0)], c[~(gap & np.concatenate([[True], gap[:-1]]))], [np.uint32(0)]]).astype(np.uint32)
    flags = np.zeros(1 << BITS, bool)
    h = c * np.uint32(0x01000193)
    for n in range(2, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] ^ c[n - 1 :]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            flags[(h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)] = True
    return flags


@dataclass
class Model:
    """columns: hashed n-gram -> column (or -1); landmarks: bit-packed 0/1 rows; weights: A."""

    langs: list[str]
    columns: np.ndarray
    landmarks: np.ndarray
    width: int
    weights: np.ndarray

    def scorer(self):
        land = np.unpackbits(self.landmarks, axis=1, count=self.width).astype(np.float32)
        land /= np.sqrt(np.maximum(land.sum(1, keepdims=True), 1))
        kept = np.flatnonzero(self.columns >= 0)
        order = kept[np.argsort(self.columns[kept])]

        def score(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
            labels, values = ["und"] * len(texts), np.zeros(len(texts))
            if not self.langs:
                return labels, values
            for at in range(0, len(texts), BATCH):
                flags = [presence(t) for t in texts[at : at + BATCH]]
                rows = [i for i, f in enumerate(flags) if f is not None]
                if not rows:
                    continue
                x = np.stack([flags[i][order] for i in rows]).astype(np.float32)
                k = (x @ land.T) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
                z = SHARPNESS * (k @ self.weights)
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                for i, b, row in zip(rows, best, p):
                    labels[at + i], values[at + i] = self.langs[b], float(row[b])
            return labels, values

        return score


def train(flags: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on packed presence rows and their languages."""
    classes = sorted(set(langs))
    if not classes:
        return Model([], np.full(1 << BITS, -1, np.int32), np.zeros((0, 0), np.uint8), 0, np.zeros((0, 0), np.float32))
    x = np.unpackbits(flags, axis=1, count=1 << BITS).astype(bool)
    y = np.array([classes.index(v) for v in langs])
    by_class = [np.flatnonzero(y == c) for c in range(len(classes))]
    per = max(1, landmarks // len(classes))
    land = np.concatenate([rows[:per] for rows in by_class])
    kept = np.flatnonzero(x[land].any(0))
    columns = np.full(1 << BITS, -1, np.int32)
    columns[kept] = np.arange(len(kept))
    x = x[:, kept].astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    k_nm = (x @ x[land].T).astype(np.float64)
    k_mm = k_nm[land]
    target = np.where(y[:, None] == np.arange(len(classes)), 1.0, -1.0)
    lhs = k_nm.T @ k_nm + ridge * len(y) * k_mm + 1e-8 * len(y) * np.eye(len(land))
    weights = np.linalg.solve(lhs, k_nm.T @ target).astype(np.float32)
    bits = np.packbits(x[land] > 0, axis=1)
    return Model(classes, columns, bits, len(kept), weights)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """Learn from the given labelled documents (any that must be held out are the caller's to
    remove). At most ``max_rows`` rows are used, spread evenly over the languages."""
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    langs = labelled.agg(F.count_distinct("lang")).head()[0]
    if not langs:
        return train(np.zeros((0, (1 << BITS) // 8), np.uint8), [])
    keys = smallest_by_hash(labelled.where(F.col("id").isNotNull()).select("id", "lang"), "id", ["lang"], max(1, max_rows // langs))

    def pack(batches):
        for b in batches:
            out_lang, out_bits = [], []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                f = presence(text)
                if f is not None:
                    out_lang.append(lang)
                    out_bits.append(np.packbits(f).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_lang, pa.string()), pa.array(out_bits, pa.binary())], ["lang", "bits"])

    texts = sampled_texts(labelled.select("id", "text"), keys, "id", "text", ["lang"])
    rows = sorted((r.lang, bytes(r.bits)) for r in arrow_map(texts, pack, "lang string, bits binary").collect())
    rng = np.random.default_rng(7)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    flags = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), (1 << BITS) // 8)
    return train(flags, [r[0] for r in rows])


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = shared.value.scorer()
        for b in batches:
            labels, values = score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(labels, pa.string()), pa.array(values, pa.float64())], [id_col, "lang_pred", "score"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return arrow_map(src, run, f"`{id_col}` {kind}, lang_pred string, score double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(id_crc("doc_id") % 5 != 0))
    found = classify(docs, model)
    return found.select("doc_id", (id_crc("doc_id") % 5 == 0).alias("held_out"), "lang_pred", "score")
