"""Sequence packing: shortest-pack-first over the histogram of lengths.

Documents become token ids (plus an end id). A document longer than a sequence is cut into full
sequences and one remainder. The histogram of remainder lengths, at most ``max_tokens`` numbers
whatever the input, goes to the driver. Lengths are placed longest first, each into the
shortest pack so far (the one with most room), as counts: a pattern is a list of lengths with the
number of packs that have it. Then patterns are joined back to the pieces by rank: the r-th piece of
a length takes the r-th slot of that length.

Ranks come without any window over a whole length: pieces are spread over salts by a number that is
stored with them (repeated rows have different ones), salts are counted per length, the counts are summed
up over salts, and a piece is ranked within its (salt, length) only.

Edge cases: a null or empty text is the end id alone; texts are cut, never shortened; repeated rows
are packed each for itself; ids of documents may be null; an empty table gives no rows. Only
named columns are read. Ties of rank are broken by doc_id, start and checksum; rows equal in
all of these are interchangeable.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import insort

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.common import CACHES, arrow_map, materialize, mix64

MAX_TOKENS = 2048
END_ID = 1
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ROWS_PER_SALT = 50_000


_LETTERS = "".join(c for c in map(chr, range(0x300)) if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in map(chr, range(0x300)) if unicodedata.category(c)[0] == "N")
_BLANKS = "\t\n\v\f\r \x85\xa0"
#: The tokenizer's own cut into words, for text below U+0300.
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")
#: What may be normalised or cut in other ways: left to the tokenizer. Letters below U+0300 are in
#: composed form already and fold one by one, except the dotted capital I.
_UNSURE = re.compile("[^\x00-\u012f\u0131-\u02ff]|<\\|")


class WordIds:
    """Token ids of texts, with the ids of words remembered in two generations of bounded size.

    The tokenizer merges within words only, so a text's ids are those of its words, in order.
    New words are encoded together; in this vocabulary a word's last token, and no other, is
    marked as an end, which tells their ids apart again."""

    LIMIT = 500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: set[str]) -> None:
        new = []
        for w in words:
            if (known := self.old.get(w)) is None:
                new.append(w)
            else:
                self.young[w] = known
        if new:
            ids = self._encode(" ".join(new))
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(new) and stops[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for w, stop in zip(new, (4 * stops).tolist()):
                    self.young[w] = raw[at:stop]
                    at = stop
            else:
                for w in new:
                    self.young[w] = self._encode(w).tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _UNSURE.search(text):
            if "<|" in text:
                return self._encode(text).tobytes()
            parts = text.replace("\n", " ").split(" ")
            return b"".join(self._encode(x).tobytes() if _UNSURE.search(x) else self._known(x) for x in parts if x)
        return self._known(text)

    def _known(self, text: str) -> bytes:
        words = _CUT.findall(text.lower())
        missing = {w for w in words if w not in self.young}
        if missing:
            if len(self.young) + len(missing) > self.LIMIT:
                self.old, self.young = self.young, {}
                missing = set(words)
            self.learn(missing)
        return b"".join(map(self.young.__getitem__, words))


_IDS: dict[str, WordIds] = {}
CACHES[__name__] = _IDS.clear


def word_ids(path: str) -> WordIds:
    """One per worker and tokenizer: what it remembers serves later tasks."""
    if path not in _IDS:
        _IDS[path] = WordIds(path)
    return _IDS[path]


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and spread: a number that repeated rows of one
    task don't share."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        known, seen = word_ids(tokenizer), 0
        for b in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                raw = memoryview(known.ids(text) + end)
                n = len(raw) // 4
                for at in range(0, n, max_tokens):
                    part = raw[4 * at : 4 * (at + max_tokens)]
                    row.append(i)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            ids = b.column("id").take(pa.array(row, pa.int32()))
            spread = mix64((np.array(crc, np.uint64) << np.uint64(32)) ^ np.arange(seen, seen + len(row), dtype=np.uint64)).view(np.int64)
            seen += len(row)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (start, length, crc, total, spread))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "spread"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return arrow_map(src, run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, spread bigint")


def shortest_pack_first(histogram: dict[int, int], max_tokens: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, number of such packs), from length -> number of pieces."""
    packs: dict[int, list[list]] = {}  # room -> [pattern, count]
    rooms: list[int] = []  # the rooms that occur, ascending
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            if not rooms or rooms[-1] < length:
                room, made, pattern = max_tokens - length, n, (length,)
            else:
                top = rooms[-1]
                group = packs[top][-1]
                made, room, pattern = min(n, group[1]), top - length, group[0] + (length,)
                group[1] -= made
                if not group[1]:
                    packs[top].pop()
                    if not packs[top]:
                        del packs[top]
                        rooms.pop()
            n -= made
            if room not in packs:
                packs[room] = []
                insort(rooms, room)
            for group in packs[room]:
                if group[0] == pattern:
                    group[1] += made
                    break
            else:
                packs[room].append([pattern, made])
    return [(tuple(p), c) for groups in packs.values() for p, c in groups]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence id of the first, offset) for runs of equal slots."""
    out, rank, base = [], {}, 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            lo = rank.get(length, 0)
            out.append((length, lo, lo + count, base, offset))
            rank[length] = lo + count
            offset += length
        base += count
    return out


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Adds sequence_id and offset to pieces that are stored (they are read more than once)."""
    spark = pieces.sparkSession
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    salts = 1 + sum(histogram.values()) // rows_per_salt
    salted = pieces.withColumn("salt", F.pmod("spread", F.lit(salts)))
    counted = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("salt", "length").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("rn", F.row_number().over(within) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("rn"))
    # the slots depend on the histogram's bins, at most max_tokens of them, not on the rows
    plan = slots(shortest_pack_first(histogram, max_tokens))
    table = spark.createDataFrame(plan or [(0, 0, 0, 0, 0)], "s_length bigint, lo bigint, hi bigint, first bigint, offset bigint")
    joined = ranked.join(F.broadcast(table), (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return joined.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset",
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, max_tokens: int = MAX_TOKENS) -> DataFrame:
    return pack(materialize(tokenize_pieces(docs, id_col, text_col, tokenizer, max_tokens), "pieces"), max_tokens)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
