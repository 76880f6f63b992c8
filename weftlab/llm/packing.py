"""Best-fit-decreasing packing of tokenised documents into sequences of fixed capacity.

Documents become pieces: a document longer than the capacity is cut into full pieces, of which the first may be shorter.
Pieces of one length are interchangeable, so the best-fit-decreasing run needs only the number of pieces per length
(at most `capacity` rows, whatever the corpus): a segment tree over remaining capacities finds the tightest open
sequence in logarithmic time, and equal sequences are filled together. The resulting placements, ranges of ranks
within a length, are joined back to the pieces, whose ranks are counted in parallel.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlab.llm.tokens import encoder
from weftlab.session import materialise

CAPACITY = 2048
RANK_BUCKETS = 512
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = "length long, low long, high long, sequence long, per_sequence long, base long"


Vocabulary = tuple[str, str] | tuple[str, str, tuple[tuple[str, int], ...]]


def public_vocabulary(control: bool = False) -> Vocabulary:
    """(ranks file, split rule, control tokens) of the public 50k byte-level vocabulary.

    control: a control token's string inside a text gets the token's id, as its tokenizer does unless told otherwise; by default it
    is ordinary text, so that no text of a corpus can bring in a control token."""
    import public_tokenizers

    added: list[dict] = []
    if control:
        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tuple((t["content"], t["id"]) for t in added)


def cut_pieces(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every row of docs (null text: empty, so only the closing id 0); with_ids adds the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*vocabulary)
        for b in batches:
            at, rows = [], []
            for i, ids in enumerate(enc.encode(b.column("text").to_pylist())):
                ids = np.append(ids, 0).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    at.append(i)
                    rows.append((k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), *([ids[lo:hi].astype(np.int32)] if with_ids else [])))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            made = [pa.array([r[c] for r in rows], kinds[c]) for c in range(4 + with_ids)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *made], names[: 5 + with_ids])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


class _Tree:
    """Which remaining capacities have an open sequence; finds the smallest at least r."""

    def __init__(self, most: int):
        self.size = 1 << (most + 1).bit_length()
        self.on = [False] * (2 * self.size)

    def set(self, r: int, on: bool) -> None:
        i = r + self.size
        self.on[i] = on
        while i > 1:
            i //= 2
            self.on[i] = self.on[2 * i] or self.on[2 * i + 1]

    def tightest(self, r: int) -> int | None:
        i = r + self.size
        if self.on[i]:
            return r
        while i > 1:
            if not i & 1 and self.on[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.on[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, low, high, sequence, per_sequence, base): the piece of rank i in [low, high) of its length
    lies in sequence + (i - low) // per_sequence at base + (i - low) % per_sequence * length."""
    tree, open_, out, made = _Tree(capacity), {}, [], 0

    def push(r: int, start: int, n: int) -> None:
        if n and r:
            if not open_.setdefault(r, []):
                tree.set(r, True)
            open_[r].append((start, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            r = tree.tightest(length)
            if r is None:
                r, start, n = capacity, made, -(-left // (capacity // length))
                made += n
            else:
                start, n = open_[r].pop()
                if not open_[r]:
                    tree.set(r, False)
            k = r // length
            full = min(n, left // k)
            rest = left - full * k if full < n else 0
            for some, each in ((full, k), (1 if rest else 0, rest)):
                if some:
                    out.append((length, rank, rank + some * each, start, each, capacity - r))
                    push(r - each * length, start, some)
                    rank, left, start, n = rank + some * each, left - some * each, start + some, n - some
            push(r, start, n)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with doc_id, piece, start, length) plus sequence_id and offset.

    Every row is placed once, repeated rows too; ties within a length go by doc_id, piece and checksum. Null ids are
    packed like others. An empty table gives an empty result. pieces must not change between reads (written before).
    """
    spark = pieces.sparkSession
    keyed = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_BUCKETS)))
    some = keyed.groupBy("length", "__bucket").count()
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    some = materialise(some.withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))), "lengths")
    counts = {r["length"]: r["n"] for r in some.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    places = spark.createDataFrame(best_fit_decreasing(counts, capacity), PLACES)
    within = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("__nth", F.row_number().over(within) - 1).join(some.drop("count"), ["length", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__nth") + F.col("__before")).withColumnRenamed("length", "__length")
    i = F.col("__rank") - F.col("low")
    placed = ranked.join(F.broadcast(places), (F.col("__length") == F.col("length")) & F.col("__rank").between(F.col("low"), F.col("high") - 1))
    return placed.select(*pieces.columns, (F.col("sequence") + F.floor(i / F.col("per_sequence"))).cast("long").alias("sequence_id"), (F.col("base") + i % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: Vocabulary | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset of every piece of docs."""
    pieces = cut_pieces(docs, vocabulary or public_vocabulary(), id_col, text_col, capacity, with_ids)
    return pack(materialise(pieces, "pieces"), capacity)
