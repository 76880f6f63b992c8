"""Token ids of a corpus as flat unsigned integer files with 64-bit document offsets, memory-mapped on reading.

A folder holds, per shard, `<name>.bin` (ids one after another, 16 bits each where the vocabulary allows, else 32, little-endian) and
`<name>.idx` (64-bit integers: the documents' starts within the shard and its end, then their doc_ids), and the table `manifest`:
shard, name, bits, n_docs, n_null, n_tokens, first_doc, first_token. Shards follow one another in ascending doc_id; their bases
(first_doc, first_token) are prefix sums over the shards' sizes, so no task waits for another. A file's name is new for each
attempt of a task and counts only if the manifest holds it, so tasks that fail or run twice leave nothing wrong.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlab.llm.pieces import byte_level

END = 2
SPAN = 4096
SHARD = "shard int, name string, bits int, n_docs long, n_null long, n_tokens long"


def vocabulary() -> str:
    """The file of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Write the ids of every document (null text: empty), each closed by the id `end`, to the folder `path`; returns its manifest.

    Documents lie in ascending doc_id, null ids first; rows that repeat an id are all kept, ordered by a hash of the text and the
    text. A very frequent id is dealt over shards by that hash. Strings of control tokens inside a text get their ids, as the tokenizers
    library gives them. shards: spark.sql.shuffle.partitions by default. No documents: a manifest without rows.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or vocabulary()
    n = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        enc = byte_level(tokenizer)
        kind = np.dtype("<u2" if max(end + 1, enc.size) <= 1 << 16 else "<u4")
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}"
        sizes, ids, nulls = [np.zeros(1, "<i8")], [], 0
        with store.open_output_stream(f"{folder}/{name}.bin") as out:
            for b in itertools.chain([first], batches):
                texts = b.column("text").to_pylist()
                n_ids = np.zeros(len(texts), "<i8")
                for i, x in enumerate(enc.encode(texts)):
                    out.write(np.append(x, end).astype(kind).tobytes())
                    n_ids[i] = len(x) + 1
                sizes.append(n_ids)
                nulls += b.column("doc_id").null_count
                ids.append(b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        starts = np.cumsum(np.concatenate(sizes))
        with store.open_output_stream(f"{folder}/{name}.idx") as out:
            for part in (starts, *ids):
                out.write(part.astype("<i8").tobytes())
        if len(starts) > 1:
            row = {"shard": [shard], "name": [name], "bits": [kind.itemsize * 8], "n_docs": [len(starts) - 1], "n_null": [nulls], "n_tokens": [int(starts[-1])]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("name", pa.string()), ("bits", pa.int32()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_tokens", pa.int64())]))

    dealt.mapInArrow(run, SHARD).write.parquet(f"{path}/shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    base = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    spark.read.schema(SHARD).parquet(f"{path}/shards").withColumns({"first_doc": base("n_docs"), "first_token": base("n_tokens")}).write.parquet(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a folder that write_tokens() has filled."""
    return spark.read.schema(SHARD + ", first_doc long, first_token long").parquet(f"{path}/manifest")


def region(store: fs.FileSystem, file: str, kind: str | np.dtype, first: int, n: int) -> np.ndarray:
    """n numbers of a file from number `first` on: memory-mapped on a local or mounted folder, else read."""
    kind = np.dtype(kind)
    if not n:
        return np.zeros(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(file, kind, "r", offset=first * kind.itemsize, shape=(n,))
    with store.open_input_file(file) as f:
        return np.frombuffer(f.read_at(n * kind.itemsize, first * kind.itemsize), kind)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, place, start, n_tokens, ids_crc32[, ids]) of every document of a folder, read from its files. place: its number in the order;
    start: ids of all documents before it; ids_crc32: unsigned crc32 of its ids as little-endian unsigned 32-bit integers.

    Shards are read in spans of at most SPAN documents, which are dealt evenly over the tasks."""
    spans = manifest(spark, path).withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(SPAN).cast("long"))))
    dealt = spans.repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard", "lo")
    fields = [("doc_id", pa.int64()), ("place", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for s in (r for b in batches for r in b.to_pylist()):
            lo, n = s["lo"], min(SPAN, s["n_docs"] - s["lo"])
            starts = region(store, f"{folder}/{s['name']}.idx", "<i8", lo, n + 1)
            ids = region(store, f"{folder}/{s['name']}.idx", "<i8", s["n_docs"] + 1 + lo, n)
            tokens = region(store, f"{folder}/{s['name']}.bin", f"<u{s['bits'] // 8}", int(starts[0]), int(starts[-1] - starts[0]))
            at = (starts - starts[0]).tolist()
            cols = [
                pa.array(ids, pa.int64(), mask=np.arange(lo, lo + n) < s["n_null"]), pa.array(s["first_doc"] + np.arange(lo, lo + n)), pa.array(s["first_token"] + starts[:-1]), pa.array(np.diff(starts)),
                pa.array([zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                *([pa.array([tokens[a:b].astype(np.int32) for a, b in zip(at[:-1], at[1:], strict=True)], pa.list_(pa.int32()))] if with_ids else []),
            ]
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(fields))

    return dealt.mapInArrow(run, "doc_id long, place long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
