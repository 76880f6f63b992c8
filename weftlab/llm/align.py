"""Alignment of two tokenizers' ids over the bytes of the same texts, with corpus-wide counts of linked pairs.

Both tokenizers spell the same bytes. Offsets where tokens of both end cut them into groups; every A token of a group is linked with every
B token of it. The count of an id pair is the number of documents that hold it linked. Counting takes three steps, all by buckets
of A ids, so that a bucket holds at most (A ids in it) x (B ids) pairs whatever the corpus:

1. the documents are aligned; a task emits the pairs it has seen with the number of its documents (`pair_counts`);
2. the distinct pairs of each bucket are united in a tree and get a minimal perfect hash, written to the shared folder with the pairs in
   the order of their numbers (`hash_pairs`);
3. the tasks' counts become dense vectors indexed by that hash, which are summed in a tree (`count_pairs`).

A second pass aligns the documents anew and looks up the counts through the hash; a pair found there is checked against the pair stored
at its number.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlab.llm.pieces import blank_led, byte_level, byte_spelling, piece_spelling, slices
from weftlab.llm.token_files import region
from weftlab.llm.words import mix
from weftlab.session import materialise, new_path

BUCKETS = 128
FAN = 64
PAIR_BITS = 40  # of a pair's number; the rest numbers the documents of a slice
LARGE_GROUP = 4096
MOST_LINKS = 1 << 22
MOST_HELD = 1 << 20
MOST_CACHED = 256 << 20

Tokenizers = tuple[str, str]


def public_tokenizers() -> Tokenizers:
    """The files of the public byte-level (A) and piece (B) vocabularies."""
    import public_tokenizers as found

    return found.path("byte_bpe_50k.json"), found.path("piece_bpe_32k.model")


class Aligned:
    """The tokens of a slice of texts: ids a and b, the group of each (ga, gb), tokens per group (na, nb), the document of each group (doc),
    and per document n_a, n_b, n_groups. Documents with odd bytes have no tokens."""

    def __init__(self, a: np.ndarray, a_bound: np.ndarray, b: np.ndarray, b_bound: np.ndarray, a_size: np.ndarray, b_size: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a, b, np.diff(a_bound), np.diff(b_bound)
        a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
        at = np.zeros((2, int(a_end[-1]) + 1 if len(a_end) else 1), bool)
        at[0, a_end], at[1, b_end] = True, True
        a_cut, b_cut = at[1, a_end], at[0, b_end]
        self.ga, self.gb = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        groups = int(a_cut.sum())
        self.na, self.nb = np.bincount(self.ga, minlength=groups), np.bincount(self.gb, minlength=groups)
        self.n_groups = np.diff(np.append(0, np.cumsum(a_cut))[a_bound])
        self.doc = np.repeat(np.arange(len(self.n_groups)), self.n_groups)

    def links(self, b_ids: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, pair = a * b_ids + b, times) of all links, documents ascending; a pair of a document lies in one of the parts, of about
        MOST_LINKS rows at most. Tokens that repeat in a large group are taken once, with their number."""
        ga, a, gb, b = self.ga, self.a.astype(np.int64), self.gb, self.b.astype(np.int64)
        ca, cb, nb = np.ones(len(a), np.int64), np.ones(len(b), np.int64), self.nb
        large = self.na * nb > LARGE_GROUP
        if large.any():
            (ga, a, ca), (gb, b, cb) = _once(ga, a, large), _once(gb, b, large)
            nb = np.bincount(gb, minlength=len(large))
        start = np.cumsum(nb) - nb
        parts = max(1, min(int(nb[ga].sum()) // MOST_LINKS, 1 << 16))
        for part in range(parts):
            if parts > 1:
                some = a % parts == part
                g, x, c = ga[some], a[some], ca[some]
            else:
                g, x, c = ga, a, ca
            n = nb[g]
            i = np.repeat(np.arange(len(g)), n)
            j = np.arange(int(n.sum())) + np.repeat(start[g] - (np.cumsum(n) - n), n)
            yield self.doc[g[i]], x[i] * b_ids + b[j], c[i] * cb[j]

    def texts_of_groups(self) -> Iterator[bytes]:
        """`a1,a2|b1;a3|b2,b3` per document: the groups' ids in order."""
        first_a, first_b = np.cumsum(self.na) - self.na, np.cumsum(self.nb) - self.nb
        place_a = np.arange(len(self.a)) + first_b[self.ga]
        place_b = np.arange(len(self.b)) + (first_a + self.na)[self.gb]
        ids, sign = np.zeros(len(self.a) + len(self.b), np.int32), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        sign[place_a[np.append(self.ga[1:] != self.ga[:-1], True)[: len(self.a)]]] = ord("|")
        sign[place_b[np.append(self.gb[1:] != self.gb[:-1], True)[: len(self.b)]]] = ord(";")
        digits, size = _decimals(int(ids.max(initial=0)).bit_length())
        signs = digits[ids]
        signs[np.arange(len(ids)), size[ids]] = sign
        text = signs[np.arange(digits.shape[1]) <= size[ids][:, None]]
        stop = np.append(0, np.cumsum(size[ids] + 1))[np.append(0, np.cumsum(self.n_a + self.n_b))].tolist()
        for lo, hi in zip(stop[:-1], stop[1:], strict=True):
            yield text[lo : max(lo, hi - 1)].tobytes()


@functools.cache
def _decimals(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(digits, number of digits) of all numbers of so many bits; a row has room for one more sign."""
    rows = [str(i).encode() for i in range(1 << bits)]
    width = len(rows[-1]) + 1
    return np.frombuffer(b"".join(r.ljust(width) for r in rows), np.uint8).reshape(-1, width), np.array([len(r) for r in rows])


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers of x, how often each)."""
    x = np.sort(x)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return x[first], np.diff(np.append(first, len(x)))


def _ranked(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers of x, which of them each place holds); x of so many bits. The places are sorted along with the numbers."""
    places = max(1, len(x) - 1).bit_length()
    if bits + places > 63:
        return np.unique(x, return_inverse=True)
    s = np.sort((x << places) | np.arange(len(x)))
    v = s >> places
    new = np.append(True, v[1:] != v[:-1])[: len(x)]
    which = np.empty(len(x), np.int64)
    which[s & ((1 << places) - 1)] = np.cumsum(new) - 1
    return v[new], which


def _once(g: np.ndarray, ids: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times) with the ids of large groups taken once, in the order of groups."""
    rest = ~large[g]
    most = int(ids.max()) + 1
    key, n = np.unique(g[~rest] * most + ids[~rest], return_counts=True)
    group, i, c = np.append(g[rest], key // most), np.append(ids[rest], key % most), np.append(np.ones(int(rest.sum()), np.int64), n)
    order = np.argsort(group, kind="stable")
    return group[order], i[order], c[order]


class Aligner:
    """Aligns lists of texts under two tokenizers."""

    def __init__(self, files: Tokenizers):
        self._a, self._b = byte_level(files[0], True), blank_led(files[1])
        self._sizes = [np.array([len(x) for x in spell(f)], np.int64) for spell, f in zip((byte_spelling, piece_spelling), files, strict=True)]
        self.b_ids = len(self._sizes[1])
        if len(self._sizes[0]) * self.b_ids >= 1 << PAIR_BITS:
            raise ValueError("the vocabularies have too many pairs of ids")

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[int, int, Aligned]]:
        """(first, last, alignment) of runs of texts."""
        for lo, hi in slices(texts):
            some = [" " + t if t else "" for t in texts[lo:hi]]
            (a, a_bound, a_odd), (b, b_bound, b_odd) = self._a.flat(some), self._b.flat(some)
            if (a_odd + b_odd).any():
                some = ["" if odd else t for t, odd in zip(some, (a_odd + b_odd).tolist(), strict=True)]
                (a, a_bound, _), (b, b_bound, _) = self._a.flat(some), self._b.flat(some)
            yield lo, hi, Aligned(a, a_bound, b, b_bound, *self._sizes)


@functools.lru_cache(maxsize=2)
def aligner(files: Tokenizers) -> Aligner:
    """One aligner per Python worker."""
    return Aligner(files)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit numbers, by levels: at each, numbers alone in their place get it, the others go on.

    As one array of 64-bit words: number of levels, number of keys, words of each level, then per level its bits and the number of places
    taken before each word, then the keys in the order of their numbers."""

    def __init__(self, words: np.ndarray):
        levels = int(words[0])
        self.n, at, self._levels = int(words[1]), 2 + levels, []
        for n in words[2 : 2 + levels].tolist():
            self._levels.append((words[at : at + n].view(np.uint64), words[at + n : at + 2 * n]))
            at += 2 * n
        self.keys = words[at : at + self.n]

    @staticmethod
    def build(keys: np.ndarray) -> np.ndarray:
        levels, left, taken, ordered = [], keys.astype(np.int64), 0, []
        while len(left):
            n = 2 * len(left) // 64 + 1
            place = _place(left, len(levels), n)
            alone = np.bincount(place, minlength=64 * n) == 1
            bits = np.packbits(alone, bitorder="little").view(np.int64)
            before = np.cumsum(np.bitwise_count(bits.view(np.uint64)).astype(np.int64))
            levels += [(bits, taken + np.append(0, before[:-1]))]
            got = alone[place]
            ordered.append(left[got][np.argsort(place[got])])
            taken, left = taken + int(before[-1]), left[~got]
        head = np.array([len(levels), len(keys), *(len(x) for x, _ in levels)], np.int64)
        return np.concatenate([head, *(x for level in levels for x in level), *ordered]).astype("<i8")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each key, whether it is one of the keys hashed); the number of others means nothing."""
        out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for k, (bits, before) in enumerate(self._levels):
            place = _place(keys[left], k, len(bits))
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            found = (bits[word] >> bit) & np.uint64(1) == 1
            w, below = word[found], bits[word[found]] & ((np.uint64(1) << bit[found]) - np.uint64(1))
            out[left[found]] = before[w] + np.bitwise_count(below)
            left = left[~found]
            if not len(left):
                break
        if not self.n:
            return out, np.zeros(len(keys), bool)
        return out, self.keys[out] == keys


def _place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level)) % np.uint64(64 * words)).astype(np.int64)


def _bucket(pairs: np.ndarray, b_ids: int, buckets: int) -> np.ndarray:
    return (mix((pairs // b_ids).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def pair_counts(docs: DataFrame, files: Tokenizers, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, part, pairs, counts): per task the pairs linked in its documents and in how many, packed as 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, part = aligner(files), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            pairs, counts = held.pop()
            at = _bucket(pairs, align.b_ids, buckets)
            order = np.argsort(at, kind="stable")
            pairs, counts = pairs[order], counts[order]
            used, first = np.unique(at[order], return_index=True)
            bound = np.append(first, len(pairs)).tolist()
            packed = [[x[lo:hi].astype("<i8").tobytes() for lo, hi in zip(bound[:-1], bound[1:], strict=True)] for x in (pairs, counts)]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([part] * len(used), pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], ["bucket", "part", "pairs", "counts"])

        for batch in batches:
            for _, _, found in align(batch.column("text").to_pylist()):
                for doc, pair, _ in found.links(align.b_ids):
                    once = _distinct((doc << PAIR_BITS) | pair)[0] & ((1 << PAIR_BITS) - 1)
                    held.append(_distinct(once))
                    if sum(len(x) for x, _ in held) > MOST_HELD:
                        held[:] = [_summed(held)]
                        if len(held[0][0]) > MOST_HELD // 2:
                            yield flush()
        if held:
            held[:] = [_summed(held)]
            yield flush()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, part int, pairs binary, counts binary")


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, which = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, which, np.concatenate([c for _, c in held]))
    return pairs, counts


def _store(folder: str, name: str, numbers: np.ndarray) -> str:
    """Write numbers to a new file of the folder; the name is told only by tasks that succeed."""
    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    file = f"{name}-{uuid.uuid4().hex[:12]}.bin"
    with store.open_output_stream(f"{at}/{file}") as out:
        out.write(numbers.astype("<i8").tobytes())
    return file


def _load(folder: str, file: str) -> np.ndarray:
    store, at = fs.FileSystem.from_uri(folder)
    return region(store, f"{at}/{file}", "<i8", 0, store.get_file_info(f"{at}/{file}").size // 8)


def hash_pairs(partial: DataFrame, parts: int, folder: str) -> DataFrame:
    """(bucket, hashed, n): the file of each bucket's minimal perfect hash and its number of pairs. parts: one more than the largest part.

    Pairs are united in a tree: at each level the sets of at most FAN parts become one."""

    def unite(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = np.unique(np.concatenate([_numbers(x) for x in rows["pairs"]]))
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "part": rows["part"].iloc[:1] % groups, "pairs": [pairs.tobytes()]})

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = np.unique(np.concatenate([_numbers(x) for x in rows["pairs"]]))
        bucket = int(rows["bucket"].iloc[0])
        return pd.DataFrame({"bucket": [bucket], "hashed": [_store(folder, f"pairs-{bucket}", PerfectHash.build(pairs))], "n": [len(pairs)]})

    sets = partial.select("bucket", "part", "pairs")
    while parts > FAN:
        groups = parts = -(-parts // FAN)
        sets = materialise(sets.groupBy("bucket", F.expr(f"part % {groups}")).applyInPandas(unite, "bucket int, part int, pairs binary"), "pair-sets")
    return materialise(sets.groupBy("bucket").applyInPandas(build, "bucket int, hashed string, n long"), "pair-hashes")


def count_pairs(partial: DataFrame, hashes: DataFrame, parts: int, folder: str, b_ids: int) -> DataFrame:
    """(bucket, hashed, counted): the file of each bucket's counts, by the numbers of its hash; a count is doubled, plus 1 where no pair of its
    A id has a higher one.

    Counts of at most FAN parts become one dense vector, then vectors are added in a tree."""

    def dense(rows: pd.DataFrame) -> pd.DataFrame:
        table = PerfectHash(_load(folder, rows["hashed"].iloc[0]))
        total = np.zeros(table.n, np.int64)
        for pairs, counts in zip(rows["pairs"], rows["counts"], strict=True):
            at, known = table.find(_numbers(pairs))
            if not known.all():
                raise RuntimeError("a pair is missing from its bucket's hash")
            total[at] += _numbers(counts)
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "hashed": rows["hashed"].iloc[:1], "part": rows["part"].iloc[:1] % groups, "counts": [total.tobytes()]})

    def added(vectors: pd.Series) -> np.ndarray:
        total = _numbers(vectors.iloc[0]).copy()
        for v in vectors.iloc[1:]:
            total += _numbers(v)
        return total

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "hashed": rows["hashed"].iloc[:1], "part": rows["part"].iloc[:1] % groups, "counts": [added(rows["counts"]).tobytes()]})

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        total, bucket = added(rows["counts"]), int(rows["bucket"].iloc[0])
        a = PerfectHash(_load(folder, rows["hashed"].iloc[0])).keys // b_ids
        order = np.argsort(a, kind="stable")
        first = np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1]))
        highest = np.zeros(len(total), np.int64)
        highest[order] = np.repeat(np.maximum.reduceat(total[order], first), np.diff(np.append(first, len(total))))
        return pd.DataFrame({"bucket": [bucket], "hashed": rows["hashed"].iloc[:1], "counted": [_store(folder, f"counts-{bucket}", 2 * total + (total == highest))]})

    schema = "bucket int, hashed string, part int, counts binary"
    groups = parts = -(-parts // FAN)
    small = F.broadcast(hashes.select("bucket", "hashed"))  # one row per bucket
    vectors = partial.join(small, "bucket").groupBy("bucket", F.expr(f"part % {groups}")).applyInPandas(dense, schema)
    while parts > FAN:
        vectors = materialise(vectors, "pair-vectors")
        groups = parts = -(-parts // FAN)
        vectors = vectors.groupBy("bucket", F.expr(f"part % {groups}")).applyInPandas(add, schema)
    return materialise(vectors.groupBy("bucket").applyInPandas(close, "bucket int, hashed string, counted string"), "pair-counts")


class Lookup:
    """Counts of pairs from the files of the buckets: memory-mapped on a local or mounted folder, else the last used of at most MOST_CACHED bytes."""

    def __init__(self, folder: str, files: dict[int, tuple[str, str]], b_ids: int, buckets: int):
        self._folder, self._files, self._b_ids, self._buckets = folder, files, b_ids, buckets
        self._kept: OrderedDict[int, tuple[PerfectHash, np.ndarray]] = OrderedDict()

    def _bucket(self, k: int) -> tuple[PerfectHash, np.ndarray]:
        if k not in self._kept:
            self._kept[k] = (PerfectHash(_load(self._folder, self._files[k][0])), _load(self._folder, self._files[k][1]))
            if not isinstance(self._kept[k][1], np.memmap):
                while len(self._kept) > 1 and sum(32 * h.n for h, _ in self._kept.values()) > MOST_CACHED:
                    self._kept.popitem(last=False)
        self._kept.move_to_end(k)
        return self._kept[k]

    def __call__(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether it is the highest of the A id) of each pair."""
        out, at = np.zeros(len(pairs), np.int64), _bucket(pairs, self._b_ids, self._buckets)
        order = np.argsort(at, kind="stable")
        used, first = np.unique(at[order], return_index=True)
        bound = np.append(first, len(order)).tolist()
        for k, lo, hi in zip(used.tolist(), bound[:-1], bound[1:], strict=True):
            table, counts = self._bucket(k)
            number, known = table.find(pairs[order[lo:hi]])
            if not known.all():
                raise RuntimeError("a pair was not counted: the documents changed between the passes")
            out[order[lo:hi]] = counts[number]
        return out >> 1, (out & 1).astype(bool)


def align_documents(docs: DataFrame, files: Tokenizers | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs.

    n_links counts linked occurrences; n_best those whose pair has the highest count of its A id, ties included; count_sum is the sum of the
    links' counts. groups_sha256: SHA-256 of the groups' ids, '' without tokens. Texts that are null, empty or not spelt back by both
    tokenizers have no tokens. Rows that repeat an id are documents of their own; null ids are kept. Texts of any length are
    whole; a group of any size is counted without listing repeated tokens. docs must not change between the two passes. An empty table gives
    an empty result. Only the names of `buckets` files pass through the driver.
    """
    spark = docs.sparkSession
    files = files or public_tokenizers()
    folder, b_ids = new_path(spark, "pair-files"), len(piece_spelling(files[1]))
    partial = materialise(pair_counts(docs, files, text_col, buckets), "pair-parts")
    parts = (partial.agg(F.max("part")).first()[0] or 0) + 1
    hashes = hash_pairs(partial, parts, folder)
    counted = count_pairs(partial, hashes, parts, folder, b_ids)
    names = {r["bucket"]: (r["hashed"], r["counted"]) for r in counted.collect()}  # one row per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, lookup = aligner(files), Lookup(folder, names, b_ids, buckets)
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for lo, hi, found in align(batch.column("text").to_pylist()):
                best, total = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for doc, pair, times in found.links(b_ids):
                    if not len(doc):
                        continue
                    once, which = _ranked(pair, PAIR_BITS)
                    count, top = lookup(once)
                    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                    best[doc[first]] += np.add.reduceat(top[which] * times, first)
                    total[doc[first]] += np.add.reduceat(count[which] * times, first)
                n_links = np.zeros(hi - lo, np.int64)
                np.add.at(n_links, found.doc, found.na * found.nb)
                shas = [hashlib.sha256(t).hexdigest() if t else "" for t in found.texts_of_groups()]
                for col, x in zip(cols, (found.n_a, found.n_b, found.n_groups, n_links, best, total, shas), strict=True):
                    col.extend(x)
            kinds = [pa.int64()] * 6 + [pa.string()]
            names_ = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names_)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
