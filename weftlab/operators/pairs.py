"""Overlaps of pairs of biclusters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlab.functions.stats import hypergeom_tail, jaccard, with_tail
from weftlab.session import materialise


def shared_counts(a: DataFrame, b: DataFrame, item: str) -> DataFrame:
    """(i, j, shared) of pairs of sets that share an item: an equi-join on the item, counted per pair."""
    return a.select(F.col("id").alias("i"), item).join(b.select(F.col("id").alias("j"), item), item).groupBy("i", "j").agg(F.count("*").alias("shared"))


#: Sets of a block; two blocks meet in one row, so pairs are dealt evenly whatever the sets hold.
BLOCK = 128


def sample_bits(samples: DataFrame, n: int) -> DataFrame:
    """(sample, word, bit) for every sample, null left out: samples are dealt by hash to words of 64 bits, half of which are used on average; where a
    word has more samples, they go on in another layer of words. n: about the number of samples, which touches the size alone."""
    words = max(1, -(-n // 32))
    named = samples.select("sample").filter("sample is not null").distinct().withColumn("w", F.pmod(F.xxhash64("sample"), F.lit(words)))
    nth = F.row_number().over(Window.partitionBy("w").orderBy("sample")) - 1
    return named.withColumn("nth", nth).select("sample", (F.col("w") + words * F.floor(F.col("nth") / 64)).cast("int").alias("word"), (F.col("nth") % 64).cast("int").alias("bit"))


def numbered_bits(samples: DataFrame, n: int) -> tuple[DataFrame, int]:
    """sample_bits, written, and the number of words."""
    bits = materialise(sample_bits(samples, n), "sample-bits")
    return bits, (bits.agg(F.max("word")).first()[0] or 0) + 1


def packed_sets(bics: DataFrame, samples: DataFrame, bits: DataFrame, n_words: int) -> DataFrame:
    """(id, direction, size, words): each bicluster's samples in the words of sample_bits, of which there are n_words. Ids without samples have no bit
    set; repeated samples count once; samples without a bit are left out."""
    part = samples.join(bits, "sample").groupBy("id", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    sets = part.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    words = F.transform(F.sequence(F.lit(0), F.lit(n_words - 1)), lambda w: F.coalesce(F.try_element_at("held", w), F.lit(0).cast("long")))
    rows = bics.select("id", "direction").join(sets, "id", "left").withColumn("words", words)
    return rows.select("id", "direction", F.aggregate("words", F.lit(0), lambda a, x: a + F.bit_count(x)).cast("long").alias("size"), "words")


def set_pairs(left: DataFrame, right: DataFrame | None = None, count: int | None = None) -> DataFrame:
    """(i, j, d1, d2, n1, n2, inter) with i < j: all pairs of packed sets of left, or, given right, all pairs with one in left and the other in right;
    right then holds left's rows too. count: of the larger table's rows, if known. Sets are dealt to blocks by hash, and blocks meet by equi-joins on their numbers."""
    def blocks(df: DataFrame) -> tuple[DataFrame, int]:
        n = max(1, -(-(df.count() if count is None else count) // BLOCK))
        return df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "direction", "size", "words", "new")).alias("sets")), n

    left = left.withColumn("new", F.lit(True))
    one, n = blocks(left)
    two = one
    if right is not None:
        two, n = blocks(right.join(left.select("id", "new"), "id", "left").withColumn("new", F.coalesce("new", F.lit(False))))
    met = one.withColumn("other", F.explode(F.sequence(F.col("block") if right is None else F.lit(0), F.lit(n - 1)))).join(two.select(F.col("block").alias("other"), F.col("sets").alias("others")), "other")
    rows = met.select("block", "other", F.explode("sets").alias("a"), "others").select("block", "other", "a", F.explode("others").alias("b"))
    once = (F.col("a.id") < F.col("b.id")) | (F.col("block") != F.col("other") if right is None else ~F.col("b.new"))
    rows = rows.filter(once & (F.col("a.id") != F.col("b.id")))
    first = F.col("a.id") < F.col("b.id")
    rows = rows.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"))
    inter = F.aggregate(F.zip_with("x.words", "y.words", lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda s, c: s + c)
    return rows.select(F.col("x.id").alias("i"), F.col("y.id").alias("j"), F.col("x.direction").alias("d1"), F.col("y.direction").alias("d2"), F.col("x.size").alias("n1"), F.col("y.size").alias("n2"), inter.cast("long").alias("inter"))


def pair_overlaps(found: DataFrame, n: int, listed: bool = True, ways: bool = False) -> DataFrame:
    """(i, j, shared, only_1, only_2, p, jac) of set_pairs; the second set is complemented where directions differ. listed: else pairs of one direction
    without a shared sample, whose p is 1, are left out. ways: with d1 and d2. The tail is computed once per distinct (shared, n1, n2)."""
    both = ("d1", "d2") if ways else ()
    same = F.col("d1") == F.col("d2")
    pairs = found if listed else found.filter(~same | (F.col("inter") > 0))
    pairs = pairs.withColumn("shared", F.when(same, F.col("inter")).otherwise(F.col("n1") - F.col("inter"))).withColumn("n2", F.when(same, F.col("n2")).otherwise(n - F.col("n2")))
    pairs = with_tail(materialise(pairs.select("i", "j", *both, "shared", "n1", "n2"), "set-pairs"), "shared", "n1", "n2", n)
    return pairs.select("i", "j", *both, "shared", (F.col("n1") - F.col("shared")).alias("only_1"), (F.col("n2") - F.col("shared")).alias("only_2"), "p", jaccard(F.col("shared"), F.col("n1"), F.col("n2")).alias("jac"))


#: Sets of a block in close_pairs, and cells that two blocks hold at once.
WIDE_BLOCK, CELLS = 512, 1 << 22


def close_pairs(left: DataFrame, n: int, below: float, right: DataFrame | None = None, count: int | None = None) -> DataFrame:
    """pair_overlaps with ways, of the pairs of set_pairs (left, right and count as there) whose p is under `below`.

    Blocks of sets meet in tasks as matrices of words, and no row stands for a pair whose p is larger: a tail is no less than its largest term, which
    tells most of them; the tails of the others are computed and compared.
    """
    def blocks(df: DataFrame) -> tuple[DataFrame, int]:
        n_blocks = max(1, -(-(df.count() if count is None else count) // WIDE_BLOCK))
        sets = df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "direction", "size", "words", "new")).alias("s"))
        return sets.select("block", *[F.col(f"s.{c}").alias(c) for c in ("id", "direction", "size", "new")], F.flatten("s.words").alias("words")), n_blocks

    left = left.withColumn("new", F.lit(True))
    one, n_blocks = blocks(left)
    two = one
    if right is not None:
        two, n_blocks = blocks(right.join(left.select("id", "new"), "id", "left").withColumn("new", F.coalesce("new", F.lit(False))))
    names, whole = ("id", "direction", "size", "new", "words"), right is None
    met = one.withColumn("other", F.explode(F.sequence(F.col("block") if whole else F.lit(0), F.lit(n_blocks - 1)))).join(two.select(F.col("block").alias("other"), *[F.col(c).alias(f"other_{c}") for c in names]), "other")
    met = met.repartition(max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block", "other")
    matrix = lambda words, ids: words.astype(np.int64).reshape(len(ids), -1)

    def meet(r: pd.Series) -> Iterator[pd.DataFrame]:
        (*one, new, words), (*two, other_new, other_words) = ([np.asarray(r[f"{side}{c}"]) for c in names] for side in ("", "other_"))
        free = np.full(len(two[0]), r["block"] != r["other"]) if whole else ~other_new
        yield from _close((*one, matrix(words, one[0])), (*two, matrix(other_words, two[0])), free, n, below)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, r in pdf.iterrows():
                yield from meet(r)

    kind = left.schema["id"].dataType.simpleString()
    found = met.mapInPandas(run, f"i {kind}, j {kind}, d1 string, d2 string, shared long, n1 long, n2 long")
    pairs = with_tail(materialise(found, "set-pairs"), "shared", "n1", "n2", n).filter(F.col("p") < below)
    return pairs.select("i", "j", "d1", "d2", "shared", (F.col("n1") - F.col("shared")).alias("only_1"), (F.col("n2") - F.col("shared")).alias("only_2"), "p", jaccard(F.col("shared"), F.col("n1"), F.col("n2")).alias("jac"))


def _close(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], free: np.ndarray, n: int, below: float) -> Iterator[pd.DataFrame]:
    """(i, j, d1, d2, shared, n1, n2) of the pairs of sets (ids, directions, sizes, words) whose largest term of the tail is under `below`. Pairs with a set of `two` that is
    not free count only where its id is the larger, others both ways; a set meets itself never."""
    (ids, ways, sizes, words), (other_ids, other_ways, other_sizes, other_words) = one, two
    a, b = np.ascontiguousarray(words).view(np.uint64), np.ascontiguousarray(other_words).view(np.uint64)
    lf, most = np.array([math.lgamma(i + 1) for i in range(n + 1)]), math.log(below) + 1e-6
    for at in range(0, len(a), step := max(1, CELLS // max(1, b.size))):
        some = slice(at, at + step)
        inter = np.bitwise_count(a[some, None, :] & b[None, :, :]).sum(axis=2, dtype=np.int64)
        first, same = ids[some, None] < other_ids[None, :], ways[some, None] == other_ways[None, :]
        n1, n2 = np.where(first, sizes[some, None], other_sizes[None, :]), np.where(first, other_sizes[None, :], sizes[some, None])
        shared, n2 = np.where(same, inter, n1 - inter), np.where(same, n2, n - n2)
        x = np.maximum(shared, (n1 + 1) * (n2 + 1) // (n + 2))
        term = lf[n1] + lf[n - n1] + lf[n2] + lf[n - n2] - lf[n] - lf[x] - lf[n1 - x] - lf[n2 - x] - lf[n - n1 - n2 + x]
        i, j = np.nonzero((first | free) & (ids[some, None] != other_ids[None, :]) & (term < most))
        if len(i):
            front, k = first[i, j], i + at
            (x1, x2), (d1, d2) = ((np.where(front, x[k], y[j]), np.where(front, y[j], x[k])) for x, y in ((ids, other_ids), (ways, other_ways)))
            yield pd.DataFrame({"i": x1, "j": x2, "d1": d1, "d2": d2, "shared": shared[i, j], "n1": n1[i, j], "n2": n2[i, j]})


def close_pairs_of_few(new: DataFrame, every: DataFrame, n: int, below: float) -> DataFrame:
    """close_pairs of a few sets, kept by the driver and sent to all tasks, with every set, theirs included; nothing is shuffled or written."""
    kept = new.select("id", "direction", "size", "words").toPandas()
    few = tuple(kept[c].to_numpy() for c in ("id", "direction", "size")) + (np.array(kept["words"].tolist(), np.int64),)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = pdf["id"].isin(few[0]).to_numpy()
            for free in (True, False):
                some = pdf[own != free]
                if len(some):
                    yield from _close((*(some[c].to_numpy() for c in ("id", "direction", "size")), np.array(some["words"].tolist(), np.int64)), few, np.full(len(few[0]), free), n, below)

    kind = every.schema["id"].dataType.simpleString()
    found = every.select("id", "direction", "size", "words").mapInPandas(run, f"i {kind}, j {kind}, d1 string, d2 string, shared long, n1 long, n2 long")
    found = found.withColumn("p", hypergeom_tail(F.col("shared"), F.col("n1"), F.col("n2"), n)).filter(F.col("p") < below)
    return found.select("i", "j", "d1", "d2", "shared", (F.col("n1") - F.col("shared")).alias("only_1"), (F.col("n2") - F.col("shared")).alias("only_2"), "p", jaccard(F.col("shared"), F.col("n1"), F.col("n2")).alias("jac"))


def bicluster_pair_overlap(bics: DataFrame, samples: DataFrame, n: int) -> DataFrame:
    """(i, j, shared, only_1, only_2, p, jac) of all pairs i < j by samples; the second set is complemented where directions differ.
    bics: id, direction; samples: id, sample; n: all samples. One row per pair of biclusters is the result itself."""
    bits, n_words = numbered_bits(samples, n)
    return pair_overlaps(set_pairs(packed_sets(bics, samples, bits, n_words), count=bics.count()), n)


def gene_overlap_pval(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """(i, j, shared, p): right-tail p that sets of a and b (id, gene) share so many of n genes; pairs without a shared gene are left out (p = 1)."""
    na, nb = a.groupBy(F.col("id").alias("i")).agg(F.count("*").alias("n1")), b.groupBy(F.col("id").alias("j")).agg(F.count("*").alias("n2"))
    rows = materialise(shared_counts(a, b, "gene").join(na, "i").join(nb, "j"), "shared-genes")
    return with_tail(rows, "shared", "n1", "n2", n).select("i", "j", "shared", "p")


def merge_candidates(pairs: DataFrame, n_bics: int, alpha: float = 0.05) -> DataFrame:
    """Pairs whose p times the number of biclusters is below alpha."""
    return pairs.filter(F.col("p") * n_bics < alpha)
