"""Merging biclusters that share samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlab.functions.ordering import numbered
from weftlab.operators import bicluster, pairs
from weftlab.session import materialise, release


#: Up to so many pairs of a round are kept by the driver and sent to all tasks.
FEW = 1000
#: Up to so many pairs of new biclusters and others are listed as rows; above it they meet in blocks.
MET = 1_000_000


def merge_biclusters(bics: DataFrame, members: DataFrame, samples: DataFrame, m: DataFrame, n: int, min_snr: float, min_n_samples: int = 8, alpha: float = 0.05, least_jaccard: float = 0.0, discordant: bool = False, exact: bool = False, max_rounds: int = 10_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bics, members, samples) after merging significant pairs (p times the number of biclusters under alpha).

    Each round merges all pairs that are each other's best (lowest p, then highest J, then ids), which are disjoint; exact: the one best pair only.
    The union of the genes gets a new sample set in the first's direction, else, if directions differ, in the second's (discordant: MIXED,
    the smaller cluster); it replaces both when its avgSNR reaches min_snr, otherwise the pair is not tried again. The factor is fixed per round.
    After a round only the pairs of the merged biclusters are new, the others' are kept, down to the p that counts at half the number of biclusters, as
    the factor falls with that number; whenever under half of them are left, all pairs of these are compared anew. Rounds go on until no pair is left
    (every round takes a bicluster or a pair away); RuntimeError after max_rounds. An empty table stays empty.

    A round is a handful of small jobs, as each of them takes its time however little it holds: genes stay under the id they were given with, and a
    table of one row per bicluster tells which one it is part of by now; a union is split, chosen and scored in one task; sample sets are words of bits.
    """
    bics, members, samples = materialise(bics.select("id", "direction"), "bics"), materialise(members, "genes"), materialise(samples, "samples")
    numbers = materialise(numbered(samples.select("sample").union(m.select("sample")).filter("sample is not null").distinct(), ["sample"], "number"), "sample-numbers")
    n_words = (numbers.agg(F.max("number")).first()[0] or 0) // 64 + 1
    bits = numbers.select("sample", F.floor(F.col("number") / 64).cast("int").alias("word"), (F.col("number") % 64).cast("int").alias("bit"))
    rows = materialise(bicluster.profiles(m.join(members.select("gene").distinct(), "gene", "left_semi"), numbers), "profiles")  # unions hold no other genes
    state = pairs.packed_sets(bics, samples, bits, n_words).select("id", F.col("id").alias("part_of"), "direction", "size", "words", F.lit(-1).alias("merged"))
    state = _State(materialise(state, "packed-sets"))
    alive = state.table.count()
    least = max(1, alive // 2)  # biclusters down to which the open pairs are known
    below = lambda: alpha / least * (1 + 1e-9)
    kept = lambda found: found.filter(F.col("jac") >= least_jaccard).select("i", "j", "d1", "d2", "p", "jac")
    known = materialise(kept(pairs.close_pairs(state.left(), n, below(), count=alive)), "open-pairs")
    tried = _Tried()
    for nth in range(max_rounds):
        chosen = materialise(_best_pairs(pairs.merge_candidates(known, alive, alpha), exact), "chosen")
        n_chosen = chosen.count()
        if not n_chosen:
            found = _as_given(materialise(state.now(), "packed-sets"), members, samples, numbers)
            release(rows, known, chosen, members, samples, state.table, *tried.tables)
            return found
        few = F.broadcast if n_chosen <= FEW else lambda d: d
        ends = state.now().select("id", "part_of").join(few(chosen.select("*", F.explode(F.array("i", "j")).alias("part_of"))), "part_of")
        genes = members.join(few(ends), "id").select("i", "j", "d1", "d2", "gene").distinct()
        done, n_done = _held(bicluster.united_sets(rows.join(few(genes), "gene"), n, n_words, min_snr, min_n_samples, discordant), "done")
        was = known, chosen, done
        known = known.join(few(chosen.select("i", "j")), ["i", "j"], "left_anti")
        if n_done < n_chosen:
            tried.add(chosen.join(done.select("i", "j"), ["i", "j"], "left_anti").select("i", "j", F.lit(nth).alias("round")))
        if n_done:
            alive -= n_done
            state.add(done, n_done, nth)
            gone = few(done.select(F.explode(F.array("i", "j")).alias("x")))
            new = done.select(F.col("i").alias("id"), "direction", "size", "words")
            if alive < least:
                least = max(1, alive // 2)
                known = tried.without(kept(pairs.close_pairs(state.left(), n, below(), count=alive)), state.left())
            else:
                known = known.join(gone.withColumnRenamed("x", "i"), "i", "left_anti").join(gone.withColumnRenamed("x", "j"), "j", "left_anti")
                met = pairs.close_pairs_of_few(new, state.left(), n, below()) if n_done <= FEW and n_done * alive <= MET else pairs.close_pairs(new, n, below(), state.left(), alive)
                known = known.select("i", "j", "d1", "d2", "p", "jac").unionByName(kept(met))
        known = materialise(known.select("i", "j", "d1", "d2", "p", "jac"), "open-pairs")
        release(*was)
    raise RuntimeError(f"merging did not end in {max_rounds} rounds")


def _held(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """df and its number of rows: up to FEW rows are kept by the driver, more are written."""
    rows = df.limit(FEW + 1).collect()
    if len(rows) <= FEW:
        return df.sparkSession.createDataFrame(rows, df.schema), len(rows)
    df = materialise(df, name)
    return df, df.count()


class _State:
    """(id, part_of, direction, size, words, merged): which bicluster each is part of by now, and the set of those that are left; merged: the last round in
    which it was, -1 if none. Up to FEW changes are kept beside the written table, so that most rounds write none."""

    def __init__(self, table: DataFrame):
        self.table, self.into, self.sets = table, {}, {}

    def add(self, done: DataFrame, n_done: int, nth: int) -> None:
        """All that was part of j is part of i, which has a new set."""
        if n_done + len(self.into) > FEW:
            was, self.table = (self.table, done), materialise(self._moved(self.now(), done, nth, n_done <= FEW), "packed-sets")
            self.into, self.sets = {}, {}
            release(was[0])
            return
        for r in done.collect():  # FEW at most
            self.into |= {x: r["i"] for x, at in self.into.items() if at == r["j"]} | {r["j"]: r["i"]}
            self.sets.pop(r["j"], None)
            self.sets[r["i"]] = (r["direction"], r["size"], r["words"], nth)

    def now(self) -> DataFrame:
        if not self.into:
            return self.table
        kinds, spark = {f.name: f.dataType.simpleString() for f in self.table.schema}, self.table.sparkSession
        into = spark.createDataFrame(list(self.into.items()), f"part_of {kinds['id']}, into {kinds['id']}")
        sets = spark.createDataFrame([(x, *new) for x, new in self.sets.items()], f"id {kinds['id']}, new_direction string, new_size long, new_words array<long>, new_merged int")
        return self._joined(self.table, into, sets, True)

    def left(self) -> DataFrame:
        return self.now().filter("id = part_of").select("id", "direction", "size", "words", "merged")

    @classmethod
    def _moved(cls, state: DataFrame, done: DataFrame, nth: int, few: bool) -> DataFrame:
        sets = done.select(F.col("i").alias("id"), *[F.col(c).alias(f"new_{c}") for c in ("direction", "size", "words")], F.lit(nth).alias("new_merged"))
        return cls._joined(state, done.select(F.col("j").alias("part_of"), F.col("i").alias("into")), sets, few)

    @staticmethod
    def _joined(state: DataFrame, into: DataFrame, sets: DataFrame, few: bool) -> DataFrame:
        hint = F.broadcast if few else lambda d: d
        rows = state.join(hint(into), "part_of", "left").join(hint(sets), "id", "left")
        fresh = F.col("new_size").isNotNull()
        now = [F.when(fresh, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("direction", "size", "words")]
        merged = F.when(fresh, F.col("new_merged")).when(F.col("into").isNotNull(), 0).otherwise(F.col("merged"))
        return rows.select("id", F.coalesce("into", "part_of").alias("part_of"), *now, merged.cast("int").alias("merged"))


class _Tried:
    """(i, j, round) of pairs whose union was turned down, which counts until one of them is merged."""

    def __init__(self):
        self.rows, self.schema, self.tables = [], None, []

    def add(self, found: DataFrame) -> None:
        held, _ = _held(found, "tried-pairs")
        if hasattr(held, "materialised_at"):
            self.tables.append(held)
            return
        self.rows, self.schema = self.rows + held.collect(), held.schema
        if len(self.rows) > FEW:
            self.tables.append(materialise(found.sparkSession.createDataFrame(self.rows, self.schema), "tried-pairs"))
            self.rows = []

    def without(self, found: DataFrame, left: DataFrame) -> DataFrame:
        """found without those of these pairs that are as they were."""
        tables = self.tables + ([found.sparkSession.createDataFrame(self.rows, self.schema)] if self.rows else [])
        if not tables:
            return found
        rows = tables[0]
        for more in tables[1:]:
            rows = rows.unionByName(more)
        since = lambda x: left.select(F.col("id").alias(x), F.col("merged").alias(f"since_{x}"))
        rows = rows.join(since("i"), "i").join(since("j"), "j").filter("round > since_i and round > since_j")
        return found.join(rows.select("i", "j"), ["i", "j"], "left_anti")


def _best_pairs(found: DataFrame, exact: bool) -> DataFrame:
    """(i, j, d1, d2) of the pairs that are each other's best: lowest p, then highest jac, then ids. exact: the best pair of all."""
    if exact:
        return found.orderBy("p", F.desc("jac"), "i", "j").limit(1).select("i", "j", "d1", "d2")
    place = F.struct("p", (-F.col("jac")).alias("jac"), "i", "j", "d1", "d2")
    best = found.select(F.explode(F.array("i", "j")).alias("x"), place.alias("pair")).groupBy("x").agg(F.min("pair").alias("pair"))
    return best.groupBy("pair.i", "pair.j").agg(F.count("*").alias("both"), F.first("pair.d1").alias("d1"), F.first("pair.d2").alias("d2")).filter("both = 2").drop("both")


def _as_given(state: DataFrame, members: DataFrame, samples: DataFrame, numbers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bics, members, samples) of the biclusters left, written, as they are read more than once; those that were never merged keep their rows."""
    merged, left = state.filter("merged >= 0"), state.filter("id = part_of")
    genes = members.join(merged.select("id", "part_of"), "id").select(F.col("part_of").alias("id"), "gene").distinct()
    words = left.filter("merged >= 0").select("id", F.posexplode("words").alias("word", "bits"))
    held = words.select("id", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.getbit("bits", b) == 1, F.col("word").cast("long") * 64 + b)), F.isnotnull)).alias("number"))
    inside = held.join(numbers, "number").select("id", "sample")
    old = merged.select("id")
    genes = materialise(members.join(old, "id", "left_anti").select("id", "gene").unionByName(genes), "genes")
    return left.select("id", "direction"), genes, materialise(samples.join(old, "id", "left_anti").select("id", "sample").unionByName(inside), "samples")


def unite_up_down(up: tuple[DataFrame, DataFrame, DataFrame], down: tuple[DataFrame, DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both (bics, members, samples) as one, the ids of the second raised past those of the first. Either may be empty."""
    offset = F.broadcast(up[0].agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("by")))
    raised = [d.join(offset).withColumn("id", (F.col("id") + F.col("by")).cast("int")).drop("by") for d in down]
    return tuple(u.unionByName(r) for u, r in zip(up, raised, strict=True))
