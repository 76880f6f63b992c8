"""MinHash near-duplicates with sequential Bayesian verification.

Documents are linked when the Jaccard similarity of their word-shingle sets reaches a threshold. Equal sets
collapse to one representative. Banded signatures propose candidates; each candidate pair's signatures are then
compared batch by batch, and a pair is pruned as soon as the posterior probability (uniform prior) that its
similarity reaches the threshold falls below `miss`. Survivors are verified exactly on their full sets.

Inside a bucket every member is first paired with the bucket's smallest member only. Components of the links
found so far then show which buckets still hold more than one component; only there the remaining pairs are compared by
signature, in blocks of bounded size, which give a spanning forest of the survivors. Its trees are clusters of candidates:
the texts of each meet once, again in blocks, and the pairs that still lie in different components are verified exactly. So no bucket is
capped, no link between components is lost, and pairs are never emitted beyond one link per row and block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlab.llm.batches import add_columns
from weftlab.llm.words import mix, shingle_sets, stream
from weftlab.operators.components import connected_components
from weftlab.session import materialise

BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
BLOCK = 256
#: Ids that are broadcast at most (8 bytes each).
MOST_SENT = 1_000_000
#: Odd multipliers of the signature's hash functions.
_MULTIPLIERS = stream(3, HASHES) | np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over a non-empty set, 32 bits each."""
    low = None
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 1024):
            part = (np.multiply.outer(_MULTIPLIERS, s[i : i + 1024])).min(axis=1)
            low = part if low is None else np.minimum(low, part)
    return (low >> np.uint64(32)).astype("<u4")


def least_matches(percent: int, miss: float, step: int = ROWS * 5) -> dict[int, int]:
    """For each number n of compared hashes the fewest matches m with P(similarity >= percent/100 | m of n) >= miss.

    Under a uniform prior the posterior is Beta(m+1, n-m+1); its upper tail at t is P(Binomial(n+1, t) <= m)."""
    t, out = percent / 100, {}
    for n in [*range(step, HASHES, step), HASHES]:
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
        out[n] = m
    return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, sig) per row: size of the shingle set, its 128-bit fingerprint, its signature."""

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        n, f1, f2, sig = [], [], [], []
        for s in shingle_sets(b.column("text").to_pylist(), size):
            with np.errstate(over="ignore"):
                for f, x in ((f1, s), (f2, mix(s ^ np.uint64(0x5555555555555555)))):
                    f.append(x.sum(dtype=np.uint64).astype(np.int64))
            n.append(len(s))
            sig.append(signature(s).tobytes() if len(s) else None)
        return {"n_shingles": pa.array(n, pa.int64()), "fp1": pa.array(f1, pa.int64()), "fp2": pa.array(f2, pa.int64()), "sig": pa.array(sig, pa.binary())}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return add_columns(rows, ["text"], "n_shingles long, fp1 long, fp2 long, sig binary", run)


def _prune(pairs: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose signatures survive every batch."""
    need = least_matches(percent, miss)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            live = np.flatnonzero(100 * np.minimum(pdf["na"], pdf["nb"]).to_numpy() >= percent * np.maximum(pdf["na"], pdf["nb"]).to_numpy())
            x = np.frombuffer(b"".join(pdf["sa"]), "<u4").reshape(len(pdf), HASHES)
            y = np.frombuffer(b"".join(pdf["sb"]), "<u4").reshape(len(pdf), HASHES)
            at, m = 0, np.zeros(len(live), np.int64)
            for n, least in need.items():
                m = m + (x[live, at:n] == y[live, at:n]).sum(axis=1)
                live, m, at = live[m >= least], m[m >= least], n
            yield pdf.iloc[live][["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs (a, b) that are linked on their full sets. docs: one row per representative (id, text).

    The pairs of one a are dealt in blocks of about BLOCK, so a popular a meets its partners in many tasks; each text comes once to a
    block."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    dealt = materialise(pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("k")).cast("int")).select("a", "part", "b"), "star-blocks")
    first = dealt.select("a", "part").distinct().select("a", "part", F.col("a").alias("id"))
    places = dealt.withColumnRenamed("b", "id").union(first)
    texts = places.join(_few(docs, places.select("id")), "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf["a"].iat[0]
        pdf = pdf.drop_duplicates(["id", "text"])  # rows that share an id are one node, with each of their texts
        whole, others = pdf.loc[pdf["id"] == a, "text"].tolist(), pdf[pdf["id"] != a]
        keep = np.zeros(len(others), bool)
        for s in shingle_sets(whole, size):
            for i, t in enumerate(shingle_sets(others["text"].tolist(), size)):
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep[i] |= 100 * both >= percent * (len(s) + len(t) - both) and both > 0
        return pd.DataFrame({"a": a, "b": others.loc[keep, "id"].unique()})

    return _dealt_out(texts, "a", "part").groupBy("a", "part").applyInPandas(run, "a long, b long")


def _blocks(rows: DataFrame, key: list[str], size: int) -> DataFrame:
    """rows dealt so that every pair of rows of one key meets in a group (key, i, j) of at most about 2 * size rows;
    own tells which side of the group a row is on."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias("k"))
    dealt = rows.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("k", "other")
    return _dealt_out(dealt, *key, "i", "j")  # else the blocks of a key would stay in one task


def _dealt_out(df: DataFrame, *key: str) -> DataFrame:
    """df dealt by key to the full number of shuffle partitions: comparing costs far more than the bytes of a block tell."""
    return df.repartition(max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *key)


def _few(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs (id, text) with one of the ids; up to MOST_SENT ids are sent to all tasks, more meet the rows by a shuffle."""
    ids = ids.distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, "id", "left_semi")


def _survivors(pdf: pd.DataFrame, need: dict[int, int], percent: int, component: Callable[[int], int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, rows, matches) of a dealt group: pairs across its two sides, in different components, that survive every
    batch; component gives the current component of a row."""
    sig = np.frombuffer(b"".join(pdf["sig"]), "<u4").reshape(len(pdf), HASHES)
    n, own = pdf["n"].to_numpy(), pdf["own"].to_numpy()
    i, j = pdf["i"].iat[0], pdf["j"].iat[0]
    cols = np.flatnonzero(own == j)
    for r in np.flatnonzero(own == i):
        c = cols[cols > r] if i == j else cols
        comp = np.array([component(x) for x in c])
        c = c[(comp != component(r)) & (100 * np.minimum(n[c], n[r]) >= percent * np.maximum(n[c], n[r]))] if len(c) else c
        at, m = 0, np.zeros(len(c), np.int64)
        for upto, least in need.items():
            if not len(c):
                break
            m = m + (sig[c, at:upto] == sig[r, at:upto]).sum(axis=1)
            c, m, at = c[m >= least], m[m >= least], upto
        if len(c):
            yield r, c, m


class _Union:
    """Union-find over the rows of a group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _links(pairs: list[tuple[int, int]], rep: np.ndarray) -> pd.DataFrame:
    got = rep[np.array(pairs, dtype=np.int64).reshape(-1, 2)]
    return pd.DataFrame({"a": got.min(axis=1), "b": got.max(axis=1)})


def _candidates(members: DataFrame, percent: int, miss: float) -> DataFrame:
    """A spanning forest (a, b) of the surviving pairs of each bucket that still holds more than one component."""
    need = least_matches(percent, miss)
    open_ = members.groupBy("band", "h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("band", "h")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        comp, seen, out = pdf["comp"].to_numpy(), _Union(len(pdf)), []
        for r, c, _ in _survivors(pdf, need, percent, comp.__getitem__):
            out.extend((r, x) for x in c if seen.join(r, x))
        return _links(out, pdf["rep"].to_numpy())

    dealt = _blocks(members.join(open_, ["band", "h"]), ["band", "h"], BLOCK)
    return dealt.groupBy("band", "h", "i", "j").applyInPandas(run, "a long, b long").distinct()


def _verified(nodes: DataFrame, percent: int, miss: float, size: int) -> DataFrame:
    """Exact links (a, b) that join different components within clusters of candidates.
    nodes: cluster, rep, comp, n, sig, text. Likelier pairs are verified first; pairs that are already joined need no test."""
    need = least_matches(percent, miss)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets, joined, out = list(shingle_sets(pdf["text"].tolist(), size)), _Union(len(pdf)), []
        first: dict[int, int] = {}
        for x, c in enumerate(pdf["comp"]):
            joined.join(first.setdefault(c, x), x)
        found = [(m, r, c) for r, c, m in _survivors(pdf, need, percent, [joined.root(x) for x in range(len(pdf))].__getitem__)]
        if found:
            m = np.concatenate([f[0] for f in found])
            r, c = np.repeat([f[1] for f in found], [len(f[2]) for f in found]), np.concatenate([f[2] for f in found])
            for k in np.argsort(-m, kind="stable"):
                x, y = int(r[k]), int(c[k])
                if joined.root(x) != joined.root(y):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        joined.join(x, y)
                        out.append((x, y))
        return _links(out, pdf["rep"].to_numpy())

    return _blocks(nodes, ["cluster"], BLOCK).groupBy("cluster", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = 5, miss: float = 1e-6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    component_id is the smallest id reachable over links, itself included; kept marks the row whose id that is.
    Null texts and texts without words have n_shingles 0 and stand alone. Rows that share an id are one node and
    are all returned. A row with a null id links with nothing; its component_id is null and it is kept. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    sigs = materialise(signatures(docs, id_col, text_col, size), "minhash")
    first = materialise(sigs.filter("n_shingles > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep")).filter("rep is not null"), "fingerprints")
    reps = sigs.join(first, (sigs.fp1 == first.fp1) & (sigs.fp2 == first.fp2) & (sigs.doc_id == first.rep), "left_semi").dropDuplicates(["doc_id", "fp1", "fp2"])
    bands = F.array(*[F.xxhash64(F.substring("sig", 1 + 4 * ROWS * i, 4 * ROWS)) for i in range(BANDS)])
    rows = reps.select(F.col("doc_id").alias("rep"), F.posexplode(bands).alias("band", "h"))
    shared = rows.groupBy("band", "h").agg(F.min("rep").alias("pivot"), F.count("*").alias("m")).filter("m > 1").drop("m")
    members = materialise(rows.join(shared, ["band", "h"]), "buckets")
    ids = members.select("rep").distinct()
    of = materialise(reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sig").join(ids, "rep", "left_semi"), "candidates")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def signed(pairs: DataFrame) -> DataFrame:
        a = of.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
        b = of.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        return pairs.join(a, "a").join(b, "b")

    star = members.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialise(_verify(materialise(_prune(signed(star), percent, miss).distinct(), "star"), texts, percent, size), "links")
    comp = connected_components(links, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    known = of.join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    maybe = materialise(_candidates(members.drop("pivot").join(known, "rep"), percent, miss), "candidate-links")
    if maybe.isEmpty():
        final = comp
    else:
        clusters = connected_components(maybe, "a", "b").toDF("rep", "cluster")
        clusters = materialise(clusters, "clusters")
        few = _few(texts, clusters.select(F.col("rep").alias("id")))
        nodes = clusters.join(known, "rep").join(few.withColumnRenamed("id", "rep"), "rep").dropDuplicates(["cluster", "rep", "sig"])
        more = materialise(_verified(nodes, percent, miss, size), "links")
        final = comp if more.isEmpty() else connected_components(comp.select(F.col("rep").alias("a"), F.col("comp").alias("b")).union(more), "a", "b").toDF("rep", "comp")
    placed = first.join(final, "rep", "left").select("fp1", "fp2", F.coalesce("comp", "rep").alias("comp"))
    out = sigs.select("doc_id", "n_shingles", "fp1", "fp2").join(placed.withColumn("n0", F.lit(True)), ["fp1", "fp2"], "left")
    linked = F.col("n_shingles") > 0
    out = out.select("doc_id", "n_shingles", F.when(linked & F.col("doc_id").isNotNull(), F.col("comp")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = 5, miss: float = 1e-6) -> DataFrame:
    """Rows of docs without those that repeat another: one id of each group stays, and of rows that share an id
    the one with the smallest text (null first). Null ids stay. Columns as in docs."""
    found = near_duplicates(docs, id_col, text_col, percent, size, miss).filter("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    left = docs.join(found, id_col, "left_anti").select(*docs.columns)
    again = left.groupBy(id_col).count().filter("count > 1").filter(F.col(id_col).isNotNull()).select(id_col)
    order = Window.partitionBy(id_col).orderBy(text_col)
    one = left.join(again, id_col, "left_semi").withColumn("__weftlab_nth", F.row_number().over(order)).filter("__weftlab_nth = 1").select(*docs.columns)
    return left.join(again, id_col, "left_anti").select(*docs.columns).unionByName(one)
