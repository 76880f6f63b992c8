"""Hard negatives by lists shared within clusters of anchors.

Anchors are clustered by direction. For a cluster with centre c and widest member angle w, no member u can score a row v above
|u| * |v| * cos(max(0, angle(v, c) - w)): dividing by |u| gives one bound per row, by which the cluster's list of rows is sorted once for all
its members. A member walks the list from the top and stops when what is left can no longer change its answer.

Lists are walked in rounds. Each round takes the next range of bounds of every list that has a member on the way; tasks sort
their rows of that range by bound, in chunks of bounded size, and chunks meet the members in blocks of bounded size, so that neither a large
cluster, nor a frequent label, nor many copies of a vector gathers in one task. Ranges grow eightfold from round to round. Their limits
come from a sample and touch the amount of work only: a row outside all of them does not exist, as the last one ends at -infinity.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlab.llm.words import mix
from weftlab.session import materialise, release

SAMPLE = 20_000
PER_CLUSTER = 256
MOST_CLUSTERS = 64
BLOCK = 512
CHUNK = 2048
FIRST_RANGE = 4096
LEAST_DEALT = 8
PER_TASK = 64
SLACK = 1e-6
NONE = np.iinfo(np.int64).min
PACKED = "cluster int, block int, packed binary"


def prepared(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = 256) -> DataFrame:
    """(id, label, dim, vec): rows with an id, a label and only finite components, which become floor(scale * x). Of rows that repeat an id the one
    with the smallest label and vector stays."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias(vec_col))
    good = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size(vec_col) > 0) & finite, F.lit(False)))
    whole = good.select("id", "label", F.transform(vec_col, lambda x: F.floor(x * scale).cast("double")).alias("vec"))
    once = whole.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r"))
    return once.select("id", "r.label", F.size("r.vec").alias("dim"), "r.vec")


def _stack(vecs, dim: int) -> np.ndarray:
    return np.concatenate(list(vecs)).astype(np.float64).reshape(-1, dim) if len(vecs) else np.zeros((0, dim))


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _directions(x: np.ndarray) -> np.ndarray:
    n = _norms(x)[:, None]
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angle of every row with every centre; 0 for a zero row, which scores 0 with anything."""
    cos = np.clip(_directions(x) @ centres.T, -1.0, 1.0)
    cos[_norms(x) == 0] = 1.0
    return np.arccos(cos)


def fit_centres(sample: np.ndarray, clusters: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Unit centres of the sample's directions by spherical k-means."""
    x = _directions(sample)
    centres = x[np.random.default_rng(seed).choice(len(x), clusters, replace=False)].copy()
    for _ in range(rounds):
        at = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(_norms(sums)[:, None] > 0, _directions(sums), centres)
    return centres


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of x with all of y, exact while they fit into 63 bits."""
    if len(x) and len(y) and _norms(x).max() * _norms(y).max() >= 2.0**52:
        return x.astype(np.int64) @ y.astype(np.int64).T
    return (x @ y.T).astype(np.int64)


def _merged(ids: list[np.ndarray], values: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of several lists along the last axis: highest value first, ties by id; places without a row hold NONE."""
    i, v = np.concatenate(ids, axis=-1), np.concatenate(values, axis=-1)
    order = np.argsort(i, axis=-1, kind="stable")
    i, v = np.take_along_axis(i, order, -1), np.take_along_axis(v, order, -1)
    order = np.argsort(-v.astype(np.float64) if (np.abs(v[v != NONE]) < 2**52).all() else _descending(v), axis=-1, kind="stable")[..., :k]
    return np.take_along_axis(i, order, -1), np.take_along_axis(v, order, -1)


def _descending(v: np.ndarray) -> np.ndarray:
    return np.where(v == NONE, np.iinfo(np.int64).max, -v)


def _top(s: np.ndarray, ok: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k columns of each row of s among those marked ok; ids ascend with the columns, so the first of equal scores is the smallest id."""
    s = np.where(ok, s, NONE)
    out_i, out_v = np.full((len(s), k), NONE), np.full((len(s), k), NONE)
    rows = np.arange(len(s))
    for j in range(min(k, s.shape[1])):
        at = np.argmax(s, axis=1)
        v = s[rows, at]
        out_v[:, j], out_i[:, j] = v, np.where(v == NONE, NONE, ids[at])
        s[rows, at] = NONE
    return out_i, out_v


class Block:
    """Some members of a cluster, and what they have found: positives (n, p) and, per positive, negatives (n, p, q)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, p: int, q: int):
        self.ids, self.labels, self.x, self.norm = ids, labels, x, _norms(x)
        self.pos_id, self.pos = np.full((len(ids), p), NONE), np.full((len(ids), p), NONE)
        self.neg_id, self.neg = np.full((len(ids), p, q), NONE), np.full((len(ids), p, q), NONE)

    def bar(self, mining: bool, low: int, high: int) -> np.ndarray:
        """The score under which nothing more counts for a member: a row is of use only at or above it."""
        if not mining:
            return np.where(self.pos[:, -1] == NONE, -np.inf, self.pos[:, -1].astype(np.float64))
        last, floor = self.neg[:, :, -1].astype(np.float64), low * self.pos.astype(np.float64) / 100
        bars = np.where(self.neg[:, :, -1] == NONE, floor, np.maximum(last, floor))
        return np.where((self.pos == NONE) | (self.pos < 0), np.inf, bars).min(axis=1)  # no score lies between low and high per cent of a negative one

    def on_the_way(self, bound: float, mining: bool, low: int, high: int) -> np.ndarray:
        """Members for whom a row at this bound could still count."""
        most = np.where(self.norm > 0, self.norm, 1e-300) * bound
        return most + SLACK * (1 + np.abs(most)) >= self.bar(mining, low, high)

    def meet(self, ids: np.ndarray, labels: np.ndarray, y: np.ndarray, mining: bool, low: int, high: int) -> None:
        """Score a chunk of rows whose ids ascend, and keep what counts."""
        s = scores(self.x, y)
        if not mining:
            ok = (self.labels[:, None] == labels[None, :]) & (self.ids[:, None] != ids[None, :])
            i, v = _top(s, ok, ids, self.pos.shape[1])
            self.pos_id, self.pos = _merged([self.pos_id, i], [self.pos, v], self.pos.shape[1])
            return
        other = self.labels[:, None] != labels[None, :]
        for j in range(self.pos.shape[1]):
            p = self.pos[:, j : j + 1]
            ok = other & (p != NONE) & (low * p <= 100 * s) & (100 * s <= high * p)
            i, v = _top(s, ok, ids, self.neg.shape[2])
            self.neg_id[:, j], self.neg[:, j] = _merged([self.neg_id[:, j], i], [self.neg[:, j], v], self.neg.shape[2])

    def join(self, other: Block) -> None:
        """Take over what another copy of the block has found in other rows."""
        if not np.array_equal(self.pos_id, other.pos_id):
            self.pos_id, self.pos = _merged([self.pos_id, other.pos_id], [self.pos, other.pos], self.pos.shape[1])
        self.neg_id, self.neg = _merged([self.neg_id, other.neg_id], [self.neg, other.neg], self.neg.shape[2])

    def fresh(self, mining: bool) -> Block:
        """A copy that has found nothing of the present phase yet."""
        out = Block(self.ids, self.labels, self.x, self.pos.shape[1], self.neg.shape[2])
        if mining:
            out.pos_id, out.pos = self.pos_id, self.pos
        return out


def hard_negatives(df: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", clusters: int | None = None, seed: int = 5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first `positives` rows of the same
    label, the first `negatives` rows of another label whose score lies between low and high per cent of the positive's.

    A score is the inner product of components floor(256 * x); higher scores come first, ties by smaller id. An anchor is never its own
    positive. Rows with a null id or label, a null or empty vector, or a null or non-finite component take no part; rows that repeat an id count once,
    with the smallest label and vector; only vectors of one length meet. Zero vectors score 0. Fewer rows than asked for: all of
    them. Anchors without a positive or without such a negative have no rows. Scores must fit into 63 bits. An empty table gives an empty result.
    clusters: by default one per PER_CLUSTER anchors, at most MOST_CLUSTERS; their centres are fitted on at most SAMPLE anchors.
    """
    rows = materialise(prepared(df, id_col, vec_col, label_col), "vectors")
    asked = materialise(prepared(anchors, id_col, vec_col, label_col), "anchors")
    found = None
    for dim in [r["dim"] for r in asked.select("dim").distinct().orderBy("dim").collect()]:  # one row per length of vectors
        part = _mine(rows.filter(F.col("dim") == dim), asked.filter(F.col("dim") == dim), int(dim), positives, negatives, low, high, clusters, seed)
        found = part if found is None else found.union(part)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return df.sparkSession.createDataFrame([], schema) if found is None else found


def _mine(rows: DataFrame, asked: DataFrame, dim: int, p: int, q: int, low: int, high: int, clusters: int | None, seed: int) -> DataFrame:
    spark = rows.sparkSession
    n, n_asked = rows.count(), asked.count()
    some = lambda d: _stack([r["vec"] for r in d.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vec").collect()], dim)
    sample = some(asked)
    k = max(1, min(clusters or math.ceil(n_asked / PER_CLUSTER), MOST_CLUSTERS, len(sample)))
    centres = fit_centres(sample, k, seed)
    blocks = max(1, math.ceil(n_asked / k / BLOCK))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            angle = _angles(_stack(pdf["vec"], dim), centres)
            at = np.argmin(angle, axis=1) if len(pdf) else np.zeros(0, np.int64)
            yield pdf.assign(cluster=at.astype(np.int32), angle=angle[np.arange(len(pdf)), at])

    placed = materialise(asked.mapInPandas(place, "id long, label long, dim int, vec array<double>, cluster int, angle double"), "placed")
    widest = np.zeros(k)
    for r in placed.groupBy("cluster").agg(F.max("angle").alias("w")).collect():  # one row per cluster
        widest[r["cluster"]] = r["w"] + SLACK

    def bounds(x: np.ndarray) -> np.ndarray:
        return _norms(x)[:, None] * np.cos(np.clip(_angles(x, centres) - widest[None, :], 0.0, np.pi))

    top = np.sort(bounds(some(rows)), axis=0)[::-1]
    cuts, share = [], FIRST_RANGE / max(n, 1)
    while share < 1:
        cuts.append(top[min(int(share * len(top)), len(top) - 1)])
        share *= 8
    cuts = [np.full(k, np.inf), *cuts, np.full(k, -np.inf)]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        made = []
        for lo in range(0, len(pdf), BLOCK):  # blocks by hash are near BLOCK in size, but never above it
            some_ = pdf.iloc[lo : lo + BLOCK]
            block = Block(some_["id"].to_numpy(), some_["label"].to_numpy(), _stack(some_["vec"], dim), p, q)
            made.append((int(pdf["cluster"].iloc[0]), int(pdf["block"].iloc[0]) + lo // BLOCK * (1 << 20), pickle.dumps(block)))
        return pd.DataFrame(made, columns=["cluster", "block", "packed"])

    dealt = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    state = materialise(dealt.groupBy("cluster", "block").applyInPandas(pack, PACKED), "blocks")
    for mining in (False, True):
        for hi, lo in zip(cuts[:-1], cuts[1:], strict=True):
            was, state = state, _round(rows, state, dim, bounds, hi, lo, mining, low, high)
            if state is was:
                break
            release(was)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("packed").to_pylist():
                b = pickle.loads(data)
                i, j, r = np.nonzero(b.neg != NONE)
                cols = [b.ids[i], b.pos_id[i, j], (r + 1).astype(np.int32), b.neg_id[i, j, r], b.pos[i, j], b.neg[i, j, r]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return state.mapInArrow(told, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _round(rows: DataFrame, state: DataFrame, dim: int, bounds, hi: np.ndarray, lo: np.ndarray, mining: bool, low: int, high: int) -> DataFrame:
    """The state after the rows with bounds in [lo, hi) of every list; the very state if no member has to go on."""

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            going = [bool(pickle.loads(data).on_the_way(hi[c], mining, low, high).any()) for c, data in zip(batch.column("cluster").to_pylist(), batch.column("packed").to_pylist(), strict=True)]
            yield batch.filter(pa.array(going, pa.bool_()))

    going = materialise(state.mapInArrow(open_, PACKED), "open-blocks")
    wanted = [r["cluster"] for r in going.select("cluster").distinct().orderBy("cluster").collect()]  # at most MOST_CLUSTERS
    if not wanted:
        release(going)
        return state

    deals = max(LEAST_DEALT, rows.count() // (CHUNK * PER_TASK))
    batches_ = max(1, going.filter(F.col("cluster").isin(wanted)).groupBy("cluster").count().agg(F.max("count")).first()[0] // PER_TASK)

    def list_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            x = batch.column("vec").values.to_numpy().reshape(-1, dim) if batch.num_rows else np.zeros((0, dim))
            bound, out = bounds(x), []
            for c in wanted:
                at = np.flatnonzero((bound[:, c] >= lo[c]) & (bound[:, c] < hi[c]))
                at = at[np.argsort(-bound[at, c], kind="stable")]
                for first in range(0, len(at), CHUNK):
                    part = at[first : first + CHUNK]
                    most = float(bound[part[0], c])
                    part = part[np.argsort(ids[part])]
                    out.append((c, int(mix(ids[part[:1]].astype(np.uint64))[0] % np.uint64(deals)), most, pickle.dumps((ids[part], labels[part], _narrow(x[part])))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.binary()))], ["cluster", "deal", "most", "rows"])

    chunks = rows.select("id", "label", "vec").mapInArrow(list_rows, "cluster int, deal int, most double, rows binary")
    key = ["cluster", "deal", "batch"]
    left = going.withColumn("batch", F.pmod(F.col("block"), F.lit(batches_))).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    right = chunks.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches_ - 1))))

    def walk(members: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(listed):
            return pd.DataFrame({"cluster": [], "block": [], "packed": []})
        known = [pickle.loads(data) for data in members["packed"]]
        found = [b.fresh(mining) for b in known]
        for most, data in listed.sort_values("most", ascending=False)[["most", "rows"]].itertuples(index=False):
            going_on = [(b, f) for b, f in zip(known, found, strict=True) if (b.on_the_way(most, mining, low, high) & f.on_the_way(most, mining, low, high)).any()]
            if not going_on:
                break
            ids, labels, y = pickle.loads(data)
            for _, f in going_on:
                f.meet(ids, labels, y.astype(np.float64), mining, low, high)
        return pd.DataFrame({"cluster": members["cluster"], "block": members["block"], "packed": [pickle.dumps(f) for f in found]})

    partial = left.select(*key, "block", "packed").groupBy(*key).cogroup(right.select(*key, "most", "rows").groupBy(*key)).applyInPandas(walk, PACKED)

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pickle.loads(pdf["packed"].iloc[0])
        for data in pdf["packed"].iloc[1:]:
            first.join(pickle.loads(data))
        return pd.DataFrame({"cluster": pdf["cluster"].iloc[:1], "block": pdf["block"].iloc[:1], "packed": [pickle.dumps(first)]})

    after = materialise(state.unionByName(partial).groupBy("cluster", "block").applyInPandas(unite, PACKED), "blocks")
    release(going)
    return after


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)
