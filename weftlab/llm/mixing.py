"""Soft-membership mixing: document rates whose expected domain token totals match target weights.

A softmax regression fitted on labelled rows (a table id, domain) gives every document posteriors over the domains, from the shape
of its text and the presence of the words that tell domains apart best. Rates r >= 0 then minimise the squared
deviations of the expected domain totals sum_d r_d tokens_d P(k|d) from the target totals, relative to the targets, by projected gradient
steps in the metric of tokens: each step is one distributed sum over the documents. Steps carry momentum, which starts anew whenever it points
uphill. A document's rate depends only on its posteriors and the few totals of the steps, so rates need no join back.

Tokens are words. The classifier is fitted from at most `MAX_ROWS` labelled rows, a sample by hash of their ids.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlab.llm.batches import add_columns
from weftlab.llm.text_features import NAMES, features
from weftlab.llm.words import slices, word_hashes
from weftlab.session import materialise, release

MAX_ROWS = 6000
TELLING = 64
#: Least chi-square of a telling word: beyond what chance gives among a million words.
LEAST_CHI = 30.0


class NoLabels(ValueError):
    """No document has a label."""


@dataclass
class Domains:
    """Softmax regression: names, telling words (sorted hashes), scaling of the inputs, weights (last row: intercept)."""

    names: list[str]
    words: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(P(domain | text) per row, number of words)."""
        x, n = inputs(texts, self.words)
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), n


def inputs(texts: list[str | None], telling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text shape features followed by the presence of each telling word; and the number of words."""
    seen, n = np.zeros((len(texts), len(telling))), np.zeros(len(texts), np.int64)
    for first, last, joined, starts in slices(texts):
        words, ptr, _, _ = word_hashes(joined, starts)
        n[first:last] = np.diff(ptr)
        if len(telling):
            at = np.minimum(np.searchsorted(telling, words), len(telling) - 1)
            hit = telling[at] == words
            seen[first + np.repeat(np.arange(last - first), np.diff(ptr))[hit], at[hit]] = 1
    return np.c_[features(texts), seen], n


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", max_rows: int = MAX_ROWS, telling: int = TELLING) -> Domains:
    """Fit on labelled (id, domain) rows; null domains are skipped. NoLabels is raised if no document has a label."""
    chosen = labelled.filter(F.col(domain_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(domain_col).alias("domain"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "domain").limit(max_rows)
    docs = docs.select(id_col, text_col)
    rows = materialise(docs.join(F.broadcast(chosen), docs[id_col] == F.col("__id")).select(F.col("__id").alias("id"), "domain", F.col(text_col).alias("text")), "labelled")
    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    names, total = sorted(sizes), sum(sizes.values())
    if not names:
        raise NoLabels("no labelled documents")

    def distinct_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, _, joined, starts in slices(pdf["text"].tolist()):
                words, ptr, _, _ = word_hashes(joined, starts)
                for k, (a, b) in enumerate(zip(ptr[:-1], ptr[1:], strict=True)):
                    yield pd.DataFrame({"domain": pdf["domain"].iat[first + k], "word": np.unique(words[a:b]).view(np.int64)})

    counts = rows.mapInPandas(distinct_words, "domain string, word long").groupBy("word", "domain").agg(F.count("*").cast("double").alias("n"))
    of = F.create_map(*[F.lit(x) for name in names for x in (name, float(sizes[name]))])
    wide = counts.join(counts.groupBy("word").agg(F.sum("n").alias("all")).filter((F.col("all") >= 5) & (F.col("all") < total)), "word").withColumn("of", of[F.col("domain")])
    excess = F.col("n") * total - F.col("all") * F.col("of")
    chi = excess * excess * total / (F.col("all") * F.col("of") * (total - F.col("all")) * F.greatest(total - F.col("of"), F.lit(0.5)))
    best = wide.filter(excess > 0).withColumn("chi", chi).filter(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "word").limit(telling * len(names)).select("word").collect()  # bounded by telling
    words = np.unique(np.array([r["word"] for r in best], np.int64).view(np.uint64))
    columns = [*NAMES, *(f"w{i}" for i in range(len(words)))]

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, _ = inputs(pdf["text"].tolist(), words)
            yield pd.DataFrame({"id": pdf["id"], "domain": pdf["domain"], "x": list(x)})

    got = rows.mapInPandas(described, "id long, domain string, x array<double>").toPandas().sort_values(["id", "domain"])
    x = np.array(got["x"].tolist()).reshape(-1, len(columns))
    return _softmax(x, np.searchsorted(names, got["domain"].to_numpy()), names, words)


def _softmax(x: np.ndarray, y: np.ndarray, names: list[str], words: np.ndarray, steps: int = 400, rate: float = 0.3, decay: float = 1e-3) -> Domains:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    scale = np.maximum(scale, np.where(np.arange(x.shape[1]) >= len(NAMES), 0.02, 0))
    z, gold = np.c_[(x - mean) / scale, np.ones(len(x))], np.eye(len(names))[y]
    w = np.zeros((z.shape[1], len(names)))
    s = np.full_like(w, 1e-8)
    for _ in range(steps):
        p = np.exp((q := z @ w) - q.max(axis=1, keepdims=True))
        g = z.T @ (p / p.sum(axis=1, keepdims=True) - gold) / len(z) + decay * w
        s += g * g
        w -= rate * g / np.sqrt(s)
    return Domains(names, words, mean, scale, w)


@dataclass
class Rates:
    """The gradient steps: rates of posteriors are replayed from them. fixed: the domain whose likeliest documents keep the first rate.
    Each step is a gradient of the domains' totals and the momentum after it. reached: every total is close to its target; settled: no step moves
    the rates any more, reached or not."""

    low: float
    high: float
    fixed: int | None = None
    steps: list[tuple[list[float], float]] = field(default_factory=list)
    totals: list[float] = field(default_factory=list)
    targets: list[float] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    reached: bool = True
    settled: bool = False

    @property
    def first(self) -> float:
        return float(min(max(1.0, self.low), self.high))

    def move(self, p: np.ndarray, r: np.ndarray, ahead: np.ndarray, steps: list[tuple[list[float], float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rates and the points ahead of them after steps, then the rates and points before the last step."""
        r_was, ahead_was = r, ahead
        held = np.zeros(len(p), bool) if self.fixed is None else p[:, self.fixed] >= p.max(axis=1, initial=0.0)
        for g, momentum in steps:
            r_was, ahead_was = r, ahead
            r = np.where(held, r, np.clip(ahead - p @ np.array(g), self.low, self.high))
            ahead = r + momentum * (r - r_was)
        return r, ahead, r_was, ahead_was

    def of(self, p: np.ndarray) -> np.ndarray:
        begin = np.full(len(p), self.first)
        return self.move(p, begin, begin, self.steps)[0]


def _posteriors(b: pa.RecordBatch, column: str, k: int) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def with_posteriors(docs: DataFrame, model: Domains, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, p) for every row; null and empty texts have 0 tokens."""

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        p, n = model.posteriors(b.column("text").to_pylist())
        return {"tokens": pa.array(n, pa.int64()), "p": pa.array(p.tolist(), pa.list_(pa.float64()))}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return add_columns(rows, ["text"], "tokens long, p array<double>", run)


def fit_rates(scored: DataFrame, weights: dict[str, float], names: list[str], low: float = 0.0, high: float = float("inf"), total: float | None = None, whole: str | None = None, most_steps: int = 1000, close: float = 1e-3, refresh: int = 25) -> Rates:
    """Projected gradient steps over scored (tokens, p) until every domain total is within `close` of its target, or no step moves the rates.

    weights: target share per domain, renormalised over the domains that have tokens. total: target sum of tokens; by default the present
    sum, or with high = 1 the largest total that needs no rate above 1. whole: the domain whose present tokens all stay: it sets the total
    (if it has tokens and a weight), the target of any other domain is at most its present tokens, and documents that are likeliest of
    it keep the rate 1, whatever their other memberships. Rates are held within [low, high]. Domains with a weight but no tokens are
    named in `dropped` of the result and warned of, and so are targets that are not reached: either the rates settled, as no
    rates allowed reach them all (the result is then the nearest in least squares), or `most_steps` were not enough.
    """
    k = len(names)
    at = lambda i: F.element_at("p", i + 1)
    tok = F.col("tokens").cast("double")
    sums = scored.agg(F.sum(tok).alias("all"), *[F.sum(tok * at(i)).alias(f"s{i}") for i in range(k)], *[F.sum(tok * at(i) * at(j)).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]).first()
    now, tokens = np.array([sums[f"s{i}"] or 0.0 for i in range(k)]), sums["all"] or 0.0
    share = np.array([max(0.0, weights.get(n, 0.0)) for n in names]) * (now > 0)
    whole_at = names.index(whole) if whole in names and share[names.index(whole)] > 0 else None
    out = Rates(low, high, whole_at)
    out.dropped = sorted(d for d, w in weights.items() if w > 0 and (d not in names or now[names.index(d)] <= 0))
    if out.dropped:
        warnings.warn(f"no tokens for the targets of {', '.join(out.dropped)}: the other weights are scaled up", stacklevel=2)
    if not share.sum():
        return out
    share /= share.sum()
    if total is None and whole_at is not None:
        total = now[whole_at] / share[whole_at]
    elif total is None:
        total = min(now[i] / share[i] for i in range(k) if share[i] > 0) if high <= 1 else now.sum()
    goal = np.maximum(share * total if whole_at is None else np.minimum(share * total, now), 1e-9 * now.sum())
    gram = np.array([[(sums[f"g{i}_{j}"] or 0.0) / np.sqrt(goal[i] * goal[j]) for j in range(k)] for i in range(k)])
    step = 1 / np.linalg.eigvalsh(gram).max()
    wanted = share > 0
    near = lambda t: bool((np.abs(t - goal)[wanted] <= close * goal[wanted]).all())
    state = scored.select("tokens", "p", F.lit(out.first).alias("r"), F.lit(out.first).alias("ahead"))
    fresh = 0  # steps that state already holds
    now = now * out.first
    ahead, speed, out.reached = now, 1.0, near(now)
    while not (out.reached or out.settled or len(out.steps) >= most_steps):
        if len(out.steps) - fresh >= refresh:
            was, state, fresh = state, materialise(_stepped(state, out, fresh), "rates"), len(out.steps)
            release(was)
        after = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        out.steps.append(((step * (ahead - goal) / goal).tolist(), float((speed - 1) / after)))
        got = _step_sums(state, out, fresh, k)
        now, speed = got[:k], after
        if got[2 * k] > 0:  # uphill: go on from the rates themselves
            out.steps[-1], ahead, speed = (out.steps[-1][0], 0.0), now, 1.0
        else:
            ahead = got[k : 2 * k]
        out.reached, out.settled = near(now), bool(got[2 * k + 1] <= 1e-7 * tokens)
    out.totals, out.targets = now.tolist(), goal.tolist()
    if not out.reached:
        named = ", ".join(f"{n} {t:.0f} for {w:.0f}" for n, t, w, s in zip(names, now, goal, wanted, strict=True) if s)
        warnings.warn(f"{'rates settled off their targets' if out.settled else f'targets not reached in {most_steps} steps'}: {named}", stacklevel=2)
    return out


def _stepped(state: DataFrame, rates: Rates, fresh: int) -> DataFrame:
    """state (tokens, p, r, ahead) after the steps from number `fresh` on."""
    steps = rates.steps[fresh:]

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        p = _posteriors(b, "p", len(steps[0][0]))
        r, ahead, _, _ = rates.move(p, b.column("r0").to_numpy(), b.column("ahead0").to_numpy(), steps)
        return {"r": pa.array(r), "ahead": pa.array(ahead)}

    return add_columns(state.withColumnsRenamed({"r": "r0", "ahead": "ahead0"}), [], "r double, ahead double", run).drop("r0", "ahead0")


def _step_sums(state: DataFrame, rates: Rates, fresh: int, k: int) -> np.ndarray:
    """After the last step: domain totals of the rates and of the points ahead; the momentum test; tokens moved by the step itself."""
    steps, names = rates.steps[fresh:], [f"s{i}" for i in range(2 * k + 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * k + 2)
        for b in batches:
            p, t = _posteriors(b, "p", k), b.column("tokens").to_numpy().astype(np.float64)
            r, ahead, r_was, ahead_was = rates.move(p, b.column("r").to_numpy(), b.column("ahead").to_numpy(), steps)
            held = r == r_was if rates.fixed is None else (p[:, rates.fixed] >= p.max(axis=1, initial=0.0)) | (r == r_was)
            sums += np.r_[(t * r) @ p, (t * ahead) @ p, (t * (ahead_was - r)) @ np.where(held, 0.0, r - r_was), t @ np.abs(r - ahead_was)]
        yield pa.RecordBatch.from_arrays([pa.array([s]) for s in sums], names)

    found = state.mapInArrow(run, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n).alias(n) for n in names]).first()
    return np.array([found[n] or 0.0 for n in names])


def _trained(docs: DataFrame, labelled: DataFrame, names: list[str], id_col: str, text_col: str) -> Domains:
    """The fitted classifier; without labelled documents one that gives even memberships in the domains `names`."""
    try:
        return train(docs, labelled, id_col, text_col)
    except NoLabels:
        k = len(NAMES)
        return Domains(names, np.zeros(0, np.uint64), np.zeros(k), np.ones(k), np.zeros((k + 1, len(names))))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, rate, p_<domain>...) for every row of docs. Rows that share an id each have a rate of their own.

    Null and empty texts have no tokens and get the rate of their posteriors like others. If no document has a label, memberships in the
    domains of `weights` are even. An empty table gives an empty result.
    """
    model = _trained(docs, labelled, sorted(weights), id_col, text_col)
    scored = materialise(with_posteriors(docs, model, id_col, text_col), "posteriors")
    rates = fit_rates(scored, weights, model.names)

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"rate": pa.array(rates.of(_posteriors(b, "p", len(model.names))), pa.float64())}

    done = add_columns(scored, [], "rate double", run)
    return done.select("doc_id", "tokens", "rate", *[F.element_at("p", i + 1).alias(f"p_{n}") for i, n in enumerate(model.names)])


def resample(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], high: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs repeated floor(rate + u) times, u uniform by a hash of the text; columns as in docs.

    With high = 1 no row is repeated, and the domain of the largest weight is kept whole: its tokens set the total, documents
    likeliest of it keep the rate 1, and a domain under its share keeps what it has. An empty table passes through, and so do all rows
    if none has a label. Repeated rows share their fate; null and empty texts are judged by their posteriors like others. Texts are scored once:
    documents are written with their posteriors, and the steps read the latter alone.
    """
    model = _trained(docs, labelled, [], id_col, text_col)
    if not model.names:
        return docs
    whole = max(sorted(weights), key=weights.get) if high <= 1 else None
    columns = docs.columns
    tokens, p = (next(n for n in (base + "_" * i for i in range(len(columns) + 1)) if n.lower() not in {c.lower() for c in columns}) for base in ("tokens", "p"))

    def score(b: pa.RecordBatch) -> dict[str, pa.Array]:
        found, n = model.posteriors(b.column(text_col).to_pylist())
        return {tokens: pa.array(n, pa.int64()), p: pa.array(found.tolist(), pa.list_(pa.float64()))}

    scored = materialise(add_columns(docs, [], f"`{tokens}` long, `{p}` array<double>", score), "scored")
    rates = fit_rates(scored.select(F.col(tokens).alias("tokens"), F.col(p).alias("p")), weights, model.names, high=high, whole=whole)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = np.array([zlib.crc32((t or "").encode("utf-8", "replace")) for t in b.column(text_col).to_pylist()]) / 2**32
            copies = np.floor(rates.of(_posteriors(b, p, len(model.names))) + u).astype(np.int64)
            yield b.select(columns).take(pa.array(np.repeat(np.arange(b.num_rows), copies), pa.int64()))

    return scored.mapInArrow(each, docs.schema)
