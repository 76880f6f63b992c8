"""Queries of rank overlap, pairs, module inference, biclusters, merging and null distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlab.functions.stats import tail_sql
from weftlab.operators import bicluster, jobs, merge, modules, network, nulls, pairs, prepare, rankoverlap, sampler, sets
from weftlab.plans import fixtures as fx
from weftlab.session import materialise, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in cols})  # no negative zeros


N = fx.N
RANKED = f"{fx.EXPRS}, {fx.EDGES}, ranked AS (SELECT gene, sample, value, CAST(row_number() OVER (PARTITION BY gene ORDER BY value DESC, sample) - 1 AS INTEGER) AS rnk FROM exprs)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.canonical_edges(fx.vector_edges(spark, sf_dir))


@query(f"WITH {RANKED} SELECT gene, sample, rnk FROM ranked")
def rank_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankoverlap.rank_samples(fx.exprs(spark, sf_dir)).select("gene", "sample", "rnk")


THRESHOLDS = f"""cells AS (SELECT 32 - a.i AS tu, 32 - b.i AS tw FROM range(0, 32) a(i), range(0, 32) b(i)),
tails AS (SELECT tu, tw, x, {tail_sql('x', 'tu', 'tw', str(N))} < 0.01 AS ok FROM (SELECT tu, tw, unnest(range(0, least(tu, tw) + 1)) AS x FROM cells)),
thresholds AS (SELECT tu, tw, coalesce(min(x) FILTER (WHERE run), {N}) AS min_overlap FROM (SELECT tu, tw, x, bool_and(ok) OVER (PARTITION BY tu, tw ORDER BY x DESC) AS run FROM tails) GROUP BY tu, tw)"""


@query(f"WITH n AS (SELECT max(len(embedding)) AS n FROM embeddings), {THRESHOLDS} SELECT CAST(tu AS INTEGER) AS tu, CAST(tw AS INTEGER) AS tw, CAST(min_overlap AS INTEGER) AS min_overlap FROM thresholds, n")
def overlap_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    return rankoverlap.overlap_thresholds(spark, n, 1, 0.01)


@query(f"WITH {RANKED} SELECT g1, g2, a.sample, a.rnk AS r1, round(a.value, 6) AS v1, b.rnk AS r2, round(b.value, 6) AS v2 FROM edges JOIN ranked a ON a.gene = g1 JOIN ranked b ON b.gene = g2 AND b.sample = a.sample WHERE a.rnk < 32 AND b.rnk < 32")
def edge_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rankoverlap.rank_samples(fx.exprs(spark, sf_dir))
    return rounded(rankoverlap.edge_profiles(_edges(spark, sf_dir), ranked, N // 2), "v1", "v2")


@query(f"WITH {RANKED}, o AS (SELECT g1, g2, count(b.sample) AS overlap FROM edges LEFT JOIN ranked a ON a.gene = g1 AND a.rnk < 20 LEFT JOIN ranked b ON b.gene = g2 AND b.sample = a.sample AND b.rnk < 16 GROUP BY g1, g2) SELECT g1, g2, overlap, round({tail_sql('overlap', '20', '16', str(N))}, 6) AS p, round(overlap / 5.0, 6) AS enrichment FROM o")
def top_overlap_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rankoverlap.rank_samples(fx.exprs(spark, sf_dir))
    return rounded(rankoverlap.top_overlap_test(_edges(spark, sf_dir), ranked, N, 20, 16), "p", "enrichment")


def grid_sql(step: int) -> str:
    k = len(rankoverlap.cutoffs(N, step))
    c = lambda r: f"least((31 - {r}.rnk) // {step}, {k - 1})"
    return f"""cut AS (SELECT i AS c, 32 - i * {step} AS t FROM range(0, {k}) r(i)),
low AS (SELECT g1, g2, {c('a')} AS c1, {c('b')} AS c2, a.value AS v1, b.value AS v2 FROM edges JOIN ranked a ON a.gene = g1 AND a.rnk < 32 JOIN ranked b ON b.gene = g2 AND b.sample = a.sample AND b.rnk < 32),
grid AS (SELECT g1, g2, x.c AS c1, y.c AS c2, x.t AS tu, y.t AS tw, count(*) FILTER (WHERE w) AS n, coalesce(sum(v1) FILTER (WHERE w), 0) AS s1, coalesce(sum(v1 * v1) FILTER (WHERE w), 0) AS ss1, coalesce(sum(v2) FILTER (WHERE w), 0) AS s2, coalesce(sum(v2 * v2) FILTER (WHERE w), 0) AS ss2
 FROM (SELECT *, l.c1 >= x.c AND l.c2 >= y.c AS w FROM low l, cut x, cut y) q(g1, g2, c1_, c2_, v1, v2, xc, xt, yc, yt, w), cut x, cut y WHERE x.c = xc AND y.c = yc GROUP BY ALL),
sums AS (SELECT gene, count(*) AS n, sum(value) AS s, sum(value * value) AS ss FROM exprs GROUP BY gene)"""


def std_sql(n: str, s: str, ss: str) -> str:
    return f"sqrt(greatest({ss} / nullif({n}, 0) - ({s} / nullif({n}, 0)) ** 2, 0))"


def snr_sql(n1: str, s1: str, ss1: str, n: str, s: str, ss: str) -> str:
    rest = (f"({n} - {n1})", f"({s} - {s1})", f"({ss} - {ss1})")
    return f"abs({s1} / nullif({n1}, 0) - {rest[1]} / nullif({rest[0]}, 0)) / nullif({std_sql(n1, s1, ss1)} + {std_sql(*rest)}, 0)"


SNRS = f"snrs AS (SELECT g.*, ({snr_sql('g.n', 's1', 'ss1', 'p.n', 'p.s', 'p.ss')} + {snr_sql('g.n', 's2', 'ss2', 'q.n', 'q.s', 'q.ss')}) / 2 AS snr FROM grid g JOIN sums p ON p.gene = g1 JOIN sums q ON q.gene = g2)"


@query(f"WITH {RANKED}, {grid_sql(4)} SELECT g1, g2, CAST(c1 AS INTEGER) AS c1, CAST(c2 AS INTEGER) AS c2, n, round(s1, 6) AS s1, round(ss1, 6) AS ss1, round(s2, 6) AS s2, round(ss2, 6) AS ss2 FROM grid")
def overlap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = rankoverlap.overlap_grid(_edges(spark, sf_dir), rankoverlap.rank_samples(fx.exprs(spark, sf_dir)), N, 4)
    return rounded(grid.drop("tu", "tw"), "s1", "ss1", "s2", "ss2")


@query(f"WITH {RANKED}, {grid_sql(4)}, {SNRS} SELECT g1, g2, CAST(tu AS INTEGER) AS tu, CAST(tw AS INTEGER) AS tw, n, round(snr, 5) AS snr FROM snrs")
def corner_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.exprs(spark, sf_dir)
    grid = rankoverlap.overlap_grid(_edges(spark, sf_dir), rankoverlap.rank_samples(m), N, 4)
    return rankoverlap.corner_snr(grid, prepare.gene_power_sums(m)).select("g1", "g2", "tu", "tw", "n", F.round("snr", 5).alias("snr"))


BEST = f"""{grid_sql(1)}, {SNRS}, {THRESHOLDS},
cell AS (SELECT s.*, min_overlap, c1 + c2 AS diag, s.n > min_overlap AND snr >= 0.2 AS hit FROM snrs s JOIN thresholds USING (tu, tw)),
stops AS (SELECT *, least(coalesce(min(diag) FILTER (WHERE hit OR n <= 10) OVER (PARTITION BY g1, g2), 31), 31) AS stop FROM cell),
best AS (SELECT g1, g2, tu, tw, n, snr FROM (SELECT *, row_number() OVER (PARTITION BY g1, g2 ORDER BY n DESC, abs(tu - tw), c1) AS nth FROM stops WHERE hit AND diag <= stop) WHERE nth = 1)"""


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rankoverlap.rank_samples(fx.exprs(spark, sf_dir))
    return rankoverlap.best_corner(_edges(spark, sf_dir), ranked, N, 1, rankoverlap.overlap_thresholds(spark, N, 1, 0.01), 10, 0.2)


@query(f"WITH {RANKED}, {BEST} SELECT g1, g2, CAST(tu AS INTEGER) AS tu, CAST(tw AS INTEGER) AS tw, n, round(snr, 5) AS snr FROM best")
def best_corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).withColumn("snr", F.round("snr", 5))


@query(f"WITH RECURSIVE {RANKED}, {BEST}, rows_ AS (SELECT e.g1, e.g2, a.sample FROM best e JOIN ranked a ON a.gene = g1 AND a.rnk < tu JOIN ranked b ON b.gene = g2 AND b.sample = a.sample AND b.rnk < tw WHERE n >= 10), kept AS (SELECT DISTINCT g1, g2 FROM rows_), und AS (SELECT g1, g2 FROM kept UNION ALL SELECT g2, g1 FROM kept), reach(a, b) AS (SELECT g1, g2 FROM und UNION SELECT r.a, u.g2 FROM reach r JOIN und u ON r.b = u.g1), big AS (SELECT a FROM reach GROUP BY a HAVING count(DISTINCT b) >= 2) SELECT g1, g2, sample FROM rows_ WHERE g1 IN (SELECT a FROM big)")
def assign_samples_to_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankoverlap.assign_samples_to_edges(_edges(spark, sf_dir), fx.exprs(spark, sf_dir), min_snr=0.2, k=2)


@query()
def snr_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, edges = fx.exprs(spark, sf_dir), materialise(rankoverlap.threshold_edges(fx.edge_ids(_edges(spark, sf_dir))), "edges")
    members = network.incidence(edges, "eid").withColumnRenamed("eid", "id")
    found = bicluster.optimal_sample_set(members, m, members.select("id").distinct().withColumn("direction", F.lit("UP")), N)
    score = bicluster.bicluster_snr(members, found, m).withColumnRenamed("id", "eid")
    return rankoverlap.snr_threshold(edges.join(score, "eid", "left"), "avgSNR", q=0.1)


TOPS = f"{RANKED}, es AS (SELECT g1 * 1000003 + g2 AS eid, g1, g2, a.sample FROM edges JOIN ranked a ON a.gene = g1 AND a.rnk < 20 JOIN ranked b ON b.gene = g2 AND b.sample = a.sample AND b.rnk < 20), ed AS (SELECT g1, g2, g1 * 1000003 + g2 AS eid FROM edges)"
STATE = "st AS (SELECT eid, 1000003 * (g1 // 7) + g2 % 2 AS module FROM ed)"


def _tops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, samples of edges, a state by an arithmetic rule)."""
    edges = fx.edge_ids(_edges(spark, sf_dir))
    ranked = rankoverlap.rank_samples(fx.exprs(spark, sf_dir))
    samples = rankoverlap.edge_profiles(edges, ranked, 20).join(edges, ["g1", "g2"]).select("eid", "g1", "g2", "sample")
    state = edges.select("eid", (F.floor(F.col("g1") / 7) * 1000003 + F.col("g2") % 2).alias("module"))
    return edges, samples, state


@query(f"WITH {TOPS}, s AS (SELECT g1, g2, count(*) AS n FROM es GROUP BY 1, 2) SELECT CASE WHEN n >= 20 THEN 11 ELSE n // 2 + 1 END AS bin, count(*) AS n_edges FROM s GROUP BY 1")
def edge_sample_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankoverlap.edge_sample_distribution(_tops(spark, sf_dir)[1], 10, 20)


# pairs of biclusters

SETS = f"{fx.bic_genes_sql('ga')}, {fx.bic_samples_sql('sa', 'ga')}, {fx.bic_genes_sql('gb', 20, 7)}, {fx.bic_samples_sql('sb', 'gb', 7)}"


def _set_a(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fx.bic_genes(spark, sf_dir), fx.bic_samples(spark, sf_dir)


def _set_b(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fx.bic_genes(spark, sf_dir, 20, 7), fx.bic_samples(spark, sf_dir, 20, 7)


def _bics(genes: DataFrame) -> DataFrame:
    return fx.directions(genes.select("id").distinct())


#: As SETS, with twins: biclusters whose ids leave one remainder by 12 hold the same samples, so they overlap significantly.
TWINS = f"{fx.bic_genes_sql('ga')}, {fx.bic_samples_sql('sa', 'ga', twin=12)}"


def _twins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fx.bic_genes(spark, sf_dir), fx.bic_samples(spark, sf_dir, twin=12)


def _pairs_sql(sets_: str) -> str:
    return f"""{sets_}, sz AS (SELECT id, {fx.DIRECTION} AS d, count(*) AS n FROM sa GROUP BY id),
pr AS (SELECT x.id AS i, y.id AS j, x.n AS n1, CASE WHEN x.d = y.d THEN y.n ELSE {N} - y.n END AS n2, (SELECT count(*) FROM sa p JOIN sa q ON p.sample = q.sample WHERE p.id = x.id AND q.id = y.id) AS it, x.d = y.d AS same FROM sz x JOIN sz y ON x.id < y.id),
pv AS (SELECT i, j, n1, n2, CASE WHEN same THEN it ELSE n1 - it END AS shared FROM pr),
pp AS (SELECT i, j, shared, n1 - shared AS only_1, n2 - shared AS only_2, {tail_sql('shared', 'n1', 'n2', str(N))} AS p, shared / (n1 + n2 - shared) AS jac FROM pv)"""


PAIRS = _pairs_sql(SETS)


@query(f"WITH {PAIRS} SELECT i, j, shared, only_1, only_2, round(p, 6) AS p, round(jac, 6) AS jac FROM pp")
def bicluster_pair_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes, samples = _set_a(spark, sf_dir)
    return rounded(pairs.bicluster_pair_overlap(_bics(genes), samples, N), "p", "jac")


@query(f"WITH {_pairs_sql(TWINS)} SELECT i, j, shared, round(p, 6) AS p FROM pp WHERE p * (SELECT count(*) FROM sz) < 0.05")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes, samples = _twins(spark, sf_dir)
    found = pairs.bicluster_pair_overlap(_bics(genes), samples, N)
    return rounded(pairs.merge_candidates(found, 25).select("i", "j", "shared", "p"), "p")


@query(f"WITH {SETS}, na AS (SELECT id, count(*) AS n FROM ga GROUP BY 1), nb AS (SELECT id, count(*) AS n FROM gb GROUP BY 1), sh AS (SELECT a.id AS i, b.id AS j, count(*) AS shared FROM ga a JOIN gb b USING (gene) GROUP BY 1, 2), t AS (SELECT count(*) AS n FROM embeddings) SELECT i, j, shared, round({tail_sql('shared', 'na.n', 'nb.n', 't.n')}, 6) AS p FROM sh JOIN na ON na.id = i JOIN nb ON nb.id = j, t")
def gene_overlap_pval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.gene_overlap_pval(_set_a(spark, sf_dir)[0], _set_b(spark, sf_dir)[0], table(spark, sf_dir, "embeddings").count()), "p")


# module inference


@query(f"WITH {TOPS} SELECT ed.eid, ed.eid AS module, round(count(es.sample) / 64.0, 6) AS share FROM ed LEFT JOIN es ON es.eid = ed.eid GROUP BY ed.eid")
def initial_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, samples, _ = _tops(spark, sf_dir)
    return rounded(modules.initial_state(edges, samples, N), "share")


@query(f"WITH {TOPS}, {STATE} SELECT module, sample, count(*) AS ones, (SELECT count(*) FROM st t WHERE t.module = st.module) AS m FROM es JOIN st USING (eid) GROUP BY module, sample")
def module_sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, samples, state = _tops(spark, sf_dir)
    return modules.module_sample_counts(state, samples)


INC = "inc AS (SELECT g1 AS gene, eid FROM ed UNION ALL SELECT g2, eid FROM ed), cand AS (SELECT DISTINCT a.eid, unnest([st.module, b.eid]) AS module FROM inc a JOIN inc b USING (gene) JOIN st ON st.eid = b.eid)"


@query(f"WITH {TOPS}, {STATE}, {INC} SELECT DISTINCT eid, module FROM cand")
def edge_candidate_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, state = _tops(spark, sf_dir)
    return modules.edge_candidate_modules(edges, state)


LOGLIK = f"""{TOPS}, {STATE}, {INC}, cm AS (SELECT DISTINCT eid, module FROM cand), home AS (SELECT cm.*, st.module = cm.module AS own FROM cm JOIN st USING (eid)),
sz AS (SELECT module, count(*) AS m FROM st GROUP BY 1), cn AS (SELECT module, sample, count(*) AS ones FROM es JOIN st USING (eid) GROUP BY 1, 2),
cells AS (SELECT h.eid, h.module, s.sample, coalesce(sz.m, 0) - CAST(own AS INTEGER) AS m, (es.eid IS NOT NULL) AS x, coalesce(ones, 0) - CASE WHEN own AND es.eid IS NOT NULL THEN 1 ELSE 0 END AS n
 FROM home h CROSS JOIN (SELECT unnest(range(0, {N})) AS sample) s LEFT JOIN sz ON sz.module = h.module LEFT JOIN es ON es.eid = h.eid AND es.sample = s.sample LEFT JOIN cn ON cn.module = h.module AND cn.sample = s.sample),
lps AS (SELECT eid, module, CASE WHEN any_value(m) <= 0 THEN {N} * ln(0.5) + ln(1.0) WHEN any_value(m) = 1 THEN sum(CASE WHEN x THEN n ELSE 0 END) * ln(1.25 / 0.5) + ({N} - sum(CASE WHEN x THEN n ELSE 0 END)) * ln(0.5) + ln(2.0)
 ELSE sum(CASE WHEN m > 1 THEN CASE WHEN x THEN ln((n + 0.25) / (m + 0.5)) ELSE ln((m - n + 0.25) / (m + 0.5)) END END) + ln(any_value(m) + 1.0) END AS lp FROM cells GROUP BY 1, 2)"""


@query(f"WITH {LOGLIK} SELECT eid, module, round(lp, 5) AS lp FROM lps")
def edge_module_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, samples, state = _tops(spark, sf_dir)
    state = materialise(state, "state")
    rows = modules.edge_module_loglik(modules.edge_candidate_modules(edges, state), state, samples, N)
    return rows.withColumn("lp", F.round("lp", 5))


@query(f"WITH {LOGLIK}, e AS (SELECT eid, module, CASE WHEN lp - max(lp) OVER (PARTITION BY eid) < -7 THEN 0.0 ELSE exp(lp - max(lp) OVER (PARTITION BY eid)) END AS e FROM lps) SELECT eid, module, round(e / sum(e) OVER (PARTITION BY eid), 5) AS p FROM e")
def move_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, samples, state = _tops(spark, sf_dir)
    state = materialise(state, "state")
    rows = modules.edge_module_loglik(modules.edge_candidate_modules(edges, state), state, samples, N)
    return modules.move_probabilities(rows).select("eid", "module", F.round("p", 5).alias("p"))


@query()
def sample_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, samples, _ = _tops(spark, sf_dir)
    return sampler.sample_modules(materialise(edges, "edges"), materialise(samples.select("eid", "sample"), "samples"), N)


HIST = "hist AS (SELECT l_orderkey AS eid, l_linenumber AS step, min(l_suppkey) % 3 AS module FROM lineitem GROUP BY 1, 2)"


def trans_sql(name: str, where: str) -> str:
    return f"""h_{name} AS (SELECT * FROM hist WHERE {where}), m_{name} AS (SELECT eid, module AS a, lead(module) OVER (PARTITION BY eid ORDER BY step) AS b FROM h_{name}),
s_{name} AS (SELECT DISTINCT eid, module FROM h_{name} WHERE eid IN (SELECT eid FROM h_{name} GROUP BY 1 HAVING count(DISTINCT module) > 1)),
{name} AS (SELECT x.eid, x.module AS a, y.module AS b, coalesce(c.n / f.n, 0.0) AS p FROM s_{name} x JOIN s_{name} y USING (eid) LEFT JOIN (SELECT eid, a, b, count(*) AS n FROM m_{name} WHERE b IS NOT NULL GROUP BY 1, 2, 3) c ON c.eid = x.eid AND c.a = x.module AND c.b = y.module LEFT JOIN (SELECT eid, a, count(*) AS n FROM m_{name} WHERE b IS NOT NULL GROUP BY 1, 2) f ON f.eid = x.eid AND f.a = x.module)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("eid"), F.col("l_linenumber").alias("step")).agg((F.min("l_suppkey") % 3).alias("module"))


@query(f"WITH {HIST}, {trans_sql('t', 'true')} SELECT eid, a, b, round(p, 6) AS p FROM t")
def edge_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(modules.edge_transitions(_history(spark, sf_dir)), "p")


@query(f"WITH {HIST}, {trans_sql('t1', 'step <= 4')}, {trans_sql('t2', 'step >= 3')}, j AS (SELECT coalesce(x.p, 0) - coalesce(y.p, 0) AS d FROM (SELECT * FROM t1 WHERE eid IN (SELECT eid FROM t2)) x FULL JOIN (SELECT * FROM t2 WHERE eid IN (SELECT eid FROM t1)) y ON x.eid = y.eid AND x.a = y.a AND x.b = y.b) SELECT round(coalesce(sqrt(avg(d * d)), 0), 6) AS rmsd FROM j")
def transition_rmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _history(spark, sf_dir)
    return rounded(modules.transition_rmsd(modules.edge_transitions(h.filter("step <= 4")), modules.edge_transitions(h.filter("step >= 3"))), "rmsd")


@query("WITH s AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS step, CAST(count(*) AS DOUBLE) AS x1, CAST(sum(o_totalprice) AS DOUBLE) AS x2 FROM orders GROUP BY 1), e AS (SELECT min(x1) AS a1, max(x1) AS b1, min(x2) AS a2, max(x2) AS b2 FROM s), t AS (SELECT * FROM s ORDER BY step DESC LIMIT 10), z AS (SELECT regr_slope(10 * (x1 - a1) / (b1 - a1), step) AS slope_1, regr_slope(10 * (x2 - a2) / (b2 - a2), step) AS slope_2 FROM t, e) SELECT round(slope_1, 6) AS slope_1, round(slope_2, 6) AS slope_2, abs(slope_1) < 0.1 AND abs(slope_2) < 0.1 AS converged FROM z")
def convergence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    series = table(spark, sf_dir, "orders").groupBy(step.alias("step")).agg(F.count("*").cast("double").alias("x1"), F.sum("o_totalprice").cast("double").alias("x2"))
    return rounded(modules.convergence_check(series), "slope_1", "slope_2")


CONSENSUS = f"{HIST}, cns AS (SELECT eid, module, share, share < 0.5 AS weak FROM (SELECT *, n / sum(n) OVER (PARTITION BY eid) AS share, row_number() OVER (PARTITION BY eid ORDER BY n DESC, module) AS nth FROM (SELECT eid, module, count(*) AS n FROM hist GROUP BY 1, 2)) WHERE nth = 1)"


@query(f"WITH {CONSENSUS} SELECT eid, module, round(share, 6) AS share, weak FROM cns")
def consensus_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(modules.consensus_modules(_history(spark, sf_dir)), "share")


@query(f"WITH {CONSENSUS}, l AS (SELECT eid, max_by(module, step) AS old FROM hist GROUP BY 1), z AS (SELECT module, count(*) AS m FROM cns GROUP BY 1) SELECT (SELECT count(*) FROM cns) - count(*) AS n_empty, count(*) FILTER (m = 1) AS n_single, count(*) FILTER (m > 1) AS n_larger, (SELECT count(*) FROM l JOIN cns USING (eid) WHERE old <> module) AS n_moved FROM z")
def module_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _history(spark, sf_dir)
    return modules.module_census(h.groupBy("eid").agg(F.max_by("module", "step").alias("module")), modules.consensus_modules(h))


@query(f"WITH {TOPS}, {STATE} SELECT DISTINCT module, unnest([g1, g2]) AS gene FROM ed JOIN st USING (eid)")
def module_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, state = _tops(spark, sf_dir)
    return modules.module_genes(edges, state)


# biclusters


@query()
def two_means_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bicluster.two_means_split(_set_a(spark, sf_dir)[0], fx.exprs(spark, sf_dir))


@query()
def optimal_sample_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = _set_a(spark, sf_dir)[0]
    return bicluster.optimal_sample_set(genes, fx.exprs(spark, sf_dir), _bics(genes), N)


@query()
def discordant_sample_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bicluster.discordant_sample_set(_set_a(spark, sf_dir)[0], fx.exprs(spark, sf_dir), N)


SUMS = "sums AS (SELECT gene, count(*) AS n, sum(value) AS s, sum(value * value) AS ss FROM exprs GROUP BY gene)"
BIC_SNR = f"{fx.EXPRS}, {SETS}, {SUMS}, ins AS (SELECT id, gene, count(*) AS n1, sum(value) AS s1, sum(value * value) AS ss1 FROM ga JOIN exprs USING (gene) JOIN sa USING (id, sample) GROUP BY 1, 2), scores AS (SELECT id, avg({snr_sql('n1', 's1', 'ss1', 'n', 's', 'ss')}) AS avgSNR FROM ins JOIN sums USING (gene) GROUP BY id)"


@query(f"WITH {BIC_SNR} SELECT id, round(avgSNR, 6) AS avgSNR FROM scores")
def bicluster_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bicluster.bicluster_snr(*_set_a(spark, sf_dir), fx.exprs(spark, sf_dir)), "avgSNR")


def _sample_std_sql(diff: str) -> str:
    return f"WITH {fx.EXPRS}, {SETS}, r AS (SELECT ga.id, gene, value, sa.sample IS NOT NULL AS x FROM ga JOIN exprs USING (gene) LEFT JOIN sa ON sa.id = ga.id AND sa.sample = exprs.sample), p AS (SELECT id, gene, avg(value) FILTER (x) AS a, avg(value) FILTER (NOT x) AS b, stddev_samp(value) FILTER (x) AS sa, stddev_samp(value) FILTER (NOT x) AS sb FROM r GROUP BY 1, 2) SELECT id, round(avg({diff} / nullif(sa + sb, 0)), 6) AS avgSNR FROM p GROUP BY id"


@query(_sample_std_sql("abs(a - b)"))
def bicluster_snr_sample_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bicluster.bicluster_snr_sample_std(*_set_a(spark, sf_dir), fx.exprs(spark, sf_dir)), "avgSNR")


@query(_sample_std_sql("(a - b)"))
def bicluster_snr_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bicluster.bicluster_snr_sample_std(*_set_a(spark, sf_dir), fx.exprs(spark, sf_dir), signed=True), "avgSNR")


@query(f"WITH {fx.EXPRS}, {SETS}, r AS (SELECT id, sample, gene, value FROM ga JOIN exprs USING (gene) JOIN sa USING (id, sample)), c AS (SELECT x.id, corr(x.value, y.value) AS r FROM r x JOIN r y ON x.id = y.id AND x.sample = y.sample AND x.gene < y.gene GROUP BY x.id, x.gene, y.gene) SELECT id, round(avg(r), 2) + 0.0 AS avg, round(min(r), 2) AS min, round(max(r), 2) AS max FROM c GROUP BY id")
def bicluster_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bicluster.bicluster_correlations(*_set_a(spark, sf_dir), fx.exprs(spark, sf_dir))


@query()
def modules_to_biclusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, state = _tops(spark, sf_dir)
    return bicluster.modules_to_biclusters(edges, state, fx.exprs(spark, sf_dir), "UP", N, 0.3)


def _merged(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    genes, samples = _twins(spark, sf_dir)
    bics, members, samples = merge.merge_biclusters(_bics(genes), genes, samples, fx.exprs(spark, sf_dir), N, 0.15, **how)
    return bics.join(members.groupBy("id").agg(F.count("*").alias("n_genes")), "id").join(samples.groupBy("id").agg(F.count("*").alias("n_samples")), "id")


@query()
def merge_biclusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


@query()
def merge_discordant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, discordant=True)


@query(f"WITH {SETS}, o AS (SELECT max(id) + 1 AS off FROM ga) SELECT id, direction, n_genes FROM (SELECT id, {fx.DIRECTION} AS direction, count(*) AS n_genes FROM ga GROUP BY 1, 2) UNION ALL SELECT CAST(id + off AS INTEGER), {fx.DIRECTION}, count(*) FROM gb, o GROUP BY ALL")
def unite_up_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _set_a(spark, sf_dir), _set_b(spark, sf_dir)
    bics, genes, _ = merge.unite_up_down((_bics(a[0]), *a), (_bics(b[0]), *b))
    return bics.join(genes.groupBy("id").agg(F.count("*").alias("n_genes")), "id")




@query(f"WITH {SETS} SELECT id, {fx.DIRECTION} AS direction, sample FROM sa WHERE id IN (SELECT id FROM sa GROUP BY id HAVING count(*) < 32)")
def flip_large_biclusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Biclusters whose sets were complemented (over half of the samples) and exchanged come back."""
    genes, samples = _set_a(spark, sf_dir)
    turned = sets.complement(samples, "id", fx.exprs(spark, sf_dir).select("sample"))
    swapped = _bics(genes).withColumn("direction", F.when(F.col("direction") == "UP", "DOWN").otherwise("UP"))
    bics, back = bicluster.flip_large_biclusters(swapped, turned, fx.exprs(spark, sf_dir).select("sample"), N)
    return bics.join(back, "id").select("id", "direction", "sample")


@query(f"WITH {SETS} SELECT n_genes, count(*) AS n_biclusters FROM (SELECT id, count(*) AS n_genes FROM ga GROUP BY 1) GROUP BY 1")
def sizes_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bicluster.sizes_census(_set_a(spark, sf_dir)[0])


def _gene_set_sizes(spark: SparkSession, sf_dir: str) -> list[int]:
    """The sizes of the biclusters' gene sets."""
    return [r["n_genes"] for r in bicluster.sizes_census(_set_a(spark, sf_dir)[0]).select("n_genes").orderBy("n_genes").collect()]


@query()
def random_connected_subnets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls.random_connected_subnets(_edges(spark, sf_dir), _gene_set_sizes(spark, sf_dir), 1000)


@query()
def null_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls.null_distribution(_edges(spark, sf_dir), fx.exprs(spark, sf_dir), _gene_set_sizes(spark, sf_dir), 1000)


@query("WITH b AS (SELECT c_custkey AS id, c_nationkey AS n_genes, c_custkey % 50 AS n_samples, CAST(c_acctbal AS DOUBLE) AS avgSNR FROM customer), z AS (SELECT s_nationkey AS n_genes, s_suppkey % 50 AS n_samples, CAST(s_acctbal AS DOUBLE) AS avgSNR FROM supplier) SELECT b.id, round((count(*) FILTER (z.n_samples >= b.n_samples AND z.avgSNR >= b.avgSNR) + 1) / (count(z.n_genes) + 1.0), 6) AS p_val, count(*) FILTER (z.n_samples >= b.n_samples) AS n_not_less_samples, count(*) FILTER (z.n_samples >= b.n_samples AND z.avgSNR >= b.avgSNR) AS \"n_higher_SNR\" FROM b LEFT JOIN z USING (n_genes) GROUP BY b.id")
def empirical_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    bics = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n_genes"), (F.col("c_custkey") % 50).alias("n_samples"), F.col("c_acctbal").cast("double").alias("avgSNR"))
    null = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_genes"), (F.col("s_suppkey") % 50).alias("n_samples"), F.col("s_acctbal").cast("double").alias("avgSNR"))
    return rounded(bicluster.empirical_pvalues(bics, null), "p_val")


@query(f"WITH {BIC_SNR}, g AS (SELECT id, array_to_string(list_sort(list(CAST(gene AS VARCHAR))), ' ') AS genes, count(*) AS n_genes FROM ga GROUP BY 1), s AS (SELECT id, array_to_string(list_sort(list(CAST(sample AS VARCHAR))), ' ') AS samples, count(*) AS n_samples FROM sa GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY n_genes, avgSNR DESC, id) - 1 AS INTEGER) AS id, round(avgSNR, 6) AS avgSNR, genes, n_genes, samples, n_samples FROM scores JOIN g USING (id) JOIN s USING (id)")
def final_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes, samples = _set_a(spark, sf_dir)
    return rounded(bicluster.final_report(bicluster.bicluster_snr(genes, samples, fx.exprs(spark, sf_dir)), genes, samples), "avgSNR")


@query(f"WITH {BIC_SNR} SELECT CAST(CASE WHEN avgSNR >= 0.5 THEN 26 ELSE floor(avgSNR / 0.5 * 25) + 1 END AS BIGINT) AS bin, count(*) AS n FROM scores WHERE avgSNR IS NOT NULL GROUP BY 1")
def bicluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bicluster.bicluster_stats(bicluster.bicluster_snr(*_set_a(spark, sf_dir), fx.exprs(spark, sf_dir)), "avgSNR", 25, 0, 0.5)


# the two jobs


@query()
def discover_biclusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    bics, members, samples = jobs.discover(fx.vector_edges(spark, sf_dir), fx.exprs(spark, sf_dir), "UP", p=0.2, min_snr=0.1, min_n_samples=8)
    return bicluster.final_report(bics.select("id", "direction", "avgSNR", "converged"), members, samples)


@query()
def significance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda sets_, way: (sets_[0].select("id").distinct().withColumn("direction", F.lit(way)), *sets_)
    up, down = side(_twins(spark, sf_dir), "UP"), side(_set_b(spark, sf_dir), "DOWN")
    return rounded(jobs.significance(up, down, fx.vector_edges(spark, sf_dir), fx.exprs(spark, sf_dir), 0.15, 8), "avgSNR", "p_val")
