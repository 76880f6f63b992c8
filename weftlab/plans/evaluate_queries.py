"""Queries of evaluation: truth, cohorts, gene sets, clinical labels, benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlab.functions.stats import tail_sql
from weftlab.operators import evaluate
from weftlab.plans import fixtures as fx
from weftlab.plans.bicluster_queries import SETS, _set_a, _set_b, rounded
from weftlab.session import table

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


OVERLAPS = f"""{SETS}, p AS (SELECT id AS i, (SELECT count(*) FROM gb g WHERE g.id = x.id) AS gp, (SELECT count(*) FROM sb g WHERE g.id = x.id) AS sp FROM (SELECT DISTINCT id FROM gb) x),
t AS (SELECT id AS j, (SELECT count(*) FROM ga g WHERE g.id = x.id) AS gt, (SELECT count(*) FROM sa g WHERE g.id = x.id) AS st FROM (SELECT DISTINCT id FROM ga) x),
sg AS (SELECT b.id AS i, a.id AS j, count(*) AS n FROM gb b JOIN ga a USING (gene) GROUP BY 1, 2), ss AS (SELECT b.id AS i, a.id AS j, count(*) AS n FROM sb b JOIN sa a USING (sample) GROUP BY 1, 2),
ov AS (SELECT i, j, gp, sp, gt, st, coalesce(sg.n, 0) * coalesce(ss.n, 0) AS ov FROM p CROSS JOIN t LEFT JOIN sg USING (i, j) LEFT JOIN ss USING (i, j))"""
JAC = "ov / (gp * sp + gt * st - ov)"
F1 = "2.0 * ov / (gp * sp + gt * st)"


@query(f"WITH {OVERLAPS} SELECT i, round(max({JAC}), 6) AS relevance FROM ov GROUP BY i")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.relevance(_set_b(spark, sf_dir), _set_a(spark, sf_dir)), "relevance")


@query(f"WITH {OVERLAPS} SELECT j, round(max({JAC}), 6) AS recovery FROM ov GROUP BY j")
def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.recovery(_set_b(spark, sf_dir), _set_a(spark, sf_dir)), "recovery")


@query(f"WITH {OVERLAPS} SELECT i, round(max({F1}), 6) AS f1 FROM ov GROUP BY i")
def f1_per_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.f1_per_prediction(_set_b(spark, sf_dir), _set_a(spark, sf_dir)), "f1")


@query(f"WITH {OVERLAPS} SELECT j, round(max({F1}), 6) AS f1 FROM ov GROUP BY j")
def f1_per_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.f1_per_truth(_set_b(spark, sf_dir), _set_a(spark, sf_dir)), "f1")


EVENTS = "ev AS (SELECT CAST(user_id AS VARCHAR) AS params, event_type AS size, CAST(event_id % 3 AS INTEGER) AS run, CAST(value AS DOUBLE) AS relevance, CAST(value AS DOUBLE) / 2 AS recovery FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value").cast("double")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("params"), F.col("event_type").alias("size"), (F.col("event_id") % 3).cast("int").alias("run"), value.alias("relevance"), (value / 2).alias("recovery"))


GRID = f"{EVENTS}, res AS (SELECT params, size, run, coalesce(avg(relevance), 0) AS relevance, coalesce(avg(recovery), 0) AS recovery, count(relevance) AS n FROM (SELECT DISTINCT params FROM ev) CROSS JOIN (SELECT DISTINCT size FROM ev) CROSS JOIN (SELECT DISTINCT run FROM ev) LEFT JOIN ev USING (params, size, run) GROUP BY 1, 2, 3)"


@query(f"WITH {GRID} SELECT params, size, run, round(relevance, 6) AS relevance, round(recovery, 6) AS recovery, n FROM res")
def benchmark_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.benchmark_results(_events(spark, sf_dir)), "relevance", "recovery")


@query(f"WITH {GRID} SELECT params, size, run, round(sqrt(relevance * recovery), 6) AS score FROM res")
def geometric_mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.geometric_mean_score(evaluate.benchmark_results(_events(spark, sf_dir)))
    return rounded(rows.select("params", "size", "run", "score"), "score")


def _kinds(spark: SparkSession, sf_dir: str) -> list[str]:
    return sorted(r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect())


@query(f"WITH {GRID}, k AS (SELECT DISTINCT size FROM ev), m AS (SELECT params, size, avg(sqrt(relevance * recovery)) AS score FROM res GROUP BY 1, 2), r AS (SELECT params, sum(score) / (SELECT count(*) FROM k) AS row_mean FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) SELECT params, size, round(score, 6) AS score, round(row_mean, 6) AS row_mean FROM m JOIN r USING (params)")
def performance_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = _kinds(spark, sf_dir)
    rows = evaluate.geometric_mean_score(evaluate.benchmark_results(_events(spark, sf_dir)))
    wide = evaluate.performance_pivot(rows, kinds, 20)
    return rounded(wide.unpivot(["params", "row_mean"], kinds, "size", "score"), "score", "row_mean")


@query(f"WITH {EVENTS}, b AS (SELECT avg(relevance) AS base FROM ev WHERE params = '1') SELECT params, round(avg(relevance), 6) AS mean_relevance, round(stddev_samp(relevance), 6) AS std_relevance, count(relevance) AS n_relevance, round(max(relevance), 6) AS max_relevance, round(min(relevance), 6) AS min_relevance, round(avg(recovery), 6) AS mean_recovery, round(stddev_samp(recovery), 6) AS std_recovery, count(recovery) AS n_recovery, round(max(recovery), 6) AS max_recovery, round(min(recovery), 6) AS min_recovery, round(avg(relevance) - any_value(base), 6) + 0.0 AS gain FROM ev, b GROUP BY params")
def best_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.best_parameters(_events(spark, sf_dir), ["relevance", "recovery"], "1", "relevance")
    return rounded(rows, *[c for c in rows.columns if c != "params" and not c.startswith("n_")])


@query("SELECT 'own' AS method, CASE WHEN p_size % 2 = 0 THEN 'Default' ELSE 'Optimised' END AS parameters, p_partkey AS part, unnest(['5', '10']) AS size, unnest([CAST(p_size AS DOUBLE), CAST(p_retailprice AS DOUBLE)]) AS performance FROM part")
def benchmark_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    wide = p.select(F.lit("own").alias("method"), F.when(F.col("p_size") % 2 == 0, "D").otherwise("O").alias("parameters"), F.col("p_partkey").alias("part"), F.col("p_size").cast("double").alias("5"), F.col("p_retailprice").cast("double").alias("10"))
    return evaluate.benchmark_unpivot(wide, ["method", "parameters", "part"], {"D": "Default", "O": "Optimised"})


def match_sql(target: str, base: str) -> str:
    return f"""(SELECT n.id AS i, coalesce(j, -1) AS j, round(coalesce(jac, 0), 6) AS jac FROM (SELECT id, count(*) AS n FROM {target} GROUP BY 1) n LEFT JOIN
(SELECT i, j, jac FROM (SELECT i, j, jac, row_number() OVER (PARTITION BY i ORDER BY jac DESC, j) AS nth FROM (SELECT x.id AS i, y.id AS j, count(*) / ((SELECT count(*) FROM {target} a WHERE a.id = x.id) + (SELECT count(*) FROM {base} b WHERE b.id = y.id) - count(*)) AS jac FROM {target} x JOIN {base} y USING (gene) GROUP BY x.id, y.id)) WHERE nth = 1) m ON m.i = n.id)"""


@query(f"WITH {SETS} SELECT * FROM {match_sql('ga', 'gb')}")
def best_match_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.best_match_genes(_set_a(spark, sf_dir)[0], _set_b(spark, sf_dir)[0]), "jac")


def both_sql(target: str, base: str) -> str:
    few = "s.sample IN (SELECT sample FROM sa WHERE id <= 12)"
    one = lambda s, k: f"(SELECT count(*) FROM {s} s WHERE s.id = {k} AND {few})"
    pair = f"""(SELECT i, j, g.jac * coalesce((SELECT count(*) FROM s{target} p JOIN s{base} q USING (sample) WHERE p.id = i AND q.id = j) / nullif({one(f's{target}', 'i')} + {one(f's{base}', 'j')} - (SELECT count(*) FROM s{target} s JOIN s{base} q ON q.sample = s.sample WHERE s.id = i AND q.id = j AND {few}), 0), 0) AS jac
FROM (SELECT x.id AS i, y.id AS j, count(*) / ((SELECT count(*) FROM g{target} a WHERE a.id = x.id) + (SELECT count(*) FROM g{base} b WHERE b.id = y.id) - count(*)) AS jac FROM g{target} x JOIN g{base} y USING (gene) GROUP BY x.id, y.id) g)"""
    return f"(SELECT n.id AS i, coalesce(j, -1) AS j, round(coalesce(jac, 0), 6) AS jac FROM (SELECT DISTINCT id FROM g{target}) n LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY jac DESC, j) AS nth FROM {pair} WHERE jac > 0) WHERE nth = 1) m ON m.i = n.id)"


def _shared_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set_a(spark, sf_dir)[1].filter("id <= 12").select("sample").distinct()


@query(f"WITH {SETS} SELECT * FROM {both_sql('a', 'b')}")
def best_match_biclusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.best_match_biclusters(_set_a(spark, sf_dir), _set_b(spark, sf_dir), _shared_samples(spark, sf_dir)), "jac")


@query(f"WITH {SETS} SELECT 'A' AS target, 'B' AS base, 'own' AS method, 'Tuned' AS parameters, * FROM {match_sql('ga', 'gb')} UNION ALL SELECT 'B', 'A', 'own', 'Default', * FROM {match_sql('gb', 'ga')}")
def cohort_reproducibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _set_a(spark, sf_dir)[0], _set_b(spark, sf_dir)[0]
    rows = evaluate.reproducibility({("A", "B"): evaluate.best_match_genes(a, b), ("B", "A"): evaluate.best_match_genes(b, a)}, {("A", "B"): "own_tuned", ("B", "A"): "own"})
    return rounded(rows, "jac")


@query(f"WITH {SETS} SELECT 'A' AS target, 'B' AS base, 'own' AS method, 'Default' AS parameters, * FROM {both_sql('a', 'b')} UNION ALL SELECT 'B', 'A', 'own', 'Default', * FROM {both_sql('b', 'a')}")
def platform_reproducibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, few = _set_a(spark, sf_dir), _set_b(spark, sf_dir), _shared_samples(spark, sf_dir)
    rows = evaluate.reproducibility({("A", "B"): evaluate.best_match_biclusters(a, b, few), ("B", "A"): evaluate.best_match_biclusters(b, a, few)})
    return rounded(rows, "jac")


ENRICH = f"""bics AS (SELECT DISTINCT CAST(l_suppkey % 40 AS INTEGER) AS id, l_partkey AS gene FROM lineitem WHERE l_quantity > 45), sets AS (SELECT p_type AS set_name, p_partkey AS gene FROM part),
n1 AS (SELECT id, count(*) AS n1 FROM bics GROUP BY 1), n2 AS (SELECT set_name, count(*) AS n2 FROM sets GROUP BY 1), nn AS (SELECT count(*) AS n FROM part),
sh AS (SELECT id, set_name, count(*) AS shared FROM bics JOIN sets USING (gene) GROUP BY 1, 2),
pv AS (SELECT id, set_name, shared, {tail_sql('shared', 'n1', 'n2', 'n')} AS p, shared * n / (n1 * n2) AS fold FROM sh JOIN n1 USING (id) JOIN n2 USING (set_name), nn),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, set_name) AS r, count(*) OVER (PARTITION BY id) AS k FROM pv),
qv AS (SELECT *, least(1.0, min(p * k / r) OVER (PARTITION BY id ORDER BY r DESC)) AS q FROM rk),
hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fold DESC, q, set_name) AS nth FROM qv WHERE q < 0.9) WHERE nth = 1)"""


def _enrich(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    bics = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select((F.col("l_suppkey") % 40).cast("int").alias("id"), F.col("l_partkey").alias("gene")).distinct()
    part = table(spark, sf_dir, "part")
    return bics, part.select(F.col("p_type").alias("set_name"), F.col("p_partkey").alias("gene")), evaluate.gene_set_enrichment(bics, part.select(F.col("p_type").alias("set_name"), F.col("p_partkey").alias("gene")), part.count(), alpha=0.9)


@query(f"WITH {ENRICH} SELECT id, set_name, shared, round(p, 6) AS p, round(q, 6) AS q, round(fold, 6) AS fold, round(-log10(q), 6) AS log_q, round(log10(fold), 6) AS log_fold FROM hit")
def gene_set_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_enrich(spark, sf_dir)[2], "p", "q", "fold", "log_q", "log_fold")


@query(f"WITH {ENRICH} SELECT CAST(i.id % 4 AS INTEGER) AS method, round(100.0 * count(hit.id) / count(*), 6) AS pct FROM (SELECT DISTINCT id FROM bics) i LEFT JOIN hit ON hit.id = i.id GROUP BY 1")
def enrichment_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bics, _, hits = _enrich(spark, sf_dir)
    method = (F.col("id") % 4).alias("method")
    return rounded(evaluate.enrichment_rate(hits.select(method, "id"), bics.select(method, "id").distinct(), ["method"]), "pct")


CLINICAL = f"""smp AS (SELECT DISTINCT CAST(o_custkey % 30 AS INTEGER) AS id, o_custkey AS sample FROM orders), lab AS (SELECT c_custkey AS sample, c_mktsegment AS category FROM customer), nn AS (SELECT count(*) AS n FROM customer),
n1 AS (SELECT id, count(*) AS n1 FROM smp GROUP BY 1), n2 AS (SELECT category, count(*) AS n2 FROM lab GROUP BY 1),
al AS (SELECT id, category, n, CASE WHEN n1 > n / 2 THEN n - n1 ELSE n1 END AS size, n2, CASE WHEN n1 > n / 2 THEN n2 - it ELSE it END AS shared FROM (SELECT id, category, n1, n2, n, (SELECT count(*) FROM smp JOIN lab USING (sample) WHERE smp.id = n1.id AND lab.category = n2.category) AS it FROM n1, n2, nn)),
pv AS (SELECT id, category, {tail_sql('shared', 'size', 'n2', 'n')} AS p, shared * n / (size * n2) AS fold, shared, shared / (size + n2 - shared) AS jac FROM al),
ca AS (SELECT i.id, coalesce(category, 'NA') AS category, round(coalesce(p, 0), 6) AS p, round(coalesce(fold, 0), 6) AS fold, CAST(coalesce(shared, 0) AS DOUBLE) AS shared, round(coalesce(jac, 0), 6) AS jac FROM n1 i LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, category) AS nth FROM pv WHERE p < 0.2) WHERE nth = 1) b ON b.id = i.id)"""


def _clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 30).cast("int").alias("id"), F.col("o_custkey").alias("sample")).distinct()
    c = table(spark, sf_dir, "customer")
    rows = evaluate.clinical_association(samples, c.select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("category")), c.count(), alpha=0.2)
    return rounded(rows, "p", "fold", "jac")


@query(f"WITH {CLINICAL} SELECT * FROM ca")
def clinical_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clinical(spark, sf_dir)


@query(f"WITH {CLINICAL}, th AS (SELECT id, p, category, row_number() OVER (ORDER BY id) * 0.05 / 6 / count(*) OVER () AS threshold FROM ca) SELECT id, p, round(threshold, 8) AS threshold, p < threshold AS passed, CASE WHEN p < threshold THEN category ELSE 'NA' END AS category FROM th")
def bh_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.bh_filter(_clinical(spark, sf_dir).select("id", "p", "category"), "p", "category", ["id"])
    return rows.withColumn("threshold", F.round("threshold", 8))


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as biclusters: status as method, priority as data set, lines as genes."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_genes"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey").select(F.col("o_orderstatus").alias("method"), F.col("o_orderpriority").alias("data"), "n_genes")


ORDERS = "b AS (SELECT o_orderstatus AS method, o_orderpriority AS data, n_genes FROM orders JOIN (SELECT l_orderkey, count(*) AS n_genes FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


@query(f"WITH {ORDERS} SELECT method, data, count(*) AS n FROM b GROUP BY 1, 2")
def count_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.count_by_method(_modules(spark, sf_dir))


@query(f"WITH {ORDERS} SELECT method, data, quantile_cont(n_genes, 0.25) AS q25, quantile_cont(n_genes, 0.5) AS q50, quantile_cont(n_genes, 0.75) AS q75 FROM b GROUP BY 1, 2")
def size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.size_distribution(_modules(spark, sf_dir), "n_genes")
