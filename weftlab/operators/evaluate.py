"""Scoring biclusters against truth, other cohorts, gene sets and clinical labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlab.functions.ordering import numbered
from weftlab.functions.stats import bh_adjust, jaccard, with_tail
from weftlab.operators.pairs import shared_counts
from weftlab.session import materialise


def _sizes(genes: DataFrame, samples: DataFrame, key: str, g: str, s: str) -> DataFrame:
    a = genes.groupBy(F.col("id").alias(key)).agg(F.count("*").alias(g))
    return a.join(samples.groupBy(F.col("id").alias(key)).agg(F.count("*").alias(s)), key)


def cell_overlaps(pred: tuple[DataFrame, DataFrame], truth: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(i, j, ov, gp, sp, gt, st) of predictions i and truths j that share a cell; each side is (genes, samples)."""
    shared = shared_counts(pred[0], truth[0], "gene").withColumnRenamed("shared", "sg").join(shared_counts(pred[1], truth[1], "sample").withColumnRenamed("shared", "ss"), ["i", "j"])
    return shared.withColumn("ov", F.col("sg") * F.col("ss")).join(_sizes(*pred, "i", "gp", "sp"), "i").join(_sizes(*truth, "j", "gt", "st"), "j")


def _best(rows: DataFrame, every: DataFrame, key: str, value, out: str) -> DataFrame:
    top = rows.groupBy(key).agg(F.max(value).alias(out))
    return every.join(top, key, "left").select(key, F.coalesce(out, F.lit(0.0)).alias(out))


def _ids(side: tuple[DataFrame, DataFrame], key: str) -> DataFrame:
    return side[0].select(F.col("id").alias(key)).distinct()


def _cells():
    return jaccard(F.col("ov"), F.col("gp") * F.col("sp"), F.col("gt") * F.col("st"))


def relevance(pred: tuple[DataFrame, DataFrame], truth: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(i, relevance): for each prediction the best cell-wise Jaccard against truth; without predictions a zero per truth."""
    out = _best(cell_overlaps(pred, truth), _ids(pred, "i"), "i", _cells(), "relevance")
    if out.isEmpty():
        return _ids(truth, "i").withColumn("relevance", F.lit(0.0))
    return out


def recovery(pred: tuple[DataFrame, DataFrame], truth: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(j, recovery): for each truth the best over predictions."""
    return _best(cell_overlaps(pred, truth), _ids(truth, "j"), "j", _cells(), "recovery")


def _f1():
    return F.try_divide(2.0 * F.col("ov"), F.col("gp") * F.col("sp") + F.col("gt") * F.col("st"))


def f1_per_prediction(pred: tuple[DataFrame, DataFrame], truth: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(i, f1): for each prediction the best F1 of cells over truths, 0 without a shared cell."""
    return _best(cell_overlaps(pred, truth), _ids(pred, "i"), "i", _f1(), "f1")


def f1_per_truth(pred: tuple[DataFrame, DataFrame], truth: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(j, f1): for each truth the best F1 of cells over predictions, 0 without a shared cell."""
    return _best(cell_overlaps(pred, truth), _ids(truth, "j"), "j", _f1(), "f1")


def benchmark_results(scores: DataFrame) -> DataFrame:
    """(params, size, run, relevance, recovery, n): means per cell of the whole grid of params, sizes and runs of scores; missing cells have zeros."""
    cells = F.broadcast(scores.select("size").distinct().join(scores.select("run").distinct()))  # the sizes and runs of one benchmark
    grid = scores.select("params").distinct().join(cells)
    got = scores.groupBy("params", "size", "run").agg(F.avg("relevance").alias("relevance"), F.avg("recovery").alias("recovery"), F.count("*").alias("n"))
    return grid.join(got, ["params", "size", "run"], "left").fillna(0, ["relevance", "recovery", "n"])


def geometric_mean_score(results: DataFrame) -> DataFrame:
    """results with score, the geometric mean of relevance and recovery; null where one is null."""
    return results.withColumn("score", F.sqrt(F.col("relevance") * F.col("recovery")))


def performance_pivot(results: DataFrame, sizes: list, top: int, value: str = "score") -> DataFrame:
    """params by size, mean of value, missing 0, the `top` rows by row mean (then params)."""
    wide = results.groupBy("params").pivot("size", sizes).agg(F.avg(value)).fillna(0.0)
    mean = reduce(lambda a, b: a + b, [F.col(f"`{s}`") for s in sizes]) / len(sizes)
    return wide.withColumn("row_mean", mean).orderBy(F.desc("row_mean"), "params").limit(top)


def best_parameters(results: DataFrame, measures: list[str], default: str, by: str) -> DataFrame:
    """(params, mean_, std_, n_, max_, min_ of each measure, gain): per parameter set, with the gain in mean `by` over the default set."""
    stats = [f(m).alias(f"{n}_{m}") for m in measures for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("n", F.count), ("max", F.max), ("min", F.min))]
    rows = results.groupBy("params").agg(*stats)
    base = rows.filter(F.col("params") == default).select(F.col(f"mean_{by}").alias("base"))
    return rows.join(F.broadcast(base)).withColumn("gain", F.col(f"mean_{by}") - F.col("base")).drop("base")


def benchmark_unpivot(wide: DataFrame, keys: list[str], kinds: dict[str, str]) -> DataFrame:
    """keys, size, performance of a wide summary; column parameters recoded by kinds."""
    sizes = [c for c in wide.columns if c not in keys]
    long = wide.unpivot(keys, sizes, "size", "performance")
    pairs = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return long.withColumn("parameters", pairs[F.col("parameters")])


def best_match_genes(target: DataFrame, base: DataFrame) -> DataFrame:
    """(i, j, jac): for each set of target the set of base with the highest gene Jaccard, ties to the smaller id; none: j -1, J 0."""
    na, nb = target.groupBy(F.col("id").alias("i")).agg(F.count("*").alias("n1")), base.groupBy(F.col("id").alias("j")).agg(F.count("*").alias("n2"))
    rows = shared_counts(target, base, "gene").join(na, "i").join(nb, "j").withColumn("jac", jaccard(F.col("shared"), F.col("n1"), F.col("n2")))
    return _top_match(rows, na)


def _top_match(rows: DataFrame, every: DataFrame) -> DataFrame:
    best = rows.withColumn("nth", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("jac"), "j"))).filter("nth = 1 and jac > 0").select("i", "j", "jac")
    return every.select("i").join(best, "i", "left").select("i", F.coalesce("j", F.lit(-1)).alias("j"), F.coalesce("jac", F.lit(0.0)).alias("jac"))


def best_match_biclusters(target: tuple[DataFrame, DataFrame], base: tuple[DataFrame, DataFrame], every: DataFrame, limit_numerator: bool = False) -> DataFrame:
    """(i, j, jac): best product of gene Jaccard and sample Jaccard, whose union is limited to the samples of `every` (and the intersection too, if asked)."""
    na, nb = target[0].groupBy(F.col("id").alias("i")).agg(F.count("*").alias("n1")), base[0].groupBy(F.col("id").alias("j")).agg(F.count("*").alias("n2"))
    few = lambda s: s.join(every.select("sample").distinct(), "sample", "left_semi")
    sa, sb = few(target[1]), few(base[1])
    ma, mb = sa.groupBy(F.col("id").alias("i")).agg(F.count("*").alias("m1")), sb.groupBy(F.col("id").alias("j")).agg(F.count("*").alias("m2"))
    top = shared_counts(sa, sb, "sample") if limit_numerator else shared_counts(target[1], base[1], "sample")
    rows = shared_counts(target[0], base[0], "gene").join(na, "i").join(nb, "j").join(top.withColumnRenamed("shared", "ss"), ["i", "j"])
    rows = rows.join(shared_counts(sa, sb, "sample").withColumnRenamed("shared", "sl"), ["i", "j"], "left").join(ma, "i", "left").join(mb, "j", "left").fillna(0, ["sl", "m1", "m2"])
    both = jaccard(F.col("shared"), F.col("n1"), F.col("n2")) * F.coalesce(F.try_divide(F.col("ss"), F.col("m1") + F.col("m2") - F.col("sl")), F.lit(0.0))
    return _top_match(rows.withColumn("jac", both), na)


def reproducibility(matches: dict[tuple[str, str], DataFrame], methods: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """(target, base, method, parameters, i, j, jac): matches of many pairs of tables, tagged Tuned where the method's name ends so, else Default."""
    out = None
    for (a, b), rows in matches.items():
        method = F.lit((methods or {}).get((a, b), "own"))
        tagged = rows.select(F.lit(a).alias("target"), F.lit(b).alias("base"), F.regexp_replace(method, "_tuned$", "").alias("method"), F.when(method.endswith("_tuned"), "Tuned").otherwise("Default").alias("parameters"), "i", "j", "jac")
        out = tagged if out is None else out.union(tagged)
    return out


def gene_set_enrichment(genes: DataFrame, sets: DataFrame, n: int, alpha: float = 0.05, by_fold: bool = True) -> DataFrame:
    """(id, set_name, shared, p, q, fold, log_q, log_fold): the best set of each bicluster among those that share a gene.

    by_fold: the highest fold change of those with q < alpha; else the lowest q. Ties go by q, then name. n: genes in all.
    """
    na, ns = genes.groupBy("id").agg(F.count("*").alias("n1")), sets.groupBy("set_name").agg(F.count("*").alias("n2"))
    rows = genes.join(sets, "gene").groupBy("id", "set_name").agg(F.count("*").alias("shared")).join(na, "id").join(ns, "set_name")
    rows = with_tail(materialise(rows, "shared-genes"), "shared", "n1", "n2", n).withColumn("fold", F.col("shared") * float(n) / (F.col("n1") * F.col("n2").cast("double")))
    q = bh_adjust(rows, "p", ["id"], ["set_name"])
    order = [F.desc("fold"), "q", "set_name"] if by_fold else ["q", F.desc("fold"), "set_name"]
    best = q.filter(F.col("q") < alpha).withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter("nth = 1")
    return best.select("id", "set_name", "shared", "p", "q", "fold", (-F.log10("q")).alias("log_q"), F.log10("fold").alias("log_fold"))


def enrichment_rate(hits: DataFrame, bics: DataFrame, by: list[str]) -> DataFrame:
    """(by..., pct): percentage of biclusters with a hit. hits and bics: by..., id."""
    rows = bics.join(hits.select(*by, "id").distinct().withColumn("hit", F.lit(1.0)), [*by, "id"], "left")
    return rows.groupBy(*by).agg((100 * F.avg(F.coalesce("hit", F.lit(0.0)))).alias("pct"))


def clinical_association(samples: DataFrame, labels: DataFrame, n: int, alpha: float = 0.05) -> DataFrame:
    """(id, category, p, fold, shared, jac): the category with the lowest right-tail p under alpha for each bicluster; none: NA and zeros.

    labels: sample, category. A bicluster of over half of the samples stands for its complement. Ties go by category.
    """
    size = samples.groupBy("id").agg(F.count("*").alias("n1"))
    cat = labels.groupBy("category").agg(F.count("*").alias("n2"))
    shared = samples.join(labels, "sample").groupBy("id", "category").agg(F.count("*").alias("inter"))
    every = F.broadcast(cat.agg(F.collect_list(F.struct("category", "n2")).alias("cats")))  # the domain of one variable
    rows = size.join(every).select("id", "n1", F.explode("cats").alias("c")).select("id", "n1", "c.category", "c.n2").join(shared, ["id", "category"], "left").fillna(0, ["inter"])
    big = F.col("n1") > n / 2
    rows = rows.withColumn("shared", F.when(big, F.col("n2") - F.col("inter")).otherwise(F.col("inter"))).withColumn("size", F.when(big, n - F.col("n1")).otherwise(F.col("n1")))
    rows = with_tail(materialise(rows, "categories"), "shared", "size", "n2", n).withColumn("fold", F.try_divide(F.col("shared") * float(n), F.col("size") * F.col("n2").cast("double"))).withColumn("jac", jaccard(F.col("shared"), F.col("size"), F.col("n2")))
    best = rows.filter(F.col("p") < alpha).withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("p", "category"))).filter("nth = 1")
    out = size.select("id").join(best, "id", "left")
    return out.select("id", F.coalesce(F.col("category").cast("string"), F.lit("NA")).alias("category"), *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in ("p", "fold", "shared", "jac")])


def bh_filter(rows: DataFrame, p: str, value: str, order: list[str], alpha: float = 0.05, n_tests: int = 6, by_p: bool = False) -> DataFrame:
    """rows with threshold = rank * alpha / n_tests / n in row order (or by p), passed, and value NA where not passed."""
    placed = numbered(rows, [*([p] if by_p else []), *order], "__nth")
    placed = placed.join(F.broadcast(placed.agg(F.count("*").alias("__n"))))
    ranked = placed.withColumn("threshold", (F.col("__nth") + 1) * alpha / n_tests / F.col("__n")).drop("__n", "__nth").withColumn("passed", F.col(p) < F.col("threshold"))
    return ranked.withColumn(value, F.when(F.col("passed"), F.col(value)).otherwise("NA"))


def count_by_method(bics: DataFrame) -> DataFrame:
    """(method, data, n)."""
    return bics.groupBy("method", "data").agg(F.count("*").alias("n"))


def size_distribution(bics: DataFrame, column: str) -> DataFrame:
    """(method, data, q25, q50, q75) of a size column."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return bics.groupBy("method", "data").agg(q.alias("q")).select("method", "data", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))
