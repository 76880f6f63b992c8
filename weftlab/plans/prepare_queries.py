"""Queries of sources, cleaning, clinical tables, sets and networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlab.operators import clinical, network, prepare, sets
from weftlab.plans import fixtures as fx
from weftlab.session import new_path, table
from weftlab.sources import matrix

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


R6 = lambda c: F.round(c, 6)


# sources


@query("SELECT CAST(vec_id AS VARCHAR) AS gene, 's' || CAST(generate_subscripts(embedding, 1) - 1 AS VARCHAR) AS sample, round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings")
def read_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "expression")
    table(spark, sf_dir, "embeddings").select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(f"s{i}") for i in range(fx.N)]).write.csv(path, sep="\t", header=True)
    return matrix.read_expression(spark, path).withColumn("value", R6("value"))


@query("SELECT CAST(p_brand AS VARCHAR) AS symbol, CAST(p_partkey AS VARCHAR) AS entrez, unnest(['p_size', 'p_retailprice']) AS sample, round(unnest([CAST(p_size AS DOUBLE), CAST(p_retailprice AS DOUBLE)]), 6) AS value FROM part")
def read_expression_two_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "two-key")
    table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice").write.csv(path, sep="\t", header=True)
    return matrix.read_expression_two_key(spark, path).withColumn("value", R6("value"))


@query(f"WITH {fx.RAW_EDGES} SELECT CAST(g1 AS VARCHAR) AS g1, CAST(g2 AS VARCHAR) AS g2 FROM raw_edges")
def read_edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "edges")
    e = fx.vector_edges(spark, sf_dir)
    e.select(F.when(F.col("g1") % 2 == 0, F.concat_ws("\t", "g1", "g2")).otherwise(F.concat_ws(" ", "g1", "g2", F.lit("1")))).write.text(path)
    return matrix.read_edge_list(spark, path)


@query(f"WITH {fx.RAW_EDGES} SELECT 'v' || g1 AS g1, 'v' || g2 AS g2 FROM raw_edges")
def read_cx_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "cx")
    e = fx.vector_edges(spark, sf_dir)
    nodes = e.select(F.explode(F.array("g1", "g2")).alias("g")).distinct().select(F.col("g").alias("@id"), F.concat(F.lit("v"), "g").alias("n"))
    files = nodes.select(F.to_json(F.struct(F.array(F.struct("@id", "n")).alias("nodes"))).alias("value")).union(e.select(F.to_json(F.struct(F.array(F.struct(F.col("g1").alias("s"), F.col("g2").alias("t"))).alias("edges")))))
    lines = files.groupBy(F.substring("value", 3, 5).alias("aspect")).agg(F.concat_ws(",", F.collect_list("value")).alias("v"))
    lines.coalesce(1).agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("v")), F.lit("]")).alias("value")).write.text(path)
    return matrix.read_cx_network(spark, path)


def _bics(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    g = fx.bic_genes(spark, sf_dir, shift=shift).groupBy("id").agg(F.collect_list(F.col("gene").cast("string")).alias("genes"))
    s = fx.bic_samples(spark, sf_dir, shift=shift).groupBy("id").agg(F.collect_list(F.col("sample").cast("string")).alias("samples"))
    both = fx.directions(g.join(s, "id")).withColumn("avgSNR", (F.col("id") * 7 % 5) / 4)
    return both.select("id", "avgSNR", F.size("genes").alias("n_genes"), F.size("samples").alias("n_samples"), "direction", F.array_sort("genes").alias("genes"), F.array_sort("samples").alias("samples"))


BICS = f"""{fx.bic_genes_sql('bg')}, {fx.bic_samples_sql('bs', 'bg')},
bics AS (SELECT id, (id * 7 % 5) / 4.0 AS avgSNR, {fx.DIRECTION} AS direction, n_genes, n_samples, genes, samples FROM
 (SELECT id, CAST(count(*) AS INTEGER) AS n_genes, list_sort(list(CAST(gene AS VARCHAR))) AS genes FROM bg GROUP BY id) JOIN
 (SELECT id, CAST(count(*) AS INTEGER) AS n_samples, list_sort(list(CAST(sample AS VARCHAR))) AS samples FROM bs GROUP BY id) USING (id))"""
ORDERED = f"WITH {BICS} SELECT CAST(row_number() OVER (ORDER BY avgSNR DESC, n_genes DESC, n_samples DESC, id) - 1 AS INTEGER) AS id, CAST(avgSNR AS DOUBLE) AS avgSNR, n_genes, n_samples, direction, array_to_string(genes, ' ') AS genes, array_to_string(samples, ' ') AS samples FROM bics"


@query(ORDERED)
def write_biclusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "bics")
    matrix.write_biclusters(_bics(spark, sf_dir), path)
    return spark.read.schema("id int, avgSNR double, n_genes int, n_samples int, direction string, genes string, samples string").csv(path, sep="\t", header=True)


@query(ORDERED)
def read_biclusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "bics")
    matrix.write_biclusters(_bics(spark, sf_dir), path)
    back = matrix.read_biclusters(spark, path).unionByName(matrix.read_biclusters(spark, path + "-missing"))
    return back.withColumn("genes", F.array_join("genes", " ")).withColumn("samples", F.array_join("samples", " "))


TOP_SAMPLES = f"{fx.EXPRS}, {fx.EDGES}, top AS (SELECT gene, sample FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY value DESC, sample) AS r FROM exprs) WHERE r <= 16)"


@query(f"WITH {TOP_SAMPLES} SELECT g1, g2, array_to_string(list_sort(list(a.sample)), ' ') AS samples FROM edges JOIN top a ON a.gene = g1 JOIN top b ON b.gene = g2 AND a.sample = b.sample GROUP BY g1, g2")
def edge_samples_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlab.operators import rankoverlap

    top = rankoverlap.rank_samples(fx.exprs(spark, sf_dir)).filter("rnk < 16")
    rows = network.canonical_edges(fx.vector_edges(spark, sf_dir)).join(top.select(F.col("gene").alias("g1"), "sample"), "g1").join(top.select(F.col("gene").alias("g2"), "sample"), ["g2", "sample"])
    packed = rows.groupBy("g1", "g2").agg(F.array_sort(F.collect_list("sample")).alias("samples"))
    folder = new_path(spark, "snapshot")
    matrix.edge_samples_snapshot(packed, folder, spark, "UP", 0.01, 0.1, 10)
    return matrix.edge_samples_snapshot(None, folder, spark, "UP", 0.01, 0.1, 10).select("g1", "g2", F.array_join("samples", " ").alias("samples"))


@query(f"WITH {BICS} SELECT id, array_to_string(genes, ' ') AS genes, array_to_string(samples, ' ') AS samples FROM bics")
def read_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "truth")
    text = F.concat(F.lit("id:\t"), "id", F.lit("\ngenes:\t"), F.array_join("genes", " "), F.lit("\nsamples:\t"), F.array_join("samples", " "))
    _bics(spark, sf_dir).select("id", text.alias("value")).repartition(3, "id").select("value").write.text(path)
    got = matrix.read_truth(spark, path)
    return got.select("id", F.array_join("genes", " ").alias("genes"), F.array_join("samples", " ").alias("samples"))


@query(f"WITH {BICS} SELECT kind, CAST(CASE kind WHEN 'flat' THEN 3 WHEN 'own' THEN 7 ELSE 0 END AS INTEGER) AS run, CASE WHEN kind = 'flat' THEN 'a' END AS parameters, array_to_string(genes, ' ') AS genes, array_to_string(CASE WHEN kind = 'flat' THEN samples[1:2] ELSE samples END, ' ') AS samples FROM bics, (VALUES ('flat'), ('keyed'), ('own')) v(kind)")
def read_tool_biclusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tools")
    b = _bics(spark, sf_dir).withColumn("g", F.array_join("genes", " ")).withColumn("s", F.array_join("samples", " "))
    two = F.slice("samples", 1, 2)  # records of two numeric names look like lines of sizes
    flat = F.concat_ws("\n", F.concat_ws(" ", F.col("n_genes").cast("string"), F.size(two).cast("string")), F.when(F.col("g") != "", F.col("g")), F.when(F.size(two) > 0, F.array_join(two, " ")))
    own = F.concat(F.lit("id:\t"), "id", F.lit("\naverage SNR:\t0.5\ngenes:\t"), "g", F.lit("\nsamples:\t"), "s")
    keyed = F.concat(F.lit("Bicluster "), "id", F.lit("\nNumber_of_Genes: "), "n_genes", F.lit("\nNumber_of_Conditions: "), "n_samples", F.lit("\nGene_names: "), "g", F.lit("\nCondition_names: "), "s")
    b.groupBy().agg(F.concat(F.lit("Sample_id:1; Parameters:a; Runtime:1; Run:3\n"), F.array_join(F.collect_list(flat), "\n"))).write.text(path + "/flat")
    b.groupBy().agg(F.array_join(F.collect_list(keyed), "\n")).write.text(path + "/keyed")
    b.groupBy().agg(F.array_join(F.collect_list(own), "\n")).write.text(path + "/own_7.a.biclusters.txt")
    got = matrix.read_tool_biclusters(spark, path + "/*/part-*")
    return got.select(F.regexp_extract("file", "/(flat|keyed|own)[^/]*/", 1).alias("kind"), "run", "parameters", F.array_join("genes", " ").alias("genes"), F.array_join("samples", " ").alias("samples"))


@query("SELECT DISTINCT p_brand AS set_name, CAST(p_partkey AS VARCHAR) AS gene FROM part WHERE p_size > 10")
def read_gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, part = new_path(spark, "gmt"), table(spark, sf_dir, "part")
    part.groupBy("p_brand").agg(F.array_join(F.collect_list(F.col("p_partkey").cast("string")), "\t").alias("g")).select(F.concat_ws("\t", "p_brand", F.lit("brand"), "g", F.lit(""))).write.text(path)
    return matrix.read_gene_sets(spark, path, part.filter("p_size > 10").select(F.col("p_partkey").cast("string").alias("gene")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS sample, c_mktsegment AS segment FROM customer")
def read_clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "clinical")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("segment")).write.csv(path, sep="\t", header=True)
    spark.createDataFrame([("#a comment",), ("#another",)], "value string").coalesce(1).write.mode("append").text(path)
    return matrix.read_clinical(spark, path)


@query("SELECT CAST(vec_id AS VARCHAR) AS gene, CAST(generate_subscripts(embedding, 1) - 1 AS VARCHAR) AS sample, round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings")
def write_harmonised(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "harmonised")
    matrix.write_harmonised(fx.exprs(spark, sf_dir), path, list(range(fx.N)))
    return matrix.read_expression(spark, path).withColumn("value", R6("value"))


# cleaning


@query(f"WITH {fx.SPARSE} SELECT count(*) AS n_cells, count(DISTINCT gene) AS n_genes, count(DISTINCT sample) AS n_samples, count(*) FILTER (isnan(value)) AS n_nan, 100.0 * count(*) FILTER (isnan(value)) / count(*) AS pct_nan, count(*) FILTER (isinf(value)) AS n_inf, 100.0 * count(*) FILTER (isinf(value)) / count(*) AS pct_inf, count(*) FILTER (value = 0) AS n_zero, round(100.0 * count(*) FILTER (value = 0) / count(*), 6) AS pct_zero FROM sparse")
def bad_value_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.bad_value_census(fx.sparse(spark, sf_dir)).withColumn("pct_zero", R6("pct_zero"))


@query(f"WITH {fx.SPARSE} SELECT gene, sample, round(CASE WHEN gene % 5 = 0 THEN 0.0 ELSE value END, 6) AS value FROM sparse")
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = fx.sparse(spark, sf_dir).withColumn("value", F.when(F.col("gene") % 10 == 0, F.lit(float("nan"))).when(F.col("gene") % 5 == 0, F.lit(None)).otherwise(F.col("value")))
    return prepare.fill_missing(holes).withColumn("value", R6("value"))


@query(f"WITH {fx.SPARSE} SELECT gene, sample, round(value, 6) AS value FROM sparse WHERE gene IN (SELECT gene FROM sparse GROUP BY gene HAVING count(*) FILTER (value <> 0) > 0.05 * (SELECT count(DISTINCT sample) FROM sparse))")
def prevalence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.prevalence_filter(fx.sparse(spark, sf_dir)).withColumn("value", R6("value"))


@query("WITH m AS (SELECT p_partkey AS gene, unnest(['size', 'brand']) AS sample, unnest([CAST(p_size % 7 AS DOUBLE), CAST(length(p_brand) AS DOUBLE)]) AS value FROM part), p AS (SELECT gene, list((sample, value) ORDER BY sample) AS v FROM m GROUP BY gene) SELECT m.* FROM m WHERE gene IN (SELECT min(gene) FROM p GROUP BY v)")
def drop_duplicate_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_size") % 7).cast("double").alias("size"), F.length("p_brand").cast("double").alias("brand")).unpivot("gene", ["size", "brand"], "sample", "value")
    return prepare.drop_duplicate_profiles(m)


@query(f"WITH {fx.SPARSE} SELECT gene, sample, round(log2(value + 1), 6) AS value FROM sparse")
def log2_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.log2_transform(fx.sparse(spark, sf_dir)).withColumn("value", R6("value"))


@query(f"WITH {fx.EXPRS} SELECT gene, sample, round((value - avg(value) OVER (PARTITION BY gene)) / nullif(stddev_pop(value) OVER (PARTITION BY gene), 0), 6) AS value FROM exprs")
def zscore_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.zscore_genes(fx.exprs(spark, sf_dir)).withColumn("value", R6("value"))


@query("SELECT l_partkey AS gene, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_gene_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.duplicate_gene_check(table(spark, sf_dir, "lineitem"), "l_partkey")


@query("SELECT p_brand AS gene, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS gid FROM (SELECT DISTINCT p_brand FROM part)")
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.assign_ids(table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene")), "gene", "gid")


@query(f"WITH {fx.EXPRS} SELECT gene, count(value) AS n, round(sum(value), 6) AS s, round(sum(value * value), 6) AS ss FROM exprs GROUP BY gene")
def gene_power_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.gene_power_sums(fx.exprs(spark, sf_dir)).withColumns({"s": R6("s"), "ss": R6("ss")})


@query(f"WITH {BICS} SELECT id, CAST(avgSNR AS DOUBLE) AS avgSNR, n_genes, n_samples, direction FROM bics WHERE avgSNR >= 0.5")
def filter_by_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.filter_by_snr(_bics(spark, sf_dir), 0.5).drop("genes", "samples")


@query(f"WITH {fx.EXPRS}, c AS (SELECT sample FROM (SELECT DISTINCT sample FROM exprs) ORDER BY md5('1-' || sample) LIMIT 8) SELECT sample, CASE WHEN value < -1 THEN 0 WHEN value >= 1 THEN 11 ELSE CAST(floor((value + 1) / 0.2) AS BIGINT) + 1 END AS bin, count(*) AS n_values FROM exprs WHERE sample IN (SELECT sample FROM c) GROUP BY 1, 2")
def random_sample_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.random_sample_profiles(fx.exprs(spark, sf_dir), 8, 10, -1.0, 1.0)


# clinical tables

SEGMENTS = {"AUTOMOBILE": "auto", "BUILDING": "building", "FURNITURE": "home", "HOUSEHOLD": "home", "MACHINERY": "machine"}


def _cohorts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    one = clinical.select_rename(c.filter("c_custkey % 2 = 0"), {"c_custkey": "sample", "c_mktsegment": "segment", "c_nationkey": "nation"})
    two = clinical.select_rename(c.filter("c_custkey % 2 = 1"), {"c_custkey": "sample", "c_mktsegment": "segment"})
    return one, two


@query("SELECT c_custkey AS sample, c_mktsegment AS segment FROM customer")
def clinical_select_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clinical.select_rename(table(spark, sf_dir, "customer"), {"c_custkey": "sample", "c_mktsegment": "segment"})


@query("SELECT c_custkey AS sample, c_mktsegment AS segment, n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def clinical_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = clinical.select_rename(table(spark, sf_dir, "customer"), {"c_custkey": "sample", "c_mktsegment": "segment"})
    return clinical.combine(left, table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sample")).agg(F.count("*").alias("n_orders")))


@query("SELECT c_custkey AS sample, CASE WHEN c_custkey % 3 = 0 THEN 'NA' ELSE c_mktsegment END AS segment FROM customer")
def clinical_fill_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    return clinical.fill_na(rows, ["segment"])


@query("SELECT c_custkey AS sample, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'auto' WHEN 'BUILDING' THEN 'building' WHEN 'FURNITURE' THEN 'home' WHEN 'HOUSEHOLD' THEN 'home' WHEN 'MACHINERY' THEN 'machine' END AS segment FROM customer")
def clinical_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample"), F.concat(F.lit("SEG_"), "c_mktsegment").alias("segment"))
    return clinical.recode(rows, "segment", SEGMENTS, strip="^SEG_")


@query("SELECT 'one' AS cohort, variable, array_to_string(list_sort(list(DISTINCT value)), ',') AS domain FROM (SELECT unnest(['segment', 'nation']) AS variable, unnest([c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS value FROM customer WHERE c_custkey % 2 = 0) GROUP BY variable")
def clinical_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, _ = _cohorts(spark, sf_dir)
    return clinical.domains(one.withColumn("nation", F.col("nation").cast("string")), ["segment", "nation"], "one").withColumn("domain", F.array_join("domain", ","))


@query("SELECT c_custkey AS sample, c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS nation, CASE WHEN c_custkey % 2 = 0 THEN 'one' ELSE 'two' END AS cohort FROM customer")
def clinical_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = _cohorts(spark, sf_dir)
    return clinical.stack({"one": one, "two": two})


# sets


@query(f"WITH {fx.EXPRS}, {fx.EDGES}, m AS (SELECT * FROM exprs WHERE gene IN (SELECT vec_id FROM embeddings WHERE label <> 3)), k AS (SELECT * FROM edges WHERE g1 IN (SELECT gene FROM m) AND g2 IN (SELECT gene FROM m)), ends AS (SELECT g1 AS gene FROM k UNION SELECT g2 FROM k) SELECT gene, count(*) AS n_values, (SELECT count(*) FROM k) AS n_edges FROM m WHERE gene IN (SELECT gene FROM ends) GROUP BY gene")
def restrict_to_shared_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, m = sets.restrict_to_shared_genes(network.canonical_edges(fx.vector_edges(spark, sf_dir)), fx.exprs(spark, sf_dir).join(table(spark, sf_dir, "embeddings").filter("label <> 3").select(F.col("vec_id").alias("gene")), "gene", "left_semi"))
    return m.groupBy("gene").agg(F.count("*").alias("n_values")).join(F.broadcast(edges.agg(F.count("*").alias("n_edges"))))


@query("SELECT gene FROM (SELECT DISTINCT l_partkey AS gene, 1 AS t FROM lineitem WHERE l_quantity > 30 UNION ALL SELECT DISTINCT p_partkey, 2 FROM part WHERE p_size > 20 UNION ALL SELECT DISTINCT l_partkey, 3 FROM lineitem WHERE l_discount > 0.05) GROUP BY gene HAVING count(*) >= 2")
def common_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem").withColumn("gene", F.col("l_partkey")), table(spark, sf_dir, "part").withColumn("gene", F.col("p_partkey"))
    return sets.common([line.filter("l_quantity > 30"), part.filter("p_size > 20"), line.filter("l_discount > 0.05")], "gene", 2)


@query("SELECT s.sample FROM (SELECT DISTINCT l_suppkey AS sample FROM lineitem WHERE l_quantity > 49 UNION SELECT DISTINCT l_suppkey FROM lineitem WHERE l_discount > 0.09) s WHERE s.sample IN (SELECT s_suppkey FROM supplier WHERE s_nationkey > 5)")
def common_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").withColumn("sample", F.col("l_suppkey"))
    platforms = line.filter("l_quantity > 49").select("sample").union(line.filter("l_discount > 0.09").select("sample"))
    return sets.common([platforms, table(spark, sf_dir, "supplier").filter("s_nationkey > 5").select(F.col("s_suppkey").alias("sample"))], "sample")


@query(f"WITH {fx.bic_genes_sql('bg')}, {fx.bic_samples_sql('bs', 'bg')} SELECT i.id, CAST(s.sample AS INTEGER) AS sample FROM (SELECT DISTINCT id FROM bs) i, (SELECT unnest(range(0, 64)) AS sample) s WHERE NOT EXISTS (SELECT 1 FROM bs WHERE bs.id = i.id AND bs.sample = s.sample)")
def set_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.complement(fx.bic_samples(spark, sf_dir), "id", fx.exprs(spark, sf_dir).select("sample"))


# networks

COMP = f"{fx.REGION_EDGES}, und AS (SELECT g1, g2 FROM edges UNION ALL SELECT g2, g1 FROM edges), comp AS (SELECT gene, (SELECT min(g) FROM (SELECT CAST(-1 - n_nationkey AS BIGINT) AS g, n_regionkey AS r FROM nation UNION ALL SELECT -1000 - n_regionkey, n_regionkey FROM nation) WHERE r = region) AS component FROM (SELECT DISTINCT g1 AS gene, n_regionkey AS region FROM und, nation WHERE CASE WHEN g1 >= 0 THEN g2 = -1 - n_nationkey WHEN g1 > -1000 THEN g1 = -1 - n_nationkey ELSE g1 = -1000 - n_regionkey END))"


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.canonical_edges(fx.region_edges(spark, sf_dir))


@query(f"WITH {fx.EDGES} SELECT g1, g2 FROM edges")
def canonical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.canonical_edges(fx.vector_edges(spark, sf_dir))


@query(f"WITH {COMP} SELECT * FROM comp")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.components(_regions(spark, sf_dir))


@query(f"WITH {COMP} SELECT g1, g2 FROM edges JOIN comp ON gene = g1 WHERE component IN (SELECT component FROM comp GROUP BY 1 HAVING count(*) >= 300)")
def drop_small_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.drop_small_components(_regions(spark, sf_dir), 300)


@query(f"WITH {COMP}, per AS (SELECT component, count(*) AS n_nodes FROM comp GROUP BY 1), pe AS (SELECT component, count(*) AS n_edges FROM edges JOIN comp ON gene = g1 GROUP BY 1) SELECT component, n_nodes, n_edges FROM per JOIN pe USING (component) UNION ALL SELECT NULL, (SELECT count(*) FROM comp), (SELECT count(*) FROM edges)")
def network_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.network_stats(_regions(spark, sf_dir))


@query(f"WITH {fx.PART_EDGES}, d AS (SELECT gene, count(*) AS degree FROM (SELECT g1 AS gene FROM part_edges UNION ALL SELECT g2 FROM part_edges) GROUP BY 1) SELECT degree, count(*) AS n_genes FROM d GROUP BY 1")
def degree_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.degree_distribution(fx.part_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {fx.EDGES}, mem AS (SELECT CAST((vec_id // 10) % 40 AS INTEGER) AS module, vec_id AS gene FROM embeddings), und AS (SELECT a.module, g1, g2 FROM edges JOIN mem a ON a.gene = g1 JOIN mem b ON b.gene = g2 AND a.module = b.module UNION ALL SELECT a.module, g2, g1 FROM edges JOIN mem a ON a.gene = g1 JOIN mem b ON b.gene = g2 AND a.module = b.module), reach(m, a, b) AS (SELECT module, gene, gene FROM mem UNION SELECT r.m, r.a, u.g2 FROM reach r JOIN und u ON u.module = r.m AND r.b = u.g1), low AS (SELECT m, a, min(b) AS c FROM reach GROUP BY 1, 2) SELECT m AS module, count(*) AS n_genes, count(DISTINCT c) = 1 AS connected FROM low GROUP BY m")
def module_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "embeddings").select((F.floor(F.col("vec_id") / 10) % 40).cast("int").alias("module"), F.col("vec_id").alias("gene"))
    return network.module_connectivity(network.canonical_edges(fx.vector_edges(spark, sf_dir)), members)


@query("WITH s AS (SELECT l_partkey AS gene, list_sort(list(DISTINCT CAST(l_quantity AS INTEGER) % 3)) AS m FROM lineitem GROUP BY 1) SELECT array_to_string(m, ',') AS modules, CAST(len(m) AS INTEGER) AS n_modules, count(*) AS n_genes FROM s GROUP BY m")
def membership_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gene"), (F.col("l_quantity").cast("int") % 3).alias("module"))
    return network.membership_groups(members).withColumn("modules", F.array_join("modules", ","))
