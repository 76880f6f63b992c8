"""The given tables in the shapes of the domain, as DataFrames and as SQL common table expressions of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlab.session import table

#: Samples per vector.
N = 64
#: Lines of a task in part_edges.
LINES = 250_000


def exprs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene = vec_id, sample = position, value."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gene"), F.posexplode("embedding").alias("sample", "value"))
    return rows.withColumn("value", F.col("value").cast("double"))


EXPRS = "exprs AS (SELECT vec_id AS gene, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS sample, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"


def wide_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other way round: gene = position, sample = vec_id."""
    return exprs(spark, sf_dir).select(F.col("sample").alias("gene"), F.col("gene").alias("sample"), "value")


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene = l_partkey, sample = l_suppkey, value = avg quantity; quantities under 10 count as zero."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("sample")).agg(F.avg("l_quantity").cast("double").alias("value"))
    return rows.withColumn("value", F.when(F.col("value") < 10, 0.0).otherwise(F.col("value")))


SPARSE = "sparse AS (SELECT gene, sample, CASE WHEN value < 10 THEN 0.0 ELSE value END AS value FROM (SELECT l_partkey AS gene, l_suppkey AS sample, CAST(avg(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2))"


def vector_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, 7v+1 mod n) and (v, v+1) over vec_id, not yet canonical."""
    e = table(spark, sf_dir, "embeddings")
    v = e.select("vec_id", F.lit(e.count()).cast("long").alias("n"))
    return v.select(F.col("vec_id").alias("g1"), F.explode(F.array((F.col("vec_id") * 7 + 1) % F.col("n"), F.col("vec_id") + 1)).alias("g2")).filter(F.col("g2") < F.lit(e.count()))


RAW_EDGES = "raw_edges AS (SELECT vec_id AS g1, g2 FROM (SELECT vec_id, unnest([(vec_id * 7 + 1) % (SELECT count(*) FROM embeddings), vec_id + 1]) AS g2 FROM embeddings) WHERE g2 < (SELECT count(*) FROM embeddings))"
EDGES = RAW_EDGES + ", edges AS (SELECT DISTINCT least(g1, g2) AS g1, greatest(g1, g2) AS g2 FROM raw_edges WHERE g1 <> g2)"


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts bought in one order (each order is a handful of lines). Tasks take about LINES lines each, and the pairs of as many."""
    rows = table(spark, sf_dir, "lineitem")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // LINES))
    lines = rows.select("l_orderkey", "l_partkey").repartition(tasks, "l_orderkey").distinct()
    other = lines.withColumnRenamed("l_partkey", "g2")
    pairs = lines.join(other, "l_orderkey").filter("l_partkey < g2").select(F.col("l_partkey").alias("g1"), "g2")
    return pairs.repartition(tasks, "g1", "g2").distinct()


PART_EDGES = "part_edges AS (SELECT DISTINCT a.l_partkey AS g1, b.l_partkey AS g2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"


def bic_genes(spark: SparkSession, sf_dir: str, k: int = 25, shift: int = 0) -> DataFrame:
    """(id, gene): the genes whose number plus shift, and half of it, leave the remainder id."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gene"))
    both = F.explode(F.array_distinct(F.array(((F.col("gene") + shift) % k).cast("int"), (F.floor((F.col("gene") + shift) / 2) % k).cast("int"))))
    return v.select(both.alias("id"), "gene")


def bic_genes_sql(name: str, k: int = 25, shift: int = 0) -> str:
    return f"{name} AS (SELECT DISTINCT CAST(unnest([(vec_id + {shift}) % {k}, ((vec_id + {shift}) // 2) % {k}]) AS INTEGER) AS id, vec_id AS gene FROM embeddings)"


def bic_samples(spark: SparkSession, sf_dir: str, k: int = 25, shift: int = 0, twin: int | None = None) -> DataFrame:
    """(id, sample): samples whose product rule with the id is small; twin: ids with one remainder by it have one set."""
    ids = bic_genes(spark, sf_dir, k, shift).select("id").distinct()
    s = F.explode(F.sequence(F.lit(0), F.lit(N - 1)))
    return ids.withColumn("sample", s).filter(f"(sample * (id{f' % {twin}' if twin else ''} + 3) + {shift}) % 17 < 6")


def bic_samples_sql(name: str, genes: str, shift: int = 0, twin: int | None = None) -> str:
    return f"{name} AS (SELECT id, CAST(sample AS INTEGER) AS sample FROM (SELECT id, unnest(range(0, {N})) AS sample FROM (SELECT DISTINCT id FROM {genes})) WHERE (sample * (id{f' % {twin}' if twin else ''} + 3) + {shift}) % 17 < 6)"


def directions(ids: DataFrame) -> DataFrame:
    """id with direction: UP for even ids, DOWN for odd."""
    return ids.withColumn("direction", F.when(F.col("id") % 2 == 0, "UP").otherwise("DOWN"))


DIRECTION = "CASE WHEN id % 2 = 0 THEN 'UP' ELSE 'DOWN' END"


def region_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers linked with their nation, nations with their region: one component per region."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("g1"), (F.lit(-1) - F.col("c_nationkey")).cast("long").alias("g2"))
    n = table(spark, sf_dir, "nation").select((F.lit(-1) - F.col("n_nationkey")).cast("long").alias("g1"), (F.lit(-1000) - F.col("n_regionkey")).cast("long").alias("g2"))
    return c.union(n)


REGION_EDGES = "edges AS (SELECT least(g1, g2) AS g1, greatest(g1, g2) AS g2 FROM (SELECT CAST(c_custkey AS BIGINT) AS g1, CAST(-1 - c_nationkey AS BIGINT) AS g2 FROM customer UNION SELECT -1 - n_nationkey, -1000 - n_regionkey FROM nation))"


def edge_ids(edges: DataFrame) -> DataFrame:
    """edges with a number eid."""
    return edges.withColumn("eid", F.col("g1") * 1000003 + F.col("g2"))


EID = "g1 * 1000003 + g2 AS eid"
