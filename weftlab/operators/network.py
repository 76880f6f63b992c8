"""Operators on undirected gene networks (g1, g2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlab.operators.components import connected_components
from weftlab.session import materialise


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Simple undirected edges: g1 < g2, distinct, no self-loops."""
    return edges.select(F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2")).filter("g1 <> g2").distinct()


def incidence(edges: DataFrame, *more: str) -> DataFrame:
    """(gene, ...): a row per end of each edge."""
    return edges.select(F.col("g1").alias("gene"), *more).union(edges.select(F.col("g2").alias("gene"), *more))


def components(edges: DataFrame) -> DataFrame:
    """(gene, component), the component named by its smallest gene."""
    return connected_components(edges, "g1", "g2").withColumnRenamed("node", "gene")


#: Up to so many genes components are told from smaller ones without finding all of them.
NEAR = 6


def drop_small_components(edges: DataFrame, k: int = 3) -> DataFrame:
    """Edges of components with at least k genes. For k over NEAR all components are found; below, only those of fewer than k genes are."""
    if k <= NEAR:
        return edges.join(_in_large(edges, k).select(F.col("gene").alias("g1")), "g1", "left_semi")
    of = components(edges)
    large = of.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    return edges.join(of.join(large, "component", "left_semi").select(F.col("gene").alias("g1")), "g1", "left_semi")


def _in_large(edges: DataFrame, k: int) -> DataFrame:
    """(gene) in components of at least k genes.

    Fewer than k genes are at most k - 2 edges apart, so the smallest gene within so many edges names such a component. Genes of one name are
    a whole component if none has a neighbour of another name, and genes of a larger one that share a name always have one, or are k or more.
    """
    given = edges.filter(F.col("g1").isNotNull() & F.col("g2").isNotNull() & (F.col("g1") != F.col("g2")))
    both = materialise(incidence(given, "g1", "g2").select("gene", F.when(F.col("gene") == F.col("g1"), F.col("g2")).otherwise(F.col("g1")).alias("nbr")).distinct(), "both-ways")
    names = both.groupBy("gene").agg(F.least("gene", F.min("nbr")).alias("name"))

    def near(names: DataFrame) -> DataFrame:
        """(gene, low, high): the smallest and largest name of each gene's neighbours."""
        return both.join(names.select(F.col("gene").alias("nbr"), "name"), "nbr").groupBy("gene").agg(F.min("name").alias("low"), F.max("name").alias("high"))

    for _ in range(k - 3):
        names = materialise(names, "names")
        names = names.join(near(names), "gene").select("gene", F.least("name", "low").alias("name"))
    names = materialise(names, "names")
    told = names.join(near(names), "gene").withColumn("open", (F.col("low") != F.col("name")) | (F.col("high") != F.col("name")))
    small = told.groupBy("name").agg(F.count("*").alias("n"), F.bool_or("open").alias("open")).filter((F.col("n") < k) & ~F.col("open"))
    return names.join(small, "name", "left_anti").select("gene")


def network_stats(edges: DataFrame) -> DataFrame:
    """(component, n_nodes, n_edges) per component, and a row with component null for the whole network."""
    of = components(edges)
    nodes = of.groupBy("component").agg(F.count("*").alias("n_nodes"))
    per = edges.join(of.withColumnRenamed("gene", "g1"), "g1").groupBy("component").agg(F.count("*").alias("n_edges"))
    parts = nodes.join(per, "component")
    whole = parts.agg(F.lit(None).cast("long").alias("component"), F.sum("n_nodes").alias("n_nodes"), F.sum("n_edges").alias("n_edges"))
    return parts.unionByName(whole)


def degrees(edges: DataFrame) -> DataFrame:
    """(gene, degree)."""
    return incidence(edges).groupBy("gene").agg(F.count("*").alias("degree"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    """(degree, n_genes)."""
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("n_genes"))


def module_connectivity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(module, n_genes, connected): does each gene set form one connected subgraph. members: module, gene."""
    a, b = members.select("module", F.col("gene").alias("g1")), members.select("module", F.col("gene").alias("g2"))
    inside = edges.join(a, "g1").join(b, ["module", "g2"])
    node = lambda g: F.struct(F.col("module"), F.col(g).alias("gene"))
    parts = connected_components(inside.select(node("g1").alias("u"), node("g2").alias("v")))
    named = members.distinct().withColumn("node", F.struct("module", "gene")).join(parts, "node", "left")
    return named.groupBy("module").agg(F.count("*").alias("n_genes"), (F.countDistinct(F.coalesce("component", "node")) == 1).alias("connected"))


def membership_groups(members: DataFrame) -> DataFrame:
    """(modules, n_modules, n_genes): genes grouped by the exact set of modules they are in."""
    sets = members.groupBy("gene").agg(F.array_sort(F.collect_set("module")).alias("modules"))
    return sets.groupBy("modules").agg(F.size(F.first("modules")).alias("n_modules"), F.count("*").alias("n_genes"))
