"""Reading and writing matrices, edge lists, biclusters, gene sets and annotations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlab.functions.ordering import numbered

#: A bicluster table as written to text.
BICLUSTERS = "id int, avgSNR double, n_genes int, n_samples int, direction string, genes array<string>, samples array<string>"


def _read_wide(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(keys..., sample, value) of TSV lines under a header, whose first fields are the keys. Lines become arrays that are exploded against the
    header's names, so the plan has no column per sample and a line may have any number of fields.

    Each file of a folder may repeat the header. Quotes around a field are taken off; fields hold no tabs. Blank lines are skipped, missing cells and
    cells that are no number are null, cells beyond the header are left out. Without lines the table is empty."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    first = lines.head()
    if first is None:
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in keys) + ", sample string, value double")
    fields = lambda line: F.transform(F.split(line, "\t", -1), lambda x: F.regexp_replace(x, '^"(.*)"$', "$1"))
    rest = lambda a: F.slice(a, len(keys) + 1, F.greatest(F.size(a) - len(keys), F.lit(0)))
    rows = lines.filter(F.col("value") != first["value"]).select(fields(F.col("value")).alias("cells"))
    named = [F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(k) for i, k in enumerate(keys)]
    cells = rows.select(*named, F.explode(F.arrays_zip(rest(fields(F.lit(first["value"]))).alias("sample"), rest(F.col("cells")).alias("cell"))).alias("x"))
    return cells.filter("x.sample is not null").select(*keys, F.col("x.sample").alias("sample"), F.col("x.cell").try_cast("double").alias("value"))


def _write_wide(long: DataFrame, row: str, column: str, value: str, names: list, path: str) -> None:
    """TSV lines of one row each with a cell per name, in the order of names, under a header; every file has it. Rows of other names are left out,
    missing and null cells are empty, of cells that repeat the smallest is written.

    A line is joined from its sorted cells and the tabs between their places, without a plan column per name."""
    spark = long.sparkSession
    places = spark.createDataFrame([(str(n), i) for i, n in enumerate(names)], "name string, place int")
    cells = long.select(F.col(row).alias("row"), F.col(column).cast("string").alias("name"), F.col(value).alias("cell")).join(places, "name").groupBy("row", "place").agg(F.min("cell").alias("cell"))
    lines = cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce(F.col("cell").cast("string"), F.lit("")).alias("cell")))).alias("cells"))
    at = F.col("cells")
    cell = F.transform(at, lambda x, i: F.concat(F.repeat(F.lit("\t"), x["place"] - F.coalesce(F.get(at, i - 1)["place"], F.lit(-1))), x["cell"]))
    line = F.concat(F.coalesce(F.col("row").cast("string"), F.lit("")), F.array_join(cell, ""), F.repeat(F.lit("\t"), len(names) - 1 - F.element_at(at, -1)["place"]))
    header = "\t".join([row, *map(str, names)])
    lines.select(line.alias(header)).write.csv(path, sep="\x01", quote="", header=True)


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    """(gene, sample, value) of a TSV matrix, genes as rows, first column the gene. Names are text; cells that are no number are null."""
    return _read_wide(spark, path, ["gene"])


def read_expression_two_key(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, entrez, sample, value) of a TSV matrix with two key columns."""
    return _read_wide(spark, path, ["symbol", "entrez"])


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """(g1, g2): first two fields of each line, split at tabs, or at blanks where a line has no tab. Lines with one field are dropped."""
    line = spark.read.text(path).select(F.trim("value").alias("v"))
    parts = line.select(F.when(F.col("v").contains("\t"), F.split("v", "\t")).otherwise(F.split("v", " +")).alias("p"))
    return parts.filter(F.size("p") >= 2).select(F.col("p")[0].alias("g1"), F.col("p")[1].alias("g2"))


def read_cx_network(spark: SparkSession, path: str) -> DataFrame:
    """(g1, g2) by node name, of a network given as JSON aspects: nodes (@id, n) and edges (s, t)."""
    schema = "nodes array<struct<`@id`: long, n: string>>, edges array<struct<s: long, t: long>>"
    aspects = spark.read.schema(schema).json(path, multiLine=True)
    nodes = aspects.select(F.explode("nodes").alias("x")).select(F.col("x.@id").alias("node"), F.col("x.n").alias("name"))
    edges = aspects.select(F.explode("edges").alias("x")).select("x.s", "x.t")
    return edges.join(nodes.toDF("s", "g1"), "s").join(nodes.toDF("t", "g2"), "t").select("g1", "g2")


def bicluster_order(bics: DataFrame) -> DataFrame:
    """bics with ids 0.. by avgSNR, n_genes, n_samples, all descending, then the old id."""
    placed = numbered(bics, [F.desc("avgSNR"), F.desc("n_genes"), F.desc("n_samples"), F.asc("id")], "__nth")
    return placed.withColumn("id", F.col("__nth").cast("int")).drop("__nth")


def write_biclusters(bics: DataFrame, path: str) -> None:
    """TSV with blank-joined sets, in bicluster_order."""
    flat = bicluster_order(bics).select("id", "avgSNR", "n_genes", "n_samples", "direction", F.array_join(F.array_sort("genes"), " ").alias("genes"), F.array_join(F.array_sort("samples"), " ").alias("samples"))
    flat.orderBy("id").write.csv(path, sep="\t", header=True)


def read_biclusters(spark: SparkSession, path: str) -> DataFrame:
    """The table back, text to sets; a missing or empty file gives an empty table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], BICLUSTERS)
    flat = spark.read.schema("id int, avgSNR double, n_genes int, n_samples int, direction string, genes string, samples string").csv(path, sep="\t", header=True)
    return flat.withColumn("genes", F.split("genes", " ")).withColumn("samples", F.split("samples", " "))


def edge_samples_snapshot(edge_samples: DataFrame | None, folder: str, spark: SparkSession, direction: str, p_val: float, q: float, min_n_samples: int, force: bool = False) -> DataFrame:
    """Edges with their samples, saved under a path of the settings; reused when it is there unless force."""
    path = f"{folder}/direction={direction}/p={p_val}/q={q}/min={min_n_samples}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if edge_samples is not None and (force or not there):
        edge_samples.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of small text files, in order."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return text.select("file", F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\r?\n")).alias("pos", "line"))


def _words(c) -> Column:
    return F.filter(F.split(F.trim(c), "[ \t]+"), lambda x: x != "")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(id, genes, samples) from lines `id:`, `genes:`, `samples:`, three per bicluster."""
    line = _lines(spark, path).withColumn("rec", F.floor(F.col("pos") / 3)).withColumn("key", F.regexp_extract("line", r"^(\w+):", 1)).withColumn("rest", F.regexp_replace("line", r"^\w+:", ""))
    of = lambda k: F.max(F.when(F.col("key") == k, F.col("rest")))
    got = line.groupBy("file", "rec").agg(of("id").alias("id"), of("genes").alias("genes"), of("samples").alias("samples"))
    return got.select(F.trim("id").cast("int").alias("id"), _words("genes").alias("genes"), _words("samples").alias("samples"))


#: Rows of read_tool_biclusters.
TOOL_ROWS = "file string, run int, parameters string, id int, avgSNR double, genes array<string>, samples array<string>"


def _flat_records(lines: list[str]) -> Iterator[tuple]:
    """Header lines name the run; a record is a line of two sizes and the lines of its sets that are not empty, by the sizes promised."""
    run, params, nth, rest = 0, None, 0, iter([x for x in lines if x.strip()])
    for line in rest:
        if "Run:" in line:
            run, nth = int(re.search(r"Run:\s*(\d+)", line)[1]), 0
            named = re.search(r"Parameters:\s*([^;]*)", line)
            params = named[1].strip() if named else None
            continue
        sizes = [int(x) for x in line.split()]
        genes, samples = (next(rest, "").split() if n else [] for n in sizes)
        nth += 1
        yield run, params, nth, None, sorted(set(genes)), sorted(set(samples))


def _named_records(lines: list[str], file: str) -> Iterator[tuple]:
    """Records of lines with a name before a colon; one ends with its line of samples. The run is a number in the path, or 0."""
    at = re.search(r"_(\d+)(?:/Results_biclustering/|\.[^/]*biclusters\.txt)", file)
    run, found = int(at[1]) if at else 0, {}
    for line in lines:
        name, _, value = line.strip().partition(":")
        if name.startswith("Bicluster"):
            found = {"id": name.removeprefix("Bicluster").strip() or value.strip()}
        elif name:
            found = {} if name == "id" else found
            found[name.lower().replace("condition_names", "samples").replace("gene_names", "genes")] = value.strip()
        if name in ("samples", "Condition_names"):
            snr = found.get("average snr")
            yield run, None, int(found.get("id") or 0), float(snr) if snr else None, sorted(set(found.get("genes", "").split())), sorted(set(found["samples"].split()))
            found = {}


def read_tool_biclusters(spark: SparkSession, path: str, n_runs: int | None = None) -> DataFrame:
    """TOOL_ROWS of result files of this and other tools, told apart by their first line; each file is one run or a few.

    Flat files: a header line with `Parameters:p` and `Run:k`, then per bicluster a line of two sizes and a line each for genes and samples, without
    the lines of empty sets; ids count from 1 per run. Named files: `Bicluster`, `Gene_names:` and `Condition_names:` lines, or `id:`, `average
    SNR:`, `genes:` and `samples:` lines. n_runs: runs 1 to n_runs that a file of its kind lacks come as a row with id 0 and empty sets, for
    flat files per file and for named ones per path without its number. Empty files have no rows.
    """
    names = [c.split()[0] for c in TOOL_ROWS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                lines = text.splitlines()
                first = next((x for x in lines if x.strip()), "")
                rows = _flat_records(lines) if "Run:" in first else _named_records(lines, file)
                yield pd.DataFrame([(file, *r) for r in rows], columns=names)

    got = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").mapInPandas(run, TOOL_ROWS)
    if n_runs is None:
        return got
    source = F.regexp_replace("file", r"_\d+(?=/Results_biclustering/|\.[^/]*biclusters\.txt)", "_*")
    there = got.select(source.alias("source"), "file", "run").groupBy("source", "run").agg(F.min("file").alias("file"))
    every = there.groupBy("source").agg(F.min("file").alias("file")).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(n_runs))))
    empty = F.array().cast("array<string>")
    return got.unionByName(every.join(there.select("source", "run"), ["source", "run"], "left_anti").select("file", "run", F.lit(None).cast("string").alias("parameters"), F.lit(0).alias("id"), F.lit(None).cast("double").alias("avgSNR"), empty.alias("genes"), empty.alias("samples")))


def read_gene_sets(spark: SparkSession, path: str, background: DataFrame | None = None) -> DataFrame:
    """(set_name, gene) of a GMT file; blank names dropped; only genes of background, if given."""
    part = spark.read.text(path).select(F.split("value", "\t").alias("p")).filter(F.size("p") > 2)
    rows = part.select(F.col("p")[0].alias("set_name"), F.explode(F.slice("p", F.lit(3), F.size("p"))).alias("gene")).select("set_name", F.trim("gene").alias("gene")).filter("gene <> ''").distinct()
    return rows if background is None else rows.join(background.select("gene").distinct(), "gene", "left_semi").select("set_name", "gene")


def read_clinical(spark: SparkSession, path: str) -> DataFrame:
    """A TSV with # comments, one row per sample."""
    return spark.read.csv(path, sep="\t", header=True, comment="#")


def write_harmonised(m: DataFrame, path: str, samples: list | None = None) -> None:
    """Long Parquet by default; with the list of samples a wide TSV, genes as rows."""
    if samples is None:
        m.write.parquet(path)
        return
    _write_wide(m, "gene", "sample", "value", samples, path)


def write_annotation(table: DataFrame, path: str, key: str = "sample", columns: list | None = None) -> None:
    """One row per sample; with the list of samples transposed, one row per variable."""
    if columns is None:
        table.write.csv(path, sep="\t", header=True)
        return
    variables = [c for c in table.columns if c != key]
    long = table.select(key, *[F.col(v).cast("string") for v in variables]).unpivot([key], variables, "variable", "value")
    _write_wide(long, "variable", key, "value", columns, path)
