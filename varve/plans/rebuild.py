"""Tables that readers of the catalogue use, written as whole tables: scores, specifications, the text index, compacted files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.operators import specs, textsearch
from varve.staging import put_file, read_file, stage

#: Files are compacted where more than this share of them is under half of the size aimed at.
MOST_SMALL = 0.15
FILE_BYTES = 128 << 20


def merged_scores(before: DataFrame, scored: DataFrame) -> DataFrame:
    """The rows of a scoring run, and those of before that it hasn't, no longer active. One exchange on product_id."""
    gone = before.join(scored.select("product_id"), "product_id", "left_anti").withColumn("is_active", F.lit(False))
    return scored.unionByName(gone.select(scored.columns))


def write_scores(before: DataFrame, scored: DataFrame, path: str) -> DataFrame:
    """merged_scores at path, which before isn't read from; ordered by category, so that a listing reads few files. The run is computed once."""
    merged = stage(merged_scores(before, scored), "scores")  # dealing out by range reads its input twice
    merged.repartitionByRange("category", "product_id").sortWithinPartitions("category", F.desc("score")).write.mode("overwrite").parquet(path)
    return before.sparkSession.read.schema(merged.schema).parquet(path)


def write_specs(extracted: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The index of specifications and the distributions, both at path. The text is searched once: distributions are
    taken of the index as written."""
    spark = extracted.sparkSession
    stage(extracted, "specs").repartitionByRange("family", "value", "product_id").sortWithinPartitions("family", "value").write.mode("overwrite").parquet(f"{path}/index")
    index = spark.read.schema(extracted.schema).parquet(f"{path}/index")
    shares = specs.distributions(index)
    shares.write.mode("overwrite").parquet(f"{path}/distributions")
    return index, spark.read.schema(shares.schema).parquet(f"{path}/distributions")


def write_text_index(docs: DataFrame, doc: str, columns: list[str], path: str) -> tuple[DataFrame, DataFrame]:
    """Postings and statistics of the documents, at path, as match() and search() take them."""
    spark = docs.sparkSession
    index = stage(textsearch.postings(docs, doc, columns), "postings")  # dealing out by range reads its input twice
    stats = textsearch.totals(docs, index)
    textsearch.write_index(index, f"{path}/postings")
    stats.write.mode("overwrite").parquet(f"{path}/statistics")
    return spark.read.schema(index.schema).parquet(f"{path}/postings"), spark.read.schema(stats.schema).parquet(f"{path}/statistics")


def _files(rows: DataFrame) -> list[tuple[str, int]]:
    """Names and sizes of the files that rows are read from, in the order of their names, in which Spark's writers number them. One row
    a file after the first exchange."""
    files = rows.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.first("file_size").alias("size"))
    return sorted(map(tuple, files.collect()))


def bins(sizes: list[int], file_bytes: int) -> list[list[int]]:
    """Neighbours that together have at most file_bytes, as far as each goes."""
    out: list[list[int]] = []
    have = 0
    for k, size in enumerate(sizes):
        if out and have + size <= file_bytes:
            out[-1].append(k)
            have += size
        else:
            out.append([k])
            have = size
    return out


def compacted(spark: SparkSession, source: str, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The Parquet table at source with its small files merged, if too many are small; else as it is.

    Files are merged with their neighbours only, and their rows keep their order, so that a table that is sorted over its
    files stays so, and a filter skips as many files as before. Files that have no small neighbour aren't touched. Merged
    files lie under path, and path/_table.json, which is put in place last, names all files of the table (see read_compacted)."""
    rows = spark.read.parquet(source)
    files = _files(rows)
    small = sum(2 * size < file_bytes for _, size in files)
    packed = bins([size for _, size in files], file_bytes)
    if small <= len(files) * MOST_SMALL or len(packed) == len(files):
        return rows
    many = [(files[k][0], b, k) for b, group in enumerate(packed) if len(group) > 1 for k in group]
    place = spark.createDataFrame(many, "_file string, _bin int, _order int")
    order = ["_bin", "_order", "_row"]
    # a row a file, as Spark lists files on the driver anyway; only the files that are merged are read
    read = spark.read.schema(rows.schema).parquet(*(name for name, _, _ in many)).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    dealt = read.join(F.broadcast(place), "_file").drop("_file").repartition(len({b for _, b, _ in many}), "_bin").sortWithinPartitions(*order)
    dealt.drop("_order", "_row").write.partitionBy("_bin").parquet(path)
    kept = [files[group[0]][0] for group in packed if len(group) == 1]
    put_file(spark, f"{path.rstrip('/')}/_table.json", json.dumps({"schema": rows.schema.json(), "kept": kept}))
    return read_compacted(spark, path)


def read_compacted(spark: SparkSession, path: str) -> DataFrame:
    """The table that compacted() put at path."""
    from pyspark.sql.types import StructType

    table = json.loads(read_file(spark, f"{path.rstrip('/')}/_table.json"))
    schema = StructType.fromJson(json.loads(table["schema"]))
    merged = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/_bin=*")
    return merged.unionByName(spark.read.schema(schema).parquet(*table["kept"])) if table["kept"] else merged
