"""Jobs over folders: Markdown to chunk files, chunk files to indexes with their report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import dense, graph
from quillon.operators.chunking import chunk_stats, standard_chunks
from quillon.sources.files import embed, read_chunks, read_markdown, save_index

#: Kinds of index: exact search by blocks, inverted lists, those with product codes, and layered graphs.
KINDS = ("flat", "ivf", "ivfpq", "hnsw")


def chunk_folder(spark: SparkSession, folder: str, out: str, pairs: Sequence[tuple[int, int]] = ((1024, 50),), overrides: DataFrame | None = None) -> DataFrame:
    """Chunk the *.md files of folder by every pair into JSON lines, a folder of out for each pair; returns counts and lengths by pair."""
    chunks = standard_chunks(read_markdown(spark, folder), pairs, overrides)
    name = F.format_string("all_cs%d_ov%d", "chunk_size", "overlap")
    chunks.withColumn("experiment", name).write.mode("overwrite").partitionBy("experiment").json(out)
    written = spark.read.schema(chunks.schema).json(out)
    return chunk_stats(written, "chunk_size", "overlap").join(written.groupBy("chunk_size", "overlap").agg(F.count_distinct("doc_id").alias("doc_count")), ["chunk_size", "overlap"])


def build_index(vectors: DataFrame, kind: str) -> DataFrame:
    """vectors (key, vector, ...) with what the kind of index adds: list_id, and codes; of graphs a row for each block."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of index {kind}")
    if kind == "flat":
        return vectors
    if kind == "hnsw":
        return graph.graph_index(vectors.select("key", "vector"))
    side = vectors.select("key", "vector")
    out = dense.assign(vectors, dense.train_centres(side, dense.list_count(side.count())))
    return out.join(dense.encode_codes(side, dense.train_codebooks(side)).select("key", "codes"), "key") if kind == "ivfpq" else out


def index_report(indexed: DataFrame, kind: str) -> DataFrame:
    """One row: the kind, vectors, dimension, lists (of graphs: blocks), and the vectors' size in MB, with the edges'."""
    if "layers" in indexed.columns:
        n, numbers = F.sum(F.size("ids")), F.sum(4 * F.size("flat") + 4 * F.aggregate("layers", F.lit(0), lambda s, x: s + F.size(x["edges"])))
        return indexed.agg(F.lit(kind).alias("kind"), F.coalesce(n, F.lit(0)).alias("vectors"), F.coalesce(F.max(F.size("flat") / F.size("ids")), F.lit(0)).cast("int").alias("dim"), F.count("*").alias("lists"), F.coalesce(numbers / (1 << 20), F.lit(0.0)).alias("mb"))
    lists = F.count_distinct("list_id") if "list_id" in indexed.columns else F.lit(0).cast("long")
    return indexed.agg(F.lit(kind).alias("kind"), F.count("*").alias("vectors"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim"), lists.alias("lists"), F.coalesce(F.sum(4 * F.size("vector")) / (1 << 20), F.lit(0.0)).alias("mb"))


def index_chunks(spark: SparkSession, chunk_file: str, out: str, encoder: Callable[[list[str]], list[list[float]]], kinds: Sequence[str] = ("flat",)) -> DataFrame:
    """Index the chunks of a file by every kind, each in its folder of out with its chunks' columns; returns the reports.

    Contents are encoded once, into out/vectors, which the kinds read.
    """
    embed(read_chunks(spark, chunk_file), encoder).withColumn("key", F.xxhash64("chunk_id")).write.mode("overwrite").parquet(f"{out}/vectors")
    vectors, reports = spark.read.parquet(f"{out}/vectors"), None
    for kind in kinds:
        save_index(build_index(vectors, kind), f"{out}/{kind}")
        report = index_report(spark.read.parquet(f"{out}/{kind}"), kind)
        reports = report if reports is None else reports.unionByName(report)
    return reports
