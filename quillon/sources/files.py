"""Sources and sinks: page files, Markdown, JSON lines, override tables, vector indexes."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = (
    "chunk_id string, doc_id string, doc_title string, doc_type string, source_type string, company string, company_short string, year string, "
    "period string, source_file string, chunk_type string, content string, char_len int, source_segment_index int, chunk_size int, overlap int"
)
EVAL_SCHEMA = "query string, ground_truth_doc_id string, answer string, question_type string, must_contain array<string>"


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source_file, text) for each *.md file."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).withColumn("source_file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    if files.isEmpty():
        raise FileNotFoundError(f"no *.md file in {folder}")
    return files.select(F.regexp_replace("source_file", r"\.md$", "").alias("doc_id"), "source_file", F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; a line that doesn't fit fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """Chunks with content; one without chunk_id, doc_id or content fails the query, and so does a path without any."""
    rows = read_jsonl(spark, path, schema)
    for c in ("chunk_id", "doc_id", "content"):
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a chunk has no {c}"))).otherwise(F.col(c)))
    rows = rows.filter(F.trim("content") != "")
    if rows.isEmpty():
        raise ValueError(f"no chunk in {path}")
    return rows


def read_eval_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items; the truth is a name or a list of names in the file and always a list here."""
    rows = read_jsonl(spark, path, EVAL_SCHEMA)
    truth = F.col("ground_truth_doc_id")
    listed = F.when(F.startswith(truth, F.lit("[")), F.from_json(truth, "array<string>")).otherwise(F.array_compact(F.array(truth)))
    return rows.withColumn("ground_truth_doc_ids", listed).drop("ground_truth_doc_id")


def read_overrides(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    """(doc_key, fields) from one JSON object keyed by document."""
    value = "struct<" + ",".join(f"{f}:string" for f in fields) + ">"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("doc_key", "v"))
    return rows.select("doc_key", *[F.col(f"v.{f}") for f in fields])


def parse_files(spark: SparkSession, folder: str, decoder: Callable[[bytes], list[dict]], done: DataFrame | None = None, glob: str = "*.pdf") -> DataFrame:
    """(doc_id, status, error, pages): page files decoded by `decoder`, files whose doc_id `done` has being skipped.

    decoder turns a file's bytes into pages; what it raises is recorded for that file only.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("doc_id"), "content")
    if done is not None:
        files = files.join(done.select("doc_id"), "doc_id", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, content in zip(frame.doc_id, frame.content):
                try:
                    rows.append((doc_id, "parsed", None, [str(p) for p in decoder(content)]))
                except Exception as e:  # recorded in the row
                    rows.append((doc_id, "failed", str(e), []))
            yield pd.DataFrame(rows, columns=["doc_id", "status", "error", "pages"])

    return files.mapInPandas(run, "doc_id string, status string, error string, pages array<string>")


def find_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, name, stem, bytes) of the files of a folder, or of one file; their contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", F.col("length").alias("bytes"))
    return listed.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("stem"), "bytes")


def find_jsonl_files(spark: SparkSession, *paths: str) -> list[str]:
    """The *.jsonl files of folders and single files, each once, by name; a folder without any fails. There are as many as experiments."""
    out: set[str] = set()
    for path in paths:
        found = [r.path for r in find_files(spark, path, "*.jsonl").collect()]
        if not found:
            raise FileNotFoundError(f"no *.jsonl file in {path}")
        out.update(found)
    return sorted(out)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query) of a file of JSON lines, those that are not blank, trimmed."""
    query = F.btrim("query", F.lit(" \t\r\n"))
    return read_jsonl(spark, path, "query string").select(query.alias("query")).filter("query <> ''")


PARSED = "name string, bytes long, status string, error string, characters long, seconds double, text string"


def parse_folder(spark: SparkSession, folder: str, out: str, decoder: Callable[[bytes], str], glob: str = "*.pdf", force: bool = False) -> DataFrame:
    """Parse the files of a folder that have no text yet, and return the run's log (name, bytes, status, error, characters, seconds, run).

    out/texts has the parsed files' texts and out/log a row for each file and run, both appended by run. A file is done
    if its last entry of the same size has text; failed and empty ones are parsed again, and all of them with force. What
    decoder raises is recorded for that file only. A run that dies leaves no log, so the next one does its files again;
    read_parsed() takes a file's text from its last logged run.
    """
    files = find_files(spark, folder, glob)
    log = read_log(spark, out)
    run = 1 + (log.agg(F.max("run")).first()[0] or 0)
    last = log.filter("status <> 'skipped'").groupBy("name").agg(F.max_by(F.struct("bytes", "status", "characters"), "run").alias("l"))
    ready = F.lit(False) if force else F.coalesce((F.col("l.status") == "parsed") & (F.col("l.characters") > 0) & (F.col("l.bytes") == F.col("bytes")), F.lit(False))
    marked = files.join(last, "name", "left").select("path", "name", "bytes", ready.alias("ready"))
    contents = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")
    wanted = contents.join(marked.filter("not ready"), "path").select("name", "bytes", "content")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, size, content in zip(frame["name"], frame["bytes"], frame["content"]):
                began = time.perf_counter()
                try:
                    text, status, error = decoder(content), "parsed", None
                except Exception as e:  # recorded in the row
                    text, status, error = None, "failed", f"{type(e).__name__}: {e}"
                rows.append((name, size, status, error, len(text or ""), time.perf_counter() - began, text))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in PARSED.split(", ")])

    wanted.mapInPandas(parse, PARSED).withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{out}/texts")
    skipped = marked.filter("ready").select("name", "bytes", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("long").alias("characters"), F.lit(0.0).alias("seconds"))
    parsed = spark.read.schema(f"{PARSED}, run int").parquet(f"{out}/texts").filter(F.col("run") == run)
    # the log goes last: what it names is written
    parsed.drop("text", "run").unionByName(skipped).withColumn("run", F.lit(run)).write.mode("append").json(f"{out}/log")
    return read_log(spark, out).filter(F.col("run") == run)


def read_log(spark: SparkSession, out: str) -> DataFrame:
    """All runs' entries; none where nothing has been logged."""
    schema = "name string, bytes long, status string, error string, characters long, seconds double, run int"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/log")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{out}/log")


def read_parsed(spark: SparkSession, out: str) -> DataFrame:
    """(name, text) of the parsed files, each by its last logged run."""
    last = read_log(spark, out).filter("status = 'parsed'").groupBy("name").agg(F.max("run").alias("run"))
    return spark.read.schema(f"{PARSED}, run int").parquet(f"{out}/texts").join(last, ["name", "run"]).select("name", "text")


def parse_stats(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("status").agg(F.count("*").alias("files"))


def save_index(indexed: DataFrame, path: str) -> None:
    """Vectors with their metadata, a folder for each inverted list where there are lists."""
    writer = indexed.write.mode("overwrite")
    (writer.partitionBy("list_id") if "list_id" in indexed.columns else writer).parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def index_size_mb(vectors: DataFrame) -> DataFrame:
    return vectors.agg((F.sum(4 * F.size("vector")) / (1 << 20)).alias("mb"))


def embed(texts: DataFrame, encoder: Callable[[list[str]], list[list[float]]], text_col: str = "content", batch: int = 32) -> DataFrame:
    """texts with vector, by an encoder that is called on batches in the workers and normalised after it."""

    @F.pandas_udf("array<float>")
    def encode(column: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        for i in range(0, len(column), batch):
            x = np.asarray(encoder(column.iloc[i : i + batch].fillna("").tolist()), np.float64)
            out.extend((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32))
        return pd.Series(out, index=column.index, dtype=object)

    return texts.withColumn("vector", encode(F.trim(text_col)))
