"""Experiments: the ranks that each method gives to items' true documents and evidence, over one or many sets of chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scratch import stored
from quillon.operators.answer import rerank
from quillon.operators.evaluate import combined_ranks, item_ranks
from quillon.operators.lexical import TOKEN
from quillon.operators.query import compare_subqueries
from quillon.operators.ranking import fuse
from quillon.operators.retriever import arms, chunk_text, final_candidates, first_hits
from quillon.operators.routing import routes


def method_hits(asked: DataFrame, chunks: DataFrame, found: DataFrame, k: int = 10, candidate_k: int = 50, pattern: str = TOKEN) -> DataFrame:
    """(qid, method, key, rank): the k hits by dense, bm25 and hybrid of questions (qid, query, company_short, year, period) among their candidates."""
    routed, corpus = routes(asked, chunks), chunks.select("key", "text")
    dense, lexical = arms(asked.select("qid", "query").join(routed.asked, "qid"), routed.candidates(), routed.whole, routed.placed, corpus, first_hits(found, 1 << 30), max(k, candidate_k), pattern)
    dense, lexical = stored(dense, "dense"), stored(lexical, "lexical")
    hybrid = fuse(dense.filter(F.col("rank") <= candidate_k), lexical.filter(F.col("rank") <= candidate_k), k)
    named = lambda hits, name: hits.filter(F.col("rank") <= k).select("qid", F.lit(name).alias("method"), "key", "rank")
    return named(dense, "dense").unionByName(named(lexical, "bm25")).unionByName(named(hybrid, "hybrid"))


def reranked_hits(asked: DataFrame, chunks: DataFrame, found: DataFrame, scorer: Callable[[Column, Column], Column] | None = None, k: int = 10, candidate_k: int = 50, coarse_k: int = 500, pattern: str = TOKEN) -> DataFrame:
    """(qid, method, key, rank): final_candidates before (hybrid) and after reranking (rerank), k of each."""
    before = stored(final_candidates(asked, chunks, found, candidate_k, coarse_k, pattern), "candidates")
    rows = before.join(chunks.select("key", chunk_text(F.col("text")).alias("content")), "key").join(asked.select("qid", "query"), "qid")
    after = rerank(rows, k, scorer).select("qid", F.lit("rerank").alias("method"), "key", "rank")
    return before.filter(F.col("rank") <= k).select("qid", F.lit("hybrid").alias("method"), "key", "rank").unionByName(after)


def evaluate_items(parsed: DataFrame, items: DataFrame, chunks: DataFrame, found: DataFrame, hits_of: Callable[..., DataFrame] = method_hits, summary_hits: int = 1, use_alias: bool = True, **sizes) -> DataFrame:
    """(qid, question_type, method, doc_rank, evidence_rank) of items (qid, question_type, truths, keywords), -1 for a miss.

    parsed has the items' questions as parse_queries() gives them; found their dense hits, with sub_idx for sub-queries
    that have vectors of their own. A comparison's rank is the worst of its sub-queries', each judged by the truth of
    its own place: the first sub-query by the first truth, the second by the second, by the only one where there is one.
    """
    docs = chunks.select("key", (F.col("doc") if "doc" in chunks.columns else F.col("key")).cast("string").alias("doc_id"), chunk_text(F.col("text")).alias("content"))
    compared = parsed.join(items.filter("question_type = 'compare'").select("qid"), "qid", "left_semi")
    single = parsed.join(items.filter("question_type <> 'compare'").select("qid", F.col("question_type").alias("__type")), "qid").withColumn("question_type", F.col("__type")).drop("__type")
    found = stored(found, "found")
    of_parent = found.filter("sub_idx is null").drop("sub_idx") if "sub_idx" in found.columns else found
    subs = compare_subqueries(compared).withColumn("sub", F.concat_ws("/", F.col("qid").cast("string"), F.col("sub_idx").cast("string")))
    asked = subs.join(compared.select("qid", "year", "period", "metric"), "qid").select(F.col("sub").alias("qid"), F.col("sub_query").alias("query"), F.col("company").alias("company_short"), "year", "period", "metric", F.lit("fact").alias("question_type"))
    own = found.join(subs.select("qid", "sub_idx", "sub"), ["qid", "sub_idx"] if "sub_idx" in found.columns else ["qid"]).drop("qid", "sub_idx").withColumnRenamed("sub", "qid")
    truth = F.coalesce(F.get("truths", F.col("sub_idx")), F.element_at("truths", -1))
    sub_items = items.join(subs.select("qid", "sub_idx", "sub"), "qid").select(F.col("sub").alias("qid"), F.lit("fact").alias("question_type"), F.array_compact(F.array(truth)).alias("truths"), "keywords")
    whole, parts = stored(hits_of(single, chunks, of_parent, **sizes), "hits"), stored(hits_of(asked, chunks, own, **sizes), "hits")
    methods = whole.select("method").unionByName(parts.select("method")).distinct()
    judged = item_ranks(items.filter("question_type <> 'compare'"), whole.join(docs, "key"), summary_hits, use_alias, methods)
    ranks = stored(item_ranks(sub_items, parts.join(docs, "key"), summary_hits, use_alias, methods), "ranks")
    both = ranks.join(subs.select(F.col("qid").alias("parent"), F.col("sub").alias("qid")), "qid")
    worst = [combined_ranks(both.select(F.col("parent").alias("qid"), "method", F.col(c).alias("rank"))).withColumnRenamed("rank", c) for c in ("doc_rank", "evidence_rank")]
    joined = worst[0].join(worst[1], ["qid", "method"]).withColumn("question_type", F.lit("compare"))
    return judged.unionByName(joined.select(*judged.columns))


@dataclass
class Cell:
    """One experiment of a sweep: its name, such as all_cs512_ov50/flat, and what makes its chunks and dense hits."""

    name: str
    chunks: Callable[[], DataFrame]
    hits: Callable[[DataFrame], DataFrame]


def sweep(cells: Sequence[Cell], parsed: DataFrame, items: DataFrame, out: str, **sizes) -> DataFrame:
    """(experiment, qid, question_type, method, doc_rank, evidence_rank) of all cells.

    Each cell's ranks are written to a folder of their own, which counts when its write has been committed; a sweep that
    was broken off goes on with the cells that have none. There are as many cells as experiments, a handful.
    """
    spark = items.sparkSession
    total = None
    for cell in cells:
        path = f"{out}/{cell.name.replace('/', '-')}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            chunks = cell.chunks()
            evaluate_items(parsed, items, chunks, cell.hits(chunks), **sizes).write.mode("overwrite").parquet(path)
        ranks = spark.read.parquet(path).withColumn("experiment", F.lit(cell.name))
        total = ranks if total is None else total.unionByName(ranks)
    return total
