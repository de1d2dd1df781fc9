"""Evaluation of items by method, and sweeps over sets of chunks that are broken off and go on."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import chunking, dense, evaluate, experiment

QUESTIONS = "qid int, query string, question_type string, companies array<string>, company_short string, year string, period string, metric string"


@pytest.fixture(scope="module")
def world(spark):
    texts = {"A年报": "Alpha 营业收入 ten. filler one. ", "B年报": "Beta 营业收入 nine. filler two. ", "C研究": "风电 发展 outlook gamma. "}
    docs = spark.createDataFrame([(k, v * 6) for k, v in texts.items()], "doc_id string, text string")
    parsed = spark.createDataFrame(
        [(1, "Alpha ten", "fact", ["A"], "A", "", "", "营业收入"), (2, "gamma outlook", "summary", [], "", "", "", ""), (3, "Alpha Beta 和", "compare", ["A", "B"], "A", "", "", "营业收入"), (4, "Alpha", "fact", [], "", "", "", "")], QUESTIONS,
    )
    items = spark.createDataFrame([(1, "fact", ["A年报"], ["营业收入"]), (2, "summary", ["C研究"], ["风电", "none"]), (3, "compare", ["A年报", "B年报"], ["营业收入"]), (4, "fact", ["missing"], [])], "qid int, question_type string, truths array<string>, keywords array<string>")

    def chunks(size):
        rows = chunking.chunk_documents(docs, size, 5).select(F.xxhash64("chunk_id").alias("key"), F.col("doc_id").alias("doc"), F.col("content").alias("text"))
        return rows.withColumns({"companies": F.array("doc"), "year": F.lit(""), "period": F.lit("")})

    def hits(rows):
        """Vectors by which a question finds documents of its first letter."""
        place = F.when(F.startswith("doc", F.lit("A")), 0).when(F.startswith("doc", F.lit("B")), 1).otherwise(2)
        vectors = rows.select("key", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i == place, 1.0).otherwise(0.1)).alias("vector"))
        asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [0.9, 1.0, 0.0]), (4, [0.0, 0.0, 1.0])], "qid int, vector array<double>")
        return dense.exact_top_k(asked, vectors, 20)

    return parsed, items, chunks, hits


def test_items_are_judged_by_their_type(spark, world):
    parsed, items, chunks, hits = world
    rows = chunks(64).cache()
    ranks = {(r.qid, r.method): (r.question_type, r.doc_rank, r.evidence_rank) for r in experiment.evaluate_items(parsed, items, rows, hits(rows)).collect()}
    assert len(ranks) == 12 and {m for _, m in ranks} == {"dense", "bm25", "hybrid"}
    assert ranks[1, "dense"][:2] == ("fact", 1) and ranks[1, "hybrid"] == ("fact", 1, 1)
    assert ranks[2, "hybrid"][0] == "summary" and ranks[2, "hybrid"][2] >= 1  # one keyword is enough
    assert ranks[3, "hybrid"][0] == "compare" and ranks[3, "hybrid"][2] >= 1  # each company's own chunks
    assert ranks[4, "dense"][1:] == (-1, -1)
    again = {(r.qid, r.method): r.evidence_rank for r in experiment.evaluate_items(parsed, items, rows, hits(rows), experiment.reranked_hits).collect()}
    assert {m for _, m in again} == {"hybrid", "rerank"} and again[1, "rerank"] == 1 and again[4, "rerank"] == -1


def test_sweeps_go_on_where_they_broke(spark, world, tmp_path):
    parsed, items, chunks, hits = world
    made = []

    def cell(size, fails=False):
        def build():
            made.append(size)
            if fails:
                raise RuntimeError("killed")
            return chunks(size)

        return experiment.Cell(f"all_cs{size}_ov5/flat", build, hits)

    with pytest.raises(RuntimeError):
        experiment.sweep([cell(64), cell(120, fails=True)], parsed, items, f"file://{tmp_path}")
    ranks = experiment.sweep([cell(64), cell(120)], parsed, items, f"file://{tmp_path}")
    assert made == [64, 120, 120]  # the first is not made again
    rows = ranks.select(F.regexp_replace("experiment", "/.*", "").alias("experiment"), "qid", "method", F.col("evidence_rank").alias("rank"))
    summary = {r.chunk_size: r for r in evaluate.experiment_summary(rows).collect()}
    assert set(summary) == {64, 120} and all(r.total_queries == 4 and r.overlap == 5 for r in summary.values())
    by_hand = rows.filter("experiment = 'all_cs64_ov5' and method = 'bm25'").collect()
    assert summary[64].bm25_recall_3 == pytest.approx(sum(1 <= r["rank"] <= 3 for r in by_hand) / 4) and summary[64].hybrid_recall_10 > 0
    experiment.sweep([cell(64), cell(120)], parsed, items, f"file://{tmp_path}")
    assert made == [64, 120, 120]
