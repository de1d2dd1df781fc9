"""Routed retrieval: metadata filters with relaxation, BM25 and dense hits over each query's candidates, fusion, evidence order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import first_present
from quillon.operators.answer import answer, evidence_score, rerank
from quillon.operators.lexical import B, EPSILON, K1, TOKEN, bm25_top_k, tokens
from quillon.operators.query import compare_subqueries, metric_keywords
from quillon.operators.ranking import first_of, fuse, top_k
from quillon.operators.routing import routes


def chunk_company(company_short: Column, company: Column, doc_title: Column, doc_id: Column, source_file: Column) -> Column:
    """What names a chunk's company."""
    return first_present(company_short, company, doc_title, doc_id, source_file)


def chunk_text(content: Column) -> Column:
    return F.coalesce(content, F.lit(""))


def chunk_key(chunk_id: Column, index: Column) -> Column:
    return first_present(chunk_id, index.cast("string"))


def bm25_in_candidates(corpus: DataFrame, queries: DataFrame, candidates: DataFrame, k: int, pattern: str = TOKEN) -> DataFrame:
    """bm25_top_k of queries (qid, route, text) with statistics of each route's candidates (route, key) only: their number, mean length, and document frequencies.

    Only chunks that are candidates are read into words, once: a chunk gives its words and the empty word, whose rows
    have the lengths. A word's statistics are made once a route, however many questions share it.
    """
    pairs = candidates.select("route", "key").distinct()
    held = corpus.join(pairs.select("key").distinct(), "key", "left_semi").select("key", tokens(F.col("text"), pattern).alias("words"))
    spread = held.select("key", F.size("words").alias("len"), F.explode(F.concat("words", F.array(F.lit("")))).alias("word"))
    local = pairs.join(spread.groupBy("key", "len", "word").agg(F.count("*").alias("tf")), "key")
    df = local.groupBy("route", "word").agg(F.count("*").alias("df"), F.avg("len").alias("avg_len"))
    sizes = df.filter("word = ''").select("route", F.col("df").alias("n"), "avg_len")  # a row each
    raw = df.filter("word <> ''").drop("avg_len").join(sizes, "route").select("route", "word", "avg_len", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = raw.groupBy("route").agg(F.avg("idf").alias("mean"))
    asked = queries.select("qid", "route", F.explode(tokens(F.col("text"), pattern)).alias("word")).groupBy("qid", "route", "word").agg(F.count("*").alias("times"))
    idf = F.when(F.col("idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf"))
    weighted = asked.join(raw, ["route", "word"]).join(mean, "route").select("qid", "route", "word", "avg_len", (F.col("times") * idf).alias("weight"))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = local.join(weighted, ["route", "word"]).groupBy("qid", "key").agg(F.sum(part).alias("score")).filter("score > 0")
    return top_k(scored, k)


def dense_in_candidates(found: DataFrame, asked: DataFrame, candidates: DataFrame, whole: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """The k best of the dense hits (qid, key, score) of the whole corpus whose chunk or document is a candidate; fewer where the hits hold fewer.

    asked are (qid, route), candidates (route, doc), whole the (route) that search all, placed the (key, doc) of all chunks.
    """
    docs, free = candidates.select("route", "doc").distinct().withColumn("routed", F.lit(True)), whole.select("route", F.lit(True).alias("whole"))
    hits = found.join(placed.select("key", "doc"), "key").join(asked, "qid")
    kept = hits.join(docs, ["route", "doc"], "left").join(free, "route", "left").filter("routed or whole")
    return top_k(kept.select("qid", "key", "score"), k)


def arms(asked: DataFrame, candidates: DataFrame, whole: DataFrame, placed: DataFrame, corpus: DataFrame, found: DataFrame, k: int, pattern: str = TOKEN) -> tuple[DataFrame, DataFrame]:
    """The dense and the BM25 hits (qid, key, score, rank), k of each, of questions (qid, route, query)."""
    texts = asked.select("qid", "route", F.col("query").alias("text"))
    lexical = bm25_in_candidates(corpus, texts.join(whole, "route", "left_anti"), candidates, k, pattern).select("qid", "key", "score", "rank")
    lexical = lexical.unionByName(bm25_top_k(corpus, texts.join(whole, "route", "left_semi").select("qid", "text"), k, pattern).select("qid", "key", "score", "rank"))
    return dense_in_candidates(found, asked.select("qid", "route"), candidates, whole, placed, k), lexical


def first_hits(found: DataFrame, k: int) -> DataFrame:
    """The dense hits (qid, key, score) up to rank k, where they have ranks."""
    return (found.filter(F.col("rank") <= k) if "rank" in found.columns else found).select("qid", "key", "score")


def retrieve(asked: DataFrame, chunks: DataFrame, found: DataFrame, k: int = 10, arm_k: int = 50, pattern: str = TOKEN, global_k: int = 300, hybrid: bool = True) -> DataFrame:
    """(qid, key, score, rank): the evidence of queries (qid, query, company_short, year, period, metric) among chunks (key, text, companies, year, period and, if they have it, doc).

    found are the dense hits over all chunks, the first global_k of them if they have ranks. Both arms are fused, or
    without hybrid put one after the other, and ordered by the evidence signal with the metric's keywords; a query all
    of whose hits score nothing has its BM25 hits.
    """
    routed, corpus = routes(asked, chunks), chunks.select("key", "text")
    questions = asked.select("qid", "query").join(routed.asked, "qid")
    dense, lexical = arms(questions, routed.candidates(), routed.whole, routed.placed, corpus, first_hits(found, global_k), arm_k, pattern)
    if hybrid:
        both = fuse(dense, lexical, 2 * arm_k).select("qid", "key", "score", "bm25_score", "bm25_rank", F.col("rank").alias("hybrid_rank"))
    else:
        ways = lexical.select("qid", "key", "score", "rank", F.lit(0).alias("way"), F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
        ways = ways.unionByName(dense.select("qid", "key", "score", "rank", F.lit(1).alias("way"), F.lit(None).cast("double").alias("bm25_score"), F.lit(None).cast("int").alias("bm25_rank")))
        once = first_of(ways, ["qid", "key"], [F.col("way"), F.col("rank")])
        both = once.withColumn("hybrid_rank", F.row_number().over(Window.partitionBy("qid").orderBy("way", "rank"))).drop("way", "rank")
    considered = arm_k if hybrid else 2 * arm_k
    rows = both.join(corpus, "key").join(asked.select("qid", "query", metric_keywords(F.col("metric")).alias("keywords")), "qid")
    signal = F.when(F.col("hybrid_rank") <= considered, evidence_score(F.col("query"), chunk_text(F.col("text")), F.col("keywords"), F.col("score")))
    scored = rows.select("qid", "key", "bm25_score", "bm25_rank", "hybrid_rank", F.coalesce(signal, F.lit(0.0)).alias("signal"))
    said = F.col("said")
    scored = scored.withColumn("said", F.max(F.col("signal") > 0).over(Window.partitionBy("qid"))).filter(F.when(said, F.col("signal") > 0).otherwise(F.col("bm25_rank") <= k))
    chosen = scored.withColumns({"score": F.when(said, F.col("signal")).otherwise(F.col("bm25_score")), "at": F.when(said, F.col("hybrid_rank")).otherwise(F.col("bm25_rank"))})
    return top_k(chosen, k, tie=("at", "key")).select("qid", "key", "score", "rank")


def _sub_questions(parsed: DataFrame, dense: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sub-queries (qid, sub_idx, company, sub_query, sub), the questions that they are, and their dense hits.

    dense are hits of the sub-queries' own vectors if they have sub_idx, else of the comparison's, which both share.
    """
    subs = compare_subqueries(parsed).withColumn("sub", F.concat_ws("/", F.col("qid").cast("string"), F.col("sub_idx").cast("string")))
    asked = subs.join(parsed.select("qid", "year", "period", "metric"), "qid").select(F.col("sub").alias("qid"), F.col("sub_query").alias("query"), F.col("company").alias("company_short"), "year", "period", "metric")
    on = ["qid", "sub_idx"] if "sub_idx" in dense.columns else ["qid"]
    found = dense.join(subs.select("qid", "sub_idx", "sub"), on)
    return subs, asked, found.select(F.col("sub").alias("qid"), "key", "score", *[c for c in ("rank",) if c in dense.columns])


def retrieve_compare(parsed: DataFrame, chunks: DataFrame, dense: DataFrame, k_each: int = 5, arm_k: int = 50, pattern: str = TOKEN) -> DataFrame:
    """(qid, sub_idx, company, sub_query, key, score, rank): each of a comparison's two sub-queries retrieved by itself.

    dense are hits (qid, key, score) of the comparison's vector or (qid, sub_idx, key, score) of its sub-queries'.
    Queries that name fewer than two companies have no rows.
    """
    subs, asked, found = _sub_questions(parsed, dense)
    hits = retrieve(asked, chunks, found, k_each, arm_k, pattern).withColumnRenamed("qid", "sub")
    return hits.join(subs, "sub").select("qid", "sub_idx", "company", "sub_query", "key", "score", "rank")


#: Candidates of each arm for summaries, and the dense hits of all chunks that they are taken from.
SUMMARY_ARM, SUMMARY_GLOBAL = 80, 500


def retrieve_summary(parsed: DataFrame, chunks: DataFrame, dense: DataFrame, k: int = 10, arm_k: int = SUMMARY_ARM, pattern: str = TOKEN, global_k: int = SUMMARY_GLOBAL) -> DataFrame:
    """retrieve() for summaries: more candidates, and routed only by a company or a year."""
    signal = (F.coalesce("company_short", F.lit("")) != "") | (F.coalesce("year", F.lit("")) != "")
    return retrieve(parsed.withColumn("period", F.when(signal, F.col("period")).otherwise("")), chunks, dense, k, arm_k, pattern, global_k)


def retrieve_by_type(parsed: DataFrame, chunks: DataFrame, dense: DataFrame, k: int = 10, k_each: int = 5, arm_k: int = 50, pattern: str = TOKEN) -> DataFrame:
    """(qid, question_type, sub_idx, key, score, rank): facts, summaries in their own sizes, comparisons by sub-query."""
    facts, summaries = parsed.filter("question_type = 'fact'"), parsed.filter("question_type = 'summary'")
    of_parent = dense.filter("sub_idx is null").drop("sub_idx") if "sub_idx" in dense.columns else dense
    hits = retrieve(facts, chunks, of_parent, k, arm_k, pattern).withColumn("question_type", F.lit("fact"))
    hits = hits.unionByName(retrieve_summary(summaries, chunks, of_parent, k, pattern=pattern).withColumn("question_type", F.lit("summary"))).withColumn("sub_idx", F.lit(None).cast("int"))
    compared = retrieve_compare(parsed.filter("question_type = 'compare'"), chunks, dense, k_each, arm_k, pattern).withColumn("question_type", F.lit("compare"))
    names = ["qid", "question_type", "sub_idx", "key", "score", "rank"]
    return hits.select(*names).unionByName(compared.select(*names))


def final_candidates(parsed: DataFrame, chunks: DataFrame, dense: DataFrame, k: int = 50, coarse_k: int = SUMMARY_GLOBAL, pattern: str = TOKEN) -> DataFrame:
    """(qid, key, score, rank): the k candidates of each question that a reranker gets, by fusion.

    Facts have those of their route. Of a summary the first coarse_k dense hits are a corpus of their own, among which
    both arms search again, BM25 with statistics of these chunks.
    """
    corpus, facts = chunks.select("key", "text"), parsed.filter("question_type <> 'summary'")
    routed = routes(facts, chunks)
    first = fuse(*arms(facts.select("qid", "query").join(routed.asked, "qid"), routed.candidates(), routed.whole, routed.placed, corpus, first_hits(dense, SUMMARY_GLOBAL), k, pattern), k)
    summaries = parsed.filter("question_type = 'summary'").select("qid", "query", F.col("qid").cast("string").alias("route"))
    coarse = top_k(dense.join(summaries.select("qid", "route"), "qid").select("qid", "route", "key", "score"), coarse_k)
    candidates = coarse.select("route", "key", F.col("key").alias("doc"))
    none, placed = summaries.select("route").limit(0), corpus.select("key", F.col("key").alias("doc"))
    second = fuse(*arms(summaries, candidates, none, placed, corpus, coarse.select("qid", "key", "score"), k, pattern), k)
    return first.unionByName(second).select("qid", "key", "score", "rank")


def final_evidence(parsed: DataFrame, chunks: DataFrame, dense: DataFrame, scorer: Callable[[Column, Column], Column] | None = None, k: int = 5, k_each: int = 3, candidate_k: int = 50, coarse_k: int = SUMMARY_GLOBAL, pattern: str = TOKEN) -> DataFrame:
    """(qid, sub_idx, key, content, score, rank): final_candidates reranked by scorer, k of facts and summaries, k_each of a comparison's sub-queries."""
    single, compared = parsed.filter("question_type <> 'compare'"), parsed.filter("question_type = 'compare'")
    of_parent = dense.filter("sub_idx is null").drop("sub_idx") if "sub_idx" in dense.columns else dense
    texts = chunks.select("key", chunk_text(F.col("text")).alias("content"))

    def reranked(questions: DataFrame, hits: DataFrame, n: int) -> DataFrame:
        rows = final_candidates(questions, chunks, hits, candidate_k, coarse_k, pattern).join(texts, "key").join(questions.select("qid", "query"), "qid")
        return rerank(rows, n, scorer).select("qid", "key", "content", F.col("reranker_score").alias("score"), "rank")

    subs, asked, found = _sub_questions(compared, dense)
    both = reranked(asked.withColumn("question_type", F.lit("fact")), found, k_each).withColumnRenamed("qid", "sub").join(subs.select("sub", "qid", "sub_idx"), "sub")
    names = ["qid", "sub_idx", "key", "content", "score", "rank"]
    return reranked(single, of_parent, k).withColumn("sub_idx", F.lit(None).cast("int")).select(*names).unionByName(both.select(*names))


#: Evidences of an answer.
MAX_EVIDENCES = 8


def merged_evidence(hits: DataFrame, max_evidences: int = MAX_EVIDENCES) -> DataFrame:
    """Hits (qid, sub_idx, key, rank, ...) as one list for each question: sub-queries in turn, each chunk at its first place."""
    at = F.coalesce("sub_idx", F.lit(0))
    once = first_of(hits, ["qid", "key"], [at, F.col("rank")])
    order = F.row_number().over(Window.partitionBy("qid").orderBy(at, "rank"))
    return once.withColumn("rank", order).filter(F.col("rank") <= max_evidences).drop("sub_idx")


def answer_questions(parsed: DataFrame, chunks: DataFrame, dense: DataFrame, generator: Callable[[Column, Column], Column] | None = None, scorer: Callable[[Column, Column], Column] | None = None, k: int = 5, k_each: int = 3, max_evidences: int = MAX_EVIDENCES, candidate_k: int = 50, pattern: str = TOKEN) -> DataFrame:
    """parsed questions answered from their own evidence: routed candidates, fused, reranked and merged; those without evidence are refused."""
    merged = merged_evidence(final_evidence(parsed, chunks, dense, scorer, k, k_each, candidate_k, pattern=pattern), max_evidences)
    return answer(merged, parsed.select("qid", "question_type", "query"), generator)
