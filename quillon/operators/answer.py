"""Evidence signals, reranking, citations and refusal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import passage, truncate_text
from quillon.operators.ranking import first_of, top_k

REFUSAL = "The evidence at hand does not answer this question."
SYSTEM = "Answer only from the numbered evidence, and cite each statement as [E1], [E2] and so on. Where the evidence does not answer, reply: " + REFUSAL
KEYWORD_WEIGHT, TOKEN_WEIGHT, SCORE_WEIGHT = 10.0, 1.0, 0.1
MIN_SCORE = -5.0


def keyword_score(content: Column, keywords: Column) -> Column:
    return F.aggregate(keywords, F.lit(0.0), lambda s, k: s + F.when(F.contains(content, k), KEYWORD_WEIGHT).otherwise(0.0))


def token_score(query: Column, content: Column) -> Column:
    """One for each run of two letters, digits or Han characters of the query, in its own words, that the content has."""
    runs = F.array_distinct(F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"([\p{L}\p{N}]{2,})"), F.lit(1)))
    return TOKEN_WEIGHT * F.size(F.filter(runs, lambda r: F.contains(content, r))).cast("double")


def evidence_score(query: Column, content: Column, keywords: Column, score: Column) -> Column:
    return keyword_score(content, keywords) + token_score(query, content) + SCORE_WEIGHT * score


def rerank(hits: DataFrame, k: int, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """hits (qid, key, query, content, score, rank) reordered; the rank before is hybrid_rank.

    scorer gives a score from query and passage, a pandas UDF around a model for one; by default the evidence
    signal without keywords. Ties keep the order before.
    """
    text = passage({"document": F.col("key").cast("string"), "content": F.col("content")})
    new = scorer(F.col("query"), text) if scorer else evidence_score(F.col("query"), F.col("content"), F.array().cast("array<string>"), F.col("score"))
    scored = hits.withColumnRenamed("rank", "hybrid_rank").withColumn("reranker_score", new)
    return top_k(scored, k, score="reranker_score", tie=("hybrid_rank", "key"))


def evidences(hits: DataFrame, max_chars: int = 900) -> DataFrame:
    """(qid, evidences): the distinct hits of each query in order, numbered E1 on. hits are a few for each query."""
    once = first_of(hits, ["qid", "key"], [F.col("rank")])
    item = F.struct("rank", F.col("key").cast("string").alias("chunk_id"), F.col("score"), truncate_text(F.col("content"), max_chars).alias("text"))
    listed = F.sort_array(F.collect_list(item))
    numbered = F.transform(listed, lambda e, i: F.struct(F.concat(F.lit("E"), i + 1).alias("id"), e["chunk_id"].alias("chunk_id"), e["score"].alias("score"), e["text"].alias("text")))
    return once.groupBy("qid").agg(numbered.alias("evidences"))


def should_refuse(items: Column) -> Column:
    """No evidence, or none that scores MIN_SCORE."""
    return (F.size(F.coalesce(items, F.array())) <= 0) | F.coalesce(F.array_max(F.transform(items, lambda e: e["score"])) < MIN_SCORE, F.lit(False))


def prompt(query: Column, items: Column) -> Column:
    """array of (role, content) for a model."""
    block = F.array_join(F.transform(items, lambda e: F.concat(F.lit("["), e["id"], F.lit("] "), e["chunk_id"], F.lit("\n"), e["text"])), "\n\n")
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(SYSTEM)), turn("user", F.concat(F.lit("Question: "), query, F.lit("\n\nEvidence:\n"), block)))


def template_answer(items: Column) -> Column:
    """The stand-in for a model: the first evidence, cited."""
    return F.concat(F.get(items, F.lit(0))["text"], F.lit(" ["), F.get(items, F.lit(0))["id"], F.lit("]"))


def citations(answer: Column) -> Column:
    """Distinct [E..] marks in order of their first place."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(E\d+)\]"), F.lit(1)))


def check_citations(answer: Column, valid: Column) -> Column:
    """struct: is_refusal, citations, invalid_citations, passed (a refusal, or some citations and all valid)."""
    found = citations(answer)
    refusal = F.startswith(F.coalesce(answer, F.lit("")), F.lit(REFUSAL))
    wrong = F.array_except(found, valid)
    return F.struct(refusal.alias("is_refusal"), found.alias("citations"), wrong.alias("invalid_citations"), (refusal | ((F.size(found) > 0) & (F.size(wrong) == 0))).alias("passed"))


def guarded(answers: DataFrame) -> DataFrame:
    """answers (answer, evidences) with citation_check, refused and answer replaced by the refusal where the check fails."""
    checked = answers.withColumn("citation_check", check_citations(F.col("answer"), F.transform("evidences", lambda e: e["id"]))).withColumnRenamed("answer", "raw_answer")
    passed = F.col("citation_check.passed")
    return checked.withColumn("answer", F.when(passed, F.col("raw_answer")).otherwise(REFUSAL)).withColumn("refused", F.col("citation_check.is_refusal") | ~passed)


def answer(hits: DataFrame, queries: DataFrame, generator: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """queries (qid, query) answered from their hits: refused without evidence, else generated and guarded."""
    rows = queries.join(evidences(hits), "qid", "left").withColumn("evidences", F.coalesce("evidences", F.array().cast("array<struct<id:string,chunk_id:string,score:double,text:string>>")))
    text = generator(F.col("query"), prompt(F.col("query"), F.col("evidences"))) if generator else template_answer(F.col("evidences"))
    return guarded(rows.withColumn("answer", F.when(should_refuse(F.col("evidences")), REFUSAL).otherwise(text)))
