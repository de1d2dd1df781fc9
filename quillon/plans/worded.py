"""Registered queries over questions in words: segmentation by a dictionary, and BM25 over its words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.scratch import stored
from quillon.operators import query as Q
from quillon.operators import segment
from quillon.operators.lexical import bm25_top_k
from quillon.plans.retrieval import QUESTION_SQL, _rounded, _spoken, registered
from quillon.plans.session import table

#: Words of the questions besides metrics; `年` begins two of them.
FRAME = ("公司", "无名", "和", "年", "第一季度", "半年度", "第三季度", "年度", "谁更高", "主要趋势", "是多少")
NAME = "regexp_extract_all({a}, '[A-Za-z0-9]+|_|公司')"
WORDS_SQL = f"""{QUESTION_SQL},
spelt as (select qid, list_concat(case when qid % 10 = 7 then ['无名', '公司'] when qid % 3 = 0 then list_concat(list_concat({NAME.format(a='a.alias')}, ['和']), {NAME.format(a='b.alias')}) else {NAME.format(a='a.alias')} end,
  list_concat(list_concat([o.year, '年', ['第一季度', '半年度', '第三季度', '年度'][q]], case qid % 3 when 0 then [m, '谁更高'] when 1 then ['主要趋势'] else [m, '是多少'] end), regexp_extract_all(query, '[0-9]+'))) as w
  from o join texts using (qid) join named a on a.k = own join named b on b.k = other)"""


def _dictionary(spark: SparkSession, questions: DataFrame) -> DataFrame:
    """Metrics and the questions' other words, each with the number of questions that hold it."""
    words = spark.createDataFrame([(w,) for w in (*Q.METRICS, *FRAME)], "word string")
    held = questions.select(F.explode(F.array(*[F.when(F.contains("query", F.lit(w)), w) for w in (*Q.METRICS, *FRAME)])).alias("word"))
    counted = words.join(held.filter("word is not null").groupBy("word").agg(F.count("*").alias("n")), "word", "left").fillna(1, ["n"])
    return spark.createDataFrame(counted.collect(), counted.schema)  # as many rows as names here


def _worded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    questions = _spoken(spark, sf_dir)[0].select(F.col("qid").alias("key"), "query")
    dictionary = _dictionary(spark, questions)
    return segment.segmented(questions, "query", dictionary).select("key", "words"), dictionary


@registered(f"with {WORDS_SQL} select qid, array_to_string(w, '|') as words from spelt")
def question_words(spark, sf_dir):
    """The words of all questions, in order; numbers count once more at the end."""
    return _worded(spark, sf_dir)[0].select(F.col("key").alias("qid"), F.array_join("words", "|").alias("words"))


@registered(f"""with {WORDS_SQL}, docs as (select qid as key, w from spelt),
sizes as (select count(*) as n, avg(len(w)) as a from docs),
postings as (select key, len(w) as l, word, count(*) as tf from (select key, w, unnest(w) as word from docs) group by key, l, word),
df as (select word, count(*) as df from postings group by word),
raw as (select word, ln(n - df + 0.5) - ln(df + 0.5) as idf from df, sizes),
idf as (select word, case when idf < 0 then 0.25 * (select avg(idf) from raw) else idf end as idf from raw),
asked as (select k as qid, word, count(*) as times from (select k, unnest(list_concat(list_concat({NAME.format(a='alias')}, ['研发费用', '是多少']), regexp_extract_all(alias, '[0-9]+'))) as word from named) group by k, word),
scored as (select qid, key, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) as score from postings join asked using (word) join idf using (word), sizes group by qid, key),
ranked as (select *, row_number() over (partition by qid order by round(score, 9) desc, key) as rank from scored where score > 0)
select qid, key, round(score, 6) as score, cast(rank as int) as rank from ranked where rank <= 20""")
def bm25_words(spark, sf_dir):
    """A question about each nation against those of all orders, by words."""
    corpus, dictionary = _worded(spark, sf_dir)
    corpus = stored(corpus, "words")  # read for frequencies and for scores
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("qid"), F.concat("n_name", F.lit("公司研发费用是多少")).alias("query"))
    return _rounded(bm25_top_k(corpus, segment.segmented(asked, "query", dictionary).select("qid", "words"), 20), "score").select("qid", "key", "score", "rank")
