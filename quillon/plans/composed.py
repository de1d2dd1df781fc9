"""Registered queries that compose several operators: comparisons, answers over routed evidence, chunk files, evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import answer as A
from quillon.operators import chunking, evaluate, retriever
from quillon.plans import retrieval as R
from quillon.plans.session import table
from quillon.sources import jobs

FLAT = "regexp_replace(regexp_replace(coalesce(c.text, ''), '\\s+', ' ', 'g'), '^ | $', '', 'g')"
#: The routed questions' SQL with two sub-queries of each passage in their place.
PAIRS_SQL = """
q as (select item_id || '/' || i as qid, item_id as item, 'src' || (item_id % 37 + i) || ' ' || text as query, 'src' || (item_id % 37 + i) as company, cast(2020 + item_id % 3 as varchar) as year, case when item_id % 40 = 0 then 'annual' else 'q3' end as period, '' as metric from benchmark, (select unnest([0, 1]) as i) where item_id % 20 = 0),"""
COMPARE_SQL = R.evidence_sql().replace(R.ROUTED_SQL, PAIRS_SQL)


def _comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages asked of two sources each, which stand for companies."""
    asked = R._asked(spark, sf_dir)
    company = lambda i: F.concat(F.lit("src"), (F.col("qid") % 37 + i).cast("string"))
    year, period = (2020 + F.col("qid") % 3).cast("string"), F.when(F.col("qid") % 40 == 0, "annual").otherwise("q3")
    return asked.select("qid", F.col("qid").alias("item"), F.coalesce("text", F.lit("")).alias("query"), F.array(company(0), company(1)).alias("companies"), company(0).alias("company_short"), year.alias("year"), period.alias("period"), F.lit("").alias("metric"), F.lit("compare").alias("question_type"))


@R.registered(f"with {COMPARE_SQL} select cast(split_part(qid, '/', 1) as bigint) as qid, cast(split_part(qid, '/', 2) as int) as sub_idx, key, round(score, 6) as score, cast(rank as int) as rank from evidence where rank <= 5")
def retrieve_compare(spark, sf_dir):
    asked = _comparisons(spark, sf_dir)
    hits = retriever.retrieve_compare(asked, R._routed_chunks(spark, sf_dir), R._global_hits(spark, sf_dir, asked), pattern=R.WORD)
    return R._rounded(hits.select("qid", "sub_idx", "key", "score", "rank"), "score")


FINAL_SQL = (R.CANDIDATE_SQL + f""",
scores as (select f.qid, f.key, f.rank as hybrid_rank, 0.1 * f.score + {R.HITS_SQL} as score from fused f join q using (qid) join c using (key)),
final as (select * from (select *, row_number() over (partition by qid order by round(score, 9) desc, hybrid_rank, key) as rank from scores) where rank <= 5)""").replace("ARM", "50").replace("GLOBAL", "500")


@R.registered(f"""with {FINAL_SQL}, top as (select e.qid, {FLAT} as f from final e join c using (key) where e.rank = 1)
select q.qid, case when f is null then '{A.REFUSAL}' when length(f) <= 900 then f || ' [E1]' else rtrim(left(f, 900)) || '... [E1]' end as answer, f is null as refused, coalesce(n, 0) as n_evidences
from q left join top using (qid) left join (select qid, cast(count(*) as int) as n from final group by qid) using (qid)""")
def answers_routed(spark, sf_dir):
    """Questions answered from their own reranked evidence by the template generator."""
    parsed = R._routed_questions(spark, sf_dir).withColumns({"question_type": F.lit("fact"), "companies": F.array("company_short")})
    found = retriever.answer_questions(parsed, R._routed_chunks(spark, sf_dir), R._global_hits(spark, sf_dir, parsed), pattern=R.WORD)
    return found.select("qid", "answer", "refused", F.size("evidences").alias("n_evidences"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of reports, research and policy papers, named by source and id."""
    at, source = F.col("doc_id") % 6, F.coalesce("source", F.lit("none"))
    kind = F.get(F.array(*map(F.lit, ("年度报告", "半年度报告", "第一季度报告", "第三季度报告", "行业研究", "管理办法"))), at.cast("int"))
    report = F.concat(F.lit("【公告】"), source, F.lit("股份有限公司："), (2020 + F.col("doc_id") % 5).cast("string"), F.lit("年"), kind, F.lit(".pdf"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.when(at < 4, report).otherwise(F.concat(source, kind, F.lit(".pdf"))).alias("source_file"), "text")


@R.registered(f"""with recursive {R.ONE_SIZE}, m as (select doc_id, coalesce(source, 'none') as s, cast(doc_id % 6 as int) as kind, cast(2020 + doc_id % 5 as varchar) as y from documents),
named as (select doc_id, case when kind < 4 then s || '股份有限公司' || y || '年' || ['年度报告', '半年度报告', '第一季度报告', '第三季度报告'][kind + 1] else s || ['行业研究', '管理办法'][kind - 3] end as doc_title,
  ['annual_report', 'semi_annual_report', 'quarterly_report', 'quarterly_report', 'industry_research', 'policy'][kind + 1] as doc_type, case when kind < 4 then 'company_report' when kind = 4 then 'research' else 'government' end as source_type,
  case when kind < 4 then s || '股份有限公司' else '' end as company, case when kind < 4 then s else '' end as company_short, case when kind < 4 then y else '' end as year, case when kind < 4 then ['annual', 'semi_annual', 'q1', 'q3'][kind + 1] else '' end as period from m)
select doc_title, doc_type, source_type, company, company_short, year, period, count(*) as chunks, cast(sum(length(content)) as bigint) as chars, max(printf('%d_text_%04d', doc_id, n)) as last_chunk from chunks join named using (doc_id) group by all""")
def standard_chunks(spark, sf_dir):
    """Chunk files' rows with their documents' metadata, counted by all of it."""
    chunks = chunking.standard_chunks(_files(spark, sf_dir))
    return chunks.groupBy("doc_title", "doc_type", "source_type", "company", "company_short", "year", "period").agg(F.count("*").alias("chunks"), F.sum("char_len").alias("chars"), F.max("chunk_id").alias("last_chunk"))


@R.registered("""with items as (select l_orderkey as qid, l_orderkey % 2 = 0 as summary, 'part' || translate(cast(l_partkey as varchar), '0123456789', 'abcdefghij') as truth, l_linestatus as k1, case when l_orderkey % 3 = 0 then 'N' end as k2 from lineitem where l_linenumber = 1),
hits as (select l_orderkey as qid, l_returnflag as method, 'part' || translate(cast(l_partkey as varchar), '0123456789', 'abcdefghij') as doc, l_linestatus || ' ' || l_returnflag as content, cast(l_linenumber as int) as rank from lineitem),
methods as (select distinct method from hits),
judged as (select i.qid, summary, m.method, rank, coalesce(contains(doc, truth) or contains(truth, doc), false) as same, coalesce(case when summary then contains(content, k1) or coalesce(contains(content, k2), false) else contains(content, k1) and coalesce(contains(content, k2), true) end, false) as said
  from items i cross join methods m left join hits h on h.qid = i.qid and h.method = m.method)
select qid, case when summary then 'summary' else 'fact' end as question_type, method, coalesce(min(case when same then rank end), -1) as doc_rank, coalesce(min(case when same and said then rank end), -1) as evidence_rank from judged group by all""")
def item_ranks(spark, sf_dir):
    """Orders as items: the first line's part is the true document, its status and a flag the keywords; an order's lines are the hits."""
    lines = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("part:"), F.translate(F.col("l_partkey").cast("string"), "0123456789", "abcdefghij"), F.lit(".pdf"))
    qid = F.col("l_orderkey").alias("qid")
    words = F.array_compact(F.array("l_linestatus", F.when(F.col("l_orderkey") % 3 == 0, F.lit("N"))))
    items = lines.filter("l_linenumber = 1").select(qid, F.when(F.col("l_orderkey") % 2 == 0, "summary").otherwise("fact").alias("question_type"), F.array(name).alias("truths"), words.alias("keywords"))
    hits = lines.select(qid, F.col("l_returnflag").alias("method"), name.alias("doc_id"), F.concat_ws(" ", "l_linestatus", "l_returnflag").alias("content"), F.col("l_linenumber").cast("int").alias("rank"))
    return evaluate.item_ranks(items, hits)


_RECALLS = ", ".join(f"round(coalesce(avg(case when method = '{m}' then case when rank between 1 and {k} then 1.0 else 0.0 end end), 0), 6) as {m}_recall_{k}" for m in ("dense", "bm25", "hybrid") for k in (3, 5, 10))


@R.registered(f"""with r as (select 'all_cs' || (256 * (1 + l_suppkey % 4)) || '_ov50' as experiment, 256 * (1 + l_suppkey % 4) as size, l_orderkey as qid, case l_returnflag when 'N' then 'dense' when 'A' then 'bm25' else 'hybrid' end as method, case when l_quantity > 12 then -1 else l_quantity end as rank from lineitem)
select experiment, cast(size as int) as chunk_size, cast(50 as int) as overlap, count(distinct qid) as total_queries, {_RECALLS} from r group by experiment, size""")
def experiment_summary(spark, sf_dir):
    """Lines as ranks of questions in four chunk experiments, by supplier; quantities over 12 are misses."""
    size = 256 * (1 + F.col("l_suppkey") % 4)
    method = F.when(F.col("l_returnflag") == "N", "dense").when(F.col("l_returnflag") == "A", "bm25").otherwise("hybrid")
    rank = F.when(F.col("l_quantity") > 12, -1).otherwise(F.col("l_quantity").cast("int"))
    ranks = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("all_cs"), size.cast("string"), F.lit("_ov50.jsonl")).alias("experiment"), F.col("l_orderkey").alias("qid"), method.alias("method"), rank.alias("rank"))
    out = evaluate.experiment_summary(ranks)
    return R._rounded(out.withColumn("experiment", evaluate.experiment_sizes(F.col("experiment"))["experiment"]), *[c for c in out.columns if "_recall_" in c])


@R.registered("select 'flat' as kind, count(*) as vectors, cast(max(len(embedding)) as int) as dim, round(sum(4 * len(embedding)) / 1048576.0, 6) as mb from embeddings union all select 'ivf', count(*), cast(max(len(embedding)) as int), round(sum(4 * len(embedding)) / 1048576.0, 6) from embeddings")
def index_reports(spark, sf_dir):
    """Exact and inverted indexes of the vectors; how many lists are in use depends on the training and is left out."""
    vectors = R._vectors(spark, sf_dir)
    flat, ivf = (jobs.index_report(jobs.build_index(vectors, k), k) for k in ("flat", "ivf"))
    return R._rounded(flat.unionByName(ivf).drop("lists"), "mb")
