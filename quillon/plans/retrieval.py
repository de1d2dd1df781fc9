"""Queries over the given tables: `documents` is the corpus, `embeddings` its vectors, `benchmark` the query texts.

Searches take as queries the rows whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.scratch import scratch_path
from quillon.functions.vectors import dot, l2_norm, l2_normalize
from quillon.operators import answer as A
from quillon.operators import chunking, dense, evaluate, graph, layout, metadata, postings, ranking, retriever, routing
from quillon.operators import query as Q
from quillon.operators.lexical import bm25_top_k
from quillon.plans.session import table

WORD = "[A-Za-z0-9À-ÿ]+"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLE_SQL[query.__name__] = sql
        return query

    return add


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("qid"), "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label")


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).filter("key % 20 = 0").select(F.col("key").alias("qid"), "vector", F.col("label").alias("asked_label"))


def _bm25(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    return bm25_top_k(_corpus(spark, sf_dir), _asked(spark, sf_dir), k, WORD)


def _dense(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return dense.exact_top_k(_vector_queries(spark, sf_dir).select("qid", "vector"), _vectors(spark, sf_dir).select("key", "vector"), k)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


BM25_SQL = f"""
docs as (select doc_id as key, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
sizes as (select count(*) as n, avg(len(w)) as a from docs),
postings as (select key, len(w) as l, word, count(*) as tf from (select key, w, unnest(w) as word from docs) group by key, l, word),
df as (select word, count(*) as df from postings group by word),
raw as (select word, ln(n - df + 0.5) - ln(df + 0.5) as idf from df, sizes),
idf as (select word, case when idf < 0 then 0.25 * (select avg(idf) from raw) else idf end as idf from raw),
asked as (select qid, word, count(*) as times from (select item_id as qid, unnest(regexp_extract_all(coalesce(text, ''), '{WORD}')) as word from benchmark where item_id % 20 = 0) group by qid, word),
scored as (select qid, key, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) as score from postings join asked using (word) join idf using (word), sizes group by qid, key having sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) > 0),
bm25 as (select qid, key, score, rank from (select *, row_number() over (partition by qid order by round(score, 9) desc, key) as rank from scored) where rank <= 20)"""
DENSE_SQL = """
pairs as (select a.vec_id as qid, b.vec_id as key, a.label as asked_label, b.label as label, list_inner_product(a.embedding::double[], b.embedding::double[]) as score from embeddings a, embeddings b where a.vec_id % 20 = 0),
dense as (select * from (select *, row_number() over (partition by qid order by round(score, 9) desc, key) as rank from pairs) where rank <= 10)"""
FUSED_SQL = BM25_SQL + """,
dense as (select * from (select a.item_id as qid, b.vec_id as key, list_inner_product(q.embedding::double[], b.embedding::double[]) as score,
  row_number() over (partition by a.item_id order by round(list_inner_product(q.embedding::double[], b.embedding::double[]), 9) desc, b.vec_id) as rank
  from benchmark a join embeddings q on q.vec_id = a.item_id, embeddings b where a.item_id % 20 = 0) where rank <= 20),
dn as (select *, case when max(score) over (partition by qid) - min(score) over (partition by qid) < 1e-12 then 1.0 else (score - min(score) over (partition by qid)) / (max(score) over (partition by qid) - min(score) over (partition by qid)) end as s from dense),
bn as (select *, case when max(score) over (partition by qid) - min(score) over (partition by qid) < 1e-12 then 1.0 else (score - min(score) over (partition by qid)) / (max(score) over (partition by qid) - min(score) over (partition by qid)) end as s from bm25),
merged as (select coalesce(dn.qid, bn.qid) as qid, coalesce(dn.key, bn.key) as key, dn.rank as dr, bn.rank as br, 0.5 * coalesce(dn.s, 0) + 0.5 * coalesce(bn.s, 0) as score from dn full outer join bn on dn.qid = bn.qid and dn.key = bn.key),
fused as (select * from (select *, row_number() over (partition by qid order by round(score, 9) desc, dr nulls last, br nulls last, key) as rank from merged) where rank <= 20)"""


@registered(f"with {BM25_SQL} select qid, key, round(score, 6) as score, cast(rank as int) as rank from bm25")
def bm25_topk(spark, sf_dir):
    return _rounded(_bm25(spark, sf_dir), "score").select("qid", "key", "score", "rank")


@registered(f"with {BM25_SQL} select qid, key, round(score, 6) as score, cast(rank as int) as rank from bm25")
def bm25_indexed(spark, sf_dir):
    """bm25_topk by an index that is written first: only the folders of the questions' words are read."""
    path = scratch_path(spark, "postings")
    postings.build(_corpus(spark, sf_dir), path, WORD)
    return _rounded(postings.search(spark, path, _asked(spark, sf_dir), 20, WORD), "score").select("qid", "key", "score", "rank")


@registered(f"with {DENSE_SQL} select qid, key, round(score, 6) as score, cast(rank as int) as rank from dense")
def dense_topk(spark, sf_dir):
    return _rounded(_dense(spark, sf_dir), "score").select("qid", "key", "score", "rank")


@registered("select vec_id, round(sqrt(list_inner_product(list_transform(embedding, lambda x: 3 * x::double), list_transform(embedding, lambda x: 3 * x::double))), 6) as norm, round(list_sum(list_transform(embedding, lambda x: x::double)) / sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as unit_sum from embeddings")
def l2_normalize_vectors(spark, sf_dir):
    tripled = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: 3 * x.cast("double")))
    return tripled.select("vec_id", F.round(l2_norm(F.col("v")), 6).alias("norm"), F.round(F.aggregate(l2_normalize(F.col("v")), F.lit(0.0), lambda s, x: s + x), 6).alias("unit_sum"))


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir)
    vectors = _vectors(spark, sf_dir).select("key", "vector")
    found = dense.exact_top_k(asked.join(vectors.withColumnRenamed("key", "qid"), "qid").select("qid", "vector"), vectors, 20)
    return ranking.fuse(found, _bm25(spark, sf_dir), 20)


@registered(f"with {FUSED_SQL} select qid, key, round(score, 6) as score, cast(rank as int) as rank from fused")
def hybrid_topk(spark, sf_dir):
    return _rounded(_hybrid(spark, sf_dir), "score").select("qid", "key", "score", "rank")


@registered(f"with {BM25_SQL} select qid, key, round(case when max(score) over (partition by qid) - min(score) over (partition by qid) < 1e-12 then 1.0 else (score - min(score) over (partition by qid)) / (max(score) over (partition by qid) - min(score) over (partition by qid)) end, 6) as norm from bm25")
def minmax_scores(spark, sf_dir):
    return _rounded(ranking.min_max(_bm25(spark, sf_dir), "score", "norm"), "norm").select("qid", "key", "norm")


@registered("select doc_id, lower(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) as normal, length(lower(regexp_replace(coalesce(text, ''), '\\s+', '', 'g'))) as n from documents")
def normalize_text(spark, sf_dir):
    normal = T.normalize_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", normal.alias("normal"), F.length(normal).cast("long").alias("n"))


@registered("select doc_id, case when length(f) <= 200 then f else rtrim(left(f, 200)) || '...' end as short from (select doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '^ | $', '', 'g') as f from documents)")
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_text(F.col("text"), 200).alias("short"))


@registered("select doc_id, len(regexp_extract_all(text, '[.·…]')) >= 10 as toc, len(regexp_extract_all(text, '[0-9]')) >= 20 and len(regexp_extract_all(text, '[0-9]')) / greatest(length(text), 1) >= 0.18 and len(regexp_extract_all(text, '[ \\t]{2,}')) >= 3 and not len(regexp_extract_all(text, '[.·…]')) >= 10 and len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) >= 3 as tabular from documents")
def layout_tests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.looks_like_toc(F.col("text")).alias("toc"), T.looks_tabular(F.col("text")).alias("tabular"))


@registered("select doc_id, round(case when length(h) = 0 then 0 else len(regexp_extract_all(h, '[\\x{E000}-\\x{F8FF}\\x{FFFD}\\x{80}-\\x{9F}\\x00-\\x08\\x0E-\\x1F]')) / length(h) end, 6) as ratio from (select doc_id, regexp_replace(left(text, 200), '\\s+', '', 'g') as h from documents)")
def garbled_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.garbled_ratio(F.col("text")), 6).alias("ratio"))


def _taken(size: str) -> str:
    """How much a chunk takes of its window, win, which has `size` characters unless it is the last."""
    marks = (r"\n\n", "[。！？；]", "[.!?;]", r"\n", "[，,]")
    ends = [f"length(regexp_extract(win, '(?s)^(.*{m})', 1))" for m in marks]
    return f"case when start + {size} >= length(text) then length(win) " + " ".join(f"when {e} >= cast(floor(0.6 * {size}) as int) then {e}" for e in ends) + " else length(win) end"


def _soft_sql(source: str) -> str:
    """step: the windows of a table (doc_id, text, size, overlap), each after the last."""
    return f"""step as (
  select doc_id, text, size, overlap, 0 as start from {source} where length(text) > 0
  union all
  select doc_id, text, size, overlap, nxt from (
    select *, case when start + size >= length(text) then length(text) when start + taken - overlap > start then start + taken - overlap else start + taken end as nxt
    from (select *, {_taken('size')} as taken from (select *, substring(text, start + 1, size) as win from step))
  ) where nxt < length(text)
)"""


CHUNK_SQL = rf"""clean as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)^[^\S\n]+|[^\S\n]+$', '', 'g'), '^\s+|\s+$', '', 'g') as text from documents),
sized as (select *, unnest(sizes).size as size, unnest(sizes).overlap as overlap from clean, (select SIZES as sizes)),
{_soft_sql('sized')},
cuts as (select doc_id, size, overlap, start, regexp_replace(left(win, {_taken('size')}), '^\s+|\s+$', '', 'g') as content from (select *, substring(text, start + 1, size) as win from step)),
chunks as (select *, row_number() over (partition by doc_id, size, overlap order by start) as n from cuts where length(content) >= 30)"""
ONE_SIZE = CHUNK_SQL.replace("SIZES", "[{'size': 1024, 'overlap': 50}]")
GRID = CHUNK_SQL.replace("SIZES", str([{"size": s, "overlap": o} for s in (256, 512, 1024) for o in (50, 100, 200)]))


@registered(f"with recursive src as (select doc_id, text, 1024 as size, 50 as overlap from documents), {_soft_sql('src')} select doc_id, cast(start as int) as start from step")
def chunk_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(chunking.windows(F.coalesce("text", F.lit("")), 1024, 50)).alias("w")).select("doc_id", "w.start")


@registered("select doc_id, cast(s as int) as start, substring(text, cast(s as int) + 1, 512) as content from (select doc_id, text, unnest(range(0, greatest(1, cast(ceil((length(text) - 512) / 412.0) as bigint) + 1) * 412, 412)) as s from documents where length(text) > 0)")
def chunk_fixed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(chunking.windows(F.coalesce("text", F.lit("")), 512, 100, soft=False)).alias("w")).select("doc_id", "w.start", "w.content")


@registered(f"with recursive {ONE_SIZE} select cast(doc_id as varchar) as doc_id, printf('%d_text_%04d', doc_id, n) as chunk_id, 'text' as chunk_type, content, cast(length(content) as int) as char_len, cast(1 as int) as source_segment_index, cast(size as int) as chunk_size, cast(overlap as int) as overlap from chunks")
def chunk_documents(spark, sf_dir):
    return chunking.chunk_documents(table(spark, sf_dir, "documents"))


@registered(f"with recursive {GRID} select cast(size as int) as chunk_size, cast(overlap as int) as overlap, count(*) as total_chunks, count(*) as text_chunks, cast(0 as bigint) as table_chunks, round(avg(length(content)), 2) as avg_len, cast(min(length(content)) as int) as min_len, cast(max(length(content)) as int) as max_len from chunks group by all")
def chunk_grid_stats(spark, sf_dir):
    return chunking.grid_stats(table(spark, sf_dir, "documents"))


@registered("select doc, cast(row_number() over (partition by doc order by p, t desc) as int) as segment_index, t as segment_type from (select doc, p, unnest(['text', 'table']) as t from (select l_orderkey as doc, row_number() over (partition by l_orderkey order by l_linenumber) as p from lineitem))")
def segment_orders(spark, sf_dir):
    """A document for each order: a line of text and a fenced table for each of its lines."""
    part = F.concat(F.lit("about "), F.col("l_partkey").cast("string"), F.lit("\n[TABLE_START]\n| line |\n| "), F.col("l_linenumber").cast("string"), F.lit(" |\n[TABLE_END]\n"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", part.alias("p")))), lambda x: x["p"]), "")
    docs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(listed.alias("text"))
    return chunking.segments(docs).select("doc", F.col("segment_index").cast("int"), "segment_type")


@registered("""with p as (select b.item_id as qid, d.doc_id, case when d.lang = 'en' and d.source = 'src' || (b.item_id % 30) then 0 when d.lang = 'en' and b.item_id % 30 < 25 then 1 else 2 end as level from benchmark b, documents d where b.item_id % 20 = 0)
select qid, cast(count(*) as bigint) as n, cast(min(level) as int) as level from (select *, min(level) over (partition by qid) as m from p) where level = m group by qid""")
def route_relaxed(spark, sf_dir):
    """The `lang` and `source` of documents stand for company and period; queries meet counts of documents, not documents."""
    asked = table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), (F.col("item_id") % 30).cast("string")).alias("source"))
    asked = asked.groupBy("qid", "source").agg(F.count("*").alias("times"))
    docs = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    totals = docs.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("lang") == "en", F.col("n"))).alias("en"))
    counted = asked.join(docs.filter("lang = 'en'").select("source", "n"), "source", "left").join(F.broadcast(totals))
    no_period = (F.col("qid") % 30 < 25) & (F.col("en") > 0)
    level = F.when(F.col("n") > 0, 0).when(no_period, 1).otherwise(2)
    n = F.coalesce(F.col("n"), F.when(no_period, F.col("en")), F.col("all"))
    return counted.select("qid", (n * F.col("times")).alias("n"), level.alias("level")).filter("n > 0")


def _routed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, four to a document: the source stands for the company, the id gives a year, the language a period."""
    docs = table(spark, sf_dir, "documents")
    period = F.when(F.col("lang") == "en", "annual").when(F.col("lang") == "de", "q1").otherwise("")
    name = F.concat(F.lit("d"), F.floor(F.col("doc_id") / 4).cast("string"))
    names = F.array_compact(F.array("source", name, F.concat(F.col("doc_id").cast("string"), F.lit(".md"))))
    return docs.select(F.col("doc_id").alias("key"), name.alias("doc"), "text", names.alias("companies"), (2020 + F.col("doc_id") % 3).cast("string").alias("year"), period.alias("period"))


def _routed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as parsed questions, each in seven ways: company, year and period or some of them, a company that no chunk has, or nothing.

    A company is a part of its sources' names; metrics are parts of words.
    """
    item, way = F.col("item_id"), F.col("way")
    company = F.when(way.isin(1, 5, 6), "").when(way == 4, "nobody").otherwise(F.concat(F.lit("RC "), ((F.floor(item / 20) + way) % 20).cast("string")))
    year = F.when(way.isin(1, 2, 6), "").otherwise((2020 + way % 3).cast("string"))
    period = F.when(way.isin(3, 6), "").when(way % 2 == 0, "annual").otherwise("q3")
    metric = F.when(way % 3 == 0, "tion").when(way % 3 == 1, "ment").otherwise("")
    rows = table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select("item_id", "text", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("way"))
    return rows.select((10 * item + way).alias("qid"), item.alias("item"), F.col("text").alias("query"), company.alias("company_short"), year.alias("year"), period.alias("period"), metric.alias("metric"))


ROUTED_SQL = """
q as (select 10 * item_id + v as qid, item_id as item, text as query, case when v in (1, 5, 6) then '' when v = 4 then 'nobody' else 'rc' || cast(((item_id - item_id % 20) / 20 + v) % 20 as bigint) end as company, case when v in (1, 2, 6) then '' else cast(2020 + v % 3 as varchar) end as year,
  case when v in (3, 6) then '' when v % 2 = 0 then 'annual' else 'q3' end as period, case v % 3 when 0 then 'tion' when 1 then 'ment' else '' end as metric from (select *, unnest(range(0, 7)) as v from benchmark where item_id % 20 = 0)),"""
ROUTE_SQL = ROUTED_SQL + """
c as (select doc_id as key, 'd' || cast((doc_id - doc_id % 4) / 4 as bigint) as doc, text, lower(source) as source, cast(2020 + doc_id % 3 as varchar) as year, case lang when 'en' then 'annual' when 'de' then 'q1' else '' end as period from documents),
hits as (select qid, key, case when q.period = '' or c.period = '' or c.period = q.period then 0 else 1 end as level from q join c on (q.company <> '' or q.year <> '' or q.period <> '') and (q.company = '' or contains(c.source, q.company) or contains(c.doc, q.company) or contains(c.key || '.md', q.company)) and (q.year = '' or c.year = q.year)
  and (q.company <> '' or q.year <> '' or c.period = '' or c.period = q.period)),
best as (select qid, min(level) as m from hits group by qid),
cand as (select qid, key, level from hits join best using (qid) where level = m union all select qid, key, 2 from q, c where qid not in (select qid from best))"""
LOCAL_SQL = f"""{ROUTE_SQL},
docs as (select key, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from c),
cd as (select cand.qid, docs.key, w from cand join docs using (key)),
sizes as (select qid, count(*) as n, avg(len(w)) as a from cd group by qid),
postings as (select qid, key, len(w) as l, word, count(*) as tf from (select qid, key, w, unnest(w) as word from cd) group by qid, key, l, word),
df as (select qid, word, count(*) as df from postings group by qid, word),
raw as (select qid, word, ln(n - df + 0.5) - ln(df + 0.5) as idf from df join sizes using (qid)),
idf as (select qid, word, case when idf < 0 then 0.25 * avg(idf) over (partition by qid) else idf end as idf from raw),
asked as (select qid, word, count(*) as times from (select qid, unnest(regexp_extract_all(coalesce(query, ''), '{WORD}')) as word from q) group by qid, word),
scored as (select qid, key, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) as score from postings join asked using (qid, word) join idf using (qid, word) join sizes using (qid) group by qid, key having sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) > 0),
bm25 as (select qid, key, score, rank from (select *, row_number() over (partition by qid order by round(score, 9) desc, key) as rank from scored) where rank <= ARM)"""
_SCALED = "case when max(score) over (partition by qid) - min(score) over (partition by qid) < 1e-12 then 1.0 else (score - min(score) over (partition by qid)) / (max(score) over (partition by qid) - min(score) over (partition by qid)) end as s"
CANDIDATE_SQL = LOCAL_SQL + f""",
global as (select * from (select q.qid, b.vec_id as key, list_inner_product(v.embedding::double[], b.embedding::double[]) as score,
  row_number() over (partition by q.qid order by round(list_inner_product(v.embedding::double[], b.embedding::double[]), 9) desc, b.vec_id) as rank
  from q join embeddings v on v.vec_id = q.item, embeddings b) where rank <= GLOBAL),
cdocs as (select distinct qid, doc from cand join c using (key)),
dense as (select qid, key, score, rank from (select g.qid, g.key, g.score, row_number() over (partition by g.qid order by round(g.score, 9) desc, g.key) as rank from global g join c on c.key = g.key join cdocs on cdocs.qid = g.qid and cdocs.doc = c.doc) where rank <= ARM),
dn as (select *, {_SCALED} from dense),
bn as (select *, {_SCALED} from bm25),
merged as (select coalesce(dn.qid, bn.qid) as qid, coalesce(dn.key, bn.key) as key, dn.rank as dr, bn.rank as br, 0.5 * coalesce(dn.s, 0) + 0.5 * coalesce(bn.s, 0) as score from dn full outer join bn on dn.qid = bn.qid and dn.key = bn.key),
fused as (select * from (select *, row_number() over (partition by qid order by round(score, 9) desc, dr nulls last, br nulls last, key) as rank from merged) where rank <= ARM)"""
HITS_SQL = "(select count(*) from (select distinct unnest(regexp_extract_all(q.query, '[\\p{L}\\p{N}]{2,}')) as t) where contains(coalesce(c.text, ''), t))"


def evidence_sql(arm: int = 50, top: int = 300) -> str:
    """The evidence of the questions q, by arms of so many hits and so many dense hits of the whole corpus."""
    sql = CANDIDATE_SQL + f""",
signals as (select f.qid, f.key, f.rank as hybrid_rank, 0.1 * f.score + case when q.metric <> '' and contains(coalesce(c.text, ''), q.metric) then 10 else 0 end + {HITS_SQL} as score from fused f join q using (qid) join c using (key)),
evidence as (select * from (select *, row_number() over (partition by qid order by round(score, 9) desc, hybrid_rank, key) as rank from signals where score > 0) where rank <= 10)"""
    return sql.replace("ARM", str(arm)).replace("GLOBAL", str(top))


@registered(f"with {ROUTE_SQL} select qid, count(*) as chunks, count(distinct doc) as docs, cast(min(level) as int) as level from cand join c using (key) group by qid")
def route_chunks(spark, sf_dir):
    return routing.routes(_routed_questions(spark, sf_dir), _routed_chunks(spark, sf_dir)).counts()


@registered(f"with {LOCAL_SQL.replace('ARM', '50')} select qid, key, round(score, 6) as score, cast(rank as int) as rank from bm25 where qid in (select qid from best)")
def bm25_routed(spark, sf_dir):
    chunks, asked = _routed_chunks(spark, sf_dir), _routed_questions(spark, sf_dir)
    routed = routing.routes(asked, chunks)
    texts = asked.select("qid", F.col("query").alias("text")).join(routed.asked, "qid")
    return _rounded(retriever.bm25_in_candidates(chunks, texts, routed.candidates(), 50, WORD), "score").select("qid", "key", "score", "rank")


def _global_hits(spark: SparkSession, sf_dir: str, asked: DataFrame, k: int = 500) -> DataFrame:
    """The dense hits of the questions (qid, item), whose vectors are their items'."""
    vectors = _vectors(spark, sf_dir).select("key", "vector")
    return dense.exact_top_k(asked.select("qid", "item").join(vectors.withColumnRenamed("key", "item"), "item").select("qid", "vector"), vectors, k)


@registered(f"with {evidence_sql()} select qid, key, round(score, 6) as score, cast(rank as int) as rank from evidence")
def retrieve_fact(spark, sf_dir):
    asked = _routed_questions(spark, sf_dir)
    return _rounded(retriever.retrieve(asked, _routed_chunks(spark, sf_dir), _global_hits(spark, sf_dir, asked), pattern=WORD), "score")


SUMMARY_SQL = evidence_sql(retriever.SUMMARY_ARM, retriever.SUMMARY_GLOBAL).replace("case when v in (3, 6) then ''", "case when v in (1, 3, 6) then ''")


@registered(f"with {SUMMARY_SQL} select qid, key, round(score, 6) as score, cast(rank as int) as rank from evidence")
def retrieve_summary(spark, sf_dir):
    """In the sizes of summaries; the question of a period alone is not routed."""
    asked = _routed_questions(spark, sf_dir)
    return _rounded(retriever.retrieve_summary(asked, _routed_chunks(spark, sf_dir), _global_hits(spark, sf_dir, asked), pattern=WORD), "score")


@registered("select page_id, coalesce(nullif(regexp_extract(url, '(20[0-9]{2})', 1), ''), '') as year, lower(regexp_replace(url, '\\s+', '', 'g')) as normal from pages")
def url_years(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.extract_year(F.col("url")).alias("year"), T.normalize_text(F.col("url")).alias("normal"))


@registered("select c_custkey, 'x' || (2020 + c_custkey % 5) || '年' || case c_custkey % 4 when 0 then '年度报告' when 1 then '半年度报告' when 2 then '第一季度报告' else '第三季度报告' end as name, cast(2020 + c_custkey % 5 as varchar) as year, case c_custkey % 4 when 0 then 'annual' when 1 then 'semi_annual' when 2 then 'q1' else 'q3' end as period, case c_custkey % 4 when 0 then 'annual_report' when 1 then 'semi_annual_report' else 'quarterly_report' end as doc_type, lower(regexp_replace(c_name, '[^A-Za-z]', '', 'g')) as company_short from customer")
def file_name_metadata(spark, sf_dir):
    """Names of report files are derived from customers: name, year and report type by key."""
    rows = table(spark, sf_dir, "customer")
    year = F.concat((2020 + F.col("c_custkey") % 5).cast("string"), F.lit("年"))
    kind = F.get(F.array(*map(F.lit, ("年度报告", "半年度报告", "第一季度报告", "第三季度报告"))), (F.col("c_custkey") % 4).cast("int"))
    company = F.lower(F.regexp_replace("c_name", "[^A-Za-z]", ""))
    found = rows.select("c_custkey", F.concat(F.lit("x"), year, kind).alias("name"), metadata.from_file_name(F.concat(company, F.lit("股份有限公司："), year, kind, F.lit(".pdf"))).alias("m"))
    return found.select("c_custkey", "name", "m.year", "m.period", "m.doc_type", "m.company_short")


QUESTION_SQL = f"""
named as (select n_nationkey as k, n_name || '公司' as alias, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as short from nation),
o as (select o_orderkey as qid, (c_nationkey + 1 + o_orderkey % 24) % 25 as other, c_nationkey as own, cast(year(o_orderdate) + 20 as varchar) as year, quarter(o_orderdate) as q, {list(Q.METRICS)}[1 + o_orderkey % {len(Q.METRICS)}] as m from orders join customer on o_custkey = c_custkey),
texts as (select qid, year, case q when 1 then 'q1' when 2 then 'semi_annual' when 3 then 'q3' else 'annual' end as period,
  case when qid % 10 = 7 then '' when qid % 3 = 0 then a.short || '|' || b.short else a.short end as companies, case when qid % 3 = 1 then '' else m end as metric,
  case when qid % 10 = 7 then '无名公司' when qid % 3 = 0 then a.alias || '和' || b.alias else a.alias end || year || '年' || ['第一季度', '半年度', '第三季度', '年度'][q] || case qid % 3 when 0 then m || '谁更高' when 1 then '主要趋势' else m || '是多少' end as query
  from o join named a on a.k = own join named b on b.k = other),
parsed as (select qid, query, companies, split_part(companies, '|', 1) as company_short, year, period, metric, case when contains(companies, '|') then 'compare' when qid % 3 = 1 then 'summary' else 'fact' end as question_type from texts)"""


def _spoken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A question for each order: year (20 years on) and period from its date, metric and wording by its key, its customer's nation as company.

    Of three orders one asks to compare with another nation and one for a summary; every tenth names no known company.
    The companies' aliases come with them.
    """
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit("公司")).alias("name"), F.initcap("n_name").alias("short"))
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.withColumn("other", (F.col("c_nationkey") + 1 + key % 24) % 25)
    for name, at in (("a", "c_nationkey"), ("b", "other")):
        rows = rows.join(F.broadcast(nations.select(F.col("n_nationkey").alias(f"{name}_key"), F.col("name").alias(name))), F.col(at) == F.col(f"{name}_key"))
    period = F.get(F.array(*map(F.lit, ("第一季度", "半年度", "第三季度", "年度"))), F.quarter(date) - 1)
    metric = F.get(F.array(*map(F.lit, Q.METRICS)), (key % len(Q.METRICS)).cast("int"))
    who = F.when(key % 10 == 7, "无名公司").when(key % 3 == 0, F.concat("a", F.lit("和"), "b")).otherwise(F.col("a"))
    what = F.when(key % 3 == 0, F.concat(metric, F.lit("谁更高"))).when(key % 3 == 1, "主要趋势").otherwise(F.concat(metric, F.lit("是多少")))
    asked = rows.select(key.alias("qid"), F.concat(who, (F.year(date) + 20).cast("string"), F.lit("年"), period, what).alias("query"))
    return asked, nations.select(F.col("name").alias("alias"), "short")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.parse_queries(*_spoken(spark, sf_dir))


@registered(f"with {QUESTION_SQL} select * from parsed")
def parse_query(spark, sf_dir):
    return _questions(spark, sf_dir).withColumn("companies", F.array_join("companies", "|"))


@registered(f"with {QUESTION_SQL} select qid, cast(i as int) as sub_idx, split_part(companies, '|', i + 1) as company, split_part(companies, '|', i + 1) || case when metric = '' then ' ' || query else year || '年' || metric || '是多少？' end as sub_query from parsed, (select unnest([0, 1]) as i) where question_type = 'compare'")
def compare_subqueries(spark, sf_dir):
    return Q.compare_subqueries(_questions(spark, sf_dir))


RERANK_SQL = FUSED_SQL + """,
texts as (select f.qid, f.key, f.rank, f.score, b.text as query, 'document: ' || f.key || case when d.text <> '' then chr(10) || 'content: ' || d.text else '' end as passage from fused f join documents d on d.doc_id = f.key join benchmark b on b.item_id = f.qid),
again as (select *, 0.1 * score + (select count(*) from (select distinct unnest(regexp_extract_all(query, '[\\p{L}\\p{N}]{2,}')) as t) where contains(d_content, t)) as s from (select t.*, d.text as d_content from texts t join documents d on d.doc_id = t.key)),
reranked as (select * from (select *, row_number() over (partition by qid order by round(s, 9) desc, rank, key) as new_rank from again) where new_rank <= 5)"""


def _with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits' texts, joined after the search."""
    hits = _hybrid(spark, sf_dir).select("qid", "key", "score", "rank")
    hits = hits.join(_corpus(spark, sf_dir).withColumnRenamed("text", "content"), "key")
    return hits.join(_asked(spark, sf_dir).withColumnRenamed("text", "query"), "qid")


@registered(f"with {RERANK_SQL} select qid, key, cast(rank as int) as hybrid_rank, round(s, 6) as reranker_score, cast(new_rank as int) as rank from reranked")
def rerank_topk(spark, sf_dir):
    return _rounded(A.rerank(_with_text(spark, sf_dir), 5), "reranker_score").select("qid", "key", "hybrid_rank", "reranker_score", "rank")


@registered(f"""with {RERANK_SQL}, flat as (select *, regexp_replace(regexp_replace(coalesce(d_content, ''), '\\s+', ' ', 'g'), '^ | $', '', 'g') as f from reranked where new_rank = 1)
select item_id as qid, case when f is null then '{A.REFUSAL}' when length(f) <= 900 then f || ' [E1]' else rtrim(left(f, 900)) || '... [E1]' end as answer, f is null as refused, case when f is null then '' else 'E1' end as citations, true as passed from benchmark left join flat on qid = item_id where item_id % 20 = 0""")
def answers(spark, sf_dir):
    """Evidence-bound answers of the template generator, guarded by their citations."""
    hits = A.rerank(_with_text(spark, sf_dir), 5).select("qid", "key", "content", F.col("reranker_score").alias("score"), "rank")
    return A.answer(hits, _asked(spark, sf_dir).withColumnRenamed("text", "query")).select("qid", "answer", "refused", F.array_join("citation_check.citations", "|").alias("citations"), F.col("citation_check.passed").alias("passed"))


@registered("""with t as (select event_id, case event_id % 5 when 0 then 'So [E1] and [E3] [E1].' when 1 then 'None.' when 2 then 'The evidence at hand does not answer this question. ' when 3 then 'See [E1, E2] [E9].' else 'See [E2].' end as a, event_id % 5 as m from events)
select event_id, cast(case m when 0 then 2 when 3 then 1 when 4 then 1 else 0 end as int) as n_citations, cast(case m when 3 then 1 else 0 end as int) as n_invalid, m in (0, 2, 4) as passed from t""")
def citation_check(spark, sf_dir):
    """Answers with all kinds of marks, dealt to events, against evidence E1 to E3."""
    texts = F.array(*map(F.lit, ("So [E1] and [E3] [E1].", "None.", A.REFUSAL + " ", "See [E1, E2] [E9].", "See [E2].")))
    checked = table(spark, sf_dir, "events").select("event_id", A.check_citations(F.get(texts, (F.col("event_id") % 5).cast("int")), F.array(*map(F.lit, ("E1", "E2", "E3")))).alias("c"))
    return checked.select("event_id", F.size("c.citations").alias("n_citations"), F.size("c.invalid_citations").alias("n_invalid"), "c.passed")


def _label_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of the first other vector of the same label, by method; the label stands for the question type."""
    labels = _vectors(spark, sf_dir).select("key", "label")
    hits = _dense(spark, sf_dir).join(labels, "key").join(_vector_queries(spark, sf_dir).select("qid", "asked_label"), "qid")
    typed = hits.select("qid", F.col("asked_label").cast("string").alias("question_type"), F.lit("dense").alias("method"), "key", "rank", (F.col("label") == F.col("asked_label")).alias("same"))
    return evaluate.first_ranks(typed, F.col("same") & (F.col("key") != F.col("qid")), ("qid", "question_type", "method"))


RANKS_SQL = DENSE_SQL + ",\nranks as (select qid, cast(asked_label as varchar) as question_type, 'dense' as method, coalesce(min(case when label = asked_label and key <> qid then rank end), -1) as rank from dense group by qid, asked_label)"
METRICS_SQL = ", ".join(f"round(avg(case when rank between 1 and {k} then 1.0 else 0.0 end), 6) as {n}" for k, n in ((3, "recall_3"), (5, "recall_5"), (10, "recall_10"), (1, "top1"))) + ", round(avg(case when rank between 1 and 5 then 1.0 / rank else 0.0 end), 6) as mrr_5, count(*) as items"
METRIC_NAMES = ("recall_3", "recall_5", "recall_10", "top1", "mrr_5")


@registered(f"with {RANKS_SQL} select method, {METRICS_SQL} from ranks group by method")
def retrieval_metrics(spark, sf_dir):
    return _rounded(evaluate.metrics(_label_ranks(spark, sf_dir)), *METRIC_NAMES)


@registered(f"with {RANKS_SQL} select coalesce(question_type, 'all') as question_type, method, {METRICS_SQL} from ranks group by grouping sets ((method), (question_type, method))")
def metrics_by_type(spark, sf_dir):
    return _rounded(evaluate.metrics_by_type(_label_ranks(spark, sf_dir)), *METRIC_NAMES)


@registered("select event_type, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by event_type")
def latency_percentiles(spark, sf_dir):
    return _rounded(evaluate.latency(table(spark, sf_dir, "events"), "value", ["event_type"]), "mean", "p50", "p95")


@registered("select l_orderkey as qid, l_returnflag as method, cast(case when min(case when l_linenumber > 6 then -1 else l_linenumber end) = -1 then -1 else max(l_linenumber) end as int) as rank from lineitem group by 1, 2")
def compare_ranks(spark, sf_dir):
    """An order's lines stand for the sub-queries of a comparison, their numbers for ranks, those over 6 for misses."""
    subs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_returnflag").alias("method"), F.when(F.col("l_linenumber") > 6, -1).otherwise(F.col("l_linenumber").cast("int")).alias("rank"))
    return evaluate.combined_ranks(subs)


@registered("select doc_id, source from (select doc_id, source, row_number() over (partition by source order by n_chars desc, doc_id) as r from documents) where r = 1")
def dedup_first(spark, sf_dir):
    return ranking.first_of(table(spark, sf_dir, "documents"), ["source"], [F.col("n_chars").desc(), F.col("doc_id")]).select("doc_id", "source")


BOXES_SQL = "boxes as (select l_orderkey as doc, l_linenumber as seq, l_quantity as x0, l_discount * 1000 as y0, l_quantity + 20 as x1, l_discount * 1000 + 30 as y1 from lineitem)"


@registered(f"with {BOXES_SQL}, p as (select a.doc, a.seq as a_seq, b.seq as b_seq, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as i from boxes a join boxes b on a.doc = b.doc and a.seq < b.seq) select doc, a_seq, b_seq, round(i / (1200 - i), 6) as iou, round(i / 600, 6) as cover from p where i > 0")
def bbox_overlaps(spark, sf_dir):
    """Boxes are derived from lines of orders, pages being orders."""
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").alias("x0"), (F.col("l_discount") * 1000).alias("y0"), (F.col("l_quantity") + 20).alias("x1"), (F.col("l_discount") * 1000 + 30).alias("y1"))
    pairs = boxes.alias("a").join(boxes.alias("b"), (F.col("a.doc") == F.col("b.doc")) & (F.col("a.seq") < F.col("b.seq")))
    found = pairs.select(F.col("a.doc").alias("doc"), F.col("a.seq").alias("a_seq"), F.col("b.seq").alias("b_seq"), F.round(layout.iou("a", "b"), 6).alias("iou"), F.round(layout.cover("a", "b"), 6).alias("cover"))
    return found.filter("iou > 0")


@registered()
def reading_order(spark, sf_dir):
    """Blocks are derived from orders' lines: two columns, by return flag."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_orderkey") * 0).cast("int").alias("page_no"), F.lit(600.0).alias("page_width"), F.when(F.col("l_returnflag") == "N", 50.0).otherwise(330.0).alias("x0"), (F.col("l_linenumber") * 100.0).alias("y0"), F.col("l_linenumber").cast("int").alias("line"))
    return layout.reading_order(lines).select("doc_id", "line", "column_no", "block_seq")


@registered("select o_custkey, '| order | status |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' |', chr(10) order by o_orderkey) as markdown, count(*) >= 3 as valid from orders group by o_custkey")
def table_to_markdown(spark, sf_dir):
    """A table for each customer, a row for each order: valid from three orders on, as a table needs three cells with digits."""
    row = F.struct("o_orderkey", F.array(F.col("o_orderkey").cast("string"), "o_orderstatus").alias("cells"))
    tables = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat(F.array(F.array(F.lit("order"), F.lit("status"))), F.transform(F.sort_array(F.collect_list(row)), lambda r: r["cells"])).alias("rows"))
    return tables.select("o_custkey", layout.table_to_markdown(F.col("rows")).alias("markdown"), layout.is_valid_table(F.col("rows")).alias("valid"))


@registered()
def ivf_topk(spark, sf_dir):
    vectors = _vectors(spark, sf_dir).select("key", "vector")
    centres = dense.train_centres(vectors, dense.list_count(vectors.count()))
    return dense.ivf_top_k(_vector_queries(spark, sf_dir).select("qid", "vector"), dense.assign(vectors, centres), centres, 10, probes=max(10, len(centres) // 2))


@registered()
def pq_topk(spark, sf_dir):
    vectors = _vectors(spark, sf_dir).select("key", "vector")
    books = dense.train_codebooks(vectors)
    return dense.pq_top_k(_vector_queries(spark, sf_dir).select("qid", "vector"), dense.encode_codes(vectors, books), books, 10, rows=vectors.count())


def _recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    both = exact.select("qid", "key").join(found.select("qid", "key").withColumn("hit", F.lit(1.0)), ["qid", "key"], "left")
    return both.agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))


@registered()
def ann_recall(spark, sf_dir):
    """Recall of the inverted lists against the exact search."""
    return _recall(_dense(spark, sf_dir), ivf_topk(spark, sf_dir))


@registered()
def pq_recall(spark, sf_dir):
    """Recall of the rescored product quantiser against the exact search."""
    return _recall(_dense(spark, sf_dir), pq_topk(spark, sf_dir))


@registered()
def hnsw_topk(spark, sf_dir):
    """Hits of the layered graphs, with the number of products that each query took; a test holds them against the exact search."""
    index = graph.graph_index(_vectors(spark, sf_dir).select("key", "vector"))
    return _rounded(graph.graph_top_k(_vector_queries(spark, sf_dir).select("qid", "vector"), index, 10), "score")


@registered()
def hnsw_recall(spark, sf_dir):
    """Recall of the graphs against the exact search, and the share of all products that they took."""
    found = hnsw_topk(spark, sf_dir)
    share = found.filter("rank = 1").agg(F.avg("products").alias("products")).join(_vectors(spark, sf_dir).agg(F.count("*").alias("n")))  # a row each
    return _recall(_dense(spark, sf_dir), found).join(share.select(F.round(F.col("products") / F.col("n"), 6).alias("share_of_products")))


@registered("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def windowed_events(spark, sf_dir):
    from quillon.streaming.incremental import windowed_counts

    out = windowed_counts(table(spark, sf_dir, "events"))
    return _rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), "total")
