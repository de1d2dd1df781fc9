"""Query understanding: one expression for each field over a table of queries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import extract_period, extract_year
from quillon.operators.metadata import apply_aliases

#: Metrics that queries ask for.
METRICS = (
    "归属于上市公司股东的净利润", "经营活动产生的现金流量净额", "经营活动现金流入", "主营业务收入", "营业收入", "研发费用", "研发投入", "研发投入占营业收入比例", "毛利率", "资产负债率", "总资产", "资产总计", "归母净利润",
    "基本每股收益", "风电发电量", "保证借款", "动力电池销量", "储能电池销量", "正极材料销量", "组件出货量", "汽车销量", "销量", "出货量", "收入", "利润",
)
#: Other names of metrics, by which evidence is ordered.
METRIC_ALIASES = {
    "归母净利润": ("归母净利润", "归属于上市公司股东的净利润"),
    "归属于上市公司股东的净利润": ("归属于上市公司股东的净利润", "归母净利润"),
    "研发投入": ("研发投入", "研发费用"),
    "研发费用": ("研发费用", "研发投入"),
    "总资产": ("总资产", "资产总计", "资产总额"),
    "资产总计": ("资产总计", "总资产", "资产总额"),
    "主营业务收入": ("主营业务收入", "营业收入"),
    "营业收入": ("营业收入", "主营业务收入", "收入"),
    "经营活动现金流入": ("经营活动现金流入", "经营活动现金流量流入"),
    "经营活动产生的现金流量净额": ("经营活动产生的现金流量净额", "经营活动现金流量净额", "经营活动产生的现金流量"),
    "保证借款": ("保证借款",),
    "毛利率": ("毛利率",),
    "资产负债率": ("资产负债率",),
    "基本每股收益": ("基本每股收益",),
    "风电发电量": ("风电", "发电量"),
    "动力电池销量": ("动力电池销量", "动力电池", "销量"),
    "储能电池销量": ("储能电池销量", "储能电池", "销量"),
    "组件出货量": ("组件", "出货量"),
    "正极材料销量": ("正极材料", "销量"),
}
#: Marks of comparisons and summaries.
COMPARE = "谁更高|哪个高|谁的|相比|对比|vs|VS|和"
SUMMARY = "总结|概括|如何描述|怎么看待|有哪些|主要|判断|趋势|支持方向"


def extract_metric(query: Column) -> Column:
    """The longest that occurs, as a short one may be part of it."""
    out = F.when(F.lit(False), "")
    for m in sorted(METRICS, key=len, reverse=True):
        out = out.when(F.contains(query, F.lit(m)), m)
    return out.otherwise("")


def question_type(query: Column, companies: Column) -> Column:
    return F.when((F.size(companies) >= 2) & query.rlike(COMPARE), "compare").when(query.rlike(SUMMARY), "summary").otherwise("fact")


def parse_queries(queries: DataFrame, aliases: Mapping[str, str] | DataFrame) -> DataFrame:
    """queries (qid, query) with companies, company_short, year, period, metric and question_type."""
    rows = apply_aliases(queries.withColumn("query", F.coalesce("query", F.lit(""))), "query", aliases)
    q = F.col("query")
    return rows.withColumns({
        "company_short": F.coalesce(F.get("companies", F.lit(0)), F.lit("")), "year": extract_year(q), "period": extract_period(q),
        "metric": extract_metric(q), "question_type": question_type(q, F.col("companies")),
    })


def metric_keywords(metric: Column) -> Column:
    """The metric and its other names; none for an empty one."""
    out = F.when(F.coalesce(metric, F.lit("")) == "", F.array().cast("array<string>"))
    for name, others in METRIC_ALIASES.items():
        out = out.when(metric == name, F.array(*map(F.lit, others)))
    return out.otherwise(F.array(metric))


def compare_subqueries(parsed: DataFrame) -> DataFrame:
    """(qid, sub_idx, company, sub_query): one for each of the first two companies; none for queries with fewer."""
    two = parsed.filter(F.size("companies") >= 2).select("*", F.posexplode(F.slice("companies", 1, 2)).alias("sub_idx", "company"))
    sub = F.when((F.col("metric") != "") & (F.col("year") != ""), F.concat("company", "year", F.lit("年"), "metric", F.lit("是多少？"))).when(F.col("metric") != "", F.concat("company", "metric", F.lit("是多少？"))).otherwise(F.concat_ws(" ", "company", "query"))
    return two.select("qid", "sub_idx", "company", sub.alias("sub_query"))
