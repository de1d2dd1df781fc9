"""Retrieval metrics over ranks, in long form: (qid, question_type, method, rank), -1 for a miss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import doc_ids_match


def keyword_groups_hit(content: Column, groups: Column) -> Column:
    """How many groups of other names have one in the content."""
    return F.size(F.filter(groups, lambda g: F.exists(g, lambda k: F.contains(content, k))))


def keyword_match(content: Column, groups: Column, mode: str = "all", min_hits: int = 1) -> Column:
    """all, any, or at_least min_hits groups (all where there are fewer); true without groups."""
    if mode not in ("all", "any", "at_least"):
        raise ValueError(f"unknown mode {mode}")
    n = F.size(groups)
    need = {"all": n, "any": F.least(F.lit(1), n), "at_least": F.least(F.lit(min_hits), n)}[mode]
    return keyword_groups_hit(content, groups) >= need


#: Other names of metrics that count as a keyword's hit in evaluation.
KEYWORD_ALIASES = {
    "研发费用": ("研发费用", "研发投入", "研发投入金额"),
    "研发投入": ("研发投入", "研发费用", "研发投入金额"),
    "研发投入占营业收入比例": ("研发投入占营业收入比例", "研发投入比例", "研发投入占比"),
    "营业收入": ("营业收入", "主营业务收入", "收入"),
    "主营业务收入": ("主营业务收入", "营业收入", "收入"),
    "归母净利润": ("归母净利润", "归属于上市公司股东的净利润"),
    "归属于上市公司股东的净利润": ("归属于上市公司股东的净利润", "归母净利润"),
    "总资产": ("总资产", "资产总计", "资产总额"),
    "资产总计": ("资产总计", "总资产", "资产总额"),
    "资产负债率": ("资产负债率",),
    "经营活动现金流入": ("经营活动现金流入", "经营活动现金流入小计"),
    "经营活动产生的现金流量净额": ("经营活动产生的现金流量净额", "经营活动现金流量净额", "经营活动产生的现金流量"),
    "毛利率": ("毛利率",),
    "基本每股收益": ("基本每股收益",),
    "保证借款": ("保证借款",),
    "动力电池销量": ("动力电池销量", "动力电池", "销量"),
    "储能电池销量": ("储能电池销量", "储能电池", "销量"),
    "正极材料": ("正极材料",),
    "销量": ("销量",),
    "组件": ("组件",),
    "出货量": ("出货量", "发货量"),
    "风电": ("风电", "风力发电"),
}


def keyword_groups(keywords: Column, use_alias: bool = True) -> Column:
    """For each keyword that is not blank the array of its other names, or itself."""
    shown = F.filter(F.transform(keywords, lambda k: F.trim(k)), lambda k: k != "")
    if not use_alias:
        return F.transform(shown, lambda k: F.array(k))
    known = F.create_map(*[x for k, v in KEYWORD_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.transform(shown, lambda k: F.coalesce(F.try_element_at(known, k), F.array(k)))


def any_doc_matches(predicted: Column, truths: Column) -> Column:
    return F.exists(truths, lambda t: doc_ids_match(predicted, t))


def item_ranks(items: DataFrame, hits: DataFrame, summary_hits: int = 1, use_alias: bool = True, methods: DataFrame | None = None) -> DataFrame:
    """(qid, question_type, method, doc_rank, evidence_rank), -1 for a miss, of items (qid, question_type, truths, keywords) by hits (qid, method, doc_id, content, rank).

    A document hit is of one of the truths; an evidence hit has the keywords as well: all of them, of a summary
    summary_hits at least. Without keywords it is the document hit. methods (method) are by default those of the hits.
    """
    groups = keyword_groups(F.col("keywords"), use_alias)
    methods = hits.select("method").distinct() if methods is None else methods
    rows = items.withColumn("groups", groups).join(F.broadcast(methods)).join(hits, ["qid", "method"], "left")
    doc = F.coalesce(any_doc_matches(F.col("doc_id"), F.col("truths")), F.lit(False))
    said = F.when(F.col("question_type") == "summary", keyword_match(F.col("content"), F.col("groups"), "at_least", summary_hits)).otherwise(keyword_match(F.col("content"), F.col("groups")))
    low = lambda test: F.coalesce(F.min(F.when(test, F.col("rank"))), F.lit(-1))
    return rows.groupBy("qid", "question_type", "method").agg(low(doc).alias("doc_rank"), low(doc & F.coalesce(said, F.lit(False))).alias("evidence_rank"))


def experiment_sizes(name: Column) -> Column:
    """struct(experiment, chunk_size, overlap) from a chunk file's name such as all_cs1024_ov50.jsonl; null sizes for other names."""
    stem = F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"\.[^.]*$", "")
    size = lambda i: F.nullif(F.regexp_extract(stem, r"cs(\d+)_ov(\d+)", i), F.lit("")).cast("int")
    return F.struct(stem.alias("experiment"), size(1).alias("chunk_size"), size(2).alias("overlap"))


def experiment_summary(ranks: DataFrame, ks: Sequence[int] = (3, 5, 10), methods: Sequence[str] = ("dense", "bm25", "hybrid")) -> DataFrame:
    """A row for each experiment of ranks (experiment, qid, method, rank): its name's sizes, its questions, each method's recalls."""
    sizes = experiment_sizes(F.col("experiment"))
    columns = [recall_of(m, k).alias(f"{m}_recall_{k}") for m in methods for k in ks]
    out = ranks.groupBy("experiment").agg(F.count_distinct("qid").alias("total_queries"), *columns)
    return out.select("experiment", sizes["chunk_size"].alias("chunk_size"), sizes["overlap"].alias("overlap"), *out.columns[1:])


def recall_of(method: str, k: int) -> Column:
    """recall_at(k) of a method's rows alone; 0 without any."""
    hit = F.when(F.col("rank").between(1, k), 1.0).otherwise(0.0)
    return F.coalesce(F.avg(F.when(F.col("method") == method, hit)), F.lit(0.0))


def first_ranks(hits: DataFrame, hit: Column, by: Sequence[str] = ("qid", "method")) -> DataFrame:
    """The lowest rank of a hit in each group, else -1."""
    return hits.groupBy(*by).agg(F.coalesce(F.min(F.when(hit, F.col("rank"))), F.lit(-1)).alias("rank"))


def combined_ranks(subs: DataFrame, by: Sequence[str] = ("qid", "method")) -> DataFrame:
    """A comparison's rank: the worst of its sub-queries', -1 where one misses."""
    return subs.groupBy(*by).agg(F.when(F.min("rank") == -1, -1).otherwise(F.max("rank")).alias("rank"))


def recall_at(k: int, rank: str = "rank") -> Column:
    return F.coalesce(F.avg(F.when(F.col(rank).between(1, k), 1.0).otherwise(0.0)), F.lit(0.0))


def mrr_at(k: int, rank: str = "rank") -> Column:
    return F.coalesce(F.avg(F.when(F.col(rank).between(1, k), 1.0 / F.col(rank)).otherwise(0.0)), F.lit(0.0))


def metrics(ranks: DataFrame, ks: Sequence[int] = (3, 5, 10), mrr_k: int = 5, by: Sequence[str] = ("method",)) -> DataFrame:
    columns = [recall_at(k).alias(f"recall_{k}") for k in ks] + [recall_at(1).alias("top1"), mrr_at(mrr_k).alias(f"mrr_{mrr_k}"), F.count("*").alias("items")]
    return ranks.groupBy(*by).agg(*columns)


def metrics_by_type(ranks: DataFrame, ks: Sequence[int] = (3, 5, 10), mrr_k: int = 5) -> DataFrame:
    """Totals by method and by question type and method in one pass; the type of totals is `all`."""
    typed = ranks.groupingSets([["method"], ["question_type", "method"]], "question_type", "method")
    columns = [recall_at(k).alias(f"recall_{k}") for k in ks] + [recall_at(1).alias("top1"), mrr_at(mrr_k).alias(f"mrr_{mrr_k}"), F.count("*").alias("items")]
    return typed.agg(*columns, F.grouping("question_type").alias("total")).withColumn("question_type", F.when(F.col("total") == 1, "all").otherwise(F.col("question_type"))).drop("total")


def latency(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean, median and 95th percentile, interpolated."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"))


def deltas(table: DataFrame, base: str, other: str, names: Sequence[str]) -> DataFrame:
    """other's metrics less base's, from a table with a row for each method."""
    a, b = (table.filter(F.col("method") == m).select(*[F.col(n).alias(f"{n}_{i}") for n in names]) for i, m in enumerate((base, other)))
    return a.join(F.broadcast(b)).select(*[(F.col(f"{n}_1") - F.col(f"{n}_0")).alias(f"delta_{n}") for n in names])


def markdown(table: DataFrame, title: str, limit: int = 1000) -> str:
    """A report's table as Markdown; one of more than limit rows is no report and fails."""
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{title} has more than {limit} rows")
    shown = lambda x: f"{x:.4f}".rstrip("0").rstrip(".") if isinstance(x, float) else str(x)
    lines = [f"## {title}", "", "| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns)]
    return "\n".join([*lines, *["| " + " | ".join(map(shown, r)) + " |" for r in rows]]) + "\n"
