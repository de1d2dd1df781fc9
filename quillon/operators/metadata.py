"""Document metadata from file names, first lines and manual overrides, and routing of queries by it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import extract_period, extract_year, first_present, normalize_text, present
from quillon.operators.aliases import find_aliases
from quillon.operators.ranking import relaxed

FIELDS = ("doc_title", "doc_type", "source_type", "company", "company_short", "year", "period")
HEAD_CHARS = 5000
#: Report names with their document type and period.
REPORT_TYPES = {
    "年度报告": ("annual_report", "annual"), "年报": ("annual_report", "annual"), "半年度报告": ("semi_annual_report", "semi_annual"), "中期报告": ("semi_annual_report", "semi_annual"),
    "第一季度报告": ("quarterly_report", "q1"), "第二季度报告": ("quarterly_report", "q2"), "第三季度报告": ("quarterly_report", "q3"), "第四季度报告": ("quarterly_report", "q4"), "季度报告": ("quarterly_report", "quarterly"),
}
#: Names that are looked for in file names and titles, the more specific first; periods are in the queries' vocabulary.
REPORTS = {name: REPORT_TYPES[name] for name in ("半年度报告", "第一季度报告", "第三季度报告", "季度报告", "年度报告")}
#: Words of policy and research papers' names; endings of company names, and what a short name goes without, the first that fits.
POLICY = "规划|通知|意见|指导意见|办法|管理办法|实施方案|方案|政策|条例|细则|决定|公告|蓝皮书|白皮书"
RESEARCH = "行业研究|深度报告|证券研究|研报|研究报告|点评|策略"
COMPANY_ENDS = ("股份有限公司", "有限责任公司", "有限公司", "集团股份有限公司", "集团有限公司", "公司")
SHORTENED = ("新能源科技股份有限公司", "汽车电子股份有限公司", "集团股份有限公司", "股份有限公司", "有限责任公司", "集团有限公司", "有限公司", "公司")
REPORT_TITLE = r"(20\d{2})\s*年\s*(年度报告|半年度报告|第一季度报告|第三季度报告|季度报告)"


def report_type(text: Column) -> Column:
    """The first report name in the text, else empty."""
    out = F.when(F.lit(False), "")
    for name in REPORTS:
        out = out.when(F.contains(text, F.lit(name)), name)
    return out.otherwise("")


def _by_report(name: Column, item: int) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in REPORTS.items():
        out = out.when(name == k, v[item])
    return out.otherwise("")


def short_company(company: Column) -> Column:
    """Without the first ending that fits."""
    out = F.when(F.lit(False), "")
    for end in SHORTENED:
        out = out.when(F.endswith(company, F.lit(end)), F.left(company, F.char_length(company) - len(end)))
    return F.trim(out.otherwise(company))


def clean_stem(file_name: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"\.[A-Za-z0-9]+$", "")
    return F.regexp_replace(F.btrim(F.regexp_replace(stem, "【[^】]*】", ""), F.lit(" _-：:")), r"(?U)\s+", "")


def from_file_name(file_name: Column) -> Column:
    """struct of FIELDS: a company report where a company is left over, else policy, research, or a bare title."""
    stem = clean_stem(file_name)
    year, report = extract_year(stem), report_type(stem)
    company = F.regexp_replace(F.regexp_replace(F.replace(stem, report, F.lit("")), r"20\d{2}年?", ""), "[ _：:-]+|报告", "")
    company = F.when((report != "") & (company != ""), company).otherwise("")
    kind = F.when(company != "", _by_report(report, 0)).when(stem.rlike(POLICY), "policy").when(stem.rlike(RESEARCH), "industry_research").otherwise("")
    source = F.when(company != "", "company_report").when(kind == "policy", "government").when(kind == "industry_research", "research").otherwise("")
    return F.struct(stem.alias("doc_title"), kind.alias("doc_type"), source.alias("source_type"), company.alias("company"), short_company(company).alias("company_short"), year.alias("year"), F.when(company != "", _by_report(report, 1)).otherwise("").alias("period"))


def from_text(text: Column) -> Column:
    """struct of FIELDS from the first fifty lines: a report title and the company on the line before; policy words in the first thirty."""
    lines = F.filter(F.transform(F.split(F.left(F.coalesce(text, F.lit("")), F.lit(HEAD_CHARS)), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "---"))
    head = F.slice(lines, 1, 50)
    titles = F.filter(F.transform(head, lambda x, i: F.struct(x.alias("line"), F.get(head, i - 1).alias("before"))), lambda x: x["line"].rlike(REPORT_TITLE))
    title = F.get(titles, F.lit(0))
    year, report = F.regexp_extract(title["line"], REPORT_TITLE, 1), F.regexp_extract(title["line"], REPORT_TITLE, 2)
    company = F.when(title["before"].rlike(f"({'|'.join(COMPANY_ENDS)})$"), title["before"])
    policy = F.exists(F.slice(lines, 1, 30), lambda x: x.rlike(POLICY))
    kind = F.when(title.isNotNull(), _by_report(report, 0)).when(policy, "policy")
    source = F.when(title.isNotNull(), "company_report").when(policy, "government")
    return F.struct(F.lit("").alias("doc_title"), kind.alias("doc_type"), source.alias("source_type"), company.alias("company"), short_company(company).alias("company_short"), year.alias("year"), _by_report(report, 1).alias("period"))


def document_metadata(docs: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, source_file, text) with FIELDS: override over file name over text over defaults.

    overrides has doc_key (a doc_id or file name) and any of FIELDS.
    """
    rows = docs.withColumn("__f", from_file_name(F.col("source_file"))).withColumn("__t", from_text(F.col("text")))
    fields = [f for f in FIELDS if overrides is not None and f in overrides.columns]
    if overrides is not None:
        for i, key in enumerate(("doc_id", "source_file")):
            side = overrides.select(F.col("doc_key").alias(f"__k{i}"), *[F.col(f).alias(f"__o{i}_{f}") for f in fields])
            rows = rows.join(side, F.col(key) == F.col(f"__k{i}"), "left")
    default = {"doc_type": "unknown", "source_type": "unknown"}
    value = lambda f: first_present(*[F.col(f"__o{i}_{f}") for i in (0, 1) if f in fields], F.col(f"__f.{f}"), F.col(f"__t.{f}"), F.lit(default.get(f, "")))
    return rows.select(*docs.columns, *[value(f).alias(f) for f in FIELDS])


def report_label(doc_type: Column, period: Column) -> Column:
    """The report's name by document type or period."""
    by_period = F.when(period == "q1", "第一季度报告").when(period == "q3", "第三季度报告")
    return F.when((doc_type == "annual_report") | (period == "annual"), "年度报告").when((doc_type == "semi_annual_report") | (period == "semi_annual"), "半年度报告").otherwise(F.coalesce(by_period, F.when(doc_type == "quarterly_report", "季度报告").otherwise("报告")))


def document_title(company: Column, year: Column, period: Column, doc_type: Column, doc_title: Column, source_file: Column, doc_id: Column) -> Column:
    """Company, year and report name where all three are known; else the title, the file's stem or the id."""
    whole = F.when((company != "") & (year != "") & (period != ""), F.concat(company, year, F.lit("年"), report_label(doc_type, period)))
    return first_present(whole, doc_title, F.regexp_replace(F.regexp_replace(source_file, "^.*/", ""), r"\.[^.]*$", ""), doc_id)


def display_id(doc_id: Column, doc_title: Column, source_file: Column) -> Column:
    return first_present(doc_id, doc_title, source_file)


def chunk_year(year: Column, names: Column) -> Column:
    return F.coalesce(present(year), extract_year(names))


def chunk_period(period: Column, names: Column) -> Column:
    """The chunk's period in the queries' vocabulary, or that in its names."""
    return F.coalesce(present(F.lower(F.regexp_replace(period, "(?i)^semi_?annual$", "semi_annual"))), extract_period(names))


def company_matches(chunk_names: Column, company: Column) -> Column:
    return (F.coalesce(company, F.lit("")) == "") | F.contains(normalize_text(chunk_names), normalize_text(company))


def year_matches(chunk: Column, year: Column) -> Column:
    return (F.coalesce(year, F.lit("")) == "") | chunk.eqNullSafe(year)


def period_matches(chunk: Column, period: Column) -> Column:
    """A chunk without a period passes."""
    return (F.coalesce(period, F.lit("")) == "") | (F.coalesce(chunk, F.lit("")) == "") | (chunk == period)


def route(pairs: DataFrame, strict: Column, without_period: Column, fallback: bool = True) -> DataFrame:
    """Candidates of each query: those that match, else those that match but for the period, else all."""
    return relaxed(pairs, [strict, without_period, *([F.lit(True)] if fallback else [])])


def apply_aliases(rows: DataFrame, text_col: str, aliases: Mapping[str, str] | DataFrame, out: str = "companies") -> DataFrame:
    """rows with the short names of all aliases in the text, in order of first place, without repeats.

    A table of aliases (alias, short) is searched by an automaton of all of them, a mapping by an expression for each.
    """
    if isinstance(aliases, DataFrame):
        return find_aliases(rows, text_col, aliases, out)
    items = list(aliases.items())
    found = F.array(*[F.struct(F.locate(a, F.col(text_col)).alias("at"), F.lit(-len(a)).alias("n"), F.lit(s).alias("short")) for a, s in items]) if items else F.array().cast("array<struct<at:int,n:int,short:string>>")
    hits = F.sort_array(F.filter(found, lambda x: x["at"] > 0))
    return rows.withColumn(out, F.array_distinct(F.transform(hits, lambda x: x["short"])))
