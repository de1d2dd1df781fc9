"""Text expressions: cleaning, layout tests, years, periods and document names. All are Column to Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases by which a query or file name gives its period, in order of precedence.
PERIODS = (
    ("semi_annual", "半年度|中期|上半年|半年报|半年度报告"),
    ("q1", "第一季度|一季度|第1季度|1季度|Q1|q1"),
    ("q3", "第三季度|三季度|第3季度|3季度|Q3|q3"),
    ("annual", "年度|全年|年报|年度报告"),
)
#: Characters that decoders leave where a font has no usable mapping.
GARBLED = r"[\p{Co}\p{Cn}\p{Cs}\x{FFFD}\x{80}-\x{9F}\x00-\x08\x0B\x0C\x0E-\x1F]"
SPACES = r"(?U)\s+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def present(value: Column) -> Column:
    """Null where the value is empty."""
    return F.nullif(value, F.lit(""))


def first_present(*values: Column) -> Column:
    """The first value that is neither null nor empty, else the empty text."""
    return F.coalesce(*[present(v) for v in values], F.lit(""))


def normalize_text(text: Column) -> Column:
    """Without any white space, in lower case; null becomes empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, ""))


def clean_cell(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), SPACES, " "))


def truncate_text(text: Column, limit: int) -> Column:
    """White space collapsed; cut at limit characters and marked where longer."""
    flat = clean_cell(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(limit))), F.lit("...")))


def normalize_document(text: Column) -> Column:
    """Unix line ends, at most one blank line in a row, no blanks around lines or the whole."""
    unix = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(unix, r"(?mU)^[^\S\n]+|[^\S\n]+$", ""), r"(?U)^\s+|\s+$", "")


def garbled_ratio(text: Column, sample: int = 200) -> Column:
    """Share of garbled characters among the non-blank ones of the first sample characters."""
    head = F.regexp_replace(F.left(F.coalesce(text, F.lit("")), F.lit(sample)), SPACES, "")
    return F.when(F.length(head) == 0, 0.0).otherwise(F.regexp_count(head, F.lit(GARBLED)) / F.length(head))


def is_garbled(text: Column, least: float = 0.3, sample: int = 200) -> Column:
    return (garbled_ratio(text, sample) >= least) | F.left(F.coalesce(text, F.lit("")), F.lit(sample)).rlike(r"\(cid\s*:\s*\d+\s*\)")


def font_garbled(chars: Column, min_chars: int = 20) -> Column:
    """From an array of (text, fontname): subset fonts, hardly any Han characters, much ASCII punctuation."""
    shown = F.filter(chars, lambda c: F.trim(c["text"]) != "")
    share = lambda test: F.size(F.filter(shown, test)) / F.size(shown)
    subset, han, marks = share(lambda c: c["fontname"].rlike(r"^[A-Z0-9]{2,6}\+")), share(lambda c: c["text"].rlike(r"[\x{4E00}-\x{9FFF}]")), share(lambda c: c["text"].rlike(r"^\p{Punct}"))
    return F.coalesce((F.size(shown) >= min_chars) & (subset >= 0.3) & (han < 0.05) & (marks > 0.4), F.lit(False))


def looks_like_toc(text: Column) -> Column:
    """Ten leader dots, two section titles, or a contents title with one."""
    sections = F.regexp_count(text, F.lit(r"第[一二三四五六七八九十\d]+节"))
    return (F.regexp_count(text, F.lit(r"[.·…]")) >= 10) | (sections >= 2) | (F.contains(text, F.lit("目录")) & (sections >= 1))


def looks_tabular(text: Column) -> Column:
    """Three lines, twenty digits that are 18 percent of the text, three gaps of two blanks or more."""
    digits = F.regexp_count(text, F.lit("[0-9]"))
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    return ~looks_like_toc(text) & (lines >= 3) & (digits >= 20) & (digits / F.greatest(F.length(text), F.lit(1)) >= 0.18) & (F.regexp_count(text, F.lit(r"[ \t]{2,}")) >= 3)


def extract_year(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(20\d{2})", 1)


def extract_period(text: Column) -> Column:
    """One vocabulary for queries and documents; a bare year of a report means the annual one."""
    found = F.when(F.lit(False), "")
    for name, pattern in PERIODS:
        found = found.when(text.rlike(pattern), name)
    return found.when(text.rlike(r"20\d{2}年"), "annual").otherwise("")


def normalize_doc_id(name: Column) -> Column:
    """A document's name without extension, source marks, colons and blanks, in lower case."""
    bare = F.regexp_replace(normalize_text(name), r"\.(pdf|md|txt|jsonl?)$", "")
    return F.regexp_replace(bare, r"【[^】]*】|[:：_\-]", "")


def doc_core(name: Column) -> Column:
    """What is left of a normalised name without its year and period words, longest words first."""
    words = r"20\d{2}年?|第[一三13]季度报告|[一三13]季度报告|半年度报告|年度报告|季度报告|第[一三]季度|[一三]季度|半年度|上半年|半年报|中期|年度|全年|年报|q[13]"
    return F.regexp_replace(normalize_doc_id(name), words, "")


def doc_ids_match(predicted: Column, truth: Column) -> Column:
    """Equal after normalisation; or no conflict of year and period, cores of four characters and one within the other."""
    agree = lambda f: (f(predicted) == "") | (f(truth) == "") | (f(predicted) == f(truth))
    a, b = doc_core(predicted), doc_core(truth)
    loose = agree(extract_year) & agree(extract_period) & (F.length(a) >= 4) & (F.length(b) >= 4) & (F.contains(a, b) | F.contains(b, a))
    return (normalize_doc_id(predicted) == normalize_doc_id(truth)) | loose


def passage(labels: dict[str, Column]) -> Column:
    """Labelled lines, those without a value left out."""
    return F.concat_ws("\n", *[F.when(present(v).isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in labels.items()])
