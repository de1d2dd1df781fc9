"""Page layout: blocks, tables and reading order. Decoders of page files are pluggable and give these frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import clean_cell, let, looks_like_toc

#: Margins of headers and footers, and the height of a low block; the share of a text that a table covers,
#: and the overlap of one table found twice; the share of a page's width that is an indent, and the most columns.
HEADER, FOOTER, LOW_BLOCK = 80.0, 80.0, 20.0
OVERLAP, SAME_TABLE = 0.3, 0.7
SNAP, MAX_COLUMNS = 0.12, 4
#: Fixed value: units of measure in table cells.
UNITS = r"(?i)[%％]|元|千元|万元|亿元|GWh|MWh|Wh/kg|次|股|吨|辆|座"
PAGE_BREAK = "\n\n---\n\n"
BOX = ("x0", "y0", "x1", "y1")


def _at(a: str | Column, c: str) -> Column:
    return F.col(f"{a}.{c}") if isinstance(a, str) else a[c]


def _side(a: str | Column, b: str | Column, low: str, high: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(_at(a, high), _at(b, high)) - F.greatest(_at(a, low), _at(b, low)))


def intersection(a: str | Column, b: str | Column) -> Column:
    """Of two boxes: structs, or names of frames or structs."""
    return _side(a, b, "x0", "x1") * _side(a, b, "y0", "y1")


def area(a: str | Column) -> Column:
    return F.greatest(F.lit(0.0), _at(a, "x1") - _at(a, "x0")) * F.greatest(F.lit(0.0), _at(a, "y1") - _at(a, "y0"))


def iou(a: str | Column, b: str | Column) -> Column:
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union <= 0, 0.0).otherwise(intersection(a, b) / union)


def cover(a: str | Column, b: str | Column) -> Column:
    """The share of a that b covers."""
    return F.when(area(a) <= 0, 0.0).otherwise(intersection(a, b) / area(a))


def is_header_footer(page_height: Column, block: Column | None = None) -> Column:
    """By y0 and y1 of a block, by default the row: within a margin, or low and starting in one."""
    y0, y1 = (F.col(c) if block is None else block[c] for c in ("y0", "y1"))
    low = y1 - y0 < LOW_BLOCK
    return (y1 <= HEADER) | (y0 >= page_height - FOOTER) | (low & ((y0 <= HEADER) | (y0 >= page_height - FOOTER)))


def outside_tables(texts: DataFrame, tables: DataFrame, by: tuple[str, ...] = ("doc_id", "page_no"), least: float = OVERLAP) -> DataFrame:
    """Text blocks that no table of their page covers by `least`."""
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by]
    test = cover("a", "b") >= least
    for c in on:
        test = c & test
    return texts.alias("a").join(tables.alias("b"), test, "left_anti")


def distinct_boxes(tables: Column, threshold: float = SAME_TABLE) -> Column:
    """Of an array of boxes, in order, those whose overlap with every kept one is below threshold."""
    keep = lambda kept, t: F.when(F.exists(kept, lambda o: iou(t, o) >= threshold), kept).otherwise(F.concat(kept, F.array(t)))
    return let(tables, lambda ts: F.when(F.size(ts) < 2, ts).otherwise(F.aggregate(ts, F.slice(ts, 1, 0), keep)))


def distinct_tables(tables: DataFrame, threshold: float = SAME_TABLE) -> DataFrame:
    """Of each page's table candidates, in order of seq, those whose overlap with every kept one is below threshold."""
    listed = tables.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("seq", F.struct(*tables.columns).alias("t")))).alias("ts"))
    return listed.select(F.explode(distinct_boxes(F.transform("ts", lambda t: t["t"]), threshold)).alias("t")).select("t.*")


def column_labels(x0: np.ndarray, page_width: float) -> np.ndarray:
    """Column number of each block from its left edge: exact one-dimensional k-means for 1 to 4 columns, the best silhouette above 0 wins."""
    return columns_of(np.zeros(len(x0), int), np.asarray(x0, float), np.array([page_width], float))


def columns_of(page: np.ndarray, x0: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """column_labels of the blocks of many pages, given with each block's page; edges that occur again are clustered once."""
    left = np.full(len(widths), np.inf)
    np.minimum.at(left, page, x0)
    x = np.where(x0 - left[page] < SNAP * widths[page], left[page], x0)
    order = np.lexsort((x, page))
    first = np.concatenate(([True], (np.diff(x[order]) != 0) | (np.diff(page[order]) != 0)))[: len(x)]
    starts = np.flatnonzero(first)
    values, counts, own = x[order][starts], np.diff(np.concatenate((starts, [len(x)]))), page[order][starts]
    found, known = np.zeros(len(values), int), {}
    begins = np.flatnonzero(np.concatenate(([True], np.diff(own) != 0)))[: len(own)]
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(values)]):
        if b - a > 1:
            key = (values[a:b].tobytes(), counts[a:b].tobytes())
            if key not in known:
                known[key] = _split(values[a:b], counts[a:b])
            found[a:b] = known[key]
    out = np.empty(len(x), int)
    out[order] = found[np.cumsum(first) - 1]
    return out


def _split(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The column of each of the ascending edges, which occur counts times."""
    best, labels, n = 0.0, np.zeros(len(values), int), len(values)
    sums, squares, weight = (np.concatenate(([0.0], np.cumsum(c))).tolist() for c in (values * counts, values**2 * counts, counts))
    cost = lambda i, j: squares[j] - squares[i] - (sums[j] - sums[i]) ** 2 / (weight[j] - weight[i])
    table = [[cost(0, j) if j else 0.0 for j in range(n + 1)]]
    cut: list[list[int]] = [[0] * (n + 1)]
    for k in range(2, min(MAX_COLUMNS, n) + 1):
        row, at = [np.inf] * (n + 1), [0] * (n + 1)
        for j in range(k, n + 1):
            at[j] = min(range(k - 1, j), key=lambda i: table[-1][i] + cost(i, j))
            row[j] = table[-1][at[j]] + cost(at[j], j)
        table.append(row)
        cut.append(at)
        ends = [n]
        for level in range(k - 1, 0, -1):
            ends.append(cut[level][ends[-1]])
        group = np.searchsorted(np.sort(ends), np.arange(n), side="right")
        score = silhouette(values, counts, group)
        if score > best + 1e-12:
            best, labels = score, group
    return labels


def silhouette(values: np.ndarray, counts: np.ndarray, group: np.ndarray) -> float:
    """Mean silhouette by distance of values that occur counts times; 0 for one group or for groups of one."""
    groups = int(group.max()) + 1
    if groups < 2 or groups >= counts.sum():
        return 0.0
    size = np.bincount(group, counts)
    far = np.zeros((len(values), groups))
    np.add.at(far.T, group, counts[:, None] * np.abs(values[:, None] - values[None]))
    own = np.arange(len(values)), group
    a = far[own] / np.maximum(size[group] - 1, 1)
    others = far / size
    others[own] = np.inf
    b, most = others.min(axis=1), np.maximum(a, others.min(axis=1))
    score = np.where((size[group] > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1.0), 0.0)
    return float((score * counts).sum() / counts.sum())


def _labels(x0: pa.Array, widths: pa.Array) -> pa.Array:
    count = pc.fill_null(pc.list_value_length(x0), 0).to_numpy()
    edges = np.asarray(x0.flatten().to_numpy(zero_copy_only=False), float)
    found = columns_of(np.repeat(np.arange(len(count)), count), edges, np.asarray(widths.to_numpy(zero_copy_only=False), float))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(found, pa.int32()))


def labels(x0: Column, page_width: Column) -> Column:
    """column_labels of a page's left edges, an array of them; all pages of a batch are worked on at once."""
    return F.arrow_udf(_labels, "array<int>")(x0.cast("array<double>"), page_width.cast("double"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, page_no, page_width, x0, y0, ...) with column_no and block_seq: by column from the left, then from the top.

    A page's left edges go to the clustering as one array, many pages in a batch; the order is a window.
    """

    page = ["doc_id", "page_no"]
    listed = blocks.groupBy(*page).agg(F.collect_list(F.struct(*blocks.columns)).alias("b"))
    marked = listed.select("b", labels(F.col("b.x0"), F.element_at("b", 1)["page_width"]).alias("labels"))
    rows = marked.select(F.explode(F.arrays_zip("b", "labels")).alias("z")).select("z.b.*", F.col("z.labels").alias("column_no"))
    return rows.withColumn("block_seq", F.row_number().over(Window.partitionBy(*page).orderBy("column_no", "y0", "x0")))


def clean_rows(rows: Column) -> Column:
    """Cells cleaned, rows without any content dropped."""
    cleaned = F.transform(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), clean_cell))
    return F.filter(cleaned, lambda r: F.exists(r, lambda c: c != ""))


def is_valid_table(rows: Column) -> Column:
    """Three rows, two columns, six cells, two rows of two cells, three numbers or two units; no contents or definition list."""
    return let(clean_rows(rows), valid_rows)


def valid_rows(shown: Column) -> Column:
    """is_valid_table of cleaned rows."""
    filled = lambda cells: F.size(F.filter(cells, lambda c: c != ""))
    matching = lambda cells, pattern: F.size(F.filter(cells, lambda c: c.rlike(pattern)))
    defines = lambda text: (F.contains(text, F.lit("释义项")) & F.contains(text, F.lit("释义内容"))) | (F.regexp_count(text, F.lit(" 指 ")) >= 3)
    said = lambda cells: (F.size(cells) >= 6) & ((matching(cells, r"\d") >= 3) | (matching(cells, UNITS) >= 2)) & let(F.array_join(cells, " "), lambda text: ~looks_like_toc(text) & ~defines(text))
    width = F.coalesce(F.array_max(F.transform(shown, F.size)), F.lit(0))
    dense = F.size(F.filter(shown, lambda r: filled(r) >= 2))
    return (F.size(shown) >= 3) & (width >= 2) & (dense >= 2) & let(F.filter(F.flatten(shown), lambda c: c != ""), said)


def table_to_markdown(rows: Column) -> Column:
    """The first row is the header; short rows are padded; pipes are escaped. Empty for a table without content."""
    return let(clean_rows(rows), rows_markdown)


def rows_markdown(shown: Column) -> Column:
    """table_to_markdown of cleaned rows."""
    escaped = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    line = lambda r, width: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), escaped), " | "), F.lit(" |"))
    rule = lambda width: F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
    whole = lambda width: F.array_join(F.flatten(F.transform(shown, lambda r, i: F.when(i == 0, F.array(line(r, width), rule(width))).otherwise(F.array(line(r, width))))), "\n")
    return F.when(F.size(shown) > 0, let(F.array_max(F.transform(shown, F.size)), whole)).otherwise("")


def block_text(kind: Column, text: Column) -> Column:
    """A block's Markdown without blanks around it, tables fenced."""
    return let(F.btrim(text, F.lit(" \t\r\n")), lambda t: F.when((kind == "table") & (t != ""), F.concat(F.lit("[TABLE_START]\n"), t, F.lit("\n[TABLE_END]"))).otherwise(t))


def page_markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, markdown) from blocks (type, text, block_seq): tables fenced, a blank line after each block."""
    shown = blocks.select("doc_id", "page_no", F.struct("block_seq", block_text(F.col("type"), F.col("text")).alias("body")).alias("b")).filter("b.body <> ''")
    return shown.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["body"]), "\n\n").alias("markdown"))


def documents_from_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the pages with content in order, a rule between them."""
    listed = F.sort_array(F.collect_list(F.struct("page_no", "markdown")))
    return pages.filter(F.trim("markdown") != "").groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda p: p["markdown"]), PAGE_BREAK).alias("text"))
