"""Pages from their decoded parts: tables from ruling lines, blocks from text lines, Markdown in reading order.

A decoder of page files gives two frames: ruling lines (doc_id, page_no, x0, y0, x1, y1) and text lines (doc_id,
page_no, page_width, page_height, x0, y0, x1, y1, text), in points from the top left; or one of pages that hold these
as arrays. Pages are spread by their key; those of a batch are worked on at once, by arrays of all their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import let
from quillon.operators import layout

#: How far lines may be apart to be one line, parts of a line to be joined, and ends to meet another line.
SNAP, JOIN, MEET = 3.0, 3.0, 5.0
#: Shorter lines are no rulings; words further apart have a blank between them; lines of a cell differ in height by more.
SHORTEST, WORD_GAP, LINE_STEP = 3.0, 3.0, 3.0
#: A text line goes on a block if it begins below its end by no more than this share of its own height.
BLOCK_GAP = 0.8
#: Pairs of lines, or of cells and words, that are compared at a time.
PAIRS = 1 << 20
PAGE = ("doc_id", "page_no")


def _spans(count: np.ndarray) -> np.ndarray:
    """0, 1, ... count - 1 for each count in turn."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where one of the keys differs from the row before; true at the first row."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for key in keys:
        out[1:] |= key[1:] != key[:-1]
    return out


def _furthest(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The largest value so far since the last first row."""
    # by the values' places in order, which are raised above those of the rows before
    known, place = np.unique(values, return_inverse=True)
    group = np.cumsum(first) * len(known)
    return known[np.maximum.accumulate(place + group) - group] if len(known) else values


def _pairs(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left row, right row) of equal pages, both sides in order of page: all rights of a left, at most about PAIRS at a time."""
    low = np.searchsorted(right, left)
    count = np.searchsorted(right, left, side="right") - low
    ends = np.cumsum(count)
    at = 0
    while at < len(left):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - count[at] + PAIRS, side="right")))
        rows = np.repeat(np.arange(at, end), count[at:end])
        yield rows, low[rows] + _spans(count[at:end])
        at = end


def snapped(values: np.ndarray, tolerance: float = SNAP, page: np.ndarray | None = None) -> np.ndarray:
    """Each run of values of a page whose neighbours are within tolerance becomes its mean."""
    page = np.zeros(len(values), int) if page is None else page
    order = np.lexsort((values, page))
    out = np.empty(len(values))
    if len(values):
        run = np.cumsum(np.concatenate(([False], (np.diff(values[order]) > tolerance) | (np.diff(page[order]) != 0))))
        out[order] = (np.bincount(run, values[order]) / np.bincount(run))[run]
    return out


def _joined(page: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, tolerance: float = JOIN) -> tuple[np.ndarray, np.ndarray]:
    """The page, and position, start and end of lines of equal page and position, those that touch within tolerance being one."""
    order = np.lexsort((low, at, page))
    page, at, low, high = page[order], at[order], low[order], high[order]
    first = _changes(page, at)
    reach = _furthest(first, high)
    starts = first.copy()
    starts[1:] |= low[1:] > reach[:-1] + tolerance
    last = np.concatenate((np.flatnonzero(starts)[1:] - 1, [len(page) - 1])) if len(page) else np.zeros(0, int)
    return page[starts], np.stack((at[starts], low[starts], reach[last]), axis=1)


def joined(at: np.ndarray, low: np.ndarray, high: np.ndarray, tolerance: float = JOIN) -> np.ndarray:
    """(n, 3) position, start and end of lines of equal position, those that touch within tolerance being one."""
    return _joined(np.zeros(len(at), int), at, low, high, tolerance)[1]


def _meets(rows: np.ndarray, across: np.ndarray, columns: np.ndarray, down: np.ndarray, tolerance: float = MEET) -> tuple[np.ndarray, np.ndarray]:
    """Which horizontal lines on pages `rows` meet which vertical ones on pages `columns`: their numbers, in order."""
    found = []
    for i, j in _pairs(rows, columns):
        (y, a, b), (x, c, d) = across[i].T, down[j].T
        hit = (x >= a - tolerance) & (x <= b + tolerance) & (c <= y + tolerance) & (d >= y - tolerance)
        found.append((i[hit], j[hit]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int),) * 2  # type: ignore[return-value]


def crossings(across: np.ndarray, down: np.ndarray, tolerance: float = MEET) -> np.ndarray:
    """(across, down) booleans: which horizontal lines meet which vertical ones."""
    out = np.zeros((len(across), len(down)), bool)
    out[_meets(np.zeros(len(across), int), across, np.zeros(len(down), int), down, tolerance)] = True
    return out


def _beyond(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For crossings in order of a line and of where they are on it, the number of the next one further on; -1 for the last."""
    starts = np.flatnonzero(_changes(line, at))
    run = np.cumsum(_changes(line, at)) - 1
    after = np.concatenate((starts, [len(line)]))[run + 1]
    same = line[np.minimum(after, len(line) - 1)] == line if len(line) else np.zeros(0, bool)
    return np.where((after < len(line)) & same, after, -1)


def _cells(page: np.ndarray, rulings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The page and the box of each cell of many pages, as cells() has them for one."""
    width, height = np.abs(rulings[:, 2] - rulings[:, 0]), np.abs(rulings[:, 3] - rulings[:, 1])
    flat, steep = (height <= SNAP) & (width >= SHORTEST), (width <= SNAP) & (height >= SHORTEST)
    low, high = np.minimum(rulings[:, :2], rulings[:, 2:]), np.maximum(rulings[:, :2], rulings[:, 2:])
    middle = (low + high) / 2
    rows, across = _joined(page[flat], snapped(middle[flat, 1], SNAP, page[flat]), low[flat, 0], high[flat, 0])
    columns, down = _joined(page[steep], snapped(middle[steep, 0], SNAP, page[steep]), low[steep, 1], high[steep, 1])
    i, j = _meets(rows, across, columns, down)
    y, x = across[i, 0], down[j, 0]
    right, order = _beyond(i, x), np.lexsort((i, j))
    below, back = np.empty(len(i), int), np.empty(len(i), int)
    after = _beyond(j[order], y[order])
    below[order] = np.where(after >= 0, order[after], -1)
    back[order] = np.arange(len(i))
    code = i * len(down) + j
    corners = lambda a, b: code[np.minimum(np.searchsorted(code, i[a] * len(down) + j[b]), len(code) - 1)] == i[a] * len(down) + j[b]
    both = np.flatnonzero((right >= 0) & (below >= 0))
    a, b = below[both], right[both]
    for n in np.flatnonzero(~corners(a, b)).tolist() if len(both) else []:
        # the nearest corner below on the same vertical and to the right on the same horizontal that closes a rectangle
        p = both[n]
        under = order[back[a[n]] : np.searchsorted(j[order], j[p], side="right")]
        beside = np.arange(b[n], np.searchsorted(i, i[p], side="right"))
        closed = np.flatnonzero(corners(np.repeat(under, len(beside)), np.tile(beside, len(under))))
        a[n], b[n] = (under[closed[0] // len(beside)], beside[closed[0] % len(beside)]) if len(closed) else (-1, -1)
    both, a, b = (c[a >= 0] for c in (both, a, b))
    found, boxes = rows[i[both]], np.stack((x[both], y[both], x[b], y[a]), axis=1)
    order = np.lexsort((boxes[:, 0], boxes[:, 1], found))
    return found[order], boxes[order]


def cells(rulings: np.ndarray) -> np.ndarray:
    """(n, 4) boxes x0, y0, x1, y1 of the least closed rectangles between rulings, from the top left."""
    return _cells(np.zeros(len(rulings), int), rulings)[1]


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """The number of each row's keys in their order, the last key being the first in order."""
    order = np.lexsort(keys)
    out = np.empty(len(order), int)
    out[order] = np.cumsum(_changes(*(k[order] for k in keys))) - 1
    return out


def _grouped(page: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """The table of each cell, from the first page's top left; -1 for cells that share no corner with another."""
    n = len(boxes)
    place = _numbered(boxes[:, [1, 1, 3, 3]].T.ravel(), boxes[:, [0, 2, 0, 2]].T.ravel(), np.tile(page, 4)).reshape(4, n)
    label, most = np.arange(n), np.zeros(4 * n, int)
    while True:  # the largest number of a cell goes around, over ever larger steps
        for corner in place:
            np.maximum.at(most, corner, label)
        new = most[place].max(axis=0) if n else label
        new = new[new]
        if (new == label).all():
            break
        label = new
    kept = np.bincount(label, minlength=n)[label] > 1
    left, top = np.full(n, np.inf), np.full(n, np.inf)
    np.minimum.at(left, label, boxes[:, 0])
    np.minimum.at(top, label, boxes[:, 1])
    out = np.full(n, -1)
    out[kept] = _numbered(label[kept], left[label[kept]], top[label[kept]], page[kept])
    return out


def tables_of(boxes: np.ndarray) -> list[np.ndarray]:
    """Groups of two or more cells that share corners, from the top left."""
    table = _grouped(np.zeros(len(boxes), int), boxes)
    return [boxes[table == t] for t in range(table.max(initial=-1) + 1)]


def cell_text(words: list[tuple[float, float, float, str]]) -> str:
    """Words (top, x0, x1, text) of a cell as lines from the top, blanks where words are apart."""
    lines: list[list[tuple[float, float, float, str]]] = []
    for word in sorted(words):
        if lines and word[0] - lines[-1][0][0] <= LINE_STEP:
            lines[-1].append(word)
        else:
            lines.append([word])
    shown = []
    for line in lines:
        line.sort(key=lambda w: w[1])
        text = line[0][3]
        for before, word in zip(line, line[1:]):
            text += (" " if word[1] - before[2] > WORD_GAP else "") + word[3]
        shown.append(text)
    return "\n".join(shown)


def _cell_texts(count: np.ndarray, words: np.ndarray, texts: pa.Array) -> pa.Array:
    """cell_text of each run of count words; runs of one line are written at once."""
    cell, begins = np.repeat(np.arange(len(count)), count), np.cumsum(count) - count
    top = words[:, 1]
    flat = np.maximum.reduceat(top, begins) - np.minimum.reduceat(top, begins) <= LINE_STEP if len(count) else np.zeros(0, bool)
    order = np.lexsort((words[:, 2], top, words[:, 0], cell))  # a line is in order of x0, and of the sort before where that is equal
    x0, x1, own = words[order, 0], words[order, 2], cell[order]
    equal = ~_changes(own, x0, x1, top[order])
    flat[own[equal]] = False  # these are in order of their texts
    first = np.zeros(len(own), bool)
    first[begins] = True
    apart = np.concatenate(([False], x0[1:] - x1[:-1] > WORD_GAP))[: len(own)] & ~first
    parts = np.stack((len(texts) + apart, order), axis=1).ravel()
    shown = pc.binary_join(pa.ListArray.from_arrays(_offsets(2 * count), pa.concat_arrays([texts, pa.array(["", " "])]).take(pa.array(parts))), "")
    if flat.all():
        return shown
    out, rows = shown.to_pylist(), list(zip(top.tolist(), words[:, 0].tolist(), words[:, 2].tolist(), texts.to_pylist()))
    for n in np.flatnonzero(~flat).tolist():
        out[n] = cell_text(rows[begins[n] : begins[n] + count[n]])
    return pa.array(out, pa.string())


def _filled(page: np.ndarray, table: np.ndarray, boxes: np.ndarray, at: np.ndarray, words: np.ndarray, texts: pa.Array) -> pa.Array:
    """The rows of each table, as filled() has them for one: cells and words are in order of page, tables are numbered from 0."""
    n = int(table.max(initial=-1)) + 1
    line, column = _numbered(boxes[:, 1], table), _numbered(boxes[:, 0], table)
    lines, columns = (np.bincount(t, minlength=n) for t in (_firsts(line, table), _firsts(column, table)))
    line, column = line - (np.cumsum(lines) - lines)[table], column - (np.cumsum(columns) - columns)[table]
    begins = np.cumsum(lines * columns) - lines * columns
    middle = (words[:, :2] + words[:, 2:]) / 2
    found = []
    (x0, y0, x1, y1), (x, y) = (np.ascontiguousarray(side.T) for side in (boxes, middle))
    for c, w in _pairs(page, at):
        for low, high, place in ((y0, y1, y), (x0, x1, x)):
            own = place[w]
            hit = np.flatnonzero((own >= low[c]) & (own < high[c]))
            c, w = c[hit], w[hit]
        found.append((c, w))
    cell, word = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int),) * 2
    count = np.bincount(cell, minlength=len(boxes))
    first = np.cumsum(count) - count
    said = np.full(len(boxes), len(texts))  # the empty text comes after the words
    said[count == 1] = word[first[count == 1]]
    several = np.flatnonzero(count > 1)
    held = word[np.repeat(first[several], count[several]) + _spans(count[several])]
    said[several] = len(texts) + 1 + np.arange(len(several))
    known = pa.concat_arrays([texts, pa.array([""]), _cell_texts(count[several], words[held], texts.take(pa.array(held)))])
    slots = np.full(int((lines * columns).sum()), -1)
    slots[begins[table] + line * columns[table] + column] = said
    values = known.take(pa.array(slots, mask=slots < 0))
    width = np.repeat(columns, lines)
    return pa.ListArray.from_arrays(_offsets(lines), pa.ListArray.from_arrays(_offsets(width), values))


def _firsts(number: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The table of each number."""
    out = np.empty(int(number.max(initial=-1)) + 1, int)
    out[number] = table
    return out


def _offsets(count: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())


def filled(boxes: np.ndarray, words: np.ndarray, texts: list[str]) -> list[list[str | None]]:
    """The table's rows: the text of the words whose middles lie in each cell; None where the grid has no cell."""
    zeros = np.zeros(len(boxes), int)
    return _filled(zeros, zeros, boxes, np.zeros(len(words), int), np.reshape(words, (-1, 4)), pa.array(texts, pa.string())).to_pylist()[0]


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of an array of lists, null ones being empty, and the elements."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()), lists.flatten()


def _boxes(parts: pa.StructArray) -> np.ndarray:
    """(n, 4) numbers of structs with a box; null ones are NaN."""
    return np.stack([np.asarray(pc.struct_field(parts, c).to_numpy(zero_copy_only=False), float) for c in layout.BOX], axis=1).reshape(-1, 4)


TABLE = "struct<seq:int,x0:double,y0:double,x1:double,y1:double,rows:array<array<string>>>"


def _tables(rulings: pa.Array, words: pa.Array) -> pa.Array:
    """For each page the list of its tables, as TABLE."""
    page, boxes = _cells(*(f(x) for f, x in zip((lambda x: x, _boxes), _flat(rulings))))
    table = _grouped(page, boxes)
    page, boxes, table = (x[table >= 0] for x in (page, boxes, table))
    at, said = _flat(words)
    rows = _filled(page, table, boxes, at, _boxes(said), pc.struct_field(said, "text"))
    own = _firsts(table, page)
    low, high = np.full((len(own), 2), np.inf), np.full((len(own), 2), -np.inf)
    np.minimum.at(low, table, boxes[:, :2])
    np.maximum.at(high, table, boxes[:, 2:])
    count = np.bincount(own, minlength=len(rulings))
    columns = [pa.array(_spans(count), pa.int32()), *(pa.array(c, pa.float64()) for c in (*low.T, *high.T)), rows]
    return pa.ListArray.from_arrays(_offsets(count), pa.StructArray.from_arrays(columns, ["seq", *layout.BOX, "rows"]))


def page_tables(rulings: Column, words: Column) -> Column:
    """The tables that rulings close, with the words in their cells, as an array of TABLE: for pages with an array of each.

    Rulings are structs of a box, words of a box and a text that is not null. All pages of a batch are worked on at once.
    """
    return F.arrow_udf(_tables, f"array<{TABLE}>")(rulings, words)


def gathered(parts: DataFrame, out: str, *columns: str) -> DataFrame:
    """(doc_id, page_no, out): an array of structs of the columns for each page, boxes as doubles."""
    return parts.groupBy(*PAGE).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) if c in layout.BOX else F.col(c) for c in columns])).alias(out))


def _ruled(rulings: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, page_no, rulings, words) of the pages that have rulings."""
    return gathered(rulings, "rulings", *layout.BOX).join(gathered(words.filter("text is not null"), "words", *layout.BOX, "text"), list(PAGE), "left")


def ruled_tables(rulings: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, page_no, seq, x0, y0, x1, y1, rows): the tables that rulings close, with the words in their cells.

    words have the columns of rulings and text. Tables of a page are numbered from the top left.
    """
    return tables_on(_ruled(rulings, words))


def tables_on(pages: DataFrame) -> DataFrame:
    """ruled_tables of pages (doc_id, page_no, rulings, words), whose arrays page_tables() takes."""
    return pages.select(*PAGE, F.explode(page_tables(F.col("rulings"), F.col("words"))).alias("t")).select(*PAGE, "t.*")


def _text_blocks(lines: pa.Array, widths: pa.Array) -> pa.Array:
    """For each page its text blocks, of lines sorted by y0, x0, y1 and text."""
    page, parts = _flat(lines)
    boxes, text = _boxes(parts), pc.struct_field(parts, "text")
    column = layout.columns_of(page, boxes[:, 0], np.asarray(widths.to_numpy(zero_copy_only=False), float))
    order = np.lexsort((column, page))  # keeps the lines' order
    page, column, boxes, text = page[order], column[order], boxes[order], text.take(pa.array(order))
    first = _changes(page, column)
    lowest = _furthest(first, np.where(np.isnan(boxes[:, 3]), -np.inf, boxes[:, 3]))
    begins = first.copy()
    begins[1:] |= ~(boxes[1:, 1] - lowest[:-1] <= BLOCK_GAP * (boxes[1:, 3] - boxes[1:, 1]))
    starts = np.flatnonzero(begins)
    size = np.diff(np.concatenate((starts, [len(page)])))
    body = pc.binary_join(pa.ListArray.from_arrays(_offsets(size), text), "\n")
    ends = [(np.fmin if c < 2 else np.fmax).reduceat(boxes[:, c], starts) if len(starts) else np.zeros(0) for c in range(4)]
    count = np.bincount(page[starts], minlength=len(lines))
    return pa.ListArray.from_arrays(_offsets(count), pa.StructArray.from_arrays([*(pa.array(c) for c in ends), body], [*layout.BOX, "text"]))


def page_texts(lines: Column, page_width: Column) -> Column:
    """The text blocks of a page's lines, structs of a box and a text: those of a column that follow one another closely are one block.

    Columns come from the lines' left edges, as for reading order. A line begins a new block where it starts below
    everything before it in its column by more than BLOCK_GAP of its own height. Lines without text are left out.
    """
    shown = F.transform(F.filter(lines, lambda t: F.trim(t["text"]) != ""), lambda t: F.struct(*[t[c].alias(c) for c in ("y0", "x0", "y1", "text", "x1")]))
    return F.arrow_udf(_text_blocks, "array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>")(F.sort_array(shown), page_width.cast("double"))


def spans_to_lines(spans: DataFrame) -> DataFrame:
    """Text lines of spans (doc_id, page_no, page_width, page_height, block_no, line_no, span_no, x0, y0, x1, y1, text): their texts strung together."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span_no", F.coalesce("text", F.lit("")).alias("text")))), lambda s: s["text"]), "")
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return spans.groupBy(*PAGE, "page_width", "page_height", "block_no", "line_no").agg(*box, text.alias("text")).drop("block_no", "line_no")


def compose_pages(lines: DataFrame, rulings: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no, markdown): tables cut out, blocks in reading order, no headers and footers.

    words fill the tables' cells, by default the text lines. Text that a table covers by layout.OVERLAP is its own
    no more; where no valid table stands the text stays.
    """
    size = [F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height")]
    said = F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in layout.BOX], "text")).alias("lines")
    return composed(lines.groupBy(*PAGE).agg(*size, said).join(_ruled(rulings, lines if words is None else words), list(PAGE), "left"))


def composed(pages: DataFrame) -> DataFrame:
    """compose_pages of pages (doc_id, page_no, page_width, page_height, lines, rulings, words) that hold their parts as arrays."""
    found = pages.select(*PAGE, "page_width", "page_height", page_tables(F.col("rulings"), F.col("words")).alias("tables"), page_texts(F.col("lines"), F.col("page_width")).alias("texts"))
    block = lambda b, kind, text: F.struct(*[b[c].alias(c) for c in layout.BOX], F.lit(kind).alias("type"), text.alias("text"))
    cleaned = F.transform("tables", lambda t: F.struct(*[t[c].alias(c) for c in layout.BOX], layout.clean_rows(t["rows"]).alias("shown")))
    valid = layout.distinct_boxes(F.filter(cleaned, lambda t: layout.valid_rows(t["shown"])))
    shown = F.filter(F.transform(valid, lambda t: block(t, "table", layout.rows_markdown(t["shown"]))), lambda b: b["text"] != "")
    outside = lambda tables: F.filter("texts", lambda t: ~F.exists(tables, lambda b: F.coalesce(layout.cover(t, b) >= layout.OVERLAP, F.lit(False))))
    both = let(shown, lambda tables: F.concat(tables, F.transform(outside(tables), lambda t: block(t, "text", t["text"]))))
    kept = F.filter(both, lambda b: ~layout.is_header_footer(F.col("page_height"), b))
    bodies = F.transform(kept, lambda b: F.struct(b["x0"].alias("x0"), b["y0"].alias("y0"), layout.block_text(b["type"], b["text"]).alias("body")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page, parts = _flat(b.column("blocks"))
            x0, y0 = (np.asarray(pc.struct_field(parts, c).to_numpy(zero_copy_only=False), float) for c in ("x0", "y0"))
            body = pc.struct_field(parts, "body")
            column = layout.columns_of(page, x0, np.asarray(b.column("page_width").to_numpy(zero_copy_only=False), float))
            order = np.lexsort((x0, y0, column, page))
            order = order[pc.not_equal(body, "").to_numpy(zero_copy_only=False)[order]]
            starts = np.flatnonzero(_changes(page[order]))
            size = np.diff(np.concatenate((starts, [len(order)])))
            text = pc.binary_join(pa.ListArray.from_arrays(_offsets(size), body.take(pa.array(order))), "\n\n")
            shown = pa.array(page[order][starts])
            yield pa.RecordBatch.from_arrays([b.column(0).take(shown), b.column(1).take(shown), text], [*PAGE, "markdown"])

    ids = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in PAGE)
    return found.select(*PAGE, F.col("page_width").cast("double").alias("page_width"), bodies.alias("blocks")).mapInArrow(run, f"{ids}, markdown string")
