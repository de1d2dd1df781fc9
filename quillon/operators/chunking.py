"""Table-preserving chunks of documents."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import normalize_document
from quillon.operators.metadata import FIELDS, document_metadata, document_title

FENCED = r"(?is)\[TABLE_START\].*?\[TABLE_END\]"
MIN_CHARS = 30
#: Fixed value: a soft boundary must lie in the last 40 percent of a window.
SOFT_FROM = 0.6
#: Soft boundaries, best first: a chunk may end after the last of a kind's marks.
BOUNDARIES = (("\n\n",), ("。", "！", "？", "；"), (".", "!", "?", ";"), ("\n",), ("，", ","))
#: White space as (?U)\\s has it: within lines, and what else ends a line for a pattern.
BLANKS, LINE_ENDS = "\t\x0b\x0c \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000", "\x85\u2028\u2029"
WHITE = BLANKS + LINE_ENDS + "\n\r"
#: Characters whose windows are cut together, and fewer texts than that go on one by one.
GRID_CHARS, FEW = 1 << 20, 40
WINDOWS = pa.list_(pa.struct([("start", pa.int32()), ("content", pa.string())]))


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a chunk size is positive and an overlap is less than it")


def segments(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with segment_index from 1, segment_type (text or table) and content, blank segments left out.

    Tables keep their fences; a fence without an end stays text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    tables = F.regexp_extract_all(text, F.lit(f"({FENCED})"), F.lit(1))
    between = F.split(text, FENCED, -1)
    fenced = F.contains(F.upper(text), F.lit("[TABLE_START]"))
    pieces = F.flatten(F.transform(between, lambda t, i: F.array(F.struct(F.lit("text").alias("type"), t.alias("content")), F.struct(F.lit("table").alias("type"), F.coalesce(F.get(tables, i), F.lit("")).alias("content")))))
    pieces = F.when(fenced, pieces).otherwise(F.array(F.struct(F.lit("text").alias("type"), text.alias("content"))))
    shown = F.filter(pieces, lambda p: p["content"].rlike(r"(?U)\S"))
    out = docs.select("*", F.posexplode(shown).alias("__i", "__s"))
    return out.select(*docs.columns, (F.col("__i") + 1).alias("segment_index"), F.col("__s.type").alias("segment_type"), F.col("__s.content").alias("content"))


def soft_length(window: str, size: int) -> int:
    """How much of a full window to take: up to its best boundary in the soft zone, else all."""
    for marks in BOUNDARIES:
        end = max(window.rfind(m) + len(m) if m in window else 0 for m in marks)
        if end >= int(SOFT_FROM * size):
            return end
    return len(window)


def cut(text: str, size: int, overlap: int, soft: bool) -> Iterator[tuple[int, str]]:
    """The windows of a text, in time linear in their total length."""
    start = 0
    while start < len(text):
        window = text[start : start + size]
        last = start + size >= len(text)
        taken = soft_length(window, size) if soft and not last else len(window)
        yield start, window[:taken]
        start = len(text) if last else start + taken - (overlap if taken > overlap else 0)


def _windows(texts: pa.Array, sizes: pa.Array, overlaps: pa.Array, softs: pa.Array) -> pa.Array:
    found = [None if t is None else [{"start": s, "content": c} for s, c in cut(t, *how)] for t, *how in zip(*(x.to_pylist() for x in (texts, sizes, overlaps, softs)))]
    return pa.array(found, WINDOWS)


def windows(text: Column, size: int | Column, overlap: int | Column, soft: bool = True) -> Column:
    """array<struct<start, content>>: overlapping windows, start from 0 in characters; null for null.

    Each window starts `overlap` before the end of the last one, or at its end where that would not advance. Where a
    window ends depends on the one before, so this is a loop over the text, run on Arrow batches.
    """
    if isinstance(size, int) and isinstance(overlap, int):
        check_sizes(size, overlap)
        size, overlap = F.lit(size), F.lit(overlap)
    return F.arrow_udf(_windows, "array<struct<start:int,content:string>>")(text, size, overlap, F.lit(soft))


def chunk_documents(docs: DataFrame, size: int = 1024, overlap: int = 50, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, chunk_id, chunk_type, content, char_len, source_segment_index, chunk_size, overlap) and the columns `keep` of docs.

    Tables are chunks as they are. Text is normalised, cut by windows(), stripped, and kept from min_chars on;
    numbers in chunk_id count the kept chunks of each type of a document.
    """
    check_sizes(size, overlap)
    return _chunks(docs, [(size, overlap)], min_chars, id_col, text_col, keep)


def _chunks(docs: DataFrame, pairs: Sequence[tuple[int, int]], min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The chunks of every pair of size and overlap: documents are read and normalised once."""
    parts = segments(docs.select(F.col(id_col).cast("string").alias("doc_id"), *keep, F.col(text_col).alias("text"))).drop("text")
    clean = F.when(F.col("segment_type") == "table", F.regexp_replace("content", r"(?U)^\s+|\s+$", "")).otherwise(normalize_document(F.col("content")))
    how = F.explode(F.array(*[F.struct(F.lit(s).alias("chunk_size"), F.lit(o).alias("overlap")) for s, o in pairs])).alias("how")
    rows = parts.withColumn("content", clean).select("*", how).select(*parts.columns, "how.*")
    whole = rows.filter("segment_type = 'table'").withColumn("at", F.lit(0))
    texts = rows.filter("segment_type = 'text'").withColumn("windows", windows(F.col("content"), F.col("chunk_size"), F.col("overlap"))).drop("content")
    texts = texts.select("*", F.posexplode("windows").alias("at", "w")).withColumn("content", F.regexp_replace("w.content", r"(?U)^\s+|\s+$", "")).filter(F.length("content") >= min_chars)
    n = F.row_number().over(Window.partitionBy("doc_id", "segment_type", "chunk_size", "overlap").orderBy("segment_index", "at"))
    both = whole.unionByName(texts.select(*whole.columns)).withColumn("n", n)
    return both.select(
        "doc_id", *keep, F.format_string("%s_%s_%04d", "doc_id", "segment_type", "n").alias("chunk_id"), F.col("segment_type").alias("chunk_type"), "content",
        F.length("content").alias("char_len"), F.col("segment_index").alias("source_segment_index"), "chunk_size", "overlap",
    )


def chunk_grid(docs: DataFrame, sizes: Iterable[int] = (256, 512, 1024), overlaps: Iterable[int] = (50, 100, 200), **names: str) -> DataFrame:
    """chunk_documents for every pair of size and overlap that is possible."""
    return _chunks(docs, _grid(sizes, overlaps), **names)


def _grid(sizes: Iterable[int], overlaps: Iterable[int]) -> list[tuple[int, int]]:
    overlaps = list(overlaps)
    pairs = [(s, o) for s in sizes for o in overlaps if o < s]
    if not pairs:
        raise ValueError("no pair of sizes is possible")
    for pair in pairs:
        check_sizes(*pair)
    return pairs


def normal_text(text: str) -> str:
    """normalize_document of a text without LINE_ENDS."""
    text = re.sub("\n{3,}", "\n\n", text.replace("\r\n", "\n").replace("\r", "\n"))
    return "\n".join([line.strip(BLANKS) for line in text.split("\n")]).strip(WHITE)


def window_lengths(texts: Sequence[str], pairs: Sequence[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pair's number and the length without outer white space of each window that cut() makes of each text for each pair."""
    n = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    here, none = np.arange(1, len(code) + 1, dtype=np.int32), np.zeros(1, np.int32)
    is_in = lambda marks: np.isin(code, [ord(m) for m in marks])
    # at each place the last end of a boundary of each kind, and of what is not white
    last = lambda hit: np.concatenate((none, np.maximum.accumulate(np.where(hit, here, 0)) if len(code) else none[:0]))
    white = is_in(WHITE)
    ends, shown = [], last(~white)
    for marks in BOUNDARIES:
        hit = is_in({m[-1] for m in marks})
        if marks == ("\n\n",):
            hit[1:] &= hit[:-1].copy()
            hit[:1] = False
        ends.append((last(hit), len(marks[0])))
    first = np.concatenate((np.minimum.accumulate(np.where(white, len(code), here - 1)[::-1])[::-1] if len(code) else none[:0], [len(code)]))
    stop, pair = np.tile(np.cumsum(n), len(pairs)), np.repeat(np.arange(len(pairs)), len(texts))
    start = stop - np.tile(n, len(pairs))
    size, overlap = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    soft = np.array([int(SOFT_FROM * s) for s, _ in pairs], np.int64)
    live, out = np.flatnonzero(start < stop), []
    while len(live) > FEW:
        at, which = start[live], pair[live]
        whole = at + size[which]
        done = whole >= stop[live]
        end = taken = np.minimum(whole, stop[live])
        for known, width in reversed(ends):
            soft_end = known[end]
            taken = np.where(soft_end - at >= np.maximum(soft[which], width), soft_end, taken)
        taken = np.where(done, stop[live], taken)
        out.append((which, np.maximum(0, shown[taken] - first[at])))
        start[live] = np.where(done, stop[live], taken - np.where(taken - at > overlap[which], overlap[which], 0))
        live = live[~done]
    rest: list[tuple[int, int]] = []
    for i in live.tolist():
        at, to, which = int(start[i]), int(stop[i]), int(pair[i])
        (width, back), least = pairs[which], int(soft[which])
        while at < to:
            done = at + width >= to
            taken = end = min(at + width, to)
            for known, long in () if done else ends:
                if (soft_end := int(known[end])) - at >= max(least, long):
                    taken = soft_end
                    break
            rest.append((which, max(0, int(shown[taken]) - int(first[at]))))
            at = to if done else taken - (back if taken - at > back else 0)
    out.append(tuple(np.array(c, np.int64) for c in zip(*rest)) if rest else (np.zeros(0, np.int64),) * 2)
    return tuple(np.concatenate(c) for c in zip(*out))  # type: ignore[return-value]


def grid_stats(docs: DataFrame, sizes: Iterable[int] = (256, 512, 1024), overlaps: Iterable[int] = (50, 100, 200), min_chars: int = MIN_CHARS, text_col: str = "text") -> DataFrame:
    """chunk_stats(chunk_grid(docs, sizes, overlaps), "chunk_size", "overlap"), without making the chunks: batches of texts hand on counts and lengths.

    The windows of all texts and pairs of a block of texts go on in step, by places of their boundaries.
    """
    pairs = _grid(sizes, overlaps)
    parts = segments(docs.select(F.col(text_col).alias("text"))).drop("text")
    is_text, content = F.col("segment_type") == "text", F.col("content")
    odd = F.contains(content, F.lit(LINE_ENDS[0])) | F.contains(content, F.lit(LINE_ENDS[1])) | F.contains(content, F.lit(LINE_ENDS[2]))
    rows = parts.select(is_text.alias("is_text"), odd.alias("odd"), F.when(is_text & odd, normalize_document(content)).otherwise(content).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(pairs)
        total, text, chars = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        low, high = np.full(n, np.iinfo(np.int32).max), np.full(n, -1)

        def add(which: np.ndarray, length: np.ndarray, of_text: int) -> None:
            count = np.bincount(which, minlength=n)
            total[:] += count
            text[:] += of_text * count
            np.add.at(chars, which, length)
            np.minimum.at(low, which, length)
            np.maximum.at(high, which, length)

        def block(texts: list[str]) -> None:
            which, length = window_lengths(texts, pairs)
            kept = length >= min_chars
            add(which[kept], length[kept], 1)

        held, size = [], 0
        for b in batches:
            for is_text, odd, content in zip(*(c.to_pylist() for c in b.columns)):
                if not is_text:
                    add(np.arange(n), np.full(n, len(content.strip(WHITE))), 0)
                    continue
                held.append(content if odd else normal_text(content))
                size += len(held[-1])
                if size >= GRID_CHARS:
                    block(held)
                    held, size = [], 0
        block(held)
        shown = np.flatnonzero(total)
        columns = [np.array([p[i] for p in pairs])[shown] for i in (0, 1)] + [c[shown] for c in (total, text, chars, low, high)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["chunk_size", "overlap", "total", "texts", "chars", "low", "high"])

    sums = rows.mapInArrow(run, "chunk_size long, overlap long, total long, texts long, chars long, low long, high long").groupBy("chunk_size", "overlap")
    found = sums.agg(*[F.sum(c).alias(c) for c in ("total", "texts", "chars")], F.min("low").alias("low"), F.max("high").alias("high"))
    return found.select(
        F.col("chunk_size").cast("int").alias("chunk_size"), F.col("overlap").cast("int").alias("overlap"), F.col("total").alias("total_chunks"), F.col("texts").alias("text_chunks"), (F.col("total") - F.col("texts")).alias("table_chunks"),
        F.round(F.col("chars").cast("double") / F.col("total"), 2).alias("avg_len"), F.col("low").cast("int").alias("min_len"), F.col("high").cast("int").alias("max_len"),
    )


def standard_chunks(docs: DataFrame, pairs: Sequence[tuple[int, int]] = ((1024, 50),), overrides: DataFrame | None = None) -> DataFrame:
    """Chunks of docs (doc_id, source_file, text) with their documents' metadata, the columns of a chunk file."""
    for pair in pairs:
        check_sizes(*pair)
    known = document_metadata(docs, overrides)
    title = document_title(*map(F.col, ("company", "year", "period", "doc_type", "doc_title", "source_file", "doc_id")))
    return _chunks(known.withColumn("doc_title", title), pairs, keep=(*FIELDS, "source_file"))


def chunk_stats(chunks: DataFrame, *by: str) -> DataFrame:
    """Counts by type and lengths of chunks."""
    return chunks.groupBy(*by).agg(
        F.count("*").alias("total_chunks"), F.count_if(F.col("chunk_type") == "text").alias("text_chunks"), F.count_if(F.col("chunk_type") == "table").alias("table_chunks"),
        F.coalesce(F.round(F.avg("char_len"), 2), F.lit(0.0)).alias("avg_len"), F.coalesce(F.min("char_len"), F.lit(0)).alias("min_len"), F.coalesce(F.max("char_len"), F.lit(0)).alias("max_len"),
    )
