"""WARC archives of pages: writing with payload de-duplication, a sorted capture index, reading back.

Null payloads count as empty. Equal payloads, empty ones too, are stored once: the record of the smallest page id
is the response, others are revisits of it; rows that share the smallest id are all responses. A null page id
counts as larger than any. A null or odd URL has the text itself as its key. A page whose id is null or beyond the
calendar has an empty capture time, which sorts first, and no date in its record. An empty table gives an empty
result; other columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.shared import broadcast_if_small, map_batches, materialise, scratch_path

#: A file is closed beyond this size; a longer record still goes into one file.
FILE_BYTES = 16 << 20
#: Distinct repeated payloads that are broadcast; more are joined by shuffle.
BROADCAST_PAYLOADS = 50_000
#: Captures that a task sorts in memory; of a run's row group, the unit of reading; of a range of the merged index.
RUN_ROWS, GROUP_ROWS, RANGE_ROWS = 200_000, 4096, 50_000
#: Runs that are merged at once, each with a row group in memory, and places among which the ranges' bounds are chosen.
FAN_IN, BOUNDS = 128, 100_000
#: Captures, and bytes of records, that are read together, and archives that a task keeps open.
WINDOW_ROWS, WINDOW_BYTES, OPEN_FILES = 1024, 8 << 20, 64
_EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
_URL = re.compile(r"(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)(?::\d+)?([^#]*)", re.I)
#: A capture; captures are ordered by the first four.
CAPTURE = pa.schema([("url_key", pa.string()), ("captured_at", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64())])
HISTORY = pa.schema([("position", pa.int64()), ("capture_no", pa.int64()), ("previous_page_id", pa.int64())])
#: A sorted run: its file, its captures, and the first place of each row group.
RUNS = "run string, rows long, firsts array<struct<url_key:string,captured_at:string,file:string,offset:long>>"


def url_key(url: str | None) -> str:
    """The host's labels in reverse order, then path and query, all in lower case, as capture indexes are sorted."""
    found = _URL.match(url or "")
    host, rest = (found[1], found[2]) if found else ("", url or "")
    host = re.sub(r"^www\d*\.", "", host.lower())
    return ",".join(reversed(host.split("."))) + ")" + (rest or "/").lower()


def captured_at(page_id: int | None) -> str:
    """The tables have no capture time: page n is taken as captured n seconds after 2020-01-01; empty for a null id or one beyond the calendar."""
    try:
        return "" if page_id is None else (_EPOCH + timedelta(seconds=page_id)).strftime("%Y-%m-%dT%H:%M:%SZ")
    except OverflowError:
        return ""


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, payload_digest: str) -> bytes:
    """One compressed member. A revisit has the payload's digest and length, not the payload."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", *([f"WARC-Date: {at}"] if (at := captured_at(page_id)) else []),
        f"WARC-Target-URI: {re.sub(r'\s', '', url or '')}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n") + squeeze.flush()


def parse(member: bytes) -> dict:
    """A record's fields; the payload's digest and length are computed where the payload is there, else taken from the headers."""
    data = zlib.decompress(member, 31)
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in (head + b"\r\n").decode().split("\r\n")[1:] if ": " in line)
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != length or digest(payload) != stated):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda x: int(x) if x else None
    return {"page_id": number(fields.get("X-Page-Id")), "payload_bytes": length, "payload_digest": stated, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("X-Refers-To-Page-Id"))}


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files in folder, and their captures as sorted runs; returned are the runs (RUNS).

    A task sorts RUN_ROWS captures at a time into a run, a Parquet file of CAPTURE beside the archives. A task that is
    run again writes files of new names; only files that the result names are ever read. folder is any URI that
    pyarrow's file systems reach.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("sha"))
    groups = rows.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("sha", "first_id")
    groups = materialise(groups, "payloads")
    placed = rows.join(broadcast_if_small(groups, BROADCAST_PAYLOADS), "sha", "left")
    refers = F.when(F.col("first_id") != F.coalesce(F.col("page_id"), F.col("first_id") + 1), F.col("first_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, stem = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        entries, out, name, at, number = [], None, "", 0, 0

        def sorted_run() -> pa.RecordBatch:
            run_name = f"run-{task:06d}-{uuid.uuid4().hex}.parquet"
            return _described([(run_name, *_write_run(fs, f"{root}/{run_name}", iter(sorted(entries, key=_sorted_key))))])

        for b in batches:
            for page_id, url, body, first in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name, at = f"run{task:06d}-{stem}-{number:05d}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                member = record(page_id, url, body, first, digest(body))
                out.write(member)
                entries.append((url_key(url), captured_at(page_id), name, at, len(member), page_id))
                if len(entries) == RUN_ROWS:
                    yield sorted_run()
                    entries = []
                at += len(member)
                if at >= FILE_BYTES:
                    out.close()
                    out, number = None, number + 1
        if out is not None:
            out.close()
        if entries:
            yield sorted_run()

    written = placed.select("page_id", "url", "payload", refers.alias("first"))
    return materialise(map_batches(written, run, RUNS), "runs")


class LoserTree:
    """K-way merge: inner nodes keep the losers of the matches between runs, so that the next least row takes one path of matches."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._replay(leaf, filling=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _replay(self, leaf: int, filling: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.losers[node] < 0 and filling:
                self.losers[node] = winner
                return
            if self.losers[node] >= 0 and self._beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[at := self.losers[0]] is not None:
            yield self.heads[at]
            self.heads[at] = next(self.runs[at], None)
            self._replay(at)


def _sorted_key(row: tuple) -> tuple:
    return row[:4]


def _write_run(fs: pyarrow.fs.FileSystem, path: str, rows: Iterator[tuple]) -> tuple[int, list[tuple]]:
    """Write rows of CAPTURE, which come in order, as one Parquet file; their number and the first place of every GROUP_ROWS."""
    n, firsts, held = 0, [], []
    with fs.open_output_stream(path, compression=None) as sink, pq.ParquetWriter(sink, CAPTURE, compression="zstd") as out:

        def flush() -> None:
            out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), CAPTURE)], schema=CAPTURE))
            firsts.append(_sorted_key(held[0]))

        for row in rows:
            held.append(row)
            n += 1
            if len(held) == GROUP_ROWS:
                flush()
                held.clear()
        if held:
            flush()
    return n, firsts


def _read_run(fs: pyarrow.fs.FileSystem, path: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """The rows of a run from low on and below high, one row group in memory; groups outside are not read."""
    with fs.open_input_file(path) as source:
        run = pq.ParquetFile(source)
        for g in range(run.metadata.num_row_groups):
            keys = run.metadata.row_group(g).column(0).statistics
            if keys is not None and keys.has_min_max and (low and keys.max < low[0] or high and keys.min > high[0]):
                continue
            for row in zip(*(c.to_pylist() for c in run.read_row_group(g).columns)):
                if (low is None or row[:4] >= low) and (high is None or row[:4] < high):
                    yield row


def _described(rows: list[tuple]) -> pa.RecordBatch:
    place = pa.struct([("url_key", pa.string()), ("captured_at", pa.string()), ("file", pa.string()), ("offset", pa.int64())])
    named = [(name, n, [dict(zip(("url_key", "captured_at", "file", "offset"), f)) for f in firsts]) for name, n, firsts in rows]
    types = [pa.string(), pa.int64(), pa.list_(place)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*named), types)] if named else [pa.array([], t) for t in types], ["run", "rows", "firsts"])


def _fewer_runs(runs: DataFrame, folder: str) -> DataFrame:
    """runs, merged in groups until there are at most FAN_IN."""
    while (n := runs.count()) > FAN_IN:
        groups = -(-n // FAN_IN)
        grouped = runs.groupBy(F.pmod(F.xxhash64("run"), F.lit(groups)).alias("group")).agg(F.sort_array(F.collect_list("run")).alias("names"))  # about FAN_IN names

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = pyarrow.fs.FileSystem.from_uri(folder)
            for b in batches:
                for names in b.column(0).to_pylist():
                    name = f"run-{uuid.uuid4().hex}.parquet"
                    yield _described([(name, *_write_run(fs, f"{root}/{name}", iter(LoserTree([_read_run(fs, f"{root}/{x}") for x in names]))))])

        runs = materialise(grouped.select("names").mapInArrow(merge, RUNS), "runs")
    return runs


def merged_index(runs: DataFrame, folder: str) -> list[tuple]:
    """Merge the sorted runs into index files in folder, one for each range of url key, time and place, in global order.

    Each range is one task's: it streams its slice of every run, a row group of each in memory, through a loser tree
    into its file. More than FAN_IN runs are merged in groups first. A range has about RANGE_ROWS captures by a
    sample of BOUNDS places, and no more memory if it has more. Returned is a row for each range: file name, number of
    captures, first key, last key, number of captures of the last key in the range, last page id.
    """
    runs = materialise(_fewer_runs(runs, folder), "few-runs")
    n = runs.agg(F.sum("rows")).first()[0] or 0
    names = sorted(r.run for r in runs.select("run").collect())
    firsts = runs.select(F.explode("firsts").alias("f")).orderBy(F.xxhash64("f"), "f").limit(BOUNDS).collect()
    places = sorted(tuple(r.f) for r in firsts)
    ranges = max(1, min(len(places), -(-n // RANGE_ROWS)))
    bounds = sorted({places[len(places) * k // ranges] for k in range(1, ranges)})
    ranges = len(bounds) + 1

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            for k in b.column(0).to_pylist():
                low, high = bounds[k - 1] if k else None, bounds[k] if k < len(bounds) else None
                seen = [None, None, 0, None]

                def watched(rows: Iterator[tuple]) -> Iterator[tuple]:
                    for row in rows:
                        seen[0] = row[0] if seen[0] is None else seen[0]
                        seen[2] = seen[2] + 1 if row[0] == seen[1] else 1
                        seen[1], seen[3] = row[0], row[5]
                        yield row

                name = f"index-{k:07d}-{uuid.uuid4().hex}.parquet"
                size, _ = _write_run(fs, f"{root}/{name}", watched(iter(LoserTree([_read_run(fs, f"{root}/{x}", low, high) for x in names]))))
                yield pa.RecordBatch.from_arrays([pa.array([x]) if x is not None else pa.nulls(1, t) for x, t in zip((k, name, size, *seen), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["range_no", "name", "n", "first", "last", "last_count", "last_page"])

    spark = runs.sparkSession
    done = materialise(spark.range(ranges, numPartitions=ranges).mapInArrow(merge, "range_no long, name string, n long, first string, last string, last_count long, last_page long"), "ranges")
    return [tuple(r)[1:] for r in done.orderBy("range_no").collect()]


def _ordered(spark: SparkSession, ranges: list[tuple], folder: str, rows_of: Callable[[pyarrow.fs.FileSystem, str, Iterator[tuple]], Iterator[tuple]], schema: pa.Schema) -> DataFrame:
    """rows_of the captures of each range, in global order; a capture is its row of CAPTURE, position, capture_no and previous_page_id.

    Positions and numbers are carried on over the ends of ranges by a tuple for each range.
    """
    carried, start, key, number, page_id = [], 0, None, 0, None
    for _, n, first, last, last_count, last_page in ranges:
        carried.append((start, key, number, page_id))
        if n:
            number = last_count + (number if first == key and last == key else 0)
            start, key, page_id = start + n, last, last_page

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)

        def numbered(k: int) -> Iterator[tuple]:
            at, key, number, page_id = carried[k]
            for row in _read_run(fs, f"{root}/{ranges[k][0]}"):
                number, before = (number + 1, page_id) if row[0] == key else (1, None)
                key, page_id = row[0], row[5]
                yield (*row, at, number, before)
                at += 1

        held: list[tuple] = []
        for b in batches:
            for k in b.column(0).to_pylist():
                for row in rows_of(fs, root, numbered(k)):
                    held.append(row)
                    if len(held) == WINDOW_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    ddl = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema)
    return spark.range(len(ranges), numPartitions=len(ranges)).mapInArrow(run, ddl)


def capture_history(runs: DataFrame, folder: str) -> DataFrame:
    """All captures in global order of URL key, time and place, with position (from 0), capture_no among the URL's captures (from 1) and the page id of the one before."""
    return _ordered(runs.sparkSession, merged_index(runs, folder), folder, lambda fs, root, rows: rows, pa.schema([*CAPTURE, *HISTORY]))


def _with_records(fs: pyarrow.fs.FileSystem, root: str, captures: Iterator[tuple]) -> Iterator[tuple]:
    """Captures with their records' fields, read from the archives that they name: some at a time, in the order of the files."""
    opened: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def member(file: str, offset: int, length: int) -> bytes:
        if file not in opened:
            if len(opened) == OPEN_FILES:
                opened.popitem(last=False)[1].close()
            opened[file] = fs.open_input_file(f"{root}/{file}")
        opened.move_to_end(file)
        opened[file].seek(offset)
        return opened[file].read(length)

    def finished(window: list[tuple]) -> Iterator[tuple]:
        fields = {i: tuple(parse(member(*window[i][2:5])).values()) for i in sorted(range(len(window)), key=lambda i: window[i][2:4])}
        return ((*row, *fields[i]) for i, row in enumerate(window))

    window, size = [], 0
    for row in captures:
        window.append(row)
        size += row[4]
        if len(window) == WINDOW_ROWS or size >= WINDOW_BYTES:
            yield from finished(window)
            window, size = [], 0
    yield from finished(window)
    for f in opened.values():
        f.close()


def read(runs: DataFrame, folder: str) -> DataFrame:
    """The archives' records in the order of capture_history(), whose columns they have, with what each record says: payload_bytes, payload_digest, record_type, refers_to."""
    fields = [("record_page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    return _ordered(runs.sparkSession, merged_index(runs, folder), folder, _with_records, pa.schema([*CAPTURE, *HISTORY, *fields]))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives, merge their capture runs and read every record back, in the order of the merged index."""
    folder = scratch_path(pages.sparkSession, "warc")
    back = read(write(pages, folder), folder)
    return back.withColumn("page_id", F.col("record_page_id")).drop("record_page_id")
