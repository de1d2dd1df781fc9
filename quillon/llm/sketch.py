"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

Null texts count as empty and have the empty sketch; a text of fewer than five words has its whole word sequence
as its one shingle. Repeated rows are fingerprinted each; rows of equal doc_id are ordered by a hash of their
text, null ids come last. A table of one row is its own next row; an empty table gives an empty result. Columns
other than the two named ones are dropped.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.shared import map_batches

SHINGLE_WORDS = 5
K = 128
#: Text of one range of ids, and the most ranges, whose firsts the driver holds; ranges grow beyond that.
RANGE_BYTES = 2 << 20
MAX_RANGES = 200_000


def sketch(text: str | None, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes of the text's shingles, ascending; ASCII letters count as lower case."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b]) for a, b in zip(starts, ends[SHINGLE_WORDS - 1 :].tolist())]
    return np.unique(np.array(hashes, np.uint64))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what two sketches stand for."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact where both sketches are whole sets; 1 for two empty sets."""
    union = np.union1d(a, b)
    if len(a) >= k or len(b) >= k:
        union = union[:k]
    if not len(union):
        return 1.0
    return float(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True).size / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has: J (|a| + |b|) / ((1 + J) |a|); 1 for an empty a."""
    j = resemblance(a, b, k)
    return min(1.0, j * (distinct(a, k) + distinct(b, k)) / ((1 + j) * distinct(a, k))) if len(a) else 1.0


def to_hex(a: np.ndarray) -> str:
    """Sixteen hex digits for each hash."""
    return a.astype(">u8").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def sketches(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", k: int = K) -> DataFrame:
    """The columns in keep and hashes array<long>, by which unsigned hashes are stored less 2**63 and so sort alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(sketch(t.as_py(), k) ^ np.uint64(1 << 63)).view(np.int64) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, pa.list_(pa.int64()))], [*keep, "hashes"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", hashes array<long>"
    return map_batches(docs.select(F.col(text_col).alias("__text"), *keep), run, schema)


def merged(sketched: DataFrame, part: str, k: int = K) -> DataFrame:
    """(part, hashes): the sketch of all documents of a part. Each task sends at most k hashes of a part."""
    spread = sketched.select(part, F.explode("hashes").alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy(part).orderBy("h"))
    return spread.withColumn("r", rank).filter(F.col("r") <= k).groupBy(part).agg(F.sort_array(F.collect_list("h")).alias("hashes"))


def edited(text: str, following: str) -> str:
    """text with its last third of code points replaced by the first as many of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id, text: str, mine: np.ndarray, following: str, theirs: np.ndarray, k: int) -> tuple:
    changed = edited(text, following)
    other = sketch(changed, k)
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), to_hex(mine), to_hex(other), resemblance(mine, other, k), resemblance(mine, theirs, k)


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likeness of the fingerprint to that and to the next document's.

    A first pass ranges ids and text hashes only and takes the first of each range, MAX_RANGES pairs at most. By
    these every document has a range; the first of a range is sent to the range before it as well, where it only
    follows. Then each task streams over its ranges in order, holding two texts at a time. Rows that equal the
    first of a range in id and text stand together, so which of them follows makes no difference.
    """
    names = [f.split()[0] for f in _RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    order = [F.col("id").desc_nulls_last(), F.col("h")]

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b.slice(0, 1) for b in batches if b.num_rows), None)
        if first is not None:
            yield first

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranged = picked.select("id", "h").repartitionByRange(min(MAX_RANGES, 1 + size // RANGE_BYTES), *order).sortWithinPartitions(*order)
    bounds = sorted({(r.id is None, -(r.id or 0), r.h) for r in ranged.mapInArrow(firsts, "id long, h long").collect()})
    n = max(1, len(bounds))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its range, and once more for the range before if it is the first of its own."""
        for b in batches:
            rows, at, follows = [], [], []
            for i, (doc, h) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                key = (doc is None, -(doc or 0), h)
                mine = bisect_right(bounds, key) - 1
                rows.append(i)
                at.append(mine)
                follows.append(False)
                if bounds[mine] == key:
                    rows.append(i)
                    at.append((mine - 1) % n)
                    follows.append(True)
            taken = [c.take(pa.array(rows, pa.int64())) for c in b.columns]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(at, pa.int32()), pa.array(follows, pa.bool_())], ["id", "h", "text", "range", "follows"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            rows = []
            for doc, text, at, follows in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if follows and last is None:
                    continue  # another copy of the row that followed
                text = text.as_py()
                mine = sketch(text, k)
                if last is not None:
                    rows.append(_row(*last, text, mine, k))
                last = None if follows else (doc, text, mine)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    placed = map_batches(picked, place, "id long, h long, text string, range int, follows boolean")
    dealt = placed.repartition("range").sortWithinPartitions("range", "follows", *order)
    return map_batches(dealt.select("id", "text", "range", "follows"), stream, _RESULT)
